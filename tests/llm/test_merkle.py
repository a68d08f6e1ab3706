import hashlib
import zlib
from itertools import groupby

from evisparq.llm.merkle import build, manifest

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def brute(rows):
    def leaf(r, lower=False):
        r = list(r)
        if lower and r[4] is not None:
            r[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, at):
        out = []
        for level in levels[:-1]:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            out.append((run[: at % 16], run[at % 16 + 1 :]))
            at //= 16
        return out

    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(order, key=lambda r: r[1])]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for s, g in enumerate(groups):
        for i, r in enumerate(g):
            path = way(trees[s], i) + way(top, s)
            h = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for a, b in path:
                h = H("".join(a) + h + "".join(b))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H("".join("".join(a + b) for a, b in path)), h, h == top[-1][0]))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], COLUMNS + ", leaf string").repartition(3)


def test_sizes_around_the_fanout(spark):
    rows = [(100 * s + i, f"s{s}", "en", i, f"Text {i} É") for s, n in enumerate((1, 15, 16, 17, 300)) for i in range(n)]
    assert got(manifest(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, None, "de", 3, "Äb\n"), (1, None, "de", 3, "Äb\n"), (5, "z", None, None, "LOUD"), (5, "z", None, None, ""), (6, "", "x", 0, None), (7, "é", "-", 1, "-"), (8, "z\U0001f600", "", 2, "A" * 100_000)]
    rows += [(i, f"many{i % 40}", "en", 1, "Same Text") for i in range(100, 200)]
    assert got(manifest(frame(spark, rows))) == brute(rows)
    one = [(3, "a", "en", 1, "T")]
    assert got(manifest(frame(spark, one))) == brute(one)
    assert manifest(frame(spark, rows).limit(0)).collect() == []


def test_store_keeps_levels_in_order(spark, tmp_path):
    nodes = spark.range(1000).selectExpr("id % 3 AS tree", "id div 3 AS pos", "IF(id % 3 = 0, 334L, 333L) AS n", "sha2(string(id), 256) AS hash")
    levels = build(nodes, f"file://{tmp_path}/store", 334)
    assert [x.count() for x in levels] == [63, 6, 3, 3][: len(levels)] and len(levels) == 4
    for k, level in enumerate(levels):
        for file in (tmp_path / "store" / f"level={k}").glob("*.parquet"):
            at = [(r.tree, r.run) for r in spark.read.parquet(f"file://{file}").collect()]
            assert at == sorted(at)


def test_query_equals_sql(compare):
    compare("op11_merkle")
