"""Columns of queries without SQL that SQL can compute, and shapes of the others, on the small tables."""

import duckdb
import pytest

from evisparq.llm import registry
from evisparq.llm.queries_corpus import crc_sql

SF = "/root/testdata/sf0.01"

WORDS = r"w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"

SQL = {
    "op1_token_counts": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents",
    "op3_sharding": f"SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc_sql('encode(x.text)')} AS text_crc32 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE length(text) < 2000) x",
    # levels of shares are met one source after the other: none of the test tables' sources reaches its cap more than once
    "op8_mixing": f"""WITH RECURSIVE {WORDS},
s AS (SELECT source, sum(len(w)) AS size FROM w GROUP BY source),
p AS (SELECT source, size, (ARRAY[3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY size / weight, source) AS n FROM p),
f AS (SELECT *, 1.5 * (SELECT sum(size) FROM p) AS total,
  coalesce(sum(2.0 * size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
water AS (SELECT min_by(level, n) AS level FROM (SELECT n, (total - capped) / free AS level, 2.0 * size / weight AS cap FROM f) WHERE level <= cap)
SELECT w.doc_id, len(w.w) AS size, f.size AS source_size, round(least(2.0 * f.size, weight * coalesce((SELECT level FROM water), 1e300)), 4) AS target
FROM w JOIN f ON w.source IS NOT DISTINCT FROM f.source""",
    "op10_quality": f"""WITH {WORDS},
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
again AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM hit, range(0, 3) t(o) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(again.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id)""",
}


@pytest.mark.parametrize("name", SQL)
def test_columns_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(SQL[name])
    names = [x[0] for x in want.description]
    rows = sorted(tuple(float(v) if names[i] == "target" else v if isinstance(v, bool) else int(v) for i, v in enumerate(r)) for r in want.fetchall())
    asked = {r[0] for r in rows}
    got = registry.queries()[name](spark, SF)
    mine = sorted(tuple(round(r[n], 4) if n == "target" else r[n] for n in names) for r in got.select(*names).collect() if r.doc_id in asked)
    assert len(mine) == len(rows) > 500
    for a, b in zip(mine, rows, strict=True):
        assert a == (pytest.approx(b) if "target" in names else b)
