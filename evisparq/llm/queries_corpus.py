"""Registered queries on the manifest of a corpus, its resampling towards a target, and repeated word spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .debruijn import remove_spans
from .merkle import manifest
from .resampling import resample


def crc_sql(blob: str) -> str:
    """SQL for the unsigned CRC-32 of a blob expression, bit by bit."""
    octets = f"list_transform(range(1, octet_length({blob}) + 1), lambda i: ('0x' || hex(({blob})[i:i]))::UBIGINT)"
    bit = "CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda v, s: {bit})"
    return f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: {byte}))"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _manifest_sql(levels: int = 6, top_levels: int = 4) -> str:
    """SQL with that many levels written out: enough for sources of 16^levels rows and 16^top_levels sources."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    steps = []

    def climb(prefix: str, count: int) -> None:
        """Tables prefix0 .. of nodes, and of each node the siblings before and after it."""
        for k in range(count):
            run = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
            steps.append(f"{prefix}{k}s AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS b, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS a FROM {prefix}{k})")
            steps.append(f"{prefix}{k + 1} AS (SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {prefix}{k} GROUP BY tree, pos // 16, n)")

    steps.append(f"d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, sha256({head} || {field('text')}) AS h, CASE WHEN doc_id IS NOT NULL AND {crc_sql('encode(doc_id::VARCHAR)')} % 5 = 0 THEN sha256({head} || {lowered}) END AS folded FROM documents)")
    steps.append("leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d)")
    steps.append("u0 AS (SELECT tree, pos, n, h FROM leaves)")
    climb("u", levels)
    steps.append(f"t0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM u{levels})")
    climb("t", top_levels)
    fold, proof, joins, at = "coalesce(folded, leaves.h)", [], [], 1
    for prefix, count, tree, pos in (("u", levels, "leaves.tree", "leaves.pos"), ("t", top_levels, "0", "leaves.tree")):
        for k in range(count):
            name = f"{prefix}{k}s"
            joins.append(f"JOIN {name} ON {name}.tree = {tree} AND {name}.pos = {pos} // {16**k}")
            proof.append(f"coalesce({name}.b || {name}.a, '')")
            steps_name = f"f{at}"
            joins.append(f"CROSS JOIN LATERAL (SELECT CASE WHEN {name}.n > 1 THEN sha256({name}.b || {fold} || {name}.a) ELSE {fold} END AS h) AS {steps_name}")
            fold, at = f"{steps_name}.h", at + 1
    return (
        f"WITH {', '.join(steps)} SELECT leaves.doc_id, leaves.h AS leaf, u{levels}.h AS subroot, t{top_levels}.h AS root, sha256({' || '.join(proof)}) AS proof_sha256, {fold} AS folded_root, {fold} = t{top_levels}.h AS verified "
        f"FROM leaves JOIN u{levels} ON u{levels}.tree = leaves.tree CROSS JOIN t{top_levels} {' '.join(joins)}"
    )


OP11_SQL = _manifest_sql()


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = rf"""
WITH w AS (
  SELECT k, doc_id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM (SELECT row_number() OVER () AS k, doc_id, 0 AS kind, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, 1, text FROM benchmark)),
f AS (SELECT k, kind, unnest(w) AS g FROM w),
b AS (SELECT g, {crc_sql("encode(g)")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM f)),
c AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f JOIN b USING (g) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM c),
sums AS (SELECT k, sum(gain) AS weight FROM f JOIN b USING (g) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY k),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::UBIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN sums USING (k) WHERE kind = 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
"""


def op13_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM t)),
hit AS (SELECT k, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
runs AS (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS g FROM (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 35 THEN 0 ELSE 1 END AS fresh FROM hit)),
spans AS (SELECT k, min(i) AS s, max(i) + 35 AS e FROM runs GROUP BY k, g),
gaps AS (SELECT k, s, e, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 1) AS p FROM spans),
cut AS (SELECT k, sum(e - s) AS n_removed, flatten(list(w[p:s - 1] ORDER BY s)) || any_value(w[z:]) AS kept FROM (SELECT *, max(e) OVER (PARTITION BY k) AS z FROM gaps) JOIN t USING (k) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(array_to_string(coalesce(kept, w), ' ')) AS kept_sha256
FROM t LEFT JOIN cut USING (k)
"""
