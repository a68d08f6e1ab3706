"""A Merkle manifest of a dataset: a tree for each source, and one over the sources.

Nodes live in a store of Parquet tables, one for each level (``level=0``, ``level=1``, ...), whose rows are runs of sixteen
siblings in the order of their coordinates (tree, run). The leaves are sorted once; a level is made from the one below
by hashing its runs. Proofs go the other way: the runs of a level are merged with the proofs of the level above, which have
the same coordinates, so that a run of leaves meets the way to the root that all its leaves share once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Siblings in a run.
FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose id's checksum this number divides are tampered with.
TAMPERED = 5
#: Bytes of source names that may be broadcast.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "array<struct<before:string,after:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """The hash of a row: each value with its length in front, or a dash."""
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def _joined(hashes: Column | str) -> Column:
    return F.array_join(hashes, "")


def _runs(nodes: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """``tree, run, n, hashes, items`` from nodes ``tree, pos, n, hash``: sorted runs of siblings, whose ``items`` are the ``carried`` columns."""
    placed = nodes.withColumn("run", F.floor(F.col("pos") / fanout).cast("long")).repartitionByRange("tree", "run")
    rows = F.array_sort(F.collect_list(F.struct("pos", "hash", *carried)))
    runs = placed.groupBy("tree", "run").agg(F.first("n").alias("n"), rows.alias("_rows"))
    items = [F.transform("_rows", lambda x: F.struct(*[x[c].alias(c) for c in carried])).alias("items")] if carried else []
    return runs.select("tree", "run", "n", F.transform("_rows", lambda x: x["hash"]).alias("hashes"), *items).sortWithinPartitions("tree", "run")


def build(nodes: DataFrame, path: str, most: int, fanout: int = FANOUT, carried: list[str] | None = None) -> list[DataFrame]:
    """The levels of the trees over leaves ``tree, pos, n, hash``, written below ``path``; ``n`` is the number of a tree's nodes on the level and ``most`` the largest of them.

    A tree ends on the level on which it has one node.
    """
    spark = nodes.sparkSession
    levels: list[DataFrame] = []
    while True:
        made = _runs(nodes, fanout, (carried or []) if not levels else [])
        at = f"{path}/level={len(levels)}"
        made.write.parquet(at)
        levels.append(spark.read.schema(made.schema).parquet(at))
        if most <= 1:
            return levels
        up = levels[-1].where("n > 1")
        nodes = up.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.sha2(_joined("hashes"), 256).alias("hash"))
        most = -(-most // fanout)


def roots(levels: list[DataFrame]) -> DataFrame:
    """``tree, hash`` of each tree's last node."""
    found = None
    for level in levels:
        one = level.where("n = 1").select("tree", F.col("hashes")[0].alias("hash"))
        found = one if found is None else found.unionByName(one)
    return found


def _step(hashes: Column, i: Column) -> Column:
    """The siblings before and after the node ``i`` of a run."""
    return F.struct(_joined(F.slice(hashes, 1, i)).alias("before"), _joined(F.slice(hashes, i + 2, F.size(hashes))).alias("after"))


def proofs(levels: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``tree, run, n, hashes, items, path, subroot`` of the lowest level's runs: ``path`` leads from the parent of the run (of a lone leaf, from itself) to the root.

    ``above`` has ``tree, path, subroot``: the way from a tree's own root on.
    """
    known = None
    for level in reversed(levels):
        lone = level.where("n = 1").join(above, "tree")
        if known is not None:
            many = level.where("n > 1").join(known.withColumnRenamed("pos", "run"), ["tree", "run"])
            lone = lone.unionByName(many.select(*lone.columns))
        if level is levels[0]:
            return lone
        nodes = lone.select("tree", "run", "n", "hashes", "path", "subroot", F.posexplode("hashes").alias("i", "_hash"))
        way = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(_step(F.col("hashes"), F.col("i"))), F.col("path")))
        known = nodes.select("tree", (F.col("run") * fanout + F.col("i")).alias("pos"), way.alias("path"), "subroot")
    raise ValueError("a tree has one level at least")


def _small(sources: DataFrame) -> DataFrame:
    n, size = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("of")), F.lit(0))).first()
    return F.broadcast(sources) if n <= scratch.BROADCAST_ROWS and size <= BROADCAST_BYTES else sources


def fold(path: Column, start: Column) -> Column:
    """The root to which a leaf and its siblings lead."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def manifest(docs: DataFrame, path: str | None = None, fanout: int = FANOUT, tampered: int = TAMPERED, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    ``columns`` name the id, the source, further values, and the text last. Within a source leaves ascend by id; rows without an
    id come first and are never tampered with, rows of one id ascend by their hash, and rows alike in all are leaves of their own. Null sources
    form one source, the first. Null values are dashes, so that an empty text and none differ; a null text stays under
    tampering. A source of one row has its leaf as subroot, and a single source its subroot as root; a leaf that is alone all the
    way has no siblings, and the proof's hash is that of nothing. An empty table gives an empty result; other columns are ignored.
    ``path`` names the folder of the node store (``sources`` for the trees of sources, ``top`` for theirs); None makes one for this session.
    """
    spark = docs.sparkSession
    path = path or scratch.new_path(spark, "manifest")
    id_col, source_col, text_col = columns[0], columns[1], columns[-1]
    values = [F.col(c) for c in columns]
    key = F.col(id_col).cast("long")
    folded = F.when(F.crc32(key.cast("string").cast("binary")) % tampered == 0, leaf([*values[:-1], F.translate(F.col(text_col), UPPER, LOWER)]))
    leaves = docs.select(key.alias("doc_id"), F.col(source_col).alias("source"), leaf(values).alias("hash"), folded.alias("folded"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("hash"), F.xxhash64("_row")]
    # sorted once; the ranges of the sort are numbered on, and no source meets in one task
    placed = scratch.numbered(leaves, order, "_number").drop("_row")
    sizes = placed.groupBy("source").agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("n"))
    sources = scratch.written(scratch.numbered(sizes, [F.col("source").asc_nulls_first()], "tree").withColumnRenamed("source", "of"), "sources")
    trees, most = sources.agg(F.count(F.lit(1)), F.max("n")).first()
    if not trees:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    nodes = placed.join(_small(sources), F.col("source").eqNullSafe(F.col("of"))).select("tree", (F.col("_number") - F.col("_first")).alias("pos"), "n", "hash", "doc_id", "folded")
    low = build(nodes, f"{path}/sources", most, fanout, ["doc_id", "folded"])
    subroots = roots(low).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "hash")
    top = build(subroots, f"{path}/top", trees, fanout)
    root = roots(top).first()["hash"]
    end = spark.range(1).select(F.col("id").alias("tree"), F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"))
    ends = proofs(top, end, fanout).select("run", "n", "hashes", "path", F.posexplode("hashes").alias("i", "subroot"))
    way = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(_step(F.col("hashes"), F.col("i"))), F.col("path")))
    above = ends.select((F.col("run") * fanout + F.col("i")).alias("tree"), way.alias("path"), "subroot")
    runs = proofs(low, above, fanout)
    rows = runs.select("n", "hashes", "path", "subroot", F.posexplode("items").alias("i", "item"))
    whole = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(_step(F.col("hashes"), F.col("i"))), F.col("path")))
    rows = rows.select(F.col("item.doc_id").alias("doc_id"), F.element_at("hashes", F.col("i") + 1).alias("leaf"), "subroot", F.col("item.folded").alias("folded"), whole.alias("whole"))
    siblings = _joined(F.transform("whole", lambda x: F.concat(x["before"], x["after"])))
    found = rows.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("whole"), F.coalesce("folded", "leaf")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
