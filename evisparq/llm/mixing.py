"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Slot k of the mix takes the golden-ratio point frac(k * phi), which falls into one
source's part of the cumulative weights; the slot's rank among those of its source names the block it takes.
A source's documents are shuffled by a seeded hash, laid end to end and cut into blocks of
equal tokens; when a source's blocks are used up its stream starts anew. Slots that a source has beyond its target go, in their order, to
the blocks that other sources lack, so that every block has a slot, and the slots are the order of the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .ranks import chunks_for, with_prefix

#: Tokens in a block.
BLOCK = 64
#: Slots whose ranks are counted together.
SLOT_CHUNK = 16_384
#: The whole mix's size as a share of all sizes, and the most that a source may take of its own size.
SHARE, MOST = 1.5, 2.0
WEIGHTS = (3.0, 1.0, 2.0)
SEED = 20_260_101
#: 2^-32 steps of the golden ratio's fraction: slots are placed in exact integer arithmetic.
GOLDEN = 2_654_435_769


def word_count(text: str) -> Column:
    """Number of runs without white space."""
    spaced = F.trim(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(spaced == "", 0).otherwise(F.size(F.split(spaced, " +"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, position, target`` from ``source, source_size``: shares by weight, none above ``most`` times its size.

    The excess of capped sources is shared by weight among the others until none is above. Weights repeat
    over the sources by code point, null last. The table has one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("position", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    # sources reach their caps in the order of cap / weight: the level at which the total is met is a prefix sum
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "position")
    up_to = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = (
        rows.withColumn("capped", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0)))
        .withColumn("free", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
        .withColumn("total", share * F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("free"))
        .withColumn("is_free", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("water", F.min(F.when(F.col("is_free"), F.struct(F.col("cap") / F.col("weight"), F.col("position"), F.col("level")))).over(whole)["level"])
    )
    return rows.select("source", "source_size", "position", F.least(F.coalesce(F.col("water") * F.col("weight"), F.col("cap")), F.col("cap")).cast("double").alias("target"))


def schedule(spark, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``id, position, nth``: for each slot of the mix its source and its rank among the source's slots.

    ``sources`` has ``position, target``, a row each. The points' range is cut into buckets, so that a slot is compared with the
    sources of its bucket only, however many there are.
    """
    by_position = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    n, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    slots = -(-int(total) // block) if total > 0 else 0
    shift = 32 - min(20, max(4, n.bit_length()))
    edge = lambda c: F.least(F.lit(1 << 32), F.round(c / total * (1 << 32)).cast("long"))
    edges = sources.where("target > 0").withColumn("done", F.sum("target").over(by_position))
    edges = edges.select("position", edge(F.col("done") - F.col("target")).alias("low"), edge(F.col("done")).alias("high")).where("low < high")
    # a point between two edges belongs to the source whose part ends behind it
    buckets = edges.select("position", "low", "high", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("bucket"))
    k = F.col("id")
    # k * GOLDEN mod 2^32 without overflow: the low 31 bits of k are enough after splitting
    point = F.pmod((k % (1 << 16)) * GOLDEN + F.pmod(F.floor(k / (1 << 16)) * GOLDEN, F.lit(1 << 16)) * (1 << 16), F.lit(1 << 32))
    rows = spark.range(slots).select("id", point.alias("point")).withColumn("bucket", F.shiftright("point", shift))
    mine = rows.join(scratch.sized(scratch.written(buckets, "edges")), "bucket").where((F.col("low") <= F.col("point")) & (F.col("point") < F.col("high")))
    return with_prefix(mine.select("id", "position", F.floor(k / SLOT_CHUNK).alias("chunk")), ["position"], "chunk", ["id"], name="nth").select("id", "position", "nth")


def blocks_taken(spark, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``position, nth, slot``: the blocks of each source's stream that the mix takes, as many as its target needs, and the place of each in the mix.

    The nth slot of a source is that of its nth block. The schedule gives a source its due number of slots but for a few: the slots that
    are left over are dealt, first slot first, to the blocks without one; as targets end within blocks, some blocks find none left
    and follow behind the last slot. No slot holds two blocks.
    """
    needed = scratch.written(sources.select("position", F.ceil(F.round("target") / block).alias("needed")), "needed")
    slots = scratch.written(schedule(spark, sources, block), "slots").join(scratch.sized(needed), "position")
    placed = slots.where("nth < needed").select("position", "nth", F.col("id").alias("slot"))
    given = scratch.written(slots.groupBy("position").agg(F.count(F.lit(1)).alias("given")), "given")
    lacks = needed.join(scratch.sized(given), "position", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < needed")
    more = lacks.select("position", F.explode(F.sequence(F.col("given"), F.col("needed") - 1)).alias("nth"))
    more = scratch.numbered(more, [F.col("nth"), F.col("position")], "turn")
    free = scratch.numbered(slots.where("nth >= needed").select("id"), [F.col("id")], "turn")
    spare = scratch.written(free, "free")
    n_spare = spare.count()
    end = sources.agg(F.coalesce(F.ceil(F.sum("target") / block), F.lit(0)).cast("long")).first()[0]
    dealt = more.join(scratch.sized(spare, n_spare), "turn", "left").select("position", "nth", F.coalesce("id", F.col("turn") - n_spare + end).alias("slot"))
    return placed.unionByName(dealt)


def row_key(id_col: str, text_col: str, seed: int = SEED) -> Column:
    """The seeded hash of a row's id and text by which its source is shuffled."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_key: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_slot`` of every row of ``docs``.

    ``first_slot`` is the place in the mix of the first block that holds words of the row; it is null for rows that aren't taken. ``taken`` is the number of words that the mix takes of the row, repeats counted; it is never above twice the size, and
    a source's sum is its target, rounded, for any number and size of sources. Null and empty texts have size 0 and are
    never taken; null sources form one source, the last. Rows of one id are told apart by their text. An
    empty table gives an empty result; other columns are ignored. ``with_key`` adds ``key``, see ``row_key``, and ``slots``: the first slot
    of each time that the mix goes through the row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), row_key(id_col, text_col, seed).alias("shuffle"))
    rows = scratch.written(rows, "sizes")
    sources = scratch.written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    n = rows.count()
    by_source = sources.withColumnRenamed("source", "of")
    rows = rows.join(scratch.sized(by_source), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "shuffle", "source_size", "position", "target")
    chunks = chunks_for(n)
    rows = rows.withColumn("chunk", F.floor(F.shiftrightunsigned("shuffle", 1) / (2**63 // chunks)))
    placed = scratch.written(with_prefix(rows, ["position"], "chunk", ["shuffle", "doc_id"], "size", "begin").drop("chunk"), "placed")
    # block nth is words [nth * block, (nth + 1) * block) of its source's stream, which goes round at its end; the last one stops at the target
    whole = sources.where("target > 0").select("position", "target", "source_size")
    spans = blocks_taken(spark, whole.select("position", "target"), block).join(scratch.sized(whole), "position")
    spans = spans.withColumn("low", F.col("nth") * block).withColumn("high", F.least((F.col("nth") + 1) * block, F.round("target").cast("long"))).where("low < high")
    # a slot may pass the stream's end, and then goes on at its start
    laps = F.sequence(F.floor(F.col("low") / F.col("source_size")), F.floor((F.col("high") - 1) / F.col("source_size")))
    spans = spans.select("position", "slot", "low", "high", "source_size", F.explode(laps).alias("lap"))
    base = F.col("lap") * F.col("source_size")
    spans = spans.select("position", "slot", "lap", (F.greatest("low", base) - base).alias("low"), (F.least(F.col("high"), base + F.col("source_size")) - base).alias("high"))
    grid = F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))
    cells = spans.select("position", "slot", "lap", "low", "high", F.explode(grid).alias("cell"))
    cells = cells.select("position", "slot", "lap", "cell", F.greatest("low", F.col("cell") * block).alias("low"), F.least("high", (F.col("cell") + 1) * block).alias("high"))
    own = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))
    parts = placed.where("size > 0").select("position", "begin", "size", F.explode(own).alias("cell"))
    overlap = F.least(F.col("begin") + F.col("size"), F.col("high")) - F.greatest("begin", "low")
    met = parts.join(cells, ["position", "cell"]).withColumn("words", overlap).where("words > 0")
    # a source is gone through twice at most, and once more where its target is rounded
    lap_slots = F.array_compact(F.array(*[F.min(F.when(F.col("lap") == k, F.col("slot"))) for k in range(int(MOST) + 1)]))
    taken = met.groupBy("position", "begin").agg(F.sum("words").cast("long").alias("taken"), lap_slots.alias("slots"))
    # rows without words begin where others do, and take nothing
    joined = placed.where("size > 0").join(taken, ["position", "begin"], "left").unionByName(placed.where("size = 0"), allowMissingColumns=True)
    names = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.array_min("slots").alias("first_slot")]
    return joined.select(*names, *([F.col("shuffle").alias("key"), "slots"] if with_key else []))
