"""Mixing sources to target weights by systematic sampling.

Size of a document: its number of words.  Sources share the total of all sizes
by weight, no source above ``cap`` times its own size (the excess goes to the
others by weight until none is above).  Within a source every document expects
``target / source size`` copies; the running sum of the expected copies plus one
random offset per source crosses integers, and a document is taken once for
every integer crossed in its part.

The running sum needs a document's place in its source.  It is counted in two
levels, so no window ever holds a whole source: documents fall into size classes
(so that the copies spread evenly over sizes) and hash blocks of a few tens of
thousands of rows; only the blocks' counts are summed over a source.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemscope.llm.common import numbered, restored, stash

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one block holds on average at most.
BLOCK_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def offset(seed: int, source: Column) -> Column:
    """A number in [0, 1) fixed by seed and source (32 bits of md5)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``(source, size)`` rows -> ``(source, source_size, n_docs, target)``.

    Sources in code-point order (null last) weigh ``weights``, repeating.  The
    fixed point of capping and resharing is ``least(cap * size, level * weight)``
    with one level: with the sources ordered by cap per weight and the first k
    capped, the level the others share rises until no more need a cap and falls
    after, so it is the largest over k.  A null or
    negative size counts as 0; without words every target is 0.
    """
    per = (sizes.groupBy("source").agg(F.sum(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))).alias("source_size"),
                                       F.count("*").alias("n_docs")))
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("i", F.row_number().over(place) - 1).withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("bigint"))
    full = F.col("source_size") * cap
    by = Window.orderBy(full / F.col("w"), "i")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumns({
        "total": F.sum("source_size").over(everything),
        "below": F.coalesce(F.sum(full).over(before), F.lit(0)),
        "left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    level = (F.col("total") - F.col("below")) / F.col("left")
    per = per.withColumn("level", F.max(level).over(everything))
    target = F.least(full.cast("double"), F.col("level") * F.col("w"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 0,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of ``docs`` (its ``doc_id, source, text``) with
    ``(size, source_size, target, copies, taken)``.

    ``copies`` is how often the mix takes the document (0 to ``cap``), ``taken``
    is copies * size.  A null text or one without words has size 0 and takes no
    words.  Repeated rows are ordered by id and text and counted one by one.  The
    same input gives the same result at any partitioning.  An empty table gives
    an empty table.
    """
    own = docs.select("doc_id", "source", "text")
    sized = stash(own.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                             F.xxhash64("text").alias("th")))
    return _placed(sized, weights, cap, seed, block_rows).drop("th")


def _placed(sized: DataFrame, weights, cap: int, seed: int, block_rows: int) -> DataFrame:
    targets = stash(source_targets(sized, weights, cap))
    n = targets.agg(F.sum("n_docs")).first()[0] or 0
    blocks = max(1, -(-n // block_rows))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = sized.withColumns({
        "class": F.floor(F.log(F.col("size") + 1.0) * 6 + 0.0001).cast("int"), "key": key,
        "block": F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") * blocks / 4294967296.0).cast("bigint")})
    counts = rows.groupBy("source", "class", "block").agg(F.count("*").alias("c"))
    per_class = counts.groupBy("source", "class").agg(F.sum("c").alias("c"))
    earlier = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    per_class = per_class.select(F.col("source").alias("s"), F.col("class").alias("k"),
                                 F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("by_class"))
    ahead = Window.partitionBy("source", "class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = (counts.withColumn("in_class", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
             .join(per_class, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k")))
             .select(F.col("source").alias("s"), F.col("class").alias("k"), F.col("block").alias("b"),
                     (F.col("by_class") + F.col("in_class")).alias("start")))
    inside = Window.partitionBy("source", "class", "block").orderBy("key", "doc_id", "size", "th")
    ranked = rows.withColumn("r", F.row_number().over(inside))
    placed = (ranked.join(start, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k"))
                          & (F.col("block") == F.col("b")))
              .withColumn("rank", F.col("start") + F.col("r")).drop("s", "k", "b", "start", "r", "class", "block", "key"))
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    out = placed.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(seed, F.col("source"))
    crossed = F.floor(F.col("rank") * rate + u) - F.floor((F.col("rank") - 1) * rate + u)
    return (out.withColumn("copies", F.least(crossed, F.lit(cap)).cast("bigint"))
            .withColumn("taken", F.col("copies") * F.col("size")).drop("rank"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 0,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The mix itself: every row of ``docs``, all its columns, ``copies`` times."""
    sized = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                              F.xxhash64("text").alias("th")))
    n = (_placed(sized, weights, cap, seed, block_rows).where("copies > 0")
         .select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), F.col("source").alias("__s"), "copies")
         .groupBy("__d", "__t", "__s").agg(F.sum("copies").alias("__n")))
    # repeated rows share one entry; each takes its part of the copies
    left = numbered(docs, ["doc_id", "source", "text"]).withColumn("__th", F.xxhash64("text")).drop("text")
    twins = Window.partitionBy("doc_id", "__th", "source").orderBy(F.lit(0))
    placed = left.withColumns({"__i": F.row_number().over(twins), "__of": F.count("*").over(twins.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))})
    joined = placed.join(n, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t"))
                           & F.col("source").eqNullSafe(F.col("__s")))
    share = F.floor((F.col("__n") + F.col("__of") - F.col("__i")) / F.col("__of")).cast("int")
    return restored(joined.withColumn("__share", share).where("__share > 0")
                    .withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__share")))), docs)
