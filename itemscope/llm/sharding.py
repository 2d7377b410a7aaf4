"""Sharding along a Hilbert curve over several metadata dimensions.

Language, source and size of a document are quantised to ``2^bits`` levels each
(equally many distinct values a level for the names, equally many documents a
level for the sizes).  The cell of a document has a place on the Hilbert curve
through all cells; documents sorted by it are cut into runs of equal length, so
a shard covers a small box of every dimension and a reader that filters by any
of them skips most files (``shard_ranges`` has the boxes).

At scale: names get their place from a range-partitioned sort of the distinct
names; cells (at most ``2^(dimensions * bits)``) are the only broadcast table.
The place of a document comes from one range-partitioned sort of narrow rows
whose key ends in ``doc_id``, so a cell or a group of copies that holds a third
of all rows is dealt over many tasks; the partitions' counts are summed after.
Copies (equal size and crc) of one cell stand next to each other.  DataFrame
operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemscope.llm.common import numbered, stash

SHARDS = 24
BITS = 5
DIMENSIONS = ("lang", "source", "size")
LOCAL = (1 << 33) - 1  # monotonically_increasing_id: partition above, row below


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def size_class(size: Column) -> Column:
    """Floating-point like class of a size of at least 8: number of bits and the three bits below the first."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.call_function("shiftright", size, bits - 4) - 8).cast("int")


def hilbert_index(cells: DataFrame, axes: list[str], bits: int, out: str) -> DataFrame:
    """``cells`` with the place of the cell ``axes`` on the Hilbert curve (0 to 2^(len(axes) * bits) - 1).

    The axes' high bits are undone from top to bottom (exchange with or inversion
    of the first axis), Gray-coded, and their bits interleaved.
    """
    n = len(axes)
    work = [f"__h{i}" for i in range(n)]
    df = cells.withColumns({w: F.col(a).cast("bigint") for w, a in zip(work, axes)})
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for w in work:
            first, own = F.col(work[0]), F.col(w)
            inverted = own.bitwiseAND(F.lit(q)) != 0
            swap = first.bitwiseXOR(own).bitwiseAND(F.lit(low))
            step = {work[0]: F.when(inverted, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap))}
            if w != work[0]:
                step[w] = F.when(inverted, own).otherwise(own.bitwiseXOR(swap))
            df = df.withColumns(step)
    for before, w in zip(work, work[1:]):
        df = df.withColumn(w, F.col(w).bitwiseXOR(F.col(before)))
    flip = F.lit(0).cast("bigint")
    for level in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(work[-1]).bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1))
                               .otherwise(F.lit(0)))
    df = df.withColumn("__flip", flip)
    place = F.lit(0).cast("bigint")
    for level in range(bits - 1, -1, -1):
        for w in work:
            bit = F.shiftright(F.col(w).bitwiseXOR(F.col("__flip")), level).bitwiseAND(F.lit(1))
            place = place * 2 + bit
    return df.withColumn(out, place).drop(*work, "__flip")


def _ranked(rows: DataFrame, keys: list, parts: int | None = None) -> DataFrame:
    """``rows`` with their 0-based place ``rank`` in the order of ``keys`` (no task sees more than its range)."""
    spread = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    placed = stash(spread.sortWithinPartitions(*keys).withColumn("__mid", F.monotonically_increasing_id()))
    part = F.shiftright("__mid", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__c"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__start"))
    # one row a task of the sort above
    return (placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
            .withColumn("rank", F.col("__start") + F.col("__mid").bitwiseAND(F.lit(LOCAL)))
            .drop("__part", "__mid", "__start"))


def _name_levels(combos: DataFrame, name: str, levels: int) -> DataFrame:
    """Distinct values of ``name`` (null first, then by code points) -> level."""
    ranked = _ranked(combos.select(name).distinct(), [F.col(name).asc_nulls_first()])
    n = ranked.count()
    return ranked.select(F.col(name).alias(f"__{name}"),
                         F.expr(f"(rank * {levels}) div {max(n, 1)}").cast("int").alias(f"{name}_level"))


def _size_levels(combos: DataFrame, levels: int) -> DataFrame:
    """Size classes (a few hundred at most) -> level by the share of documents in smaller classes."""
    per = combos.groupBy("size_class").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("size_class").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    return per.select(F.col("size_class").alias("__size_class"), before.alias("b"), total.alias("t")).select(
        "__size_class", F.expr(f"(b * {levels}) div t").cast("int").alias("size_level"))


def curve_cells(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """``(lang, source, size_class)`` combinations of ``rows`` with their levels and place ``curve``."""
    levels = 1 << bits
    combos = stash(rows.groupBy("lang", "source", "size_class").agg(F.count("*").alias("n")))
    out = combos
    for name in ("lang", "source"):
        out = out.join(_name_levels(combos, name, levels), F.col(name).eqNullSafe(F.col(f"__{name}"))).drop(f"__{name}")
    out = out.join(_size_levels(combos, levels), F.col("size_class") == F.col("__size_class")).drop("__size_class")
    axes = [f"{d}_level" for d in DIMENSIONS]
    out = stash(out)
    cells = hilbert_index(out.select(*axes).distinct(), axes, bits, "curve")
    # at most 2^(3 * bits) cells, whatever the input
    return stash(out.join(F.broadcast(cells), axes))


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (its columns ``keep``, all by default) with ``(size, text_crc32, curve, shard, slot)``.

    Shards hold equal numbers of documents (at most one apart): document number
    r of n along the curve goes to shard ``floor(r * shards / n)``, ``slot`` is
    its place there from 0.  Ties on the curve go by size, crc and doc_id; rows
    equal in all of them are repeated rows and interchangeable.  A null text has
    size 8 and crc 0; null lang and source come first; a null doc_id first among
    its ties.  Fewer rows than shards leave some shards empty; an empty table
    gives an empty table.  Own columns with the new names are replaced.
    """
    keep = docs.columns if keep is None else keep
    base = docs.select(*[F.col(f"`{c}`") for c in keep],
                       *[F.col(f"`{c}`") for c in ("doc_id", "lang", "source", "text") if c not in keep])
    own = [c for c in keep if c not in ("size", "text_crc32", "curve", "shard", "slot")]
    rows = numbered(base.select(*[F.col(f"`{c}`") for c in own],
                                *[F.col(f"`{c}`") for c in ("doc_id", "lang", "source", "text") if c not in own]),
                    ["doc_id", "lang", "source", "text"])
    held = [f"own{i}" for i in range(len(own))]
    measured = rows.withColumns({
        "size": text_size(F.col("text")), "text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))})
    measured = measured.withColumn("size_class", size_class(F.col("size"))).select(
        *held, "doc_id", "lang", "source", "size", "text_crc32", "size_class")
    measured = stash(measured)
    cells = curve_cells(measured, bits).select(
        F.col("lang").alias("__l"), F.col("source").alias("__s"), F.col("size_class").alias("__k"), "curve")
    placed = measured.join(cells, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s"))
                           & (F.col("size_class") == F.col("__k"))).select(*held, "doc_id", "size", "text_crc32", "curve")
    n = measured.count()
    ranked = _ranked(placed, ["curve", "size", "text_crc32", F.col("doc_id").asc_nulls_first()])
    out = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div {max(n, 1)}").cast("int"))
    start = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    out = out.withColumn("slot", (F.col("rank") - start).cast("bigint"))
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, own)], "size", "text_crc32", "curve", "shard", "slot")


def shard_ranges(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """One row a shard: documents, bytes and the least and greatest of ``columns`` (what a reader prunes files by)."""
    return sharded.groupBy("shard").agg(
        F.count("*").alias("n_docs"), F.sum("size").alias("n_bytes"),
        *[f(F.col(f"`{c}`")).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=k`` a shard, rows in the order of their slots."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
