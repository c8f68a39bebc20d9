"""Operator 5: shards along a Hilbert curve, DataFrame functions only.

Several metadata dimensions (source, language, length) are quantised to a few
bits each and every row gets its index on the Hilbert curve through that cube.
Rows sorted by the index are cut into runs, one a shard. Neighbours on the curve
are near each other in every dimension, so each shard's files hold narrow ranges
of all of them and filters on any can skip files.

Two laws: ``rows`` cuts runs whose row counts differ by one at most, ``bytes``
cuts runs of near equal size. Ties on the curve are ordered by a hash of id and
text, so a source or a group of copies that holds a third of all rows is cut like
any other run.

Scale: texts are read once for a narrow table; that is sorted by range
partitioning (sampled bounds, ties broken by the hash), written, and numbered by
per-partition counts. No task sees more than a partition.

Defined cases: null text has size 1 and the crc32 of nothing; null source or
language is a value of its own, last; null ids and repeated rows are rows like
others; other columns are not read; an empty table gives none; with fewer rows
than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small


def let(value: Column, body) -> Column:  # noqa: ANN001
    return F.transform(F.array(value), body)[0]


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index of a cell on the Hilbert curve; every axis holds integers of ``bits`` bits.

    The transform between axes and the curve's transposed index (Skilling 2004): undo excess rotations from the
    highest bit down, Gray-encode, then interleave the bits.
    """
    n = len(axes)

    def undo(x: Column, step: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), F.lit(bits - 1) - F.floor(step / n).cast("int"))
        low, i = bit - 1, (step % n).cast("int")
        own, head = F.get(x, i), F.get(x, F.lit(0))
        swap = own.bitwiseXOR(head).bitwiseAND(low)

        def renew(v: Column, j: Column) -> Column:
            inverted = F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)
            swapped = F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)
            return F.when(own.bitwiseAND(bit) != 0, inverted).otherwise(F.when(i == 0, v).otherwise(swapped))

        return F.transform(x, renew)

    steps = F.sequence(F.lit(0), F.lit((bits - 1) * n - 1))
    turned = F.aggregate(steps, F.array(*[a.cast("int") for a in axes]), undo)

    def gray(x: Column) -> Column:
        running = [F.get(x, F.lit(0))]
        for k in range(1, n):
            running.append(running[-1].bitwiseXOR(F.get(x, F.lit(k))))
        return let(F.array(*running), finish)

    def finish(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        flip = F.aggregate(
            F.sequence(F.lit(1), F.lit(bits - 1)),
            F.lit(0),
            lambda t, k: F.when(last.bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) != 0, t.bitwiseXOR(F.call_function("shiftleft", F.lit(1), k) - 1)).otherwise(t),
        )
        return let(F.transform(x, lambda v: v.bitwiseXOR(flip)), interleave)

    def interleave(x: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(bits * n - 1))

        def add(total: Column, place: Column) -> Column:
            axis, bit = (place % n).cast("int"), F.lit(bits - 1) - F.floor(place / n).cast("int")
            return total * 2 + F.call_function("shiftright", F.get(x, axis), bit).bitwiseAND(1)

        return F.aggregate(places, F.lit(0).cast("long"), add)

    return let(turned, gray)


def level(rank: Column, values: int, bits: int) -> Column:
    """A rank from 0 among ``values`` values, spread over ``bits`` bits."""
    return F.least(F.floor(rank * (1 << bits) / max(1, values)), F.lit((1 << bits) - 1)).cast("int")


def ranked(table: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Catalogue of a column's values with their rank, nulls last, and its size."""
    values = materialise(table.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")), "values")
    return values.withColumn(f"{column}_rank", F.row_number().over(Window.orderBy(F.col("v").asc_nulls_last())) - 1).drop("n"), values.count()


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("source", "lang"), shards: int = 16, law: str = "rows", bits: int = 6, rows_per_part: int = 10_000) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) of every row: runs along the Hilbert curve of ``dimensions`` and text length."""
    if law not in ("rows", "bytes"):
        raise ValueError("law is 'rows' or 'bytes'")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in dimensions], (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("tie")
    )
    table = materialise(narrow, "narrow")
    axes = []
    for c in dimensions:
        values, n = ranked(table, c)
        table = table.join(small(values, n), F.col(c).eqNullSafe(F.col("v")), "left").drop("v")
        axes.append(level(F.col(f"{c}_rank"), n, bits))
    # two steps for each doubling of the length
    axes.append(F.least(F.floor(2 * F.log2(F.col("size").cast("double"))), F.lit((1 << bits) - 1)).cast("int"))
    keyed = table.withColumn("curve", hilbert_index(axes, bits)).select("doc_id", "size", "text_crc32", "curve", "tie")
    total, total_bytes = table.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, -(-total // rows_per_part))
    order = ["curve", "tie", "doc_id", "text_crc32"]
    ranged = keyed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"))
    inner = Window.partitionBy("part").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("k", F.row_number().over(inner)).withColumn("b", F.sum("size").over(upto)).join(small(base, parts), "part")
    placed = placed.withColumn("rank", F.col("rows_before") + F.col("k") - 1)
    if law == "rows":
        # shard s holds ranks [ceil(s * total / shards), ceil((s + 1) * total / shards))
        placed = placed.withColumn("shard", F.floor(F.col("rank") * shards / F.lit(max(1, total))).cast("int"))
        placed = placed.withColumn("slot", F.col("rank") - F.ceil(F.col("shard").cast("long") * total / F.lit(shards)))
        return placed.select("doc_id", "size", "text_crc32", "curve", "shard", "slot")
    middle = F.col("bytes_before") + F.col("b") - F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / F.lit(max(1, total_bytes))), F.lit(shards - 1)).cast("int"))
    placed = materialise(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(small(first, shards), "shard").select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("rank") - F.col("first")).alias("slot"))
