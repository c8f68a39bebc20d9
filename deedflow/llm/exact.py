"""Operator 13: exact duplicates by progressive refinement, DataFrame functions only.

Texts are compared after every run of separators has become one space. A first
pass notes the length and a hash of the first 256 characters. Lengths that stand
alone are out, then beginnings that stand alone among texts of their length; only
what is left is hashed whole, and texts of equal SHA-256 are equal.

Scale: texts never move. What passes both tests is marked in a bitmap by the hash of
(length, beginning), of 16 MB at most however large the table; the second pass over
the texts looks its own rows up there. A bit set by others costs one more hash and
changes nothing. What moves are rows of an id and a digest, and of these only those
marked. A group's smallest id and size are partial sums, so a group of a third of
all rows is one row per task.

Defined cases: null texts are empty; a row of separators only is one space, and not
empty; null ids come after all others, so that a group is kept by a row with an id
if it has one; of rows that also share the smallest id one stays, which one is left
open. Other columns are not read; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small

PREFIX = 256
#: Bits of one row of a bitmap, as Spark's bitmap functions have it; bits of a whole bitmap at most (16 MB).
ROW_BITS, MOST_BITS = 1 << 15, 1 << 27


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def cut(df: DataFrame, *cols: str) -> DataFrame:
    """Values that stand more than once."""
    return materialise(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"), "repeated")


def marked(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A bitmap of the keys (column ``key``), in rows of 4 KB by number, and its size: 16 bits a key, 16 MB at most."""
    bits = ROW_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    at = F.pmod("key", F.lit(bits))
    rows = keys.groupBy(F.floor(at / ROW_BITS).cast("long").alias("at")).agg(F.bitmap_construct_agg((at % ROW_BITS).cast("long")).alias("bitmap"))
    return materialise(rows, "bitmap"), bits


def bit(bitmap: Column, place: Column) -> Column:
    """Whether a bit is set (a missing row has none)."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte, (place % 8).cast("int")) == 1, F.lit(False))


def duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    ``text_sha256`` is null for texts that are alone by length or beginning, which are not hashed, unless
    ``digest_all`` asks for it.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    head = F.xxhash64(F.substring("text", 1, PREFIX))
    noted = materialise(read.select(F.length("text").alias("length"), head.alias("head")), "beginnings")
    lengths = cut(noted, "length")
    beginnings = cut(noted.join(small(lengths, lengths.count()), "length", "left_semi"), "length", "head")
    key = F.xxhash64("length", "head")
    bitmap, bits = marked(beginnings.select(key.alias("key")), beginnings.count())
    place = F.pmod(F.xxhash64(F.length("text"), head), F.lit(bits))
    looked = read.withColumn("place", place).withColumn("at", F.floor(F.col("place") / ROW_BITS).cast("long")).join(F.broadcast(bitmap), "at", "left")
    left = bit(F.col("bitmap"), F.col("place") % ROW_BITS)
    full = F.sha2(F.col("text").cast("binary"), 256)
    hashed = looked.withColumn("left", left).select(
        "doc_id", "left", (full if digest_all else F.when(F.col("left"), full)).alias("text_sha256"), F.monotonically_increasing_id().alias("row")
    )
    hashed = materialise(hashed, "hashed")
    # known ids before null ones, then the smallest; the row's number decides between rows of one id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("row").alias("at")))
    groups = hashed.filter("left").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")).filter("group_size > 1")
    groups = materialise(groups.select("text_sha256", "group_size", F.col("first.id").alias("keep_id"), F.col("first.at").alias("keep_row")), "groups")
    result = lambda keep, size, kept: ("doc_id", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "text_sha256")
    alone = result(F.col("doc_id"), F.lit(1).cast("long"), F.lit(True))
    joined = hashed.filter("left").join(small(groups, groups.count()), "text_sha256", "left")
    single = F.col("group_size").isNull()
    found = result(F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1).cast("long")), single | (F.col("row") == F.col("keep_row")))
    return joined.select(*found).unionByName(hashed.filter(~F.col("left")).select(*alone))
