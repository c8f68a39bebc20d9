"""Operator 7: document fingerprints by winnowing, DataFrame functions only.

Words are hashed, neighbouring hashes combined to hashes of k = 4 words (by
doubling: two passes), and of every window of w = 4 such hashes the smallest is
kept with its position, the rightmost of equal ones. Any run of k + w - 1 = 7
words that two texts share gives them a common fingerprint entry.

Scale: a text's fingerprint is made inside its row, in the JVM; no text is
exploded. A document's neighbour in id order comes from one shuffle of the texts
into ranges of ids, as many as the table needs, with the ends of ranges joined on.

Defined cases: null and empty texts (and blank ones) have the empty fingerprint;
a text of fewer than k words has one entry, of all its words; fewer than w
hashes are one window; two empty fingerprints are alike (1), an empty and another
one are not (0). Null ids come first in id order; rows that repeat an id follow
each other in order of their text's hash. Other columns are not read. A table of
one row is its own neighbour. Positions are exact up to 2 ** 24 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, materialise, small

K, W = 4, 4
#: Bits of a packed entry that hold the position (from the right end, so that the smallest is the rightmost).
PLACE = 24


def let(value: Column, body) -> Column:  # noqa: ANN001
    return F.transform(F.array(value), body)[0]


def neighbours(a: Column, step: int, join) -> Column:  # noqa: ANN001
    """Elements combined with those ``step`` further on."""
    m = F.size(a) - step
    return F.zip_with(F.slice(a, 1, m), F.slice(a, step + 1, m), join)


def fingerprint(text: Column) -> Column:
    """Array of packed entries in text order: hash in the high bits, position in the low ones; see ``entry_hashes``."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))
    pair = lambda a, b: F.xxhash64(a, b)
    smaller = lambda a, b: F.least(a, b)
    top = (1 << PLACE) - 1

    def selected(packed: Column) -> Column:
        n = F.size(packed)
        two = lambda x: neighbours(x, 1, smaller)
        windows = F.when(n >= W, let(two(packed), lambda x: neighbours(x, 2, smaller))).otherwise(F.array(F.array_min(packed)))
        return F.array_distinct(windows)

    def grams(h: Column) -> Column:
        packed = F.transform(h, lambda x, i: F.call_function("shiftleft", F.call_function("shiftrightunsigned", x, F.lit(PLACE + 1)), F.lit(PLACE)).bitwiseOR((F.lit(top) - i).cast("long").bitwiseAND(top)))
        return let(packed, selected)

    def hashed(w: Column) -> Column:
        enough = let(neighbours(w, 1, pair), lambda two: neighbours(two, 2, pair))
        return let(F.when(F.size(w) >= K, enough).otherwise(F.array(F.xxhash64(w))), grams)

    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(hashed(w)))


def entry_hashes(packed: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, PLACE)))


def entry_places(packed: Column) -> Column:
    """Word positions of a fingerprint's entries, from 0."""
    top = (1 << PLACE) - 1
    return F.transform(packed, lambda x: F.lit(top) - x.bitwiseAND(top))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every).cast("double")


def range_of(key: Column, edges: list[float]) -> Column:
    """Number of edges at or below the key (binary search)."""
    if not edges:
        return F.lit(0)
    table = F.array(*[F.lit(float(e)) for e in edges])
    steps = F.sequence(F.lit(1), F.lit(len(edges).bit_length()))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.get(table, F.least(mid, F.lit(len(edges) - 1))) <= key
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi")))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi")), halve)
    return F.when(key.isNull(), 0).otherwise(found["lo"])


def entry_list(packed: Column) -> Column:
    """A fingerprint as (place, hash), in text order; place is the k-gram's first word, from 0."""
    top = (1 << PLACE) - 1
    return F.transform(packed, lambda x: F.struct((F.lit(top) - x.bitwiseAND(top)).cast("int").alias("place"), F.shiftright(x, PLACE).alias("hash")))


def entries(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, entries) of every row: its ``entry_list``."""
    packed = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("p"))
    return packed.select("doc_id", entry_list(F.col("p")).alias("entries"))


def range_number(d: DataFrame, key: Column, ranges: int, most_edges: int) -> Column:
    """Number of the range of ids that a key lies in, rising with the key.

    Quantiles, ``most_edges`` of them at most, cut the ids; where more ranges are needed, the ids between two
    quantiles are cut evenly. Null keys are in range 0.
    """
    edges = min(ranges, most_edges)
    if edges < 2:
        return F.lit(0).cast("long")
    found = sorted(set(d.select(key.alias("k")).approxQuantile("k", [i / edges for i in range(edges + 1)], 1 / (4 * edges))))
    if len(found) < 2:
        return F.lit(0).cast("long")
    parts = -(-ranges // edges)
    table = F.array(*[F.lit(float(e)) for e in found])
    cell = F.greatest(F.least(range_of(key, found[1:-1]), F.lit(len(found) - 2)), F.lit(0))
    lo, hi = F.get(table, cell), F.get(table, cell + 1)
    inside = F.greatest(F.least(F.floor((key - lo) / (hi - lo) * parts), F.lit(parts - 1)), F.lit(0))
    return F.when(key.isNull(), 0).otherwise(cell.cast("long") * parts + inside)


#: Bytes of range ends that may be broadcast with their texts.
FOLLOWING_BYTES = 8 << 20


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 1_000, most_edges: int = 4_096) -> DataFrame:
    """(doc_id, text, print, next_text, next_print): every row beside the row that follows in id order, after the last the first.

    Texts are shuffled once, into ranges of ids; inside a range the next row is a window's lead.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = max(1, d.count() // rows_per_range)
    placed = d.withColumn("range", range_number(d, F.col("doc_id").cast("double"), ranges, most_edges))
    # the first row of each range, found without moving texts, serves the last row of the range before
    rank = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.xxhash64("text").alias("h"))
    firsts = materialise(placed.groupBy("range").agg(F.min(rank).alias("f")).select("range", F.col("f.doc_id").alias("first_id"), F.col("f.h").alias("first_hash")), "firsts")
    after = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy()))
    firsts = firsts.select(after.alias("before"), "first_id", "first_hash")
    found = d.join(small(firsts, ranges), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_hash"))).dropDuplicates(["before"])
    following = materialise(found.select(F.col("before").alias("range"), F.col("text").alias("first_text"), fingerprint(F.col("text")).alias("first_print")), "following")
    size = following.agg(F.coalesce(F.sum(F.octet_length("first_text") + 8 * F.size("first_print")), F.lit(0))).first()[0]
    ordered = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    inside = placed.repartition(F.col("range")).withColumn("print", fingerprint(F.col("text"))).withColumn("next_text", F.lead("text").over(ordered)).withColumn("next_print", F.lead("print").over(ordered))
    joined = inside.join(following.hint("broadcast" if size <= FOLLOWING_BYTES else "merge"), "range")
    return joined.select("doc_id", "text", "print", F.coalesce("next_text", "first_text").alias("next_text"), F.coalesce("next_print", "first_print").alias("next_print"))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, print, next_print, edited, edited_print) of every row.

    The edited text is the text with its last half replaced by as much of the next document's beginning.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    both = with_next(docs, id_col=id_col, text_col=text_col).withColumn("edited", edited).withColumn("n_chars", n.cast("long"))
    return both.select("doc_id", "n_chars", "print", "next_print", "edited", fingerprint(F.col("edited")).alias("edited_print"))
