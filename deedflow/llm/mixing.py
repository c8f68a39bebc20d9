"""Operator 1: mix sources to target weights by a low-discrepancy schedule.

Every source's documents are put in a hash-shuffled line of words and the line
is cut into blocks of equal word counts. Slot i of the schedule takes the point
frac(i * golden ratio); the point's place among the cumulative target weights
names the source, and the slot's rank among that source's slots names the block
it plays. Any stretch of the schedule therefore holds each source in nearly its
target share. A source that needs more words than it has starts its line again.
The mix is the schedule's order: a document comes where the first slot that plays
it comes, and ``mixed_documents`` writes rows in that order.

Scale: texts are read once, for a narrow table of sizes. Positions in a line and
ranks in the schedule are two-level prefix sums (sub-buckets of a bounded row
count, then sums over sub-buckets), so a source holding a third of all rows is
no single task. Only the catalogue of sources (one row each) is sorted whole.

Defined cases: null or blank texts have size 0 and are never taken; a null
source is a source of its own, last in order; null ids and repeated rows are
rows like others (which of two equal rows comes first is left open); ties of the
shuffle are ordered by text hash and id; other columns are not read; an empty
table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, copy_number, materialise, small, unit_hash, unused, word_count

GOLDEN = 0.6180339887498949
#: frac(2**20 * golden ratio), so that large slot numbers keep their precision.
GOLDEN_HIGH = (1 << 20) * 0.6180339887498949 % 1.0


@dataclass
class Mix:
    """``placed``: a row per document with its line position; ``slots``: the schedule; ``pieces``: the words each slot plays."""

    placed: DataFrame
    slots: DataFrame
    pieces: DataFrame


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Catalogue of sources with sizes and target words: shares by weight, each at most ``limit`` times the source."""
    catalogue = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)
    ranked = catalogue.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", weight).withColumn("cap", limit * F.col("source_size"))
    whole = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    filled = (
        ranked.withColumn("total", share * F.sum("source_size").over(whole))
        .withColumn("before", F.sum("cap").over(up) - F.col("cap"))
        .withColumn("open_weight", F.sum("weight").over(whole) - F.sum("weight").over(up) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("open_weight"))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    )
    # the first source that the level does not fill sets the level for all
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("level")))).over(whole)["level"]
    return filled.withColumn("target", F.least(F.coalesce(level * F.col("weight"), F.col("cap")), F.col("cap"))).select("sid", "source", "weight", "source_size", "n_rows", "target")


def golden_point(slot: Column) -> Column:
    """frac(slot * golden ratio), exact enough for any slot number."""
    low, high = slot % (1 << 20), F.floor(slot / (1 << 20))
    return (low * GOLDEN + high * GOLDEN_HIGH % 1.0) % 1.0


def schedule(spark: SparkSession, catalogue: DataFrame, n_sources: int, n_slots: int, chunk: int = 1 << 14, point: Callable[[Column], Column] = golden_point) -> DataFrame:
    """Slots (slot, sid, rank): low-discrepancy points through the cumulative block counts, ranked per source.

    Each source gets exactly its ``n_blocks``: points beyond that are skipped, and what is missing (a few
    blocks) follows at the end.
    """
    span = Window.orderBy("sid")
    bounds = catalogue.withColumn("hi", F.sum("n_blocks").over(span)).withColumn("lo", F.col("hi") - F.col("n_blocks"))
    bounds = bounds.select("sid", "n_blocks", (F.col("lo") / max(1, n_slots)).alias("lo"), (F.col("hi") / max(1, n_slots)).alias("hi")).filter("n_blocks > 0")
    cells = max(1, 4 * n_sources)
    held = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    i = F.col("slot")
    points = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", point(i)).withColumn("cell", F.floor(F.col("u") * cells))
    named = points.join(small(held, 5 * n_sources), "cell").filter("u >= lo and u < hi").select("slot", "sid", F.floor(i / chunk).alias("chunk"))
    per_chunk = named.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    base = per_chunk.withColumn("base", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).drop("n")
    inner = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = named.withColumn("k", F.row_number().over(inner) - 1).join(base.hint("merge"), ["sid", "chunk"]).select("slot", "sid", (F.col("base") + F.col("k")).alias("rank"))
    got = per_chunk.groupBy("sid").agg(F.sum("n").alias("got"))
    short = catalogue.filter("n_blocks > 0").join(small(got, n_sources), "sid", "left").select("sid", F.coalesce("got", F.lit(0)).alias("got"), "n_blocks").filter("got < n_blocks")
    tail = short.withColumn("before", F.sum(F.col("n_blocks") - F.col("got")).over(span) - (F.col("n_blocks") - F.col("got"))).select(
        "sid", "got", "before", F.explode(F.sequence(F.col("got"), F.col("n_blocks") - 1)).alias("rank")
    )
    tail = tail.select((F.lit(n_slots) + F.col("before") + F.col("rank") - F.col("got")).alias("slot"), "sid", "rank")
    kept = ranked.join(small(bounds.select("sid", "n_blocks"), n_sources), "sid").filter("rank < n_blocks").select("slot", "sid", "rank")
    return kept.unionByName(tail)


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, block: int = 256, rows_per_bucket: int = 1_000,
    point: Callable[[Column], Column] = golden_point,
) -> Mix:
    """Mix all documents: sources in code-point order weigh ``weights`` in turn and share ``share`` times all words.

    ``pieces`` says, per slot, which words (``start``, ``length``) of which document it plays, and in which round
    of its source (``epoch``). Documents are cut only at block ends. The same input gives the same mix. ``point`` names
    the schedule's point of a slot in [0, 1).
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    sized = materialise(d.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), unit_hash(F.col("doc_id"), F.xxhash64("text")).alias("u")), "sized")
    catalogue = materialise(targets(sized, weights, share, limit).withColumn("words", F.round("target").cast("long")).withColumn("n_blocks", F.ceil(F.col("words") / block)), "sources")
    n_sources, n_slots = catalogue.agg(F.count("*"), F.coalesce(F.sum("n_blocks"), F.lit(0))).first()
    n_sources = max(1, n_sources)
    named = sized.join(small(catalogue.withColumnRenamed("source", "s"), n_sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bucketed = named.withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("n_rows") / rows_per_bucket)))
    per_bucket = bucketed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    base = per_bucket.withColumn("base", F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).drop("n")
    inner = Window.partitionBy("sid", "bucket").orderBy("u", "text_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bucketed.withColumn("upto", F.sum("size").over(inner)).join(base.hint("merge"), ["sid", "bucket"]).withColumn("line_start", F.col("base") + F.col("upto") - F.col("size"))
    placed = materialise(placed.select("doc_id", "source", "text_hash", "sid", "size", "source_size", "target", "words", "n_blocks", "line_start"), "placed")
    slots = schedule(spark, catalogue, n_sources, n_slots, point=point)
    rounds = placed.filter("size > 0 and words > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("words") - 1) / F.col("source_size")).cast("int"))))
    rounds = rounds.withColumn("a", F.col("epoch") * F.col("source_size") + F.col("line_start")).filter("a < words")
    rounds = rounds.withColumn("z", F.least(F.col("a") + F.col("size"), F.col("words")))
    cut = rounds.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("z") - 1) / block))))
    begin = F.greatest("a", F.col("rank") * block)
    pieces = cut.join(slots.hint("shuffle_hash"), ["sid", "rank"]).select(
        "slot", "source", "epoch", "doc_id", "text_hash", "sid", "line_start", "size", (begin - F.col("a")).alias("start"), (F.least("z", (F.col("rank") + 1) * block) - begin).alias("length")
    )
    return Mix(placed, slots, pieces)


def taken_documents(mixed: Mix) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot, slots): a row per document, how many words the mix takes, and where.

    ``first_slot`` is the first slot of the schedule that plays the document (null: none does), ``slots`` how many do.
    """
    played = mixed.pieces.groupBy("sid", "line_start").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("slots"))
    zero = F.lit(0).cast("long")
    filled = mixed.placed.filter("size > 0").join(played.hint("merge"), ["sid", "line_start"], "left").withColumns({c: F.coalesce(c, zero) for c in ("taken", "slots")})
    blank = mixed.placed.filter("size = 0").withColumns({"taken": zero, "first_slot": F.lit(None).cast("long"), "slots": zero})
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "slots"]
    return filled.select(*columns).unionByName(blank.select(*columns))


def mixed_documents(docs: DataFrame, mixed: Mix, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", rows_per_part: int = 10_000) -> DataFrame:
    """The mix as documents, in the schedule's order: a row for each document and round it is taken in, its text the words taken, other columns as they were.

    Whole documents keep their text as it is; a document cut at the mix's end keeps its first words joined by spaces.
    Partitions are stretches of the schedule, in order, and so are the files written from them.
    """
    own, text_hash, own_source, copy_no = keys = unused(docs, "__id", "__hash", "__source", "__copy")
    keyed = docs.withColumn(own, F.col(id_col)).withColumn(text_hash, F.xxhash64(text_col)).withColumn(own_source, F.col(source_col).cast("string"))
    keyed = copy_number(keyed, keys[:3], copy_no)
    same = Window.partitionBy("doc_id", "text_hash", "source").orderBy("line_start")
    copies = mixed.placed.filter("size > 0").select("sid", "line_start", "doc_id", "text_hash", "source").withColumn("copy", F.row_number().over(same)).select("sid", "line_start", "copy")
    taken = mixed.pieces.groupBy("sid", "line_start", "epoch", "doc_id", "text_hash", "source", "size").agg(F.sum("length").alias("taken"), F.min("slot").alias("slot")).join(copies.hint("merge"), ["sid", "line_start"])
    fields = ("doc_id", "text_hash", "source", "copy", "size", "taken", "slot")
    names = dict(zip(fields, unused(docs, *[f"__t_{c}" for c in fields]), strict=True))
    taken = materialise(taken.select(*[F.col(c).alias(names[c]) for c in fields]), "taken")
    n, last = taken.agg(F.count("*"), F.coalesce(F.max(names["slot"]), F.lit(0))).first()
    t = {c: F.col(names[c]) for c in fields}
    same_row = F.col(own).eqNullSafe(t["doc_id"]) & (F.col(text_hash) == t["text_hash"]) & F.col(own_source).eqNullSafe(t["source"]) & (F.col(copy_no) == t["copy"])
    words = F.split(F.btrim(F.col(text_col), F.lit(SEPARATORS)), r"[\x20\x09-\x0D]+")
    text = F.when(t["taken"] == t["size"], F.col(text_col)).otherwise(F.array_join(F.slice(words, 1, t["taken"].cast("int")), " "))
    out = keyed.join(taken.hint("merge"), same_row).withColumn(text_col, text)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    parts = max(1, -(-n // rows_per_part))
    ordered = out.repartitionById(parts, F.floor(t["slot"] * parts / (last + 1)).cast("int")).sortWithinPartitions(names["slot"], own, copy_no)
    return ordered.select(*docs.columns)
