"""Overlapping chunks of documents with page provenance, as one fold per document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedflow.functions import text

UNIT = "struct<text:string,page_number:int,page_id:string>"
CHUNK = "struct<text:string,page_start:int,page_end:int,page_ids:array<string>>"


@dataclass(frozen=True)
class Chunking:
    """Sizes in characters: a chunk is closed at ``target``; up to ``overlap`` are carried on; a tail below ``least`` joins the chunk before; more than ``most`` chunks are an error."""

    target: int = 600
    overlap: int = 120
    least: int = 80
    most: int = 2000


def page_units(page_text: Column, target: int = 600) -> Column:
    """Paragraphs of a page; one longer than ``target`` as its sentences. Blanks are dropped."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(page_text, F.lit("")), "\n\n"), text.strip), lambda p: p != "")
    pieces = lambda p: F.filter(F.transform(F.split(p, r"(?U)(?<=[.?!;])\s+"), text.strip), lambda s: s != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= target, F.array(p)).otherwise(pieces(p))))


def units(pages: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """(document_id, page_number, page_id, unit_index, text) in order of page and place."""
    return pages.select("document_id", "page_number", "page_id", F.posexplode(page_units(F.col("text"), config.target)).alias("unit_index", "text"))


def chunks(pages: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """(document_id, chunk_index, text, page_start, page_end, page_ids, char_count, token_estimate, content_hash).

    Pages (document_id, page_number, page_id, text) of a document meet in one row, already bounded by the document;
    its units are folded in order inside the JVM.
    """
    empty = F.array().cast(f"array<{UNIT}>")

    def joined(us: Column) -> Column:
        return text.strip(F.array_join(F.transform(us, lambda u: u["text"]), " "))

    def build(us: Column) -> Column:
        numbers = F.transform(us, lambda u: u["page_number"])
        ids = F.array_distinct(F.filter(F.transform(us, lambda u: u["page_id"]), lambda i: i.isNotNull()))
        return F.struct(joined(us).alias("text"), F.array_min(numbers).alias("page_start"), F.array_max(numbers).alias("page_end"), ids.alias("page_ids"))

    def carried(us: Column) -> Column:
        start = F.struct(F.lit(False).alias("full"), F.lit(0).alias("n"), empty.alias("out"))

        def take(s: Column, u: Column) -> Column:
            over = s["full"] | ((s["n"] + F.length(u["text"]) > config.overlap) & (F.size(s["out"]) > 0))
            return F.when(over, F.struct(F.lit(True).alias("full"), s["n"].alias("n"), s["out"].alias("out"))).otherwise(
                F.struct(F.lit(False).alias("full"), (s["n"] + F.length(u["text"])).alias("n"), F.concat(F.array(u), s["out"]).alias("out"))
            )

        back = F.aggregate(F.reverse(us), start, take, lambda s: s["out"])
        whole = lambda o: (F.size(o) == F.size(us)) & (F.size(us) > 1)
        return text.let(back, lambda o: F.when(whole(o), F.slice(o, 2, F.size(o))).otherwise(o))

    def length(us: Column) -> Column:
        return F.aggregate(us, F.lit(0), lambda n, u: n + F.length(u["text"])) + F.greatest(F.size(us) - 1, F.lit(0))

    def state(cur: Column, n: Column, out: Column) -> Column:
        return F.struct(cur.alias("cur"), n.cast("int").alias("n"), out.alias("out"))

    def step(s: Column, u: Column) -> Column:
        cur = F.array_append(s["cur"], u)
        n = s["n"] + F.length(u["text"]) + F.when(s["n"] > 0, 1).otherwise(0)
        close = lambda c: text.let(carried(c), lambda o: state(o, length(o), F.array_append(s["out"], build(c))))
        return F.when(n >= config.target, text.let(cur, close)).otherwise(state(cur, n, s["out"]))

    def finish(s: Column) -> Column:
        def tail(t: Column) -> Column:
            out, last = s["out"], F.element_at(s["out"], -1)
            merged = F.struct(
                text.strip(F.concat(last["text"], F.lit(" "), t)).alias("text"),
                last["page_start"].alias("page_start"),
                F.greatest(last["page_end"], F.element_at(s["cur"], -1)["page_number"]).alias("page_end"),
                F.array_distinct(F.concat(last["page_ids"], F.filter(F.transform(s["cur"], lambda u: u["page_id"]), lambda i: i.isNotNull()))).alias("page_ids"),
            )
            return F.when((F.length(t) >= config.least) | (F.size(out) == 0), F.array_append(out, build(s["cur"]))).otherwise(F.array_append(F.slice(out, 1, F.size(out) - 1), merged))

        return F.when(F.size(s["cur"]) == 0, s["out"]).otherwise(text.let(joined(s["cur"]), tail))

    unit = lambda p: F.transform(page_units(p["text"], config.target), lambda t: F.struct(t.alias("text"), p["page_number"].cast("int").alias("page_number"), p["page_id"].cast("string").alias("page_id")))
    ordered = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "page_id", "text"))).alias("ps"))
    all_units = F.flatten(F.transform("ps", unit))
    folded = ordered.select("document_id", F.aggregate(all_units, state(empty, F.lit(0), F.array().cast(f"array<{CHUNK}>")), step, finish).alias("cs"))
    too_many = F.raise_error(F.concat(F.lit("more than "), F.lit(config.most).cast("string"), F.lit(" chunks in document "), F.coalesce(F.col("document_id").cast("string"), F.lit("null"))))
    folded = folded.withColumn("cs", F.when(F.size("cs") > config.most, too_many).otherwise(F.col("cs")))
    rows = folded.select("document_id", F.posexplode("cs").alias("chunk_index", "c")).select("document_id", "chunk_index", "c.*")
    return rows.withColumns({"char_count": F.length("text"), "token_estimate": text.token_estimate(F.length("text")), "content_hash": F.sha2(F.col("text").cast("binary"), 256)})
