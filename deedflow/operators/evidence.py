"""Claims made of extracted entities, their citations resolved in page text, and coverage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedflow.functions import text
from deedflow.sources.scratch import ship, written

#: Widest range of pages a citation may span (last less first).
MAX_PAGE_RANGE = 10
ZERO_WIDTH = r"​‌‍﻿"
CLAIM_COLUMNS = ("document_id", "claim_type", "ordinal", "claim_text", "page_start", "page_end", "source_span", "section")


def squeezed(c: Column) -> Column:
    """A text without white space and zero-width characters: one that holds a span by tokens holds it squeezed, too."""
    return F.translate(c, text.WHITE_SPACE + ZERO_WIDTH, "")


def claims(parties: DataFrame, clauses: DataFrame, obligations: DataFrame, dates: DataFrame, flags: DataFrame) -> DataFrame:
    """One claims table (document_id, claim_type, ordinal, claim_text, page_start, page_end, source_span, section)."""

    def part(df: DataFrame, kind: str, claim: Column, section: Column) -> DataFrame:
        return df.select("document_id", F.lit(kind).alias("claim_type"), "ordinal", claim.alias("claim_text"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), "source_span", section.cast("string").alias("section"))

    optional = lambda label, c: F.coalesce(F.concat(F.lit(f" | {label}: "), F.col(c)), F.lit(""))
    none = F.lit(None)
    return (
        part(parties, "party", F.concat(F.lit("Party: "), "name", F.lit(" (Role: "), "role", F.lit(")")), F.lit("Parties"))
        .unionByName(part(clauses, "clause", F.concat(F.lit("Clause "), "clause_identifier", F.lit(": "), "title", F.lit(" (Category: "), "category", F.lit(")")), F.col("clause_identifier")))
        .unionByName(part(obligations, "obligation", F.concat(F.lit("Obligation: Obligor: "), "obligor", F.lit(" | Duty: "), "duty", optional("Deadline", "deadline"), optional("Trigger", "trigger")), none))
        .unionByName(part(dates, "date", F.concat(F.lit("Date: "), "description", F.lit(" ("), "date_type", F.lit("): "), "raw_text", F.coalesce(F.concat(F.lit(" [ISO: "), "normalized_date", F.lit("]")), F.lit(""))), none))
        .unionByName(part(flags, "review_flag", F.concat(F.lit("Review Flag ("), F.upper("severity"), F.lit("): "), "title"), none))
    )


def bare(token: str) -> str:
    return token.translate(_DROP)


_DROP = dict.fromkeys(map(ord, ZERO_WIDTH))
#: The characters that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = re.compile(f"[^{WHITE}]+")


def tokens(body: str) -> list[tuple[str, int, int]]:
    """Tokens without zero-width characters, and where each begins and ends less those at its edges; runs of nothing else are none."""
    out = []
    for m in RUN.finditer(body):
        t = m.group()
        if word := bare(t):
            out.append((word, m.end() - len(t.lstrip(ZERO_WIDTH)), m.start() + len(t.rstrip(ZERO_WIDTH))))
    return out


def places(page: str, spans: list[str]) -> list[tuple[int, int] | None]:
    """Where each span's tokens first stand in the page's, white space and zero-width characters aside (from, to; 0-based).

    The page is cut once; sums of its token numbers, weighted by powers, tell every run of tokens, so that a span is
    one comparison of arrays and what agrees is compared token by token.
    """
    cut = tokens(page)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(t, len(number) + 1) for t, _, _ in cut], np.uint64)
    power = np.full(len(ids) + 1, np.uint64(0x9E3779B97F4A7C15))
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * power[:-1], dtype=np.uint64)])
    found: list[tuple[int, int] | None] = []
    for span in spans:
        want = [t for t, _, _ in tokens(span)]
        n, hit = len(want), None
        if 0 < n <= len(cut) and all(t in number for t in want):
            value = (np.array([number[t] for t in want], np.uint64) * power[:n]).sum(dtype=np.uint64)
            for i in np.flatnonzero(sums[n:] - sums[: len(sums) - n] == value * power[: len(sums) - n]).tolist():
                if all(cut[i + k][0] == t for k, t in enumerate(want)):
                    hit = (cut[i][1], cut[i + n - 1][2])
                    break
        found.append(hit)
    return found


#: Spans that are looked up in one copy of a page.
SPANS = 1_000


def tolerant(missed: DataFrame, texts: DataFrame) -> DataFrame:
    """(t_document, t_start, t_end, t_span, t_from, t_to) of spans (r_document, r_start, r_end, span) found by tokens in the texts of their ranges.

    A range's text goes to one task for every ``SPANS`` of its spans.
    """
    ship(missed.sparkSession)
    key = ["r_document", "r_start", "r_end"]
    counted = missed.groupBy(*key).agg(F.ceil(F.count("*") / SPANS).cast("long").alias("blocks"))
    blocked = missed.join(counted.hint("merge"), key).withColumn("block", F.pmod(F.xxhash64("span"), F.col("blocks")))
    lists = blocked.groupBy(*key, "block").agg(F.collect_list("span").alias("spans"))
    asked = lists.join(texts.hint("merge"), key).select(*key, "spans", F.array_join(F.col("ps.pt"), "\n").alias("all"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, span, start, end = [], [], [], []
            for k, (spans, page) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("all").to_pylist(), strict=True)):
                for s, hit in zip(spans, places(page, spans), strict=True):
                    if hit:
                        row.append(k)
                        span.append(s)
                        start.append(hit[0])
                        end.append(hit[1])
            at = pa.array(row, pa.int64())
            columns = [batch.column(c).take(at) for c in key]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(span, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["t_document", "t_start", "t_end", "t_span", "t_from", "t_to"])

    kinds = dict(missed.dtypes)
    return asked.mapInArrow(look, f"t_document {kinds['r_document']}, t_start {kinds['r_start']}, t_end {kinds['r_end']}, t_span string, t_from int, t_to int")


def page_ranges(cited: DataFrame, pages: DataFrame) -> DataFrame:
    """(r_document, r_start, r_end, ps, absent) of the cited ranges of pages: their pages' texts in order, and the first missing page.

    An equi-join per page instead of a range join, at most 11 rows a range. Of page rows that repeat a number the
    first in order of text counts.
    """
    p = pages.select(F.col("document_id").alias("pd"), F.col("page_number").cast("int").alias("pn"), F.coalesce("text", F.lit("")).alias("pt"))
    wanted = cited.select(F.col("document_id").alias("r_document"), F.col("page_start").alias("r_start"), F.col("page_end").alias("r_end")).distinct()
    needed = wanted.withColumn("need", F.explode(F.sequence("r_start", "r_end")))
    rows = needed.join(p.hint("merge"), (F.col("r_document") == F.col("pd")) & (F.col("need") == F.col("pn")), "left")
    grouped = rows.groupBy("r_document", "r_start", "r_end").agg(
        F.sort_array(F.collect_set(F.when(F.col("pn").isNotNull(), F.struct("pn", "pt")))).alias("all"), F.min(F.when(F.col("pn").isNull(), F.col("need"))).alias("absent")
    )
    once = F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["pn"] != x["pn"]))
    return grouped.select("r_document", "r_start", "r_end", once.alias("ps"), "absent")


def single_pages(pages: DataFrame) -> DataFrame:
    """As ``page_ranges``, of every page by itself: no claim is read for it."""
    once = pages.groupBy(F.col("document_id").alias("r_document"), F.col("page_number").cast("int").alias("r_start")).agg(F.min(F.coalesce("text", F.lit(""))).alias("pt"))
    ps = F.array(F.struct(F.col("r_start").alias("pn"), "pt"))
    return once.select("r_document", "r_start", F.col("r_start").alias("r_end"), ps.alias("ps"), F.lit(None).cast("int").alias("absent"))


def resolve(claims_: DataFrame, pages: DataFrame) -> DataFrame:
    """Claims with validation_status, match_type, char_start, char_end and reason of their citation; equal claims stay rows of their own.

    One page, or a range of pages joined by line ends; a range's span must begin on its first and end on its last
    page, offsets count in the joined text.
    """
    c = claims_.withColumn("span", text.strip(F.coalesce("source_span", F.lit(""))))
    proper = F.coalesce((F.col("page_start") >= 1) & (F.col("page_end") >= 1), F.lit(False))
    one = F.col("page_start") == F.col("page_end")
    fits = one | ((F.col("page_end") > F.col("page_start")) & (F.col("page_end") - F.col("page_start") <= MAX_PAGE_RANGE))
    # a page is a range that needs no claim: only claims of several pages are read before they are searched
    ranges = written(page_ranges(c.filter(proper & fits & (F.col("page_start") < F.col("page_end"))), pages), "ranges")
    texts = single_pages(pages).unionByName(ranges)
    same_range = lambda d, a, z: (F.col("document_id") == F.col(d)) & (F.col("page_start") == F.col(a)) & (F.col("page_end") == F.col(z))
    joined = c.join(texts.hint("merge"), same_range("r_document", "r_start", "r_end"), "left")
    absent = F.when(F.col("r_document").isNull(), F.col("page_start")).otherwise(F.col("absent"))  # a claim without document has no pages
    joined = joined.withColumns({"absent": absent, "all": F.array_join(F.col("ps.pt"), "\n"), "proper": proper, "one": one, "fits": proper & fits})
    blank = text.strip(F.col("all")) == ""
    search = F.col("fits") & F.col("absent").isNull() & (F.col("span") != "") & ~blank
    place = F.when(search, F.instr("all", F.col("span")) - 1)
    ends = F.aggregate("ps", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pn:int,z:int>>").alias("out")), lambda a, x: F.struct((a["at"] + F.length(x["pt"]) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(x["pn"].alias("pn"), (a["at"] + F.length(x["pt"])).alias("z")))).alias("out")))["out"]
    # the exact search first; of spans that it misses only those that stand in the squeezed text are looked up by tokens
    joined = joined.withColumns({"blank": blank, "place": place})
    likely = F.coalesce(F.when(F.col("place") == -1, F.contains(squeezed(F.col("all")), squeezed(F.col("span")))), F.lit(False))
    joined = joined.withColumns({"likely": likely, "ends": F.when(~F.col("one"), ends)}).drop("all", "ps", "r_document", "r_start", "r_end")
    joined = written(joined, "searched")
    missed = joined.filter("likely").select(F.col("document_id").alias("r_document"), F.col("page_start").alias("r_start"), F.col("page_end").alias("r_end"), "span").distinct()
    exact = F.when(F.col("place") >= 0, F.struct(F.col("place").alias("start"), (F.col("place") + F.length("span")).alias("end"), F.lit(True).alias("exact")))
    if missed.isEmpty():
        joined = joined.withColumn("found", exact)
    else:
        loose = tolerant(written(missed, "missed"), texts)
        again = joined.filter("likely").join(loose.hint("merge"), same_range("t_document", "t_start", "t_end") & (F.col("span") == F.col("t_span")), "left")
        hit = F.when(F.col("t_from").isNotNull(), F.struct(F.col("t_from").alias("start"), F.col("t_to").alias("end"), F.lit(False).alias("exact")))
        again = again.withColumn("found", hit).drop("t_document", "t_start", "t_end", "t_span", "t_from", "t_to")
        joined = joined.filter("not likely").withColumn("found", exact).unionByName(again)
    found = F.col("found")
    page_of = lambda place: F.get(F.filter("ends", lambda e: place < e["z"]), F.lit(0))["pn"]
    joined = joined.withColumn("on", page_of(found["start"])).withColumn("off", page_of(found["end"] - 1))
    right = F.col("one") | F.coalesce((F.col("on") == F.col("page_start")) & (F.col("off") == F.col("page_end")), F.lit(False))
    valid = found.isNotNull() & right
    missing = F.concat(F.lit("PAGE_"), F.col("absent").cast("string"), F.lit("_NOT_FOUND"))
    on_page = F.when(F.col("absent").isNotNull(), missing).when(F.col("span") == "", "EMPTY_SOURCE_SPAN").when(F.col("blank"), "PAGE_TEXT_EMPTY").when(found.isNull(), "SPAN_NOT_FOUND_ON_PAGE")
    over_pages = (
        F.when(F.col("span") == "", "EMPTY_SOURCE_SPAN")
        .when(F.col("page_end") < F.col("page_start"), "INVALID_PAGE_RANGE")
        .when(~F.col("fits"), "EXCESSIVE_PAGE_RANGE")
        .when(F.col("absent").isNotNull(), missing)
        .when(found.isNull(), "CROSS_PAGE_SPAN_NOT_FOUND")
        .when(~valid, F.concat(F.lit("PAGE_RANGE_MISMATCH_MATCHED_PAGES_"), F.coalesce(F.col("on").cast("string"), F.lit("?")), F.lit("_TO_"), F.coalesce(F.col("off").cast("string"), F.lit("?"))))
    )
    reason = F.when(~F.col("proper"), "INVALID_PAGE_NUMBER").when(F.col("one"), on_page).otherwise(over_pages)
    kind = F.when(~valid, "unmatched").when(~F.col("one"), "cross_page").when(found["exact"], "exact").otherwise("normalized_whitespace")
    return joined.select(
        *claims_.columns, F.when(valid, "VALID").otherwise("INVALID").alias("validation_status"), kind.alias("match_type"), F.when(valid, found["start"]).alias("char_start"), F.when(valid, found["end"]).alias("char_end"), reason.alias("reason")
    )


def coverage(documents: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per document: claims, valid, invalid and unverified ones, their ratio; documents without claims have zeros."""
    is_ = lambda s: F.count_if(F.col("validation_status") == s)
    counted = resolved.groupBy("document_id").agg(F.count("*").alias("total_claims"), is_("VALID").alias("valid_claims"), is_("INVALID").alias("invalid_claims"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    filled = documents.select("document_id").distinct().join(counted, "document_id", "left").select("document_id", zero("total_claims"), zero("valid_claims"), zero("invalid_claims"))
    total, valid = F.col("total_claims"), F.col("valid_claims")
    ratio = F.when(total == 0, 0.0).otherwise(F.bround(valid / F.greatest(total, F.lit(1)), 4))
    return filled.withColumns({"unverified_claims": total - valid - F.col("invalid_claims"), "coverage_ratio": ratio, "is_fully_covered": (total > 0) & (valid == total)})
