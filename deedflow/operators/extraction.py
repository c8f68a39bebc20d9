"""Parties, clauses, obligations, dates and review flags from pages (document_id, page_number, text)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedflow.functions import rules, text

#: Patterns of what is extracted. Blanks after a heading's mark do not reach into the next line.
NAME = r"[A-Z][A-Za-z0-9\s,\.\&]+?"
ROLE = r"""(?:\s*(?:\(|,)\s*["“']?([A-Za-z\s]+)["”']?\s*(?:\)|,))?"""
BETWEEN = rf"(?idU)between\s+({NAME}){ROLE}\s+and\s+({NAME}){ROLE}(?:\.|\;|\n|$)"
ROLE_LINE = rf"(?idU){text.any_word('|'.join(rules.ROLES))}\s*[:\-]\s*({NAME})(?:\n|\;|\.|$)"
HEADING = r"^(?:(?:Section|Article|Clause)[ \t]+)?([0-9IVXLCDM]+(?:\.[0-9]+)*|\b[A-Z]\b)[\.:\-][ \t]*([^\n\r]+)$"
MODALS = ("shall", "must", "agrees to", "is required to", "undertakes to")
MODAL = rf"(?iU)\b([A-Z][A-Za-z0-9\s]{{2,25}})\s+({'|'.join(MODALS)})\s+([^.;]+)"
#: What every match of the next two patterns begins with.
TRIGGERS, DEADLINES = ("upon", "in the event of", "if", "prior to"), ("within", "on or before", "by", "monthly on the ")
TRIGGER = r"(?iU)\b(upon\s+[^,]+|in the event of\s+[^,]+|if\s+[^,]+|prior to\s+[^,]+)"
DEADLINE = r"(?iU)\b(within\s+\d+\s+(?:days|months|business days)|on or before\s+[^,.;]+|by\s+no\s+later\s+than\s+[^,.;]+|monthly on the \d+(?:st|nd|rd|th)? day)"
DATES = (
    (r"(?iU)\b(\d{4})[-/](0[1-9]|1[0-2])[-/](0[1-9]|[12]\d|3[01])\b", "yyyy-M-d"),
    (rf"(?iU)\b({rules.MONTHS})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", "MMMM d yyyy"),
    (rf"(?iU)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({rules.MONTHS})\s+(\d{{4}})\b", "d MMMM yyyy"),
)


def comma_strip(c: Column) -> Column:
    return F.regexp_replace(text.strip(c), r"^,+|,+$", "")


def together(df: DataFrame) -> DataFrame:
    """A document's rows in one partition, so that all windows over its rows share one shuffle."""
    return df.repartition("document_id")


def parties(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, ordinal, name, role, source_span): first of each name and role of the first two pages."""
    first = pages.filter("page_number <= 2 and text is not null").select("document_id", "page_number", "text")
    # plain searches first: most pages hold neither a pair of parties nor a mark after a role
    no_hit = F.array().cast("array<string>")
    paired, marked = text.may_hold(F.col("text"), ("between",)), text.contains_any(F.col("text"), (":", "-"))
    # one pass over the page for either pattern; groups are read from what matched
    pair = F.when(paired, F.regexp_extract_all("text", F.lit(BETWEEN), F.lit(0))).otherwise(no_hit)
    line = F.when(marked, F.regexp_extract_all("text", F.lit(ROLE_LINE), F.lit(0))).otherwise(no_hit)
    spans = F.concat(
        F.transform(pair, lambda x, i: F.struct(F.lit(0).alias("kind"), i.alias("hit"), x.alias("span"))),
        F.transform(line, lambda x, i: F.struct(F.lit(1).alias("kind"), i.alias("hit"), x.alias("span"))),
    )
    match = first.filter(marked | paired).select("document_id", "page_number", F.explode(spans).alias("m"))
    between = match.select("document_id", "page_number", "m.kind", "m.hit", "m.span")
    span = F.col("span")
    role = lambda c: F.coalesce(F.nullif(text.strip(c), F.lit("")), F.lit("Party"))
    # one match gives the four groups; none of them can hold the mark between
    groups = F.split(F.regexp_replace(span, BETWEEN, "$1\x01$2\x01$3\x01$4"), "\x01")

    def side(at: int, name: Column, title: Column, kind: Column) -> Column:
        return F.struct(F.lit(at).alias("side"), comma_strip(name).alias("name"), title.alias("role"), kind.alias("kind"))

    two = text.let(groups, lambda g: F.array(side(0, g[0], role(g[1]), F.lit(0)), side(1, g[2], role(g[3]), F.lit(0))))
    # a name holds neither of the marks after a role, so that hits of several roles never overlap
    kind = F.array_position(F.array(*[F.lit(r.lower()) for r in rules.ROLES]), F.lower(F.regexp_extract(span, ROLE_LINE, 1))).cast("int")
    header = lambda k: F.get(F.array(*[F.lit(r) for r in rules.ROLES]), k - 1)
    one = text.let(kind, lambda k: F.array(side(0, F.regexp_extract(span, ROLE_LINE, 2), header(k), k)))
    every = between.select("document_id", "page_number", "hit", text.strip(span).alias("source_span"), F.explode(F.when(F.col("kind") == 0, two).otherwise(one)).alias("p"))
    every = every.select("document_id", "page_number", F.struct("p.kind", "hit", "p.side").alias("o"), "p.name", "p.role", "source_span")
    every = together(every.filter((F.length("name") > 2) & (F.length("name") < 80)))
    key = [F.lower("name"), F.lower("role")]
    once = every.withColumn("n", F.row_number().over(Window.partitionBy("document_id", *key).orderBy("page_number", "o"))).filter("n = 1")
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "o"))
    return once.select("document_id", "page_number", ordinal.alias("ordinal"), "name", "role", "source_span")


def clauses(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, ordinal, clause_identifier, title, category, text, source_span).

    A clause runs from its heading to the next; a page without headings gives the lines that start or end with a
    category's keyword. Of clauses with one identifier the first of the document counts.
    """
    p = pages.filter("text is not null").select("document_id", "page_number", "text")
    cut = F.filter(F.split("text", rf"(?md)(?={HEADING})"), lambda x: x.rlike(rf"(?md)\A{HEADING}"))
    lines = F.filter(F.transform(F.split("text", "\n"), text.strip), lambda x: x != "")
    group = lambda x, g: text.strip(F.regexp_extract(x, rf"(?md)\A{HEADING}", g))

    def clause(at: Column, identifier: Column, title: Column, body: Column, category: Column) -> Column:
        return F.struct(at.alias("at"), identifier.alias("clause_identifier"), title.alias("title"), body.alias("text"), category.alias("category"))

    def headed(part: Column, at: Column) -> Column:
        named = F.struct(F.concat(F.lit("Clause-"), group(part, 1)).alias("identifier"), group(part, 2).alias("title"), text.strip(part).alias("text"))
        typed = lambda x: text.let(F.lower(F.concat(x["title"], F.lit(" "), x["text"])), rules.lower_category)
        return text.let(named, lambda x: clause(at, x["identifier"], x["title"], x["text"], typed(x)))

    def edge(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in reversed(rules.CATEGORIES.items()):
            out = F.when(reduce(or_, [F.startswith(low, F.lit(w)) | F.endswith(low, F.lit(w)) for w in words]), name).otherwise(out)
        return out

    def loose(line: Column, at: Column) -> Column:
        return clause(at, F.concat(F.lit("Section-"), at + 1), F.left(line, F.lit(50)), line, text.let(F.lower(line), edge))

    found = text.let(cut, lambda parts: F.when(F.size(parts) > 0, F.transform(parts, headed)).otherwise(F.filter(F.transform(lines, loose), lambda x: x["category"].isNotNull())))
    every = together(p.select("document_id", "page_number", F.inline(found)))
    once = every.withColumn("n", F.row_number().over(Window.partitionBy("document_id", "clause_identifier").orderBy("page_number", "at"))).filter("n = 1")
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "at"))
    span = F.left("text", F.when(F.startswith("clause_identifier", F.lit("Clause-")), 300).otherwise(200))
    return once.select("document_id", "page_number", ordinal.alias("ordinal"), "clause_identifier", "title", "category", "text", span.alias("source_span"))


def page_sentences(pages: DataFrame, likely: Callable[[Column], Column]) -> DataFrame:
    """(document_id, page_number, at, sentence) of the sentences that are ``likely`` to hold what is sought; pages without one are not cut."""
    said = pages.filter(F.col("text").isNotNull() & likely(F.col("text")))
    return said.select("document_id", "page_number", F.posexplode(text.sentences(F.col("text"))).alias("at", "sentence")).filter(likely(F.col("sentence")))


def clauses_of_pages(found_clauses: DataFrame) -> DataFrame:
    """(document_id, page_number, on_page): the clauses of a page in order."""
    one = F.struct(F.col("ordinal").alias("ordinal"), "clause_identifier", "text")
    return found_clauses.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(one)).alias("on_page"))


def holding_clause(span: Column) -> Column:
    """Identifier of the first of the page's clauses (``on_page``) whose text holds the span."""
    return F.get(F.filter("on_page", lambda c: F.contains(c["text"], span)), F.lit(0))["clause_identifier"]


def obligations(pages: DataFrame, found_clauses: DataFrame | None = None) -> DataFrame:
    """(document_id, page_number, ordinal, obligor, duty, trigger, deadline, source_span, clause_identifier).

    The clause is the first of the page whose text holds the sentence; null without one (or without clauses given).
    """
    s, said = F.col("sentence"), F.col("said")
    # the search runs once; groups are read from what matched
    match = F.filter(F.array(F.regexp_extract(s, MODAL, 0)), lambda x: x != "")
    hit = page_sentences(pages, lambda c: text.may_hold(c, MODALS)).select("*", F.explode(match).alias("said"))
    part = lambda pattern, words: F.when(text.may_hold(s, words), text.found(s, pattern, 1))
    verb = hit.select(
        "document_id", "page_number", "at",
        text.strip(F.regexp_extract(said, MODAL, 1)).alias("obligor"),
        F.concat(text.strip(F.regexp_extract(said, MODAL, 2)), F.lit(" "), text.strip(F.regexp_extract(said, MODAL, 3))).alias("duty"),
        part(TRIGGER, TRIGGERS).alias("trigger"), part(DEADLINE, DEADLINES).alias("deadline"), s.alias("source_span"),
    )
    if found_clauses is None:
        linked = verb.withColumn("clause_identifier", F.lit(None).cast("string"))
    else:
        on_page = clauses_of_pages(found_clauses)
        linked = verb.join(on_page.hint("merge"), ["document_id", "page_number"], "left").withColumn("clause_identifier", holding_clause(F.col("source_span"))).drop("on_page")
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "at"))
    return linked.select("document_id", "page_number", ordinal.alias("ordinal"), "obligor", "duty", "trigger", "deadline", "source_span", "clause_identifier")


def date_hit(kind: int, style: str) -> Callable[[Column, Column], Column]:
    def hit(raw: Column, k: Column) -> Column:
        bare = F.replace(F.regexp_replace(raw, r"(\d+)(st|nd|rd|th)", "$1"), F.lit(","), F.lit(""))
        day = F.try_to_date(F.regexp_replace(bare, r"(?U)\s+", " "), style)
        return F.struct(F.lit(kind).alias("kind"), k.alias("hit"), text.strip(raw).alias("raw"), day.alias("day"))

    return hit


def dates(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, ordinal, date_type, raw_text, normalized_date, description, source_span), each text of a page once."""
    s = F.col("sentence")
    hits = []
    for i, (pattern, style) in enumerate(DATES):
        hits.append(F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), date_hit(i, style)))
    months = [m.lower() for m in rules.MONTHS.split("|")]
    likely = lambda c: text.may_hold(c, months) | c.rlike(r"(?U)\d{4}[-/]")
    found = page_sentences(pages, likely).select("document_id", "page_number", "at", "sentence", F.explode(F.flatten(F.array(*hits))).alias("x"))
    typed = together(found.withColumn("date_type", rules.date_type(s)))
    once = typed.withColumn("n", F.row_number().over(Window.partitionBy("document_id", "page_number", "x.raw").orderBy("at", "x.kind", "x.hit"))).filter("n = 1")
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "at", "x.kind", "x.hit"))
    return once.select("document_id", "page_number", ordinal.alias("ordinal"), "date_type", F.col("x.raw").alias("raw_text"), F.date_format("x.day", "yyyy-MM-dd").alias("normalized_date"), rules.date_description(F.col("date_type")).alias("description"), s.alias("source_span"))


def flag_said(low: Column, phrases: str) -> Column:
    """A page (``text``, folded in ``low``) says one of a flag's phrases."""
    return text.contains_any(low, phrases.split("|")) & F.col("text").rlike(rf"(?iU){text.any_word(phrases)}\b")


def may_be_flagged(page: Column) -> Column:
    return text.may_hold(page, [w for *_, phrases in rules.FLAGS for w in phrases.split("|")])


def with_flags(pages: DataFrame) -> DataFrame:
    """(document_id) of pages with a review flag; no sentence is cut out."""
    said = text.let(text.folded(F.col("text")), lambda low: reduce(or_, [flag_said(low, phrases) for *_, phrases in rules.FLAGS]))
    return pages.filter(F.col("text").isNotNull() & may_be_flagged(F.col("text"))).filter(said).select("document_id")


def review_flags(pages: DataFrame, found_clauses: DataFrame | None = None) -> DataFrame:
    """(document_id, page_number, ordinal, flag_type, title, severity, source_span), each title of a page once.

    With clauses given, also ``clause_identifier``: the first of the page whose text holds the span, else null.
    """
    p = F.col("text")

    def hits(low: Column) -> Column:
        made = []
        for i, (kind, title, severity, phrases) in enumerate(rules.FLAGS):
            word = rf"{text.any_word(phrases)}\b"
            # a match begins where its sentence does, so that no other place is tried
            span = text.found(p, rf"(?iU)(?<![^.!?])([^.!?]*{word}[^.!?]*[.!?])", 1)
            made.append(F.when(flag_said(low, phrases), F.struct(F.lit(i).alias("kind"), F.lit(kind).alias("flag_type"), F.lit(title).alias("title"), F.lit(severity).alias("severity"), F.coalesce(span, F.lit(title)).alias("source_span"))))
        return F.array_compact(F.array(*made))

    hit = pages.filter(p.isNotNull() & may_be_flagged(p)).select("document_id", "page_number", F.explode(text.let(text.folded(p), hits)).alias("x"))
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "x.kind"))
    found = hit.select("document_id", "page_number", ordinal.alias("ordinal"), "x.flag_type", "x.title", "x.severity", "x.source_span")
    if found_clauses is None:
        return found
    joined = found.join(clauses_of_pages(found_clauses).hint("merge"), ["document_id", "page_number"], "left")
    return joined.withColumn("clause_identifier", holding_clause(text.strip(F.col("source_span")))).drop("on_page")


def linked(entities: DataFrame, clauses: DataFrame) -> DataFrame:
    """Entities with ``clause_id``: the id of their document's clause of that identifier (document_id, clause_identifier, clause_id)."""
    ids = clauses.select("document_id", "clause_identifier", "clause_id").dropDuplicates(["document_id", "clause_identifier"])
    return entities.join(ids.hint("merge"), ["document_id", "clause_identifier"], "left")
