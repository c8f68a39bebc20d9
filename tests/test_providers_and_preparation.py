"""A stub provider in place of extraction, worded questions and lists, reports of many claims, briefs with answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from deedflow.operators import briefs, evidence, extraction, preparation, providers, trust

PAGES = "document_id long, page_number int, text string"


def stub():  # noqa: ANN201
    """A provider that workers get by value."""

    def lines(batch):  # noqa: ANN001, ANN201
        out = []
        for body in batch.column("text").to_pylist():
            if body == "broken":
                out.append("{")
            elif body == "none":
                out.append(None)
            elif body == "other":
                out.append(json.dumps({"parties": []}))
            else:
                out.append(json.dumps({"clauses": [{"clause_identifier": str(k), "title": t, "category": " PAYMENT" if k else "odd", "text": t, "source_span": t, "more": 1} for k, t in enumerate(body.split("|"))]}))
        return out

    return lines


def test_a_provider_replaces_clauses(spark):
    pages = spark.createDataFrame([(1, 2, "pay|send"), (1, 1, "one"), (2, 1, "broken"), (2, 2, "none"), (3, 1, "other"), (4, 1, "a||b"), (5, 1, None)], PAGES).repartition(3)
    good, rejected = providers.entities(providers.answers(pages, stub()), "clauses")
    assert [(r.document_id, r.page_number, r.ordinal, r.title, r.category) for r in good.orderBy("document_id", "ordinal").collect()] == [
        (1, 1, 1, "one", "general"), (1, 2, 2, "pay", "general"), (1, 2, 3, "send", "payment"), (4, 1, 1, "a", "general"), (4, 1, 2, "b", "payment"),
    ]
    assert sorted((r.document_id, r.page_number, tuple(r.violations)) for r in rejected.collect()) == [
        (2, 1, ("INVALID_RESPONSE",)), (2, 2, ("INVALID_RESPONSE",)), (3, 1, ("INVALID_RESPONSE",)), (4, 1, ("EMPTY_TITLE", "EMPTY_TEXT")), (5, 1, ("EMPTY_TITLE", "EMPTY_TEXT")),
    ]
    empty = pages.limit(0)
    claims = evidence.claims(extraction.parties(empty), good, extraction.obligations(empty), extraction.dates(empty), extraction.review_flags(empty))
    assert {r.validation_status for r in evidence.resolve(claims, pages).collect()} == {"VALID"}


def test_a_provider_must_answer_every_page(spark):
    with pytest.raises(Exception, match="0 answers to 1 pages"):
        providers.answers(spark.createDataFrame([(1, 1, "x")], PAGES), lambda batch: [])


def test_words(spark):
    documents = spark.createDataFrame([(1,), (2,)], "document_id long")
    parties = spark.createDataFrame([(1, 2, "Bolt"), (1, 1, "Acme"), (1, 3, "")], "document_id long, ordinal int, name string")
    dates = spark.createDataFrame([(1, 2, "effective_date", "May 1", "2026-05-01"), (1, 1, "renewal_deadline", "June", None), (1, 3, "milestone_date", "x", None)], "document_id long, ordinal int, date_type string, raw_text string, normalized_date string")
    facts = {r.document_id: r.facts for r in preparation.facts_to_confirm(documents, parties, dates).collect()}
    assert facts == {
        1: ["Confirm full legal entity names and signing authority for: Acme, Bolt", "Confirm advance notice cutoff date for renewal or termination (June)", "Verify actual effective date of agreement (2026-05-01)"],
        2: [preparation.CONFIRM_DEFAULT],
    }
    clauses = spark.createDataFrame([(1, 1, "c1", "", "liability"), (1, 2, "c2", "Law", "dispute_resolution"), (1, 3, "c3", "End", "termination")], "document_id long, ordinal int, clause_identifier string, title string, category string")
    flags = spark.createDataFrame([(1, 1, "odd", "Odd thing", "c9")], "document_id long, ordinal int, flag_type string, title string, clause_identifier string")
    asked = {(r.document_id, r.seq): r for r in preparation.prepared_questions(documents, flags, clauses).collect()}
    assert asked[1, 1].question.endswith("regarding Odd thing?") and asked[1, 1].clause_identifier == "c9"
    assert asked[1, 2].rationale == "Liability terms present in c1." and asked[1, 3].clause_identifier == "c2" and asked[2, 2].category == "jurisdiction"
    answered = spark.createDataFrame([(1, 2, "B?", True), (1, 1, "A?", True), (1, 3, "C?", False)], "document_id long, seq int, question string, needs_review boolean")
    made = {r.document_id: r for r in preparation.lists(documents, clauses, flags, answered).collect()}
    assert made[1].open_questions == ["Unresolved inquiry from analysis: A?", "Unresolved inquiry from analysis: B?"]
    assert preparation.lists(documents, clauses, flags).filter("document_id = 1").first().open_questions == [preparation.OPEN["standard_addenda"]]
    assert made[2].documents_to_bring == list(preparation.BRING_ALWAYS) and len(made[2].open_questions) == 2


def test_report_counts_of_one_large_document(spark):
    claims = spark.range(200_000).select(
        F.lit(1).cast("long").alias("document_id"), F.when(F.col("id") % 4 == 0, "INTERPRETATION").otherwise("DOCUMENT_FACT").alias("trust_tier"), F.lit("SAFE").alias("safety_status"),
        F.when(F.col("id") % 10 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")).alias("limitations"),
    )
    r = trust.report(claims, spark.createDataFrame([(1,), (2,)], "document_id long"))
    got = {x.document_id: x for x in r.collect()}
    assert got[1].tier_counts == {"INTERPRETATION": 50_000, "DOCUMENT_FACT": 150_000} and got[1].limitation_counts == {"A": 20_000, "B": 20_000}
    assert (got[1].total_claims, got[1].overall_status, got[2].tier_counts, got[2].overall_status) == (200_000, "SAFE", {}, "SAFE")
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(trust_tier" not in plan


def test_titles_have_bounds(spark):
    df = spark.createDataFrame([(" x ",), (None,), ("  ",), ("y" * 300,)], "t string").select(briefs.bounded_title(F.col("t"), "Untitled", 255).alias("t"))
    assert [r.t for r in df.collect()] == ["x", "Untitled", "Untitled", "y" * 255]
