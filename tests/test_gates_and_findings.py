"""Row checks, ad-hoc claims, evidence of findings, briefs, evaluation, retrieval and replaced batches on small inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from deedflow.functions import rules
from deedflow.operators import answers, briefs, chunking, evaluation, evidence, extraction, findings, gates, matching, questions, tables, vectors
from deedflow.streaming import pages as streaming

PAGES = [
    (1, 1, 'This Agreement is made between Acme Corp ("Buyer") and Bolt LLC ("Seller").\nEffective Date: January 5, 2026.'),
    (1, 2, "1. Payment. Buyer shall pay 10 dollars within 5 days.\n2. Notices. Seller must give notice within 30 days."),
    (2, 1, 'This Agreement is made between Acme Corp ("Buyer") and Bolt LLC ("Vendor").\nEffective Date: January 5, 2026.'),
    (2, 2, "1. Payment. Buyer shall pay 12 dollars within 5 days.\n2. Notices. Seller must give notice within 60 days."),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "document_id long, page_number int, text string")


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(7, 1, 2)], "pair_id long, a_document_id long, b_document_id long")


def test_equal_claims_stay_rows_of_their_own(spark):
    p = spark.createDataFrame([(1, 1, "alpha end"), (1, 2, "begin beta"), (1, 3, "gamma"), (1, 3, "delta"), (None, 1, "x")], "document_id long, page_number int, text string")
    claims = [(1, 1, 2, "end\nbegin")] * 3 + [(1, 1, 1, "alpha")] * 2 + [(None, 1, 1, "x"), (1, 3, 3, "delta"), (1, 3, 3, "gamma"), (1, None, 1, "a"), (1, 2, 1, "a"), (1, 1, 12, "a"), (1, 1, 4, "a"), (1, 2, 2, "  ")]
    c = spark.createDataFrame(claims, "document_id long, page_start int, page_end int, source_span string")
    got = sorted((r.page_start or 0, r.page_end, r.source_span, r.validation_status, r.match_type, r.char_start, r.reason) for r in evidence.resolve(c, p).collect())
    want = [(1, 2, "end\nbegin", "VALID", "cross_page", 6, None)] * 3 + [(1, 1, "alpha", "VALID", "exact", 0, None)] * 2
    want += [(1, 1, "x", "INVALID", "unmatched", None, "PAGE_1_NOT_FOUND"), (3, 3, "delta", "VALID", "exact", 0, None), (3, 3, "gamma", "INVALID", "unmatched", None, "SPAN_NOT_FOUND_ON_PAGE")]
    want += [(0, 1, "a", "INVALID", "unmatched", None, "INVALID_PAGE_NUMBER"), (2, 1, "a", "INVALID", "unmatched", None, "INVALID_PAGE_RANGE"), (1, 12, "a", "INVALID", "unmatched", None, "EXCESSIVE_PAGE_RANGE")]
    want += [(1, 4, "a", "INVALID", "unmatched", None, "PAGE_4_NOT_FOUND"), (2, 2, "  ", "INVALID", "unmatched", None, "EMPTY_SOURCE_SPAN")]
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2])) or sorted(got, key=str) == sorted(want, key=str)


def test_repeated_pages_give_repeated_obligations(spark, pages):
    twice = pages.filter("document_id = 1").unionByName(pages.filter("document_id = 1 and page_number = 2"))
    n = extraction.obligations(twice, extraction.clauses(twice)).count()
    assert n == extraction.obligations(twice).count() == 4


def test_known_values_and_violations(spark):
    rows = [(1, " PAYMENT ", "  ", "x", 1, 2), (2, "odd", "Buyer", " ", 0, 1), (3, None, None, None, 3, 2)]
    df = spark.createDataFrame(rows, "document_id long, category string, role string, name string, page_start int, page_end int")
    got = {r.document_id: r for r in gates.violations(gates.coerced(df), "parties").collect()}
    assert [(got[i].category, got[i].role) for i in (1, 2, 3)] == [("payment", "Party"), ("general", "Buyer"), ("general", "Party")]
    assert [got[i].violations for i in (1, 2, 3)] == [[], ["EMPTY_NAME", "PAGE_START"], ["EMPTY_NAME", "PAGE_RANGE"]]
    valid, rejected = gates.split(gates.violations(df, "parties"))
    assert valid.count() == 1 and rejected.count() == 2
    assert gates.violations(df.limit(0), "parties").count() == 0


def test_ad_hoc_claims_are_bounded(spark):
    rows = [(1, 1, k, f"c{k}", "Date", None, None, "s") for k in range(51)] + [(2, 1, 1, "x" * 3000, None, 2, None, "y" * 6000), (2, 1, 2, " ", "date", 1, 1, "s")]
    df = spark.createDataFrame(rows, "request_id long, document_id long, seq int, claim_text string, claim_type string, page_start int, page_end int, source_span string")
    made, rejected = gates.ad_hoc_claims(df)
    assert [(r.request_id, r.reject_reason) for r in rejected.collect()] == [(1, "TOO_MANY_CLAIMS")]
    (r,) = made.collect()
    assert (len(r.claim_text), r.claim_type, r.page_start, r.page_end, len(r.source_span)) == (2000, "general_fact", 2, 2, 5000)


def test_no_evidence_no_claim(spark, pages, pairs):
    found = matching.diff_clauses(extraction.clauses(pages), pairs)
    fine = {(r.category, r.classification, r.trust_tier, r.safety_status, len(r.refs)) for r in findings.gated(found, pairs, pages).collect()}
    assert fine == {("PAYMENT", "MODIFIED", "DOCUMENT_FACT", "SAFE", 2), ("NOTICE", "MODIFIED", "DOCUMENT_FACT", "SAFE", 2)}
    gone = pages.withColumn("text", F.when((F.col("document_id") == 2) & (F.col("page_number") == 2), F.replace("text", F.lit("12"), F.lit("13"))).otherwise(F.col("text")))
    got = {r.category: r for r in findings.gated(found, pairs, gone).collect()}
    assert (got["PAYMENT"].classification, got["PAYMENT"].trust_tier, got["PAYMENT"].safety_status, got["PAYMENT"].notice) == ("UNRESOLVED", "PROFESSIONAL_REVIEW_NEEDED", "REVIEW_REQUIRED", findings.NOTICE)
    assert [x.validation_status for x in got["PAYMENT"].refs] == ["VALID", "INVALID"] and got["NOTICE"].classification == "MODIFIED"
    late = findings.gated(matching.compare_obligations(extraction.obligations(pages), pairs), pairs, pages).filter("classification = 'POTENTIAL_INCONSISTENCY'").collect()
    assert late and all((r.trust_tier, r.safety_status) == ("DOCUMENT_FACT", "REVIEW_REQUIRED") for r in late)


def test_diff_categories(spark):
    names = ["Parties", "termination", "notices", "payment", "governing", None, "obligation list", "miscellaneous"]
    df = spark.createDataFrame([(n,) for n in names], "c string").select(rules.diff_category(F.col("c")).alias("d"))
    assert [r.d for r in df.collect()] == ["PARTIES", "DATES", "NOTICE", "PAYMENT", "CLAUSE", "OTHER", "OBLIGATIONS", "OTHER"]


def test_briefs(spark, pages):
    more = pages.unionByName(spark.createDataFrame([(3, 1, "nothing of note")], pages.schema))
    c, f = extraction.clauses(more), extraction.review_flags(more)
    claims = evidence.claims(extraction.parties(more), c, extraction.obligations(more), extraction.dates(more), f)
    got = {r.document_id: r for r in briefs.assemble(more, claims, more, c, f).collect()}
    one = got[1].sections
    assert set(one) == {"parties", "clauses", "obligations", "dates"} and [x.title for x in one["parties"]["items"]] == ["Party: Acme Corp (Role: Buyer)", "Party: Bolt LLC (Role: Seller)"]
    assert got[1].score == 0.8 and got[1].n_items == got[1].n_supported == 7
    assert got[3].sections == {} and got[3].score == 0 and [q.category for q in got[3].questions] == ["general", "jurisdiction"]


def test_evaluation_rates(spark):
    golden = spark.createDataFrame([(1, "VALID"), (2, "INVALID"), (3, "VALID")], "id long, expected string")
    predicted = spark.createDataFrame([(1, "VALID"), (2, "VALID")], "id long, status string")
    (r,) = evaluation.rates(evaluation.judged(predicted, golden, ["id"], {"expected": "status"}), F.col("predicted_status") == "VALID").collect()
    assert (r.n, r.passed, r.pass_rate, r.citation_rate) == (3, 1, 33.3, 66.7)


def test_retrieved_context_is_the_nearest_chunks(spark):
    words = ["payment", "notice", "liability", "delivery", "garden", "river", "stone", "window"]
    text = [". ".join(f"{w} of part {k} " + " ".join(words[(k + j) % 8] for j in range(60)) for w in words[k : k + 3]) + "." for k in range(6)]
    p = spark.createDataFrame([(1, k + 1, f"p{k}", t) for k, t in enumerate(text)] + [(2, 1, "q", " ")], "document_id long, page_number int, page_id string, text string")
    asked = spark.createDataFrame([(10, 1, "what of the river and garden"), (11, 2, "anything")], "question_id long, document_id long, question string")
    got = [(r.rank, r.text) for r in answers.retrieved(asked, p, k=3).filter("question_id = 10").orderBy("rank").collect()]
    c = chunking.chunks(p).select("document_id", "chunk_index", "text")
    v = {r.chunk_index: (r.vector, r.text) for r in vectors.term_vectors(c, id_cols=("document_id", "chunk_index", "text")).filter("document_id = 1").collect()}
    q = vectors.term_vectors(asked, id_cols=("question_id",), text_col="question").filter("question_id = 10").first().vector
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))
    want = sorted(v, key=lambda k: (-round(cos(q, v[k][0]), 12), k))[:3]
    assert len(v) > 3 and got == [(i + 1, v[k][1]) for i, k in enumerate(want)]
    # a question without a chunk falls back to the document's first pages
    assert [(r.page_start, r.similarity) for r in answers.retrieved(asked, p).filter("question_id = 11").collect()] == [(1, None)]


def test_top_k_in_blocks_is_brute_force(spark, monkeypatch):
    import random

    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(80)] + [(80, [0.0] * 6)]
    e = spark.createDataFrame(rows, "id long, vector array<double>")
    q = e.filter("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    unit = [[x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v] for _, v in rows]
    want = set()
    for i in range(0, 81, 7):
        best = sorted(range(81), key=lambda j: (-round(sum(a * b for a, b in zip(unit[i], unit[j], strict=True)), 12), j))[:4]
        want |= {(i, j, k + 1) for k, j in enumerate(best)}
    for size in (vectors.BLOCK_BYTES, 400):
        monkeypatch.setattr(vectors, "BLOCK_BYTES", size)
        got = {(x.query_id, x.id, x.rank) for x in vectors.top_k(q, e, 4, order=("id",)).collect()}
        assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want}


def test_embed_once_by_content(spark):
    seen = []

    def embedder(once):
        seen.append(once.count())
        return once.select("content_hash", F.array(F.length("text").cast("double")).alias("vector"))

    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "")], "id long, text string")
    got = {r.id: r.vector for r in vectors.embedded(df, embedder).collect()}
    assert got == {1: [2.0], 2: [2.0], 3: [0.0], 4: [0.0]} and seen == [2]


def test_too_many_chunks_are_an_error(spark):
    p = spark.createDataFrame([(5, 1, "p", "\n\n".join("x" * 700 for _ in range(4)))], "document_id long, page_number int, page_id string, text string")
    assert chunking.chunks(p).count() >= 4
    with pytest.raises(Exception, match="more than 3 chunks in document 5"):
        chunking.chunks(p, chunking.Chunking(most=3)).collect()


def test_questions_documents_and_index(spark, pages):
    asked = spark.createDataFrame([(1, " "), (2, "x" * 1001), (3, "fine"), (4, None)], "id long, question string")
    good, bad = questions.checked(asked, most=1000)
    assert [r.id for r in good.collect()] == [3] and {(r.id, r.reject_reason) for r in bad.collect()} == {(1, "BLANK_QUESTION"), (2, "QUESTION_TOO_LONG"), (4, "BLANK_QUESTION")}
    documents = spark.createDataFrame([(1,), (2,), (9,)], "document_id long")
    assert {r.document_id for r in tables.existing(documents, extraction.clauses(pages), extraction.dates(pages)).collect()} == {1, 2}
    c = chunking.chunks(pages.withColumn("page_id", F.lit("p")))
    assert {(r.document_id, r.n_chunks, r.indexed) for r in tables.index_summary(documents, c).collect()} == {(1, 1, True), (2, 1, True), (9, 0, False)}


def test_a_document_sent_again_replaces_itself(spark, tmp_path):
    schema = streaming.PAGES
    import datetime as dt

    now = dt.datetime(2026, 1, 1)
    for k, text in enumerate(["1. Payment. Buyer shall pay 10 dollars.", "1. Payment. Buyer shall pay 20 dollars."]):
        rows = [(1, 1, text, now)] + ([(2, 1, "2. Notices. Seller must give notice.", now)] if k == 0 else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = streaming.write_batches(streaming.arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination()
    every = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out")
    spans = lambda df: {r.source_span for r in df.filter("claim_type = 'obligation'").collect()}
    assert len(spans(every)) == 3
    assert spans(streaming.current(every)) == {"Payment.", "1. Payment.", "Buyer shall pay 20 dollars.", "Seller must give notice."} & spans(every)
    assert not any("10 dollars" in s for s in spans(streaming.current(every)))
