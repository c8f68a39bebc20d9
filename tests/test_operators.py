"""Contract operators on literal inputs."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from deedflow.functions import text
from deedflow.operators import chunking, evidence, extraction, matching, questions, tables, timeline, trust, vectors
from deedflow.sources import ingest
from deedflow.streaming import pages as streaming

LEASE = [
    (1, 1, 'RESIDENTIAL LEASE\nThis Lease is made between Oakwood Properties LLC ("Landlord") and Alice Walker ("Tenant").\nEffective Date: January 15, 2026.\n1. Rent Payment. Tenant shall pay rent within 5 days of receipt.'),
    (1, 2, "2. Termination. Landlord must give notice upon expiration, within 30 days of the end.\nThis lease is subject to automatic renewal unless cancelled.\n3. Governing Law. Disputes go to arbitration on 2026/02/30 or 5 March 2027."),
]


@pytest.fixture(scope="module")
def lease(spark):
    return spark.createDataFrame(LEASE, "document_id long, page_number int, text string")


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, "\x00a\x08\r\nb\r\n\n\n\nc\x0c ", text.normalize_text) == "a\nb\n\nc"
    assert one(spark, None, text.normalize_text) == ""
    assert one(spark, " Été  DE  x ", text.match_key) == "été de x"
    assert one(spark, "within 60 Calendar days", text.day_count) == 60 and one(spark, "soon", text.day_count) is None
    assert one(spark, "../..\\evil\x00 na*me.pdf", text.clean_filename) == "evil na_me.pdf"
    assert one(spark, "CON.pdf", text.clean_filename) == one(spark, "", text.clean_filename) == "document.pdf"
    assert len(one(spark, "x" * 300 + ".pdf", text.clean_filename)) == 255
    assert one(spark, "You SHOULD sign now", text.neutral) == f"{text.NEUTRAL} now"
    assert one(spark, "The Acme Corp, LLC", text.party_tokens) == ["acme"] and one(spark, "The Company", text.party_tokens) == ["the", "company"]
    assert tuple(one(spark, "say Hello you", lambda c: text.highlight(c, F.lit("hello")))) == ("say ", "Hello", " you")


def test_extraction(lease):
    got = [(r.name, r.role) for r in extraction.parties(lease).orderBy("ordinal").collect()]
    assert got == [("Oakwood Properties LLC", "Landlord"), ("Alice Walker", "Tenant")]
    clauses = extraction.clauses(lease).orderBy("ordinal").collect()
    assert [(c.clause_identifier, c.category) for c in clauses] == [("Clause-1", "payment"), ("Clause-2", "termination"), ("Clause-3", "dispute_resolution")]
    duties = extraction.obligations(lease, extraction.clauses(lease)).orderBy("ordinal").collect()
    assert [(o.obligor, o.deadline, o.trigger, o.clause_identifier) for o in duties] == [("Tenant", "within 5 days", None, "Clause-1"), ("Landlord", "within 30 days", "upon expiration", "Clause-2")]
    dates = {(d.raw_text, d.normalized_date, d.date_type) for d in extraction.dates(lease).collect()}
    assert ("January 15, 2026", "2026-01-15", "effective_date") in dates and ("5 March 2027", "2027-03-05", "milestone_date") in dates and any(r == "2026/02/30" and n is None for r, n, _ in dates)
    assert [f.flag_type for f in extraction.review_flags(lease).collect()] == ["renewal_lock_in"]


def plain_chunks(units: list[str], target=600, overlap=120, least=80) -> list[str]:
    out, cur = [], []
    for u in units:
        cur.append(u)
        if len(" ".join(cur)) >= target:
            out.append(" ".join(cur))
            kept, n = [], 0
            for x in reversed(cur):
                if kept and n + len(x) > overlap:
                    break
                kept.insert(0, x)
                n += len(x)
            cur = kept[1:] if len(kept) == len(cur) > 1 else kept
    if cur:
        tail = " ".join(cur)
        if len(tail) >= least or not out:
            out.append(tail)
        else:
            out[-1] += " " + tail
    return out


def test_chunks(spark):
    import random

    r = random.Random(3)
    texts = ["", "short page", *[" ".join("w" * r.randrange(1, 90) + r.choice([".", ";", ""]) for _ in range(r.randrange(1, 60))) for _ in range(40)]]
    pages = spark.createDataFrame([(i, 1, f"p{i}", t) for i, t in enumerate(texts)], "document_id int, page_number int, page_id string, text string")
    got: dict[int, list[str]] = {}
    for c in chunking.chunks(pages).orderBy("document_id", "chunk_index").collect():
        got.setdefault(c.document_id, []).append(c.text)
    units: dict[int, list[str]] = {}
    for u in chunking.units(pages).orderBy("document_id", "unit_index").collect():
        units.setdefault(u.document_id, []).append(u.text)
    assert {i: plain_chunks(u) for i, u in units.items()} == got and 0 not in got
    two = spark.createDataFrame([(1, 3, "a", "x" * 50), (1, 4, "b", "y" * 50)], "document_id int, page_number int, page_id string, text string")
    c = chunking.chunks(two).first()
    assert (c.page_start, c.page_end, c.page_ids) == (3, 4, ["a", "b"])


def test_vectors(spark):
    v = {r.id: r.vector for r in vectors.term_vectors(spark.createDataFrame([(1, "rent due"), (2, "Rent  DUE"), (3, " ")], "id int, text string")).collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-9 and not any(v[3]) and len(v[2]) == 384
    near = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [round(x.c, 6) for x in near] == [0.707107, 0.0, 0.0]


SPANS = [
    ("exact", 1, 1, "Acme Corp (Landlord)", "VALID", "exact", None),
    ("space", 2, 2, "the rent is due monthly", "VALID", "normalized_whitespace", None),
    ("cross", 2, 3, "monthly tail\nhead of three", "VALID", "cross_page", None),
    ("tampered", 1, 1, "Acme Corp (Tenant)", "INVALID", "unmatched", "SPAN_NOT_FOUND_ON_PAGE"),
    ("missing", 3, 5, "x", "INVALID", "unmatched", "PAGE_4_NOT_FOUND"),
    ("range", 1, 2, "the rent is", "INVALID", "unmatched", "PAGE_RANGE_MISMATCH_MATCHED_PAGES_2_TO_2"),
    ("backwards", 3, 2, "x", "INVALID", "unmatched", "INVALID_PAGE_RANGE"),
    ("wide", 1, 12, "x", "INVALID", "unmatched", "EXCESSIVE_PAGE_RANGE"),
    ("zero", 0, 0, "x", "INVALID", "unmatched", "INVALID_PAGE_NUMBER"),
    ("empty", 1, 1, " ", "INVALID", "unmatched", "EMPTY_SOURCE_SPAN"),
    ("nowhere", 9, 9, "x", "INVALID", "unmatched", "PAGE_9_NOT_FOUND"),
]


def test_evidence(spark):
    pages = spark.createDataFrame([(1, 1, "between Acme Corp (Landlord) and Bob"), (1, 2, "Here the rent\n\n is​  due monthly tail"), (1, 3, "head of three"), (1, 5, "five")], "document_id int, page_number int, text string")
    claims = spark.createDataFrame([(1, n, a, z, s) for n, a, z, s, *_ in SPANS], "document_id int, name string, page_start int, page_end int, source_span string")
    got = {r.name: r for r in evidence.resolve(claims, pages).collect()}
    assert {n: (r.validation_status, r.match_type, r.reason) for n, r in got.items()} == {n: tuple(x) for n, _, _, _, *x in SPANS}
    assert (got["exact"].char_start, got["exact"].char_end) == (8, 28)
    assert (got["space"].char_start, got["space"].char_end) == (5, 32)
    c = evidence.coverage(spark.createDataFrame([(1,), (2,)], "document_id int"), evidence.resolve(claims, pages)).orderBy("document_id").collect()
    assert (c[0].total_claims, c[0].valid_claims, c[0].coverage_ratio) == (11, 3, 0.2727) and (c[1].total_claims, c[1].coverage_ratio, c[1].is_fully_covered) == (0, 0.0, False)


def test_trust(spark):
    rows = [
        ("a", 1, "party", "Salary is 10", 1, "VALID"), ("b", 1, "party", "This appears to mean X", 1, "VALID"), ("c", 1, "clause", "Is it legally enforceable now", 1, "VALID"), ("d", 1, "clause", "x", None, None),
        ("e", 1, "general_fact", "x", None, None), ("f", 1, "clause", "x", 2, "INVALID"), ("g", 1, "review_flag", "x", 1, "VALID"), ("h", 1, "party", "under California law", 1, "VALID"),
    ]
    claims = spark.createDataFrame(rows, "claim_id string, document_id int, claim_type string, claim_text string, evidence_document_id int, validation_status string")
    context = spark.createDataFrame([("g", "ambiguous_term")], "claim_id string, flag_type string")
    got = {r.claim_id: (r.trust_tier, r.safety_status, r.limitations) for r in trust.assess(claims, context).collect()}
    assert got["a"] == ("DOCUMENT_FACT", "SAFE", []) and got["b"][:2] == ("INTERPRETATION", "LIMITED") and got["c"][1] == "REVIEW_REQUIRED"
    assert got["d"][1:] == ("UNSUPPORTED", ["MISSING_EVIDENCE"]) and got["e"][0] == "GENERAL_INFORMATION" and got["f"][2] == ["CROSS_DOCUMENT_EVIDENCE"]
    assert got["g"][:2] == ("INTERPRETATION", "REVIEW_REQUIRED") and got["h"][2] == ["MISSING_JURISDICTION", "CURRENT_LAW_REQUIRED"]
    r = trust.report(trust.assess(claims, context)).first()
    assert r.total_claims == 8 and r.overall_status == "REVIEW_REQUIRED" and r.tier_counts["DOCUMENT_FACT"] == 1


def test_first_fit_is_the_nested_loop(spark):
    import random

    r = random.Random(5)
    sides = [(p, s, i, r.randrange(4)) for p in range(40) for s in "ab" for i in range(r.randrange(5))]
    df = spark.createDataFrame(sides, "pair_id int, side string, ordinal int, v int")
    pick = lambda s: df.filter(F.col("side") == s).select("pair_id", F.struct("ordinal", "v").alias("x"))
    got = {(m.pair_id, m.a and m.a.ordinal, m.b and m.b.ordinal) for m in matching.first_fit(pick("a").withColumn("side", F.lit("a")).unionByName(pick("b").withColumn("side", F.lit("b"))), F.col("a.v") == F.col("b.v")).collect()}
    want = set()
    for p in range(40):
        a, b = ([(i, v) for q, s, i, v in sides if q == p and s == side] for side in "ab")
        free = dict(b)
        for i, v in a:
            j = next((j for j, w in b if j in free and w == v), None)
            free.pop(j, None)
            want.add((p, i, j))
        want |= {(p, None, j) for j in free}
    assert got == want


def test_comparison_and_diff(spark):
    pairs = spark.createDataFrame([(1, 10, 20)], "pair_id int, a_document_id int, b_document_id int")
    duties = spark.createDataFrame([(10, 1, "Tenant", "shall give notice", None, "within 30 days"), (20, 1, "Landlord", "must give notice", None, "within 60 days"), (20, 2, "Tenant", "shall pay", None, None)], "document_id int, ordinal int, obligor string, duty string, trigger string, deadline string")
    got = {(f.category, f.classification) for f in matching.compare_obligations(duties, pairs).collect()}
    assert got == {("NOTICE", "POTENTIAL_INCONSISTENCY"), ("OBLIGATIONS", "PRESENT_IN_ONE_ONLY")}
    assert sorted(f.classification for f in matching.diff_obligations(duties, pairs).collect()) == ["ADDED", "ADDED", "REMOVED"]
    names = spark.createDataFrame([(10, 1, "Acme Corp", "Buyer"), (20, 1, "ACME  corp Ltd", "Seller")], "document_id int, ordinal int, name string, role string")
    assert matching.compare_parties(names, pairs).first().classification == "DIFFERENT"


def test_timeline(spark):
    dates = spark.createDataFrame([(1, 1, "effective_date", "January 1, 2026", "2026-01-01", "Agreement effective or commencement date")], "document_id int, ordinal int, date_type string, raw_text string, normalized_date string, description string")
    duties = spark.createDataFrame([(1, 1, "A", "shall pay", None, "30 days"), (1, 2, "B", "must act", None, None), (2, 1, "C", "must go", "upon call", "10 days"), (3, 1, "D", "must stay", None, "12 months")], "document_id int, ordinal int, obligor string, duty string, trigger string, deadline string")
    got = {(r.document_id, r.seq): (r.date_type, r.item_status, r.calendar_date) for r in timeline.timeline(duties, dates).collect()}
    assert got == {
        (1, 1): ("FIXED_DATE", "EXPLICIT_FACT", "2026-01-01"), (1, 2): ("RELATIVE_DEADLINE", "DERIVED", "2026-01-31"), (1, 3): ("UNSPECIFIED", "EXPLICIT_FACT", None),
        (2, 1): ("RELATIVE_DEADLINE", "UNRESOLVED_TRIGGER", None), (3, 1): ("DURATION", "EXPLICIT_FACT", None),
    }


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "document_id int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2)], "document_id int, v string, version int")
    assert {tuple(r) for r in tables.upsert(old, new, "document_id", "version").collect()} == {(1, "a", 1), (2, "c", 2)}
    once = tables.replace_by_document(old, new)
    assert sorted(once.collect()) == sorted(tables.replace_by_document(once, new).collect())
    assert tables.replace_by_document(old, new.limit(0), keys=new).count() == 1
    lists = spark.createDataFrame([("x", [1, 2]), ("y", [3])], "id string, ids array<int>")
    assert [r.id for r in tables.cascade_lists(lists, new, "ids", "id").collect()] == ["y"]
    assert tables.filtered(old, v="a", version="ALL").count() == 1


def test_questions(spark):
    i = one(spark, "What is the payment and which state applies?", questions.intents)
    assert i.topics == ["governing_law", "payment"] and not i.advice and not i.injection
    assert one(spark, "What is the rent and the rent date?", questions.query_terms) == ["rent", "date"]


def test_gate(spark):
    rows = [("a/x.pdf", 0, b""), ("a/x.pdf", 9, b"%PDF-1.7 "), ("a/x.txt", 9, b"%PDF-1.7 "), ("a/y.pdf", 3, b"abc"), ("b.pdf", 30 << 20, b"%PDF-")]
    got = [r.reject_reason for r in ingest.gate(spark.createDataFrame(rows, "path string, length long, content binary")).collect()]
    assert got == ["EMPTY_FILE", None, "UNSUPPORTED_EXTENSION", "INVALID_SIGNATURE", "FILE_TOO_LARGE"]


def test_streaming(spark, lease, tmp_path):
    lease.withColumn("arrived_at", F.lit(dt.datetime(2026, 1, 1))).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new and changes nothing
        streaming.write_batches(streaming.arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 11 and got.filter("validation_status = 'VALID'").count() == 11


def test_flags_of_a_long_page(spark):
    """A long sentence before the phrase is passed once, not once from each of its places."""
    body = "word " * 40_000 + ". At itſ SOLE dıscretion. sole discretion without end"
    pages = spark.createDataFrame([(1, 1, body), (2, 1, "Nothing here."), (3, 1, "no mark at best efforts")], "document_id long, page_number int, text string")
    start = time.monotonic()
    found = {(r.document_id, r.flag_type, r.source_span) for r in extraction.review_flags(pages).collect()}
    assert found == {(1, "unilateral_discretion", "At itſ SOLE dıscretion."), (3, "ambiguous_term", "Potentially Subjective Standard")}
    assert time.monotonic() - start < 30


def test_plain_searches_keep_what_patterns_find(spark):
    pages = [(1, 1, "They ſhall pay on AUGUſT 5, 2020 or 2024/12/01. Bob\u00a0mUſt go"), (1, 2, "No heads here\u2003\n payment \nx"), (2, 1, "betweEn Foo Inc and Bar Ltd.\nſeller : Acme Co\n")]
    df = spark.createDataFrame(pages, "document_id long, page_number int, text string")
    assert [(r.obligor, r.duty) for r in extraction.obligations(df).orderBy("ordinal").collect()] == [("They", "ſhall pay on AUGUſT 5, 2020 or 2024/12/01"), ("Bob", "mUſt go")]
    assert [r.clause_identifier for r in extraction.clauses(df).collect()] == ["Section-2"]
    assert {r.raw_text for r in extraction.dates(df).collect()} == {"AUGUſT 5, 2020", "2024/12/01"}
    assert {r.name for r in extraction.parties(df).collect()} >= {"Foo Inc", "Bar Ltd"}
