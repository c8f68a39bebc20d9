"""Citations of single pages are resolved in one pass over the claims; questions make their causes once."""

from __future__ import annotations

from pyspark.sql import functions as F

from deedflow.operators import answers, evidence, questions


def counted(spark):
    made = spark.sparkContext.accumulator(0)
    return made, lambda c: F.udf(lambda t: made.add(1) or t, "string")(F.col(c).cast("string")).cast("long")


def test_claims_of_single_pages_are_read_once(spark):
    pages = spark.createDataFrame([(1, 1, "Rent is due."), (1, 1, "A second row."), (1, 2, None), (2, 1, "  ")], "document_id long, page_number int, text string")
    rows = [(1, 1, 1, "A  second"), (1, 1, 1, "Rent"), (1, 2, 2, "x"), (1, 3, 3, "x"), (2, 1, 1, "x"), (None, 1, 1, "x"), (1, 0, 0, "x"), (1, None, 1, "x"), (1, 1, 1, "")]
    claims = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, document_id long, page_start int, page_end int, source_span string")
    made, once = counted(spark)
    got = evidence.resolve(claims.withColumn("document_id", once("document_id")), pages).orderBy("k").collect()
    assert [r.reason for r in got] == [None, "SPAN_NOT_FOUND_ON_PAGE", "PAGE_TEXT_EMPTY", "PAGE_3_NOT_FOUND", "PAGE_TEXT_EMPTY", "PAGE_1_NOT_FOUND", "INVALID_PAGE_NUMBER", "INVALID_PAGE_NUMBER", "EMPTY_SOURCE_SPAN"]
    assert made.value == len(rows)


def test_causes_of_questions_are_made_once(spark):
    made, once = counted(spark)
    flags = spark.createDataFrame([(d, 1, "renewal_lock_in", "t") for d in range(6)], "document_id long, ordinal int, flag_type string, title string")
    clauses = spark.createDataFrame([], "document_id long, ordinal int, category string, title string, clause_identifier string")
    documents = spark.createDataFrame([(d,) for d in range(8)], "document_id long")
    assert questions.brief_questions(documents, flags.withColumn("document_id", once("document_id")), clauses).count() == 6 + 2 * 2
    assert made.value == 6


def test_an_answer_cites_the_first_sentence_that_speaks_of_its_topic(spark):
    body = "No word of it here! Either party may give notice.\nThen, after ten days written notice; it ends. Terminate twice?"
    asked = spark.createDataFrame([(1, 1, "When may a party terminate?")], "question_id long, document_id long, question string")
    context = spark.createDataFrame([(1, 1, 4, body)], "question_id long, rank int, page_start int, text string")
    row = answers.answer_claims(asked, context).collect()[0]
    assert (row.topic, row.page_start, row.source_span) == ("termination", 4, "Then, after ten days written notice; it ends.")
    assert row.claim_text == "Termination terms: Then, after ten days written notice; it ends."
