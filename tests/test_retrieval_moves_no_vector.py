"""Retrieval for answers compares vectors where they are made: none of them is shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from deedflow.operators import answers, vectors


def test_no_vector_crosses_a_shuffle(spark):
    p = spark.createDataFrame([(d, 1, f"p{d}", f"Payment of {d} dollars. " * 9) for d in range(6)], "document_id long, page_number int, page_id string, text string")
    asked = p.select(F.col("document_id").alias("question_id"), "document_id", F.lit("What is paid?").alias("question"))
    found = answers.retrieved(asked, p)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "vector#" not in plan and found.count() == 6


def test_cosines_of_texts_are_those_of_their_vectors(spark):
    texts = ["pay the fee", "The fee", "  ", None, "fee fee pay", "Pay  the fee ", "a\u00a0b"]
    rows = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "i int, j int, a string, b string")
    two = rows
    for c in "ab":
        made = vectors.term_vectors(rows, id_cols=("i", "j"), text_col=c).withColumnRenamed("vector", f"v{c}")
        two = two.join(made, ["i", "j"])
    want = {(r.i, r.j): r.similarity for r in vectors.cosines(two, "va", "vb").collect()}
    got = {(r.i, r.j): r.similarity for r in vectors.text_cosines(rows, "a", "b").collect()}
    assert got == want and len(got) == 49
