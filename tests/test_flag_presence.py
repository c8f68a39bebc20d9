"""Whether a page has a review flag is told without cutting its sentence out."""

from __future__ import annotations

from deedflow.operators import extraction


def test_presence_of_flags_is_that_of_the_flags_cut_out(spark):
    said = ["Best Efforts!", "bestefforts", "no BEſT EFFORTS here", "Time is of the essence", "a non-competed right.", "", None, "auto-renew", "He may, in his sole discretion, act. And best efforts.", "sole\ndiscretion"]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(said)] + [(0, 2, "nothing"), (1, 2, "noncompete")], "document_id long, page_number int, text string")
    found = extraction.with_flags(pages)
    want = {r.document_id for r in extraction.review_flags(pages).select("document_id").collect()}
    assert {r.document_id for r in found.collect()} == want and {0, 1, 3, 7, 8} <= want
    assert "regexp_extract" not in found._jdf.queryExecution().toString()
