"""Vectors and searches made inside tasks: nothing is shuffled for a vector, equal vectors tie, odd rows keep their places."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from deedflow.operators import vectors


def test_term_vectors_shuffle_nothing(spark):
    made = vectors.term_vectors(spark.createDataFrame([(1, "a b a"), (2, "b a a"), (3, None), (4, "  \n"), (5, "a b a")], "id int, text string"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.vector for r in made.collect()}
    assert got[1] == got[5] != got[2] and got[3] == got[4] == [0.0] * vectors.DIMENSIONS
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-12


def test_products_give_ties_in_order_and_leave_out_no_row(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PACK", 7)
    d = np.random.default_rng(3)
    e = d.normal(size=(60, 5))
    e[10:40] = e[10]  # equal vectors settle by their id
    e[50] = 0
    rows = spark.createDataFrame([(int(i), [float(x) for x in e[i]]) for i in d.permutation(60)] + [(60, [1.0])], "id int, vector array<double>")
    asked = rows.filter("size(vector) = 5 and id % 9 = 1").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    unit = np.vstack([e / np.maximum(np.linalg.norm(e, axis=1), 1e-300)[:, None], np.zeros(5)])
    for least in (None, 0.3):
        found = vectors.top_k(asked, rows, 6, order=("id",), min_similarity=least)
        assert "BroadcastNestedLoopJoin" in found._jdf.queryExecution().executedPlan().toString()
        got = {(r.query_id, r["rank"]): r.id for r in found.collect()}
        want = {}
        for q in range(1, 60, 9):
            sim = np.round(unit @ unit[q], 9)
            best = [int(i) for i in np.lexsort([np.arange(61), -sim]) if least is None or sim[i] >= least][:6]
            want |= {(q, n + 1): i for n, i in enumerate(best)}
        assert got == want
