"""The cell index against the exact search, on clustered and on scattered vectors, with ties, zeros and other widths."""

from __future__ import annotations

import numpy as np
import pytest

from deedflow.operators import vector_index, vectors


def table(spark, made):  # noqa: ANN001
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in enumerate(made)], "vec_id long, vector array<double>")


def asked(rows):  # noqa: ANN001
    return rows.filter("vec_id % 20 = 0 and vector is not null").selectExpr("vec_id as query_id", "vector as query_vector")


@pytest.mark.parametrize("kind", ["clustered", "scattered"])
def test_recall_of_the_index(spark, tmp_path, kind):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(25, 16)) * 4
    made = draw.normal(size=(3000, 16)) + (centres[draw.integers(0, 25, 3000)] if kind == "clustered" else 0)
    rows = table(spark, made)
    index = vector_index.build(rows, f"file://{tmp_path}/i", order=("vec_id",))
    assert index.rows(spark).count() == 3000
    exact = vectors.top_k(asked(rows), rows, 10, order=("vec_id",))
    found = vector_index.search(asked(rows), index, 10)
    assert found.groupBy("query_id").count().filter("count <> 10").count() == 0
    assert vector_index.recall_of(found, exact, ("vec_id",)) >= 0.9
    assert kind == "scattered" or index.probes <= index.cells // 4
    whole = vector_index.search(asked(rows), index, 10, probes=index.cells)
    assert vector_index.recall_of(whole, exact, ("vec_id",)) == 1.0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_index_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 16)  # a cell of equal vectors is many parts, its queries many blocks
    made = [[1.0, 0.0]] * 400 + [[0.0, 1.0]] * 5 + [[0.0, 0.0], None, [1.0], [-1.0, 0.5]]
    rows = table(spark, made)
    index = vector_index.build(rows, f"file://{tmp_path}/i", order=("vec_id",), cells=3)
    assert index.rows(spark).count() == len(made)
    found = {}
    for r in vector_index.search(asked(rows), index, 4, probes=3).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.similarity, 6)))
    want = {}
    for r in vectors.top_k(asked(rows), rows.filter("size(vector) = 2"), 4, order=("vec_id",)).collect():
        want.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.similarity, 6)))
    assert {q: sorted(v) for q, v in found.items()} == {q: sorted(v) for q, v in want.items()}
    vector_index.add(spark.createDataFrame([(9000, [0.0, 2.0])], "vec_id long, vector array<double>"), index)
    one = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, query_vector array<double>")
    assert 9000 in {r.vec_id for r in vector_index.search(one, index, 10, probes=3).collect()}
    near = vector_index.search(one, index, 10, probes=3, min_similarity=0.99).collect()
    assert {r.vec_id for r in near} == {*range(400, 405), 9000}


def test_index_of_nothing(spark, tmp_path):
    rows = table(spark, []).limit(0)
    index = vector_index.build(rows, f"file://{tmp_path}/i", order=("vec_id",))
    one = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, query_vector array<double>")
    assert index.cells == 0 and vector_index.search(one, index, 3).collect() == []
