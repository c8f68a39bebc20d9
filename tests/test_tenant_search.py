"""Search within tenants against plain re-computation."""

from __future__ import annotations

import random

import numpy as np

from deedflow.operators import vectors


def test_every_tenant_has_its_own_top_rows(spark):
    r = random.Random(5)
    vector = lambda: [r.uniform(-1, 1) for _ in range(4)]
    rows = [(i, r.choice([None, 1, 1, 1, 2, 3]), vector()) for i in range(60)]
    asked = [(q, vector()) for q in range(3)]
    df = spark.createDataFrame(rows, "id long, user_id long, vector array<double>")
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<double>")
    tenants = df.select("user_id").distinct()
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    want = set()
    for q, v in asked:
        for user in {u for _, u, _ in rows}:
            own = sorted((-cosine(v, x), i) for i, u, x in rows if u == user)
            want |= {(q, user, i, k + 1) for k, (_, i) in enumerate(own[:5])}
    for given in (queries, queries.crossJoin(tenants)):
        found = vectors.top_k(given, df, 5, order=("id",), within="user_id").collect()
        assert {(x.query_id, x.user_id, x.id, x["rank"]) for x in found} == want and len(found) == len(want)


def test_chunk_search_is_a_search_of_every_tenant(spark):
    from deedflow.plans import catalogue

    sf = "/root/testdata/sf0.001"
    users = {x.user_id for x in catalogue.document_pages(spark, sf).select("user_id").distinct().collect()}
    found = catalogue.chunk_search(spark, sf).collect()
    assert {(x.query_id, x.user_id) for x in found} == {(q, u) for q in range(1, 6) for u in users}
    assert len({(x.query_id, x.user_id, x["rank"]) for x in found}) == len(found) and max(x["rank"] for x in found) <= 5
