"""Matching through keys against the nested loop, on random rules' worth of entities and on a pair of thousands."""

from __future__ import annotations

import random
import time

import pytest

from deedflow.operators import matching

WORDS = ["pay", "payment", "rent", "ent", "notice", "", "a", "te", "terminate notice", "the rent is due", None, "general", "other"]
KINDS = {
    "parties": ("name string, role string", lambda d: (d.choice(WORDS), d.choice(["Buyer", "seller", None]))),
    "dates": ("date_type string, description string, normalized_date string, raw_text string", lambda d: (d.choice(WORDS), d.choice(WORDS), d.choice(["2026", None]), "x")),
    "obligations": ("obligor string, duty string, trigger string, deadline string", lambda d: (d.choice(["A", "a", None, "B"]), d.choice(WORDS), d.choice(["", "on call", None]), d.choice(["within 30 days", None, "60 days"]))),
    "clauses": ("category string, title string, text string", lambda d: (d.choice(["payment", "general", "other", "", None]), d.choice(WORDS), d.choice(["t", "u"]))),
}


@pytest.mark.parametrize("kind", KINDS)
def test_keys_give_what_the_nested_loop_gives(spark, monkeypatch, kind):
    schema, draw = KINDS[kind]
    d = random.Random(kind)
    entities = spark.createDataFrame([(doc, i, *draw(d)) for doc in range(24) for i in range(d.choice([0, 1, 4, 9]))], f"document_id int, ordinal int, {schema}")
    pairs = spark.createDataFrame([(p, 2 * p, 2 * p + 1) for p in range(12)], "pair_id int, a_document_id int, b_document_id int")
    for f in (getattr(matching, f"compare_{kind}"), getattr(matching, f"diff_{kind}")):
        out = []
        for few in (10_000, -1):
            monkeypatch.setattr(matching, "FEW", few)
            out.append(sorted(str(tuple(r)) for r in f(entities, pairs).collect()))
        assert out[0] == out[1] and out[0]


def test_two_thousand_clauses_a_side(spark):
    n = 2000
    made = [(doc, i, f"kind {i % 7}" if i % 3 else "general", f"clause {(i * 37 + doc) % n} of the lease", "t") for doc in (1, 2) for i in range(n)]
    clauses = spark.createDataFrame(made, "document_id int, ordinal int, category string, title string, text string")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id int, a_document_id int, b_document_id int")
    began = time.time()
    rows = matching.diff_clauses(clauses, pairs).select("a_ordinal", "b_ordinal").collect()
    assert time.time() - began < 60
    a, b = ([r for r in made if r[0] == doc] for doc in (1, 2))
    free, want = {r[1]: r for r in b}, []
    for r in a:
        fit = next((j for j, o in free.items() if (r[2] != "general" and r[2] == o[2]) or r[3] in o[3] or o[3] in r[3]), None)
        free.pop(fit, None)
        want.append((r[1], fit))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want + [(None, j) for j in free]))


def test_what_rules_compare_is_made_once_an_entity(spark):
    from pyspark.sql import functions as F

    once = F.udf(lambda t: made.add(1) or t, "string")
    made = spark.sparkContext.accumulator(0)
    entities = spark.createDataFrame([(doc, i, f"t{i}") for doc in (1, 2) for i in range(12)], "document_id int, ordinal int, title string")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id int, a_document_id int, b_document_id int")
    rows = matching.matched(matching.sides(entities, pairs), [matching.Equal(lambda x: once(x("title")))]).select("a.ordinal", "b.ordinal").collect()
    assert sorted(map(tuple, rows)) == [(i, i) for i in range(12)]
    assert made.value == 24
