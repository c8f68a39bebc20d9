"""Repeated passages that need every occurrence, every first text or more than one way through a text."""

from __future__ import annotations

import random

import pyarrow as pa

from deedflow.llm import passages


def invented(n: int, name: str) -> list[str]:
    return [f"{name}{k}" for k in range(n)]


def found_segments(left: list[str], right: list[str]) -> list[tuple[int, int, int, int]]:
    made = passages.matched_segments(pa.array([" ".join(left)]), pa.array([" ".join(right)]), 46, 0.8)
    return [x[:4] for _, x in made]


def test_a_phrase_met_before_cuts_no_passage():
    p = invented(60, "p")
    for at in range(0, 55, 9):
        left = [*invented(20, "a"), *p[at : at + 5], *invented(20, "b"), *p]
        assert found_segments(left, [*invented(7, "c"), *p]) == [(45, 101, 7, 63)]


def test_verbatim_passages_against_all_pairs_of_places():
    r = random.Random(3)
    for _ in range(60):
        left, right = ([f"w{r.randrange(3)}" for _ in range(r.randrange(40))] for _ in range(2))
        p = [f"{r.choice('xyz')}{r.randrange(4)}" for _ in range(r.randrange(50, 90))]
        for _ in range(r.randrange(1, 3)):
            at = r.randrange(len(left) + 1)
            left[at:at] = p
        for _ in range(r.randrange(1, 3)):
            at = r.randrange(len(right) + 1)
            right[at:at] = p
        a, b = ([tuple(t[k : k + 5]) for k in range(len(t) - 4)] for t in (left, right))
        covered = set()
        for x in range(len(a)):
            for y in range(len(b)):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                if n >= 46:
                    covered |= set(range(y, y + n))
        assert covered <= {k for _, _, lo, hi in found_segments(left, right) for k in range(lo, hi)}


def cut_words(spark, texts: list[list[str]]) -> dict[int, list[str]]:
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.text.split() for r in passages.without_repeats(docs).collect()}


def test_every_copy_of_a_passage_is_cut(spark):
    p = invented(70, "p")
    once = [*invented(30, "a"), *p, *invented(30, "b")]
    twice = [*invented(25, "c"), *p, *invented(40, "d"), *p, *invented(25, "e")]
    rest = [*invented(25, "c"), *invented(40, "d"), *invented(25, "e")]
    assert cut_words(spark, [once, twice]) == {0: once, 1: rest}
    again = [*invented(15, "f"), *p, *invented(60, "g"), *p, *invented(15, "h")]
    assert cut_words(spark, [again, twice]) == {0: again, 1: rest}


def test_a_common_phrase_hides_no_passage(spark):
    """Many texts share a line too short to count; two later ones also share a passage around it."""
    line = invented(12, "line")
    p = [*invented(25, "p"), *line, *invented(25, "q")]
    texts = [[*invented(60, f"a{k}."), *line, *invented(60, f"z{k}.")] for k in range(30)]
    texts += [[*invented(40, f"b{k}."), *p, *invented(40, f"c{k}.")] for k in range(3)]
    cut = cut_words(spark, texts)
    assert all(cut[k] == texts[k] for k in range(31))
    assert all(cut[30 + k] == [*invented(40, f"b{k}."), *invented(40, f"c{k}.")] for k in (1, 2))


def test_run_hashes_name_equal_runs(spark):
    words = [*invented(80, "w"), *invented(80, "w")]
    rows = spark.createDataFrame([(1, " ".join(words), (7,), [90])], "node long, text string, rank struct<id long>, positions array<long>")
    rows = rows.unionByName(spark.createDataFrame([(2, " ".join(words[:80]), (8,), [10])], "node long, text string, rank struct<id long>, positions array<long>"))
    found = passages.runs(rows.select("node", "rank", "positions", "text"), 46).collect()
    at = {(x.node, x["at"]): x.run for x in found}
    assert {k for n, k in at if n == 1} == set(range(45, 91)) and {k for n, k in at if n == 2} == set(range(11))
    assert all((at[1, 80 + k] == at[2, k]) for k in range(11)) and len(set(at.values())) == 46
