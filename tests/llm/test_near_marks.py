"""Marks of words part texts that meet by chance, and no near pair."""

from __future__ import annotations

import random
from collections import Counter

from deedflow.llm import near_duplicates


def edited(t: list[str], n: int, d: random.Random) -> list[str]:
    out = list(t)
    for at in d.sample(range(len(t)), n):
        out[at] = d.choice([f"x{d.randrange(40)}", "", f"y{d.randrange(9)} z"])
    return " ".join(out).split()


def test_marks_differ_in_no_more_bits_than_words_do(spark):
    d = random.Random(1)
    texts = []
    for n in (1, 3, 20, 130, 250, 260, 700):
        for edits in (0, n // 10, n // 5, n // 2):
            a = [f"w{d.randrange(60)}" for _ in range(n)]
            texts += [a, edited(a, edits, d)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string")
    made = near_duplicates.wide_marks(table)
    bits = {r.node: (r.n, bytes(r.bits)) for r in made.collect()}
    assert all(bits[i][0] == len(t) for i, t in enumerate(texts))
    for i in range(0, len(texts), 2):
        a, b = Counter(texts[i]), Counter(texts[i + 1])
        assert near_duplicates.fewest_apart(bits[i][1], bits[i + 1][1]) <= (a - b).total() + (b - a).total()
    pairs = [(i, i + 1) for i in range(0, len(texts), 2)]
    near = [(a, b) for a, b in pairs if 1 - near_duplicates.word_edits(*([hash(w) for w in texts[k]] for k in (a, b)), 10**4) / max(len(texts[a]), len(texts[b])) >= 0.8]
    kept = {(r.a, r.b) for r in near_duplicates.plausible(spark.createDataFrame(pairs, "a long, b long"), made, 0.8).collect()}
    assert set(near) <= kept and len(near) >= 14


def test_texts_that_share_rare_words_by_chance_are_not_moved_to_be_compared(spark):
    """Members of one vocabulary: every two share a rare word, only the planted ones may be near."""
    d = random.Random(2)
    texts = [[f"w{d.randrange(2000)}" for _ in range(300)] for _ in range(60)]
    texts += [edited(texts[k], 40, d) for k in range(5)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string")
    members = spark.createDataFrame([(i, len(t), i) for i, t in enumerate(texts)], "node long, n int, root long")
    pairs = {(r.a, r.b) for r in near_duplicates.pairs_of_classes(members, table, 0.8).collect()}
    assert {(k, 60 + k) for k in range(5)} <= pairs and len(pairs) < 10
