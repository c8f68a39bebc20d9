"""Links between texts that share one bucket only, and not its centre's class."""

from __future__ import annotations

import random

from deedflow.llm import near_duplicates
from deedflow.llm.passages import compact_windows


def test_members_of_one_bucket_that_are_not_near_its_centre_meet(spark):
    d = random.Random(5)
    said = lambda n: [f"w{d.randrange(10**6)}" for _ in range(n)]
    rows, nodes, want, bands = [], [], set(), 24
    for bucket in range(6):
        line = said(12)  # all members of a bucket begin alike, two of them are near each other
        first = line + said(48)
        second = first[:20] + said(10) + first[30:]
        for k, t in enumerate([first, second, *(line + said(48) for _ in range(8))]):
            node = 100 * bucket + k
            rows.append((node, node, " ".join(t)))
            nodes.append((node, len(t), [bucket + 1, *(node * bands + b for b in range(1, bands))], node))
        want.add((100 * bucket, 100 * bucket + 1))
    rows = spark.createDataFrame(rows, "doc_id long, node long, text string")
    nodes = spark.createDataFrame(nodes, "node long, n int, sketch array<long>, least_id long")
    found: dict[int, set[int]] = {}
    for r in near_duplicates.near_roots(nodes, rows).collect():
        found.setdefault(r.root, set()).add(r.node)
    assert {tuple(sorted(c)) for c in found.values()} == want


def test_heads_of_rare_kmers_meet_for_all_near_texts(spark):
    d = random.Random(6)
    pairs = []
    for n in [*range(2, 30), 60, 200]:
        for _ in range(6):
            a = [f"w{d.randrange(40)}" for _ in range(n)]
            b = list(a)
            for at in d.sample(range(n), int(0.2 * n)):  # edits spread as they may
                b[at] = f"x{d.randrange(40)}" if d.random() < 0.5 else ""
            pairs.append((" ".join(a), " ".join(w for w in b if w)))
    texts = [t for p in pairs for t in p]
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    members = spark.createDataFrame([(i, len(t.split()), i) for i, t in enumerate(texts)], "node long, n int, root long")
    heads: dict[int, set[int]] = {}
    share: dict[int, int] = {}
    for r in near_duplicates.rare_kmers(members, table, 0.8).collect():
        heads.setdefault(r.node, set()).add(r.kmer)
        share[r.node] = r.share
    for k, (a, b) in enumerate(pairs):
        if a != b:
            assert len(heads[2 * k] & heads[2 * k + 1]) >= min(share[2 * k], share[2 * k + 1]), (a, b)


def test_no_text_as_long_as_half_a_window():
    import numpy as np

    for n in range(1, 30):
        at, left, right = compact_windows(np.arange(1, n + 1, dtype=np.uint64), np.array([0, n]), 46)
        assert len(at) == len(left) == len(right) == 0


def test_texts_that_repeat_one_line_meet_only_where_they_may_be_near(spark):
    d = random.Random(7)
    said = lambda n: [f"w{d.randrange(10**6)}" for _ in range(n)]
    texts = [said(90) + ["Is", "onhe."] * 120 for _ in range(60)]  # 240 of 330 words are the same: too few for 0.8
    texts += [texts[k][:20] + said(30) + texts[k][50:] for k in range(5)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string")
    members = spark.createDataFrame([(i, len(t), i) for i, t in enumerate(texts)], "node long, n int, root long")
    pairs = {(r.a, r.b) for r in near_duplicates.pairs_of_classes(members, table, 0.8).collect()}
    assert {(k, 60 + k) for k in range(5)} <= pairs and len(pairs) < 20
