"""Manifest, prefix trie and exact duplicates against plain Python, with nulls, ties, repeats, long rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from deedflow.llm import exact, merkle, prefix_trie

SPACES = re.compile(r"[\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree long, run long, n long, row long, digest string, index int, place int, head string, left boolean"
EXTRA = (1, 2, 3, 4, "d", 5, 6, "h", True)
LONG = "Long Words " * 200_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "A b", "en", "a", 3), (1, "A b", "en", "a", 3), (2, "A  b", "en", None, None), (None, "a\n\tb", "en", "a", 3), (None, None, None, None, None),
        (3, None, "fr", "b", 0), (4, "", "fr", "b", 0), (5, " \n\t ", "de", "b", 4), (6, LONG, "en", "a", 7), (7, LONG + "x", "en", "a", 7), (8, LONG, "en", "a", 7),
        (9, "naïve ÉTÉ 中文 \x00 \x85", "Fr", "c", 1), (-5, "A b", "é", "a", 3), (None, None, None, None, None), (33, "ONLY ÄÖ UPPER", "zz", "b", 1),
    ]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


def root_of(digests, up):  # noqa: ANN001
    """Root of a run of nodes; ``up`` gets each node's siblings, level by level, and its place above."""
    places = list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + 8] for i in range(0, len(digests), 8)]
        for k, p in enumerate(places):
            up(k, runs[p // 8][: p % 8], runs[p // 8][p % 8 + 1 :])
            places[k] = p // 8
        digests = [sha("".join(r)) for r in runs]
    return digests[0]


def plain_manifest(rows, changed):  # noqa: ANN001
    say = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = lambda t, d=doc_id, s=source, g=lang, n=n_chars: sha("".join(map(say, (d, s, g, n, t))))
        trees[lang].append((doc_id, leaf(text), leaf(lower(text)) if changed(doc_id) else leaf(text)))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    subroots, inside = [], {}
    for g in order:
        trees[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        inside[g] = defaultdict(list)
        subroots.append(root_of([r[1] for r in trees[g]], lambda k, a, b, g=g: inside[g][k].append((a, b))))
    outside = defaultdict(list)
    root = root_of(subroots, lambda k, a, b: outside[k].append((a, b)))
    out = []
    for t, g in enumerate(order):
        for k, (doc_id, leaf, value) in enumerate(trees[g]):
            path = inside[g][k] + outside[t]
            for a, b in path:
                value = sha("".join([*a, value, *b]))
            out.append((doc_id, leaf, subroots[t], root, sha("".join("".join(a + b) for a, b in path)), value, value == root))
    return out


def crc_third(doc_id) -> bool:  # noqa: ANN001
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


THIRD = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
by_text = lambda rows: sorted(map(str, map(tuple, rows)))


def test_manifest_of_odd_rows(docs):
    found = merkle.manifest(docs, THIRD()).collect()
    want = plain_manifest([tuple(r)[:5] for r in docs.collect()], crc_third)
    assert by_text(found) == by_text(want)
    assert any(not r.verified for r in found) and any(r.verified for r in found)


def test_manifest_of_several_rounds(spark):
    # one tree above 4096 leaves, so that two rounds build it, and 70 small ones
    rows = [(i, f"Text {i}", "big", "s", i) for i in range(4500)] + [(10_000 + i, f"T {i}", f"l{i % 70}", None, None) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert by_text(merkle.manifest(docs.repartition(3), THIRD()).collect()) == by_text(plain_manifest(rows, crc_third))


def test_manifest_of_nothing_and_of_one(docs):
    assert merkle.manifest(docs.limit(0), THIRD()).collect() == []
    (row,) = merkle.manifest(docs.filter("doc_id = 5"), THIRD()).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("") and row.verified


def test_states_resume_like_sha256(spark):
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    import pyarrow as pa

    level = merkle.Level.over(merkle.words(pa.array(digests)))
    for at in range(11):
        changed = list(digests)
        changed[at] = hashlib.sha256(b"new").digest()
        run = changed[at // 8 * 8 : at // 8 * 8 + 8]
        got = merkle.packed(level.folded(merkle.np.array([at]), merkle.words(pa.array([changed[at]]))))
        assert got[0] == hashlib.sha256("".join(d.hex() for d in run).encode()).digest()


def test_exact_duplicates(docs):
    found = exact.duplicates(docs, digest_all=True).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[SPACES.sub(" ", r.text or "")].append(r.doc_id)
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            want.append((i, keep, len(ids), i == keep and first, sha(text)))
            first &= i != keep
    assert by_text(found) == by_text(want)
    assert sum(r.kept for r in found) == len(groups)
    lazy = {r.doc_id: r for r in exact.duplicates(docs).collect()}
    assert lazy[33].text_sha256 is None and lazy[8].keep_id == 6 and exact.duplicates(docs.limit(0)).collect() == []


def test_exact_duplicates_with_equal_beginnings(spark):
    texts = [("x" * 300 + tail) for tail in ("a", "b", "a", "cc", "dd", "cc")] + [f"t{i % 40:03d}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in exact.duplicates(docs).filter("kept").collect()}
    assert kept == {texts.index(t) for t in texts}


TURNS = "conv_id long, turn long, role string, text string, conv long, depth int, place string, a long, x long, length long, leaf int"


def plain_trie(rows):  # noqa: ANN001
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in convs:
        convs[c] = [t[2:] for t in sorted(convs[c], key=lambda t: t[:2])]
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = [] if c is None else convs.get(c - int(math.fmod(c, 20)), [])
        said = base[:h] + own[h:]
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
        ends[tuple(said)].append(c)
    order = lambda ids: sorted(ids, key=lambda c: (c is None, c or 0))
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        children[k[:-1]] += len(k) > 0
    for k in members:
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members[k]) - 1) * (len([w for w in SPACES.split(k[-1][1]) if w]) if k else 0)
            leaves[k[:d]] += children[k] == 0
    first = {k: order(m)[0] for k, m in members.items()}
    spell = lambda c: "null" if c is None else str(c)
    return [(first[k], len(k), first[k[:-1]] if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(map(spell, order(ends[k]))))) for k, m in members.items()]


def conversations(spark, rows):  # noqa: ANN001
    return spark.createDataFrame([(*r, 1, 2, "p", 3, 4, 5, 6) for r in rows], TURNS)


def test_trie_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    draw = random.Random(5)
    say = lambda: (draw.choice(["user", "assistant", None]), draw.choice(["hi", "hi there", "", None, "a b\tc", "Ünï"]))
    rows = []
    for c in [*range(0, 90, 3), *range(1, 30, 7), None, 61, -7, -20, 1019]:
        n = draw.choice([1, 2, 3, 5, 12])
        rows += [(c, None if t == 0 and draw.random() < 0.3 else t, *say()) for t in range(n)]
    copied = [(t, *say()) for t in range(9)]
    rows += [(200 + i, *t) for i in range(40) for t in copied]  # one group of many copies
    rows += [(300, *t) for t in copied[:6]]  # a proper prefix of them, or nearly
    found = prefix_trie.prefix_trie(conversations(spark, rows).repartition(5))
    assert by_text(found.collect()) == by_text(plain_trie(rows))


def test_trie_of_one_long_conversation(spark):
    rows = [(20, t, "user", f"turn {t % 7}") for t in range(2500)] + [(40, t, "user", f"turn {t % 7}") for t in range(2500)] + [(21, 0, "user", LONG)]
    assert by_text(prefix_trie.prefix_trie(conversations(spark, rows)).collect()) == by_text(plain_trie_long(rows))


def plain_trie_long(rows):  # noqa: ANN001
    """Members of every prefix told by running hashes: the plain trie would hold quadratic keys."""
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in (20, 21, 40)}
    long = [("user", f"turn {t % 7}") for t in range(2500)]
    said = {20: long, 40: long, 21: long[: h[21]] + ([("user", LONG)] if h[21] == 0 else [])}
    words = lambda t: len(t.split())
    nodes = {}
    for c in (20, 21, 40):
        for d in range(len(said[c]) + 1):
            key = (d, "own") if c == 21 and h[21] == 0 and d == 1 else (d, "long")
            nodes.setdefault(key, []).append(c)
    out, below = [], 0
    for key in sorted(nodes, key=lambda k: (-k[0], k[1])):
        d, m = key[0], nodes[key]
        ends = sorted(c for c in m if len(said[c]) == d)
        own = (len(m) - 1) * (words(said[m[0]][d - 1][1]) if d else 0)
        kids = sum(1 for k in nodes if k[0] == d + 1 and (key[1] == "long"))
        if key[1] == "long":
            below += own
        leaves = (2 if d == 0 and (1, "own") in nodes else 1) if key[1] == "long" else 1
        parent = None if d == 0 else 20
        out.append((min(m), d, parent, len(m), 0 if key[1] == "own" else kids, leaves, below if key[1] == "long" else own, sha(",".join(map(str, ends)))))
    return out


def test_trie_of_nothing_and_of_turnless(spark):
    assert prefix_trie.prefix_trie(conversations(spark, []).limit(0)).collect() == []
    c = next(c for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4 == 3)  # all its own turns go, and there is no base
    (root,) = prefix_trie.prefix_trie(conversations(spark, [(c, 0, "user", "x")])).collect()
    assert tuple(root) == (c, 0, None, 1, 0, 1, 0, sha(str(c)))
