"""Operators against plain re-computation on small fixtures."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from deedflow.llm import fingerprints, langid, mixing, near_duplicates, packing, passages, quality, sharding, toxicity, warc
from deedflow.llm import textops as tx
from deedflow.llm.graph import components
from deedflow.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts(n: int, seed: int, most: int = 60, vocabulary_size: int = 400) -> list[str]:
    r = random.Random(seed)
    return [" ".join(f"{r.choice('abcdefg')}{r.randrange(vocabulary_size)}" for _ in range(r.randrange(most))) for _ in range(n)]


def table(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "s" if sources is None else sources[i]) for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_words_and_occurrences():
    texts = ["", "a b\ta", None, " x\x0by ", "é é é", "\x85 z"]
    data, offsets = tx.as_bytes(pa.array(texts))
    w = tx.words(data, offsets)
    got = [[bytes(data[a:z]).decode() for a, z in zip(w.start[lo:hi], w.end[lo:hi], strict=True)] for lo, hi in itertools.pairwise(w.first)]
    assert got == [WORD.findall(t or "") for t in texts]
    assert w.hash[0] == w.hash[2] != w.hash[1]
    assert tx.occurrence(np.array([5, 7, 5, 5], np.uint64), np.array([0, 0, 0, 1])).tolist() == [0, 0, 1, 0]


def test_mixing_meets_targets(spark):
    texts = some_texts(300, 1)
    sources = ["hot" if i % 3 else f"s{i % 5}" for i in range(300)]
    sources[0] = None
    docs = table(spark, texts, sources)
    mixed = mixing.mix_sources(docs, block=32, rows_per_bucket=20)
    taken = {r["source"]: r["t"] for r in mixed.pieces.groupBy("source").agg(F.sum("length").alias("t")).collect()}
    size: dict = {}
    for t, s in zip(texts, sources, strict=True):
        size[s] = size.get(s, 0) + len(WORD.findall(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:  # the excess of full sources goes to the others by weight
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 2.0 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in order)
    per_doc = mixed.pieces.groupBy("sid", "line_start", "size").agg(F.sum("length").alias("t")).collect()
    assert all(r.t <= 2 * r["size"] for r in per_doc)
    again = mixing.mix_sources(docs, block=32, rows_per_bucket=20)
    key = lambda m: sorted(map(tuple, m.pieces.select("slot", "doc_id", "start", "length").collect()))
    assert key(mixed) == key(again)
    # any stretch of the schedule holds the sources in nearly their shares
    slots = [r.sid for r in mixed.slots.orderBy("slot").collect()]
    share = slots.count(0) / len(slots)
    half = slots[: len(slots) // 2]
    assert abs(half.count(0) - share * len(half)) <= 4


def test_mix_recomputed_from_the_schedule(spark):
    """What every slot plays, computed plainly from the shuffled lines; another schedule gives another mix."""
    texts = some_texts(120, 21)
    sources = [f"s{i % 3}" for i in range(120)]
    docs = table(spark, texts, sources)
    mixed = mixing.mix_sources(docs, block=32, rows_per_bucket=20)
    placed, lines = mixed.placed.orderBy("sid", "line_start", "size").collect(), {}
    for r in placed:
        line = lines.setdefault(r.sid, [])
        assert len(line) == r.line_start
        line += [r.doc_id] * r["size"]
    words = {r.sid: r.words for r in placed}
    played, first, cursor = {}, {}, {}
    for r in mixed.slots.orderBy("slot").collect():
        assert cursor.get(r.sid, 0) == r["rank"]  # ranks follow the slots
        cursor[r.sid] = r["rank"] + 1
        for w in range(32 * r["rank"], min(32 * r["rank"] + 32, words[r.sid])):
            doc = lines[r.sid][w % len(lines[r.sid])]
            played[doc] = played.get(doc, 0) + 1
            first.setdefault(doc, r.slot)
    got = {r.doc_id: r for r in mixing.taken_documents(mixed).collect()}
    assert {i: (played.get(i, 0), first.get(i)) for i in range(120)} == {i: (r.taken, r.first_slot) for i, r in got.items()}
    point = lambda slot: F.reverse(F.lpad(F.bin(slot), 20, "0"))
    van_der_corput = lambda slot: F.conv(point(slot), 2, 10).cast("double") / (1 << 20)
    other = {r.doc_id: r for r in mixing.taken_documents(mixing.mix_sources(docs, block=32, rows_per_bucket=20, point=van_der_corput)).collect()}
    assert {i: r.taken for i, r in other.items()} == {i: r.taken for i, r in got.items()}
    assert sum(other[i].first_slot != got[i].first_slot for i in range(120)) > 60


def test_mixed_documents_follow_the_schedule(spark, tmp_path):
    texts, r = some_texts(600, 22), random.Random(3)
    sources = [r.choice(["a", "a", "a", "b", "c"]) for _ in range(600)]
    docs = table(spark, texts, sources)
    mixed = mixing.mix_sources(docs, block=32)
    mixing.mixed_documents(docs, mixed, rows_per_part=100).write.parquet(f"{tmp_path}/mix")
    rows = [x for p in sorted((tmp_path / "mix").glob("part-*.parquet")) for x in spark.read.parquet(str(p)).collect()]
    n = [len(x.text.split()) for x in rows]
    whole = {s: sum(k for k, x in zip(n, rows, strict=True) if x.source == s) / sum(n) for s in "abc"}
    for share in (0.1, 0.25, 0.5, 0.75):  # any beginning of the mix holds the sources in nearly their shares
        upto, some = 0, {s: 0 for s in "abc"}
        for k, x in zip(n, rows, strict=True):
            upto, some[x.source] = upto + k, some[x.source] + k
            if upto >= share * sum(n):
                break
        assert all(abs(some[s] / upto - whole[s]) < 0.05 for s in "abc")


def test_label_model_finds_accuracies():
    r = np.random.default_rng(3)
    y = r.random(3000) < 0.3
    v = np.full((3000, 5), toxicity.ABSTAIN, np.int8)
    for j, (right, cast) in enumerate([(0.9, 0.8), (0.85, 0.6), (0.95, 0.5), (0.8, 0.9), (0.5, 0.9)]):
        voted = r.random(3000) < cast
        good = r.random(3000) < right
        v[voted, j] = np.where(good, y, ~y)[voted]
    post, table_ = toxicity.label_model(v)
    assert ((post > 0.5) == y).mean() > 0.9
    cast = table_[:, 1, toxicity.TOXIC] / (table_[:, 1, toxicity.TOXIC] + table_[:, 1, toxicity.CLEAN])
    assert cast[2] > cast[4] and cast[0] > cast[4] and abs(cast[4] - 0.5) < 0.15


def test_toxicity_held_out(spark):
    base = some_texts(600, 5, most=80)
    rows = [(i, t + (" you zorgling pest" if i % 5 == 0 else ""), int(i % 5 == 0)) for i, t in enumerate(base)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs.filter("doc_id < 400"), labels.filter("doc_id < 400"))
    got = {r.doc_id: r.score >= 0.7 for r in toxicity.score(docs.filter("doc_id >= 400"), model, keep=["doc_id"]).collect()}
    assert np.mean([got[i] == bool(y) for i, _, y in rows if i >= 400]) == 1


def test_quality_measures(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("ab") for _ in range(r.randrange(40))) + r.choice(["", "\n", "\nx y\nx y", "# $ <a>"]) for _ in range(200)]
    got = {x.doc_id: x for x in quality.measured(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert want == (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words)


def test_quality_verdicts_recomputed(spark):
    """Votes, posteriors and verdicts of whole documents, computed plainly; the posterior is not the all-must-pass verdict."""
    r = random.Random(12)
    words = ["river", "stone", "a", "the", "walked", "garden", "of", "window", "evening", "quiet", "to", "letters"]
    texts = []
    for k in range(240):
        n = r.randrange(10, 140)
        w = [r.choice(words) + r.choice(["", "", "s", "er", "ly"]) + (str(r.randrange(99)) if r.random() < 0.3 else "") for _ in range(n)]
        w = [x.capitalize() if i % 12 == 0 else x + "." if i % 12 == 11 else x for i, x in enumerate(w)]
        kind = k % 8
        if kind == 0:
            w = [x + "#$" if i % 2 else x for i, x in enumerate(w)]
        elif kind == 1:
            w = [x.upper() + "!!" for x in w]
        elif kind == 2:
            w = w[:9] * (n // 9 + 1)
        elif kind == 3:
            w = [x.replace(".", "") for x in w]  # only the sentences are odd
        texts.append(" ".join(w) if kind != 4 else "\n".join(" ".join(w[i : i + 12]) for i in range(0, n, 12)))
    got = {x.doc_id: x for x in quality.quality(table(spark, texts)).collect()}
    votes, base = [], []
    for i, t in enumerate(texts):
        x, w = got[i], WORD.findall(t)
        n, chars = len(w), max(1, sum(map(len, w)))
        assert (x.n_distinct, x.dots, x.upper_chars, x.letters) == (len(set(w)), t.count("."), sum("A" <= c <= "Z" for c in t), sum(c.isalnum() for c in t))
        lines = [y for y in t.split("\n") if WORD.search(y)]
        ended, short = sum(y.strip(" \t\n\x0b\f\r")[-1] in quality.ENDS for y in lines), sum(len(y) <= 3 for y in w)
        marks = sum(unicodedata.category(c).startswith("P") for c in t)
        assert (x.n_ended, x.n_short, x.marks) == (ended, short, marks)
        dup, up, dots, letters, rep = len(lines) - len(set(lines)), x.upper_chars, x.dots, x.letters, x.n_repeat_words
        both = [
            (n < 20, n >= 50), (x.n_symbols > 0.05 * n, x.n_symbols <= 0.002 * n), (rep > 0.3 * n, rep <= 0.01 * n), (dup >= 3 and dup > 0.1 * len(lines), dup == 0 and len(lines) >= 3),
            (up > 0.1 * chars, 0.002 * chars <= up <= 0.05 * chars), (letters < 0.9 * chars, letters >= 0.93 * chars), (chars < 4.2 * n or chars > 6.2 * n, 4.6 * n <= chars <= 5.8 * n),
            (len(set(w)) < 0.3 * n and n < 5000, len(set(w)) >= 0.5 * n), (dots < 0.03 * n or dots > 0.22 * n, 0.04 * n <= dots <= 0.18 * n),
            (len(lines) >= 2 and ended < 0.7 * len(lines), len(lines) >= 2 and ended >= 0.95 * len(lines)), (short < 0.15 * n or short > 0.42 * n, 0.22 * n <= short <= 0.38 * n),
            (marks < 0.1 * n or marks > 0.2 * n, 0.12 * n <= marks <= 0.18 * n),
        ]
        votes.append([0 if bad else 1 if good else 2 for bad, good in both])
        base.append(n < 20 or 100 * rep > 30 * n)
    v = np.array(votes)
    p = ((v == 1).sum(1) + 1) / ((v != 2).sum(1) + 2)
    for _ in range(40):
        logit = np.full(len(v), np.log((p.sum() + 0.5) / ((1 - p).sum() + 0.5)))
        for j in range(v.shape[1]):
            for k in (0, 1, 2):
                m = v[:, j] == k
                logit[m] += np.log((p[m].sum() + 0.5) / (p.sum() + 1.5)) - np.log(((1 - p)[m].sum() + 0.5) / ((1 - p).sum() + 1.5))
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    for i, (q, b) in enumerate(zip(p, base, strict=True)):
        assert abs(got[i].quality - q) < 1e-6 and got[i].base_failed == b and got[i].kept == (not b and q >= 0.1)
    one_bad = [i for i in range(len(texts)) if (v[i] == 0).any() and not base[i]]
    assert any(got[i].kept for i in one_bad) and any(not got[i].kept for i in one_bad)


def test_quality_expectation_maximisation(spark):
    rules = len(quality.rules())
    r = random.Random(4)
    patterns = sorted({tuple(r.choice([0, 1, 2, 2, 2]) for _ in range(rules)) for _ in range(25)})
    n = [r.randrange(1, 500) for _ in patterns]
    df = spark.createDataFrame([(list(p), c) for p, c in zip(patterns, n, strict=True)], "votes array<int>, n long")
    got = {tuple(x.votes): x.quality for x in quality.posteriors(df, rounds=12).collect()}
    v, n = np.array(patterns), np.array(n, float)
    p = ((v == 1).sum(1) + 1) / ((v != 2).sum(1) + 2)
    for _ in range(12):
        logit = np.log((n @ p + 0.5) / (n @ (1 - p) + 0.5)) + np.zeros(len(p))
        for j in range(rules):
            for k in (0, 1, 2):
                m = v[:, j] == k
                odds = np.log((n[m] @ p[m] + 0.5) / (n @ p + 1.5)) - np.log((n[m] @ (1 - p[m]) + 0.5) / (n @ (1 - p) + 1.5))
                logit[m] += odds
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    assert all(abs(got[t] - x) < 1e-6 for t, x in zip(patterns, p, strict=True))


def word_edits(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(words: list[str], n: int, r: random.Random) -> list[str]:
    c = list(words)
    for k in range(n):
        at, what = r.randrange(max(1, len(c))), r.randrange(3)
        c[at : at + (what != 0)] = [] if what == 1 else [f"edit{k}"]
    return c


def test_banded_word_edits():
    r = random.Random(5)
    for _ in range(500):
        a = [r.randrange(5) for _ in range(r.randrange(30))]
        b = edited(a, r.randrange(7), r) if a else [1, 2]
        want = word_edits(a, b)
        assert near_duplicates.word_edits(a, b, 60) == want
        got = near_duplicates.word_edits(a, b, 5)
        assert got == want if want <= 5 else got >= want


def test_edit_similarity_is_exact_from_the_threshold():
    r = random.Random(6)
    left = some_texts(150, 6, most=80, vocabulary_size=30) + ["", "one", None]
    right = [" ".join(edited(t.split(), r.randrange(20), r)) if t else "x" for t in left[:-3]] + ["", "one", ""]
    got = near_duplicates.edit_similarity(pa.array(left), pa.array(right), 0.8)
    for t, u, x in zip(left, right, got, strict=True):
        a, b = (t or "").split(), (u or "").split()
        want = 1 - word_edits(a, b) / max(1, len(a), len(b))
        assert abs(x - want) < 1e-9 if want >= 0.8 else x < 0.8


def test_near_duplicates_match_all_pairs_by_edits(spark):
    r = random.Random(8)
    texts = []
    for t in some_texts(40, 7, most=200):
        w = t.split()
        texts.append(t)
        for _ in range(r.randrange(4)):
            texts.append(" ".join(edited(w, r.randrange(1 + len(w) // 12), r)) if w else t)
    template = [f"t{k}" for k in range(100)]  # one template, every text far from it in its own way or near a sibling
    for k in range(12):
        own = [f"own{k}.{x}" if x % 4 == k % 4 else w for x, w in enumerate(template)]
        texts += [" ".join(own), " ".join(edited(own, 6, r))]
    texts += [texts[3], texts[3], "same words", "same words"]
    got = {x.doc_id: x.class_id for x in near_duplicates.near_duplicate_classes(table(spark, texts)).collect()}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(t.split() for t in texts), 2):
        n = max(len(a), len(b))
        if a and b and min(len(a), len(b)) >= 0.8 * n and word_edits(a, b) <= 0.2 * n + 1e-9:
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    assert got == {i: root(i) for i in range(len(texts))}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(0, i) for i in range(300, 400)] + [(i, i + 1) for i in range(500, 560)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_hilbert_neighbours_touch(spark):
    for n, bits in ((2, 4), (3, 3)):
        cells = list(itertools.product(range(1 << bits), repeat=n))
        df = spark.createDataFrame([list(c) for c in cells], ", ".join(f"c{k} int" for k in range(n)))
        rows = df.withColumn("h", sharding.hilbert_index([F.col(f"c{k}") for k in range(n)], bits)).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(len(cells)))
        assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in itertools.pairwise(rows))


def test_shards_keep_their_law(spark):
    docs = table(spark, some_texts(501, 3)).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").otherwise("fr"))
    counts = [r["count"] for r in sharding.shard(docs, law="rows", rows_per_part=50).groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 1
    sizes = [r.b for r in sharding.shard(docs, law="bytes", rows_per_part=50).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) - min(sizes) < 2 * 400


def plain(i, body):
    digest = hashlib.sha256(body).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def packed(i, body):
    z = zlib.compressobj(wbits=31)
    return z.compress(plain(i, body)) + z.flush()


def test_warc_salvage():
    for make in (plain, packed):
        records = [make(i, f"page {i} WARC/1.1 inside".encode() * 9) for i in range(6)]
        good = b"".join(records)
        assert [x[2]["warc-record-id"] for x in warc.salvage(good)] == [f"<urn:page:{i}>" for i in range(6)]
        bad = bytearray(good)
        at = len(records[0]) + len(records[1]) + len(records[2]) // 2
        bad[at] ^= 0xFF
        found = list(warc.salvage(bytes(bad)))
        assert [x[2]["warc-record-id"][10:-1] for x in found if x[2]] == ["0", "1", "3", "4", "5"]
        gap = [x[:2] for x in found if x[2] is None]
        assert gap == [(len(records[0]) + len(records[1]), len(records[0]) + len(records[1]) + len(records[2]))]
        cut = list(warc.salvage(good[: -len(records[5]) // 2]))
        assert sum(x[2] is not None for x in cut) == 5 and cut[-1][2] is None
    mixed = packed(1, b"a" * 200) + b"garbage" + plain(2, b"b")
    assert [x[2] is None for x in warc.salvage(mixed)] == [False, True, False]
    assert list(warc.salvage(b"")) == [] and [x[2] for x in warc.salvage(b"\x00" * 50)] == [None]


def test_warc_members_of_several_records():
    body = [plain(i, f"text {i}".encode()) for i in range(4)]
    raw = gzip.compress(b"".join(body[:3])) + gzip.compress(body[3]) + gzip.compress(body[0] + b"junk" + body[1])
    found = list(warc.salvage(raw))
    assert [x[2] and x[2]["warc-record-id"][10:-1] for x in found] == ["0", "1", "2", "3", "0", "1", None]
    assert len({x[:2] for x in found}) == 3 and found[-1][:2] == found[-2][:2]


def test_many_bad_records_are_passed_in_one_search():
    bad = plain(7, b"x" * 900).replace(b"x" * 900 + b"\r", b"x" * 899 + b"y\r")
    raw = bad * 40_000 + plain(8, b"good")
    began = time.time()
    found = list(warc.salvage(raw))
    assert [x[2] is None for x in found] == [True, False] and time.time() - began < 30


def test_warc_of_other_writers():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>body</p>"
    sha1 = base64.b32encode(hashlib.sha1(b"<p>body</p>").digest()).decode()
    head = f"WARC/1.0\r\nwarc-type:response\r\nWARC-Record-Id: <urn:uuid:1>\r\nWARC-Concurrent-To: <urn:uuid:2>\r\nWARC-Concurrent-To: <urn:uuid:3>\r\nX-Note: folded\r\n  line\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{sha1}\r\nCONTENT-LENGTH:   {len(http)}\r\n\r\n"
    (a, z, headers, block), = warc.salvage(head.encode() + http + warc.END)
    assert (a, z, block) == (0, len(head) + len(http) + 4, http)
    assert headers["warc-concurrent-to"] == "<urn:uuid:2>" and headers["x-note"] == "folded line"
    assert warc.payload_of(headers, block) == b"<p>body</p>"
    wrong = head.replace(sha1, sha1[::-1]).encode() + http + warc.END
    assert [x[2] for x in warc.salvage(wrong)] == [None]
    assert warc.digest_holds("sha256:" + hashlib.sha256(b"x").hexdigest().upper(), b"x") and not warc.digest_holds("md5:00", b"x") and warc.digest_holds("blake9:00", b"x")


def test_damaged_archives_are_salvaged_and_logged(spark, tmp_path):
    bodies = {i: f"<p>page {i} " + "text " * (40 + i) for i in range(60)} | {100 + i: "<p>same " * 30 for i in range(20)}
    pages = spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in bodies.items()], "page_id long, url string, html string").coalesce(2)
    warc.write_archives(warc.planned(pages), f"file://{tmp_path}/a", archive_bytes=1 << 20)
    files = sorted((tmp_path / "a").glob("part-*"), key=lambda f: -f.stat().st_size)
    before = {r.page_id: r for r in warc.resolved(spark, f"file://{tmp_path}/a")[0].collect()}
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in before.items()} == {i: (len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in bodies.items()}
    assert len(files) > 2
    raw = bytearray(files[0].read_bytes())
    found = [x for x in warc.salvage(bytes(raw))]
    hit = found[1]
    raw[hit[1] - 30] ^= 0x55  # inside the second record's block
    for crc in (tmp_path / "a").glob(".*.crc"):
        crc.unlink()
    files[0].write_bytes(bytes(raw))
    rows, gaps = warc.resolved(spark, f"file://{tmp_path}/a")
    lost = int(hit[2]["warc-record-id"][10:-1])
    after = {r.page_id for r in rows.collect()}
    assert after == set(bodies) - {lost}
    assert [(r.from_byte, r.to_byte) for r in gaps.collect()] == [hit[:2]] and gaps.first().archive.endswith(files[0].name)


def test_archives_are_cut_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, chr(97 + i % 26) * (700_000 if i % 7 == 0 else 900)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.planned(pages), f"file://{tmp_path}/a", archive_bytes=1 << 20)
    files = [p for p in (tmp_path / "a").glob("part-*") if p.stat().st_size]
    assert max(p.stat().st_size for p in files) <= 1 << 20 and len(files) >= 6
    assert warc.resolved(spark, f"file://{tmp_path}/a")[0].count() == 40


def test_warc_revisits(spark):
    body = "<p>" + "same " * 40
    pages = spark.createDataFrame([(7, "u", body), (3, "u", body), (9, None, body), (4, "u", "short"), (5, "u", "short"), (6, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()}
    assert got == {3: ("response", None, len(body)), 7: ("revisit", 3, len(body)), 9: ("revisit", 3, len(body)), 4: ("response", None, 5), 5: ("response", None, 5), 6: ("response", None, 0)}


def test_winnowing_guarantee(spark):
    texts = some_texts(60, 9, most=80)
    shared = "one two three four five six seven"
    texts += [f"{a} {shared} {b}" for a, b in itertools.pairwise(some_texts(20, 10))]
    df = table(spark, texts)
    rows = {r.doc_id: r for r in df.select("doc_id", F.col("text"), fingerprints.fingerprint(F.col("text")).alias("p")).withColumn("h", fingerprints.entry_hashes(F.col("p"))).withColumn("at", fingerprints.entry_places(F.col("p"))).collect()}
    planted = [set(rows[i].h) for i in range(60, len(texts))]
    assert set.intersection(*planted)  # a run of k + w - 1 words leaves a common entry
    for i, t in enumerate(texts):
        n = len(WORD.findall(t))
        grams = max(min(n, 1), n - fingerprints.K + 1)
        places = rows[i]["at"]
        assert all(0 <= p < max(1, grams) for p in places) and sorted(places) == places
        # every window holds an entry
        assert all(any(k <= p < k + fingerprints.W for p in places) for k in range(grams - fingerprints.W + 1)) and bool(places) == (n > 0)
    same = table(spark, ["a b c d " * 9]).select(fingerprints.entry_places(fingerprints.fingerprint(F.col("text"))).alias("at")).first()["at"]
    assert same[-1] == 32 - (0 if same[-1] == 32 else 32 - same[-1])


def test_edited_text_and_neighbour(spark):
    texts = some_texts(120, 11) + [None, ""]
    df = table(spark, texts)
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    prints = {r.doc_id: r.p for r in df.select("doc_id", fingerprints.fingerprint(F.col("text")).alias("p")).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        assert rows[i].edited == t[: len(t) - half] + nxt[:half] and rows[i].print == prints[i] and rows[i].next_print == prints[(i + 1) % len(texts)]


def test_compact_windows_are_the_tree():
    r = np.random.default_rng(5)
    first = np.array([0, 40, 40, 43, 160])
    value = r.integers(1, 30, 160).astype(np.uint64)
    for width in (1, 2, 7, 20):
        got = set(zip(*(x.tolist() for x in passages.compact_windows(value, first, width)), strict=True))
        want = set()
        for lo, hi in itertools.pairwise(first):
            for c in range(lo, hi):
                left = next((k for k in range(1, c - lo + 1) if value[c - k] <= value[c]), c - lo + 1) - 1
                right = next((k for k in range(1, hi - c) if value[c + k] < value[c]), hi - c) - 1
                if left + right + 1 >= width:
                    want.add((c, left, right))
        assert got == want


def test_passages_are_found(spark):
    r = random.Random(6)
    base = some_texts(30, 12, most=150, vocabulary_size=5000)
    passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(70)).split()
    near = list(passage)
    near[35] = "changed"
    holders = {3: passage, 11: passage, 12: near, 20: passage}
    texts = [f"{t} {' '.join(holders[i])} tail{i}" if i in holders else t for i, t in enumerate(base)]
    found = passages.repeats(table(spark, texts)).collect()
    assert {(x.doc_id, x.first_doc_id) for x in found if not x.kept} == {(11, 3), (12, 3), (20, 3)} and {x.doc_id for x in found if x.kept} == {3}
    for x in found:
        at = len(base[x.doc_id].split())
        assert (x.start, x.end) == (at, at + 70) or x.doc_id == 12
    cut = {x.doc_id: x.text for x in passages.without_repeats(table(spark, texts)).collect()}
    assert cut[3] == texts[3] and cut[11].split() == [*base[11].split(), "tail11"] and all(cut[i] == t for i, t in enumerate(texts) if i not in holders)


def test_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    t, mine = Tokenizer.from_file(vocabulary()), packing.WordTokens(vocabulary(), most=50)
    r = random.Random(1)
    signs = "abZÉé'÷×ªµ \x1c\x85 İßſΣσ.,!1２٣\t\n-_$€😀é 中文K\x7f"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(800)] + ["don't 'tis .'s we'll", "", None]
    data, offsets = tx.as_bytes(pa.array(texts))
    for lo, hi in tx.spans(offsets, 2000):
        ids, at = mine.texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], 0)
        for k in range(hi - lo):
            assert ids[at[k] : at[k + 1]].tolist() == [*t.encode(texts[lo + k] or "", add_special_tokens=False).ids, 0]


def test_special_tokens_and_other_vocabularies(tmp_path):
    from tokenizers import Tokenizer

    t, mine, library = Tokenizer.from_file(vocabulary()), packing.loaded(vocabulary()), packing.LibraryTokens(vocabulary())
    texts = ["a <|endoftext|> b", "x<|ENDOFTEXT|>y", "plain words here", "", "wörter über größe"]
    data, offsets = tx.as_bytes(pa.array(texts))
    for tokens in (mine, library):
        ids, at = tokens.texts(data, offsets, 0)
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(5)] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert isinstance(mine, packing.WordTokens)
    other = open(vocabulary(), encoding="utf-8").read().replace('"type": "Lowercase"', '"type": "NFD"').replace('"type":"Lowercase"', '"type":"NFD"')
    (tmp_path / "other.json").write_text(other, encoding="utf-8")
    assert type(packing.loaded(str(tmp_path / "other.json"))) is packing.LibraryTokens


def test_exact_complements_are_used_first():
    counts = np.zeros(101, np.int64)
    counts[[70, 30, 60, 25, 15, 50, 20, 19, 11]] = [3, 3, 2, 2, 2, 1, 1, 1, 1]  # a single, a pair and a triple complement
    rows = packing.plan(counts, 100)
    filled: dict[int, list[int]] = {}
    for length, a, z, first, _ in rows:
        for k in range(z - a):
            filled.setdefault(first + k, []).append(length)
    assert sorted(map(sorted, filled.values())) == sorted([[30, 70]] * 3 + [[15, 25, 60]] * 2 + [[11, 19, 20, 50]])
    r = random.Random(5)
    for _ in range(60):  # the largest sum of one to three available lengths, by trying all
        avail = np.zeros(41, np.int64)
        for x in (r.randrange(1, 41) for _ in range(r.randrange(6))):
            avail[x] += 1
        held, gap = [x for x in range(41) for _ in range(avail[x])], r.randrange(1, 41)
        reached = {sum(c) for k in (1, 2, 3) for c in itertools.combinations(held, k) if sum(c) <= gap}
        got = packing.best_combination(avail, gap, 40)
        assert (sum(got) if got else 0) == max(reached, default=0)
        assert all(avail[x] >= (got or ()).count(x) for x in got or ())


def test_plan_places_every_piece():
    r = np.random.default_rng(2)
    for capacity, most in ((16, 40), (64, 200), (2048, 3000)):
        counts = np.zeros(capacity + 1, np.int64)
        for x in r.integers(1, capacity + 1, most):
            counts[x] += 1
        filled: dict[int, list[tuple[int, int]]] = {}
        used = np.zeros_like(counts)
        for length, a, z, first, offset in packing.plan(counts, capacity):
            assert a == used[length]
            used[length] = z
            for k in range(z - a):
                filled.setdefault(first + k, []).append((offset, length))
        assert (used == counts).all()
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        total = int((counts * np.arange(capacity + 1)).sum())
        assert len(filled) <= 1.06 * -(-total // capacity) + 1


def test_bitmask_filter_returns_all_languages():
    a, b = np.arange(1, 500, dtype=np.uint64), np.arange(400, 900, dtype=np.uint64)
    counted = {x: (tx.mix(h), np.full(len(h), 9)) for x, h in (("a", a), ("b", b))}
    counted = {x: (h[np.argsort(h)], n) for x, (h, n) in counted.items()}
    m = langid.build(["a", "b"], counted, ratio=0.25, least=3, log2_slots=16)
    assert (m.masks(tx.mix(a), 0) & np.uint64(1)).all() and (m.masks(tx.mix(b), 0) & np.uint64(2)).all()
    none = m.masks(tx.mix(np.arange(10**6, 10**6 + 20000, dtype=np.uint64)), 0)
    assert abs(((none & np.uint64(1)) > 0).mean() - m.false_positive[0]) < 0.01


def test_language_held_out(spark):
    r = random.Random(4)
    parts = {"xx": ["zor", "gli", "pum"], "yy": ["ané", "lou", "ble"], "zz": ["kra", "tho", "win"]}
    rows = [(i, " ".join("".join(r.choice(parts[x]) for _ in range(3)) for _ in range(r.randrange(1, 30))), x) for i in range(400) for x in [r.choice(list(parts))]]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([got[i].lang_pred == x for i, _, x in rows]) > 0.99
