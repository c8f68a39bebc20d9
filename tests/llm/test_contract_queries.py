"""Every registered query on a small corpus: its columns, types and rules, recomputed plainly."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from deedflow.llm import fingerprints, langid, queries, sharding, toxicity
from deedflow.llm import textops as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")
N = 160


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    syllables = {"en": ["ther", "ing", "on", "the", "wa", "lk"], "fr": ["eau", "que", "oi", "le", "tré", "ons"], "de": ["sch", "ung", "ein", "der", "ör", "cht"]}
    word = lambda lang: "".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(N):
        lang = r.choice(list(syllables))
        text = " ".join(word(lang) for _ in range(r.randrange(1, 120))) + (" you vile idiot" if i % 6 == 0 else "")
        rows.append([i, text, lang, f"s{min(3, r.randrange(8))}"])
    rows[3][1], rows[4][1], rows[5][3], rows[7][1], rows[9][1] = None, "", None, rows[8][1], "one two"
    path = tmp_path_factory.mktemp("corpus")
    df = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(N)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    html = {i: f"<p>{rows[i % 40][1] or ''}</p>" * 3 for i in range(60)}
    spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in html.items()], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path), {x[0]: x for x in rows}, html


SCHEMAS = {
    "op1_mix_sources": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op2_toxicity": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op3_quality_rules": [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", "boolean"), ("kept", "boolean")],
    "op4_near_duplicates": [("doc_id", "bigint"), ("class_id", "bigint")],
    "op5_hilbert_shards": [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")],
    "op6_warc_round_trip": [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")],
    "op7_winnowing": [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")],
    "op8_repeated_passages": [("doc_id", "bigint")],
    "op9_pack_sequences": [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")],
    "op10_language_id": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
}


@pytest.fixture(scope="module")
def results(spark, corpus):
    held = {}

    def get(name):
        if name not in held:
            df = queries.QUERIES[name](spark, corpus[0])
            held[name] = (df.dtypes, df.collect())
        return held[name]

    return get


@pytest.mark.parametrize("name", list(SCHEMAS))
def test_columns_and_rows(results, name):
    dtypes, rows = results(name)
    wanted = SCHEMAS[name]
    assert dtypes[: len(wanted)] == wanted
    if name not in ("op8_repeated_passages", "op9_pack_sequences", "op6_warc_round_trip"):
        assert sorted(r.doc_id for r in rows) == list(range(N))


def test_shards(results, corpus):
    rows = results("op5_hilbert_shards")[1]
    for r in rows:
        raw = (corpus[1][r.doc_id][1] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = [sum(r.shard == s for r in rows) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == N
    curve = [[r.curve for r in sorted(rows, key=lambda r: r.slot) if r.shard == s] for s in range(16)]
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in range(16))
    flat = [c for shard in curve for c in shard]
    assert flat == sorted(flat)
    values = lambda k: [len({corpus[1][r.doc_id][k] for r in rows if r.shard == s}) for s in range(16)]
    assert np.mean(values(2)) < 2.2 and np.mean(values(3)) < 3  # of 3 languages and 5 sources, a shard holds few


def test_shards_over_several_parts(spark, corpus):
    docs = queries.documents(spark, corpus[0])
    for law in ("rows", "bytes"):
        one, many = ({r.doc_id: (r.shard, r.slot, r.curve) for r in sharding.shard(docs, law=law, rows_per_part=n).collect()} for n in (10_000, 17))
        assert one == many


def spark_hash(*values, seed: int = 42) -> int:
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed)
    return seed


def winnowed(text: str) -> dict[int, int]:
    """Place -> hash of the selected k-grams: of every window of 4 the least, the rightmost of equal ones."""
    w = WORD.findall(text)
    if not w:
        return {}
    if len(w) < 4:
        grams = [spark_hash(*w)]
    else:
        two = [spark_hash(a, b) for a, b in itertools.pairwise(w)]
        grams = [spark_hash(two[i], two[i + 2]) for i in range(len(w) - 3)]
    grams = [g >> (fingerprints.PLACE + 1) for g in grams]
    out = {}
    for i in range(max(1, len(grams) - 3)):
        window = range(i, min(i + 4, len(grams)))
        best = min(window, key=lambda k: (grams[k], -k))
        out[best] = grams[best]
    return out


def test_winnowing(spark, corpus, results):
    texts = {i: x[1] or "" for i, x in corpus[1].items()}
    got = {r.doc_id: {e.place: e.hash for e in r.entries} for r in fingerprints.entries(queries.documents(spark, corpus[0])).collect()}
    assert got == {i: winnowed(t) for i, t in texts.items()}
    ties = spark.createDataFrame([(1, "a b c d " * 9), (2, "x " * 30)], "doc_id long, text string")
    assert {r.doc_id: {e.place: e.hash for e in r.entries} for r in fingerprints.entries(ties).collect()} == {1: winnowed("a b c d " * 9), 2: winnowed("x " * 30)}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    rows = {r.doc_id: r for r in results("op7_winnowing")[1]}
    for i, t in texts.items():
        nxt = texts[(i + 1) % N]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        own, after, changed = (set(winnowed(x).values()) for x in (t, nxt, edited))
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert {e.place: e.hash for e in r.entries} == winnowed(t) and r.n_entries == len(r.entries)
        assert abs(r.near_edited - like(own, changed)) < 1e-12 and abs(r.near_next - like(own, after)) < 1e-12
    assert all((rows[a].fingerprint == rows[b].fingerprint) == (winnowed(texts[a]) == winnowed(texts[b])) for a in range(0, N, 5) for b in range(N))


@pytest.mark.parametrize(("size", "edges", "small_ends"), [(10, 4096, True), (7, 5, True), (5, 1, True), (10, 4096, False)])
def test_neighbours_over_several_ranges(spark, corpus, monkeypatch, size, edges, small_ends):
    if not small_ends:
        monkeypatch.setattr(fingerprints, "FOLLOWING_BYTES", 0)
    rows = fingerprints.with_next(queries.documents(spark, corpus[0]), rows_per_range=size, most_edges=edges).collect()
    texts = {i: x[1] or "" for i, x in corpus[1].items()}
    assert {r.doc_id: r.next_text for r in rows} == {i: texts[(i + 1) % N] for i in texts} and len(rows) == N


def test_toxicity_scores_are_the_linear_model(spark, corpus, results):
    rows = {r.doc_id: r for r in results("op2_toxicity")[1]}
    docs = queries.documents(spark, corpus[0])
    model = toxicity.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).select("doc_id", "text"), toxicity.training_rows(spark.read.parquet(f"{corpus[0]}/labels.parquet")))
    weight = dict(zip(model.lexicon.names, model.weights.tolist(), strict=True))
    for i, x in corpus[1].items():
        words = set(re.findall(r"[^\W\d_]+", (x[1] or "").lower()))
        names = {e for w in words for e in [w, *[w[:k] + "-" for k in (4, 5, 6) if len(w) >= k]]}
        z = model.bias + sum(weight.get(e, 0.0) for e in names)
        assert abs(rows[i].score - 1 / (1 + math.exp(-z))) < 1e-9
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and rows[i].predicted == int(rows[i].score >= 0.7)
        assert rows[i].predicted == int(i % 6 == 0)


def test_language_scores_recomputed(spark, corpus, results):
    docs = queries.documents(spark, corpus[0])
    model = langid.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    rows = {r.doc_id: r for r in results("op10_language_id")[1]}
    for i, x in corpus[1].items():
        raw = (x[1] or "").lower().encode()
        folded = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in raw)
        seen, total = np.zeros(len(model.languages)), 0
        for width in langid.WIDTHS:
            for k in range(len(folded) - width + 1):
                gram = folded[k : k + width]
                if 32 in gram[1:-1]:
                    continue
                value = np.array([int.from_bytes(gram, "big") + (width << 56)], np.uint64)
                mask = int(model.masks(tx.mix(value), 0)[0])
                total += 1
                seen += [(mask >> n) & 1 for n in range(len(model.languages))]
        score = np.maximum(seen / max(1, total) - model.false_positive, 0) / np.maximum(1e-9, 1 - model.false_positive)
        want = model.languages[int(score.argmax())] if re.search(r"[^\W\d_]", x[1] or "") else "und"
        assert rows[i].lang_pred == want and (want == "und" or abs(rows[i].score - score.max() / (score.sum() or 1)) < 1e-9)
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_pages(results, corpus):
    html, first = corpus[2], {}
    for i, t in sorted(html.items()):
        first.setdefault(t, i)
    for r in results("op6_warc_round_trip")[1]:
        raw = html[r.page_id].encode()
        again = len(raw) >= 100 and first[html[r.page_id]] < r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[html[r.page_id]]) if again else ("response", None))


def test_packed_pieces(results, corpus):
    from tokenizers import Tokenizer

    t, filled, pieces = Tokenizer.from_file(queries.vocabulary()), {}, {}
    for r in results("op9_pack_sequences")[1]:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in filled.values():
        assert [o for o, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1] and sum(n for _, n in parts) <= 2048
    for i, x in corpus[1].items():
        ids = np.array([*t.encode(x[1] or "", add_special_tokens=False).ids, 0], "<u4")
        assert sorted(pieces[i]) == [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
