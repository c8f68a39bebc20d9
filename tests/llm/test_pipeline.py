"""The pipeline's decisions on a small corpus with everything planted, re-computed plainly."""

from __future__ import annotations

import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(1)
    prose = lambda n: " ".join(f"{r.choice('abcde')}{r.randrange(3000)}" for _ in range(n))
    clean = [prose(r.randrange(80, 160)) for _ in range(150)]
    toxic = [f"{prose(60)} you idiot scum" for _ in range(20)]
    copies = [clean[0]] * 3 + [clean[1] + " tail"]
    passage = prose(80)
    holders = [f"{prose(60)} {passage} {prose(60)}" for _ in range(4)]
    texts = clean + toxic + copies + holders
    n = len(clean)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(n <= i < n + 20)) for i in range(n + 20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    ids = lambda name: {x.doc_id for x in seen[name]}
    assert ids("toxicity") == set(range(len(texts))) - set(range(n, n + 20))
    left = ids("toxicity") - set(range(n + 20, n + 24))
    assert ids("near duplicates") == left
    cut = {x.doc_id: x for x in seen["repeated passages"]}
    first, *others = range(n + 24, n + 28)
    assert cut[first].text == texts[first] and all(cut[i].text == texts[i] for i in range(n))
    for i in others:
        assert cut[i].text.split() == texts[i].split()[:60] + texts[i].split()[140:] and cut[i].n_chars == len(cut[i].text)
    words = sum(len(x.text.split()) for x in seen["repeated passages"])
    assert abs(sum(len(x.text.split()) for x in seen["mixing"]) - 1.5 * words) <= 3
    assert all(cut[x.doc_id].text.split()[: len(x.text.split())] == x.text.split() for x in seen["mixing"])
    filled: dict[int, list[tuple[int, int]]] = {}
    for x in seen["packing"]:
        filled.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(x.length for x in seen["packing"])
    assert len(filled) <= -(-total // 2048) + 1
