"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing extra columns, and an empty table."""

from __future__ import annotations

import pytest

import corpus_pipeline
from deedflow.llm import fingerprints, langid, mixing, near_duplicates, packing, passages, quality, sharding, toxicity, warc
from deedflow.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, shard int, slot long, taken long, score double, __key long, __id long, __node long, __spans string, __hash string, __source string, __copy int, __t_slot int"
LONG = " ".join(f"w{i}x" for i in range(6000))
PROSE = "the old house on the hill was sold to a family from the north who wanted a garden and some quiet years"


@pytest.fixture(scope="module")
def nasty(spark):
    rows = [
        (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, None, None), (None, PROSE, "en", "a"), (None, None, None, None), (3, None, "fr", "b"),
        (4, "", "fr", "b"), (5, " \n\t ", "de", "b"), (6, LONG, "en", "a"), (7, LONG + " end", "en", "a"), (8, "12 34 !!", "en", "c"), (9, "one", "en", "c"),
        (9, "one", "en", "c"), (10, "Été à l’école \x85 naïve 中文 \x00 x", "fr", "c"), (-5, "a b c d", "es", "a"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, 2, 3, 4, 5, 0.5, 1, 2, 3, "s", None, "x", 7, 8) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (2, 1, None), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(params=["nasty", "empty"])
def docs(request, nasty):
    return nasty if request.param == "nasty" else nasty.limit(0)


def test_mixing(docs):
    mixed = mixing.mix_sources(docs, block=16)
    assert mixed.placed.count() == docs.count()
    out = mixing.mixed_documents(docs, mixed)
    assert out.columns == docs.columns and out.filter("text is null or text = ''").count() == 0


def test_toxicity(docs, labels):
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(docs.drop("score"), model, keep=["doc_id"]).collect()
    assert len(scored) == docs.count() and all(0 <= r.score < 0.7 for r in scored)
    assert toxicity.clean_documents(docs, model).count() == docs.count()


def test_quality(docs):
    rows = quality.quality(docs).collect()
    assert len(rows) == docs.count()
    assert all(not r.kept for r in rows if r.n_words < 20)


def test_near_duplicates(docs):
    classes = near_duplicates.near_duplicate_classes(docs).collect()
    assert len(classes) == docs.count()
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    if classes:
        assert texts.count(PROSE) == 1 and texts.count("one") == 1 and texts.count(None) == 2 and texts.count("") == 1
        assert len([t for t in texts if t and t.startswith("w0x")]) == 1


def test_sharding(docs):
    for law in ("rows", "bytes"):
        rows = sharding.shard(docs, law=law, shards=4).collect()
        assert len(rows) == docs.count()
        for s in range(4):
            slots = sorted(r.slot for r in rows if r.shard == s)
            assert slots == list(range(len(slots)))


def test_warc(spark, docs):
    pages = docs.selectExpr("doc_id as page_id", "source as url", "text as html", "size as digest", "node as first")
    assert warc.round_trip(pages).count() == docs.count()


def test_fingerprints(docs):
    rows = fingerprints.edited_fingerprints(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.print == [] for r in rows if r.n_chars == 0)


def test_passages(docs):
    cut = passages.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    found = passages.repeats(docs).filter("not kept").collect()
    assert {r.doc_id for r in found} <= {7}
    if docs.count():
        assert found and next(r.text for r in cut.collect() if r.doc_id == 7).split() == ["end"]


def test_packing(docs):
    rows = packing.pack(docs, vocabulary(), max_tokens=64).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert all(r.length <= 64 and r.offset + r.length <= 64 for r in rows)


def test_langid(docs):
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5, 8))


def test_pipeline_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name.replace(' ', '_')}"
        stage(spark, at, str(tmp_path)).write.parquet(out)
        at = spark.read.parquet(out)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert at.columns == docs.columns
