"""Operator 2: toxicity by weak supervision.

Many voters look at a text: lexicon voters (words and word beginnings that the
labelled training rows mark as toxic, dealt into several lexicons), a small
general lexicon, and pattern voters (density, repetition, shouting, absence of
any hit). A voter says toxic, says clean, or abstains. A generative label model
(expectation-maximisation over the unknown class) estimates what each vote is
worth in either class; voters that agree beyond what the class explains share
their weight. A linear classifier is trained on the label model's posteriors and
scores every whole text in one narrow pass.

The lexicons, the label model and the classifier are fitted on a bounded sample:
at most ``fit_rows`` labelled texts of either class, lowest hash first. Texts are
read in tasks; the driver sees the entries and votes of the sample, no text. The
sample takes both classes evenly and scores are kept at that even prior.

Defined cases: a null, empty or blank text gets the score of a text without any
hit; labels of null are not learned, and of several labels of one document the
highest counts; with nothing to learn from, every score is 0.5 or less; ids,
sources and languages are never read by a score; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import crc32_bucket, materialise, ship, unit_hash

WORDS = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that may be lexicon entries beside whole words.
PREFIXES = (4, 5, 6)
#: A general lexicon that needs no labels.
SEED_LEXICON = ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "clown")
KINDS, FOLDS = 1 + len(PREFIXES), 2
TOXIC, CLEAN, ABSTAIN = 1, 0, 2


def entries(word: str) -> list[str]:
    """Lexicon entries a word can match: itself and its beginnings (written with a dash)."""
    return [word, *[word[:k] + "-" for k in PREFIXES if len(word) >= k]]


@dataclass
class Lexicon:
    """Entries by number; remembers what each word matches."""

    names: list[str]
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.number = {e: i for i, e in enumerate(self.names)}

    def match(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[word] = tuple(self.number[e] for e in entries(word) if e in self.number)
        return got

    def look(self, text: str) -> tuple[list[int], int, int]:
        """Entries found in a text, how many of its words match one, and how many words it has."""
        tokens = WORDS.findall(text.lower())
        found: set[int] = set()
        words: set[str] = set()
        for w in set(tokens):
            if m := self.match(w):
                found.update(m)
                words.add(w)
        hits = sum(w in words for w in tokens) if words else 0
        return sorted(found), hits, len(tokens)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    voters: list[str]
    accuracy: np.ndarray

    def score(self, text: str | None) -> float:
        found = self.lexicon.look(text or "")[0]
        z = self.bias + (float(self.weights[found].sum()) if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def votes(lexicon: Lexicon, texts: list[str]) -> tuple[np.ndarray, list[str], list[list[int]]]:
    """Vote matrix [texts, voters], voter names, and the entries found."""
    group = {}
    for i, e in enumerate(lexicon.names):
        kind = PREFIXES.index(len(e) - 1) + 1 if e.endswith("-") else 0
        group[i] = kind * FOLDS + i % FOLDS
    seeds = set(SEED_LEXICON)
    names = [f"lexicon {k}.{f}" for k in range(KINDS) for f in range(FOLDS)] + ["seed lexicon", "dense", "repeated", "shouting", "no hit", "sparse"]
    out = np.full((len(texts), len(names)), ABSTAIN, np.int8)
    all_found = []
    base = KINDS * FOLDS
    for row, text in enumerate(texts):
        found, hits, n = lexicon.look(text)
        all_found.append(found)
        for i in found:
            out[row, group[i]] = TOXIC
        tokens = WORDS.findall(text)
        lower = Counter(w.lower() for w in tokens)
        if seeds & lower.keys():
            out[row, base] = TOXIC
        if n and hits / n >= 0.01:
            out[row, base + 1] = TOXIC
        if hits >= 3:
            out[row, base + 2] = TOXIC
        if n >= 10 and sum(w.isupper() for w in tokens) > 0.5 * n:
            out[row, base + 3] = TOXIC
        if hits == 0:
            out[row, base + 4] = CLEAN
        if n and hits / n < 0.001:
            out[row, base + 5] = CLEAN
    return out, names, all_found


def label_model(v: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the toxic class per row, and P(vote | class) as [voters, classes, votes].

    Starts from the majority of votes. Correlated voters (given the class) are discounted: a voter counts
    1 / (1 + the sum of its correlations with the others).
    """
    n, m = v.shape
    seen = np.stack([v == k for k in range(3)], axis=2).astype(float)
    balance = seen[:, :, TOXIC].sum(1) - seen[:, :, CLEAN].sum(1)
    post = 1 / (1 + np.exp(-balance))
    weight = np.ones(m)
    table = np.full((m, 2, 3), 1 / 3)
    for turn in range(rounds):
        for y, p in enumerate((1 - post, post)):
            table[:, y] = (np.einsum("n,nmk->mk", p, seen) + 0.1) / (p.sum() + 0.3)
        prior = np.clip(post.mean(), 0.01, 0.99)
        odds = np.log(prior / (1 - prior)) + np.einsum("nmk,mk,m->n", seen, np.log(table[:, 1] / table[:, 0]), weight)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if turn % 10 == 9:
            x = (v == TOXIC).astype(float) - (v == CLEAN)
            rest = x - np.where(new[:, None] > 0.5, x[new > 0.5].mean(0) if (new > 0.5).any() else 0, x[new <= 0.5].mean(0) if (new <= 0.5).any() else 0)
            scale = np.sqrt((rest**2).sum(0)) + 1e-9
            corr = np.abs((rest.T @ rest) / scale[:, None] / scale)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(1))
        done, post = np.abs(new - post).max() < 1e-6 and turn > 20, new
        if done:
            break
    return post, table


def linear(x: np.ndarray, y: np.ndarray, l2: float = 1e-5, steps: int = 2000) -> np.ndarray:
    """Logistic regression by Adam on soft labels; the last weight is the bias. No weight of an entry is below 0."""
    n, m = x.shape
    w, first, second = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    balance = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).mean()), 0.5 / max(1e-9, (y <= 0.5).mean()))
    for t in range(1, steps + 1):
        z = x @ w[:-1] + w[-1]
        g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.concatenate([x.T @ g + l2 * w[:-1], [g.sum()]])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, toxic): at most ``fit_rows`` labelled texts of either class, equal texts once."""
    found = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("u", unit_hash(F.col("doc_id")))
    picked = [found.filter(F.col("toxic") == y).orderBy("u", "doc_id").limit(fit_rows) for y in (0, 1)]
    ids = materialise(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("label_id"), "toxic"), "picked")  # 2 * fit_rows at most
    texts = docs.filter(F.col("text").isNotNull()).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).groupBy("text").agg(F.max("toxic").cast("long").alias("toxic"))
    return materialise(texts, "labelled")


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 2500, most_entries: int = 600, least: int = 4, least_share: float = 0.002) -> ToxicityModel:
    """Fit on labelled documents (doc_id, text) and labels (doc_id, toxic), as given: leave held-out rows out before.

    ``fit_rows`` bounds the labelled texts of a class, ``most_entries`` the lexicon; an entry stands in ``least``
    toxic texts and in ``least_share`` of them at least, and is at least 100 times likelier there.
    """
    ship(docs.sparkSession)
    rows = sample(docs, labels, fit_rows)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: Counter[str] = Counter()
        neg: Counter[str] = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (pos if toxic else neg).update({e for w in set(WORDS.findall(text.lower())) for e in entries(w)})
        keys = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["entry", "pos", "neg"])

    n_pos, n_neg = (max(1, x or 0) for x in rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first())
    counted = rows.mapInArrow(count, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    marked = counted.filter((F.col("pos") >= max(least, least_share * n_pos)) & ((F.col("pos") / n_pos) >= 100 * (F.col("neg") + 0.01) / n_neg)).orderBy(F.desc("pos"), "entry").limit(most_entries)
    lexicon = Lexicon([r["entry"] for r in marked.select("entry").collect()])
    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, _, found = votes(lexicon, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(v.tolist(), pa.list_(pa.int8())), pa.array(found, pa.list_(pa.int32()))], ["votes", "found"])

    names = votes(lexicon, [])[1]
    seen = rows.mapInArrow(vote, "votes array<tinyint>, found array<int>").toPandas()  # 2 * fit_rows rows of numbers at most
    if len(seen) == 0 or not lexicon.names:
        return ToxicityModel(lexicon, np.zeros(len(lexicon.names)), -2.0, names, np.zeros((len(names), 2, 3)))
    order = np.lexsort(np.array(seen["votes"].tolist()).T)  # sums do not depend on the order that tasks end in
    v, found = np.array(seen["votes"].tolist(), np.int8)[order], [seen["found"].iloc[k] for k in order]
    post, table = label_model(v)
    x = np.zeros((len(v), len(lexicon.names)))
    for row, f in enumerate(found):
        x[row, f] = 1
    w = linear(x, post)
    return ToxicityModel(Lexicon(lexicon.names), w[:-1], float(w[-1]), names, table)


def score(docs: DataFrame, model: ToxicityModel, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and the score of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*d.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], schema.names)

    return d.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows whose text scores below the threshold, all columns as they were."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py()) < threshold for t in batch.column(place)], pa.bool_()))
            tx.release()

    return docs.mapInArrow(run, docs.schema)


def training_rows(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of the id modulo 3 is not 1."""
    return labels.select("doc_id", "toxic").filter(crc32_bucket(F.col("doc_id"), 3) != 1)
