"""Operator 10: language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in every slot, one bit per language. An n-gram
sets its languages' bits in two slots; a look-up returns the AND of the two
words, that is all languages that contain the n-gram. A text's score for a
language is the number of its n-grams that carry the language's bit, less the
false positives expected from how full that language's slice is; the language
with the largest corrected share wins.

An n-gram belongs to the languages where it is at least ``ratio`` times as
frequent as where it is most frequent. N-grams are counted on a bounded sample
of labelled texts (``fit_rows`` a language, whole texts, lowest hash first), so
the filter's size does not grow with the corpus. Scoring is one narrow pass.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
languages of null label are not learned; with nothing to learn from, every text
is ``und``; ties go to the language first in code-point order; a label's repeated
or extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import crc32_bucket, materialise, ship, small, unit_hash

#: Widths of n-grams, in UTF-8 bytes of lower-cased words and the gaps beside them.
WIDTHS = (3, 4)


def grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per width: hashes of the n-grams of lower-cased texts, in order, and where each text's n-grams begin (n + 1 entries).

    Whatever is no letter counts as one kind of gap; an n-gram has a gap at its ends only.
    """
    n = len(data)
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    folded = np.where(letter, data, np.uint8(32))
    wide = np.concatenate([folded, np.full(8, 32, np.uint8)]).astype(np.uint64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    inner = np.concatenate([letter, np.zeros(8, bool)])
    good, key, out = np.arange(n) < ends, wide[:n].copy(), []
    for j in range(1, max(WIDTHS)):
        key = key << tx.U64(8) | wide[j : j + n]
        if j >= 2:
            good &= inner[j - 1 : j - 1 + n]
        if j + 1 in WIDTHS:
            kept = np.flatnonzero(good & (np.arange(j, n + j) < ends))
            out.append((tx.mix(key[kept] + tx.U64((j + 1) << 56)), np.searchsorted(kept, offsets)))
    return out


@dataclass
class LanguageFilter:
    """Slots of language bits, and per language the chance that a look-up finds it by accident."""

    languages: list[str]
    slots: np.ndarray  # uint64, one word of up to 64 languages a slot and slice
    false_positive: np.ndarray

    def masks(self, h: np.ndarray, part: int) -> np.ndarray:
        size = np.uint64(self.slots.shape[1] - 1)
        return self.slots[part][h & size] & self.slots[part][(h >> tx.U64(32)) & size]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected share of the texts' n-grams that each language contains, [texts, languages]."""
        n = len(offsets) - 1
        seen, total = np.zeros((n, len(self.languages))), np.zeros(n)
        for h, first in grams(data, offsets):
            total += np.diff(first)
            for i in range(len(self.languages)):
                if i % 64 == 0:
                    words = self.masks(h, i // 64)
                hit = ((words >> tx.U64(i % 64)) & tx.U64(1)).astype(np.uint8)
                upto = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                seen[:, i] += upto[first[1:]] - upto[first[:-1]]
        return np.maximum(seen / np.maximum(total, 1)[:, None] - self.false_positive, 0) / np.maximum(1e-9, 1 - self.false_positive)


def build(languages: list[str], counted: dict[str, tuple[np.ndarray, np.ndarray]], *, ratio: float, least: int, log2_slots: int) -> LanguageFilter:
    """Filter from each language's n-gram hashes and counts; an n-gram seen fewer than ``least`` times in a language is not its own."""
    every = np.unique(np.concatenate([h for h, _ in counted.values()])) if counted else np.zeros(0, np.uint64)
    share = np.zeros((len(languages), len(every)))
    for i, name in enumerate(languages):
        h, n = counted[name]
        share[i, np.searchsorted(every, h)] = np.where(n >= least, n / max(1, n.sum()), 0)
    member = (share > 0) & (share >= ratio * share.max(axis=0, initial=0))
    slots = np.zeros(((len(languages) + 63) // 64 or 1, 1 << log2_slots), np.uint64)
    size = np.uint64((1 << log2_slots) - 1)
    fp = np.zeros(len(languages))
    for i in range(len(languages)):
        h, bit = every[member[i]], tx.U64(1) << tx.U64(i % 64)
        for place in (h & size, (h >> tx.U64(32)) & size):
            slots[i // 64][place] |= bit
        fp[i] = float(((slots[i // 64] >> tx.U64(i % 64)) & tx.U64(1)).mean()) ** 2
    return LanguageFilter(languages, slots, fp)


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", fit_rows: int = 600, ratio: float = 0.25, least: int = 3, log2_slots: int = 20, most_grams: int = 100_000) -> LanguageFilter:
    """Learn the filter from at most ``fit_rows`` texts a language; of each language its ``most_grams`` commonest n-grams count."""
    spark = labelled.sparkSession
    ship(spark)
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), unit_hash(F.col(text_col)).alias("u"))
    per_language = materialise(known.groupBy("lang").count().select("lang", (F.lit(2.0 * fit_rows) / F.col("count")).alias("below")), "languages")
    near = known.join(small(per_language, per_language.count()), "lang").filter(F.col("u") < F.col("below")).dropDuplicates(["lang", "text"])
    sample = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))).filter(F.col("k") <= fit_rows).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.as_bytes(pc.utf8_lower(batch.column(1).fill_null("")))
            for lo, hi in tx.spans(offsets, 1 << 20):
                names = batch.column(0).slice(lo, hi - lo).to_pylist()
                codes = {x: i for i, x in enumerate(dict.fromkeys(names))}
                found = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for (h, first), (name, i) in ((g, c) for g in found for c in codes.items()):
                    own = np.repeat(np.array([codes[x] == i for x in names]), np.diff(first))
                    values, n = np.unique(h[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n, pa.int64())], ["lang", "h", "n"])

    counted = sample.mapInArrow(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))).filter(F.col("k") <= most_grams).select("lang", "h", "n").toPandas()
    languages = sorted(ranked["lang"].unique().tolist())
    counts = {x: (g["h"].to_numpy().astype(np.int64).view(np.uint64), g["n"].to_numpy()) for x, g in ranked.groupby("lang")}
    return build(languages, counts, ratio=ratio, least=least, log2_slots=log2_slots)


def predict(docs: DataFrame, model: LanguageFilter, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with lang_pred and score of every whole text. Score: the winner's share of all languages' scores."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(*keep, F.col(text_col).alias("__text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    schema = T.StructType([*d.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            scores = np.zeros((n, max(1, len(m.languages))))
            data, offsets = tx.as_bytes(pc.utf8_lower(batch.column(n_keep).fill_null("")))
            for lo, hi in tx.spans(offsets, 1 << 20) if m.languages else ():
                scores[lo:hi] = m.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            best, total = scores.argmax(axis=1), scores.sum(axis=1)
            letters = batch.column(n_keep + 1).to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
            names = [m.languages[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            score = np.where(letters & (total > 0), scores.max(axis=1) / np.where(total > 0, total, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(names, pa.string()), pa.array(score)], schema.names)

    n_keep = len(keep)
    return d.mapInArrow(run, schema)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: float) -> DataFrame:
    """Learn from labelled rows that are not held out (crc32 of the id modulo 4 is not 2) and predict every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (crc32_bucket(F.col(id_col), 4) == 2).alias("held_out"))
    return predict(d, fit(d.filter(~F.col("held_out")), **options), keep=["doc_id", "held_out"])
