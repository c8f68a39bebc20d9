"""Operator 9: pack token pieces into sequences by exact-complement hashing.

Documents are tokenized and only documents longer than a sequence are cut. The
plan works on counts per piece length, so it is as large as the sequence length
allows whatever the corpus holds: a sequence starts with the longest piece left,
and the gap it leaves is looked up among the available single lengths, sums of two
and sums of three; a combination that fills it exactly is consumed as often as its
counts allow. A gap without an exact combination takes the best fit, the largest
sum that goes in, and so on until nothing does. Pieces are then numbered within
their length and take the place the plan gives that number.

Tokenizing: with the vocabulary's known normalizer and pre-tokenizer, words are
split in numpy and each distinct one is encoded once a worker; any other
vocabulary encodes whole texts with its own library.

Scale: one pass over the texts into a narrow table of pieces; numbering is a
two-level count (a length that holds a third of all pieces is many tasks); the
plan, a few thousand rows bounded by the sequence length, is broadcast.

Defined cases: a null, empty or blank text is the end token alone; null ids and
repeated rows are packed like others (which of two equal pieces comes first is
left open); other columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import materialise, ship, unit_hash

#: What of a vocabulary file ``WordTokens`` relies on.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
#: Words that are one run of the pre-tokenizer and normal already.
SIMPLE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def byte_signs() -> dict[int, str]:
    """Code point of a byte -> the sign that stands for it in byte-level vocabularies: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and the runs of them (start, end, first run of each text) that a vocabulary of words encodes alone.

    Runs are what the vocabulary's pre-tokenizer makes: letters, single digits, other signs. Words with an
    apostrophe or beyond ASCII and the accented Latin letters are left whole: the library splits them.
    """
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    lower[lead[(tail <= 0x9E) & (tail != 0x97)] + 1] += 32
    ink = (data != 32) & ((data < 9) | (data > 13))
    plain = data < 128
    accent = lead[(tail != 0x97) & (tail != 0xB7)]
    plain[accent] = plain[accent + 1] = True
    odd = ~plain | (data == 0x27) | ((data < 32) & ink) | (data == 127)
    kind = np.full(len(data), 3, np.uint8)
    kind[((lower >= 97) & (lower <= 122)) | (data >= 128)] = 1
    kind[(data >= 48) & (data <= 57)] = 2
    kind[~ink] = 0
    w = tx.words(data, offsets)
    head = ink.copy()
    head[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    head[w.start] = True
    if odd.any():
        upto = np.concatenate([[0], np.cumsum(odd)])
        for a, z in zip(*(x[upto[w.end] > upto[w.start]].tolist() for x in (w.start, w.end)), strict=True):
            head[a + 1 : z] = False
    start = np.flatnonzero(head)
    end = np.minimum(np.concatenate([start[1:], [len(data)]]), np.repeat(w.end, np.diff(np.searchsorted(start, np.concatenate([w.start, [len(data)]])))))
    return lower, start, end, np.searchsorted(start, offsets)


class LibraryTokens:
    """Token ids of whole texts by the vocabulary's own library."""

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)

    def texts(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        ids = [[*self.tokenizer.encode(raw[a:z].decode(), add_special_tokens=False).ids, end_id] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]).astype(np.int64)
        return np.fromiter((i for x in ids for i in x), np.uint32, int(at[-1])), at


class WordTokens(LibraryTokens):
    """Token ids of words, each distinct one encoded once; holds at most ``most`` and then starts anew.

    Runs of texts that spell a special token are left to the library.
    """

    def __init__(self, path: str, most: int = 400_000):
        super().__init__(path)
        self.most, self.signs = most, byte_signs()
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    @staticmethod
    def suits(path: str) -> bool:
        """Whether the vocabulary splits and folds words as this class does."""
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        steps = (known.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split = [(x.get("type"), x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in steps]
        wanted = [("Split", SPLIT, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
        return known.get("normalizer") == NORMALIZER and split == wanted and known.get("model", {}).get("type") == "BPE"

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.start, self.size, self.flat, self.kept = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def learn(self, hashes: list[int], found: list[str]) -> None:
        one = self.tokenizer.model.tokenize
        ids: list[list[int]] = []
        for word in found:
            if SIMPLE.fullmatch(word):
                ids.append([t.id for t in one(word if word.isascii() else word.encode().decode("latin-1").translate(self.signs))])
            else:  # whatever the pre-tokenizer may split or fold
                ids.append(self.tokenizer.encode(word, add_special_tokens=False).ids)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        n, k = len(self.slot), len(found)
        while n + k > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start * 0]), np.concatenate([self.size, self.size * 0])
        while self.kept + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.start[n : n + k] = self.kept + np.cumsum(sizes) - sizes
        self.size[n : n + k] = sizes
        self.flat[self.kept : self.kept + len(flat)] = flat
        self.kept += len(flat)
        self.slot.update(zip(hashes, range(n, n + k), strict=True))

    def texts(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, each text followed by ``end_id``, and the texts' offsets among them."""
        n = len(offsets) - 1
        lower, start, end, first = parts(data, offsets) if len(data) else (data, offsets[:0], offsets[:0], offsets)
        if len(start) == 0:
            return np.full(n, end_id, np.uint32), np.arange(n + 1)
        raw = lower.tobytes()
        if any(x in raw for x in self.special):
            return super().texts(data, offsets, end_id)
        distinct, at, back = np.unique(tx.run_hashes(lower, start, end), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.slot) + len(keys) > self.most and self.slot:
            self.forget()
        slots = [self.slot.get(h, -1) for h in keys]
        new = [i for i, s in enumerate(slots) if s < 0]
        if new:
            self.learn([keys[i] for i in new], [raw[a:z].decode() for a, z in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
            slots = [self.slot[h] for h in keys]
        slot = np.array(slots)[back]
        size = self.size[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[slot] - total[:-1], size) + np.arange(total[-1])]
        ends = total[first[1:]] + np.arange(n)
        out = np.empty(len(ids) + n, np.uint32)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = ids
        out[ends] = end_id
        return out, np.concatenate([[0], ends + 1])


_LOADED: dict[str, WordTokens | LibraryTokens] = {}


def loaded(vocabulary: str) -> WordTokens | LibraryTokens:
    """The tokens of a vocabulary file, read once a worker."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = (WordTokens if WordTokens.suits(vocabulary) else LibraryTokens)(vocabulary)
    return _LOADED[vocabulary]


def token_pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; only those longer than ``max_tokens`` are cut."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "ids_crc32")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(vocabulary)
        for batch in batches:
            data, offsets = tx.as_bytes(batch.column(1))
            for lo, hi in tx.spans(offsets):
                ids, at = tokens.texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end_id)
                length = np.diff(at)
                n = -(-length // max_tokens)
                row = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                begin = piece * max_tokens
                size = np.minimum(length[row] - begin, max_tokens)
                raw = memoryview(ids.astype("<u4").tobytes())
                place = (at[row] + begin) * 4
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(place.tolist(), (place + size * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), *[pa.array(x, pa.int64()) for x in (piece, begin, size, crc)]], schema.names)
            tx.release()

    return d.mapInArrow(run, schema)


def exact_combination(avail: np.ndarray, gap: int, most: int) -> tuple[int, ...] | None:
    """One to three available lengths of at most ``most`` that sum to ``gap``, the largest first; none: None."""
    top = min(most, gap)
    if gap <= most and avail[gap]:
        return (gap,)
    here = avail[: top + 1] > 0
    lengths = np.flatnonzero(here)
    first = lengths[2 * lengths >= gap][::-1]  # pairs: the longest first part
    first = first[first < gap]
    for x in first[here[gap - first]].tolist():
        if avail[gap - x] > (2 * x == gap):
            return (x, gap - x)
    for x in lengths[::-1].tolist():
        rest = gap - x
        if 3 * x < gap:
            break
        if rest < 2:
            continue
        second = lengths[(lengths <= min(x, rest - 1)) & (2 * lengths >= rest)]
        for y in second[here[rest - second]][::-1].tolist():
            three = (x, y, rest - y)
            if all(avail[z] >= three.count(z) for z in three):
                return three
    return None


def sums(avail: np.ndarray, gap: int) -> Iterator[int]:
    """Sums of one to three available lengths up to ``gap``, the largest first; may name sums that need a length once too often."""
    lengths = np.flatnonzero(avail[: gap + 1] > 0).tolist()
    one = two = three = 0  # bit s stands for the sum s
    for x in lengths:
        one |= 1 << x
    for x in lengths:
        two |= (one if avail[x] > 1 else one & ~(1 << x)) << x
    for x in lengths:
        three |= two << x
    reached = (one | two | three) & ((1 << (gap + 1)) - 1)
    while reached:
        yield (top := reached.bit_length() - 1)
        reached ^= 1 << top


def best_combination(avail: np.ndarray, gap: int, most: int) -> tuple[int, ...] | None:
    """The exact combination if there is one, else one to three available lengths with the largest sum below ``gap``."""
    if gap <= most and avail[gap]:
        return (gap,)
    return next((found for fill in sums(avail, gap) if (found := exact_combination(avail, fill, most)) is not None), None)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, from rank, to rank, first sequence, offset) that place every piece, from counts per length."""
    avail, used, rows, sequences = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64), [], 0
    for length in range(capacity, 0, -1):
        while avail[length]:
            pattern, gap = [length], capacity - length
            avail[length] -= 1
            while gap and (more := best_combination(avail, gap, length)) is not None:
                for x in more:
                    avail[x] -= 1
                pattern += more
                gap -= sum(more)
            for x in pattern:
                avail[x] += 1
            times, offset = int(min(avail[x] // pattern.count(x) for x in pattern)), 0
            for x in pattern:
                rows.append((x, int(used[x]), int(used[x]) + times, sequences, offset))
                avail[x] -= times
                used[x] += times
                offset += x
            sequences += times
    return rows


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0, rows_per_bucket: int = 1_000) -> DataFrame:
    """Pieces of all documents with the sequence each goes to and its place there, gapless from 0."""
    pieces = materialise(token_pieces(docs, vocabulary, id_col=id_col, text_col=text_col, max_tokens=max_tokens, end_id=end_id), "pieces")
    found = pieces.groupBy("length").count().collect()  # at most max_tokens rows
    counts = np.zeros(max_tokens + 1, np.int64)
    for length, n in found:
        counts[length] = n
    placed = plan(counts, max_tokens)
    spark = docs.sparkSession
    places = spark.createDataFrame(placed, "length long, from_rank long, to_rank long, sequence long, offset long")
    buckets = max(1, int(counts.sum()) // rows_per_bucket)
    spread = pieces.withColumn("u", unit_hash(F.col("doc_id"), F.col("piece"), F.col("ids_crc32"))).withColumn("bucket", F.floor(F.col("u") * buckets))
    base = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = base.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = spread.withColumn("k", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("u", "doc_id", "piece")) - 1)
    ranked = ranked.join(base.hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("k"))
    joined = ranked.join(F.broadcast(places), "length").filter("rank >= from_rank and rank < to_rank")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")
