"""Operator 4: near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of words; its k-mers are runs of two words, each labelled
with how often it stood before. For each of ``bands`` hash functions the
``picked`` smallest labelled k-mers are taken and kept in text order: texts agree
in a band only if they hold the same k-mers in the same order, so agreement
follows edit similarity. A candidate pair is verified by aligning its words
within a band as wide as the similarity allows: similarity is
1 - word edits / words of the longer text, 0.8 or more. Classes are the connected
components of the verified pairs.

Candidates: in every bucket a member chosen at random per band is the centre and
all others are compared with it (a star, never all pairs). Members of buckets that
hold another class than their centre's meet again, all of them, by the rarest of
their words: so many that two near texts share one of them. Pairs of different
classes that share it are compared, so that no link inside a bucket is left out.
Before texts are moved to be compared, bits of their words tell pairs that cannot
be near: those that meet by chance grow with the square of the rows.

Scale: sketches are made in one narrow pass over all rows (copies too: that costs
less than moving texts to drop them first), and from there on equal texts are
one. Buckets are counted with map-side combining, written, and joined with their
centres, which splits a hot bucket; nothing is gathered per bucket. Only texts of
candidates move, one row of each text.

Defined cases: null and blank texts are near-duplicates of nothing and a class
each; a text of one word is one k-mer; null ids are classes by their text alike;
repeated rows share a class; other columns are not read; an empty table gives
none. The class id is the smallest document id of the class. Ties: equal k-mers
are told apart by their label, equal hashes by their place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import forget, materialise, ship, small, unused
from .graph import components

#: Words of a k-mer.
GRAM = 2


def sketches(s: tx.Shingles, label: np.ndarray, bands: int, picked: int) -> np.ndarray:
    """Order MinHash of every text, [texts, bands]; texts without a k-mer get 0."""
    counts, n = s.counts, len(s.first) - 1
    have = np.flatnonzero(counts)
    out = np.zeros((n, bands), np.uint64)
    if len(have) == 0:
        return out
    heads, sizes = s.first[have], counts[have]
    row = np.repeat(np.arange(len(have)), sizes)
    for band in range(bands):
        value = tx.mix(label ^ tx.seed(100 + band))
        place = np.full((len(have), picked), -1, np.int64)
        for j in range(picked):
            least = np.minimum.reduceat(value, heads)
            at = np.flatnonzero((value == least[row]) & (value != tx.MAX))
            place[row[at], j] = at
            value[at] = tx.MAX
        place.sort(axis=1)
        total = np.full(len(have), tx.seed(band))
        for j in range(picked):
            total = tx.mix(total ^ np.where(place[:, j] >= 0, s.hash[place[:, j]], tx.U64(0)))
        out[have, band] = total
    return out


def sketch_table(rows: DataFrame, bands: int, picked: int) -> DataFrame:
    """(doc_id, node, n, sketch) of rows (doc_id, node, text): number of words and the Order MinHash per band."""
    ship(rows.sparkSession)
    schema = T.StructType([*rows.select("doc_id", "node").schema.fields, T.StructField("n", T.IntegerType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.as_bytes(batch.column(2))
            for lo, hi in tx.spans(offsets):
                w = tx.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                s = tx.shingles(w, GRAM)
                sk = sketches(s, tx.labelled(s), bands, picked).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sk.size + 1, bands), pa.int32()), pa.array(sk.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(w.counts, pa.int32()), lists], schema.names)
            tx.release()

    return rows.select("doc_id", "node", "text").mapInArrow(run, schema)


def word_edits(a: list[int], b: list[int], most: int) -> int:
    """Least number of inserted, deleted and replaced words between two lists, matching words within ``most`` places only.

    Exact up to ``most``. Columns of the alignment are bit vectors of vertical differences (Myers 1999, Hyyro 2003).
    """
    m = len(a)
    if not m or not b:
        return m + len(b)
    places: dict[int, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    every, last = (1 << m) - 1, 1 << (m - 1)
    band, narrow = (1 << (2 * most + 1)) - 1, m > most + 1
    up, down, edits = every, 0, m
    for j, word in enumerate(b):
        match = places.get(word, 0)
        if match and narrow:
            match &= band << (j - most) if j >= most else band >> (most - j)
        level = (((match & up) + up) ^ up) | match | down
        right_down, right_up = up & level, down | (every & ~(up | level))
        if right_up & last:
            edits += 1
        elif right_down & last:
            edits -= 1
        right_up, right_down = right_up << 1 | 1, right_down << 1
        down = right_up & level & every
        up = (right_down | ~(right_up | level)) & every
    return edits


def edit_similarity(left: pa.Array, right: pa.Array, least: float) -> np.ndarray:
    """1 - word edits / words of the longer text, of each pair of texts.

    Exact from ``least`` on. Pairs that share too few words to reach it are not aligned; theirs is a bound below it.
    """
    sides = []
    for col in (left, right):
        data, offsets = tx.as_bytes(col)
        sides.append(tx.words(data, offsets))
    a, b = sides
    longer = np.maximum(a.counts, b.counts)
    ka, kb = (tx.mix(np.where((occ := tx.occurrence(w.hash, w.doc)) == 0, w.hash, tx.mix(w.hash + occ.astype(np.uint64))) ^ tx.mix(w.doc.astype(np.uint64) + tx.U64(7))) for w in sides)
    shared = np.bincount(a.doc[np.isin(ka, kb)], minlength=len(longer))
    out = np.where(longer > 0, shared / np.maximum(longer, 1), 1.0)
    for p in np.flatnonzero(out >= least):
        x, y = a.hash[a.first[p] : a.first[p + 1]], b.hash[b.first[p] : b.first[p + 1]]
        n = min(len(x), len(y))
        differ = x[:n] != y[:n]
        head = int(differ.argmax()) if differ.any() else n
        x, y, n = x[head:], y[head:], n - head
        differ = x[len(x) - n :][::-1] != y[len(y) - n :][::-1]
        tail = int(differ.argmax()) if differ.any() else n
        most = int((1 - least) * longer[p] + 1e-9)
        out[p] = 1 - word_edits(x[: len(x) - tail].tolist(), y[: len(y) - tail].tolist(), most) / max(1, longer[p])
    return out


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) with their similarity and a column ``near``: their texts are similar enough."""
    ship(texts.sparkSession)
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    joined = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "left", "right")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tx.as_bytes(batch.column(2))
            for lo, hi in tx.spans(offsets):
                some = batch.slice(lo, hi - lo)
                sim = edit_similarity(some.column(2), some.column(3), least)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sim >= least), pa.array(sim)], ["a", "b", "near", "similarity"])
            tx.release()

    return joined.mapInArrow(run, "a long, b long, near boolean, similarity double")


def wide_marks(texts: DataFrame) -> DataFrame:
    """(node, n, bits) of texts (node, text): their number of words and marks as ``marks``, two bits a word or more."""
    ship(texts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.as_bytes(batch.column(1))
            for lo, hi in tx.spans(offsets):
                w = tx.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                s = tx.shingles(w, 1)
                value = tx.mix(tx.labelled(s) ^ tx.seed(400))
                bits = []
                for k, n in enumerate(w.counts.tolist()):
                    size = max(512, 1 << (2 * n - 1).bit_length())
                    place = (value[s.first[k] : s.first[k + 1]] % tx.U64(size)).astype(np.int64)
                    bits.append(np.packbits((np.bincount(place, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(w.counts, pa.int32()), pa.array(bits, pa.binary())], ["node", "n", "bits"])
            tx.release()

    return texts.select("node", "text").mapInArrow(run, "node long, n int, bits binary")


def fewest_apart(a: bytes, b: bytes) -> int:
    """So many words stand in one of two texts only, at least: bits in which their marks differ, the longer marks folded to the length of the shorter."""
    x, y = (np.frombuffer(m, np.uint8) for m in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def plausible(pairs: DataFrame, made: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that may be near by their marks (node, n, bits): only their texts move."""
    side = lambda s: made.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "bits")])
    joined = pairs.select("a", "b").join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_a", "n_b"))
            most = one + two - 2 * least * np.maximum(one, two) + 1e-9
            apart = np.array([fewest_apart(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)], np.int64)
            keep = pa.array(np.flatnonzero(apart <= most))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], ["a", "b"])

    return materialise(joined.mapInArrow(run, "a long, b long"), "plausible")


def candidate_texts(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text) of the texts named in ``wanted``: of each the row of its smallest id, so that copies stay where they are."""
    wanted = materialise(wanted.distinct().join(nodes.select("node", "least_id").hint("merge"), "node").select(F.col("node").alias("w_node"), F.col("least_id").alias("w_id")), "wanted")
    same = (F.col("node") == F.col("w_node")) & F.col("doc_id").eqNullSafe(F.col("w_id"))
    return materialise(rows.join(small(wanted, wanted.count()), same, "left_semi").select("node", "text").dropDuplicates(["node"]), "texts")


def with_root(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    """The class of the text in ``column`` so far: its root, or itself."""
    found = roots.select(F.col("node").alias(column), F.col("root").alias(name))
    return df.join(small(found, roots.count()), column, "left").withColumn(name, F.coalesce(name, column))


#: Slots in which words are counted, to take the rare ones first.
SLOTS = 1 << 18
#: Rare words before a meeting that are looked at to see whether the pair has met already.
LATEST = 8
#: Longs of a text's marks: its labelled words fall into 64 bits of each, a bit is set if an odd number falls there.
MARKS = 8
MARKED = [f"m{k}" for k in range(MARKS)]


def word_counts(texts: DataFrame) -> np.ndarray:
    """How many words of the texts (node, text) fall into each slot: a fixed number of sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            data, offsets = tx.as_bytes(batch.column(0))
            for lo, hi in tx.spans(offsets):
                s = tx.shingles(tx.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), 1)
                total += np.bincount((s.hash % tx.U64(SLOTS)).astype(np.int64), minlength=SLOTS)
            tx.release()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SLOTS, np.int64)
    for slot, n in found:
        out[slot] = n
    return out


def marks(s: tx.Shingles, label: np.ndarray) -> np.ndarray:
    """The marks of every text, [texts, MARKS]: as many bits of two texts differ as labelled words stand in one of them only, at most."""
    n, bits = len(s.first) - 1, 64 * MARKS
    place = s.doc * bits + (tx.mix(label ^ tx.seed(400)) % tx.U64(bits)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def rare_kmers(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(node, n, root, kmer, share, at, m0, m1, ...): as many of the rarest labelled words (k-mers of one word) of each member (node, n, root) that two texts near each other share ``share``, one.

    An edit takes one word at most from the longer text, so near texts share ``least`` of its words, and of lists in one
    order the heads that leave one less of these share the first word that both hold. ``at`` is a word's place in the
    whole list, m0 and so on are the text's marks. A word that no other text holds is left out.
    """
    ship(texts.sparkSession)
    rows = materialise(members.join(texts.hint("merge"), "node").select("node", "n", "root", "text"), "members")
    counts = word_counts(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.as_bytes(batch.column(3))
            for lo, hi in tx.spans(offsets):
                w = tx.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                s = tx.shingles(w, 1)
                label, seen = tx.labelled(s), counts[(s.hash % tx.U64(SLOTS)).astype(np.int64)]
                order = np.lexsort((label, seen, s.doc))
                head = w.counts - np.ceil(least * w.counts - 1e-9).astype(np.int64) + 1
                text = s.doc[order]
                place = np.arange(len(order)) - s.first[text]
                keep = (place < head[text]) & (seen[order] > 1)
                at = pa.array(lo + text[keep])
                share = pa.array(np.ones(len(at), np.int32))
                marked = marks(s, label)[text[keep]]
                columns = [*(batch.column(c).take(at) for c in range(3)), pa.array(label[order[keep]].view(np.int64)), share, pa.array(place[keep].astype(np.int32)), *(pa.array(marked[:, m]) for m in range(MARKS))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "root", "kmer", "share", "at", *MARKED])
            tx.release()

    return rows.mapInArrow(run, "node long, n int, root long, kmer long, share int, at int" + "".join(f", {m} long" for m in MARKED))


def pairs_of_classes(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of members (node, n, root) of different classes that may be near, none left out.

    A pair meets in the first rare word that both hold. In a later one it meets again only if the first is not among the
    ``LATEST`` before it, and if the words from there on would do for a near pair. Pairs whose marks differ in more bits
    than near texts have words of their own are none: most texts that meet by chance part here, before a text moves.
    """
    kmers = materialise(rare_kmers(members, texts, least), "kmers")
    mixed = kmers.groupBy("kmer").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("kmer")
    shared = materialise(kmers.join(mixed.hint("merge"), "kmer", "left_semi"), "shared")
    forget(kmers)
    before = F.collect_list("kmer").over(Window.partitionBy("node").orderBy("at").rowsBetween(-LATEST, -1))
    line = materialise(shared.withColumn("before", before), "line")
    forget(shared)
    side = lambda s: line.select("kmer", F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "root", "at", "before", *MARKED)])
    one, two = side("a").alias("one"), side("b").alias("two")
    left = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    may = (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & (left >= least * F.greatest("a_n", "b_n") - 1e-9)
    # near texts have ``least`` of the longer one's words in common
    apart = reduce(add, [F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in MARKED])
    may = may & (apart <= F.col("a_n") + F.col("b_n") - 2 * least * F.greatest("a_n", "b_n") + 1e-9)
    met = one.join(two.hint("merge"), (F.col("one.kmer") == F.col("two.kmer")) & may & ~F.arrays_overlap("a_before", "b_before"))
    pairs = materialise(met.select("a", "b").distinct(), "pairs")
    forget(line)
    return pairs


def near_roots(nodes: DataFrame, rows: DataFrame, *, least: float = 0.8) -> DataFrame:
    """(node, root) of every text that is near another: ``nodes`` (node, n, sketch, least_id), their texts in ``rows`` (doc_id, node, text)."""
    place = F.posexplode("sketch").alias("band", "value")
    opened = nodes.filter("n > 0").select("node", "n", place).select("band", F.xxhash64("band", "value").alias("bucket"), "node", "n")
    rank = F.struct(F.xxhash64("node", "band").alias("h"), F.col("node"), F.col("n"))
    centre = opened.groupBy("bucket").agg(F.min(rank).alias("c"), F.count("*").alias("size")).filter("size > 1")
    centre = materialise(centre.select("bucket", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")), "centres")
    n = centre.count()
    if n == 0:
        return rows.sparkSession.createDataFrame([], "node long, root long")
    stars = materialise(opened.join(small(centre, n), "bucket").filter("node <> centre"), "stars")
    texts = candidate_texts(stars.select("node").unionByName(centre.select(F.col("centre").alias("node"))), nodes, rows)
    possible = F.least("n", "centre_n") >= least * F.greatest("n", "centre_n")
    pairs = materialise(stars.filter(possible).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "pairs")
    marked = materialise(wide_marks(texts), "marks")
    pairs = plausible(pairs, marked, least)
    new = materialise(verified(pairs, texts, least), "verified")
    roots = materialise(components(new.filter("near").select("a", "b")), "roots")
    judged = with_root(with_root(stars, roots, "node", "own"), roots, "centre", "other")
    judged = materialise(judged.select("bucket", "node", "n", "own", "other"), "judged")
    forget(stars, pairs, centre)
    # a bucket of the centre's class and one more text is done: the two have met
    split = materialise(judged.groupBy("bucket").agg(F.bool_or(F.col("own") != F.col("other")).alias("some"), F.count("*").alias("size")).filter("some and size > 1").select("bucket"), "split")
    n = split.count()
    again = judged.join(small(split, n), "bucket", "left_semi").select("node", "n", F.col("own").alias("root")).distinct()
    again = materialise(again, "again")
    later = None
    if n:
        pairs = pairs_of_classes(again, texts, least)
        untried = materialise(pairs.join(new.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "untried")
        untried = plausible(untried, marked, least)
        later = materialise(verified(untried, texts, least), "verified").filter("near").select("a", "b")
        forget(pairs, untried)
    forget(texts, marked, judged, split, again)
    if later is None or later.isEmpty():
        return roots
    return materialise(components(later.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = 24, picked: int = 3, least: float = 0.8) -> DataFrame:
    """(doc_id, node, root, class_id, class_size) of every row; rows of one class are copies or near copies of each other.

    ``node`` is the hash of the text, ``root`` names the class. ``class_id`` is the smallest id of the class (null if
    it has none); a blank or null text is a class by itself, of its own id, and has no root.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("node"))
    sketched = materialise(sketch_table(rows, bands, picked), "sketches")
    nodes = sketched.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    nodes = materialise(nodes, "nodes")
    roots = near_roots(nodes, rows, least=least)
    named = nodes.select("node", "least_id", "copies").join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least_id", "copies")
    named = materialise(named, "named")
    classes = materialise(named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size")), "classes")
    member = materialise(named.select("node", "root").join(classes.hint("merge"), "root"), "member")
    full = sketched.filter("n > 0").select("doc_id", "node").join(member.hint("merge"), "node").select("doc_id", "node", "root", "class_id", "class_size")
    alone = sketched.filter("n = 0").select("doc_id", "node", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return full.unionByName(alone)


def text_key(text: Column) -> Column:
    """Two hashes of a text as one long."""
    return F.xxhash64(text, F.crc32(text.cast("binary")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """Rows of ``docs`` that stay when one document of each class stays (the smallest id; blank texts all stay)."""
    classes = near_duplicate_classes(docs, id_col=id_col, text_col=text_col, **options)
    many = materialise(classes.filter("class_size > 1").select("root", "doc_id", "node"), "copies")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    kept = materialise(many.groupBy("root").agg(F.min(rank).alias("r")).select("root", F.col("r.doc_id").alias("k_id"), F.col("r.node").alias("k_node")), "kept")
    fate = many.join(kept.hint("merge"), "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("node") == F.col("k_node")))
    key, gone, copy = unused(docs, "__key", "__id", "__node")
    fate = fate.groupBy("doc_id", "node").agg(F.max("stays").alias("stays"), F.count("*").alias("rows"))
    fate = materialise(fate.select(F.col("doc_id").alias(gone), F.col("node").alias(copy), "stays", "rows"), "fate")
    lost = fate.filter("not stays").select(gone, copy)
    again = materialise(fate.filter("stays and rows > 1").select(gone, copy), "again")
    rows = docs.withColumn(key, text_key(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(gone)) & (F.col(key) == F.col(copy))
    stay = rows.join(lost.hint("merge"), same, "left_anti")
    if again.isEmpty():
        return stay.select(*docs.columns)
    first = stay.join(again.hint("merge"), same, "left_semi").dropDuplicates([id_col, key])
    return stay.join(again.hint("merge"), same, "left_anti").unionByName(first).select(*docs.columns)
