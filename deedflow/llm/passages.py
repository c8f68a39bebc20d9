"""Operator 8: repeated passages by compact windows.

Tokens are five-word shingles. Under one hash function the subsequences of a text
that share a minimum form a compact window: the shingle holding the minimum and
how far it stays the minimum to the left and right (a node of the text's
Cartesian tree). Only windows as wide as the shortest passage count, about
2 / (width + 1) of the positions. Windows of different texts with the same
minimum are joined, their common interval is kept, and a pair of texts whose
intervals agree under enough hash functions is verified: matching shingles are
chained to segments of at least ``least_words`` words and similarity 0.8 or more.

Within a group of equal minima every window of a text is joined with the group's
first text only (a star), by the widest extents of that text's windows. Windows
that the first text does not explain are the rest, however many: each gives the
hashes of all runs of ``least_words`` words around its minimum, and texts that
share a run are joined with the first text that has it. Such a text always
explains them. At last the same is done with every run, of any text, that the spans
found so far do not hold whole: an earlier text that has it may be explained by a
third one, and a passage may go on where that one's ends. So no verbatim passage is
lost and nothing is tried in turns. Before runs are hashed, every run is stood for
by half of it, chosen by its content alone, so that neighbouring runs have one half
in common: only runs whose half another text has as well are hashed and compared.

Scale: distinct texts are written once, in buckets of their key, and move no more
except to a first text. The windows are made twice in narrow passes rather than
kept. Groups are counted with map-side combining, written, and joined with their
first text, which splits a passage that very many documents share.

Defined cases: the first occurrence, by document id (null ids last), is kept. A
copy of a whole text is a repeat from its first to its last word if it has
``least_words`` words; rows with the id and text of the first count as the first.
Null, empty and shorter texts have no repeats. Repeats within one text are left
alone. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import bucketed, forget, materialise, ship, small, unused, word_count
from .near_duplicates import text_key

#: Words of a shingle.
SHINGLE = 5
CLIP = 65_535
#: Number that an anchor carries in place of a hash function's where a whole run was found.
RUN = 15


def compact_windows(value: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, left, right) of every value that is the minimum of ``width`` values around it in its own text.

    ``first`` marks where texts begin (n + 1 entries). Of equal values the leftmost is the minimum. Extents are
    cut at 65 535, which keeps a window wide enough.
    """
    n, texts = len(value), len(first) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    text = np.repeat(np.arange(texts), np.diff(first))
    v = np.zeros(n + texts + 1, np.uint64)  # zeros between texts end every window
    v[np.arange(n) + text + 1] = np.maximum(value, tx.U64(1))
    levels = [v]
    longest = min(int(np.diff(first).max()), CLIP)
    while (1 << len(levels)) <= longest:
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    half = (width + 1) // 2
    j = min(half.bit_length() - 1, len(levels) - 1)
    if longest < half:  # no text is as long as half a window
        z = np.zeros(0, np.int64)
        return z, z, z
    low = np.minimum(levels[j][: len(v) - half + 1], levels[j][half - (1 << j) : len(v) - (1 << j) + 1])
    good = np.zeros(len(v), bool)
    good[: len(low)] |= v[: len(low)] == low
    good[half - 1 :] |= v[half - 1 :] == low
    at = np.flatnonzero(good & (v > 0))
    own = v[at]
    right, left = at + 1, at.copy()
    for j in range(len(levels) - 1, -1, -1):
        table, step = levels[j], 1 << j
        here = np.minimum(right, len(table) - 1)
        right = np.where((right < len(table)) & (table[here] >= own), right + step, right)
        there = np.maximum(left - step, 0)
        left = np.where((left >= step) & (table[np.minimum(there, len(table) - 1)] > own), left - step, left)
    left, right = at - left, right - 1 - at
    wide = left + right + 1 >= width
    at, left, right = at[wide], left[wide], right[wide]
    place = at - np.searchsorted(np.flatnonzero(v == 0), at)
    return place, np.minimum(left, CLIP), np.minimum(right, CLIP)


def windows(rows: DataFrame, hashes: int, width: int) -> DataFrame:
    """(minimum, node, doc_id, place) of the compact windows of rows (doc_id, node, text); place packs position and extents, minimum ends in the hash's number."""
    ship(rows.sparkSession)
    schema = T.StructType([T.StructField("minimum", T.LongType()), *rows.select("node", "doc_id").schema.fields, T.StructField("place", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.as_bytes(batch.column(2))
            node = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in tx.spans(offsets):
                s = tx.shingles(tx.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), SHINGLE)
                text = s.doc
                for m in range(hashes):
                    value = tx.mix(s.hash ^ tx.seed(200 + m))
                    at, left, right = compact_windows(value, s.first, width)
                    key = (value[at] & ~tx.U64(15)) | tx.U64(m)
                    place = (at - s.first[text[at]]) << 32 | left << 16 | right
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[lo + text[at]]), batch.column(1).take(pa.array(lo + text[at])), pa.array(place)], schema.names)
            del data, batch
            tx.release()

    return rows.select("node", "doc_id", "text").mapInArrow(run, schema)


def run_starts(places: np.ndarray, n: int, width: int) -> np.ndarray:
    """Starts of all runs of ``width`` of ``n`` shingles that hold one of the places."""
    starts = np.unique(places[:, None] - np.arange(width)[None, :])
    return starts[(starts >= 0) & (starts + width <= n)]


def prefix_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upto, back): the hash of shingles [a, b) is ``(upto[b] - upto[a]) * back[a]``, mixed."""
    base = tx.U64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse among 64-bit numbers
    n = len(hashes)
    power, back = (np.full(n + 1, x) for x in (base, tx.U64(pow(int(base), -1, 1 << 64))))
    for x in (power, back):
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:n], dtype=np.uint64)]), back


def halves(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, begin) of the half that stands for each run of ``width`` shingles from ``at``.

    The half reaches from the run's least shingle (under a hash of its own, the first of equal ones) to the side that
    has room for ``width // 2`` shingles more, which one always has: equal runs have equal halves.
    """
    half = width // 2
    value = tx.mix(hashes ^ tx.seed(300))
    least, step = np.arange(len(value)), 1
    while 2 * step <= width:
        one, two = least[:-step], least[step:]
        least = np.where(value[two] < value[one], two, one)
        step *= 2
    one, two = least[at], least[at + width - step]
    place = np.where(value[two] < value[one], two, one)
    begin = np.where(place - at >= half, place - half, place)
    upto, back = prefix_sums(hashes)
    return tx.mix((upto[begin + half + 1] - upto[begin]) * back[begin]), begin


def half_runs(joined: DataFrame, width: int) -> DataFrame:
    """(half, node, lo, hi) of all runs of ``width`` shingles around the open positions of (node, positions, text): those from lo to hi have the half in common."""
    ship(joined.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.as_bytes(batch.column(2))
            for lo, hi in tx.spans(offsets):
                s = tx.shingles(tx.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), SHINGLE)
                starts = [run_starts(batch.column(1).slice(k, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64), int(s.counts[k - lo]), width) for k in range(lo, hi)]
                row = np.repeat(np.arange(hi - lo), [len(x) for x in starts])
                if not len(row):
                    continue
                own = np.concatenate(starts)
                key, begin = halves(s.hash, s.first[row] + own, width)
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (own[1:] != own[:-1] + 1) | (begin[1:] != begin[:-1])])
                head = np.flatnonzero(new)
                last = np.append(head[1:], len(row)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), batch.column(0).take(pa.array(lo + row[head])), pa.array(own[head]), pa.array(own[last])], ["half", "node", "lo", "hi"])
            tx.release()

    return joined.select("node", "positions", "text").mapInArrow(run, "half long, node long, lo long, hi long")


def open_halves(rows: DataFrame, width: int) -> DataFrame:
    """(half, node, lo, hi, open) of all runs of ``width`` shingles of rows (node, covered, text): those from lo to hi have the half in common.

    ``covered`` are spans of words; runs are open unless the spans together hold them whole.
    """
    ship(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.as_bytes(batch.column(2))
            for lo, hi in tx.spans(offsets):
                w = tx.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                s = tx.shingles(w, SHINGLE)
                many = np.maximum(s.counts - width + 1, 0)
                row = np.repeat(np.arange(hi - lo), many)
                if not len(row):
                    continue
                own = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                key, begin = halves(s.hash, s.first[row] + own, width)
                held = np.zeros(len(w.start) + 1, np.int64)
                for k, spans in enumerate(batch.column(1).slice(lo, hi - lo).to_pylist()):
                    for x in spans or ():
                        held[1 + w.first[k] + x["start"] : 1 + w.first[k] + x["end"]] = 1
                held = np.cumsum(held)
                one = w.first[row] + own
                end = np.minimum(one + width + SHINGLE - 1, w.first[row + 1])
                open_ = held[end] - held[one] < end - one
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (begin[1:] != begin[:-1]) | (open_[1:] != open_[:-1])])
                head = np.flatnonzero(new)
                last = np.append(head[1:], len(row)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), batch.column(0).take(pa.array(lo + row[head])), pa.array(own[head], pa.int32()), pa.array(own[last], pa.int32()), pa.array(open_[head])], ["half", "node", "lo", "hi", "open"])
            del data, batch
            tx.release()

    return rows.select("node", "covered", "text").mapInArrow(run, "half long, node long, lo int, hi int, open boolean")


def runs(joined: DataFrame, width: int) -> DataFrame:
    """(run, node, rank, at, open) of the runs of ``width`` shingles of (node, rank, starts, text), from lo to hi each, or around the positions of (node, rank, positions, text), all open; at is where the run begins."""
    ship(joined.sparkSession)
    given = "starts" in joined.columns
    schema = T.StructType([T.StructField("run", T.LongType()), *joined.select("node", "rank").schema.fields, T.StructField("at", T.LongType()), T.StructField("open", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.as_bytes(batch.column(3))
            for lo, hi in tx.spans(offsets):
                s = tx.shingles(tx.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), SHINGLE)
                upto, back = prefix_sums(s.hash)
                for k in range(lo, hi):
                    first = int(s.first[k - lo])
                    where = batch.column(2)[k].as_py()
                    if given:  # a run has one half, so that no two stretches of a text overlap
                        starts = np.concatenate([np.arange(x["lo"], x["hi"] + 1, dtype=np.int64) for x in where])
                        open_ = np.concatenate([np.full(x["hi"] + 1 - x["lo"], x["open"]) for x in where])
                    else:
                        starts = run_starts(np.array(where, np.int64), int(s.counts[k - lo]), width)
                        open_ = np.ones(len(starts), bool)
                    at = first + starts
                    key = tx.mix((upto[at + width] - upto[at]) * back[at])
                    same = pa.array(np.full(len(starts), k))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(same), batch.column(1).take(same), pa.array(starts), pa.array(open_)], schema.names)
            tx.release()

    return joined.select("node", "rank", "starts" if given else "positions", "text").mapInArrow(run, schema)


def turning_points(ka: np.ndarray, kb: np.ndarray, beside_a: np.ndarray, beside_b: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with equal keys, j among ``wanted``, whose neighbours (``beside``) differ: where runs of equal keys begin or end."""
    names, rank = np.unique(np.concatenate([beside_a, beside_b]), return_inverse=True)
    values, group = np.unique(ka, return_inverse=True)
    size = len(names)
    place = group * size + rank[: len(ka)]
    order = np.argsort(place, kind="stable")
    place = place[order]
    j = wanted
    mine = np.searchsorted(values, kb[j])
    own = mine * size + rank[len(ka) + j]
    first, last = np.searchsorted(place, mine * size), np.searchsorted(place, (mine + 1) * size)
    skip, on = np.searchsorted(place, own), np.searchsorted(place, own, side="right")  # equal keys with equal neighbours
    before = skip - first
    n = before + last - on
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at += np.repeat(first, n) + np.where(at >= np.repeat(before, n), np.repeat(on - skip, n), 0)
    return order[at], np.repeat(j, n)


def matching_runs(a: tx.Shingles, b: tx.Shingles, enough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, i, j, length) of every longest run of equal shingles, text p of ``a`` against text p of ``b``, by pair and j.

    All occurrences of a shingle meet. Only where runs begin and end is looked up, so that texts which repeat
    themselves take time by their runs, not by their matches. Pairs with less than ``enough`` shingles of ``b`` in
    ``a`` have no runs.
    """
    doc = b.doc
    ka, kb = (tx.mix(s.hash ^ tx.mix(s.doc.astype(np.uint64) + tx.U64(7))) for s in (a, b))
    order = np.argsort(ka)
    run = ka[order]
    heads = np.flatnonzero(np.concatenate([[len(ka) > 0], run[1:] != run[:-1]]))
    value, size = run[heads], np.diff(np.append(heads, len(run)))
    if not len(value) or not len(kb):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    group = np.minimum(np.searchsorted(value, kb), len(value) - 1)
    lo, many = heads[group], np.where(value[group] == kb, size[group], 0)
    many[np.bincount(doc[many > 0], minlength=len(b.first) - 1)[doc] < enough] = 0
    wanted = np.flatnonzero(many)
    if not len(wanted):
        z = np.zeros(0, np.int64)
        return z, z, z, z

    def beside(key: np.ndarray, first: np.ndarray, step: int, mark: int) -> np.ndarray:
        out = np.full(len(key), tx.U64(mark))
        if step < 0:
            out[1:] = key[:-1]
            out[first[:-1][np.diff(first) > 0]] = mark
        else:
            out[:-1] = key[1:]
            out[first[1:][np.diff(first) > 0] - 1] = mark
        return out

    sides = [(beside(ka, a.first, step, 0), beside(kb, b.first, step, 1)) for step in (-1, 1)]
    if many.sum() <= 4 * len(kb):  # few matches are faster looked at one by one
        n = many[wanted]
        j = np.repeat(wanted, n)
        i = order[np.repeat(lo[wanted] - np.cumsum(n) + n, n) + np.arange(len(j))]
        (i, j), (i_end, last) = ((i[turn], j[turn]) for turn in (x[i] != y[j] for x, y in sides))
    else:
        (i, j), (i_end, last) = (turning_points(ka, kb, x, y, wanted) for x, y in sides)
    diagonal, last_diagonal = i - j, i_end - last
    by, to = np.lexsort((j, diagonal)), np.lexsort((last, last_diagonal))
    diagonal, j, length = diagonal[by], j[by], last[to] - j[by] + 1
    i, pair = diagonal + j, doc[j]
    i, j = i - a.first[pair], j - b.first[pair]
    by = np.lexsort((i, j, pair))
    return pair[by], i[by], j[by], length[by]


def segments(i: list[int], j: list[int], n: list[int], least: int, similarity: float, gap: int = 2 * SHINGLE) -> list[tuple[int, int, int, int, float]]:
    """Segments (from i, to i, from j, to j, similarity) of runs of equal shingles in order of j; ends are exclusive, in shingles.

    Every run is chained to the run before it that both texts have within ``gap`` shingles and whose chain holds most
    matches, so that stray matches elsewhere cut nothing. The longest similar part of a chain is a segment, then that
    of what is left on both sides. Of the places of the first text that give a segment the first is taken.
    """
    score, before, over = list(n), [-1] * len(n), [0] * len(n)
    wide = 2 * gap + 1
    ends: dict[tuple[int, int], list[int]] = {}  # runs by the cell that their end lies in
    for r in range(len(n)):
        x, y, size = i[r], j[r], n[r]
        for cx in range((x - gap) // wide, (x + gap) // wide + 1):
            for cy in range((y - gap) // wide, (y + gap) // wide + 1):
                for q in ends.get((cx, cy), ()):
                    ahead, later = x - i[q] - n[q], y - j[q] - n[q]
                    if ahead < -gap or ahead > gap or later < -gap or later > gap or i[q] >= x or j[q] >= y:
                        continue
                    common = max(0, -ahead, -later)
                    if common < size and common < n[q] and score[q] - common + size > score[r]:
                        score[r], before[r], over[r] = score[q] - common + size, q, common
        ends.setdefault(((x + size) // wide, (y + size) // wide), []).append(r)
    found: list[tuple[int, int, int, int, int, float]] = []

    def part(path: list[int]) -> None:
        open_ = [path]
        while open_:
            path = open_.pop()
            if not path or j[path[-1]] + n[path[-1]] - j[path[0]] < least:
                continue
            if len(path) == 1:
                r = path[0]
                found.append((n[r], i[r], i[r] + n[r], j[r], j[r] + n[r], 1.0))
                continue
            i0, j0, size, common = (np.array([x[r] for r in path]) for x in (i, j, n, over))
            upto = np.cumsum(size - common)
            # a part from run a to run z is similar if gain[z] >= due[a]; for every a the last such z holds most matches
            gain = (1 + similarity) * upto - similarity * (i0 + j0 + 2 * size) + 1e-9
            due = (1 + similarity) * (upto - size) - similarity * (i0 + j0)
            latest = np.maximum.accumulate(gain[::-1])
            z = len(path) - 1 - np.searchsorted(latest, due)
            matched = upto[z] - upto + size
            matched[j0[z] + size[z] - j0 < least] = 0
            a = int(matched.argmax())
            if matched[a]:
                found_, z = int(matched[a]), int(z[a])
                ni, nj = i[path[z]] + n[path[z]] - i[path[a]], j[path[z]] + n[path[z]] - j[path[a]]
                found.append((found_, i[path[a]], i[path[a]] + ni, j[path[a]], j[path[a]] + nj, found_ / (ni + nj - found_)))
                open_ += [path[:a], path[z + 1 :]]

    used = [False] * len(n)
    for r in sorted((r for r in range(len(n)) if score[r] >= least * similarity), key=lambda r: (-score[r], i[r])):
        path = []
        while r >= 0 and not used[r]:
            used[r] = True
            path.append(r)
            r = before[r]
        if path:
            part(path[::-1])
    out: list[tuple[int, int, int, int, float]] = []
    starts: list[int] = []  # places in j of the segments taken, none within another: ends rise with starts
    stops: list[int] = []
    for _, *one in sorted(found, key=lambda x: (-x[0], x[1])):
        lo, hi = one[2], one[3]
        at = bisect_right(starts, lo)
        if at and stops[at - 1] >= hi:
            continue
        out.append(tuple(one))
        first = bisect_left(starts, lo)
        last = bisect_right(stops, hi)
        starts[first : max(first, last)] = [lo]
        stops[first : max(first, last)] = [hi]
    return sorted(out, key=lambda x: x[2:4])


def matched_segments(left: pa.Array, right: pa.Array, least: int, similarity: float) -> Iterator[tuple[int, tuple[int, int, int, int, float]]]:
    """(pair, segment) of every pair of texts."""
    made = []
    for col in (left, right):
        data, offsets = tx.as_bytes(col)
        made.append(tx.shingles(tx.words(data, offsets), SHINGLE))
    pair, i, j, n = matching_runs(*made, least * similarity / 2)
    bounds = np.searchsorted(pair, np.arange(len(right) + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        lo, hi = bounds[p], bounds[p + 1]
        for found in segments(i[lo:hi].tolist(), j[lo:hi].tolist(), n[lo:hi].tolist(), least, similarity):
            yield int(p), found


def verified_spans(pairs: DataFrame, texts: DataFrame, width: int, agree: int, similarity: float) -> DataFrame:
    """Spans of words (node, start, end) that repeat words of ``first_node`` from ``first_start``, of pairs (first_node, node, anchors).

    An anchor is the position of a shared minimum in ``node``, times 16, plus its hash's number; a span needs
    anchors of ``agree`` different hash functions.
    """
    ship(pairs.sparkSession)
    # first texts are written for themselves: both sides of their join are then shuffled, so that a popular one is split
    wanted = materialise(pairs.select(F.col("first_node").alias("node")).distinct(), "wanted")
    one = materialise(texts.select("node", "text").join(wanted.hint("merge"), "node", "left_semi").select(F.col("node").alias("first_node"), F.col("text").alias("left")), "firsts")
    two = texts.select("node", F.col("text").alias("right"))
    joined = pairs.join(two.hint("merge"), "node").join(one.hint("merge"), "first_node").select("first_node", "node", "anchors", "left", "right")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["first_node", "node", "start", "end", "first_start", "first_end", "similarity"]
        for batch in batches:
            (_, one), (_, two) = (tx.as_bytes(batch.column(c)) for c in (3, 4))
            for lo, hi in tx.spans(one + two):  # a first text may be far longer than those that repeat it
                some = batch.slice(lo, hi - lo)
                rows = []
                for p, made in groupby(matched_segments(some.column(3), some.column(4), width, similarity), key=lambda x: x[0]):
                    segments_ = sorted((x[1] for x in made), key=lambda x: (x[2] - x[3], x))
                    anchors = np.sort(some.column(2).slice(p, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                    edges = np.searchsorted(anchors, np.array([(x[2] << 4, x[3] << 4) for x in segments_]))
                    covered = np.zeros(max(x[3] for x in segments_), bool)
                    nodes = some.column(0)[p].as_py(), some.column(1)[p].as_py()
                    # the longest first: what longer spans of the pair cover is no row of its own
                    for (i0, i1, j0, j1, sim), (first, last) in zip(segments_, edges.tolist(), strict=True):
                        if last > first and not covered[j0:j1].all() and len(np.unique(anchors[first:last] & 15)) >= agree:
                            covered[j0:j1] = True
                            rows.append((*nodes, j0, j1 + SHINGLE - 1, i0, i1 + SHINGLE - 1, sim))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = [pa.int64()] * 6 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                tx.release()
            del batch

    spans = materialise(joined.mapInArrow(run, "first_node long, node long, start long, end long, first_start long, first_end long, similarity double"), "spans")
    forget(wanted, one)
    return spans


def repeated_spans(texts: DataFrame, *, hashes: int = 4, agree: int = 2, least_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """Verified spans of distinct ``texts`` (doc_id, node, text), which are in buckets of node and in the order of doc_id."""
    width = least_words - SHINGLE + 1
    at, left, right = lambda p: F.shiftright(p, 32), lambda p: F.shiftright(p, 16) % 65536, lambda p: p % 65536
    made = windows(texts, hashes, width)
    shared = made.groupBy("minimum").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("minimum")
    shared = materialise(shared, "shared")
    held = materialise(made.join(shared.hint("merge"), "minimum", "left_semi"), "windows")
    rank = F.struct(F.min("doc_id").isNull().alias("unknown"), F.min("doc_id").alias("least_id"), F.col("node"))
    members = materialise(held.groupBy("minimum", "node").agg(F.collect_set("place").alias("places"), rank.alias("rank")), "members")
    forget(shared, held)
    widest = [F.array_max(F.transform("places", extent)).alias(name) for extent, name in ((left, "first_left"), (right, "first_right"))]
    first = members.groupBy("minimum").agg(F.min(F.struct("rank", *widest)).alias("f"))
    first = materialise(first.select("minimum", F.col("f.rank.node").alias("first_node"), "f.first_left", "f.first_right"), "first")
    wide = F.filter("places", lambda p: F.least(left(p), F.col("first_left")) + F.least(right(p), F.col("first_right")) + 1 >= width)
    stars = members.join(first.hint("merge"), "minimum").filter("node <> first_node").withColumn("wide", wide)
    stars = materialise(stars.select("minimum", "node", "places", "wide", "rank", "first_node"), "stars")
    forget(members, first)
    anchors = F.transform("wide", lambda p: at(p) * 16 + F.col("minimum").bitwiseAND(15))
    pairs = stars.filter(F.size("wide") > 0).groupBy("first_node", "node").agg(F.flatten(F.collect_list(anchors)).alias("anchors"), F.countDistinct(F.col("minimum").bitwiseAND(15)).alias("agreeing"))
    pairs = materialise(pairs.filter(F.col("agreeing") >= agree).select("first_node", "node", "anchors"), "pairs")
    spans = verified_spans(pairs, texts, width, agree, similarity)
    # the rest: windows that no span of their pair explains
    explained = materialise(spans.groupBy("first_node", "node").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "explained")
    within = lambda p: F.exists("spans", lambda s: (at(p) >= s["start"]) & (at(p) < s["end"]))
    # outer, since Spark would look for empty arrays by filtering twice
    unexplained = F.explode_outer(F.filter("places", lambda p: ~F.coalesce(within(p), F.lit(False)))).alias("place")
    rest = stars.join(explained.hint("merge"), ["first_node", "node"], "left").select("minimum", "node", "rank", unexplained).filter("place is not null")
    # a text's window is open only if another text's is, which the first one's never are
    rest = materialise(rest.select("minimum", "node", "rank", at(F.col("place")).alias("position")), "rest")
    forget(stars, explained, pairs)
    several = materialise(rest.groupBy("minimum").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("minimum"), "several")
    opened = rest.join(several.hint("merge"), "minimum", "left_semi").groupBy("node", "rank").agg(F.collect_set("position").alias("positions"))
    opened = materialise(opened, "opened")
    forget(rest, several)
    # of two texts that share a run both have its half
    made = materialise(half_runs(opened.join(texts.hint("merge"), "node"), width), "halves")
    common = made.groupBy("half").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("half")
    common = materialise(common, "common_halves")
    starts = made.join(small(common, common.count()), "half", "left_semi").groupBy("node").agg(F.collect_list(F.struct("lo", "hi", F.lit(True).alias("open"))).alias("starts"))
    starts = materialise(starts.join(opened.select("node", "rank").hint("merge"), "node"), "starts")
    forget(opened, made, common)
    spans = materialise(spans.unionByName(verified_spans(run_pairs(starts, texts, width), texts, width, 1, similarity)), "spans")
    return spans.unionByName(verified_spans(run_pairs(open_starts(texts, spans, width), texts, width), texts, width, 1, similarity))


def open_starts(texts: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """(node, rank, starts) of the runs of ``texts`` that may repeat an earlier text's and that the spans do not hold whole, and of the runs that they may repeat, held or not."""
    covered = materialise(spans.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("covered")), "covered")
    made = materialise(open_halves(texts.join(covered.hint("merge"), "node", "left"), width), "halves")
    forget(covered)
    common = made.groupBy("half").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.max("open").alias("some")).filter("a <> z and some").select("half")
    common = materialise(common, "common_halves")
    ranked = texts.select("node", F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("least_id"), F.col("node")).alias("rank"))
    held = materialise(made.join(small(common, common.count()), "half", "left_semi").join(ranked.hint("merge"), "node"), "held")
    forget(made, common)
    # the first text that has a run keeps it: the others' are looked for
    useful = held.groupBy("half").agg(F.min("rank").alias("first"), F.max(F.when(F.col("open"), F.col("rank"))).alias("last")).filter("last > first").select("half")
    useful = materialise(useful, "useful")
    starts = held.join(small(useful, useful.count()), "half", "left_semi").groupBy("node").agg(F.min("rank").alias("rank"), F.collect_list(F.struct("lo", "hi", "open")).alias("starts"))
    starts = materialise(starts, "starts")
    forget(held, useful)
    return starts


def run_pairs(starts: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(first_node, node, anchors): texts with open runs of (node, rank, starts), each with the first text that has the run."""
    # like the windows, runs are made twice: few of them stand in two texts
    made = runs(starts.join(texts.hint("merge"), "node"), width)
    common = made.groupBy("run").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("run")
    common = materialise(common, "common")
    found = materialise(made.join(small(common, common.count()), "run", "left_semi"), "runs")
    forget(starts, common)
    leader = materialise(found.groupBy("run").agg(F.min("rank").alias("f")).select("run", F.col("f.node").alias("first_node")), "leaders")
    more = found.filter("open").join(leader.hint("merge"), "run").filter("node <> first_node").groupBy("first_node", "node").agg(F.collect_list(F.col("at") * 16 + RUN).alias("anchors"))
    more = materialise(more, "more")
    forget(found, leader)
    return more


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hashes: int = 4, agree: int = 2, least_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """(doc_id, node, start, end, first_doc_id, first_start, first_end, similarity, kept): a row per repeated passage and document.

    Words [start, end) of the document repeat those of ``first_doc_id``, the first document that has them. Rows
    with ``kept`` true are the first occurrences themselves.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("node"))
    rows = rows.filter(F.length("text") >= 2 * least_words - 1)  # words and what parts them
    texts = bucketed(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text")), "texts", "node")
    nodes = materialise(texts.select("node", F.col("doc_id").alias("least_id")), "nodes")
    copies = materialise(rows.select("doc_id", "node").distinct().join(nodes.hint("merge"), "node").filter(~F.col("doc_id").eqNullSafe(F.col("least_id"))), "copied")
    copied = copies.select("node").distinct()
    copied = materialise(texts.join(copied.hint("merge"), "node", "left_semi").select("node", word_count(F.col("text")).alias("n_words")), "copied_words")
    spans = repeated_spans(texts, hashes=hashes, agree=agree, least_words=least_words, similarity=similarity)
    names = nodes.select(F.col("node").alias("first_node"), F.col("least_id").alias("first_doc_id"))
    spans = materialise(spans.distinct().join(names.hint("merge"), "first_node"), "spans")
    forget(texts)
    columns = ["doc_id", "node", "start", "end", "first_doc_id", "first_start", "first_end", "similarity", "kept"]
    firsts = nodes.select("node", F.col("least_id").alias("doc_id"))
    cut = spans.join(firsts.hint("merge"), "node").withColumn("kept", F.lit(False)).select(*columns)
    keep = spans.select(F.col("first_doc_id").alias("doc_id"), F.col("first_node").alias("node"), F.col("first_start").alias("start"), F.col("first_end").alias("end"), "first_doc_id", "first_start", "first_end", F.lit(1.0).alias("similarity"), F.lit(True).alias("kept")).distinct()
    copies = copies.join(copied.filter(F.col("n_words") >= least_words).hint("merge"), "node")
    zero = F.lit(0).cast("long")
    copies = materialise(copies.select("doc_id", "node", zero.alias("start"), F.col("n_words").alias("end"), F.col("least_id").alias("first_doc_id"), zero.alias("first_start"), F.col("n_words").alias("first_end"), F.lit(1.0).alias("similarity"), F.lit(False).alias("kept")), "copies")
    kept_copies = copies.select(F.col("first_doc_id").alias("doc_id"), *columns[1:-1], F.lit(True).alias("kept")).distinct()
    return cut.unionByName(keep).unionByName(copies).unionByName(kept_copies)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **options: float) -> DataFrame:
    """``docs`` with every repeated passage cut but its first occurrence; rows and other columns stay, the length column follows the text."""
    ship(docs.sparkSession)
    found = repeats(docs, id_col=id_col, text_col=text_col, **options).filter("not kept")
    key, at_id, at_node, cuts = unused(docs, "__key", "__id", "__node", "__spans")
    spans = materialise(found.groupBy("doc_id", "node").agg(F.collect_list(F.struct("start", "end")).alias(cuts)).select(F.col("doc_id").alias(at_id), F.col("node").alias(at_node), cuts), "cuts")
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    joined = keyed.join(spans.hint("merge"), F.col(id_col).eqNullSafe(F.col(at_id)) & (F.col(key) == F.col(at_node)), "left").select(*docs.columns, cuts)
    place, schema = docs.columns.index(text_col), docs.schema
    at = docs.columns.index(length_col) if length_col in docs.columns else None

    def cut(text: str, spans: list[dict[str, int]]) -> str:
        raw = text.encode()
        w = tx.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        gone = np.zeros(len(w.start) + 1, bool)
        for s in spans:
            gone[s["start"] : s["end"]] = True
        edges = np.append(w.start, len(raw))
        edges[0] = 0
        return b"".join(raw[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone[:-1]).tolist()).decode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(schema)).to_pylist()
            hit = [k for k, s in enumerate(spans) if s]
            columns = list(batch.columns[: len(schema)])
            if hit:
                texts = columns[place].to_pylist()
                for k in hit:
                    texts[k] = cut(texts[k], spans[k])
                columns[place] = pa.array(texts, columns[place].type)
                if at is not None:
                    sizes = columns[at].to_pylist()
                    for k in hit:
                        sizes[k] = len(texts[k])
                    columns[at] = pa.array(sizes, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(run, schema)
