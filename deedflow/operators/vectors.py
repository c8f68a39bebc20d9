"""Hashed term vectors, cosine similarity and top-k search."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedflow.functions import text
from deedflow.sources.scratch import ship

DIMENSIONS = 384


#: Words whose slots a task keeps at once.
KEPT_WORDS = 200_000
RUN = re.compile(f"[^{text.WHITE_SPACE}]+")


def words_of(digests: list[bytes], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights), eight of each word, of the words' SHA-256 digests."""
    word = np.frombuffer(b"".join(digests), ">u4").astype(np.int64).reshape(-1, 8)
    return word % dimensions, ((word >> 16 & 255) / 255.0 - 0.5) / np.arange(1, 9)


def text_columns(c: Column) -> tuple[Column, Column]:
    """What a text's vector is made of: the text in lower case, and the SHA-256 of the whole."""
    t = F.coalesce(c, F.lit(""))
    return F.lower(t), F.sha2(text.strip(t).cast("binary"), 256)


def maker(dimensions: int) -> Callable[[list[str], list[str]], np.ndarray]:
    """For use in one task: rows of unit vectors of texts (lower case, SHA-256 of the whole); words are kept between calls."""
    place: dict[str, int] = {}
    slots, weights = np.zeros((1024, 8), np.int64), np.zeros((1024, 8))
    own = min(dimensions, 32)

    def made(low: list[str], whole: list[str]) -> np.ndarray:
        nonlocal slots, weights
        out = np.zeros((len(low), dimensions))
        for i, body in enumerate(low):
            counts = Counter(RUN.findall(body))
            if not counts:
                continue
            if len(place) > KEPT_WORDS:
                place.clear()
            new = [w for w in counts if w not in place]
            if new:
                first = len(place)
                place.update((w, first + k) for k, w in enumerate(new))
                while len(slots) < len(place):
                    slots, weights = np.concatenate([slots, np.zeros_like(slots)]), np.concatenate([weights, np.zeros_like(weights)])
                slots[first : len(place)], weights[first : len(place)] = words_of([hashlib.sha256(w.encode()).digest() for w in new], dimensions)
            at = np.fromiter(map(place.__getitem__, counts), np.int64, len(counts))
            n = np.fromiter(counts.values(), np.float64, len(counts))
            v = np.bincount(slots[at].ravel(), (weights[at] * n[:, None]).ravel(), dimensions)
            v[:own] += (np.frombuffer(bytes.fromhex(whole[i]), np.uint8)[:own] / 255.0 - 0.5) * 0.2
            norm = np.sqrt((v * v).sum())
            if norm > 1e-9:
                out[i] = v / norm
            else:
                out[i, 0] = 1.0
        return out

    return made


def term_vectors(texts: DataFrame, *, id_cols: tuple[str, ...] = ("id",), text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(ids, vector): a unit vector of each text; blank texts get the zero vector.

    Each word adds to 8 slots named by its SHA-256, the whole text to the first 32. A vector is made of its text alone,
    so that no row is shuffled.
    """
    ship(texts.sparkSession)
    low, whole = text_columns(F.col(text_col))
    rows = texts.select(*id_cols, low.alias("_low"), whole.alias("_whole"))
    schema = T.StructType([*texts.select(*id_cols).schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])
    names = [*id_cols, "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = maker(dimensions)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                out = made(some.column(len(id_cols)).to_pylist(), some.column(len(id_cols) + 1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dimensions), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in range(len(id_cols))), lists], names)

    return rows.mapInArrow(run, schema)


def embedded(texts: DataFrame, embedder: Callable[[DataFrame], DataFrame] | None = None, *, id_cols: tuple[str, ...] = ("id",), text_col: str = "text") -> DataFrame:
    """(ids, content_hash, vector), each distinct text embedded once.

    ``embedder`` makes (content_hash, vector) of (content_hash, text), for any model; without one the hashed term
    vectors stand in. Null texts are empty.
    """
    keyed = texts.select(*id_cols, F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    once = keyed.dropDuplicates(["content_hash"]).select("content_hash", "text")
    made = term_vectors(once, id_cols=("content_hash",)) if embedder is None else embedder(once).select("content_hash", "vector")
    return keyed.drop("text").join(made.hint("merge"), "content_hash").select(*id_cols, "content_hash", "vector")


def unit(vector: Column) -> Column:
    """The vector at length 1, as doubles; one without length stays as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return text.let(wide, lambda v: text.let(norm(v), lambda n: F.when(n > 1e-9, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: F.lit(0.0)))))


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for vectors of different length."""
    product = F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(product)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different length or without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (na <= 1e-9) | (nb <= 1e-9), 0.0).otherwise(dot(a, b) / F.greatest(na * nb, F.lit(1e-300)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine similarity."""
    return 1.0 - cosine(a, b)


#: Bytes of queries that a search may broadcast at once; more are searched in blocks.
BLOCK_BYTES = 32 << 20


def best_of(scored: DataFrame, k: int, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """The ``k`` rows of highest similarity of each key, with their rank; ``order`` settles ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("similarity"), *order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; one of another width is zeros."""
    flat = column.flatten()
    if column.null_count == 0 and len(flat) == len(column) * width and (np.diff(np.asarray(column.offsets)) == width).all():
        return np.asarray(flat, dtype=float).reshape(-1, width)
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width:
            out[i] = v
    return out


def cosines(pairs: DataFrame, a: str, b: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """The pairs with ``similarity``, the cosine of their vectors of ``dimensions`` in columns ``a`` and ``b``, in place of these."""
    ship(pairs.sparkSession)
    kept = [c for c in pairs.columns if c not in (a, b)]
    schema = T.StructType([*pairs.select(*kept).schema.fields, T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = as_matrix(batch.column(a), dimensions), as_matrix(batch.column(b), dimensions)
            norm = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
            cosine = np.where(norm > 1e-18, (x * y).sum(1) / np.maximum(norm, 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cosine)], schema.names)

    return pairs.mapInArrow(run, schema)


def text_cosines(pairs: DataFrame, a: str, b: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """As ``cosines``, of the hashed term vectors of the texts in columns ``a`` and ``b``: made where they are compared, each text of a pack of rows once."""
    ship(pairs.sparkSession)
    kept = [c for c in pairs.columns if c not in (a, b)]
    schema = T.StructType([*pairs.select(*kept).schema.fields, T.StructField("similarity", T.DoubleType())])
    sides = [x.alias(f"_{side}_{what}") for side, c in (("a", a), ("b", b)) for what, x in zip(("low", "whole"), text_columns(F.col(c)), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = maker(dimensions)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                found = []
                for side in "ab":
                    low, whole = (some.column(f"_{side}_{what}").to_pylist() for what in ("low", "whole"))
                    first: dict[str, int] = {}
                    for i, w in enumerate(whole):
                        first.setdefault(w, i)
                    number = {w: n for n, w in enumerate(first)}
                    once = made([low[i] for i in first.values()], list(first))
                    found.append(once[[number[w] for w in whole]])
                x, y = found
                norm = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
                cosine = np.where(norm > 1e-18, (x * y).sum(1) / np.maximum(norm, 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(cosine)], schema.names)

    return pairs.select(*kept, *sides).mapInArrow(run, schema)


#: Rows, and queries, of one matrix product.
PACK = 1_000


def packed(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """(ids, vectors): the table in rows of up to ``PACK`` rows in their order, the other columns as structs and the vectors in one array."""
    ids = [c for c in rows.columns if c != vector]
    kinds = rows.select(*ids).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PACK):
                some = batch.slice(lo, PACK)
                structs = pa.StructArray.from_arrays([some.column(c) for c in ids], ids)
                flat = pa.array(as_matrix(some.column(vector), width).ravel())
                whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.RecordBatch.from_arrays([whole(structs), whole(flat)], ["ids", "vectors"])

    return rows.select(*ids, vector).mapInArrow(run, T.StructType([T.StructField("ids", T.ArrayType(kinds)), T.StructField("vectors", T.ArrayType(T.DoubleType()))]))


def met(asked: DataFrame, rows: DataFrame, k: int, order: tuple[str, ...], least: float | None, width: int) -> DataFrame:
    """(query_id, the rows' columns, similarity): of each pack of rows the ``k`` most similar to every query, by matrix products.

    Rows lie in packs in the order that settles ties. What the product lets through is computed again vector by
    vector, so that equal vectors have equal similarities.
    """
    ship(rows.sparkSession)
    q = packed(asked.select("query_id", "query_vector"), "query_vector", width).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    r = packed(rows.sortWithinPartitions(*order), "vector", width)
    columns = [c for c in rows.columns if c != "vector"]
    schema = T.StructType([*asked.select("query_id").schema.fields, *rows.select(*columns).schema.fields, T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = lambda c: batch.column(c).slice(i, 1).flatten()  # noqa: B023, E731
                ids, q_ids = one("ids"), one("q_ids")
                v, w = (np.asarray(one(c)).reshape(-1, width) for c in ("vectors", "q_vectors"))
                who, what, near = [], [], []
                for n, line in enumerate(w @ v.T):
                    low = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf
                    if least is not None:
                        low = max(low, least)
                    hit = np.flatnonzero(line >= low - 1e-9)
                    exact = (v[hit] * w[n]).sum(1)
                    best = np.argsort(-exact, kind="stable")[:k]
                    if least is not None:
                        best = best[exact[best] >= least]
                    who.append(np.full(len(best), n))
                    what.append(hit[best])
                    near.append(exact[best])
                who, what = pa.array(np.concatenate(who)), pa.array(np.concatenate(what))
                yield pa.RecordBatch.from_arrays([*q_ids.take(who).flatten(), *ids.take(what).flatten(), pa.array(np.concatenate(near))], schema.names)

    return r.crossJoin(F.broadcast(q)).mapInArrow(run, schema)


def top_k(queries: DataFrame, rows: DataFrame, k: int, *, order: tuple[str, ...], min_similarity: float | None = None, within: str | None = None) -> DataFrame:
    """The ``k`` most similar rows (vector and key columns) of every query (query_id, query_vector[, ``within``]).

    The queries are a stated set. They are counted, and broadcast in blocks of at most ``BLOCK_BYTES``, so that a set
    of any size meets all rows block by block; partial limits come before the shuffle. Vectors are brought to length 1
    once, on both sides, and a pair costs an inner product: of a matrix product in blocks unless ``within`` is given.
    ``within`` names a column of the rows, as a tenant: each of its values, null too, has its own ``k`` rows of every
    query. Queries that have the column as well meet only rows of their own value.
    """
    if not 1 <= k <= 50:
        raise ValueError("k is 1 to 50")
    size = F.coalesce(F.size("query_vector"), F.lit(-1))
    n, width, narrowest = queries.agg(F.count("*"), F.coalesce(F.max(size), F.lit(0)), F.min(size)).first()
    blocks = -(-n * (8 * width + 64) // BLOCK_BYTES) or 1
    asked = queries.withColumn("query_vector", unit(F.col("query_vector")))
    rows = rows.withColumn("vector", unit(F.col("vector")))
    keys = ["query_id", *([within] if within else [])]
    # vectors of one width meet by matrix products; a null vector has no similarity, and is left to the plain way
    plain = within is not None or width <= 0 or narrowest != width or not rows.filter(F.col("vector").isNull()).isEmpty()
    found = None
    for block in range(blocks):
        some = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        if not plain:
            best = best_of(met(some, rows, k, order, min_similarity, width), k, keys, order)
            found = best if found is None else found.unionByName(best)
            continue
        if within and within in queries.columns:
            own = some.withColumnRenamed(within, "_within")
            joined = rows.join(F.broadcast(own), F.col(within).eqNullSafe(F.col("_within"))).drop("_within")
        else:
            joined = rows.crossJoin(F.broadcast(some))
        scored = joined.withColumn("similarity", dot(F.col("query_vector"), F.col("vector"))).drop("query_vector", "vector")
        if min_similarity is not None:
            scored = scored.filter(F.col("similarity") >= min_similarity)
        best = best_of(scored, k, keys, order)
        found = best if found is None else found.unionByName(best)
    return found
