"""Approximate top-k: a cell index of vectors, written as a table, with the number of probed cells found by measurement.

Cells are k-means centres of a bounded sample; every row is in the cell of its nearest centre. The index's files are
in order of cells, so that a search reads what it probes. A search ranks the cells for each query and meets only rows
of the first ``probes`` of them: an equi-join by cell, in blocks of at most ``PART`` rows and ``PART`` queries, each a
matrix product. ``vectors.top_k`` is the exact search.

How many cells must be probed depends on the data: few where vectors cluster, half of them and more where they do
not. ``build`` finds it: the exact neighbours of some rows are looked up, and as many cells are probed as hold the
wanted share of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedflow.operators import vectors
from deedflow.sources.scratch import ship, written

#: Rows, and queries, that meet in one matrix product at most.
PART = 4_096
#: Cells of an index at most, rows its centres are learned from, rows whose exact neighbours fix the number of probes.
MOST_CELLS, SAMPLE, ASKED = 1_024, 20_000, 100


@dataclass(frozen=True)
class Index:
    """A written index: its folder, the columns that tell a row and settle ties, vectors' width, cells and probes."""

    path: str
    order: tuple[str, ...]
    width: int
    cells: int
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def centres(self, spark: SparkSession) -> np.ndarray:
        """Bounded by the number of cells."""
        return np.array(KMeansModel.load(f"{self.path}/model").clusterCenters())


def placed(rows: DataFrame, model: KMeansModel, width: int) -> DataFrame:
    """Rows with their unit vector (of ``width``, zeros where it had another one) and cell."""
    sized = F.when(F.size("vector") == width, vectors.unit(F.col("vector"))).otherwise(F.array_repeat(F.lit(0.0), width))
    fixed = rows.withColumn("vector", sized).withColumn("_features", array_to_vector("vector"))
    return model.transform(fixed).drop("_features").withColumn("cell", F.col("cell").cast("int"))


def write_rows(assigned: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows in order of cells, each cell in parts of about ``PART`` rows."""
    counts = assigned.groupBy("cell").agg(F.count("*").alias("_n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / PART)).cast("long")
    dealt = assigned.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_n")
    dealt.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.mode(mode).parquet(f"{path}/rows")


def build(rows: DataFrame, path: str, *, order: tuple[str, ...], k: int = 10, recall: float = 0.95, cells: int | None = None, seed: int = 7) -> Index:
    """Index all rows (``order`` columns, ``vector``) in a folder, to find ``recall`` of the ``k`` nearest on average.

    The centres come of about ``SAMPLE`` rows, the number of probes of the exact neighbours of about ``ASKED`` rows.
    """
    ship(rows.sparkSession)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
    some = rows if n <= SAMPLE else rows.sample(SAMPLE / n, seed)
    learned = some.filter(F.size("vector") == width).select(array_to_vector(vectors.unit(F.col("vector"))).alias("_features"))
    if n == 0 or width <= 0:
        return Index(path, order, 0, 0, 0)
    model = KMeans(featuresCol="_features", predictionCol="cell", k=cells, seed=seed, maxIter=10).fit(learned)
    model.write().overwrite().save(f"{path}/model")
    assigned = written(placed(rows, model, width), "assigned")
    write_rows(assigned, path)
    found = Index(path, order, width, len(model.clusterCenters()), 0)
    asked = rows.filter(F.size("vector") == width).sample(min(1.0, ASKED / n), seed + 1).limit(2 * ASKED)
    asked = written(asked.select(F.monotonically_increasing_id().alias("query_id"), F.col("vector").alias("query_vector")), "asked")
    near = vectors.top_k(asked, found.rows(rows.sparkSession), k, order=order).select("query_id", "cell")
    ranked = cells_of(asked, found, found.cells)
    held = near.join(ranked.hint("merge"), ["query_id", "cell"]).select("place")
    needed = held.agg(F.percentile("place", F.lit(recall)).alias("p")).first()["p"]
    return Index(path, order, width, found.cells, min(found.cells, int(-(-(needed or 0) // 1)) + 1))


def add(rows: DataFrame, index: Index) -> None:
    """More rows into the cells of an index."""
    model = KMeansModel.load(f"{index.path}/model")
    write_rows(written(placed(rows, model, index.width), "assigned"), index.path, "append")


def cells_of(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """(query_id, query_vector, cell, place): the first cells of every query, nearest first."""
    centres = index.centres(queries.sparkSession)
    width = index.width

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                ids, vecs = some.column("query_id"), some.column("query_vector")
                q = vectors.as_matrix(vecs, width)
                # nearest by distance, as rows were placed: |q - c|^2 less the query's own part
                order = np.argsort(-(2 * q @ centres.T - (centres**2).sum(1)), axis=1, kind="stable")[:, :probes]
                n = len(q) * order.shape[1]
                each = np.repeat(np.arange(len(q)), order.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(each)), vecs.take(pa.array(each)), pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(order.shape[1], dtype=np.int32), len(q))[:n])],
                    ["query_id", "query_vector", "cell", "place"],
                )

    asked = queries.select("query_id", vectors.unit(F.col("query_vector")).alias("query_vector"))
    return asked.mapInArrow(rank, f"query_id {dict(queries.dtypes)['query_id']}, query_vector array<double>, cell int, place int")


def search(queries: DataFrame, index: Index, k: int, *, probes: int | None = None, min_similarity: float | None = None) -> DataFrame:
    """About the ``k`` most similar rows of every query (query_id, query_vector): the index's columns, similarity, rank.

    The queries are a stated set of any size; ``probes`` overrides the number the index was built with.
    """
    spark = queries.sparkSession
    ship(spark)
    if index.cells == 0:
        keys = ", ".join(f"{c} string" for c in index.order)
        return spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, {keys}, similarity double, rank int")
    rows = index.rows(spark)
    asked = written(cells_of(queries, index, probes or index.probes), "probes")
    per_cell = asked.groupBy("cell").agg(F.count("*").alias("n")).collect()  # bounded by the number of cells
    blocks = max([1, *(-(-r["n"] // PART) for r in per_cell)])
    rows = rows.filter(F.col("cell").isin([r["cell"] for r in per_cell]))
    parts = rows.select(F.col("cell").alias("cell"), F.col("part").alias("part")).distinct()
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    # every part of a cell meets every block of its queries
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else rows.withColumn("block", F.lit(0))
    right = asked.join(F.broadcast(parts), "cell")
    key = ["cell", "part", "block"]
    kinds = dict(rows.dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, " + ", ".join(f"{c} {kinds[c]}" for c in index.order) + ", similarity double"
    order, width = index.order, index.width

    def meet(some: pa.Table, these: pa.Table) -> pa.Table:
        columns = [these["query_id"].combine_chunks(), *(some[c].combine_chunks() for c in order)]
        if len(some) == 0 or len(these) == 0:
            return pa.Table.from_arrays([*[c.slice(0, 0) for c in columns], pa.array([], pa.float64())], names=["query_id", *order, "similarity"])
        near = vectors.as_matrix(these["query_vector"].combine_chunks(), width) @ vectors.as_matrix(some["vector"].combine_chunks(), width).T
        ties = [np.asarray(some[c].to_pylist(), dtype=object) if pa.types.is_string(some.schema.field(c).type) else np.asarray(some[c]) for c in order]
        who, what = [], []
        for i, line in enumerate(near):
            least = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf
            hit = np.flatnonzero((line >= least) if min_similarity is None else ((line >= least) & (line >= min_similarity)))
            best = hit[np.lexsort([*[t[hit] for t in reversed(ties)], -line[hit]])][:k]
            who.append(np.full(len(best), i))
            what.append(best)
        who, what = np.concatenate(who), np.concatenate(what)
        return pa.Table.from_arrays([columns[0].take(pa.array(who)), *[c.take(pa.array(what)) for c in columns[1:]], pa.array(near[who, what])], names=["query_id", *order, "similarity"])

    left, right = left.select(*key, *order, "vector"), right.select(*key, "query_id", "query_vector")
    candidates = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, schema)
    return vectors.best_of(candidates, k, ["query_id"], order)


def recall_of(found: DataFrame, exact: DataFrame, order: tuple[str, ...]) -> float:
    """Share of the exact neighbours that a search found."""
    hit = exact.select("query_id", *order).join(found.select("query_id", *order).hint("merge"), ["query_id", *order], "left_semi").count()
    return hit / max(1, exact.count())
