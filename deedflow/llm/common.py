"""Shared plumbing of the training-data operators: scratch tables, safe broadcasts, hashing expressions."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

#: Separators of words, wherever an operator counts or cuts words.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\f\r"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/deedflow/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, gives true sizes, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_ = path
    return back


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``materialise``, in as many buckets of ``key`` as a shuffle has partitions: joins by the key leave this table where it is."""
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"deedflow_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    back = spark.table(table)
    back.scratch_, back.table_ = path, table
    return back


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables that no table still to be computed reads, and let Spark drop the shuffle files behind them.

    Spark keeps a shuffle's files until the driver collects the plan they belong to, which a driver with memory to
    spare does rarely.
    """
    gc.collect()
    for df in tables:
        spark = df.sparkSession
        if hasattr(df, "table_"):
            spark.sql(f"DROP TABLE IF EXISTS {df.table_}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the table's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcast hint for a table counted at ``rows``; beyond ``limit`` rows Spark shuffles it instead."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")


def unit_hash(*cols: Column) -> Column:
    """A deterministic point in [0, 1) of the given columns (nulls count as a value of their own)."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double")) / F.lit(float(1 << 53))


def crc32_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null ids count as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % n


def word_count(text: Column) -> Column:
    """Words of a text (null: 0), JVM-side."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("long")


def copy_number(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number the rows that agree in all ``keys`` from 1; rows that stand alone get 1 without moving.

    Only rows with a partner are shuffled. Which of two equal rows comes first is left open.
    """
    repeated = materialise(df.groupBy(*keys).count().filter("count > 1").drop("count"), "repeated")
    n = repeated.count()
    if n == 0:
        return df.withColumn(name, F.lit(1))
    same = F.lit(True)
    right = repeated.select([F.col(k).alias(f"__r_{k}") for k in keys])
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    right = small(right, n)
    alone = df.join(right, same, "left_anti").withColumn(name, F.lit(1))
    window = Window.partitionBy(*keys).orderBy(*keys)
    again = df.join(right, same, "left_semi").withColumn(name, F.row_number().over(window))
    return alone.unionByName(again)


def numbered(df: DataFrame, name: str, within: list[str], by: list[str], rows_per_part: int = 50_000) -> DataFrame:
    """The table with ``name``: a row's place, from 0, among rows equal in ``within``, in the order of ``by`` (nulls first).

    Rows are sorted into ranges, so that one group may fill many of them; the first place of a group in each range is
    a sum over one row per group and range. The table is read twice: hand over a written one.
    """
    order = [F.col(c).asc_nulls_first() for c in [*within, *by]]
    at, part, first, n, before = unused(df, "at", "part", "first", "n", "before")
    ranges = max(1, -(-df.count() // rows_per_part))
    line = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    line = materialise(line.withColumn(part, F.shiftright(at, 33)), "line")
    heads = line.groupBy(*within, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    running = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = materialise(heads.withColumn(before, F.coalesce(F.sum(n).over(running), F.lit(0))), "heads")
    right = heads.select(*[F.col(c).alias(f"__h_{c}") for c in [*within, part]], first, before)
    same = F.lit(True)
    for c in [*within, part]:
        same = same & F.col(c).eqNullSafe(F.col(f"__h_{c}"))
    place = (F.col(at) - F.col(first) + F.col(before)).alias(name)
    return line.join(small(right, heads.count()), same).select(*df.columns, place)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that tasks can import it on any cluster.

    Whole texts travel in Arrow batches: unless the session sets their size, batches are kept to 2000 rows.
    """
    import shutil
    from pathlib import Path

    sc, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "2000")
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        into = tempfile.mkdtemp(prefix="deedflow-")
        sc.addPyFile(shutil.make_archive(f"{into}/deedflow_tasks", "zip", package.parent, package.name))
        _SHIPPED.add(sc.applicationId)
