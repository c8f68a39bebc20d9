"""Sources: raw files through an ingest gate, pages, nested reports, golden labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedflow.functions import text

MAX_BYTES = 20 << 20
MAX_PAGES = 500
GOLDEN = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "document_name", "domain", "claim", "claim_type")] + [T.StructField(n, T.IntegerType()) for n in ("page_start", "page_end")] + [T.StructField("source_span", T.StringType()), T.StructField("expected_citation_validity", T.StringType()), T.StructField("human_verified_grounding", T.BooleanType()), T.StructField("notes", T.StringType())])


def reject_reason(size: Column, name: Column, head: Column, most: int = MAX_BYTES) -> Column:
    """First failing rule of a raw file, null if it passes: not empty, not too large, named .pdf, begins as a PDF."""
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_FILE")
        .when(size > most, "FILE_TOO_LARGE")
        .when(~F.lower(F.coalesce(name, F.lit(""))).endswith(".pdf"), "UNSUPPORTED_EXTENSION")
        .when(F.substring(head, 1, 5) != F.lit("%PDF-").cast("binary"), "INVALID_SIGNATURE")
    )


def gate(files: DataFrame) -> DataFrame:
    """Raw files (path, length, content) with a clean name, SHA-256 and reject_reason; accepted where that is null."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", text.clean_filename(name).alias("filename"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("content_hash"), reject_reason(F.col("length"), name, F.col("content")).alias("reject_reason"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return gate(spark.read.format("binaryFile").load(path))


def status(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents (document_id, has_bytes) with the status their pages give: FAILED with a message, else READY."""
    n = pages.groupBy("document_id").agg(F.count("*").alias("n_pages"))
    joined = documents.join(n, "document_id", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    message = F.when(~F.coalesce("has_bytes", F.lit(False)), "File content is missing").when(F.col("n_pages") == 0, "No pages could be read").when(F.col("n_pages") > MAX_PAGES, "Too many pages")
    return joined.withColumn("error_message", message).withColumn("status", F.when(F.col("error_message").isNull(), "READY").otherwise("FAILED"))


def golden_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled claims of a JSON array."""
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path)


def nested_json(row: Column) -> Column:
    return F.to_json(row)


def from_nested_json(json: Column, schema: T.StructType, defaults: dict[str, Column]) -> Column:
    """A report read from JSON; missing parts get their default."""
    parsed = F.from_json(json, schema)
    return F.struct(*[(F.coalesce(parsed[f.name], defaults[f.name]) if f.name in defaults else parsed[f.name]).alias(f.name) for f in schema.fields])
