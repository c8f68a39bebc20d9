"""Extraction by a model: a provider answers batches of pages, its answers are checked, what fails is kept apart.

A provider is a function of an Arrow batch (document_id, page_number, text) that gives one JSON text a page, or null:
an object with a list for each kind of entity it extracts. It runs in Spark's tasks. What it gives is read with the
kind's schema, known values are coerced and required fields checked as for any entity; the rest of the library takes
the result in place of its own extraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedflow.operators import gates
from deedflow.sources.scratch import ship, written

Provider = Callable[[pa.RecordBatch], list[str | None]]

#: Fields of each kind that a provider gives, beside the page, which is that of its answer.
FIELDS = {
    "parties": "name string, role string, source_span string",
    "clauses": "clause_identifier string, title string, category string, text string, source_span string",
    "obligations": "obligor string, duty string, trigger string, deadline string, source_span string",
    "dates": "date_type string, raw_text string, normalized_date string, description string, source_span string",
    "review_flags": "flag_type string, title string, description string, severity string, source_span string",
}


def answers(pages: DataFrame, provider: Provider) -> DataFrame:
    """(document_id, page_number, answer) of every page, asked once. A provider that gives too few or too many answers is an error."""
    ship(pages.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = provider(batch)
            if len(given) != batch.num_rows:
                raise ValueError(f"{len(given)} answers to {batch.num_rows} pages")
            yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("page_number"), pa.array(given, pa.string())], ["document_id", "page_number", "answer"])

    asked = pages.select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("text"))
    kinds = dict(asked.dtypes)
    return written(asked.mapInArrow(ask, f"document_id {kinds['document_id']}, page_number {kinds['page_number']}, answer string"), "answers")


def entities(answered: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Entities of a kind (document_id, page_number, ordinal and the kind's fields), and what was rejected (document_id, page_number, violations, raw).

    An answer that is no such JSON is rejected whole (INVALID_RESPONSE); an entity for its violations.
    """
    parsed = answered.withColumn("parsed", F.from_json("answer", f"{kind} array<struct<{fields_of(kind)}>>")[kind])
    broken = F.col("answer").isNull() | F.col("parsed").isNull()
    bad = parsed.filter(broken).select("document_id", "page_number", F.array(F.lit("INVALID_RESPONSE")).alias("violations"), F.col("answer").alias("raw"))
    each = parsed.filter(~broken).select("document_id", "page_number", F.posexplode("parsed").alias("at", "x")).filter("x is not null")
    checked = gates.violations(gates.coerced(each.select("document_id", "page_number", "at", "x.*")), kind)
    good, rejected = gates.split(checked)
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "at"))
    raw: Column = F.to_json(F.struct(*[c for c in good.columns if c not in ("document_id", "page_number", "at")]))
    return good.withColumn("ordinal", ordinal).drop("at"), bad.unionByName(rejected.select("document_id", "page_number", "violations", raw.alias("raw")))


def fields_of(kind: str) -> str:
    return ", ".join(f"{name}: {kind_}" for name, kind_ in (f.split() for f in FIELDS[kind].split(", ")))
