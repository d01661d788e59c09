"""Readers of recognition output and adapters for tools that this library does not contain (PDF text, recognition models, renderers, validators)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _whole(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of a model's output folder: all .md files, else all .txt, else all .json (see from_json)."""
    for glob in ("*.md", "*.txt"):
        found = _whole(spark, path, glob)
        if not found.isEmpty():
            return found
    return from_json(_whole(spark, path, "*.json"))


def from_json(raw: DataFrame) -> DataFrame:
    """(name, text) of JSON outputs: a string, an object's text or content, or a list, whose items are joined with a blank line between; other texts as they are."""
    v = F.try_parse_json("text")
    told = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$.content", "string"), F.try_variant_get(x, "$", "string"))
    items = F.try_variant_get(v, "$", "array<variant>")
    listed = F.array_join(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), "\n\n")
    return raw.select("name", F.coalesce(F.when(items.isNotNull(), listed), told(v), F.col("text")).alias("text"))


def with_tool(rows: DataFrame, tool: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Rows through an external tool. ``tool`` gets batches and keeps its model for the life of a worker; resources are asked for by the session's resource profile."""
    return rows.mapInPandas(tool, schema)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def source_of(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """outputs(output_file) with the PDF of the first job that made it."""
    first = jobs.filter("output_file is not null and pdf_path is not null").groupBy("output_file").agg(F.min_by("pdf_path", "job_id").alias("pdf_path"))
    return outputs.join(first, "output_file", "left")
