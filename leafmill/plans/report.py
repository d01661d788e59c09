"""Findings folded into verdicts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONSOLE_ROWS = 60


def verdicts(epubs: DataFrame, findings: DataFrame) -> DataFrame:
    """(epub, errors, warnings, infos, verdict): fail with an error, warn with a warning, else pass. epubs(epub) without findings pass."""
    count = lambda level: F.count_if(F.col("level") == level)
    by = findings.groupBy("epub").agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"))
    out = epubs.join(by, "epub", "left").fillna(0, ["errors", "warnings", "infos"])
    return out.withColumn("verdict", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass"))


def layers(findings: DataFrame) -> DataFrame:
    """(epub, layer, passed): a layer passes without an error."""
    return findings.groupBy("epub", "layer").agg((F.count_if(F.col("level") == "error") == 0).alias("passed"))


def exit_code(verdict) -> F.Column:
    """0 for a pass only; a warning counts as 1."""
    return F.when(verdict == "pass", 0).otherwise(1)


def as_json(verdict: DataFrame, findings: DataFrame) -> DataFrame:
    """(epub, report): a JSON text with the verdict, counts and findings in order."""
    listed = F.array_sort(F.collect_list(F.struct("layer", "ord", "level", "code", "message", "location")))
    by = findings.groupBy("epub").agg(listed.alias("findings"))
    whole = verdict.join(by, "epub", "left")
    return whole.select("epub", F.to_json(F.struct("verdict", F.struct("errors", "warnings", "infos").alias("counts"), F.coalesce("findings", F.array().cast(by.schema["findings"].dataType)).alias("findings"))).alias("report"))


def console(findings: DataFrame, rows: int = CONSOLE_ROWS) -> DataFrame:
    """The first findings of each package, as a console shows them."""
    order = Window.partitionBy("epub").orderBy("layer", "ord", "code", "location")
    return findings.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= rows)


def latest_status(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    newest = F.max_by(F.struct(*log.columns), F.struct(at, tie))
    return log.groupBy(key).agg(newest.alias("r")).select("r.*")


def library(spark, path: str) -> DataFrame:
    """(filename, size, modified) of packages in a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("filename")
