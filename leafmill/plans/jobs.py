"""Conversion jobs as an append-only log: uploads, states, and who may do what. The service around them is not part of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import core
from ..functions import pdf
from ..functions import text as T
from ..sources import epub

STATES = ("pending", "processing", "done", "error")


def is_pdf(filename) -> Column:
    return F.endswith(F.lower(filename), F.lit(".pdf"))


def safe_filename(name, suffix: str = ".epub") -> Column:
    """Whether a name can be asked for: a bare file name with that suffix, in no folder."""
    return F.coalesce((F.regexp_extract(name, r"([^/]*)$", 1) == name) & (name != "") & (name != ".") & (name != "..") & F.endswith(F.lower(name), F.lit(suffix)), F.lit(False))


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of the PDFs of a folder, whatever the case of their suffix."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content")


def accept(uploads: DataFrame, folder: str) -> DataFrame:
    """The first rows of the log for uploads(filename, content): job_id, status, step, pdf_path, page_count, original_name, output_file, error, code.

    What is no PDF by its name, or cannot be opened, is refused (400) and not kept; all else is written to ``folder`` under its job's id. Ids are drawn once and stored.
    """
    rows = uploads.select("filename", "content", F.uuid().alias("job_id"), pdf.page_counts("content").alias("page_count"))
    rows = core.stored(rows.withColumn("error", F.when(~F.coalesce(is_pdf(F.col("filename")), F.lit(False)), "not a PDF by its name").when(F.col("page_count").isNull(), "the PDF cannot be opened")), "uploads")
    kept = epub.write_files(rows.filter("error is null").select(F.concat("job_id", F.lit(".pdf")).alias("filename"), "content"), folder)
    paths = kept.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("job_id"), F.col("path").alias("pdf_path"))
    fine = F.col("error").isNull()
    out = rows.drop("content").join(paths, "job_id", "left")
    return out.select("job_id", F.when(fine, "pending").otherwise("error").alias("status"), F.when(fine, "Uploaded").otherwise("Refused").alias("step"), "pdf_path", "page_count", F.col("filename").alias("original_name"), F.lit(None).cast("string").alias("output_file"), "error", F.when(fine, 200).otherwise(400).alias("code"))


def start_code(status, has_text_layer, model_ready) -> Column:
    """What a request to process a job is answered: 404 without a job, 409 if it runs or is done, 503 without a text layer and a model, else 200."""
    return F.when(status.isNull(), 404).when(status.isin("processing", "done"), 409).when(~(has_text_layer | model_ready), 503).otherwise(200)


def output_name(filename, original_name) -> Column:
    """The book's file name: as asked for, else after the upload."""
    stem = F.regexp_replace(F.coalesce(original_name, F.lit("document.pdf")), r"\.[^.]*$", "")
    return F.concat(T.safe_name(F.coalesce(F.nullif(filename, F.lit("")), stem)), F.lit(".epub"))


def in_range(refs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Figure references (doc_id, page_index, ...) whose page the PDF has. jobs(doc_id, page_count)."""
    return refs.join(jobs.select("doc_id", "page_count"), "doc_id").filter((F.col("page_index") >= 0) & (F.col("page_index") < F.col("page_count"))).drop("page_count")
