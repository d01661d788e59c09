"""Whole jobs over collections: validation of packages with all layers, conversion of extracted text to packages, and a command line."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import core
from ..functions import markup
from ..functions import text as T
from ..operators import fidelity, package, shaping
from ..sources import epub
from . import report

FINDING = "epub string, layer string, ord int, level string, code string, message string, location string"


def format_findings(members: DataFrame, packs: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """All rules of the format layer for stored members and packages; messages of an external validator if there are any."""
    good = package.sound(members)
    entries = package.manifest_last(epub.manifest(packs))
    docs = core.stored(epub.documents(good, entries), "content-documents")
    # a package whose OPF cannot be read is not checked against it
    opened = packs.filter("spine is not null and container_error is null and opf_error is null").join(good.select("epub", F.col("name").alias("opf_path")), ["epub", "opf_path"], "left_semi")
    found = [
        package.archive_findings(members),
        package.container_findings(good),
        package.rootfile_findings(packs, good),
        package.metadata_findings(epub.metadata(packs)),
        package.package_findings(entries, epub.spine(packs), good.join(opened.select("epub"), "epub", "left_semi"), opened),
        package.content_findings(docs, epub.refs(docs), good),
        package.image_findings(package.probed_images(good)),
    ]
    return package.union(found if messages is None else [*found, package.tool_findings(messages)])


def book_texts(members: DataFrame, packs: DataFrame) -> DataFrame:
    """(epub, text, spine_documents) in reading order."""
    good = package.sound(members)
    entries = package.manifest_last(epub.manifest(packs))
    spine = epub.spine(packs)
    return package.book_texts(package.reading_order(spine, entries, packs, good), epub.spine_documents(good, package.spine_paths(spine, entries)))


def fidelity_metrics(members: DataFrame, packs: DataFrame, pages: DataFrame, toc: DataFrame, images: DataFrame) -> DataFrame:
    """Measures of each book against its source: pages(epub, page, text), toc(epub, ord, title), images(epub, xref)."""
    as_doc = lambda df: df.withColumnRenamed("epub", "doc_id")
    texts = core.stored(as_doc(book_texts(members, packs)), "book-texts")
    there = pages.select("epub").distinct()
    counts = as_doc(there).join(as_doc(fidelity.package_images(members)), "doc_id", "left").join(fidelity.source_images(as_doc(images)), "doc_id", "left").join(texts.select("doc_id", "spine_documents"), "doc_id", "left")
    return fidelity.metrics(as_doc(pages), texts.select("doc_id", "text"), as_doc(toc), counts)


def validate(members: DataFrame, source: dict[str, DataFrame] | None = None, messages: DataFrame | None = None, renderer: Callable[[DataFrame], DataFrame] | None = None, most_rendered: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(verdicts, findings, metrics or None) of packages, from their members.

    source: tables pages, toc and images of the PDFs, and failed(epub, error) for those that could not be read; damaged packages cannot be compared either. messages: an external validator's. renderer: from
    package.to_render() to reports (package.RENDERED_DDL) of the documents that it was given.
    """
    members = core.stored(members, "members")
    packs = core.stored(epub.packages(package.sound(members)), "packages")
    found = [format_findings(members, packs, messages)]
    if renderer is not None:
        entries = package.manifest_last(epub.manifest(packs))
        rows = core.stored(package.to_render(epub.spine(packs), entries, packs, package.sound(members), most_rendered), "to-render")
        reports = core.stored(renderer(rows.filter("content is not null")), "rendered")
        found += [package.render_failures(rows, packs, members), package.render_findings(reports)]
    measured = None
    if source is not None:
        pages = source["pages"]
        damaged = members.filter("error is not null").groupBy("epub").agg(F.min("error").alias("error")).join(pages.select("epub").distinct(), "epub", "left_semi")
        measured = core.stored(fidelity_metrics(members, packs, pages.join(damaged.select("epub"), "epub", "left_anti"), source["toc"], source["images"]), "metrics")
        failed = damaged.unionByName(source["failed"].select("epub", "error")) if "failed" in source else damaged
        found += [fidelity.findings(measured), fidelity.failed(failed.withColumnRenamed("epub", "doc_id"))]
    findings = core.stored(reduce(DataFrame.unionByName, found), "findings")
    return report.verdicts(members.select("epub").distinct(), findings), findings, measured


def convert(texts: DataFrame, images: DataFrame | None = None, language: str = "en", cover_converter: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(doc_id, filename, content, error): packages from markdown texts(doc_id, title, author, text[, cover binary]).

    The texts are repaired, cut into chapters of bounded size, rendered and filtered; figures that a text names come from images(doc_id, page_index, image_index, content).
    """
    docs = core.stored(texts.withColumn("text", T.encoding_repaired(F.coalesce("text", F.lit("")))), "texts")
    packed = shaping.figures_packed(docs, images) if images is not None else docs.select("doc_id", F.lit(None).cast("map<string,binary>").alias("images")).limit(0)
    parts = shaping.sized(shaping.chapters(docs)).join(packed.select("doc_id", F.map_keys("images").alias("names")), "doc_id", "left")
    body = markup.fragment_with_images(markup.markdown_rendered(T.math_rendered("body")), F.coalesce("names", F.array().cast("array<string>")))["html"]
    chapters = core.stored(shaping.chapter_documents(parts.withColumn("body", body).drop("names")), "chapters")
    books = docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"), F.lit(language).alias("language"), *(["cover"] if "cover" in docs.columns else [])).join(packed, "doc_id", "left")
    made = epub.write_books(chapters, core.stored(books, "books"), cover_converter)
    return made.join(docs.select("doc_id", F.concat(T.safe_name(F.col("title")), F.lit(".epub")).alias("filename")), "doc_id").select("doc_id", "filename", "content", "error")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Validates a package or a folder of them and prints verdicts and findings; 0 if all pass, else 1."""
    options = argparse.ArgumentParser(prog="leafmill", description="Checks EPUB packages, alone or against their source.")
    options.add_argument("epub", help="a package, or a folder of packages")
    options.add_argument("source", nargs="?", help="a folder with pages.parquet, toc.parquet and images.parquet of the sources, keyed by epub")
    options.add_argument("--messages", metavar="FILE", help="an external validator's messages as Parquet")
    options.add_argument("--json", metavar="FOLDER", help="write a JSON report of each package here")
    chosen = options.parse_args(arguments)
    spark = spark or core.session()
    read = lambda name: spark.read.parquet(f"{chosen.source}/{name}.parquet")
    source = {name: read(name) for name in ("pages", "toc", "images")} if chosen.source else None
    verdicts, findings, _ = validate(epub.read_members(spark, chosen.epub), source, spark.read.parquet(chosen.messages) if chosen.messages else None)
    verdicts = core.stored(verdicts, "verdicts")
    for row in verdicts.orderBy("epub").toLocalIterator():
        print(f"{row['epub']}: {row['verdict'].upper()} ({row['errors']} errors, {row['warnings']} warnings)")
    for row in report.console(findings).orderBy("epub", "row").toLocalIterator():
        print(f"  {row['level'].upper():7s} {row['code']}: {row['message']}" + (f" [{row['location']}]" if row["location"] else ""))
    if chosen.json:
        report.as_json(verdicts, findings).write.mode("overwrite").json(chosen.json)
    return verdicts.select(F.max(report.exit_code(F.col("verdict")))).first()[0] or 0


if __name__ == "__main__":
    raise SystemExit(main())
