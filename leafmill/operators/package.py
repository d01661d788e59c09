"""Checks of packages as relations: members, manifest, spine and references against each other.

members(epub, ord, name, compress_type, content, error), manifest(epub, ord, id, href, path, media_type, properties), spine(epub, pos, idref),
refs(epub, doc_path, ord, tag, attr, value), metadata(epub, field, value). Every check gives findings (epub, layer, ord, level, code, message, location).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import images, paths

MIMETYPE = "application/epub+zip"
CONTAINER = "META-INF/container.xml"
XHTML = "http://www.w3.org/1999/xhtml"
IMAGE_NAME = r"(?i)\.(jpg|jpeg|png|gif|webp)$"
SEVERITIES = {"FATAL": "error", "ERROR": "error", "WARNING": "warning", "INFO": "info", "USAGE": "info", "SUPPRESSED": "info"}


def finding(rows: DataFrame, level, code, message: Column, location=None, layer: str = "format", order=0) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("epub", F.lit(layer).alias("layer"), lit(order).cast("int").alias("ord"), lit(level).alias("level"), lit(code).alias("code"), message.alias("message"), lit(location).cast("string").alias("location"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def archive_findings(members: DataFrame) -> DataFrame:
    """Archives that cannot be opened or hold a damaged member."""
    bad = members.filter("error is not null")
    code = F.when(F.col("name").isNull(), F.lit("zip/unreadable")).otherwise(F.lit("zip/corrupt"))
    return finding(bad, "error", code, F.col("error"), F.col("name"))


def sound(members: DataFrame) -> DataFrame:
    """Members of archives without damage; structure is checked for these only."""
    return members.join(members.filter("error is not null").select("epub").distinct(), "epub", "left_anti")


def container_findings(members: DataFrame) -> DataFrame:
    """The mimetype member: there, first, stored and right."""
    is_type = F.col("name") == "mimetype"
    per = members.groupBy("epub").agg(F.max(is_type).alias("there"), F.min_by("name", "ord").alias("first"), F.max(F.when(is_type, F.col("compress_type"))).alias("kind"), F.max(F.when(is_type, F.decode("content", "ISO-8859-1"))).alias("value"), F.max(F.col("name") == CONTAINER).alias("container"))
    here = per.filter("there")
    return union([
        finding(per.filter("not there"), "error", "ocf/missing-mimetype", F.lit("no mimetype member"), order=1),
        finding(here.filter("first <> 'mimetype'"), "error", "ocf/mimetype-not-first", F.concat(F.lit("first member is "), "first"), order=2),
        finding(here.filter("kind <> 0"), "error", "ocf/mimetype-compressed", F.lit("mimetype is compressed"), order=3),
        finding(here.filter(F.regexp_replace("value", r"\s+$", "") != MIMETYPE), "error", "ocf/mimetype-content", F.lit("mimetype has other content"), order=4),
        finding(per.filter("not container"), "error", "ocf/missing-container", F.lit(f"no {CONTAINER}"), order=5),
    ])


def rootfile_findings(packages: DataFrame, members: DataFrame) -> DataFrame:
    """packages(epub, container_error, opf_path, opf_error): what the container says."""
    has = packages.filter("container_error is null").join(members.filter(F.col("name") == CONTAINER).select("epub").distinct(), "epub", "left_semi")
    named = has.filter("opf_path is not null and opf_path <> ''")
    lost = named.join(members.select("epub", F.col("name").alias("opf_path")), ["epub", "opf_path"], "left_anti")
    return union([
        finding(packages.filter("container_error is not null"), "error", "ocf/bad-container", F.col("container_error"), order=6),
        finding(has.filter("coalesce(opf_path, '') = ''"), "error", "ocf/no-rootfile", F.lit("no rootfile"), order=7),
        finding(lost, "error", "ocf/rootfile-missing", F.concat(F.col("opf_path"), F.lit(" is not in the archive")), order=8),
        finding(packages.filter("opf_error is not null"), "error", "opf/not-xml", F.col("opf_error"), F.col("opf_path"), order=9),
    ])


def metadata_findings(metadata: DataFrame) -> DataFrame:
    return finding(metadata.filter("coalesce(value, '') = ''"), "error", "opf/missing-metadata", F.concat(F.lit("no dc:"), F.col("field")), order=10)


def manifest_last(manifest: DataFrame) -> DataFrame:
    """One entry for each id: the last one wins."""
    last = Window.partitionBy("epub", "id").orderBy(F.desc("ord"))
    return manifest.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n")


def manifest_missing(manifest: DataFrame, members: DataFrame) -> DataFrame:
    """Manifest entries whose file is not in the archive."""
    return manifest.join(members.select("epub", F.col("name").alias("path")), ["epub", "path"], "left_anti")


def undeclared(manifest: DataFrame, members: DataFrame, opf: DataFrame) -> DataFrame:
    """Content files that no manifest entry declares. opf(epub, opf_path)."""
    content = members.filter("name <> 'mimetype' and not startswith(name, 'META-INF/') and not endswith(name, '/')").join(opf, "epub", "left").filter("opf_path is null or name <> opf_path")
    return content.join(manifest.select("epub", F.col("path").alias("name")), ["epub", "name"], "left_anti")


def spine_paths(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """Spine items in order with their paths; items that the manifest lacks vanish."""
    return spine.join(manifest.select("epub", F.col("id").alias("idref"), "path"), ["epub", "idref"])


def package_findings(manifest: DataFrame, spine: DataFrame, members: DataFrame, packages: DataFrame) -> DataFrame:
    """packages(epub, opf_path, nav_path, ncx_path)."""
    opf = packages.select("epub", "opf_path")
    lost = manifest_missing(manifest, members)
    extra = undeclared(manifest, members, opf)
    empty = packages.join(spine_paths(spine, manifest).select("epub").distinct(), "epub", "left_anti")
    return union([
        finding(lost, "error", "opf/manifest-file-missing", F.concat(F.col("id"), F.lit(": "), F.col("path")), order=11),
        finding(extra, "warning", "opf/undeclared-resource", F.col("name"), order=12),
        finding(empty, "error", "opf/empty-spine", F.lit("the spine names no file"), F.col("opf_path"), order=13),
        finding(packages.filter("nav_path is null and ncx_path is null"), "error", "opf/no-navigation", F.lit("no navigation document"), F.col("opf_path"), order=14),
    ])


def resolved_refs(refs: DataFrame) -> DataFrame:
    """References with ``external``, ``remote`` and, for inner ones, ``target``; NULL for a bare fragment."""
    value = F.col("value")
    inner = ~paths.is_external(value) & (paths.path_of(value) != "")
    return refs.withColumn("external", paths.is_external(value)).withColumn("remote", paths.is_remote(value)).withColumn("target", F.when(inner, paths.resolved(paths.folder(F.col("doc_path")), value)))


def broken_refs(refs: DataFrame, members: DataFrame) -> DataFrame:
    return resolved_refs(refs).filter("target is not null").join(members.select("epub", F.col("name").alias("target")), ["epub", "target"], "left_anti")


def content_findings(documents: DataFrame, refs: DataFrame, members: DataFrame) -> DataFrame:
    """documents(epub, path, xml_error, namespace). A document has one finding of its own at most; references are resolved once and looked up among the members."""
    good = documents.filter("xml_error is null")
    told = F.concat(F.lit("<"), F.col("tag"), F.lit(" "), F.col("attr"), F.lit("='"), F.col("value"), F.lit("'>"))
    broken_xml = F.col("xml_error").isNotNull()
    own = documents.filter(broken_xml | (F.coalesce("namespace", F.lit("")) != XHTML))
    code = F.when(broken_xml, "content/not-xml").otherwise("content/wrong-namespace")
    message = F.coalesce("xml_error", F.concat(F.lit("namespace "), F.coalesce("namespace", F.lit("none"))))
    of_good = resolved_refs(refs.join(good.select("epub", F.col("path").alias("doc_path")), ["epub", "doc_path"], "left_semi")).filter("remote or target is not null")
    there = members.select("epub", F.col("name").alias("target")).distinct().withColumn("found", F.lit(True))
    bad = of_good.join(there, ["epub", "target"], "left").filter("remote or found is null")
    return union([
        finding(own, "error", code, message, F.col("path"), order=F.when(broken_xml, 15).otherwise(16)),
        finding(bad, F.when(F.col("remote"), "warning").otherwise("error"), F.when(F.col("remote"), "content/remote-resource").otherwise("content/broken-reference"), told, F.col("doc_path"), order=F.when(F.col("remote"), 17).otherwise(18)),
    ])


def image_findings(probes: DataFrame) -> DataFrame:
    """probes(epub, name, decodable), as probed_images() gives."""
    return finding(probes.filter(F.col("name").rlike(IMAGE_NAME) & ~F.col("decodable")), "error", "image/not-decodable", F.lit("the image does not decode"), F.col("name"), order=19)


def probed_images(members: DataFrame) -> DataFrame:
    """(epub, name, format, mode, width, height, decodable, error) of the members that are images by their name."""
    found = members.filter(F.col("name").rlike(IMAGE_NAME)).select("epub", "name", images.probed("content").alias("p"))
    return found.select("epub", "name", "p.*")


def reading_order(spine: DataFrame, manifest: DataFrame, packages: DataFrame, members: DataFrame) -> DataFrame:
    """(epub, pos, path): the documents of a book in the order of its spine, without its navigation and without files that are not there."""
    named = spine_paths(spine, manifest).join(packages.select("epub", "nav_path"), "epub").filter("nav_path is null or path <> nav_path")
    return named.select("epub", "pos", "path").join(members.select("epub", F.col("name").alias("path")).distinct(), ["epub", "path"], "left_semi")


def book_texts(order: DataFrame, documents: DataFrame) -> DataFrame:
    """(epub, text, spine_documents): the texts of a book's documents, in reading order with a space between."""
    rows = order.join(documents.select("epub", "path", F.col("text").alias("body")), ["epub", "path"])
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("body", F.lit("")).alias("body"))))
    return rows.groupBy("epub").agg(F.array_join(F.transform(parts, lambda p: p["body"]), " ").alias("text"), F.count("*").alias("spine_documents"))


def tool_findings(messages: DataFrame) -> DataFrame:
    """Messages of an external validator: (epub, ord, id, severity, message, locations array<struct<path, line>>); three places are told."""
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), F.col("severity")), F.lit("error"))
    place = F.array_join(F.transform(F.slice("locations", 1, 3), lambda x: F.concat(F.coalesce(x["path"], F.lit("?")), F.lit(":"), F.coalesce(x["line"].cast("string"), F.lit("?")))), ", ")
    more = F.when(F.size("locations") > 3, F.concat(F.lit(" (+"), (F.size("locations") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    return finding(messages, level, F.concat(F.lit("epubcheck/"), F.coalesce("id", F.lit("?"))), F.coalesce("message", F.lit("")), F.concat(place, more), layer="epubcheck", order=F.col("ord"))


RENDERED_DDL = "epub string, pos int, document string, is_nav boolean, load_error string, page_errors array<string>, failed_requests array<string>, broken_images array<string>, visible_text_chars int, image_count int, horizontal_overflow boolean"


def to_render(spine: DataFrame, manifest: DataFrame, packages: DataFrame, members: DataFrame, most: int | None = None) -> DataFrame:
    """(epub, pos, document, is_nav, content): what a renderer is given: the spine in order, the first ``most`` documents of each book; content is null for files that are not there."""
    rows = spine_paths(spine, manifest)
    if most:
        first = Window.partitionBy("epub").orderBy("pos")
        rows = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).drop("n")
    rows = rows.join(packages.select("epub", "nav_path"), "epub").select("epub", "pos", F.col("path").alias("document"), F.coalesce(F.col("path") == F.col("nav_path"), F.lit(False)).alias("is_nav"))
    return rows.join(members.select("epub", F.col("name").alias("document"), "content"), ["epub", "document"], "left").select("epub", "pos", "document", "is_nav", "content")


def render_failures(rendered: DataFrame, packages: DataFrame, members: DataFrame) -> DataFrame:
    """Books that a renderer cannot open, and spine documents that are not there. rendered: to_render()'s rows."""
    unopened = members.filter("name is null and error is not null")
    lost = packages.filter("coalesce(opf_path, '') = '' and container_error is null")
    bad = packages.filter("container_error is not null or opf_error is not null")
    return union([
        finding(lost, "error", "render/no-container", F.lit("no OPF to render"), layer="render", order=0),
        finding(unopened, "error", "render/unpack-failed", F.col("error"), layer="render", order=0),
        finding(bad, "error", "render/unpack-failed", F.coalesce("container_error", "opf_error"), layer="render", order=0),
        finding(rendered.filter("content is null"), "error", "render/missing-spine-doc", F.lit("the spine document is not in the archive"), F.col("document"), "render", 1),
    ])


def render_findings(documents: DataFrame) -> DataFrame:
    """documents(epub, pos, document, is_nav, load_error, page_errors, failed_requests, broken_images, visible_text_chars, image_count, horizontal_overflow): reports of a renderer.

    The findings of a document are made as one array, so its row is read once; a document that did not load has no other.
    """

    def one(order: int, level: str, code: str, message) -> Column:
        message = message if isinstance(message, Column) else F.lit(message)
        return F.struct(F.lit(order).alias("ord"), F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"))

    def when(condition: Column, *what) -> Column:
        return F.when(condition, F.array(one(*what))).otherwise(F.array().cast(kind))

    kind = "array<struct<ord:int,level:string,code:string,message:string>>"
    loaded = F.concat(
        when(F.size("broken_images") > 0, 2, "error", "render/broken-images", F.array_join(F.slice("broken_images", 1, 5), ", ")),
        F.transform(F.slice("failed_requests", 1, 5), lambda x: one(3, "error", "render/resource-failed", x)).cast(kind),
        F.transform(F.slice("page_errors", 1, 5), lambda x: one(4, "warning", "render/page-error", x)).cast(kind),
        when((F.col("visible_text_chars") < 20) & (F.col("image_count") == 0) & ~F.col("is_nav"), 5, "warning", "render/blank-document", "the document shows nothing"),
        when(F.col("horizontal_overflow"), 6, "warning", "render/horizontal-overflow", "wider than the window"),
    )
    failed = F.array(one(1, "error", "render/load-failed", F.col("load_error"))).cast(kind)
    made = documents.select("epub", "document", F.explode(F.when(F.col("load_error").isNotNull(), failed).otherwise(loaded)).alias("f"))
    by_document = made.select("epub", F.lit("render").alias("layer"), "f.*", F.col("document").alias("location"))
    total = documents.groupBy("epub").agg(F.sum("visible_text_chars").alias("chars"))
    book = finding(total.filter("chars < 200"), "error", "render/book-blank", F.lit("the book shows almost no text"), layer="render", order=7)
    return by_document.select(*book.columns).unionByName(book)


def render_totals(documents: DataFrame) -> DataFrame:
    return documents.groupBy("epub").agg(F.count("*").alias("documents"), F.sum("visible_text_chars").alias("visible_text_chars"), F.sum(F.size("broken_images")).alias("broken_images"))
