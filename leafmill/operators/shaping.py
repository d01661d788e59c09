"""From extracted text to chapters: text layer, recognised text, chapters, size packing, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

CHAPTER_CHARS = 30_000
TEXT_PAGES = 0.60
PAGES_A_BATCH = 8
#: Tokens that recognition models leave in their output, deleted one after another in this order.
MODEL_TOKENS = ("<|im_end|>", "<|im_start|>", "<|endoftext|>", "</s>", "<s>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|finetune_right_pad_id|>")
FIGURE = r"(?i)images/page_(\d+)_(\d+)\.(jpe?g|png|gif|webp)"


def recognised_clean(c, tokens: tuple[str, ...] = MODEL_TOKENS) -> Column:
    """Without one fence around the whole, model tokens and page tags. Each token is deleted on its own, since a deletion can join another."""
    c = F.regexp_replace(T.strip(c), r"(?s)^```[A-Za-z]*\n(.*?)\n```\s*$", "$1")
    for token in tokens:
        c = F.replace(c, F.lit(token), F.lit(""))
    return T.strip(F.regexp_replace(c, r"</?PAGE\b[^>\n]*>", ""))


def batches(pages: DataFrame, index: str = "page_index", size: int = PAGES_A_BATCH) -> DataFrame:
    return pages.withColumn("batch", F.floor(F.col(index) / size).cast("int"))


def joined_in_order(rows: DataFrame, keys: list[str], order: str, text: str, gap: str = "\n\n") -> DataFrame:
    """Non-blank texts of each key in order, with a gap between."""
    parts = F.array_sort(F.collect_list(F.when(T.strip(F.col(text)) != "", F.struct(order, text))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[text]), gap).alias(text))


def text_layer(pages: DataFrame, toc: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Markdown of documents whose text layer is usable: (doc_id, text).

    pages(doc_id, page_index, text), toc(doc_id, ord, level, title, page_number from 1), images(doc_id, page_index, image_index). A document with too few text pages
    has an empty text.
    """
    toc = toc.filter((T.strip(F.col("title")) != "") & (F.col("page_number") > 0))
    heads = toc.groupBy("doc_id", (F.col("page_number") - 1).alias("page_index")).agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.repeat(F.lit("#"), F.least(F.greatest("level", F.lit(1)), F.lit(2))), F.lit(" "), T.strip(F.col("title"))).alias("line")))).alias("heads"))
    full = pages.join(heads, ["doc_id", "page_index"], "left")
    if images is not None:
        refs = images.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list("image_index")).alias("figures"))
        full = full.join(refs, ["doc_id", "page_index"], "left")
    else:
        full = full.withColumn("figures", F.array().cast("array<int>"))
    figures = F.transform(F.coalesce("figures", F.array().cast("array<int>")), lambda k: F.concat(F.lit("![](images/page_"), F.col("page_index").cast("string"), F.lit("_"), k.cast("string"), F.lit(".jpg)")))
    lines = F.concat(F.coalesce(F.transform("heads", lambda h: h["line"]), F.array().cast("array<string>")), F.array(T.strip(F.col("text"))), figures)
    full = full.withColumn("has_text", T.strip(F.col("text")) != "").withColumn("chunk", F.array_join(lines, "\n\n"))
    parts = F.array_sort(F.collect_list(F.when(F.col("has_text"), F.struct("page_index", "chunk"))))
    done = full.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["chunk"]), "\n\n").alias("whole"), F.count_if("has_text").alias("n"), F.count("*").alias("pages"))
    return done.select("doc_id", F.when(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("pages") * F.lit(TEXT_PAGES))), F.col("whole")).otherwise("").alias("text"))


def figures_kept(images: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Images of a page that count as figures: large enough, no full-page background, and the first of an xref. image_index counts all images of the page.

    Where rows repeat an image_index, ``ties`` are columns by which one of them is first.
    """
    fit = images.filter("width >= 80 and height >= 80")
    first = Window.partitionBy("doc_id", "page_index", "xref").orderBy("image_index", *ties)
    return fit.withColumn("n", F.row_number().over(first)).filter("n = 1 and area_fraction < 0.8").drop("n")


def figure_refs(docs: DataFrame) -> DataFrame:
    """(doc_id, page_index, image_index, ref): the first spelling of each figure that a text names."""
    hits = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(FIGURE), F.lit(0))).alias("ord", "ref"))
    hits = hits.select("doc_id", "ord", "ref", F.regexp_extract("ref", FIGURE, 1).cast("int").alias("page_index"), F.regexp_extract("ref", FIGURE, 2).cast("int").alias("image_index"))
    return hits.groupBy("doc_id", "page_index", "image_index").agg(F.min_by("ref", "ord").alias("ref"))


def figures_resolved(docs: DataFrame, images: DataFrame) -> DataFrame:
    """Named figures that exist, by page and index: references to other pages or images are left out."""
    return figure_refs(docs).join(images, ["doc_id", "page_index", "image_index"])


def figures_packed(docs: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, images map<ref, content>): the figures that a text names and that exist, in order of page and index. images has ``content``."""
    found = figures_resolved(docs, images).filter("content is not null")
    rows = F.array_sort(F.collect_list(F.struct("page_index", "image_index", "ref", "content")))
    return found.groupBy("doc_id").agg(rows.alias("rows")).select("doc_id", F.map_from_entries(F.transform("rows", lambda r: F.struct(r["ref"], r["content"]))).alias("images"))


HEADING = r"(?m)^(?U:\s){0,3}(#{1,2})(?U:\s)+(.+)$"


def chapters(docs: DataFrame) -> DataFrame:
    """(doc_id, idx from 1, title, body). Text before the first heading is left out, as long as there is one; without any, the whole is "Document"."""
    mark, taken = "\u0001", "\u0002"
    # the mark is written otherwise in the text first, and read back in titles and bodies
    safe = F.replace(F.replace("text", F.lit(taken), F.lit(f"{taken}b")), F.lit(mark), F.lit(f"{taken}a"))
    marked = F.regexp_replace(safe, HEADING, f"{mark}$2{mark}")

    def back(c: Column) -> Column:
        return T.strip(F.replace(F.replace(c, F.lit(f"{taken}a"), F.lit(mark)), F.lit(f"{taken}b"), F.lit(taken)))

    def headed(parts: Column) -> Column:
        n = F.greatest(F.floor((F.size(parts) - 1) / 2).cast("int"), F.lit(1))
        both = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(back(F.element_at(parts, (2 * i).cast("int"))).alias("title"), back(F.element_at(parts, (2 * i + 1).cast("int"))).alias("body")))
        return F.when(F.size(parts) > 1, both)

    found = F.coalesce(T.once(F.split(marked, mark), headed), F.array(F.struct(F.lit("Document").alias("title"), F.col("text").alias("body"))))
    return docs.select("doc_id", F.posexplode(found).alias("pos", "c")).select("doc_id", (F.col("pos") + 1).alias("idx"), "c.title", "c.body")


def packed(paragraphs: Column, most: int) -> Column:
    """Greedy parts of paragraphs: a part is closed when the next paragraph would take it over ``most`` characters. Paragraphs are never cut."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def put(s, p):
        full = (F.size(s["now"]) > 0) & (s["n"] + F.length(p) > most)
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(full, F.array(p)).otherwise(F.concat(s["now"], F.array(p))).alias("now"), (F.when(full, 0).otherwise(s["n"]) + F.length(p) + 2).alias("n"))

    return F.aggregate(paragraphs, start, put, lambda s: F.transform(F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]), lambda part: F.array_join(part, "\n\n")))


def sized(chaps: DataFrame, most: int = CHAPTER_CHARS, gap: str = r"\n(?U:\s)*\n") -> DataFrame:
    """Chapters over ``most`` characters in parts, titled (i/n) where there are several."""
    parts = F.when(F.length("body") <= most, F.array("body")).otherwise(packed(F.split("body", gap), most))
    out = chaps.withColumn("parts", parts).select("doc_id", "idx", "title", "body", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "part"))
    title = F.when(F.col("n") > 1, F.concat("title", F.lit(" ("), (F.col("pos") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return out.select("doc_id", "idx", (F.col("pos") + 1).alias("part_no"), title.alias("title"), F.when(F.col("n") > 1, F.col("part")).otherwise(F.col("body")).alias("body"))


def chapter_documents(parts: DataFrame) -> DataFrame:
    """Numbered XHTML documents (doc_id, name, title, xhtml) from sized chapters whose body is HTML."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "part_no"))
    title = T.escaped(F.col("title"))
    page = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>'), title, F.lit('</title><link rel="stylesheet" type="text/css" href="style/main.css"/></head><body><h1>'), title, F.lit("</h1>\n"), F.col("body"), F.lit("</body></html>"))
    return parts.withColumn("number", number).select("doc_id", "number", F.format_string("chapter_%03d.xhtml", "number").alias("name"), "title", page.alias("xhtml"))
