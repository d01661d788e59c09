"""How much of a source survives in a derived text: coverage, missing spans, extra content, titles.

source(doc_id, page, text) are ordered pages, derived(doc_id, text) one text for each document. Shingles are joined on doc_id and 128 bits of hash, and only
those of the derived text that the source has are moved: the source's shingles go to the derived text if they are few, else both are dealt by
document and hash, where no key repeats. Pages are put into normal form one by one, then joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import core, joins
from ..functions import text as T

ERROR_BELOW, WARN_BELOW, POOR_PAGE, EXTRA_OVER, TITLES_BELOW = 0.75, 0.90, 0.5, 0.20, 0.75
SPANS_TOLD, SPANS_KEPT, TITLES_KEPT, TITLES_TOLD = 20, 50, 25, 5
MOJIBAKE = "[ÂÃ][-¿–—‘’“”®©]"
#: Keys (24 bytes each) that are broadcast at most.
FEW = 100_000
IMAGE_NAME = r"(?i)\.(jpg|jpeg|png|gif|webp)$"


def _hashed(shingle) -> list[Column]:
    return [F.xxhash64(shingle).alias("a"), F.xxhash64(F.lit(1), shingle).alias("b")]


def runs(rows: DataFrame, keys: list[str], text: str = "text", n: int = 5) -> DataFrame:
    """(keys, a, b): distinct shingles of each row's text, as 128 bits."""
    found = rows.select(*keys, F.explode(T.shingles(T.words(T.normalized(F.col(text))), n)).alias("shingle"))
    return found.select(*keys, *_hashed(F.col("shingle")))


def joined_runs(pages: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """(keys, a, b): shingles of the pages of each document as one text, in normal form page by page, so words at a page's end and at the next one's start run on.

    Each page sees the first words of the pages after it, and makes the shingles that begin on it; a document's text is never in one row.
    """
    full = pages.select(*keys, "page", T.words(T.normalized(F.col("text"))).alias("w")).filter("size(w) > 0")
    order = Window.partitionBy(*keys).orderBy("page")
    after = F.slice(F.flatten(F.collect_list(F.slice("w", 1, n - 1)).over(order.rowsBetween(1, n - 1))), 1, n - 1)
    full = full.withColumn("all", F.concat("w", after)).withColumn("first", F.row_number().over(order) == 1)
    # a page makes as many shingles as begin on it; a whole text of fewer than n words is one
    count = F.least(F.size("w"), F.size("all") - (n - 1))
    short = F.col("first") & (F.size("all") < n)
    many = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice("all", i, n), " "))
    made = F.when(short, F.array(F.array_join("all", " "))).when(count > 0, many).otherwise(F.array().cast("array<string>"))
    return full.select(*keys, F.explode(F.array_distinct(made)).alias("shingle")).select(*keys, *_hashed(F.col("shingle")))


def among(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``few``, which is stored and has no key twice; it is broadcast if it is small."""
    small = few.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(few) if small else few, on, "left_semi")


def page_coverage(pages: DataFrame, derived: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, page, shingles, hits, coverage); a blank page has coverage 1."""
    own = core.stored(runs(pages, ["doc_id", "page"], n=n), "page-shingles")
    return _covered(pages, own, runs(derived, ["doc_id"], n=n))


def _covered(pages: DataFrame, own: DataFrame, there: DataFrame) -> DataFrame:
    key = ["doc_id", "a", "b"]
    wanted = core.stored(own.select(*key).distinct(), "wanted-shingles")
    there = among(there, wanted, key).distinct().withColumn("found", F.lit(1))
    counted = own.join(there, key, "left").groupBy("doc_id", "page").agg(F.count("*").alias("shingles"), F.count("found").alias("hits"))
    all_pages = pages.select("doc_id", "page").join(counted, ["doc_id", "page"], "left").fillna(0, ["shingles", "hits"])
    return all_pages.withColumn("coverage", F.when(F.col("shingles") == 0, 1.0).otherwise(F.col("hits") / F.col("shingles")))


def text_coverage(by_page: DataFrame) -> DataFrame:
    """(doc_id, pages, text_coverage): the mean over pages with text, 0 without any."""
    mean = F.avg(F.when(F.col("shingles") > 0, F.col("coverage")))
    return by_page.groupBy("doc_id").agg(F.count("*").alias("pages"), F.coalesce(mean, F.lit(0.0)).alias("text_coverage"))


def missing_spans(by_page: DataFrame) -> DataFrame:
    """(doc_id, span, first, last): maximal runs of poor pages with text, 1-based."""
    order = Window.partitionBy("doc_id").orderBy("page")
    ranked = by_page.withColumn("pos", F.row_number().over(order))
    poor = ranked.filter((F.col("coverage") < POOR_PAGE) & (F.col("shingles") > 0)).withColumn("island", F.col("pos") - F.row_number().over(order))
    spans = poor.groupBy("doc_id", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return spans.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("span"), "first", "last")


def _extra(own: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Of distinct shingles of each derived text, how many the source lacks."""
    hits = among(own, known, on).groupBy("doc_id").agg(F.count("*").alias("known"))
    counted = own.groupBy("doc_id").agg(F.count("*").alias("derived_shingles")).join(hits, "doc_id", "left")
    counted = counted.select("doc_id", "derived_shingles", (F.col("derived_shingles") - F.coalesce("known", F.lit(0))).alias("extra"))
    return counted.withColumn("extra_ratio", F.when(F.col("derived_shingles") > 0, F.col("extra") / F.col("derived_shingles")).otherwise(0.0))


def extra_ratio(pages: DataFrame, derived: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, derived_shingles, extra, extra_ratio): shingles of the derived text that its source lacks."""
    known = core.stored(joined_runs(pages, ["doc_id"], n).distinct(), "source-shingles")
    return _extra(runs(derived, ["doc_id"], n=n), known, ["doc_id", "a", "b"])


def extra_against(pages: DataFrame, derived: DataFrame, n: int = 5) -> DataFrame:
    """The same where all derived texts have one source: pages(page, text)."""
    known = core.stored(joined_runs(pages.withColumn("all_", F.lit(0)), ["all_"], n).select("a", "b").distinct(), "source-shingles")
    return _extra(runs(derived, ["doc_id"], n=n), known, ["a", "b"])


def title_coverage(toc: DataFrame, derived: DataFrame) -> DataFrame:
    """(doc_id, titles, found, toc_coverage, missing): titles of four characters or more that the derived text contains; NULL without titles."""
    title = toc.select("doc_id", "ord", "title", T.normalized(F.col("title")).alias("n")).filter(F.length("n") >= 4)
    joined = title.join(derived.select("doc_id", T.normalized(F.col("text")).alias("body")), "doc_id", "left").withColumn("there", F.coalesce(F.contains("body", "n"), F.lit(False)))
    lost = F.transform(F.array_sort(F.collect_list(F.when(~F.col("there"), F.struct("ord", "title")))), lambda t: t["title"])
    return joined.groupBy("doc_id").agg(F.count("*").alias("titles"), F.count_if("there").alias("found"), lost.alias("missing")).withColumn("toc_coverage", F.col("found") / F.col("titles"))


def suspicious(c) -> Column:
    """Signs of wrongly decoded text, counted before case is folded."""
    return F.regexp_count(c, F.lit(MOJIBAKE))


def source_images(images: DataFrame) -> DataFrame:
    """(doc_id, source_images): different images of a source, told apart by xref. images(doc_id, xref, ...)."""
    return images.groupBy("doc_id").agg(F.count_distinct("xref").alias("source_images"))


def package_images(members: DataFrame) -> DataFrame:
    """(epub, derived_images): images of a package that are not its cover, by their names."""
    counted = F.count_if(F.coalesce(F.col("name").rlike(IMAGE_NAME) & ~F.contains(F.lower("name"), F.lit("cover")), F.lit(False)))
    return members.groupBy("epub").agg(counted.alias("derived_images"))


def metrics(pages: DataFrame, derived: DataFrame, toc: DataFrame, counts: DataFrame, n: int = 5) -> DataFrame:
    """One row for each document with all measures. counts(doc_id, source_images, derived_images, spine_documents). Each text is cut into shingles once."""
    there = core.stored(runs(derived, ["doc_id"], n=n), "derived-shingles")
    by_page = core.stored(_covered(pages, core.stored(runs(pages, ["doc_id", "page"], n=n), "page-shingles"), there), "pages")
    extra = _extra(there, core.stored(joined_runs(pages, ["doc_id"], n).distinct(), "source-shingles"), ["doc_id", "a", "b"])
    spans = missing_spans(by_page).filter(F.col("span") <= SPANS_KEPT).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    more = missing_spans(by_page).groupBy("doc_id").agg(F.count("*").alias("n_spans"))
    size = lambda rows, name: rows.select("doc_id", F.size(T.words(T.normalized(F.col("text")))).alias(name)).groupBy("doc_id").agg(F.sum(name).alias(name))
    titles = title_coverage(toc, derived).withColumn("missing", F.slice("missing", 1, TITLES_KEPT))
    out = text_coverage(by_page)
    for other in (spans, more, extra.select("doc_id", "extra_ratio"), titles, size(pages, "source_words"), size(derived, "derived_words"), derived.select("doc_id", suspicious(F.col("text")).alias("mojibake")), counts):
        out = out.join(other, "doc_id", "left")
    ratio = F.try_divide(F.col("derived_words"), F.col("source_words"))
    return out.fillna(0.0, ["extra_ratio"]).fillna(0, ["n_spans", "source_words", "derived_words", "mojibake", "source_images", "derived_images", "spine_documents"]).withColumn("word_ratio", F.bround(ratio, 3))


def failed(documents: DataFrame) -> DataFrame:
    """Findings for documents whose comparison could not run: documents(doc_id, error)."""
    return documents.filter("error is not null").select(F.col("doc_id").cast("string").alias("epub"), F.lit("fidelity").alias("layer"), F.lit(0).alias("ord"), F.lit("error").alias("level"), F.lit("fidelity/comparison-failed").alias("code"), F.concat(F.lit("the source cannot be compared: "), F.col("error")).alias("message"), F.lit(None).cast("string").alias("location"))


def findings(m: DataFrame) -> DataFrame:
    """Findings (epub, layer, ord, level, code, message, location) of metrics()."""
    percent = lambda c: F.concat(F.bround(F.col(c) * 100, 0).cast("int").cast("string"), F.lit("%"))
    none = F.lit(None).cast("string")
    made: list[Column] = []

    def add(order: int, when: Column, level: str, code: str, message: Column) -> None:
        made.append(F.when(when, F.array(F.struct(F.lit(order).alias("ord"), F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"), none.alias("location")))))

    add(1, F.col("text_coverage") < ERROR_BELOW, "error", "fidelity/low-text-coverage", F.concat(F.lit("text kept: "), percent("text_coverage")))
    add(2, (F.col("text_coverage") >= ERROR_BELOW) & (F.col("text_coverage") < WARN_BELOW), "warning", "fidelity/reduced-text-coverage", F.concat(F.lit("text kept: "), percent("text_coverage")))
    spans = F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))
    told = F.transform(F.slice(spans, 1, SPANS_TOLD), lambda s, i: F.struct((F.lit(3) + i).cast("int").alias("ord"), F.lit("warning").alias("level"), F.lit("fidelity/missing-span").alias("code"), F.concat(F.lit("pages "), s["first"].cast("string"), F.lit("-"), s["last"].cast("string"), F.lit(" are mostly missing")).alias("message"), none.alias("location")))
    made.append(told)
    add(30, F.col("n_spans") > SPANS_TOLD, "warning", "fidelity/missing-span", F.concat((F.col("n_spans") - SPANS_TOLD).cast("string"), F.lit(" more spans are mostly missing")))
    add(31, F.col("extra_ratio") > EXTRA_OVER, "warning", "fidelity/extra-content", F.concat(percent("extra_ratio"), F.lit(" of the text is not in the source")))
    add(32, F.col("toc_coverage") < TITLES_BELOW, "warning", "fidelity/toc-entries-missing", F.concat(F.col("found").cast("string"), F.lit("/"), F.col("titles").cast("string"), F.lit(" titles found; missing: "), F.array_join(F.slice("missing", 1, TITLES_TOLD), ", ")))
    add(33, (F.col("source_images") > 0) & (F.col("derived_images") == 0), "warning", "fidelity/images-dropped", F.concat(F.col("source_images").cast("string"), F.lit(" images in the source, none here")))
    add(34, F.col("mojibake") > 0, "warning", "fidelity/mojibake", F.concat(F.col("mojibake").cast("string"), F.lit(" signs of wrong decoding")))
    add(35, (F.col("pages") >= 50) & (F.col("spine_documents") <= 1), "warning", "fidelity/no-chapter-structure", F.concat(F.col("pages").cast("string"), F.lit(" pages in a single document")))
    empty = F.array().cast("array<struct<ord:int,level:string,code:string,message:string,location:string>>")
    all_of = F.concat(*[F.coalesce(x, empty) for x in made])
    return m.select(F.col("doc_id").cast("string").alias("epub"), F.lit("fidelity").alias("layer"), F.explode(all_of).alias("f")).select("epub", "layer", "f.*")
