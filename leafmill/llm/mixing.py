"""Mixing of sources to target weights by Pareto order sampling.

Targets. Each source has a weight; targets are proportional to weights, but stop at ``most`` times the source's size, and what is cut off is
shared again by weight. That is min(most * size, weight * level) for the one level at which targets add up; the level is
found by sums over sources, so sources are never gathered in one place.

Expected copies. Within a source, a document is expected min(most, favour * level) times, where ``favour`` grows with its words (their fourth root, unless told
otherwise) and the source's level makes the expected words equal to its target. Whole copies are certain; the fraction p, another one for each length, is drawn.

Sampling. Documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken from the least rank on until the source's words are
reached: a sample of fixed size, in words. The rank at which that happens is found by counting words in ever finer cells of ranks, so a source is never sorted,
and documents are not moved: each is judged against its source's border. The document at the border is taken whole or left where that brings the source within
``near`` of its target; else (in small sources) it gives its first words. u depends on the row and the seed alone, so reruns agree.

A null text has size 0; null sources are one source, last in order. Rows that repeat in doc_id, text and source have equal ranks; at the border as many of them as are
needed are taken. A source of size 0 has target 0 and is not taken. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import core, joins

WEIGHTS = (5, 2, 1)
NEAR = 0.01
CELLS, ROWS_A_CELL, ROWS_SORTED = 4096, 500, 2000


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def by_length(size: Column) -> Column:
    """The fourth root of a document's words: long ones are favoured, mildly. Square roots are exact, so every machine agrees."""
    return F.sqrt(F.sqrt(size + F.lit(1.0)))


def ranked(df: DataFrame, key: str) -> DataFrame:
    """Adds ``rank``, from 0, by ``key`` ascending with null last. Ranges are ranked apart; one count for each comes to the driver."""
    n = core.shuffle_partitions(df.sparkSession)
    order = F.col(key).asc_nulls_last()
    dealt = core.stored(df.repartitionByRange(n, order).withColumn("range", F.spark_partition_id()), "ranges")
    before, total = [], 0
    for r, count in sorted((x[0], x[1]) for x in dealt.groupBy("range").count().collect()):
        before += [F.lit(r), F.lit(total)]
        total += count
    offsets = F.create_map(*before) if before else F.create_map(F.lit(0), F.lit(0))
    return dealt.withColumn("rank", F.element_at(offsets, F.col("range")) + F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1).drop("range")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: (source, source_size, ...). Adds ``target``."""
    rows = ranked(sizes, "source").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    rows = core.stored(rows.withColumn("cap", most * F.col("source_size")), "sources")
    wanted = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = F.col("cap") <= F.col("weight") * level
        cut, n, open_weight = rows.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(above.cast("int")), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n is None or n == full or not open_weight:
            break
        level, full = (wanted - cut) / open_weight, n
    return rows.withColumn("target", F.least("cap", F.col("weight") * F.lit(float(level)))).drop("rank", "cap", "weight")


def _key() -> Column:
    """Sources as texts without null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _mark() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _odds(rows: DataFrame, most: float, seed: int, favour: Callable[[Column], Column]) -> DataFrame:
    """rows (doc_id, size, mark, target, level, ...) with ``expected`` copies, ``whole`` ones, the fraction p and the ``place`` of its rank in (0, 1), null without a fraction."""
    rows = rows.withColumn("expected", F.when(F.col("level").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.col("level") * favour(F.col("size")))))
    rows = rows.withColumn("whole", F.floor("expected").cast("long"))
    # 52 bits of a hash of the row: u is inside (0, 1)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("mark")), 12) + 0.5) / float(1 << 52)
    rows = rows.withColumn("p", F.col("expected") - F.col("whole")).withColumn("u", u)
    low, high = F.col("u") * (1 - F.col("p")), F.col("p") * (1 - F.col("u"))  # their ratio is random odds over inclusion odds
    return rows.withColumn("place", F.when(F.col("p") > 0, low / (low + high)))


def _levels(base: DataFrame, sizes: DataFrame, most: float, favour: Callable[[Column], Column]) -> DataFrame:
    """sizes with ``level``, null where every document is expected ``most`` times. Sums run over a source's different lengths, the longest first."""
    lengths = base.groupBy("key", "size").agg(F.count("*").alias("n")).filter("size > 0").withColumn("favour", favour(F.col("size"))).withColumn("words", F.col("size") * F.col("n"))
    lengths = lengths.join(sizes.select("key", "target"), "key")
    order = Window.partitionBy("key").orderBy(F.desc("favour"), F.desc("size"))
    full = F.coalesce(F.sum(most * F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("favour") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = lengths.withColumn("level", (F.col("target") - full) / rest).filter(F.col("level") * F.col("favour") < most)
    levels = levels.groupBy("key").agg(F.max_by("level", F.struct("favour", "size")).alias("level"))
    # a source without words has target 0
    return sizes.join(levels, "key", "left").withColumn("level", F.when(F.col("source_size") > 0, F.col("level")).otherwise(0.0))


def _borders(odds: DataFrame, plan: DataFrame, near: float) -> DataFrame:
    """plan with the border of each source: its ``place``, doc_id and mark, how many such rows are taken, and how many words of one more (0: none). Null where all are taken."""
    sums = odds.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.sum(F.when(F.col("place").isNotNull(), F.col("size")).otherwise(0)).alias("drawable"), F.count("place").alias("rows"))
    goal = plan.select("key", "target").join(sums, "key").withColumn("missing", F.col("target") - F.col("certain"))
    goal = goal.filter(F.col("missing") < F.col("drawable")).select("key", "target", "missing", F.lit(0.0).alias("low"), F.lit(1 + 2**-50).alias("high"), F.lit(0).cast("long").alias("before"), "rows")
    goal = core.stored(goal, "borders")
    drawable = odds.filter("place is not null").select("key", "place", "doc_id", "mark", "size")
    rows = None
    while True:
        now = goal.agg(F.max("rows")).first()[0]
        if now is None or now <= ROWS_SORTED or now == rows:
            break
        rows = now
        cells = goal.withColumn("cells", F.greatest(F.lit(1), F.least(F.lit(CELLS), F.ceil(F.col("rows") / ROWS_A_CELL))))
        own = joins.looked_up(drawable, core.stored(cells, "cells"), "key").filter("place >= low and place < high")
        own = own.withColumn("cell", F.least(F.col("cells") - 1, F.floor((F.col("place") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("cells"))))
        by = own.groupBy("key", "cell").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.first("before").alias("start"), F.first("missing").alias("missing"), F.first("target").alias("target"))
        until = F.col("start") + F.sum("words").over(Window.partitionBy("key").orderBy("cell"))
        by = by.withColumn("until", until).filter("until > missing").groupBy("key").agg(F.min_by(F.struct("target", "missing", "first", "last", "until", "words", "n"), "cell").alias("c"))
        # cells end just after the last of their documents, so a cell of equal places cannot be cut further
        goal = core.stored(by.select("key", "c.target", "c.missing", F.col("c.first").alias("low"), (F.col("c.last") * (1 + 2**-50)).alias("high"), (F.col("c.until") - F.col("c.words")).cast("long").alias("before"), F.col("c.n").alias("rows")), "borders")
    last = joins.looked_up(drawable, goal, "key").filter("place >= low and place < high").groupBy("key", "place", "doc_id", "mark", "size").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("missing").alias("missing"), F.first("target").alias("target"))
    order = Window.partitionBy("key").orderBy("place", "doc_id", "mark")
    last = last.withColumn("until", F.col("before") + F.sum(F.col("size") * F.col("n")).over(order)).filter("until > missing")
    last = last.groupBy("key").agg(F.min_by(F.struct("place", "doc_id", "mark", "size", "n", "until", "missing", "target"), F.struct("place", "doc_id", "mark")).alias("b")).select("key", "b.*")
    left = F.col("missing") - (F.col("until") - F.col("size") * F.col("n"))
    last = last.withColumn("taken", F.floor(left / F.col("size")).cast("long")).withColumn("left", left - F.col("taken") * F.col("size")).withColumn("over", F.col("size") - F.col("left"))
    whole = (F.col("over") <= near * F.col("target")) & ((F.col("over") <= F.col("left")) | (F.col("left") > near * F.col("target")))
    cut = F.when(whole | (F.col("left") <= near * F.col("target")), 0).otherwise(F.floor(F.col("left") + 1e-6)).cast("long")
    last = last.select("key", F.struct("place", "doc_id", "mark").alias("border"), (F.col("taken") + whole.cast("long")).alias("at_border"), cut.alias("border_words"), F.col("n").alias("border_rows"))
    return plan.join(last, "key", "left")


def _plan(docs: DataFrame, weights: tuple, share: float, most: float, seed: int, near: float, favour: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Documents (key, doc_id, source, size, mark), and for each key its target, level and border."""
    base = core.stored(docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in("text").alias("size"), _mark().alias("mark")), "sizes")
    sizes = base.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sizes = core.stored(targets(sizes, weights, share, most), "targets")
    plan = core.stored(_levels(base, sizes, most, favour), "levels")
    odds = _odds(joins.looked_up(base, plan.select("key", "target", "level"), "key"), most, seed, favour)
    odds = core.stored(odds.select("key", "doc_id", "mark", "size", "whole", "place"), "odds")
    return base, core.stored(_borders(odds, plan, near).drop("source"), "plan")


def _decided(rows: DataFrame, plan: DataFrame, most: float, seed: int, favour: Callable[[Column], Column]) -> DataFrame:
    """rows (key, doc_id, size, mark, ...) with ``copies``, the words of a ``cut`` copy, source_size, target and expected copies."""
    found = _odds(joins.looked_up(rows, plan, "key"), most, seed, favour)
    me = F.struct("place", "doc_id", "mark")
    side = F.when(F.col("place").isNull(), 1).when(F.col("border").isNull(), -1).when(me.eqNullSafe(F.col("border")), 0).when(me < F.col("border"), -1).otherwise(1)
    found = found.withColumn("side", side)
    here = F.col("side") == 0

    def taken(some: DataFrame, n: Column) -> DataFrame:
        """n: the number, from 1, of a row at the border among its like."""
        drawn = (F.col("side") < 0) | (here & (n <= F.col("at_border")))
        return some.withColumn("copies", F.col("whole") + drawn.cast("long")).withColumn("cut", F.when(here & (n == F.col("at_border") + 1), F.col("border_words")).otherwise(0).cast("long"))

    if plan.filter("border_rows > 1").isEmpty():
        return taken(found, F.lit(1))
    # rows that repeat at a border are numbered; there are as many as rows of one doc_id, text and source
    numbered = found.filter(here).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("place")))
    return taken(found.filter(~here), F.lit(1)).unionByName(taken(numbered, F.col("n")).drop("n"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, near: float = NEAR, favour: Callable[[Column], Column] = by_length) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, expected copies, whole copies, words of a cut copy, words taken in all."""
    base, plan = _plan(docs, weights, share, most, seed, near, favour)
    found = _decided(base, plan, most, seed, favour)
    return found.select("doc_id", "source", "size", "source_size", "target", "expected", "copies", "cut", (F.col("copies") * F.col("size") + F.col("cut")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, near: float = NEAR, favour: Callable[[Column], Column] = by_length) -> DataFrame:
    """``docs``, each row as often as the mix takes it; a cut copy has its first words, with single spaces. Texts are not moved: only sources' borders are brought to them."""
    _, plan = _plan(docs, weights, share, most, seed, near, favour)
    rows = docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), words_in("text").alias("size"), _mark().alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = _decided(rows, plan, most, seed, favour).select("row", "copies", "cut")
    copies = F.concat(F.when(F.col("copies") > 0, F.array_repeat(F.lit(-1).cast("long"), F.col("copies").cast("int"))).otherwise(F.array().cast("array<long>")), F.when(F.col("cut") > 0, F.array("cut")).otherwise(F.array().cast("array<long>")))
    # explode() would have Spark filter empty lists first, and for that count the words of every text again
    taken = found.select("row", F.explode_outer(copies).alias("take")).filter("take is not null")
    words = F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, F.greatest(F.col("take"), F.lit(0)).cast("int")), " ")
    whole = F.col("take") < 0
    changed = {"text": F.when(whole, F.col("row.text")).otherwise(cut)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType))
    return taken.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
