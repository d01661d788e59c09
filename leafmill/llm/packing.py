"""Packing of token sequences by non-negative least squares over shallow length combinations.

A document's ids are cut into windows of the full length, a main piece of a multiple of a unit (a 64th of the window) and a
tail below it. Windows stand alone. Main pieces have lengths 1 to 63 units at any window, so combinations of up to four lengths that
fill a window exactly are enumerated; non-negative least squares finds how often each combination is used to match the
histogram of lengths; counts are rounded down. Main pieces that are left are laid one after another and cut, at units, where a sequence is full; tails that are left
are packed greedily, many equal sequences at a time. So sequences of main pieces have no padding whatever the lengths are, but for the last. The driver
sees the histogram and the plan, both of a size that only depends on the window; pieces find their sequence by their rank among pieces of the same length.

Null texts are empty: they hold the end id alone. Rows that share a doc_id are documents of their own; pieces of equal length are ranked by doc_id, start and
checksum, and rows that repeat in all of these are alike, so either may come first. Very long texts are many windows. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import core
from . import bpe

WINDOW = 4096
UNITS = 64
ROWS_A_BUCKET = 5_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, units binary"


def unit_of(window: int) -> int:
    """Lengths are told apart by units, so that their number, and with it the plan, is the same for every window."""
    return max(1, window // UNITS)


@lru_cache
def combinations(units: int, depth: int = 4) -> tuple[tuple[int, ...], ...]:
    """Falling sequences of 2 to depth parts that add up to units."""

    def parts(total: int, most: int, left: int):
        if total == 0:
            yield ()
        elif left:
            for x in range(min(total, most), 0, -1):
                if x * left < total:
                    break
                for rest in parts(total - x, x, left - 1):
                    yield (x, *rest)

    return tuple(p for p in parts(units, units - 1, depth) if len(p) > 1)


def nnls(a: np.ndarray, b: np.ndarray, most: int = 400) -> np.ndarray:
    """Lawson and Hanson's active-set method for min |a x - b|, x >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(most):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[k] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            bad = at[s <= 0]
            step = min(x[j] / (x[j] - s[i]) if x[j] > s[i] else 0 for i, j in enumerate(at) if s[i] <= 0)
            x[at] += step * (s - x[at])
            active[bad[x[bad] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, unit: int | None = None) -> list[tuple[int, int, int, int, int, int, bool]]:
    """Slots (length, first rank, end rank, first sequence, pieces of this slot in a sequence, offset, in a row).

    A piece of that length and rank r in [first, end) goes to sequence first_sequence + (r - first) // pieces,
    at offset + (r - first) % pieces * length. Of slots in a row, pieces follow each other from offset on over as many sequences as they need, each filled with whole units.
    """
    unit = unit or unit_of(window)
    units = window // unit
    left = {k: v for k, v in sorted(histogram.items(), reverse=True) if v > 0 and k > 0}
    ranks = dict.fromkeys(left, 0)
    slots, sequence = [], 0

    def use(pattern: list[tuple[int, int]], times: int) -> None:
        """pattern: (length, pieces in a sequence)."""
        nonlocal sequence
        offset = 0
        for length, pieces in pattern:
            slots.append((length, ranks[length], ranks[length] + times * pieces, sequence, pieces, offset, False))
            ranks[length] += times * pieces
            left[length] -= times * pieces
            offset += length * pieces
        sequence += times

    if left.get(window):
        use([(window, 1)], left[window])
    have = [u for u in range(1, units) if left.get(u * unit)]
    if have:
        row = {u: i for i, u in enumerate(have)}
        shapes = [p for p in combinations(units) if all(u in row for u in p)]
        if shapes:
            a = np.zeros((len(have), len(shapes)))
            for j, p in enumerate(shapes):
                for u in p:
                    a[row[u], j] += 1
            x = nnls(a, np.array([left[u * unit] for u in have], float))
            for j in np.argsort(-x):
                need = {u * unit: shapes[j].count(u) for u in dict.fromkeys(shapes[j])}
                if (times := min(int(x[j] + 1e-6), *(left[k] // c for k, c in need.items()))) > 0:
                    use(list(need.items()), times)
    # main pieces that are left, in a row
    room, at = units * unit, 0
    for length in [k for k in left if k % unit == 0 and left[k]]:
        slots.append((length, ranks[length], ranks[length] + left[length], sequence, 1, at, True))
        at += length * left[length]
        ranks[length] += left[length]
        left[length] = 0
    sequence += -(-at // room)
    # tails that are left, the longest first, as many equal sequences at once as there are pieces for
    while any(left.values()):
        room, pattern = window, []
        for length in left:
            if (c := min(left[length], room // length)) > 0:
                pattern.append((length, c))
                room -= c * length
        use(pattern, min(left[k] // c for k, c in pattern))
    return slots


def joined_crc(units: bytes, first: int, end: int, unit: int) -> int:
    """The crc32 of the units first to end, from the crc32 of each: to go over a unit is linear, so a unit of zeros does it."""
    zeros = bytes(4 * unit)
    base, crc = zlib.crc32(zeros), 0
    for own in np.frombuffer(units, "<u4")[first:end].tolist():
        crc = zlib.crc32(zeros, crc) ^ base ^ own
    return crc


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, window: int = WINDOW, unit: int | None = None) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, and of main pieces the crc32 of each unit."""
    core.bounded_batches(docs.sparkSession)
    unit = unit or unit_of(window)

    def cut(batches):
        coder = bpe.encoder(bpe.vocabulary(vocabulary))
        for batch in core.released(batches):
            row = 0
            for ids, n in coder.encode(batch["text"]):
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                size = n + 1
                full, rest = size // window, size % window
                main, tail = rest // unit * unit, rest % unit
                count = full + (main > 0) + (tail > 0)
                doc = np.repeat(np.arange(len(n)), count)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = np.minimum(k, full[doc]) * window + np.where(k > full[doc], main[doc], 0)
                length = np.where(k < full[doc], window, np.where((k == full[doc]) & (main[doc] > 0), main[doc], tail[doc]))
                raw = memoryview(ids.tobytes())
                at = 4 * ((np.cumsum(size) - size)[doc] + start)
                crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(at.tolist(), (4 * length).tolist(), strict=True)]
                # of main pieces also each unit's, as they may be cut
                own = (length < window) & (length % unit == 0)
                by_unit = [np.array([zlib.crc32(raw[k : k + 4 * unit]) for k in range(a, a + b, 4 * unit)], "<u4").tobytes() if o else None for a, b, o in zip(at.tolist(), (4 * length).tolist(), own.tolist(), strict=True)]
                names = batch["doc_id"].slice(row, len(n)).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([names, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[doc]), pa.array(by_unit, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "units"])
                row += len(n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, window: int = WINDOW, unit: int | None = None) -> DataFrame:
    """Pieces with their sequence_id and offset. Every id lies in one piece; a sequence has no gaps."""
    spark = docs.sparkSession
    cut = core.stored(pieces(docs, vocabulary, end_id, window, unit), "pieces")
    rows = cut.count()
    buckets = max(1, rows // ROWS_A_BUCKET)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = core.stored(counts, "piece-counts")
    slots = plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, window, unit)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    # a length and bucket hold about ROWS_A_BUCKET rows at most, as buckets are drawn by hash
    ranked = dealt.withColumn("at", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("at") + F.col("before"))
    plan_rows = spark.createDataFrame([(*map(int, x[:6]), bool(x[6])) for x in slots], "length long, low long, high long, seq long, per long, base long, row boolean")
    # the plan has a few hundred rows, by its construction from at most 127 lengths
    placed = ranked.join(F.broadcast(plan_rows), (ranked["length"] == plan_rows["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(plan_rows["length"])
    step = unit or unit_of(window)
    room = window // step * step
    within = F.col("rank") - F.col("low")
    along = F.col("base") + within * F.col("length")
    placed = placed.withColumn("sequence", F.when(F.col("row"), F.col("seq") + F.floor(along / room)).otherwise(F.col("seq") + F.floor(within / F.col("per"))).cast("long"))
    placed = placed.withColumn("place", F.when(F.col("row"), along % room).otherwise(F.col("base") + within % F.col("per") * F.col("length")).cast("long"))
    # of pieces in a row, those over a sequence's end are two pieces
    first = F.when(F.col("row"), F.least("length", room - F.col("place"))).otherwise(F.col("length"))
    nothing = F.lit(0).cast("long")
    one = F.struct(nothing.alias("skip"), first.alias("size"), F.col("sequence").alias("seq"), F.col("place").alias("at"))
    two = F.struct(first.alias("skip"), (F.col("length") - first).alias("size"), (F.col("sequence") + 1).alias("seq"), nothing.alias("at"))
    cut = first < F.col("length")
    rows = placed.select("doc_id", "start", "ids_crc32", "doc_tokens", F.when(cut, F.col("units")).alias("units"), F.explode(F.when(cut, F.array(one, two)).otherwise(F.array(one))).alias("p"))

    @F.pandas_udf("long")
    def crc_of(units, skip, size):
        import pandas as pd

        return pd.Series([None if u is None else joined_crc(u, a // step, (a + n) // step, step) for u, a, n in zip(units, skip, size, strict=True)], dtype="Int64")

    return rows.select("doc_id", (F.col("start") + F.col("p.skip")).alias("start"), F.col("p.size").alias("length"), F.coalesce(crc_of("units", "p.skip", "p.size"), "ids_crc32").alias("ids_crc32"), "doc_tokens", F.col("p.seq").alias("sequence_id"), F.col("p.at").alias("offset"))
