"""Homomorphic multiset hash of documents.

A text is a multiset of paragraphs: lines, cut further after sentence ends and every LONGEST bytes. Each paragraph is hashed to a wide
vector, and a document's fingerprint is the sum of its paragraphs' vectors modulo powers of two. So paragraphs can be added and taken away
without the rest of the text, and the order of paragraphs does not matter.

The vector has two parts. Four 64-bit lanes are dense and decide equality. LEVELS x LANES 8-bit lanes are sparse: a paragraph has one
non-zero lane, on level k for a share 2^-(k+1) of all paragraphs. Lanes that differ between two sums estimate how many paragraphs
differ, and with both counts the Jaccard likeness. The top level has a share of 2^-31, so it is not full for any two texts that a row can
hold. A paragraph that one text has many times more than the other changes one lane only, so
likeness is told too high where lines repeat (its bound is the difference of the counts). Written out, levels above the last one with a non-zero lane are left out. The last 32 bits count paragraphs.

Null texts are empty texts; these have no paragraph and the zero fingerprint. Rows are ordered by descending doc_id, null last, rows of one
doc_id by text. Equal texts have equal fingerprints. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import core

LONGEST = 200
DENSE, LEVELS, LANES = 4, 32, 32
#: Estimated paragraphs on a level by its lanes that differ, as far as a level is used.
_APART = [-LANES * float(np.log1p(-k / LANES)) for k in range(LANES) if k < 0.8 * LANES]
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in " \t\n\r"]] = True


def cuts(text: bytes) -> np.ndarray:
    """Ends of the paragraphs of a text. Whether a place is an end only depends on the text since the end before it, and the byte after it."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    mark = b == 10
    mark[:-1] |= _END[b[:-1]] & _GAP[b[1:]]
    mark[-1] = True
    ends = np.flatnonzero(mark) + 1
    size = np.diff(ends, prepend=0)
    if size.max() > LONGEST:
        count = (size - 1) // LONGEST + 1
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        ends = np.minimum(np.repeat(ends - size, count) + k * LONGEST, np.repeat(ends, count))
    return ends


def vectors(text: bytes, ends: np.ndarray) -> np.ndarray:
    """48 hash bytes of each paragraph."""
    h, a, out = hashlib.blake2b, 0, []
    for e in ends.tolist():
        out.append(h(text[a:e], digest_size=48).digest())
        a = e
    return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 6)


class Sum:
    """A fingerprint that paragraphs are added to and taken from."""

    __slots__ = ("count", "dense", "sparse")

    def __init__(self, dense=None, sparse=None, count: int = 0):
        self.dense = np.zeros(DENSE, np.uint64) if dense is None else dense
        self.sparse = np.zeros(LEVELS * LANES, np.uint8) if sparse is None else sparse
        self.count = count

    def plus(self, v: np.ndarray, sign: int = 1) -> Sum:
        """The fingerprint with the paragraphs of v added, or taken away."""
        if not len(v):
            return self
        with np.errstate(over="ignore"):
            total = v[:, :DENSE].sum(0, dtype=np.uint64)
            low = v[:, DENSE]
            level = np.minimum(np.log2((low & (~low + np.uint64(1))).astype(np.float64) + (low == 0) * 2.0**63).astype(np.int64), LEVELS - 1)
            lane = level * LANES + (v[:, DENSE + 1] & np.uint64(LANES - 1)).astype(np.int64)
            value = ((v[:, DENSE + 1] >> np.uint64(8)) & np.uint64(0xFF)) | np.uint64(1)
            add = np.bincount(lane, value.astype(np.float64), LEVELS * LANES).astype(np.int64).astype(np.uint8)
            return Sum(self.dense + total, self.sparse + add, self.count + len(v)) if sign > 0 else Sum(self.dense - total, self.sparse - add, self.count - len(v))

    def hex(self) -> str:
        used = np.flatnonzero(self.sparse)
        levels = int(used[-1]) // LANES + 1 if len(used) else 0
        return (self.dense.astype("<u8").tobytes() + self.sparse[: levels * LANES].tobytes() + self.count.to_bytes(4, "little")).hex()


def from_hex(text: str) -> Sum:
    raw = bytes.fromhex(text)
    sparse = np.zeros(LEVELS * LANES, np.uint8)
    sparse[: len(raw) - 8 * DENSE - 4] = np.frombuffer(raw[8 * DENSE : -4], np.uint8)
    return Sum(np.frombuffer(raw, "<u8", DENSE).astype(np.uint64), sparse, int.from_bytes(raw[-4:], "little"))


def likeness(a: Sum, b: Sum) -> float:
    """Estimated Jaccard likeness of two multisets of paragraphs: 1 for equal ones."""
    if a.count == b.count and (a.dense == b.dense).all():
        return 1.0
    total = a.count + b.count
    off = (a.sparse != b.sparse).reshape(LEVELS, LANES).sum(1).tolist()
    apart, k = 0.0, LEVELS - 1
    while k >= 0 and off[k] < len(_APART):
        apart += _APART[off[k]]
        k -= 1
    apart = min(max(apart * 2 ** (k + 1), abs(a.count - b.count), 1), total)
    return (total - apart) / (total + apart)


def fingerprint(text: str) -> Sum:
    raw = text.encode()
    return Sum().plus(vectors(raw, cuts(raw)))


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


class _Row:
    """A document, its paragraphs' vectors and its fingerprint."""

    __slots__ = ("doc_id", "ends", "raw", "sum", "text", "vec")

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text, self.raw = doc_id, text, text.encode()
        self.ends = cuts(self.raw)
        self.vec = vectors(self.raw, self.ends)
        self.sum = Sum().plus(self.vec)

    def edited(self, following: str) -> tuple[bytes, Sum]:
        """The text whose last third is replaced, and its fingerprint: only paragraphs at and after the edit are taken away and added."""
        n = len(self.text)
        take = n // 3
        head = self.text[: n - take].encode()
        raw = head + following[:take].encode()
        # paragraphs that end before the last byte of the head do not see the edit
        same = int(np.searchsorted(self.ends, len(head) - 1, "right")) if take else len(self.ends)
        start = int(self.ends[same - 1]) if same else 0
        rest = raw[start:]
        return raw, self.sum.plus(self.vec[same:], -1).plus(vectors(rest, cuts(rest)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document the columns of OUT; near_next compares with the next document by descending doc_id (after the last, the first)."""
    spark = docs.sparkSession
    core.bounded_batches(spark, 500)
    least = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = 4 * core.shuffle_partitions(spark)
    bounds = np.unique(np.array(rows.select("doc_id").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges), np.float64)) if ranges > 1 else np.zeros(0)

    @F.pandas_udf("int")
    def range_of(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.float64), "right").astype(np.int32))

    dealt = rows.withColumn("range", range_of("doc_id"))
    # The first document of each range also goes, as the last row, to the range before it: a row for each range.
    tops = sorted(((r[0], r[1]) for r in rows.select("doc_id").withColumn("range", range_of("doc_id")).groupBy("range").agg(F.max("doc_id")).collect()), reverse=True)
    if not tops:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {top: tops[k - 1][0] for k, (_, top) in enumerate(tops)}
    firsts = rows.filter(F.col("doc_id").isin(list(before))).groupBy("doc_id").agg(F.min("text").alias("text"))
    firsts = firsts.withColumn("range", F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("doc_id")))
    both = dealt.withColumn("extra", F.lit(0)).unionByName(firsts.withColumn("extra", F.lit(1)))
    both = both.repartition(core.shuffle_partitions(spark), "range").sortWithinPartitions("range", "extra", F.desc("doc_id"), "text")

    def run(batches):
        held: _Row | None = None
        for batch in core.released(batches):
            out: list[tuple] = []
            for doc_id, text, extra in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["extra"].to_pylist(), strict=True):
                row = _Row(doc_id, text)
                if held is not None:
                    raw, changed = held.edited(text)
                    out.append((None if held.doc_id == least else held.doc_id, len(held.text), hashlib.sha256(raw).hexdigest(), held.sum.hex(), changed.hex(), likeness(held.sum, changed), likeness(held.sum, row.sum)))
                held = None if extra else row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), OUT, strict=True)], schema=OUT)

    return both.select("doc_id", "text", "extra").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
