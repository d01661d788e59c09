"""N-gram Jaccard join on a token-group matrix: documents linked at 100 * intersection >= PERCENT * union.

Sets. A document's tokens are 64-bit hashes of its distinct word n-grams; equal sets are one node, named by a
128-bit digest of its tokens.

Groups. Two sets of at most L tokens that link differ in at most d = 2L(1-t)/(1+t) tokens. Tokens are dealt to
d + 1 + slack + late + more parts by hash, so linked sets have slack + late + more + 1 equal parts. A set leaves out up to ``slack`` of its
smallest parts, then the ``late`` most frequent of the rest, ties by fingerprint. Both orders are of fingerprints, the same for
all sets: of the equal parts, two sets together leave out at most slack in the first step and late in the second, and more + 1 are left.
So passages that many documents share make no candidates unless they fill most of a document.
Nodes that share the fingerprint of a part are similar; each node joins the group of its most shared part, and groups are split
by hash, by their number of members, into blocks of bounded size. Each block also holds the group's leader, so blocks of one
group meet in the leader's component.

Matrix. Every block is compared inside. What is linked between blocks goes through two sieves. Linked sets that leave out their ``more`` next frequent parts too
still share a part; nodes that share none with another block's in a different component are done. The tokens of the others are counted, and each set keeps
the rarest of them: sets that link have PERCENT of the larger one's tokens in common, so each can leave out one token fewer than PERCENT of its own, the
most frequent, and a common one is left. Any order that is the same for all sets will do: tokens that tasks find frequent come first and are known to every task, so they are
left out where the sets are and not moved. Only blocks of different components that share such a token are compared: the overlap of each query set with the
other block's token union bounds its Jaccard similarity with every member, and the block is opened for the queries that this bound lets through.

No pair that links is lost at any threshold, and no list of pairs of a group of documents is ever made. Texts that have lines in common and enough words of their own
are not paired; blocks that share one of their rarest tokens in different components are, and those pairs grow with the square of the blocks of one token. Fingerprints, nodes and components that hold a large share of all rows are split. Lineage is cut by tables in the shared folder, which go
when nothing needs them any more. Sets travel as compressed texts, of which the copies in a block cost little, and tokens are made again where they are
compared: 64-bit tokens do not compress.

Null and blank texts have an empty set, n_shingles 0, and are linked with nothing; their component_id is their own doc_id.
Rows that repeat a doc_id are documents of their own; null doc_ids never become a component_id while another is there. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import core, joins
from . import words

PERCENT = 90
RATIO = 1.37  # least ratio of the upper sizes of two classes
WEAK = 3  # parts of fewer tokens say little; sets leave them, or the smallest of them, out as far as their slack goes
BLOCK_SETS, BLOCK_TOKENS = 128, 1 << 18
FLUSH = 1 << 19
BITS = 1 << 24
REGROUPED = 2  # rounds in which groups join the group that most of them share a fingerprint with
FREQUENT, SPREAD = 512, 32  # a fingerprint that a task meets more often than this goes to so many rows of its range
KNOWN = 1 << 16  # frequent tokens that every task knows; others are counted like rare ones
BLOCKS_A_TASK = 64  # blocks of one fingerprint that a task pairs with all others of it
OPEN_BLOCKS = 8  # blocks whose token sets a task keeps while it compares pairs
_MARK = 1 << 47  # above the key of a node: its fingerprint is frequent
_K = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def token_sets(texts: pa.Array, n: int = 3):
    """Yields, in row order, the sorted distinct tokens of each text."""
    data, offsets = words.buffers(texts)
    for i, j in words.chunks(offsets):
        _, _, _, names, first = words.scan(data, offsets, i, j)
        with np.errstate(over="ignore"):
            if len(names) >= n:
                grams = names[: len(names) - n + 1] * _K[0]
                for k in range(1, n):
                    grams = words.mix(grams) + names[k : len(names) - n + 1 + k] * _K[k % 4]
                grams = words.mix(grams)
            else:
                grams = names[:0]
            for r in range(j - i):
                a, b = int(first[r]), int(first[r + 1])
                if b - a >= n:
                    yield np.unique(grams[a : b - n + 1])
                elif b > a:
                    short = _K[4] * np.uint64(b - a)
                    for x in names[a:b]:
                        short = words.mix(np.atleast_1d(short + x * _K[1]))
                    yield np.atleast_1d(short)
                else:
                    yield names[:0]


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _key(node: bytes) -> int:
    """The short name of a node, by which it is looked up before its full name is compared."""
    return int.from_bytes(node[:6], "little") & (_MARK - 1)


@lru_cache
def _classes(percent: int) -> tuple[np.ndarray, tuple]:
    """Upper sizes of the classes, and for each class the most tokens in which two linked sets differ. Linked sets lie in one class or in two that follow each other."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is a whole number from 1 to 100")
    tops = [0]
    while tops[-1] < 1 << 31:
        tops.append(max(tops[-1] + 1, -int(-tops[-1] * RATIO // 1), -(-100 * tops[-1] // percent)))
    tops = np.array(tops[1:])
    return tops, tuple(int(2 * t * (100 - percent) // (100 + percent)) for t in tops)


_parts: dict[tuple[int, int], tuple] = {}


def _spare(c: int, percent: int) -> tuple[int, int, int]:
    """How many parts a set of class c leaves out: of its smallest, and of its most frequent. Then how many equal parts more than one linked sets have left."""
    tops, most = _classes(percent)
    slack = 2 if tops[c] >= 60 else 0
    if 6 * most[c] > tops[c]:  # many small parts: more of them must be equal, so that more weak ones can be left out
        slack = max(slack, most[c] // 4)
    late = (most[c] + 3) // 4
    return slack, late - late // 2, late // 2


def _class_parts(c: int, percent: int):
    if (c, percent) not in _parts:
        slack, late, more = _spare(c, percent)
        m = _classes(percent)[1][c] + 1 + slack + late + more
        bounds = (((np.arange(1, m, dtype=np.uint64) << np.uint64(32)) + np.uint64(m - 1)) // np.uint64(m)) << np.uint64(32)
        _parts[c, percent] = bounds, words.mix(np.arange(m, dtype=np.uint64) + np.uint64(c << 32) + np.uint64(percent << 52)), slack
    return _parts[c, percent]


def part_names(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Fingerprints of the parts of one set, for its size class and, near the top, for the next. The low 7 bits are the class."""
    tops, _ = _classes(percent)
    size = len(tokens)
    c = int(np.searchsorted(tops, size))
    out = []
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(tokens ^ _K[2]))])
        for k in (c, c + 1):
            if k > c and 100 * size < percent * (int(tops[c]) + 1):
                break
            bounds, names, slack = _class_parts(k, percent)
            cuts = np.concatenate([[0], np.searchsorted(tokens, bounds), [size]])
            count = np.diff(cuts)
            sig = words.mix((sums[cuts[1:]] - sums[cuts[:-1]]) + names + count.astype(np.uint64) * _K[3])
            # of two linked sets, the one that leaves out larger parts keeps all but slack of the equal ones, and so does the other
            least = next(w for w in range(WEAK, -1, -1) if (count < w).sum() <= slack)
            sig = sig[count >= least]
            out.append((sig & ~np.uint64(127)) | np.uint64(k))
    return np.concatenate(out)


def overlaps(a: list[np.ndarray], b: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of two lists of sets that count in ``shared``, by products of 0/1 blocks of tokens."""
    out = np.zeros((len(a), len(b)))

    def places(sets):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        at = np.searchsorted(shared, flat)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == flat[ok]
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok], at[ok]

    (ra, ca), (rb, cb) = places(a), places(b)
    step = 1 << 14
    for k in range(0, len(shared), step):
        x, y = (np.zeros((len(s), min(step, len(shared) - k)), np.float32) for s in (a, b))
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            ok = (c >= k) & (c < k + step)
            m[r[ok], c[ok] - k] = 1
        out += x @ y.T
    return out


def _linked(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (na[:, None] + nb[None, :] - inter)


def _union(sets: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)


@lru_cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def squeezed(texts: list[bytes]) -> bytes:
    return _zstd()[0].compress(b"".join(texts))


def token_sets_of(lengths: list[int], packed: bytes, n: int, take: list[int] | None = None) -> list[np.ndarray]:
    """The token sets of texts that squeezed() made one, or of those at ``take``."""
    data = _zstd()[1].decompress(packed)
    cuts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return list(token_sets(pa.array([data[cuts[i] : cuts[i + 1]] for i in (range(len(lengths)) if take is None else take)], pa.binary()), n))


def _home(table: pa.Table, n: int, percent: int) -> pa.Table:
    """Links inside one block: a row for the block with its nodes, their component labels and texts."""
    lead = table["lead"][0].as_py()
    seen: dict[bytes, bytes] = {}
    keys: dict[bytes, int] = {}
    home: dict[bytes, bool] = {}
    for node, key, text, at_home in zip(table["node"].to_pylist(), table["key"].to_pylist(), table["packed"].to_pylist(), table["home"].to_pylist(), strict=True):
        seen[node], keys[node], home[node] = text, key, at_home or home.get(node, False)
    nodes = sorted(seen)
    texts = [_zstd()[1].decompress(seen[x]) for x in nodes]
    sets = list(token_sets(pa.array(texts, pa.binary()), n))
    flat, counts = np.unique(np.concatenate(sets), return_counts=True)
    sizes = np.array([len(s) for s in sets])
    link = _linked(overlaps(sets, sets, flat[counts > 1]), sizes, sizes, percent)
    label = np.arange(len(nodes))
    while True:  # least label among neighbours, then of that label
        new = np.where(link | np.eye(len(nodes), dtype=bool), label[None, :], len(nodes)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    leaders = [i for i, x in enumerate(nodes) if keys[x] == lead]
    for i in leaders[:1]:
        label[label == label[i]] = i
    own = [i for i, x in enumerate(nodes) if home[x]]
    row = {
        "nodes": [[nodes[i] for i in own]], "keys": [[keys[nodes[i]] for i in own]], "labels": [[nodes[label[i]] for i in own]],
        "lengths": [[len(texts[i]) for i in own]], "packed": [squeezed([texts[i] for i in own])],
    }
    if len(flat) > BLOCK_TOKENS // 4:
        core.release()
    return pa.table(row, BLOCK)


BLOCK = pa.schema([("nodes", pa.list_(pa.binary())), ("keys", pa.list_(pa.int64())), ("labels", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int64())), ("packed", pa.binary())])
BLOCK_DDL = "nodes array<binary>, keys array<long>, labels array<binary>, lengths array<long>, packed binary"


def compare_blocks(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Links between the sets of two blocks. Only queries whose overlap with b's union can reach the threshold open b."""
    na, nb = (np.array([len(s) for s in x]) for x in (a, b))
    union = _union(b)
    flat = np.concatenate(a)
    at = np.minimum(np.searchsorted(union, flat), len(union) - 1)
    bound = np.bincount(np.repeat(np.arange(len(a)), na), union[at] == flat, len(a))
    # a link needs an overlap of percent/100 of the larger set
    queries = np.flatnonzero(100 * bound >= percent * np.maximum(na, nb.min()))
    out = np.zeros((len(a), len(b)), bool)
    if len(queries):
        shared = np.intersect1d(_union([a[i] for i in queries]), union, assume_unique=True)
        out[queries] = _linked(overlaps([a[i] for i in queries], b, shared), na[queries], nb, percent)
    return out


def connected(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, root) of every node in edges (u, v): the least node that is reachable. Labels move to neighbours and jump along labels, each round stored.

    Neither the edges of a hub nor the members of a large component meet in one task: see joins.looked_up.
    """
    both = core.stored(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{what}-edges")
    labels = core.stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")), what)
    hubs = joins.frequent_keys(both, "v")
    while True:
        near = joins.looked_up(both, labels.select(F.col("node").alias("v"), "root"), "v", hot=hubs).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        better = core.stored(labels.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), f"{what}-near")
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = core.stored(joins.looked_up(better, jump, "root", "left").select("node", "old", F.least("root", "far").alias("root")), what)
        core.dropped(labels, better)
        if new.filter("old <> root").isEmpty():
            core.dropped(both, hubs)
            return new.select("node", "root")
        labels = new


def _bit(column):
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def _bits(rows: DataFrame, column: str) -> np.ndarray:
    """A bit map of BITS bits with the hashes of ``column``: 2 MB at any size of the input. A full map lets everything through."""
    bit = _bit(column)
    words_of = rows.select((bit / 64).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bit"))
    out = np.zeros(BITS // 64, np.int64)
    for r in words_of.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        out[r[0]] = r[1]
    return out


def _among_bits(spark, bits: np.ndarray):
    """A function of _bit() that tells whether the map has it."""
    held = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def among(place):
        import pandas as pd

        place = place.to_numpy()
        return pd.Series((held.value[place // 64] >> (place % 64)) & 1 > 0)

    return among


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _mark():
    """Rows of one doc_id are told apart by a hash of their text."""
    return F.unhex(F.sha2(F.col("text").cast("string"), 256))


PACKED_DDL = "part long, packed binary"
NUMBERS = -2  # the lane of rows that are no names but numbers of their keys


def _records(part: np.ndarray, *both: np.ndarray) -> pa.RecordBatch:
    """A row for each part: of every pair of numbers in ``both`` the low 6 bytes."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    flat = np.empty((len(order), 12), np.uint8)
    for k, x in enumerate(both):
        flat[:, 6 * k : 6 * k + 6] = x[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    cuts = (12 * np.append(heads, len(part))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(part[heads]), pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])], ["part", "packed"])


def _packed(named, dealt: int):
    """Of (names, key of a node) packed rows, one for each of the ``dealt`` ranges of names: of a name the low 6 bytes, as the range tells most of the rest, and the 6 bytes of the key.

    Names that are frequent here go to one of SPREAD rows by their key, so that a range stays small; one of their keys also goes the common way, marked, which tells
    it that they are frequent.
    """
    held: list[np.ndarray] = []
    held_keys: list[int] = []

    def flush():
        sig, key = np.concatenate(held), np.repeat(np.array(held_keys, np.uint64), [len(x) for x in held])
        held.clear()
        held_keys.clear()
        values = np.sort(sig)
        hot = np.unique(values[FREQUENT:][values[FREQUENT:] == values[:-FREQUENT]])
        del values
        many = np.flatnonzero(np.isin(sig, hot)) if len(hot) else np.zeros(0, np.int64)
        lane = 1 + words.mix(key[many]) % np.uint64(SPREAD)
        one = many[np.unique(sig[many], return_index=True)[1]]
        sig, key = np.concatenate([sig, sig[one]]), np.concatenate([key, key[one] | np.uint64(_MARK)])
        part = sig >> np.uint64(32)
        part *= np.uint64(dealt)
        part >>= np.uint64(32)
        part *= np.uint64(SPREAD + 1)
        part[many] += lane
        return _records(part.astype(np.int64), sig, key)

    size = 0
    for names, key in named:
        held.append(names)
        held_keys.append(key)
        size += len(names)
        if size > FLUSH:
            yield flush()
            core.release()
            size = 0
    if held:
        yield flush()


def _shared(table: pa.Table) -> pa.Table:
    """Of one range of names, those that two or more nodes have, with their number; of frequent ones all, which are told by ``lane``. Parts below 0 hold a number for each key instead."""
    flat = np.frombuffer(b"".join(table["packed"].to_pylist()), np.uint8).reshape(-1, 12)
    wide = np.zeros((2, len(flat), 8), np.uint8)
    wide[0, :, :6], wide[1, :, :6] = flat[:, :6], flat[:, 6:]
    sig, key = wide.view("<u8")[:, :, 0]
    part = table["part"][0].as_py()
    if part < 0:
        return pa.table({"sig": sig.view(np.int64), "key": key.view(np.int64), "count": np.zeros(len(sig), np.int64), "lane": np.full(len(sig), NUMBERS, np.int32)})
    sig |= np.uint64(part // (SPREAD + 1) << 48)
    frequent = np.unique(sig[key >= np.uint64(_MARK)])
    key &= np.uint64(_MARK - 1)
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
    sig, key = sig[fresh], key[fresh]
    heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    count = np.diff(np.append(heads, len(sig)))
    lane = np.where(np.isin(sig, frequent), -1, part % (SPREAD + 1)).astype(np.int32)
    many = np.repeat(count > 1, count) | (lane != 0)
    return pa.table({"sig": sig[many].view(np.int64), "key": key[many].view(np.int64), "count": np.repeat(count, count)[many], "lane": lane[many]})


def _met(packed: DataFrame, what: str) -> tuple[DataFrame, list[DataFrame]]:
    """(sig, key, count) of every name in rows of _packed() that two or more nodes have, and the stored tables that this reads, of which the first has the numbers of keys."""
    shared = core.stored(packed.groupBy("part").applyInArrow(_shared, "sig long, key long, count long, lane int"), what)
    parts = shared.filter("lane = 0").select("sig", "key", "count")
    # of names that went several ways the nodes meet here, and are counted
    met = core.stored(shared.filter(f"lane not in (0, {NUMBERS})").select("sig", "key").distinct(), f"met-{what}")
    if met.isEmpty():
        return parts, [shared, met]
    counts = core.stored(met.groupBy("sig").agg(F.count("*").alias("count")).filter("count > 1"), f"{what}-counts")
    return parts.unionByName(joins.looked_up(met, counts, "sig", weight="count").select("sig", "key", "count")), [shared, met, counts]


def _often(sets, least: int):
    """(sig, count) of the tokens that more than ``least`` of about FLUSH tokens on end are."""
    held: list[np.ndarray] = []

    def flush():
        sig, count = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        many = count > least
        return pa.RecordBatch.from_arrays([pa.array(sig[many].view(np.int64)), pa.array(count[many].astype(np.int64))], ["sig", "count"])

    size = 0
    for tokens in sets:
        held.append(tokens)
        size += len(tokens)
        if size > FLUSH:
            yield flush()
            core.release()
            size = 0
    if held:
        yield flush()


def _ranked(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens of (sig, count), sorted, at most KNOWN, and the rank of each: 0 is the most frequent."""
    totals = core.stored(counts.groupBy("sig").agg(F.sum("count").alias("count")).filter(F.col("count") > FREQUENT), "token-totals")
    least = FREQUENT
    while totals.filter(F.col("count") > least).count() > KNOWN:
        least *= 2
    rows = totals.filter(F.col("count") > least).collect()
    core.dropped(totals)
    sig, count = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.lexsort((sig, -count))
    sig, rank = sig[order], np.argsort(sig[order])
    return sig[rank], rank


def rarest(tokens: np.ndarray, known: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Of a set the tokens that it may keep, and how many of them, the most frequent, it leaves out yet. The known ones come first in the order; they are left out here."""
    out = (percent * len(tokens) + 99) // 100 - 1
    if not len(known):
        return tokens, out
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    hit = known[at] == tokens
    of = rank[at[hit]]
    if len(of) <= out:
        return tokens[~hit], out - len(of)
    return np.concatenate([tokens[~hit], tokens[hit][np.argsort(of)[out:]]]), 0


def join(docs: DataFrame, n: int = 3, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    documents, nodes = _components(docs, n, percent)
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    least = core.stored(least, "least")
    named = core.stored(joins.looked_up(nodes.select("node", "root"), least, "root").select("node", "component_id"), "named")
    return joins.looked_up(documents, named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _components(docs: DataFrame, n: int, percent: int, marked: bool = False) -> tuple[DataFrame, DataFrame]:
    """A row (doc_id, n, node) for each document, and (node, least, root) for each node: its least doc_id and its component.

    When ``marked``, documents have a mark, and nodes their ``best`` document too.
    """
    spark = docs.sparkSession
    core.bounded_batches(spark)
    texts = _texts(docs)
    dealt = min(16 * core.shuffle_partitions(spark), 1 << 15)  # ranges of fingerprints, so that one range stays small

    def nodes_of(batches):
        for batch in core.released(batches):
            counts, names = [], []
            for tokens in token_sets(batch["text"], n):
                counts.append(len(tokens))
                names.append(digest(tokens) if len(tokens) else None)
            rest = ["mark"] if marked else []
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array([x and _key(x) for x in names], pa.int64()), *[batch[c] for c in rest]], ["doc_id", "n", "node", "key", *rest])
        core.release()

    rows = texts.withColumn("mark", _mark()) if marked else texts
    documents = core.stored(rows.mapInArrow(nodes_of, "doc_id long, n long, node binary, key long" + ", mark binary" * marked), "sets")

    def all_parts(batches):
        def named():
            seen: set[bytes] = set()
            for batch in core.released(batches):
                for tokens in token_sets(batch["text"], n):
                    if not len(tokens) or (name := digest(tokens)) in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(name)
                    yield part_names(tokens, percent), _key(name)

        yield from _packed(named(), dealt)
        core.release()

    parts, parts_stored = _met(texts.select("text").mapInArrow(all_parts, PACKED_DDL), "parts")
    size_class = F.col("sig").bitwiseAND(F.lit(127))
    tops, _ = _classes(percent)

    def of_class(values, which=size_class):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (which + 1).cast("int"))

    # a fingerprint that one node has alone is rarer than all here, so the most frequent parts of a node are among these
    by_count = Window.partitionBy("key", size_class).orderBy(F.desc("count"), "sig")
    late, more = (of_class(_spare(c, percent)[k] for c in range(len(tops))) for k in (1, 2))
    parts = parts.repartition("key").withColumn("place", F.row_number().over(by_count)).filter(F.col("place") > late)
    # groups are formed by the rarer ones where a node has such, so that passages of many documents form none
    parts = parts.withColumn("rare", F.col("place") > late + more)
    parts = parts.withColumn("group", F.max(F.struct("rare", "count", "sig")).over(Window.partitionBy("key"))["sig"])
    parts = parts_table = core.stored(parts.select("sig", "key", "group", "rare"), "shared-parts")
    core.dropped(*parts_stored)

    room = of_class(max(2, min(BLOCK_SETS, BLOCK_TOKENS // int(t))) for t in tops)
    best = core.stored(parts.select("key", F.col("group").alias("sig")).distinct(), "best")
    shared_class = F.col("shared").bitwiseAND(F.lit(127))
    held = core.stored(parts.filter("rare").select(F.col("sig").alias("shared"), F.col("group").alias("sig")).filter(shared_class >= size_class).distinct(), "group-parts")
    for k in range(REGROUPED):
        # a group joins the fingerprint that most groups share, of its own size class or above, so that sizes stay bounded by the class
        wide = held.groupBy("shared").agg(F.collect_list("sig").alias("sigs")).filter(F.size("sigs") > 1).select(F.size("sigs").alias("count"), "shared", F.explode("sigs").alias("sig"))
        joined = core.stored(wide.groupBy("sig").agg(F.max(F.struct("count", "shared")).alias("b")).select("sig", F.col("b.shared").alias("to")), "joined")
        new = core.stored(joins.looked_up(best, joined, "sig", "left").select("key", F.coalesce("to", "sig").alias("sig")), "best")
        if k + 1 < REGROUPED:
            moved = joins.looked_up(held, joined, "sig", "left").select("shared", F.coalesce("to", "sig").alias("sig"))
            moved = core.stored(moved.filter(shared_class >= size_class).distinct(), "group-parts")
            core.dropped(held)
            held = moved
        core.dropped(best, joined)
        best = new
    core.dropped(held)
    groups = core.stored(best.groupBy("sig").agg(F.count("*").alias("count"), F.min("key").alias("lead")), "groups")
    members = joins.looked_up(best, groups, "sig", weight="count").withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(7)), F.ceil(F.col("count") / room)).cast("int")).select("key", "sig", "chunk", "lead", F.lit(True).alias("home"))
    members = core.stored(members.union(members.select(F.col("lead").alias("key"), "sig", "chunk", "lead", F.lit(False)).distinct()), "members")

    # Texts are read again for one document of each member. A bit map of fixed size keeps most others out; whatever it lets through falls out in the join.
    keyed = documents.filter("node is not null").groupBy("node", "key").agg(F.min("doc_id").alias("doc_id"))
    wanted = keyed.join(members.select("key").distinct(), "key", "left_semi")
    core.dropped(best, groups)
    bits = spark.sparkContext.broadcast(_bits(wanted.filter("doc_id is not null"), "doc_id"))

    def open_sets(batches):
        for batch in core.released(batches):
            place = batch["place"].to_numpy(zero_copy_only=False)
            take = (place < 0) | ((bits.value[place // 64] >> (place % 64)) & 1 > 0)
            text = batch["text"].filter(pa.array(take))
            names = [digest(s) if len(s) else None for s in token_sets(text, n)]
            some = [(x, t) for x, t in zip(names, text.cast(pa.large_binary()).to_pylist(), strict=True) if x]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x, _ in some], pa.int64()), pa.array([x for x, _ in some], pa.binary()), pa.array([squeezed([t]) for _, t in some], pa.binary())], ["key", "node", "packed"])
        core.release()

    sets_again = texts.select("text", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_bit("doc_id")).cast("long").alias("place"))
    opened = sets_again.mapInArrow(open_sets, "key long, node binary, packed binary")
    blocks = members.join(opened, "key").groupBy("sig", "chunk").applyInArrow(lambda t: _home(t, n, percent), BLOCK_DDL)
    blocks = core.stored(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    core.dropped(members)

    inside = blocks.select("block", F.explode(F.arrays_zip("nodes", "keys", "labels")).alias("m")).select("block", F.col("m.nodes").alias("node"), F.col("m.keys").alias("key"), F.col("m.labels").alias("label"))
    # blocks of a group meet in its leader: components so far, so that only different ones are compared
    known = core.stored(connected(inside.filter("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v")), "inner").withColumnRenamed("root", "known"), "known")
    # components are told apart by 64 bits, as tokens are
    labelled = inside.join(known, "node", "left").select("key", "block", F.xxhash64(F.coalesce("known", "node")).alias("label"))
    labelled = core.stored(labelled, "labelled")
    # two nodes of different components and blocks that link have a rare part in common; nodes without such a part are done
    rare = parts.filter("rare").select("sig", "key")
    open_parts = rare.join(labelled, "key").groupBy("sig").agg(*[f(c).alias(f"{k}_{c}") for c in ("label", "block") for k, f in (("low", F.min), ("high", F.max))])
    open_parts = core.stored(open_parts.filter("low_label <> high_label and low_block <> high_block").select("sig"), "open-parts")
    # a bit map, as nodes that it lets through besides cost time only
    is_open = _among_bits(spark, _bits(open_parts, "sig"))
    open_nodes = core.stored(rare.filter(is_open(_bit("sig"))).select("key").distinct(), "open-nodes")
    core.dropped(parts_table, open_parts)
    open_bits = spark.sparkContext.broadcast(_bits(open_nodes, "key"))

    def sets_of_open(batches):
        """The tokens and keys of open nodes. What else the bit map lets through does no harm, as all that is here is counted."""
        for batch in core.released(batches):
            for keys, places, lengths, packed in zip(*(batch[c].to_pylist() for c in ("keys", "places", "lengths", "packed")), strict=True):
                place = np.array(places, np.int64)
                take = np.flatnonzero((open_bits.value[place // 64] >> (place % 64)) & 1 > 0).tolist()
                if take:
                    yield from zip(token_sets_of(lengths, packed, n, take), [keys[i] for i in take], strict=True)

    least = max(FREQUENT // 8, 1)  # a task has a share of a token's nodes only

    def often(batches):
        yield from _often((tokens for tokens, _ in sets_of_open(batches)), least)
        core.release()

    placed = blocks.select("keys", F.transform("keys", _bit).alias("places"), "lengths", "packed")
    known_tokens = spark.sparkContext.broadcast(_ranked(placed.mapInArrow(often, "sig long, count long")))

    def open_tokens(batches):
        left: list[tuple[int, int]] = []

        def named():
            for tokens, key in sets_of_open(batches):
                tokens, out = rarest(tokens, *known_tokens.value, percent)
                left.append((out, key))
                yield tokens, key

        for batch in _packed(named(), dealt):
            yield batch
            out, key = np.array(left, np.uint64).T
            left.clear()
            yield _records(-1 - (words.mix(key) % np.uint64(max(dealt // 16, 1))).astype(np.int64), out, key)
        core.release()

    tokens, tokens_stored = _met(placed.mapInArrow(open_tokens, PACKED_DDL), "tokens")
    # Linked sets have percent of the larger one's tokens in common. Each leaves out one fewer than percent of its own, the most frequent, in one order for all; so a common one is left.
    left_out = tokens_stored[0].filter(f"lane = {NUMBERS}").groupBy("key").agg(F.min("sig").alias("left_out"))
    left_out = core.stored(left_out.join(open_nodes, "key", "left_semi"), "left-out")
    by_count = Window.partitionBy("key").orderBy(F.desc("count"), "sig")
    tokens = tokens.join(left_out, "key").withColumn("place", F.row_number().over(by_count)).filter("place > left_out")
    units = tokens.select(F.col("sig").alias("shared"), "key").join(labelled, "key").groupBy("shared", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    units = units_stored = core.stored(units, "units")
    core.dropped(*tokens_stored, left_out, open_nodes, labelled)
    # only tokens that several blocks have in several components matter; the blocks of a frequent one are dealt to several tasks, each with all others
    open_parts = units.groupBy("shared").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.count("*").alias("n")).filter("a <> b and n > 1").select("shared", F.ceil(F.col("n") / BLOCKS_A_TASK).cast("int").alias("lanes"))
    open_parts = core.stored(open_parts, "open-parts")
    units = core.stored(joins.looked_up(units, open_parts, "shared", weight="lanes"), "open-units")
    core.dropped(units_stored, open_parts)
    units_stored = units
    other = units.select("shared", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), *[F.col(c).alias(f"{c}2") for c in ("block", "low", "high")])
    units = units.withColumn("lane", F.pmod(F.xxhash64("block"), F.col("lanes")).cast("int"))
    pairs = units.join(other, ["shared", "lane"]).filter("block < block2 and not (low = high and low2 = high2 and low = low2)")
    pairs = core.stored(pairs.select("block", "block2").distinct(), "block-pairs")
    core.dropped(units_stored)
    # of two blocks the one with less text goes to the other
    sizes = core.stored(blocks.select("block", F.octet_length("packed").alias("bytes")), "block-sizes")
    sized = pairs.join(sizes, "block").join(sizes.select(F.col("block").alias("block2"), F.col("bytes").alias("bytes2")), "block2")
    less = F.col("bytes") <= F.col("bytes2")
    turned = [F.when(less, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("block", "block2"), ("block2", "block"))]
    pairs = pairs_stored = core.stored(sized.select(*turned), "block-pairs")
    core.dropped(sizes)
    is_needed = _among_bits(spark, _bits(pairs.select("block").union(pairs.select("block2")), "block"))
    wanted_blocks = blocks.filter(is_needed(_bit("block")))
    one = wanted_blocks.select("block", "labels", "lengths", "packed")
    second = wanted_blocks.select(*[F.col(c).alias(f"{c}2") for c in ("block", "labels", "lengths", "packed")])
    pairs = pairs.join(one, "block").join(second, "block2")

    def across(batches):
        opened: dict[bytes, list[np.ndarray]] = {}

        def block(lengths, packed):
            if packed not in opened:
                while len(opened) >= OPEN_BLOCKS:
                    del opened[next(iter(opened))]
                opened[packed] = token_sets_of(lengths, packed, n)
            return opened[packed]

        for batch in core.released(batches):
            found: set[tuple[bytes, bytes]] = set()
            for la, na, ta, lb, nb, tb in zip(*(batch[c].to_pylist() for c in ("labels", "lengths", "packed", "labels2", "lengths2", "packed2")), strict=True):
                for i, j in np.argwhere(compare_blocks(block(na, ta), block(nb, tb), percent)).tolist():
                    if la[i] != lb[j]:
                        found.add((la[i], lb[j]))
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])
        opened.clear()
        core.release()

    links = pairs.select("labels", "lengths", "packed", "labels2", "lengths2", "packed2").mapInArrow(across, "u binary, v binary")
    ends = known.select("node", "known")
    links = core.stored(links.distinct(), "block-links")
    links = core.stored(joins.looked_up(links, ends.select(F.col("node").alias("u"), F.col("known").alias("ku")), "u", "left"), "block-links")
    links = joins.looked_up(links, ends.select(F.col("node").alias("v"), F.col("known").alias("kv")), "v", "left")
    links = links.select(F.coalesce("ku", "u").alias("u"), F.coalesce("kv", "v").alias("v")).filter("u <> v")
    roots = connected(links, "links")
    core.dropped(pairs_stored, blocks)

    best_of = [F.min(_place()).alias("best")] if marked else []
    more = ["best"] if marked else []
    first = documents.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), *best_of).join(known, "node", "left").select("node", "least", *more, F.coalesce("known", "node").alias("known"))
    first = joins.looked_up(core.stored(first, "firsts"), core.stored(roots.withColumnRenamed("node", "known"), "roots"), "known", "left").select("node", "least", *more, F.coalesce("root", "known").alias("root"))
    return documents, core.stored(first, "nodes")


def _place():
    """Documents of a component in order: by doc_id, null last, then by mark."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")


def representatives(docs: DataFrame, n: int = 3, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: one with the least doc_id, null last. Documents without words stay.

    Rows are told apart by doc_id and text; of rows that repeat both, the one whose columns come first stays.
    """
    documents, nodes = _components(docs, n, percent, marked=True)
    best = core.stored(nodes.groupBy("root").agg(F.min("best").alias("best")), "best")
    named = core.stored(joins.looked_up(nodes.select("node", "root"), best, "root").select("node", "best"), "named")
    rows = joins.looked_up(documents, named, "node").groupBy("doc_id", "mark").agg(F.min(_place() == F.col("best")).alias("stays"), F.count("*").alias("count"))
    rows = core.stored(rows.filter("not stays or count > 1"), "told")
    mark = next(f"mark{k}" for k in range(len(docs.columns) + 1) if f"mark{k}" not in docs.columns)
    # rows whose doc_id no told row has stay where they are; the texts of the others go through the joins
    told = _among_bits(docs.sparkSession, _bits(rows, "doc_id"))(_bit(F.col("doc_id").cast("long")))
    marked = docs.filter(told).withColumn(mark, _mark()).alias("docs")

    def among(some: DataFrame, how: str) -> DataFrame:
        same = (F.col(f"docs.{mark}") == F.col("told.mark")) & F.col("docs.doc_id").cast("long").eqNullSafe(F.col("told.doc_id"))
        return marked.join(some.select("doc_id", "mark").alias("told"), same, how)

    single = docs.filter(~told).union(among(rows, "left_anti").select(*docs.columns))
    again = rows.filter("stays")
    if again.isEmpty():
        return single
    order = Window.partitionBy("doc_id", mark).orderBy(F.to_json(F.struct(*docs.columns)))
    one = among(again, "left_semi").withColumn(mark, F.row_number().over(order)).filter(F.col(mark) == 1)
    return single.union(one.select(*docs.columns))
