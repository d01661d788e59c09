"""Token ids as grammar-compressed shards (Re-Pair), with random access by document.

Each shard holds the ids of a run of documents in ascending doc_id order. Frequent adjacent pairs
are replaced by new symbols, round after round, until no pair is frequent or no symbol is left; a pair never reaches over the end of a document. Symbols
take two bytes, or four with a vocabulary that leaves no room in two. The file keeps the rules, the expansion length of every rule, the symbols, and for each document its id,
first symbol and number of ids, so a document is decoded without the rest of the shard.

Null texts are empty documents: they hold the end id alone. Rows that share a doc_id follow each other by
text; every row is a document. A null doc_id sorts first. An empty table gives no shard and no row.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import core
from . import bpe, files

MAGIC = b"LMRP0001"
SHARD_IDS = 2_000_000
RULES_A_ROUND = 8000
LEAST_COUNT = 12
_SLOTS = 1 << 20
_NO_ID = -(2**63)


def symbol_bytes(base: int) -> int:
    """Two bytes hold a symbol where they leave room for rules beside the vocabulary, else four do."""
    return 2 if base + RULES_A_ROUND <= 1 << 16 else 4


def _slot(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return ((keys * np.uint32(2654435761)) >> np.uint32(12)).astype(np.int32)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)


def compress(ids: np.ndarray, ends: np.ndarray, base: int):
    """Re-Pair of one shard. ends: of each document, the index after its last id.

    Returns symbols, the symbol index after each document's last symbol, and rules as pairs of symbols; rule k is symbol base + k. Rounds go on until
    no pair is there LEAST_COUNT times, or no symbol is left for rules.
    """
    narrow = symbol_bytes(base) == 2
    kind, half = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
    most = (1 << 16 if narrow else 1 << 31) - base
    seq = ids.astype(np.uint32)
    final = np.zeros(len(seq), bool)
    final[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    made = 0
    while len(seq) > 1 and made < most:
        keys = (seq[:-1].astype(kind) << half) | seq[1:]
        usable = ~final[:-1]
        ordered = np.sort(keys[usable])
        if not len(ordered):
            break
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(heads, len(ordered)))
        good = np.flatnonzero(counts >= LEAST_COUNT)
        if not len(good):
            break
        good = good[np.argsort(-counts[good], kind="stable")[: min(RULES_A_ROUND, most - made)]]
        chosen = ordered[heads[good]]
        # of pairs that share a slot of the lookup table, the most frequent is taken in this round
        _, firsts = np.unique(_slot(chosen), return_index=True)
        chosen = chosen[np.sort(firsts)]
        pairs = np.stack([chosen >> half, chosen & ((kind(1) << half) - kind(1))], 1).astype(np.uint32)
        table = np.full(_SLOTS, -1, np.int32)
        table[_slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
        # most places fall out by one of their two symbols, in tables that stay in a cache
        left, right = np.zeros((2, 1 << 16), bool)
        left[pairs[:, 0] & np.uint32(0xFFFF)] = right[pairs[:, 1] & np.uint32(0xFFFF)] = True
        low = seq.astype(np.uint16)
        at = np.flatnonzero(left[low[:-1]] & right[low[1:]] & usable)
        rule = table[_slot(keys[at])]
        hit = rule >= 0
        hit[hit] = chosen[rule[hit]] == keys[at[hit]]
        at, rule = at[hit], rule[hit]
        # of hits that overlap, every second one from the left
        new_run = np.concatenate([[True], np.diff(at) > 1])
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run_start) % 2 == 0
        at, rule = at[take], rule[take]
        seq[at] = (base + made + rule).astype(np.uint32)
        final[at] = final[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, final = seq[keep], final[keep]
        rules.append(pairs)
        made += len(chosen)
    return seq, np.flatnonzero(final) + 1, np.concatenate([np.zeros((0, 2), np.uint32), *rules])


def _generations(rules: np.ndarray, base: int):
    """Runs (first, end) of rules that only name symbols before the run."""
    newest = np.maximum.accumulate(rules.max(1)).astype(np.int64) - base if len(rules) else np.zeros(0, np.int64)
    done = 0
    while done < len(rules):
        end = int(np.searchsorted(newest, done, "left"))
        yield done, end
        done = end


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Number of ids that each rule stands for."""
    lengths = np.ones(len(rules), np.uint32)
    for a, b in _generations(rules, base):
        own = rules[a:b].astype(np.int64)
        lengths[a:b] = np.where(own >= base, lengths[np.maximum(own - base, 0)], 1).sum(1)
    return lengths


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """A pool with the ids of every rule, and the start of each rule in it."""
    starts = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    pool = np.zeros(int(starts[-1]), np.uint32)
    for a, b in _generations(rules, base):
        pool[starts[a] : starts[b]] = expand(rules[a:b].ravel(), lengths, pool, starts, base)
    return pool, starts[:-1]


def expand(seq: np.ndarray, lengths: np.ndarray, pool: np.ndarray, starts: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    seq = seq.astype(np.int64)
    rule = np.flatnonzero(seq >= base)
    n = np.ones(len(seq), np.int64)
    n[rule] = lengths[seq[rule] - base]
    total = np.cumsum(n)
    out = np.repeat(seq.astype(np.uint32), n)
    # where rules stand, their ids are gathered from the pool
    size = n[rule]
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(total[rule] - size, size) + within] = pool[np.repeat(starts[seq[rule] - base], size) + within]
    return out


def shard_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, base: int) -> list[bytes]:
    """A shard file: magic, header, then the arrays that the header lists."""
    seq, symbol_ends, rules = compress(ids, np.cumsum(counts), base)
    symbol = f"<u{symbol_bytes(base)}"
    arrays = {"doc_ids": doc_ids.astype("<i8"), "counts": counts.astype("<i8"), "symbol_ends": symbol_ends.astype("<i8"), "rules": rules.astype(symbol), "lengths": rule_lengths(rules, base).astype("<u4"), "symbols": seq.astype(symbol)}
    header = json.dumps({"base": base, "arrays": [[k, v.dtype.str, v.size] for k, v in arrays.items()]}).encode()
    return [MAGIC, struct.pack("<I", len(header)), header, *(v.tobytes() for v in arrays.values())]


def open_shard(data: bytes) -> dict:
    if data[:8] != MAGIC:
        raise ValueError("not a shard")
    (n,) = struct.unpack("<I", data[8:12])
    header = json.loads(data[12 : 12 + n])
    out, at = {"base": header["base"]}, 12 + n
    for name, kind, size in header["arrays"]:
        out[name] = np.frombuffer(data, np.dtype(kind), size, at)
        at += out[name].nbytes
    out["rules"] = out["rules"].reshape(-1, 2)
    out["pool"], out["starts"] = expansions(out["rules"], out["lengths"], out["base"])
    return out


def document(shard: dict, k: int) -> np.ndarray:
    """Random access: the ids of the k-th document of a shard."""
    a = int(shard["symbol_ends"][k - 1]) if k else 0
    return expand(shard["symbols"][a : int(shard["symbol_ends"][k])], shard["lengths"], shard["pool"], shard["starts"], shard["base"])


def write_shards(docs: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes documents (doc_id, text) as shards in ``folder``; returns the stored manifest (partition, start, path, n_docs, n_ids).

    ``start`` counts the ids of the same partition before the shard; partitions are ranges of doc_id.
    The manifest names the files of attempts that succeeded only.
    """
    spark = docs.sparkSession
    core.bounded_batches(spark)
    files.make_folder(folder)

    def encode(batches):
        coder = bpe.encoder(bpe.vocabulary(vocabulary))
        base = int(len(coder.last))
        part, start, shard = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal start, shard
            names, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            path = f"{folder}/{files.fresh_name(f'{part:06d}-{shard:06d}')}.ids"
            files.write(path, shard_bytes(names, counts, ids, base))
            row = pa.RecordBatch.from_pydict({"partition": [part], "start": [start], "path": [path], "n_docs": [len(names)], "n_ids": [len(ids)]}, SHARDS)
            start, shard = start + len(ids), shard + 1
            held.clear()
            return row

        size = 0
        for batch in core.released(batches):
            row = 0
            names = batch["doc_id"].fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for ids, n in coder.encode(batch["text"]):
                whole = np.insert(ids, np.cumsum(n), end_id) if len(n) else ids
                held.append((names[row : row + len(n)], n + 1, whole.astype(np.uint32)))
                row, size = row + len(n), size + len(whole)
                if size >= shard_ids:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(core.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return core.stored(ordered.mapInArrow(encode, "partition int, start long, path string, n_docs long, n_ids long"), "shards")


SHARDS = pa.schema([("partition", pa.int32()), ("start", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_shards(manifest: DataFrame) -> DataFrame:
    """Of each document in the shards of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only one total for each partition comes to the driver.
    """
    spark = manifest.sparkSession
    before, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in manifest.groupBy("partition").agg(F.sum("n_ids")).collect()):
        before[part], total = total, total + n

    def read(batches):
        for batch in batches:
            for part, start, path in zip(batch["partition"].to_pylist(), batch["start"].to_pylist(), batch["path"].to_pylist(), strict=True):
                shard = open_shard(files.read(path))
                ids = expand(shard["symbols"], shard["lengths"], shard["pool"], shard["starts"], shard["base"]).astype("<u4")
                n = shard["counts"]
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                names = pa.array(shard["doc_ids"], mask=shard["doc_ids"] == _NO_ID)
                yield pa.RecordBatch.from_arrays([names, pa.array(before[part] + start + ends - n), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("partition", "start", "path").repartition(core.shuffle_partitions(spark), "path")
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
