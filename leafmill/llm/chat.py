"""Chat formatting with loss masks, by incremental rendering of a template that is a black box.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation are rendered and consecutive outputs
compared: what a turn adds is its span, and a template whose earlier output changes is found out (``rewrites``). A turn's text lies
between the parts of its span that do not depend on the text, which two probe texts show.

The template here writes control strings around turns. Texts that hold a control string are escaped by a backslash inside it, and
backslashes are doubled, so every text is read back as it was.

Null roles and texts are empty; a null conv_id is one conversation; turns sort by number (null first), then role and text, and repeated rows are turns of
their own. A conversation is held by one task, and rendering its prefixes takes time and memory with the square of its turns (0.2 s for 1,000 turns of 200 characters). An empty table gives conversation -1 only in the query, and no rows here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import core

Turn = tuple[str, str]
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left in the result; unescape() gives the text back."""
    text = text.replace("\\", "\\\\")
    while True:
        broken = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
        if broken == text:
            return text
        text = broken


def unescape(text: str) -> str:
    """A doubled backslash is one; a single backslash only breaks a control string."""
    return _ESCAPED.sub(lambda m: m[1], text)


def frame(turns: list[Turn]) -> str:
    """The template, for roles and texts that are escaped already."""
    return "".join([f"<|turn|>{role}<|text|>{text}<|end|>\n" for role, text in turns])


def render(turns: list[Turn]) -> str:
    return frame([(escape(role), escape(text)) for role, text in turns])


def parse(formatted: str) -> list[Turn]:
    """The turns of render()'s output."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _same(a: str, b: str) -> int:
    """Length of the common prefix, by halving: slices are compared at the speed of memory."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def incremental(turns: list[Turn], template: Callable[[list[Turn]], str] = render) -> tuple[str, list[tuple[int, int]], bool]:
    """The output for all turns, the span of each turn's text in it, and whether the template rewrites what it wrote before."""
    before, spans, rewrites = template([]), [], False
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            rewrites = True
        x, y = (template([*turns[:k], (role, probe)]) for probe in ("A", "BB"))
        head = _same(x, y)
        tail = _same(x[:head:-1], y[: head + 1 : -1])
        # a probe's own characters are not part of the frame
        tail = min(tail, len(x) - head - 1)
        spans.append((head, len(now) - tail))
        before = now
    return before, spans, rewrites


OUT = "conv_id long, formatted string, spans array<struct<role:string,start:int,end:int>>, rewrites boolean"


def format_conversations(rows: DataFrame, template: Callable[[list[Turn]], str] = frame, prepare: Callable[[str], str] = escape) -> DataFrame:
    """Per conversation: conv_id, formatted, the text span of each turn with its role, and rewrites.

    ``prepare`` is applied once to each role and text before the template sees them, so that prefixes are rendered without escaping again.

    Rows are sorted within partitions and streamed; one conversation is held at a time.
    """
    spark = rows.sparkSession
    core.bounded_batches(spark)
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.repartition(core.shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("rewrites", pa.bool_())])

    def run(batches):
        conv, held, out = None, [], []

        def done():
            text, spans, rewrites = incremental([(prepare(r), prepare(t)) for r, t in held], template)
            out.append({"conv_id": conv, "formatted": text, "spans": [{"role": r, "start": a, "end": b} for (r, _), (a, b) in zip(held, spans, strict=True)], "rewrites": rewrites})

        for batch in batches:
            for c, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if held and c != conv:
                    done()
                    held = []
                conv = c
                held.append((role, text))
            if len(out) >= 200:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out.clear()
        if held:
            done()
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return turns.mapInArrow(run, OUT)


def digests(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """Read back from the output of format_conversations: turns from its text, and what the loss mask of ``learn`` covers from its spans."""
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns = parse(row["formatted"])
                loss = "".join(unescape(row["formatted"][s["start"] : s["end"]]) for s in row["spans"] if s["role"] == learn)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append({"conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(row["formatted"])})
            yield pa.RecordBatch.from_pylist(out, kinds)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
