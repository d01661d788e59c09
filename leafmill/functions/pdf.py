"""What a PDF says of its pages without a PDF library: their number. Text and pixels need a tool (see sources.recognition)."""

from __future__ import annotations

import re
import zlib

import pandas as pd

from .batches import on_batches

_PAGES = re.compile(rb"/Type\s*/Pages\b")
_PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")
_COUNT = re.compile(rb"/Count\s+(\d+)")
_STREAM = re.compile(rb"<<(?:(?!stream).)*?/ObjStm(?:(?!stream).)*?>>\s*stream\r?\n", re.DOTALL)
_OBJECT = re.compile(rb"<<(?:[^<>]|<(?!<)|>(?!>)|<<(?:[^<>]|<(?!<)|>(?!>))*>>)*>>")


def _told(data: bytes) -> tuple[int, int]:
    """The largest count of a page tree, and the number of page objects."""
    counts, pages = [0], 0
    for m in _OBJECT.finditer(data):
        if _PAGES.search(m[0]):
            counts += map(int, _COUNT.findall(m[0]))
        elif _PAGE.search(m[0]):
            pages += 1
    return max(counts), pages


def page_count(data: bytes | None) -> int | None:
    """Pages of a PDF: as its page tree says, else as many as there are page objects, also in compressed object streams; None for what is no PDF or has no page."""
    if not data or b"%PDF-" not in data[:1024]:
        return None
    found = [_told(data)]
    for m in _STREAM.finditer(data):
        try:
            found.append(_told(zlib.decompressobj().decompress(data[m.end() :])))
        except zlib.error:
            continue
    return max(c for c, _ in found) or sum(p for _, p in found) or None


@on_batches("int")
def page_counts(contents: pd.Series) -> pd.Series:
    return pd.Series([page_count(None if c is None else bytes(c)) for c in contents], dtype="Int32")
