"""Token ids of whole texts by a public tokenizer whose tokens never cross white space.

The library's cost for each text is high, so texts are cut into units, each distinct unit is encoded once by the library and its ids are kept in a bounded
cache. A word of ASCII and Latin-1 letters is cut where the tokenizer's own splitting pattern cuts it: runs of letters, single digits, runs of signs, all in lower
case. Any other word (another script, an apostrophe, what may be a special token) is a unit as it is. This gives the ids of the whole text because the
tokenizer's normaliser and splitting pattern never look across white space. Units are found by name and told apart by their bytes.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from . import words

UNITS_KEPT = 1_200_000
_BATCH = 2000
#: Kinds of bytes: 1 letters, 2 digits, 3 signs, 4 what only the library knows. The second byte of a Latin-1 letter is a letter.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[ord("'")] = 4
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False  # the signs of multiplication and division


class WordBPE:
    """Encoder with a cache for one process."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix") or "</w>"
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.last = np.zeros(size, bool)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.last[k] = token.endswith(suffix)
        self._reset(UNITS_KEPT)

    def _reset(self, room: int) -> None:
        self.names = np.zeros(0, np.uint64)  # unit names, sorted, and the row of each in the arrays below
        self.rows = np.zeros(0, np.int32)
        self.start = np.zeros(room, np.int64)  # ids of a row in the pool
        self.count = np.zeros(room, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.size = np.zeros(room, np.int32)  # bytes of a row's unit, and where they are
        self.at = np.zeros(room, np.int64)
        self.text = np.zeros(1 << 20, np.uint8)
        self.used = self.text_used = self.rows_used = 0

    def _each(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of units, one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.array([x for ids in found for x in ids], np.uint32), np.array([len(x) for x in found], np.int64)

    def _together(self, plain: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain units, as one text: each ends with a token that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(plain).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(plain) or ends[-1] != len(ids):
            return self._each(plain)
        return ids, np.diff(ends, prepend=0)

    def _add(self, new: list[bytes], plain: bool) -> np.ndarray:
        """Encodes units into fresh rows."""
        parts = [(self._together if plain else self._each)(new[k : k + _BATCH]) for k in range(0, len(new), _BATCH)]
        flat, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = np.array([len(w) for w in new], np.int64)
        data = np.frombuffer(b"".join(new), np.uint8)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        while self.text_used + len(data) + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(len(self.text), np.uint8)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.text[self.text_used : self.text_used + len(data)] = data
        if (short := self.rows_used + len(new) - len(self.start)) > 0:
            for name in ("start", "count", "size", "at"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(short + len(old) // 4, old.dtype)]))
        rows = np.arange(self.rows_used, self.rows_used + len(new))
        self.start[rows], self.count[rows] = self.used + np.cumsum(n) - n, n
        self.at[rows], self.size[rows] = self.text_used + np.cumsum(size) - size, size
        self.used, self.text_used, self.rows_used = self.used + len(flat), self.text_used + len(data), self.rows_used + len(new)
        return rows

    def _rows(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The cache row of each unit, after new ones are encoded. A name finds a row, and the row's bytes decide; units whose name is another's get rows of their own."""
        coded = pa.array(words.names_of(text, starts, ends)).dictionary_encode()
        index, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        where = np.empty(len(keys), np.int64)
        where[index[::-1]] = np.arange(len(index) - 1, -1, -1)
        raw = text.tobytes()

        def bytes_at(places: np.ndarray) -> list[bytes]:
            return [raw[s:e] for s, e in zip(starts[places].tolist(), ends[places].tolist(), strict=True)]

        def known() -> np.ndarray:
            if not len(self.names):
                return np.full(len(keys), -1, np.int64)
            at = np.minimum(np.searchsorted(self.names, keys), len(self.names) - 1)
            return np.where(self.names[at] == keys, self.rows[at].astype(np.int64), -1)

        rows = known()
        if self.rows_used + (rows < 0).sum() > UNITS_KEPT:
            self._reset(UNITS_KEPT)
            rows = known()
        for kind in (True, False):
            if (fresh := np.flatnonzero((rows < 0) & (plain[where] == kind))).size:
                rows[fresh] = self._add(bytes_at(where[fresh]), kind)
                order = np.argsort(keys[fresh])
                at = np.searchsorted(self.names, keys[fresh][order])
                self.names = np.insert(self.names, at, keys[fresh][order])
                self.rows = np.insert(self.rows, at, rows[fresh][order].astype(np.int32))
        out = rows[index]
        size = ends - starts
        right = self.size[out] == size
        long = np.flatnonzero(right & (size > 7))
        right[long] = words.same(text, starts[long], self.text, self.at[out[long]], size[long])
        if (odd := np.flatnonzero(~right)).size:
            spelt = bytes_at(odd)
            own = list(dict.fromkeys(spelt))
            own = dict(zip(own, self._add(own, False).tolist(), strict=True))
            out[odd] = [own[w] for w in spelt]
        return out

    def _units(self, raw: np.ndarray, cuts: np.ndarray):
        """Of the bytes of some rows: padded bytes (plain words lowered), start and end of each unit, whether it is plain, and the first unit of each row."""
        n = len(raw)
        kind = _KIND[raw]
        latin = np.flatnonzero(raw[:-1] == 0xC3)
        latin = latin[_LATIN[raw[latin + 1]]]
        kind[latin] = kind[latin + 1] = 1
        starts, ends = words.spans(raw, cuts)
        strange = kind == 4
        token = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        strange[token] = True
        count = np.concatenate([[0], np.cumsum(strange, dtype=np.int64)])
        special = (count[ends] - count[starts]) > 0
        low = words.LOWER[raw]
        up = latin[raw[latin + 1] < 0x9F] + 1  # ß is lower case
        low[up] += 0x20
        inner = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
        if special.any():
            step = np.zeros(n + 1, np.int8)
            np.add.at(step, starts[special], 1)
            np.add.at(step, ends[special], -1)
            kept = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
            low[kept] = raw[kept]
            inner = inner[~kept[inner]]
        begins = np.zeros(n + 1, bool)
        begins[inner[~words.SPACE[raw[inner]]]] = True
        begins[starts] = True
        own = np.flatnonzero(begins)
        word = np.searchsorted(starts, own, "right") - 1
        until = np.append(own[1:], n)
        return words.padded(low), own, np.minimum(until, ends[word]), ~special[word], np.searchsorted(own, cuts)

    def encode(self, texts: pa.Array):
        """Yields, for runs of rows, their ids in one array and the number of ids of each row."""
        data, offsets = words.buffers(texts)
        for i, j in words.chunks(offsets):
            text, starts, ends, plain, first = self._units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(starts):
                yield np.zeros(0, np.uint32), np.zeros(j - i, np.int64)
                continue
            rows = self._rows(text, starts, ends, plain)
            n = self.count[rows].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(n)])
            # gathers the ragged rows of the pool
            at = np.arange(total[-1]) + np.repeat(self.start[rows] - total[:-1], n)
            yield self.pool[at], np.diff(total[first])


_kept: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    """The process's encoder for a tokenizer file."""
    if path not in _kept:
        _kept[path] = WordBPE(path)
    return _kept[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
