"""Token ids of a vocabulary that drops white space and never crosses it.

Texts are cut into units whose ids don't depend on what stands around them:
words of Latin letters, digits and marks into their parts (letters, single
digits, marks), all other words whole. Each task tokenizes every distinct unit
once, with the library, and gathers the ids of its texts by position. Units are
found, named by a hash and looked up as arrays; nothing is done word by word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tiescope.llm import rows, words

#: Units, and their ids, that a task remembers; beyond that it starts anew.
TABLE_UNITS = 1_000_000
TABLE_IDS = 8_000_000
#: A longer unit is not remembered.
KEPT_BYTES = 64
_tables: dict[str, "UnitTable"] = {}

# Kinds of bytes: letters, digits, marks, and what makes a word whole.
_LETTER, _DIGIT, _MARK, _ODD = range(4)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39] = _ODD  # an apostrophe may start a part of its own
#: Letters of one word, or one digit: the library numbers each as one word of a line.
_PART = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def units(data: np.ndarray, offsets: np.ndarray):
    """(bytes, start, end, row) of the units of each text; those cut from a word are in lower case.

    Letters are ASCII ones and those of Latin-1 (two bytes, the first 0xC3).
    """
    starts, ends, row = words.spans(data, offsets)
    n = len(data)
    if not len(starts):
        return data, starts, ends, row
    kind = _KIND[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)
    second = data[latin + 1]
    latin = latin[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    pipe = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|" may start a special token
    kind[pipe] = _ODD

    odd = np.concatenate([[0], np.cumsum(kind == _ODD)])
    plain = odd[ends] == odd[starts]
    inside = np.zeros(n + 1, np.int8)
    inside[starts[plain]] = 1
    inside[ends[plain]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)

    lowered = data.copy()
    lowered[inside] = _LOWER[data[inside]]
    raised = latin[inside[latin] & (data[latin + 1] < 0x9F)] + 1
    lowered[raised] += 0x20

    # a unit starts with its word, and inside a plain word where the kind changes and at digits
    begins = np.zeros(n, bool)
    begins[1:] = inside[1:] & inside[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    begins[starts] = True
    at = np.flatnonzero(begins)
    word = np.searchsorted(starts, at, "right") - 1
    stops = np.append(at[1:], n)
    return lowered, at, np.minimum(stops, ends[word]), row[word]


class UnitTable:
    """Ids of distinct units under one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        for probe in ("a b", "a\tb", "a　b", "a\x85b"):
            if not np.array_equal(self.ids_of([probe])[0], np.concatenate(self.ids_of(["a", "b"]))):
                raise ValueError("white space is part of this vocabulary's tokens")
        self.clear()
        self.cut = True
        for probe in ("Don't a1b22c", "Größe,«x» It'LL", "À-la x!?", "#$%ab ÇA99 <|x|> x<|y", "a×b÷c Ý.Þ"):
            if not np.array_equal(self.encode(*_bytes([probe]))[0], self.ids_of([probe])[0]):
                raise ValueError("this vocabulary does not cut words at letters, digits and marks")

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def at_once(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of parts of words from one call: the library numbers the words of a line."""
        line = self.library.encode(" ".join(parts), add_special_tokens=False)
        number = np.array(line.word_ids, np.int64)
        if not len(number) or number[-1] + 1 != len(parts):
            return self.ids_of(parts)
        return np.split(np.array(line.ids, np.int32), np.searchsorted(number, np.arange(1, len(parts))))

    def new_ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found: list = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if _PART.fullmatch(t)]
        odd = sorted(set(range(len(texts))) - set(plain))
        for k in range(0, len(plain), 4096):
            for place, ids in zip(plain[k:k + 4096], self.at_once([texts[p].decode() for p in plain[k:k + 4096]])):
                found[place] = ids
        for k in range(0, len(odd), 4096):
            for place, ids in zip(odd[k:k + 4096], self.ids_of([texts[p].decode() for p in odd[k:k + 4096]])):
                found[place] = ids
        return found

    def learn(self, names: np.ndarray, texts: list[bytes]) -> None:
        """Adds units by their names, ascending."""
        ids = self.new_ids(texts)
        size = np.array([len(i) for i in ids], np.int64)
        total = int(size.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(max(total, self.used) + (1 << 16), np.int32)])
        if total:
            self.flat[self.used:self.used + total] = np.concatenate(ids)
        place = np.searchsorted(self.keys, names)
        self.keys = np.insert(self.keys, place, names)
        self.at = np.insert(self.at, place, (self.used + np.cumsum(size) - size).astype(np.int32))
        self.size = np.insert(self.size, place, size.astype(np.int32))
        self.used += total

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, begin): int32 ids of the texts and the n + 1 places where they begin."""
        data, starts, ends, row = units(data, offsets)
        names, first, inverse = np.unique(words.hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        if len(self.keys) + len(names) > TABLE_UNITS or self.used > TABLE_IDS:
            self.clear()
        place = np.searchsorted(self.keys, names)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != names
        else:
            new = np.ones(len(names), bool)
        if new.any():
            a, b = starts[first[new]], ends[first[new]]
            raw = data.tobytes()
            self.learn(names[new], [raw[s:e] for s, e in zip(a.tolist(), b.tolist())])
            place = np.searchsorted(self.keys, names)
        at, size = (column[place].astype(np.int64)[inverse] for column in (self.at, self.size))
        ids = self.flat[rows.ragged(at, size)]
        counts = np.bincount(row, size, len(offsets) - 1).astype(np.int64)
        long_ = names[new][(b - a) > KEPT_BYTES] if new.any() else names[:0]
        if len(long_):
            kept = ~np.isin(self.keys, long_)
            self.keys, self.at, self.size = self.keys[kept], self.at[kept], self.size[kept]
        return ids, np.concatenate([[0], np.cumsum(counts)])


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return rows.raw_text(pa.array(texts, pa.large_string()))


def with_end(ids: np.ndarray, begin: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts with ``end`` behind each."""
    count = np.diff(begin)
    out = np.full(len(ids) + len(count), end, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
    return out, begin + np.arange(len(begin))


def checksum(ids: np.ndarray) -> int:
    """crc32 over ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenize(df: DataFrame, path: str, end: int, text: str = "text", ids: str = "ids",
             window: int | None = None, sums: str = "sums") -> DataFrame:
    """``df`` with ``ids`` of every whole text in place of the text, ``end`` last; null is empty.

    With ``window`` the column ``sums`` has the checksum of every ``window``
    ids, the last ones too. Repeated rows get the same ids each, an empty table
    gives no rows; other columns stay, but for ones named like the new ones.
    """
    rows.ship(df.sparkSession)
    made = [ids] if window is None else [ids, sums]
    kept = [c for c in df.columns if c not in (text, *made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core only
        if path not in _tables:
            _tables[path] = UnitTable(path)
        for batch in batches:
            for part in rows.slices(batch, text, rows.SMALL_SLICE):
                found, begin = with_end(*_tables[path].encode(*rows.raw_text(part.column(text))), end)
                columns = [rows.list_array(found, begin)]
                if window is not None:
                    count = -(-np.diff(begin) // window)
                    at = np.repeat(begin[:-1], count) + rows.ragged(np.zeros(len(count), np.int64), count) * window
                    stop = np.minimum(at + window, np.repeat(begin[1:], count))
                    each = np.array([checksum(found[a:b]) for a, b in zip(at.tolist(), stop.tolist())], np.int64)
                    columns.append(rows.list_array(each, np.concatenate([[0], np.cumsum(count)])))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + columns, [*kept, *made])

    added = f"`{ids}` array<int>" + ("" if window is None else f", `{sums}` array<bigint>")
    return df.mapInArrow(run, rows.extended(df, kept, added))
