"""SentencePiece encoding and decoding over a table of distinct chunks.

Where no piece crosses a whitespace marker, a text is a sequence of chunks
(markers and the characters up to the next marker) that are segmented
independently. Each task segments every distinct chunk once and puts the ids
back by position. The table lives in the task: a table over the whole corpus
would have to move every word of every text through a shuffle. It is emptied
when it holds ``TABLE_CHUNKS`` chunks, which costs time and changes no result.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tiescope.llm import rows

#: Distinct chunks that a task keeps.
TABLE_CHUNKS = 400_000
#: Characters of the longest chunk kept in the table.
KEPT_CHARS = 64
#: Ids decoded at once.
SLICE_IDS = 1 << 19
MARKER = "▁"
_MARKED = re.compile(" +[^ ]*")
_tables: dict[str, "ChunkTable"] = {}


class ChunkTable:
    """Ids of distinct chunks under one model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARKER in name.lstrip(MARKER) for name in names):
            raise ValueError("a piece crosses a whitespace marker; chunks are not independent")
        self.end = self.model.eos_id()
        self.lone = np.array([self.model.piece_to_id(MARKER)], np.int32).tobytes()
        self.ids: dict[str, bytes] = {}
        control = [self.model.is_control(i) for i in range(len(names))]
        byte = [self.model.is_byte(i) for i in range(len(names))]
        surface = [b"" if c else bytes([int(n[3:5], 16)]) if b else n.replace(MARKER, " ").encode()
                   for n, c, b in zip(names, control, byte)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.sizes = np.array([len(x) for x in surface], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # pieces that only the library may render: unknown, and bytes of longer characters
        self.special = np.array([self.model.is_unknown(i) or (b and s[0] >= 128)
                                 for i, (b, s) in enumerate(zip(byte, surface))])

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks without their first marker, the added one in front included."""
        if MARKER in text:
            text = text.replace(MARKER, " ")
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or "  " in text:
            return [chunk[1:] for chunk in _MARKED.findall(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Int32 ids of each text, with the end id."""
        parts = [self.chunks(text) for text in texts]
        self.ids.setdefault("", self.lone)
        new: set[str] = set()
        for part in parts:
            try:
                deque(map(self.ids.__getitem__, part), 0)
            except KeyError:
                new.update(part)
        new -= self.ids.keys()
        if len(self.ids) + len(new) > TABLE_CHUNKS:
            self.ids.clear()
            self.ids[""] = self.lone
            new = set().union(*parts) - {""}
        fresh = sorted(new)
        for chunk, ids in zip(fresh, self.model.encode(fresh, num_threads=1)):
            self.ids[chunk] = np.array(ids, np.int32).tobytes()
        end = np.array([self.end], np.int32).tobytes()
        out = [b"".join(map(self.ids.__getitem__, part)) + end for part in parts]
        for chunk in fresh:
            if len(chunk) > KEPT_CHARS:
                del self.ids[chunk]
        return out

    def decode(self, values: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Text of each list of ids."""
        sizes = self.sizes[values]
        data = self.surface[rows.ragged(self.starts[values], sizes)].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        odd = np.concatenate([[0], np.cumsum(self.special[values])])[offsets]
        out = []
        for k in range(len(offsets) - 1):
            if odd[k + 1] > odd[k]:
                out.append(self.model.decode(values[offsets[k]:offsets[k + 1]].tolist()))
            else:
                text = data[at[k]:at[k + 1]].decode()
                out.append(text[1:] if text[:1] == " " else text)
        return out


def chunk_table(path: str) -> ChunkTable:
    """The table of this Python worker."""
    if path not in _tables:
        _tables[path] = ChunkTable(path)
    return _tables[path]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the piece ids of every whole text, the end id last.

    Null and empty texts have the end id alone. Row order and repeated rows
    do not matter; a column named ``ids`` is replaced, all others are kept.
    """
    rows.ship(df.sparkSession)
    kept = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned = chunk_table(path)
        for batch in batches:
            for part in rows.slices(batch, text):
                found = owned.encode(part.column(text).fill_null("").to_pylist())
                offsets = np.cumsum([0] + [len(x) // 4 for x in found])
                column = rows.list_array(np.frombuffer(b"".join(found), np.int32), offsets)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [column], [*kept, ids])

    return df.mapInArrow(run, rows.extended(df, kept, f"`{ids}` array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` replaced by their text; null and no ids give ''."""
    rows.ship(df.sparkSession)
    kept = [c for c in df.columns if c not in (ids, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned = chunk_table(path)
        for batch in batches:
            at, n = 0, batch.num_rows
            while at < n:  # rows with at most SLICE_IDS ids, one row at least
                column = batch.column(ids).slice(at)
                lengths = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
                end = max(1, int(np.searchsorted(lengths, SLICE_IDS, "right")))
                column = column.slice(0, end)
                values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                found = owned.decode(values, np.concatenate([[0], lengths[:end]]))
                part = batch.slice(at, end)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(found, pa.string())],
                                                 [*kept, text])
                at += end

    return df.mapInArrow(run, rows.extended(df, kept, f"`{text}` string"))
