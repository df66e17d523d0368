"""Token counts from a finite-state transducer with counts on its edges.

A byte-level BPE vocabulary is compiled, edge by edge as texts need them, to
a deterministic transducer. After a prefix of a word, BPE's last token is the
only token that ends there and goes together with the last token before its
own start, so all that the next byte can depend on is: for each start from
which a vocabulary entry is still open, the entry's prefix read so far, the
last token before that start and the count there. That list is the state. An
edge carries the change of the token count, so the count of a word is the sum
over its edges, without making tokens.

A text is cut into blocks of a fixed size. Where a word begins, the state is
the start state whatever came before, so a block's state map is constant
after its first word start: all blocks run at once from there. For the heads
of the blocks (up to that place) the maps are filled lazily, for the entry
states that occur: all heads run at once, entered in the state that the block
before gives so far, and composed with it; heads whose entry changes by that run
again. The first blocks of a chain are right after each round, and as BPE falls
into step after a few bytes whatever it came from, so are nearly all others: a
run of any length without a word start takes few rounds.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tiescope.llm import rows

BLOCK_BYTES = 512
#: States kept in a worker; beyond, the automaton is compiled anew from the texts that follow.
MAX_STATES = 400_000
LETTER, NUMBER, SPACE, OTHER, NONE = range(5)
_automata: dict[str, "CountingTransducer"] = {}


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class CountingTransducer:
    """Counts tokens of texts as the vocabulary file's tokenizer does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False,
                                                           "trim_offsets": True, "use_regex": True}:
            raise ValueError("only plain byte-level vocabularies are compiled")
        self.words = library.pre_tokenizer
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        of = {c: b for b, c in enumerate(byte_characters())}
        self.tokens = {bytes(of[c] for c in name): i for name, i in spec["model"]["vocab"].items()
                       if all(c in of for c in name) and name.encode() not in self.special}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[bytes(of[c] for c in left), bytes(of[c] for c in right)] = rank
        self.made = {left + right: (left, right) for left, right in reversed(self.merges)}
        self.sides: dict[tuple[bytes, bool], list] = {}
        self.children: set[bytes] = {b""}  # prefixes that go on
        for token in self.tokens:
            self.children.update(token[:k] for k in range(1, len(token)))
        self.classes = np.full(0x110000, 255, np.uint8)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states but the start."""
        self.states = {((b"", None, 0),): 0}
        self.entries = [((b"", None, 0),)]
        self.columns = np.full(256, -1, np.int32)  # byte to column of the tables
        self.edges = np.full((4096, 32), -1, np.int32)  # target state, and the count's change plus 128 in the low byte

    def merged(self, text: bytes) -> list[bytes]:
        """Plain BPE of a short byte string."""
        parts = [text[k:k + 1] for k in range(len(text))]
        while len(parts) > 1:
            ranked = [(self.merges[pair], k) for k, pair in enumerate(zip(parts, parts[1:])) if pair in self.merges]
            if not ranked:
                break
            _, k = min(ranked)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def side(self, token: bytes, right: bool) -> list[tuple[bytes, float]]:
        """What stands at one end of a token while it is merged, and the rank that ends each."""
        key = (token, right)
        if key not in self.sides:
            steps, limit = [], math.inf
            while True:
                steps.append((token, limit))
                if token not in self.made:
                    break
                pair = self.made[token]
                limit, token = self.merges[pair], pair[right]
            self.sides[key] = steps[::-1]
        return self.sides[key]

    def follows(self, left: bytes | None, token: bytes) -> bool:
        """Whether BPE leaves ``token`` after ``left`` as it is: no merge across them comes first."""
        if token not in self.whole:
            self.whole[token] = self.merged(token) == [token]
        if left is None or not self.whole[token]:
            return self.whole[token]
        if (left, token) in self.pairs:
            return self.pairs[left, token]
        a, b = self.side(left, True), self.side(token, False)
        i = k = 0
        while True:
            across = self.merges.get((a[i][0], b[k][0]), math.inf)
            if across < a[i][1] and across <= b[k][1] and across < math.inf:
                answer = False
                break
            if a[i][1] == b[k][1] == math.inf:
                answer = True
                break
            if a[i][1] <= b[k][1]:
                i += 1
            else:
                k += 1
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[left, token] = answer
        return answer

    def edge(self, state: int, byte: int) -> None:
        """Compile one edge."""
        step, found, still = bytes([byte]), None, []
        for prefix, left, count in self.entries[state]:
            prefix += step
            if found is None and prefix in self.tokens and self.follows(left, prefix):
                found = (prefix, count + 1)
            if prefix in self.children:
                still.append((prefix, left, count))
        token, gain = found
        target = tuple([(p, t, n - gain) for p, t, n in still] + [(b"", token, 0)])
        number = self.states.setdefault(target, len(self.entries))
        if number == len(self.entries):
            self.entries.append(target)
            if number >= len(self.edges):
                self.edges = np.concatenate([self.edges, np.full_like(self.edges, -1)])
        self.edges[state, self.columns[byte]] = number << 8 | gain + 128

    def column(self, byte: int) -> None:
        """Give a new byte a column."""
        used = int(self.columns.max()) + 1
        if used == self.edges.shape[1]:
            self.edges = np.concatenate([self.edges, np.full_like(self.edges, -1)], 1)
        self.columns[byte] = used

    def run(self, data, flags, starts, ends, entry) -> tuple[np.ndarray, np.ndarray]:
        """State and count at the end of each range that is entered in ``entry``."""
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        starts, state, columns = starts[order], entry[order].astype(np.int64), self.columns[data]
        sorted_lengths = -lengths[order]
        count = np.zeros(len(starts), np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(sorted_lengths, -step, "left"))
            at = starts[:live] + step
            column = columns[at]
            now = state[:live]
            now[flags[at]] = 0
            width = self.edges.shape[1]
            edge = self.edges.ravel().take(now * width + column)
            while edge.min() < 0:
                missing = edge < 0
                for s, b in {*zip(now[missing].tolist(), data[at[missing]].tolist())}:
                    self.edge(s, b)
                edge = self.edges.ravel().take(now * width + column)
            count[:live] += (edge & 255) - 128
            state[:live] = edge >> 8
        out_state, out_count = np.empty_like(state), np.empty_like(count)
        out_state[order], out_count[order] = state, count
        return out_state, out_count

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point, asked once of the library's own word splitter."""
        found = self.classes[points]
        if (found == 255).any():
            for point in np.unique(points[found == 255]):
                char = chr(point)
                alone = lambda left: len(self.words.pre_tokenize_str(left + char)) == 1
                self.classes[point] = (LETTER if alone("a") else NUMBER if alone("1") else
                                       OTHER if alone("!") else SPACE)
            found = self.classes[points]
        return found

    def word_starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether each character begins a word; ``first`` marks those that begin a text."""
        n, kind = len(points), self.kinds(points)
        before, after = np.full(n, NONE, np.uint8), np.full(n, NONE, np.uint8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        before[first] = NONE
        after[:-1][first[1:]] = NONE
        point_before = np.zeros(n, points.dtype)
        point_before[1:] = points[:-1]
        space, space_before = kind == SPACE, before == SPACE
        starts = first | (space & ~space_before) | (space & space_before & (after < NONE) & (after != SPACE))
        starts |= ~space & space_before & (point_before != 32)
        starts |= ~space & ~space_before & (kind != before)
        # endings after an apostrophe that begins a word: 's 't 'm 'd 're 've 'll
        text_of = np.cumsum(first)
        for k in np.flatnonzero((points == 39) & starts).tolist():
            tail = "".join(map(chr, points[k + 1:k + 3][text_of[k + 1:k + 3] == text_of[k]].tolist()))
            size = 2 if tail[:1] and tail[0] in "stmd" else 3 if tail in ("re", "ve", "ll") else 0
            if size:
                starts[k + 1:k + size] = False
                if k + size < n:
                    starts[k + size] = True
        return starts

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a buffer."""
        if len(self.entries) > MAX_STATES:
            self.reset()
        total = np.zeros(len(offsets) - 1, np.int64)
        whole = data.tobytes()
        data, offsets, owner = self.without_special(whole, data, offsets, total)
        for byte in np.unique(data):
            if self.columns[byte] < 0:
                self.column(byte)
        if not len(data):
            return total
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        at = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.zeros(len(data), bool)
        first[heads] = True
        flags = np.zeros(len(data), bool)
        flags[at[self.word_starts(points, first[at])]] = True
        # blocks inside each text
        lengths = np.diff(offsets)
        blocks = -(-lengths // BLOCK_BYTES)
        text = np.repeat(np.arange(len(lengths)), blocks)
        number = rows.ragged(np.zeros(len(blocks), np.int64), blocks)
        begin = offsets[:-1][text] + number * BLOCK_BYTES
        end = np.minimum(begin + BLOCK_BYTES, offsets[1:][text])
        places = np.append(np.flatnonzero(flags), len(data))
        sync = np.minimum(places[np.searchsorted(places, begin)], end)
        state, count = self.run(data, flags, sync, end, np.zeros(len(sync), np.int64))
        # The blocks' heads: each block's map, filled for the entry states that occur. All run
        # at once, entered in what the block before gives so far; those whose entry changes run again.
        pending = np.flatnonzero(sync > begin)
        through = sync[pending] == end[pending]  # without a word start: the exit depends on the entry
        entry, gain = state[pending - 1], np.zeros(len(pending), np.int64)
        turn = np.arange(len(pending))
        while len(turn):
            own = pending[turn]
            left, gain[turn] = self.run(data, flags, begin[own], sync[own], entry[turn])
            state[own[through[turn]]] = left[through[turn]]
            given = state[pending - 1]
            turn = np.flatnonzero(given != entry)
            entry = given
        count[pending] += gain
        np.add.at(total, owner[text], count)
        return total

    def without_special(self, whole, data, offsets, total):
        """Parts between special strings, and their text; each special string counts one."""
        cuts = []
        for mark in self.special:
            at = whole.find(mark)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(mark) <= offsets[text + 1]:
                    cuts.append((at, at + len(mark), text))
                    at = whole.find(mark, at + len(mark))
                else:
                    at = whole.find(mark, at + 1)
        owner = np.arange(len(offsets) - 1)
        if not cuts:
            return data, offsets, owner
        kept = np.ones(len(data), bool)
        inner = np.array(sorted(c[0] for c in cuts))
        for begin, end, text in cuts:
            total[text] += 1
            kept[begin:end] = False
        before = np.concatenate([[0], np.cumsum(kept)])
        bounds = np.sort(np.concatenate([offsets[:-1], inner]), kind="stable")
        owner = np.searchsorted(offsets[:-1], bounds, "right") - 1
        # a text that begins with a special string has an empty part in front
        return data[kept], np.append(before[bounds], before[-1]), owner


def transducer(path: str) -> CountingTransducer:
    """The transducer of this Python worker."""
    if path not in _automata:
        _automata[path] = CountingTransducer(path)
    return _automata[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", tokens: str = "n_tokens") -> DataFrame:
    """``df`` with the token count of every whole text.

    Null and empty texts count 0. Special strings in a text count as one
    token each. A column named ``tokens`` is replaced, all others are kept.
    """
    rows.ship(df.sparkSession)
    kept = [c for c in df.columns if c != tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned = transducer(path)
        for batch in batches:
            for part in rows.slices(batch, text):
                found = owned.count(*rows.raw_text(part.column(text)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(found)], [*kept, tokens])

    return df.mapInArrow(run, rows.extended(df, kept, f"`{tokens}` bigint"))
