"""Repair of the structure of conversations, by iterative-deepening A*.

A row is kept (cost 0), gets another role (2) or is deleted (3); empty rows of
a user or an assistant may be put in anywhere (2). Blank and repeated rows must
be deleted, a truncated row that stays costs 1 more. The repaired roles must
read ``(s?(ua)+)?`` by their initials. So each state of the search, (rows read,
last role), allows one role to come next, and the string of the edits' initials
says the whole repair.

The search is depth-first in ASCII order of the initials (D, I, K, R), under a
bound on the cost that rises to the least cost at which the last round gave up.
A table holds the failed states, each with the cost that is known to be needed
from there on. The first path accepted is the cheapest, and of these the
ASCII-least.

A conversation of up to ROWS rows is searched as a whole, inside the task that
reads it in order. A longer one is cut into blocks. Each block is searched from
each role before it to each role after it, in parallel; the costs of the blocks
are put together for each conversation, and the texts go through the digest,
which is sequential, as a stream of blocks. Equal prefixes decide ties right:
two ways through a block are never prefixes of each other, as both read all its
rows and end with a row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiescope.llm import rows
from tiescope.session import stage

#: Rows and text bytes of a conversation that are held and searched at once.
ROWS = 512
BYTES = 8 << 20
BLANKS = " \t\n\v\f\r"
FAR = 1 << 60

START, SYSTEM, USER, ASSISTANT = range(4)
#: Role that may come next after each state, other than a system row at the start.
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL = {"su", "ua", "au"}
NAMES = {USER: "user", ASSISTANT: "assistant"}


def _kept(letter: str, state: int) -> int:
    """State after a row with this initial is kept, -1 where it may not stand."""
    if letter == "s":
        return SYSTEM if state == START else -1
    if letter == "u":
        return USER if state != USER else -1
    return ASSISTANT if letter == "a" and state == USER else -1


def _bounds(codes: str) -> list[int]:
    """Cost that is needed from each row on: forced deletions, truncated rows, odd roles, illegal neighbours.

    An edit that costs 2 or 3 touches two pairs of neighbours at most, so each
    illegal pair costs 1.
    """
    left = [0] * (len(codes) + 1)
    after = ""
    for at in range(len(codes) - 1, -1, -1):
        code = codes[at]
        if code == "X":
            left[at] = left[at + 1] + 3
            continue
        role = code.lower()
        need = int(code.isupper())
        if role == "o":
            need = min(2 + need, 3)
        elif after and after != "o" and role + after not in LEGAL:
            need += 1
        left[at], after = left[at + 1] + need, role
    return left


class Search:
    """Repairs of one sequence of row codes; the table of failed states serves all starts.

    Codes: initial of the role (o: neither s, u nor a), upper case if truncated,
    X if the row must go. ``goal`` is the state to end in after the last row;
    without it the whole conversation is repaired, with rows put in at its end.
    """

    def __init__(self, codes: str, goal: int | None = None):
        self.codes, self.goal = codes, goal
        left = _bounds(codes)
        self.needed = [[n] * 4 for n in left]

    def edits(self, at: int, state: int) -> list[tuple[str, int, int, int]]:
        """(initial, cost, row, state) of the edits possible here, in ASCII order."""
        found = []
        more = at < len(self.codes)
        if more:
            found.append(("D", 3, at + 1, state))
        if more or self.goal is None:
            found.append(("I", 2, at, NEXT[state]))
        if more and self.codes[at] != "X":
            code = self.codes[at]
            late = int(code.isupper())
            kept = _kept(code.lower(), state)
            if kept >= 0:
                found.append(("K", late, at + 1, kept))
            found.append(("R", 2 + late, at + 1, NEXT[state]))
        return found

    def accepts(self, at: int, state: int) -> bool:
        if at < len(self.codes):
            return False
        return state in (START, ASSISTANT) if self.goal is None else state == self.goal

    def run(self, state: int = START) -> tuple[int, str] | None:
        """Least cost and its ASCII-least edits; None if the goal can't be reached."""
        needed = self.needed
        if not self.reachable(state):
            return None
        while True:
            path = self._under(state, needed[0][state])
            if path is not None:
                return needed[0][state], path

    def reachable(self, state: int) -> bool:
        """Whether the goal can be reached: without any row, or a system row, only from the start."""
        if self.goal == START:
            return state == START
        if self.goal == SYSTEM:
            return state == SYSTEM or state == START and not {"s", "S"}.isdisjoint(self.codes)
        return True

    def _under(self, state: int, bound: int) -> str | None:
        """Edits of a path that costs ``bound`` at most; else raises the table's entries on its way."""
        needed = self.needed
        if self.accepts(0, state):
            return ""
        stack = [[0, state, 0, None, 0]]  # row, state, cost so far, edits, the next of them
        path = []
        while stack:
            top = stack[-1]
            at, here, spent, edits, turn = top
            if edits is None:
                edits = top[3] = self.edits(at, here)
            while turn < len(edits):
                letter, cost, row, then = edits[turn]
                turn += 1
                if spent + cost + needed[row][then] <= bound:
                    break
            else:
                least = min((cost + needed[row][then] for _, cost, row, then in edits), default=FAR)
                needed[at][here] = max(needed[at][here], min(least, FAR))
                stack.pop()
                if path:
                    path.pop()
                continue
            top[4] = turn
            path.append(letter)
            if self.accepts(row, then):
                return "".join(path)
            stack.append([row, then, spent + cost, None, 0])
        return None


@functools.lru_cache(1 << 14)
def whole(codes: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    return Search(codes).run()


@functools.lru_cache(1 << 8)
def through(codes: str) -> dict[tuple[int, int], tuple[int, str]]:
    """{(state before, state after): (cost, edits)} of a block."""
    found = {}
    for goal in range(4):
        search = Search(codes, goal)
        for state in range(4):
            way = search.run(state)
            if way is not None:
                found[state, goal] = way
    return found


def repaired(edits: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """Lines ``role:text`` of the repaired rows."""
    lines, at = [], 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            state = _kept(roles[at][:1], state)
            lines.append(f"{roles[at]}:{texts[at]}")
            at += 1
            continue
        state = NEXT[state]
        if edit == "R":
            lines.append(f"{NAMES[state]}:{texts[at]}")
            at += 1
        else:
            lines.append(f"{NAMES[state]}:")
    return lines


def code(role: str, text: str, repeated: bool) -> tuple[str, str]:
    """Code of a row, and its fault ('' if none)."""
    end = text.rstrip(BLANKS)
    if not end:
        return "X", "blank"
    if repeated:
        return "X", "duplicate"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return (letter, "") if end[-1] in ".!?" else (letter.upper(), "truncated")


def damaged(conversations: DataFrame, kind: Column) -> DataFrame:
    """Rows with the damage that ``kind`` (a number) says: 0 drops, 1 empties the
    text, 2 takes out ``[.!?]``, 3 repeats the row, 4 makes it a user's.

    A dropped row stays as a marker (``gone``), so that its conversation is known.
    Null roles and texts become one space.
    """
    marked = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                  F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = (F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                         text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


class _Open:
    """The conversation that a task reads at the moment."""

    def __init__(self, conv, most: int):
        self.conv, self.most = conv, most
        self.count = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.last = None
        self.turns = 0
        self.before = None
        self.block = 0
        self.clear()

    def clear(self) -> None:
        self.codes, self.roles, self.texts, self.bytes = [], [], [], 0

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
            self.turns += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.count["illegal"] += 1
        self.before = role[:1]
        letter, fault = code(role, text, repeated)
        if fault:
            self.count[fault] += 1
        self.codes.append(letter)
        self.roles.append(role)
        self.texts.append("" if letter == "X" else text)
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.codes) >= self.most or self.bytes >= BYTES

    def give(self) -> dict:
        """The open rows as a block."""
        row = {"block": self.block, "codes": "".join(self.codes), "roles": self.roles, "texts": self.texts}
        self.block += 1
        self.clear()
        return row | {"conv_id": self.conv}

    def end(self) -> list[dict]:
        """Counts, with the repair if the conversation was never cut."""
        if self.turns:
            self.count["gaps"] = self.high - self.low + 1 - self.turns
        row = self.count | {"conv_id": self.conv}
        if self.block:
            return ([self.give()] if self.codes else []) + [row]
        cost, audit = whole("".join(self.codes))
        text = "\n".join(repaired(audit, START, self.roles, self.texts))
        return [row | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}]


def _in_order(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema)


def _read(df: DataFrame, key: str, most: int) -> DataFrame:
    """Counts and repairs of all conversations, and the blocks of those that were cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found, size, schema = None, [], 0, None
        for batch in batches:
            schema = schema or pa.schema([
                pa.field("conv_id", batch.schema.field("conv_id").type), *[pa.field(n, pa.int64()) for n in COUNTS + ["cost"]],
                pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string()), pa.field("block", pa.int64()),
                pa.field("codes", pa.string()), pa.field("roles", pa.list_(pa.string())), pa.field("texts", pa.list_(pa.string()))])
            for part in rows.slices(batch, "text"):
                columns = [part.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "gone", "nth")]
                for conv, turn, role, text, gone, nth in zip(*columns):
                    if current is None or conv != current.conv:
                        if current is not None:
                            found += current.end()
                        current = _Open(conv, most)
                    if not gone:
                        if current.full():
                            size += current.bytes
                            found.append(current.give())
                        current.add(turn, role, text, nth > 1)
                    if len(found) >= 1000 or size >= BYTES:
                        yield _in_order(found, schema)
                        found, size = [], 0
        if current is not None:
            yield _in_order(found + current.end(), schema)

    return df.mapInArrow(run, f"conv_id {key}, " + ", ".join(f"{n} bigint" for n in COUNTS + ["cost"])
                         + ", audit string, repaired_sha256 string, block bigint, codes string, roles array<string>, texts array<string>")


def _ways(blocks: DataFrame, key: str) -> DataFrame:
    """(conv_id, block, before, after, cost, place): ways through each block, ``place`` in ASCII order of one ``before``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for conv, block, codes in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "block", "codes"))):
                ways = sorted((before, edits, after, cost) for (before, after), (cost, edits) in through(codes).items())
                found += [(conv, block, before, after, cost, place) for place, (before, _, after, cost) in enumerate(ways)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], batch.schema.field("conv_id").type if not k else pa.int64()) for k in range(6)],
                ["conv_id", "block", "before", "after", "cost", "place"])

    return blocks.select("conv_id", "block", "codes").mapInArrow(
        run, f"conv_id {key}, block bigint, before bigint, after bigint, cost bigint, place bigint")


def _chosen(ways: DataFrame, key: str) -> DataFrame:
    """(conv_id, block, before, after, cost, tail): the cheapest chain of blocks; rows put in at the end in ``tail``."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tails = {START: (0, ""), SYSTEM: (4, "II"), USER: (2, "I"), ASSISTANT: (0, "")}
        rest = {state: cost for state, (cost, _) in tails.items()}
        choice = {}
        for block, own in sorted(((b, f) for b, f in frame.groupby("block")), reverse=True, key=lambda x: x[0]):
            best = {}
            for before, after, cost, place in zip(own.before, own.after, own.cost, own.place):
                if after in rest:
                    best[before] = min(best.get(before, (FAR,)), (cost + rest[after], place, after, cost))
            choice[block] = best
            rest = {before: way[0] for before, way in best.items()}
        found, state = [], START
        for block in sorted(choice):
            _, _, after, cost = choice[block][state]
            found.append((frame.conv_id.iloc[0], block, state, after, cost, ""))
            state = after
        found[-1] = (*found[-1][:4], found[-1][4] + tails[state][0], tails[state][1])
        return pd.DataFrame(found, columns=["conv_id", "block", "before", "after", "cost", "tail"])

    return ways.groupBy("conv_id").applyInPandas(
        run, f"conv_id {key}, block bigint, before bigint, after bigint, cost bigint, tail string")


def _joined(blocks: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """(conv_id, cost, audit, repaired_sha256) of the conversations that were cut."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "block", "codes", "roles", "texts", "before", "after", "cost", "tail")
        for batch in batches:
            for at in range(batch.num_rows):
                conv, block, codes, roles, texts_, before, after, cost, tail = (
                    batch.column(n)[at].as_py() for n in names)
                edits = through(codes)[before, after][1] + tail
                lines = repaired(edits, before, roles, texts_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv], batch.schema.field("conv_id").type), pa.array([block]), pa.array([cost]),
                     pa.array([edits]), pa.array(["\n".join(lines) if lines else None], pa.string())],
                    ["conv_id", "block", "cost", "edits", "lines"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kind = None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([current[0]], kind), pa.array([current[1]]), pa.array(["".join(current[2])]),
                 pa.array([current[3].hexdigest()])], ["conv_id", "cost", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for at in range(batch.num_rows):
                conv, cost, edits, lines = (batch.column(n)[at].as_py() for n in ("conv_id", "cost", "edits", "lines"))
                if current is None or conv != current[0]:
                    if current is not None:
                        yield row()
                    current = [conv, 0, [], hashlib.sha256(), False]
                current[1] += cost
                current[2].append(edits)
                if lines is not None:
                    current[3].update((("\n" if current[4] else "") + lines).encode())
                    current[4] = True
        if current is not None:
            yield row()

    on = F.col("b.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("b.block") == F.col("c.block"))
    pieces = (blocks.alias("b").join(chosen.alias("c"), on)
              .select("b.conv_id", "b.block", "codes", "roles", "texts", "before", "after", "c.cost", "tail")
              .mapInArrow(texts, f"conv_id {key}, block bigint, cost bigint, edits string, lines string"))
    return (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block")
            .mapInArrow(digest, f"conv_id {key}, cost bigint, audit string, repaired_sha256 string"))


def repair(conversations: DataFrame, kind: Column | None = None, most: int = ROWS) -> DataFrame:
    """One row per conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``conversations`` has conv_id, turn, role, text; other columns are not
    looked at. ``kind`` damages the rows first (see ``damaged``). A
    conversation of more than ``most`` rows is searched in blocks. Rows go by
    turn, nulls first, then role and text. A null conv_id is a conversation,
    null roles and texts are one space, so such a text is blank. A conversation
    without a row left has zeros, an empty audit and the digest of the empty
    string. An empty table gives no rows.
    """
    key = conversations.schema["conv_id"].dataType.simpleString()
    marked = damaged(conversations, F.lit(None).cast("int") if kind is None else kind)
    marked = marked.withColumn("gone", F.coalesce("gone", F.lit(False)))
    # one exchange serves the window and the stream
    own = marked.repartition("conv_id")
    seen = Window.partitionBy("conv_id", "gone", "h1", "h2").orderBy(F.asc_nulls_first("turn"))
    named = own.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("row"), "role", "text")})
    ordered = (named.withColumn("nth", F.row_number().over(seen))
               .select("conv_id", "turn", "role", "text", "gone", "nth")
               .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "nth"))
    rows.ship(conversations.sparkSession)
    read = stage(_read(ordered, key, most), "repair-read")
    columns = ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]
    done = read.filter("block is null")
    blocks = read.filter("block is not null")
    if blocks.isEmpty():
        return done.select(*columns)
    chosen = stage(_chosen(_ways(blocks, key), key), "repair-blocks")
    cut = _joined(blocks.select("conv_id", "block", "codes", "roles", "texts"), chosen, key)
    open_ = done.filter("cost is null").select("conv_id", *COUNTS).alias("d")
    long_ = open_.join(cut.alias("l"), F.col("d.conv_id").eqNullSafe(F.col("l.conv_id"))).select(
        "d.conv_id", *COUNTS, "cost", "audit", "repaired_sha256")
    return done.filter("cost is not null").select(*columns).unionByName(long_)


def kinds() -> Column:
    """Damage of a row by crc32 of ``conv_id:turn``, modulo 20 (nulls: one space)."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    return (F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20).cast("int")
