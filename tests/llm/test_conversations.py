"""Conversation repair and prefix trie against brute force."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tiescope.llm import prefixtrie, queries, repair

SF = "/root/testdata/sf0.01"
PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(codes):
    """(cost, edits) by uniform-cost search over (row, roles so far), by cost, then ASCII."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, edits, at, state = heapq.heappop(heap)
        if at == len(codes) and state in (repair.START, repair.ASSISTANT):
            return cost, edits
        # the first to come out is the cheapest and ASCII-least of its state
        if (at, state) in done:
            continue
        done.add((at, state))
        then = repair.NEXT[state]
        heapq.heappush(heap, (cost + 2, edits + "I", at, then))
        if at < len(codes):
            heapq.heappush(heap, (cost + 3, edits + "D", at + 1, state))
            if codes[at] != "X":
                late = codes[at].isupper()
                heapq.heappush(heap, (cost + 2 + late, edits + "R", at + 1, then))
                kept = repair._kept(codes[at].lower(), state)
                if kept >= 0:
                    heapq.heappush(heap, (cost + late, edits + "K", at + 1, kept))


def exhaustive(codes):
    """The same from the definition: all edit strings up to a cost, checked by the pattern."""
    best = None
    for n_inserts in range(0, 4):
        for places in itertools.combinations_with_replacement(range(len(codes) + 1), n_inserts):
            for acts in itertools.product("DKR", repeat=len(codes)):
                if any(c == "X" and a != "D" for c, a in zip(codes, acts)):
                    continue
                edits = "".join("I" * places.count(k) + (acts[k] if k < len(codes) else "") for k in range(len(codes) + 1))
                cost = sum({"D": 3, "K": 0, "R": 2, "I": 2}[e] for e in edits) + sum(
                    c.isupper() and a != "D" for c, a in zip(codes, acts))
                if best is not None and (cost, edits) >= best:
                    continue
                options = []
                it = iter(codes)
                for e in edits:
                    c = next(it) if e != "I" else ""
                    if e == "K":
                        options.append(c.lower())
                    elif e in "RI":
                        options.append("ua")
                if any(PATTERN.fullmatch("".join(way)) for way in itertools.product(*options)):
                    best = (cost, edits)
    return best


def test_search_against_definition():
    draw = random.Random(3)
    for _ in range(150):
        codes = "".join(draw.choices("suaoUAX", k=draw.randint(0, 4)))
        assert repair.Search(codes).run() == exhaustive(codes) == cheapest(codes), codes


def test_search_on_long_rows():
    draw = random.Random(5)
    for n in (10, 40, 200):
        for _ in range(15):
            codes = "".join(draw.choices("suaoUAX", [1, 9, 9, 1, 2, 2, 2], k=n))
            assert repair.Search(codes).run() == cheapest(codes)


def test_ways_through_blocks():
    """Any cut of a row into blocks gives the repair of the whole."""
    draw = random.Random(6)
    tails = {repair.START: (0, ""), repair.SYSTEM: (4, "II"), repair.USER: (2, "I"), repair.ASSISTANT: (0, "")}
    for _ in range(60):
        codes = "".join(draw.choices("suaoUAX", k=draw.randint(2, 12)))
        cut = draw.randint(1, len(codes) - 1)
        first, then = repair.through(codes[:cut]), repair.through(codes[cut:])
        ways = [(c1 + c2 + tails[b][0], e1 + e2 + tails[b][1]) for (s, a), (c1, e1) in first.items() if s == repair.START
                for (a2, b), (c2, e2) in then.items() if a2 == a]
        assert min(ways) == cheapest(codes)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    found = {}
    hurt = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in hurt if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes, faults = set(), "", collections.Counter()
        for _, role, text in own:
            chars = re.findall(r"[^\x20\x09-\x0D]", text)
            if not chars:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            else:
                fault = "" if chars[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            letter = role[:1] if role[:1] and role[:1] in "sua" else "o"
            codes += "X" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest(codes)
        lines, last, it = [], "", iter(own)
        for e in audit:
            row = next(it) if e != "I" else (0, "", "")
            if e == "D":
                continue
            role = row[1] if e == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{row[2]}")
        found[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
                       hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def conversations(n=120):
    draw = random.Random(8)
    rows = []
    for conv in range(n):
        for turn in range(draw.choice([1, 2, 5, 8, 40]) if conv else 300):
            rows.append((conv, draw.choice([turn] * 9 + [None, turn + 3]), draw.choice(["user", "assistant", "system", "tool", "", None] if draw.random() < .2 else ["user", "assistant"]),
                         draw.choice(["a b.", "c!", "d", " \n", "é?  ", None, "", "x" * 50 + "."] + [f"{draw.random()}."] * 6)))
    return rows + [(None, None, "user", "a."), (None, 3, "assistant", "b."), (10 ** 6, 1, "user", None)] + rows[-3:]


@pytest.mark.parametrize("most", [512, 7])
def test_repair(spark, most):
    """Whole conversations, and the same cut into blocks."""
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("x")).withColumn("gone", F.lit(1))
    found = repair.repair(df, repair.kinds(), most).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == expected(rows) and len(found) == len({r[0] for r in rows})
    assert repair.repair(df.filter("conv_id = -1"), repair.kinds()).count() == 0


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in queries.op12_repair(spark, SF).collect()}
    assert found == expected(rows) and sum(r[5] for r in found.values()) > 0


def trie(rows):
    """Nodes from the definition."""
    told = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            told[conv].append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [t[2:] for t in sorted(own)] for c, own in told.items()}
    built = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(told.get(base, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, own in built.items():
        for d in range(len(own) + 1):
            members[own[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[:len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in own if len(built[c]) == len(path))))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), kids[path],
                    sum(not kids[p] for p in below), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def made(draw, n=260):
    rows = []
    for conv in [*range(0, n), -5, -105, -100, 1000, 777701]:
        for turn in range(draw.choice([1, 2, 3, 6, 8]) if conv % 97 else 30):
            rows.append((conv, None if draw.random() < .01 else turn, draw.choice(["user", None]), draw.choice(["a", "bé", "", None, "ccc"])))
    return rows + [(None, 1, "user", "x")]


@pytest.mark.parametrize("piece, shard", [(512, 40000), (512, 50), (4, 60)])
def test_trie(spark, monkeypatch, piece, shard):
    """One shard, many, and conversations cut into pieces."""
    monkeypatch.setattr(prefixtrie, "PIECE", piece)
    rows = made(random.Random(piece))
    # turns are told apart, so that the order within a conversation is defined
    rows = [(c, t, r, x) for (c, t), (r, x) in {(c, t): (r, x) for c, t, r, x in rows}.items()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("x")).withColumn("block", F.lit(0))
    block = F.col("conv_id") - F.col("conv_id") % 100
    heads = F.crc32(F.col("conv_id").cast("string")) % 6
    pieces = prefixtrie.rebuilt(prefixtrie.turns(df), block, 5, heads)
    assert (pieces.filter("piece > 0").count() > 0) == (piece == 4)
    found = sorted(map(tuple, prefixtrie.trie(pieces, block, shard).collect()), key=lambda r: (r[1], r[0]))
    assert found == trie(rows)
    none = prefixtrie.rebuilt(prefixtrie.turns(df.filter("conv_id = 999")), block, 5, heads)
    assert prefixtrie.trie(none, block).count() == 0


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_trie(spark, SF).collect()
    assert sorted(map(tuple, found), key=lambda r: (r[1], r[0])) == trie(rows)
