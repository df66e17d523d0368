"""Secrets in texts, by rules over a trigram index.

Each rule is a regular expression. From its parse tree a Boolean query over
trigrams is derived: an OR of ANDs that every match satisfies. The index holds,
for each trigram that the queries name, bitmaps of the documents that have it,
one bitmap for 32,768 documents in a row. Bitmaps are intersected within an AND
and united over the ANDs of a rule; what is left are candidates, whose texts are
verified with the expression. A rule without a query of its own reads all texts.

All steps are DataFrame expressions. Texts are lower-cased for the index, so one
index serves rules with and without case. Positions come from the expression
itself: matches are put between marks, the text is split there, and running
sums of the parts' lengths are the places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiescope.session import stage

#: Strings of one stretch, and ANDs of one query; what goes beyond makes the query weaker, never wrong.
STRINGS = 64
ANDS = 64

#: Marks around matches: code points that Unicode reserves from use. A text that has them gets PLAIN in their place.
OPEN, MID, CLOSE, PLAIN = "﷐", "﷑", "﷒", "﷓"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and the least code points of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in their order, then further kinds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("keyblock", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed", r"(?:ghp_|gho_|ghs_|xoxb-|xoxp-|sk_live_)[A-Za-z0-9-]{16,}"),
    Rule("login", r"://[^\x20\x09-\x0D:@/]{1,64}:[^\x20\x09-\x0D:@/]{1,64}@"),
)
BASE = ("assign", "access", "hex")


def _either(ands: set[frozenset[str]]) -> frozenset[frozenset[str]]:
    """An OR without the ANDs that another one implies; beyond ANDS it says nothing."""
    least = frozenset(a for a in ands if not any(b < a for b in ands))
    return least if len(least) <= ANDS else frozenset([frozenset()])


def _both(a: frozenset, b: frozenset) -> frozenset:
    joined = {x | y for x in a for y in b} if len(a) * len(b) <= ANDS * ANDS else {frozenset()}
    found = _either(joined)
    return found if found != frozenset([frozenset()]) else min(a, b, key=lambda q: (frozenset() in q, len(q)))


def _of(strings: set[str]) -> frozenset[frozenset[str]]:
    """Query of a stretch that is one of ``strings``."""
    return _either({frozenset(s[k:k + 3] for k in range(len(s) - 2)) for s in strings})


ANY = frozenset([frozenset()])


def _class(members: list) -> set[str] | None:
    """Characters of a small class, lower case; None for a large or negated one."""
    found: set[str] = set()
    for kind, value in members:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 4:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 4 else None


def _node(node: tuple) -> tuple[set[str] | None, frozenset]:
    """(the strings a part of an expression may be, or None, query that holds for it)."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}, ANY
    if kind is op.IN:
        return _class(value), ANY
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        ways = [_sequence(way) for way in value[1]]
        strings = None if any(s is None for s, _ in ways) else set().union(*(s for s, _ in ways))
        if strings is not None and len(strings) <= STRINGS:
            return strings, ANY
        return None, _either(set().union(*(_both(q, _of(s) if s is not None else ANY) for s, q in ways)))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, part = value
        strings, query = _sequence(part)
        if strings is not None and high == 1:
            return strings | ({""} if low == 0 else set()), ANY
        if low == 0:
            return None, ANY
        if strings is not None and low == high and len(strings) ** low <= STRINGS:
            found = {""}
            for _ in range(low):
                found = {a + b for a in found for b in strings}
            return found, ANY
        return None, _both(query, _of(strings)) if strings is not None else query
    if kind is op.AT:
        return {""}, ANY
    return None, ANY


def _sequence(parts) -> tuple[set[str] | None, frozenset]:
    """Like ``_node`` for parts in a row: stretches of known strings are ANDed."""
    query, open_, whole = ANY, {""}, True
    for part in parts:
        strings, own = _node(part)
        query = _both(query, own)
        if strings is not None and len(open_) * len(strings) <= STRINGS:
            open_ = {a + b for a in open_ for b in strings}
            continue
        whole = False
        query = _both(query, _of(open_))
        open_ = {""} if strings is None else strings
    return (open_, query) if whole else (None, _both(query, _of(open_)))


def query(pattern: str) -> frozenset[frozenset[str]]:
    """OR of ANDs of lower-case trigrams that every text with a match has; an empty AND says nothing.

    Groups, alternatives, classes, repeats and anchors are read; any other part
    of an expression stands for whatever text.
    """
    strings, found = _sequence(parser.parse(pattern))
    found = _both(found, _of(strings)) if strings is not None else found
    # only ASCII has one lower-case form here and in Spark
    return _either({frozenset(t for t in a if t.isascii()) for a in found})


def index(numbered: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, bucket, docs): bitmaps of the rows that have each trigram, by their row number.

    A posting is at most 4 KB, however many documents have the trigram.
    """
    # the lower-cased text is bound once for all trigrams
    here = F.flatten(F.transform(F.array(F.lower("text")), lambda low: F.filter(
        F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(low, t))))
    return (numbered.select(F.col("_row"), F.explode(here).alias("trigram"))
            .groupBy("trigram", F.bitmap_bucket_number(F.col("_row") + 1).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_row") + 1)).alias("docs")))


def candidates(postings: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """(kind, _row): rows that satisfy the query of a kind."""
    spark = postings.sparkSession
    wanted = [(kind, n, trigram, len(part)) for kind, ands in queries.items() for n, part in enumerate(sorted(map(sorted, ands)))
              for trigram in part]
    terms = spark.createDataFrame(wanted, "kind string, part int, trigram string, size int")
    both = (postings.join(F.broadcast(terms), "trigram").groupBy("kind", "part", "bucket")
            .agg(F.bitmap_and_agg("docs").alias("docs"), F.count("*").alias("n"), F.first("size").alias("size"))
            .filter("n = size"))
    either = both.groupBy("kind", "bucket").agg(F.bitmap_or_agg("docs").alias("docs"))
    # parts of 64 bytes, then bytes as two digits; only what isn't zero is opened
    part = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at")
    parts = either.select("kind", "bucket", "docs", part).select(
        "kind", "bucket", "at", F.hex(F.substring("docs", 64 * F.col("at") + 1, F.lit(64))).alias("digits"))
    byte = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("byte")
    bits = F.conv(F.substring("digits", 2 * F.col("byte") + 1, F.lit(2)), 16, 10).cast("int")
    opened = (parts.filter(F.col("digits") != "0" * 128).select("kind", "bucket", "at", "digits", byte)
              .select("kind", "bucket", (64 * F.col("at") + F.col("byte")).alias("byte"), bits.alias("bits")).filter("bits <> 0"))
    bit = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")
    return (opened.select("kind", "bucket", "byte", "bits", bit).filter(F.expr("shiftright(bits, bit) & 1 = 1"))
            .select("kind", ((F.col("bucket") - 1) * 32768 + F.col("byte") * 8 + F.col("bit")).alias("_row")))


def _parts(text: Column, rule: Rule) -> Column:
    """Text outside, match and group of each match in turn, and the text after the last."""
    plain = F.translate(text, OPEN + MID + CLOSE, PLAIN * 3)
    marked = F.regexp_replace(plain, F.lit(rule.pattern), F.lit(f"{OPEN}$0{MID}${rule.group}{CLOSE}"))
    return F.split(marked, f"[{OPEN}{MID}{CLOSE}]")


def _sizes(text: Column, rule: Rule, place: int) -> Column:
    """(place, least, threes): lengths outside, in and in the group of each match of a rule."""
    def by_threes(sizes: Column) -> Column:
        matches = F.floor(F.size(sizes) / 3).cast("int")
        numbers = F.filter(F.sequence(F.lit(0), matches), lambda k: k < matches)
        return F.transform(numbers, lambda k: F.struct(
            F.get(sizes, 3 * k).alias("outside"), F.get(sizes, 3 * k + 1).alias("size"), F.get(sizes, 3 * k + 2).alias("group")))

    sizes = F.transform(_parts(text, rule), lambda p: F.length(p))
    threes = F.element_at(F.transform(F.array(sizes), by_threes), 1)
    return F.struct(F.lit(place).alias("place"), F.lit(rule.least).alias("least"), threes.alias("threes"))


def _matches(texts: DataFrame, rules: dict[int, Rule], kinds: Column | None = None) -> DataFrame:
    """(_row, place, least, nth, outside, size, group): matches of the rules, where ``kinds`` has their kind."""
    told = [_sizes(F.col("text"), rule, place) for place, rule in rules.items()]
    if kinds is not None:
        told = [F.when(F.array_contains(kinds, rule.kind), sizes) for rule, sizes in zip(rules.values(), told)]
    return (texts.select("_row", F.explode(F.array(*told)).alias("told"))
            .select("_row", "told.place", "told.least", F.posexplode("told.threes").alias("nth", "m"))
            .select("_row", "place", "least", "nth", "m.*"))


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end) by start, then kind as in ``rules``.

    Places are code points from 0, ends exclusive. A null or empty text has an
    empty array. Repeated rows are scanned each for itself; other columns stay,
    but for one named ``spans``, which is replaced. Matches of one kind are the
    leftmost ones that don't overlap; those whose group is too short are dropped.
    """
    kept = [c for c in docs.columns if c != "spans"]
    # the caller's columns stay apart from the own ones
    numbered = stage(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"))
                     .withColumn("_row", F.monotonically_increasing_id()), "secrets-numbered")
    texts = numbered.select("_row", F.coalesce(F.col("_doc").getField(text), F.lit("")).alias("text"))
    queries = {rule.kind: query(rule.pattern) for rule in rules}
    bound = {kind: ands for kind, ands in queries.items() if frozenset() not in ands}
    free = {k: rule for k, rule in enumerate(rules) if rule.kind not in bound}
    found = []
    if free:
        found.append(_matches(texts, free))
    if bound:
        named = sorted({t for ands in bound.values() for a in ands for t in a})
        hits = candidates(index(texts, named), bound).groupBy("_row").agg(F.collect_set("kind").alias("kinds"))
        verified = texts.join(stage(hits, "secrets-candidates"), "_row")
        found.append(_matches(verified, {k: rule for k, rule in enumerate(rules) if rule.kind in bound}, F.col("kinds")))
    matches = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    until = Window.partitionBy("_row", "place").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.element_at(F.array(*[F.lit(rule.kind) for rule in rules]), F.col("place") + 1)
    spans = (matches.withColumn("end", F.sum(F.col("outside") + F.col("size")).over(until))
             .filter("group >= least").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(
                 (F.col("end") - F.col("size")).alias("start"), "place", kind.alias("kind"), "end"))).alias("spans")))
    plain = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return numbered.join(spans, "_row", "left").select(
        *[F.col("_doc").getField(c).alias(c) for c in kept], F.coalesce(plain, nothing).alias("spans"))


def _sql_rule(place: int, rule: Rule) -> str:
    """Matches of a rule in DuckDB: (n, place, kind, s, e)."""
    marked = (f"regexp_replace(text, '{rule.pattern.replace(chr(39), chr(39) * 2)}', "
              f"'{OPEN}' || chr(92) || '0{MID}' || chr(92) || '{rule.group}{CLOSE}', 'g')")
    return rf"""
  SELECT n, {place} AS place, '{rule.kind}' AS kind, e - size AS s, e FROM (
    SELECT n, size, grp, sum(outside + size) OVER (PARTITION BY n ORDER BY k) AS e FROM (
      SELECT n, k, length(p[3 * k - 2]) AS outside, length(p[3 * k - 1]) AS size, length(p[3 * k]) AS grp FROM (
        SELECT n, p, unnest(range(1, len(p) // 3 + 1)) AS k FROM (
          SELECT n, string_split_regex({marked}, '[{OPEN}{MID}{CLOSE}]') AS p FROM docs)))) WHERE grp >= {rule.least}"""


_TOLD = "kind || ':' || s::bigint || ':' || e::bigint"
#: The same for DuckDB, over the table documents.
SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, translate(coalesce(text, ''), '{OPEN}{MID}{CLOSE}', '{PLAIN * 3}') AS text
  FROM documents),
found AS ({" UNION ALL ".join(_sql_rule(k, rule) for k, rule in enumerate(RULES))})
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  sha256(coalesce(string_agg({_TOLD}, ',' ORDER BY s, place) FILTER (place < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({_TOLD}, ',' ORDER BY s, place), '') AS spans
FROM docs LEFT JOIN found USING (n) GROUP BY n, doc_id
"""
