"""Secret scans against the expressions in Python."""

import hashlib
import random
import re

import pytest

from tiescope.llm import queries, secretscan
from tiescope.llm.secretscan import Rule

#: Java's letters without case are ASCII here.
FLAGS = re.ASCII


def by_loops(text, rules=secretscan.RULES):
    found = []
    for place, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", FLAGS):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), place, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def spans_of(row):
    return [tuple(s) for s in row.spans]


def odd_texts(n=300):
    draw = random.Random(4)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", '"', "'", " ", ":", "=", "abcDEF012345", "é", "中", "\U0001f600",
             "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh.eyJabcdefgh.abcdefgh_1",
             "ghp_abcdefghij0123456789", "https://me:pw@host", "\n", "x", "﷐", "﷒", "ſecret=abcdefghijklmnop"]
    return ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(n)] + [None, "", " ", "a" * 100000,
            "token=" + "x" * 100000, "token=password:abcdefghijklmnop ", "0" * 16 + "g" + "f" * 15, "0123456789abcdef " * 5000]


def test_against_loops(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: spans_of(r) for r in secretscan.scan(df).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        assert found[k] == by_loops(text), text[:200]
    assert sum(map(len, found.values())) > 300


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "token=abcdefghijkl", "a", 1, "x"), (1, "token=abcdefghijkl", "a", 1, "x"), (None, None, None, 2, "y")],
                               "_row long, text string, `place` string, nth int, spans string")
    found = secretscan.scan(df)
    assert found.columns == ["_row", "text", "place", "nth", "spans"]
    rows = sorted((r._row or 0, r.text or "", spans_of(r)) for r in found.collect())
    assert rows == [(0, "", []), (1, "token=abcdefghijkl", [("assign", 0, 18)]), (1, "token=abcdefghijkl", [("assign", 0, 18)])]
    assert secretscan.scan(df.filter("nth = 9")).count() == 0


@pytest.mark.parametrize("rules", [(Rule("digits", "[0-9]{3,}"),), (Rule("word", "(?:abc|abd)x?ef"), Rule("end", "^start"))])
def test_own_rules(spark, rules):
    texts = ["abcef 123", "abdxef", "start 12 abcxef abdef", "restart", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secretscan.scan(df, rules=rules).collect():
        assert spans_of(r) == by_loops(texts[r.doc_id], rules)


@pytest.mark.parametrize("pattern", [r.pattern for r in secretscan.RULES] + [
    "abc", "ab", "(?:abcd|bcde)+x", "a(?:bc)?def", "(abc){2}", "x.*yzz", "[ab]cd[0-9]efg", "(?i)KeY=.{3}", "abc|x", "(?=foo)foobar", "a?b?c?d?"])
def test_queries_hold_for_all_matches(pattern):
    draw = random.Random(pattern)
    found = secretscan.query(pattern)
    tried = ["".join(draw.choices("abcdefxyzKkEe=0123foobar_ ", k=12)) for _ in range(3000)] + [t or "" for t in odd_texts(200)]
    tried += ["abcdbcdex", "abcabc", "adef", "abcdef", "xyyzz", "acd0efg", "KEY=123", "foobar"]
    for text in tried:
        if re.search(pattern, text, FLAGS):
            low = text.lower()
            assert any(all(t in low for t in part) for part in found)


def test_postings(spark):
    """Bitmaps over more rows than one holds."""
    df = spark.range(70000).selectExpr(
        "id as _row", "case when id % 1000 = 0 then 'abcd' when id % 7 = 0 then 'abc' else 'x' end as text")
    queries_ = {"k": secretscan.query("abcd")}
    found = secretscan.candidates(secretscan.index(df, ["abc", "bcd"]), queries_).collect()
    assert sorted(r._row for r in found) == list(range(0, 70000, 1000))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op11_secrets(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        own = by_loops(texts[r.doc_id])
        told = [":".join(map(str, s)) for s in own if s[0] in secretscan.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in own) for k in secretscan.BASE]
        assert r.spans == ",".join(":".join(map(str, s)) for s in own)
    assert sum(r.n_assign for r in found) > 0
