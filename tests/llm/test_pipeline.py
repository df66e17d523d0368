"""Every stage of the pipeline against loops, with repeated rows, null ids and columns named like own ones."""

import collections
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_llm_models import base
from test_pairs import components
from tiescope.llm import linededup, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out, as rows."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long_ = " ".join(f"word{k}" for k in range(90)) + ".\nAnother line of the same text, with a few more words in it."
    other = " ".join(f"term{k}" for k in range(80)) + ".\n" + " ".join(f"word{k}" for k in range(60)) + "."
    odd = [(None, long_, "en", "s"), (10 ** 6, long_, "en", "t"), (10 ** 6, long_, "en", "t"), (10 ** 6, other, "en", "u"),
           (None, None, None, None), (10 ** 6 + 1, "", "en", "s"), (None, other + " End.", "en", "s")]
    more = spark.createDataFrame([(*r, 0) for r in odd], docs.schema)
    docs = docs.unionByName(more).withColumns({"row": F.lit(77).cast("bigint"), "ord": F.lit("x"), "n_removed": F.lit(1)})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    current, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, current, folder)
        if name != "packing":
            out.write.parquet(f"{folder}/{name}")
            out = spark.read.parquet(f"{folder}/{name}")
            assert out.columns == docs.columns
            assert all(r.row == 77 and r.ord == "x" and r.n_removed == 1 for r in out.select("row", "ord", "n_removed").collect())
        kept[name] = ([tuple(r) for r in current.select("doc_id", "text", "source").collect()],
                      out.collect() if name == "packing" else [tuple(r) for r in out.select("doc_id", "text", "source").collect()])
        current = out
    return kept


def order(row):
    return (row[0] is None, row[0] or 0)


def test_quality(stages):
    given, kept = stages["quality"]
    passed = collections.Counter()
    for doc, text, source in given:
        n = base(text)
        if not (n[0] < 50 or 100 * n[4] > 50 * n[0]):
            passed[doc, text, source] += 1
    assert not collections.Counter(kept) - passed and len(kept) > 0.8 * sum(passed.values())


def test_lines(stages):
    given, kept = stages["lines"]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    connection.executemany("INSERT INTO docs VALUES (?, ?, ?)", given)
    told = connection.execute(linededup.SQL.format(docs="docs", sites=linededup.SITES)).fetchall()
    assert sorted(map(str, ((d, t) for d, t, _ in kept))) == sorted(map(str, ((d, t) for d, t, _ in told)))


def test_one_of_each_group(stages):
    given, kept = stages["near_duplicates"]
    rows = sorted(given, key=order)
    group = components(list(enumerate(r[1] for r in rows)))
    firsts = [rows[k] for k in range(len(rows)) if group[k][1] == k]
    assert collections.Counter(map(str, ((d, t) for d, t, _ in kept))) == collections.Counter(map(str, ((d, t) for d, t, _ in firsts)))
    assert len(kept) < len(given)


def test_passages_are_cut(stages):
    given, kept = stages["passages"]
    rows = sorted(given, key=order)
    seen, expected = {}, []
    for k, (doc, text, _) in enumerate(rows):
        words = (text or "").split()
        runs = [tuple(words[at:at + 50]) for at in range(len(words) - 49)]
        for run in runs:
            seen.setdefault(run, k)
        gone = {w for at, run in enumerate(runs) if seen[run] != k for w in range(at, at + 50)}
        expected.append((doc, [w for n, w in enumerate(words) if n not in gone] if gone else text))
    got = [(doc, text if text in {r[1] for r in rows} else text.split()) for doc, text, _ in sorted(kept, key=order)]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_packing(stages):
    given, pieces = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORDS))
    tokens = collections.Counter()
    for doc, text, _ in given:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        tokens[doc, len(ids), sum(zlib.crc32(ids[a:a + 1].tobytes()) for a in range(len(ids)))] += 1
    assert sum(p.length for p in pieces) == sum(n * times for (_, n, _), times in tokens.items())
    inside = collections.defaultdict(list)
    for p in pieces:
        inside[p.sequence_id].append((p.offset, p.length))
    for own in inside.values():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at <= 4096
