"""Jaccard join, suffix dedup and line dedup against brute force."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tiescope.llm import jaccard, linededup, rows, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string, s string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near_copies(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = draw.choices(vocabulary, k=60)
    made = []
    for _ in range(15):
        base = draw.choices(vocabulary, k=draw.choice([3, 4, 5, 6, 8, 10, 15, 40, 120]))
        for _ in range(draw.choice([1, 2, 5, 70])):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                at = draw.randrange(len(text))
                text[at:at + draw.choice([0, 1, 1])] = [draw.choice(vocabulary)]
            made.append(" ".join(text))
    for _ in range(90):  # a passage that many documents share
        own = draw.choices(vocabulary, k=draw.choice([6, 12, 20, 60]))
        made.append(" ".join(own[:3] + passage + own[3:]))
    made += ["", None, " \n", "a", "A b", "a B", made[0], made[0]]
    draw.shuffle(made)
    return list(enumerate(made))


def components(rows):
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    held = collections.defaultdict(list)
    for k in sorted(sets):
        both = collections.Counter()
        for shingle in sets[k]:
            both.update(held[shingle])
            held[shingle].append(k)
        for other, n in both.items():
            if 100 * n >= 75 * (len(sets[k]) + len(sets[other]) - n):
                a, b = sorted((root(k), root(other)))
                parent[b] = a
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize("full_block", [48, 3])
def test_components(spark, monkeypatch, full_block):
    """All links, also where crowded blocks are taken back or compared in cells."""
    monkeypatch.setattr(jaccard, "FULL_BLOCK", full_block)
    rows = near_copies(full_block)
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], DOC).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == components(rows)


def test_components_of_odd_tables(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text, "", ""), (5, text, "", ""), (5, text, "", ""), (None, None, "", ""),
                                  (None, "x", "", "")], DOC)
    got = sorted(jaccard.near_duplicates(docs).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [
        ("5", 3, "5"), ("5", 3, "5"), ("None", 0, "None"), ("None", 1, "None"), ("None", 3, "5")]
    assert jaccard.near_duplicates(docs.filter("doc_id = 9")).count() == 0


def test_sketches_bound_the_difference():
    import numpy as np
    import pyarrow as pa

    from tiescope.llm.rows import raw_text

    rows = [t for _, t in near_copies(9) if t and shingles(t)][:80]
    token, begin = jaccard.shingle_sets(*raw_text(pa.array(rows)))
    sketches = jaccard.bit_sketches(token, begin)
    sets = [set(token[a:b].tolist()) for a, b in zip(begin, begin[1:])]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in rows]
    for i in range(len(rows)):
        for k in range(i):
            linked = 100 * len(sets[i] & sets[k]) >= 75 * len(sets[i] | sets[k])
            assert not linked or jaccard.near_enough(sketches[i], sketches[k], len(sets[i]), len(sets[k]))
    assert np.all(np.diff(begin) > 0)


def passages(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    shared = [draw.choices(vocabulary, k=n) for n in (40, 49, 66, 80, 120, 300)]
    made = []
    for _ in range(150):
        text = []
        for _ in range(draw.choice([0, 1, 1, 2])):
            text += draw.choices(vocabulary, k=draw.randint(0, 60)) + draw.choice(shared)
        made.append(text + draw.choices(vocabulary, k=draw.randint(0, 60)))
    return [(k, "\n".join([" ".join(t[:7]), " ".join(t[7:])])) for k, t in enumerate(made)], shared


def test_passages(spark):
    """Every passage of 50 words and more that an earlier document has, and only words of such runs."""
    rows, shared = passages(2)
    rows += [(900, None), (901, ""), (902, "short"), (None, "null key")]
    seen = {}
    for k, text in rows:
        words = (text or "").split()
        for at in range(len(words) - 49):
            seen.setdefault(tuple(words[at:at + 50]), k)
    expected = {}
    for k, text in rows:
        words = (text or "").split()
        expected[k] = {w for at in range(len(words) - 49) if seen[tuple(words[at:at + 50])] != k
                       for w in range(at, at + 50)}
    docs = suffixes.numbered(spark.createDataFrame([(k, t, "", "") for k, t in rows], DOC).repartition(3))
    found = suffixes.repeats(docs)
    got = collections.defaultdict(set)
    for r in found.filter("removed").join(docs.select("row", "ord"), "row").collect():
        got[r.ord].update(range(r.start, r.start + r.size))
    assert all(got[k] <= expected[k] for k in expected if k is not None)
    before = set()
    for k, text in rows:
        words = (text or "").split()
        for number, passage in enumerate(shared):
            for at in range(len(words) - len(passage) + 1):
                if len(passage) >= 50 and words[at:at + len(passage)] == passage:
                    if number in before:
                        assert got[k] >= set(range(at, at + len(passage)))
        before |= {n for n, passage in enumerate(shared) if " ".join(passage) in " ".join(words)}
    for r in suffixes.remove(docs, found).collect():
        text = dict(rows).get(r.ord if r.ord < 1 << 62 else None)
        if not got[r.ord]:
            assert r.text == text
        else:
            assert r.text.split() == [w for k, w in enumerate(text.split()) if k not in got[r.ord]]


def test_texts_without_removed_passages_are_not_joined(spark, monkeypatch):
    """Only the documents that lose a passage, and few others, meet the spans."""
    draw = random.Random(5)
    passage = [f"p{draw.random()}" for _ in range(60)]
    texts = [" ".join(f"{k}x{n}" for n in range(40)) for k in range(200)] + [None, ""]
    texts += [" ".join([f"{k}a", *passage, f"{k}b"]) for k in range(3)]
    docs = suffixes.numbered(spark.createDataFrame([(k, t, "", "") for k, t in enumerate(texts)], DOC).repartition(3))
    found = suffixes.repeats(docs)
    parted, parts = suffixes._parted, []
    monkeypatch.setattr(suffixes, "_parted", lambda *given: parts.append(parted(*given)) or parts[-1])
    got = {r.ord: r.text for r in suffixes.remove(docs, found).collect()}
    assert got == dict(enumerate(texts)) | {203: "1a 1b", 204: "2a 2b"}
    touched, others = ({r.ord for r in part.collect()} for part in parts[0])
    assert {203, 204} <= touched and len(touched) < 10 and others == set(range(len(texts))) - touched


def templates(seed):
    """Documents around templates of 35 to 49 words, of which some share the words beside the template too."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(900)]
    made = []
    for size in (35, 38, 40, 43, 46, 49):
        template = draw.choices(vocabulary, k=size)
        sides = [[draw.choices(vocabulary, k=draw.randint(4, 16)) for _ in range(6)] for _ in range(2)]
        for _ in range(40):
            left, right = (draw.choice(side) if draw.random() < 0.5 else [] for side in sides)
            made.append(draw.choices(vocabulary, k=draw.randint(0, 30)) + left + template + right
                        + draw.choices(vocabulary, k=draw.randint(0, 30)))
        for _ in range(6):  # the template twice in the text, of which the second place is shared
            made.append(template + draw.choices(vocabulary, k=9) + draw.choice(sides[0]) + template + draw.choice(sides[1]))
    made += [["same"] * 300, ["same"] * 120 + ["end"], draw.choices(vocabulary, k=20)]
    draw.shuffle(made)
    return [(k, " ".join(t)) for k, t in enumerate(made)]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_around_templates(spark, seed):
    """Exactly the words of the runs of 50 that an earlier document has, where many documents share the middle."""
    rows = templates(seed)
    seen, expected = {}, {}
    for k, text in rows:
        words = text.split()
        runs = [tuple(words[at:at + 50]) for at in range(len(words) - 49)]
        for run in runs:
            seen.setdefault(run, k)
        expected[k] = {w for at, run in enumerate(runs) if seen[run] != k for w in range(at, at + 50)}
    docs = suffixes.numbered(spark.createDataFrame([(k, t, "", "") for k, t in rows], DOC).repartition(3))
    got = collections.defaultdict(set)
    for r in suffixes.repeats(docs).filter("removed").join(docs.select("row", "ord"), "row").collect():
        got[r.ord].update(range(r.start, r.start + r.size))
    assert any(expected.values())
    assert [k for k, _ in rows if got[k] != expected[k]] == []


def test_passages_of_copies(spark):
    text = " ".join(f"v{k}" for k in range(70))
    docs = suffixes.numbered(spark.createDataFrame([(k, text, "", "") for k in (3, 3, 1, 2, None)], DOC))
    found = suffixes.repeats(docs).join(docs.select("row", "ord"), "row").collect()
    assert sorted((r.ord, r.start, r.size) for r in found if r.removed)[:3] == [(2, 0, 70), (3, 0, 70), (3, 0, 70)]
    assert {r.ord for r in found if not r.removed} == {1}
    assert suffixes.repeats(docs.filter("row < 0")).count() == 0


def test_lines(spark):
    draw = random.Random(4)
    head, foot, copied = "Head line.", "Foot line one.\nFoot line two.", "Only here.\nA longer line of this one document."
    rows = []
    for k in range(200):
        own = "\n".join(" ".join(draw.choices("abcdefgh", k=draw.randint(3, 30))) + f" {k}.{j}" for j in range(3))
        text = "\n".join(x for x in (head if k % 3 else "", own, foot if k % 5 == 0 else "", "  ") if x)
        rows.append((k, text, None if k % 7 == 0 else f"s{k % 14}", "extra"))
    rows += [(1000 + k, copied, f"s{k}", "copies") for k in range(14)]
    rows += [(2000, None, "s1", ""), (2001, "", "s1", ""), (2002, head, None, ""), (2002, head, None, ""), (None, foot, "s2", "")]
    docs = spark.createDataFrame(rows, DOC)
    got = linededup.clean(docs)
    assert got.columns == [*docs.columns, "n_removed"]
    got = got.toPandas()
    connection = duckdb.connect()
    connection.register("docs", docs.toPandas())
    sql = connection.sql(linededup.SQL.format(docs="docs", sites=linededup.SITES)).fetchall()
    clean = lambda x: None if x is None or x != x else x
    assert sorted(((clean(a), clean(b), int(c)) for a, b, c in zip(got.doc_id, got.text, got.n_removed)), key=str) == sorted(
        ((clean(a), clean(b), int(c)) for a, b, c in sql), key=str)
    assert set(got[got.doc_id.between(1000, 1013)].text) == {copied}
    assert linededup.clean(docs.filter("doc_id = -1")).count() == 0


def test_footers(spark):
    """A footer longer than the pages' own lines, and a line that pages of 20 sites share with near copies of one document."""
    footer, shared = "All rights reserved, see the terms and the privacy notice of this site. " * 3, "Subscribe to the letter."
    rows = [(k, f"own {k}\nshort {k}.\n{footer}", f"s{k % 30}", 0) for k in range(600)]
    body = [f"line {j} of the copied document with some words" for j in range(20)]
    rows += [(1000 + k, f"page {k}\ntext {k}\n{shared}", f"t{k % 20}", 1) for k in range(300)]
    for k in range(900):  # near copies: one line differs
        copy = [f"edited {k}" if j == k % 20 else line for j, line in enumerate(body)]
        rows.append((2000 + k, "\n".join([*copy, shared]), f"t{k % 20}", 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int")
    for names in ({}, {"source": "line", "n_removed": "_gone"}):  # columns named like own ones
        renamed = docs.withColumnsRenamed(names)
        got = linededup.clean(renamed, site=names.get("source", "source"))
        assert got.columns[:2] == ["doc_id", "text"] and got.columns[-1] == "n_removed" and len(set(got.columns)) == len(got.columns)
        for r in got.select("doc_id", "text", "n_removed").collect():
            lines = r.text.split("\n")
            assert r.n_removed == 1 and footer not in lines and shared not in lines
            assert len(lines) == (2 if r.doc_id < 2000 else 20)  # the copies keep their text


@pytest.mark.parametrize("cell_sets", [7, 1024])
def test_crowded_blocks_give_each_pair_once(spark, cell_sets):
    """All pairs of components that sizes and sketches allow, from one of the blocks that the two share."""
    draw = random.Random(9)
    sets = {}
    for k in range(60):
        base = range(1000 * (k % 3), 1000 * (k % 3) + 40 * (1 + k % 3))
        token = np.unique(np.array([draw.randint(0, 9) if draw.random() < 0.1 else x for x in base], np.uint64))
        sketch = jaccard.bit_sketches(jaccard.words.mix(token), np.array([0, len(token)]))[0]
        sets[k + 1] = (len(token), sketch, 1 + k % 10)
    blocks = {key: draw.sample(sorted(sets), 45) for key in (-5, 0, 8, 77)}
    member = [(key, s, sets[s][2], len(of)) for key, of in blocks.items() for s in of]
    crowded = spark.createDataFrame(member, "key bigint, s bigint, c bigint, many bigint")
    sizes = spark.createDataFrame([(s, n, x) for s, (n, x, _) in sets.items()], "s bigint, n bigint, sketch binary")
    found = sorted(tuple(r) for r in jaccard._all_pairs(crowded, sizes, cell_sets).collect())
    wanted = sorted({(a, b) for of in blocks.values() for a in of for b in of if a < b and sets[a][2] != sets[b][2]
                     and jaccard.near_enough(sets[a][1], sets[b][1], sets[a][0], sets[b][0])})
    assert found == wanted and len(wanted) > 100


def test_lists_that_met_before():
    lists = [[], [1, 4, 9], [2, 9], [3], [-7, 3], []]
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(6) for j in range(6)]))
    found = jaccard.met_before(pa.array(lists, pa.list_(pa.int64())), a, b)
    assert found.tolist() == [bool(set(lists[i]) & set(lists[j])) for i, j in zip(a, b)]


def test_shared_blocks_given_out_in_parts(spark, monkeypatch):
    """Blocks of more rows than a task holds keep every set and one head; sets from several tasks count once."""
    monkeypatch.setattr(jaccard, "HELD_ROWS", 6)
    draw = random.Random(5)
    rows = [(key, 1 + draw.randrange(most)) for key, most in ((-7, 1), (-3, 40), (2, 2), (5, 900), (8, 1), (9, 30))
            for _ in range(60)] + [(key, 5) for key in range(20, 60)]
    emitted = jaccard._sorted(spark.createDataFrame(rows, "key long, s long").repartition(4))
    plan = emitted._jdf.queryExecution().sparkPlan().toString()
    assert "Sort [key#" in plan and "s#" not in plan.split("Sort [")[1].split("]")[0]  # one number is sorted by its digits
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = jaccard._shared(emitted).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sets = collections.defaultdict(set)
    for key, s in rows:
        sets[key].add(s)
    assert {(r.key, r.s) for r in got} == {(k, s) for k, found in sets.items() if len(found) > 1 for s in found}
    heads = collections.defaultdict(set)
    for r in got:
        heads[r.key].add(r.head)
    assert all(len(found) == 1 and found <= sets[k] for k, found in heads.items())


def test_texts_come_in_batches_of_limited_bytes(spark):
    """A worker holds a few megabytes of text at once, not 10,000 texts."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat('some words ', 600) text")
    rows.ship(spark)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    found = [r.n for r in docs.mapInArrow(run, "n long").collect()]
    assert max(found) < 4 << 20 and len(found) > 4


def test_shingles_of_other_sets_are_not_moved(spark):
    """Sets that are held from earlier pairs stay where they are."""
    sets = spark.createDataFrame([(k, list(range(k, k + 8))) for k in range(200)], "s long, tokens array<long>")
    pairs = spark.createDataFrame([(3, 4), (3, 9)], "a long, b long")
    found = jaccard.verified(pairs, sets)
    assert [tuple(r) for r in found.collect()] == [(3, 4)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2


def test_components_where_names_of_blocks_fall_together(spark, monkeypatch):
    """Short names of blocks put others together; no link is lost and none is made by that."""
    monkeypatch.setattr(jaccard, "NAME_BITS", 7)
    rows_ = near_copies(11)
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows_], DOC).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == components(rows_)
