"""Toxicity, language, line quality, packing, nearest neighbours."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tiescope.llm import ann, language, linequality, packing, queries, toxicity
from tiescope.llm.words import hashes

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def toxic_rows(n=400):
    draw = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(n):
        sentences = [" ".join(draw.choices(words, k=8)) + "." for _ in range(6)]
        if k % 4 == 0:
            sentences[2] = " ".join(draw.choices(words, k=3) + [draw.choice(["vile", "awful"])]) + "!"
        rows.append((k, "\n".join(sentences), int(k % 4 == 0)))
    return rows


def test_toxicity_from_document_labels(spark):
    df = spark.createDataFrame(toxic_rows(), "doc_id long, text string, label int")
    model = toxicity.fit(df.filter("doc_id < 300"))
    found = toxicity.score(df, model).filter("doc_id >= 300").collect()
    assert all((r.score >= 0.5) == bool(r.label) for r in found)
    for r in found:  # the sentence that carries the label is found
        spots = [r.text[s.start:].split("\n")[0] for s in r.offending]
        assert len(spots) == r.label and all("vile" in s or "awful" in s for s in spots)


def test_noisy_or_by_loops(spark):
    """Scores from the sums over each sentence's different features."""
    draw = np.random.default_rng(3)
    weights = draw.normal(size=1 << toxicity.FEATURE_BITS).astype(np.float32)
    model = toxicity.Model(weights, -1.5)
    words = ["Ab", "cd", "efghijklm", "é1", "ZZ"]
    texts = ["".join(draw.choice([*words, " ", " ", ". ", "!", "\n", "-"], size=draw.integers(0, 40))) for _ in range(60)]

    def features(word):
        data = np.frombuffer(word.encode(), np.uint8)
        shift, half = np.uint64(65 - toxicity.FEATURE_BITS), 1 << toxicity.FEATURE_BITS - 1
        one = lambda n: int(hashes(data, np.array([0]), np.array([n]))[0] >> shift)
        return {one(len(data)), one(min(len(data), toxicity.PREFIX)) + half}

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, model).collect():
        clean, spots = 1.0, 0
        for sentence in re.split("[.!?\n]", texts[r.doc_id]):
            known = set().union(*(features(w) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", sentence)))
            if known:
                chance = 1 / (1 + np.exp(1.5 - sum(float(weights[f]) for f in known)))
                clean, spots = clean * (1 - chance), spots + (chance >= toxicity.OFFENDING)
        assert np.isclose(r.score, 1 - clean, atol=1e-5) and len(r.offending) == spots


def test_toxicity_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "", "a"), (2, "...", "a"), (3, "x " * 30000, "a")],
                               "doc_id long, text string, offending string")
    model = toxicity.fit(spark.createDataFrame(toxic_rows(), "doc_id long, text string, label int"))
    found = toxicity.score(df, model).collect()
    assert [r.score for r in found][:3] == [0, 0, 0] and all(0 <= r.score <= 1 for r in found)
    none = df.selectExpr("doc_id", "text", "1 as label")
    assert toxicity.score(df, toxicity.fit(none.filter("doc_id = 9"))).count() == 4
    assert all(r.score > 0.99 for r in toxicity.score(df, toxicity.fit(none)).filter("doc_id = 3").collect())


def test_toxicity_and_language_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = queries.op3_toxicity(spark, SF).collect()
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.8
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op4_language(spark, SF).collect()
    assert len(found) == len(langs)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in found if r.held_out]) > 0.97


def test_profiles_by_hand(spark):
    rows = [("ab ab", "x"), ("ab", "x"), ("ÇD cd", "y"), (None, "y"), ("zz", None)]
    found = language.profiles(spark.createDataFrame(rows, "text string, lang string")).collect()
    counts = collections.Counter()
    for text in ("ab ab", "ab"):
        for word in text.split():
            padded = f" {word} "
            for n in (1, 2, 3):
                for k in range(len(padded) - n + 1):
                    gram = padded[k:k + n]
                    if n == 1 and gram == " ":
                        continue
                    counts[gram] += 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    expected = sorted(counts, key=lambda g: (-counts[g], code(g)))
    assert [r.gram for r in sorted(found, key=lambda r: r.rank) if r.lang == "x"] == [code(g) for g in expected]
    assert {r.lang for r in found} == {"x", "y"}


def test_language_of_odd_rows(spark):
    profile = language.profiles(spark.createDataFrame([("the cat", "en"), ("der hund", "de")], "text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 !"), (4, "the"), (4, "the"), (None, "hund"), (5, "der " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.lang_pred) for r in language.predict(df, profile).collect()]
    assert found == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (5, "de")]
    assert {r.lang_pred for r in language.predict(df, profile.filter("rank < 0")).collect()} == {"und"}
    assert language.predict(df.filter("doc_id = 9"), profile).count() == 0


def test_many_languages_and_letters(spark):
    """Joined profiles give what sent ones give; a slice with very many letters takes wide keys."""
    draw = random.Random(11)
    letters = [chr(c) for c in range(0x4E00, 0x9F00)] + [chr(c) for c in range(0xAC00, 0xD7A0)]
    texts = ["".join(draw.choices(letters[k * 200:k * 200 + 400], k=30)) for k in range(150)]
    df = spark.createDataFrame([(k, t, f"l{k % 50:02d}") for k, t in enumerate(texts)] + [(200, None, "x"), (201, "12", "y")],
                               "doc_id long, text string, lang string")
    profile = language.profiles(df)
    sent = language.predict(df, profile).collect()
    joined = language.predict(df, profile, sent=10).collect()
    assert sorted(map(str, sent)) == sorted(map(str, joined)) and len({r.lang_pred for r in sent}) > 10
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    group = np.arange(len(texts))
    narrow = language.grams(data, offsets, group)
    most = 1 << 40  # as many groups as make the keys too large
    wide = language.grams(data, offsets, group + most)
    assert all(np.array_equal(a, b) for a, b in zip(narrow, (wide[0] - most, *wide[1:])))


def base(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k:k + 3])] > 1:
            repeated |= {k, k + 1, k + 2}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(repeated))


def test_base_counts(spark):
    draw = random.Random(6)
    parts = ["a", "b c", "é#", "\n", "\n\n", " ", "\t", "|x|", "z\x0b", "a b c", " ", "中 "]
    made = ["".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(200)] + [None, "", " \n ", "w " * 20000]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    model = linequality.fit(df.selectExpr("doc_id", "text", "1 as label"))  # one class: all lines are content
    for r in linequality.judge(df, model).collect():
        n = base(made[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed)
    assert linequality.judge(df.filter("doc_id < 0"), model).count() == 0


def test_viterbi_and_gradient():
    """Decoding and marginals against all markings of short sequences."""
    import itertools

    draw = np.random.default_rng(0)
    model = linequality.Model(np.zeros(1), draw.normal(size=(2, 2)), draw.normal(size=2))
    lengths = np.array([1, 4, 2, 5])
    begin = np.cumsum(lengths) - lengths
    scores = draw.normal(size=lengths.sum())
    marks = linequality.viterbi(model, scores, begin, lengths)
    chance, _, _ = linequality._expected(model, scores, begin, lengths)
    for b, n in zip(begin, lengths):
        value = {}
        for way in itertools.product((0, 1), repeat=int(n)):
            value[way] = (model.first[way[0]] + sum(model.steps[x, y] for x, y in zip(way, way[1:]))
                          + sum(scores[b + k] * way[k] for k in range(n)))
        assert tuple(marks[b:b + n]) == max(value, key=value.get)
        total = sum(map(np.exp, value.values()))
        for k in range(n):
            assert np.isclose(chance[b + k], sum(np.exp(v) for w, v in value.items() if w[k]) / total)


def test_quality_keeps_clean_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = [r for r in queries.op10_line_quality(spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept for r in found if labels[r.doc_id] == 1]) > 0.99
    assert np.mean([r.kept for r in found if labels[r.doc_id] == 0]) < 0.3


def test_lines_of_mixed_documents(spark):
    """Documents of both kinds of lines: the marks are those of the lines, not of the document."""
    draw = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    good = lambda: " ".join(draw.choices(words, k=draw.randint(12, 30))).capitalize() + "."
    junk = lambda: " ".join(w.upper() + "!!" for w in draw.choices(words, k=draw.randint(12, 30)))

    def document(label):
        n = draw.randint(6, 14)
        other = draw.randint(0, n // 4) if label else n - draw.randint(0, n // 4)  # junk lines
        kinds = [0] * other + [1] * (n - other)
        cut = draw.randint(0, n)
        kinds = kinds[cut:] + kinds[:cut]  # in a row, so that steps between the kinds are few
        return "\n".join(good() if k else junk() for k in kinds), kinds

    made = [(document(k % 2), k % 2) for k in range(400)]
    df = spark.createDataFrame([(k, text, label) for k, ((text, _), label) in enumerate(made)], "doc_id long, text string, label int")
    model = linequality.fit(df.filter("doc_id < 300"))
    held = [(text, kinds) for (text, kinds), _ in made[300:]]
    wrong = total = 0
    for text, kinds in held:
        data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        _, (_, _, features) = linequality.measures(data, offsets)
        marks = linequality.viterbi(model, features @ model.weights, np.array([0]), np.array([len(kinds)]))
        wrong += sum(a != b for a, b in zip(marks.tolist(), kinds))
        total += len(kinds)
    assert wrong < 0.03 * total
    shares = [r.content_share for r in linequality.judge(df.filter("doc_id >= 300"), model).collect()]
    between = [0.05 < s < 0.95 for s, (_, kinds) in zip(shares, held) if 0 < sum(kinds) < len(kinds)]
    assert len(between) > 30 and np.mean(between) > 0.9


def test_least_squares_plan():
    draw = np.random.default_rng(1)
    histogram = np.bincount(np.ceil(np.clip(draw.lognormal(4, 1, 20000), 1, 511) / 8).astype(int), minlength=65)
    histogram[0] = 0
    taken = packing.plan(histogram)
    used, filled = collections.Counter(), collections.Counter()
    for units, first, n, sequence, _ in taken:
        assert first == used[units]
        used[units] += n
        filled[sequence] += units
    assert all(v == 64 for v in filled.values())
    assert all(used[u] <= histogram[u] for u in used) and sum(used.values()) > 0.9 * histogram.sum()


@pytest.mark.parametrize("lengths", [[], [1], [4096, 4096, 1], [9000, 0, 5, 4095, 3000, 3000], list(range(1, 400))])
def test_pieces_tile(spark, lengths):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "row long, n long")
    pieces = packing.pack(df).collect()
    of, inside = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        of[p.row].append((p.start, p.length))
        inside[p.sequence_id].append((p.offset, p.length))
    for own, n in [(of[k], n) for k, n in enumerate(lengths)] + [(v, None) for v in inside.values()]:
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == n if n is not None else at <= 4096


def test_packing_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORDS))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op8_packing(spark, SF).toPandas()
    for doc, own in found.groupby("doc_id"):
        ids = np.array(library.encode(texts[doc], add_special_tokens=False).ids + [2], "<u4")
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
    assert set(found.doc_id) == set(texts)
    assert 1 - found["length"].sum() / (4096 * found.sequence_id.nunique()) < 0.02


def nearest(rows, k):
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in good:
        if q % 50 == 0:
            cos = lambda i: float(good[i] @ good[q] / (np.sqrt(good[i] @ good[i]) * np.sqrt(good[q] @ good[q])))
            out[q] = sorted(((-cos(i), i) for i in good if i != q))[:k]
    return out


def test_nearest(spark):
    draw = np.random.default_rng(5)
    rows = [(k, draw.normal(size=20).tolist()) for k in range(600)]
    rows += [(k, [1.0] * 20) for k in range(600, 900)]  # a third are equal
    rows += [(1000, None), (1001, [0.0] * 20), (1050, [None] * 20), (1100, [float("nan")] * 20), (None, [1.0] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, df.filter("vec_id % 50 = 0")).collect()
    expected = nearest(rows, 5)
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(expected)
    hits = [len({i for i, _ in got[q]} & {i for _, i in expected[q]}) for q in expected]
    assert np.mean(hits) >= 4.5
    assert [i for i, _ in got[600]] == [601, 602, 603, 604, 605]
    for q, own in got.items():
        truth = {i: -s for s, i in nearest(rows, 10 ** 6)[q]}
        assert all(abs(truth[i] - s) < 1e-12 for i, s in own)
    assert ann.search(df.filter("vec_id < 0"), df).count() == 0
    assert ann.search(df.filter("vec_id in (0, 1)"), df.filter("vec_id = 0")).count() == 1
    odd = spark.createDataFrame([(2000, [1.0, 2.0]), (2050, [1.0] * 19)], df.schema)
    again = ann.search(df.unionByName(odd), df.unionByName(odd).filter("vec_id % 50 = 0")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))  # other lengths take no part


def test_scan_keeps_the_nearest():
    draw = np.random.default_rng(8)
    points, asked = (draw.normal(size=(n, 64)) for n in (700, 40))
    points[100:140] = points[99]  # ties
    points, asked = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (points, asked))
    ids = draw.permutation(700)
    truth = ((points[None] - asked[:, None]) ** 2).sum(2)
    kth = np.sort(truth, axis=1)[:, 5]
    for bound, share in ((None, 1), (kth, 1), (kth * 0.8, 1), (kth * 1.5, 1)):
        query, point, distance = ann.scan(points, ids, asked, 6, bound)
        assert np.allclose(distance, truth[query, point], atol=1e-9)
        for q in range(40):
            best = sorted((round(truth[q, p], 9), ids[p]) for p in range(700) if bound is None or truth[q, p] <= bound[q] + 1e-9)[:6]
            mine = [(round(truth[q, p], 9), ids[p]) for p in point[query == q]]
            assert len(mine) <= 6 and len(set(mine) & set(best)) >= len(best) - 1
    few = ann.scan(points[:3], ids[:3], asked, 6)
    assert len(few[0]) == 120


def test_recall(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    expected = nearest(rows, 5)
    got = collections.defaultdict(set)
    for r in queries.op1_nearest(spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean([len(got[q] & {i for _, i in expected[q]}) / 5 for q in expected]) >= 0.9
