"""Piece ids, word ids and token counts against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tiescope.llm import pieces, queries, tokencount, wordids

PIECES, BYTES, WORDS = (public_tokenizers.path(x) for x in (queries.PIECES, queries.BYTES, queries.WORDS))
PARTS = [" ", "  ", "\n", "\t", "'s", "'re", "''", "a", "Z", "é", "É", "9", "12", "!", "<|endoftext|>", " ", "　",
         "ﬁ", "中", "\x1c", "\x85", "ll", "Don't", "'ll've", "😀", "́", "<|endof", "the ", "ing", "▁", "Σ", "İ", "×"]


def texts():
    draw = random.Random(3)
    made = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    return made + ["", None, " ", "   ", "a" * 3000 + "b" * 700, "word " * 3000, "\x00\n\r\n x  ", "x", "x"]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, text, "kept") for k, text in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_pieces(spark, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = pieces.encode(documents, PIECES)
    got = {r.doc_id: r for r in found.collect()}
    decoded = {r.doc_id: r for r in pieces.decode(found, PIECES).collect()}
    for k, text in enumerate(texts()):
        expected = model.encode(text or "") + [model.eos_id()]
        assert got[k].ids == expected and got[k].n_tokens == "kept"
        assert decoded[k].decoded == model.decode(expected)


def test_piece_table_is_emptied(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 3)
    table = pieces.ChunkTable(PIECES)
    for text in ("a b c d e f", "g h a b", "a  b"):
        assert np.frombuffer(table.encode([text])[0], np.int32).tolist()[:-1] == table.model.encode(text)


def test_piece_query(spark, tmp_path):
    rows = [(k, text) for k, text in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for row in queries.op2_pieces(spark, str(tmp_path)).collect():
        ids = model.encode(rows[row.doc_id][1] or "") + [model.eos_id()]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_counts(spark, documents):
    library = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(documents, BYTES).collect()}
    for k, text in enumerate(texts()):
        assert got[k] == len(library.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_compose(monkeypatch, block):
    """The same counts however a text is cut into blocks."""
    import pyarrow as pa

    from tiescope.llm import rows

    monkeypatch.setattr(tokencount, "BLOCK_BYTES", block)
    made = [t or "" for t in texts()][:60] + ["ab" * 200 + " c"]
    owned = tokencount.transducer(BYTES)
    library = Tokenizer.from_file(BYTES)
    got = owned.count(*rows.raw_text(pa.array(made))).tolist()
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in made]


def test_word_ids(spark, documents):
    library = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r.ids for r in wordids.tokenize(documents, WORDS, 2).collect()}
    for k, text in enumerate(texts()):
        assert got[k] == library.encode(text or "", add_special_tokens=False).ids + [2]


def test_empty_tables(documents):
    none = documents.filter("doc_id < 0")
    assert pieces.decode(pieces.encode(none, PIECES), PIECES).count() == 0
    assert tokencount.count_tokens(none, BYTES).count() == 0
    assert wordids.tokenize(none, WORDS, 2).count() == 0
