"""The registered queries of the package, and their SQL twins for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiescope.llm import ann, jaccard, language, linededup, linequality, packing, pieces, prefixtrie, repair, secretscan, suffixes, tokencount, toxicity, wordids
from tiescope.llm.rows import table
from tiescope.session import stage

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"
WORDS = "word_bpe_49k.json"


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, the text they decode to, and both digests."""
    path = public_tokenizers.path(PIECES)
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    digests = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                             F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                             "ids")
    return (pieces.decode(digests, path)
            .withColumn("decoded_sha256", F.sha2(F.col("decoded"), 256)).drop("decoded"))


def _share(parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of a fifth of the ids are held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(documents.join(labels.filter(_share(5) != 0), "doc_id"))
    return toxicity.score(documents, model).select(
        "doc_id", (_share(5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of the ids is held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profile = language.profiles(documents.filter(_share(4) != 2))
    return language.predict(documents.select("doc_id", "text"), profile).select(
        "doc_id", (_share(4) == 2).alias("held_out"), "lang_pred", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without cross-site boilerplate lines."""
    return linededup.clean(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that documents share, every occurrence found."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = suffixes.numbered(documents)
    named = docs.select("row", F.nullif("ord", F.lit((1 << 63) - 1)).alias("doc_id"))
    found = suffixes.repeats(docs)
    return (found.join(named, "row").join(named.select(F.col("row").alias("other"), F.col("doc_id").alias("other_id")), "other")
            .select("doc_id", "start", "size", "other_id", "removed"))


def packed(documents: DataFrame) -> DataFrame:
    """Pieces of the documents' token sequences, with checksums."""
    numbered = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    tokens = wordids.tokenize(numbered, public_tokenizers.path(WORDS), 2, window=packing.WINDOW)
    # written once: the row numbers hold from here on
    tokens = stage(tokens.withColumn("doc_tokens", F.size("ids").cast("long")), "packing-tokens")
    pieces_ = stage(packing.pack(tokens.select("row", F.col("doc_tokens").alias("n"))), "packing-pieces")
    return packing.checksums(pieces_, tokens)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4,096 tokens."""
    return packed(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by the transducer."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (tokencount.count_tokens(documents, public_tokenizers.path(BYTES))
            .select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                    "n_tokens", (F.col("n_tokens") > 512).alias("over_limit")))


def judged(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the verdict of the line model, which the labels of the tables train."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")
    return linequality.judge(documents, linequality.fit(labelled))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the line model's verdict for every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(spark, documents, sf_dir).drop("text")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by kind and place."""
    found = secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(list(secretscan.BASE)))
    kind = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[kind(name).alias(f"n_{name}") for name in secretscan.BASE],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure faults and cheapest repair of every conversation, after damage by row."""
    return repair.repair(table(spark, sf_dir, "conversations"), repair.kinds())


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of conversations that share starts by hundreds."""
    told = prefixtrie.turns(table(spark, sf_dir, "conversations"))
    block = F.col("conv_id") - F.col("conv_id") % 100
    pieces_ = prefixtrie.rebuilt(told, block, 5, F.crc32(F.col("conv_id").cast("string")) % 6)
    return prefixtrie.trie(stage(pieces_, "trie-pieces"), block)


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_pieces": op2_pieces,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_line_quality": op10_line_quality,
    "op11_secrets": op11_secrets,
    "op12_repair": op12_repair,
    "op13_trie": op13_trie,
}

#: SQL twins by query name, where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op6_line_dedup": linededup.SQL.format(docs="documents", sites=linededup.SITES),
    "op11_secrets": secretscan.SQL,
}
