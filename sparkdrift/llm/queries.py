"""The operators applied to the driver's tables: one query each, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdrift.llm import (
    alignment,
    hnsw,
    importance,
    lexical,
    line_dedup,
    max_plus,
    minhash,
    mixing,
    packing,
    pii,
    rp_forest,
    token_counts,
    toxicity,
)
from sparkdrift.llm.frames import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages of three and more lines that an earlier document has."""
    cleaned = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.span_digest(pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return hnsw.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("key") % 20 == 0)


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents, and the sample drawn by them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    # As many rows are sampled as the labels lead to expect on target.
    share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    setting = importance.Setting() if share is None else importance.Setting(share=share)
    return importance.resample(docs, labels.where("quality = 1"), setting=setting, keep=["doc_id"])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    setting = toxicity.Setting()
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", setting)
    scored = toxicity.score_texts(docs, model, setting=setting)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate embeddings."""
    return rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: number and hash of the ids, and whether the text came back."""
    model = tokenizer_file("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spelt = max_plus.decode(max_plus.encode(docs, model), model)
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return spelt.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        same.alias("round_trip"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of pre-tokens and tokens of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, tokenizer_file("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_pretokens", "n_tokens")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers lined up in all documents, with corpus-wide counts of linked pairs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.rank(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents that bring their sources to the targets."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_pii,
        op3_hnsw,
        op4_importance,
        op5_packing,
        op6_toxicity,
        op7_rp_forest,
        op8_minhash,
        op9_sentencepiece,
        op10_token_counts,
        op11_alignment,
        op12_lexical,
        op13_mixing,
    )
}
ORACLE_SQL = {"op1_line_dedup": line_dedup.removal_sql(), "op12_lexical": lexical.ranking_sql()}
