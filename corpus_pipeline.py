"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdrift.llm import line_dedup, minhash, packing, pii, toxicity
from sparkdrift.llm.frames import shared_folder, table
from sparkdrift.llm.queries import tokenizer_file


def with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a frame whose texts may be shorter now; n_chars follows them."""
    length = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return changed.withColumns(length).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go; the others stay as they are."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", toxicity.Setting())
    return toxicity.score_texts(docs, model).where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of three and more lines that an earlier document has go; every document stays."""
    return with_text(docs, line_dedup.remove_repeated_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; every document stays."""
    return with_text(docs, pii.find_personal_data(docs, redact=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express the trained classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
