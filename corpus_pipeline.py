"""The corpus pipeline: staged cleaning of ``documents`` with the llm operators.

Each stage reads what the one before has written and applies its own decisions; all but the last return the
columns of ``documents``, whatever other columns there are. Repeated rows are judged each like the first, but for near_dedup,
which keeps one; null ids keep their rows (near_dedup prefers a row with an id). Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.llm import bpe, decontam, jaccard, langid, secrets
from driftmesh.llm.common import cut, table
from driftmesh.llm.queries import _tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SHARE = 0.4
MIN_ALIKE = 0.8
SHINGLE_WORDS = 5
MARK = "[SECRET]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a word or in which no learned language has ``MIN_SHARE`` of the words.

    So null and empty texts and those without a letter go. Without a labelled row nothing is learned, and all go.
    """
    got = langid.predict(docs, langid.fit_model(docs), keep=COLUMNS)
    return got.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles alike) stays: that with the smallest id.

    Candidates come from SimHashes by Golay keys, and from MinHash keys for near copies beyond their four bits; each is verified.
    Of rows with one id and text one stays. Texts without a word are copies of each other.
    """
    return jaccard.keep_one(docs.select(*COLUMNS), MIN_ALIKE, SHINGLE_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, or most of one in edited form, go; null and empty texts hold none and stay."""
    return decontam.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the rest of each text stays as it is. Overlapping spans give one mark; null texts stay null."""
    got = secrets.scan(docs, secrets.fit_model(docs), redact=MARK, keep=COLUMNS)
    text = F.col("redacted")
    return got.select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.length(text).cast("long"), "n_chars").alias("n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, in a segmentation drawn by seeded merge-dropout; null and empty texts have none."""
    return bpe.encode(docs, _tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("hide_secrets", hide_secrets),
    ("tokenize", tokenize),
]

#: Trained models, fingerprints and merges aren't SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
