"""Corpus pipeline: language ID, near-dedup, repeat removal, decontamination, encoding.

Every stage takes all documents that its predecessor kept, as Parquet, and
returns the columns of ``documents`` (the last one its encodings). Extra
columns are passed through by none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontam, langid, repeats, simhash, spm
from fleetlens.llm.common import materialize, table
from fleetlens.llm.queries import TOKENIZERS, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a key made of all columns: never null, ordered by doc_id, rows without one last."""
    return docs.select(*COLUMNS, F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text"),
        "lang", "source", "n_chars").alias("row_key"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject. Null texts and texts without letters are rejected."""
    models = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    judged = langid.identify(docs, models, key="doc_id", keep=COLUMNS[1:])
    return judged.where(~F.col("rejected")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id (repeated rows: one of them).

    A row without an id is kept if its group has no row with one. Rows that share an id but are in different groups
    are judged apart; in one group, the smallest text hash and then the other columns decide.
    """
    rows = with_row_key(docs)
    groups = simhash.near_duplicates(rows, key="row_key", shingle=4, radius=4)
    keep = materialize(groups.where("row_key = component").groupBy("row_key").agg(F.count("*").alias("n")), "kept-documents")
    kept = rows.join(keep.select("row_key"), "row_key", "left_semi")
    if keep.where("n > 1").take(1):  # repeated rows of a kept document
        kept = kept.dropDuplicates(["row_key"])
    return kept.select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated strings cover; n_chars follows. Documents stay, if need be empty."""
    cut = repeats.remove_repeats(docs.withColumn("no_text", F.col("text").isNull()),
                                 keep=("lang", "source", "n_chars", "no_text"), with_text=True)
    changed = F.col("n_removed") > 0
    return cut.select("doc_id", F.when(~F.col("no_text"), F.col("kept")).alias("text"), "lang", "source",
                      F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains no benchmark item, whether or not they have an id or share it. Null and empty texts
    contain none and stay; of repeated rows all stay or go."""
    rows = with_row_key(docs)
    found = decontam.contaminated(rows, table(spark, sf_dir, "benchmark"), key="row_key")
    leaks = materialize(found.select("row_key").distinct(), "leaks")
    return rows.join(leaks, "row_key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded documents, checked against the sentencepiece library: a row for each row, null and empty texts with no ids."""
    return spm.encode_decode(docs, tokenizer_path(TOKENIZERS["pieces"]), keep=("lang", "source", "n_chars"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

# No stage can be expressed in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
