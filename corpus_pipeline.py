"""Corpus preparation: language, near duplicates, test passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnkit.llm import decontaminate, jaccard, langid, packing, pii
from churnkit.llm.queries import table, tokenizer_path
from churnkit.llm.textkit import held_out
from churnkit.session import scratch_path

CACHED_WORDS = 50_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those scored below what all but a thousandth of the labelled rows of the
    predicted language reach: texts in other languages or scripts, and strings of letters."""
    model, least = langid.fit_language_filter(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return langid.keep_languages(docs, model, min_score=least)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles, the smallest id stays."""
    groups = jaccard.jaccard_components(docs, shingle=5, percent=80)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def remove_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item's words in tiles of matching words, or one tile of 50 of
    them, go.  Items under eight words or 24 characters remove only documents that say nothing else."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), drop_words=8, drop_chars=24)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; no document goes."""
    return pii.redact_pii(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place in it; a null text is its closing id alone.  Workers keep
    fewer words than by default, as they hold memory of the stages before."""
    return packing.pack_documents(docs, tokenizer_path(), cached_words=CACHED_WORDS)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_test_passages),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

# The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
