"""A corpus from raw documents to a training mixture: the stages in order, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slideloom.llm import decontaminate, langid, mixing, neardup, pii
from slideloom.llm._shared import free_names, materialize, read_table

#: Documents whose language is less sure than this go.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language; fills in the language where it was null.

    Null and letterless texts go; repeated rows share their fate; other columns stay as they are, whatever their
    names; an empty table gives an empty table.  Without any labelled text all documents go.
    """
    pred, score = free_names(docs, "lang_pred", "score")
    found = langid.identify(docs, langid.train(docs), (pred, score))
    kept = found.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id: five words a shingle, a similarity of 0.8.

    Documents with a null doc_id, and those without words, stay; repeated rows of the kept document stay, and a
    doc_id with several texts goes if one of them does; other columns stay as they are, whatever their names; an empty table gives an empty table.
    """
    (gone_id,) = free_names(docs, "gone_id")
    # a table of its own: its size is known before the join, so that few ids are broadcast and no text is shuffled
    gone = materialize(neardup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == F.col(gone_id), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a span of ten words with a benchmark item.

    Texts decide, so that a null doc_id makes no difference and repeated rows share their fate; null and empty
    texts stay; other columns stay as they are; an empty table gives an empty table.
    """
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts and keeps every row; null and empty texts and other columns stay as they are."""
    return pii.redact_pii(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics reach their target shares.

    Documents without words go; repeated rows share their fate; null sources and languages are values of their own;
    other columns stay as they are; an empty table gives an empty table.
    """
    return mixing.sample_mixture(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_to_targets),
]

#: Near duplicates, statistical language models and span classifiers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; every stage's rows are written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
