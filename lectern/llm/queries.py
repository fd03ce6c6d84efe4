"""Queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boundaries, confusables, encoding, leakage, packing, pairs, reading
from .common import CHAPTER, SENTENCE, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pairs.judged(table(spark, folder, "notes"))
    return found.where("defect = 'truncated'").select(*SENTENCE).distinct()


def p1_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """Share of truncated notes for each model."""
    return pairs.by_source(table(spark, folder, "notes"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pairs.judged(table(spark, folder, "notes"))
    return found.where("defect is not null").select(*SENTENCE, "defect").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = confusables.cases(table(spark, folder, "sentences"), "text", SENTENCE)
    paragraphs = confusables.cases(table(spark, folder, "paragraphs"), "full_text", [*CHAPTER, "para_idx"])
    form = lambda df, field, sent: df.select(F.lit(field).alias("field"), *CHAPTER, "para_idx", sent.cast("int").alias("sent_idx"))
    return form(texts, "text", F.col("sent_idx")).unionByName(form(paragraphs, "full_text", F.lit(-1)))


def p2_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of both fields in its consistent form."""
    texts = confusables.normalised(table(spark, folder, "sentences"), "text").select(F.lit("text").alias("field"), *SENTENCE, "normal", "was_case")
    paragraphs = confusables.normalised(table(spark, folder, "paragraphs"), "full_text")
    paragraphs = paragraphs.select(F.lit("full_text").alias("field"), *CHAPTER, "para_idx", F.lit(-1).cast("int").alias("sent_idx"), "normal", "was_case")
    return texts.unionByName(paragraphs)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    graded = reading.levels(table(spark, folder, "sentences"), table(spark, folder, "graded"))
    return graded.where("share_english > 0.5").select(*CHAPTER, "band")


def p4_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The English chapters by band: how many, their length, and their mean earlier score where one is there.

    Earlier scores of another run's scale, far outside the usual one's
    range, are left out of the mean.
    """
    graded = reading.levels(table(spark, folder, "sentences"), table(spark, folder, "graded")).where("share_english > 0.5")
    earlier = table(spark, folder, "scored").select(*SENTENCE, "score").where("score between -50 and 150").distinct()
    scores = earlier.groupBy(*CHAPTER).agg(F.sum("score").alias("_sum"), F.count("score").alias("_n"))
    both = graded.join(scores, CHAPTER, "left").groupBy("band")
    return both.agg(F.count("*").alias("n_chapters"), F.sum("n_words").alias("n_words"), F.sum("_n").alias("n_scored"), F.round(F.sum("_sum") / F.sum("_n"), 6).alias("mean_score"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return boundaries.sentences(table(spark, folder, "paragraphs"))


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), table(spark, folder, "containers"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers of each kind are filled."""
    return packing.report(p6_packed(spark, folder), table(spark, folder, "containers"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.repaired(table(spark, folder, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled documents with their text restored as far as it can be."""
    return encoding.repaired(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_by_model": p1_by_model, "p2_found": p2_found, "p2_normalised": p2_normalised, "p3_found": p3_found, "p4_found": p4_found, "p4_profile": p4_profile, "p5_found": p5_found, "p6_packed": p6_packed, "p6_report": p6_report, "p7_found": p7_found, "p8_found": p8_found, "p8_restored": p8_restored}


def oracle_sql() -> dict[str, str]:
    return {}
