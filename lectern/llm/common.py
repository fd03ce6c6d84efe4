"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.durable import durable, spread

__all__ = ["CHAPTER", "SENTENCE", "durable", "spread", "table"]

#: Columns that name one sentence, and one chapter.
SENTENCE = ["book_id", "spine_idx", "para_idx", "sent_idx"]
CHAPTER = ["book_id", "spine_idx"]
#: Tables whose texts are worked on.
LARGE = {"documents", "notes", "paragraphs", "sentences"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; large ones over all cores even if they are few files."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in LARGE else df
