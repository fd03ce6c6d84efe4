"""Books as they arrive: each new container is annotated once.

Annotation keeps no state between books, so no watermark is needed; every
micro-batch goes through the batch pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import annotate_books
from ..sources import epub

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, glob: str = "*.epub", per_trigger: int = 100) -> DataFrame:
    """(book_id, content) of containers as they appear below ``folder``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("book_id"), "content")


def annotate_arriving(spark: SparkSession, source: str, target: str, checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """Writes annotated books to ``target``; a batch that runs again writes the same files again."""

    def batch(books: DataFrame, _: int) -> None:
        if not books.isEmpty():
            done = annotate_books(epub.entries(books), **options)
            epub.write_books(epub.packed(done.entries), target).count()

    writer = arriving(spark, source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
