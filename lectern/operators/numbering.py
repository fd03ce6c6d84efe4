"""Positions: note numbers, spine order, insertion and play order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Paragraphs of a chapter that are numbered in one window.
STRETCH = 4096


def note_ids(df: DataFrame, chapter: list[str], paragraph: str = "para_idx", out: str = "note_id") -> DataFrame:
    """Numbers the paragraphs that occur from 1 within each chapter; rows of one paragraph share a number.

    The paragraphs are numbered on their own, one row each, in stretches of a
    chapter, and joined back: neither the sentences nor the paragraphs of a
    very long chapter ever meet in one window.
    """
    stretch = F.floor(F.col(paragraph) / STRETCH).alias("_stretch")
    distinct = df.select(*chapter, paragraph).distinct().select("*", stretch)
    before = Window.partitionBy(*chapter).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = distinct.groupBy(*chapter, "_stretch").agg(F.count("*").alias("_n"))
    offsets = sizes.select(*chapter, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*chapter, "_stretch").orderBy(paragraph))
    numbered = distinct.withColumn("_k", within).join(offsets, [*chapter, "_stretch"])
    return df.drop(out).join(numbered.select(*chapter, paragraph, (F.col("_before") + F.col("_k")).cast("int").alias(out)), [*chapter, paragraph])


def last_positions(spine: DataFrame) -> DataFrame:
    """(book_id, idref, spine_idx): an item named twice keeps its last position."""
    return spine.groupBy("book_id", "idref").agg(F.max("spine_idx").alias("spine_idx"))


def last_items(manifest: DataFrame) -> DataFrame:
    """The last item of each id in a book."""
    best = F.max_by(F.struct("href", "media_type"), F.struct("ord", "href", "media_type")).alias("_i")
    return manifest.groupBy("book_id", "item_id").agg(best).select("book_id", "item_id", "_i.*")


def reading_order(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book_id, spine_idx, item_id, href, media_type): spine entries with their items; those without are dropped."""
    order = last_positions(spine).withColumnRenamed("idref", "item_id")
    return order.join(last_items(manifest), ["book_id", "item_id"]).select("book_id", "spine_idx", "item_id", "href", "media_type")


def inserted_after(order: DataFrame, added: DataFrame, group: str = "book_id", position: str = "spine_idx", out: str = "new_idx") -> DataFrame:
    """Both sets of rows numbered from 0, each added row right behind the row of its position."""
    both = order.withColumn("is_added", F.lit(False)).unionByName(added.withColumn("is_added", F.lit(True)))
    return both.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(position, "is_added")) - 1)


def play_order(nav_count: Column | str, rank: Column | str) -> Column:
    """Play order of the k-th added page: the number of points there were, plus k."""
    return (F.col(nav_count) if isinstance(nav_count, str) else nav_count) + (F.col(rank) if isinstance(rank, str) else rank)


def first_containing(items: DataFrame, nav: DataFrame, exact: bool = False) -> DataFrame:
    """(book_id, item_id, nav_idx): the first navigation point whose source contains the item's id.

    By substring an id also meets the longer ids it begins; with ``exact`` the
    source's stem must equal it.  Points are met within a book only.
    """
    meets = F.regexp_extract("src", r"([^/]*?)(?:\.[^./]*)?$", 1) == F.col("item_id") if exact else F.contains("src", "item_id")
    return items.join(nav, "book_id").where(meets).groupBy("book_id", "item_id").agg(F.min("nav_idx").alias("nav_idx"))


def zipped(left: DataFrame, right: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows of equal position, up to the shorter side; rows of ``right`` whose text is null leave theirs as it is."""
    return left.join(right, [*keys, position])
