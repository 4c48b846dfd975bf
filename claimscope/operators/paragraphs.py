"""Skip and break rules over ordered paragraphs, as array expressions: no row order is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skipped(paragraphs: Column, banned: Column) -> Column:
    """Paragraphs that are no ban lines (``banned``: array of texts)."""
    return F.filter(paragraphs, lambda p: ~F.array_contains(banned, p))


def before_first(paragraphs: Column, hit: Callable[[Column], Column]) -> Column:
    """The paragraphs before the first hit; all if there is none."""
    at = F.array_position(F.transform(paragraphs, lambda p: F.coalesce(hit(p), F.lit(False))), True)
    return F.when(at > 0, F.slice(paragraphs, F.lit(1), (at - 1).cast("int"))).otherwise(paragraphs)


def until_line(paragraphs: Column, lines: Column) -> Column:
    return before_first(paragraphs, lambda p: F.array_contains(lines, p))


def until_containing(paragraphs: Column, text: Column) -> Column:
    return before_first(paragraphs, lambda p: F.contains(p, text))


def skipped_until(paragraphs: Column, banned: Column, breaks: Column) -> Column:
    """Ban lines dropped, then cut at the first break line left; a line in both is only dropped."""
    return until_line(skipped(paragraphs, banned), breaks)


def by_mode(paragraphs: Column, mode: Column, banned: Column, breaks: Column, text: Column) -> Column:
    """The rule that a site's mode names."""
    return (
        F.when(mode == "skip", skipped(paragraphs, banned))
        .when(mode == "break", until_line(paragraphs, banned))
        .when(mode == "skip_break", skipped_until(paragraphs, banned, breaks))
        .when(mode == "contains", until_containing(paragraphs, text))
        .when(mode == "skip_contains", until_containing(skipped(paragraphs, banned), text))
        .otherwise(paragraphs)
    )


def recurring_lines(paragraphs: DataFrame, least_pages: int) -> DataFrame:
    """Texts found on so many pages: boilerplate by rule. ``paragraphs``: page_id, text."""
    return paragraphs.groupBy("text").agg(F.count_distinct("page_id").alias("pages")).where(F.col("pages") >= least_pages).select("text")


def rows_without(paragraphs: DataFrame, lines: DataFrame) -> DataFrame:
    """Row form of the skip rule, for ban lists too large for an array: an anti join."""
    return paragraphs.join(lines.select("text"), "text", "left_anti")


def rows_before(paragraphs: DataFrame, lines: DataFrame) -> DataFrame:
    """Row form of the break rule: rows of a page before its first hit. ``paragraphs``: page_id, pos, text."""
    hits = paragraphs.join(lines.select("text"), "text", "left_semi").groupBy("page_id").agg(F.min("pos").alias("first_hit"))
    return paragraphs.join(hits, "page_id", "left").where("first_hit is null or pos < first_hit").drop("first_hit")


def first_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first rows of each key by a total order."""
    from pyspark.sql import Window

    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
