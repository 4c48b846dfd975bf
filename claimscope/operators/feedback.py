"""Reports, ratings and interface events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reports from which a link is hidden; the threshold is ours.
HIDE_FROM = 40
NORMAL, PINNED, HIDDEN = 0, 1, 2


def report_counters(reports: DataFrame, key: str, kind: str, kinds: dict[str, str]) -> DataFrame:
    """Counters per link; ``kinds``: column name to kind of report."""
    return reports.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(c) for c, k in kinds.items()])


def visibility(reports: Column, hide_from: int = HIDE_FROM) -> Column:
    return F.when(reports >= hide_from, HIDDEN).otherwise(NORMAL)


def overall(mean: Column) -> Column:
    """A mean rating as a whole score from 0 to 5."""
    return F.least(F.lit(5), F.greatest(F.lit(0), F.floor(mean + 0.5).cast("int")))


def rating_summary(ratings: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """Per link the mean of each dimension and the overall score, their mean's."""
    means = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("ratings"), *[F.avg(d).alias(d) for d in dimensions])
    total = sum((F.col(d) for d in dimensions), F.lit(0.0)) / len(dimensions)
    return means.withColumn("overall", overall(F.round(total, 6))).select(key, "ratings", *[F.round(d, 6).alias(d) for d in dimensions], "overall")


def rated_links(links: DataFrame, ratings: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """Reported links with their ratings' means; links without ratings come with a count of 0. Ratings are summed before the join."""
    summary = rating_summary(ratings, key, dimensions)
    return links.join(summary, key, "left").withColumn("ratings", F.coalesce("ratings", F.lit(0).cast("long")))


def toggled(clicks: DataFrame, key: str) -> DataFrame:
    """Per post: clicks, whether its table was built (first click), whether it shows (odd number of clicks)."""
    return clicks.groupBy(key).agg(F.count_distinct("event_id").alias("clicks")).select(
        key, "clicks", (F.col("clicks") > 0).alias("built"), (F.col("clicks") % 2 == 1).alias("visible")
    )
