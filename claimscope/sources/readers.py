"""Readers and writers: CSV, JSON, text lists, JDBC, keyword logs, stored articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.schema import TITLES_CSV, TRAIN_CSV


def headed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header whose values may hold quotes, separators and line ends."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def titles_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; all columns are strings."""
    return headed_csv(spark, path, TITLES_CSV)


def train_csv(spark: SparkSession, path: str) -> DataFrame:
    """A positional CSV: title and three labels."""
    return spark.read.option("header", False).option("multiLine", True).option("escape", '"').schema(TRAIN_CSV).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def search_results(body: Column) -> Column:
    """Array of (title, link) from a JSON array; null if it is none."""
    return F.from_json(body, "array<struct<title:string,link:string>>")


def link_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''").distinct()


def keyword_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of space-separated keywords, tab-separated from their title's number."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].cast("long").alias("line"), F.filter(F.split(parts[1], " "), lambda x: x != "").alias("keywords"))


def write_keyword_log(rows: DataFrame, path: str) -> None:
    """Rows (line, keywords array) as lines; the number keeps them apart without an order of files."""
    rows.select(F.concat_ws("\t", F.col("line").cast("string"), F.array_join("keywords", " ")).alias("value")).write.mode("overwrite").text(path)


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A database table; column pruning and filters are pushed to the database. Credentials come through ``options``."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def append_jdbc(rows: DataFrame, url: str, name: str, **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=name, **options).mode("append").save()


def append_articles(rows: DataFrame, path: str) -> None:
    """Append crawl results in one pass and one commit; rows with a null title, content or link carry that as their reason.

    The store is cut by whether rows were accepted, so readers of either part open only its files.
    """
    required = ("news_title", "news_content", "news_link")
    bad = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull()), ",")
    marked = rows.withColumn("reason", bad).withColumn("accepted", F.col("reason") == "")
    marked.write.partitionBy("accepted").mode("append").parquet(path)


def accepted_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("accepted = 'true'").drop("accepted", "reason")


def rejected_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("accepted = 'false'").drop("accepted")


def point_lookup(stored: DataFrame, column: str, value: str) -> DataFrame:
    """The first stored row of a value; the filter reaches the source."""
    return stored.where(F.col(column) == value).limit(1)


def append_bug_reports(rows: DataFrame, path: str) -> None:
    """Append bug reports (Bug_ID, Bug_DATE, COMMENT, Bug_IMAGE as binary) in the stored schema."""
    rows.select("Bug_ID", "Bug_DATE", "COMMENT", F.col("Bug_IMAGE").cast("binary")).write.mode("append").parquet(path)
