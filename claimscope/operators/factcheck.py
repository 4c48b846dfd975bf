"""Fact checks: an article's keywords against a corpus of checked claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.rules import FACT_CHECK_HOST, NO_VERDICT, VERDICTS


def best_hits(articles: DataFrame, claims: DataFrame, key: str, claim_key: str) -> DataFrame:
    """(key, claim_key, overlap): per article the claim that shares most keywords; ties go to the smaller claim.

    ``articles``: key, term; ``claims``: claim_key, term, both distinct. An equi-join on the term.
    """
    shared = articles.join(claims, "term").groupBy(key, claim_key).agg(F.count(F.lit(1)).alias("overlap"))
    order = Window.partitionBy(key).orderBy(F.col("overlap").desc(), claim_key)
    return shared.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def verdict(title: Column) -> Column:
    """The verdict that a claim's title names, the most specific one first; none: no data."""
    found = F.when(F.contains(title, F.lit(VERDICTS[0])), VERDICTS[0])
    for v in VERDICTS[1:]:
        found = found.when(F.contains(title, F.lit(v)), v)
    return found.otherwise(NO_VERDICT)


def guarded(host: Column, title: Column) -> Column:
    """The verdict if the hit lies on the fact-checking site, else no data."""
    return F.when(F.contains(host, F.lit(FACT_CHECK_HOST)), verdict(title)).otherwise(NO_VERDICT)
