"""Registered domains by a table of public suffixes, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.urls import host


def registered(pages: DataFrame, suffixes: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, suffix, domain): the longest public suffix of each host and one label before it.

    ``suffixes``: suffix, one a row, with rules as the published list has them: ``co.uk``, ``*.ck`` (any label) and
    ``!www.ck`` (an exception to such a rule). Each distinct host is looked up once under all its endings, so a hot host costs one row. A host
    without a listed suffix has its last label as one; a host that is a suffix itself, an address or a single label
    stands for itself. Pages without a host come back with nulls.
    """
    hosts = pages.select(key, host(F.col(url)).alias("host"))
    labels = F.split("host", r"\.")
    distinct = hosts.where("host is not null").select("host").distinct()
    endings = distinct.select("host", F.posexplode(labels).alias("from", "label")).select(
        "host", "from", F.array_join(F.slice(labels, F.col("from") + 1, F.size(labels)), ".").alias("ending"), F.array_join(F.concat(F.array(F.lit("*")), F.slice(labels, F.col("from") + 2, F.size(labels))), ".").alias("wild")
    )
    rules = suffixes.select(F.lower("suffix").alias("rule")).where("rule <> ''").distinct()
    tried = endings.select("host", "from", F.explode(F.array("ending", "wild", F.concat(F.lit("!"), F.col("ending")))).alias("rule"))
    # an exception wins over all rules, and its suffix starts one label later
    found = tried.join(rules, "rule").select("host", F.when(F.col("rule").startswith("!"), F.col("from") + 1).otherwise(F.col("from")).alias("from"), F.col("rule").startswith("!").alias("exception"))
    best = found.groupBy("host").agg(F.min(F.when(F.col("exception"), F.col("from"))).alias("excepted"), F.min("from").alias("longest"))
    known = distinct.join(best, "host", "left").select("host", F.coalesce("excepted", "longest", F.size(labels) - 1).alias("at"))
    part = lambda at: F.array_join(F.slice(labels, at + 1, F.size(labels)), ".")
    alone = F.col("host").rlike(r"^[0-9.]+$") | (F.size(labels) == 1)
    named = known.select(
        F.col("host").alias("__host"), F.when(~alone, part(F.col("at"))).alias("suffix"), F.when(alone, F.col("host")).otherwise(part(F.greatest(F.col("at") - 1, F.lit(0)))).alias("domain")
    )
    return hosts.join(named, F.col("host") == F.col("__host"), "left").select(key, "host", "suffix", "domain")

