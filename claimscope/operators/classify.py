"""Title classification: label encoding and multinomial naive Bayes as aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.session import stored


#: Classes that a table of codes may hold.
MOST_CLASSES = 100_000


def codes(rows: DataFrame, label: str) -> DataFrame:
    """(label, code): labels numbered from 0 in alphabetical order. The number of classes is checked before they are ranked."""
    own = stored(rows.select(label).distinct().where(F.col(label).isNotNull()), "classes")
    if own.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    return own.withColumn("code", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))


def encoded(rows: DataFrame, label: str) -> DataFrame:
    """Adds code, the number of the row's label."""
    return rows.join(F.broadcast(codes(rows, label)), label)


def decoded(rows: DataFrame, table: DataFrame, label: str) -> DataFrame:
    """The inverse: adds the label of each row's code by a table of ``codes``."""
    return rows.join(F.broadcast(table), "code").select(*rows.columns, label)


def fit(weights: DataFrame, labels: DataFrame, key: str, alpha: float = 1.0) -> DataFrame:
    """(label, term, loglik, prior): smoothed log likelihoods for every class and known term.

    ``weights``: key, term, w, read twice and best a stored table; ``labels``: key, label. Terms times classes rows are
    made; the number of classes is checked before they are broadcast.
    """
    labelled = weights.join(labels.select(key, "label"), key)
    sums = stored(labelled.groupBy("label", "term").agg(F.sum("w").alias("sw")), "sums")
    classes = labels.join(weights.select(key).distinct(), key, "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
    totals = sums.groupBy("label").agg(F.sum("sw").alias("total"))
    size = sums.agg(F.count_distinct("term").alias("v"), F.lit(1).alias("one"))
    all_docs = classes.agg(F.sum("docs").alias("all_docs"))
    heads = stored(classes.join(totals, "label").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(all_docs)), "heads")  # one row each
    if heads.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    terms = sums.select("term").distinct()
    grid = terms.crossJoin(F.broadcast(heads))  # a row per class
    return grid.join(sums, ["label", "term"], "left").select(
        "label",
        "term",
        F.ln((F.coalesce("sw", F.lit(0.0)) + alpha) / (F.col("total") + alpha * F.col("v"))).alias("loglik"),
        F.ln(F.col("docs") / F.col("all_docs")).alias("prior"),
    )


def predict(weights: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """(key, label, score): the class of greatest log probability; ties go to the smaller label. Unknown terms do not count."""
    return best(weights.join(model, "term"), key)


def best(rows: DataFrame, key: str) -> DataFrame:
    """(key, label, score) by rows of a weight with a class' log likelihood: key, w, label, loglik, prior."""
    per_class = rows.groupBy(key, "label").agg((F.sum(F.col("w") * F.col("loglik")) + F.max("prior")).alias("score"))
    rounded = per_class.withColumn("score", F.round("score", 6))
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "label")
    return rounded.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
