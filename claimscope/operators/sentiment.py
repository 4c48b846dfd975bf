"""Sentiment: word log-odds to a probability, means and labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.rules import NO_SENTIMENT, SENTIMENT_LABELS, SENTIMENT_LABELS_EN


def _seen(counts: DataFrame, labels: DataFrame, key: str, terms: DataFrame | None = None) -> DataFrame:
    """term, pos, n, all_pos, all_n: positive and all labelled documents that hold a term, and of the corpus."""
    asked, keys = counts, counts.select(key)
    if terms is not None:  # the corpus' documents are still those of all terms; their keys become distinct where they are read
        asked, keys = counts.join(terms, "term", "left_semi"), keys.distinct()
    seen = asked.join(labels, key).groupBy("term").agg(F.sum("positive").alias("pos"), F.count(F.lit(1)).alias("n"))
    totals = labels.join(keys, key, "left_semi").agg(F.coalesce(F.sum("positive"), F.lit(0)).alias("all_pos"), F.count(F.lit(1)).alias("all_n"))
    return seen.crossJoin(F.broadcast(totals))  # totals: one row


def _odds() -> Column:
    return F.ln(((F.col("pos") + 1) / (F.col("all_pos") + 2)) / ((F.col("n") - F.col("pos") + 1) / (F.col("all_n") - F.col("all_pos") + 2)))


def word_scores(counts: DataFrame, labels: DataFrame, key: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, score): probability that a term comes from a positive document, from add-one document shares.

    ``counts``: key, term, read twice and best a stored table; ``labels``: key, positive (0 or 1). ``terms``: those whose
    scores are asked for, if not all; only their counts go on to the join with the labels.
    """
    return _seen(counts, labels, key, terms).select("term", (1 / (1 + F.exp(-_odds()))).alias("score"))


def log_odds(counts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The model of whole strings, (term, odds): each term's log odds, and under the empty term those of a positive document.

    ``counts`` and ``labels`` as for ``word_scores``; ``counts`` is read three times.
    """
    totals = labels.join(counts.select(key), key, "left_semi").agg(F.coalesce(F.sum("positive"), F.lit(0)).alias("all_pos"), F.count(F.lit(1)).alias("all_n"))
    prior = totals.select(F.lit("").alias("term"), F.ln((F.col("all_pos") + 1) / (F.col("all_n") - F.col("all_pos") + 1)).alias("odds"))
    return _seen(counts, labels, key).where("term <> ''").select("term", _odds().alias("odds")).unionByName(prior)


class SentimentProvider:
    """Sentiment of strings by a model of ``log_odds``, best a stored table: the probability that all words of a string
    come from a positive text, each as often as it stands there. Words that the model does not know say nothing; a string
    without known words has the corpus' share of positive texts. ``words`` cuts a column of strings into words.

    A provider of another kind has the same method.
    """

    def __init__(self, model: DataFrame, words: Callable[[Column], Column]):
        self.model, self.words = model, words

    def scores(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, score) of every row. Rows are counted by word before they are joined; keys should be unique."""
        own = rows.select(key, F.explode_outer(self.words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("times"))
        known = self.model.where("term <> ''")
        joint = own.join(known, "term", "left").groupBy(key).agg(F.sum(F.coalesce(F.col("times") * F.col("odds"), F.lit(0.0))).alias("joint"))
        prior = self.model.where("term = ''").select(F.col("odds").alias("prior"))
        return joint.crossJoin(F.broadcast(prior)).select(key, (1 / (1 + F.exp(-(F.col("joint") + F.col("prior"))))).alias("score"))  # prior: one row


def label(mean: Column, labels: Sequence[str] = SENTIMENT_LABELS, top: float = 0.9) -> Column:
    """The label of a mean score; no keywords (null): undefined."""
    a, b, c, d, e, f, g = labels
    return (
        F.when(mean.isNull(), NO_SENTIMENT)
        .when(mean >= top, a)
        .when(mean >= 0.7, b)
        .when(mean > 0.5, c)
        .when(mean == 0.5, d)
        .when(mean >= 0.3, e)
        .when(mean > 0.1, f)
        .otherwise(g)
    )


def label_older(mean: Column) -> Column:
    """The older labels, whose top class begins at 0.8."""
    return label(mean, SENTIMENT_LABELS_EN, 0.8)


def label_three(score: Column) -> Column:
    """Three classes; exactly 0.5 and 0.3 have none."""
    return F.when(score > 0.5, "quite positive").when((score < 0.5) & (score > 0.3), "quite negative").when(score < 0.3, "strong negative")

