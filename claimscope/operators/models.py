"""Models as artefacts: versions of named tables, of which only complete ones are read.

A version's tables are written first; a manifest that names them, and figures beside them, appears in one step and makes the
version. Readers take the latest version with a manifest, or a given one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.operators import classify, keywords
from claimscope.session import stored
from claimscope.sources import markers


class Version(NamedTuple):
    number: int
    tables: dict[str, DataFrame]
    figures: dict


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions."""
    return [int(n) for n in markers.names(spark, f"{folder.rstrip('/')}/manifests")]


def save(folder: str, tables: dict[str, DataFrame], **figures: float) -> int:
    """Write the next version; the one that a writer left incomplete is written over. One writer at a time."""
    folder, spark = folder.rstrip("/"), next(iter(tables.values())).sparkSession
    number = max(versions(spark, folder), default=0) + 1
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/version={number}/{name}")
    schemas = {name: rows.schema.simpleString()[len("struct<") : -1] for name, rows in tables.items()}
    publish(spark, folder, number, {"tables": schemas, "figures": figures})
    return number


def publish(spark: SparkSession, folder: str, number: int, manifest: dict) -> None:
    if not markers.put(spark, f"{folder}/manifests/{number:09}", json.dumps(manifest)):
        raise RuntimeError(f"version {number} was written by another writer")


def load(spark: SparkSession, folder: str, number: int | None = None) -> Version:
    folder, there = folder.rstrip("/"), versions(spark, folder)
    number = max(there, default=None) if number is None else number
    if number not in there:
        raise LookupError(f"no complete version {'' if number is None else number} in {folder}")
    manifest = json.loads(markers.get(spark, f"{folder}/manifests/{number:09}"))
    tables = {name: spark.read.schema(schema.replace(":", " ")).parquet(f"{folder}/version={number}/{name}") for name, schema in manifest["tables"].items()}
    return Version(number, tables, manifest["figures"])


# --- naive Bayes over unit TF-IDF weights ---


def train_titles(docs: DataFrame, labels: DataFrame, key: str, words: Column, folder: str, stop: tuple[str, ...] = (), counts: DataFrame | None = None) -> int:
    """Fit a classifier of texts by labels (key, label) and save it: document frequencies, log likelihoods, the number of texts.

    ``counts``: the texts' term counts as a stored table, where the caller has them.
    """
    counts = stored(keywords.term_counts(docs, key, words, stop), "counts") if counts is None else counts
    documents = docs.count()
    frequency = stored(keywords.document_frequency(counts), "frequency")
    unit = stored(labelled_units(counts, frequency, documents, labels, key), "unit")
    return save(folder, {"frequency": frequency, "likelihood": classify.fit(unit, labels, key)}, documents=documents)


def labelled_units(counts: DataFrame, frequency: DataFrame, documents: int, labels: DataFrame, key: str) -> DataFrame:
    """(key, term, w): unit weights of the labelled texts, the only ones that a classifier is fitted on, by all texts' frequencies."""
    own = counts.join(labels.select(key), key, "left_semi")
    return keywords.l2_normalised(keywords.weighted(own, frequency, documents, key), key).select(key, "term", "w")


def predict_titles(docs: DataFrame, key: str, words: Column, model: Version, stop: tuple[str, ...] = (), counts: DataFrame | None = None) -> DataFrame:
    """(key, label, score) of texts by a saved classifier: nothing is fitted. Texts without a known word have no row.

    Counts meet a term's frequency and its likelihoods in one join, and the weights of a text in one exchange, which its
    scores are added up in too. ``counts`` as for ``train_titles``.
    """
    counts = keywords.term_counts(docs, key, words, stop) if counts is None else counts
    likelihood = model.tables["likelihood"]
    likes = likelihood.groupBy("term").agg(F.collect_list(F.struct("label", "loglik")).alias("likes"))  # a class each
    known = model.tables["frequency"].join(likes, "term", "left")
    unit = keywords.l2_normalised(keywords.weighted(counts, known, model.figures["documents"]).select(key, "w", "likes"), key)
    rows = unit.select(key, "w", F.explode("likes").alias("x")).select(key, "w", "x.label", "x.loglik")
    priors = likelihood.groupBy("label").agg(F.first("prior").alias("prior"))  # classes, whose number was checked
    return classify.best(rows.join(F.broadcast(priors), "label"), key)


def predicting(key: str, words: Column, folder: str, write: Callable[[DataFrame, int], None], stop: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch's texts by the latest complete version when the batch begins."""

    def run(rows: DataFrame, batch: int) -> None:
        model = load(rows.sparkSession, folder)
        found = predict_titles(rows.select(key, words.alias("__words")), key, F.col("__words"), model, stop)
        write(found.withColumn("version", F.lit(model.number)), batch)

    return run
