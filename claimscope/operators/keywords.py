"""Term weights and keywords: counts once, then document frequencies, weights and top-k from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


class Embedding(Protocol):
    """A provider of embeddings: vectors of texts within a task, a row each, all of one width."""

    def vectors(self, texts: Sequence[str]) -> np.ndarray: ...


def term_counts(docs: DataFrame, key: str, words: Column, stop: Sequence[str] = ()) -> DataFrame:
    """(key, term, tf): one row per distinct term of a document that is no stop word.

    A text's words are sorted and counted in its own row, so neither texts nor counts are shuffled. Only where keys repeat,
    which is looked up when the query is built (the keys alone are read), are the words of all rows counted by an exchange of partial sums.
    """
    asked = lambda rows: rows.where(~F.col("term").isin(*dict.fromkeys(stop))) if stop else rows  # noqa: E731  a hash set, tested row by row
    if not docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return asked(docs.select(key, F.explode(words).alias("term"))).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    ordered = docs.select(key, F.sort_array(words).alias("__words")).where(F.size("__words") > 0)
    word = lambda at: F.get("__words", at)
    ends = ordered.select(key, "__words", F.filter(F.sequence(F.lit(1), F.size("__words")), lambda i: ~word(i - 1).eqNullSafe(word(i))).alias("__ends"))  # the place behind each term's last word
    count = lambda end, k: F.struct(word(end - 1).alias("term"), (end - F.coalesce(F.get("__ends", k - 1), F.lit(0))).cast("long").alias("tf"))
    return asked(ends.select(key, F.inline(F.transform("__ends", count))))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def weighted(counts: DataFrame, frequency: DataFrame, documents: int, by: str | None = None) -> DataFrame:
    """Adds df and w = tf * (ln((1 + n) / (1 + df)) + 1), the smooth inverse document frequency, by a table (term, df).

    ``by``: the column that the rows are grouped by next; they are shuffled to it with their small whole numbers, before
    these become weights, which hardly compress.
    """
    weight = F.col("tf") * (F.ln((F.lit(1.0) + documents) / (1 + F.col("df"))) + 1)
    # by hash: only a task's distinct terms are held, and the counts need no sort by their terms
    joined = counts.join(frequency.hint("shuffle_hash"), "term")
    return (joined if by is None else joined.repartition(by)).withColumn("w", weight)


def tf_idf(counts: DataFrame, documents: int, by: str | None = None) -> DataFrame:
    """The weights by the frequencies of the same counts."""
    return weighted(counts, document_frequency(counts), documents, by)


def l2_normalised(weights: DataFrame, key: str) -> DataFrame:
    """w divided by the root of the document's sum of squares: one exchange, a document's terms in one window."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weights.withColumn("w", F.col("w") / norm)


def top_terms(weights: DataFrame, key: str, k: int) -> DataFrame:
    """The k terms of greatest weight of each document with their rank; equal weights in the terms' order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.round("w", 6).desc(), "term"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= k)


def joined(top: DataFrame, key: str, separator: str) -> DataFrame:
    """The keywords of a document in rank order as one string."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return top.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["term"]), separator).alias("keywords"))


def slots(top: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The first keywords as columns keyword1, keyword2, ..."""
    return top.groupBy(key).agg(*[F.max(F.when(F.col("rank") == k, F.col("term"))).alias(f"keyword{k}") for k in range(1, n + 1)])


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; null if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    length = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.try_divide(dot, length(a) * length(b))


#: Query vectors that go to every task at a time.
QUERY_BLOCK = 8192


def nearest_of_all(queries: DataFrame, candidates: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, cand_id, similarity, rank): the k candidates most like each query vector, of all others, by cosine.

    ``queries``: query_id, qv; ``candidates``: cand_id, cv. Each block of queries, of checked size, goes to all tasks and
    passes over the candidates once; a task keeps its best k per query, which are ranked after a shuffle of those alone.
    Similarities are rounded to six digits, ties go to the smaller candidate; vectors without length have none and come last.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // block))
    dealt = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("qv").cast("array<double>").alias("qv")).withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    chosen, best = candidates.select(F.col("cand_id").cast("long").alias("cand_id"), F.col("cv").cast("array<double>").alias("cv")), None
    for at in range(blocks):
        rows = dealt.where(F.col("__block") == at).collect()
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in rows], _unit([r["qv"] for r in rows])))

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            ids, width = np.array(ids, dtype=np.int64), vectors.shape[1]
            top = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), dtype=np.int64)
            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    part = batch.slice(low, 1024)
                    cand = part.column(0).to_numpy()
                    score = np.nan_to_num(np.round(vectors @ _unit(part.column(1).to_pylist(), width).T, 6), nan=-2.0)
                    score[ids[:, None] == cand[None, :]] = -np.inf
                    both, own = np.concatenate([top[0], score], axis=1), np.concatenate([top[1], np.broadcast_to(cand, score.shape)], axis=1)
                    order = np.lexsort((own, -both))[:, :k]
                    top = np.take_along_axis(both, order, 1), np.take_along_axis(own, order, 1)
            query, there = np.broadcast_to(ids[:, None], top[0].shape).ravel(), np.isfinite(top[0]).ravel()
            similarity = top[0].ravel()[there]
            yield pa.RecordBatch.from_arrays([pa.array(query[there]), pa.array(top[1].ravel()[there]), pa.array(similarity, mask=similarity < -1.5)], ["query_id", "cand_id", "similarity"])

        found = chosen.mapInArrow(partial, "query_id long, cand_id long, similarity double")
        best = found if best is None else best.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), "cand_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _unit(vectors: list, width: int | None = None) -> np.ndarray:
    """Vectors as rows of length one; those without length, null or of another width are NaN."""
    width = max((len(v) for v in vectors if v is not None), default=0) if width is None else width
    x = np.array([v if v is not None and len(v) == width else [np.nan] * width for v in vectors], dtype=float).reshape(len(vectors), width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, cand_id, similarity, rank): the k candidates most like each query vector, within the same group.

    ``queries``: query_id, grp, qv; ``candidates``: cand_id, grp, cv. Candidates are those of the query's document
    (group), so the join stays as small as the documents are.
    """
    scored = queries.join(candidates, "grp").withColumn("similarity", F.round(cosine(F.col("qv"), F.col("cv")), 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "cand_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "cand_id", "similarity", "rank")


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Jaccard similarity of two keyword sets per document. Both: key, keywords (array)."""
    both = a.select(key, F.col("keywords").alias("ka")).join(b.select(key, F.col("keywords").alias("kb")), key)
    return both.withColumn("jaccard", F.round(F.try_divide(F.size(F.array_intersect("ka", "kb")), F.size(F.array_union("ka", "kb"))), 6))


#: Bytes of texts and words that a task compares at a time.
COMPARED_AT_ONCE = 2 << 20


def by_embedding(docs: DataFrame, key: str, content: Column, words: Column, embed: Embedding, k: int = 5) -> DataFrame:
    """(key, term, similarity, rank): the k distinct words most like their whole text, by an embedding provider.

    Texts and words become vectors and are compared where they are read, each distinct word of a part of the texts embedded
    once; only what may be among a text's k best is shuffled. Keys should be unique: texts that share one are ranked
    together, each word by its own text; rows without a key are left out.
    """
    own = docs.where(F.col(key).isNotNull()).select(key, content.alias("__content"), F.array_distinct(words).alias("__words")).where("__content IS NOT NULL AND size(__words) > 0")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield _likest(part, key, embed, k)

    schema = StructType([own.schema[key], StructField("term", StringType()), StructField("raw", DoubleType())])
    scored = own.mapInArrow(compared, schema).select(key, "term", F.round("raw", 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("similarity").desc_nulls_last(), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, some megabytes of texts and words at a time."""
    words = batch.column(2)
    ends = np.cumsum(pc.fill_null(pc.binary_length(words.flatten()), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    stop = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
    size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64) + ends[stop - 1]
    first = 0
    while first < batch.num_rows:
        before = size[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(size, before + COMPARED_AT_ONCE, "right")))
        yield batch.slice(first, end - first)
        first = end


def _likest(part: pa.RecordBatch, key: str, embed: Embedding, k: int) -> pa.RecordBatch:
    """(key, term, raw): cosines of the words that may be among their text's k best once they are rounded; null ones come last."""
    lists = part.column(2)
    flat = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    term = flat.indices.to_numpy(zero_copy_only=False)
    texts, terms = embed.vectors(part.column(1).to_pylist()), embed.vectors(flat.dictionary.to_pylist())
    # added up one dimension after the other, as ``cosine`` does
    dot, a, b = np.zeros(len(term)), np.zeros(len(texts)), np.zeros(len(terms))
    for x, y in zip(np.ascontiguousarray(texts.T), np.ascontiguousarray(terms.T), strict=True):
        dot += x[row] * y[term]
        a += x * x
        b += y * y
    lengths = np.sqrt(a)[row] * np.sqrt(b)[term]
    there = lengths > 0
    raw = np.divide(dot, lengths, out=np.full(len(dot), -9.0), where=there)
    order = np.lexsort((-raw, row))
    count = np.bincount(row, minlength=part.num_rows)
    last = raw[order[np.cumsum(count) - count + np.minimum(k, count) - 1]]
    kept = np.flatnonzero(raw >= last[row] - 2e-6)  # equal after rounding to six digits, at least
    return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[kept])), flat.dictionary.take(pa.array(term[kept])), pa.array(raw[kept], mask=~there[kept])], [key, "term", "raw"])
