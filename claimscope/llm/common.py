"""Shared scratch storage, Arrow plumbing and numbering for the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.session import discard, stored

__all__ = ["discard", "numbered", "row_blocks", "stored", "text_or_empty", "unused"]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The given names, each with underscores before it until no column of ``df`` is called so (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_blocks(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20, most_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of bounded size, so that a few long texts do not fill a worker.

    (The batches themselves are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB where nothing is set.)
    """
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = min(most_rows, max(1, int(rows * most_bytes / max(batch.nbytes, 1))))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


#: Groups of a key whose starts one window sums up.
_STARTS = 1 << 16


def numbered(
    df: DataFrame, keys: list[str], order: list[str], *, salts: Column | None = None, name: str = "rank"
) -> DataFrame:
    """Add a gapless rank from 0 within ``keys`` without gathering a key in one task.

    Rows of a key are dealt to salted groups by a hash of ``order``; each group is numbered by a window of its own, and
    starts where the groups before it end. The starts are summed up in two levels, so no window sees more than
    ``_STARTS`` groups of a key. ``salts`` is the number of groups of a row's key (a column). Null keys or order values
    form ordinary groups. Rows with equal ``order`` share a group, so it should name a row: they take different ranks,
    in any order.
    """
    salts = F.lit(1) if salts is None else salts
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(*order), salts.cast("long")))
    within = Window.partitionBy(*keys, "__salt").orderBy(*order)
    block = F.shiftright(F.col("__salt"), _STARTS.bit_length() - 1)
    sizes = dealt.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n")).withColumn("__block", block)
    before = Window.partitionBy(*keys, "__block").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    blocks_before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    starts = sizes.select(*named, "__block", F.col("__salt").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    blocks = sizes.groupBy(*keys, "__block").agg(F.sum("__n").alias("__n"))
    bases = blocks.select(*keys, F.col("__block").alias("__b"), F.coalesce(F.sum("__n").over(blocks_before), F.lit(0)).alias("__base")).where("__base > 0")
    ranked = dealt.withColumn("__at", F.row_number().over(within) - 1).join(starts, [*same, F.col("__salt") == F.col("__s")]).drop(*[f"__k{i}" for i in range(len(keys))])
    # blocks that start at 0, and so all rows of a key with few groups, need no base
    based = ranked.join(bases.select(*named, "__b", "__base"), [*same, F.col("__block") == F.col("__b")], "left")
    return based.withColumn(name, (F.col("__start") + F.col("__at") + F.coalesce("__base", F.lit(0))).cast("long")).select(*df.columns, name)
