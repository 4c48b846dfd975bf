"""Counters per key that grow by increments: only the parts that an increment touches are written anew.

Keys are dealt to parts by a hash. An increment is summed up per key, merged with the touched parts' current rows, and
written beside them under its own version; the ledger then names the parts that it replaced, in one step. Readers open of
each part the latest version in the ledger. A repeated increment changes nothing, whether the first attempt died before
its entry or not, and parts that an increment does not touch keep their files.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.session import discard, stored
from claimscope.sources import markers

_KINDS = {"sum": F.sum, "min": F.min, "max": F.max}


class Counters:
    """``keys``: key columns; ``values``: value column to sum, min or max. One writer at a time."""

    def __init__(self, path: str, keys: list[str], values: dict[str, str], parts: int = 64):
        self.path, self.keys, self.values, self.parts = path.rstrip("/"), keys, values, parts

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("part", *self.keys).agg(*[_KINDS[kind](c).alias(c) for c, kind in self.values.items()])

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def applied(self, spark: SparkSession) -> list[str]:
        """The names of the increments in the ledger."""
        return [json.loads(markers.get(spark, f"{self.path}/ledger/{n}"))["increment"] for n in markers.names(spark, f"{self.path}/ledger")]

    def versions(self, spark: SparkSession) -> dict[int, int]:
        """The latest version of each part."""
        out: dict[int, int] = {}
        for n in markers.names(spark, f"{self.path}/ledger"):
            out |= dict.fromkeys(json.loads(markers.get(spark, f"{self.path}/ledger/{n}"))["parts"], int(n))
        return out

    def _read(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame:
        places = [f"{self.path}/data/version={v}/part={p}" for p, v in sorted(versions.items())]
        return spark.read.option("basePath", f"{self.path}/data").parquet(*places).drop("version")

    def add(self, increment: str, rows: DataFrame) -> bool:
        """Add an increment's rows (keys and values); false, and nothing done, if the ledger has it."""
        spark = rows.sparkSession
        if increment in self.applied(spark):
            return False
        delta = stored(self._merged(rows.select(*self.keys, *self.values).withColumn("part", self._part())), "delta")
        touched = sorted(r["part"] for r in delta.select("part").distinct().collect())  # at most ``parts``
        before = {p: v for p, v in self.versions(spark).items() if p in touched}
        merged = self._merged(delta.unionByName(self._read(spark, before).select(*delta.columns))) if before else delta
        version = len(markers.names(spark, f"{self.path}/ledger"))
        merged.repartition(min(self.parts, max(1, len(touched))), "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/version={version}")
        self.commit(spark, version, increment, touched)
        discard(delta)
        return True

    def commit(self, spark: SparkSession, version: int, increment: str, touched: list[int]) -> None:
        if not markers.put(spark, f"{self.path}/ledger/{version:09}", json.dumps({"increment": increment, "parts": touched})):
            raise RuntimeError(f"version {version} was written by another writer")

    def current(self, spark: SparkSession) -> DataFrame:
        """The counters: keys and values."""
        return self._read(spark, self.versions(spark)).drop("part")

    def clean(self, spark: SparkSession) -> None:
        """Remove the files of versions of parts that later ones replaced."""
        now = self.versions(spark)
        for n in markers.names(spark, f"{self.path}/ledger"):
            for p in json.loads(markers.get(spark, f"{self.path}/ledger/{n}"))["parts"]:
                if now[p] != int(n):
                    markers.remove(spark, f"{self.path}/data/version={int(n)}/part={p}")
