"""Sinks that hold each batch of a stream once, however often it is attempted: files with a ledger, and databases.

A batch's rows are written first and count only when the ledger names the batch, which happens in one step. An attempt that
dies before it leaves files or rows that nobody reads and that the next attempt replaces; a batch in the ledger is left
alone. Rows that lack a required value go to quarantine with the reason. Accepted rows get ids without gaps, from the
ledger's next id on: numbers within each partition of the batch, and the partitions' starts. Files hold the numbers, and
readers add the starts, so a batch takes one job; a database holds the ids, for which one row a partition reaches the
driver. One query writes a sink at a time, its batches in order.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.session import discard, stored
from claimscope.sources import markers


def missing(required: Sequence[str]) -> F.Column:
    """The names of required columns that are null, joined by commas; empty for an acceptable row."""
    return F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull()), ",") if required else F.lit("")


def numbered(rows: DataFrame, first: int, name: str) -> tuple[DataFrame, int]:
    """``rows``, a stored table with ``__row`` (of monotonically_increasing_id), with gapless ids from ``first`` on; and their number."""
    part = F.shiftright("__row", 33)
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], first
    for p, n in sizes:
        starts.append((p, at))
        at += n
    table = rows.sparkSession.createDataFrame(starts, "__part long, __start long")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__row")) - 1
    ids = rows.withColumn("__part", part).join(F.broadcast(table), "__part").withColumn(name, F.col("__start") + rank)  # a row per partition
    return ids.drop("__part", "__start", "__row"), at - first


#: An entry of the ledger of files.
ENTRY = "batch long, first_id long, next_id long"


class FileSink:
    """``writeStream.foreachBatch(FileSink(path, required))``; read with ``accepted``, ``rejected``.

    A batch is written in one pass over its rows and one job: ``reason`` is empty in acceptable rows, which ``__row`` numbers
    (the partition above 33 bits, the acceptable rows before it in the partition below). What a batch costs does not
    depend on how many there were.
    """

    def __init__(self, path: str, required: Sequence[str] = (), id_column: str = "ID"):
        self.path, self.required, self.id_column = path.rstrip("/"), tuple(required), id_column
        self._own: dict | None = None

    @cached_property
    def _marks(self) -> tuple[F.Column, F.Column, F.Column]:
        """Columns of a batch, made once: the reason, the number (which acceptable rows alone ask for, and so count up), the count."""
        return missing(self.required).alias("reason"), F.when(F.col("reason") == "", F.monotonically_increasing_id()).alias("__row"), F.count("__row").alias("n")

    def _marker(self, batch: int) -> str:
        return f"{self.path}/ledger/{batch:012}"

    def last(self, spark: SparkSession) -> dict | None:
        """The latest entry of the ledger."""
        found = markers.names(spark, f"{self.path}/ledger")
        return json.loads(markers.get(spark, f"{self.path}/ledger/{found[-1]}")) if found else None

    def _before(self, spark: SparkSession, batch: int) -> dict | None:
        """The same; the ledger is not listed if the batch follows on the last one that this object committed."""
        follows = self._own is not None and self._own["batch"] == batch - 1 and not markers.there(spark, self._marker(batch))
        return self._own if follows else self.last(spark)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        last = self._before(spark, batch)
        if last is not None and batch <= last["batch"]:
            return
        first, seen = last["next_id"] if last else 1, Observation()
        reason, number, count = self._marks
        marked = rows.select("*", reason).select("*", number).observe(seen, count)
        # the ledger tells which batches are whole, so no mark of success beside it
        marked.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{self.path}/rows/batch={batch}")
        n = seen.get["n"]
        self.commit(spark, batch, first, n)
        self._own = {"batch": batch, "next_id": first + n}

    def commit(self, spark: SparkSession, batch: int, first: int, count: int) -> None:
        entry = {"batch": batch, "first_id": first, "next_id": first + count}
        if not markers.put(spark, self._marker(batch), json.dumps(entry)):
            raise RuntimeError(f"batch {batch} was committed by another writer")

    def _committed(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Rows of committed batches, and their entries."""
        batches = [int(n) for n in markers.names(spark, f"{self.path}/ledger")]
        entries = spark.read.schema(ENTRY).json(f"{self.path}/ledger") if batches else spark.createDataFrame([], ENTRY)
        return spark.read.parquet(f"{self.path}/rows").where(F.col("batch").isin(batches)), entries

    def accepted(self, spark: SparkSession) -> DataFrame:
        rows, entries = self._committed(spark)
        good = rows.where("reason = ''").drop("reason").withColumn("__part", F.shiftright("__row", 33))
        sizes = good.groupBy("batch", "__part").agg(F.count(F.lit(1)).alias("__n"))
        before = F.sum("__n").over(Window.partitionBy("batch").orderBy("__part")) - F.col("__n")  # a row a partition
        starts = sizes.join(entries.select("batch", "first_id"), "batch").select("batch", "__part", (F.col("first_id") + before).alias("__start"))
        number = F.col("__start") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
        return good.join(starts, ["batch", "__part"]).withColumn(self.id_column, number).drop("batch", "__part", "__start", "__row")

    def rejected(self, spark: SparkSession) -> DataFrame:
        """Rows of committed batches that lack a required value, with ``reason``."""
        return self._committed(spark)[0].where("reason <> ''").drop("batch", "__row")


class JdbcSink:
    """The same for a database table, whose rows carry their batch (``BATCH_ID``) and whose ledger is a table beside it.

    A batch is deleted before it is appended, and readers join the ledger (``accepted``); rejected rows go to a file sink's
    place at ``quarantine``. ``driver``: the class of the JDBC driver; credentials and types come through ``options``.
    """

    def __init__(self, url: str, name: str, driver: str, quarantine: str, required: Sequence[str] = (), id_column: str = "ID", **options: str):
        self.url, self.name, self.driver, self.quarantine = url, name, driver, quarantine.rstrip("/")
        self.required, self.id_column, self.options = tuple(required), id_column, options

    def _run(self, spark: SparkSession, *statements: str) -> list[int]:
        """Run statements in one transaction on the driver; the first numbers of their results."""
        jvm, out = spark._jvm, []
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        link = loader.loadClass(self.driver).getDeclaredConstructor(None).newInstance(None).connect(self.url, jvm.java.util.Properties())
        try:
            link.setAutoCommit(False)
            for s in statements:
                statement = link.createStatement()
                if statement.execute(s):
                    result = statement.getResultSet()
                    out += [result.getLong(1) if result.next() else 0]
            link.commit()
        finally:
            link.rollback()
            link.close()
        return out

    def _there(self, spark: SparkSession, name: str) -> bool:
        try:
            self._run(spark, f"SELECT COUNT(*) FROM {name}")
        except Exception:  # noqa: BLE001  databases name a missing table in their own ways
            return False
        return True

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark, ledger = rows.sparkSession, f"{self.name}_LEDGER"
        if not self._there(spark, ledger):
            self._run(spark, f"CREATE TABLE {ledger} (BATCH_ID BIGINT NOT NULL PRIMARY KEY, NEXT_ID BIGINT NOT NULL)")
        done, first = self._run(spark, f"SELECT COUNT(*) FROM {ledger} WHERE BATCH_ID >= {batch}", f"SELECT COALESCE(MAX(NEXT_ID), 1) FROM {ledger}")
        if done:
            return
        marked = stored(rows.withColumn("reason", missing(self.required)).withColumn("__row", F.monotonically_increasing_id()), "batch")
        good, count = numbered(marked.where("reason = ''").drop("reason"), first, self.id_column)
        marked.where("reason <> ''").drop("__row").write.mode("overwrite").parquet(f"{self.quarantine}/batch={batch}")
        if self._there(spark, self.name):
            self._run(spark, f"DELETE FROM {self.name} WHERE BATCH_ID = {batch}")
        own = good.withColumn("BATCH_ID", F.lit(batch).cast("long"))
        own.write.format("jdbc").options(url=self.url, dbtable=self.name, driver=self.driver, **self.options).mode("append").save()
        self.commit(spark, batch, first + count)
        discard(marked)

    def commit(self, spark: SparkSession, batch: int, next_id: int) -> None:
        self._run(spark, f"INSERT INTO {self.name}_LEDGER VALUES ({batch}, {next_id})")

    def accepted(self, spark: SparkSession) -> DataFrame:
        """Rows of committed batches; the database does the join."""
        query = f"SELECT t.* FROM {self.name} t JOIN {self.name}_LEDGER l ON l.BATCH_ID = t.BATCH_ID"
        return spark.read.format("jdbc").options(url=self.url, query=query, driver=self.driver).load().drop("BATCH_ID")
