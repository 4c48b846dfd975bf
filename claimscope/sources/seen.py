"""The store of links that were seen: a bucketed table behind a filter of fixed size.

Links are hashed into a bitmap of ``bits`` bits, whatever their number is; a link whose bit is not set was never seen and
goes no further. The others are looked up exactly: their distinct addresses are dealt to the store's buckets and joined
there, so the store itself is never moved, however large it has grown. The bitmap goes to every task (``bits`` / 8 bytes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one row of the bitmap, as Spark's bitmap functions have them.
_ROW = 32_768


class SeenLinks:
    """``name``: the store's table in the session's catalog; ``path``: its folder. A null address is never seen."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 256, bits: int = 1 << 23):
        self.spark, self.name, self.path, self.buckets, self.bits = spark, name, path.rstrip("/"), buckets, bits

    def _there(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def store(self) -> DataFrame:
        """(url) of all links seen; a filter on an address opens one bucket."""
        return self.spark.table(self.name)

    def _hash(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.bits)) + 1

    def bitmap(self) -> DataFrame:
        """(row, bits): at most ``bits`` / 32,768 rows of 4 KB."""
        return self.spark.read.schema("row long, bits binary").parquet(f"{self.path}/filter").groupBy("row").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _may_be_seen(self, links: DataFrame, url: str) -> DataFrame:
        """Adds __may: whether the link's bit is set."""
        hashed = links.withColumn("__row", F.bitmap_bucket_number(self._hash(F.col(url)))).withColumn("__bit", F.bitmap_bit_position(self._hash(F.col(url))))
        known = F.broadcast(self.bitmap().withColumnRenamed("row", "__known"))  # of fixed size
        byte = F.conv(F.hex(F.substr("bits", (F.floor(F.col("__bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.shiftright(byte.cast("long"), 0).bitwiseAND(F.pow(F.lit(2), F.col("__bit") % 8).cast("long")) > 0
        return hashed.join(known, F.col("__row") == F.col("__known"), "left").withColumn("__may", F.coalesce(bit, F.lit(False))).drop("__row", "__bit", "__known", "bits")

    def seen_addresses(self, links: DataFrame, url: str = "url") -> DataFrame:
        """(__seen): the distinct addresses of ``links`` that the store holds. Only they are shuffled, to the store's buckets."""
        asked = self._may_be_seen(links.select(url), url).where("__may").select(F.col(url).alias("__seen")).distinct()
        return asked.repartition(self.buckets, "__seen").join(self.store().hint("merge"), F.col("__seen") == F.col("url"), "left_semi")

    def seen(self, links: DataFrame, url: str = "url") -> DataFrame:
        """The rows whose link was seen."""
        if not self._there():
            return links.limit(0)
        return links.join(self.seen_addresses(links, url), F.col(url) == F.col("__seen"), "left_semi")

    def unseen(self, links: DataFrame, url: str = "url") -> DataFrame:
        """The rows whose link was not."""
        if not self._there():
            return links
        return links.join(self.seen_addresses(links, url), F.col(url) == F.col("__seen"), "left_anti")

    def add(self, links: DataFrame, url: str = "url") -> None:
        """Remember links; those known already are not stored again.

        The bitmap is written first: an attempt that dies between leaves bits without links, which the exact look-up corrects.
        """
        new = self.unseen(links.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct())
        hashed = new.select(F.bitmap_bucket_number(self._hash(F.col("url"))).alias("row"), F.bitmap_bit_position(self._hash(F.col("url"))).alias("bit"))
        hashed.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).write.mode("append").parquet(f"{self.path}/filter")
        dealt = new.repartition(self.buckets, "url")  # one file a bucket
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "url").sortBy("url").option("path", f"{self.path}/links").saveAsTable(self.name)
