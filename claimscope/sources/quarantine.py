"""Broken input is kept: rows that a format or schema does not take go to quarantine with their text, reason and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimscope.session import stored

#: Names of the columns of a quarantine table.
RECORD, REASON, PLACE = "record", "reason", "place"
_BROKEN = "__broken"


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of CSV files: rows with too few or too many fields, or with values that are none of their type,
    come out as record, reason and place (file). The files are parsed once, into a stored table of both."""
    own = StructType.fromDDL(schema)
    wide = StructType.fromDDL(f"{schema}, `{_BROKEN}` string")
    reader = spark.read.option("header", header).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).option("enforceSchema", True)
    parsed = reader.schema(wide).csv(path).select(*wide.names, F.col("_metadata.file_path").alias(PLACE))
    kept = stored(parsed, "parsed")
    # a doubled quote ends one quoted stretch and begins the next, so what is left has the separators alone
    fields = F.regexp_count(F.regexp_replace(_BROKEN, '"[^"]*"', ""), F.lit(",")) + 1
    reason = F.when(fields < len(own), "too few fields").when(fields > len(own), "too many fields").otherwise("a value of another type")
    broken = kept.where(F.col(_BROKEN).isNotNull()).select(F.col(_BROKEN).alias(RECORD), reason.alias(REASON), PLACE)
    return kept.where(F.col(_BROKEN).isNull()).select(*own.names), broken


def json_arrays(rows: DataFrame, body: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(elements, quarantine) of a column of JSON arrays of objects.

    Elements come out as the other columns, ``pos`` (from 0) and the fields (name to type), of which none may be missing.
    What is not JSON, not an array, or an element that is no object or lacks a field goes to quarantine with the other
    columns, ``pos`` (null for a whole body), record and reason. A null body has no elements. Native.
    """
    others = [c for c in rows.columns if c != body]
    parsed = rows.withColumn("__v", F.try_parse_json(body))
    kind = F.schema_of_variant("__v")
    whole = F.when(F.col("__v").isNull(), "no JSON").when(~kind.startswith("ARRAY"), "no array")
    marked = parsed.where(F.col(body).isNotNull()).withColumn("__why", whole)
    bad = marked.where("__why is not null").select(*others, F.lit(None).cast("int").alias("pos"), F.col(body).alias(RECORD), F.col("__why").alias(REASON))
    each = marked.where("__why is null").select(*others, F.posexplode(F.variant_get("__v", "$", "array<variant>")).alias("pos", "__e"))
    values = [F.try_variant_get("__e", f"$.{name}", of).alias(name) for name, of in fields.items()]
    lacking = F.array_join(F.array_compact(F.array(*[F.when(F.try_variant_get("__e", f"$.{n}", of).isNull(), F.lit(n)) for n, of in fields.items()])), ",")
    why = F.when(F.col("__e").isNull() | ~F.schema_of_variant("__e").startswith("OBJECT"), "no object").when(lacking != "", F.concat(F.lit("without "), lacking))
    judged = each.withColumn("__why", why)
    good = judged.where("__why is null").select(*others, "pos", *values)
    return good, bad.unionByName(judged.where("__why is not null").select(*others, "pos", F.to_json("__e").alias(RECORD), F.col("__why").alias(REASON)))


def append(broken: DataFrame, path: str, source: Column) -> None:
    """Append a quarantine table to the store at ``path``, cut by its source."""
    broken.withColumn("source", source).write.mode("append").partitionBy("source").parquet(path)
