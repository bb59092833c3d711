"""Keyed tables: upsert, idempotent partition writes, verification and state."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kelpie.session import delete


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in the given order, found by combining rows before the shuffle.

    A null key is a key like any other. Rows equal in the order are told apart by all their
    columns' hash, so that the result does not depend on how the rows are spread.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.xxhash64(*[F.to_json(F.struct(*df.columns))]).alias("h"))
    return df.groupBy(*keys).agg(F.max_by(row, place).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not in ``new``, and all of ``new``. A null key never equals another."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new)


def without(old: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows that no tombstone names."""
    return old.join(deleted.select(*keys).distinct(), keys, "left_anti")


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table at a path, read with its schema; one that was never written, or has no rows, is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The part of a table that holds a key: a hash, so that parts stay few and alike whatever the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_partitions(df: DataFrame, path: str, by: str, touched: DataFrame | None = None) -> None:
    """Replace the partitions that ``df`` has; those that ``touched`` names and ``df`` has not are removed.

    Running it again gives the same table. ``df`` must not read what it replaces.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if touched is not None:
        for row in touched.select(by).distinct().join(df.select(by).distinct(), by, "left_anti").toLocalIterator():
            delete(df.sparkSession, f"{path}/{by}={row[0]}")


def verify(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each collection on both sides: OK, INCOMPLETE, MISSING, or EXTRA where only the target has it."""
    a, b = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected")), target.groupBy(*keys).agg(F.count(F.lit(1)).alias("stored"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.alias("a").join(b.alias("b"), on, "full").select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("stored", F.lit(0)).alias("stored"))
    return both.withColumn("status", F.when(F.col("expected") == 0, "EXTRA").when(F.col("stored") == 0, "MISSING").when(F.col("stored") < F.col("expected"), "INCOMPLETE").otherwise("OK"))


#: Kinds of incidents; any other is Unknown.
INCIDENTS = ["CrashLoopBackOff", "OOMKilled", "SecretMount", "ProbeFailure", "PipelineFailure", "InfraFailure", "AppStartup", "NetworkPolicy", "ImagePull", "Unknown"]


def investigations(df: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Valid investigations to append: the four required fields are there, the kind is a known one, id and time are set."""
    needed = ["client", "service_name", "root_cause_summary", "resolution"]
    whole = df
    for c in needed:
        whole = whole.where(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    kind = F.when(F.col("incident_type").isin(kinds or INCIDENTS), F.col("incident_type")).otherwise("Unknown")
    return whole.withColumns({"id": F.expr("uuid()"), "timestamp": F.current_timestamp(), "incident_type": kind})
