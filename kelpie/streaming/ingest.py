"""Incremental indexing with Structured Streaming: new rows update a keyed table, late ones count in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from kelpie.operators.stores import bucket_of, latest, stored, write_partitions
from kelpie.session import materialize


def rows_of(spark: SparkSession, path: str, schema: StructType, files_each: int | None = None) -> DataFrame:
    """New Parquet files under a path as a stream; the checkpoint remembers those that were read."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).parquet(path)


def windowed(events: DataFrame, at: str, length: str, late: str, by: list[str]) -> DataFrame:
    """Rows per window and key; rows later than the watermark are left out. Rows without a time have no window.

    Times without a zone are read, and starts given, as UTC, whatever the session's zone.
    """
    utc, here = F.lit("UTC"), F.current_timezone()
    kept = events.where(F.col(at).isNotNull()).withColumn(at, F.convert_timezone(utc, here, F.col(at)).cast("timestamp")).withWatermark(at, late)
    return kept.groupBy(F.window(at, length), *by).agg(F.count(F.lit(1)).alias("rows")).select(F.convert_timezone(here, utc, F.col("window.start").cast("timestamp_ntz")).alias("start"), *by, "rows")


def into_table(path: str, keys: list[str], order: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each key keeps its latest row of all batches, a late one does not replace a newer one.

    The table is cut into ``buckets`` by a hash of the key; a batch reads and writes only
    those its keys fall into, so choose their number for parts of some hundred MB. A batch
    that runs again gives the same table.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("bucket", bucket_of(keys, buckets))
        touched = fresh.select("bucket").distinct()  # at most as many rows as buckets
        old = stored(batch.sparkSession, path, fresh.schema).join(F.broadcast(touched), "bucket", "left_semi").select(*fresh.columns)
        write_partitions(materialize(latest(old.unionByName(fresh), keys, [F.col(order)]), "table"), path, "bucket")

    return write


def follow(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: str, every: str | None = None, buckets: int = 16) -> StreamingQuery:
    """Keep a keyed table up to date: once with what is there, or again and again after ``every``."""
    writer = stream.writeStream.foreachBatch(into_table(table, keys, order, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def followed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that ``follow`` keeps, in the schema of its stream."""
    return stored(spark, path, StructType(schema.fields).add("bucket", IntegerType())).drop("bucket")
