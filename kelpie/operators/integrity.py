"""References to records that do not exist.

Method: references and the validity intervals of parents go through one shuffle on the key
and one sort on (key, time), then a linear merge: a running maximum of the ends of the
intervals begun so far tells for each reference whether a parent was live at its time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.operators.skew import hot_keys, replicated, salted

_FIRST, _LAST = "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def references(df: DataFrame, table: str, field: str, row_id: str, at: str) -> DataFrame:
    """The non-null, non-empty references of one column in the form the merge takes."""
    return df.where(F.col(field).isNotNull() & (F.col(field) != "")).select(
        F.lit(table).alias("ref_table"),
        F.lit(field).alias("ref_field"),
        F.col(row_id).cast("string").alias("row_id"),
        F.col(field).alias("key"),
        F.col(at).cast("timestamp_ntz").alias("at"),
    )


def lifetimes(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Distinct validity intervals; a null start is open to the past, a null end to the future."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"), F.coalesce(F.col(start).cast("timestamp_ntz"), _ntz(_FIRST)).alias("at"))
        .agg(F.max(F.coalesce(F.col(end).cast("timestamp_ntz"), _ntz(_LAST))).alias("until"))
    )


def judged(refs: DataFrame, parents: DataFrame, split_rows: int = 250_000) -> DataFrame:
    """Each reference with ``status``: live, missing, deleted, late or undated.

    ``missing``: the key has no parent row at all. ``late``: the first parent row begins
    after the reference. ``deleted``: parents began before it, all had ended by then.
    ``undated``: the reference has no time, though its key has parents. Intervals are
    closed at the start and open at the end. Repeated reference rows stay (see
    ``orphans``); repeated parent rows count once. Keys with more than ``split_rows``
    references are split, their parents' intervals going to every part. Empty inputs give
    an empty result, an empty parent table makes every reference missing.
    """
    hot = hot_keys(refs, "key", split_rows)
    left = salted(refs, hot, "key", "row_id").withColumns({"_kind": F.lit(1), "until": F.lit(None).cast("timestamp_ntz")})
    right = replicated(parents, hot, "key").withColumn("_kind", F.lit(0))
    merged = left.unionByName(right, allowMissingColumns=True)
    group = Window.partitionBy("key", "salt")
    so_far = group.orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    status = (
        F.when(F.col("_known") == 0, "missing")
        .when(F.col("at").isNull(), "undated")
        .when(F.col("_end").isNull(), "late")
        .when(F.col("_end") <= F.col("at"), "deleted")
        .otherwise("live")
    )
    return (
        merged.withColumn("_end", F.max("until").over(so_far))
        .withColumn("_known", F.count("until").over(group))
        .where("_kind = 1")
        .select("ref_table", "ref_field", "row_id", "key", "at", status.alias("status"))
    )


def orphans(refs: DataFrame, parents: DataFrame, split_rows: int = 250_000) -> DataFrame:
    """References without a parent known to be live, once for each (table, field, row, key, time).

    One without a time is among them, as no parent can be shown to be live then: status
    undated (or missing) and a null period.
    """
    found = judged(refs, parents, split_rows).where(F.col("status") != "live")
    return found.dropDuplicates(["ref_table", "ref_field", "row_id", "key", "at"]).withColumn("period", F.date_format("at", "yyyy-MM"))


def report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, period and status."""
    return found.groupBy("ref_table", "ref_field", "period", "status").agg(F.count(F.lit(1)).alias("orphans"))
