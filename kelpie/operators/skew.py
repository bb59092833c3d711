"""Splitting of hot groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.session import materialize

#: Rows of one key beyond which its group is split. A group below it stays in one task: at 100 bytes a row, 100 MB.
SPLIT_ROWS = 1_000_000
#: Hot keys up to which their table is broadcast (a few MB); beyond it the planner chooses the join.
MOST_BROADCAST = 100_000


def hot_keys(df: DataFrame, keys: str | list[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Keys with more than ``split_rows`` rows and the number of parts to split each into, written once.

    Counts combine before the shuffle. Every such key comes out, so there are at most
    rows / ``split_rows`` of them. A null key is never hot. Columns: the keys and ``parts``.
    """
    keys = [keys] if isinstance(keys, str) else keys
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return materialize(counts.where(F.col("_n") > split_rows).select(*keys, F.ceil(F.col("_n") / split_rows).cast("int").alias("parts")), "hot")


def _known(hot: DataFrame) -> DataFrame:
    return F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot


def salted(df: DataFrame, hot: DataFrame, keys: str | list[str], by: str | list[str]) -> DataFrame:
    """The side with many rows: ``salt`` spreads rows of a hot key by the hash of ``by``. ``hot`` is a materialised table."""
    by = [by] if isinstance(by, str) else by
    return (
        df.join(_known(hot), keys, "left")
        .withColumn("salt", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), "parts").cast("int")))
        .drop("parts")
    )


def replicated(df: DataFrame, hot: DataFrame, keys: str | list[str]) -> DataFrame:
    """The other side: each row of a hot key once for each of its salts."""
    return (
        df.join(_known(hot), keys, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
        .drop("parts")
    )


def split_join(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], how: str = "inner", split_rows: int = SPLIT_ROWS, rows: int | None = None) -> DataFrame:
    """``many`` joined with ``few``, where a key may hold a large part of the rows of ``many``.

    The number of rows of ``many`` tells at once whether a key can be hot at all: ``rows``,
    an upper bound that the caller knows, or the count of what is then best a
    materialised table. The rows of a hot key spread by the hash of ``by``, those of ``few``
    go to all its parts. ``how`` is inner, left, left_semi or left_anti.
    """
    if (many.count() if rows is None else rows) <= split_rows:
        return many.join(few, keys, how)
    hot = hot_keys(many, keys, split_rows)
    return salted(many, hot, keys, by).join(replicated(few, hot, keys), [*keys, "salt"], how).drop("salt")
