"""Mixing sources to target weights.

Each document has a hash; the documents of a source used once more than the rest are those
whose hash lies below a threshold. The threshold comes from histograms of tokens by source
and hash bucket: only the boundary bucket is refined, twice, and nothing is sorted. What the
threshold leaves over is less than the document it stops at; documents beyond it that fill
this rest best are told by a histogram of tokens by source and document size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm.tokenizers import FOLDER, byte_bpe
from kelpie.session import materialize, spread

_BITS = 10  # of the hash for each level of buckets


def token_counts(df: DataFrame, keep: list[str], text: str = "text", folder: str = FOLDER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``; a null or empty text has none."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_bpe(folder)
        for b in batches:
            yield b[keep].assign(n_tokens=[len(encoder.encode_ordinary(t)) if t else 0 for t in b["_text"]])

    return spread(df.select(*keep, F.col(text).alias("_text"))).mapInPandas(count, schema)


def _boundary(sums: DataFrame, part: str, wanted: DataFrame) -> DataFrame:
    """Per source: the bucket in which the running sum passes ``need``, and what is needed of it."""
    running = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sums.withColumn("_sum", F.sum("n").over(running)).join(wanted.select("source", "need"), "source")
        .where((F.col("_sum") > F.col("need")) & (F.col("_sum") - F.col("n") <= F.col("need")))
        .groupBy("source").agg(F.min(part).alias(part), F.min(F.col("need") - F.col("_sum") + F.col("n")).alias("need"))
    )


def plan(sized: DataFrame, targets: DataFrame, total: int | str | None = None) -> DataFrame:
    """One row for each listed source: budget, whole uses of every document, and what is left for a part of them.

    Sources without any token cannot take part; the others' shares are scaled to sum to 1.
    ``total`` tokens are mixed: a number, ``available`` for as many as the listed sources
    hold, or by default the most with which the caps let every source meet its share (the
    source that is scarcest for its share and cap then sets the size). A source whose cap does
    not reach its ``wish`` gives what it can, and nothing takes its place. Repeated rows of a
    source in ``targets`` add up their shares and keep the largest cap.
    """
    wish = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("repeat_cap").alias("repeat_cap"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    both = wish.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    able = (F.col("available") > 0) & (F.col("repeat_cap") > 0)
    everything = Window.partitionBy(F.lit(1))  # one row for each listed source
    share = F.when(able, F.col("target_share")) / F.sum(F.when(able, F.col("target_share"))).over(everything)
    if total is None:
        size = F.floor(F.min(F.when(able, F.col("available") * F.col("repeat_cap") / F.col("share"))).over(everything))
    elif total == "available":
        size = F.sum(F.when(able, F.col("available"))).over(everything)
    else:
        size = F.lit(total).cast("bigint")
    mixed = both.withColumn("share", share).withColumn("total", size).withColumn("wish", F.coalesce(F.round(F.col("total") * F.col("share")).cast("bigint"), F.lit(0)))
    return (
        mixed.withColumn("budget", F.least("wish", F.col("available") * F.col("repeat_cap")))
        .withColumn("uses", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int"))
        .withColumn("need", F.when(F.col("uses") < F.col("repeat_cap"), F.col("budget") - F.col("uses") * F.col("available")).otherwise(0))
    )


def _best_fill(group: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each size fill the rest of one source: the largest that fit, and one more if that comes nearer."""
    rest, take = int(group["rest"].iloc[0]), {}
    sizes = group.sort_values("n_tokens", ascending=False)
    for n, many in zip(sizes["n_tokens"], sizes["documents"]):
        if n <= rest:
            take[n] = min(int(many), rest // n)
            rest -= take[n] * n
    left = [n for n, many in zip(sizes["n_tokens"], sizes["documents"]) if many > take.get(n, 0)]
    if left and min(left) < 2 * rest:
        take[min(left)] = take.get(min(left), 0) + 1
    return pd.DataFrame({"source": group["source"].iloc[0], "n_tokens": list(take), "take": list(take.values())})


def _first(df: DataFrame, per: list[str], order: list[str], most: str) -> DataFrame:
    """The first rows of each group, as many as ``most`` says; parts of a group are thinned before it comes together."""
    for group in ([*per, "_part"], per):
        n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(1024))).withColumn("_n", n).where(F.col("_n") <= F.col(most))
    return df.drop("_part", "_n")


def mix(df: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 1, folder: str = FOLDER) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): ``doc_id, source, n_tokens, uses``, and for each listed source what it should give and gives.

    Documents of a null or unlisted source take no part, nor do texts without tokens; rows
    that repeat id, source and text are one document. No document is used more than its
    source's cap. Each source misses its budget by less than the shortest document it could
    still use (``shortest_left``; null where all are used up to the cap). ``short_tokens`` is
    what it lacks of its share of the total. The choice depends on ids, texts and ``seed`` alone.
    """
    listed = targets.where("source IS NOT NULL").select("source").distinct()
    taking = spread(df.select("doc_id", "source", "text")).join(listed, "source", "left_semi").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    sized = materialize(
        token_counts(taking, ["doc_id", "source", "h"], folder=folder).where("n_tokens > 0").distinct()
        .withColumn("b1", F.shiftrightunsigned("h", 64 - _BITS)).withColumn("b2", F.shiftrightunsigned(F.shiftleft("h", _BITS), 64 - _BITS)),
        "sizes",
    )
    wanted = materialize(plan(sized, targets, total), "plan")
    first = _boundary(sized.groupBy("source", "b1").agg(F.sum("n_tokens").alias("n")), "b1", wanted)
    inside = sized.join(first, ["source", "b1"])
    second = _boundary(inside.groupBy("source", "b2").agg(F.sum("n_tokens").alias("n")), "b2", first)
    within = inside.drop("need").join(second, ["source", "b2"]).groupBy("source", "h").agg(F.sum("n_tokens").alias("n"), F.first("need").alias("need"))
    running = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = within.withColumn("_sum", F.sum("n").over(running)).where("_sum <= need").groupBy("source").agg(F.max("h").alias("h_last"))
    bounds = materialize(
        wanted.select("source", "uses", "need", "repeat_cap")
        .join(first.select("source", F.col("b1").alias("c1")), "source", "left")
        .join(second.select("source", F.col("b2").alias("c2")), "source", "left").join(last, "source", "left"),
        "bounds",
    )
    below = (
        F.col("c1").isNull()
        | (F.col("b1") < F.col("c1"))
        | ((F.col("b1") == F.col("c1")) & ((F.col("b2") < F.col("c2")) | ((F.col("b2") == F.col("c2")) & (F.col("h") <= F.coalesce("h_last", F.lit(-(2**63)))) & F.col("h_last").isNotNull())))
    )
    placed = sized.join(bounds, "source").withColumn("extra", (F.col("need") > 0) & F.coalesce(below, F.lit(False))).drop("c1", "c2", "h_last", "b1", "b2")
    taken = placed.where("need > 0").groupBy("source").agg(F.first("need").alias("need"), F.sum(F.when(F.col("extra"), F.col("n_tokens")).otherwise(0)).alias("taken"))
    rest = materialize(taken.select("source", (F.col("need") - F.col("taken")).alias("rest")).where("rest > 0"), "rest")
    # sizes up to twice the rest, which is less than one document: few rows whatever the number of documents
    open_ = placed.where("need > 0 AND NOT extra").join(rest, "source").where(F.col("n_tokens") < 2 * F.col("rest"))
    sizes = open_.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("documents"), F.first("rest").alias("rest"))
    fill = materialize(sizes.groupBy("source").applyInPandas(_best_fill, "source string, n_tokens bigint, take bigint"), "fill")
    filled = materialize(_first(open_.join(fill, ["source", "n_tokens"]), ["source", "n_tokens"], ["h", "doc_id"], "take").select("source", "h", F.col("doc_id").alias("filled_id"), F.lit(True).alias("filled")), "filled")
    same = (F.col("p.source") == F.col("f.source")) & (F.col("p.h") == F.col("f.h")) & F.col("p.doc_id").eqNullSafe(F.col("f.filled_id"))
    used = placed.alias("p").join(filled.alias("f"), same, "left").select("p.doc_id", "p.source", "p.n_tokens", "p.repeat_cap", (F.col("p.uses") + (F.col("p.extra") | F.col("f.filled").isNotNull()).cast("int")).alias("uses"), F.col("p.uses").alias("least"))
    selection = used.where("uses > 0").select("doc_id", "source", "n_tokens", "uses")
    sums = used.groupBy("source").agg(
        F.count_if(F.col("uses") > 0).alias("documents"), F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"),
        F.min(F.when((F.col("uses") == F.col("least")) & (F.col("uses") < F.col("repeat_cap")), F.col("n_tokens"))).alias("shortest_left"),
    )
    everything = Window.partitionBy(F.lit(1))
    shares = (
        wanted.select("source", "target_share", "repeat_cap", F.col("available").alias("available_tokens"), F.col("budget").alias("budget_tokens"), "wish")
        .join(sums, "source", "left").fillna(0, ["documents", "used_tokens", "most_uses"])
        .withColumn("short_tokens", F.greatest(F.col("wish") - F.col("used_tokens"), F.lit(0))).drop("wish")
        .withColumn("actual_share", F.coalesce(F.try_divide("used_tokens", F.sum("used_tokens").over(everything)), F.lit(0.0)))
    )
    return selection, shares
