"""Comparison, listing and freshness of branches of repositories."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.names import branch_tier, file_class, release_version


def snapshots(chunks: DataFrame) -> DataFrame:
    """``repo, branch, file, hash``: each file of a branch with a hash of its distinct texts, in whatever order.

    Null texts count as none. Hashes combine before the shuffle, so no file's texts are gathered.
    """
    known = chunks.where("repo IS NOT NULL AND branch IS NOT NULL AND file IS NOT NULL")
    texts = known.select("repo", "branch", "file", F.sha2("text", 256).alias("t")).distinct()
    parts = [F.coalesce(F.bit_xor(F.when(F.col("t").isNotNull(), F.xxhash64(F.lit(seed), "t"))), F.lit(0)) for seed in (1, 2)]
    return texts.groupBy("repo", "branch", "file").agg(F.concat_ws("-", F.count("t"), *[F.hex(p) for p in parts]).alias("hash"))


def diff(files: DataFrame, base: str, compare: str) -> DataFrame:
    """``repo, file, status, class`` of every file that differs between two branches of a repo: A, M or D."""
    a = files.where(F.col("branch") == base).select("repo", "file", F.col("hash").alias("old"))
    b = files.where(F.col("branch") == compare).select("repo", "file", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old") != F.col("new"), "M")
    return a.join(b, ["repo", "file"], "full").withColumns({"status": status, "class": file_class(F.col("file"))}).where("status IS NOT NULL").drop("old", "new")


def diff_summary(changes: DataFrame) -> DataFrame:
    """Changes per repo and class, added, modified, deleted and in all."""
    return changes.groupBy("repo", "class").agg(
        F.count_if(F.col("status") == "A").alias("added"), F.count_if(F.col("status") == "M").alias("modified"), F.count_if(F.col("status") == "D").alias("deleted"), F.count(F.lit(1)).alias("total")
    )


def _lines_changed(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(a, b):
        codes = SequenceMatcher(None, (x or "").splitlines(), (y or "").splitlines(), autojunk=False).get_opcodes()
        gone = sum(i2 - i1 for tag, i1, i2, _, _ in codes if tag in ("delete", "replace"))
        come = sum(j2 - j1 for tag, _, _, j1, j2 in codes if tag in ("insert", "replace"))
        rows.append((come, gone))
    return pd.DataFrame(rows, columns=["added", "removed"])


def line_changes(chunks: DataFrame, base: str, compare: str) -> DataFrame:
    """``repo, file, chunk_index, added, removed``: lines that differ in the chunks two branches share.

    A null text has no lines. Copies of one chunk that are equal count once.
    """
    a = chunks.where(F.col("branch") == base).select("repo", "file", "chunk_index", F.col("text").alias("old")).distinct()
    b = chunks.where(F.col("branch") == compare).select("repo", "file", "chunk_index", F.col("text").alias("new")).distinct()
    both = a.join(b, ["repo", "file", "chunk_index"]).where(~F.col("old").eqNullSafe(F.col("new")))
    changed = F.pandas_udf(_lines_changed, "added int, removed int")(F.col("old"), F.col("new"))
    return both.select("repo", "file", "chunk_index", changed.alias("c")).select("repo", "file", "chunk_index", "c.added", "c.removed")


def listed(branches: DataFrame) -> DataFrame:
    """Distinct branches of each repo with tier and place in the order of tiers and names."""
    tiers = ["production", "integration", "staging", "development", "feature"]
    place = F.coalesce(*[F.when(F.col("tier") == t, F.lit(i)) for i, t in enumerate(tiers)], F.lit(5))
    one = branches.where("repo IS NOT NULL AND branch IS NOT NULL").select("repo", "branch").distinct().withColumn("tier", branch_tier(F.col("branch")))
    return one.withColumn("position", F.row_number().over(Window.partitionBy("repo").orderBy(place, "branch")))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype=float)


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two names."""
    return F.pandas_udf(_ratio, "double")(a, b)


def closest(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """For each (repo, branch) asked for, whether it is there and otherwise the closest branch of the repo.

    Release branches go by the distance of versions, all others by likeness of names; ties go
    to the smaller name. ``closest`` is null for a repo without branches. Only distinct names
    that are not there meet those of their repo.
    """
    known = have.where("repo IS NOT NULL AND branch IS NOT NULL").select("repo", F.col("branch").alias("candidate")).distinct()
    asked = wanted.where("repo IS NOT NULL AND branch IS NOT NULL").select("repo", "branch").distinct()
    there = known.withColumnRenamed("candidate", "branch")
    exact = asked.join(there, ["repo", "branch"], "left_semi").select("repo", "branch", F.lit(True).alias("indexed"), F.col("branch").alias("closest"))
    pairs = asked.join(there, ["repo", "branch"], "left_anti").join(known, "repo", "left")
    gap = F.abs(release_version(F.col("branch")) - release_version(F.col("candidate")))
    measured = pairs.withColumns({"gap": gap, "ratio": similarity(F.col("branch"), F.col("candidate"))})
    best = measured.groupBy("repo", "branch").agg(
        F.min(F.when(F.col("gap").isNotNull(), F.struct("gap", "candidate"))).alias("by_version"),
        F.min(F.when(F.col("ratio") > 0, F.struct((-F.col("ratio")).alias("r"), "candidate"))).alias("by_name"),
    )
    return exact.unionByName(best.select("repo", "branch", F.lit(False).alias("indexed"), F.coalesce("by_version.candidate", "by_name.candidate").alias("closest")))


def status_list(configured: DataFrame, state: DataFrame) -> DataFrame:
    """Each configured (repo, branch) with the first 8 digits of its commit and the time of its last sync, ``n/a`` and ``never`` without one."""
    known = state.groupBy("repo", "branch").agg(F.max(F.struct("synced_at", "commit")).alias("s"))
    both = configured.select("repo", "branch").distinct().join(known, ["repo", "branch"], "left")
    when = F.coalesce(F.date_format("s.synced_at", "yyyy-MM-dd HH:mm:ss"), F.lit("never"))
    return both.select("repo", "branch", F.coalesce(F.left("s.commit", F.lit(8)), F.lit("n/a")).alias("commit"), when.alias("synced_at"))


def freshness(heads: DataFrame, indexed: DataFrame) -> DataFrame:
    """Each (repo, branch, head) fresh, stale or unknown against what is indexed (repo, branch, at)."""
    status = F.when(F.col("at").isNull(), "unknown").when(F.col("at") >= F.col("head"), "fresh").otherwise("stale")
    return heads.join(indexed, ["repo", "branch"], "left").withColumn("status", status)


def freshness_summary(states: DataFrame) -> DataFrame:
    counts = states.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status") == "stale").alias("stale"), F.coalesce(F.bool_and(F.col("status") == "fresh"), F.lit(True)).alias("all_fresh"))
    message = F.when(F.col("all_fresh"), "All branches fresh").when(F.col("stale") > 0, F.format_string("%d branch(es) stale", "stale")).otherwise(F.format_string("Checked %d branch(es)", "checked"))
    return counts.withColumn("message", message)
