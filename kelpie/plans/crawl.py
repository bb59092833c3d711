"""Ingest of files to classes, edges and chunks, written by partition; only what changed is read again.

``files`` has ``repo, branch, file, text``. Tables below ``out``: ``state`` (hash of each
file), ``files``, ``edges``, ``chunks``; partitioned by a hash of repo and branch, so that a
run replaces the parts it touches and may be run again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from kelpie.functions.names import file_class
from kelpie.functions.text import chunk_id
from kelpie.operators import chunking as C
from kelpie.operators import extraction as X
from kelpie.operators.stores import bucket_of, stored, without, write_partitions
from kelpie.session import materialize

KEYS = ["repo", "branch", "file"]


def changes(files: DataFrame, state: DataFrame) -> DataFrame:
    """``repo, branch, file, hash, status``: A, M, D, or S for files that stayed the same."""
    now = files.select(*KEYS, F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    both = now.join(state.select(*KEYS, F.col("hash").alias("old")), KEYS, "full")
    status = F.when(F.col("old").isNull(), "A").when(F.col("hash").isNull(), "D").when(F.col("hash") != F.col("old"), "M").otherwise("S")
    return both.select(*KEYS, "hash", status.alias("status"))


def edges_of(files: DataFrame) -> DataFrame:
    """Edges of all kinds, each extractor on the files of its class."""
    kind = files.withColumn("class", file_class(F.col("file")))
    parts = [
        X.pipeline_edges(kind.where("class = 'pipeline'")), X.terraform_edges(kind.where("class = 'terraform'")),
        X.mount_edges(kind.where("class IN ('template', 'helm_values')")), X.settings_edges(kind.where("class = 'config'")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def chunks_of(files: DataFrame) -> DataFrame:
    """Structural chunks, and pieces of fixed size of the files without structure."""
    known = files.where("text IS NOT NULL").withColumn("id", F.to_json(F.struct(*KEYS)))
    cut = C.structural(known).select("id", "chunk_index", "text")
    rest = C.fixed(known.join(cut.select("id").distinct(), "id", "left_anti")).select("id", "chunk_index", "text")
    named = cut.unionByName(rest).withColumn("k", F.from_json("id", "repo string, branch string, file string"))
    return named.select("k.*", "chunk_index", "text").withColumn("id", chunk_id(F.col("file"), F.col("branch"), F.col("chunk_index")))


def sync(files: DataFrame, out: str, buckets: int = 16) -> DataFrame:
    """Bring the tables below ``out`` up to date and return the changes, counted by repo, branch and status.

    Files of which nothing changed are neither extracted nor cut again. Deleted files leave
    all tables, also the last one of a repository. Running it again without changes writes
    nothing. Rows without repo, branch or file are left out, of repeated ones the first text
    in order counts.
    """
    spark = files.sparkSession
    state_kind = StructType([StructField(k, StringType()) for k in [*KEYS, "hash"]] + [StructField("bucket", IntegerType())])
    part = bucket_of(["repo", "branch"], buckets).alias("bucket")
    whole = files.dropna(subset=KEYS).groupBy(*KEYS).agg(F.min("text").alias("text"))
    found = materialize(changes(whole, stored(spark, f"{out}/state", state_kind)), "changes")
    touched = found.where("status <> 'S'")
    report = found.groupBy("repo", "branch", "status").agg(F.count(F.lit(1)).alias("files"))
    if touched.isEmpty():
        return report
    parts = materialize(touched.select(part).distinct(), "parts")
    fresh = materialize(whole.join(touched.where("status <> 'D'").select(*KEYS), KEYS, "left_semi"), "fresh")
    made = {"files": fresh.select(*KEYS, file_class(F.col("file")).alias("class")), "edges": edges_of(fresh), "chunks": chunks_of(fresh)}
    for name, new in made.items():
        new = new.select("*", part)
        old = stored(spark, f"{out}/{name}", new.schema).join(parts, "bucket", "left_semi")
        kept = without(old, touched, KEYS).select(*new.columns)
        write_partitions(materialize(kept.unionByName(new), name), f"{out}/{name}", "bucket", parts)
    state = found.where("status <> 'D'").select(*KEYS, "hash", part).join(parts, "bucket", "left_semi")
    write_partitions(materialize(state, "state"), f"{out}/state", "bucket", parts)
    return report
