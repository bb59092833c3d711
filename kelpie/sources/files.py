"""Files, JSON stores and configuration as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.names import file_class, tree_kind
from kelpie.functions.text import extension, line_count

# Extensions read for chunks and for trees, and folders never read.
CHUNK_EXTENSIONS = [".tf", ".yaml", ".yml", ".md", ".json", ".hcl", ".tfvars"]
TREE_EXTENSIONS = [".yaml", ".yml", ".tf", ".hcl", ".json"]
PRUNED = r"(^|/)(node_modules|\.git|__pycache__|vendor|\.terraform|\.pytest_cache|\.mypy_cache|\.venv|venv)/"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """All files under a folder: ``file`` (relative), class, size and modification time; contents are not read."""
    root = folder.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    # the reader gives URIs: the part after the folder's own path is the relative one
    return found.select(F.element_at(F.split("path", F.lit(root.split(":", 1)[-1].rstrip("/") + "/"), 2), 2).alias("file"), "length", "modificationTime").withColumn("class", file_class(F.col("file")))


def texts(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """Texts under a folder with lines and bytes: ``file, text, line_count, size_bytes``; pruned folders are left out."""
    root = folder.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = found.select(F.element_at(F.split("path", F.lit(root.split(":", 1)[-1].rstrip("/") + "/"), 2), 2).alias("file"), F.col("content").cast("string").alias("text"), F.col("length").alias("size_bytes"))
    kept = named.where(~F.col("file").rlike(PRUNED))
    if extensions:
        kept = kept.where(extension(F.col("file")).isin(extensions))
    return kept.withColumn("line_count", line_count(F.col("text")))


def for_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, CHUNK_EXTENSIONS)


def for_trees(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, TREE_EXTENSIONS).withColumn("tree_kind", tree_kind(F.col("file"), F.col("text")))


def chunk_store(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON files that hold lists, in one flat form; unreadable files are left out.

    Older stores name the metadata ``file`` and ``type``; both forms are understood.
    """
    meta = "struct<file_path:string,file:string,repo:string,branch:string,chunk_index:int,file_type:string,type:string,total_chunks:int,line_start:int>"
    rows = spark.read.schema(f"id string, text string, metadata {meta}").option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.select("id", "text", F.coalesce("metadata.file_path", "metadata.file").alias("file_path"), "metadata.repo", "metadata.branch", "metadata.chunk_index", F.coalesce("metadata.file_type", "metadata.type").alias("file_type"), "metadata.total_chunks", "metadata.line_start")


def investigation_store(spark: SparkSession, path: str) -> DataFrame:
    """Investigations, one JSON object a file; those without an id are left out."""
    schema = "id string, timestamp string, client string, service_name string, incident_type string, root_cause_summary string, resolution string, files_cited array<struct<file_path:string,repo:string,branch:string,relevance:string>>, tags array<string>"
    return spark.read.schema(schema).option("multiLine", True).json(path).where("id IS NOT NULL")


def client_config(spark: SparkSession, path: str) -> DataFrame:
    """One row for each repository and branch of a client's YAML or JSON configuration (a small file, read by the driver)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f) or {}
    fallback = config.get("default_branch")
    rows = [
        (config.get("client_name"), r.get("name"), r.get("path"), r.get("type"), r.get("platform"), b)
        for r in config.get("repos") or []
        for b in (r.get("branches") or [fallback])
    ]
    return spark.createDataFrame(rows, "client string, repo string, path string, type string, platform string, branch string")


def with_coverage(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files with what the store knows of them: number of chunks, coverage, and where the content is to be had."""
    from kelpie.functions.text import coverage

    known = chunks.groupBy("file").agg(F.count(F.lit(1)).alias("chunks"))
    both = files.join(known, "file", "full").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    on_disk = F.col("text").isNotNull()
    source = F.when(on_disk & (F.col("chunks") > 0), "both").when(on_disk, "disk").when(F.col("chunks") > 0, "kb").otherwise("none")
    return both.withColumns({"coverage": coverage(F.col("chunks")), "source": source})
