"""Edges and entities extracted from text by patterns; ``files`` has ``file, repo, branch, text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.names import CONFIG_KEYS, endpoint, settings_service
from kelpie.functions.text import parent_name, stem

EDGE = ["source", "target", "edge_type", "file", "repo", "branch"]


def every(text: str, pattern: str, group: int = 1) -> Column:
    """All matches of a group, an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def _edges(files: DataFrame, found: Column, kind: str, source: Column | None = None) -> DataFrame:
    """One edge for each target in an array, from the file itself unless a source is given."""
    targets = files.select("*", F.explode(found).alias("target"))
    return targets.select((F.col("file") if source is None else source).alias("source"), "target", F.lit(kind).alias("edge_type"), "file", "repo", "branch")


#: Words that refer to templates, services and infrastructure.
REFERENCES = {"templateRef": "CALLS_TEMPLATE", "serviceRef": "USES_SERVICE", "infraRef": "TARGETS_INFRA"}


def pipeline_edges(files: DataFrame, words: dict[str, str] = REFERENCES) -> DataFrame:
    """An edge for each value after one of the words, of the word's type; every occurrence counts."""

    def told(word: str, kind: str) -> Column:
        return F.transform(every("text", rf"\b{word}:\s*[\"']?(\S+)[\"']?"), lambda t: F.struct(t.alias("target"), F.lit(kind).alias("edge_type")))

    pairs = F.flatten(F.array(*[told(word, kind) for word, kind in words.items()]))
    return files.select("*", F.explode(pairs).alias("e")).select(F.col("file").alias("source"), "e.target", "e.edge_type", "file", "repo", "branch")


def terraform_edges(files: DataFrame, vault: str = "azurerm_key_vault_secret", cluster: str = "kubernetes_secret") -> DataFrame:
    """Secrets made and read by Terraform, and depends_on; a block ends at the first brace that begins a line."""

    def blocks(head: str, kind: str) -> DataFrame:
        pattern = rf'(?s){head}\s+"{kind}"\s+"([\w-]+)"\s*\{{(.*?)\n\}}'
        zipped = F.arrays_zip(every("text", pattern, 1).alias("name"), every("text", pattern, 2).alias("body"))
        return files.where(F.contains("text", F.lit(kind))).select("file", "repo", "branch", F.explode(zipped).alias("b")).select("file", "repo", "branch", F.col("b.name").alias("name"), F.col("b.body").alias("body"))

    def named(pattern: str) -> Column:
        found = F.regexp_extract("body", pattern, 1)
        return F.when(found == "", F.col("name")).otherwise(found)

    made, held, read = blocks("resource", vault), blocks("resource", cluster), blocks("data", vault)
    label = r'name\s*=\s*"([^"]+)"'
    creates = made.select(F.col("file").alias("source"), F.concat(F.lit("kv_secret:"), named(label)).alias("target"), F.lit("CREATES_KV_SECRET").alias("edge_type"), "file", "repo", "branch")
    secret = F.concat(F.lit("k8s_secret:"), named(r'(?s)metadata\s*\{[^}]*name\s*=\s*"([^"]+)"'))
    clusters = held.select(F.col("file").alias("source"), secret.alias("target"), F.lit("CREATES_K8S_SECRET").alias("edge_type"), "file", "repo", "branch")
    reads = held.select("*", secret.alias("secret"), F.explode(every("body", rf"data\.{vault}\.(\w+)\.value")).alias("ref")).select(
        F.col("secret").alias("source"), F.concat(F.lit("kv_data:"), "ref").alias("target"), F.lit("READS_KV_SECRET").alias("edge_type"), "file", "repo", "branch"
    )
    sources = read.select(F.concat(F.lit("kv_data:"), "name").alias("source"), F.concat(F.lit("kv_secret:"), named(label)).alias("target"), F.lit("READS_KV_SECRET").alias("edge_type"), "file", "repo", "branch")
    depends = F.flatten(F.transform(every("text", r"(?s)depends_on\s*=\s*\[(.*?)\]"), lambda d: F.regexp_extract_all(d, F.lit(r"(\w+\.\w+)"), F.lit(1))))
    needs = _edges(files, depends, "DEPENDS_ON")
    return creates.unionByName(clusters).unionByName(reads).unionByName(sources).unionByName(needs)


def mount_edges(files: DataFrame) -> DataFrame:
    """Cluster secrets mounted by templates, in block or flow form."""
    names = F.transform(every("text", r"secretKeyRef:\s*(?:\n\s+|\{\s*)name:\s*[\"']?([^\"'\n,}]+)[\"']?"), lambda n: F.concat(F.lit("k8s_secret:"), F.trim(n)))
    return _edges(files, names, "MOUNTS_SECRET")


def settings_edges(files: DataFrame) -> DataFrame:
    """Settings files: the service they define, the base they override, endpoints and configuration keys.

    Keys and values are ``key: value`` lines; a key is told by its own line, not its parents.
    An overlay has an edge only where its base file exists in the same repo, branch and folder.
    """
    known = files.withColumn("s", settings_service(F.col("file"))).where("s.service IS NOT NULL").withColumn("id", F.concat(F.lit("config:"), "file"))
    defines = known.where("s.service <> 'application'").select(F.col("id").alias("source"), F.col("s.service").alias("target"), F.lit("DEFINES_CONFIG").alias("edge_type"), "file", "repo", "branch")
    folder = F.regexp_replace("file", r"[^/]*$", "")
    based = known.select("repo", "branch", folder.alias("folder"), F.col("s.service").alias("service"), "s.profile", "id", "file")
    base = based.where("profile IS NULL").groupBy("repo", "branch", "folder", "service").agg(F.min("id").alias("target"))
    overlay = based.where("profile IS NOT NULL").join(base, ["repo", "branch", "folder", "service"])
    overrides = overlay.select(F.col("id").alias("source"), "target", F.lit("OVERRIDES_FOR_ENV").alias("edge_type"), "file", "repo", "branch")
    line = r"(?m)^[ \t]*(?:- )?([A-Za-z_][\w.\-]*):[ \t]+[\"']?([^\s\"'#][^\n\"'#]*)"
    pairs = known.select("id", "file", "repo", "branch", F.explode(F.arrays_zip(every("text", line, 1).alias("key"), every("text", line, 2).alias("value"))).alias("kv"))
    pairs = pairs.select("id", "file", "repo", "branch", F.col("kv.key").alias("key"), F.trim(F.col("kv.value")).alias("value"))
    connects = pairs.withColumn("e", endpoint(F.col("value"))).where("e IS NOT NULL").select(F.col("id").alias("source"), F.concat(F.lit("endpoint:"), "e.value").alias("target"), F.lit("CONNECTS_TO").alias("edge_type"), "file", "repo", "branch")
    keys = pairs.where(F.lower("key").rlike(CONFIG_KEYS)).select(F.col("id").alias("source"), F.concat(F.lit("config_prop:"), "key").alias("target"), F.lit("DEFINES_CONFIG").alias("edge_type"), "file", "repo", "branch")
    return defines.unionByName(overrides).unionByName(connects).unionByName(keys)


def pipelines(files: DataFrame) -> DataFrame:
    """One row for each text with a pipeline or stage: names and the distinct references in order of appearance.

    A line ends at a line feed; a carriage return before it belongs to no name.
    """

    def refs(word: str) -> Column:
        return F.filter(F.array_distinct(every("text", rf"{word}:\s*(\S+)")), lambda r: ~r.rlike(r"^[<$]"))

    def first(pattern: str) -> Column:
        return F.regexp_replace(F.regexp_extract("text", pattern, 1), r'^[\s"]+|[\s"]+$', "")

    stages = F.transform(every("text", r"-\s*stage:\s*\n((?:\s{2,}[^\n]+\n)*)"), lambda s: F.struct(
        F.regexp_replace(F.regexp_replace(F.regexp_extract(s, r"name:\s*([^\n]+)", 1), '"', ""), r"^\s+|\s+$", "").alias("name"), F.regexp_extract(s, r"type:\s*(\S+)", 1).alias("type")))
    variable = r"-\s*name:\s*(\S+)\s*\n\s*type:\s*(\S+)"
    return files.where(F.col("text").rlike("pipeline:|stage:")).select(
        "file", "repo", "branch", first(r"name:[ \t]*([^\n]+)").alias("name"), first(r"identifier:\s*(\S+)").alias("identifier"),
        stages.alias("stages"),
        F.transform(F.filter(stages, lambda s: F.lower(s["type"]).isin("approval", "harnessapproval", "jiraapproval")), lambda s: s["name"]).alias("approval_stages"),
        refs("templateRef").alias("templates_used"), refs("serviceRef").alias("services_referenced"), refs("environmentRef").alias("environments_referenced"),
        refs("infrastructureRef").alias("infrastructure_refs"), refs("connectorRef").alias("connectors"),
        F.arrays_zip(every("text", variable, 1).alias("name"), every("text", variable, 2).alias("type")).alias("variables"),
        F.regexp_extract("text", r"(?s)trigger:.*?type:\s*(\S+)", 1).alias("trigger"),
    )


def declared(files: DataFrame) -> DataFrame:
    """Terraform declarations: ``kind`` (resource, data, module, output), ``type`` and ``name`` of each."""
    pattern = r'(?m)^\s*(resource|data|module|output)\s+"([^"]+)"(?:\s+"([^"]+)")?'
    zipped = F.arrays_zip(*[every("text", pattern, i).alias(n) for i, n in ((1, "kind"), (2, "a"), (3, "b"))])
    one = files.select("file", "repo", "branch", F.explode(zipped).alias("d"))
    pair = F.col("d.kind").isin("resource", "data")
    return one.select("file", "repo", "branch", F.col("d.kind").alias("kind"), F.when(pair, F.col("d.a")).alias("type"), F.when(pair, F.col("d.b")).otherwise(F.col("d.a")).alias("name"))


def services(files: DataFrame, word: str = "serviceRef") -> DataFrame:
    """Distinct services: from service definitions, charts and references of pipelines, with the number of sources."""
    from kelpie.functions.names import file_class, service_name

    kind = files.withColumn("class", file_class(F.col("file")))
    identifier, label = F.regexp_extract("text", r"identifier:\s*[\"']?([^\s\"']+)", 1), F.regexp_extract("text", r"(?m)^name:\s*[\"']?([^\"'\n]+)", 1)
    own = kind.where("class = 'harness_svc'").select(F.when(identifier == "", stem(F.col("file"))).otherwise(identifier).alias("display"), F.lit("definition").alias("source"), "file", "repo")
    charts = kind.where("class = 'helm_chart'").select(F.when(label == "", parent_name(F.col("file"))).otherwise(label).alias("display"), F.lit("chart").alias("source"), "file", "repo")
    refs = files.select(F.explode(F.array_distinct(every("text", rf"\b{word}:\s*[\"']?([^\s\"']+)"))).alias("display"), F.lit("pipeline_ref").alias("source"), "file", "repo").where(~F.col("display").rlike(r"^[<$]"))
    found = own.unionByName(charts).unionByName(refs).distinct().withColumn("name", service_name(F.col("display")))
    return found.groupBy("name").agg(F.min("display").alias("display_name"), F.count(F.lit(1)).alias("sources"), F.countDistinct("repo").alias("repos"))
