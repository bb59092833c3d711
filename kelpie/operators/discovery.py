"""What a set of repositories consists of: types, environments, layers, naming conventions, a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.names import NAME_PARTS, environment_tier
from kelpie.functions.text import extension, file_name, normal_path
from kelpie.operators.extraction import declared, every


def repo_types(files: DataFrame) -> DataFrame:
    """Type of each repository by additive hints in its file names; ties go to the first of the types listed.

    Below 0.2 the type is unknown, the confidence is at most 1. A null repository is left out.
    """
    name, path = F.lower(file_name(F.col("file"))), normal_path(F.col("file"))
    has = {
        "dot": path.rlike(r"(^|/)\.harness/"), "pipeline": name.isin("pipeline.yaml", "pipeline.yml"), "pipeline_dir": path.rlike(r"^(pipelines|ci|cd)/") & (extension(F.col("file")).isin(".yaml", ".yml")),
        "services": path.rlike("(^|/)services/"), "environments": path.rlike("(^|/)environments/"), "overrides": path.rlike("(^|/)overrides/"),
        "layer": path.rlike("(^|/)layer_"), "tfvars": name == "terraform.tfvars", "backend": name == "backend.tf", "providers": name == "providers.tf", "versions": name == "versions.tf",
        "chart": name.isin("chart.yaml", "chart.yml"), "chart_dir": path.rlike("^charts/"), "values": name.isin("values.yaml", "values.yml"), "templates": path.rlike(r"(^|/)templates/[^/]+\.ya?ml$"),
        "docker": name == "dockerfile", "node": name == "package.json", "python": name.isin("requirements.txt", "setup.py"), "java": name.isin("pom.xml", "build.gradle"), "make": name == "makefile", "go": name == "go.mod",
    }
    seen = files.where("repo IS NOT NULL").groupBy("repo").agg(
        *[F.max(c.cast("int")).alias(k) for k, c in has.items()], F.countDistinct(F.when(extension(F.col("file")) == ".tf", path)).alias("tf")
    )

    def weigh(*parts: tuple[str, float]) -> Column:
        return sum((F.coalesce(F.col(k), F.lit(0)) * w for k, w in parts), F.lit(0.0))

    scored = seen.select("repo", F.array(
        F.struct(F.round(weigh(("dot", 0.4), ("pipeline_dir", 0.3), ("pipeline", 0.2), ("services", 0.1), ("environments", 0.1), ("overrides", 0.1)), 4).alias("score"), F.lit(-1).alias("o"), F.lit("cicd").alias("type")),
        F.struct(F.round(F.least(F.lit(0.5), F.col("tf") * 0.05) + weigh(("layer", 0.3), ("tfvars", 0.1), ("backend", 0.1), ("providers", 0.1), ("versions", 0.1)), 4).alias("score"), F.lit(-2).alias("o"), F.lit("infrastructure").alias("type")),
        F.struct(F.round(weigh(("chart", 0.3), ("chart_dir", 0.5), ("templates", 0.1)) + F.col("chart") * F.col("values") * 0.1, 4).alias("score"), F.lit(-3).alias("o"), F.lit("helm").alias("type")),
        F.struct(F.round(weigh(("docker", 0.15), ("node", 0.15), ("python", 0.15), ("java", 0.15), ("make", 0.15), ("go", 0.15)), 4).alias("score"), F.lit(-4).alias("o"), F.lit("application").alias("type")),
    ).alias("scores"))
    best = scored.select("repo", F.array_max("scores").alias("b"))
    return best.select("repo", F.when(F.col("b.score") < 0.2, "unknown").otherwise(F.col("b.type")).alias("type"), F.least(F.lit(1.0), F.col("b.score")).alias("confidence"))


def environments(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct environments that pipelines refer to, in texts or in the graph, with tier and number of sources."""
    refs = files.select(F.explode(F.array_distinct(F.concat(every("text", r"environmentRef:\s*[\"']?([^\s\"']+)"), every("text", r"envRef:\s*[\"']?([^\s\"']+)")))).alias("name"), "file")
    targets = edges.where("edge_type = 'TARGETS_INFRA' AND target LIKE 'env:%'").select(F.substring("target", 5, 1000).alias("name"), "file")
    named = refs.unionByName(targets).where(~F.col("name").rlike(r"^[<$]") & (F.col("name") != "")).distinct()
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("sources")).withColumn("tier", environment_tier(F.col("name")))


def infra_layers(files: DataFrame) -> DataFrame:
    """Terraform layers by folder: number of files, resources, data sources, modules and outputs; ordered by the first number in the name."""
    layer = F.regexp_extract(normal_path(F.col("file")), r"(?:^|/)(layer_[^/]+)/", 1)
    own = files.where(extension(F.col("file")) == ".tf").withColumn("layer", layer).where("layer <> ''")
    counts = declared(own).join(own.select("file", "layer").distinct(), "file").groupBy("layer").agg(
        *[F.sum((F.col("kind") == k).cast("int")).alias(n) for k, n in (("resource", "resources"), ("data", "data_sources"), ("module", "modules"), ("output", "outputs"))]
    )
    sizes = own.groupBy("layer").agg(F.countDistinct("file").alias("tf_files"))
    number = F.coalesce(F.regexp_extract("layer", r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(999.0))
    return sizes.join(counts, "layer", "left").fillna(0).withColumn("position", number)


def naming(names: DataFrame) -> DataFrame:
    """Patterns of names (``type, name``): parts for region, environment and tier become placeholders.

    A pattern needs two parts and a replacement; its confidence grows by 0.15 with each. The
    separator is the one of ``-`` and ``_`` that occurs more often in the names of a type.
    """
    dashes, lines = F.length("name") - F.length(F.replace("name", F.lit("-"), F.lit(""))), F.length("name") - F.length(F.replace("name", F.lit("_"), F.lit("")))
    per = names.groupBy("type").agg(F.when(F.sum(lines) > F.sum(dashes), "_").otherwise("-").alias("separator"))
    lookup = F.create_map(*[x for c in reversed(NAME_PARTS) for v in NAME_PARTS[c] if not any(v in NAME_PARTS[e] for e in list(NAME_PARTS)[: list(NAME_PARTS).index(c)]) for x in (F.lit(v), F.lit("{" + c + "}"))])
    parts = F.filter(F.split("name", F.concat(F.lit("["), "separator", F.lit("]"))), lambda p: p != "")
    told = names.join(per, "type").withColumn("parts", F.transform(parts, lambda p: F.coalesce(lookup[F.lower(p)], F.lower(p))))
    told = told.withColumn("replaced", F.size(F.filter("parts", lambda p: F.startswith(p, F.lit("{"))))).where("replaced > 0 AND size(parts) > 1")
    return (
        told.groupBy("type", "separator", F.array_join("parts", "~").alias("p"))
        .agg(F.min("name").alias("example"), F.count(F.lit(1)).alias("names"), F.min(F.round(F.least(F.lit(1.0), F.col("replaced") * 0.15 + 0.5), 2)).alias("confidence"))
        .select("type", F.translate("p", "~", "").alias("_"), F.expr("replace(p, '~', separator)").alias("pattern"), "example", "names", "confidence").drop("_")
    )


def secrets(terraform: DataFrame, mounts: DataFrame) -> DataFrame:
    """Secrets by how they are met: ``kind`` (kv_secrets, k8s_secrets, mounts), ``name`` and the number of files."""
    made = F.when(F.col("edge_type") == "CREATES_KV_SECRET", "kv_secrets").when(F.col("edge_type") == "CREATES_K8S_SECRET", "k8s_secrets").when(F.col("edge_type") == "MOUNTS_SECRET", "mounts")
    named = terraform.unionByName(mounts).select(made.alias("kind"), F.regexp_replace("target", "^[a-z0-9_]+:", "").alias("name"), "file").where("kind IS NOT NULL")
    return named.groupBy("kind", "name").agg(F.count_distinct("file").alias("files"))


def profile(parts: dict[str, DataFrame]) -> DataFrame:
    """Number of rows of each part, as ``part, entries``."""
    counted = [df.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(name).alias("part"), "entries") for name, df in parts.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def ranked(df: DataFrame, by: Column, per: list[str], k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*per).orderBy(by))).where(F.col("_n") <= k).drop("_n")
