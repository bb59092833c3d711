"""Queries of classification, extraction, discovery, chunking, branches, stores, scoring and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.functions import names as N
from kelpie.functions import text as T
from kelpie.operators import branches as B
from kelpie.operators import chunking as C
from kelpie.operators import discovery as D
from kelpie.operators import evaluation as V
from kelpie.operators import extraction as X
from kelpie.operators import stores as S
from kelpie.operators import trees as TR
from kelpie.plans import crawl
from kelpie.plans.registry import QuerySet
from kelpie.session import scratch, table
from kelpie.streaming import ingest as ST

CORPUS = QuerySet()


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Chunk rows as files to extract from."""
    return table(spark, d, "chunks").select("id", F.col("file_path").alias("file"), "repo", "branch", "text")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("file_path").alias("file"), "repo", "branch", "text")


_NAME, _EXT, _PARENT = "regexp_extract(file_path, '[^/]*$')", "lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1))", "regexp_extract(file_path, '([^/]+)/[^/]*$', 1)"
_STEM = "regexp_replace(regexp_extract(file_path, '[^/]*$'), '(.)\\.[^.]+$', '\\1')"
_SKIP = ", ".join(f"'{e}'" for e in N.SKIPPED_EXTENSIONS)
_YAML = f"{_EXT} IN ('.yaml', '.yml')"
_CLASS = f"""CASE WHEN {_EXT} IN ({_SKIP}) OR {_NAME} IN ('.DS_Store', 'Thumbs.db', '.gitkeep', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml') THEN 'skip'
 WHEN {_YAML} AND (({_PARENT} <> '' AND starts_with({_STEM}, {_PARENT})) OR starts_with({_STEM}, 'application')) THEN 'config'
 WHEN lower({_NAME}) IN ('pipeline.yaml', 'pipeline.yml') THEN 'pipeline' WHEN lower({_NAME}) IN ('chart.yaml', 'chart.yml') THEN 'helm_chart' WHEN lower({_NAME}) IN ('values.yaml', 'values.yml') THEN 'helm_values'
 WHEN {_EXT} IN ('.tf', '.tfvars') THEN 'terraform' WHEN {_YAML} AND list_contains(string_split(lower(file_path), '/'), 'services') THEN 'harness_svc'
 WHEN {_YAML} AND list_contains(string_split(lower(file_path), '/'), 'environments') THEN 'harness_env' WHEN {_YAML} AND list_contains(string_split(lower(file_path), '/'), 'overrides') THEN 'harness_override'
 WHEN {_YAML} AND list_contains(string_split(lower(file_path), '/'), 'templates') THEN 'template' WHEN {_YAML} THEN 'unknown' WHEN starts_with(lower({_NAME}), 'dockerfile') THEN 'dockerfile' WHEN starts_with(lower({_NAME}), 'readme') THEN 'readme' ELSE 'unknown' END"""


@CORPUS.add("file_classes", f"SELECT file_path AS file, {_CLASS} AS class FROM (SELECT DISTINCT file_path FROM chunks)")
def file_classes(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file").distinct().withColumn("class", N.file_class(F.col("file")))


@CORPUS.add(
    "tree_kinds",
    """SELECT id, CASE WHEN regexp_matches(lower(file_path), '\\.(tf|hcl)$') THEN 'terraform' WHEN regexp_matches(lower(file_path), 'pipeline|harness') THEN 'harness'
    WHEN starts_with(coalesce(text, ''), 'pipeline:') OR contains(coalesce(text, ''), chr(10) || 'pipeline:') OR regexp_matches(coalesce(text, ''), '^ *pipeline:') THEN 'harness'
    WHEN regexp_matches(lower(file_path), 'charts/|chart/|values|helm') THEN 'helm' WHEN contains(coalesce(text, ''), 'replicaCount:') OR contains(coalesce(text, ''), 'image:') THEN 'helm' ELSE 'generic' END AS kind FROM chunks""",
)
def tree_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("id", N.tree_kind(F.col("file"), F.col("text")).alias("kind"))


@CORPUS.add(
    "chunk_kinds",
    f"""SELECT id, CASE WHEN {_EXT} = '.tf' THEN 'terraform' WHEN {_YAML} THEN CASE WHEN contains(lower({_NAME}), 'pipeline') THEN 'pipeline' WHEN contains(lower({_NAME}), 'chart') THEN 'helm_chart'
    WHEN contains(lower({_NAME}), 'values') THEN 'helm_values' WHEN contains(file_path, 'templates') THEN 'template' ELSE 'yaml' END WHEN {_EXT} = '.md' THEN 'markdown' ELSE 'unknown' END AS kind FROM chunks""",
)
def chunk_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("id", N.chunk_kind(F.col("file")).alias("kind"))


@CORPUS.add(
    "branch_tiers",
    """SELECT branch, translate(lower(branch), '/-', '__') AS slug,
    CASE WHEN regexp_matches(lower(trim(branch)), '^(main|master)$') THEN 'production' WHEN regexp_matches(lower(trim(branch)), '^(develop|development)$') THEN 'integration' WHEN regexp_matches(lower(trim(branch)), '^release([_/]|$)') THEN 'release'
      WHEN regexp_matches(lower(trim(branch)), '^hotfix([_/]|$)') THEN 'hotfix' WHEN regexp_matches(lower(trim(branch)), '^feature([_/]|$)') THEN 'feature' WHEN regexp_matches(lower(trim(branch)), '^(bugfix|fix)[_/]') THEN 'bugfix' ELSE 'unknown' END AS tier,
    regexp_matches(branch, '(?i)^(main$|master$|release[_/]|hotfix[_/]|develop$|development$)') AS protected,
    CASE WHEN regexp_matches(branch, '(?i)^(main|master)$') THEN 'production' WHEN regexp_matches(branch, '(?i)^(develop|development)$') THEN 'integration' WHEN regexp_matches(branch, '(?i)^release[_/]') THEN 'release' WHEN regexp_matches(branch, '(?i)^hotfix[_/]') THEN 'hotfix'
      WHEN regexp_matches(branch, '(?i)^feat(ure)?[_/]') THEN 'feature' WHEN regexp_matches(branch, '(?i)^fix[_/]') THEN 'fix' WHEN regexp_matches(branch, '(?i)^chore[_/]') THEN 'chore' ELSE 'unknown' END AS protection,
    CASE WHEN regexp_matches(branch, '(?i)^release[_/]\\d+[_./]\\d+$') THEN regexp_extract(branch, '(\\d+)[_./](\\d+)$', 1)::DOUBLE + regexp_extract(branch, '(\\d+)[_./](\\d+)$', 2)::DOUBLE / 100 END AS version
    FROM (SELECT DISTINCT branch FROM chunks WHERE branch IS NOT NULL)""",
)
def branch_tiers(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("branch")
    return _files(spark, d).where("branch IS NOT NULL").select("branch").distinct().select(
        "branch", N.branch_slug(b).alias("slug"), N.branch_tier(b).alias("tier"), N.is_protected(b).alias("protected"), N.protection_tier(b).alias("protection"), N.release_version(b).alias("version")
    )


@CORPUS.add("working_branches", "SELECT DISTINCT branch, 'work/' || replace(branch, '/', '-') || '-fix-' || regexp_replace(lower(repo), '[^a-z0-9_-]+', '-', 'g') AS working FROM chunks WHERE branch IS NOT NULL AND repo IS NOT NULL")
def working_branches(spark: SparkSession, d: str) -> DataFrame:
    rows = _files(spark, d).where("branch IS NOT NULL AND repo IS NOT NULL").select("branch", "repo").distinct()
    return rows.select("branch", N.working_branch(F.col("branch"), F.concat(F.lit("fix "), "repo")).alias("working")).distinct()


#: Words of these tables that refer to something.
_WORDS = {"cluster": "TARGETS_INFRA", "queue": "CONNECTS_TO", "image": "REFERENCES"}


@CORPUS.add(
    "pipeline_edges",
    r"""WITH t AS (SELECT file_path AS file, repo, branch, unnest([struct_pack(k := 'TARGETS_INFRA', a := regexp_extract_all(text, '\bcluster:\s*["'']?(\S+)["'']?', 1)), struct_pack(k := 'CONNECTS_TO', a := regexp_extract_all(text, '\bqueue:\s*["'']?(\S+)["'']?', 1)),
      struct_pack(k := 'REFERENCES', a := regexp_extract_all(text, '\bimage:\s*["'']?(\S+)["'']?', 1))]) AS s FROM (SELECT file_path, repo, branch, text FROM chunks UNION ALL SELECT file_path, repo, branch, text FROM documents))
    SELECT file AS source, unnest(s.a) AS target, s.k AS edge_type, file, repo, branch FROM t""",
)
def pipeline_edges(spark: SparkSession, d: str) -> DataFrame:
    return X.pipeline_edges(_files(spark, d).drop("id").unionByName(_documents(spark, d).drop("id")), _WORDS)


@CORPUS.add(
    "mount_edges",
    r"""SELECT file_path AS source, 'k8s_secret:' || trim(unnest(regexp_extract_all(text, 'secretKeyRef:\s*(?:\n\s+|\{\s*)name:\s*["'']?([^"''\n,}]+)["'']?', 1))) AS target, 'MOUNTS_SECRET' AS edge_type, file_path AS file, repo, branch FROM chunks""",
)
def mount_edges(spark: SparkSession, d: str) -> DataFrame:
    return X.mount_edges(_files(spark, d))


@CORPUS.add(
    "terraform_edges",
    r"""WITH f AS (SELECT file_path AS file, repo, branch, text FROM chunks UNION ALL SELECT file_path, repo, branch, text FROM documents),
    v AS (SELECT file, repo, branch, unnest(list_zip(regexp_extract_all(text, '(?s)resource\s+"cloud_vault"\s+"([\w-]+)"\s*\{(.*?)\n\}', 1), regexp_extract_all(text, '(?s)resource\s+"cloud_vault"\s+"([\w-]+)"\s*\{(.*?)\n\}', 2))) AS z FROM f),
    k AS (SELECT file, repo, branch, unnest(list_zip(regexp_extract_all(text, '(?s)resource\s+"cloud_store"\s+"([\w-]+)"\s*\{(.*?)\n\}', 1), regexp_extract_all(text, '(?s)resource\s+"cloud_store"\s+"([\w-]+)"\s*\{(.*?)\n\}', 2))) AS z FROM f),
    d AS (SELECT file, repo, branch, unnest(list_zip(regexp_extract_all(text, '(?s)data\s+"cloud_vault"\s+"([\w-]+)"\s*\{(.*?)\n\}', 1), regexp_extract_all(text, '(?s)data\s+"cloud_vault"\s+"([\w-]+)"\s*\{(.*?)\n\}', 2))) AS z FROM f),
    ks AS (SELECT *, 'k8s_secret:' || coalesce(nullif(regexp_extract(z[2], '(?s)metadata\s*\{[^}]*name\s*=\s*"([^"]+)"', 1), ''), z[1]) AS s FROM k)
    SELECT file AS source, 'kv_secret:' || coalesce(nullif(regexp_extract(z[2], 'name\s*=\s*"([^"]+)"', 1), ''), z[1]) AS target, 'CREATES_KV_SECRET' AS edge_type, file, repo, branch FROM v UNION ALL
    SELECT file, s, 'CREATES_K8S_SECRET', file, repo, branch FROM ks UNION ALL
    SELECT s, 'kv_data:' || unnest(regexp_extract_all(z[2], 'data\.cloud_vault\.(\w+)\.value', 1)), 'READS_KV_SECRET', file, repo, branch FROM ks UNION ALL
    SELECT 'kv_data:' || z[1], 'kv_secret:' || coalesce(nullif(regexp_extract(z[2], 'name\s*=\s*"([^"]+)"', 1), ''), z[1]), 'READS_KV_SECRET', file, repo, branch FROM d UNION ALL
    SELECT file, unnest(flatten(list_transform(regexp_extract_all(text, '(?s)depends_on\s*=\s*\[(.*?)\]', 1), lambda x: regexp_extract_all(x, '(\w+\.\w+)', 1)))), 'DEPENDS_ON', file, repo, branch FROM f""",
)
def terraform_edges(spark: SparkSession, d: str) -> DataFrame:
    """Secrets made and read by Terraform, under the type names of these tables, and its dependencies."""
    return X.terraform_edges(_files(spark, d).drop("id").unionByName(_documents(spark, d).drop("id")), vault="cloud_vault", cluster="cloud_store")


_ENDPOINT = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN regexp_extract(v, '{p}', 0)" for p, _ in N.ENDPOINTS) + " END"


@CORPUS.add(
    "settings_edges",
    rf"""WITH f AS (SELECT file_path AS file, repo, branch, text, {_STEM} AS stem_, {_PARENT} AS above FROM chunks),
    t AS (SELECT *, CASE WHEN starts_with(stem_, 'application') THEN 'application' WHEN above <> '' AND starts_with(stem_, above) THEN above END AS service FROM f),
    k AS (SELECT *, 'config:' || file AS id, CASE WHEN substr(stem_, length(service) + 1, 1) = '-' AND substr(stem_, length(service) + 2) IN ({', '.join(f"'{x}'" for x in N.PROFILES)}) THEN substr(stem_, length(service) + 2) END AS profile,
      regexp_replace(file, '[^/]*$', '') AS folder FROM t WHERE service IS NOT NULL),
    base AS (SELECT repo, branch, folder, service, min(id) AS target FROM k WHERE profile IS NULL GROUP BY ALL),
    pairs AS (SELECT id, file, repo, branch, unnest(regexp_extract_all(text, '(?m)^[ \t]*(?:- )?([A-Za-z_][\w.\-]*):[ \t]+["'']?([^\s"''#][^\n"''#]*)', 1)) AS k, trim(unnest(regexp_extract_all(text, '(?m)^[ \t]*(?:- )?([A-Za-z_][\w.\-]*):[ \t]+["'']?([^\s"''#][^\n"''#]*)', 2)), ' ') AS v FROM k),
    ends AS (SELECT *, {_ENDPOINT} AS e FROM pairs)
    SELECT id AS source, service AS target, 'DEFINES_CONFIG' AS edge_type, file, repo, branch FROM k WHERE service <> 'application' UNION ALL
    SELECT k.id, b.target, 'OVERRIDES_FOR_ENV', file, k.repo, k.branch FROM k JOIN base b ON b.repo = k.repo AND b.branch = k.branch AND b.folder = k.folder AND b.service = k.service WHERE profile IS NOT NULL UNION ALL
    SELECT id, 'endpoint:' || e, 'CONNECTS_TO', file, repo, branch FROM ends WHERE e IS NOT NULL UNION ALL
    SELECT id, 'config_prop:' || k, 'DEFINES_CONFIG', file, repo, branch FROM pairs WHERE regexp_matches(lower(k), '{N.CONFIG_KEYS}')""",
)
def settings_edges(spark: SparkSession, d: str) -> DataFrame:
    return X.settings_edges(_files(spark, d))


_STAGES = r"regexp_extract_all(text, '-\s*stage:\s*\n((?:\s{2,}[^\n]+\n)*)', 1)"
_FIRST = r"""regexp_replace(regexp_extract(text, '{}', 1), '^[\s"]+|[\s"]+$', '', 'g')"""


def _refs_sql(word: str) -> str:
    """The distinct references of one kind in order of appearance, as text."""
    found = rf"regexp_extract_all(text, '{word}:\s*(\S+)', 1)"
    return f"array_to_string(list_filter(list_filter({found}, lambda r, i: list_position({found}, r) = i), lambda r: NOT regexp_matches(r, '^[<$]')), ',')"


@CORPUS.add(
    "pipeline_details",
    rf"""WITH s AS (SELECT *, list_transform({_STAGES}, lambda x: struct_pack(name := regexp_replace(replace(regexp_extract(x, 'name:\s*([^\n]+)', 1), '"', ''), '^\s+|\s+$', '', 'g'), type := regexp_extract(x, 'type:\s*(\S+)', 1))) AS st FROM chunks WHERE regexp_matches(text, 'pipeline:|stage:'))
    SELECT file_path AS file, repo, branch, {_FIRST.format('name:[ \\t]*([^\\n]+)')} AS name, {_FIRST.format('identifier:\\s*(\\S+)')} AS identifier, len(st)::INT AS stages,
    array_to_string(list_transform(list_filter(st, lambda x: lower(x.type) IN ('approval', 'harnessapproval', 'jiraapproval')), lambda x: x.name), ',') AS approvals, {_refs_sql('templateRef')} AS templates, {_refs_sql('serviceRef')} AS services,
    {_refs_sql('environmentRef')} AS environments, {_refs_sql('connectorRef')} AS connectors, len(regexp_extract_all(text, '-\s*name:\s*(\S+)\s*\n\s*type:\s*(\S+)', 1))::INT AS variables, regexp_extract(text, '(?s)trigger:.*?type:\s*(\S+)', 1) AS trigger FROM s""",
)
def pipeline_details(spark: SparkSession, d: str) -> DataFrame:
    return X.pipelines(_files(spark, d)).select(
        "file", "repo", "branch", "name", "identifier", F.size("stages").alias("stages"), F.array_join("approval_stages", ",").alias("approvals"), F.array_join("templates_used", ",").alias("templates"),
        F.array_join("services_referenced", ",").alias("services"), F.array_join("environments_referenced", ",").alias("environments"), F.array_join("connectors", ",").alias("connectors"), F.size("variables").alias("variables"), "trigger",
    )


@CORPUS.add(
    "terraform_declarations",
    r"""WITH t AS (SELECT text, regexp_extract_all(text, '(?m)^\s*(resource|data|module|output)\s+"([^"]+)"(?:\s+"([^"]+)")?', 1) AS k FROM chunks)
    SELECT k AS kind, count(*) AS declarations FROM (SELECT unnest(k) AS k FROM t) GROUP BY 1""",
)
def terraform_declarations(spark: SparkSession, d: str) -> DataFrame:
    return X.declared(_files(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("declarations"))


@CORPUS.add(
    "services",
    r"""WITH f AS (SELECT file_path AS file, repo, text FROM chunks UNION ALL SELECT file_path, repo, text FROM documents),
    found AS (SELECT DISTINCT unnest(list_distinct(regexp_extract_all(text, '\btarget:\s*["'']?([^\s"'']+)', 1))) AS display, file, repo FROM f)
    SELECT regexp_replace(regexp_replace(lower(display), '[_\s]+', '-', 'g'), '-v\d+$', '') AS name, min(display) AS display_name, count(*) AS sources, count(DISTINCT repo) AS repos FROM found WHERE NOT regexp_matches(display, '^[<$]') GROUP BY 1""",
)
def services(spark: SparkSession, d: str) -> DataFrame:
    """Services that texts of these tables call targets."""
    return X.services(_files(spark, d).drop("id").unionByName(_documents(spark, d).drop("id")), "target")


@CORPUS.add(
    "environments",
    r"""WITH f AS (SELECT file_path AS file, text FROM chunks),
    named AS (SELECT unnest(list_concat(regexp_extract_all(text, 'environmentRef:\s*["'']?([^\s"'']+)', 1), regexp_extract_all(text, 'envRef:\s*["'']?([^\s"'']+)', 1))) AS name, file FROM f
      UNION SELECT target[5:], file FROM edges WHERE edge_type = 'TARGETS_INFRA' AND starts_with(target, 'env:'))
    SELECT name, count(*) AS sources, CASE WHEN regexp_matches(name, '(?i)\b(prod|prd|production)\b') THEN 'production' WHEN regexp_matches(name, '(?i)\b(staging|stg|uat|pre-?prod)\b') THEN 'staging'
      WHEN regexp_matches(name, '(?i)\b(dev|develop|int|integration)\b') THEN 'integration' WHEN regexp_matches(name, '(?i)\b(sandbox|sbx|lab|test)\b') THEN 'sandbox' ELSE 'unknown' END AS tier
    FROM (SELECT DISTINCT * FROM named) WHERE name <> '' AND NOT regexp_matches(name, '^[<$]') GROUP BY name""",
)
def environments(spark: SparkSession, d: str) -> DataFrame:
    return D.environments(_files(spark, d), table(spark, d, "edges"))


def _any(condition: str, weight: float) -> str:
    return f"max(({condition})::INT) * {weight}"


_CP = "replace(file_path, chr(92), '/')"
_CI = [("regexp_matches(p, '(^|/)\\.harness/')", 0.4), (f"regexp_matches(p, '^(pipelines|ci|cd)/') AND {_YAML}", 0.3), ("n IN ('pipeline.yaml', 'pipeline.yml')", 0.2), ("regexp_matches(p, '(^|/)services/')", 0.1), ("regexp_matches(p, '(^|/)environments/')", 0.1), ("regexp_matches(p, '(^|/)overrides/')", 0.1)]
_INFRA = [("regexp_matches(p, '(^|/)layer_')", 0.3), ("n = 'terraform.tfvars'", 0.1), ("n = 'backend.tf'", 0.1), ("n = 'providers.tf'", 0.1), ("n = 'versions.tf'", 0.1)]
_HELM = [("n IN ('chart.yaml', 'chart.yml')", 0.3), ("regexp_matches(p, '^charts/')", 0.5), ("regexp_matches(p, '(^|/)templates/[^/]+\\.ya?ml$')", 0.1)]
_APPS = [("n = 'dockerfile'", 0.15), ("n = 'package.json'", 0.15), ("n IN ('requirements.txt', 'setup.py')", 0.15), ("n IN ('pom.xml', 'build.gradle')", 0.15), ("n = 'makefile'", 0.15), ("n = 'go.mod'", 0.15)]


@CORPUS.add(
    "repo_types",
    f"""WITH f AS (SELECT DISTINCT repo, file_path, {_CP} AS p, lower({_NAME}) AS n FROM chunks WHERE repo IS NOT NULL AND file_path IS NOT NULL),
    s AS (SELECT repo, round({' + '.join(_any(*x) for x in _CI)}, 4) AS ci, round(least(0.5, count(DISTINCT CASE WHEN {_EXT} = '.tf' THEN p END) * 0.05) + {' + '.join(_any(*x) for x in _INFRA)}, 4) AS infra,
      round({' + '.join(_any(*x) for x in _HELM)} + max((n IN ('chart.yaml', 'chart.yml'))::INT) * max((n IN ('values.yaml', 'values.yml'))::INT) * 0.1, 4) AS helm, round({' + '.join(_any(*x) for x in _APPS)}, 4) AS app FROM f GROUP BY repo)
    SELECT repo, CASE WHEN greatest(ci, infra, helm, app) < 0.2 THEN 'unknown' WHEN ci = greatest(ci, infra, helm, app) THEN 'cicd' WHEN infra = greatest(ci, infra, helm, app) THEN 'infrastructure' WHEN helm = greatest(ci, infra, helm, app) THEN 'helm' ELSE 'application' END AS type,
    least(1.0, greatest(ci, infra, helm, app))::DOUBLE AS confidence FROM s""",
)
def repo_types(spark: SparkSession, d: str) -> DataFrame:
    return D.repo_types(_files(spark, d).select("file", "repo").distinct())


@CORPUS.add(
    "infra_layers",
    r"""WITH own AS (SELECT file_path AS file, regexp_extract(file_path, '(?:^|/)(layer_[^/]+)/', 1) AS layer FROM edges_files WHERE lower(file_path) LIKE '%.tf')
    SELECT layer, count(DISTINCT file) AS tf_files, coalesce(TRY_CAST(regexp_extract(layer, '(\d+(?:\.\d+)?)', 1) AS DOUBLE), 999.0) AS position FROM own WHERE layer <> '' GROUP BY layer""".replace("FROM edges_files", "FROM (SELECT file AS file_path FROM nodes)"),
)
def infra_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers among the files of the graph's nodes."""
    files = table(spark, d, "nodes").select("file", "repo", "branch", F.lit(None).cast("string").alias("text")).distinct()
    return D.infra_layers(files).select("layer", "tf_files", "position")


_PART = "CASE " + " ".join(f"WHEN lower(x) IN ({', '.join(repr(v) for v in vs)}) THEN '{{{k}}}'" for k, vs in N.NAME_PARTS.items()) + " ELSE lower(x) END"


@CORPUS.add(
    "naming_conventions",
    f"""WITH n AS (SELECT DISTINCT regexp_extract(id, '^([a-z0-9_]+):', 1) AS type, regexp_extract(id, '^[a-z0-9_]+:(.+)$', 1) AS name FROM nodes),
    named AS (SELECT * FROM n WHERE type <> '' AND name <> ''),
    per AS (SELECT type, CASE WHEN sum(length(name) - length(replace(name, '_', ''))) > sum(length(name) - length(replace(name, '-', ''))) THEN '_' ELSE '-' END AS separator FROM named GROUP BY type),
    told AS (SELECT type, separator, name, list_transform(list_filter(string_split(name, separator), lambda x: x <> ''), lambda x: {_PART}) AS parts FROM named JOIN per USING (type)),
    counted AS (SELECT *, len(list_filter(parts, lambda x: starts_with(x, '{{'))) AS replaced FROM told)
    SELECT type, list_reduce(parts, lambda a, b: a || separator || b) AS pattern, min(name) AS example, count(*) AS names, min(round(least(1.0, replaced * 0.15 + 0.5), 2))::DOUBLE AS confidence FROM counted WHERE replaced > 0 AND len(parts) > 1 GROUP BY ALL""",
)
def naming_conventions(spark: SparkSession, d: str) -> DataFrame:
    """Patterns in the names of secrets and environments of the graph."""
    named = table(spark, d, "nodes").select(F.regexp_extract("id", "^([a-z0-9_]+):", 1).alias("type"), F.regexp_extract("id", "^[a-z0-9_]+:(.+)$", 1).alias("name")).where("type <> '' AND name <> ''").distinct()
    return D.naming(named)


@CORPUS.add(
    "corpus_profile",
    """SELECT 'branches' AS part, count(*) AS entries FROM (SELECT DISTINCT repo, branch FROM chunks WHERE repo IS NOT NULL AND branch IS NOT NULL) UNION ALL
    SELECT 'repos', count(DISTINCT repo) FROM chunks UNION ALL SELECT 'files', count(DISTINCT file_path) FROM chunks UNION ALL
    SELECT 'pipelines', count(*) FROM chunks WHERE regexp_matches(text, 'pipeline:|stage:') UNION ALL SELECT 'services', count(*) FROM ("""
    + CORPUS.sql["services"]
    + """) UNION ALL SELECT 'layers', count(*) FROM ("""
    + CORPUS.sql["infra_layers"]
    + """) UNION ALL SELECT 'secrets', count(DISTINCT id) FROM nodes WHERE starts_with(id, 'kv_secret:') OR starts_with(id, 'k8s_secret:') UNION ALL SELECT 'environments', count(DISTINCT id) FROM nodes WHERE starts_with(id, 'env:')""",
)
def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    files, nodes = table(spark, d, "chunks"), table(spark, d, "nodes")
    return D.profile({
        "branches": files.where("repo IS NOT NULL AND branch IS NOT NULL").select("repo", "branch").distinct(), "repos": files.where("repo IS NOT NULL").select("repo").distinct(), "files": files.where("file_path IS NOT NULL").select("file_path").distinct(),
        "pipelines": X.pipelines(_files(spark, d)), "services": services(spark, d), "layers": infra_layers(spark, d),
        "secrets": nodes.where("id LIKE 'kv\\_secret:%' OR id LIKE 'k8s\\_secret:%'").select("id").distinct(), "environments": nodes.where("id LIKE 'env:%'").select("id").distinct(),
    })


@CORPUS.add(
    "discovered_secrets",
    "WITH e AS ((" + CORPUS.sql["terraform_edges"] + ") UNION ALL (" + CORPUS.sql["mount_edges"] + """))
    SELECT CASE edge_type WHEN 'CREATES_KV_SECRET' THEN 'kv_secrets' WHEN 'CREATES_K8S_SECRET' THEN 'k8s_secrets' ELSE 'mounts' END AS kind, regexp_replace(target, '^[a-z0-9_]+:', '') AS name, count(DISTINCT file) AS files
    FROM e WHERE edge_type IN ('CREATES_KV_SECRET', 'CREATES_K8S_SECRET', 'MOUNTS_SECRET') GROUP BY ALL""",
)
def discovered_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Secrets that Terraform makes and templates mount, under the type names of these tables."""
    return D.secrets(terraform_edges(spark, d), mount_edges(spark, d))


@CORPUS.add(
    "chunkers",
    f"""SELECT chunker, count(*) AS files FROM (SELECT CASE WHEN {_EXT} IN ('.tf', '.tfvars') THEN 'terraform' WHEN {_YAML} AND trim(text) <> '' AND contains(text, 'pipeline:') AND contains(text, 'stages:') AND contains(text, 'stage:') THEN 'pipeline'
    WHEN {_YAML} AND trim(text) <> '' AND (lower({_NAME}) = 'values.yaml' OR starts_with(lower({_NAME}), 'values-') OR (contains(text, 'image:') AND contains(text, 'replicaCount:'))) THEN 'values' WHEN {_YAML} AND trim(text) <> '' THEN 'yaml' ELSE 'fixed' END AS chunker FROM chunks WHERE text IS NOT NULL) GROUP BY 1""",
)
def chunkers(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where("text IS NOT NULL").groupBy(C.chunker(F.col("file"), F.col("text")).alias("chunker")).agg(F.count(F.lit(1)).alias("files"))


@CORPUS.add("structural_chunks")
def structural_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.structural(_documents(spark, d))


def _cut(at: str) -> str:
    """Where a piece that begins at an offset ends: after the last line end or blank of its second half."""
    half = f"substr(text, {at} + 251, 250)"
    return rf"""CASE WHEN {at} + 500 >= length(text) THEN length(text) WHEN contains({half}, chr(10)) THEN {at} + 500 - length(regexp_extract({half}, '[^\n]*$')) WHEN contains({half}, ' ') THEN {at} + 500 - length(regexp_extract({half}, '[^ ]*$')) ELSE {at} + 500 END"""


_BLANK = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@CORPUS.add(
    "fixed_chunks",
    f"""WITH RECURSIVE d AS (SELECT doc_id AS id, file_path AS file, text FROM documents WHERE text <> ''),
    cuts AS (SELECT id, 0 AS start, {_cut('0')} AS stop FROM d UNION ALL SELECT c.id, c.stop - 50, {_cut('(c.stop - 50)')} FROM cuts c JOIN d ON d.id = c.id WHERE c.stop < length(text)),
    pieces AS (SELECT d.id, file, start, regexp_replace(regexp_replace(substr(text, start + 1, stop - start), '^{_BLANK}', ''), '{_BLANK}$', '') AS text FROM cuts c JOIN d ON d.id = c.id)
    SELECT id, file, (row_number() OVER (PARTITION BY id ORDER BY start) - 1)::INT AS chunk_index, text FROM pieces WHERE text <> ''""",
)
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.fixed(_documents(spark, d))


_SNAP = """snap AS (SELECT repo, branch, file_path AS file, md5(array_to_string(list_sort(coalesce(list(DISTINCT md5(text)) FILTER (WHERE text IS NOT NULL), [])), ',')) AS hash FROM chunks
  WHERE repo IS NOT NULL AND branch IS NOT NULL AND file_path IS NOT NULL GROUP BY ALL),
changes AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.file, b.file) AS file, coalesce(a.file, b.file) AS file_path, CASE WHEN a.hash IS NULL THEN 'A' WHEN b.hash IS NULL THEN 'D' WHEN a.hash <> b.hash THEN 'M' END AS status
  FROM (SELECT * FROM snap WHERE branch = 'main') a FULL JOIN (SELECT * FROM snap WHERE branch = 'develop') b ON a.repo = b.repo AND a.file = b.file)"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return B.diff(B.snapshots(_files(spark, d)), "main", "develop")


@CORPUS.add("branch_diff", f"WITH {_SNAP} SELECT repo, file, status, {_CLASS} AS class FROM changes WHERE status IS NOT NULL")
def branch_diff(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d)


@CORPUS.add(
    "branch_diff_summary",
    f"WITH {_SNAP} SELECT repo, class, count_if(status = 'A')::BIGINT AS added, count_if(status = 'M')::BIGINT AS modified, count_if(status = 'D')::BIGINT AS deleted, count(*) AS total FROM (SELECT *, {_CLASS} AS class FROM changes WHERE status IS NOT NULL) GROUP BY ALL",
)
def branch_diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.diff_summary(_changes(spark, d))


@CORPUS.add(
    "branch_diff_order",
    "WITH s AS (" + CORPUS.sql["branch_diff_summary"] + ") SELECT repo, class, total, row_number() OVER (PARTITION BY repo ORDER BY total DESC, class) AS position FROM s",
)
def branch_diff_order(spark: SparkSession, d: str) -> DataFrame:
    """Classes of changed files of each repository, those with most changes first."""
    order = Window.partitionBy("repo").orderBy(F.desc("total"), "class")
    return B.diff_summary(_changes(spark, d)).select("repo", "class", "total", F.row_number().over(order).alias("position"))


@CORPUS.add(
    "branch_status",
    """WITH c AS (SELECT DISTINCT repo, branch FROM edges WHERE repo IS NOT NULL AND branch IS NOT NULL),
    k AS (SELECT repo, branch, embedded_at, md5(id) AS h, row_number() OVER (PARTITION BY repo, branch ORDER BY embedded_at DESC, md5(id) DESC) AS rn FROM chunks WHERE embedded_at IS NOT NULL)
    SELECT c.repo, c.branch, coalesce(left(h, 8), 'n/a') AS commit, coalesce(strftime(embedded_at, '%Y-%m-%d %H:%M:%S'), 'never') AS synced_at FROM c LEFT JOIN k ON k.repo = c.repo AND k.branch = c.branch AND rn = 1""",
)
def branch_status(spark: SparkSession, d: str) -> DataFrame:
    """Branches that edges name, with the hash of the chunk stored last as their commit."""
    state = table(spark, d, "chunks").where("embedded_at IS NOT NULL").select("repo", "branch", F.md5("id").alias("commit"), F.col("embedded_at").alias("synced_at"))
    return B.status_list(table(spark, d, "edges").dropna(subset=["repo", "branch"]), state)


@CORPUS.add(
    "sync_delays",
    """WITH t AS (SELECT id, date_diff('microsecond', file_mtime, embedded_at) // 1000000 AS s FROM chunks WHERE embedded_at >= file_mtime)
    SELECT DISTINCT id, s AS seconds, CASE WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS delay FROM t""",
)
def sync_delays(spark: SparkSession, d: str) -> DataFrame:
    """How long after its change each chunk was stored."""
    rows = table(spark, d, "chunks").where("embedded_at >= file_mtime")
    seconds = F.floor(F.timestamp_diff("MICROSECOND", F.col("file_mtime"), F.col("embedded_at")) / 1_000_000)
    return rows.select("id", seconds.alias("seconds")).distinct().select("id", "seconds", T.duration(F.col("seconds")).alias("delay"))


_SAID = "string_split_regex(lower(q), '\\s+')"
_STRIP = "[.,?!:;()\\[\\]{}\"''/]+"
_LISTED = lambda words: ", ".join(f"'{w}'" for w in words)


@CORPUS.add(
    "proposed_branches",
    f"""WITH p AS (SELECT doc_id AS id, branch, regexp_extract(text, '^[^\\n]*', 0) AS q FROM documents WHERE text <> '' AND branch IS NOT NULL),
    w AS (SELECT *, regexp_extract_all(lower(q), '[a-z]+') AS said, list_filter(list_transform(list_filter({_SAID}, lambda x: x <> ''), lambda x: regexp_replace(x, '^{_STRIP}|{_STRIP}$', '', 'g')),
      lambda x: x NOT IN ({_LISTED(N.STOP_WORDS)}) AND length(x) > 2 AND regexp_matches(x, '^[a-z0-9_]+$')) AS telling FROM p),
    s AS (SELECT *, CASE WHEN len(telling) = 0 THEN translate(branch, '/_', '--') ELSE array_to_string(telling[:4], '-') END AS slug FROM w)
    SELECT id, CASE WHEN list_has_any(said, [{_LISTED(N.FIX_WORDS)}]) THEN 'fix' WHEN list_has_any(said, [{_LISTED(N.UPDATE_WORDS)}]) THEN 'chore' ELSE 'feat' END || '/' || CASE WHEN length(slug) > 50 THEN regexp_replace(left(slug, 50), '-+$', '') ELSE slug END AS proposed FROM s""",
)
def proposed_branches(spark: SparkSession, d: str) -> DataFrame:
    """A branch name for every document, as if its first line were a prompt."""
    rows = table(spark, d, "documents").where("text <> '' AND branch IS NOT NULL")
    return rows.select(F.col("doc_id").alias("id"), N.new_branch(F.regexp_extract("text", r"^[^\n]*", 0), F.col("branch")).alias("proposed"))


def _hint(names: list[str], inside: list[str], ends: list[str], held: list[str]) -> str:
    clues = [f"contains(p, '{w}')" for w in inside] + [f"ends_with(p, '{w}')" for w in ends] + [f"contains(t, '{w}')" for w in held]
    return f"CASE WHEN {' OR '.join(clues)} THEN [{_LISTED(names)}] ELSE [] END"


@CORPUS.add(
    "repo_hints",
    f"""WITH c AS (SELECT DISTINCT id, file_path, lower(coalesce(file_path, '')) AS p, lower(coalesce(text, '')) AS t FROM chunks)
    SELECT id, file_path AS file, array_to_string(list_sort(list_distinct(flatten([{', '.join(_hint(*h) for h in N.HINTS)}]))), ',') AS hints FROM c""",
)
def repo_hints(spark: SparkSession, d: str) -> DataFrame:
    """What each chunk tells about the type of its repository."""
    return _files(spark, d).select("id", "file", "text").distinct().select("id", "file", F.array_join(N.repo_hints(F.col("file"), F.col("text")), ",").alias("hints"))


@CORPUS.add("branch_line_changes")
def branch_line_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("repo", F.col("file_path").alias("file"), "branch", "chunk_index", "text")
    return B.line_changes(rows, "main", "develop")


@CORPUS.add(
    "branch_list",
    """WITH b AS (SELECT DISTINCT repo, branch, lower(trim(branch)) AS l FROM chunks WHERE repo IS NOT NULL AND branch IS NOT NULL),
    t AS (SELECT repo, branch, CASE WHEN regexp_matches(l, '^(main|master)$') THEN 'production' WHEN regexp_matches(l, '^(develop|development)$') THEN 'integration' WHEN regexp_matches(l, '^release([_/]|$)') THEN 'release'
      WHEN regexp_matches(l, '^hotfix([_/]|$)') THEN 'hotfix' WHEN regexp_matches(l, '^feature([_/]|$)') THEN 'feature' WHEN regexp_matches(l, '^(bugfix|fix)[_/]') THEN 'bugfix' ELSE 'unknown' END AS tier FROM b)
    SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE tier WHEN 'production' THEN 0 WHEN 'integration' THEN 1 WHEN 'feature' THEN 4 ELSE 5 END, branch) AS position FROM t""",
)
def branch_list(spark: SparkSession, d: str) -> DataFrame:
    return B.listed(_files(spark, d))


@CORPUS.add("closest_branches")
def closest_branches(spark: SparkSession, d: str) -> DataFrame:
    """For every branch that an edge names, the closest one that the repository has chunks of."""
    return B.closest(table(spark, d, "edges").select("repo", "branch"), _files(spark, d))


_FRESH = """states AS (SELECT repo, branch, max(file_mtime) AS head, max(embedded_at) FILTER (WHERE embedded_at < TIMESTAMP '2025-06-01') AS at_ FROM chunks WHERE repo IS NOT NULL AND branch IS NOT NULL GROUP BY ALL),
judged AS (SELECT repo, branch, CASE WHEN at_ IS NULL THEN 'unknown' WHEN at_ >= head THEN 'fresh' ELSE 'stale' END AS status FROM states WHERE head IS NOT NULL)"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("repo IS NOT NULL AND branch IS NOT NULL")
    heads = rows.groupBy("repo", "branch").agg(F.max("file_mtime").alias("head")).where("head IS NOT NULL")
    return B.freshness(heads, rows.where("embedded_at < TIMESTAMP_NTZ '2025-06-01 00:00:00'").groupBy("repo", "branch").agg(F.max("embedded_at").alias("at")))


@CORPUS.add("branch_freshness", f"WITH {_FRESH} SELECT repo, branch, status FROM judged")
def branch_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Branches against an index of the middle of 2025."""
    return _states(spark, d).select("repo", "branch", "status")


@CORPUS.add(
    "freshness_summary",
    f"""WITH {_FRESH}, c AS (SELECT count(*) AS checked, count_if(status = 'stale')::BIGINT AS stale, bool_and(status = 'fresh') AS all_fresh FROM judged)
    SELECT *, CASE WHEN all_fresh THEN 'All branches fresh' WHEN stale > 0 THEN stale || ' branch(es) stale' ELSE 'Checked ' || checked || ' branch(es)' END AS message FROM c""",
)
def freshness_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.freshness_summary(_states(spark, d))


@CORPUS.add("latest_edges", "SELECT id, max(loaded_at) AS loaded_at, count(*) AS deliveries FROM edges GROUP BY id")
def latest_edges(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each edge."""
    edges = table(spark, d, "edges")
    return S.latest(edges, ["id"], [F.col("loaded_at")]).select("id", "loaded_at").join(edges.groupBy("id").agg(F.count(F.lit(1)).alias("deliveries")), "id")


@CORPUS.add(
    "upsert_chunks",
    """WITH fresh AS (SELECT * FROM chunks WHERE embedded_at >= TIMESTAMP '2025-01-01'), old AS (SELECT * FROM chunks WHERE embedded_at < TIMESTAMP '2025-01-01' OR embedded_at IS NULL),
    merged AS (SELECT * FROM old WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT * FROM fresh) SELECT repo, branch, count(*) AS chunks, max(embedded_at) AS newest FROM merged GROUP BY ALL""",
)
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks")
    cut = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    merged = S.upsert(rows.where((F.col("embedded_at") < cut) | F.col("embedded_at").isNull()), rows.where(F.col("embedded_at") >= cut), ["id"])
    return merged.groupBy("repo", "branch").agg(F.count(F.lit(1)).alias("chunks"), F.max("embedded_at").alias("newest"))


@CORPUS.add(
    "verify_collections",
    """SELECT repo, branch, count(*) AS expected, count_if(line_start IS NOT NULL)::BIGINT AS stored,
    CASE WHEN count_if(line_start IS NOT NULL) = 0 THEN 'MISSING' WHEN count_if(line_start IS NOT NULL) < count(*) THEN 'INCOMPLETE' ELSE 'OK' END AS status FROM chunks GROUP BY ALL""",
)
def verify_collections(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each collection against those whose place in the file is known."""
    rows = table(spark, d, "chunks")
    return S.verify(rows, rows.where("line_start IS NOT NULL"), ["repo", "branch"])


_CHECKS = """q AS (SELECT doc_id AS id, coalesce(source, 'none') AS category, lower(coalesce(text, '')) AS t, n_chars FROM documents),
scored AS (SELECT id, category, (t <> '')::INT + (contains(t, 'deploy') OR contains(t, 'replica'))::INT + (contains(t, 'name') AND contains(t, ':'))::INT + coalesce((n_chars >= 400)::INT, 0) AS passed, 4 AS total FROM q),
graded AS (SELECT *, CASE WHEN passed = 4 THEN 3 WHEN passed >= 3 THEN 2 WHEN passed >= 2 THEN 1 ELSE 0 END AS score FROM scored)"""


def _graded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("none")).alias("category"), F.coalesce("text", F.lit("")).alias("t"), "n_chars")
    t = F.col("t")
    checks = rows.select("id", F.explode(F.array(t != "", T.any_within(t, ["deploy", "replica"]), T.all_within(t, ["name", ":"]), F.coalesce(F.col("n_chars") >= 400, F.lit(False)))).alias("ok"))
    return V.outcomes(rows.select("id", "category"), checks)


@CORPUS.add("validator_scores", f"WITH {_CHECKS} SELECT id, category, passed, total, score FROM graded")
def validator_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document held against four validators."""
    return _graded(spark, d)


@CORPUS.add(
    "score_report",
    f"WITH {_CHECKS} SELECT CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE category END AS category, count(*) AS questions, sum(score)::BIGINT AS points, round(sum(score) / (count(*) * 3) * 100, 1) AS accuracy FROM graded GROUP BY ROLLUP (category)",
)
def score_report(spark: SparkSession, d: str) -> DataFrame:
    return V.report(_graded(spark, d))


@CORPUS.add("yaml_leaves")
def yaml_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Scalars of the YAML documents by path."""
    rows = _documents(spark, d).where(T.extension(F.col("file")).isin(".yaml", ".yml") & F.col("text").isNotNull()).select("id", "text")
    return TR.flatten(rows, "id", "text", yaml=True).where("preview IS NOT NULL").select("id", "document", "node_path", "depth", "kind", "preview")


@CORPUS.add(
    "event_properties",
    "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@CORPUS.add(
    "stream_windows",
    """WITH e AS (SELECT date_trunc('day', ts) AS start, event_type FROM events WHERE ts IS NOT NULL), m AS (SELECT max(ts) - INTERVAL 1 DAY AS closed FROM events)
    SELECT start, event_type, count(*) AS rows FROM e, m WHERE start + INTERVAL 1 DAY <= closed GROUP BY ALL""",
)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per closed day and type, by a stream that then gets all events of the past a second time: too late to count."""
    rows = table(spark, d, "events")
    folder = scratch(spark, "windows")
    rows.coalesce(1).write.parquet(f"{folder}/in")
    closed = rows.agg(F.max("ts").alias("last"))
    both = rows.join(F.broadcast(closed), F.col("ts") <= F.col("last"))  # a batch of the last moment, so that the watermark stands, and the past
    for part in (F.col("ts") == F.col("last"), F.col("ts") < F.col("last") - F.expr("INTERVAL 3 DAYS")):
        both.where(part).drop("last").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    counted = ST.windowed(ST.rows_of(spark, f"{folder}/in", rows.schema, 1), "ts", "1 day", "1 day", ["event_type"])
    write = lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    counted.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{folder}/out").select("start", "event_type", "rows")


@CORPUS.add(
    "stream_table",
    "SELECT id, max(loaded_at) AS loaded_at FROM edges GROUP BY id",
)
def stream_table(spark: SparkSession, d: str) -> DataFrame:
    """Edges kept up to date by key from four batches of deliveries, cut so that each holds rows older than those of another."""
    rows = table(spark, d, "edges")
    folder = scratch(spark, "edges")
    rows.repartitionByRange(4, F.xxhash64("id", "loaded_at")).write.parquet(f"{folder}/in")
    ST.follow(ST.rows_of(spark, f"{folder}/in", rows.schema, 1), f"{folder}/table", f"{folder}/state", ["id"], "loaded_at").awaitTermination()
    return ST.followed(spark, f"{folder}/table", rows.schema).select("id", "loaded_at")


@CORPUS.add(
    "crawl_sync",
    """WITH f AS (SELECT DISTINCT repo, branch, file_path AS file FROM chunks WHERE repo IS NOT NULL AND branch IS NOT NULL AND file_path IS NOT NULL),
    gone AS (SELECT min(repo) AS repo FROM f), k AS (SELECT f.*, CASE WHEN repo IN (SELECT repo FROM gone) THEN 'D' WHEN length(file) % 3 = 0 THEN 'M' ELSE 'S' END AS status FROM f)
    SELECT repo, branch, count_if(status = 'M')::BIGINT AS modified, count_if(status = 'D')::BIGINT AS deleted, count_if(status = 'S')::BIGINT AS same, count_if(status <> 'D')::BIGINT AS stored FROM k GROUP BY ALL""",
)
def crawl_sync(spark: SparkSession, d: str) -> DataFrame:
    """The second ingest of all files, after a third of them changed and one repository went: its report beside what is stored."""
    files, out = _files(spark, d).drop("id"), scratch(spark, "crawl")
    crawl.sync(files, out)
    first = files.where("branch IS NOT NULL AND file IS NOT NULL").agg(F.min("repo").alias("gone"))
    left = files.join(F.broadcast(first), files["repo"] == F.col("gone"), "left_anti")
    text = F.when(F.length("file") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" changed"))).otherwise(F.col("text"))
    report = crawl.sync(left.withColumn("text", text), out)
    counted = report.groupBy("repo", "branch").pivot("status", ["M", "D", "S"]).agg(F.sum("files"))
    kept = spark.read.parquet(f"{out}/files").groupBy("repo", "branch").agg(F.count(F.lit(1)).alias("stored"))
    named = counted.select("repo", "branch", *[F.coalesce(s, F.lit(0)).alias(n) for s, n in (("M", "modified"), ("D", "deleted"), ("S", "same"))])
    return named.join(kept, ["repo", "branch"], "left").fillna(0, ["stored"])
