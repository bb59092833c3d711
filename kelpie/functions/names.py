"""Column functions on names of branches, files, environments, services and graph nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpie.functions.text import extension, file_name, normal_path, parent_name, stem

# Branch families, first match wins.
BRANCH_TIERS = [
    ("production", r"^(main|master)$"),
    ("integration", r"^(develop|development)$"),
    ("release", r"^release([_/]|$)"),
    ("hotfix", r"^hotfix([_/]|$)"),
    ("feature", r"^feature([_/]|$)"),
    ("bugfix", r"^(bugfix|fix)[_/]"),
]
PROTECTION_TIERS = [
    ("production", r"(?i)^(main|master)$"),
    ("integration", r"(?i)^(develop|development)$"),
    ("release", r"(?i)^release[_/]"),
    ("hotfix", r"(?i)^hotfix[_/]"),
    ("feature", r"(?i)^feat(ure)?[_/]"),
    ("fix", r"(?i)^fix[_/]"),
    ("chore", r"(?i)^chore[_/]"),
]
PROTECTED = r"(?i)^(main$|master$|release[_/]|hotfix[_/]|develop$|development$)"
# Environment families as whole words, first match wins.
ENV_TIERS = [
    ("production", r"(?i)\b(prod|prd|production)\b"),
    ("staging", r"(?i)\b(staging|stg|uat|pre-?prod)\b"),
    ("integration", r"(?i)\b(dev|develop|int|integration)\b"),
    ("sandbox", r"(?i)\b(sandbox|sbx|lab|test)\b"),
]
# Parts of resource names that stand for a place, an environment or a tier.
NAME_PARTS = {
    "region": "eus2 eus wus2 wus cus ncus scus weu neu sea eas eastus2 westus2 centralus eastus westus".split(),
    "env": "dev stg staging prod prd uat np sandbox sbx test qa".split(),
    "tier": "prd npd np prod nonprod".split(),
}
# Kinds of files that hold no text of interest.
SKIPPED_EXTENSIONS = (
    ".jar .class .war .ear .png .jpg .jpeg .gif .bmp .ico .svg .webp .zip .tar .gz .bz2 .7z .rar .exe .dll .so .dylib .bin "
    ".pyc .pyo .o .obj .woff .woff2 .ttf .eot .mp3 .mp4 .avi .mov .wav .pdf .doc .docx .xls .xlsx .lock .sum"
).split()
SKIPPED_NAMES = [".DS_Store", "Thumbs.db", ".gitkeep", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"]
PROFILES = ["prod", "proddr", "dev", "qa", "perf", "demo", "preprod", "predemo"]
# Endpoint kinds, first match wins.
ENDPOINTS = [
    (r"[\w.-]+\.servicebus\.windows\.net", "service_bus"),
    (r"[\w.-]+\.database\.azure\.com", "database"),
    (r"[\w.-]+\.redis\.cache\.windows\.net", "redis"),
    (r"[\w.-]+\.blob\.core\.windows\.net", "storage"),
    (r"https?://[\w.-]*salesforce\.com[\w/.-]*", "salesforce"),
    (r"[\w.-]+\.auth0app\.com[\w/.-]*", "auth0"),
    (r"[\w.-]+\.azurewebsites\.net", "app_service"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?", "internal_endpoint"),
]
CONFIG_KEYS = r"endpoint|url|host|namespace|connection-string|domain|base-url|access-token-uri"


def first_of(value: Column, rules: list[tuple[str, str]], otherwise: str = "unknown") -> Column:
    """Name of the first rule whose pattern the value matches."""
    return F.coalesce(*[F.when(value.rlike(pattern), F.lit(name)) for name, pattern in rules], F.lit(otherwise))


def branch_slug(branch: Column) -> Column:
    return F.translate(F.lower(branch), "/-", "__")


def branch_tier(branch: Column) -> Column:
    return first_of(F.trim(F.lower(branch)), BRANCH_TIERS)


def bare_branch(branch: Column) -> Column:
    return F.regexp_replace(branch, "^origin/", "")


def protection_tier(branch: Column) -> Column:
    return first_of(F.replace(branch, F.lit("origin/"), F.lit("")), PROTECTION_TIERS)


def is_protected(branch: Column) -> Column:
    return bare_branch(branch).rlike(PROTECTED)


def release_version(branch: Column) -> Column:
    """``release_12_3`` as 12.03 and ``release_12`` as 12, null for other names."""
    two, one = r"(?i)^release[_/](\d+)[_./](\d+)$", r"(?i)^release[_/](\d+)$"
    of_two = F.regexp_extract(branch, two, 1).try_cast("double") + F.regexp_extract(branch, two, 2).try_cast("double") / 100.0
    return F.coalesce(of_two, F.regexp_extract(branch, one, 1).try_cast("double"))


def working_branch(source: Column, description: Column, prefix: str = "work") -> Column:
    """``prefix/source-description``, the description in safe characters, at most 50."""
    clean = F.replace(F.replace(source, F.lit("origin/"), F.lit("")), F.lit("/"), F.lit("-"))
    safe = F.regexp_replace(F.regexp_replace(F.lower(description), "[^a-zA-Z0-9_-]", "-"), "-+", "-")
    return F.concat(F.lit(f"{prefix}/"), clean, F.lit("-"), F.left(F.regexp_replace(safe, "^-+|-+$", ""), F.lit(50)))


def environment_tier(name: Column) -> Column:
    return first_of(name, ENV_TIERS)


def service_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"[_\s]+", "-"), r"-v\d+$", "")


def file_class(path: Column) -> Column:
    """Class of a file by its path alone; rules apply in order."""
    name, ext, above, base = F.lower(file_name(path)), extension(path), parent_name(path), stem(path)
    yaml = ext.isin(".yaml", ".yml")
    folders = F.split(F.lower(normal_path(path)), "/")

    def under(folder: str) -> Column:
        return F.array_contains(folders, folder) & yaml

    rules = [
        (ext.isin(SKIPPED_EXTENSIONS) | file_name(path).isin(SKIPPED_NAMES), "skip"),
        (yaml & (((above != "") & F.startswith(base, above)) | F.startswith(base, F.lit("application"))), "config"),
        (name.isin("pipeline.yaml", "pipeline.yml"), "pipeline"),
        (name.isin("chart.yaml", "chart.yml"), "helm_chart"),
        (name.isin("values.yaml", "values.yml"), "helm_values"),
        (ext.isin(".tf", ".tfvars"), "terraform"),
        (under("services"), "harness_svc"),
        (under("environments"), "harness_env"),
        (under("overrides"), "harness_override"),
        (under("templates"), "template"),
        (yaml, "unknown"),
        (F.startswith(name, F.lit("dockerfile")), "dockerfile"),
        (F.startswith(name, F.lit("readme")), "readme"),
    ]
    return F.coalesce(*[F.when(rule, F.lit(cls)) for rule, cls in rules], F.lit("unknown"))


def tree_kind(path: Column, content: Column | None = None) -> Column:
    """Kind of a tree: by extension, words in the path, then by the content."""
    p = F.lower(normal_path(path))
    text = F.coalesce(content, F.lit("")) if content is not None else F.lit("")
    return (
        F.when(p.rlike(r"\.(tf|hcl)$"), "terraform")
        .when(p.rlike("pipeline|harness"), "harness")
        .when(text.rlike(r"(?m)^pipeline:") | F.ltrim(text).startswith("pipeline:"), "harness")
        .when(p.rlike("charts/|chart/|values|helm"), "helm")
        .when(F.contains(text, F.lit("replicaCount:")) | F.contains(text, F.lit("image:")), "helm")
        .otherwise("generic")
    )


def chunk_kind(path: Column) -> Column:
    """Fallback type of a chunk by the file's suffix and name."""
    name, ext = F.lower(file_name(path)), extension(path)
    of_yaml = (
        F.when(F.contains(name, F.lit("pipeline")), "pipeline").when(F.contains(name, F.lit("chart")), "helm_chart")
        .when(F.contains(name, F.lit("values")), "helm_values").when(F.contains(path, F.lit("templates")), "template").otherwise("yaml")
    )
    return F.when(ext == ".tf", "terraform").when(ext.isin(".yaml", ".yml"), of_yaml).when(ext == ".md", "markdown").otherwise("unknown")


def settings_service(path: Column) -> Column:
    """Service and profile of a settings file: ``{service}[-{profile}]`` in the service's folder, or ``application[-{profile}]``."""
    base, above = stem(path), parent_name(path)
    service = F.when(F.startswith(base, F.lit("application")), F.lit("application")).when((above != "") & F.startswith(base, above), above)
    rest = F.substring(base, F.length(service) + 1, F.length(base))
    profile = F.when(F.startswith(rest, F.lit("-")) & F.substring(rest, 2, 100).isin(PROFILES), F.substring(rest, 2, 100))
    return F.struct(service.alias("service"), profile.alias("profile"))


def endpoint(value: Column) -> Column:
    """Value and kind of the first endpoint in a text, null without one."""
    return F.coalesce(
        *[F.when(value.rlike(p), F.struct(F.regexp_extract(value, f"({p})", 1).alias("value"), F.lit(kind).alias("kind"))) for p, kind in ENDPOINTS]
    )


def node_kind(node: Column) -> Column:
    """Type of a graph node by its id."""
    prefixes = [("kv_secret:", "kv_secret"), ("k8s_secret:", "k8s_secret"), ("kv_data:", "kv_data_source"), ("config:", "config_file"), ("endpoint:", "external_endpoint"), ("config_prop:", "config_property")]
    by_prefix = reduce(lambda c, p: c.when(F.startswith(node, F.lit(p[0])), p[1]), prefixes[1:], F.when(F.startswith(node, F.lit(prefixes[0][0])), prefixes[0][1]))
    return by_prefix.when(F.endswith(node, F.lit(".tf")), "terraform_file").when(node.rlike(r"\.ya?ml$"), "yaml_file").otherwise("entity")


def risk(prod: Column, services: Column, entities: Column, files: Column) -> Column:
    return (
        F.when(prod & (services > 2), "critical").when(prod | (services > 3), "high")
        .when((entities > 10) | (files > 5), "medium").otherwise("low")
    )


# Words that tell what a prompt wants, and words that say nothing about it.
FIX_WORDS = ["fix", "bug", "patch", "hotfix", "repair"]
UPDATE_WORDS = ["update", "modify", "change", "refactor", "improve"]
STOP_WORDS = [
    "a", "an", "the", "and", "or", "for", "in", "on", "at", "to", "from", "with", "we", "i", "it", "is", "are", "be", "this", "that", "please", "can", "you", "need", "want", "should", "would", "create", "make",
    "new", "file", "pipeline", "branch", "repo", "harness", "just", "also", "all", "but", "not", "do", "does", "our", "my", "so", "have", "has",
]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def new_branch(prompt: Column, source: Column) -> Column:
    """Branch name of a prompt: what it wants to do, then its first four telling words; without one, the branch it starts from."""
    low = F.lower(prompt)
    said = F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1))
    prefix = F.when(F.arrays_overlap(said, _strings(FIX_WORDS)), "fix").when(F.arrays_overlap(said, _strings(UPDATE_WORDS)), "chore").otherwise("feat")
    raw = F.transform(F.filter(F.split(low, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"^[.,?!:;()\[\]{}\"'/]+|[.,?!:;()\[\]{}\"'/]+$", ""))
    telling = F.filter(raw, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 2) & w.rlike("^[a-z0-9_]+$"))
    slug = F.array_join(F.slice(telling, 1, 4), "-")
    whole = F.when(slug == "", F.translate(source, "/_", "--")).otherwise(slug)
    return F.concat(prefix, F.lit("/"), F.when(F.length(whole) > 50, F.regexp_replace(F.left(whole, F.lit(50)), "-+$", "")).otherwise(whole))


# For each pair of hints, what a path holds, how it ends, and what a text holds.
HINTS = [
    (["cicd", "harness"], ["pipeline", "stage", "step", ".harness"], [], ["pipeline:", "stage:", "step:", "type: pipeline"]),
    (["infrastructure", "terraform"], ["terraform"], [".tf", ".tfvars"], ['resource "', 'provider "', 'module "', "terraform {"]),
    (["mixed", "helm"], ["values", "chart", "templates/", "helm"], [], ["apiversion:", "kind:", "helm.sh"]),
]


def repo_hints(path: Column, text: Column) -> Column:
    """Types of repository that a file's path and text hint at, each once, in alphabetical order."""
    p, t = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    told = []
    for names, inside, ends, held in HINTS:
        clues = [F.contains(p, F.lit(w)) for w in inside] + [F.endswith(p, F.lit(w)) for w in ends] + [F.contains(t, F.lit(w)) for w in held]
        told.append(F.when(reduce(lambda a, b: a | b, clues), _strings(names)).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(*told)))
