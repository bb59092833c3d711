"""Queries over the edge and node tables and over trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.names import node_kind
from kelpie.functions.text import fuzzy_match
from kelpie.operators import components as CC
from kelpie.operators import graph as G
from kelpie.operators import trees as TR
from kelpie.plans.registry import QuerySet
from kelpie.session import materialize, spread, table

GRAPH = QuerySet()

_LINKED = "linked AS (SELECT id, min(source) AS source, min(target) AS target, min(edge_type) AS edge_type, min(file) AS file FROM edges WHERE source <> '' AND target <> '' GROUP BY id)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.linked(table(spark, d, "edges"))


@GRAPH.add(
    "graph_downstream",
    f"""WITH RECURSIVE {_LINKED}, seeds AS (SELECT DISTINCT source AS seed FROM linked WHERE id % 20 = 0),
    walk AS (SELECT seed, seed AS node, 0 AS hops FROM seeds UNION SELECT w.seed, l.target, w.hops + 1 FROM walk w JOIN linked l ON l.source = w.node WHERE w.hops < 3)
    SELECT seed, node, min(hops)::INT AS hops FROM walk GROUP BY ALL""",
)
def graph_downstream(spark: SparkSession, d: str) -> DataFrame:
    """Everything within three links out of each queried edge's source."""
    edges = _edges(spark, d)
    return G.traverse(edges, edges.where("id % 20 = 0").select(F.col("source").alias("seed")), 3, "out")


_BOTH = f"""WITH RECURSIVE {_LINKED}, seeds AS (SELECT min(id) AS seed FROM nodes WHERE node_type IS NOT NULL GROUP BY node_type),
    ways AS (SELECT source AS a, target AS b FROM linked UNION SELECT target, source FROM linked),
    walk AS (SELECT seed, seed AS node, 0 AS hops FROM seeds UNION SELECT w.seed, l.b, w.hops + 1 FROM walk w JOIN ways l ON l.a = w.node WHERE w.hops < 2),
    visited AS (SELECT seed, node, min(hops) AS hops FROM walk GROUP BY ALL),
    latest AS (SELECT id, node_type, coalesce(file, '') AS file, coalesce(repo, '') AS repo FROM
      (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, coalesce(file, '') DESC, coalesce(node_type, '') DESC) AS rn FROM nodes) WHERE rn = 1)"""


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where("node_type IS NOT NULL").groupBy("node_type").agg(F.min("id").alias("seed")).select("seed")


@GRAPH.add(
    "graph_neighbourhood",
    _BOTH + """ SELECT v.seed, v.node, v.hops::INT AS hops, CASE WHEN l.id IS NULL THEN 'unknown' ELSE l.node_type END AS node_type, coalesce(l.file, '') AS file, coalesce(l.repo, '') AS repo
    FROM visited v LEFT JOIN latest l ON l.id = v.node""",
)
def graph_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within two links either way of one node of each type, with their details."""
    return G.described(G.traverse(_edges(spark, d), _seeds(spark, d), 2), table(spark, d, "nodes"))


@GRAPH.add(
    "graph_walked_edges",
    _BOTH + """ SELECT DISTINCT v.seed, l.source, l.target, l.edge_type FROM visited v JOIN linked l ON l.source = v.node OR l.target = v.node WHERE v.hops < 2""",
)
def graph_walked_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return G.traversed_edges(edges, G.traverse(edges, _seeds(spark, d), 2), 2).select("seed", "source", "target", "edge_type")


@GRAPH.add(
    "change_impact",
    _BOTH + """, known AS (SELECT v.seed, l.*, contains(lower(coalesce(node_type, '')), 'service') OR contains(lower(id), 'service') AS is_service,
      contains(lower(coalesce(node_type, '')), 'environment') OR contains(lower(id), 'env') AS is_env FROM visited v JOIN latest l ON l.id = v.node),
    counts AS (SELECT seed, count(*) AS entities, count_if(is_service)::BIGINT AS services, count_if(is_env)::BIGINT AS environments, coalesce(bool_or(CASE WHEN is_env THEN contains(lower(id), 'prod') END), false) AS prod FROM known GROUP BY seed),
    fs AS (SELECT seed, file FROM known WHERE file <> '' UNION SELECT v.seed, l.file FROM visited v JOIN linked l ON (l.source = v.node OR l.target = v.node) AND v.hops < 2 WHERE l.file <> ''),
    files AS (SELECT seed, count(*) AS files FROM fs GROUP BY seed),
    both_ AS (SELECT s.seed, coalesce(entities, 0) AS entities, coalesce(services, 0) AS services, coalesce(environments, 0) AS environments, coalesce(prod, false) AS prod, coalesce(files, 0) AS files FROM seeds s LEFT JOIN counts c ON c.seed = s.seed LEFT JOIN files f ON f.seed = s.seed)
    SELECT *, CASE WHEN prod AND services > 2 THEN 'critical' WHEN prod OR services > 3 THEN 'high' WHEN entities > 10 OR files > 5 THEN 'medium' ELSE 'low' END AS risk_level,
    'Impact of ' || seed || ': risk ' || upper(CASE WHEN prod AND services > 2 THEN 'critical' WHEN prod OR services > 3 THEN 'high' WHEN entities > 10 OR files > 5 THEN 'medium' ELSE 'low' END) || ', ' || entities || ' entities, ' || files || ' files' AS summary FROM both_""",
)
def change_impact(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return G.impact(G.traverse(edges, _seeds(spark, d), 2), table(spark, d, "nodes"), edges, 2)


@GRAPH.add("branch_edges", "SELECT id, branch, branch = 'main' OR branch = 'default' AS shared, branch = 'main' OR branch IS NULL AS open FROM edges WHERE branch = 'main' OR branch = 'default' OR branch IS NULL")
def branch_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a branch under both rules for what holds on all branches: the default branch, or none."""
    shared, unnamed = G.on_branch("main", F.col("branch") == "default"), G.on_branch("main", F.col("branch").isNull())
    return table(spark, d, "edges").select("id", "branch", shared.alias("shared"), unnamed.alias("open")).where("shared OR open")


@GRAPH.add(
    "entity_profiles",
    f"""WITH {_LINKED}, o AS (SELECT source AS id, count(*) AS outbound FROM linked GROUP BY 1), i AS (SELECT target AS id, count(*) AS inbound FROM linked GROUP BY 1),
    f AS (SELECT id, count(*) AS related_files FROM (SELECT source AS id, file FROM linked UNION SELECT target, file FROM linked UNION SELECT id, file FROM nodes) WHERE file <> '' GROUP BY id)
    SELECT n.id, coalesce(outbound, 0) AS outbound, coalesce(inbound, 0) AS inbound, coalesce(related_files, 0) AS related_files
    FROM (SELECT DISTINCT id FROM nodes) n LEFT JOIN o ON o.id = n.id LEFT JOIN i ON i.id = n.id LEFT JOIN f ON f.id = n.id""",
)
def entity_profiles(spark: SparkSession, d: str) -> DataFrame:
    return G.profiles(_edges(spark, d), table(spark, d, "nodes"))


@GRAPH.add(
    "entity_resolution",
    """WITH names AS (SELECT DISTINCT name FROM (SELECT min(id) AS name FROM nodes WHERE node_type IS NOT NULL GROUP BY node_type UNION ALL SELECT 'core-main' UNION ALL SELECT 'no such name')),
    ids AS (SELECT DISTINCT id FROM nodes), exact AS (SELECT name, id FROM names JOIN ids ON id = name),
    found AS (SELECT * FROM exact UNION ALL SELECT name, id FROM names JOIN ids ON id ILIKE '%' || name || '%' WHERE name NOT IN (SELECT name FROM exact))
    SELECT name, id, count(*) OVER (PARTITION BY name) AS matches FROM found""",
)
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes")
    names = _seeds(spark, d).select(F.col("seed").alias("name")).unionByName(spark.createDataFrame([("core-main",), ("no such name",)], "name string")).distinct()
    return G.resolve(nodes, names)


# The same four as searches of many: every end of an edge whose id is divisible by 20, and its file, against all rows.
_WALK = "walk AS (SELECT seed, {0} AS node, 0 AS hops FROM {1} UNION"
_ENDS = "SELECT source AS seed, source AS node FROM linked WHERE id % 20 = 0 UNION SELECT target, target FROM linked WHERE id % 20 = 0"
_FILES = """ UNION SELECT 'file:' || a.file, n.node FROM (SELECT DISTINCT file FROM linked WHERE id % 20 = 0 AND file <> '') a
      JOIN (SELECT file, source AS node FROM linked UNION SELECT file, target FROM linked UNION SELECT file, id FROM nodes) n ON n.file = a.file"""
_SEEDS = "seeds AS (SELECT min(id) AS seed FROM nodes WHERE node_type IS NOT NULL GROUP BY node_type)"


def _searched(name: str, starts: str) -> str:
    """The SQL of a query with other seeds."""
    return GRAPH.sql[name].replace(_SEEDS, f"starts AS ({starts}), seeds AS (SELECT DISTINCT seed FROM starts)", 1).replace(_WALK.format("seed", "seeds"), _WALK.format("node", "starts"), 1)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.where("id % 20 = 0").select(F.explode(F.array("source", "target")).alias("seed")).distinct()


@GRAPH.add("neighbourhood_searches", _searched("graph_neighbourhood", _ENDS))
def neighbourhood_searches(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within two links either way of every searched end."""
    edges = _edges(spark, d)
    return G.neighbourhoods(edges, _ends(edges), table(spark, d, "nodes"))


@GRAPH.add("walked_edge_searches", _searched("graph_walked_edges", _ENDS))
def walked_edge_searches(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return G.walked_by_each(edges, _ends(edges))


@GRAPH.add("impact_searches", _searched("change_impact", _ENDS + _FILES))
def impact_searches(spark: SparkSession, d: str) -> DataFrame:
    """The impact of every searched end, and of every searched file through all nodes that it holds."""
    edges, nodes = materialize(_edges(spark, d).select("id", "source", "target", "file"), "edges"), table(spark, d, "nodes")
    asked = edges.where("id % 20 = 0 AND file <> ''").select("file").distinct()
    held = edges.select("file", F.explode(F.array("source", "target")).alias("node")).unionByName(nodes.select("file", F.col("id").alias("node"))).distinct()
    files = held.join(asked, "file").select(F.concat(F.lit("file:"), "file").alias("seed"), "node")
    starts = _ends(edges).select("seed", F.col("seed").alias("node")).unionByName(files)
    return G.impact_of_many(edges, starts, nodes)


@GRAPH.add(
    "resolution_searches",
    f"""WITH {_LINKED}, ends AS (SELECT source AS name FROM linked WHERE id % 20 = 0 UNION SELECT target FROM linked WHERE id % 20 = 0),
    names AS (SELECT name FROM ends UNION SELECT regexp_extract(name, '[^:]+$', 0) FROM ends WHERE NOT ends_with(name, ':')),
    ids AS (SELECT DISTINCT id FROM nodes), exact AS (SELECT name, id FROM names JOIN ids ON id = name),
    found AS (SELECT * FROM exact UNION ALL SELECT name, id FROM names JOIN ids ON id ILIKE '%' || name || '%' WHERE name NOT IN (SELECT name FROM exact))
    SELECT name, id, count(*) OVER (PARTITION BY name) AS matches FROM found""",
)
def resolution_searches(spark: SparkSession, d: str) -> DataFrame:
    """Every searched end by its id, and by its id without the kind before the colon."""
    ends = _ends(_edges(spark, d)).select(F.col("seed").alias("name"))
    bare = ends.where("NOT endswith(name, ':')").select(F.regexp_extract("name", "[^:]+$", 0).alias("name"))
    return G.resolve(table(spark, d, "nodes"), ends.unionByName(bare).distinct())


@GRAPH.add(
    "repo_resolution",
    """WITH names AS (SELECT DISTINCT repo AS name FROM edges WHERE repo IS NOT NULL UNION SELECT DISTINCT regexp_replace(repo, '-[^-]*$', '') FROM edges WHERE repo IS NOT NULL UNION SELECT DISTINCT repo || '-mirror' FROM nodes WHERE repo IS NOT NULL),
    known AS (SELECT DISTINCT repo AS found FROM chunks WHERE repo IS NOT NULL),
    loose AS (SELECT name, found FROM names, known WHERE name NOT IN (SELECT found FROM known) AND name <> '' AND found <> '' AND (contains(lower(name), lower(found)) OR contains(lower(found), lower(name)))),
    best AS (SELECT name, count(*) AS n, min(found) AS one FROM loose GROUP BY name)
    SELECT name, 'exact' AS status, name AS found FROM names WHERE name IN (SELECT found FROM known) UNION ALL
    SELECT n.name, CASE WHEN b.n = 1 THEN 'fuzzy' WHEN b.n > 1 THEN 'ambiguous' ELSE 'unknown' END, CASE WHEN b.n = 1 THEN one END FROM names n LEFT JOIN best b ON b.name = n.name WHERE n.name NOT IN (SELECT found FROM known)""",
)
def repo_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Repositories as edges call them, without their last part, and with one more, among those that chunks come from."""
    edges = table(spark, d, "edges").where("repo IS NOT NULL").select("repo").distinct()
    more = table(spark, d, "nodes").where("repo IS NOT NULL").select(F.concat("repo", F.lit("-mirror")).alias("name"))
    names = edges.select(F.col("repo").alias("name")).unionByName(edges.select(F.regexp_replace("repo", "-[^-]*$", "").alias("name"))).unionByName(more)
    return G.resolve_names(names, table(spark, d, "chunks").select(F.col("repo").alias("name")))


@GRAPH.add(
    "catalogue_impact",
    f"""WITH {_LINKED}, ends AS (SELECT source AS id FROM linked WHERE id % 20 = 0 UNION SELECT target FROM linked WHERE id % 20 = 0),
    names AS (SELECT DISTINCT regexp_extract(id, '[^:]+$', 0) AS name FROM ends WHERE NOT ends_with(id, ':')), open_ AS (SELECT name FROM names WHERE name NOT IN (SELECT source FROM linked) AND name NOT IN (SELECT target FROM linked)),
    entries AS (SELECT DISTINCT id, node_type, file FROM nodes),
    found AS (SELECT DISTINCT name, id, node_type, file FROM open_, entries WHERE name <> '' AND (contains(lower(id), lower(name)) OR contains(lower(file), lower(name))))
    SELECT name, count(*) AS entities, count(DISTINCT CASE WHEN file <> '' THEN file END) AS files, count(DISTINCT CASE WHEN regexp_matches(lower(node_type), 'service|svc') THEN id END) AS services FROM found GROUP BY name""",
)
def catalogue_impact(spark: SparkSession, d: str) -> DataFrame:
    """Names of every searched end without its kind, where the graph has no such node, by the catalogue of nodes."""
    edges = _edges(spark, d)
    bare = _ends(edges).where("NOT endswith(seed, ':')").select(F.regexp_extract("seed", "[^:]+$", 0).alias("name")).distinct()
    graph = edges.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    return G.catalogue(bare.join(graph, "name", "left_anti"), table(spark, d, "nodes"))


@GRAPH.add(
    "entity_views",
    f"""WITH {_LINKED}, ends AS (SELECT source AS id FROM linked WHERE id % 20 = 0 UNION SELECT target FROM linked WHERE id % 20 = 0)
    SELECT DISTINCT e.id, 'out' AS direction, target AS other, edge_type, file FROM ends e JOIN linked l ON l.source = e.id UNION
    SELECT DISTINCT e.id, 'in', source, edge_type, file FROM ends e JOIN linked l ON l.target = e.id""",
)
def entity_views(spark: SparkSession, d: str) -> DataFrame:
    """Every link of each searched end, with the file that names it."""
    edges = _edges(spark, d)
    return G.entity_view(edges, _ends(edges).select(F.col("seed").alias("id")))


@GRAPH.add(
    "fuzzy_entities",
    """SELECT DISTINCT id FROM nodes WHERE contains(translate(lower(id), '-_ ', ''), 'zonecore') OR contains('zonecore', translate(lower(id), '-_ ', ''))""",
)
def fuzzy_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where(fuzzy_match("zone-core", F.col("id"))).select("id").distinct()


@GRAPH.add(
    "graph_nodes",
    f"""WITH {_LINKED}, repos AS (SELECT DISTINCT id, repo FROM edges WHERE source <> '' AND target <> ''),
    ends AS (SELECT source AS id, coalesce(file, '') AS file FROM linked UNION ALL SELECT target, '' FROM linked)
    SELECT id, max(file) AS file, CASE WHEN starts_with(id, 'kv_secret:') THEN 'kv_secret' WHEN starts_with(id, 'k8s_secret:') THEN 'k8s_secret' WHEN starts_with(id, 'kv_data:') THEN 'kv_data_source'
      WHEN starts_with(id, 'config:') THEN 'config_file' WHEN starts_with(id, 'endpoint:') THEN 'external_endpoint' WHEN starts_with(id, 'config_prop:') THEN 'config_property'
      WHEN id LIKE '%.tf' THEN 'terraform_file' WHEN id LIKE '%.yaml' OR id LIKE '%.yml' THEN 'yaml_file' ELSE 'entity' END AS node_type FROM ends GROUP BY id""",
)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes_of(_edges(spark, d)).drop("repo")


@GRAPH.add(
    "secret_flow",
    """WITH e AS (SELECT DISTINCT source, target, edge_type FROM edges WHERE source <> '' AND target <> ''),
    made AS (SELECT target AS secret, source AS kv_file FROM e WHERE edge_type = 'CREATES_KV_SECRET' AND starts_with(target, 'kv_secret:')),
    data AS (SELECT target AS secret, source AS reader FROM e WHERE edge_type = 'READS_KV_SECRET' AND starts_with(target, 'kv_secret:')),
    held AS (SELECT target AS reader, source AS k8s FROM e WHERE edge_type = 'READS_KV_SECRET' AND starts_with(target, 'kv_data:')),
    mounts AS (SELECT target AS k8s_secret, source AS mount_file FROM e WHERE edge_type = 'MOUNTS_SECRET' AND starts_with(target, 'k8s_secret:')),
    created AS (SELECT target AS k8s_secret, source AS k8s_file FROM e WHERE edge_type = 'CREATES_K8S_SECRET' AND starts_with(target, 'k8s_secret:')),
    seen AS (SELECT * FROM data WHERE secret IN (SELECT secret FROM made)),
    cluster AS (SELECT s.secret, h.k8s FROM seen s JOIN held h ON h.reader = s.reader UNION SELECT secret, reader FROM seen WHERE starts_with(reader, 'k8s_secret:'))
    SELECT DISTINCT secret, 'kv_file' AS stage, kv_file AS name FROM made UNION ALL SELECT DISTINCT secret, 'kv_data', reader FROM seen UNION ALL SELECT secret, 'k8s_secret', k8s FROM cluster UNION ALL
    SELECT DISTINCT c.secret, 'k8s_file', r.k8s_file FROM cluster c JOIN created r ON r.k8s_secret = c.k8s UNION ALL SELECT DISTINCT c.secret, 'mount_file', m.mount_file FROM cluster c JOIN mounts m ON m.k8s_secret = c.k8s""",
)
def secret_flow(spark: SparkSession, d: str) -> DataFrame:
    return G.secret_flow(_edges(spark, d))


@GRAPH.add(
    "graph_components",
    f"""WITH RECURSIVE {_LINKED}, ways AS (SELECT source AS a, target AS b FROM linked UNION SELECT target, source FROM linked),
    reach AS (SELECT DISTINCT a AS node, a AS r FROM ways UNION SELECT node, b FROM reach JOIN ways ON a = r)
    SELECT node, min(r) AS component FROM reach GROUP BY node""",
)
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """The component of every node of the graph."""
    return CC.components(_edges(spark, d), "source", "target")


@GRAPH.add(
    "edge_metadata",
    """SELECT id, max(TRY_CAST(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.line') AS INT)) AS line FROM edges GROUP BY id""",
)
def edge_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The line of each edge from its metadata; broken JSON has none."""
    line = F.get_json_object("metadata", "$.line").try_cast("int")
    return table(spark, d, "edges").groupBy("id").agg(F.max(line).alias("line"))


@GRAPH.add(
    "skeleton_pages",
    """WITH r AS (SELECT id, client, file_type, node_count, row_number() OVER (PARTITION BY client ORDER BY indexed_at DESC, id) AS n, count(*) OVER (PARTITION BY client) AS total_found FROM
      (SELECT id, client, file_type, node_count, indexed_at FROM hti_skeletons WHERE deleted_at IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, coalesce(node_count, -1) DESC) = 1))
    SELECT id, client, n, total_found FROM r WHERE n <= 50""",
)
def skeleton_pages(spark: SparkSession, d: str) -> DataFrame:
    """The 50 youngest live skeletons of each client, as a page of results."""
    live = table(spark, d, "hti_skeletons").where("deleted_at IS NULL").groupBy("id", "client").agg(F.max("indexed_at").alias("indexed_at"))
    return TR.pages(live, ["client"]).select("id", "client", "n", "total_found")


@GRAPH.add(
    "fetch_nodes",
    """WITH q AS (SELECT DISTINCT skeleton_id, w AS wanted FROM hti_nodes, (VALUES ('root.spec'), ('root.stages[0]'), ('root.service.exec')) v(w) WHERE skeleton_id <> ''),
    near AS (SELECT q.skeleton_id, q.wanted, n.node_path, n.depth, n.node_path <> q.wanted AS loose, row_number() OVER (PARTITION BY q.skeleton_id, q.wanted ORDER BY n.node_path <> q.wanted, n.depth, n.node_path) AS rn
      FROM q JOIN hti_nodes n ON n.skeleton_id = q.skeleton_id AND starts_with(n.node_path, q.wanted))
    SELECT q.skeleton_id, q.wanted, CASE WHEN b.rn IS NULL THEN 'missing' WHEN b.loose THEN 'prefix' ELSE 'exact' END AS found, b.node_path, b.depth
    FROM q LEFT JOIN near b ON b.skeleton_id = q.skeleton_id AND b.wanted = q.wanted AND b.rn = 1""",
)
def fetch_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Three paths looked up in every skeleton that has nodes."""
    nodes = table(spark, d, "hti_nodes")
    wanted = F.explode(F.array(F.lit("root.spec"), F.lit("root.stages[0]"), F.lit("root.service.exec"))).alias("wanted")
    return TR.fetch(nodes, nodes.where("skeleton_id <> ''").select("skeleton_id").distinct().select("skeleton_id", wanted)).drop("content_json")


@GRAPH.add(
    "outdated_skeletons",
    """WITH cut AS (SELECT * FROM hti_skeletons WHERE indexed_at < TIMESTAMP '2025-01-01'), known AS (SELECT id, max(mtime_epoch) AS m FROM cut GROUP BY id)
    SELECT s.id, s.mtime_epoch FROM hti_skeletons s LEFT JOIN known k ON k.id = s.id WHERE k.m IS NULL OR s.mtime_epoch > k.m""",
)
def outdated_skeletons(spark: SparkSession, d: str) -> DataFrame:
    """What an index of early 2025 would have to read again."""
    rows = table(spark, d, "hti_skeletons")
    return TR.outdated(rows, rows.where("indexed_at < TIMESTAMP_NTZ '2025-01-01 00:00:00'")).select("id", "mtime_epoch")


@GRAPH.add(
    "tree_flatten",
    """WITH d AS (SELECT DISTINCT id, skeleton_json FROM hti_skeletons WHERE json_valid(skeleton_json)),
    n AS (SELECT d.id, t.fullkey, t.type, t.atom FROM d, json_tree(d.skeleton_json) t)
    SELECT id, 0 AS document, 'root' || replace(substr(fullkey, 2), '"', '') AS node_path, (length(fullkey) - length(replace(replace(fullkey, '.', ''), '[', '')))::INT AS depth,
    CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END AS kind,
    CASE WHEN type = 'BOOLEAN' THEN upper(left(atom::VARCHAR, 1)) || substr(atom::VARCHAR, 2) WHEN type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(atom, '$') END AS preview FROM n""",
)
def tree_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Every node of every skeleton document, to any depth."""
    rows = table(spark, d, "hti_skeletons").select("id", "skeleton_json").distinct()
    return TR.flatten(spread(rows), "id", "skeleton_json").drop("content_json")


@GRAPH.add("node_depths", "SELECT skeleton_id, count(*) AS nodes, max(depth) AS deepest FROM (SELECT DISTINCT id, skeleton_id, depth FROM hti_nodes) WHERE skeleton_id <> '' GROUP BY skeleton_id")
def node_depths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hti_nodes").where("skeleton_id <> ''").select("id", "skeleton_id", "depth").distinct()
    return rows.groupBy("skeleton_id").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("deepest"))


@GRAPH.add("node_kinds", """SELECT node_kind, count(*) AS nodes FROM (SELECT id, CASE WHEN starts_with(id, 'kv_secret:') THEN 'kv_secret' WHEN starts_with(id, 'k8s_secret:') THEN 'k8s_secret' WHEN starts_with(id, 'kv_data:') THEN 'kv_data_source'
      WHEN starts_with(id, 'config:') THEN 'config_file' WHEN starts_with(id, 'endpoint:') THEN 'external_endpoint' WHEN starts_with(id, 'config_prop:') THEN 'config_property'
      WHEN id LIKE '%.tf' THEN 'terraform_file' WHEN id LIKE '%.yaml' OR id LIKE '%.yml' THEN 'yaml_file' ELSE 'entity' END AS node_kind FROM (SELECT DISTINCT id FROM nodes)) GROUP BY 1""")
def node_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select("id").distinct().groupBy(node_kind(F.col("id")).alias("node_kind")).agg(F.count(F.lit(1)).alias("nodes"))
