"""Queries of the general data problems: references (1) and hierarchies (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.operators import hierarchy as H
from kelpie.operators import integrity as I
from kelpie.plans.registry import QuerySet
from kelpie.session import table

CORE = QuerySet()

_REFS_SQL = """
WITH refs AS (
  SELECT 'edges' AS ref_table, 'source' AS ref_field, CAST(id AS VARCHAR) AS row_id, source AS k, extracted_at AS ts FROM edges
  UNION SELECT 'edges', 'target', CAST(id AS VARCHAR), target, extracted_at FROM edges
  UNION SELECT 'hti_nodes', 'skeleton_id', id, skeleton_id, indexed_at FROM hti_nodes),
parents AS (
  SELECT 'edges' AS t, id, indexed_at, deleted_at FROM nodes
  UNION ALL SELECT 'hti_nodes', id, indexed_at, deleted_at FROM hti_skeletons),
state AS (
  SELECT r.ref_table, r.ref_field, r.row_id, r.ts, r.k,
         count(p.id) AS known, coalesce(bool_or(p.indexed_at <= r.ts), false) AS begun,
         coalesce(bool_or(p.indexed_at <= r.ts AND (p.deleted_at IS NULL OR p.deleted_at > r.ts)), false) AS live
  FROM refs r LEFT JOIN parents p ON p.t = r.ref_table AND p.id = r.k
  WHERE r.k IS NOT NULL AND r.k <> '' GROUP BY ALL)
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = table(spark, d, "edges"), table(spark, d, "nodes")
    tree, skeletons = table(spark, d, "hti_nodes"), table(spark, d, "hti_skeletons")
    refs = I.references(edges, "edges", "source", "id", "extracted_at").unionByName(I.references(edges, "edges", "target", "id", "extracted_at"))
    of_edges = I.orphans(refs, I.lifetimes(nodes, "id", "indexed_at", "deleted_at"))
    of_trees = I.orphans(I.references(tree, "hti_nodes", "skeleton_id", "id", "indexed_at"), I.lifetimes(skeletons, "id", "indexed_at", "deleted_at"))
    return of_edges.unionByName(of_trees)


@CORE.add("p1_found", _REFS_SQL + "SELECT ref_table, ref_field, row_id, strftime(ts, '%Y-%m') AS period FROM state WHERE NOT live")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_field", "row_id", "period")


@CORE.add(
    "p1_report",
    _REFS_SQL
    + """SELECT ref_table, ref_field, strftime(ts, '%Y-%m') AS period,
    CASE WHEN known = 0 THEN 'missing' WHEN ts IS NULL THEN 'undated' WHEN begun THEN 'deleted' ELSE 'late' END AS status, count(*) AS orphans
    FROM state WHERE NOT live GROUP BY ALL""",
)
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return I.report(_orphans(spark, d))


_LINKS_SQL = """
WITH RECURSIVE links AS (
  SELECT edge_type, source AS node, min(target) AS parent FROM edges
  WHERE edge_type IN ('DEPENDS_ON', 'OVERRIDES_FOR_ENV') AND source <> '' AND target <> '' GROUP BY ALL),
named AS (SELECT * FROM edges WHERE edge_type IN ('DEPENDS_ON', 'OVERRIDES_FOR_ENV') AND source <> '' AND target <> ''),
ids AS (SELECT edge_type, source AS node FROM named UNION SELECT edge_type, target FROM named),
walk AS (
  SELECT edge_type, node, node AS cur, 0 AS hops, [node] AS path FROM ids
  UNION ALL
  SELECT w.edge_type, w.node, l.parent, w.hops + 1, list_append(w.path, l.parent)
  FROM walk w JOIN links l ON l.edge_type = w.edge_type AND l.node = w.cur
  WHERE NOT list_contains(w.path[:-2], w.cur)),
ends AS (SELECT *, row_number() OVER (PARTITION BY edge_type, node ORDER BY hops DESC) AS rn FROM walk),
tail AS (SELECT *, list_position(path, path[-1]) AS p FROM ends WHERE rn = 1)
"""


def _tree(spark: SparkSession, d: str, paths: bool) -> DataFrame:
    edges = table(spark, d, "edges").where(F.col("edge_type").isin("DEPENDS_ON", "OVERRIDES_FOR_ENV"))
    return H.hierarchy(H.links(edges), paths)


@CORE.add(
    "p4_found",
    _LINKS_SQL
    + """SELECT edge_type, node AS node_id,
    CASE WHEN p < len(path) THEN list_min(path[p:]) ELSE cur END AS root_id,
    CAST(CASE WHEN p = len(path) THEN hops WHEN list_contains(path[p:], node) THEN -1 ELSE -2 END AS INT) AS depth FROM tail""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, False).select(F.col("kind").alias("edge_type"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


@CORE.add(
    "p4_paths",
    _LINKS_SQL
    + """SELECT edge_type, node AS node_id, CASE WHEN p < len(path) THEN list_min(path[p:]) ELSE cur END AS root_id,
    CASE WHEN p = len(path) THEN array_to_string(list_reverse(path), ' > ') END AS path FROM tail""",
)
def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, True).select(
        F.col("kind").alias("edge_type"), F.col("node").alias("node_id"), F.col("root").alias("root_id"),
        F.when(F.col("path").isNotNull(), F.array_join("path", " > ")).alias("path"),
    )


@CORE.add(
    "p4_descendants",
    _LINKS_SQL
    + """SELECT w.edge_type, w.cur AS ancestor, w.node AS descendant, w.hops AS distance
    FROM walk w JOIN tail t ON t.edge_type = w.edge_type AND t.node = w.node WHERE t.p = len(t.path) AND w.hops > 0""",
)
def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(_tree(spark, d, True)).withColumnRenamed("kind", "edge_type")
