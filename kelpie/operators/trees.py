"""Nested documents as trees: flattening, incremental index, pages and look-up of nodes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.operators.skew import hot_keys, replicated, salted

NODES = "node_path string, depth int, kind string, preview string, content_json string"


def _walk(document: object, deepest: int | None, long_list: int | None, preview: int | None) -> Iterator[tuple]:
    """Every node in the document's order, without recursion: path, depth, kind, preview, content."""
    waiting = [(document, "root", 0, True)]
    while waiting:
        node, path, depth, further = waiting.pop()
        kind = {type(None): "null", dict: "object", list: "array"}.get(type(node), type(node).__name__)
        yield path, depth, kind, None if kind in ("null", "object", "array") else str(node)[:preview], json.dumps(node, default=str)
        if not further or deepest is not None and depth >= deepest:
            continue
        if isinstance(node, dict):
            waiting += [(v, f"{path}.{k}", depth + 1, True) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            thin = long_list is not None and len(node) > long_list
            waiting += [(node[i], f"{path}[{i}]", depth + 1, not thin or i < 3 or i == len(node) - 1) for i in reversed(range(len(node)))]


def _parsed(text: str | None, yaml: bool) -> list:
    if not text or not text.strip():
        return []
    try:
        if yaml:
            import yaml as Y

            return [d for d in Y.load_all(text, Loader=getattr(Y, "CSafeLoader", Y.SafeLoader)) if d is not None]
        return [json.loads(text)]
    except Exception:  # an unreadable document has no nodes
        return []


def flatten(df: DataFrame, key: str, text: str, yaml: bool = False, deepest: int | None = None, long_list: int | None = None, preview: int | None = None) -> DataFrame:
    """``key, document, node_path, depth, kind, preview, content_json`` of every node of every document.

    Paths are ``root``, ``.key`` and ``[i]``; ``document`` numbers the documents of a YAML
    stream from 0. Everything comes out whole; on request, nodes deeper than ``deepest`` are
    left out, of lists with more than ``long_list`` items only the first three and the last are
    walked further (the others have a node of their own), and previews end after ``preview``
    characters. Empty, null and unreadable texts have no nodes.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nodes = ((k, i, *n) for k, t in zip(b["_key"], b["_text"]) for i, d in enumerate(_parsed(t, yaml)) for n in _walk(d, deepest, long_list, preview))
            while part := list(islice(nodes, 10_000)):
                yield pd.DataFrame(part, columns=[key, "document", "node_path", "depth", "kind", "preview", "content_json"])

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, document int, {NODES}")


def outdated(found: DataFrame, indexed: DataFrame, key: str = "id", mtime: str = "mtime_epoch") -> DataFrame:
    """Rows of ``found`` that are new or younger than what is indexed."""
    known = indexed.groupBy(key).agg(F.max(mtime).alias("_known"))
    return found.join(known, key, "left").where(F.col("_known").isNull() | (F.col(mtime) > F.col("_known"))).drop("_known")


def pages(skeletons: DataFrame, per: list[str], most: int = 50) -> DataFrame:
    """The ``most`` youngest rows of each group with the number of all its rows; ties go to the smaller id."""
    group = Window.partitionBy(*per)
    latest = skeletons.withColumn("n", F.row_number().over(group.orderBy(F.desc("indexed_at"), F.asc("id")))).where(F.col("n") <= most)
    totals = skeletons.groupBy(*per).agg(F.count(F.lit(1)).alias("total_found"))
    return latest.join(totals, per)


def fetch(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (``skeleton_id, wanted``) with its node: the exact path, else the shallowest that begins with it.

    ``found`` is exact, prefix or missing. Nodes of the wanted skeletons only are looked at;
    the best node of each request is kept as rows combine, so no group is gathered.
    """
    distinct = nodes.where("skeleton_id IS NOT NULL AND skeleton_id <> ''").select("skeleton_id", "node_path", "depth", "content_json")
    hot = hot_keys(distinct, "skeleton_id")
    spread = salted(distinct, hot, "skeleton_id", "node_path")
    near = spread.join(replicated(requests, hot, "skeleton_id"), ["skeleton_id", "salt"]).where(F.startswith("node_path", F.col("wanted")))
    order = F.struct((F.col("node_path") != F.col("wanted")).alias("loose"), "depth", "node_path", "content_json")
    best = near.groupBy("skeleton_id", "wanted").agg(F.min(order).alias("b"))
    out = requests.join(best, ["skeleton_id", "wanted"], "left")
    found = F.when(F.col("b").isNull(), "missing").when(F.col("b.loose"), "prefix").otherwise("exact")
    return out.select("skeleton_id", "wanted", found.alias("found"), "b.node_path", "b.depth", "b.content_json")
