"""Parent-child links to full hierarchies.

Method: a weighted disjoint-set forest. Every node keeps the farthest ancestor known so
far and its offset to it. Nodes that have no children wait until the end. The others' links
first combine inside each partition; the partitions' forests then merge by rounds in which
each unfinished pointer takes over the pointer it rests on, so that the reach at least
doubles. What a round no longer brings nearer to a root ends in a cycle, found by the same
doubling on the bare links. Roots and offsets come first; paths are then put together from
the indexed parents, in segments that double.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators.skew import split_join
from kelpie.session import materialize, release

_POINTER = "kind string, node string, up string, hops int"


def links(edges: DataFrame, child: str = "source", parent: str = "target", kind: str = "edge_type") -> DataFrame:
    """One link (kind, node, parent) for each child; ``parent`` is null for nodes that are only parents.

    Null or empty ends make no link, repeated links count once. A child with several
    parents keeps the smallest one, so that every node has one place; the parents whose
    links are dropped this way stay nodes.
    """
    whole = edges.where((F.col(child) != "") & (F.col(parent) != "")).select(F.col(kind).alias("kind"), F.col(child).alias("node"), F.col(parent).alias("parent"))
    ends = whole.unionByName(whole.select("kind", F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    return ends.groupBy("kind", "node").agg(F.min("parent").alias("parent"))


def dropped(edges: DataFrame, kept: DataFrame, child: str = "source", parent: str = "target", kind: str = "edge_type") -> DataFrame:
    """The links of ``edges`` that ``links`` left out, as their child has a smaller parent: kind, node, parent."""
    every = edges.where((F.col(child) != "") & (F.col(parent) != "")).select(F.col(kind).alias("kind"), F.col(child).alias("node"), F.col(parent).alias("parent")).distinct()
    return every.join(kept.where("parent IS NOT NULL"), ["kind", "node", "parent"], "left_anti")


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weighted forest over the links of one batch: each node's farthest ancestor in it, by doubling on places.

    Nodes on a cycle inside the batch keep their bare links.
    """
    for rows in batches:
        own = pd.MultiIndex.from_frame(rows[["kind", "node"]])
        start = own.get_indexer(pd.MultiIndex.from_arrays([rows["kind"], rows["parent"]]))
        to, hops, here = start.copy(), np.ones(len(rows), np.int64), np.arange(len(rows))
        at = np.where(start < 0, here, start)  # a node whose parent is not here is a local root
        steps = np.where(start < 0, 0, 1)
        for _ in range(len(rows).bit_length()):
            steps, at = steps + steps[at], at[at]
        looped = start[at] >= 0  # such a walk never leaves the batch: it ends in a cycle
        to = np.where(looped, here, at)
        hops = np.where(looped, 0, steps)
        yield pd.DataFrame({"kind": rows["kind"], "node": rows["node"], "up": rows["parent"].to_numpy()[to], "hops": (hops + 1).astype(np.int32)})


def hierarchy(parents: DataFrame, paths: bool = False) -> DataFrame:
    """``kind, node, root, depth`` and, if asked for, ``path`` (root first) of every node.

    ``parents`` is the result of ``links``. The root has depth 0. A node on a cycle has
    depth -1, one whose ancestors end in a cycle -2; their root is the smallest id on the
    cycle and their path is null. A link to itself is a cycle of one. An empty table gives
    an empty result.
    """
    base = materialize(parents, "links")
    most = base.count()
    inner = base.where("parent IS NOT NULL").select("kind", F.col("parent").alias("node")).distinct()
    held = materialize(base.join(inner, ["kind", "node"]), "inner")
    roots = held.where("parent IS NULL").select("kind", "node", F.col("node").alias("root"), F.lit(0).alias("depth"))
    placed, open_ = _roots(held.where("parent IS NOT NULL"), roots, most)
    tree = roots.unionByName(placed)
    if not open_.isEmpty():
        looped = materialize(_cycles(held.join(open_.select("kind", "node"), ["kind", "node"], "left_semi"), most), "looped")
        tree = tree.unionByName(looped)
    if paths:
        tree = _paths(tree, held, most)
    # nodes without children: one link below their parent
    leaves = base.where("parent IS NOT NULL").join(inner, ["kind", "node"], "left_anti")
    above = tree.select("kind", F.col("node").alias("parent"), "root", F.when(F.col("depth") < 0, -2).otherwise(F.col("depth") + 1).alias("depth"), *(["path"] if paths else []))
    below = split_join(leaves, above, ["kind", "parent"], ["node"], rows=most)
    alone = base.where("parent IS NULL").join(inner, ["kind", "node"], "left_anti").select("kind", "node", F.col("node").alias("root"), F.lit(0).alias("depth"))
    if paths:
        below, alone = below.withColumn("path", F.concat("path", F.array("node"))), alone.withColumn("path", F.array("node"))
    return tree.unionByName(below.select(*tree.columns)).unionByName(alone)


def _roots(linked: DataFrame, roots: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(nodes placed below a root with their depth, pointers that never reach one)."""
    state = materialize(linked.mapInPandas(_combine, _POINTER), "forest")
    finished, before = [], None
    ends = roots.select("kind", F.col("node").alias("up"), F.col("root").alias("up2"), F.lit(0).alias("hops2"), F.lit(True).alias("done"))
    while True:
        # a pointer may rest on a root, on a node placed in an earlier round, or on another unfinished pointer
        known = [ends, *(p.select("kind", F.col("node").alias("up"), F.col("root").alias("up2"), F.col("depth").alias("hops2"), F.lit(True).alias("done")) for p in finished)]
        known.append(state.select("kind", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.lit(False).alias("done")))
        step = split_join(state, reduce(DataFrame.unionByName, known), ["kind", "up"], ["node"], rows=most)
        step = step.select("kind", "node", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops"), "done")
        following = materialize(step, "forest")
        state = following.where("NOT done").drop("done")
        finished.append(following.where("done").select("kind", "node", F.col("up").alias("root"), F.col("hops").alias("depth")))
        left = state.count()
        if left in (0, before):
            return reduce(DataFrame.unionByName, finished), state
        before = left


def _cycles(rest: DataFrame, most: int) -> DataFrame:
    """Nodes all of whose links end in cycles.

    A jump longer than the number of nodes ends on a cycle, and the smallest id met by one
    that starts there is the cycle's.
    """
    jump = materialize(rest.select("kind", "node", F.col("parent").alias("to"), F.least("node", "parent").alias("low")), "jump")
    for _ in range((jump.count().bit_length() + 1) // 2):
        following = jump
        for _ in range(2):
            other = following.select("kind", F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
            following = split_join(following, other, ["kind", "to"], ["node"], rows=most).select("kind", "node", F.col("to2").alias("to"), F.least("low", "low2").alias("low"))
        following = materialize(following, "jump")
        release(jump)
        jump = following
    on = jump.select("kind", F.col("to").alias("node")).distinct()
    lowest = jump.join(on, ["kind", "node"]).select("kind", F.col("node").alias("to"), F.col("low").alias("root"))
    member = on.withColumn("on_cycle", F.lit(True))
    return (
        jump.select("kind", "node", "to").join(lowest, ["kind", "to"]).join(member, ["kind", "node"], "left")
        .select("kind", "node", "root", F.when(F.col("on_cycle"), -1).otherwise(-2).alias("depth"))
    )


def _paths(tree: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """``tree`` with ``path``: segments of ancestors, nearest first, that double until they reach the root."""
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    up = held.select("kind", "node", F.col("parent").alias("above"))
    part = tree.where("depth >= 0").join(up, ["kind", "node"], "left").select("kind", "node", "root", "depth", F.when(F.col("depth") == 0, F.array().cast("array<string>")).otherwise(F.array("above")).alias("path"))
    part, finished = materialize(part, "segments"), []
    while True:
        whole = F.size("path") == F.col("depth")
        finished.append(part.where(whole))
        if 2 ** (len(finished) - 1) >= deepest:
            break
        open_ = part.where(~whole).withColumn("far", F.element_at("path", -1))
        known = reduce(DataFrame.unionByName, [*finished, part.where(~whole)]).select("kind", F.col("node").alias("far"), F.col("path").alias("beyond"))
        step = split_join(open_, known, ["kind", "far"], ["node"], rows=most)
        part = materialize(step.select("kind", "node", "root", "depth", F.concat("path", "beyond").alias("path")), "segments")
    done = reduce(DataFrame.unionByName, finished).withColumn("path", F.reverse(F.concat(F.array("node"), "path")))
    return done.unionByName(tree.where("depth < 0").withColumn("path", F.lit(None).cast("array<string>")))


def descendants(tree: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of the placed nodes; needs ``path``."""
    return tree.where("path IS NOT NULL").select(
        "kind", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("level", "ancestor")
    ).where(F.col("level") < F.col("depth")).select("kind", "ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))
