"""Bounded traversal, entity profiles, change impact and secret flow over an edge table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.names import node_kind, risk
from kelpie.functions.text import fuzzy_match
from kelpie.operators.skew import hot_keys, replicated, salted, split_join
from kelpie.session import materialize, release, spread

_COLUMNS = ["source", "target", "edge_type", "file", "repo", "branch"]


def linked(edges: DataFrame) -> DataFrame:
    """Edges with both ends, each delivered row once."""
    return edges.where((F.col("source") != "") & (F.col("target") != "")).select("id", *_COLUMNS).dropDuplicates(["id"])


def on_branch(branch: str | None, shared: Column) -> Column:
    """The branch itself or what ``shared`` says holds for all branches; everything without a branch."""
    return F.lit(True) if branch is None else (F.col("branch") == branch) | shared


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
    """``seed, node, hops``: every node within ``depth`` links of each seed, with the fewest links.

    All seeds travel together, level by level; each level is one join of the frontier with
    the edges and one anti-join with what is visited. ``direction`` is out, in or both. A
    frontier without news ends the search. Null seeds are dropped, repeated ones count once.
    ``seeds`` has ``seed``, and ``node`` where a search starts at nodes other than its own name.
    """
    ways = []
    if direction in ("out", "both"):
        ways.append(edges.select(F.col("source").alias("node"), F.col("target").alias("next")))
    if direction in ("in", "both"):
        ways.append(edges.select(F.col("target").alias("node"), F.col("source").alias("next")))
    if not ways:
        raise ValueError("direction is out, in or both")
    steps = materialize((ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])).distinct(), "steps")
    start = F.col("node" if "node" in seeds.columns else "seed").alias("node")
    visited = materialize(seeds.where("seed IS NOT NULL").select("seed", start, F.lit(0).alias("hops")).distinct(), "visited")
    for level in range(depth):
        frontier = visited.where(F.col("hops") == level)
        fresh = split_join(steps, frontier, ["node"], ["next"]).select("seed", F.col("next").alias("node")).distinct().join(visited.select("seed", "node"), ["seed", "node"], "left_anti")
        following = materialize(visited.unionByName(fresh.withColumn("hops", F.lit(level + 1))), "visited")
        grew = not following.where(F.col("hops") == level + 1).isEmpty()
        release(visited)
        visited = following
        if not grew:
            break
    return visited


def described(visited: DataFrame, nodes: DataFrame) -> DataFrame:
    """Visited nodes with type, file and repo; a node without a row is unknown.

    A node with several rows takes the one registered last.
    """
    latest = nodes.groupBy("id").agg(F.max_by(F.struct("node_type", "file", "repo"), F.struct("indexed_at", F.coalesce("file", F.lit("")), F.coalesce("node_type", F.lit("")))).alias("n"))
    return visited.join(latest, visited["node"] == latest["id"], "left").select(
        *visited.columns, F.coalesce("n.node_type", F.when(F.col("id").isNull(), "unknown")).alias("node_type"), F.coalesce("n.file", F.lit("")).alias("file"), F.coalesce("n.repo", F.lit("")).alias("repo")
    )


def traversed_edges(edges: DataFrame, visited: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """The edges walked from each seed, one for each (source, target, type): that of the smallest id."""
    inner = visited.where(F.col("hops") < depth).select("seed", "node")
    rows = []
    if direction in ("out", "both"):
        rows.append(edges.join(inner, edges["source"] == inner["node"]).drop("node"))
    if direction in ("in", "both"):
        rows.append(edges.join(inner, edges["target"] == inner["node"]).drop("node"))
    walked = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    kept = walked.groupBy("seed", "source", "target", "edge_type").agg(F.min_by(F.struct("file", "repo", "branch"), "id").alias("e"))
    return kept.select("seed", "source", "target", "edge_type", "e.*")


def matching(nodes: DataFrame, name: str) -> DataFrame:
    """Ids equal to a name or loosely matching it."""
    return nodes.where((F.col("id") == name) | fuzzy_match(name, F.col("id"))).select(F.col("id").alias("seed")).distinct()


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda i: F.substr(text, i, F.lit(3))))


def resolve(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Each name with its exact id, else all ids that contain it; ``matches`` counts them (1 is a hit).

    A name without an exact id meets the ids that share its rarest three letters in a row,
    and ILIKE, whose wildcards a name may hold, decides. Only names that have no three
    letters in a row between wildcards are compared with every id.
    """
    ids = nodes.select("id").distinct()
    exact = names.join(ids, names["name"] == ids["id"]).select("name", "id")
    open_names = materialize(names.join(exact.select("name"), "name", "left_anti").where("name IS NOT NULL"), "names")
    contains = F.expr(r"id ILIKE concat('%', replace(name, '\\', '\\\\'), '%')")  # a backslash stands for itself
    letters = F.filter(F.flatten(F.transform(F.split(F.lower("name"), r"[%_\\]"), _grams)), lambda g: F.length(g) == 3)
    cut = open_names.distinct().select("name", letters.alias("grams"))
    asked = cut.select("name", F.explode("grams").alias("gram"))
    held = materialize(ids.select("id", F.explode(_grams(F.lower("id"))).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi"), "grams")
    counts = asked.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left").fillna(0, ["n"])
    rarest = counts.groupBy("name").agg(F.min(F.struct("n", "gram")).alias("g")).select("name", F.col("g.gram").alias("gram"))
    loose = split_join(held, open_names.join(rarest, "name"), ["gram"], ["id"]).where(contains).select("name", "id")
    short = open_names.join(cut.where(F.size("grams") == 0).select("name"), "name", "left_semi")
    if not short.isEmpty():
        loose = loose.unionByName(short.join(ids, contains).select("name", "id"))
    found = exact.unionByName(loose)
    counts = found.groupBy("name").agg(F.count(F.lit(1)).alias("matches"))
    return found.join(counts, "name")


def _short_grams(text: Column) -> Column:
    """Every one, two and three letters in a row."""
    def cut(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(cut(1), cut(2), cut(3)))


#: Bytes in which two texts must agree to share an anchor for certain: four grams of five bytes.
_STRETCH = 8


def _anchors(texts: DataFrame, column: str) -> DataFrame:
    """``column, gram``, each once for a text: of any eight bytes in a row of the text in lower case, one gram of five that they alone determine.

    Texts that share eight bytes share that gram, and a text has far fewer of them than
    letters. Texts under eight bytes have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = b.column("low").cast(pa.large_binary())
            size = np.asarray(pc.binary_length(low)).astype(np.int64)
            raw = np.frombuffer(b"".join(low.to_pylist()), np.uint8).astype(np.uint64)
            if len(raw) < _STRETCH:
                continue
            gram = sum(raw[i : len(raw) - 4 + i] << np.uint64(8 * i) for i in range(5)) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(32)
            least = np.minimum.reduce([gram[i : len(gram) - 3 + i] for i in range(4)])
            row = np.repeat(np.arange(b.num_rows), size)[: len(least)]
            inside = np.arange(len(least)) + _STRETCH <= np.cumsum(size)[row]
            row, least = row[inside], least[inside]
            order = np.lexsort((least, row))
            row, least = row[order], least[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
            yield pa.RecordBatch.from_arrays([b.column(column).take(pa.array(row[first])), pa.array(least[first].view(np.int64))], [column, "gram"])

    return spread(texts).select(column, F.lower(column).alias("low")).mapInArrow(run, f"`{column}` string, gram bigint")


def contained(short: DataFrame, long: DataFrame, a: str = "short", b: str = "long") -> DataFrame:
    """Pairs (``a``, ``b``) where the one text lies in the other, whatever the case.

    Each short text meets only the long ones that hold the rarest of its anchors, or of its
    letter sequences if it is too short for one; empty and null texts lie in none.
    """
    few = short.select(a).where(F.col(a) != "").distinct()
    many = long.select(b).where(F.col(b) != "").distinct()
    low = F.lower(a)
    brief = F.octet_length(low) < _STRETCH

    def met(asked: DataFrame, grams: DataFrame) -> DataFrame:
        held = materialize(grams.join(asked.select("gram").distinct(), "gram", "left_semi"), "grams")
        counts = asked.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left").fillna(0, ["n"])
        rarest = materialize(counts.groupBy(a).agg(F.min(F.struct("n", "gram")).alias("g")).select(a, F.col("g.gram").alias("gram"), "g.n"), "rarest")
        most = rarest.agg(F.max("n")).first()[0] or 0  # rows of the hottest key that is asked for
        return split_join(held, rarest.where("n > 0").drop("n"), ["gram"], [b], rows=most).where(F.contains(F.lower(b), F.lower(a))).select(a, b)

    found = met(_anchors(few.where(~brief), a), _anchors(many, b))
    if few.where(brief).isEmpty():
        return found
    asked = few.where(brief).select(a, F.explode(F.when(F.length(low) > 3, _grams(low)).otherwise(F.array(low))).alias("gram"))
    return found.unionByName(met(asked, many.select(b, F.explode(_short_grams(F.lower(b))).alias("gram"))))


def resolve_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """``name, status, found``: a known name that is equal, or the only one that holds the name or lies in it.

    ``names`` and ``known`` have ``name``. Status is exact, fuzzy, ambiguous or unknown; only
    the first two have a name found.
    """
    asked, there = names.where("name IS NOT NULL").select("name").distinct(), known.where("name IS NOT NULL").select(F.col("name").alias("found")).distinct()
    exact = asked.join(there, asked["name"] == there["found"]).select("name", F.lit("exact").alias("status"), "found")
    rest = materialize(asked.join(exact.select("name"), "name", "left_anti"), "names")
    loose = contained(rest, there, "name", "found").unionByName(contained(there, rest, "found", "name")).distinct()
    best = loose.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("found").alias("one"))
    status = F.when(F.col("n") == 1, "fuzzy").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return exact.unionByName(rest.join(best, "name", "left").select("name", status.alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("found")))


def catalogue(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Impact of names that are in no graph, by the catalogue: ``name, entities, files, services`` of the entries that hold the name.

    ``entities`` has ``id, node_type, file``. A name lies in an entry's id or file, whatever
    the case; entries equal in all three count once. Names that nothing holds have no row.
    """
    entries = entities.select("id", "node_type", "file").distinct()
    lies = materialize(contained(names, entries.select(F.explode(F.array("id", "file")).alias("text")), "name", "text"), "contained")
    held = [lies.join(entries, F.col("text") == F.col(c)).select("name", "id", "node_type", "file") for c in ("id", "file")]
    found = held[0].unionByName(held[1]).distinct()
    kind = F.lower(F.coalesce("node_type", F.lit("")))
    service = F.contains(kind, F.lit("service")) | F.contains(kind, F.lit("svc"))
    return found.groupBy("name").agg(
        F.count(F.lit(1)).alias("entities"), F.count_distinct(F.when(F.col("file") != "", F.col("file"))).alias("files"), F.count_distinct(F.when(service, F.col("id"))).alias("services")
    )


def entity_view(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``id, direction, other, edge_type, file`` of every link out of or into each asked entity (``id``), each once."""
    ids = asked.where("id IS NOT NULL").select("id").distinct()
    out = edges.select(F.col("source").alias("id"), F.lit("out").alias("direction"), F.col("target").alias("other"), "edge_type", "file")
    into = edges.select(F.col("target").alias("id"), F.lit("in").alias("direction"), F.col("source").alias("other"), "edge_type", "file")
    return out.unionByName(into).join(ids, "id", "left_semi").distinct()


def profiles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node: links out and in and the sorted set of files that mention it (its own and its links')."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("outbound"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("inbound"))
    files = (
        edges.select(F.explode(F.array("source", "target")).alias("id"), "file")
        .unionByName(nodes.select("id", "file")).where("file IS NOT NULL AND file <> ''").distinct()
        .groupBy("id").agg(F.count(F.lit(1)).alias("related_files"))
    )
    ids = nodes.select("id").distinct()
    return ids.join(out, "id", "left").join(into, "id", "left").join(files, "id", "left").fillna(0)


def impact(visited: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """One row for each seed: affected entities, files, services and environments, and the risk they make.

    Entities are visited nodes that are registered; services and environments are told by
    their type or id; files are those of the entities and of the edges walked.
    """
    known = described(visited, nodes).where("node_type <> 'unknown' OR node_type IS NULL")
    kind, name = F.lower(F.coalesce("node_type", F.lit(""))), F.lower("node")
    marked = known.withColumns({
        "is_service": F.contains(kind, F.lit("service")) | F.contains(name, F.lit("service")),
        "is_env": F.contains(kind, F.lit("environment")) | F.contains(name, F.lit("env")),
    })
    counts = marked.groupBy("seed").agg(
        F.count(F.lit(1)).alias("entities"), F.sum(F.col("is_service").cast("int")).alias("services"), F.sum(F.col("is_env").cast("int")).alias("environments"),
        F.coalesce(F.max(F.when(F.col("is_env"), F.contains(name, F.lit("prod")))), F.lit(False)).alias("prod"),
    )
    files = known.select("seed", "file").unionByName(traversed_edges_files(edges, visited, depth)).where("file <> ''").distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("files"))
    both = visited.select("seed").distinct().join(counts, "seed", "left").join(files, "seed", "left").fillna(0, ["entities", "services", "environments", "files"]).fillna(False, ["prod"])
    return _judged(both)


def _judged(counts: DataFrame) -> DataFrame:
    level = risk(F.col("prod"), F.col("services"), F.col("entities"), F.col("files"))
    summary = F.format_string("Impact of %s: risk %s, %d entities, %d files", F.col("seed"), F.upper(level), F.col("entities"), F.col("files"))
    return counts.withColumns({"risk_level": level, "summary": summary})


#: Of an item's number: bits of what it counts as, below the number of its text.
_MARKS = 5
_COUNTS = ("entities", "services", "environments", "prod", "files")


def _spans(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each of ``low`` on, ``size`` of them, one after the other."""
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _unions(starts: pa.Table, lists: pa.Table) -> pa.Table:
    """For each seed of a block: counts over the union of what lies around the nodes within one link of its starts.

    ``starts`` has ``seed, node, far, base``, ``lists`` each node's neighbours and itself (``near``) and
    the items around a node. What lies around a seed's base, the largest share of its union, is gathered
    once for all seeds with that base; each of them adds what is not in there.
    """
    whole = lambda t, c: pa.concat_arrays([pa.array([], t.schema.field(c).type), *t.column(c).chunks])
    number = lambda a: np.asarray(a).astype(np.int64)
    near, held = np.asarray(whole(lists, "near").to_numpy(zero_copy_only=False)).astype(bool), {}
    for link in (True, False):
        some = lists.filter(pa.array(near == link))
        some = some.take(pa.array(np.argsort(number(whole(some, "node")), kind="stable")))
        items = whole(some, "held")
        size = number(pc.list_value_length(items))
        held[link] = number(whole(some, "node")), np.cumsum(size) - size, size, number(items.flatten())
    (at, link_low, link_size, inner), (of, low, size, items) = held[True], held[False]

    def place(all_: np.ndarray, asked: np.ndarray) -> np.ndarray:
        i = np.searchsorted(all_, asked)
        return np.where((i < len(all_)) & (np.append(all_, -1)[i] == asked), i, -1)

    known, code = np.unique(items, return_inverse=True)
    marks = (known & ((1 << _MARKS) - 1)).astype(np.uint8)
    weights = (np.arange(1 << _MARKS)[:, None] >> np.arange(_MARKS)) & 1
    inner = place(of, inner)  # nodes that have nothing around them, in this part, are left out
    seeds = whole(starts, "seed").dictionary_encode()
    who, node, far, base = number(seeds.indices), number(whole(starts, "node")), np.asarray(whole(starts, "far").to_numpy(zero_copy_only=False)).astype(bool), number(whole(starts, "base"))
    order = np.lexsort((who, base, far))
    who, far, base, asked = who[order], far[order], base[order], place(at, node[order])
    as_start, as_inner = place(at, base), place(of, base)
    cuts = np.flatnonzero(np.append(True, who[1:] != who[:-1])).tolist() + [len(who)] if len(who) else [0]
    last = np.zeros(len(known), np.int64)
    met, walked = np.zeros(len(known), bool), np.zeros(len(of), bool)
    out, of_base = np.zeros((_MARKS, len(seeds.dictionary)), np.int64), np.zeros(_MARKS, np.int64)

    def around(nodes: np.ndarray) -> np.ndarray:
        return code[_spans(low[nodes], size[nodes])]

    def nodes_at(some: np.ndarray) -> np.ndarray:
        some = some[some >= 0]
        nodes = inner[_spans(link_low[some], link_size[some])]
        return nodes[nodes >= 0]

    before = None
    for i, j in zip(cuts, cuts[1:]):
        if before != (far[i], base[i]):
            before = far[i], base[i]
            met[:], walked[:] = False, False
            nodes = nodes_at(as_start[i : i + 1]) if far[i] else as_inner[i : i + 1][as_inner[i : i + 1] >= 0]
            walked[nodes] = True
            more = around(nodes)
            met[more] = True
            more = _once(more, last)
            of_base = np.bincount(marks[more], minlength=1 << _MARKS) @ weights
        nodes = nodes_at(asked[i:j])
        more = around(nodes[~walked[nodes]])
        more = _once(more[~met[more]], last)
        out[:, who[i]] = of_base + np.bincount(marks[more], minlength=1 << _MARKS) @ weights
    return pa.table({"seed": seeds.dictionary, **{c: pa.array(x) for c, x in zip(_COUNTS, out)}})


def _once(numbers: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each of ``numbers`` once; ``last`` is room for as many as there can be."""
    rows = np.arange(len(numbers))
    last[numbers] = rows
    return numbers[last[numbers] == rows]


def impact_of_many(edges: DataFrame, starts: DataFrame, nodes: DataFrame, block_rows: int = 100_000, part_rows: int = 8_000_000) -> DataFrame:
    """``impact`` of what lies within two links of each seed, for so many seeds that no visited pair is to be listed, not even within one link.

    What counts for a seed (registered nodes with their marks, and files) are items that lie
    around nodes, stored once in lists. Each block of seeds gets the links of its starts and
    the lists at their ends, and counts each seed's union there in an array. Seeds meet where
    they share their largest share, a hub or all around one, which is gathered once. Items are cut
    into parts by their hash, so that no task holds more than some ``part_rows`` of them.
    A node counts as registered if it has a row, whatever its type.
    """
    asked = materialize(starts.where("seed IS NOT NULL").select("seed", F.col("node").alias("start")).distinct(), "starts")
    texts = reduce(DataFrame.unionByName, [
        edges.select(F.explode(F.array("source", "target", "file")).alias("text")), nodes.select(F.explode(F.array("id", "file")).alias("text")), asked.select(F.col("start").alias("text")),
    ])
    ids = materialize(texts.where("text IS NOT NULL").distinct().withColumn("n", F.monotonically_increasing_id()), "ids")

    def coded(df: DataFrame, column: str, name: str, how: str = "inner") -> DataFrame:
        return df.join(ids.select(F.col("text").alias(column), F.col("n").alias(name)), column, how).drop(column)

    def item(number: str, marks: Column | int) -> Column:
        return F.shiftleft(number, _MARKS).bitwiseOR(marks if isinstance(marks, Column) else F.lit(marks))

    named = F.when(F.col("file") != "", F.col("file")).alias("file")
    known = described(nodes.where("id IS NOT NULL").select(F.col("id").alias("node")).distinct(), nodes)
    kind, name = F.lower(F.coalesce("node_type", F.lit(""))), F.lower("node")
    env = F.contains(kind, F.lit("environment")) | F.contains(name, F.lit("env"))
    bits = [(F.contains(kind, F.lit("service")) | F.contains(name, F.lit("service")), 2), (env, 4), (env & F.contains(name, F.lit("prod")), 8)]
    marks = reduce(lambda x, y: x + y, [F.when(c, v).otherwise(0) for c, v in bits], F.lit(1)).cast("bigint")
    marked = coded(coded(known.select("node", marks.alias("marks"), named), "node", "next"), "file", "f", "left")
    marked = marked.select("next", F.array_compact(F.array(item("next", F.col("marks")), item("f", 16))).alias("items"))
    links = materialize(coded(coded(coded(edges.select("source", "target", named), "source", "s"), "target", "t"), "file", "f", "left"), "links")
    first = materialize(coded(asked, "start", "node", "left").select("seed", F.coalesce("node", F.lit(-1)).alias("node")), "first")
    ends = links.select(F.col("s").alias("node"), F.col("t").alias("next"))
    selves = ends.select(F.explode(F.array("node", "next")).alias("node")).unionByName(first.select("node").where("node >= 0")).select("node", F.col("node").alias("next"))
    steps = materialize(ends.unionByName(ends.select(F.col("next").alias("node"), F.col("node").alias("next"))).unionByName(selves).distinct(), "steps")
    told = links.where("f IS NOT NULL").select(F.explode(F.array("s", "t")).alias("node"), item("f", 16).alias("item"))
    around = steps.join(marked, "next").select("node", F.explode("items").alias("item")).unionByName(told).distinct()
    parts = steps.count() * 3 // part_rows + 1  # a node and a file for each step, a file for each link
    lists = materialize(around.groupBy("node", F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part")).agg(F.collect_list("item").alias("held")), "lists")

    size = lists.groupBy(F.col("node").alias("next")).agg(F.sum(F.size("held")).alias("w"))
    reached = steps.join(first.select("node").distinct(), "node", "left_semi").join(size, "next")
    sizes = reached.groupBy("node").agg(F.sum("w").alias("all"), F.max(F.struct("w", "next")).alias("top"))
    bases = first.join(sizes, "node", "left").groupBy("seed").agg(F.max(F.struct("all", "node")).alias("wide"), F.max("top").alias("top"), F.count(F.lit(1)).alias("rows"))
    far = F.coalesce(F.col("wide.all") >= 2 * F.col("top.w"), F.lit(False))
    bases = materialize(bases.select("seed", far.alias("far"), F.coalesce(F.when(far, F.col("wide.node")).otherwise(F.col("top.next")), F.lit(-1)).alias("base"), "rows"), "bases")
    cores = edges.sparkSession.sparkContext.defaultParallelism
    rows = min(block_rows, first.count() // (4 * cores) + 1)
    blocks = first.count() // rows + 1
    hot = bases.groupBy("far", "base").agg(F.sum("rows").alias("n")).where(F.col("n") > rows)
    salt = F.coalesce(F.pmod(F.xxhash64("seed"), F.ceil(F.col("n") / rows)), F.lit(0).cast("bigint"))
    placed = bases.join(hot, ["far", "base"], "left").select("seed", "far", "base", F.pmod(F.xxhash64("far", "base", salt), F.lit(blocks)).alias("block"))
    left = materialize(first.join(placed, "seed"), "asked")
    reach = left.select(F.col("block").alias("to"), F.col("node").alias("at")).distinct().join(steps.withColumnRenamed("node", "at"), "at")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part")
    linked_to = reach.groupBy("to", "at").agg(F.collect_list("next").alias("held")).select("to", every, F.lit(True).alias("near"), F.col("at").alias("node"), "held")
    held = reach.select("to", F.col("next").alias("node")).distinct().join(lists, "node").select("to", "part", F.lit(False).alias("near"), "node", "held")
    right = linked_to.unionByName(held).repartition(blocks * parts, "to", "part")
    left = left.select("*", every).repartition(blocks * parts, "block", "part")
    counted = left.groupBy("block", "part").cogroup(right.groupBy("to", "part")).applyInArrow(_unions, "seed string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return _judged(counted.groupBy("seed").agg(*[F.sum(c).alias(c) for c in _COUNTS]).withColumn("prod", F.col("prod") > 0))


def _masks(starts: pa.Table, lists: pa.Table) -> pa.Table:
    """For each seed of a block and each list at one of its nodes: bits of the items that the seed is not to skip and has in no list before."""
    whole = lambda t, c: pa.concat_arrays([pa.array([], t.schema.field(c).type), *t.column(c).chunks])
    names, place = whole(lists, "node").dictionary_encode(), whole(lists, "part")
    node = np.asarray(names.indices).astype(np.int64)
    order = np.argsort(node, kind="stable")
    items = whole(lists, "items").take(pa.array(order))
    size = np.asarray(pc.list_value_length(items)).astype(np.int64)
    known, code = np.unique(np.asarray(items.flatten()).astype(np.int64), return_inverse=True)
    words = (size + 63) // 64  # lists begin at whole words; between them is a last item that every seed has
    at = np.concatenate([[0], np.cumsum(words)])
    padded = np.full(at[-1] * 64, len(known), np.int32)
    padded[np.repeat(at[:-1] * 64 - (np.cumsum(size) - size), size) + np.arange(len(code))] = code
    seeds = whole(starts, "seed").dictionary_encode()
    code = np.asarray(seeds.indices).astype(np.int64)
    by_seed = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[by_seed], np.arange(len(seeds.dictionary) + 1))
    asked = np.asarray(pc.fill_null(pc.index_in(whole(starts, "node"), value_set=names.dictionary), -1)).astype(np.int64)[by_seed]
    low, high = np.searchsorted(node[order], asked), np.searchsorted(node[order], asked, "right")
    skip = np.asarray(pc.fill_null(pc.index_in(whole(starts, "skip"), value_set=pa.array(known)), len(known))).astype(np.int64)[by_seed]
    met = np.zeros(len(known) + 1, bool)
    met[-1] = True
    bits, begin, end = [np.zeros(0, np.int64)], (at[low] * 64).tolist(), (at[high] * 64).tolist()
    for q in range(len(seeds.dictionary)):
        rows = range(cuts[q], cuts[q + 1])
        met[skip[rows.start : rows.stop]] = True
        for j in rows:
            if begin[j] < end[j]:
                near = padded[begin[j] : end[j]]
                bits.append(np.packbits(~met[near], bitorder="little").view(np.int64))
                met[near] = True
        for j in rows:
            met[padded[begin[j] : end[j]]] = False
        met[skip[rows.start : rows.stop]] = False
        met[-1] = True
    bits, many = np.concatenate(bits), high - low
    row = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    width = words[row]
    some = np.bitwise_or.reduceat(bits, np.cumsum(width) - width) != 0 if len(row) else np.zeros(0, bool)
    bits, row, width = bits[np.repeat(some, width)], row[some], width[some]
    of = pa.array(order[row])
    mask = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(bits))
    return pa.table({"seed": seeds.dictionary.take(pa.array(np.repeat(code[by_seed], many)[some])), "node": whole(lists, "node").take(of), "part": place.take(of), "mask": mask})


def around_each(starts: DataFrame, around: DataFrame, block_rows: int = 100_000, list_rows: int = 512, task_rows: int = 1_000_000) -> DataFrame:
    """``seed`` and the fields of ``what``: every item around one of the seed's nodes, once for each seed.

    ``starts`` has ``seed, node, skip``: at which nodes a seed looks, and items that it leaves
    out; either may be null. ``around`` has ``node, item, what``, each (node, item) once. What
    lies around a node is stored once, in lists of some ``list_rows``; blocks of seeds learn the
    items' numbers and say with one bit an item which of a list a seed takes. Rows for a seed
    and an item arise only in the end, from list and bits, and are not shuffled or compared.
    """
    hot = around.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > list_rows)
    part = F.coalesce(F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / list_rows)), F.lit(0).cast("bigint")).alias("part")
    lists = materialize(around.join(hot, "node", "left").groupBy("node", part).agg(F.sort_array(F.collect_list(F.struct("item", "what"))).alias("held")), "lists")
    cores = starts.sparkSession.sparkContext.defaultParallelism
    asked = materialize(starts, "asked")
    blocks = max(cores, asked.count() // block_rows + 1)
    left = asked.withColumn("block", F.pmod(F.xxhash64("seed"), F.lit(blocks)))
    right = lists.select("node", "part", F.col("held.item").alias("items")).join(left.where("node IS NOT NULL").select("node", F.col("block").alias("for")).distinct(), "node")
    masks = materialize(left.groupBy("block").cogroup(right.groupBy("for")).applyInArrow(_masks, "seed string, node string, part bigint, mask array<bigint>"), "masks")
    rows = masks.agg(F.sum(F.size("mask"))).first()[0] or 0
    tasks = min(100_000, max(2 * cores, 64 * rows // task_rows + 1))  # by the rows that come out; the tables that meet are small
    keys = ["node", "part"]
    hot = hot_keys(masks, keys, max(1, task_rows // list_rows))
    met = salted(masks, hot, keys, "seed").repartition(tasks, *keys, "salt").join(replicated(lists, hot, keys).repartition(tasks, *keys, "salt"), [*keys, "salt"])
    taken = F.expr("(shiftright(mask[shiftright(pos, 6)], pos & 63) & 1) = 1")
    return met.select("seed", "mask", F.posexplode("held")).where(taken).select("seed", "col.what.*")


def neighbourhoods(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, **sizes: int) -> DataFrame:
    """``described(traverse(edges, seeds, 2), nodes)`` for so many seeds that the visited pairs are not to be shuffled."""
    inner = traverse(edges, seeds, 1)
    ways = edges.select(F.col("source").alias("node"), F.col("target").alias("next")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("next"))).distinct()
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    about = materialize(described(ends, nodes).withColumn("item", F.monotonically_increasing_id()), "about")
    around = ways.join(about.select(F.col("node").alias("next"), "item", F.struct("node", "node_type", "file", "repo").alias("what")), "next").drop("next")
    starts = inner.join(about.select("node", F.col("item").alias("skip")), "node", "left").select("seed", F.when(F.col("hops") == 1, F.col("node")).alias("node"), "skip")
    far = around_each(starts, around, **sizes).withColumn("hops", F.lit(2))
    return described(inner, nodes).unionByName(far)


def walked_by_each(edges: DataFrame, seeds: DataFrame, **sizes: int) -> DataFrame:
    """``seed, source, target, edge_type`` of ``traversed_edges`` within two links, for so many seeds that the walked pairs are not to be shuffled."""
    inner = traverse(edges, seeds, 1)
    links = materialize(edges.select("source", "target", "edge_type").distinct().withColumn("item", F.monotonically_increasing_id()), "links")
    around = links.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node"), "item", F.struct("source", "target", "edge_type").alias("what"))
    return around_each(inner.select("seed", "node", F.lit(None).cast("bigint").alias("skip")), around, **sizes)


def traversed_edges_files(edges: DataFrame, visited: DataFrame, depth: int) -> DataFrame:
    inner = visited.where(F.col("hops") < depth).select("seed", "node")
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"), "file").distinct()
    return inner.join(ends, "node").select("seed", "file")


def nodes_of(edges: DataFrame) -> DataFrame:
    """The node table an edge table implies: type by id, file of its outgoing edges (the largest), repo."""
    ends = edges.select(F.col("source").alias("id"), "file", "repo").unionByName(edges.select(F.col("target").alias("id"), F.lit("").alias("file"), "repo"))
    return ends.groupBy("id").agg(F.max(F.coalesce("file", F.lit(""))).alias("file"), F.max("repo").alias("repo")).withColumn("node_type", node_kind(F.col("id")))


def secret_flow(edges: DataFrame) -> DataFrame:
    """``secret, stage, name``: the files that make a secret, the data sources that read it, the
    cluster secrets made of those, their files, and the files that mount them.

    Each (secret, stage, name) once: the stages of a secret are listed, not multiplied.
    """

    def ends(kind: str, prefix: str, target: str, source: str) -> DataFrame:
        rows = edges.where((F.col("edge_type") == kind) & F.startswith("target", F.lit(prefix)))
        return rows.select(F.col("target").alias(target), F.col("source").alias(source)).distinct()

    made = ends("CREATES_KV_SECRET", "kv_secret:", "secret", "name")
    read = ends("READS_KV_SECRET", "kv_secret:", "secret", "name").join(made.select("secret").distinct(), "secret", "left_semi")
    held = ends("READS_KV_SECRET", "kv_data:", "reader", "name")
    direct = read.where(F.startswith("name", F.lit("k8s_secret:")))
    cluster = read.select("secret", F.col("name").alias("reader")).join(held, "reader").select("secret", "name").unionByName(direct).distinct()
    upward = cluster.select("secret", F.col("name").alias("k8s"))
    created = upward.join(ends("CREATES_K8S_SECRET", "k8s_secret:", "k8s", "name"), "k8s").select("secret", "name").distinct()
    mounted = upward.join(ends("MOUNTS_SECRET", "k8s_secret:", "k8s", "name"), "k8s").select("secret", "name").distinct()
    stages = [("kv_file", made), ("kv_data", read), ("k8s_secret", cluster), ("k8s_file", created), ("mount_file", mounted)]
    return reduce(DataFrame.unionByName, [rows.select("secret", F.lit(stage).alias("stage"), "name") for stage, rows in stages])
