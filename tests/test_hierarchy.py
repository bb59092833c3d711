import random

from kelpie.operators import hierarchy as H

EDGE = "source string, target string, edge_type string, kind string, node string, path int"


def tree(spark, pairs, paths=True):
    df = spark.createDataFrame([(a, b, "T", "x", "y", 1) for a, b in pairs], EDGE)
    return {r.node: r for r in H.hierarchy(H.links(df), paths).collect()}


def brute(pairs):
    up, out = {}, {}
    for a, b in pairs:
        if a and b:
            up[a] = min(up.get(a, b), b)
    for n in {x for p in pairs if all(p) for x in p}:
        trail, at = [], n
        while at in up and at not in trail:
            trail.append(at)
            at = up[at]
        if at in up:
            loop = trail[trail.index(at) :]
            out[n] = (min(loop), -1 if n in loop else -2, None)
        else:
            out[n] = (at, len(trail), [*reversed([*trail, at])])
    return out


def same(spark, pairs):
    want = brute(pairs)
    got = tree(spark, pairs)
    assert {k: (r.root, r.depth, r.path) for k, r in got.items()} == want
    assert {k: (r.root, r.depth) for k, r in tree(spark, pairs, False).items()} == {k: v[:2] for k, v in want.items()}


def test_forest_with_cycles_tails_and_dirt(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(150)]
    loops = [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("t1", "l2"), ("t2", "t1"), ("self", "self"), ("s2", "self")]
    dirt = [(None, "a"), ("a", None), ("", "b"), ("b", ""), ("r", "s"), ("r", "s"), ("m", "p2"), ("m", "p1")]
    same(spark, chain + loops + dirt)


def test_random_functional_graph(spark):
    rng = random.Random(5)
    same(spark, [(f"x{i}", f"x{rng.randrange(300)}") for i in range(0, 300, 2)] + [(f"x{i}", f"x{rng.randrange(i)}") for i in range(1, 300, 2)])


def test_other_parents_stay_nodes_and_their_links_are_reported(spark):
    pairs = [("c", "b"), ("c", "d"), ("c", "e"), ("b", "a"), ("e", "f")]
    same(spark, pairs)
    df = spark.createDataFrame([(a, b, "T", "", "", 1) for a, b in pairs], EDGE)
    assert {(r.node, r.parent) for r in H.dropped(df, H.links(df)).collect()} == {("c", "d"), ("c", "e")}


def test_descendants_and_empty(spark):
    df = spark.createDataFrame([("c", "b", "T", "", "", 1), ("b", "a", "T", "", "", 1)], EDGE)
    found = {(r.ancestor, r.descendant, r.distance) for r in H.descendants(H.hierarchy(H.links(df), True)).collect()}
    assert found == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert H.hierarchy(H.links(df.limit(0)), True).count() == 0
