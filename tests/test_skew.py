from functools import partial

import pytest

from kelpie.operators import components as CC
from kelpie.operators import graph as G
from kelpie.operators import hierarchy as H
from kelpie.operators import retrieval as R
from kelpie.operators import skew
from kelpie.session import materialize
from tests import test_graph_trees, test_hierarchy, test_retrieval


@pytest.fixture
def tiny_splits(monkeypatch):
    small = partial(skew.split_join, split_rows=3)
    for module in (CC, G, H, R):
        monkeypatch.setattr(module, "split_join", small)


def test_split_join_is_a_join(spark):
    many = materialize(spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(60)], "k int, v int"), "many")
    few = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (None, "n"), (9, "z")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, many.join(few, ["k"], how).collect()), key=str)
        assert sorted(map(tuple, skew.split_join(many, few, ["k"], ["v"], how, 4).collect()), key=str) == plain


def test_hierarchies_with_hot_parents(spark, tiny_splits):
    test_hierarchy.same(spark, [(f"c{i}", "hub") for i in range(40)] + [("hub", "top"), ("top", "root")] + [(f"t{i}", "x") for i in range(9)] + [("x", "y"), ("y", "x")])


def test_graphs_with_hubs(spark, tiny_splits):
    test_graph_trees.test_traversal_levels_and_directions(spark)
    test_graph_trees.test_components_against_union_find(spark)


def test_ranking_with_hot_terms(spark, tiny_splits):
    test_retrieval.test_bm25_against_its_formula(spark)
