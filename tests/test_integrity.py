from datetime import datetime as D

from kelpie.operators import integrity as I

REF = "id bigint, source string, at timestamp_ntz, salt int, status string, key string"
PAR = "id string, indexed_at timestamp_ntz, deleted_at timestamp_ntz, at int"


def judge(spark, refs, parents, **kw):
    r = I.references(spark.createDataFrame([(*x, 1, "x", "y") for x in refs], REF), "edges", "source", "id", "at")
    p = I.lifetimes(spark.createDataFrame([(*x, 1) for x in parents], PAR), "id", "indexed_at", "deleted_at")
    return sorted((x.row_id, x.status) for x in I.judged(r, p, **kw).collect()), r, p


PARENTS = [("a", D(2024, 1, 1), D(2024, 2, 1)), ("a", D(2024, 1, 1), D(2024, 2, 1)), ("a", D(2024, 3, 1), None), ("b", D(2024, 5, 1), None), (None, D(2024, 1, 1), None), ("c", None, D(2024, 1, 2))]
REFS = [(1, "a", D(2024, 1, 1)), (2, "a", D(2024, 2, 1)), (3, "a", D(2024, 3, 1)), (4, "a", D(2023, 1, 1)), (5, "b", D(2024, 4, 30)), (6, "zz", D(2024, 1, 1)), (7, "", D(2024, 1, 1)), (8, None, D(2024, 1, 1)), (9, "a", None), (10, "zz", None), (11, "c", D(2020, 1, 1))]
WANT = sorted([("1", "live"), ("2", "deleted"), ("3", "live"), ("4", "late"), ("5", "late"), ("6", "missing"), ("9", "undated"), ("10", "missing"), ("11", "live")])


def test_states_at_the_edges_of_lifetimes(spark):
    assert judge(spark, REFS, PARENTS)[0] == WANT


def test_splitting_a_hot_key_changes_nothing(spark):
    refs = [(i, "a", D(2024, 2, 1 + i % 28)) for i in range(200)] + [(1000 + i, k, t) for i, k, t in REFS]
    whole = judge(spark, refs, PARENTS)[0]
    assert judge(spark, refs, PARENTS, split_rows=7)[0] == whole


def test_repeated_rows_count_once_and_report(spark):
    _, r, p = judge(spark, REFS + REFS, PARENTS)
    found = I.orphans(r, p)
    assert found.count() == 6
    rows = {(x.period, x.status): x.orphans for x in I.report(found).collect()}
    assert rows[("2024-02", "deleted")] == 1 and rows[(None, "missing")] == 1 and rows[(None, "undated")] == 1


def test_empty_tables(spark):
    assert judge(spark, [], PARENTS)[0] == []
    assert {s for _, s in judge(spark, REFS, [])[0]} == {"missing"}
