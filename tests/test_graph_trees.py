import random

import json

import duckdb

import __spark_entry__ as E
from kelpie.operators import components as CC
from kelpie.operators import graph as G
from kelpie.operators import trees as TR

EDGES = [
    (1, "pipeline:deploy", "audit_service", "USES_SERVICE", "p.yaml", "r", "main"),
    (2, "pipeline:deploy", "env:prod", "TARGETS_INFRA", "p.yaml", "r", None),
    (3, "db.tf", "kv_secret:s1", "CREATES_KV_SECRET", "db.tf", "r", "main"),
    (4, "kv_data:d1", "kv_secret:s1", "READS_KV_SECRET", "db.tf", "r", "main"),
    (5, "k8s_secret:k1", "kv_data:d1", "READS_KV_SECRET", "db.tf", "r", "main"),
    (6, "t.yaml", "k8s_secret:k1", "MOUNTS_SECRET", "t.yaml", "r", "main"),
    (6, "t.yaml", "k8s_secret:k1", "MOUNTS_SECRET", "t.yaml", "r", "main"),
    (7, None, "x", "DEPENDS_ON", None, None, None),
    (8, "", "x", "DEPENDS_ON", None, None, None),
]


def tables(spark):
    edges = spark.createDataFrame([(*e, 0) for e in EDGES], "id bigint, source string, target string, edge_type string, file string, repo string, branch string, seed int").drop("seed")
    nodes = spark.createDataFrame([("audit_service", "service", "a.yaml", "r", "2024-01-01"), ("env:prod", "environment", None, "r", "2024-01-01"), ("pipeline:deploy", None, "p.yaml", "r", "2024-01-01"), ("pipeline:deploy", "old", "o.yaml", "r", "2023-01-01")], "id string, node_type string, file string, repo string, indexed_at string")
    return G.linked(edges), nodes


def test_traversal_levels_and_directions(spark):
    edges, nodes = tables(spark)
    seeds = spark.createDataFrame([("db.tf",), ("db.tf",), (None,), ("nowhere",)], "seed string")
    both = {(r.seed, r.node): r.hops for r in G.traverse(edges, seeds, 9).collect()}
    assert both[("db.tf", "t.yaml")] == 4 and both[("nowhere", "nowhere")] == 0 and len(both) == 6
    assert {r.node for r in G.traverse(edges, seeds.limit(1), 9, "out").collect()} == {"db.tf", "kv_secret:s1"}
    named = {r.node: r.node_type for r in G.described(G.traverse(edges, spark.createDataFrame([("pipeline:deploy",)], "seed string"), 1), nodes).collect()}
    assert named == {"pipeline:deploy": None, "audit_service": "service", "env:prod": "environment"}


def test_impact_and_flow(spark):
    edges, nodes = tables(spark)
    seeds = spark.createDataFrame([("pipeline:deploy",), ("nowhere",)], "seed string")
    rows = {r.seed: r for r in G.impact(G.traverse(edges, seeds, 2), nodes, edges, 2).collect()}
    hit = rows["pipeline:deploy"]
    assert (hit.entities, hit.services, hit.environments, hit.prod, hit.risk_level) == (3, 1, 1, True, "high")
    assert rows["nowhere"].risk_level == "low" and rows["nowhere"].entities == 0
    flow = {(r.secret, r.stage, r.name) for r in G.secret_flow(edges).collect()}
    assert flow == {("kv_secret:s1", *x) for x in (("kv_file", "db.tf"), ("kv_data", "kv_data:d1"), ("k8s_secret", "k8s_secret:k1"), ("mount_file", "t.yaml"))}


def test_components_against_union_find(spark):
    import random

    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)] + [(None, 1), (5, 5)]
    boss = {}

    def root(x):
        while boss.setdefault(x, x) != x:
            x = boss[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            lo, hi = sorted((root(a), root(b)))
            boss[hi] = lo
    got = {r.node: r.component for r in CC.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in boss}
    assert CC.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_flatten_keeps_everything_unless_told(spark):
    deep = "x" * 200
    for i in range(12):
        deep = {"d": deep} if i % 2 else [deep]
    doc = {"a": {"b": None, "c": [1, True, "x"]}, "long": [{"i": i} for i in range(15)], "deep": deep}
    df = spark.createDataFrame([("d", json.dumps(doc)), ("bad", "{"), ("none", None), ("empty", "")], "id string, text string")
    rows = {r.node_path: r for r in TR.flatten(df, "id", "text").collect()}
    assert (rows["root.a.c[1]"].depth, rows["root.a.c[1]"].kind, rows["root.a.b"].kind) == (3, "bool", "null")
    assert {f"root.long[{i}].i" for i in range(15)} <= set(rows)
    last = max(rows.values(), key=lambda r: r.depth)
    assert (last.depth, last.preview) == (13, "x" * 200) and json.loads(rows["root"].content_json) == doc
    thin = {r.node_path: r for r in TR.flatten(df, "id", "text", deepest=8, long_list=10, preview=80).collect()}
    assert "root.long[2].i" in thin and "root.long[14].i" in thin and "root.long[5]" in thin and "root.long[5].i" not in thin and max(r.depth for r in thin.values()) == 8
    shallow = {r.node_path for r in TR.flatten(df, "id", "text", deepest=1).collect()}
    assert shallow == {"root", "root.a", "root.long", "root.deep"}
    stream = TR.flatten(spark.createDataFrame([("y", "a: 1\nb:\n - x\n---\nc: 2\n")], "id string, text string"), "id", "text", yaml=True).collect()
    assert {(r.document, r.node_path) for r in stream} == {(0, "root"), (0, "root.a"), (0, "root.b"), (0, "root.b[0]"), (1, "root"), (1, "root.c")}


def test_fetch_exact_prefix_missing(spark):
    nodes = spark.createDataFrame([("s", "root.a", 1, "1"), ("s", "root.a.b", 2, "2"), ("s", "root.a.b", 2, "2"), (None, "root", 0, "0"), ("", "root", 0, "0")], "skeleton_id string, node_path string, depth int, content_json string")
    wanted = spark.createDataFrame([("s", "root.a"), ("s", "root.a."), ("s", "zzz"), ("t", "root")], "skeleton_id string, wanted string")
    got = {(r.skeleton_id, r.wanted): (r.found, r.node_path) for r in TR.fetch(nodes, wanted).collect()}
    assert got == {("s", "root.a"): ("exact", "root.a"), ("s", "root.a."): ("prefix", "root.a.b"), ("s", "zzz"): ("missing", None), ("t", "root"): ("missing", None)}


def test_searches_start_from_every_twentieth_edge(spark, sf):
    edges = G.linked(spark.read.parquet(f"{sf}/edges.parquet")).where("id % 20 = 0").collect()
    ends = {e.source for e in edges} | {e.target for e in edges}
    asked = ends | {f"file:{e.file}" for e in edges if e.file}
    assert {r.seed for r in E.queries()["impact_searches"](spark, sf).collect()} == asked
    for name in ("neighbourhood_searches", "walked_edge_searches"):
        assert {r.seed for r in E.queries()[name](spark, sf).collect()} == ends


def test_resolution_compares_no_name_with_every_id(spark):
    nodes = spark.createDataFrame([("svc:a_core-Main",), ("svc:axcore-main",), ("env:x",), ("svc:100%-b",), ("q",), ("config:a\\bcd.yaml",)], "id string")
    names = spark.createDataFrame([("env:x",), ("A_CORE-m",), ("core",), ("100%-b",), ("none such",), ("%core_main",), ("a\\bcd",), (None,)], "name string")
    found = G.resolve(nodes, names)
    got = {}
    for r in found.collect():
        got.setdefault(r.name, set()).add(r.id)
    core = {"svc:a_core-Main", "svc:axcore-main"}
    assert got == {"env:x": {"env:x"}, "A_CORE-m": core, "core": core, "100%-b": {"svc:100%-b"}, "%core_main": core, "a\\bcd": {"config:a\\bcd.yaml"}}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    short = spark.createDataFrame([("x",), ("e_v",)], "name string")
    assert {(r.name, r.id) for r in G.resolve(nodes, short).collect()} == {("x", "env:x"), ("x", "svc:axcore-main"), ("e_v", "env:x")}


def test_contained_names_and_the_catalogue(spark):
    texts = spark.createDataFrame([("svc:Orders-API",), ("o",), ("xy",), ("",), (None,), ("svc:100%_b",), ("svc:Orders-API",)], "long string")
    asked = spark.createDataFrame([("orders",), ("O",), ("%",), ("y",), ("none such",), ("",), (None,), ("0%_",)], "short string")
    assert {tuple(r) for r in G.contained(asked, texts).collect()} == {("orders", "svc:Orders-API"), ("O", "svc:Orders-API"), ("O", "o"), ("%", "svc:100%_b"), ("y", "xy"), ("0%_", "svc:100%_b")}
    assert G.contained(asked, texts.limit(0)).count() == 0 and G.contained(asked.limit(0), texts).count() == 0
    known = spark.createDataFrame([("team-infra",), ("infra",), ("web",), (None,)], "name string")
    got = {r.name: (r.status, r.found) for r in G.resolve_names(spark.createDataFrame([("web",), ("web-app",), ("Infra",), ("zzz",), (None,), ("",)], "name string"), known).collect()}
    assert got == {"web": ("exact", "web"), "web-app": ("fuzzy", "web"), "Infra": ("ambiguous", None), "zzz": ("unknown", None), "": ("unknown", None)}
    nodes = spark.createDataFrame([("a", "Service", "f/orders.tf", 1), ("a", "Service", "f/orders.tf", 2), ("orders", None, None, 3), ("b", "env", "", 4)], "id string, node_type string, file string, name int")
    assert [tuple(r) for r in G.catalogue(spark.createDataFrame([("orders",), ("b2",)], "name string"), nodes).collect()] == [("orders", 2, 1, 1)]


def test_containment_writes_few_rows_for_each_text(spark, monkeypatch):
    draw, letters = random.Random(5), "abcdefgh-_:%éİ中"
    texts = ["".join(draw.choices(letters, k=draw.randint(1, 60))) for _ in range(300)]
    names = [t[(i := draw.randrange(len(t))) : i + draw.randint(1, 30)].upper() for t in texts] + ["nothing-holds-this"]
    written, write = {}, G.materialize

    def watched(df, name):
        out = write(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(G, "materialize", watched)
    long = spark.createDataFrame([(t,) for t in texts], "long string")
    lower = {t: r for t, r in spark.createDataFrame([(t,) for t in {*texts, *names}], "t string").selectExpr("t", "lower(t)").collect()}

    def pairs(some):
        got = G.contained(spark.createDataFrame([(n,) for n in some], "short string"), long).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == {(n, t) for n in some for t in texts if lower[n] in lower[t]}

    pairs(names)
    written.clear()
    pairs([n for n in names if len(lower[n].encode()) >= 8])
    assert written["grams"] < sum(map(len, texts)) * 0.3, written


def test_entity_view_has_each_link_once(spark):
    edges = spark.createDataFrame([("a", "b", "T", "f"), ("a", "b", "T", "f"), ("c", "a", "T", None), ("x", "y", "T", "f")], "source string, target string, edge_type string, file string")
    got = {(r.id, r.direction, r.other, r.file) for r in G.entity_view(edges, spark.createDataFrame([("a",), ("a",), (None,)], "id string")).collect()}
    assert got == {("a", "out", "b", "f"), ("a", "in", "c", None)}


def test_impact_of_many_lists_no_pairs_through_hubs(spark, monkeypatch):
    spokes = [f"{('svc_service', 'env:prod', 'x', 'environment')[i % 4]}-{i}" for i in range(120)]
    edges = spark.createDataFrame([(i, *((s, "hub") if i % 2 else ("hub", s)), "T", ("f", "", None, f"f{i}")[i % 4], "r", "main") for i, s in enumerate(spokes)], "id int, source string, target string, edge_type string, file string, repo string, branch string")
    nodes = spark.createDataFrame([(s, (None, "service", "entity")[i % 3], ("", "g", None, f"f{i}")[i % 4], "r", i) for i, s in enumerate(spokes[:90])] + [("alone", "service", "g", "r", 1)], "id string, node_type string, file string, repo string, indexed_at int")
    starts = spark.createDataFrame([(s, s) for s in [*spokes, "hub", "nowhere"]] + [("file:g", n) for n in ("alone", spokes[1], "nowhere")] + [(None, "hub")], "seed string, node string")
    want = {tuple(r) for r in G.impact(G.traverse(edges, starts, 2), nodes, edges, 2).select("seed", "entities", "services", "environments", "prod", "files", "risk_level", "summary").collect()}
    most, write = [], G.materialize

    def watched(df, name):
        out = write(df, name)
        most.append(out.count())
        return out

    monkeypatch.setattr(G, "materialize", watched)
    got = {tuple(r) for r in G.impact_of_many(edges, starts, nodes, block_rows=50).select("seed", "entities", "services", "environments", "prod", "files", "risk_level", "summary").collect()}
    assert got == want and len(got) == 123
    assert max(most) < 10 * len(spokes)


def test_impact_of_files_at_a_hub_lists_no_pairs_within_one_link(spark, tmp_path, monkeypatch):
    links = [(20 * i, *((f"svc-service-{i}", "hub") if i % 2 else ("hub", f"env:prod-{i}")), "T", f"f{i}", "r", "main") for i in range(120)]
    links += [(i, f"svc-service-{i}", f"far{i % 7}", "U", ("f1", "", None, "g")[i % 4], "r", "main") for i in range(1, 120, 2)] + [(2400, "loop", "loop", "T", "f1", "r", "main")]
    edges = spark.createDataFrame(links, "id bigint, source string, target string, edge_type string, file string, repo string, branch string")
    nodes = [(f"far{i}", ("unknown", None, "service")[i % 3], ("", "f1", None)[i % 3], "r", i) for i in range(7)] + [(f"svc-service-{i}", "entity", f"n{i % 9}", "r", 1) for i in range(1, 100, 2)]
    nodes += [("hub", "environment", "f3", "r", 1), ("hub", "env", "f4", "r", 2), ("alone", "service", "f5", "r", 1), (None, "service", "f6", "r", 1)]
    nodes = spark.createDataFrame(nodes, "id string, node_type string, file string, repo string, indexed_at int")
    for name, df in (("edges", edges), ("nodes", nodes)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("edges", "nodes"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = ["seed", "entities", "services", "environments", "prod", "files", "risk_level", "summary"]
    want = set(con.execute(f"SELECT {', '.join(columns)} FROM ({E.oracle_sql()['impact_searches']})").fetchall())
    got, most = most_written(monkeypatch, lambda: [tuple(r) for r in E.queries()["impact_searches"](spark, str(tmp_path)).select(columns).collect()])
    assert set(got) == want and len(got) == len(want) and most < 120 * 120 / 8
    whole = G.impact_of_many
    monkeypatch.setattr(G, "impact_of_many", lambda *tables: whole(*tables, block_rows=20, part_rows=300))
    assert sorted(tuple(r) for r in E.queries()["impact_searches"](spark, str(tmp_path)).select(columns).collect()) == sorted(got)


def hub_tables(spark, folder):
    """A hub with 150 neighbours, a second hub with some of them, chains and a loop; every end is searched."""
    draw = random.Random(7)
    links = [(f"s{i}", "hub") if i % 2 else ("hub", f"s{i}") for i in range(150)] + [(f"s{i}", "second") for i in range(0, 150, 5)]
    links += [(f"s{draw.randrange(150)}", f"s{draw.randrange(150)}") for _ in range(60)] + [("hub", "second"), ("loop", "loop"), ("a", "b"), ("b", "c"), ("c", "d"), ("a", "b"), ("b", "a")]
    rows = [(20 * i, s, t, ("T", "U", None)[i % 3], f"f{i % 9}", "r", "main") for i, (s, t) in enumerate(links)]
    edges = spark.createDataFrame([*rows, *rows[:5], (7, None, "a", "T", "f", "r", "main"), (20, "", "a", "T", "f", "r", "main")][5:], "id bigint, source string, target string, edge_type string, file string, repo string, branch string")
    nodes = spark.createDataFrame([(f"s{i}", ("service", None)[i % 2], (None, "g", "")[i % 3], "r", i) for i in range(100)] + [("s1", "old", "o", "r", -1)], "id string, node_type string, file string, repo string, indexed_at int")
    for name, df in (("edges", edges), ("nodes", nodes)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return G.linked(spark.read.parquet(f"{folder}/edges.parquet")), spark.read.parquet(f"{folder}/nodes.parquet")


def most_written(monkeypatch, run):
    most, write = [], G.materialize

    def watched(df, name):
        out = write(df, name)
        most.append(out.count())
        return out

    with monkeypatch.context() as patch:
        patch.setattr(G, "materialize", watched)
        return run(), max(most)


def test_walked_edges_of_many_write_no_pairs_through_hubs(spark, tmp_path, monkeypatch):
    edges, _ = hub_tables(spark, tmp_path)
    got, most = most_written(monkeypatch, lambda: [tuple(r) for r in E.queries()["walked_edge_searches"](spark, str(tmp_path)).collect()])
    ends = edges.select(G.F.explode(G.F.array("source", "target")).alias("seed")).distinct()
    want = {tuple(r) for r in G.traversed_edges(edges, G.traverse(edges, ends, 2), 2).select("seed", "source", "target", "edge_type").collect()}
    assert set(got) == want and len(got) == len(want) and most < len(got) / 10
    few = ends.where("seed IN ('a', 's5', 'loop')").unionByName(spark.createDataFrame([("nowhere",), (None,), ("a",)], "seed string"))
    small = [tuple(r) for r in G.walked_by_each(edges, few, block_rows=20, list_rows=7, task_rows=100).collect()]
    assert set(small) == {w for w in want if w[0] in ("a", "s5", "loop")} and len(small) == len(set(small))
    assert G.walked_by_each(edges.limit(0), few).count() == 0 and G.walked_by_each(edges, few.limit(0)).count() == 0


def test_neighbourhoods_of_many_write_no_pairs_through_hubs(spark, tmp_path, monkeypatch):
    edges, nodes = hub_tables(spark, tmp_path)
    columns = ["seed", "node", "hops", "node_type", "file", "repo"]
    got, most = most_written(monkeypatch, lambda: [tuple(r) for r in E.queries()["neighbourhood_searches"](spark, str(tmp_path)).select(columns).collect()])
    ends = edges.select(G.F.explode(G.F.array("source", "target")).alias("seed")).distinct()
    want = {tuple(r) for r in G.described(G.traverse(edges, ends, 2), nodes).select(columns).collect()}
    assert set(got) == want and len(got) == len(want) and most < len(got) / 10
    few = ends.where("seed IN ('a', 's5', 'loop')").unionByName(spark.createDataFrame([("nowhere",), (None,), ("a",)], "seed string"))
    small = [tuple(r) for r in G.neighbourhoods(edges, few, nodes, block_rows=20, list_rows=7, task_rows=100).select(columns).collect()]
    assert set(small) == {w for w in want if w[0] in ("a", "s5", "loop")} | {("nowhere", "nowhere", 0, "unknown", "", "")} and len(small) == len(set(small))
    assert G.neighbourhoods(edges.limit(0), few, nodes).count() == 4 and G.neighbourhoods(edges, few.limit(0), nodes).count() == 0
