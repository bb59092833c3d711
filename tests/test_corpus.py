import json
import subprocess

from pyspark.sql import functions as F

from kelpie.functions import names as N
from kelpie.functions import text as T
from kelpie.operators import branches as B
from kelpie.operators import chunking as C
from kelpie.operators import discovery as D
from kelpie.operators import evaluation as V
from kelpie.operators import extraction as X
from kelpie.operators import stores as S
from kelpie.sources import files as FS
from kelpie.sources import git as GS
from kelpie.streaming import ingest as ST

FILES = "file string, repo string, branch string, text string"


def column(spark, values, make):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "v string").select(make(F.col("v")).alias("x")).collect()]


def test_file_classes(spark):
    want = {
        "a/logo.PNG": "skip", "x/yarn.lock": "skip", "svc/svc-prod.yaml": "config", "c/application-dev.yml": "config", "q/pipeline.yaml": "pipeline", "pipeline/pipeline.yaml": "config", "charts/a/Chart.yaml": "helm_chart",
        "charts/a/values.yaml": "helm_values", "l/main.tf": "terraform", ".harness/services/a.yaml": "harness_svc", "environments/e.yml": "harness_env", "overrides/o.yaml": "harness_override", "a/templates/d.yaml": "template",
        "k/deploy.yaml": "unknown", "Dockerfile.dev": "dockerfile", "README.md": "readme", "src/a.py": "unknown",
    }
    assert column(spark, list(want), N.file_class) == list(want.values())


def test_names(spark):
    assert column(spark, ["main", "release_26_1", "hotfix/x", "fix/y", "Feature/z", "xx"], N.branch_tier) == ["production", "release", "hotfix", "bugfix", "feature", "unknown"]
    assert column(spark, ["release_12_18", "release/26.3", "release_26", "main", None], N.release_version) == [12.18, 26.03, 26.0, None, None]
    assert column(spark, ["origin/main", "feature/a", "RELEASE_1"], N.is_protected) == [True, False, True]
    assert column(spark, ["eu-prod-1", "pre-prod", "dev", "my_prod"], N.environment_tier) == ["production", "production", "integration", "unknown"]
    assert column(spark, ["My_Service-v2", " a  b "], N.service_name) == ["my-service", "a-b"]
    assert [tuple(r) for r in column(spark, ["a/client/client-prod.yaml", "a/client/client.yaml", "x/application-zz.yaml"], N.settings_service)] == [("client", "prod"), ("client", None), ("application", None)]
    assert column(spark, ["see sb1.servicebus.windows.net now", "10.0.0.1:80", "none"], lambda c: N.endpoint(c)["kind"]) == ["service_bus", "internal_endpoint", None]
    assert column(spark, ["a\nb\n", "a\nb", "", None], T.line_count) == [2, 2, 0, None]
    assert column(spark, ["65", "5"], lambda c: T.duration(c.cast("int"))) == ["1m 5s", "5s"]


def test_branches_of_prompts_and_hints_of_files(spark):
    prompts = ["create a release precheck pipeline", "fix the deploy stage timeout", "update terraform module versions", "the a of", "", None, "add " + "abcdefghijklmnopq " * 4]
    df = spark.createDataFrame([(p, "release/26_2") for p in prompts], "p string, b string")
    got = [r.x for r in df.select(N.new_branch(F.col("p"), F.col("b")).alias("x")).collect()]
    assert got == ["feat/release-precheck", "fix/fix-deploy-stage-timeout", "chore/update-terraform-module-versions", "feat/release-26-2", "feat/release-26-2", None, "feat/add-" + "-".join(["abcdefghijklmnopq"] * 3)[:46]]
    files = spark.createDataFrame([("a/main.tf", None), ("x", "kind: Pod"), (None, None), ("charts/pipeline.yaml", "")], "p string, t string")
    assert [r.x for r in files.select(N.repo_hints(F.col("p"), F.col("t")).alias("x")).collect()] == [["infrastructure", "terraform"], ["helm", "mixed"], [], ["cicd", "harness", "helm", "mixed"]]


def test_status_of_configured_branches(spark):
    configured = spark.createDataFrame([("r", "main"), ("r", "main"), ("r", "dev")], "repo string, branch string")
    state = spark.sql("SELECT 'r' AS repo, 'main' AS branch, '0123456789' AS commit, TIMESTAMP_NTZ '2025-01-02 03:04:05' AS synced_at")
    assert {tuple(r) for r in B.status_list(configured, state).collect()} == {("r", "main", "01234567", "2025-01-02 03:04:05"), ("r", "dev", "n/a", "never")}


def test_extraction(spark):
    tf = 'resource "azurerm_key_vault_secret" "s" {\n  name = "db-pass"\n}\nresource "kubernetes_secret" "k" {\n  metadata {\n    name = "app"\n  }\n  data = { x = data.azurerm_key_vault_secret.d.value }\n}\ndata "azurerm_key_vault_secret" "d" {\n  name = "db-pass"\n}\ndepends_on = [azurerm.a, module.b]\n'
    df = spark.createDataFrame([("m.tf", "r", "b", tf), ("p.yaml", "r", "b", 'templateRef: "t1"\nserviceRef: s1\nserviceRef: s1\n'), ("x", None, None, None), ("h.yaml", "r", "b", "secretKeyRef:\n  name: 'app'\n  key: x\n")], FILES)
    got = {(r.source, r.target, r.edge_type) for r in X.terraform_edges(df).collect()}
    assert got == {("m.tf", "kv_secret:db-pass", "CREATES_KV_SECRET"), ("m.tf", "k8s_secret:app", "CREATES_K8S_SECRET"), ("k8s_secret:app", "kv_data:d", "READS_KV_SECRET"), ("kv_data:d", "kv_secret:db-pass", "READS_KV_SECRET"), ("m.tf", "azurerm.a", "DEPENDS_ON"), ("m.tf", "module.b", "DEPENDS_ON")}
    assert sorted((r.target, r.edge_type) for r in X.pipeline_edges(df).collect()) == [("s1", "USES_SERVICE"), ("s1", "USES_SERVICE"), ('t1"', "CALLS_TEMPLATE")]
    assert [r.target for r in X.mount_edges(df).collect()] == ["k8s_secret:app"]
    conf = spark.createDataFrame([("c/svc/svc.yaml", "r", "b", "host: db.servicebus.windows.net\n"), ("c/svc/svc-prod.yaml", "r", "b", "a: 1\n")], FILES)
    kinds = {(r.source, r.target, r.edge_type) for r in X.settings_edges(conf).collect()}
    assert ("config:c/svc/svc-prod.yaml", "config:c/svc/svc.yaml", "OVERRIDES_FOR_ENV") in kinds and ("config:c/svc/svc.yaml", "endpoint:db.servicebus.windows.net", "CONNECTS_TO") in kinds and ("config:c/svc/svc.yaml", "config_prop:host", "DEFINES_CONFIG") in kinds
    pipe = "pipeline:\n  name: P\n  identifier: p1\n  stages:\n  - stage:\n      name: A\n      type: Approval\n  - stage:\n      name: B\n      type: Deployment\n      serviceRef: s\n      serviceRef: <+input>\n"
    row = X.pipelines(spark.createDataFrame([("p", "r", "b", pipe)], FILES)).first()
    assert (row.name, row.identifier, row.approval_stages, row.services_referenced, [s.name for s in row.stages]) == ("P", "p1", ["A"], ["s"], ["A"])  # indented stages after the first belong to its block


def test_discovery(spark):
    rows = [("layer_2/main.tf", "tf"), ("layer_2/vars.tf", "tf"), ("charts/a/Chart.yaml", "helm"), ("charts/a/values.yaml", "helm"), (".harness/services/a.yaml", "ci"), ("pipelines/x/pipeline.yaml", "ci"), ("Dockerfile", "app"), ("package.json", "app"), ("x.md", "none"), ("y", None)]
    got = {r.repo: r.type for r in D.repo_types(spark.createDataFrame(rows, "file string, repo string")).collect()}
    assert got == {"tf": "infrastructure", "helm": "helm", "ci": "cicd", "app": "application", "none": "unknown"}
    names = spark.createDataFrame([("vm", "eus2-prod-web"), ("vm", "wus-dev-api"), ("vm", "plain"), ("kv", "np_x")], "type string, name string")
    found = {(r.type, r.pattern): r.confidence for r in D.naming(names).collect()}
    assert found == {("vm", "{region}-{env}-web"): 0.8, ("vm", "{region}-{env}-api"): 0.8, ("kv", "{env}_x"): 0.65}
    tf = spark.createDataFrame([("layer_10_net/a.tf", "r", "b", 'resource "x" "y" {\n}\nmodule "m" {\n}\n'), ("layer_x/b.tf", "r", "b", None)], FILES)
    assert {(r.layer, r.position, r.resources, r.modules) for r in D.infra_layers(tf).collect()} == {("layer_10_net", 10.0, 1, 1), ("layer_x", 999.0, 0, 0)}


def test_chunking(spark):
    tf = 'variable "a" {\n}\n\nvariable "b" {\n}\n\nresource "x" "y" {\n  z = 1\n}\n\noutput "o" {\n}\n'
    pipe = "pipeline:\n  stages:\n    - stage:\n        name: One\n    - stage:\n        name: Two\n"
    gen = "a: 1\nb: 2\nbig:\n" + "  x: y\n" * 60 + "c: 3\n"
    df = spark.createDataFrame([(1, "m.tf", tf), (2, "p.yaml", pipe), (3, "g.yaml", gen), (4, "values.yaml", "image: x\ndeep:\n  a:\n" + "    k: v\n" * 300 + "  b:\n" + "    k: v\n" * 200 + "port: 1\n"), (5, "n.md", "text"), (6, "e.yaml", ""), (7, "z.tf", None)], "id int, file string, text string")
    got = {}
    for r in C.structural(df).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.section)
    assert got == {1: ["variable_group", "resource x y", "variable_group"], 2: ["One", "Two"], 3: ["grouped_keys", "big", "grouped_keys"], 4: ["deep", "deep", "root_scalars"]}
    text = "word " * 400 + "x" * 900
    pieces = [r.text for r in C.fixed(spark.createDataFrame([(1, "f", text), (2, "f", "  "), (3, "f", None)], "id int, file string, text string")).orderBy("chunk_index").collect()]
    assert all(len(p) <= 500 for p in pieces) and pieces[0].endswith("word") and "".join(text.split()) in "".join(text.split())


def test_branches_and_stores(spark):
    rows = [("r", "main", "a.tf", "1"), ("r", "main", "b.tf", "1"), ("r", "develop", "a.tf", "2"), ("r", "develop", "c.md", None), ("r", None, "x", "y")]
    snaps = B.snapshots(spark.createDataFrame(rows, "repo string, branch string, file string, text string"))
    assert {(r.file, r.status, r["class"]) for r in B.diff(snaps, "main", "develop").collect()} == {("a.tf", "M", "terraform"), ("b.tf", "D", "terraform"), ("c.md", "A", "unknown")}
    lines = spark.createDataFrame([("r", "f", "main", 0, "a\nb\nc"), ("r", "f", "develop", 0, "a\nx\nc\nd"), ("r", "f", "main", 1, None), ("r", "f", "develop", 1, "n")], "repo string, file string, branch string, chunk_index int, text string")
    assert sorted(tuple(r) for r in B.line_changes(lines, "main", "develop").collect()) == [("r", "f", 0, 2, 1), ("r", "f", 1, 1, 0)]
    have = spark.createDataFrame([("r", "release_26_1"), ("r", "release_26_3"), ("r", "main"), (None, "x")], "repo string, branch string")
    want = spark.createDataFrame([("r", "release_26_4"), ("r", "mains"), ("r", "main"), ("q", "main")], "repo string, branch string")
    assert {(r.repo, r.branch): (r.indexed, r.closest) for r in B.closest(want, have).collect()} == {("r", "release_26_4"): (False, "release_26_3"), ("r", "mains"): (False, "main"), ("r", "main"): (True, "main"), ("q", "main"): (False, None)}
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(S.upsert(old, new, ["id"]).collect(), key=str) == sorted([(1, "a"), (None, "n"), (2, "c"), (3, "d")], key=str)
    latest = S.latest(spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (1, 7, "y"), (2, None, "z")], "id int, at int, v string"), ["id"], [F.col("at")])
    assert sorted(tuple(r) for r in latest.collect())[0] == (1, 7, "y") and latest.count() == 2
    v = {r.k: r.status for r in S.verify(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string"), spark.createDataFrame([("a",), ("c",), (None,)], "k string"), ["k"]).collect()}
    assert v == {"a": "INCOMPLETE", "b": "MISSING", "c": "EXTRA", None: "OK"}


def test_partitions_are_replaced_not_doubled(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string")
    for _ in range(2):
        S.write_partitions(df, str(tmp_path / "t"), ["k"])
    S.write_partitions(spark.createDataFrame([(9, "b")], "v int, k string"), str(tmp_path / "t"), ["k"])
    assert sorted((r.v, r.k) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (9, "b")]


def test_scores(spark):
    q = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, None)], "id int, category string")
    c = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False), (2, False), (2, False), (2, True), (3, None)], "id int, ok boolean")
    assert {r.id: r.score for r in V.outcomes(q, c).collect()} == {1: 3, 2: 1, 3: 2, 4: 0}
    assert {r.category: r.points for r in V.report(V.outcomes(q, c)).collect()} == {"A": 4, "B": 2, "none": 0, "TOTAL": 6}


def test_sources(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "sub").mkdir(parents=True)
    (repo / "main.tf").write_text("a\nb")
    (repo / "sub" / "x.png").write_bytes(b"\x89")
    assert {(r.file, r["class"]) for r in FS.listing(spark, str(repo)).collect()} == {("main.tf", "terraform"), ("sub/x.png", "skip")}
    assert [(r.file, r.line_count, r.size_bytes) for r in FS.for_chunks(spark, str(repo)).collect()] == [("main.tf", 2, 3)]
    store = tmp_path / "store"
    store.mkdir()
    (store / "a.json").write_text(json.dumps([{"id": "1", "text": "t", "metadata": {"file": "f", "type": "k"}}, {"id": "2", "text": "u", "metadata": {"file_path": "g"}}]))
    assert sorted((r.id, r.file_path) for r in FS.chunk_store(spark, str(store)).collect()) == [("1", "f"), ("2", "g")]
    (tmp_path / "c.yaml").write_text("client_name: c\ndefault_branch: main\nrepos:\n - {name: a, branches: [x, y]}\n - {name: b}\n")
    assert sorted((r.repo, r.branch) for r in FS.client_config(spark, str(tmp_path / "c.yaml")).collect()) == [("a", "x"), ("a", "y"), ("b", "main")]
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main"), run("add", "."), run("commit", "-qm", "one"), run("checkout", "-qb", "dev")
    (repo / "new.md").write_text("n")
    (repo / "main.tf").write_text("c")
    run("add", "."), run("commit", "-qm", "two")
    GS.register(spark)
    read = lambda **o: spark.read.format("git").options(paths=str(repo), **o).load().collect()
    assert {r.branch for r in read(table="branches")} == {"main", "dev"}
    assert {(r.file, r.status) for r in read(table="changes", base="main", compare="dev")} == {("main.tf", "M"), ("new.md", "A")}


def test_stream_keeps_a_table(spark, tmp_path):
    src, schema = tmp_path / "src", "id int, at int, v string"
    kind = spark.createDataFrame([], schema).schema
    assert ST.followed(spark, str(tmp_path / "t"), kind).count() == 0
    batches = [[(1, 1, "a"), (1, 5, "e"), (2, 1, "c"), (None, 2, "n")], [(1, 3, "late"), (3, 1, "n"), (None, 1, "late")], [(1, 5, "e"), (2, 2, "d")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        ST.follow(ST.rows_of(spark, str(src), kind), str(tmp_path / "t"), str(tmp_path / "ck"), ["id"], "at", buckets=3).awaitTermination()
    got = {r.id: r.v for r in ST.followed(spark, str(tmp_path / "t"), kind).collect()}
    assert got == {1: "e", 2: "d", 3: "n", None: "n"}
    ST.into_table(str(tmp_path / "t"), ["id"], "at", 3)(spark.createDataFrame(batches[1], schema), 1)  # a batch that runs again
    assert {r.id: r.v for r in ST.followed(spark, str(tmp_path / "t"), kind).collect()} == got
