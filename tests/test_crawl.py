from kelpie.plans import crawl

FILES = "repo string, branch string, file string, text string, id int"
TF = 'resource "azurerm_key_vault_secret" "s" {\n  name = "x"\n}\n'


def tables(spark, out):
    edges = {(r.file, r.target) for r in spark.read.schema("file string, target string").parquet(f"{out}/edges").collect()}
    chunks = {(r.file, r.text) for r in spark.read.parquet(f"{out}/chunks").collect()}
    return edges, chunks


def test_sync_reads_only_what_changed(spark, tmp_path):
    out = str(tmp_path / "out")
    first = [("r", "main", "a.tf", TF, 1), ("r", "main", "n.md", "note", 2), ("r", "dev", "n.md", "other", 3), (None, "main", "z", "z", 4), ("r", "main", "empty.md", None, 5)]
    got = {(r.branch, r.status): r.files for r in crawl.sync(spark.createDataFrame(first, FILES), out).collect()}
    assert got == {("main", "A"): 3, ("dev", "A"): 1}
    edges, chunks = tables(spark, out)
    assert edges == {("a.tf", "kv_secret:x")} and ("n.md", "note") in chunks and ("n.md", "other") in chunks
    same = {(r.branch, r.status): r.files for r in crawl.sync(spark.createDataFrame(first, FILES), out).collect()}
    assert same == {("main", "S"): 3, ("dev", "S"): 1}
    second = [("r", "main", "n.md", "changed", 2), ("r", "dev", "n.md", "other", 3), ("r", "main", "empty.md", None, 5), ("r", "main", "b.tf", TF.replace('"x"', '"y"'), 6)]
    got = {(r.branch, r.status): r.files for r in crawl.sync(spark.createDataFrame(second, FILES), out).collect()}
    assert got == {("main", "A"): 1, ("main", "M"): 1, ("main", "D"): 1, ("main", "S"): 1, ("dev", "S"): 1}
    edges, chunks = tables(spark, out)
    assert edges == {("b.tf", "kv_secret:y")} and {t for f, t in chunks if f == "n.md"} == {"changed", "other"}


def test_the_last_file_of_a_repository_leaves_all_tables(spark, tmp_path):
    out = str(tmp_path / "out")
    first = [("gone", "main", "a.tf", TF, 1), ("stays", "main", "n.md", "note", 2)]
    crawl.sync(spark.createDataFrame(first, FILES), out, buckets=64)
    got = {(r.repo, r.status) for r in crawl.sync(spark.createDataFrame(first[1:], FILES), out, buckets=64).collect()}
    assert got == {("gone", "D"), ("stays", "S")}
    assert {(r.repo, r.status) for r in crawl.sync(spark.createDataFrame(first[1:], FILES), out, buckets=64).collect()} == {("stays", "S")}
    assert tables(spark, out) == (set(), {("n.md", "note")})


def test_a_table_without_rows_can_be_read_again(spark, tmp_path):
    out = str(tmp_path / "out")
    crawl.sync(spark.createDataFrame([("r", "main", "n.md", "note", 1)], FILES), out)
    crawl.sync(spark.createDataFrame([("r", "main", "n.md", "note", 1), ("r", "main", "a.tf", TF, 2)], FILES), out)
    assert tables(spark, out)[0] == {("a.tf", "kv_secret:x")}
