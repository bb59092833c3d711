import pytest
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kelpie.functions import text as T
from kelpie.operators import retrieval as R


def words(t):
    out = []
    for w in re.findall(r"[a-zA-Z0-9][a-zA-Z0-9_-]*", t.lower()):
        out.append(w)
        parts = re.split("[-_]", w)
        if len(parts) > 1:
            out += [p for p in parts if len(p) > 1]
    return out


def test_terms_split_compounds(spark):
    rows = spark.createDataFrame([("Tagging-Service x_y a--b 9lives",), ("",), (None,)], "t string").select(T.terms(F.col("t")).alias("w")).collect()
    assert sorted(rows[0].w) == sorted(words("Tagging-Service x_y a--b 9lives")) and rows[1].w == [] and rows[2].w == []


def test_bm25_against_its_formula(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("alpha beta-gamma delta eps zeta the the the".split()) for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [(98, None), (99, "")]
    asked = [(1, "beta delta delta"), (2, "nothing here"), (3, "the")]
    d, q = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(asked, "query int, q string")
    got = {(r.query, r.doc): r.score for r in R.bm25(R.index(d, "id", F.col("text")), q).collect()}
    bags = {i: Counter(words(t or "")) for i, t in docs}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    want = {}
    for n, text in asked:
        for i, b in bags.items():
            s = sum(math.log((len(bags) + 1) / df[w]) * (1 + b[w] * 2.5 / (1.5 * (0.25 + 0.75 * sum(b.values()) / mean) + b[w])) for w in words(text) if b[w])
            if any(b[w] for w in words(text)):
                want[n, i] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pruned_rankings_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["the"] * 60 + ["of", "in"] * 25
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(300)] + [(1000, None)]
    df = spark.createDataFrame(docs, "id int, text string")
    asked = spark.createDataFrame([(n, " ".join(rng.choice(words) for _ in range(n % 7))) for n in range(30)] + [(99, None), (98, "nothing")], "query int, q string")
    indexed = R.index(df, "id", F.col("text"))
    found = R.postings(indexed, asked)
    every = {}
    for r in R.bm25(indexed, asked).collect():
        every.setdefault(r.query, []).append((-round(r.score, 6), r.doc))
    for k in (1, 5, 20):
        want = {(q, d) for q, rows in every.items() for _, d in sorted(rows)[:k]}
        assert {(r.query, r.doc) for r in R.keyword_hits(indexed, asked, k, found=found).collect()} == want
    some = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc int")
    want = {(q, d) for q, rows in every.items() for _, d in sorted(x for x in rows if x[1] % 3 == 0 and x[1] < 300)[:5]}
    assert {(r.query, r.doc) for r in R.keyword_hits(indexed, asked, 5, some).collect()} == want
    have = {i: set((t or "").split()) for i, t in docs}
    want = set()
    for r in asked.collect():
        terms = set((r.q or "").split())
        scored = sorted((-round(len(terms & have[i]) / len(terms), 4), i) for i in have if terms & have[i])
        want |= {(r.query, i) for _, i in scored[:4]}
    assert {(r.query, r.doc) for r in R.overlap_hits(indexed, asked, 4, found).collect()} == want


def test_fusion_adds_up_and_keeps_the_first(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3)], "query int, doc string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query int, doc string, rank int")
    got = {r.key: r for r in R.fuse([a, b]).collect()}
    assert got["x"].rrf_score == round(1 / 61 + 1 / 63, 6) and got["y"].lists == 2 and (got["y"].best_list, got["y"].best_rank) == (1, 1)
    assert [r.key for r in R.fuse([a, b]).orderBy("rank").collect()] == ["y", "x", "z"]
    assert R.fuse([a.limit(0), b.limit(0)]).count() == 0


def vectors(spark, n=400, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(10, dim))
    rows = [(i, [float(x) for x in centre[i % 10] + 0.4 * rng.normal(size=dim)]) for i in range(n)] + [(n, None), (n + 1, [0.0] * dim)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), rows


def test_vector_search_in_blocks_is_exact(spark):
    df, rows = vectors(spark)
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    got = {(r.query, r.doc): r.relevance for r in R.vector_hits(df, asked, "vec_id", "embedding", 5, block_rows=37, block_queries=4).collect()}
    m = np.array([v for _, v in rows if v], dtype=np.float32).astype(float)
    unit = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    ids = [i for i, v in rows if v]
    for q in range(0, 400, 20):
        c = np.round(np.maximum(0, unit @ unit[q]), 4)
        best = sorted(range(len(ids)), key=lambda j: (-c[j], ids[j]))[:5]
        assert {k[1] for k in got if k[0] == q} == {ids[j] for j in best}


def test_ties_of_any_size_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(8)
    one = [float(x) for x in rng.normal(size=8)]
    near = [[x + 1e-7 * float(rng.normal()) for x in one] for _ in range(100)]
    rows = [(i, one if i % 3 == 0 else near[i % 100] if i % 3 == 1 else [float(x) for x in rng.normal(size=8)]) for i in rng.permutation(600).tolist()]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, one), (2, [0.0] * 8), (3, rows[0][1])], "query int, v array<float>")
    m = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    want = set()
    for q, v in ((r.query, np.array(r.v)) for r in asked.collect()):
        c = {i: round(max(0.0, float(x @ v / (np.linalg.norm(x) * np.linalg.norm(v) or 1))), 4) for i, x in m.items()}
        want |= {(q, i, n + 1) for n, i in enumerate(sorted(c, key=lambda i: (-c[i], i))[:5])}
    for blocks in (37, 65_536):
        assert {(r.query, r.doc, r["rank"]) for r in R.vector_hits(df, asked, "vec_id", "embedding", 5, block_rows=blocks).collect()} == want
    indexed, centres = R.inverted_index(df, "vec_id", "embedding", cells=8)
    got = {(r.query, r.doc, r["rank"]) for r in R.indexed_hits(indexed, centres, asked, 5, probes=4).collect()}
    assert {x for x in got if x[0] < 3} == {x for x in want if x[0] < 3}


def test_index_recall(spark):
    df, _ = vectors(spark, 2000)
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    exact = {(r.query, r.doc) for r in R.vector_hits(df, asked, "vec_id", "embedding", 10).collect()}
    indexed, centres = R.inverted_index(df, "vec_id", "embedding", cells=16)
    assert indexed.count() == 2001  # every row but the null one
    found = {(r.query, r.doc) for r in R.indexed_hits(indexed, centres, asked, 10, probes=8, block_rows=50).collect()}
    assert len(found & exact) / len(exact) >= 0.9


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_vectors_recall(spark, sf, size):
    df = spark.read.parquet(f"{sf}/../{size}/embeddings.parquet")
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    exact = {(r.query, r.doc) for r in R.vector_hits(df, asked, "vec_id", "embedding").collect()}
    indexed, centres = R.inverted_index(df, "vec_id", "embedding")
    found = {(r.query, r.doc) for r in R.indexed_hits(indexed, centres, asked).collect()}
    assert len(centres) == int(2 * df.count() ** 0.5) and len(found & exact) / len(exact) >= 0.9


def test_recall_filters_before_ranking(spark):
    rows = [("i1", "api", "OOMKilled", "heap too small", "raise limit", ["jvm"]), ("i2", "api", "Unknown", "bad secret", "rotate secret", None), ("i3", "web", "OOMKilled", "heap leak", None, [])]
    df = spark.createDataFrame(rows, "id string, service_name string, incident_type string, root_cause_summary string, resolution string, tags array<string>")
    q = spark.createDataFrame([(1, "heap jvm"), (2, "  ")], "query int, q string")
    assert [(r.query, r.doc) for r in R.recall(df, q).orderBy("query", "rank").collect()] == [(1, "i1"), (1, "i3")]
    assert [r.doc for r in R.recall(df, q, service="web", incident="OOMKilled").collect()] == ["i3"]
    assert R.recall(df, q, service="none").count() == 0


def test_hashed_embedding_puts_equal_texts_together(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma alpha beta"), (3, "delta eps"), (4, None)], "id int, text string")
    v = {r.doc: np.array(r.v) for r in R.embed(R.index(df, "id", F.col("text"))).collect()}
    assert np.allclose(v[1], v[2]) and abs(np.linalg.norm(v[1]) - 1) < 1e-6 and v[1] @ v[3] < 0.9 and not v[4].any()


def test_collections_fall_back_to_all(spark):
    df = spark.createDataFrame([("r", "release/1"), ("q", "main"), (None, "main")], "repo string, branch string")
    assert {tuple(r) for r in R.collections(df, "release-1").collect()} == {("r", "release/1")}
    assert R.collections(df, "nowhere").count() == 2 and R.collections(df, None).count() == 2


def test_rerank_with_and_without_model(spark):
    hits = spark.createDataFrame([(1, "a", 1, "long text", "q"), (1, "b", 2, "x", "q")], "query int, key string, rank int, text string, ask string")
    assert [r.method for r in R.rerank(hits, "text", "ask", None, 1).collect()] == ["hybrid_rrf_no_rerank"]
    best = R.rerank(hits, "text", "ask", lambda q, t: -t.str.len(), 1).collect()
    assert best[0].key == "b" and best[0].rerank_score == -1.0


def test_simple_relevance(spark):
    df = spark.createDataFrame([("deploy cd_env", "please deploy cd_env now", "a/cd_env.yaml"), ("", "x", "y"), ("foo bar", "only foo", None)], "q string, t string, p string")
    assert [r.s for r in df.select(T.simple_relevance(F.col("q"), F.col("t"), F.col("p")).alias("s")).collect()] == [1.0, 0.0, 0.5]


def test_rankings_make_rows_of_the_best_pairs_only(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "common words " + "more " * (i % 3)) for i in range(300)] + [(7, "common"), (7, "common common words")], "id int, text string")
    asked = spark.createDataFrame([(q, "Common words" if q % 2 else "common WORDS") for q in range(200)] + [(200, "more"), (201, "none"), (202, "")], "query int, q string")
    indexed = R.index(docs, "id", F.col("text"))
    few, back = R.once(asked)
    assert {tuple(r) for r in few.collect()} == {(0, "common words"), (200, "more"), (201, "none"), (202, "")}
    made, ranked = [], R.top

    def watched(df, *rest):
        made.append(df.count())
        return ranked(df, *rest)

    monkeypatch.setattr(R, "top", watched)
    for hits in (R.keyword_hits, R.overlap_hits):
        made.clear()
        got = back(hits(indexed, few, 5)).collect()
        assert made and max(made) <= 3 * 5
        assert {r.query for r in got} == {*range(201)} and all(len({r.doc for r in got if r.query == q}) == 5 for q in (0, 1, 199))
    assert {(r.doc, r.score) for r in got if r.query == 1} == {(i, 1.0) for i in range(5)}
    scores = {(r.query, r.doc): r.score for r in R.bm25(indexed, few).collect()}
    want = sorted(((-round(s, 6), d) for (q, d), s in scores.items() if q == 0))[:5]
    assert [(-r.score, r.doc) for r in sorted(R.keyword_hits(indexed, few, 5).where("query = 0").collect(), key=lambda r: r.rank)] == want


def test_rankings_in_many_blocks(spark):
    rows = [(i, t, float(g)) for i in range(40) for t, g in (("a", i % 4), ("b", 1 + i % 3)) if g]
    gains = spark.createDataFrame(rows, "doc int, term string, gain double")
    wanted = spark.createDataFrame([(q, t, 1.0 + q, 2.0) for q in range(9) for t in "abz"], "query int, term string, weight double, size double")
    got = {(r.query, r.rank): (r.doc, r.score) for r in R._ranked(gains, wanted, 6, 1, 40, 27, block_docs=7, block_terms=5).collect()}
    sums = {}
    for i, _, g in rows:
        sums[i] = sums.get(i, 0) + g
    assert got == {(q, n + 1): (i, round(x * (1 + q) / 2, 1)) for q in range(9) for n, (i, x) in enumerate(sorted(sums.items(), key=lambda e: (-e[1], e[0]))[:6])}


def test_coverage_and_nearest_against_every_stretch_and_pair(spark):
    draw = random.Random(3)
    docs = [(i, " ".join(draw.choices(["alpha", "be", "gamma", "de", "x", "y", "z"], k=draw.randrange(0, 150)))) for i in range(40)]
    asked = [(1, "alpha be nothing"), (2, "gamma de x alpha"), (3, "")]
    pairs = spark.createDataFrame([(q, d) for q, _ in asked for d in range(42)], "query int, key int")
    rows = spark.createDataFrame([*docs, (40, None)], "doc int, text string")
    got = {(r.query, r.key): r.score for r in R.window_coverage(pairs, spark.createDataFrame(asked, "query int, q string"), rows, F.col("text"), 9).collect()}
    texts, weight = dict(docs), lambda ts: sum(2 if len(t) > 4 else 1 for t in ts)
    for q, question in asked:
        terms = set(question.split())
        for d in range(42):
            ws = (texts.get(d) or "").split()
            best = max([weight(terms & set(ws[i : i + 9])) for i in range(len(ws))], default=0)
            assert got[q, d] == pytest.approx(best / weight(terms) if terms else 0, abs=1e-6)
    vectors = [(i, [float(draw.randrange(-2, 3)) for _ in range(3)]) for i in range(500)]
    table = spark.createDataFrame(vectors, "id int, v array<float>")
    near = {}
    for r in R.vector_hits(table, spark.createDataFrame([(1, [1.0, 2.0, -1.0]), (2, [0.0, 0.0, 0.0]), (3, [-1.0, 0.0, 0.0])], "query int, v array<float>"), "id", "v", 30, 90).collect():
        near.setdefault(r.query, {})[r.rank] = r.doc
    for q, ask in ((1, (1, 2, -1)), (2, (0, 0, 0)), (3, (-1, 0, 0))):
        def relevance(v):
            norm = (sum(x * x for x in v) * sum(x * x for x in ask)) ** 0.5
            return round(max(0.0, sum(a * b for a, b in zip(v, ask)) / norm if norm else 0.0), 4)

        assert [near[q][n] for n in range(1, 31)] == [i for i, _ in sorted(vectors, key=lambda e: (-relevance(e[1]), e[0]))[:30]]
