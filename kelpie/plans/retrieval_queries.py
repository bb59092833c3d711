"""Queries of retrieval: keyword and vector ranking, fusion, relevance, file search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import text as T
from kelpie.operators import retrieval as R
from kelpie.operators import stores as S
from kelpie.plans.registry import QuerySet
from kelpie.session import table

RETRIEVAL = QuerySet()

#: The queries of a search: every document whose id is divisible by 20, by its first line.
_ASKED = "asked AS (SELECT doc_id AS query, regexp_extract(text, '^[^\\n]*', 0) AS q FROM documents WHERE doc_id % 20 = 0 AND text <> '')"
_TERMS = """flatten(list_transform(regexp_extract_all({0}, '[a-zA-Z0-9][a-zA-Z0-9_-]*'),
  lambda t: CASE WHEN len(regexp_split_to_array(t, '[-_]')) > 1 THEN list_concat([t], list_filter(regexp_split_to_array(t, '[-_]'), lambda p: length(p) > 1)) ELSE [t] END))"""
_BODY = "lower(coalesce(text, '') || ' ' || coalesce(file_path, ''))"
_BM25 = f"""
WITH {_ASKED},
listed AS (SELECT doc_id AS doc, {_TERMS.format(_BODY)} AS ts FROM documents),
sizes AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM listed),
post AS (SELECT doc, len(ts) AS dl, term, count(*) AS tf FROM (SELECT doc, ts, unnest(ts) AS term FROM listed) GROUP BY ALL),
wanted AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({_TERMS.format('lower(q)')}) AS term FROM asked) GROUP BY ALL),
idf AS (SELECT term, ln((n + 1.0) / count(*)) AS idf FROM post, sizes GROUP BY term, n),
scored AS (SELECT w.query, p.doc, round(sum(w.qtf * i.idf * (1 + p.tf * 2.5 / (1.5 * (0.25 + 0.75 * p.dl / s.mean) + p.tf))), 6) AS score
  FROM post p JOIN wanted w ON w.term = p.term JOIN idf i ON i.term = p.term, sizes s GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored)
"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where("doc_id % 20 = 0 AND text <> ''").select(F.col("doc_id").alias("query"), F.regexp_extract("text", r"^[^\n]*", 0).alias("q"))


def _body() -> F.Column:
    return F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("file_path", F.lit("")))


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    return R.index(_documents(spark, d), "doc_id", _body())


@RETRIEVAL.add("keyword_search", _BM25 + "SELECT query, doc, score, rank, round(score / max(score) OVER (PARTITION BY query) * 100, 1) AS relevance_pct FROM ranked WHERE rank <= 20")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    asked, back = R.once(_asked(spark, d))
    return back(R.keyword_hits(_indexed(spark, d), asked))


@RETRIEVAL.add(
    "keyword_search_filtered",
    _BM25.replace("scored AS (SELECT", "scored AS (SELECT").replace("ranked AS (SELECT *, row_number", "kept AS (SELECT s.* FROM scored s JOIN documents d ON d.doc_id = s.doc WHERE d.source = 'runbooks'),\nranked AS (SELECT *, row_number").replace("AS rank FROM scored", "AS rank FROM kept")
    + "SELECT query, doc, score, rank, round(score / max(score) OVER (PARTITION BY query) * 100, 1) AS relevance_pct FROM ranked WHERE rank <= 20",
)
def keyword_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of all documents, hits of one source only."""
    asked, back = R.once(_asked(spark, d))
    return back(R.keyword_hits(_indexed(spark, d), asked, among=_documents(spark, d).where("source = 'runbooks'").select(F.col("doc_id").alias("doc"))))


_OVERLAP = f"""
WITH {_ASKED},
wanted AS (SELECT DISTINCT query, unnest({_TERMS.format('lower(q)')}) AS term FROM asked),
held AS (SELECT DISTINCT doc_id AS doc, unnest({_TERMS.format(_BODY)}) AS term FROM documents),
sizes AS (SELECT query, count(*) AS size FROM wanted GROUP BY query),
shared AS (SELECT w.query, h.doc, round(count(*) / any_value(s.size), 4) AS score FROM wanted w JOIN held h ON h.term = w.term JOIN sizes s ON s.query = w.query GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM shared)
"""


@RETRIEVAL.add("overlap_search", _OVERLAP + "SELECT query, doc, score, rank FROM ranked WHERE rank <= 3")
def overlap_search(spark: SparkSession, d: str) -> DataFrame:
    asked, back = R.once(_asked(spark, d))
    return back(R.overlap_hits(_indexed(spark, d), asked))


_FUSED = (
    _BM25
    + ", " + _OVERLAP.split("\nwanted AS", 1)[1].replace(" (SELECT DISTINCT query, unnest", "wanted2 AS (SELECT DISTINCT query, unnest", 1)
    .replace("sizes AS", "sizes2 AS").replace("FROM wanted GROUP", "FROM wanted2 GROUP").replace("FROM wanted w", "FROM wanted2 w").replace("JOIN sizes s", "JOIN sizes2 s").replace("ranked AS", "ranked2 AS")
    + """, lists AS (SELECT query, doc, rank, 0 AS l FROM ranked WHERE rank <= 20 UNION ALL SELECT query, doc, rank, 1 FROM ranked2 WHERE rank <= 20),
    fused AS (SELECT query, doc AS key, round(sum(1.0 / (60 + rank)), 6) AS rrf_score, count(DISTINCT l) AS lists FROM lists GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf_score DESC, key) AS rank FROM fused)"""
)


@RETRIEVAL.add("rank_fusion", _FUSED + "SELECT query, key, rrf_score, lists, rank FROM placed WHERE rank <= 20")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    asked, back = R.once(_asked(spark, d))
    return back(_fused(_indexed(spark, d), asked).drop("best_list", "best_rank"))


def _fused(indexed: DataFrame, asked: DataFrame) -> DataFrame:
    found = R.postings(indexed, asked)
    return R.fuse([R.keyword_hits(indexed, asked, found=found), R.overlap_hits(indexed, asked, 20, found)])


@RETRIEVAL.add("hybrid_search")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword hits and nearest hashed embeddings of each question, fused by rank."""
    indexed, (asked, back) = _indexed(spark, d), R.once(_asked(spark, d))
    questions = R.embed(R.index(asked, "query", F.col("q"))).select(F.col("doc").alias("query"), "v")
    return back(R.fuse([R.vector_hits(R.embed(indexed), questions, "doc", "v"), R.keyword_hits(indexed, asked)]))


@RETRIEVAL.add(
    "branch_collections",
    """SELECT DISTINCT repo, branch FROM chunks WHERE repo IS NOT NULL AND branch IS NOT NULL AND contains(translate(lower(repo || '_' || branch), '/-', '__'), 'release_25')""",
)
def branch_collections(spark: SparkSession, d: str) -> DataFrame:
    return R.collections(table(spark, d, "chunks"), "release-25")


@RETRIEVAL.add(
    "reranked_search",
    _FUSED
    + """, hits AS (SELECT query, key FROM placed WHERE rank <= 20),
    read_ AS (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '') || ' ' || coalesce(file_path, '')), '[a-zA-Z0-9][a-zA-Z0-9_-]*') AS ws FROM documents),
    spots AS (SELECT h.query, h.key, r.at_, r.term FROM hits h JOIN (SELECT doc, unnest(ws) AS term, generate_subscripts(ws, 1) AS at_ FROM read_) r ON r.doc = h.key JOIN wanted2 w ON w.query = h.query AND w.term = r.term),
    ahead AS (SELECT query, key, list_distinct(list(term) OVER (PARTITION BY query, key ORDER BY at_ RANGE BETWEEN CURRENT ROW AND 39 FOLLOWING)) AS ts FROM spots),
    best AS (SELECT query, key, max(list_sum(list_transform(ts, lambda t: CASE WHEN length(t) > 4 THEN 2 ELSE 1 END))) AS covered FROM ahead GROUP BY ALL),
    whole AS (SELECT query, sum(CASE WHEN length(term) > 4 THEN 2 ELSE 1 END) AS whole_ FROM wanted2 GROUP BY query),
    judged AS (SELECT h.query, h.key, round(coalesce(covered / whole_, 0), 6) AS score FROM hits h LEFT JOIN best b ON b.query = h.query AND b.key = h.key LEFT JOIN whole w ON w.query = h.query),
    kept AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM judged)
    SELECT query, key, score, rank FROM kept WHERE rank <= 5""",
)
def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    """The best five of the fused hits by how densely their whole texts cover the question."""
    indexed, (asked, back) = _indexed(spark, d), R.once(_asked(spark, d))
    docs = _documents(spark, d).select(F.col("doc_id").alias("doc"), "text", "file_path")
    return back(R.top(R.window_coverage(_fused(indexed, asked), asked, docs, _body()), ["query"], [F.desc("score"), F.asc("key")], 5))


#: Documents of investigations as records of them: what happened is the first line, the kind of incident is told by a word.
_KINDS = {"OOMKilled": "oom", "ProbeFailure": "probe", "SecretMount": "secret", "PipelineFailure": "pipeline"}
_CASES = "CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{k}'" for k, w in _KINDS.items()) + " ELSE 'Other' END"
_RECORDS = f"""records AS (SELECT doc_id AS id, repo AS client, repo AS service_name, {_CASES} AS incident_type, regexp_extract(text, '^[^\\n]*', 0) AS root_cause_summary, text AS resolution FROM documents WHERE source = 'investigations')"""
_VALID = f"""{_RECORDS}, valid AS (SELECT id, client, service_name, CASE WHEN incident_type = 'Other' THEN 'Unknown' ELSE incident_type END AS incident_type, root_cause_summary, resolution FROM records
  WHERE trim(coalesce(client, ''), ' ') <> '' AND trim(coalesce(root_cause_summary, ''), ' ') <> '' AND trim(coalesce(resolution, ''), ' ') <> '')"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).where("source = 'investigations'")
    kind = F.coalesce(*[F.when(F.contains(F.lower("text"), F.lit(w)), F.lit(k)) for k, w in _KINDS.items()], F.lit("Other"))
    return rows.select(
        F.col("doc_id").alias("number"), F.col("repo").alias("client"), F.col("repo").alias("service_name"), kind.alias("incident_type"), F.regexp_extract("text", r"^[^\n]*", 0).alias("root_cause_summary"),
        F.col("text").alias("resolution"), F.lit(None).cast("array<string>").alias("tags"),
    )


@RETRIEVAL.add("saved_investigations", f"WITH {_VALID} SELECT id, service_name, incident_type FROM valid")
def saved_investigations(spark: SparkSession, d: str) -> DataFrame:
    """Investigations that may be saved, with a known kind of incident."""
    return S.investigations(_records(spark, d)).select(F.col("number").alias("id"), "service_name", "incident_type")


@RETRIEVAL.add(
    "recalled_investigations",
    "WITH " + _VALID + ", " + _BM25.strip().removeprefix("WITH ").replace(f"listed AS (SELECT doc_id AS doc, {_TERMS.format(_BODY)} AS ts FROM documents)", f"""listed AS (SELECT id AS doc, {_TERMS.format("lower(concat_ws(' ', root_cause_summary, resolution, service_name, incident_type))")} AS ts FROM valid)""")
    + "SELECT query, doc, score, rank FROM ranked WHERE rank <= 3",
)
def recalled_investigations(spark: SparkSession, d: str) -> DataFrame:
    """The three past investigations closest to each question."""
    saved = S.investigations(_records(spark, d)).drop("id").withColumnRenamed("number", "id")
    return R.recall(saved, _asked(spark, d)).select("query", "doc", "score", "rank")


_COSINE = """
WITH ranked AS (SELECT a.vec_id AS query, b.vec_id AS doc,
  round(greatest(0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) AS relevance
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, doc) AS rank FROM ranked)
"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    return rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))


@RETRIEVAL.add("vector_search", _COSINE + "SELECT query, doc, relevance, rank FROM placed WHERE rank <= 20")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    return R.vector_hits(rows, asked, "vec_id", "embedding")


@RETRIEVAL.add("vector_index_search")
def vector_index_search(spark: SparkSession, d: str) -> DataFrame:
    """Approximate: only the cells nearest to each query; the tests hold its recall against the exact search."""
    rows, asked = _vectors(spark, d)
    indexed, centres = R.inverted_index(rows, "vec_id", "embedding")
    return R.indexed_hits(indexed, centres, asked)


@RETRIEVAL.add("vector_index_recall", "SELECT count(*) AS queries, count(*) * 20 AS hits, true AS recall_of_nine_tenths FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """The index against the exact search over all rows: at least nine tenths of its hits."""
    rows, asked = _vectors(spark, d)
    exact = R.vector_hits(rows, asked, "vec_id", "embedding").select("query", "doc", F.lit(1).alias("hit"))
    found = vector_index_search(spark, d).select("query", "doc", F.lit(1).alias("found"))
    both = exact.join(found, ["query", "doc"], "full")
    return both.agg(F.count_distinct(F.when(F.col("found") == 1, F.col("query"))).alias("queries"), F.count("found").alias("hits"), (F.count_if((F.col("hit") == 1) & (F.col("found") == 1)) / F.count("hit") >= 0.9).alias("recall_of_nine_tenths"))


@RETRIEVAL.add(
    "term_counts",
    f"SELECT id, len(ts) AS terms, len(list_distinct(ts)) AS distinct_terms FROM (SELECT id, {_TERMS.format(_BODY)} AS ts FROM chunks)",
)
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    ts = T.terms(_body())
    return table(spark, d, "chunks").select("id", F.size(ts).alias("terms"), F.size(F.array_distinct(ts)).alias("distinct_terms"))


_QUESTION = "rotate the deploy-token of queue"


@RETRIEVAL.add(
    "simple_relevance",
    f"""WITH c AS (SELECT id, lower(coalesce(text, '')) AS t, lower(coalesce(file_path, '')) AS p FROM chunks),
    w AS (SELECT *, list_distinct(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+')) AS have FROM c),
    a AS (SELECT *, len(list_intersect(['rotate', 'the', 'deploy', 'token', 'of', 'queue'], have)) / 6.0 AS base FROM w),
    b AS (SELECT *, CASE WHEN contains(t, '{_QUESTION}') THEN least(1.0, base + 0.3) ELSE base END AS s1 FROM a),
    m AS (SELECT *, CASE WHEN contains(t, 'deploy-token') THEN least(1.0, s1 + 0.4) ELSE s1 END AS s2 FROM b),
    n AS (SELECT *, CASE WHEN contains(p, 'deploy-token') THEN least(1.0, s2 + 0.5) ELSE s2 END AS s3, len(list_filter(['rotate', 'the', 'deploy', 'token', 'queue'], lambda x: contains(p, x))) AS hits FROM m)
    SELECT id, round(CASE WHEN hits > 0 THEN least(1.0, s3 + hits * 0.15) ELSE s3 END, 4)::DOUBLE AS relevance FROM n WHERE round(CASE WHEN hits > 0 THEN least(1.0, s3 + hits * 0.15) ELSE s3 END, 4) > 0""",
)
def simple_relevance(spark: SparkSession, d: str) -> DataFrame:
    q = F.lit(_QUESTION)
    return table(spark, d, "chunks").select("id", T.simple_relevance(q, F.col("text"), F.col("file_path")).alias("relevance")).where("relevance > 0")


@RETRIEVAL.add(
    "citations",
    """SELECT id, '[Source: ' || file_path || ' | repo: ' || coalesce(repo, 'null') || ' | branch: ' || coalesce(branch, 'null') || ' | relevance: ' || (chunk_index % 100)::VARCHAR || '.0%]' AS citation
    FROM chunks""",
)
def citations(spark: SparkSession, d: str) -> DataFrame:
    pct = (F.col("chunk_index") % 100).cast("double")
    return table(spark, d, "chunks").select("id", T.citation(F.col("file_path"), F.col("repo"), F.col("branch"), pct).alias("citation"))


@RETRIEVAL.add(
    "file_search",
    "SELECT DISTINCT file_path AS file, repo, branch FROM chunks WHERE contains(lower(file_path), 'values') AND branch = 'main' ORDER BY file, repo NULLS FIRST LIMIT 25",
)
def file_search(spark: SparkSession, d: str) -> DataFrame:
    """At most 25 files whose path holds a word, as the page of a search."""
    rows = table(spark, d, "chunks").where(F.contains(F.lower("file_path"), F.lit("values")) & (F.col("branch") == "main"))
    return rows.select(F.col("file_path").alias("file"), "repo", "branch").distinct().orderBy("file", F.asc_nulls_first("repo")).limit(25)


@RETRIEVAL.add(
    "file_coverage",
    """SELECT file_path AS file, count(*) AS chunks, CASE WHEN count(*) >= 5 THEN 'full' ELSE 'partial' END AS coverage,
    sum(coalesce(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND text NOT LIKE '%' || chr(10) THEN 1 ELSE 0 END, 0))::BIGINT AS lines FROM chunks GROUP BY file_path""",
)
def file_coverage(spark: SparkSession, d: str) -> DataFrame:
    count = F.count(F.lit(1))
    return table(spark, d, "chunks").groupBy(F.col("file_path").alias("file")).agg(
        count.alias("chunks"), T.coverage(count).alias("coverage"), F.sum(F.coalesce(T.line_count(F.col("text")), F.lit(0))).cast("bigint").alias("lines")
    )


@RETRIEVAL.add("chunk_ids", "SELECT id, left(sha256(file_path || ':' || coalesce(branch, 'default') || ':' || chunk_index), 16) AS chunk_id FROM chunks")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", T.chunk_id(F.col("file_path"), F.coalesce("branch", F.lit("default")), F.col("chunk_index")).alias("chunk_id"))


@RETRIEVAL.add(
    "pattern_lines",
    "SELECT id, CASE WHEN contains(text, 'image:') THEN length(left(text, instr(text, 'image:') - 1)) - length(replace(left(text, instr(text, 'image:') - 1), chr(10), '')) + 1 END AS line FROM chunks WHERE contains(text, 'image:')",
)
def pattern_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where(F.contains("text", F.lit("image:"))).select("id", T.line_of_first(F.col("text"), F.lit("image:")).alias("line"))
