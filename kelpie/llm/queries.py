"""Queries of the text problems (2, 3, 5, 6, 7 and 8) over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.llm import credentials as C
from kelpie.llm import encoding as E
from kelpie.llm import lookalikes as L
from kelpie.llm import mixing as M
from kelpie.llm import nearduplicates as N
from kelpie.llm import splitting as S
from kelpie.plans.registry import QuerySet
from kelpie.session import table

LLM = QuerySet()


@LLM.add("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    spans = C.credentials(table(spark, d, "chunks"))
    return spans.select("id", F.explode("_spans.line_no").alias("line_no")).distinct()


@LLM.add("p2_redacted")
def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text that holds a credential, with only that blanked."""
    found = C.credentials(table(spark, d, "chunks"), keep=("id", "file_path"), redact=True).where(F.size("_spans") > 0)
    return found.select("id", "file_path", F.size("_spans").alias("credentials"), F.col("_redacted").alias("text"))


@LLM.add(
    "p2_properties",
    """SELECT id, file_path, length(text) AS size, length(text) - length(replace(text, chr(10), '')) AS line_ends, true AS blanked FROM chunks WHERE text IS NOT NULL""",
)
def p2_properties(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every redacted text: its size and lines, and all other characters but those of its credentials."""
    rows = table(spark, d, "chunks").where("text IS NOT NULL")
    found = C.credentials(rows, keep=("id", "file_path", "text"), redact=True)
    a, b = F.split("text", ""), F.split("_redacted", "")
    other = F.filter(F.zip_with(a, b, lambda x, y: (x == y) | (y == "*")), lambda same: ~same)
    return found.select(
        "id", "file_path", F.length("_redacted").cast("bigint").alias("size"), (F.length("_redacted") - F.length(F.replace("_redacted", F.lit("\n"), F.lit("")))).cast("bigint").alias("line_ends"),
        ((F.size(other) == 0) & ((F.size("_spans") > 0) == (F.col("text") != F.col("_redacted")))).alias("blanked"),
    )


_WORDS_SQL = r"""
WITH texts AS (SELECT DISTINCT id, text FROM chunks),
words AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM texts),
sizes AS (SELECT id, count(*) AS n FROM words GROUP BY id),
shared AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM words a JOIN words b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
similar_ AS (SELECT x, y FROM shared JOIN sizes a ON a.id = x JOIN sizes b ON b.id = y WHERE c * 5 >= (a.n + b.n - c) * 4)
"""


@LLM.add("p3_found", _WORDS_SQL + "SELECT x AS id_a, y AS id_b FROM similar_")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return N.pairs(*N.near_duplicates(table(spark, d, "chunks")))


@LLM.add(
    "p3_groups",
    _WORDS_SQL.replace("WITH texts", "WITH RECURSIVE texts", 1)
    + """, both_ AS (SELECT x, y FROM similar_ UNION ALL SELECT y, x FROM similar_),
    sets AS (SELECT id, string_agg(w, ' ' ORDER BY w) AS s FROM words GROUP BY id),
    classes AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies FROM sets),
    reach AS (SELECT id, id AS r FROM sets UNION SELECT reach.id, y FROM reach JOIN both_ ON x = r),
    found AS (SELECT id, min(r) AS group_id FROM reach GROUP BY id),
    degree AS (SELECT x AS id, count(DISTINCT b.class_id) AS links FROM both_ JOIN classes a ON a.id = x JOIN classes b ON b.id = y WHERE a.class_id <> b.class_id GROUP BY x)
    SELECT c.id, class_id, group_id, copies, coalesce(links, 0) AS links FROM classes c JOIN found f ON f.id = c.id LEFT JOIN degree d ON d.id = c.id""",
)
def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return N.groups(*N.near_duplicates(table(spark, d, "chunks")))


@LLM.add("p5_found", "SELECT DISTINCT id FROM chunks WHERE length(text) > 3000")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return S.split(table(spark, d, "chunks")).select("id").distinct()


@LLM.add("p5_pieces")
def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return S.split(table(spark, d, "chunks"))


@LLM.add(
    "p5_properties",
    """WITH t AS (SELECT DISTINCT id, text FROM chunks WHERE length(text) > 3000)
    SELECT id, length(text) AS size, md5(text) AS digest, true AS under_limit, true AS overlaps, true AS numbered FROM t""",
)
def p5_properties(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every text's pieces: put together they are the text, all are under the limit and overlap by at most 50, and their numbers run on."""
    parts = S.split(table(spark, d, "chunks"))
    one = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "start", "stop", "text"))).alias("p"))
    pairs = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))
    shared = F.transform(pairs, lambda x: x["a"]["stop"] - x["b"]["start"])
    whole = F.aggregate("p", F.lit(""), lambda t, x: F.concat(F.left(t, x["start"]), x["text"]))
    return one.select(
        "id", F.length(whole).cast("bigint").alias("size"), F.md5(whole).alias("digest"), (F.forall("p", lambda x: (F.length(x["text"]) <= 3000) & (F.length(x["text"]) == x["stop"] - x["start"]))).alias("under_limit"),
        F.forall(shared, lambda x: (x >= 0) & (x <= 50)).alias("overlaps"), (F.transform("p", lambda x: x["chunk_index"]) == F.sequence(F.lit(0), F.size("p") - 1)).alias("numbered"),
    )


@LLM.add("p6_ids")
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return E.encode(table(spark, d, "documents"))


@LLM.add("p6_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts back from their ids; null comes back empty, as their lists are the same."""
    return E.decode(E.encode(table(spark, d, "documents")))


@LLM.add("p7_selection")
def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@LLM.add("p7_shares")
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@LLM.add(
    "p7_properties",
    """WITH usable AS (SELECT source, count(*) FILTER (WHERE text <> '') > 0 AS has_tokens FROM documents WHERE source IS NOT NULL GROUP BY source)
    SELECT t.source, sum(target_share) AS target_share, max(repeat_cap) AS repeat_cap, coalesce(bool_or(has_tokens), false) AS takes_part, true AS cap_kept, true AS budget_met, true AS share_met
    FROM mix_targets t LEFT JOIN usable u ON u.source = t.source WHERE t.source IS NOT NULL AND target_share > 0 GROUP BY t.source""",
)
def p7_properties(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every mix: caps, budgets missed by no more than the shortest document left, and shares of those that take part."""
    shares = M.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]
    takes = F.col("available_tokens") > 0
    scaled = F.when(takes, F.col("target_share")) / F.sum(F.when(takes, F.col("target_share"))).over(Window.partitionBy(F.lit(1)))
    everything = Window.partitionBy(F.lit(1))  # one row for each listed source
    off = F.abs(F.col("budget_tokens") - F.col("used_tokens"))
    most = (2 * F.sum(off).over(everything) + F.count(F.lit(1)).over(everything)) / F.sum("used_tokens").over(everything)  # what budgets missed and rounded come to
    return shares.select(
        "source", "target_share", "repeat_cap", takes.alias("takes_part"), (F.col("most_uses") <= F.col("repeat_cap")).alias("cap_kept"),
        (off <= F.coalesce("shortest_left", F.lit(0))).alias("budget_met"), (F.abs(F.col("actual_share") - F.coalesce(scaled, F.lit(0.0))) <= most).alias("share_met"),
    )


@LLM.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return L.pairs(L.same_look(table(spark, d, "documents")))


@LLM.add("p8_forms")
def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every text."""
    return L.skeletons(table(spark, d, "documents")).select("doc_id", F.col("skeleton").alias("form"))


@LLM.add("p8_groups")
def p8_groups(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose look another text shares, one row each."""
    return L.groups(L.same_look(table(spark, d, "documents")))
