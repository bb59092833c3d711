"""Keyword ranking, vector search and their fusion, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.names import branch_slug
from kelpie.functions.text import terms, words
from kelpie.operators.skew import split_join
from kelpie.session import materialize, spread


def top(df: DataFrame, per: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in the given order, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col(rank) <= k)


def index(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """``doc, terms, dl`` of every document, written once: its terms and their number."""
    return materialize(spread(docs.select(F.col(doc).alias("doc"), text.alias("t"))).select("doc", terms(F.col("t")).alias("terms")).withColumn("dl", F.size("terms")), "terms")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query", F.explode(terms(F.col("q"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _counted(indexed: DataFrame) -> DataFrame:
    """``doc, dl, term, tf`` of every row of ``index``, counted where the row is."""
    kind = indexed.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("terms")
            coded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(lists)))
            width = max(len(coded.dictionary), 1)
            key, tf = np.unique(row * width + np.asarray(coded.indices), return_counts=True)
            at = pa.array(key // width)
            yield pa.RecordBatch.from_arrays([b.column("doc").take(at), b.column("dl").take(at), coded.dictionary.take(pa.array(key % width)), pa.array(tf.astype(np.int64))], ["doc", "dl", "term", "tf"])

    return indexed.select("doc", "dl", "terms").mapInArrow(run, f"doc {kind}, dl int, term string, tf bigint")


def postings(indexed: DataFrame, queries: DataFrame) -> DataFrame:
    """``doc, dl, term, tf`` of every term of the queries in every document of ``index``, written once for all rankings.

    Occurrences are counted in the tasks that hold the document, then meet the queries'
    distinct terms. Only rows of an id that occurs more than once are added up afterwards.
    """
    found = _counted(indexed).join(_asked(queries).select("term").distinct(), "term", "left_semi").select("doc", "dl", "term", "tf")
    if indexed.count() > indexed.select(F.struct("doc")).distinct().count():
        found = found.groupBy("doc", "dl", "term").agg(F.sum("tf").alias("tf"))
    return materialize(found, "found")


def _gains(indexed: DataFrame, found: DataFrame, queries: DataFrame, k1: float, b: float, delta: float) -> tuple[DataFrame, DataFrame]:
    """BM25+ taken apart: (``doc, term, gain``; ``query, term, weight``), a score being the sum of gain times weight."""
    measured = indexed.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean")).first()
    n, mean = float(measured["n"]), float(measured["mean"] or 0.0) or 1.0
    gain = delta + F.col("tf") * (k1 + 1) / (k1 * (1 - b + b * F.col("dl") / mean) + F.col("tf"))
    gains = found.select("doc", "term", gain.alias("gain"))
    seen = gains.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(F.lit(n + 1) / F.col("df")) * F.col("qtf")
    return gains, _asked(queries).join(seen, "term").select("query", "term", weight.alias("weight"))


def _sums(gains: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    met = split_join(gains, wanted.select("query", "term", "weight"), ["term"], ["doc"], rows=rows)
    return met.groupBy("query", "doc").agg(F.sum(F.col("gain") * F.col("weight")).alias("score"))


def _places(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in ascending order, nulls first, and the place of each row's value among them."""
    coded = pa.concat_arrays([pa.array([], column.type), *column.chunks]).dictionary_encode(null_encoding="encode")
    order = np.asarray(pc.array_sort_indices(coded.dictionary, order="ascending", null_placement="at_start"))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[np.asarray(coded.indices)]


def _best(k: int, digits: int, each_once: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``k`` best documents of a block for each query in the final order: rounded score downward, then id."""
    scale = 10.0**digits

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        which, at, scores = [], [], []
        docs, doc = _places(rows.column("doc"))
        asked, query = _places(queries.column("query"))
        names, term = _places(rows.column("term"))
        of = pc.index_in(queries.column("term"), value_set=names)
        known = np.asarray(of.is_valid())
        of = np.asarray(of.fill_null(0)).astype(np.int64)
        order = np.lexsort((doc, term))
        term, doc, gain = term[order], doc[order], np.asarray(rows.column("gain"))[order]
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])) if len(term) else term)
        if len(new) < len(term):  # ids with several rows
            term, doc, gain = term[new], doc[new], (np.maximum if each_once else np.add).reduceat(gain, new)
        starts = np.searchsorted(term, np.arange(len(names) + 1))
        line = np.flatnonzero(known)
        line = line[np.argsort(query[line], kind="stable")]
        weight, size, per = np.asarray(queries.column("weight"))[line], np.asarray(queries.column("size"))[line], query[line]
        first, last, cuts = starts[of[line]], starts[of[line] + 1], np.searchsorted(per, np.arange(len(asked) + 1))
        for q in np.unique(per):
            sums = np.zeros(len(docs))
            for j in range(cuts[q], cuts[q + 1]):
                sums[doc[first[j] : last[j]]] += gain[first[j] : last[j]] * weight[j]
            hit = np.flatnonzero(sums)
            value = np.floor(sums[hit] / size[cuts[q]] * scale + 0.5)
            if len(hit) > k:
                least = np.partition(value, len(hit) - k)[len(hit) - k]
                above, ties = np.flatnonzero(value > least), np.flatnonzero(value == least)
                kept = np.concatenate([above, ties[: k - len(above)]])
                hit, value = hit[kept], value[kept]
            which.append(np.full(len(hit), q))
            at.append(hit)
            scores.append(value / scale)
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"query": asked.take(pa.array(joined(which, np.int64))), "doc": docs.take(pa.array(joined(at, np.int64))), "score": pa.array(joined(scores, np.float64))})

    return run


def _ranked(gains: DataFrame, wanted: DataFrame, k: int, digits: int, docs: int, asked: int, each_once: bool = False, block_docs: int = 32_768, block_terms: int = 2_000_000) -> DataFrame:
    """``query, doc, score, rank``: the ``k`` best documents by the sum of gain times weight over the query's ``size``, rounded; ties go to the smaller id.

    Queries and documents meet block by block, each with its sums in one array, so no row
    is made of a pair that is not among the best of its block. ``docs`` and ``asked`` are
    about the numbers of documents and of terms of queries. A term in several rows of an id
    counts each time, or once with ``each_once``.
    """
    across, down = docs // block_docs + 1, asked // block_terms + 1
    left = wanted.select("query", "term", F.col("weight").cast("double").alias("weight"), F.col("size").cast("double").alias("size")).withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(down)).cast("int")).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = gains.select("doc", "term", F.col("gain").cast("double").alias("gain")).withColumn("db", F.pmod(F.xxhash64("doc"), F.lit(across)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    kinds = f"query {wanted.schema['query'].dataType.simpleString()}, doc {gains.schema['doc'].dataType.simpleString()}, score double"
    best = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(_best(k, digits, each_once), kinds)
    return top(best, ["query"], [F.desc("score"), F.asc("doc")], k)


def once(queries: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Each text of ``queries`` (``query, q``) once, under the smallest of its queries, and what gives its hits to all of them.

    Of a query with several texts, all of them count.
    """
    texts = queries.groupBy("query").agg(F.sort_array(F.collect_list(F.lower("q"))).alias("qs"))
    alike = materialize(texts.withColumn("first", F.min("query").over(Window.partitionBy("qs"))), "queries")
    few = alike.where("query = first").select("query", F.array_join("qs", " ").alias("q"))

    def back(hits: DataFrame) -> DataFrame:
        return alike.select("query", "first").join(hits.withColumnRenamed("query", "first"), "first").select(*hits.columns)

    return few, back


def bm25(indexed: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, delta: float = 1.0) -> DataFrame:
    """``query, doc, score`` of every document of ``index`` that shares a term with a query (BM25+).

    ``queries`` has ``query`` and ``q`` (its text). A term repeated in a query counts each
    time. Number of documents, their mean length and the frequency of each term are those
    of all documents, those without terms included.
    """
    found = postings(indexed, queries)
    gains, wanted = _gains(indexed, found, queries, k1, b, delta)
    return _sums(gains, wanted, found.count())


def keyword_hits(indexed: DataFrame, queries: DataFrame, k: int = 20, among: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """The ``k`` best documents of each query by BM25+, with their share of the best score in per cent.

    ``among`` (``doc``) restricts the hits, while the statistics stay those of all documents.
    ``found`` is what ``postings`` gives, where other rankings need it, too. Ties go to the
    smaller document id.
    """
    found = postings(indexed, queries) if found is None else found
    gains, wanted = _gains(indexed, found, queries, 1.5, 0.75, 1.0)
    if among is not None:
        gains = gains.join(among.select("doc").distinct(), "doc", "left_semi")
    best = _ranked(gains, wanted.withColumn("size", F.lit(1.0)), k, 6, indexed.count(), _asked(queries).count())
    share = F.col("score") / F.max("score").over(Window.partitionBy("query"))
    return best.withColumn("relevance_pct", F.round(share * 100, 1))


def overlap_hits(indexed: DataFrame, queries: DataFrame, k: int = 3, found: DataFrame | None = None) -> DataFrame:
    """Ranking by the share of a query's distinct terms that a document has; ``found`` as in ``keyword_hits``."""
    found = postings(indexed, queries) if found is None else found
    asked = _asked(queries).select("query", "term")
    sizes = asked.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    wanted = asked.join(sizes, "query").withColumn("weight", F.lit(1.0))
    return _ranked(found.select("doc", "term", F.lit(1.0).alias("gain")), wanted, k, 4, indexed.count(), asked.count(), each_once=True)


def recall(investigations: DataFrame, queries: DataFrame, service: str | None = None, incident: str | None = None, k: int = 3) -> DataFrame:
    """The ``k`` past investigations closest to each query, with all their fields.

    Filters come before the index, so that frequencies are those of what is left. Blank
    queries have no hits.
    """
    kept = investigations
    for column, value in (("service_name", service), ("incident_type", incident)):
        kept = kept if value is None else kept.where(F.col(column) == value)
    fields = ["root_cause_summary", "resolution", "service_name", "incident_type"]
    body = F.concat_ws(" ", *fields, F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    hits = keyword_hits(index(kept, "id", body), queries.where(F.trim("q") != ""), k)
    return hits.join(kept.withColumnRenamed("id", "doc"), "doc")


def embed(indexed: DataFrame, dims: int = 64) -> DataFrame:
    """``doc, v``: terms hashed to signed dimensions, damped by the logarithm of their number, of length 1.

    A stand-in for a trained embedding that needs no model. A document without terms has a
    zero vector.
    """
    kind = indexed.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("h")
            flat = np.asarray(lists.flatten()).view(np.uint64)
            row = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(lists)))
            sign = np.where(flat >> np.uint64(63), 1.0, -1.0)
            sums = np.bincount(row * dims + (flat % np.uint64(dims)).astype(np.int64), weights=sign, minlength=b.num_rows * dims).reshape(-1, dims)
            damped = np.sign(sums) * np.log1p(np.abs(sums))
            norm = np.linalg.norm(damped, axis=1, keepdims=True)
            unit = (damped / np.where(norm == 0, 1, norm)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), dims).cast(pa.list_(pa.float32()))], ["doc", "v"])

    return indexed.select("doc", F.transform("terms", lambda t: F.xxhash64(t)).alias("h")).mapInArrow(run, f"doc {kind}, v array<float>")


def collections(chunks: DataFrame, branch: str | None) -> DataFrame:
    """Distinct (repo, branch) whose joined name holds the branch's slug, or all when none does or none is asked for."""
    every = chunks.where("repo IS NOT NULL AND branch IS NOT NULL").select("repo", "branch").distinct()
    if not branch or branch == "all":
        return every
    slug = branch.replace("/", "_").replace("-", "_").lower()
    some = every.where(F.contains(branch_slug(F.concat_ws("_", "repo", "branch")), F.lit(slug)))
    return every if some.isEmpty() else some


def _unit(lists: pa.Array) -> np.ndarray:
    flat = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)
    norm = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return flat / np.where(norm == 0, 1, norm)


def _nearest(k: int, slab: int = 8_388_608) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``k`` first rows of a block for each query in the final order: relevance downward, then id.

    Relevance in ten-thousandths and the place of the id make one whole number, so no two
    rows tie. Noise of the product is rounded off first, as equal vectors must not differ by
    it; at most ``slab`` numbers are held at a time.
    """

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table({"query": pa.array([], queries.schema.field("query").type), "doc": pa.array([], rows.schema.field("doc").type), "relevance": pa.array([], pa.float64())})
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc", "ascending")], null_placement="at_start"))
        a, b = _unit(queries.column("v").combine_chunks()), _unit(rows.column("v").combine_chunks())
        n = len(b)
        m, step, later = min(k, n), max(1, slab // n), np.arange(n)[::-1]
        kept = []
        for at in range(0, len(a), step):
            cosine = np.nan_to_num(a[at : at + step] @ b.T, nan=0.0)
            few = max(m, n // 16)  # the m-th of some rows bounds the m-th of all from below
            least = np.floor(np.partition(cosine[:, :few], few - m, axis=1)[:, few - m] * 1e4 - 1) / 1e4
            least[least <= 0] = -np.inf  # whatever is not above 0 ties
            for line, may in enumerate(cosine >= least[:, None]):
                may = np.flatnonzero(may)
                key = np.floor(np.round(np.maximum(cosine[line, may], 0) * 1e4, 6) + 0.5).astype(np.int64) * n + later[may]
                kept.append(np.partition(key, len(may) - m)[len(may) - m :])
        best = np.concatenate(kept)
        return pa.table(
            {
                "query": queries.column("query").combine_chunks().take(pa.array(np.repeat(np.arange(len(a)), m))),
                "doc": rows.column("doc").combine_chunks().take(pa.array(n - 1 - best % n)),
                "relevance": pa.array(best // n / 1e4),
            }
        )

    return run


def vector_hits(rows: DataFrame, queries: DataFrame, doc: str, vector: str, k: int = 20, block_rows: int = 65_536, block_queries: int = 4_096) -> DataFrame:
    """The ``k`` nearest rows of each query by cosine, exactly: queries and rows meet block by block.

    ``queries`` has ``query`` and ``v``. ``relevance`` is the cosine, not below 0, rounded to 4
    places; ties, however many, go to the smaller id, as each block orders its rows that way
    too. Null vectors take no part; a zero vector, or one with NaN, has cosine 0.
    """
    have = rows.where(F.col(vector).isNotNull()).select(F.col(doc).alias("doc"), F.col(vector).alias("v"))
    ask = queries.where("v IS NOT NULL").select("query", "v")
    across, down = have.count() // block_rows + 1, ask.count() // block_queries + 1
    left = ask.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(down))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = have.withColumn("rb", F.pmod(F.xxhash64("doc"), F.lit(across)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint"))))
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, doc {rows.schema[doc].dataType.simpleString()}, relevance double"
    near = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(_nearest(k), kinds)
    return top(near, ["query"], [F.desc("relevance"), F.asc("doc")], k)


def inverted_index(rows: DataFrame, doc: str, vector: str, cells: int | None = None, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """(every row with its ``cell``, the cells' centres): centres by spherical k-means on at most ``sample`` rows.

    There are twice as many cells as the root of the number of rows, unless told, and at most
    a twentieth of the sample, so that a centre stands for some rows; a larger cell is cut into
    blocks when it is searched.
    """
    if cells is None:
        cells = int(min(max(2 * rows.count() ** 0.5, 1), max(sample // 20, 1)))
    have = rows.where(F.col(vector).isNotNull()).select(F.col(doc).alias("doc"), F.col(vector).alias("v"))
    picked = have.orderBy(F.xxhash64(F.lit(seed), "doc")).limit(sample).toPandas()
    x = _unit(pa.array(picked["v"].tolist(), pa.list_(pa.float64()))) if len(picked) else np.zeros((1, 1))
    centres = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (nearest == c).any():
                mean = x[nearest == c].mean(axis=0)
                centres[c] = mean / (np.linalg.norm(mean) or 1)
    kind = rows.schema[doc].dataType.simpleString()
    element = rows.schema[vector].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((_unit(b.column("v")) @ centres.T).argmax(axis=1).astype(np.int32))], ["doc", "v", "cell"])

    return have.mapInArrow(assign, f"doc {kind}, v {element}, cell int"), centres


def indexed_hits(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 20, probes: int | float = 0.65, block_rows: int = 65_536) -> DataFrame:
    """The nearest rows among the ``probes`` cells closest to each query (below 1, that share of them); large cells are cut into blocks.

    Vectors in groups need few probes, vectors without any most of the cells: measure the
    recall against ``vector_hits``. A zero query is equally close to all cells and looks into
    each of them.
    """
    probes = int(np.ceil(probes * len(centres))) if probes < 1 else int(probes)
    sizes = indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))  # one row a cell: at most a twentieth of the sample
    kind, element = queries.schema["query"].dataType.simpleString(), queries.schema["v"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = _unit(b.column("v"))
                order = np.argsort(-(unit @ centres.T), axis=1, kind="stable")
                looked = np.arange(len(centres)) < np.where(unit.any(axis=1), probes, len(centres))[:, None]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(np.nonzero(looked)[0])) for c in b.columns] + [pa.array(order[looked].astype(np.int32))], ["query", "v", "cell"])

    asked = queries.where("v IS NOT NULL").select("query", "v").mapInArrow(probe, f"query {kind}, v {element}, cell int")
    left = asked.join(sizes, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = indexed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    kinds = f"query {kind}, doc {indexed.schema['doc'].dataType.simpleString()}, relevance double"
    near = left.drop("blocks").groupBy("cell", "block").cogroup(right.drop("blocks").groupBy("cell", "block")).applyInArrow(_nearest(k), kinds)
    return top(near, ["query"], [F.desc("relevance"), F.asc("doc")], k)


def fuse(lists: list[DataFrame], k: int = 60, key: str = "doc", keep: int = 20) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``query, key, rank`` from 1): sum of 1/(k + rank) for each key.

    A key that occurs more than once in a list adds up each time. ``lists`` counts the lists
    that hold it, ``best_list`` and ``best_rank`` tell where the kept occurrence stands: the
    last list that has it first, otherwise the first list that has it.
    """
    ranked = [df.select("query", F.col(key).alias("key"), "rank", F.lit(i).alias("list")) for i, df in enumerate(lists)]
    union = ranked[0]
    for df in ranked[1:]:
        union = union.unionByName(df)
    kept = F.coalesce(F.max(F.when(F.col("rank") == 1, F.struct("list", "rank"))), F.min(F.struct("list", "rank")))
    fused = union.groupBy("query", "key").agg(
        F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 6).alias("rrf_score"), F.countDistinct("list").alias("lists"), kept.alias("kept")
    )
    return top(fused, ["query"], [F.desc("rrf_score"), F.asc("key")], keep).select(
        "query", "key", "rrf_score", "lists", F.col("kept.list").alias("best_list"), F.col("kept.rank").alias("best_rank"), "rank"
    )


def _densest(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``query, doc, covered``: the most weight of a query's terms in a stretch of a text, for the pairs of a block.

    An occurrence counts for the starts of stretches up to ``window`` words ahead of it, as
    far back as the one before it of the same word.
    """

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        flat = lambda t, c: pa.concat_arrays([x.flatten() for x in t.column(c).chunks]) if t.num_rows else pa.array([], pa.string())
        edges = lambda t, c: np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(t.column(c)).fill_null(0)))]).astype(np.int64)
        coded = flat(texts, "words").dictionary_encode()
        word, begins = np.asarray(coded.indices).astype(np.int64), edges(texts, "words")
        asked = np.asarray(pc.index_in(flat(pairs, "terms"), value_set=coded.dictionary).fill_null(-1)).astype(np.int64)
        from_ = edges(pairs, "terms")
        weight = np.where(np.asarray(pc.utf8_length(coded.dictionary)) > 4, 2, 1)
        at = {}
        for i, d in enumerate(texts.column("doc").to_pylist()):
            at.setdefault(d, []).append(i)
        wanted = np.zeros(len(weight), np.int64)
        covered = np.zeros(pairs.num_rows, np.int64)
        for n, d in enumerate(pairs.column("doc").to_pylist()):
            terms = asked[from_[n] : from_[n + 1]]
            terms = terms[terms >= 0]
            wanted[terms] = weight[terms]
            for i in at.get(d, ()):
                seen = word[begins[i] : begins[i + 1]]
                spots = np.flatnonzero(wanted[seen])
                if len(spots):
                    held = seen[spots]
                    order = np.argsort(held, kind="stable")
                    before = np.full(len(spots), -1)
                    same = held[order][1:] == held[order][:-1]
                    before[order[1:][same]] = spots[order[:-1][same]]
                    change = np.zeros(len(seen) + 1, np.int64)
                    np.add.at(change, np.maximum(np.maximum(before + 1, spots - window + 1), 0), wanted[held])
                    np.add.at(change, spots + 1, -wanted[held])
                    covered[n] = max(covered[n], change.cumsum().max())
            wanted[terms] = 0
        return pa.table({"query": pairs.column("query"), "doc": pairs.column("doc"), "covered": pa.array(covered)})

    return run


def window_coverage(hits: DataFrame, questions: DataFrame, docs: DataFrame, text: Column, window: int = 40) -> DataFrame:
    """``query, key, score`` of every hit: how much of the question the densest stretch of the text covers.

    Every stretch of ``window`` words of the whole text counts. Its score is the weight of
    the question's distinct terms in it over that of all of them, a term of five letters or
    more weighing 2, any other 1. ``docs`` has ``doc`` and what ``text`` reads. Texts without
    a word of the question, and questions without terms, score 0.
    """
    weight = F.when(F.length("term") > 4, 2).otherwise(1)
    asked = _asked(questions).select("query", "term", weight.alias("weight"))
    whole = asked.groupBy("query").agg(F.sum("weight").alias("whole"))
    pairs = materialize(hits.select("query", F.col("key").alias("doc")).distinct(), "pairs")
    lists = materialize(pairs.join(asked.groupBy("query").agg(F.collect_list("term").alias("terms")), "query"), "pairs")
    blocks = lists.count() // 10_000 + 1
    block = F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("block")
    read = docs.join(pairs.select("doc").distinct(), "doc", "left_semi").select("doc", words(text).alias("words"), block)
    kinds = f"query {pairs.schema['query'].dataType.simpleString()}, doc {pairs.schema['doc'].dataType.simpleString()}, covered bigint"
    best = lists.select("query", "doc", "terms", block).groupBy("block").cogroup(read.groupBy("block")).applyInArrow(_densest(window), kinds).groupBy("query", "doc").agg(F.max("covered").alias("covered"))
    scored = pairs.join(best, ["query", "doc"], "left").join(whole, "query", "left")
    return scored.select("query", F.col("doc").alias("key"), F.round(F.coalesce(F.col("covered") / F.col("whole"), F.lit(0.0)), 6).alias("score"))


def rerank(hits: DataFrame, text: str, question: str, score: Callable[[pd.Series, pd.Series], pd.Series] | None, k: int = 5, first: int | None = None) -> DataFrame:
    """The ``k`` best of each query by a model's score of (question, text), or by rank without a model.

    The model sees the whole text, unless ``first`` says how many of its characters it takes;
    ``score`` works on whole batches. Method and score tell which of the two it was. Ties go
    to the smaller key. ``window_coverage`` is a score that needs no model.
    """
    if score is None:
        return hits.where(F.col("rank") <= k).withColumns({"rerank_score": F.lit(None).cast("double"), "method": F.lit("hybrid_rrf_no_rerank")})
    model = F.pandas_udf(lambda q, t: score(q, t).astype(float), "double")
    seen = F.col(text) if first is None else F.left(F.col(text), F.lit(first))
    scored = hits.drop("rank").withColumn("rerank_score", F.round(model(F.col(question), seen), 6))
    return top(scored, ["query"], [F.desc("rerank_score"), F.asc("key")], k).withColumn("method", F.lit("hybrid_rrf_reranked"))
