"""Near-duplicate records with small edits, by Bayesian candidate pruning.

Texts with one set of words form a class. Classes that share a word of their rarest ones
are candidates; this prefix filter loses no pair above the threshold, whatever the order of
the words. Candidates compare their MinHash values a few at a time and are dropped as soon
as the posterior probability of reaching the threshold falls below a tolerance. The rest
are verified exactly on their whole word sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from math import lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators.components import components
from kelpie.operators.skew import split_join
from kelpie.session import materialize, spread

WORD = "([a-z0-9_]+)"
HASHES = 64  # MinHash values of a class, a byte each
STEP = 8  # compared before each decision
TOLERANCE = 1e-7
SPLIT = 100_000  # texts with one prefix word beyond which its group is split
MOST_PARTITIONS = 100_000  # of a shuffle; beyond it, partitions grow
WORDS_EACH, BLOCKS_EACH = 200_000, 1  # words of blocks, and blocks, that one partition of a shuffle should hold
BLOCK_WORDS = 250_000  # of the texts of a block


def _minhash(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One byte of each of the MinHash values, for every list of word hashes."""
    rng = np.random.default_rng(20_240_229)
    x = (flat.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), HASHES), dtype=np.uint8)
    for k in range(HASHES):
        a, b = rng.integers(1, 2**31, 2, dtype=np.uint32)
        h = x * (a * np.uint32(2) + np.uint32(1)) + b
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        out[:, k] = np.minimum.reduceat(h, starts) & np.uint32(255)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and sorted word hashes to block, class key, size, words and sketch; at least one word each."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        words = batch.column("words")
        if not len(words):
            continue
        flat = np.asarray(words.flatten())
        sizes = np.asarray(pc.list_value_length(words))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sketch = _minhash(flat, starts)
        keys = [hashlib.blake2b(flat[a : a + n].tobytes(), digest_size=16).digest() for a, n in zip(starts, sizes)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(block + starts // BLOCK_WORDS), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), words, pa.array([r.tobytes() for r in sketch], pa.binary())],
            ["id", "block", "key", "n", "words", "sketch"],
        )
        block += int(starts[-1]) // BLOCK_WORDS + 1


def signed(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``id, block, key, n, words, sketch`` of every row that has a word; whole texts, words hashed to 64 bits."""
    kind = df.schema[key].dataType.simpleString()
    words = F.sort_array(F.transform(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(1))), lambda w: F.xxhash64(w)))
    texts = spread(df.select(F.col(key).alias("id"), F.col(text).alias("text"))).select("id", words.alias("words")).where(F.size("words") > 0)
    return texts.mapInArrow(_signed, f"id {kind}, block bigint, key binary, n int, words array<bigint>, sketch binary")


def _fresh(keys: pa.Array) -> pa.Array:
    """The first row of each key."""
    first = pc.index_in(keys, value_set=pc.unique(keys))
    return pa.array(np.unique(np.asarray(first), return_index=True)[1])


def _lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of the classes of a block, and how many of them have it; a block comes as consecutive rows."""
    for batch in batches:
        blocks = np.asarray(batch.column("block"))
        bounds = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for start, stop in zip(bounds, bounds[1:]):
            if stop > start:
                part = batch.slice(start, stop - start)
                words, uses = np.unique(np.asarray(part.take(_fresh(part.column("key"))).column("words").flatten()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), blocks[start])), pa.array(words), pa.array(uses, pa.int64())], ["block", "w", "uses"])


def _prefixes(t: Fraction) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The rarest words of each class of a block with their place, and the parts their groups are split into.

    A word that no other class has is left out, as it can lead to no pair. Words equally rare
    are in the order of their hashes, so that all blocks agree.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right.column("w")))
        known, counts = np.asarray(right.column("w")), np.asarray(right.column("count"))
        keys = left.column("key").combine_chunks()
        picked = _fresh(keys)
        left, keys = left.take(picked), keys.take(picked)
        flat, n = np.asarray(left.column("words").combine_chunks().flatten()), np.asarray(left.column("n")).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        count = counts[np.searchsorted(known, flat)] if len(flat) else np.zeros(0, np.int64)
        order = np.lexsort((flat, count, row))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        length = n - -(-t.numerator * n // t.denominator) + 1
        inside = (place < length[row]) & (count[order] > 1)
        chosen, rows = order[inside], row[inside]
        return pa.table(
            [pa.array(flat[chosen], pa.int64()), keys.take(pa.array(rows)), pa.array(n[rows], pa.int32()), pa.array(place[inside], pa.int32()), pa.array((count[chosen] // SPLIT + 1).astype(np.int32))],
            ["token", "key", "n", "place", "parts"],
        )

    return run


def rare_words(table: DataFrame, t: Fraction) -> tuple[DataFrame, bool]:
    """(``token, key, n, place, parts`` of the words of each class that may lead to a pair, whether any group is split).

    How many classes have a word is counted exactly in a partitioned table: blocks of texts
    send each of their distinct words once and get its count back, so nothing is broadcast,
    whatever the vocabulary. A class in several blocks counts in each, which changes only
    the order.
    """
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a class of n words has no partner below threshold n/(n+1)
    useful = table.where(F.col("n") + 1 >= F.lit(float(1 / (1 - t))) - 1e-9).select("block", "key", "n", "words")
    words = useful.select("block", "key", "words").mapInArrow(_lexicon, "block bigint, w bigint, uses bigint")
    size = useful.agg(F.sum("n").alias("words"), F.count_distinct("block").alias("blocks")).first()
    parts, blocks = (max(least, min(int(n or 0), MOST_PARTITIONS)) for n in ((size["words"] or 0) // WORDS_EACH // 4, size["blocks"] // BLOCKS_EACH))
    placed = words.repartition(parts, "w")
    counted = materialize(placed.select("block", "w").join(placed.groupBy("w").agg(F.sum("uses").alias("count")), "w"), "words")
    hot = (counted.agg(F.max("count")).first()[0] or 0) > SPLIT
    tokens = useful.repartition(blocks, "block").groupBy("block").cogroup(counted.repartition(blocks, "block").groupBy("block"))
    return tokens.applyInArrow(_prefixes(t), "token bigint, key binary, n int, place int, parts int"), hot


def least_matches(t: float, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """For each step, the fewest matches with which a pair may go on.

    With a uniform prior, m matches of n leave similarity a Beta(m+1, n-m+1) posterior; its
    part above ``t`` is the probability of m or fewer successes of n+1 at rate t.
    """

    def tail(m: int, n: int) -> float:
        return sum(np.exp(lgamma(n + 2) - lgamma(i + 1) - lgamma(n + 2 - i) + i * log(t) + (n + 1 - i) * log(1 - t)) for i in range(m + 1))

    return [next(m for m in range(n + 2) if m > n or tail(m, n) >= tolerance) for n in range(step, hashes + 1, step)]


def _promising(batches: Iterator[pa.RecordBatch], least: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alive = np.arange(batch.num_rows)
        if not len(alive):
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sketch_a", "sketch_b"))
        matches = np.zeros(len(alive), np.int32)
        for i, m in enumerate(least):
            part = slice(i * STEP, (i + 1) * STEP)
            matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1, dtype=np.int32)
            alive = alive[matches[alive] >= m]
        yield batch.select(["key_a", "key_b"]).take(pa.array(alive))


def similar_classes(table: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``key_a, key_b`` of different classes of ``signed`` whose similarity is at least the threshold.

    Two similar sets share a word among the rarest of each, in any fixed order of words; at
    the first such word, what follows in both sets must still suffice for the threshold.
    """
    t = Fraction(str(threshold))
    tokens, hot = rare_words(table, t)
    if hot:  # words of many texts may lead some prefixes: split their groups
        spread = tokens.dropDuplicates(["token", "key"])
        left = spread.withColumn("salt", F.pmod(F.xxhash64("key"), "parts").cast("int"))
        right = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        on = ["token", "salt"]
    else:
        left = right = tokens.drop("parts").repartition("token").dropDuplicates(["token", "key"])
        on = ["token"]
    a = left.select(*on, F.col("key").alias("key_a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"))
    b = right.select(*on, F.col("key").alias("key_b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"))
    fits = F.least("n_a", "n_b") * t.denominator >= F.greatest("n_a", "n_b") * t.numerator
    reach = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    enough = reach * (t.numerator + t.denominator) >= (F.col("n_a") + F.col("n_b")) * t.numerator
    candidates = a.join(b, on).where((F.col("key_a") < F.col("key_b")) & fits & enough).select("key_a", "key_b").distinct()

    sketches = table.select("key", "sketch").dropDuplicates(["key"])
    compared = candidates.join(sketches.select(F.col("key").alias("key_a"), F.col("sketch").alias("sketch_a")), "key_a").join(
        sketches.select(F.col("key").alias("key_b"), F.col("sketch").alias("sketch_b")), "key_b"
    )
    least = least_matches(threshold)
    left_over = materialize(compared.mapInArrow(lambda x: _promising(x, least), "key_a binary, key_b binary"), "promising")

    involved = left_over.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    sets = table.select("key", "n", "words").join(involved, "key", "left_semi").dropDuplicates(["key"])
    whole = left_over.join(sets.select(F.col("key").alias("key_a"), F.col("n").alias("n_a"), F.col("words").alias("words_a")), "key_a").join(
        sets.select(F.col("key").alias("key_b"), F.col("n").alias("n_b"), F.col("words").alias("words_b")), "key_b"
    )
    shared = F.size(F.array_intersect("words_a", "words_b"))
    enough = shared * t.denominator >= (F.col("n_a") + F.col("n_b") - shared) * t.numerator
    return whole.where(enough).select("key_a", "key_b")


def near_duplicates(df: DataFrame, threshold: float = 0.8, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): ``id, key`` of every text that has a word, and the similar pairs of classes.

    A word is a maximal run of a-z, 0-9 and _ in the lower-cased text; similarity is that of
    the sets of words. Texts of one class have similarity 1. Null, empty and wordless texts
    have no class. Rows that repeat an id count once.
    """
    table = materialize(signed(df, key, text), "signed")
    members = materialize(table.select("id", "key").distinct(), "members")
    return members, materialize(similar_classes(table, threshold), "links")


def pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs ``id_a < id_b``: the links between classes and the copies within a class, with every id.

    Classes of very many copies are split in each join.
    """
    a, b = members.select(F.col("id").alias("x"), F.col("key").alias("key_a")), members.select(F.col("id").alias("y"), F.col("key").alias("key_b"))
    across = split_join(b, split_join(a, links, ["key_a"], ["x"]), ["key_b"], ["y"]).select("x", "y")
    repeated = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    again = split_join(members, repeated, ["key"], ["id"], "left_semi")
    rows = members.count()
    copies = split_join(again.select("key", F.col("id").alias("x")), again.select("key", F.col("id").alias("y")), ["key"], ["x"], rows=rows).where("x < y").select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each id: its class, its group, the texts in its class and the classes linked to its own.

    Classes and groups are named by their smallest id.
    """
    classes = materialize(members.groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "classes")
    named = links.join(classes.select(F.col("key").alias("key_a"), F.col("class_id").alias("a")), "key_a").join(
        classes.select(F.col("key").alias("key_b"), F.col("class_id").alias("b")), "key_b"
    )
    edges = materialize(named.select("a", "b"), "class_links")
    degree = edges.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    found = components(edges).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    rich = classes.join(degree, "class_id", "left").join(found, "class_id", "left")
    return split_join(members, rich, ["key"], ["id"]).select(
        "id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links")
    )
