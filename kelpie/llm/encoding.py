"""Encoding of a corpus with a public tokenizer through a table of distinct words.

Spark splits the texts into words with the tokenizer's own pattern, once. Blocks of
documents keep their words as numbers into the block's list of distinct words; each distinct
word of the corpus is encoded once, its ids return to the blocks that have it and are put in
by position. Decoding puts the vocabulary's piece in the place of each id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.tokenizers import FOLDER, WORD_PATTERN, byte_bpe
from kelpie.session import materialize, spread

#: A shuffle has no more partitions than this; beyond it, partitions grow.
MOST_PARTITIONS = 100_000
#: Rows of distinct words, and blocks, that one partition of a shuffle should hold.
WORDS_EACH, BLOCKS_EACH = 200_000, 1
#: Blocks with one word beyond which the word's rows are spread over several tasks.
SPLIT_BLOCKS = 100_000


def words_of(text: str) -> Column:
    """The words of a text in order, as the tokenizer splits it; a null or empty text has none."""
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(f"(?U)({WORD_PATTERN})"), F.lit(1)), F.array().cast("array<string>"))


def _number(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    """Documents to blocks of about ``block_words`` words: a row with numbers for each, and one for each distinct word."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.list_value_length(batch.column("words"))))
        cuts = np.unique(np.searchsorted(ends, np.arange(block_words, ends[-1] + block_words, block_words)) + 1) if len(ends) else []
        start = 0
        for stop in [*(int(c) for c in cuts if c < len(ends)), len(ends)]:
            if stop <= start:
                continue
            docs = batch.slice(start, stop - start)
            words = docs.column("words")
            coded = words.flatten().dictionary_encode()
            sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(words)))])
            n, m = len(docs), len(coded.dictionary)
            numbers = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), coded.indices.cast(pa.int32()))
            names = ["block", "doc_id", "numbers", "place", "word"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), docs.column("doc_id"), numbers, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.nulls(m, docs.schema.field("doc_id").type), pa.nulls(m, numbers.type), pa.array(np.arange(m, dtype=np.int32)), coded.dictionary], names)
            start, block = stop, block + 1


def _encode(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by word: each distinct word of the partition is encoded once."""
    encoder, last, ids = byte_bpe(folder), None, []
    for batch in batches:
        run = pc.run_end_encode(batch.column("word"))
        codes = []
        for word in run.values.to_pylist():
            if word != last:
                last, ids = word, encoder.encode_ordinary(word)
            codes.append(ids)
        ends = np.asarray(run.run_ends)
        which = np.repeat(np.arange(len(codes)), np.diff(ends, prepend=0))
        taken = pa.array(codes, pa.list_(pa.int32())).take(pa.array(which))
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("place"), taken], ["block", "place", "ids"])


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block: the numbers of its documents' words, and the ids of each number."""
    numbers = left.column("numbers").combine_chunks()
    ids = right.column("ids").combine_chunks().take(pc.sort_indices(right.column("place")))
    taken = ids.take(numbers.flatten())
    sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(taken)))])
    bounds = sizes[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(numbers)))])]
    out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), taken.flatten())
    return pa.table({"doc_id": left.column("doc_id"), "ids": out})


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block_words: int = 1_000_000, folder: str = FOLDER) -> DataFrame:
    """``doc_id, ids`` for every row; ids are those of ``byte_bpe_50k`` without special tokens.

    A null or empty text has an empty list. Repeated rows and null ids stay, as blocks are
    cut from the rows as they are read, whatever their ids. A block of about ``block_words``
    words is what one task holds at a time, a longer single text makes a longer block. A word
    that very many blocks have is encoded by several tasks. Other columns are not looked at.
    """
    spark = df.sparkSession
    kind = df.schema[doc_id].dataType.simpleString()
    texts = spread(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", words_of("text").alias("words"))
    numbered = materialize(texts.mapInArrow(lambda b: _number(b, block_words), f"block bigint, doc_id {kind}, numbers array<int>, place int, word string"), "words")
    docs, lexicon = numbered.where("place IS NULL").select("block", "doc_id", "numbers"), numbered.where("place IS NOT NULL").select("block", "place", "word")
    measured = lexicon.agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("place") == 0).alias("blocks")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, blocks = (max(least, min(int(n), MOST_PARTITIONS)) for n in (measured["words"] // WORDS_EACH, measured["blocks"] // BLOCKS_EACH))
    salt = F.pmod(F.xxhash64("block"), F.lit(measured["blocks"] // SPLIT_BLOCKS + 1))
    coded = lexicon.repartition(parts, "word", salt).sortWithinPartitions("word").mapInArrow(lambda b: _encode(b, folder), "block bigint, place int, ids array<int>")
    return (
        docs.repartition(blocks, "block").groupBy("block")
        .cogroup(coded.repartition(blocks, "block").groupBy("block")).applyInArrow(_assemble, f"doc_id {kind}, ids array<int>")
    )


@lru_cache(maxsize=4)
def _pieces(folder: str, name: str) -> pa.Array:
    """The bytes of every id in order; as many as the vocabulary has, some 50,000."""
    rows = dict((int(b), base64.b64decode(a)) for a, b in map(bytes.split, filter(None, (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines())))
    return pa.array([rows.get(i) for i in range(max(rows) + 1)], pa.binary())


def vocabulary(spark: SparkSession, folder: str = FOLDER, name: str = "byte_bpe_50k") -> DataFrame:
    """``id, piece`` (bytes) of every id; as many rows as the vocabulary has, some 50,000."""
    return spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(_pieces(folder, name).to_pylist()) if p is not None], "id int, piece binary")


def decode(encoded: DataFrame, folder: str = FOLDER, name: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, text`` of every row: each id's piece in its place, joined to one text.

    The vocabulary's size is fixed, so every task has it and takes pieces by position; rows
    never leave their place, so repeated and null ids stay apart and no list is gathered. A
    null or unknown id has no piece; a null list gives a null text.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(folder, name)
        for b in batches:
            ids = b.column("ids")
            flat = ids.flatten()
            known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces))), flat, None)
            joined = pc.fill_null(pieces.take(known), b"")
            sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(ids), 0)))])
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), joined), b"")
            texts = [t.decode("utf-8", "replace") if known else None for t, known in zip(whole.to_pylist(), ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
