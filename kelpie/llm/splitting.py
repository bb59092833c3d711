"""Splitting oversized items at natural boundaries.

Method: the offsets of a text's units are prefix sums of their sizes; the natural boundaries
are a sorted array of offsets. A binary search finds the last boundary under the limit, the
next piece begins a given overlap before it, and where there is no boundary the cut is hard.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.tokenizers import FOLDER, byte_bpe

#: What may follow a boundary, from the strongest: a heading or block, an empty line, a line, a sentence, a word.
_LEVELS = [
    re.compile(r"\n(?=#{1,6} |(?:resource|module|data|variable|output|locals|provider)\b|- stage:|---|def |class |[A-Za-z_][\w.\-]*:[ \t]*\r?\n)"),
    re.compile(r"\r?\n[ \t]*\r?\n"),
    re.compile(r"\n"),
    re.compile(r"[.!?。！？][\"')\]]*\s+|[。！？]"),
    re.compile(r"\s+"),
]


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted offsets after which a piece may begin, one array for each level."""
    return [np.array([m.end() for m in level.finditer(text)], dtype=np.int64) for level in _LEVELS]


def characters(text: str) -> np.ndarray:
    """Prefix sums of the sizes of a text's code points, each of size 1."""
    return np.arange(len(text) + 1)


def tokens(folder: str = FOLDER) -> Callable[[str], np.ndarray]:
    """A measure for ``split``: prefix sums of tokens of ``byte_bpe_50k``, each counted where it begins."""

    def measure(text: str) -> np.ndarray:
        encoder = byte_bpe(folder)
        starts = encoder.decode_with_offsets(encoder.encode_ordinary(text))[1]
        return np.concatenate([[0], np.cumsum(np.bincount(np.asarray(starts, np.int64), minlength=len(text))[: len(text)])])

    return measure


def cuts(sums: np.ndarray, levels: list[np.ndarray], limit: int, overlap: int, least: float = 0.5) -> list[tuple[int, int]]:
    """(start, stop) of the pieces: each of a size of at most ``limit``, together without a gap.

    ``sums`` are prefix sums of sizes by offset, in which a binary search finds how far a
    piece may reach and how far back the next one begins. The strongest level that has a
    boundary in the part of the piece beyond ``least`` of the limit gives the cut, the weakest
    one anywhere in it the next best. A single character larger than the limit is a piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    size, total = len(sums) - 1, sums[-1]
    every = np.unique(np.concatenate(levels)) if levels else np.array([], dtype=np.int64)
    pieces, start, reached = [], 0, 0
    while total - sums[start] > limit:
        far = max(int(np.searchsorted(sums, sums[start] + limit, side="right")) - 1, reached + 1)
        stop = 0
        low = max(int(np.searchsorted(sums, sums[start] + int(limit * least))), reached)
        for level in levels:
            i = int(np.searchsorted(level, far, side="right")) - 1
            if i >= 0 and level[i] > low:
                stop = int(level[i])
                break
        if not stop:
            i = int(np.searchsorted(every, far, side="right")) - 1
            after = max(int(np.searchsorted(sums, sums[start] + overlap)), reached)
            stop = int(every[i]) if i >= 0 and every[i] > after else far
        pieces.append((start, stop))
        reached = stop
        back = max(int(np.searchsorted(sums, sums[stop] - overlap, side="left")), start + 1)
        i = int(np.searchsorted(every, back, side="left"))
        start = int(every[i]) if i < len(every) and every[i] < stop else min(back, stop)
    return [*pieces, (start, size)]


def split(
    df: DataFrame, limit: int = 3000, overlap: int = 50, key: str = "id", text: str = "text", carry: tuple[str, ...] = ("file_path",), measure: Callable[[str], np.ndarray] | None = None
) -> DataFrame:
    """Pieces ``key, carry..., chunk_index, start, stop, text`` of each text of a size above ``limit``.

    Sizes are code points, or what ``measure`` says (``tokens``); ``start`` and ``stop`` are
    always code points. Consecutive pieces share a size of ``overlap``, or less where a
    natural boundary lies closer before the cut. Smaller, empty and null texts give no rows.
    Rows that repeat a key are split once: where they differ, the smallest in the order of
    ``carry`` and text. A null key is a key like any other.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *carry))
    columns, sums_of = [key, *carry], measure or characters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                whole = row[-1]
                sums = sums_of(whole)
                if sums[-1] > limit:
                    rows += [(*row[:-1], n, start, stop, whole[start:stop]) for n, (start, stop) in enumerate(cuts(sums, boundaries(whole), limit, overlap))]
            yield pd.DataFrame(rows, columns=[*columns, "chunk_index", "start", "stop", "text"])

    wanted = df.where(F.col(text) != "") if measure else df.where(F.char_length(text) > limit)
    once = wanted.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*carry, F.col(text).alias("_text"))).alias("_row"))
    oversized = once.select(F.col("_key").alias(key), *[F.col(f"_row.{c}").alias(c) for c in carry], F.col("_row._text").alias("_text"))
    return oversized.mapInPandas(run, f"{kinds}, chunk_index int, start int, stop int, text string")
