"""Public tokenizers, loaded once per Python worker from files whose folder is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache
from pathlib import Path

import numpy as np

FOLDER = "/opt/tokenizers"

#: Fixed value: the published pattern that splits a text into the words of the byte-level vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def byte_bpe(folder: str = FOLDER, name: str = "byte_bpe_50k"):
    """The byte-level BPE encoder; special tokens' names are ordinary text to it."""
    import tiktoken

    lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}
    return tiktoken.Encoding(name, pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


_PIECE = 256  # characters; a longer string is measured piece by piece, so that the time stays linear


def chars_per_token(text: str, folder: str = FOLDER) -> float:
    """Mean characters for each subword: about 4 to 6 in words, 2 or less in random strings."""
    encode = byte_bpe(folder).encode_ordinary
    if len(text) <= _PIECE:
        return len(text) / max(1, len(encode(text)))
    return len(text) / sum(len(encode(text[i : i + _PIECE])) for i in range(0, len(text), _PIECE))


_TOGETHER = 4096  # strings


def chars_per_tokens(texts: Iterable[str], folder: str = FOLDER) -> dict[str, float]:
    """``chars_per_token`` of many strings without white space, encoded together.

    The pattern keeps the line end between two strings apart from both, so each has the subwords it has alone.
    """
    encode = byte_bpe(folder).encode_ordinary
    (end,) = encode("\n")
    texts = list(texts)
    out = {x: chars_per_token(x, folder) for x in texts if not 0 < len(x) <= _PIECE}
    short = [x for x in texts if 0 < len(x) <= _PIECE]
    for i in range(0, len(short), _TOGETHER):
        part = short[i : i + _TOGETHER]
        ends = np.flatnonzero(np.array(encode("\n".join(part) + "\n")) == end)
        out.update((x, len(x) / n) for x, n in zip(part, (np.diff(ends, prepend=-1) - 1).tolist(), strict=True))
    return out
