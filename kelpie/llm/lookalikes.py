"""Visually identical text with different characters: one form for all that looks the same.

Method: a skeleton. Decompose, replace every character by its prototype, decompose again;
texts with equal skeletons look the same.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators.skew import split_join
from kelpie.session import materialize, spread

# Letters of other scripts and the Latin letters that look the same, in Unicode order of each script.
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϜϲϳϹϺͿ", "ABEZHIKMNOPTYXvoFcjCMJ"))
_CYRILLIC = dict(zip("ЅІЈАВЕКМНОРСТХаеорсухѕіјѴѵҮүһӀӏӔӕӘәӠӡԁԌԚԛԜԝ", "SIJABEKMHOPCTXaeopcyxsijVvYyhIlÆæƏəƷʒdGQqWw"))
_ARMENIAN = dict(zip("ԼՍՏՕզհոսցօ", "LUSOqhnugo"))
_CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiAJEWMHYGZ4SVSLCPKdGB"))
_COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ", "HIKMNOoPpCcTYX"))
_LISU = dict(zip("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"))
_LATIN = {"ɑ": "a", "ɡ": "g"} | dict(zip("ᴄᴏꜱᴜᴠᴡᴢɪ", "cosuvwzi"))  # small capitals with the shape of the small letter
_MARKS = {"‐": "-", "‑": "-", "․": ".", "∕": "/", "∶": ":"}
PROTOTYPES = _GREEK | _CYRILLIC | _ARMENIAN | _CHEROKEE | _COPTIC | _LISU | _LATIN | _MARKS

# Where a compatible form has the shape of the characters it decomposes to: digraphs, micro sign,
# dots, doubled marks, Roman numerals, radicals, ligatures. Elsewhere it shows (raised, in a circle, a fraction).
_SAME_SHAPE = [(0xB5, 0xB5), (0x132, 0x133), (0x149, 0x149), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2024, 0x2026), (0x2033, 0x2034), (0x203C, 0x203C), (0x2047, 0x2049), (0x2057, 0x2057), (0x2160, 0x217F), (0x2E9F, 0x2E9F), (0x2EF3, 0x2FD5), (0xFB00, 0xFB06), (0xFB13, 0xFB17)]

# Characters that are displayed as nothing beyond the format class of Unicode.
_NOTHING = {"͏", "ᅟ", "ᅠ", "឴", "឵", "ㅤ", "ﾠ", *map(chr, range(0x180B, 0x1810)), *map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0xE0100, 0xE01F0))}


class _Table(dict):
    """Prototype of each character met, by rule: invisible ones vanish; width variants, kinds of space, styled
    letters of formulas and forms of the same shape fold, look-alike letters take the Latin letter, everything else stays."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        parts = unicodedata.decomposition(c).split()
        if unicodedata.category(c) == "Cf" or c in _NOTHING:
            to = ""
        elif unicodedata.category(c) == "Zs":
            to = " "
        elif c in PROTOTYPES:
            to = PROTOTYPES[c]
        elif parts and (parts[0] in ("<wide>", "<narrow>", "<font>") or parts[0] == "<compat>" and any(a <= code <= b for a, b in _SAME_SHAPE)):
            to = "".join(self[ord(x)] for x in unicodedata.normalize("NFD", "".join(chr(int(p, 16)) for p in parts[1:])))
        else:
            to = c
        self[code] = to
        return to


@lru_cache(maxsize=1)
def _table() -> _Table:
    return _Table()


def skeleton(text: str) -> str:
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_table()))


def skeletons(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the text as ``original`` and its form as ``skeleton``, for every row.

    A null text has a null form, an empty one an empty form. Case, accents, digits, raised
    digits and punctuation stay as they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["skeleton"] = [None if t is None else skeleton(t) for t in b["original"]]
            yield b

    columns = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(df.select(*keep, F.col(text).alias("original"))).mapInPandas(run, f"{columns}, original string, skeleton string")


def same_look(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, look, form`` of the documents whose look another text shares.

    ``look`` identifies the skeleton, ``form`` the exact text, both by SHA-256. Null and
    empty texts take no part; texts of invisible characters alone look alike. Written once.
    """
    marked = materialize(
        skeletons(df.where(F.col(text) != ""), text, (doc_id,))
        .select(F.col(doc_id).alias("id"), F.unhex(F.sha2("skeleton", 256)).alias("look"), F.unhex(F.sha2("original", 256)).alias("form")),
        "looks",
    )
    forms = marked.groupBy("look", "form").agg(F.count(F.lit(1)).alias("copies"))
    shared = forms.groupBy("look").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1").select("look")
    return materialize(split_join(marked, shared, ["look"], ["id"], "left_semi"), "same_look")


def groups(members: DataFrame) -> DataFrame:
    """One row for each document of ``same_look``: its look and its text, named by their smallest id, and how many texts and documents the look has."""
    texts = members.groupBy("look", "form").agg(F.min("id").alias("text_id"), F.count(F.lit(1)).alias("copies"))
    looks = texts.groupBy("look").agg(F.min("text_id").alias("look_id"), F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("documents"))
    named = split_join(members, texts.join(looks, "look"), ["look", "form"], ["id"])
    return named.select(F.col("id").alias("doc_id"), "look_id", "text_id", "texts", "documents")


def pairs(members: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b`` of documents with one look and different texts: all pairs, as its columns say; ``groups`` is the linear form.

    The few forms of a look are paired first and then joined with their documents, so that
    no pair of copies is ever made only to be dropped. Documents of a form with very many
    are split in both joins.
    """
    forms = members.select("look", "form").distinct()
    other = forms.select("look", F.col("form").alias("form_b"))
    joined = forms.withColumnRenamed("form", "form_a").join(other, "look").where("form_a < form_b")
    a = members.select("look", F.col("form").alias("form_a"), F.col("id").alias("a"))
    b = members.select("look", F.col("form").alias("form_b"), F.col("id").alias("b"))
    first = split_join(a, joined, ["look", "form_a"], ["a"])
    return split_join(b, first, ["look", "form_b"], ["b"]).select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
