"""Structure-aware chunking. Sections are cut by patterns inside Spark's expressions and put together by a running size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.text import extension, file_name
from kelpie.session import spread

TERRAFORM_BLOCK = r"(?m)(?=^(?:resource|data|module|variable|locals|output|provider|terraform)\s)"
TOP_KEY = r"(?m)(?=^[A-Za-z_\"'][^\n:]*:)"
STAGE = r"(?m)(?=^\s*- stage:\s*$)"


def chunker(path: Column, text: Column) -> Column:
    """Which chunker a file takes: terraform, pipeline, values, yaml or fixed."""
    ext, name = extension(path), F.lower(file_name(path))
    pipeline = F.contains(text, F.lit("pipeline:")) & F.contains(text, F.lit("stages:")) & F.contains(text, F.lit("stage:"))
    values = (name == "values.yaml") | F.startswith(name, F.lit("values-")) | (F.contains(text, F.lit("image:")) & F.contains(text, F.lit("replicaCount:")))
    yaml = ext.isin(".yaml", ".yml") & (F.trim(text) != "")
    return F.when(ext.isin(".tf", ".tfvars"), "terraform").when(yaml & pipeline, "pipeline").when(yaml & values, "values").when(yaml, "yaml").otherwise("fixed")


def _sections(text: Column, pattern: str, head: str) -> Column:
    """Pieces that begin at the pattern, with trailing blanks cut; what comes before the first is left out."""
    return F.transform(F.filter(F.split(text, pattern), lambda s: s.rlike(head)), lambda s: F.regexp_replace(s, r"\s+$", ""))


def _grouped(sections: Column, limit: int, small: Column | None, joiner: str, at_limit: bool) -> Column:
    """Small neighbours run together up to the limit; all others stay alone. ``small`` tells which, by name ``x``."""
    kind = "struct<kind:string,size:int,parts:array<string>>"
    start = F.from_json(F.lit("[]"), f"array<{kind}>")

    def step(done: Column, section: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        tiny = small(section) if small is not None else F.lit(False)
        full = (last["size"] >= limit) if at_limit else (last["size"] + F.length(section) > limit)
        joins = tiny & F.coalesce((last["kind"] == "group") & ~full, F.lit(False))
        fresh = F.struct(F.when(tiny, "group").otherwise("one").alias("kind"), F.length(section).alias("size"), F.array(section).alias("parts"))
        longer = F.struct(last["kind"].alias("kind"), (last["size"] + F.length(section)).alias("size"), F.concat(last["parts"], F.array(section)).alias("parts"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(fresh)))

    return F.transform(F.aggregate(sections, start, step), lambda g: F.struct(g["kind"].alias("kind"), F.array_join(g["parts"], joiner).alias("text")))


def _parts(section: Column, head: str, at: str, limit: int) -> Column:
    """An oversized section as its head and runs of inner items up to the limit; the section itself without such items."""
    items = F.filter(F.split(section, at), lambda s: s.rlike(head))
    runs = F.transform(_grouped(items, limit, lambda s: F.lit(True), "", False), lambda g: F.concat(F.regexp_extract(section, r"^([^\n]*\n)", 1), F.regexp_replace(g["text"], r"\s+$", "")))
    return F.when((F.length(section) > limit) & (F.size(items) > 1), runs).otherwise(F.array(section))


def structural(files: DataFrame, limit: int = 3000) -> DataFrame:
    """``file..., chunker, chunk_index, section, text`` of every file that has structure.

    ``files`` has ``id, file, text``. Terraform goes by top-level block, variables and outputs
    run together up to ``limit``; values and other YAML by top-level key, in values the
    scalars come together last, in other YAML keys under 200 characters run together; pipelines
    by stage. Sections of values and stages beyond ``limit`` are cut at keys of the second
    level and at steps. A file without any section, and
    every other kind of file, gives no row here (see ``fixed``).
    """
    text, known = F.col("text"), spread(files.where("text IS NOT NULL").select("id", "file", "text")).withColumn("chunker", chunker(F.col("file"), F.col("text"))).where("chunker <> 'fixed'")
    terraform = _grouped(_sections(text, TERRAFORM_BLOCK, r"^(?:resource|data|module|variable|locals|output|provider|terraform)\s"), limit, lambda s: s.rlike(r"^(variable|output)\s"), "\n\n", False)
    keyed = _sections(text, TOP_KEY, r"^[A-Za-z_\"'][^\n:]*:")
    nested, scalars = F.filter(keyed, lambda s: F.contains(s, F.lit("\n")) | s.rlike(":$")), F.filter(keyed, lambda s: ~(F.contains(s, F.lit("\n")) | s.rlike(":$")))
    cut = F.flatten(F.transform(nested, lambda s: _parts(s, r"^  [^\s#-]", r"(?m)(?=^  [^\s#-])", limit)))
    together = F.when(F.size(scalars) > 0, F.array(F.struct(F.lit("scalars").alias("kind"), F.array_join(scalars, "\n").alias("text")))).otherwise(F.from_json(F.lit("[]"), "array<struct<kind:string,text:string>>"))
    values = F.concat(F.transform(cut, lambda s: F.struct(F.lit("one").alias("kind"), s.alias("text"))), together)
    generic = _grouped(keyed, limit, lambda s: F.length(s) < 200, "\n", True)
    steps = F.flatten(F.transform(_sections(text, STAGE, r"^\s*- stage:"), lambda s: _parts(s, r"^\s*- step:", r"(?m)(?=^\s*- step:)", limit)))
    stages = F.transform(steps, lambda s: F.struct(F.lit("one").alias("kind"), s.alias("text")))
    by_kind = F.when(F.col("chunker") == "terraform", terraform).when(F.col("chunker") == "pipeline", stages).when(F.col("chunker") == "values", values).otherwise(generic)
    one = known.select("id", "file", "chunker", F.posexplode(by_kind).alias("chunk_index", "g"))
    body = F.col("g.text")
    name = (
        F.when(F.col("g.kind") == "group", F.when(F.col("chunker") == "terraform", "variable_group").otherwise("grouped_keys"))
        .when(F.col("g.kind") == "scalars", "root_scalars")
        .when(F.col("chunker") == "terraform", F.regexp_replace(F.regexp_extract(body, r"^(\w+(?:\s+\"[^\"]*\")*)", 1), '["]', ""))
        .when(F.col("chunker") == "pipeline", F.regexp_extract(body, r"name:[ \t]*[\"']?([^\n\"']+)", 1)).otherwise(F.regexp_extract(body, r"^[\"']?([^:\"']+)", 1))
    )
    return one.select("id", "file", "chunker", "chunk_index", name.alias("section"), body.alias("text"))


def _fixed(text: str, size: int, overlap: int) -> list[str]:
    out, start = [], 0
    while start < len(text):
        stop = start + size
        if stop >= len(text):
            out.append(text[start:])
            break
        for mark in "\n ":
            at = text.rfind(mark, start + size // 2, stop)
            if at > start:
                stop = at + 1
                break
        out.append(text[start:stop])
        start = stop - overlap
    return [p for p in (x.strip() for x in out) if p]


def fixed(files: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """``id, file, chunk_index, text``: pieces of at most ``size`` characters that end after a line or word where they can.

    Null, empty and blank texts give no row. The overlap must be under half the size, so
    that every piece goes on.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("the overlap must be under half the size")
    kind = files.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, f, n, p) for i, f, t in zip(b["id"], b["file"], b["text"]) for n, p in enumerate(_fixed(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["id", "file", "chunk_index", "text"])

    return spread(files.where("text IS NOT NULL").select("id", "file", "text")).mapInPandas(run, f"id {kind}, file string, chunk_index int, text string")
