"""Blocks of code that occur more than once."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import latest, record_text, strip

BLOCK = 10


def normalised(block: Column) -> Column:
    """Without comments of any language and with single spaces."""
    out = F.regexp_replace(block, r"(?m)#.*$", "")
    out = F.regexp_replace(out, r"(?m)//.*$", "")
    out = F.regexp_replace(out, r"(?s)/\*.*?\*/", "")
    return strip(F.regexp_replace(out, r"\s+", " "))


def block_column(size: int = BLOCK) -> Column:
    """The blocks of ``size`` lines of a text with more than 3 that aren't blank, as structs (start, n, digest)."""
    text = F.regexp_replace(record_text(), "\r\n", "\n")
    # One pass cuts the text into runs of ``size`` lines and a shorter rest.
    chunks = F.regexp_extract_all(text, F.lit(f"(?:[^\\n]*\\n){{{size}}}|[\\s\\S]+"), 0)
    block = lambda c, i: F.struct((i * size).alias("start"), F.least(F.lit(size), F.regexp_count(c, F.lit("\n")) + 1).alias("n"), F.regexp_count(c, F.lit(r"(?m)^[^\S\n]*[^\s]")).alias("filled"), normalised(c).alias("norm"))
    return _digested(F.filter(F.transform(chunks, block), lambda b: b.filled > 3))


def _digested(blocks: Column) -> Column:
    return F.transform(F.filter(blocks, lambda b: b.norm != ""), lambda b: F.struct(b.start.alias("start"), b.n.alias("n"), F.md5(b.norm).alias("digest")))


def _definitions(texts: pd.Series) -> pd.Series:
    return pd.Series([definitions(t) if t is not None else None for t in texts], dtype=object)


def definitions(text: str, longest: int = 21) -> list[dict] | None:
    """The first ``longest`` lines from each def or class on, or None where there is none or the text isn't Python."""
    from .astmetrics import parse

    tree, lines = parse(text), text.split("\n")
    at = sorted(n.lineno - 1 for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))) if tree else []
    return [{"start": s, "n": len(lines[s : s + longest]), "text": "\n".join(lines[s : s + longest])} for s in at] or None


def definition_column() -> Column:
    """Blocks from each def or class on in Python files, and those of ``block_column`` where there is none."""
    text = F.regexp_replace(record_text(), "\r\n", "\n")
    cut = F.pandas_udf(_definitions, "array<struct<start:int,n:int,text:string>>")
    own = F.transform(cut(F.when(F.col("extension") == ".py", text)), lambda b: F.struct(b.start.alias("start"), b.n.alias("n"), normalised(b.text).alias("norm")))
    return F.coalesce(_digested(own), block_column())


def exploded_blocks(rows: DataFrame) -> DataFrame:
    """(repository, file_id, path, start_line, n_lines, digest) from rows with ``blocks``."""
    each = rows.select("repository", "file_id", "path", F.explode("blocks").alias("b"))
    return each.select("repository", "file_id", "path", (F.col("b.start") + 1).alias("start_line"), F.col("b.n").alias("n_lines"), F.col("b.digest").alias("digest"))


def code_blocks(files: DataFrame, blocks: Column | None = None) -> DataFrame:
    """(repository, file_id, path, start_line, n_lines, digest) of the blocks of each file, by default those of 10 lines.

    Blocks that hold only comments are left out. The digest is the md5 of the normalised block.
    """
    return exploded_blocks(latest(files, "repository", "path", (block_column() if blocks is None else blocks).alias("blocks"), heavy=True))


def duplicate_blocks(files: DataFrame) -> DataFrame:
    """Each later block of a repository with the first block of the same digest.

    k equal blocks give k - 1 rows: the first is found by an aggregate and joined, so
    nothing is paired within a group and a hot digest is not gathered by a window.
    """
    return later_blocks(code_blocks(files))


def duplicate_definitions(files: DataFrame) -> DataFrame:
    """The same by definitions: up to 21 lines from each def or class on, in Python files that have any."""
    return later_blocks(code_blocks(files, definition_column()))


def later_blocks(blocks: DataFrame) -> DataFrame:
    first = blocks.groupBy("repository", "digest").agg(F.min(F.struct("path", "start_line", "file_id")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    pairs = blocks.join(first, ["repository", "digest"]).filter((F.col("file_id") != F.col("first.file_id")) | (F.col("start_line") != F.col("first.start_line")))
    return pairs.select("repository", F.col("first.path").alias("original_path"), F.col("first.start_line").alias("original_line"), F.col("path").alias("duplicate_path"), F.col("start_line").alias("duplicate_line"), "n_lines")


def duplication(files: DataFrame) -> DataFrame:
    """(repository, duplicate_blocks, duplicate_lines, total_lines, duplication_pct)."""
    totals = latest(files, "repository", "lines").groupBy("repository").agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"))
    return duplication_of(totals, code_blocks(files))


def duplication_of(totals: DataFrame, blocks: DataFrame) -> DataFrame:
    """The same from (repository, total_lines) and blocks. Of k equal blocks all but the first count, so sums by digest will do."""
    equal = blocks.groupBy("repository", "digest").agg(F.count("*").alias("k"), F.sum("n_lines").alias("n"), F.min(F.struct("path", "start_line", "file_id", "n_lines")).alias("first")).filter("k > 1")
    found = equal.groupBy("repository").agg(F.sum(F.col("k") - 1).alias("blocks"), F.sum(F.col("n") - F.col("first.n_lines")).alias("dup"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return totals.join(found, "repository", "left").select("repository", count("blocks").alias("duplicate_blocks"), count("dup").alias("duplicate_lines"), "total_lines", (count("dup") * 100.0 / F.greatest("total_lines", F.lit(1))).cast("double").alias("duplication_pct"))
