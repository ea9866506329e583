"""Totals of a corpus by repository, extension and language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import latest

#: Languages by extension, in order of precedence.
LANGUAGES = (("Python", (".py",)), ("JavaScript", (".js", ".jsx")), ("TypeScript", (".ts", ".tsx")), ("Java", (".java",)), ("C++", (".cpp", ".cc", ".cxx")), ("Go", (".go",)), ("Rust", (".rs",)))


def corpus_overview(files: DataFrame) -> DataFrame:
    """(repository, extension, files, total_lines) with subtotals: NULL extension for a repository, both NULL for all."""
    rows = latest(files, "repository", "extension", "lines")
    return rows.rollup("repository", "extension").agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"))


def file_types(files: DataFrame) -> DataFrame:
    """(repository, extension, files, rank) by falling count, equal counts by name."""
    counts = latest(files, "repository", "extension").groupBy("repository", "extension").agg(F.count("*").alias("files"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("files"), "extension")))


def primary_language(files: DataFrame) -> DataFrame:
    """(repository, language, total_lines) of the language with most lines; the first in LANGUAGES of equals."""
    e = F.col("extension")
    number = None
    for k, (_, extensions) in enumerate(LANGUAGES):
        number = F.when(e.isin(*extensions), k) if number is None else number.when(e.isin(*extensions), k)
    rows = latest(files, "repository", number.alias("k"), "lines").filter("k IS NOT NULL")
    sums = rows.groupBy("repository", "k").agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"))
    best = sums.groupBy("repository").agg(F.max(F.struct("total_lines", (-F.col("k")).alias("k"))).alias("b"))
    names = F.array(*(F.lit(n) for n, _ in LANGUAGES))
    return best.select("repository", F.element_at(names, (1 - F.col("b.k")).cast("int")).alias("language"), "b.total_lines")
