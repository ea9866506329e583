"""Column expressions on texts, lines and paths, evaluated by the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space at both ends; Spark's own trim removes spaces only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def stripped_lines(text: Column, first: int | None = None) -> Column:
    parts = lines(text)
    return F.transform(F.slice(parts, 1, first) if first else parts, strip)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The basename without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any word is a substring of ``text``; NULL counts as empty."""
    text = F.coalesce(text, F.lit(""))
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def labels(rules: Iterable[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in the order of the rules."""
    return F.filter(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules)), lambda x: x.isNotNull())


def record_text() -> Column:
    return F.coalesce(F.col("full_content"), F.col("content_preview"), F.lit(""))


def latest(files: DataFrame, *keep: Column | str, key: str = "file_id", order: str = "loaded_at", heavy: bool = False) -> DataFrame:
    """One row a ``key`` with the columns ``keep`` of its last delivery.

    Only the kept columns are shuffled, after partial aggregation, so features should be
    computed before texts are dropped. ``heavy`` ones are computed on every core even if
    the input has few splits.
    """
    if heavy:
        from .arrow import spread

        files = spread(files)
    columns = [F.col(c) if isinstance(c, str) else c for c in keep]
    rows = files.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.coalesce(F.col(order).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("_order"), F.struct(*columns).alias("_kept"))
    return rows.groupBy("_key").agg(F.max_by("_kept", "_order").alias("_kept")).select(F.col("_key").alias(key), "_kept.*")
