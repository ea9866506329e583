"""Problem 6: source files that are not valid in any dialect of their extension."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CODE_EXTENSIONS, CONFIG_EXTENSIONS, record_text, spread
from .syntax.parse import is_valid

#: A preview of a record without full_content is cut at this length.
PREVIEW = 1000


def parsed(files: DataFrame) -> DataFrame:
    """(file_id, repository, extension, valid) of each record that has a grammar.

    Each text is recognised by a generalised LL parser that runs the grammars of all
    dialects of its extension together. NULL texts and previews that were cut have
    ``valid`` NULL: nothing can be said of them. Empty code is valid, an empty .json file
    is not. Repeated rows stay repeated; other extensions are left out.
    """
    cut = F.col("full_content").isNull() & (F.length("content_preview") >= PREVIEW)
    rows = files.filter(F.col("extension").isin(*CODE_EXTENSIONS, *CONFIG_EXTENSIONS)).select("file_id", "repository", "extension", F.when(~cut, record_text()).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = [None if t is None else is_valid(t, e) for e, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(valid, pa.bool_())], ["file_id", "repository", "extension", "valid"])

    return spread(rows).mapInArrow(run, "file_id long, repository string, extension string, valid boolean")


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id) of the records rejected by every dialect, each once."""
    return parsed(files).filter("NOT valid").select("file_id").distinct()


def invalid_rates(files: DataFrame) -> DataFrame:
    """(repository, extension, files, invalid, rate); a file_id delivered twice counts once, rate is NULL without judged files."""
    once = parsed(files).groupBy("file_id", "repository", "extension").agg(F.bool_and("valid").alias("valid"))
    counted = once.groupBy("repository", "extension").agg(F.count("valid").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
    return counted.withColumn("rate", F.try_divide(F.col("invalid").cast("double"), F.col("files")))
