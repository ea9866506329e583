"""Python functions on rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Uses every core when a scan has fewer splits than the cluster has cores; large inputs and other plans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().sparkPlan().toString() or "Join" in df._jdf.queryExecution().optimizedPlan().toString():
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def map_rows(df: DataFrame, function: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Applies ``function(*values)`` to each row in Arrow batches; it yields output tuples.

    ``schema`` is a DDL string. Rows of one batch are turned into columns once, so the
    cost per row is that of ``function``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in part.columns)):
                out.extend(function(*row))
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    return spread(df).mapInArrow(run, schema)
