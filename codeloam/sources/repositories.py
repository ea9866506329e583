"""Repository addresses, source trees and cached results."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import map_rows
from ..functions.text import strip
from ..operators import extract

#: Extensions of code and of other files that are read, and directories that are not.
CODE = (".py", ".js", ".ts", ".java", ".cpp", ".c", ".go", ".rs", ".rb", ".php", ".cs", ".jsx", ".tsx")
OTHER = (".md", ".txt", ".json", ".yaml", ".yml")
PRUNED = ("node_modules", "__pycache__", "venv", "env")


def repository_of(address: Column) -> Column:
    """owner/name of an address or of a bare owner/name; NULL for anything else.

    Scheme and host may be written in any case; a final slash and a final .git are cut.
    """
    bare = F.regexp_replace(F.regexp_replace(strip(address), r"/+$", ""), r"(?i)\.git$", "")
    path = F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^@/\s]+@)?(?:[A-Za-z0-9\-]+\.)+[A-Za-z]+(?::\d+)?[/:]", "")
    found = F.regexp_extract(path, r"^([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+)(?:/.*)?$", 1), F.regexp_extract(path, r"^([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+)(?:/.*)?$", 2)
    return F.when(found[0] != "", F.concat_ws("/", F.lower(found[0]), F.lower(found[1])))


def repositories(inputs: DataFrame) -> DataFrame:
    """(repository, inputs): how many spellings of each repository came in; unreadable ones are left out."""
    return inputs.select(repository_of(F.col("input")).alias("repository")).filter("repository IS NOT NULL").groupBy("repository").agg(F.count("*").alias("inputs"))


def listed(root: str) -> Iterator[tuple[str, str]]:
    """(full path, path below root) of the files that are read, in order; hidden and pruned directories are skipped."""
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if not n.startswith(".") and n not in PRUNED)
        for f in sorted(files):
            if not f.startswith(".") and (os.path.splitext(f)[1].lower() in CODE + OTHER or f.lower() == "dockerfile"):
                full = os.path.join(folder, f)
                yield full, os.path.relpath(full, root)


def read_tree(spark: SparkSession, root: str, repository: str) -> DataFrame:
    """The files below ``root`` as code and other records; the folder must be shared by the executors.

    Undecodable bytes are dropped, files without lines or that can't be read are left out.
    Only paths pass through the driver.
    """
    paths = spark.createDataFrame(list(listed(root)), "full string, path string")

    def load(full, path):
        try:
            with open(full, "rb") as file:
                text = file.read().decode("utf-8", "ignore")
        except OSError:
            return []
        n = len(text.splitlines())
        return [(path, os.path.splitext(path)[1].lower(), n, text)] if n and text.strip() else []

    rows = map_rows(paths, load, "path string, extension string, lines int, text string")
    code = F.col("extension").isin(*CODE)
    text, extension = F.col("text"), F.col("extension")
    kind = F.when(extension.isin(".json", ".yaml", ".yml"), "configuration").otherwise("documentation")
    return rows.select(
        F.xxhash64(F.lit(repository), "path").alias("file_id"), F.lit(repository).alias("repository"), "path", "extension", "lines", F.when(code, F.substring(text, 1, 2000)).otherwise(F.substring(text, 1, 1000)).alias("content_preview"), F.when(code, text).alias("full_content"),
        F.when(code, extract.import_lines(text, extension)).alias("imports"), F.when(code, extract.function_names(text, extension)).alias("functions"), F.when(code, extract.class_names(text, extension)).alias("classes"), F.when(~code, kind).alias("file_type"),
        F.current_timestamp().cast("timestamp_ntz").alias("scanned_at"), F.current_timestamp().cast("timestamp_ntz").alias("loaded_at"),
    )


def cache_key(address: Column) -> Column:
    return F.md5(F.concat(address, F.lit("_full")))


def cached(entries: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(cache_key, repository, added_at) of the newest entry of each address that isn't older than ``hours``."""
    rows = entries.filter("input IS NOT NULL").select(cache_key(F.col("input")).alias("cache_key"), "repository", "added_at").filter(F.col("added_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    return rows.groupBy("cache_key").agg(F.max_by(F.struct("repository", "added_at"), "added_at").alias("e")).select("cache_key", "e.repository", "e.added_at")


def save(result: DataFrame, folder: str) -> None:
    """Writes a result as JSON; an older one is replaced."""
    result.write.mode("overwrite").json(folder)
