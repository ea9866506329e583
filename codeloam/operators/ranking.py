"""Files ranked by what their names, sizes and symbols tell of their weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, latest, record_text, stem

#: Names of weighty files.
FIRST = ("main.py", "app.py", "index.js", "server.py", "manage.py")
SECOND = ("readme.md", "package.json", "requirements.txt", "setup.py")
CORE = ("main.py", "app.py", "train.py", "model.py", "server.py")
ENTRY_NAMES = ("main", "index", "app", "server", "run", "start", "launch", "cli", "manage", "script", "tool", "demo", "example")


def symbols(column: str) -> Column:
    return F.coalesce(F.greatest(F.size(F.col(column)), F.lit(0)), F.lit(0))


def priority(files: DataFrame, most: int = 12) -> DataFrame:
    """(repository, path, score, rank) of the files to explain first; equal scores by path."""
    name, lines = F.lower(basename(F.col("path"))), F.coalesce("lines", F.lit(0))
    named = F.when(name.isin(*FIRST), 100).when(name.isin(*SECOND), 90).when(name.startswith("test_") | F.col("path").contains("/test"), 20).otherwise(0)
    size = F.when(lines > 100, 30).when(lines > 50, 20).when(lines > 20, 10).otherwise(0)
    kind = F.when(F.col("extension").isin(".py", ".js", ".ts", ".java"), 25).when(F.col("extension").isin(".md", ".txt"), 15).otherwise(0)
    n = symbols("functions") + symbols("classes")
    score = named + size + kind + F.when(n > 5, 20).when(n > 2, 10).otherwise(0)
    return _top(latest(files, "repository", "path", score.alias("score")), most)


def core_files(files: DataFrame, most: int = 8, above: int = 50) -> DataFrame:
    """(repository, path, score, rank) of the files richest in functions, classes and lines."""
    named = F.when(F.lower(basename(F.col("path"))).isin(*CORE), 100).otherwise(0)
    score = named + symbols("functions") * 10 + symbols("classes") * 15 + F.least(F.floor(F.coalesce("lines", F.lit(0)) / 10), F.lit(50)).cast("int")
    return _top(latest(files, "repository", "path", score.alias("score")).filter(F.col("score") > above), most)


def _top(scored: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("score"), "path"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most).select("repository", "path", "score", "rank")


def entry_points(files: DataFrame) -> DataFrame:
    """(file_id, type, priority, confidence) of each mark of an entry point."""
    text, e = record_text(), F.col("extension")
    script = e.isin(".js", ".ts", ".jsx", ".tsx")
    marks = (
        ("main_block", (e == ".py") & text.contains('if __name__ == "__main__"'), "high", 0.95),
        ("main_function", (e == ".py") & text.rlike(r"def main\s*\("), "high", 0.9),
        ("cli_entry", script & (text.contains("process.argv") | F.lower(text).contains("command line")), "high", 0.5),
        ("java_main", (e == ".java") & text.contains("public static void main"), "high", 0.95),
        ("web_server", text.contains("app.run") | text.contains("app.listen"), "high", 0.85),
        ("filename_entry", F.lower(stem(F.col("path"))).isin(*ENTRY_NAMES), "medium", 0.6),
    )
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(n).alias("type"), F.lit(p).alias("priority"), F.lit(v).alias("confidence"))) for n, c, p, v in marks)), lambda x: x.isNotNull())
    return latest(files, found.alias("marks")).select("file_id", F.explode("marks").alias("m")).select("file_id", "m.type", "m.priority", "m.confidence")
