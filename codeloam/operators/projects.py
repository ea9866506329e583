"""What kind of project a repository is, and standards that depend on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, contains_any, labels, latest

#: Words by which a repository is classed, and points a file or name gives.
TYPES = ("educational", "production", "research", "prototype")
NAMES = ("nano", "mini", "simple", "tutorial", "learn", "demo")
FILE_WORDS = {"educational": (("# simple", "# minimal", "# tutorial", "# example"), 20), "production": (("logging", "error_handler", "production", "deploy"), 15), "research": (("experiment", "paper", "research", "arxiv"), 20)}
#: For each type of project the least complexity and size that are findings, the least share of comments and the most of copies in percent, the weights of speed and clarity, and points added to a score.
STANDARDS = {
    "educational": (20, 100, 10, 15, 0.3, 0.7, 20),
    "production": (10, 50, 20, 5, 0.8, 0.5, 0),
    "research": (15, 80, 15, 10, 0.4, 0.6, 10),
    "prototype": (15, 75, 8, 20, 0.4, 0.6, 15),
}
STANDARD = ("complexity", "function_size", "comments", "copies", "speed_weight", "clarity_weight", "bonus")
#: Words of domains, frameworks and tasks.
DOMAINS = {
    "Machine Learning": ("model", "train", "predict", "neural", "torch", "tensorflow"), "Web Service": ("api", "endpoint", "request", "response", "server"), "Data Processing": ("process", "transform", "parse", "data", "csv", "json"), "Command Line Tool": ("cli", "command", "args", "parser"),
}
FRAMEWORKS = {"Flask": "flask", "Django": "django", "Streamlit": "streamlit", "FastAPI": "fastapi", "PyTorch": "torch", "TensorFlow": "tensorflow"}
TASKS = {"Data Analysis": ("analyze", "process"), "Machine Learning": ("predict", "model"), "API Development": ("api", "endpoint"), "Data I/O": ("parse", "load")}
LAYERS = {"Model Layer": ("model",), "View Layer": ("view", "template"), "Controller/Handler": ("controller", "handler"), "Service Layer": ("service",), "Configuration": ("config", "settings")}


def project_types(files: DataFrame) -> DataFrame:
    """(repository, educational, production, research, prototype, project_type); the first of equal scores counts."""
    text = F.lower(F.coalesce("content_preview", F.lit("")))
    rows = latest(files, "repository", "lines", *(contains_any(text, words).cast("int").alias(k) for k, (words, _) in FILE_WORDS.items()))
    sums = rows.groupBy("repository").agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("n"), *(F.sum(k).alias(k) for k in FILE_WORDS))
    small = F.col("n") < 2000
    name = F.lower(F.coalesce("repository", F.lit("")))
    points = {k: F.col(k) * FILE_WORDS[k][1] for k in FILE_WORDS}
    points["educational"] = points["educational"] + F.when(contains_any(name, NAMES), 50).otherwise(0) + F.when(small, 30).otherwise(0)
    points["prototype"] = F.when(small, 20).otherwise(0).cast("long")
    scored = sums.select("repository", *(points[k].cast("long").alias(k) for k in TYPES))
    best = F.greatest(*TYPES)
    kind = None
    for k in TYPES:
        kind = F.when(F.col(k) == best, k) if kind is None else kind.when(F.col(k) == best, k)
    return scored.withColumn("project_type", kind)


def typed_findings(files: DataFrame) -> DataFrame:
    """(repository, file_id, line_no, name, rule, severity) of Python functions above the thresholds of the repository's type."""
    from . import astmetrics

    limit = lambda at: F.coalesce(*(F.when(F.col("project_type") == k, v[at]) for k, v in STANDARDS.items()))
    rows = astmetrics.functions(files).filter("NOT is_async").join(latest(files, "repository"), "file_id").join(project_types(files).select("repository", "project_type"), "repository")
    c, n = F.col("complexity_blocks"), F.col("n_lines") - 1
    complexity = F.when(c > limit(0), F.struct(F.lit("complexity").alias("rule"), F.when(c < limit(0) + 5, "medium").otherwise("high").alias("severity")))
    size = F.when(n > limit(1), F.struct(F.lit("size").alias("rule"), F.lit("low").alias("severity")))
    found = rows.select("repository", "file_id", "line_no", "name", F.explode(F.array_compact(F.array(complexity, size))).alias("f"))
    return found.select("repository", "file_id", "line_no", "name", "f.rule", "f.severity")


def _joined(*columns: str) -> Column:
    return F.lower(F.concat_ws("\n", *(F.array_join(c, " ") if c != "content_preview" else F.col(c) for c in columns)))


def domains(files: DataFrame) -> DataFrame:
    """(repository, domain, files): files that show the words of a domain."""
    text = _joined("content_preview", "functions", "imports")
    rows = latest(files, "repository", labels((k, contains_any(text, w)) for k, w in DOMAINS.items()).alias("d"))
    return rows.select("repository", F.explode("d").alias("domain")).groupBy("repository", "domain").agg(F.count("*").alias("files"))


def structures(files: DataFrame) -> DataFrame:
    """(repository, layers, frameworks, tasks, files, functions, classes, style): names found and how code is organised."""
    name = F.lower(basename(F.col("path")))
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    imports, functions = _joined("imports"), _joined("functions")
    flags = {
        **{f"l{k}": contains_any(name, w) for k, w in enumerate(LAYERS.values())}, **{f"f{k}": imports.contains(w) for k, w in enumerate(FRAMEWORKS.values())}, **{f"t{k}": contains_any(functions, w) for k, w in enumerate(TASKS.values())},
    }
    rows = latest(files, "repository", size("functions").alias("nf"), size("classes").alias("nc"), *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))
    sums = rows.groupBy("repository").agg(F.count("*").alias("files"), F.sum("nf").alias("functions"), F.sum("nc").alias("classes"), *(F.bool_or(k).alias(k) for k in flags))
    listed = lambda mark, names: F.array_join(labels((n, F.col(f"{mark}{k}")) for k, n in enumerate(names)), ", ")
    style = F.when(F.col("classes") * 10 > F.col("functions") * 3, "object-oriented").when(F.col("functions") > F.col("classes") * 3, "functions").otherwise("mixed")
    return sums.select("repository", listed("l", LAYERS).alias("layers"), listed("f", FRAMEWORKS).alias("frameworks"), listed("t", TASKS).alias("tasks"), "files", "functions", "classes", style.alias("style"))
