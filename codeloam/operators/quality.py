"""Comment shares, sizes and scores of files and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import latest, record_text, stripped_lines

COMMENTED = (".py", ".js", ".ts", ".jsx", ".tsx", ".java")


def comment_lines(text: Column, extension: Column) -> Column:
    return F.size(F.filter(stripped_lines(text), lambda x: F.when(extension == ".py", x.startswith("#")).otherwise(x.startswith("//") | x.startswith("/*"))))


def filled_lines(text: Column) -> Column:
    return F.size(F.filter(stripped_lines(text), lambda x: x != ""))


def comment_ratios(files: DataFrame) -> DataFrame:
    """(file_id, repository, comment_lines, filled_lines, comment_pct) of code files; 0 percent without any other line."""
    rows = files.filter(F.col("extension").isin(*COMMENTED))
    c, n = comment_lines(record_text(), F.col("extension")), filled_lines(record_text())
    counts = latest(rows, "repository", c.alias("comment_lines"), n.alias("filled_lines"))
    share = F.when(F.col("filled_lines") > F.col("comment_lines"), F.col("comment_lines") * 100.0 / F.col("filled_lines")).otherwise(0.0)
    return counts.withColumn("comment_pct", share.cast("double"))


def complexity_indicators(files: DataFrame) -> DataFrame:
    """(repository, files, total_lines, functions, large_functions, modules, mean_lines, level) with a level from a weighted sum.

    A function is large if more than 50 lines lie between its head and the next.
    """
    from .extract import modules

    text = record_text()
    count = F.regexp_count(text, F.lit(r"(?:def|function|func)\s+\w+"))
    between = F.filter(F.slice(F.split(text, r"(?:def|function|func)\s+\w+"), 2, 1 << 30), lambda x: F.regexp_count(x, F.lit("\n")) >= 50)
    rows = latest(files, "repository", F.coalesce("lines", F.lit(0)).alias("lines"), count.alias("functions"), F.size(between).alias("large"), modules(text).alias("modules"))
    sums = rows.groupBy("repository").agg(F.count("*").alias("files"), F.sum("lines").alias("total_lines"), F.sum("functions").alias("functions"), F.sum("large").alias("large_functions"))
    names = rows.select("repository", F.explode("modules").alias("m")).groupBy("repository").agg(F.countDistinct("m").alias("modules"))
    out = sums.join(names, "repository", "left").withColumn("modules", F.coalesce("modules", F.lit(0))).withColumn("mean_lines", F.col("total_lines") / F.col("files"))
    score = F.col("files") * 100 + F.col("total_lines") + F.col("functions") * 500 + F.col("modules") * 2000
    return out.withColumn("level", F.when(score < 20_000, "Low").when(score < 100_000, "Medium").when(score < 300_000, "High").otherwise("Very High"))


def large_files(files: DataFrame, above: int = 1000) -> DataFrame:
    """(file_id, path, lines) of the files with more than ``above`` lines."""
    return latest(files, "path", "lines").filter(F.col("lines") > above)


def risk(complexity: Column) -> Column:
    return F.when(complexity <= 5, "low").when(complexity <= 10, "medium").when(complexity <= 15, "high").otherwise("very_high")


def quality_score(metrics: DataFrame) -> DataFrame:
    """Adds score and grade to rows of (average_complexity, duplication_pct, large_functions, comment_pct); NULL costs nothing."""
    c, d, n, r = (F.coalesce(F.col(x), F.lit(v)) for x, v in (("average_complexity", 0.0), ("duplication_pct", 0.0), ("large_functions", 0), ("comment_pct", 15.0)))
    lost = F.when(c > 10, F.least(F.lit(30.0), (c - 10) * 3)).otherwise(0.0) + F.when(d > 5, F.least(F.lit(25.0), d * 2)).otherwise(0.0) + F.least(F.lit(20), n * 5) + F.when(r < 5, 10).when(r > 50, 5).otherwise(0)
    scored = metrics.withColumn("score", F.greatest(F.lit(0.0), 100 - lost))
    s = F.col("score")
    return scored.withColumn("grade", F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F"))


#: Points a finding costs by severity, and the least score of each grade.
COSTS = {"critical": 20, "high": 10, "medium": 5, "low": 1}
GRADES = ((95, "A+"), (90, "A"), (85, "B+"), (80, "B"), (75, "B-"), (70, "C"), (60, "D"))


def findings_score(findings: DataFrame, by: str) -> DataFrame:
    """(by, findings, critical, high, medium, low, score, grade) from rows with a severity."""
    counts = findings.groupBy(by).agg(F.count("*").alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in COSTS))
    scored = counts.withColumn("score", F.greatest(F.lit(0), 100 - sum((F.col(s) * n for s, n in COSTS.items()), F.lit(0))))
    return scored.withColumn("grade", grade(F.col("score")))


def grade(score: Column) -> Column:
    out = None
    for least, name in GRADES:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("F")


def script_findings(files: DataFrame) -> DataFrame:
    """(file_id, line_no, severity, rule) of loops in scripts that grow arrays or query the page within the next five lines."""
    from ..functions.text import lines

    text = record_text()
    rows = files.filter(F.col("extension").isin(".js", ".ts", ".jsx", ".tsx"))
    parts = lines(text)
    at = F.sequence(F.lit(1), F.size(parts))
    window = lambda k: F.array_join(F.slice(parts, k, F.lit(5)), "\n")
    loop = lambda k: F.element_at(parts, k).rlike(r"\bfor\b\s*(?:await\s*)?\(|\bwhile\s*\(")
    marks = lambda k: F.when(window(k).rlike(r"document\.querySelector|document\.getElementById|\$\("), F.struct(k.alias("line_no"), F.lit("high").alias("severity"), F.lit("dom_query_in_loop").alias("rule"))).when(window(k).rlike(r"\.(?:push|unshift)\("), F.struct(k.alias("line_no"), F.lit("low").alias("severity"), F.lit("array_growth_in_loop").alias("rule")))
    found = F.filter(F.transform(F.filter(at, loop), marks), lambda x: x.isNotNull())
    return latest(rows, found.alias("found")).select("file_id", F.explode("found").alias("x")).select("file_id", "x.line_no", "x.severity", "x.rule")
