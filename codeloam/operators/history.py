"""Commits, changed files and the growth of functions over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rank import positioned

#: Words of messages that tell of a repair.
REPAIRS = ("fix", "bug", "error", "issue", "problem", "crash", "fault")


def commits_once(commits: DataFrame) -> DataFrame:
    """Each commit once, with the message of its last delivery."""
    at = F.coalesce(F.col("loaded_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    return commits.filter("commit IS NOT NULL").groupBy("commit").agg(F.max_by(F.struct("repository", "date", "message"), at).alias("c")).select("commit", "c.*")


def changes_once(changes: DataFrame) -> DataFrame:
    return changes.select("commit", "repository", "path", "insertions", "deletions").distinct()


def recent_commits(commits: DataFrame, days: int) -> DataFrame:
    """(commit, repository, date) within ``days`` before the repository's last commit."""
    rows = commits_once(commits)
    last = rows.groupBy("repository").agg(F.max("date").alias("_last"))
    return rows.join(last, "repository").filter(F.col("date") >= F.col("_last") - F.expr(f"INTERVAL {days} DAYS")).select("commit", "repository", "date")


def bug_fixes(commits: DataFrame, changes: DataFrame, suffix: str = ".py") -> DataFrame:
    """(commit, repository, path, date, subject) of files with ``suffix`` changed by commits whose message tells of a repair."""
    repairs = commits_once(commits).filter(F.lower("message").rlike("|".join(REPAIRS))).select("commit", "date", F.substring_index("message", "\n", 1).alias("subject"))
    return changes_once(changes).filter(F.col("path").endswith(suffix)).select("commit", "repository", "path").distinct().join(repairs, "commit")


def recent_bug_fixes(commits: DataFrame, changes: DataFrame, most: int = 500, suffix: str = ".py") -> DataFrame:
    """``bug_fixes`` among the last ``most`` commits of each repository."""
    rank = F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("date"), "commit"))
    last = commits_once(commits).withColumn("k", rank).filter(F.col("k") <= most).select("commit")
    return bug_fixes(commits, changes, suffix).join(last, "commit", "left_semi")


def bug_prone(commits: DataFrame, changes: DataFrame, least: int = 3, suffix: str = ".py") -> DataFrame:
    """(repository, path, bug_fixes) of the files repaired ``least`` times or more."""
    return bug_fixes(commits, changes, suffix).groupBy("repository", "path").agg(F.count("*").alias("bug_fixes")).filter(F.col("bug_fixes") >= least)


def churn(changes: DataFrame) -> DataFrame:
    """(repository, path, commits, insertions, deletions); NULL counts are 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return changes_once(changes).groupBy("repository", "path").agg(F.countDistinct("commit").alias("commits"), total("insertions").alias("insertions"), total("deletions").alias("deletions"))


def sampled_commits(commits: DataFrame, every: int = 7) -> DataFrame:
    """(repository, commit, position): each ``every``th commit from the newest on."""
    rows = positioned(commits_once(commits).select("repository", "commit", "date"), "repository", F.desc("date"), "commit")
    return rows.filter((F.col("position") - 1) % every == 0).select("repository", "commit", "position")


def three_points(commits: DataFrame, most: int = 100) -> DataFrame:
    """(repository, commit, point): the newest, the middle and the oldest of the last ``most`` commits."""
    by = Window.partitionBy("repository")
    rows = commits_once(commits).withColumn("k", F.row_number().over(by.orderBy(F.desc("date"), "commit"))).filter(F.col("k") <= most).withColumn("n", F.count("*").over(by))
    point = F.when(F.col("k") == 1, "newest").when(F.col("k") == F.floor(F.col("n") / 2) + 1, "middle").when(F.col("k") == F.col("n"), "oldest")
    return rows.withColumn("point", point).filter("point IS NOT NULL").select("repository", "commit", "point")


def directory(path):
    return F.when(path.contains("/"), F.element_at(F.split(path, "/"), 1)).otherwise("root")


def directories(changes: DataFrame) -> DataFrame:
    """(repository, directory, paths): different paths by top directory."""
    return changes.filter("path IS NOT NULL").select("repository", "path", directory(F.col("path")).alias("directory")).distinct().groupBy("repository", "directory").agg(F.count("*").alias("paths"))


def new_directories(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(repository, directory) of top directories changed in the later half of the commits only."""
    half = F.when(F.col("position") * 2 <= F.col("total") + 1, 1).otherwise(2)
    dated = positioned(commits_once(commits).select("repository", "commit", "date"), "repository", "date", "commit").select("commit", half.alias("half"))
    rows = changes.filter("path IS NOT NULL").select("commit", "repository", directory(F.col("path")).alias("directory")).distinct().join(dated, "commit")
    early = rows.filter("half = 1").select("repository", "directory").distinct()
    return rows.filter("half = 2").select("repository", "directory").distinct().join(early, ["repository", "directory"], "left_anti")


def history_once(history: DataFrame) -> DataFrame:
    """One row an entity and commit; of contradicting rows the one with most lines counts."""
    return history.filter("entity IS NOT NULL").groupBy("repository", "entity", "commit", "date").agg(F.max("lines").alias("lines"), F.max("complexity").alias("complexity"))


def growth_alerts(history: DataFrame, above: float = 200.0) -> DataFrame:
    """(repository, entity, points, first_lines, last_lines, growth_pct) of entities that grew more than ``above`` percent."""
    order = F.struct("date", "commit")
    rows = history_once(history).filter("lines IS NOT NULL").groupBy("repository", "entity").agg(F.count("*").alias("points"), F.min_by("lines", order).alias("first_lines"), F.max_by("lines", order).alias("last_lines"))
    growth = (F.col("last_lines") - F.col("first_lines")) * 100.0 / F.col("first_lines")
    return rows.filter("points >= 2 AND first_lines > 0").withColumn("growth_pct", growth.cast("double")).filter(F.col("growth_pct") > above)


def complexity_alerts(history: DataFrame) -> DataFrame:
    """(repository, entity, first_complexity, last_complexity) where the last exceeds 10 and one and a half times the first."""
    order = F.struct("date", "commit")
    rows = history_once(history).filter("complexity IS NOT NULL").groupBy("repository", "entity").agg(F.count("*").alias("points"), F.min_by("complexity", order).alias("first_complexity"), F.max_by("complexity", order).alias("last_complexity"))
    return rows.filter("points >= 2 AND last_complexity > 10 AND last_complexity * 2 > first_complexity * 3").drop("points")


def growth_trends(history: DataFrame, last: int = 3) -> DataFrame:
    """(repository, entity, points, lines, trend_pct): mean change in percent over the last ``last`` points.

    A change from 0 lines counts as 0. Entities with one point have trend 0.
    """
    by = Window.partitionBy("repository", "entity")
    rows = history_once(history).filter("lines IS NOT NULL")
    rows = rows.withColumn("k", F.row_number().over(by.orderBy(F.desc("date"), F.desc("commit")))).withColumn("points", F.count("*").over(by)).withColumn("before", F.lag("lines").over(by.orderBy("date", "commit")))
    change = F.when((F.col("k") < F.least(F.col("points"), F.lit(last))) & (F.col("before") > 0), (F.col("lines") - F.col("before")) * 100.0 / F.col("before")).otherwise(0.0)
    kept = rows.filter(F.col("k") <= last).withColumn("change", change)
    out = kept.groupBy("repository", "entity").agg(F.first("points").alias("points"), F.max(F.when(F.col("k") == 1, F.col("lines"))).alias("lines"), F.sum("change").alias("s"))
    return out.select("repository", "entity", "points", "lines", F.when(F.col("points") > 1, F.col("s") / (F.least("points", F.lit(last)) - 1)).otherwise(0.0).cast("double").alias("trend_pct"))


def forecasts(history: DataFrame) -> DataFrame:
    """(repository, entity, lines, predicted_lines, priority): entities with 3 points or more that will pass 100 lines in three steps."""
    rows = growth_trends(history).filter("points >= 3 AND trend_pct > 20")
    predicted = F.col("lines") * F.pow(1 + F.col("trend_pct") / 100, F.lit(3))
    return rows.withColumn("p", predicted).filter("p > 100").select("repository", "entity", "lines", F.floor("p").cast("long").alias("predicted_lines"), F.when(F.col("p") > 150, "high").otherwise("medium").alias("priority"))


def file_complexity(history: DataFrame) -> DataFrame:
    """(repository, path, commit, functions, complexity): mean over a file's functions at each commit; the path precedes ::."""
    rows = history_once(history).filter("complexity IS NOT NULL").withColumn("path", F.substring_index("entity", "::", 1))
    return rows.groupBy("repository", "path", "commit").agg(F.count("*").alias("functions"), F.avg("complexity").alias("complexity"))


def evolution_summary(commits: DataFrame, changes: DataFrame, history: DataFrame) -> DataFrame:
    """(repository, commits, changed_paths, entities, growth_alerts)."""
    c = commits_once(commits).groupBy("repository").agg(F.count("*").alias("commits"))
    p = changes.filter("path IS NOT NULL").groupBy("repository").agg(F.countDistinct("path").alias("changed_paths"))
    e = history.groupBy("repository").agg(F.countDistinct("entity").alias("entities"))
    g = growth_alerts(history).groupBy("repository").agg(F.count("*").alias("growth_alerts"))
    out = c.join(p, "repository", "left").join(e, "repository", "left").join(g, "repository", "left")
    return out.select("repository", "commits", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("changed_paths", "entities", "growth_alerts")))
