"""Standards, scores, advice and insights drawn from what other operators count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import basename, contains_any, labels, latest, record_text
from . import astmetrics, history, overview, projects, quality, ranking, rules

#: Points a finding costs by severity, and the part of them that counts by type of project and rule.
COSTS = {"critical": 20, "high": 10, "medium": 5, "low": 2}
RELIEF = {("educational", "complexity"): 0.5, ("educational", "size"): 0.5, ("research", "complexity"): 0.7}
#: What is said of a score and of what to do next, by type of project.
MESSAGES = {
    "educational": ("Judged as teaching material: being clear counts for more than being fast.", ("Explain the hard parts in comments.", "Choose names that speak for themselves.", "Keep a long function whole if it tells one story.")),
    "production": ("Judged as a service in use: speed, safety and upkeep all count.", ("Mend the findings of high severity first.", "Log and handle errors on every vital path.", "Cover the code with automatic tests.")),
    "research": ("Judged as research: an intricate method is fine if it is made clear.", ("Say where each method comes from.", "Pin data and libraries so that runs can be repeated.", "Accept complexity only where the method needs it.")),
    "prototype": ("Judged as a first draft: progress counts along with basic care.", ("Get the main path to work first.", "Mark what must be redone later.", "Measure before making anything faster.")),
}
#: What to look at first by type of application, and how deeply.
FOCUS = {
    "Web Application": ("routing, request_handling, data_flow", "high"),
    "CLI Application": ("argument_parsing, command_flow, output", "medium"),
    "Data Processing": ("data_input, transformations, output", "medium"),
    "Machine Learning": ("model_lifecycle, data_pipeline, training_flow", "medium"),
}
OTHER_FOCUS = ("entry_points, core_logic, dependencies", "medium")


def _lookup(spark: SparkSession, table: dict[str, tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in table.items()], schema)


def standards(files: DataFrame) -> DataFrame:
    """(repository, project_type, complexity, function_size, comments, copies, speed_weight, clarity_weight, bonus)."""
    table = _lookup(files.sparkSession, projects.STANDARDS, "project_type string, complexity int, function_size int, comments int, copies int, speed_weight double, clarity_weight double, bonus int")
    return projects.project_types(files).select("repository", "project_type").join(table, "project_type").select("repository", "project_type", *projects.STANDARD)


def context_messages(files: DataFrame) -> DataFrame:
    """(repository, project_type, message, recommendations)."""
    table = _lookup(files.sparkSession, {k: (m, " ".join(r)) for k, (m, r) in MESSAGES.items()}, "project_type string, message string, recommendations string")
    return projects.project_types(files).select("repository", "project_type").join(table, "project_type").select("repository", "project_type", "message", "recommendations")


def context_scores(files: DataFrame) -> DataFrame:
    """(repository, project_type, findings, score, grade): 100 less what the type's findings cost, with the type's points, from 0 to 100."""
    types = projects.project_types(files).select("repository", "project_type")
    return context_score(types, projects.typed_findings(files).select("repository", "rule", "severity"))


def context_score(types: DataFrame, findings: DataFrame) -> DataFrame:
    """The same from (repository, project_type) and (repository, rule, severity). The grade is that of the score before it is raised to 0."""
    choose = lambda pairs, other: F.coalesce(*(F.when(c, F.lit(float(v))) for c, v in pairs), F.lit(float(other)))
    lost = choose(((F.col("severity") == k, v) for k, v in COSTS.items()), 0) * choose((((F.col("project_type") == t) & (F.col("rule") == r), v) for (t, r), v in RELIEF.items()), 1)
    sums = findings.join(types, "repository").groupBy("repository").agg(F.count("*").alias("findings"), F.sum(lost).alias("lost"))
    bonus = choose(((F.col("project_type") == k, v[6]) for k, v in projects.STANDARDS.items()), 0)
    score = F.least(F.lit(100.0), 100.0 - F.coalesce("lost", F.lit(0.0)) + bonus)
    scored = types.join(sums, "repository", "left").select("repository", "project_type", F.coalesce("findings", F.lit(0)).alias("findings"), score.alias("raw"))
    return scored.select("repository", "project_type", "findings", F.greatest("raw", F.lit(0.0)).alias("score"), quality.grade(F.col("raw")).alias("grade"))


def findings_by(findings: DataFrame, files: DataFrame, *by: str) -> DataFrame:
    """(repository, *by, findings): how many findings of each kind."""
    return findings.join(latest(files, "repository"), "file_id").groupBy("repository", *by).agg(F.count("*").alias("findings"))


def _told(rows: DataFrame, rules: list[tuple[str, Column, Column]], name: str = "advice", most: int | None = None) -> DataFrame:
    """(repository, name, amount) of the rules that hold, in their order."""
    items = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(text).alias(name), n.cast("double").alias("amount"))) for text, c, n in rules)))
    return rows.select("repository", F.explode(F.slice(items, 1, most) if most else items).alias("x")).select("repository", "x.*")


def quality_advice(files: DataFrame) -> DataFrame:
    """(repository, advice, amount): what to do about the quality of each repository; praise where there is nothing."""
    return advice_of(astmetrics.quality(files))


def advice_of(metrics: DataFrame) -> DataFrame:
    """The same from (average_complexity, duplicate_blocks, large_functions, comment_pct); NULL means nothing to say."""
    c, d, n, r = (F.coalesce(F.col(x), F.lit(v)) for x, v in (("average_complexity", 0.0), ("duplicate_blocks", 0), ("large_functions", 0), ("comment_pct", 15.0)))
    found = [("split complex functions", c > 10, c), ("share repeated code", d > 0, d), ("split large functions", n > 0, n), ("add comments", r < 10, r)]
    return _told(metrics, [*found, ("nothing to mend", ~(found[0][1] | found[1][1] | found[2][1] | found[3][1]), F.lit(0))])


def performance_insights(files: DataFrame) -> DataFrame:
    """(repository, insight, amount) from the findings in Python files."""
    return insights_of(astmetrics.findings(files).join(latest(files, "repository"), "file_id").select("repository", "severity", "rule"))


def insights_of(findings: DataFrame) -> DataFrame:
    """The same from (repository, severity, rule): the commonest rule, critical findings, loops, queries in loops, and the state of all."""
    rules_ = findings.groupBy("repository", "rule").agg(F.count("*").alias("n"))
    commonest = rules_.groupBy("repository").agg(F.max_by("rule", F.struct("n", "rule")).alias("rule"), F.max("n").alias("most"))
    count = lambda c: F.count_if(c)
    sums = findings.groupBy("repository").agg(
        *(count(F.col("severity") == s).alias(s) for s in quality.COSTS), count(F.col("rule") == "nested_loops").alias("loops"), count(F.col("rule") == "query_in_loop").alias("queries")
    )
    score = F.greatest(F.lit(0), 100 - sum((F.col(s) * n for s, n in quality.COSTS.items()), F.lit(0)))
    rows = sums.join(commonest, "repository").withColumn("score", score)
    named = F.array(F.struct(F.concat(F.lit("commonest: "), "rule").alias("insight"), F.col("most").cast("double").alias("amount")))
    state = F.when(F.col("score") >= 90, "in good health").when(F.col("score") >= 70, "acceptable").otherwise("in need of work")
    fixed = [("critical findings", "critical"), ("nested loops", "loops"), ("queries in loops", "queries")]
    more = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.struct(F.lit(t).alias("insight"), F.col(c).cast("double").alias("amount"))) for t, c in fixed)))
    last = F.array(F.struct(state.alias("insight"), F.col("score").cast("double").alias("amount")))
    return rows.select("repository", F.explode(F.concat(named, more, last)).alias("x")).select("repository", "x.*")


def evolution_insights(commits: DataFrame, changes: DataFrame, table: DataFrame) -> DataFrame:
    """(repository, insight, subject, amount): the fastest growth, the file repaired most, how many functions will grow too large, or health."""
    every = commits.filter("repository IS NOT NULL").select("repository").distinct()
    growth = history.growth_alerts(table).groupBy("repository").agg(F.max(F.struct("growth_pct", "entity")).alias("g"))
    repairs = history.bug_prone(commits, changes).groupBy("repository").agg(F.max(F.struct("bug_fixes", "path")).alias("b"))
    later = history.forecasts(table).filter("priority = 'high'").groupBy("repository").agg(F.count("*").alias("n"))
    rows = every.join(growth, "repository", "left").join(repairs, "repository", "left").join(later, "repository", "left")
    none = F.lit(None).cast("string")
    item = lambda c, insight, subject, amount: F.when(c, F.struct(F.lit(insight).alias("insight"), subject.alias("subject"), amount.cast("double").alias("amount")))
    items = F.array(
        item(F.col("g").isNotNull(), "grew fastest", F.col("g.entity"), F.col("g.growth_pct")),
        item(F.col("b").isNotNull(), "repaired most", F.col("b.path"), F.col("b.bug_fixes")),
        item(F.col("n") > 0, "will grow too large", none, F.col("n")),
        item(F.col("g").isNull() & F.col("b").isNull(), "healthy", none, F.lit(0)),
    )
    return rows.select("repository", F.explode(F.array_compact(items)).alias("x")).select("repository", "x.*")


def application_type(files: DataFrame) -> DataFrame:
    """(repository, application_type): the type most files show, of equals the first by rule."""
    order = F.array(*(F.lit(n) for n in rules.APPLICATION_TYPES))
    rows = rules.application_types(files).filter("repository IS NOT NULL")
    return rows.groupBy("repository").agg(F.max_by("application_type", F.struct("files", -F.array_position(order, F.col("application_type")))).alias("application_type"))


def strategies(files: DataFrame) -> DataFrame:
    """(repository, application_type, focus, depth): what to look at first; repositories of no type get the general answer."""
    every = latest(files, "repository").filter("repository IS NOT NULL").select("repository").distinct()
    rows = every.join(application_type(files), "repository", "left")
    pick = lambda at: F.coalesce(*(F.when(F.col("application_type") == k, v[at]) for k, v in FOCUS.items()), F.lit(OTHER_FOCUS[at]))
    return rows.select("repository", "application_type", pick(0).alias("focus"), pick(1).alias("depth"))


def architectures(files: DataFrame) -> DataFrame:
    """(repository, patterns, style): patterns told by file names, and a style by type and number of files."""
    name = F.lower(basename(F.col("path")))
    marks = {"model": ("model",), "view": ("view",), "control": ("control",), "api": ("api",), "logic": ("business", "logic"), "data": ("data", "db"), "service": ("service",), "component": ("component",)}
    rows = latest(files, "repository", *(contains_any(name, w).alias(k) for k, w in marks.items())).filter("repository IS NOT NULL")
    sums = rows.groupBy("repository").agg(F.count("*").alias("files"), *(F.count_if(F.col(k)).alias(k) for k in marks)).join(application_type(files), "repository", "left")
    has = lambda *names: sum((F.when(F.col(n) > 0, 1).otherwise(0) for n in names), F.lit(0)) == len(names)
    patterns = labels((("MVC", has("model", "view", "control")), ("Service-oriented", F.col("service") > 2), ("Layered", has("api", "logic", "data")), ("Component-based", F.col("component") > 1)))
    kind, n = F.col("application_type"), F.col("files")
    style = F.when(kind == "Web Application", "web").when(kind == "CLI Application", "command line").when(kind == "Machine Learning", "learning pipeline").when(n > 20, "many modules").when(n < 5, "script").otherwise("modular")
    return sums.select("repository", F.array_join(patterns, ", ").alias("patterns"), style.alias("style"))


def _profile(files: DataFrame) -> DataFrame:
    """(repository, application_type, level, large_functions, entries, language)."""
    level = quality.complexity_indicators(files).select("repository", "level", "large_functions")
    entries = ranking.entry_points(files).join(latest(files, "repository"), "file_id").groupBy("repository").agg(F.count("*").alias("entries"))
    language = overview.primary_language(files).select("repository", "language")
    out = level.filter("repository IS NOT NULL")
    for part in (application_type(files), entries, language):
        out = out.join(part, "repository", "left")
    return out.withColumn("entries", F.coalesce("entries", F.lit(0)))


def visual_insights(files: DataFrame) -> DataFrame:
    """(repository, kind, item): at most six insights and five recommendations about type, size, entry points and language."""
    kind, level, entries = F.col("application_type"), F.col("level"), F.col("entries")
    of = lambda text, *c: F.when(c[0], text if isinstance(text, Column) else F.lit(text))
    insights = [
        of(F.concat(F.lit("type: "), kind), kind.isNotNull()), of("easy to understand", level == "Low"), of("divide into modules", level == "High"), of("restructure", level == "Very High"),
        of("one entry point", entries == 1), of(F.concat(F.lit("entry points: "), entries.cast("string")), entries > 5), of(F.concat(F.lit("language: "), "language"), F.col("language").isNotNull()),
    ]
    advice = [
        of("break large files up", level == "High"), of("split large functions", F.col("large_functions") > 3), of("add an entry point", entries == 0), of("join entry points", entries > 10),
        of("check requests and handle errors", kind == "Web Application"), of("describe the commands", kind == "CLI Application"), of("check the data and handle errors", kind == "Data Processing"), F.lit("look for untidy parts in the diagrams"),
    ]
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), F.slice(F.array_compact(F.array(*items)), 1, most).alias("items")) for k, items, most in (("insight", insights, 6), ("recommendation", advice, 5))))
    return _profile(files).select("repository", F.explode(parts).alias("p")).select("repository", "p.kind", F.explode("p.items").alias("item"))


def call_contexts(files: DataFrame, most: int = 15, around: int = 50) -> DataFrame:
    """(file_id, pos, name, place, context): the first calls by name, where each begins, and ``around`` characters on both sides.

    The names are those of ``extract.function_calls``; places count code points from 0.
    """
    import re

    from ..functions.arrow import map_rows
    from .extract import NOT_CALLS

    call = re.compile(r"(\w+)\s*\([^)]*\)", re.ASCII)

    def run(file_id, text):
        seen: dict[str, tuple[int, int]] = {}
        for m in call.finditer(text):
            if len(m[1]) >= 3 and m[1] not in NOT_CALLS and m[1] not in seen:
                seen[m[1]] = m.span()
                if len(seen) == most:
                    break
        return [(file_id, n, name, s, text[max(0, s - around) : e + around]) for n, (name, (s, e)) in enumerate(seen.items(), 1)]

    rows = latest(files, record_text().alias("text"))
    return map_rows(rows, run, "file_id long, pos int, name string, place int, context string")


def function_inventory(files: DataFrame, most: int = 5, longest: int = 1000) -> DataFrame:
    """(repository, inventory): the core files with their first functions, a line each, cut to ``longest`` characters."""
    core = ranking.core_files(files).select("repository", "path", "rank")
    rows = latest(files.filter(F.size("functions") > 0), "repository", "path", F.array_join(F.slice("functions", 1, most), ", ").alias("names")).join(core, ["repository", "path"])
    line = F.struct("rank", "path", F.concat("path", F.lit(": "), "names", F.lit("\n")).alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "")
    return rows.groupBy("repository").agg(F.substring(text, 1, longest).alias("inventory"))
