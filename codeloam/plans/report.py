"""One row a repository with what the operators tell of it, and prompts made of that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import latest
from ..operators import overview, projects, quality, ranking, relations, rules


def repository_report(files: DataFrame) -> DataFrame:
    """(repository, files, total_lines, language, technologies, level, coupling)."""
    totals = overview.corpus_overview(files).filter("repository IS NOT NULL AND extension IS NULL").select("repository", "files", "total_lines")
    language = overview.primary_language(files).select("repository", "language")
    level = quality.complexity_indicators(files).select("repository", "level")
    coupling = relations.coupling(files).select("repository", "coupling")
    out = totals
    for part in (language, rules.technologies(files), level, coupling):
        out = out.join(part, "repository", "left")
    return out.select("repository", "files", "total_lines", F.coalesce("language", F.lit("none")).alias("language"), "technologies", "level", "coupling")


def _listed(rows: DataFrame, item: Column, *order: Column | str) -> DataFrame:
    """(repository, text): the items of each repository in order, with semicolons; few by repository."""
    struct = F.struct(F.row_number().over(Window.partitionBy("repository").orderBy(*order)).alias("n"), item.alias("item"))
    each = rows.select("repository", struct.alias("s"))
    return each.groupBy("repository").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["item"]), "; ").alias("text"))


def intelligence(files: DataFrame) -> DataFrame:
    """(repository, files, patterns, layers, imports, tasks, purposes, import_level, function_level, technologies).

    ``patterns`` counts files that look like each kind of project, ``imports`` names the five
    commonest import lines, ``purposes`` counts files by purpose; lists are joined with semicolons.
    """
    counted = rules.file_patterns(files).filter("repository IS NOT NULL").groupBy("repository").agg(F.count("*").alias("files"), *(F.count_if(F.col(k)).alias(k) for k in rules.FILE_PATTERNS))
    pattern = F.array_join(F.array_compact(F.array(*(F.when(F.col(k) > 0, F.concat(F.lit(f"{k}: "), F.col(k).cast("string"))) for k in rules.FILE_PATTERNS))), "; ")
    out = counted.select("repository", "files", pattern.alias("patterns"))
    named = lambda df, column: df.filter("repository IS NOT NULL").select("repository", F.col("text").alias(column))
    imports = _listed(relations.import_frequency(files), F.concat("import_line", F.lit(" ("), F.col("files").cast("string"), F.lit(")")), "rank")
    purposes = _listed(rules.purposes(files), F.concat("purpose", F.lit(": "), F.col("files").cast("string")), "purpose")
    levels = relations.coupling(files).select("repository", F.col("coupling").alias("import_level"), F.col("organisation").alias("function_level"))
    for part in (projects.structures(files).select("repository", "layers", "tasks"), named(imports, "imports"), named(purposes, "purposes"), levels, rules.technologies(files)):
        out = out.join(part, "repository", "left")
    return out.select("repository", "files", "patterns", "layers", F.coalesce("imports", F.lit("")).alias("imports"), "tasks", "purposes", "import_level", "function_level", "technologies")


def _section(title: str, column: str) -> Column:
    return F.concat(F.lit(f"\n\n{title}\n"), F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("unknown")))


INSIGHT_SECTIONS = (("Files", "files"), ("Kinds of files", "patterns"), ("Layers", "layers"), ("Commonest imports", "imports"), ("Tasks", "tasks"), ("Purposes", "purposes"), ("Coupling", "import_level"), ("Functions a file", "function_level"), ("Technologies", "technologies"))
INSIGHT_HEAD, INSIGHT_TAIL = "You judge the repository ", "Say what it is for, how it is built, how well it can be kept up, and what to do first."


def insight_prompts(files: DataFrame) -> DataFrame:
    """(repository, prompt): what ``intelligence`` tells, as the request for an assessment of the whole repository."""
    parts = [F.lit(INSIGHT_HEAD), F.col("repository"), *(_section(t, c) for t, c in INSIGHT_SECTIONS), F.lit("\n\n" + INSIGHT_TAIL)]
    return intelligence(files).select("repository", F.concat(*parts).alias("prompt"))


MENTOR_HEAD, GENERAL_HEAD = "You are a mentor for the repository ", "You are a patient teacher of programming. Explain the idea first, give a short example, name a common mistake and a next step."


def key_files(files: DataFrame, cut: int = 400) -> DataFrame:
    """(repository, path, rank, text): the core files with purpose, names, size, dependencies and the first ``cut`` characters."""
    listed = lambda c, n: F.coalesce(F.array_join(F.slice(F.col(c), 1, n), ", "), F.lit(""))
    facts = latest(files, "repository", "path", rules.purpose(F.col("path")).alias("purpose"), listed("functions", 5).alias("functions"), listed("classes", 3).alias("classes"), listed("imports", 5).alias("imports"), F.coalesce(F.col("lines"), F.lit(0)).cast("string").alias("lines"), F.substring(F.coalesce("content_preview", F.lit("")), 1, cut).alias("start"))
    rows = facts.join(ranking.core_files(files).select("repository", "path", "rank"), ["repository", "path"])
    text = F.concat(F.lit("File: "), "path", F.lit("\nPurpose: "), "purpose", F.lit("\nFunctions: "), "functions", F.lit("\nClasses: "), "classes", F.lit("\nImports: "), "imports", F.lit("\nLines: "), "lines", F.lit("\n"), "start")
    return rows.select("repository", "path", "rank", text.alias("text"))


def mentor_prompts(files: DataFrame, question: str) -> DataFrame:
    """(repository, prompt): the answer to a question about each repository; a general one goes without facts.

    The class of the question follows ``rules.question_class``.
    """
    rows = intelligence(files)
    core = key_files(files).groupBy("repository").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n---\n").alias("core"))
    facts = F.concat(F.lit(MENTOR_HEAD), "repository", *(_section(t, c) for t, c in INSIGHT_SECTIONS), _section("Key files", "core"))
    general = rules.question_class(F.lit(question)) == "general"
    head = F.when(general, GENERAL_HEAD).otherwise(facts)
    asked = F.when(general, question).otherwise(F.concat(F.lit("About "), "repository", F.lit(f": {question}")))
    return rows.join(core, "repository", "left").select("repository", F.concat(F.lit("System: "), head, F.lit("\n\nUser: "), asked, F.lit("\n\nAssistant:")).alias("prompt"))


def key_file_imports(files: DataFrame, most: int = 5) -> DataFrame:
    """``relations.import_frequency`` over the core files alone."""
    core = ranking.core_files(files).select("repository", "path")
    return relations.import_frequency(files.join(core, ["repository", "path"], "left_semi"), most)


def key_file_levels(files: DataFrame) -> DataFrame:
    """(repository, files, functions, level): complexity of the core files by functions a file."""
    core = ranking.core_files(files).select("repository", "path")
    rows = relations.coupling(files.join(core, ["repository", "path"], "left_semi"))
    return rows.select("repository", "files", "functions", F.col("organisation").alias("level"))
