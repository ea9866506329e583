"""Classifiers by keyword rules. Rules are data; tests are for substrings, as told per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, contains_any, labels, latest, record_text

#: Words that mark what a file does.
FILE_PATTERNS = {
    "ml": (("torch", "tensorflow", "sklearn", "model", "train", "predict", "neural", "gradient", "loss", "optimizer", "dataset", "embedding"), True),
    "web": (("flask", "django", "fastapi", "streamlit", "request", "response", "route", "endpoint", "api", "http"), False),
    "data": (("pandas", "numpy", "csv", "json", "dataframe", "process", "transform", "parse", "load", "save"), True),
    "cli": (("argparse", "click", "main", "argv", "command", "parser", "args"), False),
}
#: Words of application types, tested on the lower-cased text.
APPLICATION_TYPES = {
    "Web Application": ("app.route", "router.", "express", "flask", "django", "fastapi", "http", "server", "api", "@app.", "render_template", "jsonify"),
    "CLI Application": ("argparse", "click", "sys.argv", "command line", "cli", "parser.add_argument"),
    "Data Processing": ("pandas", "numpy", "csv", "json", "xml", "data", "dataframe", "read_csv", "to_csv", "parse", "transform"),
    "Game": ("pygame", "unity", "game", "player", "score", "level", "sprite"),
    "Machine Learning": ("model", "train", "predict", "neural", "network", "learning", "fit", "score", "accuracy", "loss", "epoch", "batch"),
    "Desktop Application": ("tkinter", "pyqt", "wxpython", "kivy", "gui", "window", "dialog"),
    "Testing": ("test", "assert", "unittest", "pytest", "mock", "fixture"),
    "Database": ("database", "sql", "sqlite", "postgres", "mysql", "mongodb", "connection", "query", "table", "schema"),
}
#: Marks of data inputs and outputs, case-sensitive, and of transformations, lower-cased.
INPUTS = {"File input": ("open(",), "Network/API input": ("requests.", "fetch(", "http", "api"), "Database input": ("sql", "query", "database", "db."), "User input": ("input(", "stdin", "argv"), "Environment variables": ("environ",)}
TRANSFORMATIONS = {"Data parsing": ("parse",), "Data conversion": ("convert",), "Data transformation": ("transform",), "Data filtering": ("filter",), "Data mapping": ("map",), "Data sorting": ("sort",), "Data joining": ("join",), "Data merging": ("merge",), "Data splitting": ("split",), "Data formatting": ("format",)}
OUTPUTS = {"File output": ("write(", "save(", "dump"), "Console output": ("print(", "console.log", "stdout"), "Function return value": ("return ", "yield "), "Response/Render output": ("response", "render", "send")}
#: Words whose occurrences score how a file runs, in order of precedence.
EXECUTION = {"sequential": ("step", "then", "next", "after"), "event_driven": ("event", "handler", "callback", "listener"), "loop_based": ("for", "while", "iterate", "repeat"), "conditional": ("if", "switch", "case", "condition"), "parallel": ("thread", "async", "concurrent", "parallel"), "pipeline": ("pipe", "chain", "flow", "pipeline")}
#: Technologies by extension, in order, and by root file.
TECHNOLOGIES = (("Python", (".py",)), ("JavaScript", (".js", ".jsx")), ("TypeScript", (".ts", ".tsx")), ("Java", (".java",)), ("C/C++", (".cpp", ".c")), ("Go", (".go",)), ("Rust", (".rs",)), ("Ruby", (".rb",)), ("PHP", (".php",)), ("C#", (".cs",)))
ROOT_FILES = (("Node.js", "package.json"), ("Python Package", "requirements.txt"), ("Docker", "dockerfile"), ("Python Package", "setup.py"))
KEY_FILES = ("readme.md", "requirements.txt", "package.json", "dockerfile", "setup.py")
#: Questions about programming in general.
GREETINGS = ("hello", "hi", "hey", "thanks", "thank you")
GENERAL = ("what is python", "what is oop", "what is functional programming", "explain recursion", "what are design patterns", "what is mvc", "programming languages", "computer science", "algorithm complexity", "data structures theory", "big o notation")


def joined(*parts: Column) -> Column:
    """Texts below each other in lower case, so that no word arises across a border."""
    return F.lower(F.concat_ws("\n", *parts))


def file_patterns(files: DataFrame) -> DataFrame:
    """(file_id, repository, ml, web, data, cli): which words of FILE_PATTERNS occur in preview, imports and functions."""
    narrow = joined(F.col("content_preview"), F.array_join("imports", " "))
    wide = joined(F.col("content_preview"), F.array_join("imports", " "), F.array_join("functions", " "))
    return latest(files, "repository", *(contains_any(wide if with_functions else narrow, words).alias(name) for name, (words, with_functions) in FILE_PATTERNS.items()))


def rule_labels(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    return labels((name, contains_any(text, words)) for name, words in rules.items())


def application_types(files: DataFrame) -> DataFrame:
    """(repository, application_type, files), how many files show each type."""
    rows = latest(files, "repository", rule_labels(F.lower(record_text()), APPLICATION_TYPES).alias("types"), heavy=True)
    return rows.select("repository", F.explode("types").alias("application_type")).groupBy("repository", "application_type").agg(F.count("*").alias("files"))


def data_flows(files: DataFrame) -> DataFrame:
    """(file_id, inputs, transformations, outputs, complexity), joined names and their number; files without any are left out."""
    text = record_text()
    rows = latest(files, rule_labels(text, INPUTS).alias("i"), rule_labels(F.lower(text), TRANSFORMATIONS).alias("t"), rule_labels(text, OUTPUTS).alias("o"), heavy=True)
    return rows.select("file_id", F.array_join("i", ", ").alias("inputs"), F.array_join("t", ", ").alias("transformations"), F.array_join("o", ", ").alias("outputs"), (F.size("i") + F.size("t") + F.size("o")).alias("complexity")).filter("complexity > 0")


def execution_pattern(text: Column) -> Column:
    """The class of EXECUTION with most occurrences of its words; the first of equals."""
    low = F.lower(text)
    scores = {name: sum(((F.length(low) - F.length(F.replace(low, F.lit(w)))) / len(w) for w in words), F.lit(0)) for name, words in EXECUTION.items()}
    best = F.greatest(*scores.values())
    out = None
    for name, score in scores.items():
        out = F.when(score == best, name) if out is None else out.when(score == best, name)
    return out


def execution_patterns(files: DataFrame) -> DataFrame:
    return latest(files, execution_pattern(record_text()).alias("execution_pattern"), heavy=True)


def technologies(files: DataFrame) -> DataFrame:
    """(repository, technologies): names in fixed order; Python Package stands twice if both root files do."""
    rows = latest(files, "repository", "extension", F.lower("path").alias("path"))
    seen = rows.groupBy("repository").agg(*(F.bool_or(F.col("extension").isin(*e)).alias(f"e{k}") for k, (_, e) in enumerate(TECHNOLOGIES)), *(F.bool_or(F.col("path") == p).alias(f"r{k}") for k, (_, p) in enumerate(ROOT_FILES)))
    found = labels([*((n, F.col(f"e{k}")) for k, (n, _) in enumerate(TECHNOLOGIES)), *((n, F.col(f"r{k}")) for k, (n, _) in enumerate(ROOT_FILES))])
    return seen.select("repository", F.array_join(found, ", ").alias("technologies"))


def key_files(files: DataFrame) -> DataFrame:
    """(repository, path) of the files named as in KEY_FILES."""
    return latest(files.filter(F.lower(basename(F.col("path"))).isin(*KEY_FILES)), "repository", "path").select("repository", "path")


def purpose(path: Column) -> Column:
    name = F.lower(basename(path))
    return (
        F.when(contains_any(name, ("main", "app")), "Entry Points").when(name.contains("test"), "Tests").when(contains_any(name, ("config", "settings")), "Configuration").when(contains_any(name, ("util", "helper")), "Utilities").otherwise("Core Logic")
    )


def purposes(files: DataFrame) -> DataFrame:
    """(repository, purpose, files)."""
    return latest(files, "repository", purpose(F.col("path")).alias("purpose")).groupBy("repository", "purpose").agg(F.count("*").alias("files"))


#: Patterns of architecture by words of the file's name, its classes, functions or text.
ARCHITECTURE = (
    ("Data Model / Domain Model pattern", ("model",), "classes", ("model",)), ("Controller / Handler pattern", ("controller", "handler"), None, ()), ("View / Presentation pattern", ("view", "template"), None, ()),
    ("Service Layer pattern", ("service",), "functions", ("service",)), ("Factory / Builder pattern", (), "text", ("factory", "create")), ("Configuration pattern", ("config", "settings"), None, ()), ("Utility / Helper pattern", ("util", "helper"), None, ()),
)


def file_architecture(files: DataFrame) -> DataFrame:
    """(file_id, patterns) joined by "; ", or a default."""
    name, text = F.lower(basename(F.col("path"))), F.lower(F.coalesce("content_preview", F.lit("")))
    among = lambda column, words: contains_any(F.lower(F.array_join(column, "\n")), words)
    rules = []
    for label, words, where, more in ARCHITECTURE:
        hit = contains_any(name, words)
        if where == "text":
            hit = hit | text.contains("factory") | among("functions", ("create",))
        elif where:
            hit = hit | among(where, more)
        rules.append((label, hit))
    found = labels(rules)
    return latest(files, F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise("No specific patterns detected").alias("patterns"))


def file_group(files: DataFrame) -> DataFrame:
    """(repository, kind, files): code, configuration, documentation or other by suffix."""
    e = F.col("extension")
    kind = F.when(e.isin(".py", ".js", ".ts", ".java", ".go", ".c", ".cpp", ".rs"), "code").when(e.isin(".json", ".yaml", ".yml", ".toml"), "configuration").when(e.isin(".md", ".txt", ".rst"), "documentation").otherwise("other")
    return latest(files, "repository", kind.alias("kind")).groupBy("repository", "kind").agg(F.count("*").alias("files"))


def question_class(text: Column, context: Column | None = None) -> Column:
    """general or repository_specific; without context all questions are general."""
    low = F.lower(text)
    general = F.trim(low).isin(*GREETINGS) | contains_any(low, GENERAL)
    return F.when(~context if context is not None else F.lit(False), "general").when(general, "general").otherwise("repository_specific")


def search(files: DataFrame, term: str) -> DataFrame:
    """(file_id, path) of the files whose path or text holds the term, whatever its case."""
    hit = F.lower("path").contains(term.lower()) | F.lower(record_text()).contains(term.lower())
    return latest(files.filter(hit), "path")
