"""Imports, names, exports, calls and other fields taken from source texts line by line or by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import latest, record_text, strip, stripped_lines

SCRIPTS = (".js", ".ts", ".jsx", ".tsx")
#: Import lines with a relative path, another quoted path, or a bare module; the module is group 1.
RELATIVE = r"""(?:from\s+|require\(|^import\s+)["']\.{1,2}/(?:[^"']*/)?([^"'/]+)["']"""
QUOTED = r"""(?:from\s+|require\(|^import\s+)["']([^"'/.][^"'/]*)[^"']*["']"""
PLAIN = r"^(?:import|from)\s+(?:static\s+)?\.*(\w+)"


def import_lines(text: Column, extension: Column) -> Column:
    """The first 10 import lines among the first 50 lines, whole."""
    keep = lambda x: F.when(extension == ".py", x.startswith("import ") | x.startswith("from ")).when(extension.isin(*SCRIPTS), x.startswith("import ") | (x.contains("require(") & x.contains("const "))).otherwise(F.lit(False))
    return F.slice(F.filter(stripped_lines(text, 50), keep), 1, 10)


def function_names(text: Column, extension: Column) -> Column:
    """The first 15 names of functions by line prefix (.py) or marks of functions (scripts)."""
    python = F.transform(F.filter(stripped_lines(text), lambda x: x.startswith("def ") & x.contains("(")), lambda x: strip(F.regexp_extract(x, r"^def ([^(]*)", 1)))
    arrow = lambda x: F.when(x.contains("function "), strip(F.regexp_extract(x, r"function ([^(]*)", 1))).otherwise(strip(F.regexp_extract(x, r"^([^=]*)=", 1)))
    script = F.transform(F.filter(stripped_lines(text), lambda x: x.contains("(") & (x.contains("function ") | x.contains("=>"))), arrow)
    return F.slice(F.when(extension == ".py", python).when(extension.isin(*SCRIPTS), script).otherwise(F.array().cast("array<string>")), 1, 15)


def class_names(text: Column, extension: Column) -> Column:
    """The first 10 names of classes by line prefix."""
    python = F.transform(F.filter(stripped_lines(text), lambda x: x.startswith("class ") & x.contains(":")), lambda x: strip(F.regexp_extract(x, r"^class ([^(:]*)", 1)))
    script = F.transform(F.filter(stripped_lines(text), lambda x: x.startswith("class ") & x.contains("{")), lambda x: strip(F.regexp_replace(F.regexp_extract(x, r"^class ([^{]*)", 1), r" extends.*$", "")))
    return F.slice(F.when(extension == ".py", python).when(extension.isin(*SCRIPTS), script).otherwise(F.array().cast("array<string>")), 1, 10)


def modules(text: Column) -> Column:
    """The first 10 imported modules among the first 50 lines, whatever the language.

    ``from a.b import c`` and ``import a.b`` give a, ``from .a import b`` too; a script's
    import gives the last part of a relative path and the first part of any other.
    """
    of = lambda x: F.when(x.rlike(RELATIVE), F.regexp_extract(x, RELATIVE, 1)).when(x.rlike(QUOTED), F.regexp_extract(x, QUOTED, 1)).when(x.rlike(PLAIN), F.regexp_extract(x, PLAIN, 1)).otherwise(F.lit(""))
    return F.slice(F.filter(F.transform(stripped_lines(text, 50), of), lambda m: m != ""), 1, 10)


def frameworks(text: Column, extension: Column) -> Column:
    """Names of imported packages by the patterns of the language, duplicates kept."""
    found = lambda *patterns: F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in patterns))
    by = (
        F.when(extension == ".py", found(r"(?i)import\s+(\w+)", r"(?i)from\s+(\w+)\s+import"))
        .when(extension.isin(*SCRIPTS), found(r"""(?i)import.*from\s+["'](\w+)["']""", r"""(?i)require\(["'](\w+)["']\)""", r"(?i)import\s+(\w+)"))
        .when(extension == ".java", found(r"(?i)import\s+(\w+)"))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.filter(by, lambda x: x.rlike("^[A-Za-z]{3,}$"))


def exports(text: Column) -> Column:
    """Structs (name, type): at most 5 functions and 3 classes, then all script exports."""
    named = lambda pattern, kind, most=None: F.transform(F.slice(F.regexp_extract_all(text, F.lit(pattern), 1), 1, most) if most else F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.struct(x.alias("name"), F.lit(kind).alias("type")))
    return F.concat(named(r"def\s+(\w+)\s*\(", "function", 5), named(r"class\s+(\w+)\s*[\(:]", "class", 3), *(named(p, "export") for p in (r"export\s+function\s+(\w+)", r"export\s+class\s+(\w+)", r"export\s+const\s+(\w+)", r"module\.exports\s*=\s*(\w+)")))


#: Words that look like calls and are none.
NOT_CALLS = ("if", "for", "while", "def", "class", "import", "from", "return")


def function_calls(text: Column) -> Column:
    """The first 15 different names that are called, in order of first occurrence."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\w+)\s*\([^)]*\)"), 1))
    return F.slice(F.filter(names, lambda x: (F.length(x) >= 3) & ~x.isin(*NOT_CALLS)), 1, 15)


#: Groups of words that class a call, in order.
OPERATIONS = (
    ("data", ("load", "read", "fetch", "get", "retrieve", "parse")),
    ("processing", ("process", "transform", "convert", "compute", "calculate")),
    ("output", ("save", "write", "export", "send", "publish", "display")),
    ("control", ("start", "stop", "run", "execute", "launch", "init")),
    ("communication", ("connect", "request", "response", "call", "api")),
)


def operation_class(name: Column) -> Column:
    """The first group of OPERATIONS of which a word occurs in the name, else operation."""
    low = F.lower(name)
    out = None
    for kind, words in OPERATIONS:
        hit = low.rlike("|".join(words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("operation")


#: Patterns of control flow with their type.
CONTROL = (
    ("conditional", r"(?i)if\s+.+:"), ("loop", r"(?i)for\s+.+:"), ("conditional_loop", r"(?i)while\s+.+:"), ("exception_handling", r"(?i)try\s*:"),
    ("context_management", r"(?i)with\s+.+:"), ("async_operation", r"(?i)async\s+def"), ("async_wait", r"(?i)await\s+"),
)
#: Patterns of configuration with their aspect.
CONFIGURATION = (
    ("application_config", r"(?i)config\s*="), ("settings", r"(?i)settings\s*="), ("environment_file", r"(?i)\.env"), ("environment", r"(?i)os\.environ"),
    ("cli_config", r"(?i)argparse"), ("file_config", r"(?i)configparser"),
)
#: Words of operations, in order.
OPERATION_WORDS = ("initialize setup configure load save process execute run start stop create update delete read write parse validate transform convert").split()


def exploded(files: DataFrame, items: Column, *names: str) -> DataFrame:
    """(file_id, pos, ...) of the items of each file's last delivery; pos counts from 1."""
    rows = latest(files, items.alias("_items"), heavy=True).select("file_id", F.posexplode("_items").alias("_pos", "_item"))
    columns = [F.col("_item").alias(names[0])] if len(names) == 1 else [F.col(f"_item.{n}").alias(n) for n in names]
    return rows.select("file_id", (F.col("_pos") + 1).alias("pos"), *columns)


def counted(files: DataFrame, patterns: tuple[tuple[str, str], ...]) -> DataFrame:
    """(file_id, type, hits) of the patterns that occur in the text."""
    text = record_text()
    items = F.array(*(F.struct(F.lit(name).alias("type"), F.regexp_count(text, F.lit(p)).alias("hits")) for name, p in patterns))
    return exploded(files, F.filter(items, lambda x: x.hits > 0), "type", "hits").drop("pos")


def todo_comments(files: DataFrame) -> DataFrame:
    """(file_id, pos, tag, note) of each to-do mark with a colon."""
    text = record_text()
    pattern = r"(?i)(TODO|FIXME):(.*)"
    marks = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("tag"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("note")),
        lambda x: F.struct(x.tag.alias("tag"), strip(x.note).alias("note")),
    )
    return exploded(files, marks, "tag", "note")
