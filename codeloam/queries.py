"""Queries of the core operators, and SQL that gives their rows: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus
from .functions.text import latest, record_text
from .operators import advice, astmetrics, diagrams, duplicates, extract, flows, graph, history, overview, projects, prompts, quality, ranking, relations, rules
from .plans import report
from .sources import repositories
from .sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, operator: Callable[..., DataFrame], *tables: str, sql: str | None = None) -> None:
    """Registers ``operator`` over whole tables."""
    QUERIES[name] = lambda spark, directory: operator(*(table(spark, directory, t) for t in tables))
    if sql:
        SQL[name] = sql


FILES = "detailed_files"
#: The last delivery of each file, of each commit, and history without repeats.
F_ = "f AS (SELECT * FROM detailed_files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
C_ = "c AS (SELECT * FROM commits WHERE commit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY commit ORDER BY loaded_at DESC NULLS LAST) = 1)"
H_ = "h AS (SELECT repository, entity, commit, date, max(lines) AS lines, max(complexity) AS complexity FROM history WHERE entity IS NOT NULL GROUP BY ALL)"
E_ = "e AS (SELECT DISTINCT repository, src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"
TEXT = "coalesce(full_content, content_preview, '')"
BASE = "string_split(path, '/')[-1]"
STEM = f"regexp_replace({BASE}, '(.)\\.[^.]*$', '\\1')"
SCRIPT = "('.js', '.ts', '.jsx', '.tsx')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def lines(x: str, first: int | None = None) -> str:
    return f"list_transform(string_split({x}, chr(10)){f'[1:{first}]' if first else ''}, lambda l: {strip('l')})"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def labelled(rules_: list[tuple[str, str]], separator: str = ", ") -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {quoted(n)} END" for n, c in rules_) + f"], lambda l: l IS NOT NULL), {quoted(separator)})"


def unnested(items: str, *names: str, where: str = "true") -> str:
    """Rows (file_id, pos, ...) of a list of each file."""
    columns = f"x.v AS {names[0]}" if len(names) == 1 else ", ".join(f"x.v.{n} AS {n}" for n in names)
    return f"WITH {F_}, i AS (SELECT file_id, {items} AS items FROM f WHERE {where}) SELECT file_id, CAST(x.k AS INTEGER) AS pos, {columns} FROM (SELECT file_id, unnest(list_zip(items, range(1, len(items) + 1))) AS z FROM i) q, LATERAL (SELECT z[1] AS v, z[2] AS k) x"


# Overview
add("corpus_overview", overview.corpus_overview, FILES, sql=f"WITH {F_} SELECT repository, extension, count(*) AS files, CAST(coalesce(sum(lines), 0) AS BIGINT) AS total_lines FROM f GROUP BY ROLLUP (repository, extension)")
add("file_types", overview.file_types, FILES, sql=f"WITH {F_}, g AS (SELECT repository, extension, count(*) AS files FROM f GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY repository ORDER BY files DESC, extension) AS INTEGER) AS rank FROM g")
_LANGUAGE = "CASE " + " ".join(f"WHEN extension IN ({', '.join(map(quoted, e))}) THEN {k}" for k, (_, e) in enumerate(overview.LANGUAGES)) + " END"
add(
    "primary_language", overview.primary_language, FILES,
    sql=f"WITH {F_}, g AS (SELECT repository, {_LANGUAGE} AS k, CAST(coalesce(sum(lines), 0) AS BIGINT) AS total_lines FROM f GROUP BY ALL) SELECT repository, [{', '.join(quoted(n) for n, _ in overview.LANGUAGES)}][k + 1] AS language, total_lines FROM g WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repository ORDER BY total_lines DESC, k) = 1",
)
add("technologies", rules.technologies, FILES, sql=f"WITH {F_} SELECT repository, {labelled([*((n, f'bool_or(extension IN ({chr(44).join(map(quoted, e))}))') for n, e in rules.TECHNOLOGIES), *((n, f'bool_or(lower(path) = {quoted(p)})') for n, p in rules.ROOT_FILES)])} AS technologies FROM f GROUP BY repository")
add("key_files", rules.key_files, FILES, sql=f"WITH {F_} SELECT repository, path FROM f WHERE lower({BASE}) IN ({', '.join(map(quoted, rules.KEY_FILES))})")
add("repository_report", report.repository_report, FILES)

# Fields taken from texts
_CODE_TEXT = "full_content IS NOT NULL"


def _extracted(column: Callable) -> Callable[[DataFrame], DataFrame]:
    return lambda files: extract.exploded(files.filter("full_content IS NOT NULL"), column(F.col("full_content"), F.col("extension")), "value")


_IMPORT = f"CASE WHEN extension = '.py' THEN starts_with(l, 'import ') OR starts_with(l, 'from ') WHEN extension IN {SCRIPT} THEN starts_with(l, 'import ') OR (contains(l, 'require(') AND contains(l, 'const ')) ELSE false END"
add("import_lines", _extracted(extract.import_lines), FILES, sql=unnested(f"list_filter({lines('full_content', 50)}, lambda l: {_IMPORT})[1:10]", "value", where=_CODE_TEXT))
_PY_DEF = f"list_transform(list_filter({lines('full_content')}, lambda l: starts_with(l, 'def ') AND contains(l, '(')), lambda l: {strip(chr(114) + 'egexp_extract(l, ' + quoted('^def ([^(]*)') + ', 1)')})"
_JS_DEF = f"list_transform(list_filter({lines('full_content')}, lambda l: contains(l, '(') AND (contains(l, 'function ') OR contains(l, '=>'))), lambda l: CASE WHEN contains(l, 'function ') THEN {strip('regexp_extract(l, ' + quoted('function ([^(]*)') + ', 1)')} ELSE {strip('regexp_extract(l, ' + quoted('^([^=]*)=') + ', 1)')} END)"
add("function_names", _extracted(extract.function_names), FILES, sql=unnested(f"(CASE WHEN extension = '.py' THEN {_PY_DEF} WHEN extension IN {SCRIPT} THEN {_JS_DEF} ELSE [] END)[1:15]", "value", where=_CODE_TEXT))
_PY_CLASS = f"list_transform(list_filter({lines('full_content')}, lambda l: starts_with(l, 'class ') AND contains(l, ':')), lambda l: {strip('regexp_extract(l, ' + quoted('^class ([^(:]*)') + ', 1)')})"
_JS_CLASS = f"list_transform(list_filter({lines('full_content')}, lambda l: starts_with(l, 'class ') AND contains(l, '{{')), lambda l: {strip('regexp_replace(regexp_extract(l, ' + quoted('^class ([^{]*)') + ', 1), ' + quoted(' extends.*$') + ', ' + quoted('') + ')')})"
add("class_names", _extracted(extract.class_names), FILES, sql=unnested(f"(CASE WHEN extension = '.py' THEN {_PY_CLASS} WHEN extension IN {SCRIPT} THEN {_JS_CLASS} ELSE [] END)[1:10]", "value", where=_CODE_TEXT))
_MODULE = "CASE " + " ".join(f"WHEN regexp_matches(l, {quoted(p)}) THEN regexp_extract(l, {quoted(p)}, 1)" for p in (extract.RELATIVE, extract.QUOTED, extract.PLAIN)) + " ELSE '' END"
MODULES = f"list_filter(list_transform({lines(TEXT, 50)}, lambda l: {_MODULE}), lambda m: m <> '')[1:10]"
add("imported_modules", lambda files: extract.exploded(files, extract.modules(record_text()), "module"), FILES, sql=unnested(MODULES, "module"))


def _found(*patterns: str) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all(full_content, {quoted(p)}, 1)" for p in patterns) + ")" if len(patterns) > 1 else f"regexp_extract_all(full_content, {quoted(patterns[0])}, 1)"


_FRAMEWORKS = f"""list_filter(CASE WHEN extension = '.py' THEN {_found("(?i)import\\s+(\\w+)", "(?i)from\\s+(\\w+)\\s+import")} WHEN extension IN {SCRIPT} THEN list_concat({_found("(?i)import.*from\\s+[\"'](\\w+)[\"']", "(?i)require\\([\"'](\\w+)[\"']\\)")}, {_found("(?i)import\\s+(\\w+)")}) WHEN extension = '.java' THEN {_found("(?i)import\\s+(\\w+)")} ELSE [] END, lambda m: regexp_matches(m, '^[A-Za-z]{{3,}}$'))"""


def top_frameworks(files: DataFrame, most: int = 8) -> DataFrame:
    from pyspark.sql import Window

    rows = latest(files.filter("full_content IS NOT NULL"), "repository", extract.frameworks(F.col("full_content"), F.col("extension")).alias("names"), heavy=True)
    counts = rows.select("repository", F.explode("names").alias("framework")).groupBy("repository", "framework").agg(F.count("*").alias("uses"))
    rank = F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("uses"), "framework"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most)


add("frameworks_top8", top_frameworks, FILES, sql=f"WITH {F_}, n AS (SELECT repository, unnest({_FRAMEWORKS}) AS framework FROM f WHERE {_CODE_TEXT}), g AS (SELECT repository, framework, count(*) AS uses FROM n GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY repository ORDER BY uses DESC, framework) AS INTEGER) AS rank FROM g QUALIFY rank <= 8")
_EXPORTED = "list_concat(" * 5 + f"list_transform(regexp_extract_all({TEXT}, 'def\\s+(\\w+)\\s*\\(', 1)[1:5], lambda l: {{'name': l, 'type': 'function'}}), list_transform(regexp_extract_all({TEXT}, 'class\\s+(\\w+)\\s*[\\(:]', 1)[1:3], lambda l: {{'name': l, 'type': 'class'}}))" + "".join(f", list_transform(regexp_extract_all({TEXT}, '{p}', 1), lambda l: {{'name': l, 'type': 'export'}}))" for p in ("export\\s+function\\s+(\\w+)", "export\\s+class\\s+(\\w+)", "export\\s+const\\s+(\\w+)", "module\\.exports\\s*=\\s*(\\w+)"))
add("exports", lambda files: extract.exploded(files, extract.exports(record_text()), "name", "type"), FILES, sql=unnested(_EXPORTED, "name", "type"))
_CALLS = f"SELECT file_id, n, min(k) AS k FROM (SELECT file_id, unnest(a) AS n, unnest(range(len(a))) AS k FROM (SELECT file_id, regexp_extract_all({TEXT}, '(\\w+)\\s*\\([^)]*\\)', 1) AS a FROM f)) GROUP BY file_id, n"


def call_classes(files: DataFrame) -> DataFrame:
    rows = extract.exploded(files, extract.function_calls(record_text()), "name")
    return rows.withColumn("operation", extract.operation_class(F.col("name")))


_OPERATION = "CASE " + " ".join(f"WHEN regexp_matches(lower(n), '{'|'.join(w)}') THEN '{kind}'" for kind, w in extract.OPERATIONS) + " ELSE 'operation' END"
add("function_calls", call_classes, FILES, sql=f"WITH {F_}, g AS ({_CALLS}) SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY k) AS INTEGER) AS pos, n AS name, {_OPERATION} AS operation FROM g WHERE length(n) >= 3 AND n NOT IN ({', '.join(map(quoted, extract.NOT_CALLS))}) QUALIFY pos <= 15")


def _counts(patterns) -> str:
    each = " UNION ALL ".join(f"SELECT file_id, {quoted(n)} AS type, CAST(len(regexp_extract_all({TEXT}, {quoted(p)})) AS INTEGER) AS hits FROM f" for n, p in patterns)
    return f"WITH {F_}, g AS ({each}) SELECT * FROM g WHERE hits > 0"


add("control_flow", lambda files: extract.counted(files, extract.CONTROL), FILES, sql=_counts(extract.CONTROL))
add("configuration", lambda files: extract.counted(files, extract.CONFIGURATION), FILES, sql=_counts(extract.CONFIGURATION))
_WORDS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower({TEXT}), {quoted(w)}) THEN {quoted(w)} END" for w in extract.OPERATION_WORDS) + "], lambda l: l IS NOT NULL)[1:8]"
add("operation_words", lambda files: extract.exploded(files, F.slice(rules.labels((w, F.lower(record_text()).contains(w)) for w in extract.OPERATION_WORDS), 1, 8), "word"), FILES, sql=unnested(_WORDS, "word"))
add("todo_comments", extract.todo_comments, FILES, sql=unnested(f"list_transform(list_zip(regexp_extract_all({TEXT}, '(?i)(TODO|FIXME):(.*)', 1), regexp_extract_all({TEXT}, '(?i)(TODO|FIXME):(.*)', 2)), lambda l: {{'tag': l[1], 'note': {strip('l[2]')}}})", "tag", "note"))

# Rules
_NARROW, _WIDE = "lower(concat_ws(chr(10), content_preview, array_to_string(imports, ' ')))", "lower(concat_ws(chr(10), content_preview, array_to_string(imports, ' '), array_to_string(functions, ' ')))"
add("file_patterns", rules.file_patterns, FILES, sql=f"WITH {F_} SELECT file_id, repository, {', '.join(f'{any_of(_WIDE if w else _NARROW, words)} AS {n}' for n, (words, w) in rules.FILE_PATTERNS.items())} FROM f")


def _rule_sql(x: str, table_: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    return [(n, any_of(x, w)) for n, w in table_.items()]


add("application_types", rules.application_types, FILES, sql=f"WITH {F_}, n AS (SELECT repository, unnest(list_filter([{', '.join(f'CASE WHEN {c} THEN {quoted(n)} END' for n, c in _rule_sql(f'lower({TEXT})', rules.APPLICATION_TYPES))}], lambda l: l IS NOT NULL)) AS application_type FROM f) SELECT repository, application_type, count(*) AS files FROM n GROUP BY ALL")
_FLOWS = {"inputs": (TEXT, rules.INPUTS), "transformations": (f"lower({TEXT})", rules.TRANSFORMATIONS), "outputs": (TEXT, rules.OUTPUTS)}
add("data_flows", rules.data_flows, FILES, sql=f"WITH {F_}, g AS (SELECT file_id, {', '.join(f'{labelled(_rule_sql(x, r))} AS {n}' for n, (x, r) in _FLOWS.items())}, CAST({' + '.join(f'CAST({c} AS INTEGER)' for x, r in _FLOWS.values() for _, c in _rule_sql(x, r))} AS INTEGER) AS complexity FROM f) SELECT * FROM g WHERE complexity > 0")
_LOW = f"lower({TEXT})"
_SCORES = {n: " + ".join(f"(length({_LOW}) - length(replace({_LOW}, {quoted(w)}, ''))) // {len(w)}" for w in words) for n, words in rules.EXECUTION.items()}
add("execution_patterns", rules.execution_patterns, FILES, sql=f"WITH {F_}, g AS (SELECT file_id, {', '.join(f'{s} AS s{k}' for k, s in enumerate(_SCORES.values()))} FROM f) SELECT file_id, CASE {' '.join(f'WHEN s{k} = greatest({chr(44).join(f"s{j}" for j in range(len(_SCORES)))}) THEN {quoted(n)}' for k, n in enumerate(_SCORES))} END AS execution_pattern FROM g")
_NAME = f"lower({BASE})"
_PURPOSE = f"CASE WHEN {any_of(_NAME, ('main', 'app'))} THEN 'Entry Points' WHEN contains({_NAME}, 'test') THEN 'Tests' WHEN {any_of(_NAME, ('config', 'settings'))} THEN 'Configuration' WHEN {any_of(_NAME, ('util', 'helper'))} THEN 'Utilities' ELSE 'Core Logic' END"
add("purposes", rules.purposes, FILES, sql=f"WITH {F_} SELECT repository, {_PURPOSE} AS purpose, count(*) AS files FROM f GROUP BY ALL")
_AMONG = {"classes": "lower(array_to_string(classes, chr(10)))", "functions": "lower(array_to_string(functions, chr(10)))"}


def _architecture() -> str:
    out = []
    for label, words, where, more in rules.ARCHITECTURE:
        hit = any_of(_NAME, words) if words else "false"
        if where == "text":
            hit = f"({hit} OR contains(lower(coalesce(content_preview, '')), 'factory') OR coalesce(contains({_AMONG['functions']}, 'create'), false))"
        elif where:
            hit = f"({hit} OR coalesce({any_of(_AMONG[where], more)}, false))"
        out.append((label, hit))
    return labelled(out, "; ")


add("file_architecture", rules.file_architecture, FILES, sql=f"WITH {F_} SELECT file_id, coalesce(nullif({_architecture()}, ''), 'No specific patterns detected') AS patterns FROM f")
add("file_groups", rules.file_group, FILES, sql=f"WITH {F_} SELECT repository, CASE WHEN extension IN ('.py', '.js', '.ts', '.java', '.go', '.c', '.cpp', '.rs') THEN 'code' WHEN extension IN ('.json', '.yaml', '.yml', '.toml') THEN 'configuration' WHEN extension IN ('.md', '.txt', '.rst') THEN 'documentation' ELSE 'other' END AS kind, count(*) AS files FROM f GROUP BY ALL")
add("search_ledger", lambda files: rules.search(files, "ledger"), FILES, sql=f"WITH {F_} SELECT file_id, path FROM f WHERE contains(lower(path), 'ledger') OR contains(lower({TEXT}), 'ledger')")


def question_classes(documents: DataFrame) -> DataFrame:
    """Each text as a question."""
    return documents.filter("text IS NOT NULL").select("doc_id", rules.question_class(F.col("text")).alias("question_class"))


_QUESTION = "lower(text)"
add("question_classes", question_classes, "documents", sql=f"SELECT doc_id, CASE WHEN trim({_QUESTION}) IN ({', '.join(map(quoted, rules.GREETINGS))}) OR {any_of(_QUESTION, rules.GENERAL)} THEN 'general' ELSE 'repository_specific' END AS question_class FROM documents WHERE text IS NOT NULL")

# Duplicates
_NORM = f"""{strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '(?m)#.*$', '', 'g'), '(?m)//.*$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '\\s+', ' ', 'g')")}"""
_BLOCKS = f"""{F_}, l AS (SELECT repository, file_id, path, string_split(replace({TEXT}, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM f),
s AS (SELECT repository, file_id, path, ls, unnest(range(0, len(ls), 10)) AS s FROM l),
b0 AS (SELECT repository, file_id, path, s + 1 AS start_line, len(ls[s + 1 : s + 10]) AS n_lines, len(list_filter(ls[s + 1 : s + 10], lambda x: {strip('x')} <> '')) AS filled, array_to_string(ls[s + 1 : s + 10], chr(10)) AS b FROM s),
b1 AS (SELECT *, {_NORM} AS norm FROM b0 WHERE filled > 3),
b AS (SELECT repository, file_id, path, start_line, n_lines, md5(norm) AS digest FROM b1 WHERE norm <> ''),
d AS (SELECT *, row_number() OVER w AS rn, first_value(path) OVER w AS op, first_value(start_line) OVER w AS ol FROM b WINDOW w AS (PARTITION BY repository, digest ORDER BY path, start_line, file_id))"""
add("duplicate_blocks", duplicates.duplicate_blocks, FILES, sql=f"WITH {_BLOCKS} SELECT repository, op AS original_path, CAST(ol AS INTEGER) AS original_line, path AS duplicate_path, CAST(start_line AS INTEGER) AS duplicate_line, CAST(n_lines AS INTEGER) AS n_lines FROM d WHERE rn > 1")
add("duplicate_definitions", duplicates.duplicate_definitions, FILES)
add(
    "duplication", duplicates.duplication, FILES,
    sql=f"WITH {_BLOCKS}, t AS (SELECT repository, CAST(coalesce(sum(lines), 0) AS BIGINT) AS total_lines FROM f GROUP BY repository), g AS (SELECT repository, count(*) AS n, sum(n_lines) AS s FROM d WHERE rn > 1 GROUP BY repository) SELECT repository, coalesce(n, 0) AS duplicate_blocks, CAST(coalesce(s, 0) AS BIGINT) AS duplicate_lines, total_lines, CAST(coalesce(s, 0) AS BIGINT) * CAST(100 AS DOUBLE) / greatest(total_lines, 1) AS duplication_pct FROM t LEFT JOIN g USING (repository)",
)

# Quality
_MARK = "CASE WHEN extension = '.py' THEN regexp_matches(l, '^#') ELSE regexp_matches(l, '^(?://|/\\*)') END"
add("comment_ratios", quality.comment_ratios, FILES, sql=f"WITH {F_}, g AS (SELECT file_id, repository, CAST(len(list_filter({lines(TEXT)}, lambda l: {_MARK})) AS INTEGER) AS comment_lines, CAST(len(list_filter({lines(TEXT)}, lambda l: l <> '')) AS INTEGER) AS filled_lines FROM f WHERE extension IN ({', '.join(map(quoted, quality.COMMENTED))})) SELECT *, CASE WHEN filled_lines > comment_lines THEN comment_lines * CAST(100 AS DOUBLE) / filled_lines ELSE CAST(0 AS DOUBLE) END AS comment_pct FROM g")
add(
    "complexity_levels", quality.complexity_indicators, FILES,
    sql=f"WITH {F_}, g AS (SELECT repository, coalesce(lines, 0) AS n, len(regexp_extract_all({TEXT}, '(?:def|function|func)\\s+\\w+')) AS functions, len(list_filter(string_split_regex({TEXT}, '(?:def|function|func)\\s+\\w+')[2:], lambda x: length(x) - length(replace(x, chr(10), '')) >= 50)) AS large, {MODULES} AS ms FROM f), s AS (SELECT repository, count(*) AS files, CAST(sum(n) AS BIGINT) AS total_lines, CAST(sum(functions) AS BIGINT) AS functions, CAST(sum(large) AS BIGINT) AS large_functions FROM g GROUP BY repository), m AS (SELECT repository, count(DISTINCT m) AS modules FROM (SELECT repository, unnest(ms) AS m FROM g) GROUP BY repository), j AS (SELECT repository, files, total_lines, functions, large_functions, coalesce(modules, 0) AS modules, total_lines / files AS mean_lines FROM s LEFT JOIN m USING (repository)), k AS (SELECT *, files * 100 + total_lines + functions * 500 + modules * 2000 AS score FROM j) SELECT repository, files, total_lines, functions, large_functions, modules, mean_lines, CASE WHEN score < 20000 THEN 'Low' WHEN score < 100000 THEN 'Medium' WHEN score < 300000 THEN 'High' ELSE 'Very High' END AS level FROM k",
)
add("large_files", quality.large_files, FILES, sql=f"WITH {F_} SELECT file_id, path, lines FROM f WHERE lines > 1000")
add("script_findings", quality.script_findings, FILES)


def script_scores(files: DataFrame) -> DataFrame:
    return quality.findings_score(quality.script_findings(files), "file_id")


add("script_scores", script_scores, FILES)

# Relations
_DEPENDENCIES = f"{F_}, m AS (SELECT repository, path, file_id, lines, {MODULES} AS ms FROM f)"
add("dependency_edges", relations.dependency_edges, FILES, sql=f"WITH {_DEPENDENCIES}, a AS (SELECT DISTINCT repository, path AS src, lower(unnest(ms)) AS n FROM m), b AS (SELECT repository, path AS dst, lower({STEM}) AS n FROM f) SELECT DISTINCT a.repository, src, dst FROM a JOIN b ON a.repository = b.repository AND (a.n = b.n OR contains(b.n, '.' || a.n)) WHERE src <> dst")
_SIZE = "greatest(coalesce(lines, 1), 1)"
add(
    "component_interactions", relations.component_interactions, FILES,
    sql=f"WITH {_DEPENDENCIES}, k AS (SELECT *, lower({STEM}) AS component FROM m QUALIFY row_number() OVER (PARTITION BY repository, component ORDER BY path DESC) = 1), a AS (SELECT DISTINCT repository, component AS from_component, {_SIZE} AS sa, len(ms) AS imports, lower(unnest(ms)) AS w FROM k), b AS (SELECT DISTINCT repository, component AS to_component, {_SIZE} AS sb, component FROM k) SELECT DISTINCT a.repository, from_component, to_component, CASE WHEN imports > 3 AND least(sa, sb) / greatest(sa, sb) > 0.5 THEN 'strong' WHEN imports > 1 THEN 'medium' ELSE 'weak' END AS strength FROM a JOIN b ON a.repository = b.repository AND contains(component, w) WHERE from_component <> to_component",
)
add("importers", relations.importers, "edges", sql="WITH d AS (SELECT DISTINCT repository, src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL), n AS (SELECT *, string_split(src, '/')[-1] AS name FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY repository, dst ORDER BY name, src) AS k FROM n) SELECT repository, dst AS path, string_agg(name, ', ' ORDER BY k) AS importers FROM r WHERE k <= 5 GROUP BY repository, dst")
add(
    "similar_files", relations.similar_files, FILES,
    sql=f"WITH {F_}, x AS (SELECT file_id, repository, len(list_distinct(coalesce(imports, []))) AS ni, len(list_distinct(coalesce(functions, []))) AS nf FROM f), i AS (SELECT DISTINCT file_id, repository, 1 AS im, unnest(imports) AS item FROM f UNION ALL SELECT DISTINCT file_id, repository, 0, unnest(functions) FROM f), g AS (SELECT a.file_id, b.file_id AS similar_id, CAST(sum(im) AS BIGINT) AS common_imports, CAST(sum(1 - im) AS BIGINT) AS common_functions FROM i a JOIN i b USING (repository, im, item) WHERE a.file_id <> b.file_id GROUP BY ALL) SELECT file_id, similar_id, common_imports, common_functions FROM g JOIN x USING (file_id) WHERE common_imports * 10 > greatest(ni, 1) * 3 OR common_functions * 5 > greatest(nf, 1) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY similar_id) <= 4",
)
add("import_frequency", relations.import_frequency, FILES, sql=f"WITH {F_}, n AS (SELECT repository, unnest(imports) AS import_line FROM f), g AS (SELECT repository, import_line, count(*) AS files FROM n GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY repository ORDER BY files DESC, import_line) AS INTEGER) AS rank FROM g QUALIFY rank <= 5")
add("dependency_kinds", relations.dependency_kinds, FILES, sql=f"WITH {F_} SELECT file_id, array_to_string(list_filter(imports, lambda l: regexp_matches(l, '[./]'))[1:3], ', ') AS internal, array_to_string(list_filter(imports, lambda l: NOT regexp_matches(l, '[./]'))[1:3], ', ') AS external FROM f WHERE len(imports) > 0")
add("coupling", relations.coupling, FILES, sql=f"WITH {F_}, g AS (SELECT repository, count(*) AS files, CAST(sum(coalesce(len(imports), 0)) AS BIGINT) AS imports, CAST(sum(coalesce(len(functions), 0)) AS BIGINT) AS functions FROM f GROUP BY repository) SELECT *, CASE WHEN imports > 5 * files THEN 'high' WHEN imports > 2 * files THEN 'moderate' ELSE 'low' END AS coupling, CASE WHEN functions > 10 * files THEN 'complex' WHEN functions > 5 * files THEN 'moderate' ELSE 'simple' END AS organisation FROM g")

# Ranking
_N = "coalesce(len(functions), 0) + coalesce(len(classes), 0)"
_RANKED = "SELECT repository, path, score, CAST(row_number() OVER (PARTITION BY repository ORDER BY score DESC, path) AS INTEGER) AS rank FROM g"
add(
    "priority_top12", ranking.priority, FILES,
    sql=f"WITH {F_}, g AS (SELECT repository, path, CAST(CASE WHEN {_NAME} IN ({', '.join(map(quoted, ranking.FIRST))}) THEN 100 WHEN {_NAME} IN ({', '.join(map(quoted, ranking.SECOND))}) THEN 90 WHEN starts_with({_NAME}, 'test_') OR contains(path, '/test') THEN 20 ELSE 0 END + CASE WHEN coalesce(lines, 0) > 100 THEN 30 WHEN coalesce(lines, 0) > 50 THEN 20 WHEN coalesce(lines, 0) > 20 THEN 10 ELSE 0 END + CASE WHEN extension IN ('.py', '.js', '.ts', '.java') THEN 25 WHEN extension IN ('.md', '.txt') THEN 15 ELSE 0 END + CASE WHEN {_N} > 5 THEN 20 WHEN {_N} > 2 THEN 10 ELSE 0 END AS INTEGER) AS score FROM f) {_RANKED} QUALIFY rank <= 12",
)
add("core_files_top8", ranking.core_files, FILES, sql=f"WITH {F_}, g AS (SELECT repository, path, CAST(CASE WHEN {_NAME} IN ({', '.join(map(quoted, ranking.CORE))}) THEN 100 ELSE 0 END + coalesce(len(functions), 0) * 10 + coalesce(len(classes), 0) * 15 + least(coalesce(lines, 0) // 10, 50) AS INTEGER) AS score FROM f) {_RANKED} WHERE score > 50 QUALIFY rank <= 8")
_SCRIPT_ENTRY = f"extension IN {SCRIPT} AND (contains({TEXT}, 'process.argv') OR contains(lower({TEXT}), 'command line'))"
_ENTRIES = (
    ("main_block", f"extension = '.py' AND contains({TEXT}, 'if __name__ == \"__main__\"')", "high", 0.95), ("main_function", f"extension = '.py' AND regexp_matches({TEXT}, 'def main\\s*\\(')", "high", 0.9), ("cli_entry", _SCRIPT_ENTRY, "high", 0.5),
    ("java_main", f"extension = '.java' AND contains({TEXT}, 'public static void main')", "high", 0.95), ("web_server", f"contains({TEXT}, 'app.run') OR contains({TEXT}, 'app.listen')", "high", 0.85),
    ("filename_entry", f"lower({STEM}) IN ({', '.join(map(quoted, ranking.ENTRY_NAMES))})", "medium", 0.6),
)
add("entry_points", ranking.entry_points, FILES, sql=f"WITH {F_} " + " UNION ALL ".join(f"SELECT file_id, {quoted(n)} AS type, {quoted(p)} AS priority, CAST({v} AS DOUBLE) AS confidence FROM f WHERE {c}" for n, c, p, v in _ENTRIES))

# History
add("bug_fixes", history.bug_fixes, "commits", "commit_files", sql=f"WITH {C_} SELECT DISTINCT commit, k.repository, path, date, string_split(message, chr(10))[1] AS subject FROM commit_files k JOIN c USING (commit) WHERE regexp_matches(lower(message), '{'|'.join(history.REPAIRS)}') AND ends_with(path, '.py')")
add("recent_bug_fixes", history.recent_bug_fixes, "commits", "commit_files", sql=f"WITH {C_}, l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repository ORDER BY date DESC, commit) <= 500) SELECT DISTINCT commit, k.repository, path, date, string_split(message, chr(10))[1] AS subject FROM commit_files k JOIN l USING (commit) WHERE regexp_matches(lower(message), '{'|'.join(history.REPAIRS)}') AND ends_with(path, '.py')")
add("bug_prone", history.bug_prone, "commits", "commit_files", sql=f"WITH {C_}, d AS (SELECT DISTINCT commit, k.repository, path FROM commit_files k JOIN c USING (commit) WHERE regexp_matches(lower(message), '{'|'.join(history.REPAIRS)}') AND ends_with(path, '.py')) SELECT repository, path, count(*) AS bug_fixes FROM d GROUP BY repository, path HAVING count(*) >= 3")
add("churn", history.churn, "commit_files", sql="WITH d AS (SELECT DISTINCT commit, repository, path, insertions, deletions FROM commit_files) SELECT repository, path, count(DISTINCT commit) AS commits, CAST(coalesce(sum(insertions), 0) AS BIGINT) AS insertions, CAST(coalesce(sum(deletions), 0) AS BIGINT) AS deletions FROM d GROUP BY repository, path")
add("recent_commits", lambda c: history.recent_commits(c, 180), "commits", sql=f"WITH {C_} SELECT commit, repository, date FROM c QUALIFY date >= max(date) OVER (PARTITION BY repository) - INTERVAL 180 DAY")
add("sampled_commits", history.sampled_commits, "commits", sql=f"WITH {C_}, r AS (SELECT repository, commit, CAST(row_number() OVER (PARTITION BY repository ORDER BY date DESC, commit) AS INTEGER) AS position FROM c) SELECT * FROM r WHERE (position - 1) % 7 = 0")
add("three_points", history.three_points, "commits", sql=f"WITH {C_}, r AS (SELECT repository, commit, row_number() OVER (PARTITION BY repository ORDER BY date DESC, commit) AS k FROM c QUALIFY k <= 100), n AS (SELECT *, count(*) OVER (PARTITION BY repository) AS n FROM r), p AS (SELECT repository, commit, CASE WHEN k = 1 THEN 'newest' WHEN k = n // 2 + 1 THEN 'middle' WHEN k = n THEN 'oldest' END AS point FROM n) SELECT * FROM p WHERE point IS NOT NULL")
_DIRECTORY = "CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'root' END"
add("directories", history.directories, "commit_files", sql=f"SELECT repository, {_DIRECTORY} AS directory, count(DISTINCT path) AS paths FROM commit_files WHERE path IS NOT NULL GROUP BY ALL")
add("new_directories", history.new_directories, "commits", "commit_files", sql=f"WITH {C_}, t AS (SELECT commit, ntile(2) OVER (PARTITION BY repository ORDER BY date, commit) AS half FROM c), r AS (SELECT DISTINCT half, k.repository, {_DIRECTORY} AS directory FROM commit_files k JOIN t USING (commit) WHERE path IS NOT NULL) SELECT repository, directory FROM r WHERE half = 2 EXCEPT SELECT repository, directory FROM r WHERE half = 1")
_GROWTH = f"{H_}, g AS (SELECT repository, entity, count(*) AS points, arg_min(lines, (date, commit)) AS first_lines, arg_max(lines, (date, commit)) AS last_lines FROM h WHERE lines IS NOT NULL GROUP BY repository, entity), a AS (SELECT *, (last_lines - first_lines) * CAST(100 AS DOUBLE) / first_lines AS growth_pct FROM g WHERE points >= 2 AND first_lines > 0)"
add("growth_alerts", history.growth_alerts, "history", sql=f"WITH {_GROWTH} SELECT * FROM a WHERE growth_pct > 200")
add("complexity_alerts", history.complexity_alerts, "history", sql=f"WITH {H_}, g AS (SELECT repository, entity, count(*) AS n, arg_min(complexity, (date, commit)) AS first_complexity, arg_max(complexity, (date, commit)) AS last_complexity FROM h WHERE complexity IS NOT NULL GROUP BY repository, entity) SELECT repository, entity, first_complexity, last_complexity FROM g WHERE n >= 2 AND last_complexity > 10 AND last_complexity * 2 > first_complexity * 3")
_TREND = f"{H_}, w AS (SELECT *, row_number() OVER (PARTITION BY repository, entity ORDER BY date DESC, commit DESC) AS k, count(*) OVER (PARTITION BY repository, entity) AS points, lag(lines) OVER (PARTITION BY repository, entity ORDER BY date, commit) AS before FROM h WHERE lines IS NOT NULL), t AS (SELECT repository, entity, any_value(points) AS points, max(CASE WHEN k = 1 THEN lines END) AS lines, sum(CASE WHEN k < least(points, 3) AND before > 0 THEN (lines - before) * CAST(100 AS DOUBLE) / before ELSE CAST(0 AS DOUBLE) END) AS s FROM w WHERE k <= 3 GROUP BY repository, entity), trend AS (SELECT repository, entity, points, lines, CASE WHEN points > 1 THEN s / (least(points, 3) - 1) ELSE CAST(0 AS DOUBLE) END AS trend_pct FROM t)"
add("growth_trends", history.growth_trends, "history", sql=f"WITH {_TREND} SELECT * FROM trend")
add("forecasts", history.forecasts, "history", sql=f"WITH {_TREND}, p AS (SELECT *, lines * pow(1 + trend_pct / 100, 3) AS p FROM trend WHERE points >= 3 AND trend_pct > 20) SELECT repository, entity, lines, CAST(floor(p) AS BIGINT) AS predicted_lines, CASE WHEN p > 150 THEN 'high' ELSE 'medium' END AS priority FROM p WHERE p > 100")
add("history_complexity", history.file_complexity, "history", sql=f"WITH {H_} SELECT repository, string_split(entity, '::')[1] AS path, commit, count(*) AS functions, avg(complexity) AS complexity FROM h WHERE complexity IS NOT NULL GROUP BY ALL")
add("evolution_summary", history.evolution_summary, "commits", "commit_files", "history", sql=f"WITH {C_}, {_GROWTH}, x AS (SELECT repository, count(*) AS commits FROM c GROUP BY repository), p AS (SELECT repository, count(DISTINCT path) AS changed_paths FROM commit_files GROUP BY repository), n AS (SELECT repository, count(DISTINCT entity) AS entities FROM history GROUP BY repository), w AS (SELECT repository, count(*) AS growth_alerts FROM a WHERE growth_pct > 200 GROUP BY repository) SELECT repository, commits, coalesce(changed_paths, 0) AS changed_paths, coalesce(entities, 0) AS entities, coalesce(growth_alerts, 0) AS growth_alerts FROM x LEFT JOIN p USING (repository) LEFT JOIN n USING (repository) LEFT JOIN w USING (repository)")

# Graphs
_CYCLES = f"WITH RECURSIVE {E_}, p AS (SELECT repository, [src, dst] AS nodes, false AS closed FROM e WHERE src < dst UNION ALL SELECT p.repository, CASE WHEN e.dst = nodes[1] THEN nodes ELSE list_append(nodes, e.dst) END, e.dst = nodes[1] FROM p JOIN e ON e.repository = p.repository AND e.src = nodes[-1] WHERE NOT closed AND len(nodes) <= 4 AND (e.dst = nodes[1] OR (len(nodes) < 4 AND e.dst > nodes[1] AND NOT list_contains(nodes, e.dst)))) SELECT repository, CAST(len(nodes) AS BIGINT) AS length, array_to_string(nodes, ' -> ') AS cycle FROM p WHERE closed"
add(
    "cycles", graph.cycles, "edges",
    sql=_CYCLES,
)
add("cycle_issues", graph.cycle_issues, "edges", sql=f"SELECT repository, 'high' AS severity, 'architecture' AS kind, 'whole project' AS location, 'Files depend on each other in a circle: ' || cycle AS description FROM ({_CYCLES}) q")
add("cycle_members", graph.cycle_members, "edges")
add("degrees", graph.degrees, "edges", sql=f"WITH {E_}, d AS (SELECT repository, src AS path, 1 AS o, 0 AS i FROM e UNION ALL SELECT repository, dst, 0, 1 FROM e) SELECT repository, path, CAST(sum(o) AS BIGINT) AS imports, CAST(sum(i) AS BIGINT) AS imported_by FROM d GROUP BY repository, path")
add("component_sizes", graph.component_sizes, "edges", sql=f"WITH RECURSIVE {E_}, u AS (SELECT repository, src AS a, dst AS b FROM e UNION SELECT repository, dst, src FROM e), r AS (SELECT repository, a AS root, a AS node FROM u UNION SELECT r.repository, r.root, u.b FROM r JOIN u ON u.repository = r.repository AND u.a = r.node), m AS (SELECT repository, node, min(root) AS component FROM r GROUP BY repository, node) SELECT repository, component, count(*) AS nodes FROM m GROUP BY repository, component")

# Syntax trees
add("python_functions", astmetrics.functions, FILES)
add("python_findings", astmetrics.findings, FILES)
add("function_sizes", astmetrics.function_sizes, FILES)
add("python_complexity", astmetrics.file_complexity, FILES)
add("quality_scores", astmetrics.quality, FILES)
add("performance_scores", lambda files: quality.findings_score(astmetrics.findings(files).join(latest(files, "repository"), "file_id"), "repository"), FILES)
add("roadmap", astmetrics.roadmap, FILES)


def risk_levels(files: DataFrame) -> DataFrame:
    rows = astmetrics.functions(files).filter("NOT is_async")
    return rows.groupBy("file_id", quality.risk(F.col("complexity")).alias("risk")).agg(F.count("*").alias("functions"))


add("risk_levels", risk_levels, FILES)

# Prompts and diagrams


def conversations(documents: DataFrame, label: str = "User") -> DataFrame:
    """Documents of a source and day as a conversation: read-mes set the scene, answers and reviews come from the user."""
    role = F.when(F.col("kind") == "readme", "system").when(F.col("kind").isin("answer", "review"), "user").otherwise("assistant")
    rows = documents.filter("source IS NOT NULL AND doc_id IS NOT NULL").select(F.concat_ws("@", "source", F.to_date("created_at").cast("string")).alias("conversation"), F.col("created_at").alias("at"), "doc_id", role.alias("role"), "text")
    return prompts.message_prompts(rows, "conversation", ["at", "doc_id"], label)


_CONVERSATIONS = """WITH m AS (SELECT concat_ws('@', source, CAST(CAST(created_at AS DATE) AS VARCHAR)) AS conversation, created_at, doc_id, CASE WHEN kind = 'readme' THEN 'System: ' ELSE 'User: ' END || coalesce(text, '') AS line FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL AND kind IN ('readme', 'answer', 'review')) SELECT conversation, string_agg(line, chr(10) || chr(10) ORDER BY created_at NULLS FIRST, doc_id) || chr(10) || chr(10) || 'Assistant:' AS prompt FROM m GROUP BY conversation"""
add("message_prompts", conversations, "documents", sql=_CONVERSATIONS)
add("human_prompts", lambda documents: conversations(documents, "Human"), "documents", sql=_CONVERSATIONS.replace("'User: '", "'Human: '"))
add("file_prompts", lambda files: prompts.file_prompts(ranking.priority(files), files), FILES)
add("batch_prompts", lambda files: prompts.batched(prompts.file_prompts(ranking.priority(files), files)), FILES)
_FIRST = f"{E_}, k AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY src, dst) AS n FROM e QUALIFY n <= 10)"
_LABEL = "regexp_replace(string_split(path, '/')[-1], '[^A-Za-z0-9_. ]', '', 'g')"
add(
    "interaction_diagrams", diagrams.interaction_diagrams, "edges",
    sql=f"WITH {_FIRST}, u AS (SELECT DISTINCT repository, unnest([src, dst]) AS path FROM k), i AS (SELECT repository, path, 'N' || row_number() OVER (PARTITION BY repository ORDER BY path) AS id, CASE WHEN length({_LABEL}) > 25 THEN substr({_LABEL}, 1, 22) || '...' ELSE {_LABEL} END AS label FROM u), a AS (SELECT repository, string_agg('    ' || id || '[' || label || ']', chr(10) ORDER BY path) AS a FROM i GROUP BY repository), b AS (SELECT k.repository, string_agg('    ' || x.id || ' --> ' || y.id, chr(10) ORDER BY n) AS b FROM k JOIN i x ON x.repository = k.repository AND x.path = src JOIN i y ON y.repository = k.repository AND y.path = dst GROUP BY k.repository) SELECT repository, 'graph TD' || chr(10) || a || chr(10) || b AS diagram FROM a JOIN b USING (repository)",
)
add("flow_texts", diagrams.flow_texts, "edges", sql=f"WITH {_FIRST} SELECT repository, string_agg(string_split(src, '/')[-1] || ' -> ' || string_split(dst, '/')[-1], chr(10) ORDER BY n) AS flow FROM k GROUP BY repository")
add("diagram_edges", lambda edges: diagrams.diagram_edges(diagrams.interaction_diagrams(edges)), "edges")
add("diagram_nodes", lambda edges: diagrams.diagram_nodes(diagrams.interaction_diagrams(edges)), "edges")

# Flows and projects
_CALLED = f"list_filter(regexp_extract_all({TEXT}, '(\\w+)\\s*\\([^)]*\\)', 1), lambda n: length(n) >= 3 AND n NOT IN ({', '.join(map(quoted, extract.NOT_CALLS))}))"


def _seen(patterns, most: int) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({TEXT}, {quoted(p)}) THEN {quoted(n)} END" for n, p in patterns) + f"], lambda l: l IS NOT NULL)[1:{most}]"


def _steps(items: str, action: str, kind: str, category: str) -> str:
    return f"list_transform({items}, lambda n: {{'action': {action}, 'kind': {kind}, 'category': '{category}'}})"


_FLOW = (
    "list_concat(list_concat(list_concat(list_concat("
    + _steps(f"[{STEM}]", "'Start: ' || n", "'initialization'", "entry") + ", " + _steps("ms[1:3]", "'Import ' || n", "'dependency_loading'", "setup") + "), " + _steps(_seen(extract.CONFIGURATION, 2), "'Configure ' || n", "'configuration'", "setup") + "), "
    + _steps("list_filter(cs, lambda n, i: list_position(cs, n) = i)[1:4]", "'Execute ' || n || '()'", _OPERATION, "operation") + "), " + _steps(_seen(extract.CONTROL, 2), "'Control: ' || n", "'control_flow'", "logic") + ")"
)
_ENTRY = "GREATEST(" + ", ".join(f"CASE WHEN {c} THEN {(1 if p == 'high' else 0) + v / 10} ELSE 0 END" for _, c, p, v in _ENTRIES) + ")"
add(
    "flow_steps", flows.flow_steps, FILES,
    sql=f"WITH {F_}, e AS (SELECT *, {MODULES} AS ms, {_CALLED} AS cs, {_ENTRY} AS w FROM f), k AS (SELECT * FROM e WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY repository ORDER BY w DESC, path) <= 5), s AS (SELECT repository, file_id, {_FLOW} AS steps FROM k), u AS (SELECT repository, file_id, unnest(range(1, len(steps) + 1)) AS step, steps FROM s) SELECT repository, file_id, CAST(step AS INTEGER) AS step, steps[step].action AS action, steps[step].kind AS kind, steps[step].category AS category FROM u",
)
add("execution_diagrams", lambda files: flows.execution_diagrams(flows.flow_steps(files)), FILES)
add("data_flow_diagrams", flows.data_flow_diagrams, FILES)
_PREVIEW = "lower(coalesce(content_preview, ''))"
_POINTS = {k: f"CAST(sum(CASE WHEN {any_of(_PREVIEW, w)} THEN {n} ELSE 0 END)" for k, (w, n) in projects.FILE_WORDS.items()}
_FEW = "coalesce(sum(lines), 0) < 2000"
add(
    "project_types", projects.project_types, FILES,
    sql=f"WITH {F_}, g AS (SELECT repository, {_POINTS['educational']} + CASE WHEN {any_of('lower(any_value(repository))', projects.NAMES)} THEN 50 ELSE 0 END + CASE WHEN {_FEW} THEN 30 ELSE 0 END AS BIGINT) AS educational, {_POINTS['production']} AS BIGINT) AS production, {_POINTS['research']} AS BIGINT) AS research, CAST(CASE WHEN {_FEW} THEN 20 ELSE 0 END AS BIGINT) AS prototype FROM f GROUP BY repository) SELECT *, CASE greatest(educational, production, research, prototype) {' '.join(f'WHEN {k} THEN {quoted(k)}' for k in projects.TYPES)} END AS project_type FROM g",
)
add("typed_findings", projects.typed_findings, FILES)
_ALL = "lower(concat_ws(chr(10), content_preview, array_to_string(functions, ' '), array_to_string(imports, ' ')))"
add("domains", projects.domains, FILES, sql=f"WITH {F_} " + " UNION ALL ".join(f"SELECT repository, {quoted(k)} AS domain, count(*) AS files FROM f WHERE {any_of(_ALL, w)} GROUP BY repository" for k, w in projects.DOMAINS.items()))
_IMPORTED, _FUNCTIONS = "lower(coalesce(array_to_string(imports, ' '), ''))", "lower(coalesce(array_to_string(functions, ' '), ''))"
_LISTS = {"layers": [(k, f"bool_or({any_of(_NAME, w)})") for k, w in projects.LAYERS.items()], "frameworks": [(k, f"bool_or({any_of(_IMPORTED, [w])})") for k, w in projects.FRAMEWORKS.items()], "tasks": [(k, f"bool_or({any_of(_FUNCTIONS, w)})") for k, w in projects.TASKS.items()]}
add(
    "structures", projects.structures, FILES,
    sql=f"WITH {F_}, g AS (SELECT repository, {', '.join(f'{labelled(r)} AS {k}' for k, r in _LISTS.items())}, count(*) AS files, CAST(sum(coalesce(len(functions), 0)) AS BIGINT) AS functions, CAST(sum(coalesce(len(classes), 0)) AS BIGINT) AS classes FROM f GROUP BY repository) SELECT *, CASE WHEN classes * 10 > functions * 3 THEN 'object-oriented' WHEN functions > classes * 3 THEN 'functions' ELSE 'mixed' END AS style FROM g",
)

# Standards, advice and prompts
def _values(table_: dict[str, tuple], *names: str) -> str:
    rows = ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else f"CAST({x} AS {'DOUBLE' if isinstance(x, float) else 'INTEGER'})" for x in (k, *v)) + ")" for k, v in table_.items())
    return f"(VALUES {rows}) v({', '.join(names)})"


_TYPED = f"(SELECT repository, project_type FROM ({SQL['project_types']}) p)"
add("standards", advice.standards, FILES, sql=f"SELECT repository, v.* FROM {_TYPED} t JOIN {_values(projects.STANDARDS, 'project_type', *projects.STANDARD)} USING (project_type)")
add("context_messages", advice.context_messages, FILES, sql=f"SELECT repository, v.* FROM {_TYPED} t JOIN {_values({k: (m, ' '.join(r)) for k, (m, r) in advice.MESSAGES.items()}, 'project_type', 'message', 'recommendations')} USING (project_type)")
add("context_scores", advice.context_scores, FILES)
add("finding_kinds", lambda files: advice.findings_by(astmetrics.findings(files), files, "severity", "rule"), FILES)
add("quality_advice", advice.quality_advice, FILES)
add("performance_insights", advice.performance_insights, FILES)
add("call_contexts", advice.call_contexts, FILES)
_BY_RULE = "CASE application_type " + " ".join(f"WHEN {quoted(n)} THEN {k}" for k, n in enumerate(rules.APPLICATION_TYPES)) + " END"
_APPLICATION = f"(SELECT repository, application_type FROM ({SQL['application_types']}) q WHERE repository IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repository ORDER BY files DESC, {_BY_RULE}) = 1)"
_EVERY = f"(WITH {F_} SELECT DISTINCT repository FROM f WHERE repository IS NOT NULL)"
_FOCUS = [f"CASE application_type {' '.join(f'WHEN {quoted(k)} THEN {quoted(v[at])}' for k, v in advice.FOCUS.items())} ELSE {quoted(advice.OTHER_FOCUS[at])} END" for at in (0, 1)]
add("strategies", advice.strategies, FILES, sql=f"SELECT repository, application_type, {_FOCUS[0]} AS focus, {_FOCUS[1]} AS depth FROM {_EVERY} e LEFT JOIN {_APPLICATION} a USING (repository)")
_COUNT = lambda *words: f"count_if({any_of(_NAME, words)})"
add(
    "architectures", advice.architectures, FILES,
    sql=f"WITH {F_}, g AS (SELECT repository, count(*) AS files, {_COUNT('model')} AS m, {_COUNT('view')} AS v, {_COUNT('control')} AS c, {_COUNT('api')} AS a, {_COUNT('business', 'logic')} AS l, {_COUNT('data', 'db')} AS d, {_COUNT('service')} AS s, {_COUNT('component')} AS k FROM f WHERE repository IS NOT NULL GROUP BY repository) SELECT repository, {labelled([('MVC', 'm > 0 AND v > 0 AND c > 0'), ('Service-oriented', 's > 2'), ('Layered', 'a > 0 AND l > 0 AND d > 0'), ('Component-based', 'k > 1')])} AS patterns, CASE WHEN application_type = 'Web Application' THEN 'web' WHEN application_type = 'CLI Application' THEN 'command line' WHEN application_type = 'Machine Learning' THEN 'learning pipeline' WHEN files > 20 THEN 'many modules' WHEN files < 5 THEN 'script' ELSE 'modular' END AS style FROM g LEFT JOIN {_APPLICATION} t USING (repository)",
)
_PROFILE = f"p AS (SELECT c.repository, application_type, level, large_functions, coalesce(n, 0) AS entries, language FROM ({SQL['complexity_levels']}) c LEFT JOIN {_APPLICATION} a USING (repository) LEFT JOIN (SELECT repository, count(*) AS n FROM ({SQL['entry_points']}) e JOIN f USING (file_id) GROUP BY repository) n USING (repository) LEFT JOIN ({SQL['primary_language']}) l USING (repository) WHERE c.repository IS NOT NULL)"


def _some(items: list[tuple[str, str]], most: int) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for t, c in items) + f"], lambda l: l IS NOT NULL)[1:{most}]"


_INSIGHTS = [("'type: ' || application_type", "application_type IS NOT NULL"), ("'easy to understand'", "level = 'Low'"), ("'divide into modules'", "level = 'High'"), ("'restructure'", "level = 'Very High'"), ("'one entry point'", "entries = 1"), ("'entry points: ' || entries", "entries > 5"), ("'language: ' || language", "language IS NOT NULL")]
_ADVICE = [("'break large files up'", "level = 'High'"), ("'split large functions'", "large_functions > 3"), ("'add an entry point'", "entries = 0"), ("'join entry points'", "entries > 10"), ("'check requests and handle errors'", "application_type = 'Web Application'"), ("'describe the commands'", "application_type = 'CLI Application'"), ("'check the data and handle errors'", "application_type = 'Data Processing'"), ("'look for untidy parts in the diagrams'", "true")]
add("visual_insights", advice.visual_insights, FILES, sql=f"WITH {F_}, {_PROFILE} SELECT repository, 'insight' AS kind, unnest({_some(_INSIGHTS, 6)}) AS item FROM p UNION ALL SELECT repository, 'recommendation', unnest({_some(_ADVICE, 5)}) FROM p")
add(
    "evolution_insights", advice.evolution_insights, "commits", "commit_files", "history",
    sql=f"WITH r AS (SELECT DISTINCT repository FROM commits WHERE repository IS NOT NULL), g AS (SELECT repository, max((growth_pct, entity)) AS x FROM ({SQL['growth_alerts']}) q GROUP BY repository), b AS (SELECT repository, max((bug_fixes, path)) AS y FROM ({SQL['bug_prone']}) q GROUP BY repository), l AS (SELECT repository, count(*) AS n FROM ({SQL['forecasts']}) q WHERE priority = 'high' GROUP BY repository), j AS (SELECT * FROM r LEFT JOIN g USING (repository) LEFT JOIN b USING (repository) LEFT JOIN l USING (repository)) SELECT repository, 'grew fastest' AS insight, x[2] AS subject, CAST(x[1] AS DOUBLE) AS amount FROM j WHERE x IS NOT NULL UNION ALL SELECT repository, 'repaired most', y[2], CAST(y[1] AS DOUBLE) FROM j WHERE y IS NOT NULL UNION ALL SELECT repository, 'will grow too large', NULL, CAST(n AS DOUBLE) FROM j WHERE n > 0 UNION ALL SELECT repository, 'healthy', NULL, CAST(0 AS DOUBLE) FROM j WHERE x IS NULL AND y IS NULL",
)
_CORE = f"(SELECT repository, path, rank FROM ({SQL['core_files_top8']}) q)"
add("function_inventory", advice.function_inventory, FILES, sql=f"WITH {F_} SELECT repository, substr(string_agg(path || ': ' || array_to_string(functions[1:5], ', ') || chr(10), '' ORDER BY rank, path), 1, 1000) AS inventory FROM f JOIN {_CORE} c USING (repository, path) WHERE len(functions) > 0 GROUP BY repository")
_PATTERNS = ", ".join(f"count_if({k}) AS {k}" for k in rules.FILE_PATTERNS)
_COUNTED = f"array_to_string(list_filter([{', '.join(f'CASE WHEN {k} > 0 THEN {quoted(k + chr(58) + chr(32))} || {k} END' for k in rules.FILE_PATTERNS)}], lambda l: l IS NOT NULL), '; ')"
SQL["intelligence"] = f"WITH g AS (SELECT repository, count(*) AS files, {_PATTERNS} FROM ({SQL['file_patterns']}) q WHERE repository IS NOT NULL GROUP BY repository), s AS ({SQL['structures']}), i AS (SELECT repository, string_agg(import_line || ' (' || files || ')', '; ' ORDER BY rank) AS imports FROM ({SQL['import_frequency']}) q GROUP BY repository), u AS (SELECT repository, string_agg(purpose || ': ' || files, '; ' ORDER BY purpose) AS purposes FROM ({SQL['purposes']}) q GROUP BY repository), c AS ({SQL['coupling']}), t AS ({SQL['technologies']}) SELECT repository, g.files, {_COUNTED} AS patterns, layers, coalesce(i.imports, '') AS imports, tasks, purposes, coupling AS import_level, organisation AS function_level, technologies FROM g LEFT JOIN s USING (repository) LEFT JOIN i USING (repository) LEFT JOIN u USING (repository) LEFT JOIN c USING (repository) LEFT JOIN t USING (repository)"
add("intelligence", report.intelligence, FILES, sql=SQL["intelligence"])
_SECTION = lambda t, c: f"chr(10) || chr(10) || {quoted(t)} || chr(10) || coalesce(nullif(CAST({c} AS VARCHAR), ''), 'unknown')"
_FACTS = " || ".join(_SECTION(t, c) for t, c in report.INSIGHT_SECTIONS)
add("insight_prompts", report.insight_prompts, FILES, sql=f"SELECT repository, {quoted(report.INSIGHT_HEAD)} || repository || {_FACTS} || chr(10) || chr(10) || {quoted(report.INSIGHT_TAIL)} AS prompt FROM ({SQL['intelligence']}) q")
_KEYED = f"k AS (SELECT repository, path, rank, 'File: ' || path || chr(10) || 'Purpose: ' || {_PURPOSE} || chr(10) || 'Functions: ' || coalesce(array_to_string(functions[1:5], ', '), '') || chr(10) || 'Classes: ' || coalesce(array_to_string(classes[1:3], ', '), '') || chr(10) || 'Imports: ' || coalesce(array_to_string(imports[1:5], ', '), '') || chr(10) || 'Lines: ' || coalesce(lines, 0) || chr(10) || substr(coalesce(content_preview, ''), 1, 400) AS text FROM f JOIN {_CORE} c USING (repository, path))"
QUESTION = "How do the main parts work together?"
add("mentor_prompts", lambda files: report.mentor_prompts(files, QUESTION), FILES, sql=f"WITH {F_}, {_KEYED}, x AS (SELECT repository, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) AS core FROM k GROUP BY repository) SELECT repository, 'System: ' || {quoted(report.MENTOR_HEAD)} || repository || {_FACTS} || {_SECTION('Key files', 'core')} || chr(10) || chr(10) || 'User: About ' || repository || ': {QUESTION}' || chr(10) || chr(10) || 'Assistant:' AS prompt FROM ({SQL['intelligence']}) q LEFT JOIN x USING (repository)")
_OF_CORE = f"WITH {F_}, f2 AS (SELECT f.* FROM f JOIN {_CORE} c ON c.repository = f.repository AND c.path = f.path)"
add("key_file_imports", report.key_file_imports, FILES, sql=f"{_OF_CORE}, n AS (SELECT repository, unnest(imports) AS import_line FROM f2), g AS (SELECT repository, import_line, count(*) AS files FROM n GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY repository ORDER BY files DESC, import_line) AS INTEGER) AS rank FROM g QUALIFY rank <= 5")
add("key_file_levels", report.key_file_levels, FILES, sql=f"{_OF_CORE}, g AS (SELECT repository, count(*) AS files, CAST(sum(coalesce(len(functions), 0)) AS BIGINT) AS functions FROM f2 GROUP BY repository) SELECT *, CASE WHEN functions > 10 * files THEN 'complex' WHEN functions > 5 * files THEN 'moderate' ELSE 'simple' END AS level FROM g")

# SQL of queries above that others are made of
SQL["repository_report"] = f"WITH t AS (SELECT repository, files, total_lines FROM ({SQL['corpus_overview']}) q WHERE repository IS NOT NULL AND extension IS NULL) SELECT repository, t.files, t.total_lines, coalesce(language, 'none') AS language, technologies, level, coupling FROM t LEFT JOIN ({SQL['primary_language']}) l USING (repository) LEFT JOIN ({SQL['technologies']}) n USING (repository) LEFT JOIN ({SQL['complexity_levels']}) c USING (repository) LEFT JOIN ({SQL['coupling']}) k USING (repository)"
_WINDOW = "array_to_string(ls[k : k + 4], chr(10))"
SQL["script_findings"] = f"WITH {F_}, l AS (SELECT file_id, string_split({TEXT}, chr(10)) AS ls FROM f WHERE extension IN {SCRIPT}), k AS (SELECT file_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM l), w AS (SELECT file_id, k, regexp_matches({_WINDOW}, 'document\\.querySelector|document\\.getElementById|\\$\\(') AS page, regexp_matches({_WINDOW}, '\\.(?:push|unshift)\\(') AS grows FROM k WHERE regexp_matches(ls[k], '\\bfor\\b\\s*(?:await\\s*)?\\(|\\bwhile\\s*\\(')) SELECT file_id, CAST(k AS INTEGER) AS line_no, CASE WHEN page THEN 'high' ELSE 'low' END AS severity, CASE WHEN page THEN 'dom_query_in_loop' ELSE 'array_growth_in_loop' END AS rule FROM w WHERE page OR grows"
_GRADE = "CASE " + " ".join(f"WHEN score >= {n} THEN {quoted(g)}" for n, g in quality.GRADES) + " ELSE 'F' END"
SQL["script_scores"] = f"WITH g AS (SELECT file_id, count(*) AS findings, {', '.join(f'count_if(severity = {quoted(k)}) AS {k}' for k in quality.COSTS)} FROM ({SQL['script_findings']}) q GROUP BY file_id), s AS (SELECT *, CAST(greatest(0, 100 - {' - '.join(f'{k} * {n}' for k, n in quality.COSTS.items())}) AS INTEGER) AS score FROM g) SELECT *, {_GRADE} AS grade FROM s"
_OR = lambda c, n: f"coalesce(nullif(array_to_string({c}[1:{n}], ', '), ''), 'none')"
SQL["file_prompts"] = f"WITH {F_} SELECT repository, f.path, 'File: ' || f.path || chr(10) || 'Type: ' || extension || ', lines: ' || coalesce(CAST(lines AS VARCHAR), 'unknown') || chr(10) || 'Imports: ' || {_OR('imports', 10)} || chr(10) || 'Functions: ' || {_OR('functions', 15)} || chr(10) || 'Classes: ' || {_OR('classes', 10)} || chr(10) || chr(10) || substr(coalesce(content_preview, ''), 1, 800) AS prompt FROM f JOIN ({SQL['priority_top12']}) r USING (repository, path)"
SQL["batch_prompts"] = f"WITH k AS (SELECT repository, prompt, row_number() OVER (PARTITION BY repository ORDER BY path) - 1 AS k FROM ({SQL['file_prompts']}) q) SELECT repository, k // 3 AS batch, string_agg('FILE ' || (k % 3 + 1) || ': ' || prompt, chr(10) || chr(10) ORDER BY k) AS prompt FROM k GROUP BY repository, k // 3"
_DRAWN = f"d AS (SELECT repository, {strip('unnest(string_split(diagram, chr(10)))')} AS line FROM ({SQL['interaction_diagrams']}) q)"
_ARROW = "'^(\\w+)(?:\\[[^\\]]*\\])?\\s*-->\\s*(?:\\|([^|]*)\\|\\s*)?(\\w+)'"
SQL["diagram_edges"] = f"WITH {_DRAWN} SELECT repository, regexp_extract(line, {_ARROW}, 1) AS from_id, regexp_extract(line, {_ARROW}, 3) AS to_id, nullif(regexp_extract(line, {_ARROW}, 2), '') AS label FROM d WHERE regexp_matches(line, {_ARROW})"
_NODES = f"{_DRAWN}, n AS (SELECT DISTINCT repository, regexp_extract(line, '^(\\w+)\\[', 1) AS id, regexp_extract(line, '^\\w+\\[([^\\]]*)\\]', 1) AS label FROM d WHERE regexp_matches(line, '^\\w+\\[[^\\]]*\\]'))"
add("diagram_components", lambda edges: diagrams.diagram_components(diagrams.interaction_diagrams(edges)), "edges", sql=f"WITH {_NODES}, a AS (SELECT x.repository, x.label || ' -> ' || y.label AS line FROM ({SQL['diagram_edges']}) e JOIN n x ON x.repository = e.repository AND x.id = from_id JOIN n y ON y.repository = e.repository AND y.id = to_id), c AS (SELECT repository, string_agg(label, chr(10) ORDER BY id) AS components FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY repository ORDER BY id) <= 10) q GROUP BY repository), t AS (SELECT repository, string_agg(line, chr(10) ORDER BY line) AS flow FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY repository ORDER BY line) <= 10) q GROUP BY repository) SELECT repository, components, flow FROM c LEFT JOIN t USING (repository)")
_SHORT = "regexp_replace(CASE WHEN length(action) > 25 THEN substr(action, 1, 22) || '...' ELSE action END, '[\"\\[\\]{}()]', '', 'g')"
SQL["execution_diagrams"] = f"WITH s AS (SELECT *, max(step) OVER (PARTITION BY file_id) AS last FROM ({SQL['flow_steps']}) q WHERE step <= 8) SELECT file_id, 'graph TD' || chr(10) || string_agg('    S' || step || '[\"' || {_SHORT} || '\"]' || chr(10) || '    class S' || step || ' ' || category || CASE WHEN step < last THEN chr(10) || '    S' || step || ' --> S' || (step + 1) ELSE '' END, chr(10) ORDER BY step) AS diagram FROM s GROUP BY file_id"
_PART = lambda c: f"list_filter(string_split({c}, ', '), lambda x: x <> '')[1:2]"
_DRAW = lambda c, mark, arrow: f"array_to_string(list_transform({_PART(c)}, lambda x, i: chr(10) || '    {mark}' || k || '_' || i || '[\"' || substr(regexp_replace(x, '[^a-zA-Z0-9 ]', '', 'g'), 1, 15) || '\"]' || chr(10) || '    ' || {arrow}), '')"
_INTO, _OUT = "'I' || k || '_' || i || ' --> F' || k", "'F' || k || ' --> O' || k || '_' || i"
SQL["data_flow_diagrams"] = f"WITH {F_}, d AS (SELECT repository, path, {STEM} AS stem, inputs, outputs, row_number() OVER (PARTITION BY repository ORDER BY complexity DESC, path) AS k FROM ({SQL['data_flows']}) q JOIN f USING (file_id) QUALIFY k <= 2) SELECT repository, 'graph TD' || string_agg(chr(10) || '    F' || k || '[\"' || stem || '\"]' || {_DRAW('inputs', 'I', _INTO)} || {_DRAW('outputs', 'O', _OUT)}, '' ORDER BY k) AS diagram FROM d GROUP BY repository"
add(
    "all_diagrams", flows.all_diagrams, FILES, "edges",
    sql=f"WITH s AS ({SQL['flow_steps'].replace('<= 5)', '<= 1)')}), x AS ({SQL['execution_diagrams'].replace(SQL['flow_steps'], 'SELECT * FROM s')}) SELECT repository, 'execution' AS kind, diagram FROM x JOIN (SELECT DISTINCT file_id, repository FROM s) u USING (file_id) UNION ALL SELECT repository, 'interactions', diagram FROM ({SQL['interaction_diagrams']}) i UNION ALL SELECT repository, 'data_flow', diagram FROM ({SQL['data_flow_diagrams']}) w",
)

# Sources
_BARE = f"regexp_replace(regexp_replace({strip('input')}, '/+$', ''), '(?i)\\.git$', '')"
_PATH = f"regexp_replace({_BARE}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*://)?(?:[^@/\\s]+@)?(?:[A-Za-z0-9\\-]+\\.)+[A-Za-z]+(?::[0-9]+)?[/:]', '')"
_OWNER = "'^([A-Za-z0-9_.\\-]+)/([A-Za-z0-9_.\\-]+)(?:/.*)?$'"
add("repository_inputs", repositories.repositories, "repo_inputs", sql=f"WITH p AS (SELECT {_PATH} AS x FROM repo_inputs WHERE input IS NOT NULL) SELECT lower(regexp_extract(x, {_OWNER}, 1)) || '/' || lower(regexp_extract(x, {_OWNER}, 2)) AS repository, count(*) AS inputs FROM p WHERE regexp_matches(x, {_OWNER}) GROUP BY 1")
add("cache_hits", lambda entries: repositories.cached(entries, F.lit("2023-01-01 00:00:00").cast("timestamp_ntz"), 24 * 30), "repo_inputs", sql="SELECT md5(input || '_full') AS cache_key, arg_max(repository, added_at) AS repository, max(added_at) AS added_at FROM repo_inputs WHERE input IS NOT NULL AND added_at >= TIMESTAMP '2023-01-01' - INTERVAL 720 HOUR GROUP BY input")

# The small corpus with results worked out by hand
_GOLDEN: dict[str, Callable[[DataFrame], DataFrame]] = {
    "golden_functions": astmetrics.functions,
    "golden_findings": astmetrics.findings,
    "golden_sizes": astmetrics.function_sizes,
    "golden_complexity": astmetrics.file_complexity,
    "golden_quality": astmetrics.quality,
    "golden_risks": risk_levels,
    "golden_scores": lambda files: quality.findings_score(astmetrics.findings(files).join(latest(files, "repository"), "file_id"), "repository"),
    "golden_insights": advice.performance_insights,
    "golden_advice": advice.quality_advice,
    "golden_kinds": lambda files: advice.findings_by(astmetrics.findings(files), files, "severity", "rule"),
    "golden_roadmap": astmetrics.roadmap,
    "golden_key_files": rules.key_files,
    "golden_dependencies": relations.dependency_edges,
    "golden_large_files": quality.large_files,
    "golden_calls": lambda files: advice.call_contexts(files.filter("file_id IN (32, 42)")),
}


_SERVICE: dict[str, Callable[[DataFrame], DataFrame]] = {"golden_project_types": projects.project_types, "golden_typed_findings": projects.typed_findings, "golden_context": advice.context_scores}


def _golden(operator: Callable[[DataFrame], DataFrame], texts: dict) -> Query:
    return lambda spark, directory: operator(corpus.files(spark, texts))


def _literal(columns: str, rows: list[tuple]) -> str:
    names, types = zip(*(c.rsplit(" ", 1) for c in columns.split(", ")))
    value = lambda x, t: f"CAST({'NULL' if x is None else quoted(x) if isinstance(x, str) else x} AS {t})"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(value, r, types)) + ")" for r in rows) + f") v({', '.join(names)})"


for _operators, _texts in ((_GOLDEN, corpus.TEXTS), (_SERVICE, corpus.SERVICE)):
    for _name, _operator in _operators.items():
        QUERIES[_name] = _golden(_operator, _texts)
        SQL[_name] = _literal(*corpus.GOLDENS[_name])
