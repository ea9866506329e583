"""Core operators on small literal tables, worked out by hand."""

import os
from datetime import datetime, timedelta

import pytest
from codeloam.operators import astmetrics, diagrams, duplicates, extract, flows, graph, history, overview, projects, prompts, quality, ranking, relations, rules
from codeloam.plans import report
from codeloam.schema import COMMIT_FILES, COMMITS, EDGES, FILES, HISTORY
from codeloam.sources import repositories
from pyspark.sql import functions as F

DAY = datetime(2024, 1, 1)


def files(spark, *records):
    """Records (file_id, path, text) of one repository; a dict adds fields."""
    out = []
    for i, path, text, *more in records:
        e = os.path.splitext(path)[1]
        code = e in (".py", ".js", ".ts", ".java", ".go", ".c")
        row = {"file_id": i, "repository": "a/b", "path": path, "extension": e, "lines": len((text or "").splitlines()), "content_preview": (text or "")[: 2000 if code else 1000], "full_content": text if code else None, "imports": [], "functions": [], "classes": [], "file_type": None, "scanned_at": DAY, "loaded_at": DAY}
        row.update(*more)
        out.append(tuple(row.values()))
    return spark.createDataFrame(out, FILES)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_last_delivery_counts_once(spark):
    table = files(spark, (1, "a.py", "x\ny"), (1, "a.py", "x\ny\nz", {"loaded_at": DAY + timedelta(1)}), (1, "a.py", "x\ny\nz", {"loaded_at": DAY + timedelta(1)}), (2, "b.md", "t", {"lines": None}))
    assert rows(overview.corpus_overview(table).filter("extension IS NULL AND repository IS NOT NULL"), "files", "total_lines") == [(2, 3)]
    assert rows(overview.primary_language(table), "language", "total_lines") == [("Python", 3)]


def test_extraction(spark):
    text = "import os\nfrom .shift import a\nfrom x.y import z\n\nclass A(B):\n  def f(self): pass\n  async def g(self): pass\n# TODO: one \n# fixme:two\n"
    script = "import {a} from './b/c';\nconst d = require(\"e/f\");\nfunction g(x) {}\nconst h = (y) => y;\nclass K extends L {}\nmodule.exports = g\n"
    table = files(spark, (1, "a.py", text), (2, "b.js", script))
    name = lambda column: rows(extract.exploded(table, column(F.col("full_content"), F.col("extension")), "v"))
    assert name(extract.function_names) == [(1, 1, "f"), (2, 1, "g"), (2, 2, "const h")]
    assert name(extract.class_names) == [(1, 1, "A"), (2, 1, "K")]
    assert [r[2] for r in name(extract.import_lines)] == ["import os", "from .shift import a", "from x.y import z", "import {a} from './b/c';", 'const d = require("e/f");']
    assert rows(extract.exploded(table, extract.modules(F.col("full_content")), "m")) == [(1, 1, "os"), (1, 2, "shift"), (1, 3, "x"), (2, 1, "c"), (2, 2, "e")]
    assert rows(extract.todo_comments(table)) == [(1, 1, "TODO", "one"), (1, 2, "fixme", "two")]
    assert ("g", "export") in rows(extract.exploded(table, extract.exports(F.col("full_content")), "name", "type"), "name", "type")


def test_duplicates_pair_with_the_first(spark):
    block = "\n".join(f"call_{k}(1)  # {{}}" for k in range(10))
    table = files(spark, *((i, f"f{i}.c", block.replace("{}", str(i))) for i in range(1, 5)), (9, "c.py", "# a\n" * 10))
    assert rows(duplicates.duplicate_blocks(table), "original_path", "duplicate_path") == [("f1.c", f"f{i}.c") for i in (2, 3, 4)]
    assert rows(duplicates.duplication(table), "duplicate_blocks", "duplicate_lines", "total_lines") == [(3, 30, 50)]


def test_rules(spark):
    table = files(spark, (1, "src/main.py", "import sys\nx = open('f')\nprint(x)\nfor a in b: pass"), (2, "requirements.txt", "numpy"), (3, "pkg/user_service.java", "class A {}", {"functions": ["createIt"]}))
    assert rows(rules.technologies(table)) == [("a/b", "Python, Java, Python Package")]
    assert rows(rules.key_files(table)) == [("a/b", "requirements.txt")]
    assert rows(rules.purposes(table), "purpose", "files") == [("Core Logic", 2), ("Entry Points", 1)]
    assert dict(rows(rules.file_architecture(table)))[3] == "Service Layer pattern; Factory / Builder pattern"
    assert ("File input", "", "Console output", 2) == rows(rules.data_flows(table).filter("file_id = 1"))[0][1:]
    assert rows(rules.execution_patterns(table).filter("file_id = 2"), "execution_pattern") == [("sequential",)]
    assert rows(rules.search(table, "NUMPY"), "file_id") == [(2,)]
    asked = spark.createDataFrame([("Hello ",), ("what is MVC?",), ("why is f slow",)], "q string")
    assert [r[0] for r in asked.select(rules.question_class(F.col("q"))).collect()] == ["general", "general", "repository_specific"]


def test_relations(spark):
    table = files(spark, (1, "p/alpha.py", "import beta\nfrom gamma import x\nimport a\nimport b\n", {"imports": ["i1", "i2", "i3"]}), (2, "p/beta.py", "import alpha\n", {"imports": ["i1"]}), (3, "q/gamma_tool.js", "", {"imports": ["i9"]}))
    assert rows(relations.dependency_edges(table)) == [("a/b", "p/alpha.py", "p/beta.py"), ("a/b", "p/beta.py", "p/alpha.py")]
    assert ("alpha", "gamma_tool") in rows(relations.component_interactions(table), "from_component", "to_component")
    assert rows(relations.similar_files(table), "file_id", "similar_id") == [(1, 2), (2, 1)]
    assert rows(relations.import_frequency(table, 1), "import_line", "files") == [("i1", 2)]
    edges = spark.createDataFrame([("a/b", "x/c.py", "d.py"), ("a/b", "b.py", "d.py"), ("a/b", "b.py", "d.py"), ("a/b", "e.py", None)], EDGES)
    assert rows(relations.importers(edges)) == [("a/b", "d.py", "b.py, c.py")]


def test_cycles_and_components(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "c"), ("a", "b"), ("d", "e"), ("e", None), ("x", "y")]
    edges = spark.createDataFrame([("r", *p) for p in pairs], EDGES)
    assert set(rows(graph.cycles(edges), "length", "cycle")) == {(2, "a -> b"), (3, "a -> b -> c")}
    assert rows(graph.component_sizes(edges), "component", "nodes") == [("a", 3), ("d", 2), ("x", 2)]
    assert rows(graph.degrees(edges).filter("path = 'b'"), "imports", "imported_by") == [(2, 1)]
    chain = spark.createDataFrame([("r", f"{k:03}", f"{k + 1:03}") for k in range(200)], EDGES)
    assert rows(graph.component_sizes(chain), "component", "nodes") == [("000", 201)]
    assert graph.cycles(edges.limit(0)).count() == graph.component_sizes(edges.limit(0)).count() == 0


def test_cycles_of_any_length(spark):
    ring = [(f"{k:02}", f"{(k + 1) % 21:02}") for k in range(21)]
    pairs = [*ring, ("05", "03"), ("20", "x"), ("w", "00"), ("x", "y"), ("y", "z"), ("z", "y"), ("z", "u"), ("u", "v"), ("x", None), ("w", "w")]
    edges = spark.createDataFrame([("r", *p) for p in pairs] + [("s", "00", "01")], EDGES)
    short = {k: "03 -> 04 -> 05" for k in ("03", "04", "05")}
    found = {r["path"]: r for r in graph.cycle_members(edges).collect()}
    assert set(found) == {a for a, _ in ring} | {"y", "z"} and {r["repository"] for r in found.values()} == {"r"}
    assert {r["component"] for k, r in found.items() if k < "u"} == {"00"} and found["00"]["files"] == 21 and (found["z"]["component"], found["z"]["files"]) == ("y", 2)
    assert all(r["length"] == (3 if k in short else 2 if k > "u" else 21) for k, r in found.items())
    assert found["04"]["cycle"] == "04 -> 05 -> 03" and found["19"]["cycle"].startswith("19 -> 20 -> 00 -> 01")
    assert graph.cycle_members(edges.limit(0)).count() == 0


def test_history(spark):
    at = lambda k: DAY + timedelta(days=k)
    points = [("f.py::g", "r", f"c{k}", at(k), n, c) for k, (n, c) in enumerate([(10, 4), (20, None), (40, 12)])] + [("f.py::h", "r", "c0", at(0), 0, 1), ("f.py::h", "r", "c1", at(1), 5, 1), ("z.py::one", "r", "c0", at(0), 5, None)]
    table = spark.createDataFrame(points + points[:1], HISTORY)
    assert rows(history.growth_alerts(table), "entity", "first_lines", "last_lines", "growth_pct") == [("f.py::g", 10, 40, 300.0)]
    assert rows(history.complexity_alerts(table), "entity") == [("f.py::g",)]
    assert rows(history.growth_trends(table), "entity", "trend_pct") == [("f.py::g", 100.0), ("f.py::h", 0.0), ("z.py::one", 0.0)]
    assert rows(history.forecasts(table), "entity", "predicted_lines", "priority") == [("f.py::g", 320, "high")]
    assert rows(history.file_complexity(table).filter("commit = 'c0'"), "path", "functions", "complexity") == [("f.py", 2, 2.5)]
    commits = spark.createDataFrame([(f"c{k}", "r", at(k), ["Fix: x\n\nmore", "add y", None, "BUGfix z"][k % 4], at(k)) for k in range(9)] + [("c0", "r", at(0), "Fix: x\n\nmore", at(50))], COMMITS)
    changes = spark.createDataFrame([(f"c{k}", "r", p, 1, None) for k in range(9) for p in ("a/f.py", "g.md")] + [("c8", "r", "new/h.py", 2, 2), ("c0", "r", "a/f.py", 1, None)], COMMIT_FILES)
    assert rows(history.bug_prone(commits, changes)) == [("r", "a/f.py", 5)]
    assert {r[2] for r in rows(history.bug_fixes(commits, changes), "commit", "path", "subject")} == {"Fix: x", "BUGfix z"}
    assert rows(history.sampled_commits(commits)) == [("r", "c1", 8), ("r", "c8", 1)]
    assert rows(history.three_points(commits), "commit", "point") == [("c0", "oldest"), ("c4", "middle"), ("c8", "newest")]
    assert rows(history.new_directories(commits, changes), "directory") == [("new",)]
    assert rows(history.churn(changes).filter("path = 'a/f.py'"), "commits", "insertions", "deletions") == [(9, 9, 0)]
    assert history.three_points(commits.limit(0)).count() == 0


def nested(depth):
    return "def f(a):\n" + "".join("    " * (k + 1) + f"for x{k} in a:\n" for k in range(depth)) + "    " * (depth + 1) + "pass\n"


@pytest.mark.parametrize("depth,severity", [(1, None), (2, "medium"), (3, "high"), (4, "critical")])
def test_nested_loops(depth, severity):
    found = [r for r in astmetrics.finding_rows(nested(depth)) if r[2] == "nested_loops"]
    assert ([r[1] for r in found][:1] or [None]) == [severity]


def test_syntax_trees(spark):
    text = "def f(n):\n    if n > 1 and n < 5 or n:\n        return f(n - 1)\n    return 1 if n else 2\n\n@lru_cache(1)\ndef g(n):\n    return g(n)\n\nasync def h():\n    async for x in y:\n        text += str(x)\n        db.get(1)\n        db.get(2)\n    z = fp.read()\n    return list(z)\n"
    assert [r[:1] + r[3:6] for r in astmetrics.function_rows(text)] == [("f", 6, 4, 5), ("g", 1, 1, 1), ("h", 2, 1, 2)]
    assert sorted(r[2] for r in astmetrics.finding_rows(text)) == ["list_from_iterator", "query_in_loop", "recursion_without_cache", "string_concatenation", "whole_file_read"]
    body = lambda n: "def f():\n" + "    x = 1\n" * (n - 1)
    table = files(spark, *((n, f"{n}.py", body(n)) for n in (20, 21, 50, 51, 100, 101)), (1, "bad.py", "def ("), (2, "e.py", ""), (3, "n.py", None))
    assert rows(astmetrics.function_sizes(table), "small", "medium", "large", "very_large") == [(1, 2, 2, 1)]
    assert {r[0] for r in rows(astmetrics.file_complexity(table), "file_id")} == {20, 21, 50, 51, 100, 101, 2, 3}
    levels = spark.createDataFrame([(n,) for n in (5, 6, 10, 11, 15, 16)], "c int")
    assert [r[0] for r in levels.select(quality.risk(F.col("c"))).collect()] == ["low", "medium", "medium", "high", "high", "very_high"]


def test_scores(spark):
    metrics = spark.createDataFrame([(10.0, 5.0, 0, 10.0), (12.0, 10.0, 1, 4.0), (99.0, 99.0, 99, 60.0), (None, None, None, None)], "average_complexity double, duplication_pct double, large_functions int, comment_pct double")
    assert [tuple(r) for r in quality.quality_score(metrics).select("score", "grade").collect()] == [(100.0, "A"), (59.0, "F"), (20.0, "F"), (100.0, "A")]
    found = spark.createDataFrame([("a", s) for s in ("critical", "high", "medium", "low")] + [("b", "critical")] * 6, "k string, severity string")
    assert rows(quality.findings_score(found, "k"), "k", "score", "grade") == [("a", 64, "D"), ("b", 0, "F")]
    script = files(spark, (1, "a.js", "for (const a of b) {\n  c.push(a);\n}\nfor (;;) {\n  document.querySelector('x');\n}\n"))
    assert {(1, 4, "high")} <= set(rows(quality.script_findings(script), "file_id", "line_no", "severity"))


def test_ranking(spark):
    table = files(spark, (1, "z/main.py", "x\n" * 101), (2, "b.py", ""), (3, "a.py", ""), (4, "README.md", "x"), (5, "c.py", "", {"functions": list("abcdef")}))
    assert rows(ranking.priority(table).orderBy("rank"), "rank", "path", "score") == [(1, "z/main.py", 155), (2, "README.md", 105), (3, "c.py", 45), (4, "a.py", 25), (5, "b.py", 25)]
    assert rows(ranking.core_files(table), "path", "score") == [("c.py", 60), ("z/main.py", 110)]
    assert rows(ranking.entry_points(table), "file_id", "type") == [(1, "filename_entry")]
    assert report.repository_report(table).count() == 1


def test_prompts(spark):
    said = spark.createDataFrame([("c", 2, "user", "b"), ("c", 1, "system", "a"), ("c", 3, "assistant", "x"), ("c", 4, "user", None)], "conv string, turn int, role string, text string")
    assert rows(prompts.message_prompts(said, "conv", ["turn"])) == [("c", "System: a\n\nUser: b\n\nUser: \n\nAssistant:")]
    assert rows(prompts.answered(spark.createDataFrame([("p",), ("q",)], "prompt string"), lambda p: {"p": "yes"}[p])) == [("p", "yes"), ("q", None)]
    table = files(spark, (1, "a.py", "x"), (2, "b.py", "y"), (3, "c.py", "z"), (4, "d.py", "w"))
    assert [r[0].count("FILE") for r in prompts.batched(prompts.file_prompts(ranking.priority(table), table)).orderBy("batch").select("prompt").collect()] == [3, 1]
    keys = prompts.Rotation(["a", "b"])
    assert [keys.next(), keys.next(), keys.next()] == ["a", "b", "a"]
    keys.limit("a")
    keys.limit("b")
    assert keys.next() is None
    router = prompts.Router({"first": lambda p: 1 / 0, "second": lambda p: "ok"})
    assert router("p") == "ok" and router.counts == {"first": 0, "second": 1}


def test_diagrams_round_trip(spark):
    edges = spark.createDataFrame([("r", "p/a.py", "b.py"), ("r", "b.py", "c.py")], EDGES)
    drawn = diagrams.interaction_diagrams(edges)
    assert rows(drawn, "diagram") == [("graph TD\n    N1[b.py]\n    N2[c.py]\n    N3[a.py]\n    N1 --> N2\n    N3 --> N1",)]
    assert rows(diagrams.diagram_edges(drawn), "from_id", "to_id", "label") == [("N1", "N2", None), ("N3", "N1", None)]
    labelled = spark.createDataFrame([("r", "graph TD\nA[x] -->|calls| B")], "repository string, diagram string")
    assert rows(diagrams.diagram_edges(labelled), "from_id", "to_id", "label") == [("A", "B", "calls")]
    assert len(rows(diagrams.diagram_nodes(drawn))) == 3


def test_repository_addresses(spark):
    cases = {"https://code.example/a/b": "a/b", "HTTPS://CODE.EXAMPLE/a/b/": "a/b", "a/b": "a/b", "git@code.example:a/digit.git": "a/digit", " a/b.git ": "a/b", "nothing": None, "": None, None: None, "https://code.example/a/b/tree/main": "a/b"}
    table = spark.createDataFrame([(k,) for k in cases], "input string")
    assert [r[0] for r in table.select(repositories.repository_of(F.col("input"))).collect()] == list(cases.values())


def test_source_tree(spark, tmp_path):
    for path, data in {"pkg/__init__.py": b"import os\n", "pkg/a.js": b"const x = 1\xff\n", "node_modules/x.js": b"1", ".hid/y.py": b"1", "empty.py": b"", "README.md": b"hi", "x.bin": b"1"}.items():
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)
    found = repositories.read_tree(spark, str(tmp_path), "a/b")
    assert rows(found, "path", "lines", "file_type") == [("README.md", 1, "documentation"), ("pkg/__init__.py", 1, None), ("pkg/a.js", 1, None)]
    assert rows(found.filter("extension = '.js'"), "full_content") == [("const x = 1\n",)]
    entries = spark.createDataFrame([("u", "r", DAY), ("u", "s", DAY + timedelta(hours=5)), ("v", "t", DAY - timedelta(days=3)), (None, "x", DAY)], "input string, repository string, added_at timestamp_ntz")
    assert rows(repositories.cached(entries, F.lit(DAY + timedelta(hours=6)).cast("timestamp_ntz")), "repository") == [("s",)]


def test_empty_and_null_tables(spark):
    from codeloam import queries

    empty = {"detailed_files": FILES, "commits": COMMITS, "commit_files": COMMIT_FILES, "history": HISTORY, "edges": EDGES}
    operators = [overview.corpus_overview, overview.file_types, overview.primary_language, rules.technologies, rules.file_patterns, rules.application_types, rules.data_flows, rules.execution_patterns, duplicates.duplication, relations.dependency_edges, relations.component_interactions, relations.similar_files, quality.comment_ratios, quality.complexity_indicators, ranking.priority, astmetrics.findings, astmetrics.quality, report.repository_report]
    nothing = spark.createDataFrame([], FILES)
    nulls = spark.createDataFrame([(1, *(None,) * 12), (2, "r", None, ".py", *(None,) * 9), (None,) * 13], FILES).withColumns({c: F.lit(1) for c in ("_kept", "pos", "score", "text", "blocks")})
    for operator in operators:
        assert operator(nothing).count() <= 1  # a rollup of nothing may give its total
        operator(nulls).collect()
    for operator in (history.growth_trends, history.forecasts, history.file_complexity):
        assert operator(spark.createDataFrame([(None,) * 6], HISTORY)).count() == 0
    assert set(empty) and set(queries.SQL) <= set(queries.QUERIES)


def test_flows(spark):
    text = 'import os\nfrom json import x\nconfig = load_it(1)\nif x:\n    run_all(2)\n    run_all(3)\nif __name__ == "__main__":\n    main(1)\n'
    table = files(spark, (1, "app.py", text), (2, "other.py", "x = 1"))
    found = flows.flow_steps(table)
    assert rows(found.orderBy("step"), "step", "action", "kind") == [
        (1, "Start: app", "initialization"), (2, "Import os", "dependency_loading"), (3, "Import json", "dependency_loading"), (4, "Configure application_config", "configuration"),
        (5, "Execute load_it()", "data"), (6, "Execute run_all()", "control"), (7, "Execute main()", "operation"), (8, "Control: conditional", "control_flow"),
    ]
    drawn = flows.execution_diagrams(found).first()["diagram"].split("\n")
    assert drawn[:4] == ["graph TD", '    S1["Start: app"]', "    class S1 entry", "    S1 --> S2"] and drawn[-1] == "    class S8 logic" and '    S6["Execute run_all"]' in drawn
    data = flows.data_flow_diagrams(files(spark, (1, "a.py", "x = open('f')\nprint(x)"))).first()["diagram"]
    assert data == 'graph TD\n    F1["a"]\n    I1_1["File input"]\n    I1_1 --> F1\n    O1_1["Console output"]\n    F1 --> O1_1'
    many = "graph TD\nclassDef x\n" + "\n".join(f'N{k}["{"long label " * 3}"]' for k in range(12)) + "\nN1 --> N2"
    kept = spark.createDataFrame([(many,)], "d string").select(flows.simplified(F.col("d"))).first()[0].split("\n")
    assert kept[1] == 'N0["long label long l..."]' and len(kept) == 13
    answers = spark.createDataFrame([("r", 0, "FILE 1: x\nfirst\nmore\nFILE 2: y")], "repository string, batch long, answer string")
    batches = spark.createDataFrame([("r", 0, 1, "p"), ("r", 0, 2, "q"), ("r", 0, 3, "s")], "repository string, batch long, n int, path string")
    assert rows(flows.batch_answers(answers, batches), "path", "answer") == [("p", "first\nmore"), ("q", None), ("s", None)]


def test_projects(spark):
    table = files(spark, (1, "a.py", "# Example\nimport logging\n" + nested(3) + "    if a and a or a: pass\n" * 18), (2, "model_view.py", "x", {"imports": ["import flask"], "functions": ["parse_it", "load"], "classes": ["A"]}))
    assert rows(projects.project_types(table)) == [("a/b", 50, 15, 0, 20, "educational")]
    assert rows(projects.typed_findings(table), "file_id", "rule", "severity") == [(1, "complexity", "high")]
    assert rows(projects.structures(table)) == [("a/b", "Model Layer, View Layer", "Flask", "Data I/O", 2, 2, 1, "object-oriented")]
    assert ("a/b", "Data Processing", 1) in rows(projects.domains(table))


def test_positions_in_ranges(spark):
    from codeloam.functions.rank import positioned

    data = [(g, n % 7, f"k{n:03}") for g in ("a", "b", None) for n in range(50)] + [("c", None, "x")]
    table = spark.createDataFrame(data, "g string, v int, k string").repartition(5)
    found = {(r["g"], r["k"]): (r["position"], r["total"]) for r in positioned(table, "g", F.desc("v"), "k").collect()}
    for g in ("a", "b", None, "c"):
        own = sorted((r for r in data if r[0] == g), key=lambda r: (-(r[1] if r[1] is not None else -1), r[2]))
        assert [found[g, r[2]] for r in own] == [(n, len(own)) for n in range(1, len(own) + 1)]
    assert positioned(table.limit(0), "g", "k").count() == 0


def test_similar_files_against_brute_force(spark):
    import random

    r = random.Random(3)
    data = [(i, f"{i}.py", "", {"repository": r.choice("pq"), "imports": r.sample("abcdefghijkl", r.choice((0, 1, 2, 4, 8, 10))) or None, "functions": [r.choice("uvwxyz") for _ in range(r.choice((0, 1, 3, 6, 12)))]}) for i in range(150)]
    sets = {i: (m["repository"], set(m["imports"] or ()), set(m["functions"])) for i, _, _, m in data}
    expected = []
    for i, (p, a, b) in sets.items():
        like = [(j, len(a & c), len(b & d)) for j, (q, c, d) in sorted(sets.items()) if j != i and p == q]
        expected += [(i, *x) for x in like if x[1] * 10 > max(len(a), 1) * 3 or x[2] * 5 > max(len(b), 1)][:4]
    assert sorted(tuple(x) for x in relations.similar_files(files(spark, *data)).collect()) == sorted(expected)


def test_components_over_many_partitions(spark):
    import random

    r = random.Random(4)
    pairs = [(r.choice("rs"), f"n{r.randrange(120):03}", f"n{r.randrange(120):03}") for _ in range(110)] + [("hub", "m", f"n{k:03}") for k in range(200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for p, a, b in pairs:
        if a != b:
            x, y = sorted((find((p, a)), find((p, b))))
            parent[y] = x
    sizes = {}
    for x in list(parent):
        sizes[find(x)] = sizes.get(find(x), 0) + 1
    table = spark.createDataFrame(pairs, EDGES).repartition(7)
    assert rows(graph.component_sizes(table)) == sorted(((*k, n) for k, n in sizes.items()), key=str)


def test_blocks_by_definitions(spark):
    body = "def f(a):\n" + "    x = a\n" * 30
    table = files(spark, (1, "a.py", "import x\n\n\n" + body), (2, "b.py", body + "\n# end\n"), (3, "c.py", "def ("), (4, "d.c", body), (5, "e.py", None))
    assert rows(duplicates.duplicate_definitions(table), "original_path", "original_line", "duplicate_path", "duplicate_line", "n_lines")[0] == ("a.py", 4, "b.py", 1, 21)


def test_golden_results(spark):
    from codeloam import queries

    def plain(x):
        return round(x, 9) if isinstance(x, float) else x

    for operators, texts in ((queries._GOLDEN, queries.corpus.TEXTS), (queries._SERVICE, queries.corpus.SERVICE)):
        table = queries.corpus.files(spark, texts)
        for name, operator in operators.items():
            columns, expected = queries.corpus.GOLDENS[name]
            found = operator(table).select(*(c.rsplit(" ", 1)[0] for c in columns.split(", ")))
            assert sorted((tuple(map(plain, x)) for x in found.collect()), key=str) == sorted((tuple(map(plain, x)) for x in expected), key=str), name


def test_roadmap_phases(spark):
    from codeloam import queries

    assert {r["phase"] for r in astmetrics.roadmap(queries.corpus.files(spark)).collect()} == {2}


def test_scores_by_context(spark):
    from codeloam.operators import advice

    types = spark.createDataFrame([("e", "educational"), ("r", "research"), ("p", "production"), ("x", "prototype"), ("n", None)], "repository string, project_type string")
    found = spark.createDataFrame([(k, rule, s) for k in "erpx" for rule in ("complexity", "size", "other") for s in ("critical", "high", "medium", "low", "odd")], "repository string, rule string, severity string")
    scores = {r[0]: (r["findings"], r["score"], r["grade"]) for r in advice.context_score(types, found).collect()}
    # A rule's findings cost 37 points; 100 less what counts, and the points of the type.
    assert scores == {"e": (15, pytest.approx(120 - 37 * 2), "F"), "r": (15, pytest.approx(110 - 37 * 2.7), "F"), "p": (15, 0.0, "F"), "x": (15, pytest.approx(115 - 37 * 3), "F"), "n": (0, 100.0, "A+")}
    metrics = spark.createDataFrame([("bad", 11.0, 2, 3, 9.0), ("good", 10.0, 0, 0, 10.0), ("none", None, None, None, None)], "repository string, average_complexity double, duplicate_blocks long, large_functions long, comment_pct double")
    told = rows(advice.advice_of(metrics), "repository", "advice")
    assert told == [("bad", "add comments"), ("bad", "share repeated code"), ("bad", "split complex functions"), ("bad", "split large functions"), ("good", "nothing to mend"), ("none", "nothing to mend")]


def test_evolution_insights(spark):
    from codeloam.operators import advice

    at = lambda k: DAY + timedelta(days=k)
    commits = spark.createDataFrame([(f"c{k}", "r", at(k), "fix it", at(k)) for k in range(3)] + [("d", "calm", at(0), "add", at(0))], COMMITS)
    changes = spark.createDataFrame([(f"c{k}", "r", "a.py", 1, 1) for k in range(3)], COMMIT_FILES)
    table = spark.createDataFrame([("a.py::f", "r", f"c{k}", at(k), n, 1) for k, n in enumerate((10, 30, 90))], HISTORY)
    assert rows(advice.evolution_insights(commits, changes, table)) == [("calm", "healthy", None, 0.0), ("r", "grew fastest", "a.py::f", 800.0), ("r", "repaired most", "a.py", 3.0), ("r", "will grow too large", None, 1.0)]


def test_prompts_of_repositories(spark):
    table = files(spark, (1, "main.py", "import os\n", {"imports": ["import os"], "functions": ["train_all", "load"], "classes": ["A"]}), (2, "user_model.py", "x"))
    (prompt,) = rows(report.insight_prompts(table), "prompt")[0]
    assert "Layers\nModel Layer" in prompt and "Commonest imports\nimport os (1)" in prompt and "Purposes\nCore Logic: 1; Entry Points: 1" in prompt
    (mentor,) = rows(report.mentor_prompts(table, "how does it start?"), "prompt")[0]
    assert "File: main.py\nPurpose: Entry Points\nFunctions: train_all, load" in mentor and mentor.endswith("User: About a/b: how does it start?\n\nAssistant:")
    (general,) = rows(report.mentor_prompts(table, "What is OOP?"), "prompt")[0]
    assert general.startswith("System: " + report.GENERAL_HEAD) and "a/b" not in general
    said = spark.createDataFrame([("c", 1, "user", "b")], "conv string, turn int, role string, text string")
    assert rows(prompts.message_prompts(said, "conv", ["turn"], "Human")) == [("c", "Human: b\n\nAssistant:")]


def test_services():
    calls, pauses = [], []

    def call(prompt, key):
        calls.append(key)
        if key == "a":
            raise prompts.Limited
        if len(calls) < 4:
            raise OSError
        return f"{key}: {prompt}"

    service = prompts.Service("s", call, ["a", "b"], 3, pauses.append)
    assert service("p") == "b: p" and calls == ["a", "b", "b", "b"] and pauses == [1.0, 2.0] and service.keys.limited == {"a"} and service.available and service.requests == 1
    service.keys.limit("b")
    assert not service.available and service("p") is None
    assert prompts.keys_of({"k_1": " x ", "k_2": "", "k_4": "y"}, "k") == ["x", "y"]
    router = prompts.discovered({"one": "1"}, {"one": lambda s: (lambda p: None) if "one" in s else None, "two": lambda s: s["two"], "three": lambda s: lambda p: "ok"})
    assert list(router.clients) == ["one", "three"] and router("p") == "ok"
    assert router.status() == {"services": ["one", "three"], "available": ["one", "three"], "first": "one", "requests": 1, "answers": {"one": 0, "three": 1}, "failures": 0, "ready": True}
    router.prefer("three")
    assert router.status()["first"] == "three"
    session = prompts.Session()
    for k in range(6):
        session.note(file=f"f{k % 4}", topic=f"t{k}", level="advanced")
    session.say("user", "x")
    assert session.progress == 100 and session.level == "advanced" and len(session.history) == 1
    session.clear()
    assert session.history == [] and prompts.Session().progress == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from codeloam.sources.tables import shared_folder

    conf = SimpleNamespace(get=lambda k: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError):
            shared_folder(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master=master)))


def test_rules_by_words_written_out(spark):
    """Labels by words given here, not taken from the tables of rules."""
    label = {
        "@app.route('/')": "Web Application", "import argparse": "CLI Application", "df.to_csv(x)": "Data Processing", "import pygame": "Game", "loss.epoch": "Machine Learning", "import tkinter": "Desktop Application", "import unittest": "Testing", "import sqlite3": "Database",
    }
    table = files(spark, *((n, f"f{n}.py", text) for n, text in enumerate(label)))
    found = {r["file_id"]: set(r["t"]) for r in table.select("file_id", rules.rule_labels(F.lower("full_content"), rules.APPLICATION_TYPES).alias("t")).collect()}
    assert all(kind in found[n] for n, kind in enumerate(label.values()))
    flows_of = {
        "open(x)": ("File input", "", ""), "requests.get(x)": ("Network/API input", "", ""), "run_sql(x)": ("Database input", "", ""), "sys.argv": ("User input", "", ""), "os.environ": ("Environment variables", "", ""), "parse": ("", "Data parsing", ""), "convert": ("", "Data conversion", ""),
        "Sort": ("", "Data sorting", ""), "merge": ("", "Data merging", ""), "fh.write(x)": ("", "", "File output"), "console.log(x)": ("", "", "Console output"), "yield x": ("", "", "Function return value"), "render": ("", "", "Response/Render output"),
    }
    table = files(spark, *((n, f"f{n}.py", text) for n, text in enumerate(flows_of)))
    assert {r[0]: tuple(r[1:4]) for r in rules.data_flows(table).collect()} == dict(enumerate(flows_of.values()))
    runs = {"callback listener": "event_driven", "while repeat": "loop_based", "switch case": "conditional", "async thread": "parallel", "pipeline": "pipeline", "next step": "sequential", "x": "sequential"}
    table = files(spark, *((n, f"f{n}.py", text) for n, text in enumerate(runs)))
    assert dict(rows(rules.execution_patterns(table))) == dict(enumerate(runs.values()))
    calls = {"load_rows": "data", "compute_it": "processing", "publish": "output", "launch": "control", "connect_to": "communication", "foo": "operation"}
    names = spark.createDataFrame([(c,) for c in calls], "n string")
    assert [r[0] for r in names.select(extract.operation_class(F.col("n"))).collect()] == list(calls.values())
    shown = {"if x:": "conditional", "for a in b:": "loop", "while x:": "conditional_loop", "try:": "exception_handling", "with a as b:": "context_management", "async def f(": "async_operation", "await x": "async_wait"}
    table = files(spark, *((n, f"f{n}.py", text) for n, text in enumerate(shown)))
    assert {(r[0], r[1]) for r in extract.counted(table, extract.CONTROL).collect()} >= set(enumerate(shown.values()))
    names = {"main.py": "Entry Points", "my_app.js": "Entry Points", "test_x.py": "Tests", "settings.py": "Configuration", "helpers.go": "Utilities", "core.c": "Core Logic"}
    paths = spark.createDataFrame([(f"d/{p}",) for p in names], "p string")
    assert [r[0] for r in paths.select(rules.purpose(F.col("p"))).collect()] == list(names.values())
