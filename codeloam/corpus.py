"""A small corpus written for the operators whose results SQL can't compute: each boundary of their rules once.

``GOLDENS`` holds what they must give, worked out by hand from the rules.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .schema import FILES

AT = datetime(2024, 1, 1)


def _loops(depth: int) -> str:
    return "def loops(a):\n" + "".join("    " * (k + 1) + f"for x{k} in a:\n" for k in range(depth)) + "    " * (depth + 1) + "pass\n"


def _long(lines: int) -> str:
    return f"def long_{lines}():\n" + "    x = 1\n" * (lines - 1)


def _branches(count: int) -> str:
    return f"def branch_{count}(a):\n" + "    if a: pass\n" * count


TEXTS = {
    1: ("main.py", 'import os\nfrom .store import load_all\n\n\ndef f(n):\n    """Counts down."""\n    if n > 1 and n < 5 or n:\n        return f(n - 1)\n    return 1 if n else 2\n'),
    2: ("store.py", "import json\nimport test\n\n\n@lru_cache(1)\ndef g(n, *, m=1):\n    return g(n)\n\n\nasync def h(y):\n    async for x in y:\n        text += str(x)\n        db.get(1)\n        db.get(2)\n    with open(p) as fp:\n        z = fp.read()\n    return list(z)\n"),
    3: ("unit.test.py", "def try_all(a):\n    try:\n        a()\n    except ValueError:\n        pass\n    except KeyError:\n        pass\n    while a and b and c:\n        rows.append(a)\n"),
    4: ("two.py", _loops(2)), 5: ("three.py", _loops(3)), 6: ("four.py", _loops(4)),
    **{10 + k: (f"size_{n}.py", _long(n)) for k, n in enumerate((20, 21, 50, 51, 100, 101))},
    **{20 + k: (f"risk_{n + 1}.py", _branches(n)) for k, n in enumerate((4, 5, 9, 10, 14, 15, 16))},
    30: ("broken.py", "def f(:\n"), 31: ("empty.py", ""), 32: ("append.py", "for x in y:\n    out.append(x)\n"),
    40: ("Dockerfile", "FROM x"), 41: ("docs/README.md", "read"), 42: ("requirements.txt", "numpy = run(1)\nwait (2)"), 43: ("big.go", "x\n" * 1001), 44: ("thousand.go", "x\n" * 1000),
}


#: A repository that looks like a service in use.
SERVICE = {1: ("a.py", "import logging\n" + _branches(11)), 2: ("b.py", "# deploy\n" + _branches(14)), 3: ("c.py", "# production\n" + _long(52)), 4: ("d.py", _long(51) + _branches(9))}


def files(spark: SparkSession, texts: dict[int, tuple[str, str]] = TEXTS) -> DataFrame:
    """A corpus as the table of scanned files of one repository."""
    rows = []
    for i, (path, text) in texts.items():
        name = path.rsplit("/", 1)[-1]
        extension = "." + name.rsplit(".", 1)[1] if "." in name else ""
        code = extension in (".py", ".go")
        rows.append((i, "a/b", path, extension, len(text.splitlines()), text[: 2000 if code else 1000], text if code else None, [] if code else None, [] if code else None, [] if code else None, None, AT, AT))
    return spark.createDataFrame(rows, FILES)


#: name -> (columns with types, rows)
GOLDENS: dict[str, tuple[str, list[tuple]]] = {
    # Decisions: with comparisons; with operands of and/or; with conditional expressions and with-blocks.
    "golden_functions": (
        "file_id BIGINT, name VARCHAR, line_no INTEGER, n_lines INTEGER, complexity INTEGER, complexity_operands INTEGER, complexity_blocks INTEGER, parameters INTEGER, has_docstring BOOLEAN, is_async BOOLEAN",
        [
            (1, "f", 5, 5, 6, 4, 5, 1, True, False), (2, "g", 6, 2, 1, 1, 1, 2, False, False), (2, "h", 10, 8, 2, 1, 3, 1, False, True), (3, "try_all", 1, 9, 5, 6, 5, 1, False, False),
            (4, "loops", 1, 4, 3, 3, 3, 1, False, False), (5, "loops", 1, 5, 4, 4, 4, 1, False, False), (6, "loops", 1, 6, 5, 5, 5, 1, False, False),
            *((10 + k, f"long_{n}", 1, n, 1, 1, 1, 0, False, False) for k, n in enumerate((20, 21, 50, 51, 100, 101))),
            *((20 + k, f"branch_{n}", 1, n + 1, n + 1, n + 1, n + 1, 1, False, False) for k, n in enumerate((4, 5, 9, 10, 14, 15, 16))),
        ],
    ),
    "golden_findings": (
        "file_id BIGINT, line_no INTEGER, severity VARCHAR, rule VARCHAR, detail VARCHAR",
        [
            (1, 5, "high", "recursion_without_cache", "f"), (2, 12, "medium", "string_concatenation", "text"), (2, 13, "high", "query_in_loop", "db.get(1)"), (2, 16, "high", "whole_file_read", "read"), (2, 17, "low", "list_from_iterator", ""),
            (4, 2, "medium", "nested_loops", "O(n^2)"), (5, 2, "high", "nested_loops", "O(n^3)"), (5, 3, "medium", "nested_loops", "O(n^2)"), (6, 2, "critical", "nested_loops", "O(n^4)"), (6, 3, "high", "nested_loops", "O(n^3)"), (6, 4, "medium", "nested_loops", "O(n^2)"),
            (25, 1, "medium", "high_complexity", "branch_15 16"), (26, 1, "medium", "high_complexity", "branch_16 17"), (32, 1, "low", "comprehension", ""),
        ],
    ),
    # Six functions of the size files, seven of the risk files, and those of files 1 to 6.
    "golden_sizes": ("repository VARCHAR, small BIGINT, medium BIGINT, large BIGINT, very_large BIGINT, functions BIGINT, mean_lines DOUBLE", [("a/b", 15, 2, 2, 1, 20, 462 / 20)]),
    "golden_complexity": (
        "file_id BIGINT, repository VARCHAR, functions INTEGER, complexity DOUBLE",
        [(1, "a/b", 1, 6.0), (2, "a/b", 1, 1.0), (3, "a/b", 1, 5.0), (4, "a/b", 1, 3.0), (5, "a/b", 1, 4.0), (6, "a/b", 1, 5.0), *((10 + k, "a/b", 1, 1.0) for k in range(6)), *((20 + k, "a/b", 1, n + 1.0) for k, n in enumerate((4, 5, 9, 10, 14, 15, 16))), (31, "a/b", 0, 0.0), (32, "a/b", 0, 0.0)],
    ),
    "golden_risks": (
        "file_id BIGINT, risk VARCHAR, functions BIGINT",
        [(1, "medium", 1), (2, "low", 1), (3, "low", 1), (4, "low", 1), (5, "low", 1), (6, "low", 1), *((10 + k, "low", 1) for k in range(6)), *((20 + k, r, 1) for k, r in enumerate(("low", "medium", "medium", "high", "high", "very_high", "very_high")))],
    ),
    # 1 critical, 5 high, 6 medium and 2 low findings cost 20, 50, 30 and 2 points.
    "golden_scores": ("repository VARCHAR, findings BIGINT, critical BIGINT, high BIGINT, medium BIGINT, low BIGINT, score INTEGER, grade VARCHAR", [("a/b", 14, 1, 5, 6, 2, 0, "F")]),
    "golden_insights": ("repository VARCHAR, insight VARCHAR, amount DOUBLE", [("a/b", "commonest: nested_loops", 6.0), ("a/b", "critical findings", 1.0), ("a/b", "nested loops", 6.0), ("a/b", "queries in loops", 1.0), ("a/b", "in need of work", 0.0)]),
    "golden_kinds": (
        "repository VARCHAR, severity VARCHAR, rule VARCHAR, findings BIGINT",
        [("a/b", "high", "recursion_without_cache", 1), ("a/b", "medium", "string_concatenation", 1), ("a/b", "high", "query_in_loop", 1), ("a/b", "high", "whole_file_read", 1), ("a/b", "low", "list_from_iterator", 1), ("a/b", "medium", "nested_loops", 3), ("a/b", "high", "nested_loops", 2), ("a/b", "critical", "nested_loops", 1), ("a/b", "medium", "high_complexity", 2), ("a/b", "low", "comprehension", 1)],
    ),
    "golden_roadmap": (
        "repository VARCHAR, phase INTEGER, rank INTEGER, file_id BIGINT, line_no INTEGER, severity VARCHAR, rule VARCHAR, effort VARCHAR, impact VARCHAR",
        [("a/b", 2, 1, 6, 2, "critical", "nested_loops", "high", "high"), ("a/b", 2, 2, 1, 5, "high", "recursion_without_cache", "medium", "high"), ("a/b", 2, 3, 2, 13, "high", "query_in_loop", "medium", "high"), ("a/b", 2, 4, 2, 16, "high", "whole_file_read", "medium", "high"), ("a/b", 2, 5, 5, 2, "high", "nested_loops", "medium", "high")],
    ),
    "golden_key_files": ("repository VARCHAR, path VARCHAR", [("a/b", "Dockerfile"), ("a/b", "docs/README.md"), ("a/b", "requirements.txt")]),
    # A relative import of a stem, and a name behind a dot in one.
    "golden_dependencies": ("repository VARCHAR, src VARCHAR, dst VARCHAR", [("a/b", "main.py", "store.py"), ("a/b", "store.py", "unit.test.py")]),
    "golden_large_files": ("file_id BIGINT, path VARCHAR, lines INTEGER", [(43, "big.go", 1001)]),
    "golden_calls": (
        "file_id BIGINT, pos INTEGER, name VARCHAR, place INTEGER, context VARCHAR",
        [(32, 1, "append", 20, "for x in y:\n    out.append(x)\n"), (42, 1, "run", 8, "numpy = run(1)\nwait (2)"), (42, 2, "wait", 15, "numpy = run(1)\nwait (2)")],
    ),
    # 27 later blocks of ten equal lines in the size files and 199 in the long ones, over 2,481 lines; 110 decisions in 21 files that parse.
    "golden_quality": ("repository VARCHAR, average_complexity DOUBLE, duplicate_blocks BIGINT, duplication_pct DOUBLE, large_functions BIGINT, comment_pct DOUBLE, score DOUBLE, grade VARCHAR", [("a/b", 110 / 21, 226, 226000 / 2481, 3, 0.0, 50.0, "F")]),
    "golden_advice": ("repository VARCHAR, advice VARCHAR, amount DOUBLE", [("a/b", "share repeated code", 226.0), ("a/b", "split large functions", 3.0), ("a/b", "add comments", 0.0)]),
    # Three files with marks of production, 15 points each, against 30 and 20 for a small project.
    "golden_project_types": ("repository VARCHAR, educational BIGINT, production BIGINT, research BIGINT, prototype BIGINT, project_type VARCHAR", [("a/b", 30, 45, 0, 20, "production")]),
    "golden_typed_findings": ("repository VARCHAR, file_id BIGINT, line_no INTEGER, name VARCHAR, rule VARCHAR, severity VARCHAR", [("a/b", 1, 2, "branch_11", "complexity", "medium"), ("a/b", 2, 2, "branch_14", "complexity", "high"), ("a/b", 3, 2, "long_52", "size", "low")]),
    "golden_context": ("repository VARCHAR, project_type VARCHAR, findings BIGINT, score DOUBLE, grade VARCHAR", [("a/b", "production", 3, 83.0, "B")]),
}
