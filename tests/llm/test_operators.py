"""Training-data operators in Spark: brute force on small tables, and nulls, repeats, empty tables and clashing columns."""

import itertools
import random

import pytest
from codeloam.llm import credentials, docpairs, generated, invalid, leakage, prose, residue, spans, split, tokens
from codeloam.schema import FILES

NO = [None] * 6


def files(spark, rows):
    """Rows of (file_id, repository, extension, text) as a table with columns of other meanings beside."""
    data = [(i, r, f"{i}{e}", e, None, None if e in (".md", ".json") else t, None if e in (".md", ".json") else t, None, None, None, None, None, None) for i, r, e, t in rows]
    data = [(*x[:5], t[:1000] if t and x[3] in (".md", ".json") else x[5], *x[6:]) for x, (_, _, _, t) in zip(data, rows)]
    df = spark.createDataFrame(data, FILES)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("text", "h", "pos", "start", "kept", "class", "n", "row", "kind", "_key", "lang")})


def texts(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "item_id", "kind")})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_shared_spans_against_brute_force(spark):
    r = random.Random(7)
    piece = lambda n: "".join(r.choice("abcdefgh \né") for _ in range(n))
    pool = [piece(r.choice((39, 40, 41, 60, 200))) for _ in range(8)]
    data = []
    for i in range(40):
        data.append((i, "a/b", ".py", piece(r.randint(0, 80)) + r.choice(pool) + piece(r.randint(0, 80)) + (r.choice(pool) if i % 3 else "")))
    data += [(100, "a/b", ".py", data[3][3]), (101, "a/b", ".md", data[4][3]), (3, "a/b", ".py", data[3][3]), (200, "a/b", ".py", None), (201, None, ".py", ""), (202, "a/b", ".py", "a" * 500), (203, "a/b", ".js", "a" * 300), (None, "a/b", ".py", pool[0] * 3)]
    text = {i: t or "" for i, _, _, t in data if i is not None}
    windows = {i: {t[k : k + 40] for k in range(len(t) - 39)} for i, t in text.items()}
    expected = [(a, b) for a, b in itertools.combinations(sorted(text), 2) if windows[a] & windows[b]]
    found = spans.SharedSpans(files(spark, data), 40)
    assert rows(found.record_pairs()) == expected
    cover = []
    for i, t in text.items():
        others = set().union(*(w for j, w in windows.items() if j != i))
        marked = {p for k in range(len(t) - 39) if t[k : k + 40] in others for p in range(k, k + 40)}
        cover.append((i, len(t), len(marked)))
    assert rows(found.shared_characters()) == sorted(cover)
    pairs, members = rows(found.class_pairs()), {f: c for f, c, _ in found.membership().collect()}
    linked = {tuple(sorted((members[a], members[b]))) for a, b in expected if members[a] != members[b]}
    assert linked == set(pairs)
    degree = lambda c: sum(c in p for p in linked)
    assert {(f, c, n) for f, c, _, n in found.linked_classes().collect()} == {(f, c, degree(c)) for f, c in members.items()}
    groups = {}
    for g, c, n in found.span_groups().collect():
        groups.setdefault((g, n), set()).add(c)
    assert all(len(cs) == n for (_, n), cs in groups.items()) and {tuple(sorted(p)) for cs in groups.values() for p in itertools.combinations(cs, 2)} == linked


def test_hot_copies_are_one_class(spark):
    same = "def f(x):\n    return x + 1\n" * 20
    data = [(i, f"r/{i}", ".py", same) for i in range(60)] + [(100, "r/x", ".py", "y" * 50 + same[:100] + "z" * 50)]
    found = spans.SharedSpans(files(spark, data), 40)
    assert rows(found.class_pairs()) == [(0, 100)]
    assert found.record_pairs().count() == 61 * 60 // 2
    assert rows(found.linked_classes())[0] == (0, 0, 60, 1) and rows(found.linked_classes())[-1] == (100, 100, 1, 1)


def test_split_and_round_trip(spark):
    r = random.Random(8)
    text = "".join(r.choice(["word ", "x\n", "\n\n", "y" * 50]) for _ in range(3000))
    data = [(1, "a", ".py", text), (1, "a", ".py", text), (2, "a", ".py", "z" * 9000), (3, "a", ".py", None), (4, "a", ".py", "short")]
    pieces = rows(split.split_oversized(files(spark, data)))
    for i, t in ((1, text), (2, "z" * 9000)):
        own = [(s, e) for f, s, e in pieces if f == i]
        assert own[0][0] == 0 and own[-1][1] == len(t) and all(e - s <= 4000 for s, e in own)
        assert all(b[0] == a[1] - 200 for a, b in zip(own, own[1:])) and own == list(split.cuts(t))
        assert t[: own[0][1]] + "".join(t[s + 200 : e] for s, e in own[1:]) == t
    assert {f for f, *_ in pieces} == {1, 2}


def test_bisection(spark):
    text = "line of text\n" * 2000
    data = [(1, "a", ".py", text), (1, "a", ".py", text), (2, "a", ".py", None), (3, "a", ".py", "short")]
    assert rows(split.bisect_oversized(files(spark, data))) == [(1, *x) for x in split.bisected(text)]


def test_token_ids(spark):
    data = [(1, "Hello  world"), (2, ""), (3, None), (4, " \n"), (1, "Hello  world"), (5, "long " * 20_000)]
    found = tokens.encode_corpus(texts(spark, data)).collect()
    assert len(found) == 6 and {r.doc_id: r.ids for r in found if r.doc_id in (2, 3)} == {2: [], 3: []}
    own = tokens.Encoder()
    assert all(r.ids == own.encode(dict(data)[r.doc_id] or "") for r in found)


def test_leaks(spark):
    item = " ".join(f"w{k}" for k in range(25))
    data = [(1, "x " + " ".join(f"W{k}," for k in range(3, 15))), (2, " ".join(f"w{k}" for k in range(11))), (3, None), (4, ""), (1, "x " + " ".join(f"W{k}," for k in range(3, 15)))]
    items = spark.createDataFrame([(7, item), (8, None), (9, "short"), (7, item)], "item_id long, text string")
    assert rows(leakage.find_leaks(texts(spark, data), items)) == [(1, 7)]
    assert rows(leakage.find_leaks(texts(spark, data), items.limit(0))) == []
    edited = [(5, " ".join(f"w{k}" if k != 7 else "w" for k in range(3, 15))), *data]
    assert rows(leakage.find_leaks(texts(spark, edited), items, edits=2)) == [(1, 7), (5, 7)]


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 200)
    items = spark.createDataFrame([(k, " ".join(f"v{k}x{j}" for j in range(15))) for k in range(9)], "item_id long, text string")
    data = texts(spark, [(k, " ".join(f"v{k}x{j}" for j in range(12))) for k in range(9)])
    assert rows(leakage.find_leaks(data, items)) == [(k, k) for k in range(9)]


def test_vendored_copies_without_notice(spark):
    library = "\n".join(f"    value_{k} = compute_something(argument_{k}, other_{k})" for k in range(30))
    edited = library.replace("value_3 ", "renamed_3 ")
    own = "\n".join(f"    result_{k} = transform_anything(parameter_{k}, extra_{k})" for k in range(30))
    part = own.replace("\n", "\n", 1) + "\n" + "\n".join(library.split("\n")[:10])
    data = [(1, "a/a", ".py", library), (2, "b/b", ".py", edited), (3, "c/c", ".py", part), (4, "d/d", ".py", None), (5, "d/d", ".py", "")]
    assert rows(generated.cross_repository(files(spark, data))) == [(1,), (2,)]
    repeated = data + [(2, "b/b", ".py", edited)] * 3
    assert rows(generated.cross_repository(files(spark, repeated))) == [(1,), (2,)]


def test_vendored_copies_of_any_number(spark):
    library = [f"    value_{k} = compute_something(argument_{k}, other_{k})" for k in range(12)]
    equal = [(k, f"r/{k % 7}", ".py", "\n".join(library)) for k in range(1001)]
    edited = [(k, f"r/{k % 7}", ".py", "\n".join([*library[: k % 12], f"    edited_{k} = compute_something_else({k})", *library[k % 12 + 1 :]])) for k in range(2000, 3200)]
    assert generated.cross_repository(files(spark, equal)).count() == 1001
    assert generated.cross_repository(files(spark, edited)).count() == 1200
    apart = [(k, f"r/{k}", ".py", "\n".join([*library[: k % 12], f"    edited_{k} = compute_something_else({k})", *library[k % 12 + 1 :]])) for k in range(1500)]
    assert generated.cross_repository(files(spark, apart)).count() == 1500
    # Common turns from many places are no copy of any.
    pool = [f"    common_turn_{k} = settings.get_value('{k}')" for k in range(40)]
    mixed = [(k, f"r/{k}", ".py", "\n".join(random.Random(k).sample(pool, 12))) for k in range(40)]
    assert generated.cross_repository(files(spark, mixed)).count() <= 2
    turn = ["    if not found_anything: return None", "    for row in all_the_rows_given:"]
    own = [(k, f"r/{k % 7}", ".py", "\n".join(x for j in range(12) for x in (f"    own_{k}_{j} = call_number({j}, {k})", turn[j % 2]))) for k in range(4000, 5100)]
    assert rows(generated.cross_repository(files(spark, own))) == []


@pytest.mark.parametrize("operator", [generated.not_handwritten, credentials.find_credentials, credentials.mask_credentials, docpairs.doc_lines, docpairs.doc_pairs, prose.file_languages, invalid.invalid_files, invalid.invalid_rates, split.split_oversized, split.bisect_oversized])
def test_empty_and_null_tables(spark, operator):
    nothing = files(spark, [])
    assert operator(nothing).count() == 0
    nulls = spark.createDataFrame([(None,) * 13, (1, *(None,) * 12), (2, "a", "p", ".py", *(None,) * 9), (3, None, None, ".js", None, "", "", *(None,) * 6)], FILES)
    assert operator(nulls).count() <= 4


def test_empty_documents(spark):
    empty = texts(spark, [])
    assert tokens.encode_corpus(empty).count() == residue.find_residue(empty).count() == residue.without_residue(empty).count() == 0
    mixed = texts(spark, [(1, None), (2, ""), (3, "404 Not Found"), (3, "404 Not Found"), (4, "fine"), (None, "404 Not Found")])
    assert rows(residue.find_residue(mixed)) == [(3, "error", 1.0)]
    assert rows(residue.without_residue(mixed)) == [(1,), (2,), (4,)]
    assert spans.SharedSpans(files(spark, []), 40).record_pairs().count() == 0


def test_repeats_and_long_texts(spark):
    text = 'password = "Shelf#Ledger4760"\n' + "# The rows are read one after the other by us.\n" * 4000 + 'def f():\n    """Reads all the rows of the table."""\n'
    data = [(1, "a/a", ".py", text)] * 3 + [(2, "a/a", ".js", "(" * 5000), (3, "a/a", ".json", '{"a": 1'), (4, "a/a", ".json", "[" * 1000)]
    table = files(spark, data)
    assert rows(credentials.find_credentials(table)) == [(1, 1)]
    assert rows(docpairs.doc_lines(table)) == [(1, 4002)]
    assert [r[:2] for r in rows(prose.file_languages(table))] == [(1, "en")]
    assert rows(invalid.invalid_files(table)) == [(2,), (3,)]
    assert {(r[0], r[1]): r[2:] for r in rows(invalid.invalid_rates(table))}[("a/a", ".py")] == (1, 0, 0.0)
