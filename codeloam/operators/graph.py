"""Cycles and degrees of dependency graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_edges(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops and open ends."""
    return edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("repository", "src", "dst").distinct()


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """(repository, length, cycle): all simple cycles of at most ``longest`` nodes, each once.

    A cycle is written from its smallest node on. Paths start at that node and go through
    larger ones only, so that no cycle is found twice; each step is an equi-join.
    """
    e = clean_edges(edges)
    step = e.select("repository", F.col("src").alias("_at"), F.col("dst").alias("_next"))
    paths = e.filter("src < dst").select("repository", F.array("src", "dst").alias("nodes"))
    found = None
    for _ in range(2, longest + 1):
        ahead = paths.join(step, (paths["repository"] == step["repository"]) & (F.element_at("nodes", -1) == step["_at"])).select(paths["repository"], "nodes", "_next")
        closed = ahead.filter(F.col("_next") == F.element_at("nodes", 1)).select("repository", "nodes")
        found = closed if found is None else found.unionByName(closed)
        paths = ahead.filter((F.col("_next") > F.element_at("nodes", 1)) & ~F.array_contains("nodes", F.col("_next"))).select("repository", F.array_append("nodes", F.col("_next")).alias("nodes"))
    return found.select("repository", F.size("nodes").cast("long").alias("length"), F.array_join("nodes", " -> ").alias("cycle"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(repository, path, component): each file on a cycle, with the smallest path of its strongly connected component.

    Files without a way in or out are trimmed. Labels of the smallest file that leads to each
    then spread forward, with pointer jumping; the files of a label that lead back to the file
    it names are its component, and the rest goes round again until no edge is left.
    """
    from ..sources.tables import written

    e, left = written(clean_edges(edges)), None
    out = e.select("repository", F.col("src").alias("path"), F.col("src").alias("component")).limit(0)
    while True:
        while (n := e.count()) and n != left:
            left = n
            for _ in range(2):
                e = e.join(e.select("repository", F.col("dst").alias("src")).distinct(), ["repository", "src"], "leftsemi").join(e.select("repository", F.col("src").alias("dst")).distinct(), ["repository", "dst"], "leftsemi").select("repository", "src", "dst")
            e = written(e)
        if not n:
            return out
        labels, changed = written(e.select("repository", F.col("src").alias("path"), F.col("src").alias("label")).distinct()), True
        while changed:
            near = e.join(labels.withColumnRenamed("path", "src"), ["repository", "src"]).groupBy("repository", F.col("dst").alias("path")).agg(F.min("label").alias("near"))
            best = labels.join(near, ["repository", "path"], "left").select("repository", "path", F.least("label", "near").alias("best"), "label")
            jump = labels.select("repository", F.col("path").alias("best"), F.col("label").alias("further"))
            new = written(best.join(jump, ["repository", "best"]).select("repository", "path", F.least("best", "further").alias("label"), F.col("label").alias("old")))
            labels, changed = new.drop("old"), bool(new.filter("label <> old").limit(1).count())
        ends = labels.withColumnRenamed("path", "src").withColumnRenamed("label", "component")
        inner = written(e.join(ends, ["repository", "src"]).join(ends.withColumnRenamed("src", "dst"), ["repository", "dst", "component"]))
        front = inner.filter("src = component").select("repository", F.col("src").alias("path"), "component").distinct()
        back = front = written(front)
        while front.limit(1).count():
            before = inner.join(front.withColumnRenamed("path", "dst"), ["repository", "dst", "component"]).select("repository", F.col("src").alias("path"), "component").distinct()
            front = written(before.join(back, ["repository", "path", "component"], "leftanti"))
            back = back.unionByName(front)
        # A label that nothing leads back to has its own file alone, which is on no cycle.
        lone = back.groupBy("repository", "component").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        out = out.unionByName(written(back.join(lone, ["repository", "component"], "leftsemi").select("repository", "path", "component")))
        rest = inner.select("repository", "src", "dst")
        for end in ("src", "dst"):
            rest = rest.join(back.select("repository", F.col("path").alias(end)), ["repository", end], "leftanti")
        e, left = written(rest.select("repository", "src", "dst")), None


def cycle_members(edges: DataFrame) -> DataFrame:
    """(repository, path, component, files, length, cycle): each file on a cycle of any length, with one shortest through it.

    ``component`` is the smallest path of the file's strongly connected component, of
    ``files`` files. ``cycle`` starts at the file; of several shortest it is the first by its
    paths. The search from a file stays in its component and ends when it closes.
    """
    from ..sources.tables import written

    members = written(strong_components(edges))
    own = members.select("repository", F.col("path").alias("src"), "component")
    step = written(clean_edges(edges).join(own, ["repository", "src"]).join(own.withColumnRenamed("src", "dst"), ["repository", "dst", "component"]).select("repository", F.col("src").alias("at"), F.col("dst").alias("next")))
    front = members.select("repository", F.col("path").alias("start"), F.col("path").alias("at"), F.array("path").alias("nodes"))
    seen, found = None, front.select("repository", "start", "nodes").limit(0)
    while front.limit(1).count():
        ahead = written(front.join(step, ["repository", "at"]).select("repository", "start", "next", "nodes"))
        closed = written(ahead.filter("next = start").groupBy("repository", "start").agg(F.min("nodes").alias("nodes")))
        found = found.unionByName(closed)
        new = ahead.join(closed.select("repository", "start"), ["repository", "start"], "leftanti").groupBy("repository", "start", F.col("next").alias("at")).agg(F.min("nodes").alias("nodes"))
        if seen is not None:
            new = new.join(seen, ["repository", "start", "at"], "leftanti")
        front = written(new.select("repository", "start", "at", F.array_append("nodes", F.col("at")).alias("nodes")))
        now = front.select("repository", "start", "at")
        seen = now if seen is None else seen.unionByName(now)
    sizes = members.groupBy("repository", "component").agg(F.count("*").alias("files"))
    cycle = found.select("repository", F.col("start").alias("path"), F.size("nodes").cast("long").alias("length"), F.array_join("nodes", " -> ").alias("cycle"))
    return members.join(sizes, ["repository", "component"]).join(cycle, ["repository", "path"]).select("repository", "path", "component", "files", "length", "cycle")


def cycle_issues(edges: DataFrame, longest: int = 4) -> DataFrame:
    """(repository, severity, kind, location, description): one issue of high severity for each cycle."""
    told = F.concat(F.lit("Files depend on each other in a circle: "), "cycle")
    return cycles(edges, longest).select("repository", F.lit("high").alias("severity"), F.lit("architecture").alias("kind"), F.lit("whole project").alias("location"), told.alias("description"))


def degrees(edges: DataFrame) -> DataFrame:
    """(repository, path, imports, imported_by)."""
    e = clean_edges(edges)
    out = e.select("repository", F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select("repository", F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return out.groupBy("repository", "path").agg(F.sum("o").alias("imports"), F.sum("i").alias("imported_by"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the edges of one partition: each node with the smallest node it is connected to there."""
    root: dict[tuple[str | None, str], tuple[str | None, str]] = {}

    def find(x):
        path = []
        while root.setdefault(x, x) != x:
            path.append(x)
            x = root[x]
        for p in path:
            root[p] = x
        return x

    for batch in batches:
        for r, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = sorted((find((r, a)), find((r, b))), key=lambda n: n[1])
            root[y] = x
    nodes = [(x[0], x[1], find(x)[1]) for x in list(root)]
    for at in range(0, len(nodes), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*nodes[at : at + 20_000])], ["repository", "node", "low"])


def component_sizes(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(repository, component, nodes): weakly connected components, named by their smallest path.

    Each partition joins its own edges first. Then stars are contracted by turns: every node
    hands its larger neighbours, and then its smaller ones, to the smallest of all. The
    smallest is found by an aggregate, so a hub's neighbours are never gathered. A graph that
    still changes after ``rounds`` turns raises an error.
    """
    from ..sources.tables import written

    rows = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("repository", "src", "dst")
    stars = written(rows.mapInArrow(_forest, "repository string, node string, low string").distinct())
    mark = [F.count("*"), F.sum(F.xxhash64("repository", "node", "low").cast("decimal(20,0)"))]
    seen = tuple(stars.agg(*mark).first())
    for _ in range(rounds):
        links = stars.filter("node <> low")
        both = links.select("repository", F.col("node").alias("a"), F.col("low").alias("b")).unionByName(links.select("repository", F.col("low").alias("a"), F.col("node").alias("b")))
        least = both.groupBy("repository", "a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.filter("b > a").join(least, ["repository", "a"]).select("repository", F.col("b").alias("node"), "low").distinct()
        smallest = large.groupBy("repository", "node").agg(F.min("low").alias("to"))
        small = large.join(smallest, ["repository", "node"]).select("repository", F.explode(F.array(F.struct("node", F.col("to").alias("low")), F.struct(F.col("low").alias("node"), F.col("to").alias("low")))).alias("x")).select("repository", "x.*")
        roots = small.select("repository", F.col("low").alias("node"), "low")
        stars = written(small.unionByName(roots).distinct())
        now = tuple(stars.agg(*mark).first())
        if now == seen:
            return stars.groupBy("repository", F.col("low").alias("component")).agg(F.count("*").alias("nodes"))
        seen = now
    raise RuntimeError(f"components still change after {rounds} rounds")
