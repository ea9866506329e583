"""Steps a program takes, as rows and as diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import latest, record_text, stem, strip
from . import extract, ranking, rules

SHOWN = 8


def _step(kind: str, category: str, action: Column) -> Column:
    return F.struct(action.alias("action"), F.lit(kind).alias("kind"), F.lit(category).alias("category"))


def steps(text: Column, name: Column) -> Column:
    """Start, at most 3 imports, 2 configurations, 4 operations and 2 forms of control flow, in that order."""
    found = lambda patterns: rules.labels((n, text.rlike(p)) for n, p in patterns)
    return F.concat(
        F.array(_step("initialization", "entry", F.concat(F.lit("Start: "), name))),
        F.transform(F.slice(extract.modules(text), 1, 3), lambda m: _step("dependency_loading", "setup", F.concat(F.lit("Import "), m))),
        F.transform(F.slice(found(extract.CONFIGURATION), 1, 2), lambda c: _step("configuration", "setup", F.concat(F.lit("Configure "), c))),
        F.transform(F.slice(extract.function_calls(text), 1, 4), lambda c: F.struct(F.concat(F.lit("Execute "), c, F.lit("()")).alias("action"), extract.operation_class(c).alias("kind"), F.lit("operation").alias("category"))),
        F.transform(F.slice(found(extract.CONTROL), 1, 2), lambda c: _step("control_flow", "logic", F.concat(F.lit("Control: "), c))),
    )


def flow_steps(files: DataFrame, most: int = 5) -> DataFrame:
    """(repository, file_id, step, action, kind, category) for the first ``most`` entry points of each repository.

    Entry points rank by priority, confidence and path; a file with several marks counts once.
    """
    marks = ranking.entry_points(files).groupBy("file_id").agg(F.max(F.struct((F.col("priority") == "high").alias("high"), "confidence")).alias("m"))
    rows = latest(files, "repository", "path", steps(record_text(), stem(F.col("path"))).alias("steps")).join(marks, "file_id")
    rank = F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("m.high"), F.desc("m.confidence"), "path"))
    kept = rows.withColumn("_k", rank).filter(F.col("_k") <= most).select("repository", "file_id", F.posexplode("steps").alias("_n", "_s"))
    return kept.select("repository", "file_id", (F.col("_n") + 1).alias("step"), "_s.action", "_s.kind", "_s.category")


def short_label(text: Column, most: int = 25) -> Column:
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
    return F.regexp_replace(cut, r'["\[\]{}()]', "")


def execution_diagrams(flows: DataFrame, most: int = SHOWN) -> DataFrame:
    """(file_id, diagram): a chain of the first ``most`` steps, each with the class of its category."""
    kept = flows.filter(F.col("step") <= most)
    last = kept.groupBy("file_id").agg(F.max("step").alias("last"))
    node = F.concat(F.lit("S"), F.col("step").cast("string"))
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("    "), node, F.lit('["'), short_label(F.col("action")), F.lit('"]')),
            F.concat(F.lit("    class "), node, F.lit(" "), F.col("category")),
            F.when(F.col("step") < F.col("last"), F.concat(F.lit("    "), node, F.lit(" --> S"), (F.col("step") + 1).cast("string"))),
        )
    )
    drawn = kept.join(last, "file_id").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("step", lines.alias("lines")))).alias("all"))
    return drawn.select("file_id", F.concat_ws("\n", F.lit("graph TD"), F.flatten("all.lines")).alias("diagram"))


def data_flow_diagrams(files: DataFrame, most: int = 2) -> DataFrame:
    """(repository, diagram) of the ``most`` files with most inputs, changes and outputs; two inputs and outputs each."""
    flows = rules.data_flows(files).join(latest(files, "repository", "path"), "file_id")
    rank = F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("complexity"), "path"))
    kept = flows.withColumn("k", rank).filter(F.col("k") <= most)
    label = lambda x: F.substring(F.regexp_replace(x, "[^a-zA-Z0-9 ]", ""), 1, 15)
    parts = lambda c: F.slice(F.filter(F.split(F.col(c), ", "), lambda x: x != ""), 1, 2)
    k = F.col("k").cast("string")

    def side(column: str, mark: str, inward: bool) -> Column:
        def draw(x, i):
            node = F.concat(F.lit(mark), k, F.lit("_"), (i + 1).cast("string"))
            arrow = F.concat(node, F.lit(" --> F"), k) if inward else F.concat(F.lit("F"), k, F.lit(" --> "), node)
            return F.array(F.concat(F.lit("    "), node, F.lit('["'), label(x), F.lit('"]')), F.concat(F.lit("    "), arrow))

        return F.flatten(F.transform(parts(column), draw))

    lines = F.concat(F.array(F.concat(F.lit("    F"), k, F.lit('["'), stem(F.col("path")), F.lit('"]'))), side("inputs", "I", True), side("outputs", "O", False))
    drawn = kept.groupBy("repository").agg(F.sort_array(F.collect_list(F.struct("k", lines.alias("lines")))).alias("all"))
    return drawn.select("repository", F.concat_ws("\n", F.lit("graph TD"), F.flatten("all.lines")).alias("diagram"))


def all_diagrams(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(repository, kind, diagram): execution of the first entry point, interactions and data flow, each where there is one."""
    from .diagrams import interaction_diagrams

    flows = flow_steps(files, 1)
    execution = execution_diagrams(flows).join(flows.select("file_id", "repository").distinct(), "file_id").select("repository", F.lit("execution").alias("kind"), "diagram")
    interactions = interaction_diagrams(edges).select("repository", F.lit("interactions").alias("kind"), "diagram")
    return execution.unionByName(interactions).unionByName(data_flow_diagrams(files).select("repository", F.lit("data_flow").alias("kind"), "diagram"))


def simplified(diagram: Column, nodes: int = 10, label: int = 20) -> Column:
    """Without styles, with labels of at most ``label`` characters, and without arrows once more than ``nodes`` nodes stand."""
    lines = F.filter(F.transform(F.split(diagram, "\n"), strip), lambda x: (x != "") & ~x.rlike(r"^(?:style |classDef)"))
    is_node = lambda x: x.rlike(r"^[^\[\]]*\[.*\]") & ~x.contains("-->")
    bare = lambda x: F.regexp_replace(F.regexp_extract(x, r"\[([^\]]*)\]", 1), "[\"']", "")
    cut = lambda t: F.when(F.length(t) > label, F.concat(F.substring(t, 1, label - 3), F.lit("..."))).otherwise(t)
    short = lambda x: F.when(is_node(x), F.concat(F.regexp_extract(x, r"^([^\[]*\[)", 1), F.lit('"'), cut(bare(x)), F.lit('"]'))).otherwise(x)
    before = lambda i: F.size(F.filter(F.slice(lines, F.lit(1), F.greatest(i, F.lit(0))), is_node))
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~x.contains("-->") | (before(i) <= nodes), short(x))), lambda x: x.isNotNull())
    return F.array_join(kept, "\n")


def batch_answers(answers: DataFrame, batches: DataFrame) -> DataFrame:
    """(repository, path, answer): the nth section of a batch's answer to its nth path, NULL where there is none.

    ``answers`` has (repository, batch, answer), ``batches`` (repository, batch, n, path)
    with n from 1. Sections begin at FILE marks; the first line of each is dropped.
    """
    sections = answers.select("repository", "batch", F.posexplode(F.split("answer", "FILE ")).alias("n", "section")).filter("n > 0")
    told = sections.select("repository", "batch", "n", strip(F.regexp_extract("section", r"(?s)^[^\n]*\n(.*)$", 1)).alias("answer"))
    return batches.join(told, ["repository", "batch", "n"], "left").select("repository", "path", F.nullif("answer", F.lit("")).alias("answer"))
