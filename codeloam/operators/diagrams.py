"""Diagram texts of dependency graphs, and their way back to nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, strip


def interaction_diagrams(edges: DataFrame, most: int = 10) -> DataFrame:
    """(repository, diagram): a graph of the first ``most`` edges, node ids numbered by name."""
    rows = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("repository", "src", "dst").distinct()
    kept = rows.withColumn("n", F.row_number().over(Window.partitionBy("repository").orderBy("src", "dst"))).filter(F.col("n") <= most)
    nodes = kept.select("repository", F.explode(F.array("src", "dst")).alias("path")).distinct()
    label = F.regexp_replace(basename(F.col("path")), r"[^A-Za-z0-9_. ]", "")
    short = F.when(F.length(label) > 25, F.concat(F.substring(label, 1, 22), F.lit("..."))).otherwise(label)
    named = nodes.select("repository", "path", F.concat(F.lit("N"), F.row_number().over(Window.partitionBy("repository").orderBy("path"))).alias("id"), short.alias("label"))
    drawn = named.groupBy("repository").agg(F.sort_array(F.collect_list(F.struct("path", F.concat(F.lit("    "), "id", F.lit("["), "label", F.lit("]")).alias("line")))).alias("a"))
    a, b = named.select("repository", F.col("path").alias("src"), F.col("id").alias("ia")), named.select("repository", F.col("path").alias("dst"), F.col("id").alias("ib"))
    arrows = kept.join(a, ["repository", "src"]).join(b, ["repository", "dst"]).groupBy("repository").agg(F.sort_array(F.collect_list(F.struct("n", F.concat(F.lit("    "), "ia", F.lit(" --> "), "ib").alias("line")))).alias("b"))
    return drawn.join(arrows, "repository").select("repository", F.concat_ws("\n", F.lit("graph TD"), F.col("a.line"), F.col("b.line")).alias("diagram"))


def cleaned(diagram):
    """Without blank lines, indented, under a graph TD head."""
    rows = F.filter(F.transform(F.split(diagram, "\n"), strip), lambda x: (x != "") & ~x.rlike(r"^(?:graph|flowchart)\b"))
    return F.concat_ws("\n", F.lit("graph TD"), F.transform(rows, lambda x: F.concat(F.lit("    "), x)))


def diagram_edges(diagrams: DataFrame) -> DataFrame:
    """(repository, from_id, to_id, label) of the arrows in each diagram, with the label between bars if there is one."""
    line = strip(F.col("line"))
    pattern = r"^(\w+)(?:\[[^\]]*\])?\s*-->\s*(?:\|([^|]*)\|\s*)?(\w+)"
    rows = diagrams.select("repository", F.explode(F.split("diagram", "\n")).alias("line")).filter(line.rlike(pattern))
    return rows.select("repository", F.regexp_extract(line, pattern, 1).alias("from_id"), F.regexp_extract(line, pattern, 3).alias("to_id"), F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")).alias("label"))


def diagram_nodes(diagrams: DataFrame) -> DataFrame:
    """(repository, id, label, x, y) of the nodes in each diagram, laid out on a circle in order of id."""
    rows = diagrams.select("repository", F.explode(F.split("diagram", "\n")).alias("line")).select("repository", strip(F.col("line")).alias("line")).filter(F.col("line").rlike(r"^\w+\[[^\]]*\]"))
    found = rows.select("repository", F.regexp_extract("line", r"^(\w+)\[", 1).alias("id"), F.regexp_extract("line", r"^\w+\[([^\]]*)\]", 1).alias("label")).distinct()
    by = Window.partitionBy("repository")
    angle = (F.row_number().over(by.orderBy("id")) - 1) * 2 * 3.141592653589793 / F.count("*").over(by)
    return found.select("repository", "id", "label", F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def flow_texts(edges: DataFrame, most: int = 10) -> DataFrame:
    """(repository, flow): the first ``most`` edges as lines of text."""
    rows = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("repository", "src", "dst").distinct()
    kept = rows.withColumn("n", F.row_number().over(Window.partitionBy("repository").orderBy("src", "dst"))).filter(F.col("n") <= most)
    line = F.concat(basename(F.col("src")), F.lit(" -> "), basename(F.col("dst")))
    return kept.groupBy("repository").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("t")))), lambda x: x.t), "\n").alias("flow"))


def diagram_components(diagrams: DataFrame, most: int = 10) -> DataFrame:
    """(repository, components, flow): the first node labels and arrows of each diagram as text."""
    first = lambda df, item, order: df.withColumn("n", F.row_number().over(Window.partitionBy("repository").orderBy(order))).filter(F.col("n") <= most).groupBy("repository").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    nodes = diagram_nodes(diagrams)
    arrows = diagram_edges(diagrams)
    names = nodes.select("repository", "id", "label")
    a, b = names.select("repository", F.col("id").alias("from_id"), F.col("label").alias("x")), names.select("repository", F.col("id").alias("to_id"), F.col("label").alias("y"))
    flow = arrows.join(a, ["repository", "from_id"]).join(b, ["repository", "to_id"]).select("repository", F.concat("x", F.lit(" -> "), "y").alias("line"))
    components = first(names, F.col("label"), F.col("id")).withColumnRenamed("text", "components")
    return components.join(first(flow, F.col("line"), F.col("line")).withColumnRenamed("text", "flow"), "repository", "left")
