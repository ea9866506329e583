"""Which files depend on which, by imported names, and which resemble each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, latest, record_text, stem
from .extract import modules


def _imports(files: DataFrame) -> DataFrame:
    return latest(files, "repository", "path", "lines", modules(record_text()).alias("modules"))


def substrings(text: Column) -> Column:
    """All different substrings of a name; there are at most as many as the square of its length."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(text, i, k)))))


def dependency_edges(files: DataFrame) -> DataFrame:
    """(repository, src, dst): a module imported by src names dst's stem, or stands in it behind a dot.

    An equi-join on names; what may stand behind a dot are the beginnings of what follows it.
    """
    rows = _imports(files)
    sources = rows.select("repository", F.col("path").alias("src"), F.explode(F.array_distinct("modules")).alias("name"))
    name = F.lower(stem(F.col("path")))
    dotted = F.transform(F.filter(substrings(name), lambda x: x.startswith(".") & (F.length(x) > 1)), lambda x: F.substring(x, 2, 1 << 30))
    targets = rows.select("repository", F.col("path").alias("dst"), F.explode(F.array_distinct(F.concat(F.array(name), F.when(name.contains("."), dotted).otherwise(F.array().cast("array<string>"))))).alias("name"))
    return sources.withColumn("name", F.lower("name")).join(targets, ["repository", "name"]).filter("src <> dst").select("repository", "src", "dst").distinct()


def component_interactions(files: DataFrame) -> DataFrame:
    """(repository, from_component, to_component, strength): a module is a part of another component's stem.

    Components are stems; of files with one stem the last path counts. The substrings of
    the stems are joined with the modules, so that it stays an equi-join. Strength is strong
    for more than 3 imports and sizes within a factor of two, medium for more than one import.
    """
    newest = Window.partitionBy("repository", "component").orderBy(F.desc("path"))
    rows = _imports(files).withColumn("component", F.lower(stem(F.col("path")))).withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
    size, imports = F.greatest(F.coalesce("lines", F.lit(1)), F.lit(1)), F.size("modules")
    a = rows.select("repository", F.col("component").alias("from_component"), size.alias("size_a"), imports.alias("imports"), F.explode(F.array_distinct("modules")).alias("word")).withColumn("word", F.lower("word"))
    b = rows.select("repository", F.col("component").alias("to_component"), size.alias("size_b"), F.explode(substrings(F.col("component"))).alias("word"))
    pairs = a.join(b, ["repository", "word"]).filter("from_component <> to_component")
    alike = F.least("size_a", "size_b") / F.greatest("size_a", "size_b") > 0.5
    strength = F.when((F.col("imports") > 3) & alike, "strong").when(F.col("imports") > 1, "medium").otherwise("weak")
    return pairs.select("repository", "from_component", "to_component", strength.alias("strength")).distinct()


def importers(edges: DataFrame, most: int = 5) -> DataFrame:
    """(repository, path, importers): basenames of the files that depend on a path, the first ``most`` by name."""
    rank = Window.partitionBy("repository", "dst").orderBy(basename(F.col("src")), "src")
    rows = edges.filter("dst IS NOT NULL AND src IS NOT NULL").select("repository", "src", "dst").distinct().withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= most)
    named = rows.groupBy("repository", "dst").agg(F.sort_array(F.collect_list(F.struct("n", basename(F.col("src")).alias("name")))).alias("names"))
    return named.select("repository", F.col("dst").alias("path"), F.array_join("names.name", ", ").alias("importers"))


def similar_files(files: DataFrame, most: int = 4) -> DataFrame:
    """(file_id, similar_id, common_imports, common_functions), the first ``most`` by id.

    Similar is a file of the repository that shares more than 30 percent of the file's
    import lines or more than 20 percent of its function names. Files with one set are a
    class; of each class and of each item no more than the first ids are kept, as no file
    can need more of them. A file that needs one common item takes the first ids of its
    items. One that needs t of n is tried against the classes that hold one of its n - t + 1
    rarest items, and the sets are then compared.
    """
    from ..sources.tables import written

    rows = latest(files, "repository", *(F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))))).alias(k) for c, k in (("imports", "i"), ("functions", "f"))))
    kinds = F.filter(F.array(F.struct(F.lit("i").alias("kind"), F.col("i").alias("items")), F.struct(F.lit("f").alias("kind"), F.col("f").alias("items"))), lambda x: F.size(x["items"]) > 0)
    sets = rows.filter("repository IS NOT NULL").select("file_id", "repository", F.explode(kinds).alias("k")).select("file_id", "repository", "k.kind", "k.items")
    first = lambda df, *by: df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("file_id"))).filter(F.col("_k") <= most + 1).drop("_k")
    n = F.size("items")
    need = F.when(F.col("kind") == "i", F.floor(n * 3 / 10)).otherwise(F.floor(n / 5)).cast("int") + 1
    sets = written(sets.withColumn("class", F.xxhash64("repository", "kind", "items")).withColumn("need", need))
    leading = first(sets.select("class", "file_id"), "class")
    classes = sets.select("class", "repository", "kind", "items", "need").distinct()
    key = ["repository", "kind", "item"]
    items = classes.select("class", "repository", "kind", "need", "items", F.explode("items").alias("item"))
    by_item = first(sets.select("repository", "kind", "file_id", F.explode("items").alias("item")), *key).drop("_k")
    single = items.filter("need = 1").select("class", *key).join(by_item, key).select("class", F.col("file_id").alias("similar_id"))
    frequency = items.groupBy(*key).agg(F.count("*").alias("uses"))
    ranked = items.filter("need > 1").join(frequency, key).groupBy("class").agg(F.first("need").alias("need"), F.first("items").alias("items"), F.array_sort(F.collect_list(F.struct("uses", *key))).alias("all"))
    rarest = ranked.select("class", "need", "items", F.explode(F.slice("all", F.lit(1), F.size("all") - F.col("need") + 1)).alias("x")).select("class", "need", "items", *(F.col(f"x.{c}").alias(c) for c in key))
    other = items.select(F.col("class").alias("other"), F.col("items").alias("others"), *key)
    alike = rarest.join(other, key).filter(F.size(F.array_intersect("items", "others")) >= F.col("need")).select("class", "other").distinct()
    several = alike.join(leading.select(F.col("class").alias("other"), F.col("file_id").alias("similar_id")), "other").select("class", "similar_id")
    found = single.unionByName(several).distinct().withColumnRenamed("similar_id", "file_id")
    kept = first(found, "class").select("class", F.col("file_id").alias("similar_id"))
    pairs = sets.select("file_id", "class").join(kept, "class").filter("file_id <> similar_id").select("file_id", "similar_id").distinct()
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("similar_id"))
    hits = pairs.withColumn("n", rank).filter(F.col("n") <= most).drop("n")
    own, theirs = rows.select("file_id", "i", "f"), rows.select(F.col("file_id").alias("similar_id"), F.col("i").alias("i2"), F.col("f").alias("f2"))
    common = lambda a, b: F.size(F.array_intersect(a, b)).cast("long")
    return hits.join(own, "file_id").join(theirs, "similar_id").select("file_id", "similar_id", common("i", "i2").alias("common_imports"), common("f", "f2").alias("common_functions"))


def import_frequency(files: DataFrame, most: int = 5) -> DataFrame:
    """(repository, import_line, files, rank) of the import lines used by most files."""
    lines = latest(files, "repository", "imports").select("repository", F.explode("imports").alias("import_line"))
    counts = lines.groupBy("repository", "import_line").agg(F.count("*").alias("files"))
    rank = F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("files"), "import_line"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most)


def dependency_kinds(files: DataFrame) -> DataFrame:
    """(file_id, internal, external): the first three import lines with a dot or slash, and the first three others."""
    inner = lambda x: x.rlike(r"[./]")
    take = lambda keep: F.concat_ws(", ", F.slice(F.filter("imports", keep), 1, 3))
    rows = files.filter(F.size("imports") > 0)
    return latest(rows, take(inner).alias("internal"), take(lambda x: ~inner(x)).alias("external"))


def coupling(files: DataFrame) -> DataFrame:
    """(repository, files, imports, functions, coupling, organisation): levels by imports and functions a file."""
    count = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    rows = latest(files, "repository", F.greatest(count("imports"), F.lit(0)).alias("i"), F.greatest(count("functions"), F.lit(0)).alias("f"))
    sums = rows.groupBy("repository").agg(F.count("*").alias("files"), F.sum("i").alias("imports"), F.sum("f").alias("functions"))
    level = lambda c, low, high, names: F.when(F.col(c) > high * F.col("files"), names[2]).when(F.col(c) > low * F.col("files"), names[1]).otherwise(names[0])
    return sums.select("*", level("imports", 2, 5, ("low", "moderate", "high")).alias("coupling"), level("functions", 5, 10, ("simple", "moderate", "complex")).alias("organisation"))
