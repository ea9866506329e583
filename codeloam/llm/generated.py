"""Problem 1: generated, minified or vendored source files, and data saved as code."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_records, map_rows, written
from .segments import blanked, comment_blocks, comment_text, segments

#: Notices by which tools mark what they wrote, in the languages of the corpus.
_TOOL = re.compile(
    r"(?is)code generated\b.{0,200}\bdo not edit|<auto-?generated|(?<!\w)@generated\b|^\W*(?:[\w.\-]+ \d+\s+)?[\w.\-]+: auto-?gen(?:erated)?\b|\bauto-?generated (?:file|code|from|by)\b"
    r"|\b(?:file|code|source|class|module|stubs?|bindings?)\b.{0,60}\b(?:was|is|has been|were|are)\s+(?:automatically\s+|auto-?)?(?:generated|written|created|produced)\s+(?:automatically\s+)?(?:by|from|with)\b.{0,160}\b(?:overwritten|lost|do not|don't|instead)"
    r"|\b(?:generated|produced|created|built|derived)\s+(?:automatically\s+)?(?:by|from|with)\b.{0,160}\b(?:by hand|manual(?:ly)?|do not (?:edit|modify|change)|overwritten|regenerate|run the command again)"
    r"|\bdo not (?:edit|modify|change)\b.{0,160}\b(?:generated|overwritten|regenerate)"
    r"|\bautomatisch\s+(?:erzeugt|erstellt|generiert)\b|\b(?:produit|généré|créé|écrit)\s+automatiquement\b|\bautomáticamente\b.{0,60}\b(?:no\s+(?:lo|la)|sobrescri)|\b(?:creado|generado|escrito|producido)\s+(?:de forma automática|automáticamente)|\b(?:criado|gerado|escrito|produzido)\s+(?:de forma automática|automaticamente)"
)
#: Notices of copies of outside libraries, at the head of a file.
_OUTSIDE = re.compile(
    r"(?is)\bvendored (?:from|copy|in)\b|\bunmodified copy of\b|\bcop(?:y|ied) (?:of|from)\b.{0,60}\bversion\s+v?\d|(?<!\w)@license\s+[\w.@/\-]+\s+v?\d|\bupstream:\s*\S+@v?\d|\bbundled\b.{0,80}\bv?\d+\.\d"
    r"|\bkopie\b.{0,40}\bbibliothek\b|\bcopie\b.{0,40}\b(?:bibliothèque|librairie)\b.{0,40}\d|\bcopia\b.{0,40}\b(?:biblioteca|librería)\b.{0,40}\d"
    r"|^\W*[\w.\-]+\s+v?\d+\.\d+(?:\.\d+)?\b.{0,120}(?:https?://|copyright|\(c\)|licen[sc]e)"
)
#: Lines that belong to the head of a file, however long it is.
_IMPORT = re.compile(r"(?:import\b|from\b|package\b|#\s*(?:include|pragma|ifndef|define)\b|using\b|use\b|(?:const|let|var)\b.*\brequire\b|[\s\"'`()\[\]{},;]*$)")
#: Parts above which a file is judged by the composition of its tokens.
LITERAL, REPEATED, DENSE = 0.85, 0.7, 90
_NUMBER = re.compile(r"(?<!\w)-?(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][+-]?\d+)?)[fFlLuU]*[\s,\]})]*")
_TOKEN = re.compile(r"[\w$]+")
#: Lines in one shape window, and how often a window must recur.
WINDOW, RECURS = 6, 3


def composition(text: str, extension: str) -> str | None:
    """generated, minified or data, by notices in comments and the make-up of the tokens; else None."""
    found = segments(text, extension)
    blocks = comment_blocks(text, found)
    notes = [" ".join(comment_text("\n".join(text[s:e] for s, e in block)).split()) for block in blocks]
    if any(_TOOL.search(n) for n in notes):
        return "generated"
    if any(_OUTSIDE.search(n) and _in_head(text, found, b[0][0]) for n, b in zip(notes, blocks)):
        return "vendored"
    if len(text) < 200:
        return None
    blank = blanked(text, found)
    comments = sum(e - s for kind, s, e in found if kind == "c")
    strings = sum(e - s for kind, s, e in found if kind != "c")
    numbers = sum(len(m) for m in _NUMBER.findall(blank))
    if (strings + numbers) >= LITERAL * max(1, len(text) - comments):
        return "data"
    valued = _valued(text, found)
    lines = [line.strip() for line in valued.split("\n")]
    lines = [line for line in lines if line]
    dense = sum(map(len, lines))
    if dense >= DENSE * max(1, len(lines)) and sum(line.count(" ") for line in lines) < 0.1 * dense:
        return "minified"
    if len(lines) < 8:
        return None
    # A literal counts as a value, like a name or a number.
    shapes = [line.strip() for line in _TOKEN.sub("v", valued).split("\n")]
    shapes = [line for line in shapes if line]
    windows = Counter(tuple(shapes[k : k + WINDOW]) for k in range(len(shapes) - WINDOW + 1))
    total = sum(windows.values())
    return "generated" if total >= 4 and sum(n for n in windows.values() if n >= RECURS) >= REPEATED * total else None


def _in_head(text: str, found: list[tuple[str, int, int]], at: int) -> bool:
    """Nothing but comments, literals and imports stands before ``at``."""
    before = blanked(text[:at], [x for x in found if x[2] <= at])
    return all(_IMPORT.match(line.strip()) for line in before.split("\n"))


def _valued(text: str, found: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, s, e in found:
        out.append(text[at:s])
        out.append("v" if kind != "c" else "")
        at = e
    out.append(text[at:])
    return "".join(out)


def line_index(files: DataFrame, shortest: int = 25) -> DataFrame:
    """(row, file_id, repository hash, n, pos, h): the distinct telling lines of each file, n in all, as hashes in their order."""
    bare = F.transform(F.split("full_content", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.array_distinct(F.filter(bare, lambda x: (F.length(x) >= shortest) & x.rlike("[A-Za-z]{3}.*[A-Za-z]{3}")))
    rows = code_records(files).select(F.monotonically_increasing_id().alias("row"), "file_id", F.xxhash64("repository").alias("repo"), F.transform(kept, lambda x: F.xxhash64(x)).alias("lines"))
    return rows.select("row", "file_id", "repo", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "h"))


def cross_repository(files: DataFrame, containment: float = 0.8, least: int = 8) -> DataFrame:
    """(file_id) of the files of which ``containment`` of all telling lines stand in other repositories.

    An inverted index of line hashes keeps those of two repositories or more. A line may be
    a common turn, so it counts only where another repository has it, too, together with two
    of the three indexed lines before or after it, in their order. Equal and edited copies are
    thus found however many there are, and nothing depends on how often a line occurs. Lines
    and triples are combined by map tasks before they are shuffled, and each is joined with
    one row a key.
    """
    lines = line_index(files)
    repositories = (F.min("repo").alias("low"), F.max("repo").alias("high"))
    index = lines.groupBy("h").agg(*repositories).filter("low < high").select("h")
    held = written(lines.join(index, "h").groupBy("row", "file_id", "repo", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("held")))
    key = lambda a, b: f"struct(xxhash64(get(s, 0).h, get(s, {a}).h, get(s, {b}).h) AS triple, array(get(s, 0).pos, get(s, {a}).pos, get(s, {b}).pos) AS at)"
    near = F.expr(f"flatten(transform(transform(held, (x, i) -> slice(held, i + 1, 4)), s -> CASE size(s) WHEN 4 THEN array({key(1, 2)}, {key(1, 3)}, {key(2, 3)}) WHEN 3 THEN array({key(1, 2)}) ELSE slice(array({key(1, 2)}), 1, 0) END))")
    kept = held.filter((F.col("n") >= least) & (F.size("held") >= containment * F.col("n")))
    triples = held.select("repo", F.explode(near).alias("z")).groupBy("z.triple").agg(*repositories).filter("low < high").select("triple")
    backed = kept.select("row", "file_id", "n", F.inline(near)).join(triples, "triple").select("row", "file_id", "n", F.explode("at").alias("pos"))
    return backed.groupBy("row", "file_id", "n").agg(F.count_distinct("pos").alias("backed")).filter(F.col("backed") >= containment * F.col("n")).select("file_id").distinct()


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, kind) of the code records nobody wrote by hand here, each once.

    ``kind`` is generated, minified, vendored or data. Notices count in comments only;
    paths do not count. NULL and empty texts are no cases; repeated rows count once; other
    columns are ignored.
    """
    rows = code_records(files).filter("file_id IS NOT NULL").select("file_id", "extension", "full_content")

    def judge(file_id, extension, text):
        kind = composition(text, extension)
        return [(file_id, kind)] if kind else []

    judged = map_rows(rows, judge, "file_id long, kind string")
    copies = cross_repository(files.filter("file_id IS NOT NULL")).withColumn("kind", F.lit("vendored"))
    return judged.unionByName(copies).groupBy("file_id").agg(F.min("kind").alias("kind"))
