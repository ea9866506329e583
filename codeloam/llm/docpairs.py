"""Problem 4: functions paired with their documentation."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_records, map_rows
from .segments import blanked, comment_text, segments, string_text

_MODIFIERS = r"(?:(?:public|private|protected|static|final|abstract|native|synchronized|strictfp|default|transient)[ \t]+)*"
_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|with|return|function|new|else|do|throw|typeof|await|super|case|sizeof|synchronized|try|func|defer|go|select|range|import|require|assert|yield|delete|in|of|and|or|not)\b)"
_NOT_TYPES = r"(?!(?:return|new|else|throw|case|goto|package|import|await|yield|assert|typedef|go|defer|do|if|for|while|switch)\b)"
_JS_START = r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
#: Signatures up to the parenthesis of the parameters; the name is in group n.
SIGNATURES = {
    ".py": [re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>[^\W\d]\w*)[ \t]*(?:\[[^\]\n]*\])?[ \t]*\(", re.M)],
    ".js": [
        re.compile(_JS_START + r"(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<n>[\w$]+)[ \t]*(?:<[^()\n]*>)?[ \t]*\(", re.M),
        re.compile(_JS_START + r"const[ \t]+(?P<n>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async\b[ \t]*)?(?P<f>function\b[ \t]*\*?[ \t]*[\w$]*[ \t]*)?(?:<[^()\n]*>)?[ \t]*\(", re.M),
        re.compile(_JS_START + r"const[ \t]+(?P<n>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]+)?[\w$]+[ \t]*=>", re.M),
        re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set|abstract)[ \t]+)*\*?[ \t]*{_NOT_NAMES}(?P<n>\#?[A-Za-z_$][\w$]*)[ \t]*\??(?:<[^()\n]*>)?[ \t]*\(", re.M),
    ],
    ".java": [re.compile(rf"^[ \t]*(?:@\w[\w.]*(?:\([^()\n]*\))?[ \t]+)*{_MODIFIERS}(?:<[^()\n{{}};]*>[ \t]*)?{_NOT_TYPES}(?!(?:public|private|protected|static|final|abstract)\b)[A-Za-z_][\w.]*(?:<[^()\n{{}};]*>)?(?:[ \t]*\[[ \t]*\])*[ \t]+{_NOT_NAMES}(?P<n>[A-Za-z_$][\w$]*)[ \t]*\(", re.M)],
    ".go": [re.compile(r"^func[ \t]+(?:\([^()\n]*\)[ \t]*)?(?P<n>[^\W\d]\w*)[ \t]*(?:\[[^\]\n]*\])?[ \t]*\(", re.M)],
    ".c": [re.compile(rf"^(?:{_NOT_TYPES}[A-Za-z_]\w*(?:[ \t]*\*+[ \t]*|[ \t]+|[ \t]*\n(?=[A-Za-z_]\w*[ \t]*\()))+{_NOT_NAMES}(?P<n>[A-Za-z_]\w*)[ \t]*\(", re.M)],
}
SIGNATURES[".ts"] = SIGNATURES[".js"]
_BRACKET = re.compile(r"[()\[\]{}]")
#: What may stand between the parameters and the body.
_BODY = {
    ".js": re.compile(r"[ \t]*(?::[ \t]*[^={};\n]+)?\s*\{"),
    ".arrow": re.compile(r"[ \t]*(?::[ \t]*[^={};\n]+)?[ \t]*=>\s*(\{)?"),
    ".java": re.compile(r"(?:[ \t]*\[\])*\s*(?:throws\s+[\w.,\s<>]+)?\{"),
    ".go": re.compile(r"[ \t]*[^\n{}]*(?:(?:interface|struct)[ \t]*\{[^\n{}]*\}[^\n{}]*)*\{"),
    ".c": re.compile(r"\s*(?:__attribute__\s*\(\([^\n]*\)\))?\s*\{"),
}
_BODY[".ts"] = re.compile(r"[ \t]*(?::[ \t]*(?:[^={};\n]|\{[^{}\n]*\}|=>)+)?\s*\{")
_ARROW_BODY = re.compile(r"\s*(\{)?")
_COLON = re.compile(r"\s*(?:->[ \t]*[^:\n]*)?[ \t]*:")
_SPACE = re.compile(r"\s*(?:\\\r?\n\s*)*")
_TAG_LINE = re.compile(r"^[ \t]*(?:@|:).*$", re.M)
_TODO = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD|NOTE TO SELF)\b(?:\([^)\n]*\))?:?", re.I)
_WORD = re.compile(r"[^\W_]+")


def description(raw: str, extension: str) -> str:
    """Documentation without comment marks, tag lines and to-do marks."""
    text = string_text(raw) if extension == ".py" else comment_text(raw)
    return re.sub(r"[ \t]*\n[ \t\n]*", "\n", _TODO.sub("", _TAG_LINE.sub("", text))).strip()


def brackets(blank: str) -> dict[int, int]:
    """Start of each bracket -> its end, by one stack; brackets without a partner are left out."""
    stack: list[int] = []
    out: dict[int, int] = {}
    for m in _BRACKET.finditer(blank):
        if m[0] in "([{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out


def indented_blocks(blank: str, found: list[tuple[str, int, int]], closed: dict[int, int], lines: list[int]) -> dict[int, int]:
    """Start of each line -> the start of the next line that is not deeper, by one stack.

    Lines that are blank, hold a comment alone, or begin inside a bracket or literal, count as none.
    """
    out: dict[int, int] = {}
    stack: list[tuple[int, int]] = []
    inner = sorted([*closed.items(), *((s, e) for _, s, e in found)])
    k = reached = 0
    for n, s in enumerate(lines):
        while k < len(inner) and inner[k][0] < s:
            reached = max(reached, inner[k][1])
            k += 1
        stop = lines[n + 1] if n + 1 < len(lines) else len(blank)
        bare = blank[s:stop].lstrip(" \t\f")
        if s < reached or not bare.strip():
            continue
        depth = stop - s - len(bare)
        while stack and stack[-1][0] >= depth:
            out[stack.pop()[1]] = s
        stack.append((depth, s))
    return out | {s: len(blank) for _, s in stack}


def functions(text: str, extension: str) -> Iterator[tuple[int, str, int, int, str]]:
    """(line of the name, name, start, end, raw documentation) of each documented function."""
    found = segments(text, extension)
    blank = blanked(text, found)
    starts = [s for _, s, _ in found]
    lines = [0, *(m.end() for m in re.finditer(r"\n", text))]
    closed = brackets(blank)
    blocks = indented_blocks(blank, found, closed, lines) if extension == ".py" else {}
    seen: dict[int, tuple[int, re.Match]] = {}
    for number, pattern in enumerate(SIGNATURES[extension]):
        for m in pattern.finditer(blank):
            seen.setdefault(m.start("n"), (number, m))
    begins = sorted(m.start() for _, m in seen.values())
    for name, (number, m) in seen.items():
        if extension == ".py":
            hit = _python(text, m, found, starts, lines, closed, blocks)
        else:
            hit = _braced(text, blank, m, extension, number, found, starts, lines, closed, begins)
        if hit:
            yield bisect_right(lines, name), m["n"], *hit


def _python(text, m, found, starts, lines, closed, blocks):
    end = closed.get(m.end() - 1, -1)
    colon = _COLON.match(m.string, end) if end >= 0 else None
    if not colon:
        return None
    at = colon.end()
    k = bisect_right(starts, at - 1)
    while True:  # comments may stand before the docstring
        at = _SPACE.match(text, at).end()
        while k < len(found) and found[k][1] < at:
            k += 1
        if k < len(found) and found[k][1] == at and found[k][0] == "c":
            at = found[k][2]
            k += 1
            continue
        break
    if k >= len(found) or found[k][1] != at or found[k][0] != "s":
        return None
    raw = text[at : found[k][2]]
    if re.match(r"[rRuU]?[bBfF]", raw):
        return None
    column = len(m[0]) - len(m[0].lstrip())
    if "\n" in text[colon.end() : at] and at - lines[bisect_right(lines, at) - 1] <= column:
        return None
    return m.start(), blocks.get(m.start(), len(text)), raw


def _braced(text, blank, m, extension, number, found, starts, lines, closed, begins):
    script = extension in (".js", ".ts")
    arrow = script and number in (1, 2)
    end = m.end() if script and number == 2 else closed.get(m.end() - 1, -1)
    if end < 0:
        return None
    if script and number == 2:
        body = _ARROW_BODY.match(blank, end)
    elif arrow and not m["f"]:
        body = _BODY[".arrow"].match(blank, end)
    else:
        body = _BODY[extension].match(blank, end)
    if not body:
        return None
    if body[0].endswith("{"):
        stop = closed.get(body.end() - 1)
        if stop is None:  # never closed
            following = bisect_right(begins, m.start("n"))
            stop = begins[following] if following < len(begins) else len(text)
    else:  # an arrow with an expression
        stop = blank.find("\n", body.end())
        stop = len(text) if stop < 0 else stop
    raw = _comment_above(text, blank, bisect_right(lines, m.start() + len(m[0]) - len(m[0].lstrip())) - 1, found, starts, lines)
    return (m.start(), stop, raw) if raw is not None else None


def _comment_above(text, blank, line, found, starts, lines):
    """The comment that ends on the line directly above ``line``, annotations skipped."""
    above = line - 1
    while above >= 0 and blank[lines[above] : lines[above + 1]].lstrip().startswith("@"):
        above -= 1
    if above < 0:
        return None
    end = lines[above + 1] - 1
    stop = len(text[lines[above] : end].rstrip()) + lines[above]
    k = bisect_right(starts, stop) - 1
    if k < 0 or found[k][0] != "c" or found[k][2] < stop or not text[lines[above] : end].strip():
        return None
    start = found[k][1]
    own = lines[bisect_right(lines, start) - 1]
    if blank[own:start].strip():
        return None  # it stands behind code
    if text[start : start + 2] == "//":
        while k and found[k - 1][0] == "c" and text[found[k - 1][1] : found[k - 1][1] + 2] == "//":
            s, e = found[k - 1][1:]
            before = lines[bisect_right(lines, s) - 1]
            if text[e:start].strip() or text.count("\n", e, start) != 1 or blank[before:s].strip():
                break
            k -= 1
            start = s
    return text[start:stop]


def documented(text: str, extension: str, least: int = 5) -> Iterator[tuple[int, str, str, str]]:
    """(def_line, name, code, description) of the functions with non-trivial documentation."""
    for line, name, start, end, raw in functions(text, extension):
        told = description(raw, extension)
        if len(_WORD.findall(told)) >= least:
            yield line, name, text[start:end].strip("\r\n"), told


def doc_pairs(files: DataFrame, least: int = 5) -> DataFrame:
    """(file_id, def_line, name, code, description), one row a function with documentation of ``least`` words.

    The body is delimited by one stack, of indentation or of brackets; a body that is
    never closed ends before the next signature, or with the file. NULL and empty texts give nothing, a file_id delivered twice
    gives its functions once, other columns are ignored.
    """
    rows = code_records(files).select("file_id", "extension", "full_content").filter("file_id IS NOT NULL")
    found = map_rows(rows, lambda i, e, t: ((i, *x) for x in documented(t, e, least)), "file_id long, def_line int, name string, code string, description string")
    return found.groupBy("file_id", "def_line").agg(*(F.min(c).alias(c) for c in ("name", "code", "description")))


def doc_lines(files: DataFrame, least: int = 5) -> DataFrame:
    """(file_id, def_line) of the pairs, each once."""
    rows = code_records(files).select("file_id", "extension", "full_content").filter("file_id IS NOT NULL")
    return map_rows(rows, lambda i, e, t: ((i, x[0]) for x in documented(t, e, least)), "file_id long, def_line int").distinct()
