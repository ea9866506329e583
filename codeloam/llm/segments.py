"""Comments and string literals of source texts, found leniently: broken files have them too."""

from __future__ import annotations

import re

_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\.)*"?', r"'(?:[^'\\\n]|\\.)*'?"
_TRIPLE = r'"""(?:[^"\\]|\\.|"(?!""))*(?:"""|\Z)|' + r"'''(?:[^'\\]|\\.|'(?!''))*(?:'''|\Z)"
_BLOCK, _LINE = r"/\*.*?(?:\*/|\Z)", r"//[^\n]*"
_CHAR = r"'(?:[^'\\\n]|\\.){1,8}'"
_REGEX = r"(?<=[(,=:\[!&|?{};])[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"


def _compiled(comment: str, string: str, other: str = "") -> re.Pattern:
    return re.compile(rf"(?P<c>{comment})|(?P<s>{string})" + (f"|(?P<o>{other})" if other else ""), re.S)


PATTERNS = {
    ".py": _compiled(r"\#[^\n]*", rf"(?<![A-Za-z0-9_])[rRbBuUfF]{{0,2}}(?:{_TRIPLE}|{_DOUBLE}|{_SINGLE})|{_TRIPLE}|{_DOUBLE}|{_SINGLE}"),
    ".js": _compiled(f"{_LINE}|{_BLOCK}", rf"{_DOUBLE}|{_SINGLE}|`(?:[^`\\]|\\.)*(?:`|\Z)", _REGEX),
    ".java": _compiled(f"{_LINE}|{_BLOCK}", rf'"""(?:[^"\\]|\\.|"(?!""))*(?:"""|\Z)|{_DOUBLE}', _CHAR),
    ".go": _compiled(f"{_LINE}|{_BLOCK}", rf"{_DOUBLE}|`[^`]*(?:`|\Z)", _CHAR),
    ".c": _compiled(f"{_LINE}|{_BLOCK}", _DOUBLE, _CHAR),
}
PATTERNS[".ts"] = PATTERNS[".js"]


def segments(text: str, extension: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order; kind is c for comments, s for strings, o for other literals."""
    return [(m.lastgroup, m.start(), m.end()) for m in PATTERNS[extension].finditer(text)]


_PRINTED = re.compile(r"[^\n]")


def blanked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with comments and literals blank; positions and lines stay."""
    out, at = [], 0
    for _, s, e in found:
        out.append(text[at:s])
        piece = text[s:e]
        out.append(" " * (e - s) if "\n" not in piece else _PRINTED.sub(" ", piece))
        at = e
    out.append(text[at:])
    return "".join(out)


def comment_blocks(text: str, found: list[tuple[str, int, int]]) -> list[list[tuple[int, int]]]:
    """Comments, where line comments on adjacent lines are one."""
    out: list[list[tuple[int, int]]] = []
    for kind, s, e in found:
        if kind != "c":
            continue
        lined = text[s] == "#" or text[s : s + 2] == "//"
        if lined and out and text[out[-1][-1][0]] == text[s] and text[out[-1][-1][0] : out[-1][-1][0] + 2] != "/*":
            gap = text[out[-1][-1][1] : s]
            if not gap.strip() and gap.count("\n") == 1:
                out[-1].append((s, e))
                continue
        out.append([(s, e)])
    return out


_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|//+[!]?|\#+!?|\*+(?!\w))?|[ \t]*\*+/[ \t]*$", re.M)


def comment_text(raw: str) -> str:
    """A comment without its marks, line by line."""
    return "\n".join(_MARKS.sub("", line).strip() for line in raw.split("\n"))


_PREFIX = re.compile(r"^[rRbBuUfF]{0,2}(\"{3}|'{3}|[\"'`])")


def string_text(raw: str) -> str:
    """A literal without prefix and quotes; escapes become spaces."""
    m = _PREFIX.match(raw)
    if not m:
        return raw
    body = raw[m.end() :]
    if body.endswith(m[1]):
        body = body[: -len(m[1])]
    return re.sub(r"\\[nrt]", " ", body)
