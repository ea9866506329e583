"""Replaces strings, comments and literals of a source text by marks, for tokens that fit on a line."""

from __future__ import annotations

import re

#: Marks in a masked text. BAD makes the token after it unknown, so that the text is rejected.
STR, BAD, CHAR, REGEX = '"', "\x01", "'", "\x02"

_PY = re.compile(r"""\#[^\n]*|\\\r?\n|(?<!\w)([rRbBuUfF]{0,2})(\"{3}|'{3}|"|')""")
_PY_END = {
    '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S),
    "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S),
    '"': re.compile(r'(?:[^"\\\n]|\\(?:\r\n|.))*"', re.S),
    "'": re.compile(r"(?:[^'\\\n]|\\(?:\r\n|.))*'", re.S),
}
_C_LIKE = {
    ".c": re.compile(r"""//(?:[^\n\\]|\\.|\\\n)*|/\*|(?<!\w)(?:u8|[uUL])?"|(?<!\w)[uUL]?'|^[ \t]*\#(?:[^\n\\/]|\\(?:\r?\n|.)|/(?!\*)|/\*.*?\*/)*""", re.M | re.S),
    ".java": re.compile(r"""//[^\n]*|/\*|\"{3}|"|'"""),
    ".go": re.compile(r"""//[^\n]*|/\*|"|'|`"""),
}
_DOUBLE, _SINGLE = re.compile(r'(?:[^"\\\n]|\\(?:\r?\n|.))*"', re.S), re.compile(r"(?:[^'\\\n]|\\.)+'")
_TEXT_BLOCK = re.compile(r'[ \t\f]*\r?\n(?:[^"\\]|\\.|"(?!""))*"""', re.S)
_JS = re.compile(r"""//[^\n]*|/\*|"|'|`|(?:(?<=[(,=:\[!&|?{};+\-*%<>~^\n])|(?<![\w$.])(?:return|typeof|case|in|of|void|delete|throw|new|do|else)\b)[ \t]*/(?=[^/*\n])|^[ \t]*/(?=[^/*\n])|[{}]""", re.M)
_REGEX = re.compile(r"(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)


def python_mask(text: str) -> tuple[str, list[str]]:
    """The masked text and the masked expressions of its formatted strings."""
    fields: list[str] = []
    out, at = [], 0
    while m := _PY.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        quote = m[2]
        if quote is None:
            continue
        prefix = m[1].lower()
        if len(set(prefix)) < len(prefix) or "u" in prefix and len(prefix) > 1 or prefix in ("bf", "fb"):
            out.append(BAD)
        end = _PY_END[quote].match(text, at)
        if "f" in prefix and (end is None or "{" in end[0]):
            stop = _formatted(text, at, quote, "r" in prefix, fields)
        else:
            stop = end.end() if end else -1
        if stop < 0:
            out.append(BAD)
            break
        out.append(STR)
        at = stop
    else:
        out.append(text[at:])
    return "".join(out), fields


def _formatted(text: str, at: int, quote: str, raw: bool, fields: list[str], depth: int = 0) -> int:
    """The end of a formatted string whose content starts at ``at``, or -1; at depth > 0, of a format."""
    n = len(text)
    while at < n:
        c = text[at]
        if text.startswith(quote, at):
            return at + len(quote) if not depth else -1
        if c == "\\" and (not raw or text[at + 1 : at + 2] in "\\'\""):
            if text.startswith("\\N{", at) and not raw:
                at = text.find("}", at) + 1
                if not at:
                    return -1
            else:
                at += 2
        elif c == "{" and text.startswith("{{", at) and not depth:
            at += 2
        elif c == "}":
            if depth:
                return at
            if not text.startswith("}}", at):
                return -1
            at += 2
        elif c == "{":
            at = _field(text, at + 1, quote, raw, fields, depth)
            if at < 0:
                return -1
        elif c == "\n" and len(quote) == 1:
            return -1
        else:
            at += 1
    return -1


def _field(text: str, at: int, quote: str, raw: bool, fields: list[str], depth: int) -> int:
    opened: list[str] = []
    out: list[str] = []
    n = len(text)
    while at < n:
        c = text[at]
        if not opened and c in "}:!" and text[at : at + 2] != "!=":
            break
        if c in "([{":
            opened.append(c)
        elif c in ")]}":
            if not opened:
                return -1
            opened.pop()
        elif c in "'\"":
            mark = _PY.match(text, at)
            end = _PY_END[mark[2]].match(text, mark.end())
            if end is None or len(quote) == 1 and "\n" in end[0]:
                return -1
            at = end.end()
            out.append(STR)
            continue
        elif c == "\n" and len(quote) == 1:
            return -1
        out.append(c)
        at += 1
    fields.append("".join(out))
    if text[at : at + 1] == "!":
        if text[at + 1 : at + 2] not in ("r", "s", "a"):
            return -1
        at += 2
    if text[at : at + 1] == ":":
        at = _formatted(text, at + 1, quote, raw, fields, depth + 1)
        if at < 0:
            return -1
    return at + 1 if text[at : at + 1] == "}" else -1


def c_like_mask(text: str, extension: str) -> str:
    out, at = [], 0
    search = _C_LIKE[extension].search
    while m := search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        mark = m[0]
        if mark[:2] == "//":
            continue
        if mark == "/*":
            end = text.find("*/", at)
            if end < 0:
                out.append(BAD)
                return "".join(out)
            out.append("\n" if "\n" in text[at:end] else " ")
            at = end + 2
            continue
        if mark.lstrip()[:1] == "#":
            continue
        if mark == "`":
            end = text.find("`", at)
            stop = end + 1 if end >= 0 else -1
        else:
            pattern = _TEXT_BLOCK if mark == '"""' else _DOUBLE if mark[-1] == '"' else _SINGLE
            end = pattern.match(text, at)
            stop = end.end() if end else -1
        if stop < 0:
            out.append(BAD)
            return "".join(out)
        out.append(CHAR if mark[-1] == "'" else STR)
        at = stop
    out.append(text[at:])
    return "".join(out)


def script_mask(text: str) -> str:
    """JavaScript and TypeScript. A template with values becomes a string followed by calls."""
    out: list[str] = []
    at = 0
    if text.startswith("#!"):
        at = max(text.find("\n"), 0)
    braces: list[bool] = []  # whether the closing brace goes on with a template
    while m := _JS.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        mark = m[0]
        if mark == "{":
            braces.append(False)
            out.append(mark)
        elif mark == "}":
            if braces and braces.pop():
                out.append(")")
                at = _template(text, at, out, braces)
            else:
                out.append(mark)
        elif mark == "`":
            out.append(STR)
            at = _template(text, at, out, braces)
        elif mark[:2] == "//":
            pass
        elif mark == "/*":
            end = text.find("*/", at)
            if end < 0:
                at = -1
            else:
                out.append("\n" if "\n" in text[at:end] else " ")
                at = end + 2
        elif mark[-1] == "/":
            end = _REGEX.match(text, at)
            out.append(mark[:-1] + (REGEX if end else "/"))
            at = end.end() if end else at
        else:
            end = (_DOUBLE if mark == '"' else _SINGLE).match(text, at)
            if end is None and text.startswith("'", at):
                out.append(STR)
                at += 1
            elif end is None:
                at = -1
            else:
                out.append(STR)
                at = end.end()
        if at < 0:
            out.append(BAD)
            return "".join(out)
    out.append(text[at:])
    return "".join(out)


def _template(text: str, at: int, out: list[str], braces: list[bool]) -> int:
    end = _TEMPLATE.match(text, at)
    if end is None:
        return -1
    if end[1] == "${":
        out.append("(")
        braces.append(True)
    return end.end()
