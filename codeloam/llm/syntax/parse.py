"""Whether a source text is valid in one of the dialects of its extension."""

from __future__ import annotations

import re
from functools import cache

from . import grammars as g
from .gll import Grammar, Group, Interner
from .masks import BAD, CHAR, REGEX, STR, c_like_mask, python_mask, script_mask

_NUMBER = {
    ".py": r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|(?:[1-9](?:_?\d)*|0(?:_?0)*))(?!\w)",
    ".js": r"(?:0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)(?![\w$])",
    ".java": r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)(?!\w)",
    ".go": r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[oO][0-7_]+i?|0[bB][01_]+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)(?!\w)",
    ".c": r"(?:0[xX][0-9a-fA-F']+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?[uUlLfF]*|0[bB][01]+[uUlL]*|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[uUlLfFjJi]*)(?!\w)",
}
_NUMBER[".ts"] = _NUMBER[".js"]
_PUNCTUATION = {
    ".py": ["...", "**=", "//=", ">>=", "<<=", "!=", "->", ":=", "==", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "@=", "&=", "|=", "^=", "**", "//", "<<", ">>"],
    ".js": ["...", "===", "!==", "**=", "<<=", "&&=", "||=", "??=", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**", "<<"],
    ".java": ["...", "<<=", "->", "::", "==", "!=", "<=", ">=", "&&", "||", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<"],
    ".go": ["...", "<<=", ">>=", "&^=", ":=", "<-", "==", "!=", "<=", ">=", "&&", "||", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "&^", "<<", ">>"],
    ".c": ["...", "<<=", ">>=", "->", "==", "!=", "<=", ">=", "&&", "||", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>"],
}
_PUNCTUATION[".ts"] = _PUNCTUATION[".js"]
_SINGLES = {".py": "()[]{}:;,.=<>+-*/%|&^~@", ".js": "()[]{}:;,.=<>+-*/%|&^~!?#", ".ts": "()[]{}:;,.=<>+-*/%|&^~!?#@", ".java": "()[]{}:;,.=<>+-*/%|&^~!?@", ".go": "()[]{}:;,.=<>+-*/%|&^~!", ".c": "()[]{}:;,.=<>+-*/%|&^~!?"}
_PAIR = {")": "(", "]": "[", "}": "{"}
#: Groups and lines kept for each language in a worker, about a kilobyte each.
ROOM = 60_000
#: Kinds that go on with a statement although a brace or line has ended.
_GOES_ON = {"else", "catch", "finally", "while", ".", "?.", "(", "[", ",", ";", ")", "=", "=>", "?", ":", "STR", "&&", "||", "??", "+", "-", "*", "/", "as", "implements", "of", "in", "instanceof", "==", "===", "!=", "!==", "<", ">", "|", "&", "->", "::"}


def _cut_script(kinds: list[str], breaks: tuple) -> list[int]:
    out = []
    for i in range(1, len(kinds)):
        last, k = kinds[i - 1], kinds[i]
        if last == ";" and k not in ("else", "while") or last == "{" and k not in _GOES_ON and (not breaks or breaks[i]) or breaks and breaks[i] and k not in _GOES_ON and k != "{" and last in ("n", "0", "STR", "(", "["):
            out.append(i)
    return out


def _cut_plain(kinds: list[str], breaks: tuple) -> list[int]:
    out = []
    for i in range(1, len(kinds)):
        last, k = kinds[i - 1], kinds[i]
        if last == ";" and k not in ("else", "while") or last == "{" and k not in _GOES_ON:
            out.append(i)
    return out


def _cut_go(kinds: list[str], breaks: tuple) -> list[int]:
    return [i for i in range(1, len(kinds)) if kinds[i - 1] == ";"]


def _cut_python(kinds: list[str], breaks: tuple) -> list[int]:
    on = {"elif", "else", "except", "finally", "»"}
    return [i for i in range(1, len(kinds)) if kinds[i - 1] in ("NL", "»") and kinds[i] not in on and kinds[i - 2 : i - 1] != ["NL"]]


#: Rules of lists by extension, for Grammar.
_LISTS = {
    ".py": {"list": ("element", True), "braces": ("pair", True), "paren": ("element", True), "args": ("arg", True)},
    ".js": {"elems": ("elem", True), "object": ("prop", True), "args": ("arg", True)},
    ".java": {"inits": ("init", True), "args": ("expr", False)},
    ".go": {"lit": ("elem", True), "args": ("arg", True)},
    ".c": {"values": ("elem", True), "args": ("arg", False)},
}
_LISTS[".ts"] = _LISTS[".js"]


class Language:
    def __init__(self, extension: str) -> None:
        self.extension = extension
        words, soft, text, self.roots, cut = {
            ".py": (g.PYTHON_WORDS, g.PYTHON_SOFT, g.PYTHON, ("stmts_",), _cut_python),
            ".js": (g.JS_WORDS, g.JS_SOFT, g.JAVASCRIPT, ("items_", "stmts_"), _cut_script),
            ".ts": (g.JS_WORDS, g.TS_SOFT, g.TYPESCRIPT, ("items_", "stmts_"), _cut_script),
            ".java": (g.JAVA_WORDS, g.JAVA_SOFT, g.JAVA, ("unit",), _cut_plain),
            ".go": (g.GO_WORDS, set(), g.GO, ("unit",), _cut_go),
            ".c": (g.C_WORDS, g.C_SOFT, g.C, ("externals_", "gnuitems_"), _cut_plain),
        }[extension]
        named = {"n"} | soft
        marks = {"STR", "CHR", "NUM"}
        classes = {"NAME": named, "WORD": named | words, "NEVER": set(), "NUM": {"NUM"}, "ANY": named | words | marks | set(_PUNCTUATION[extension]) | set(_SINGLES[extension]) - set("()[]{}")}
        self.grammar = Grammar(text, classes, cut, _LISTS[extension])
        self.breaks = extension in (".js", ".ts")
        self.words = words | soft
        kept = "|".join(sorted(self.words))
        start = "A-Za-z_$" if self.breaks else "A-Za-z_"
        #: Identifiers that are no words of the language; all of them become n.
        self.names = re.compile(rf"(?<![\w$])(?!(?:{kept})(?![\w$]))(?:[^\W\d]|\$)[\w$]*" if self.breaks else rf"\b(?!(?:{kept})\b)[^\W\d]\w*")
        self.numbers = re.compile(rf"(?<![\w$]){_NUMBER[extension]}")
        punctuation = "|".join(map(re.escape, _PUNCTUATION[extension]))
        self.tokens = re.compile(rf"[^\S\n]+|(?:[^\W\d]\w*)|#n|0(?!\w)|\"|'|\x02|{punctuation}|[{re.escape(_SINGLES[extension])}]|.", re.S)
        self.lines: dict[str, tuple | None] = {}
        self.interner = Interner(ROOM)

    def line(self, line: str) -> tuple | None:
        """(items, breaks, last kind) of a masked line; None if a token is unknown.

        Items are kinds, groups that open and close on the line, and unmatched brackets,
        which are written with a colon behind them.
        """
        items: list = []
        flags: list[bool] = []
        opened: list[tuple[str, list, list]] = []
        last, fresh = "", True
        for t in self.tokens.findall(line):
            if t[0].isspace():
                continue
            if t[0].isalpha() or t[0] == "_":
                if t != "n" and t not in self.words:
                    return None
                kind = t
            elif t == "0":
                kind = "NUM"
            elif t == STR:
                kind = "STR"
            elif t == CHAR:
                kind = "STR" if self.breaks else "CHR"
            elif t == REGEX:
                kind = "RE"
            elif t == "#n":
                kind = "PRIVATE"
            elif len(t) == 1 and t not in _SINGLES[self.extension]:
                return None
            else:
                kind = t
            last = kind
            if kind in "([{":
                opened.append((kind, items, flags, fresh))
                items, flags = [], []
            elif kind in ")]}":
                if opened:
                    bracket, outer, outer_flags, was = opened.pop()
                    if bracket != _PAIR[kind]:
                        return None
                    outer.append(self.interner.get(bracket, tuple(items), tuple(flags) if self.breaks else ()))
                    outer_flags.append(was)
                    items, flags = outer, outer_flags
                else:
                    items.append(kind + ":")
                    flags.append(fresh)
            else:
                items.append(kind)
                flags.append(fresh)
            fresh = False
        while opened:
            bracket, outer, outer_flags, was = opened.pop()
            outer.append(bracket + ":")
            outer_flags.append(was)
            outer.extend(items)
            outer_flags.extend(flags)
            items, flags = outer, outer_flags
        return tuple(items), tuple(flags), last

    def read(self, masked: str) -> Group | None:
        """The whole text as one group of kind ``file``; None if tokens or brackets are wrong."""
        if BAD in masked:
            return None
        text = self.numbers.sub("0", self.names.sub("n", masked))
        lines, known = text.split("\n"), self.lines
        python, go = self.extension == ".py", self.extension == ".go"
        breaks = self.breaks
        stack: list[tuple[str, list, list]] = []
        items: list = []
        flags: list = []
        indents = [0]
        open_brackets = 0
        for line in lines:
            bare = line.strip()
            if not bare:
                continue
            entry = known.get(bare, 0)
            if entry == 0:
                entry = known[bare] = self.line(bare)
            if entry is None:
                return None
            if python and not open_brackets:
                width = len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())
                if width > indents[-1]:
                    if items[-1:] != ["NL"]:
                        return None
                    indents.append(width)
                    stack.append(("»", items, flags))
                    items, flags = [], []
                else:
                    while width < indents[-1]:
                        indents.pop()
                        bracket, outer, outer_flags = stack.pop()
                        outer.append(self.interner.get("»", tuple(items)))
                        items, flags = outer, outer_flags
                    if width != indents[-1]:
                        return None
            for t, f in zip(entry[0], entry[1]):
                if type(t) is str and len(t) == 2 and t[1] == ":" and t != "::":
                    c = t[0]
                    if c in "([{":
                        stack.append((c, items, flags))
                        flags.append(f)
                        items, flags = [], []
                        open_brackets += 1
                    else:
                        if not stack or stack[-1][0] != _PAIR[c]:
                            return None
                        group = self.interner.get(_PAIR[c], tuple(items), tuple(flags) if breaks else ())
                        _, items, flags = stack.pop()
                        items.append(group)
                        open_brackets -= 1
                else:
                    items.append(t)
                    flags.append(f)
            if python and not open_brackets:
                items.append("NL")
            elif go and entry[2] in ("n", "NUM", "STR", "CHR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"):
                items.append(";")
        while python and len(indents) > 1 and stack and stack[-1][0] == "»":
            indents.pop()
            bracket, outer, outer_flags = stack.pop()
            outer.append(self.interner.get("»", tuple(items)))
            items, flags = outer, outer_flags
        if stack:
            return None
        if len(known) > ROOM:
            known.clear()
        return self.interner.get("file", tuple(items), tuple(flags) if breaks else ())

    def valid(self, text: str) -> bool:
        if self.interner.trim():
            self.lines.clear()
        text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\f", " ")
        fields: list[str] = []
        if self.extension == ".py":
            masked, fields = python_mask(text.replace("\r", "\n"))
        elif self.breaks:
            masked = script_mask(text)
        else:
            masked = c_like_mask(text, self.extension)
        whole = self.read(masked)
        if whole is None or not self.grammar.accepts(whole, self.roots, self.interner):
            return False
        return all(self._field(f) for f in fields)

    def _field(self, text: str) -> bool:
        entry = self.read("(" + text + "\n)")
        if entry is None or len(entry.tokens) != 2 or type(entry.tokens[0]) is str:
            return False
        return self.grammar.derives(entry.tokens[0], self.grammar.number["field"], self.interner)


@cache
def language(extension: str) -> Language:
    return Language(extension)


_JSON_TOKEN = re.compile(r'[ \t\r\n]+|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true|false|null|[{}\[\]:,]|.', re.S)
_json = Grammar(g.JSON, {}, None, {"members": ("member", False), "elements": ("value", False)})


def grouped(kinds: list[str], interner: Interner) -> Group | None:
    stack: list[tuple[str, list]] = []
    items: list = []
    for k in kinds:
        if k in ("{", "[", "("):
            stack.append((k, items))
            items = []
        elif k in ("}", "]", ")"):
            if not stack or stack[-1][0] != _PAIR[k]:
                return None
            group = interner.get(_PAIR[k], tuple(items))
            items = stack.pop()[1]
            items.append(group)
        else:
            items.append(k)
    return None if stack else interner.get("file", tuple(items))


def valid_json(text: str) -> bool:
    kinds = []
    for t in _JSON_TOKEN.findall(text.removeprefix("\ufeff")):
        c = t[0]
        if c in " \t\r\n":
            continue
        if c == '"' and len(t) > 1:
            kinds.append("STR")
        elif c.isdigit() or c == "-" and len(t) > 1:
            kinds.append("NUM")
        elif t in ("true", "false", "null") or c in "{}[]:,":
            kinds.append(t)
        else:
            return False
    interner = Interner()
    whole = grouped(kinds, interner)
    return whole is not None and _json.accepts(whole, ("text",), interner)


def is_valid(text: str, extension: str) -> bool:
    if extension == ".json":
        return valid_json(text)
    if extension in (".yaml", ".yml"):
        from .yaml import valid_yaml

        return valid_yaml(text)
    return language(extension).valid(text)
