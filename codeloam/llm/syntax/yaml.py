"""YAML streams as tokens grouped by indentation, for the generalised LL recogniser."""

from __future__ import annotations

import re

from . import grammars as g
from .gll import Grammar, Group, Interner

_grammar = Grammar(g.YAML, {})
_DOUBLE, _SINGLE = re.compile(r'"(?:[^"\\]|\\.)*"', re.S), re.compile(r"'(?:[^']|'')*'", re.S)
_PROPERTY = re.compile(r"[&!][^\s,\[\]{}]*(?:[ \t]+|(?=\n)|$)")
_KEY = re.compile(r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\n]|'')*'|\*[^\s:]+ ?|(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`\n]|[\-?:](?=[^\s]))(?:[^:#\n]|:(?=[^\s])|(?<=[^\s])\#)*?)[ \t]*:(?=\s|$)")
_BLOCK = re.compile(r"[|>](?:[1-9][+-]?|[+-][1-9]?)?[ \t]*(?:#[^\n]*)?(?=\n|$)")
_COMMENT = re.compile(r"(?:^|(?<=[ \t]))\#[^\n]*")
_FLOW_PLAIN = re.compile(r"(?:[^\s,\[\]{}:#\"'&*!|>%@`]|:(?=[^\s,\[\]{}])|\*)(?:[^,\[\]{}:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)\#)*")


class _Invalid(Exception):
    pass


def _flow(text: str, at: int) -> tuple[list[str], int]:
    """Kinds of a flow collection that begins at ``at``, and its end."""
    kinds: list[str] = []
    depth = 0
    while at < len(text):
        c = text[at]
        if c in "[{":
            depth += 1
            kinds.append(c)
            at += 1
        elif c in "]}":
            depth -= 1
            kinds.append(c)
            at += 1
            if not depth:
                return kinds, at
        elif c in ",:":
            kinds.append(c)
            at += 1
        elif c in "\"'":
            m = (_DOUBLE if c == '"' else _SINGLE).match(text, at)
            if not m:
                raise _Invalid
            kinds.append("SC")
            at = m.end()
        elif c in " \t\r\n":
            at += 1
        elif c == "#":
            at = text.find("\n", at) + 1 or len(text)
        elif m := _PROPERTY.match(text, at):
            at = m.end()
        elif m := _FLOW_PLAIN.match(text, at):
            if text.startswith(("---", "..."), at) and (at == 0 or text[at - 1] == "\n"):
                raise _Invalid
            if kinds[-1:] != ["SC"]:  # a plain scalar may go on in the next line
                kinds.append("SC")
            at = m.end()
        else:
            raise _Invalid
    raise _Invalid


def _tokens(text: str) -> list[tuple[int, object]]:
    """(column, token) of the stream; a token is a kind or the kinds of a flow collection."""
    out: list[tuple[int, object]] = []
    at, n = 0, len(text)
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        line = text[at:end]
        bare = line.strip()
        if not bare or bare[0] == "#":
            at = end + 1
            continue
        if line[0] == "%" and not out:
            at = end + 1
            continue
        if re.match(r"(---|\.\.\.)(\s|$)", line):
            out.append((0, line[:3]))
            text = text[:at] + "   " + text[at + 3 :]
            if not text[at:end].strip():
                at = end + 1
            continue
        indent = len(line) - len(line.lstrip(" "))
        if line[indent] == "\t":
            raise _Invalid
        at += indent
        start = at - indent
        while m := re.compile(r"-(?:[ \t]+|(?=\n)|$)|\?[ \t]+").match(text, at):
            out.append((at - start, m[0][0]))
            at = m.end()
            if at < n and text[at] == "#":
                at = end
        if at >= n or text[at] == "\n":
            at = end + 1
            continue
        column = at - start
        while m := _PROPERTY.match(text, at):
            at = m.end()
        key = _KEY.match(text, at)
        if key:
            at = key.end()
            while at < n and text[at] in " \t":
                at += 1
            while m := _PROPERTY.match(text, at):
                at = m.end()
            if at >= n or text[at] == "\n" or text[at] == "#" and text[at - 1] in " \t":
                out.append((column, "KEY"))
                at = (text.find("\n", at) + 1) or n
                continue
            if re.match(r"-[ \t\n]", text[at : at + 2]):
                raise _Invalid
            out.append((column, "KV"))
        at = _value(text, at, column, indent, bool(key), out)
    return out


def _value(text: str, at: int, column: int, indent: int, keyed: bool, out: list) -> int:
    n = len(text)
    c = text[at : at + 1]
    if not c or c == "\n":
        return at + 1
    if m := _BLOCK.match(text, at):
        if not keyed:
            out.append((column, "SC"))
        parent = column if keyed else (out[-2][0] if len(out) > 1 and out[-2][1] in ("-", "?", ":") else -1)
        at = m.end() + 1
        least = None
        while at < n:
            end = text.find("\n", at)
            end = n if end < 0 else end
            line = text[at:end]
            if line.strip():
                deep = len(line) - len(line.lstrip(" "))
                if deep <= parent:
                    break
                if least is None:
                    least = deep
                if deep < least:
                    if line.lstrip()[0] != "#":
                        raise _Invalid
                    break
            at = end + 1
        return at
    if c in "[{":
        kinds, at = _flow(text, at)
        out.append((column, kinds))
        return _rest(text, at)
    if c in "\"'":
        m = (_DOUBLE if c == '"' else _SINGLE).match(text, at)
        if not m:
            raise _Invalid
        for line in m[0].split("\n")[1:]:
            if line.strip() and keyed and len(line) - len(line.lstrip(" ")) <= column:
                raise _Invalid
        if not keyed:
            out.append((column, "SC"))
        return _rest(text, m.end())
    end = text.find("\n", at)
    end = n if end < 0 else end
    plain = _COMMENT.sub("", text[at:end]).rstrip()
    if c in "@`%,]}" or c in "|>" or re.search(r":(?:\s|$)", plain):
        raise _Invalid
    if not keyed:
        out.append((column, "SC"))
    return end + 1


def _rest(text: str, at: int) -> int:
    end = text.find("\n", at)
    end = len(text) if end < 0 else end
    rest = text[at:end]
    if rest.strip() and not re.match(r"[ \t]+#", rest):
        raise _Invalid
    return end + 1


def _build(tokens: list[tuple[int, object]], interner: Interner) -> Group:
    stack: list[tuple[int, list]] = []
    column, items = 0, []
    first = True
    for col, token in tokens:
        if token in ("---", "..."):
            while stack:
                column, items = _close(stack, items, interner)
            items.append(token)
            first = True
            continue
        flow = _flow_group(token, interner) if isinstance(token, list) else None
        if flow and items[-1:] == ["KV"] and col == column:
            items.append(flow)
            continue
        if first:
            column, first = col, False
            if stack:
                raise _Invalid
        if col > column:
            stack.append((column, items))
            column, items = col, []
        while col < column:
            if not stack:
                raise _Invalid
            column, items = _close(stack, items, interner)
        if col != column:
            raise _Invalid
        items.append(flow or token)
    while stack:
        column, items = _close(stack, items, interner)
    return interner.get("file", tuple(items))


def _close(stack: list, items: list, interner: Interner) -> tuple[int, list]:
    column, outer = stack.pop()
    outer.append(interner.get("»", tuple(items)))
    return column, outer


def _flow_group(kinds: list[str], interner: Interner) -> Group:
    from .parse import grouped

    whole = grouped(kinds, interner)
    if whole is None:
        raise _Invalid
    return whole.tokens[0]


def valid_yaml(text: str) -> bool:
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", text):
        return False
    interner = Interner()
    try:
        tokens = _tokens(text)
        if not tokens:
            return True
        return _grammar.accepts(_build(tokens, interner), ("stream",), interner)
    except _Invalid:
        return False
