"""A generalised LL recogniser with a graph-structured stack, over bracketed token groups.

Grammars are written one rule a line: ``name = alternative | alternative``. A symbol is a
rule's name, a quoted terminal, a terminal class in capitals, a bracketed rule such as
``(expr)`` for a group whose content derives the rule, or EOS, which holds without reading
a token where a line or the group ends. ``?``, ``*`` and ``+`` may follow a symbol.
A rule whose name ends in ``s_`` is closed under concatenation.
"""

from __future__ import annotations

import re
import sys

sys.setrecursionlimit(100_000)

_T, _N, _G, _E, _END = range(5)
_OPEN = {"(": ")", "[": "]", "{": "}", "»": "«"}


class Group:
    """A bracketed run of tokens. Equal runs are one object, which keeps what they derive."""

    __slots__ = ("kind", "tokens", "breaks", "known")

    def __init__(self, kind: str, tokens: tuple, breaks: tuple) -> None:
        self.kind, self.tokens, self.breaks = kind, tokens, breaks
        self.known: dict[int, bool] = {}


class Interner:
    """Groups by content. Emptied when full, which costs time but changes no answer."""

    def __init__(self, room: int = 300_000) -> None:
        self.room, self.groups = room, {}

    def get(self, kind: str, tokens: tuple, breaks: tuple = ()) -> Group:
        key = (kind, tokens, breaks)
        group = self.groups.get(key)
        if group is None:
            group = self.groups[key] = Group(kind, tokens, breaks)
        return group

    def trim(self) -> bool:
        if len(self.groups) > self.room:
            self.groups.clear()
            return True
        return False


class Grammar:
    def __init__(self, text: str, classes: dict[str, set[str]], cut=None, lists: dict[str, tuple[str, bool]] | None = None) -> None:
        """``cut(kinds, breaks)`` proposes where a closed run may be split; None never splits.

        ``lists`` names rules that elements between commas derive, each with the rule of an
        element and whether a comma may stand behind the last.
        """
        self.cut = cut
        rules: dict[str, list[list[str]]] = {}
        for line in re.sub(r"\n[ \t]+", " ", text.strip()).split("\n"):
            if not line:
                continue
            name, _, body = line.partition(" = ")
            rules[name.strip()] = [alternative.split() for alternative in re.split(r"(?<!\S)\|(?!\S)", body)]
        for name in list(rules):
            rules[name] = [[self._plain(s, rules) for s in alternative if s != "ε"] for alternative in rules[name]]
        for name in [n for n in rules if n[-1] in "?*+"]:
            rules[name] = [[self._plain(s, rules) for s in alternative] for alternative in rules[name]]
        self.number = {name: k for k, name in enumerate(rules)}
        self.closed = {self.number[n] for n in rules if n.endswith("s_")}
        self.lists = {self.number[k]: (self.number[v], trailing) for k, (v, trailing) in (lists or {}).items()}
        op: list[int] = []
        arg: list = []
        starts: list[list[int]] = []
        for name, alternatives in rules.items():
            starts.append([])
            for alternative in alternatives:
                starts[-1].append(len(op))
                for s in alternative:
                    kind, value = self._symbol(s, classes)
                    op.append(kind)
                    arg.append(value)
                op.append(_END)
                arg.append(None)
        self.op, self.arg = op, arg
        self._select(starts)

    @staticmethod
    def _plain(symbol: str, rules: dict) -> str:
        if len(symbol) > 1 and symbol[-1] in "?*+" and symbol[0] != "'":
            base = symbol[:-1]
        elif len(symbol) > 3 and symbol[0] == "'" and symbol[-1] in "?*+" and symbol[-2] == "'":
            base = symbol[:-1]
        else:
            return symbol
        rules.setdefault(symbol, {"?": [["ε"], [base]], "*": [["ε"], [base, symbol]], "+": [[base], [base, symbol]]}[symbol[-1]])
        if rules[symbol][0] == ["ε"]:
            rules[symbol][0] = []
        return symbol

    def _symbol(self, symbol: str, classes: dict[str, set[str]]):
        if symbol in self.number:
            return _N, self.number[symbol]
        if symbol == "EOS":
            return _E, None
        if symbol in classes:
            return _T, frozenset(classes[symbol])
        if symbol[0] == "'" and symbol[-1] == "'" and len(symbol) > 2:
            return _T, frozenset((symbol[1:-1],))
        if symbol[0] in _OPEN and symbol[-1] == _OPEN[symbol[0]] and symbol[1:-1] in self.number:
            return _G, (symbol[0], self.number[symbol[1:-1]])
        raise ValueError(f"unknown symbol {symbol}")

    def _select(self, starts: list[list[int]]) -> None:
        """For each rule and next kind, the alternatives that could begin there."""
        op, arg, n = self.op, self.arg, len(starts)
        first: list[set] = [set() for _ in range(n)]
        follow: list[set] = [{"$"} for _ in range(n)]
        empty = [False] * n

        def begin(s: int) -> tuple[set, bool]:
            out: set = set()
            while True:
                if op[s] == _END:
                    return out, True
                if op[s] == _T:
                    return out | arg[s], False
                if op[s] == _G:
                    return out | {arg[s][0]}, False
                if op[s] == _N:
                    out |= first[arg[s]]
                    if not empty[arg[s]]:
                        return out, False
                s += 1

        changed = True
        while changed:
            changed = False
            for k in range(n):
                for s in starts[k]:
                    f, e = begin(s)
                    if not f <= first[k] or e and not empty[k]:
                        first[k] |= f
                        empty[k] |= e
                        changed = True
        changed = True
        while changed:
            changed = False
            for k in range(n):
                for s in starts[k]:
                    while op[s] != _END:
                        if op[s] == _N:
                            f, e = begin(s + 1)
                            f = f | follow[k] if e else f
                            if not f <= follow[arg[s]]:
                                follow[arg[s]] |= f
                                changed = True
                        s += 1
        self.select: list[dict[str, list[int]]] = []
        for k in range(n):
            table: dict[str, list[int]] = {}
            for s in starts[k]:
                f, e = begin(s)
                for kind in f | follow[k] if e else f:
                    table.setdefault(kind, []).append(s)
            self.select.append(table)

    def derives(self, group: Group, rule: int, interner: Interner) -> bool:
        answer = group.known.get(rule)
        if answer is None:
            answer = False
            if rule in self.closed and self.cut and len(group.tokens) > 8:
                answer = self._in_parts(group, rule, interner)
            elif rule in self.lists and len(group.tokens) > 8:
                answer = self._in_elements(group, rule, interner)
            answer = answer or self.recognise((rule,), group, interner)
            group.known[rule] = answer
        return answer

    def _in_parts(self, group: Group, rule: int, interner: Interner) -> bool:
        """True if the run splits into parts that derive a rule closed under concatenation."""
        kinds = [t if type(t) is str else t.kind for t in group.tokens]
        at = [0, *self.cut(kinds, group.breaks), len(kinds)]
        if len(at) < 3:
            return False
        parts = [interner.get("", group.tokens[a:b], group.breaks[a:b]) for a, b in zip(at, at[1:]) if a < b]
        return all(self.derives(p, rule, interner) for p in parts)

    def _in_elements(self, group: Group, rule: int, interner: Interner) -> bool:
        """True if each run between commas derives an element of a list rule."""
        element, trailing = self.lists[rule]
        tokens, breaks = group.tokens, group.breaks
        at = [-1, *(i for i, t in enumerate(tokens) if t == ","), len(tokens)]
        if trailing and at[-2] == len(tokens) - 1:
            at.pop()
        if len(at) < 4:
            return False
        parts = {interner.get("", tokens[a + 1 : b], breaks[a + 1 : b]) for a, b in zip(at, at[1:])}
        return all(p.tokens and self.derives(p, element, interner) for p in parts)

    def accepts(self, group: Group, rules: tuple[str, ...], interner: Interner) -> bool:
        """Whether any of the start rules, one for each dialect, derives the run."""
        numbers = tuple(self.number[r] for r in rules)
        known = [group.known.get(r) for r in numbers]
        if True in known:
            return True
        for r in numbers:
            if r in self.closed and self.cut and self._in_parts(group, r, interner):
                group.known[r] = True
                return True
        answer = self.recognise(numbers, group, interner)
        if not answer:
            for r in numbers:
                group.known[r] = False
        return answer

    def recognise(self, roots: tuple[int, ...], group: Group, interner: Interner) -> bool:
        op, arg, select = self.op, self.arg, self.select
        tokens, breaks = group.tokens, group.breaks
        n = len(tokens)
        kinds = [t if type(t) is str else t.kind for t in tokens]
        kinds.append("$")
        # Nodes of the graph-structured stack by (rule, position): edges to the callers, and
        # the positions at which the rule was left.
        stack: dict[tuple[int, int], tuple[set, set]] = {}
        root: tuple[set, set] = (set(), set())
        work: list[tuple[int, tuple, int]] = []
        for r in roots:
            node = (set(), set())
            node[0].add((-1, id(root)))
            stack[r, 0] = node
            work.extend((s, node, 0) for s in select[r].get(kinds[0], ()))
        nodes = {id(root): root}
        nodes.update((id(x), x) for x in stack.values())
        seen: set[tuple[int, int, int]] = set()
        while work:
            s, node, i = work.pop()
            while True:
                o = op[s]
                if o == _T:
                    if kinds[i] not in arg[s]:
                        break
                    s += 1
                    i += 1
                elif o == _G:
                    bracket, rule = arg[s]
                    if kinds[i] != bracket:
                        break
                    inner = tokens[i]
                    known = inner.known.get(rule)
                    if known is None:
                        known = self.derives(inner, rule, interner)
                    if not known:
                        break
                    s += 1
                    i += 1
                elif o == _N:
                    rule = arg[s]
                    child = stack.get((rule, i))
                    edge = (s + 1, id(node))
                    if child is None:
                        child = stack[rule, i] = ({edge}, set())
                        nodes[id(child)] = child
                        for a in select[rule].get(kinds[i], ()):
                            work.append((a, child, i))
                    elif edge not in child[0]:
                        child[0].add(edge)
                        for j in child[1]:
                            key = (s + 1, edge[1], j)
                            if key not in seen:
                                seen.add(key)
                                work.append((s + 1, node, j))
                    break
                elif o == _E:
                    if i < n and not (breaks and breaks[i]):
                        break
                    s += 1
                else:
                    edges, left = node
                    if i in left:
                        break
                    left.add(i)
                    for back, parent in edges:
                        if back < 0:
                            if i == n:
                                return True
                            continue
                        key = (back, parent, i)
                        if key not in seen:
                            seen.add(key)
                            work.append((back, nodes[parent], i))
                    break
        return False
