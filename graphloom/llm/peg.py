"""Packrat parsing-expression grammars over token classes.

A grammar is text, one rule a line group::

    rule <- a b / c      sequence, ordered choice
    x* x+ x? &x !x (x)   repetition, lookahead, grouping
    "lit"                the class of that keyword or operator
    UPPER                a named set of classes
    END                  end of input

Input is a string with one character per token, its class. ``match`` memoizes
every (rule, position), keeps the furthest position at which a terminal failed,
and needs the whole input for a match.

Each expression has two matchers with the same result: a function, and a
coroutine for inputs that are nested deeper than Python's stack. ``match`` calls
the functions and, where the stack ends, starts anew with the coroutines, whose
stack is a list. So nesting has no limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Generator

_TOKEN = re.compile(r'\s*(?:(?P<lit>"[^"]+")|(?P<name>\w+)(?P<def>\s*<-)?|(?P<op>[*+?&!()/]))')
_END = "\0"

Matcher = Callable[["Run", int], int]
#: Yields (matcher, position) for each part, is sent where that part ends, and returns its own end.
DeepMatcher = Callable[["Run", int], Generator[tuple["DeepMatcher", int], int, int]]


class Run:
    """One parse: input with an end mark, memo and furthest failure."""

    __slots__ = ("far", "memo", "s")

    def __init__(self, s: str) -> None:
        self.s, self.memo, self.far = s + _END, {}, 0


class Grammar:
    """Compiled grammar; ``classes`` maps literals and UPPER names to their class characters.

    Expressions are compiled to functions; the classes an expression can begin
    with are worked out first, so that choices only try what can begin here.
    """

    def __init__(self, text: str, classes: dict[str, str]) -> None:
        self.classes = classes
        tokens = [m for line in text.splitlines() for m in _TOKEN.finditer(line.partition("#")[0]) if m.group().strip()]
        self._trees: dict[str, tuple] = {}
        i = 0
        while i < len(tokens):
            name, i = tokens[i]["name"], i + 1
            self._trees[name], i = self._choice(tokens, i)
        self._begin: dict[str, tuple[frozenset[str], bool]] = {n: (frozenset(), False) for n in self._trees}
        changed = True
        while changed:
            changed = False
            for name, tree in self._trees.items():
                if (now := self._begins(tree)) != self._begin[name]:
                    self._begin[name], changed = now, True
        self._bodies: dict[str, Matcher] = {}
        self.rules: dict[str, Matcher] = {name: self._rule(name) for name in self._trees}
        for name, tree in self._trees.items():
            self._bodies[name] = self._compile(tree)
        self._deep_bodies: dict[str, DeepMatcher] = {}
        self._deep_rules: dict[str, DeepMatcher] = {name: self._deep_rule(name) for name in self._trees}
        for name, tree in self._trees.items():
            self._deep_bodies[name] = self._deep(tree)

    # grammar text to trees

    def _choice(self, t: list[re.Match[str]], i: int) -> tuple[tuple, int]:
        options = []
        while True:
            parts = []
            while i < len(t) and not t[i]["def"] and t[i]["op"] not in ("/", ")"):
                part, i = self._item(t, i)
                parts.append(part)
            options.append(parts[0] if len(parts) == 1 else ("seq", parts))
            if i < len(t) and t[i]["op"] == "/":
                i += 1
                continue
            return (options[0] if len(options) == 1 else ("alt", options)), i

    def _item(self, t: list[re.Match[str]], i: int) -> tuple[tuple, int]:
        m = t[i]
        if m["op"] in ("&", "!"):
            part, i = self._item(t, i + 1)
            return ("look", part, m["op"] == "&"), i
        if m["op"] == "(":
            part, i = self._choice(t, i + 1)
            i += 1
        elif m["lit"]:
            part, i = ("is", frozenset(self.classes[m["lit"][1:-1]])), i + 1
        elif m["name"] == "END":
            part, i = ("end",), i + 1
        elif m["name"].isupper():
            part, i = ("is", frozenset(self.classes[m["name"]])), i + 1
        else:
            part, i = ("rule", m["name"]), i + 1
        while i < len(t) and t[i]["op"] in ("*", "+", "?"):
            part = ("maybe", part) if t[i]["op"] == "?" else ("many", part, int(t[i]["op"] == "+"))
            i += 1
        return part, i

    def _begins(self, tree: tuple) -> tuple[frozenset[str], bool]:
        """Classes with which a match can begin; whether it can be empty."""
        kind = tree[0]
        if kind == "is":
            return tree[1], False
        if kind == "end":
            return frozenset(_END), False
        if kind == "rule":
            return self._begin[tree[1]]
        if kind == "look":
            return frozenset(), True
        if kind in ("maybe", "many"):
            first, empty = self._begins(tree[1])
            return first, empty or kind == "maybe" or not tree[2]
        each = [self._begins(x) for x in tree[1]]
        if kind == "alt":
            return frozenset().union(*(f for f, _ in each)), any(e for _, e in each)
        first: frozenset[str] = frozenset()
        for f, e in each:
            first |= f
            if not e:
                return first, False
        return first, True

    # trees to functions

    def _rule(self, name: str) -> Matcher:
        bodies, (first, empty) = self._bodies, self._begin[name]

        def rule(run: Run, i: int) -> int:
            if not empty and run.s[i] not in first:
                if i > run.far:
                    run.far = i
                return -1
            key = (name, i)
            found = run.memo.get(key)
            if found is None:
                found = run.memo[key] = bodies[name](run, i)
            return found

        return rule

    def _compile(self, tree: tuple) -> Matcher:
        kind = tree[0]
        if kind == "rule":
            return self.rules[tree[1]]
        if kind in ("is", "end"):
            classes, step = (tree[1], 1) if kind == "is" else (frozenset(_END), 0)

            def terminal(run: Run, i: int) -> int:
                if run.s[i] in classes:
                    return i + step
                if i > run.far:
                    run.far = i
                return -1

            return terminal
        if kind == "seq":
            parts = [self._compile(x) for x in tree[1]]

            def sequence(run: Run, i: int) -> int:
                for p in parts:
                    i = p(run, i)
                    if i < 0:
                        return -1
                return i

            return sequence
        if kind == "alt":
            options = [(self._compile(x), *self._begins(x)) for x in tree[1]]
            always = tuple(p for p, _, e in options if e)
            by_class = {c: tuple(p for p, f, e in options if e or c in f) for c in self._begins(tree)[0]}

            def choice(run: Run, i: int) -> int:
                found = by_class.get(run.s[i], always)
                for p in found:
                    j = p(run, i)
                    if j >= 0:
                        return j
                if i > run.far:
                    run.far = i
                return -1

            return choice
        part, (first, empty) = self._compile(tree[1]), self._begins(tree[1])
        if kind == "look":
            wanted = tree[2]

            def look(run: Run, i: int) -> int:
                far = run.far
                found = part(run, i) >= 0
                run.far = far
                return i if found == wanted else -1

            return look
        if kind == "maybe":

            def maybe(run: Run, i: int) -> int:
                if not empty and run.s[i] not in first:
                    if i > run.far:
                        run.far = i
                    return i
                j = part(run, i)
                return i if j < 0 else j

            return maybe
        least = tree[2]

        def many(run: Run, i: int) -> int:
            n = 0
            while run.s[i] in first and (j := part(run, i)) > i:
                i, n = j, n + 1
            if i > run.far:
                run.far = i
            return i if n >= least else -1

        return many

    # trees to coroutines, for inputs nested deeper than the stack

    def _deep_rule(self, name: str) -> DeepMatcher:
        bodies, (first, empty) = self._deep_bodies, self._begin[name]

        def rule(run: Run, i: int) -> Generator[tuple[DeepMatcher, int], int, int]:
            if not empty and run.s[i] not in first:
                run.far = max(run.far, i)
                return -1
            key = (name, i)
            if key not in run.memo:
                run.memo[key] = yield bodies[name], i
            return run.memo[key]

        return rule

    def _deep(self, tree: tuple) -> DeepMatcher:
        kind = tree[0]
        if kind == "rule":
            return self._deep_rules[tree[1]]
        if kind in ("is", "end"):
            terminal = self._compile(tree)

            def leaf(run: Run, i: int) -> Generator[tuple[DeepMatcher, int], int, int]:
                return terminal(run, i)
                yield  # a coroutine as all others

            return leaf
        if kind in ("seq", "alt"):
            parts, stop_on_match = [(self._deep(x), *self._begins(x)) for x in tree[1]], kind == "alt"

            def several(run: Run, i: int) -> Generator[tuple[DeepMatcher, int], int, int]:
                at = i
                for part, first, empty in parts:
                    if stop_on_match and not empty and run.s[i] not in first:
                        continue
                    found = yield part, at
                    if stop_on_match and found >= 0 or not stop_on_match and found < 0:
                        return found
                    at = i if stop_on_match else found
                if stop_on_match:
                    run.far = max(run.far, i)
                    return -1
                return at

            return several
        part, (first, empty) = self._deep(tree[1]), self._begins(tree[1])
        if kind == "look":
            wanted = tree[2]

            def look(run: Run, i: int) -> Generator[tuple[DeepMatcher, int], int, int]:
                far = run.far
                found = yield part, i
                run.far = far
                return i if (found >= 0) == wanted else -1

            return look
        once, least = kind == "maybe", 0 if kind == "maybe" else tree[2]

        def repeated(run: Run, i: int) -> Generator[tuple[DeepMatcher, int], int, int]:
            n = 0
            while (run.s[i] in first or once and empty) and not (once and n):
                j = yield part, i
                if j < 0 or j == i:
                    break
                i, n = j, n + 1
            run.far = max(run.far, i)
            return i if n >= least else -1

        return repeated

    def _start(self, run: Run, rule: str, at: int) -> int:
        try:
            return self.rules[rule](run, at)
        except RecursionError:
            run.memo.clear()
            run.far = 0
        stack, found = [self._deep_rules[rule](run, at)], None
        while stack:
            try:
                part, i = stack[-1].send(found)
                stack.append(part(run, i))
                found = None
            except StopIteration as done:
                stack.pop()
                found = done.value
        return found

    def match(self, rule: str, s: str) -> tuple[bool, int]:
        """Whether ``rule`` takes all of ``s``; the furthest position at which it failed."""
        run = Run(s)
        end = self._start(run, rule, 0)
        return end == len(s), max(run.far, end)

    def prefix(self, rule: str, s: str, at: int = 0) -> int:
        """End of the match of ``rule`` at a position, -1 without."""
        return self._start(Run(s), rule, at)


class Remembered(dict):
    """Results by token classes, kept over files; starts anew when its keys hold more than so many characters, which only costs time."""

    def __init__(self, make: Callable[[str], object], most: int = 16 << 20) -> None:
        super().__init__()
        self._make, self._most, self._held = make, most, 0

    def keep(self, key: str, value: object) -> object:
        self._held += len(key) + 100  # and the entry itself
        if self._held > self._most:
            self.clear()
            self._held = len(key) + 100
        self[key] = value
        return value

    def __missing__(self, key: str) -> object:
        return self.keep(key, self._make(key))
