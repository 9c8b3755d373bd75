"""Parsing with derivatives over token classes, memoised on hash-consed languages.

A language is an integer: equal languages are one integer, so the derivative by a token is looked up in a table after it has first been
worked out. Grammars must not be left-recursive. The empty derivative marks the token at fault; a language that is not nullable at
the end of the tokens says that the text stops too early.
"""

from __future__ import annotations

import re

EMPTY, EPS = 0, 1
MOST_LANGUAGES = 400_000
_SYMBOL = re.compile(r"\s*(?:'([^']+)'|([A-Za-z_]\w*)|([()\[\]|*+?;=]))")


class Grammar:
    """Rules in a small notation: name = alternatives of sequences, 'token', [optional], (group), *, +, ? and a closing ;"""

    def __init__(self, rules: str, start: str):
        self.classes: dict[str, int] = {}
        self.rules = self._read(rules)
        self.start_name = start
        self._nullable_rules = self._fixpoint()
        self.reset()

    def _read(self, text: str) -> dict:
        at, symbols = 0, []
        text = text.strip()
        while at < len(text):
            m = _SYMBOL.match(text, at)
            if not m:
                raise ValueError(f"grammar at {text[at : at + 30]!r}")
            symbols.append(("tok", m.group(1)) if m.group(1) else ("ref", m.group(2)) if m.group(2) else ("op", m.group(3)))
            at = m.end()
        rules, i = {}, 0
        while i < len(symbols):
            name = symbols[i][1]
            body, i = self._alternatives(symbols, i + 2)
            rules[name] = body
            i += 1
        return rules

    def _alternatives(self, s: list, i: int):
        options = []
        while True:
            parts = []
            while s[i] not in (("op", "|"), ("op", ")"), ("op", "]"), ("op", ";")):
                kind, value = s[i]
                if kind == "tok":
                    node, i = ("tok", self.classes.setdefault(value, len(self.classes) + 1)), i + 1
                elif kind == "ref":
                    node, i = ("ref", value), i + 1
                else:
                    inner, i = self._alternatives(s, i + 1)
                    node, i = (("alt", [inner, ("seq", [])]) if value == "[" else inner), i + 1
                while i < len(s) and s[i] in (("op", "*"), ("op", "+"), ("op", "?")):
                    node = {"*": ("star", node), "+": ("seq", [node, ("star", node)]), "?": ("alt", [node, ("seq", [])])}[s[i][1]]
                    i += 1
                parts.append(node)
            options.append(("seq", parts))
            if s[i] != ("op", "|"):
                return ("alt", options), i
            i += 1

    def _fixpoint(self) -> set[str]:
        known: set[str] = set()

        def can(n) -> bool:
            kind, x = n
            return kind == "star" or (kind == "ref" and x in known) or (kind == "seq" and all(map(can, x))) or (kind == "alt" and any(map(can, x)))

        while True:
            more = {r for r, b in self.rules.items() if can(b)} - known
            if not more:
                return known
            known |= more

    def reset(self) -> None:
        """Forgets all languages but the rules'."""
        self.nodes: list = [None, None]
        self.nullable: list[bool] = [False, True]
        self.ids: dict = {}
        self.memo: dict[int, int] = {}
        self.bodies: dict[int, object] = {}
        self.start = self._build(("ref", self.start_name))

    def _node(self, key: tuple, nullable: bool) -> int:
        n = self.ids.get(key)
        if n is None:
            n = self.ids[key] = len(self.nodes)
            self.nodes.append(key)
            self.nullable.append(nullable)
        return n

    def _build(self, n) -> int:
        kind, x = n
        if kind == "tok":
            return self._node(("t", x), False)
        if kind == "ref":
            made = self._node(("r", x), x in self._nullable_rules)
            self.bodies.setdefault(made, self.rules[x])
            return made
        if kind == "star":
            made = self._node(("s", self._build(x)), True)
            return made
        if kind == "seq":
            out = EPS
            for part in reversed(x):
                out = self._seq(self._build(part), out)
            return out
        return self._alt([self._build(p) for p in x])

    def _seq(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        key = self.nodes[a]
        if key[0] == "q":
            return self._seq(key[1], self._seq(key[2], b))
        return self._node(("q", a, b), self.nullable[a] and self.nullable[b])

    def _alt(self, options) -> int:
        flat: set[int] = set()
        for o in options:
            key = self.nodes[o]
            if key and key[0] == "a":
                flat |= key[1]
            elif o != EMPTY:
                flat.add(o)
        if not flat:
            return EMPTY
        if len(flat) == 1:
            return flat.pop()
        return self._node(("a", frozenset(flat)), any(self.nullable[o] for o in flat))

    def derive(self, n: int, token: int) -> int:
        """The language of what may follow token in n."""
        if n <= EPS:
            return EMPTY
        at = n << 8 | token
        known = self.memo.get(at)
        if known is not None:
            return known
        key = self.nodes[n]
        kind = key[0]
        if kind == "t":
            out = EPS if key[1] == token else EMPTY
        elif kind == "q":
            out = self._seq(self.derive(key[1], token), key[2])
            if self.nullable[key[1]]:
                out = self._alt((out, self.derive(key[2], token)))
        elif kind == "a":
            out = self._alt([self.derive(o, token) for o in key[1]])
        elif kind == "s":
            out = self._seq(self.derive(key[1], token), n)
        else:
            body = self.bodies[n]
            if not isinstance(body, int):
                body = self.bodies[n] = self._build(body)
            out = self.derive(body, token)
        self.memo[at] = out
        return out

    def parse(self, tokens: list[int]) -> int:
        """The index of the token at fault; len(tokens) if the tokens stop too early; -1 if they are in the language."""
        if len(self.nodes) > MOST_LANGUAGES:
            self.reset()
        n, memo = self.start, self.memo
        for i, t in enumerate(tokens):
            nxt = memo.get(n << 8 | t)
            n = self.derive(n, t) if nxt is None else nxt
            if n == EMPTY:
                return i
        return -1 if self.nullable[n] else len(tokens)
