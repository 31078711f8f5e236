"""The regular-expression subset of schemas, matched in linear time.

Literals, `.` (not LF), classes, absolute ^ and $, groups, alternation, * + ? {n} {n,} {n,m} {,m}, ASCII \\d \\w \\s and
their complements. In a class only \\n \\t \\r \\f \\v are special; another escaped character is itself. A quantifier
character where an atom is due is a literal.

A pattern becomes a nondeterministic automaton, whose sets of states are made into a deterministic one as texts ask for
them. No pattern makes a search slower than its states times the text's length.
"""

from __future__ import annotations

import functools

from canonframe.kernel.values import JsonError, quoted

# The class escapes, as ranges of code points, and the control escapes.
_CLASSES = {"d": [(48, 57)], "w": [(48, 57), (65, 90), (95, 95), (97, 122)], "s": [(9, 13), (32, 32)]}
_CONTROLS = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}
#: Most states of a pattern (counted repetitions multiply them), and most transitions that are kept.
MAX_STATES = 100_000
MAX_KEPT = 50_000
_END = 0x10FFFF


def _complement(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], 0
    for low, high in sorted(ranges):
        if low > at:
            out.append((at, low - 1))
        at = max(at, high + 1)
    return out + [(at, _END)] if at <= _END else out


class _Reader:
    """From a pattern to a tree: ("set", ranges), ("bound", is_end), ("all", parts), ("any", parts), ("times", part, low, high)."""

    def __init__(self, source: str) -> None:
        self.s, self.at = source, 0

    def peek(self) -> str:
        return self.s[self.at : self.at + 1]

    def next(self, complaint: str) -> str:
        c = self.peek()
        if not c:
            raise JsonError(f"regex: {complaint}")
        self.at += 1
        return c

    def choice(self) -> tuple:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("any", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            part = self.atom()
            times = self.quantifier()
            parts.append(("times", part, *times) if times else part)
        return "all", parts

    def quantifier(self) -> tuple | None:
        c = self.peek()
        if c and c in "*+?":
            self.at += 1
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        if c != "{":
            return None
        stop = self.s.find("}", self.at)
        if stop < 0:
            raise JsonError("regex: unterminated {")
        low, comma, high = self.s[self.at + 1 : stop].partition(",")
        self.at = stop + 1
        if not all(x.isascii() and x.isdigit() and len(x) < 10 for x in (low, high) if x) or not (low or comma):
            raise JsonError("regex: invalid {")
        least = int(low or 0)
        most = (int(high) if high else None) if comma else least
        if most is not None and most < least:
            raise JsonError("regex: min repeat greater than max repeat")
        return least, most

    def atom(self) -> tuple:
        c = self.next("")
        if c == "(":
            if self.s.startswith("?:", self.at):
                self.at += 2
            inner = self.choice()
            if self.next("unterminated (") != ")":
                raise JsonError("regex: unterminated (")
            return inner
        if c == "[":
            return "set", self.bracket()
        if c == "\\":
            e = self.next("trailing backslash")
            if e.lower() in _CLASSES:
                return "set", _complement(_CLASSES[e.lower()]) if e.isupper() else _CLASSES[e.lower()]
            c = _CONTROLS.get(e, e)
        elif c in "^$":
            return "bound", c == "$"
        elif c == ".":
            return "set", _complement([(10, 10)])
        return "set", [(ord(c), ord(c))]

    def member(self) -> str:
        c = self.next("unterminated [")
        if c != "\\":
            return c
        e = self.next("unterminated [")
        return _CONTROLS.get(e, e)

    def bracket(self) -> list[tuple[int, int]]:
        negated = self.peek() == "^"
        self.at += negated
        ranges = []
        while self.peek() != "]":
            low = high = self.member()
            if self.peek() == "-" and self.s[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                high = self.member()
            if low <= high:
                ranges.append((ord(low), ord(high)))
        self.at += 1
        return _complement(ranges) if negated else ranges


class Pattern:
    """A compiled pattern; search(text) tells whether it matches anywhere.

    state k is a list of: "set" ranges to one state, "bound" to one state, or "to" several; state 0 is the match.
    """

    def __init__(self, tree: tuple) -> None:
        self.states: list[tuple] = [("match",)]
        self.first = self.build(tree, 0)
        self.sets: dict[tuple[frozenset, str], frozenset] = {}
        self.starts = self.reach([self.first], True, False), self.reach([self.first], False, False)

    def add(self, *state) -> int:
        if len(self.states) >= MAX_STATES:
            raise JsonError(f"regex: more than {MAX_STATES} states")
        self.states.append(state)
        return len(self.states) - 1

    def build(self, tree: tuple, after: int) -> int:
        """States for the tree, which lead to `after`; returns the first. Trees nest no deeper than the pattern's groups."""
        kind = tree[0]
        if kind in ("set", "bound"):
            return self.add(kind, tree[1], after)
        if kind == "any":
            return self.add("to", [self.build(t, after) for t in tree[1]])
        if kind == "all":
            for t in reversed(tree[1]):
                after = self.build(t, after)
            return after
        _, part, low, high = tree
        if high is None:
            loop = self.add("to", [after])
            self.states[loop][1].append(self.build(part, loop))
            after = loop
        else:
            end = after
            for _ in range(high - low):
                after = self.add("to", [end, self.build(part, after)])
        for _ in range(low):
            after = self.build(part, after)
        return after

    def reach(self, states, at_start: bool, at_end: bool) -> frozenset:
        """What can be reached without a character. An end that has not come yet stays in the set, to be asked again."""
        seen, stack = set(), list(states)
        while stack:
            k = stack.pop()
            if k in seen:
                continue
            seen.add(k)
            state = self.states[k]
            if state[0] == "to":
                stack += state[1]
            elif state[0] == "bound" and (at_end if state[1] else at_start):
                stack.append(state[2])
        return frozenset(k for k in seen if self.states[k][0] != "to")

    def step(self, now: frozenset, c: str) -> frozenset:
        code = ord(c)
        to = [s[2] for s in (self.states[k] for k in now) if s[0] == "set" and any(a <= code <= b for a, b in s[1])]
        out = self.reach(to, False, False) | self.starts[1]
        if len(self.sets) >= MAX_KEPT:
            self.sets.clear()
        self.sets[now, c] = out
        return out

    def search(self, text: str) -> bool:
        now, sets = self.starts[0], self.sets
        for c in text:
            if 0 in now:
                return True
            now = sets.get((now, c)) or self.step(now, c)
        return 0 in now or 0 in self.reach(now, not text, True)


@functools.lru_cache(1024)
def compiled(pattern: str) -> Pattern:
    try:
        reader = _Reader(pattern)
        tree = reader.choice()
        if reader.at != len(pattern):
            raise JsonError(f"regex: unexpected {quoted(reader.peek())}")
        return Pattern(tree)
    except RecursionError:
        raise JsonError("regex: nested too deeply") from None


def search(pattern: str, text: str) -> bool:
    return compiled(pattern).search(text)
