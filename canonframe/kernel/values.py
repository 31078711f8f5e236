"""The value tree: dict, list, str, bool, None, Num (a number's token, never floated) and NonFinite."""

from __future__ import annotations


class JsonError(ValueError):
    """A document, schema or transform that cannot be processed."""


class Num(str):
    """A number token as written (hexadecimal ones as decimal digits)."""

    __slots__ = ()


class NonFinite:
    __slots__ = ("kind",)

    def __init__(self, kind: str) -> None:
        self.kind = kind

    def __eq__(self, other: object) -> bool:
        return isinstance(other, NonFinite) and other.kind == self.kind

    def __hash__(self) -> int:
        return hash(self.kind)


# How a non-finite number is spelled as a string.
SPELLED = {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}


def kind_of(v) -> str:
    if v is None:
        return "null"
    if v is True or v is False:
        return "bool"
    return {Num: "number", NonFinite: "nonfinite", str: "string", list: "array", dict: "object"}[type(v)]


def quoted(text: str) -> str:
    return f"'{text}'"


def line_starts(text: str) -> list[int]:
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


class Positions:
    """line:col of positions, by code points, with the lines found once."""

    def __init__(self, text: str) -> None:
        self.starts = line_starts(text)

    def __call__(self, pos: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.starts, pos)
        return line, pos - self.starts[line - 1] + 1

    def text(self, pos: int) -> str:
        return "{}:{}".format(*self(pos))
