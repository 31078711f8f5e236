"""Lenient parser with an explicit stack: RFC 8259, JSONC, JSON5 and Python-emitter texts, with diagnostics and salvage.

Strict texts take the C scanner of the standard library with number tokens kept as text; anything it refuses, and every
parse that needs diagnostics, salvage or duplicate checks, runs on the scanner below.
"""

from __future__ import annotations

import json
import re
import unicodedata

from canonframe.kernel.numbers import is_number
from canonframe.kernel.values import JsonError, NonFinite, Num, Positions, quoted

_SPACE = re.compile(r"[ \t\n\r\v\f]*")
_PLAIN = {'"': re.compile(r'[^"\\]*'), "'": re.compile(r"[^'\\]*")}
_NUMBER = re.compile(r"[+-]?(?:[0-9.eE]|(?<=[eE])[+-])*")
_HEX = re.compile(r"[0-9a-fA-F]*")
_HEX4, _HEX2 = re.compile(r"[0-9a-fA-F]{4}"), re.compile(r"[0-9a-fA-F]{2}")
# One-letter escapes; any other escaped character stands for itself.
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}
# Literals in the order tried, with what they are and how they are reported.
_SIGNED = [("Infinity", "inf"), ("+Infinity", "inf"), ("-Infinity", "-inf"), ("-inf", "-inf"), ("-Inf", "-inf")]
_WORDS = [
    ("true", True, ""), ("True", True, "python"), ("false", False, ""), ("False", False, "python"), ("null", None, ""), ("None", None, "python"),
    ("NaN", NonFinite("nan"), "finite"), ("nan", NonFinite("nan"), "finite"), ("Infinity", NonFinite("inf"), "finite"), ("Inf", NonFinite("inf"), "finite"), ("inf", NonFinite("inf"), "finite"),
]

# Identifier classes of ECMAScript by Unicode general category.
_START = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl"}
_CONTINUE = _START | {"Mn", "Mc", "Nd", "Pc"}


def starts_name(c: str) -> bool:
    return c in "_$" or unicodedata.category(c) in _START


def continues_name(c: str) -> bool:
    return c in "_$\u200c\u200d" or unicodedata.category(c) in _CONTINUE


class _Fault(Exception):
    pass


_VALUE, _ITEM, _AFTER, _DONE, _FAIL = range(5)


class Scanner:
    def __init__(self, text: str, strict_dupes: bool = False, salvage: bool = False, max_depth: int = 1_000_000) -> None:
        self.text, self.at, self.end = text, 0, len(text)
        self.strict_dupes, self.salvage, self.max_depth = strict_dupes, salvage, max_depth
        self.notes: list[tuple[int, str, str]] = []
        self.recoveries: list[tuple[int, str]] = []

    def fault(self, message: str) -> _Fault:
        return _Fault(f"{message} at position {self.at}")

    def note(self, pos: int, category: str, message: str) -> None:
        self.notes.append((pos, category, message))

    # -- lexical parts
    def space(self) -> str:
        """Skips white space and comments; returns the character that follows, '' at the end."""
        text = self.text
        while True:
            self.at = _SPACE.match(text, self.at).end()
            two = text[self.at : self.at + 2]
            if two == "//":
                self.note(self.at, "comment", "comment is not valid JSON")
                stop = text.find("\n", self.at)
                self.at = self.end if stop < 0 else stop
            elif two == "/*":
                self.note(self.at, "comment", "comment is not valid JSON")
                stop = text.find("*/", self.at + 2)
                if stop < 0:
                    self.at = self.end
                    raise self.fault("unterminated block comment")
                self.at = stop + 2
            else:
                return two[:1]

    def unit(self) -> str:
        """A \\uXXXX escape whose backslash is at self.at, joined with a low surrogate that follows."""
        m = _HEX4.match(self.text, self.at + 2)
        if not m:
            raise self.fault("invalid \\u escape")
        code = int(m[0], 16)
        self.at += 6
        if 0xD800 <= code < 0xDC00 and self.text.startswith("\\u", self.at):
            low = _HEX4.match(self.text, self.at + 2)
            if low and 0xDC00 <= int(low[0], 16) < 0xE000:
                self.at += 6
                return chr(0x10000 + ((code & 0x3FF) << 10) + (int(low[0], 16) & 0x3FF))
        return chr(code)

    def string(self, quote: str) -> str:
        text = self.text
        if quote == "'":
            self.note(self.at, "single-quote", "single-quoted string is not valid JSON")
        self.at += 1
        parts = []
        while True:
            m = _PLAIN[quote].match(text, self.at)
            parts.append(m[0])
            self.at = m.end()
            if self.at >= self.end:
                raise self.fault("unterminated string")
            if text[self.at] == quote:
                self.at += 1
                return "".join(parts)
            e = text[self.at + 1 : self.at + 2]
            if not e:
                self.at += 1
                raise self.fault("unterminated escape")
            if e == "u":
                parts.append(self.unit())
            elif e == "x":
                self.note(self.at, "hex-escape", "\\xHH escape is JSON5, not JSON")
                m = _HEX2.match(text, self.at + 2)
                if not m:
                    raise self.fault("invalid \\x escape")
                parts.append(chr(int(m[0], 16)))
                self.at += 4
            elif e in "\n\r\u2028\u2029":
                self.note(self.at, "line-continuation", "escaped newline is JSON5, not JSON")
                self.at += 3 if text.startswith("\r\n", self.at + 1) else 2
            else:
                parts.append(_ESCAPES.get(e, e))
                self.at += 2

    def name(self) -> str:
        begin, out = self.at, []
        while self.at < self.end:
            here = self.at
            if self.text[here] == "\\":
                if not self.text.startswith("\\u", here):
                    if not out:
                        raise self.fault("invalid identifier escape")
                    break
                c = self.unit()
            else:
                c = self.text[here]
                self.at += 1
            if not (continues_name(c) if out else starts_name(c)):
                self.at = here
                break
            out.append(c)
        if not out:
            self.at = begin
            raise self.fault("expected string key")
        key = "".join(out)
        self.note(begin, "unquoted-key", f"unquoted key {quoted(key)} is JSON5, not JSON")
        return key

    def number(self):
        text, begin = self.text, self.at
        for word, kind in _SIGNED:
            if text.startswith(word, begin):
                self.note(begin, "non-finite", f"{word} has no JSON representation")
                self.at += len(word)
                return NonFinite(kind)
        digits = begin + (text[begin] in "+-")
        if text[digits : digits + 2] in ("0x", "0X"):
            m = _HEX.match(text, digits + 2)
            self.at = m.end()
            if not m[0]:
                raise self.fault("invalid hex number")
            self.note(begin, "hex-number", f"hex number {quoted(text[begin : self.at])} is JSON5, not JSON")
            value = _decimal(int(m[0], 16))
            return Num("-" + value if text[begin] == "-" and value != "0" else value)
        token = _NUMBER.match(text, begin)[0]
        self.at = begin + len(token)
        if not is_number(token):
            raise self.fault(f"invalid number {quoted(token)}")
        body = token.lstrip("+-")
        why = "leading '+' in number" if token[0] == "+" else "leading zero in number" if body[0] == "0" and body[1:2].isdigit() else "missing digit in number" if "." in (body[0], body[-1]) else ""
        if why:
            self.note(begin, "number-syntax", f"{why} {quoted(token)}")
        return Num(token)

    def word(self):
        for word, value, how in _WORDS:
            if self.text.startswith(word, self.at):
                if how == "finite":
                    self.note(self.at, "non-finite", f"{word} has no JSON representation")
                elif how:
                    self.note(self.at, "python-literal", f"{word} is Python, not JSON")
                self.at += len(word)
                return value
        raise self.fault("unexpected token")

    def resync(self) -> None:
        """To the next comma or closing bracket at this depth, past strings and nested containers."""
        depth = 0
        for m in _DELIMITERS.finditer(self.text, self.at):
            c = m[0]
            if c in "[{":
                depth += 1
            elif c in "]}":
                if not depth:
                    self.at = m.start()
                    return
                depth -= 1
            elif c == "," and not depth:
                self.at = m.start()
                return
        self.at = self.end

    # -- values
    def value(self):
        """One value from self.at on. Frames are [container, key, begin of the current member]."""
        frames: list[list] = []
        state, result, failed = _VALUE, None, None
        while True:
            if state == _DONE:
                if not frames:
                    return result
                box, key, _ = frames[-1]
                if type(box) is list:
                    box.append(result)
                else:
                    if key in box and not self.salvage:
                        if self.strict_dupes:
                            raise self.fault(f"duplicate key {quoted(key)}")
                        self.note(self.at, "duplicate-key", f"duplicate key {quoted(key)} (last value wins)")
                    box[key] = result
                state = _AFTER
            elif state == _FAIL:
                if not self.salvage or not frames:
                    raise failed
                self.recoveries.append((frames[-1][2], "dropped malformed " + ("array element" if type(frames[-1][0]) is list else "object member")))
                self.resync()
                state = _AFTER
            elif state == _VALUE:
                try:
                    c = self.space()
                    if c == "":
                        raise self.fault("unexpected end of input")
                    if c in "{[":
                        if len(frames) >= self.max_depth:
                            raise self.fault("too deeply nested")
                        self.at += 1
                        box: dict | list = {} if c == "{" else []
                        c = self.space()
                        if c and c == ("]" if type(box) is list else "}"):
                            self.at += 1
                            result, state = box, _DONE
                        else:
                            frames.append([box, None, self.at])
                            state = _ITEM
                    else:
                        result = self.string(c) if c in "\"'" else self.number() if c in "+-.0123456789" else self.word()
                        state = _DONE
                except _Fault as e:
                    failed, state = e, _FAIL
            elif state == _ITEM:
                frame = frames[-1]
                try:
                    c = self.space()
                except _Fault as e:  # the container itself cannot go on: its parent drops it
                    frames.pop()
                    failed, state = e, _FAIL
                    continue
                frame[2] = self.at
                if type(frame[0]) is list:
                    state = _VALUE
                    continue
                try:
                    frame[1] = self.string(c) if c and c in "\"'" else self.name()
                    if self.space() != ":":
                        raise self.fault("expected ':'")
                    self.at += 1
                    state = _VALUE
                except _Fault as e:
                    failed, state = e, _FAIL
            else:  # after a member or element
                box = frames[-1][0]
                close, what = ("]", "array") if type(box) is list else ("}", "object")
                try:
                    c = self.space()
                    if c == ",":
                        self.at += 1
                        if self.space() == close:
                            self.note(self.at, "trailing-comma", f"trailing comma in {what}")
                            self.at += 1
                            result, state = frames.pop()[0], _DONE
                        else:
                            state = _ITEM
                        continue
                    if c == close:
                        self.at += 1
                        result, state = frames.pop()[0], _DONE
                        continue
                    if not self.salvage:
                        raise self.fault(f"expected ',' or '{close}'")
                except _Fault as e:
                    frames.pop()
                    failed, state = e, _FAIL
                    continue
                if c == "":
                    self.recoveries.append((self.at, f"unterminated {what} at end of input"))
                    result, state = frames.pop()[0], _DONE
                    continue
                self.recoveries.append((self.at, f"unexpected token in {what}"))
                self.resync()
                c = self.text[self.at : self.at + 1]
                if c == ",":
                    self.at += 1
                    state = _ITEM
                else:
                    self.at += c == close
                    result, state = frames.pop()[0], _DONE

    def document(self):
        try:
            out = self.value()
            self.space()
            if self.at != self.end:
                raise self.fault("trailing data")
        except _Fault as e:
            raise JsonError(str(e)) from None
        return out

    def stream(self) -> list:
        """All values of a text: RS-framed, separated by white space, or one after the other."""
        out = []
        try:
            while True:
                c = self.space()
                if c == "\x1e":
                    self.at += 1
                elif c == "":
                    return out
                else:
                    out.append(self.value())
        except _Fault as e:
            raise JsonError(str(e)) from None


_DELIMITERS = re.compile(r"""[\[\]{},]|"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|'(?:[^'\\]|\\.)*+(?:'|\\?\Z)""", re.S)


def _decimal(x: int) -> str:
    """Decimal digits of an integer of any size, without the interpreter's limit on conversions."""
    if x < 1 << 10_000:
        return str(x)
    half = x.bit_length() * 3 // 20
    hi, lo = divmod(x, 10**half)
    return _decimal(hi) + _decimal(lo).rjust(half, "0")


def _constant(word: str) -> NonFinite:
    return NonFinite({"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}[word])


_FAST = json.JSONDecoder(parse_float=Num, parse_int=Num, parse_constant=_constant)


def parse(text: str, strict_dupes: bool = False):
    """The value of a text."""
    if not strict_dupes:
        try:
            return _FAST.decode(text)
        except (ValueError, RecursionError):
            pass
    return Scanner(text, strict_dupes).document()


def diagnose(text: str) -> tuple[object, list[tuple[int, str, str]]]:
    s = Scanner(text)
    return s.document(), s.notes


def salvage(text: str) -> tuple[object, list[tuple[int, int, str]]]:
    """What can be read of a text, and (line, col, message) of what was dropped."""
    s = Scanner(text, salvage=True)
    out = None
    try:
        s.space()
        out = s.value()
    except _Fault:
        s.recoveries.append((s.at, "could not parse a value; using null"))
    try:
        s.space()
    except _Fault:
        s.at = min(s.at, s.end - 1)
    if s.at != s.end:
        s.recoveries.append((s.at, "dropped trailing data after the value"))
    where = Positions(text)
    return out, [(*where(pos), message) for pos, message in s.recoveries]


def parse_stream(text: str, strict_dupes: bool = False) -> list:
    return Scanner(text, strict_dupes).stream()


_LINE = re.compile(r"\r\n|\r|\n")


def ndjson_lines(text: str) -> list[str]:
    """Lines ended by LF, CRLF or CR, without those that hold only white space."""
    return [x for x in _LINE.split(text) if x.strip()]
