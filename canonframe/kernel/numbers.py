"""Exact decimal text of number tokens, and ECMAScript text of doubles."""

from __future__ import annotations

import re

from canonframe.kernel.values import JsonError

TOKEN = re.compile(r"([+-]?)(?:([0-9]+)(?:\.([0-9]*))?|\.([0-9]+))(?:[eE]([+-]?[0-9]+))?\Z")
#: Most digits that plain format may pad a number to; beyond it the document fails instead of the executor.
MAX_PLAIN_DIGITS = 10_000_000
#: Most digits of an exponent, leading zeros apart: reading longer ones would take time quadratic in their length.
MAX_EXPONENT_DIGITS = 4_000


def is_number(token: str) -> bool:
    return TOKEN.match(token) is not None


def _parts(token: str) -> tuple[str, str, int]:
    """sign, significant digits without outer zeros ('' for zero), and the power of ten of the last digit."""
    m = TOKEN.match(token)
    if m is None:
        raise JsonError(f"invalid number '{token}'")
    sign, whole, part, bare, exponent = m.groups()
    fraction = bare if bare is not None else part or ""
    digits = ((whole or "") + fraction).lstrip("0")
    short = digits.rstrip("0")
    if not short:
        return "", "", 0
    written = (exponent or "0").lstrip("+-").lstrip("0")
    if len(written) > MAX_EXPONENT_DIGITS:
        raise JsonError(f"number '{token[:40]}' has an exponent of more than {MAX_EXPONENT_DIGITS} digits")
    power = int(written or 0) * (-1 if exponent and exponent[0] == "-" else 1) - len(fraction)
    return ("-" if sign == "-" and short else ""), short, power + len(digits) - len(short)


def _scientific(sign: str, digits: str, exponent: int) -> str:
    lead = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
    return f"{sign}{lead}e{'-' if exponent < 0 else '+'}{abs(exponent)}"


def canonical(token: str, number_format: str = "plain", preserve_type: bool = False) -> str:
    """plain, scientific or auto (scientific outside 1e-6 <= |x| < 1e21) decimal text of a token's exact value."""
    if token.isdigit() and token.isascii() and (token[0] != "0" or len(token) == 1) and number_format == "plain":
        return str(token)
    sign, digits, power = _parts(token)
    if not digits:
        return "0"
    top = power + len(digits) - 1
    if number_format == "scientific" or (number_format == "auto" and not -6 <= top < 21):
        return _scientific(sign, digits, top)
    if abs(power) > MAX_PLAIN_DIGITS:
        raise JsonError(f"number '{token[:40]}' needs more than {MAX_PLAIN_DIGITS} digits in plain format")
    if power >= 0:
        typed = preserve_type and any(c in token for c in ".eE")
        return sign + digits + "0" * power + (".0" if typed else "")
    return sign + (digits[:power] or "0") + "." + digits[power:].rjust(-power, "0")


def is_integral(token: str) -> bool:
    sign, digits, power = _parts(token)
    return power >= 0 or not digits


def to_float(token: str) -> float:
    return float(token)


def ecmascript(x: float) -> str:
    """What String(x) gives in JavaScript for a finite double."""
    if x == 0:
        return "0"
    sign, digits, power = _parts(repr(float(x)))
    n = power + len(digits)  # the point stands after n digits
    if -6 < n <= 21:
        if n <= 0:
            return f"{sign}0.{'0' * -n}{digits}"
        return sign + (digits.ljust(n, "0") if n >= len(digits) else f"{digits[:n]}.{digits[n:]}")
    return _scientific(sign, digits, n - 1)
