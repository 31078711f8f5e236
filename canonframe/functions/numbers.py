"""Number canonicalization as Catalyst expressions: exact decimal text, no Python.

A token is taken apart once; each intermediate value is bound once, so neither the plan nor the work grows with its uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from canonframe.kernel.numbers import MAX_EXPONENT_DIGITS, MAX_PLAIN_DIGITS

PATTERN = r"^([+-]?)(?:([0-9]+)(?:\.([0-9]*))?|\.([0-9]+))(?:[eE]([+-]?[0-9]+))?\z"
#: Tokens of at most 20 digits before the point and 18 behind it, whatever their exponent does: a decimal(38, 18) holds them.
_SHORT = r"^[+-]?(?:[0-9]{1,11}(?:\.[0-9]{0,8})?|\.[0-9]{1,8})(?:[eE][+-]?[0-9])?\z"
#: Digits of an exponent that fit a long with room for the shift by a token's length.
_LOW = 17


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def is_number_token(token: Column | str) -> Column:
    return _column(token).rlike(PATTERN)


def _fields(t: Column) -> Column:
    """[sign, whole digits, fraction digits, exponent] of a number token; anything else has another size."""
    return F.when(~F.contains(t, F.lit("|")), F.split(F.regexp_replace(t, PATTERN, "$1|$2|$3$4|$5"), r"\|"))


def _magnitude(digits: Column, shift: Column) -> Column:
    """Text of a whole number of more than _LOW digits plus a shift far below it: the carry runs through the text."""
    high, unit = F.left(digits, F.length(digits) - _LOW), 10**_LOW
    low = F.right(digits, F.lit(_LOW)).cast("long") + shift
    up, down = F.rtrim(high, F.lit("9")), F.rtrim(high, F.lit("0"))
    last = lambda h, step: F.concat(F.left(h, F.length(h) - 1), (F.right(h, F.lit(1)).cast("int") + step).cast("string"))
    carried = F.rpad(F.when(up == "", "1").otherwise(last(up, 1)), F.length(high) + F.when(up == "", 1).otherwise(0), "0")
    borrowed = F.rpad(last(down, -1), F.length(high), "9")
    tail = lambda x: F.lpad(x.cast("string"), F.lit(_LOW), "0")
    text = F.when(low >= unit, F.concat(carried, tail(low - unit))).when(low < 0, F.concat(borrowed, tail(low + unit))).otherwise(F.concat(high, tail(low)))
    return F.ltrim(text, F.lit("0"))


def _shaped(t: Column, number_format: str, preserve_type: bool) -> Callable[[Column], Column]:
    """From the fields to the text; null where plain format would need too many digits or the exponent has too many."""

    def digits_of(p: Column) -> Column:
        digits = F.ltrim(F.concat(p[1], p[2]), F.lit("0"))
        written = F.ltrim(p[3], F.lit("+-"))
        return F.struct(
            F.when(p[0] == "-", "-").otherwise("").alias("minus"),
            digits.alias("digits"),
            F.rtrim(digits, F.lit("0")).alias("short"),
            F.length(p[2]).cast("long").alias("behind"),
            p[3].startswith("-").alias("below"),
            F.ltrim(written, F.lit("0")).alias("exponent"),
        )

    def places_of(d: Column) -> Column:
        size = F.length(d["short"]).cast("long")
        shift = F.length(d["digits"]) - size - d["behind"]
        wide = F.length(d["exponent"]) > _LOW
        whole = F.when(wide, F.lit(0)).otherwise(F.concat(F.when(d["below"], "-").otherwise(""), F.lit("0"), d["exponent"]).cast("long"))
        return F.struct(d["minus"].alias("minus"), d["short"].alias("short"), size.alias("size"), wide.alias("wide"), (whole + shift).alias("power"), d["below"].alias("below"), d["exponent"].alias("exponent"))

    def text_of(x: Column) -> Column:
        short, power, minus = x["short"], x["power"], x["minus"]
        top = power + x["size"] - 1
        far = F.when(x["below"], _magnitude(x["exponent"], -top)).otherwise(_magnitude(x["exponent"], top))
        exponent = F.when(x["wide"], F.concat(F.when(x["below"], "-").otherwise("+"), far)).otherwise(F.concat(F.when(top < 0, "-").otherwise("+"), F.abs(top).cast("string")))
        mantissa = F.concat(minus, F.left(short, F.lit(1)), F.when(x["size"] > 1, F.concat(F.lit("."), F.substr(short, F.lit(2)))).otherwise(""))
        scientific = F.when(F.length(x["exponent"]) <= MAX_EXPONENT_DIGITS, F.concat(mantissa, F.lit("e"), exponent))
        places = F.when(~x["wide"] & (F.abs(power) <= MAX_PLAIN_DIGITS), power.cast("int"))
        end = F.when(t.rlike("[.eE]"), ".0").otherwise("") if preserve_type else F.lit("")
        plain = (
            F.when(places >= 0, F.concat(minus, short, F.repeat(F.lit("0"), places), end))
            .when(-places < x["size"], F.concat(minus, F.left(short, F.length(short) + places), F.lit("."), F.right(short, -places)))
            .when(places < 0, F.concat(minus, F.lit("0."), F.repeat(F.lit("0"), -places - F.length(short)), short))
        )
        out = {"plain": plain, "scientific": scientific, "auto": F.when(~x["wide"] & (top >= -6) & (top < 21), plain).otherwise(scientific)}
        return F.when(short == "", "0").otherwise(out[number_format])

    return lambda p: F.when(F.size(p) == 4, bound(bound(digits_of(p), places_of), text_of))


def try_canon_number(token: Column | str, number_format: str = "plain", preserve_type: bool = False) -> Column:
    """Canonical text of number tokens; null for what is no number token, for plain text of more than MAX_PLAIN_DIGITS
    padding digits, and for an exponent of more than MAX_EXPONENT_DIGITS digits."""
    if number_format not in ("plain", "scientific", "auto"):
        raise ValueError(f"unknown number_format {number_format!r}")
    t = _column(token)
    return _with_short_ones(t, _general(t, number_format, preserve_type), number_format, preserve_type)


def _general(t: Column, number_format: str, preserve_type: bool) -> Column:
    # all below is about s["t"], so that the token's own expression (a Python function, perhaps) is in no lambda
    return bound(F.struct(t.alias("t")), lambda s: bound(_fields(s["t"]), _shaped(s["t"], number_format, preserve_type)))


def _with_short_ones(t: Column, others: Column, number_format: str, preserve_type: bool) -> Column:
    """Tokens that a decimal holds exactly, and whose text a decimal gives without an exponent, need no taking apart."""
    if number_format == "scientific":
        return others
    exact = F.when(t.rlike(_SHORT), t.cast("decimal(38,18)"))
    text = F.rtrim(F.rtrim(exact.cast("string"), F.lit("0")), F.lit("."))
    if preserve_type:
        text = F.concat(text, F.when(~F.contains(text, F.lit(".")) & t.rlike("[.eE]"), ".0").otherwise(""))
    return F.when(exact == 0, "0").when(F.abs(exact) >= F.lit("0.000001").cast("decimal(7,6)"), text).otherwise(others)


def canon_number(token: Column | str, number_format: str = "plain", preserve_type: bool = False) -> Column:
    """The same, but anything else than a number token (or null) is an error, and so is what needs too many digits."""
    if number_format not in ("plain", "scientific", "auto"):
        raise ValueError(f"unknown number_format {number_format!r}")

    def checked(s: Column) -> Column:
        t, x = s["t"], s["x"]
        complaint = F.when(is_number_token(t), F.concat(F.lit("number '"), F.left(t, F.lit(40)), F.lit("' needs too many digits"))).otherwise(F.concat(F.lit("invalid number '"), t, F.lit("'")))
        return F.when(t.isNotNull() & x.isNull(), F.raise_error(complaint)).otherwise(x)

    t = _column(token)
    others = bound(F.struct(t.alias("t"), _general(t, number_format, preserve_type).alias("x")), checked)
    return _with_short_ones(t, others, number_format, preserve_type)
