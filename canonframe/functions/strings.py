"""Strings, keys and output bytes as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from canonframe.functions.numbers import _column

_SHORT = (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r"))
# Byte order marks by output encoding, and the charset names that Spark knows them by.
MARKS = {"utf-8": "EFBBBF", "utf-16-le": "FFFE", "utf-16-be": "FEFF", "utf-32-le": "FFFE0000", "utf-32-be": "0000FEFF", "latin-1": ""}
_CHARSETS = {"utf-8": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32-be": "UTF-32", "latin-1": "ISO-8859-1"}


def enc_string(s: Column | str) -> Column:
    """A JSON string literal with the least escapes; most strings need none, and few the long form."""
    c = _column(s)
    short = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), _SHORT, c)
    rare = r"[\x00-\x07\x0b\x0e-\x1f]"
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(rare), F.lit(0)))
    long_ = F.aggregate(found, short, lambda text, x: F.replace(text, x, F.concat(F.lit("\\u00"), F.lpad(F.lower(F.hex(F.ascii(x))), F.lit(2), "0"))))
    body = F.when(~c.rlike(r'["\\\x00-\x1f]'), c).when(c.rlike(rare), long_).otherwise(short)
    return F.concat(F.lit('"'), body, F.lit('"'))


def sort_keys(keys: Column | str, jcs: bool = False) -> Column:
    """An array of keys in canonical order: by code point, or by UTF-16 unit under RFC 8785."""
    k = _column(keys)
    if not jcs:
        return F.array_sort(k)
    return F.transform(F.array_sort(F.transform(k, lambda x: F.struct(F.encode(x, "UTF-16BE").alias("o"), x.alias("k")))), lambda s: s["k"])


def encode_output(text: Column | str, output_encoding: str = "utf-8", bom: bool = False) -> Column:
    """Bytes of canonical text in one of six encodings, with its byte order mark if asked for."""
    if output_encoding not in MARKS:
        raise ValueError(f"unsupported output encoding: {output_encoding}")
    t = _column(text)
    if output_encoding == "utf-32-le":  # Spark has no such charset: the big-endian form, four bytes at a time reversed
        h = F.hex(F.encode(t, "UTF-32"))
        body = F.unhex(F.regexp_replace(h, "(..)(..)(..)(..)", "$4$3$2$1"))
    else:
        body = F.encode(t, _CHARSETS[output_encoding])
    return F.concat(F.unhex(F.lit(MARKS[output_encoding])), body) if bom and MARKS[output_encoding] else body


def decode_bytes(data: Column | str) -> Column:
    """Text of bytes by their byte order mark, UTF-8 without one; malformed input is an error."""
    b = _column(data)
    n = F.octet_length(b)
    head = F.hex(F.substring(b, 1, 4))
    after = lambda k: F.substr(b, F.lit(k + 1), n - k)
    reversed32 = F.unhex(F.regexp_replace(F.hex(after(4)), "(..)(..)(..)(..)", "$4$3$2$1"))
    return (
        F.when(head.startswith("FFFE0000"), F.decode(reversed32, "UTF-32"))
        .when(head.startswith("0000FEFF"), F.decode(after(4), "UTF-32"))
        .when(head.startswith("EFBBBF"), F.decode(after(3), "UTF-8"))
        .when(head.startswith("FFFE"), F.decode(after(2), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(after(2), "UTF-16BE"))
        .otherwise(F.decode(b, "UTF-8"))
    )


def nonfinite(kind: Column | str, nan: str = "error", path: str = "<root>") -> Column:
    """JSON text of NaN, Infinity and -Infinity by policy; other values are null."""
    k = _column(kind)
    known = k.isin("NaN", "Infinity", "-Infinity")
    if nan == "null":
        return F.when(known, "null")
    if nan == "string":
        return F.when(known, F.concat(F.lit('"'), k, F.lit('"')))
    return F.when(known, F.raise_error(F.concat(F.lit("non-finite number ("), k, F.lit(f") at {path}"))))
