"""Kernels as columns: each crosses to Python once per Arrow batch.

Functions come in a strict form, which fails the query on a bad document, and a try_ form, which gives null. Constant
schemas and patches are compiled once per worker.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from canonframe.functions.numbers import _column
from canonframe.kernel import binary, cddl, jdata, jsonschema, jtd, parser, pointer, reports, text
from canonframe.kernel.document import Canonicalizer, Options
from canonframe.kernel.numbers import canonical, ecmascript
from canonframe.kernel.serialize import dumps, jcs_changes
from canonframe.kernel.values import JsonError

ISSUE = "struct<loc: string, category: string, message: string>"
_ISSUES = pa.list_(pa.struct([("loc", pa.string()), ("category", pa.string()), ("message", pa.string())]))
_RECOVERIES = pa.list_(pa.struct([("line", pa.int32()), ("col", pa.int32()), ("message", pa.string())]))


#: The issue of a document that nests deeper than a recursive check can follow.
TOO_DEEP = ("$", "nested too deeply to check")


@functools.lru_cache(64)
def _made(factory: Callable, argument):
    return factory(argument)


def _safe(s: str) -> str:
    """Text that a string column can hold: unpaired surrogates are written as escapes."""
    return s if s.isascii() else s.encode("utf-8", "backslashreplace").decode("utf-8")


def _lift(make: Callable[[], Callable], spark_type: str, arrow_type: pa.DataType, lenient: bool):
    """An Arrow function that applies make()'s result to each row; null rows stay null."""

    def run(*columns):
        f = make()
        out = []
        for row in zip(*[c.to_pylist() for c in columns]):
            if any(x is None for x in row):
                out.append(None)
                continue
            try:
                out.append(f(*row))
            except JsonError:
                if not lenient:
                    raise
                out.append(None)
        return pa.array(out, arrow_type)

    # the number of arguments is part of the signature that Spark inspects
    def one(a: pa.Array) -> pa.Array:
        return run(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    return lambda *cols: F.arrow_udf({1: one, 2: two}[len(cols)], spark_type)(*map(_column, cols))


def _text_of(data) -> str:
    return text.decode(data)


def _canonical(options: Options, lenient: bool) -> Callable:
    as_text = options.is_text

    def make():
        run = Canonicalizer(options)
        return (lambda d: run(d).data.decode("utf-8")) if as_text else (lambda d: run(d).data)

    return _lift(make, *(("string", pa.string()) if as_text else ("binary", pa.binary())), lenient)


def canonicalize(data: Column | str, **options) -> Column:
    """Canonical text of documents (string or binary); binary where the options ask for other bytes than UTF-8 text."""
    return _canonical(Options(**options), False)(data)


def try_canonicalize(data: Column | str, **options) -> Column:
    return _canonical(Options(**options), True)(data)


def canonicalize_report(data: Column | str, **options) -> Column:
    """struct<canon: binary, error: string, warnings: array<string>, recoveries: array<struct<line, col, message>>>."""
    o = Options(**options)
    arrow = pa.struct([("canon", pa.binary()), ("error", pa.string()), ("warnings", pa.list_(pa.string())), ("recoveries", _RECOVERIES)])

    def make():
        run = Canonicalizer(o)

        def f(d):
            try:
                r = run(d)
            except JsonError as e:
                return {"canon": None, "error": _safe(str(e)), "warnings": [], "recoveries": []}
            return {"canon": r.data, "error": None, "warnings": [_safe(w) for w in r.warnings], "recoveries": [{"line": a, "col": b, "message": m} for a, b, m in r.recoveries]}

        return f

    return _lift(make, "struct<canon: binary, error: string, warnings: array<string>, recoveries: array<struct<line: int, col: int, message: string>>>", arrow, False)(data)


def content_hash(data: Column | str, **options) -> Column:
    """Lower-case SHA-256 of the canonical bytes."""
    c = canonicalize(data, **options)
    return F.sha2(c.cast("binary"), 256)


def is_canonical(data: Column | str, **options) -> Column:
    """Whether a document already is what canonicalize gives; false for one that cannot be read, null for null."""
    c = _column(data)
    return F.when(c.isNotNull(), try_canonicalize(c, **options).eqNullSafe(c))


def salvage(data: Column | str) -> Column:
    """struct<canon: string, recoveries: array<struct<line, col, message>>> of damaged documents."""

    def make():
        def f(d):
            value, lost = parser.salvage(_text_of(d))
            return {"canon": dumps(value, nan="null"), "recoveries": [{"line": a, "col": b, "message": m} for a, b, m in lost]}

        return f

    arrow = pa.struct([("canon", pa.string()), ("recoveries", _RECOVERIES)])
    return _lift(make, "struct<canon: string, recoveries: array<struct<line: int, col: int, message: string>>>", arrow, False)(data)


def json_values(data: Column | str, **options) -> Column:
    """Canonical texts of all values of a stream text (RS-framed, white-space separated or concatenated), in order."""
    return _lift(lambda: lambda d: [dumps(v, **options) for v in parser.parse_stream(_text_of(d))], "array<string>", pa.list_(pa.string()), False)(data)


def ndjson_values(data: Column | str, **options) -> Column:
    """Canonical texts of the lines of an NDJSON text, in order."""
    return _lift(lambda: lambda d: [dumps(parser.parse(x), **options) for x in parser.ndjson_lines(_text_of(d))], "array<string>", pa.list_(pa.string()), False)(data)


def _issues(make: Callable[[], Callable], data) -> Column:
    def wrapped():
        f = make()
        return lambda d: [{"loc": _safe(a), "category": b, "message": _safe(c)} for a, b, c in f(d)]

    return _lift(wrapped, f"array<{ISSUE}>", _ISSUES, False)(data)


def _or_syntax(f: Callable) -> Callable:
    """Reports stay data: a document that cannot be parsed has one issue of category syntax."""

    def run(d):
        try:
            return f(d)
        except JsonError as e:
            return [("1:1", "syntax", str(e))]
        except RecursionError:
            return [(TOO_DEEP[0], "depth", TOO_DEEP[1])]

    return run


def lint(data: Column | str, number_format: str = "plain") -> Column:
    return _issues(lambda: _or_syntax(lambda d: reports.lint(d, number_format=number_format)), data)


def ijson(data: Column | str) -> Column:
    return _issues(lambda: _or_syntax(reports.ijson), data)


def geojson(data: Column | str) -> Column:
    return _issues(lambda: _or_syntax(reports.geojson), data)


def _schema(kind: str, source: str | bytes, assert_format: bool = False):
    if kind == "schema":
        return jsonschema.Schema(source, assert_format)
    return (jtd if kind == "jtd" else cddl).Schema(source)


@functools.lru_cache(64)
def _compiled(kind: str, source: str | bytes, assert_format: bool):
    return _schema(kind, source, assert_format)


def _validation(kind: str, source, assert_format: bool = False) -> Callable:
    _schema(kind, source, assert_format)  # a bad schema fails on the driver, when the query is built
    return lambda: _or_syntax(lambda d: _compiled(kind, source, assert_format).errors(parser.parse(_text_of(d))))


def schema_errors(data: Column | str, schema: str | bytes, assert_format: bool = False) -> Column:
    """JSON Schema violations: array<struct<loc, category, message>>."""
    return _issues(_validation("schema", schema, assert_format), data)


def jtd_errors(data: Column | str, schema: str | bytes) -> Column:
    return _issues(_validation("jtd", schema), data)


def cddl_errors(data: Column | str, schema: str | bytes) -> Column:
    return _issues(_validation("cddl", schema), data)


def _valid(kind: str, data, source, assert_format: bool = False) -> Column:
    _schema(kind, source, assert_format)

    def f(d):
        try:
            return _compiled(kind, source, assert_format).is_valid(parser.parse(_text_of(d)))
        except (JsonError, RecursionError):
            return False

    return _lift(lambda: f, "boolean", pa.bool_(), False)(data)


def is_valid_schema(data: Column | str, schema: str | bytes, assert_format: bool = False) -> Column:
    return _valid("schema", data, schema, assert_format)


def is_valid_jtd(data: Column | str, schema: str | bytes) -> Column:
    return _valid("jtd", data, schema)


def is_valid_cddl(data: Column | str, schema: str | bytes) -> Column:
    return _valid("cddl", data, schema)


def diff_documents(a: Column | str, b: Column | str, **options) -> Column:
    """Difference lines of two documents, in canonical order."""
    return _lift(lambda: lambda x, y: [_safe(s) for s in reports.diff(parser.parse(_text_of(x)), parser.parse(_text_of(y)), **options)], "array<string>", pa.list_(pa.string()), False)(a, b)


def change_rows(a: Column | str, b: Column | str, **options) -> Column:
    """array<struct<op, path, old, new>>: the differences of two documents; null stands for a missing one."""
    fields = ("op", "path", "old", "new")

    def rows(x, y):
        if x is None or y is None:
            whole = None if x is None and y is None else _safe(dumps(parser.parse(_text_of(y if x is None else x)), **options))
            found = [] if whole is None else [("+", "$", None, whole) if x is None else ("-", "$", whole, None)]
        else:
            found = reports.changes(parser.parse(_text_of(x)), parser.parse(_text_of(y)), **options)
        return [{k: None if v is None else _safe(v) for k, v in zip(fields, row)} for row in found]

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([rows(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.list_(pa.struct([(f, pa.string()) for f in fields])))

    return F.arrow_udf(two, "array<struct<op: string, path: string, old: string, new: string>>")(_column(a), _column(b))


def _transformed(f: Callable, data, argument, lenient: bool, options: dict) -> Column:
    """f(value, argument) as canonical text; the argument is a constant or a column."""
    if isinstance(argument, Column):
        return _lift(lambda: lambda d, x: dumps(f(parser.parse(_text_of(d)), x), **options), "string", pa.string(), lenient)(data, argument)
    return _lift(lambda: lambda d: dumps(f(parser.parse(_text_of(d)), argument), **options), "string", pa.string(), lenient)(data)


def _patched(value, operations: str):
    return pointer.patch(value, _made(parser.parse, operations))


def _merged(value, change: str):
    return pointer.merge(value, _made(parser.parse, change))


def json_pointer(data, expr, lenient: bool = False, **options) -> Column:
    """The value at a JSON Pointer (a text or a column), canonical."""
    return _transformed(pointer.get, data, expr, lenient, options)


def json_patch(data, operations, lenient: bool = False, **options) -> Column:
    return _transformed(_patched, data, operations, lenient, options)


def merge_patch(data, change, lenient: bool = False, **options) -> Column:
    return _transformed(_merged, data, change, lenient, options)


def try_json_pointer(data, expr, **options) -> Column:
    return json_pointer(data, expr, True, **options)


def try_json_patch(data, operations, **options) -> Column:
    return json_patch(data, operations, True, **options)


def to_cbor(data: Column | str, nan: str = "error") -> Column:
    return canonicalize(data, output_format="cbor", nan=nan)


def from_cbor(data: Column | str, **options) -> Column:
    return canonicalize(data, input_format="cbor", **options)


def to_msgpack(data: Column | str, nan: str = "error") -> Column:
    return canonicalize(data, output_format="msgpack", nan=nan)


def from_msgpack(data: Column | str, **options) -> Column:
    return canonicalize(data, input_format="msgpack", **options)


def from_jdata(data: Column | str, **options) -> Column:
    return canonicalize(data, input_format="jdata", **options)


def jcs_warnings(data: Column | str) -> Column:
    """A line for each number that binary64 changes."""
    return _lift(lambda: lambda d: [_safe(x) for x in jcs_changes(parser.parse(_text_of(d)))], "array<string>", pa.list_(pa.string()), False)(data)


def ecmascript_number(x: Column | str) -> Column:
    """String(x) of finite doubles; null for the others."""

    def f(v):
        return ecmascript(v) if v - v == 0 else None

    return _lift(lambda: f, "string", pa.string(), False)(_column(x).cast("double"))


def plain_number(x: Column | str) -> Column:
    """Canonical plain text of finite doubles; null for the others."""

    def f(v):
        return canonical(ecmascript(v)) if v - v == 0 else None

    return _lift(lambda: f, "string", pa.string(), False)(_column(x).cast("double"))


def register(spark: SparkSession) -> list[str]:
    """Registers the one-argument functions for SQL as json_*; returns their names."""
    from canonframe.operators.nodes import register_tables

    plain = {
        "json_canon": (lambda d: dumps(parser.parse(_text_of(d))), "string", pa.string()),
        "json_jcs": (lambda d: dumps(parser.parse(_text_of(d)), jcs=True), "string", pa.string()),
        "json_lint_count": (lambda d: len(reports.lint(d)), "int", pa.int32()),
        "json_to_cbor": (lambda d: binary.encode(parser.parse(_text_of(d)), binary.Cbor), "binary", pa.binary()),
        "json_to_msgpack": (lambda d: binary.encode(parser.parse(_text_of(d)), binary.MessagePack), "binary", pa.binary()),
        "json_from_cbor": (lambda d: dumps(binary.decode_cbor(d)), "string", pa.string()),
        "json_from_msgpack": (lambda d: dumps(binary.decode_msgpack(d)), "string", pa.string()),
        "json_jdata": (lambda d: dumps(jdata.expand(parser.parse(_text_of(d)))), "string", pa.string()),
    }
    for name, (f, spark_type, arrow_type) in plain.items():
        spark.udf.register(name, F.arrow_udf(_single(f, arrow_type), spark_type))
    return [*plain, *register_tables(spark)]


def _single(f: Callable, arrow_type: pa.DataType) -> Callable:
    def one(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in a.to_pylist()], arrow_type)

    return one


def as_json_text(value) -> str:
    """JSON text of a Python object for use as a schema or patch."""
    return value if isinstance(value, str) else json.dumps(value)
