"""Typed tables to canonical documents: keys are sorted when the plan is made, rows are a concat of expressions."""

from __future__ import annotations

import base64
import math
import re
import uuid
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canonframe.functions.documents import plain_number
from canonframe.functions.numbers import canon_number
from canonframe.functions.strings import enc_string, nonfinite
from canonframe.kernel.numbers import canonical, ecmascript
from canonframe.kernel.serialize import dumps, string, utf16
from canonframe.kernel.values import NonFinite, Num


def _has_double(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_double(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_double(kind.keyType) or _has_double(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_double(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.FloatType, T.DoubleType))


def scalar(c: Column, kind: T.DataType, nan: str = "null", exact_doubles: bool = True, jcs: bool = False) -> Column:
    """Canonical JSON of a typed column; a map is an object with its keys as text.

    Doubles: exact_doubles takes shortest digits from the interpreter (one Python crossing; arrays and maps that hold doubles
    cross as a whole). Without it they are printed by the JVM, which is exact only where its digits are the shortest: always
    from JDK 19 on, on older ones for values between 1e-3 and 1e7 of at most 15 digits.
    """
    if isinstance(kind, T.StringType):
        out = enc_string(c)
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        out = c.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        double = c.cast("string").cast("double") if isinstance(kind, T.FloatType) else c
        digits = plain_number(double) if exact_doubles else canon_number(F.when(~F.isnan(c) & (F.abs(double) < float("inf")), double.cast("string")))
        out = F.coalesce(digits, nonfinite(c.cast("string"), nan))
    elif isinstance(kind, T.NumericType):
        out = canon_number(c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = enc_string(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    elif isinstance(kind, T.DateType):
        out = enc_string(F.date_format(c, "yyyy-MM-dd"))
    elif isinstance(kind, T.BinaryType):
        out = enc_string(F.base64(c))
    elif isinstance(kind, T.ArrayType):
        wide = exact_doubles and _has_double(kind)
        texts = _elements(c, kind.elementType, nan, jcs) if wide else F.transform(c, lambda x: scalar(x, kind.elementType, nan, False, jcs))
        out = F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        keys, values = F.map_keys(c), F.map_values(c)
        if exact_doubles and _has_double(kind):
            names = _elements(keys, kind.keyType, nan, jcs) if _has_double(kind.keyType) else F.transform(keys, lambda k: k.cast("string"))
            texts = _elements(values, kind.valueType, nan, jcs)
        else:
            names, texts = F.transform(keys, lambda k: k.cast("string")), F.transform(values, lambda x: scalar(x, kind.valueType, nan, False, jcs))
        member = lambda k, v: F.struct(F.encode(k, "UTF-16BE" if jcs else "UTF-8").alias("o"), F.concat(enc_string(k), F.lit(":"), v).alias("t"))
        members = F.transform(F.array_sort(F.zip_with(names, texts, member)), lambda m: m["t"])
        out = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        out = F.when(c.isNotNull(), _object([(f.name, c[f.name], f.dataType) for f in kind.fields], nan, exact_doubles, jcs))
    else:
        out = enc_string(c.cast("string"))
    return F.coalesce(out, F.lit("null"))


def _elements(values: Column, kind: T.DataType, nan: str, jcs: bool) -> Column:
    """Canonical texts of an array's elements, doubles in them with the interpreter's digits: one Python crossing."""
    run = _tree(kind)

    def one(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [dumps(run(v), nan=nan, jcs=jcs) for v in x] for x in a.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(one, "array<string>")(values)


def _tree(kind: T.DataType) -> Callable:
    """From an Arrow value of a type to a value tree of the kernel."""
    if isinstance(kind, T.ArrayType):
        item = _tree(kind.elementType)
        made = lambda v: [item(x) for x in v]
    elif isinstance(kind, T.MapType):
        key, item = _tree(kind.keyType), _tree(kind.valueType)
        made = lambda v: {k if isinstance(k, str) else dumps(key(k)).strip('"'): item(x) for k, x in v}
    elif isinstance(kind, T.StructType):
        parts = [(f.name, _tree(f.dataType)) for f in kind.fields]
        made = lambda v: {name: f(v[name]) for name, f in parts}
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        short = (lambda v: float(str(np.float32(v)))) if isinstance(kind, T.FloatType) else float

        def made(v):
            return Num(canonical(ecmascript(short(v)))) if v - v == 0 else NonFinite("NaN" if v != v else "Infinity" if v > 0 else "-Infinity")

    elif isinstance(kind, T.NumericType):
        made = lambda v: Num(canonical(format(v, "f") if isinstance(v, Decimal) else str(v)))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        made = lambda v: v.isoformat(timespec="milliseconds")[:23]
    elif isinstance(kind, T.DateType):
        made = lambda v: v.isoformat()
    elif isinstance(kind, T.BinaryType):
        made = lambda v: base64.b64encode(v).decode()
    elif isinstance(kind, T.BooleanType):
        made = bool
    else:
        made = str
    return lambda v: None if v is None else made(v)


def _object(members: list[tuple[str, Column, T.DataType]], nan: str, exact_doubles: bool, jcs: bool) -> Column:
    members = sorted(members, key=lambda m: utf16(m[0]) if jcs else m[0])
    parts: list[Column] = []
    for i, (name, c, kind) in enumerate(members):
        parts += [F.lit(("," if i else "{") + string(name) + ":"), scalar(c, kind, nan, exact_doubles, jcs)]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def canonical_row(df: DataFrame, nan: str = "null", exact_doubles: bool = True, jcs: bool = False) -> Column:
    """Each row of df as a canonical JSON object."""
    return _object([(f.name, df[f.name], f.dataType) for f in df.schema.fields], nan, exact_doubles, jcs)


def canonical_columns(df: DataFrame, index: str, nan: str = "null") -> DataFrame:
    """{column: {index: value}} of a small frame (the pandas `columns` orient) as one document in column `canon`.

    Built per column with aggregates; the result is one row, so it is for frames whose text one task can hold.
    """
    key = df[index].cast("string")
    parts = []
    for f in sorted((f for f in df.schema.fields if f.name != index), key=lambda f: f.name):
        pair = F.struct(key.alias("k"), F.concat(enc_string(key), F.lit(":"), scalar(df[f.name], f.dataType, nan)).alias("v"))
        members = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda s: s["v"]), ",")
        parts.append(F.concat(F.lit(string(f.name) + ":{"), members, F.lit("}")))
    body = F.concat_ws(",", *parts) if parts else F.lit("")
    return df.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("canon"))


def _marked(v, mark: str):
    """Floats as marked texts of their shortest digits, so that pandas does not round them; missing ones as None."""
    if isinstance(v, (float, np.floating)):
        return mark + repr(float(v)) if math.isfinite(v) else None
    if isinstance(v, np.ndarray):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [_marked(x, mark) for x in v]
    if isinstance(v, dict):
        return {str(k): _marked(x, mark) for k, x in v.items()}
    return v


def from_pandas(obj, **options) -> bytes:
    """Canonical bytes of a pandas object or of anything json can dump, at full precision (shortest digits of doubles)."""
    import json

    from canonframe.kernel.document import canonicalize

    if not hasattr(obj, "to_json"):
        return canonicalize(json.dumps(obj), **options)
    import pandas as pd

    mark = f"float {uuid.uuid4().hex} "

    def marked(s):
        return s.astype(object).map(lambda v: _marked(v, mark)) if s.dtype == object or pd.api.types.is_float_dtype(s.dtype) else s

    if isinstance(obj, pd.DataFrame):
        obj = pd.concat([marked(obj.iloc[:, i]) for i in range(obj.shape[1])], axis=1) if obj.shape[1] else obj
    elif isinstance(obj, pd.Series):
        obj = marked(obj)
    if isinstance(obj, (pd.DataFrame, pd.Series)) and pd.api.types.is_float_dtype(obj.index.dtype):
        obj.index = [repr(float(x)) for x in obj.index]
    written = obj.to_json(double_precision=15, date_format="iso", default_handler=str)
    return canonicalize(re.sub(f'"{mark}([^"]*)"', r"\1", written), **options)
