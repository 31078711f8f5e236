"""Canonical JSON and document processing on Spark.

The names here work on one document without Spark; canonframe.functions.documents has the same as columns.
"""

from __future__ import annotations

from canonframe.kernel import binary as _binary
from canonframe.kernel import cddl as _cddl
from canonframe.kernel import jsonschema as _jsonschema
from canonframe.kernel import jtd as _jtd
from canonframe.kernel.document import Options, canonicalize
from canonframe.kernel.jdata import expand as decode_jdata
from canonframe.kernel.numbers import canonical as canon_number
from canonframe.kernel.numbers import ecmascript as ecmascript_number_to_string
from canonframe.kernel.numbers import is_number as is_number_token
from canonframe.kernel.parser import ndjson_lines, salvage
from canonframe.kernel.parser import parse as loads
from canonframe.kernel.parser import parse_stream as load_stream
from canonframe.kernel.pointer import get as get_pointer
from canonframe.kernel.pointer import merge as apply_merge_patch
from canonframe.kernel.pointer import patch as apply_patch
from canonframe.kernel.reports import diff as diff_values
from canonframe.kernel.reports import geojson, ijson, lint
from canonframe.kernel.serialize import dumps
from canonframe.kernel.text import decode as decode_bytes
from canonframe.kernel.text import encode as encode_output
from canonframe.kernel.values import JsonError, NonFinite, Num

__version__ = "0.1.0"


def load_ndjson(text: str, strict_dupes: bool = False) -> list:
    return [loads(x, strict_dupes) for x in ndjson_lines(text)]


def diff(a: bytes | str, b: bytes | str, encoding: str | None = None, strict_dupes: bool = False, **options) -> list[str]:
    """Differences of two documents under the same serializer options."""
    return diff_values(loads(decode_bytes(a, encoding), strict_dupes), loads(decode_bytes(b, encoding), strict_dupes), **options)


def encode_cbor(value, nan: str = "error") -> bytes:
    return _binary.encode(value, _binary.Cbor, nan)


def encode_msgpack(value, nan: str = "error") -> bytes:
    return _binary.encode(value, _binary.MessagePack, nan)


decode_cbor, decode_msgpack = _binary.decode_cbor, _binary.decode_msgpack


def validate_jsonschema(schema: bytes | str, instance: bytes | str, encoding: str | None = None, assert_format: bool = False) -> list:
    return _jsonschema.Schema(schema, assert_format, encoding).errors(loads(decode_bytes(instance, encoding)))


def validate_jtd(schema: bytes | str, instance: bytes | str, encoding: str | None = None) -> list:
    return _jtd.Schema(schema, encoding).errors(loads(decode_bytes(instance, encoding)))


def validate_cddl(schema: bytes | str, instance: bytes | str, encoding: str | None = None) -> list:
    return _cddl.Schema(schema, encoding).errors(loads(decode_bytes(instance, encoding)))


def from_pandas(obj, **options) -> bytes:
    from canonframe.operators.typed import from_pandas as convert

    return convert(obj, **options)


__all__ = [
    "JsonError", "NonFinite", "Num", "Options", "apply_merge_patch", "apply_patch", "canon_number", "canonicalize", "decode_bytes", "decode_cbor",
    "decode_jdata", "decode_msgpack", "diff", "diff_values", "dumps", "ecmascript_number_to_string", "encode_cbor", "encode_msgpack", "encode_output",
    "from_pandas", "geojson", "get_pointer", "ijson", "is_number_token", "lint", "load_ndjson", "load_stream", "loads", "salvage", "validate_cddl",
    "validate_jsonschema", "validate_jtd",
]
