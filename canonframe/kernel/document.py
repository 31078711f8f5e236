"""One document from bytes to canonical bytes, with all options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from canonframe.kernel import binary, jdata, parser, pointer, text
from canonframe.kernel.serialize import Writer, jcs_changes
from canonframe.kernel.values import JsonError

_DECODERS = {"cbor": binary.decode_cbor, "msgpack": binary.decode_msgpack}
_ENCODERS = {"cbor": binary.Cbor, "msgpack": binary.MessagePack}


@dataclass(frozen=True)
class Options:
    encoding: str | None = None
    ndjson: bool = False
    json_seq: bool = False
    strict_dupes: bool = False
    preserve_number_type: bool = False
    nan: str = "error"
    number_format: str = "plain"
    jcs: bool = False
    newline: bool = False
    output_encoding: str = "utf-8"
    bom: bool = False
    input_format: str = "json"
    output_format: str = "json"
    force: bool = False
    pointer: str | None = None
    patch: str | None = None
    merge_patch: str | None = None
    transform: Callable | None = None

    def __post_init__(self) -> None:
        if self.input_format not in ("json", "jdata", *_DECODERS) or self.output_format not in ("json", *_ENCODERS):
            raise JsonError("unknown input_format or output_format")
        if self.input_format != "json" and (self.force or self.ndjson or self.json_seq):
            raise JsonError("force, ndjson and json_seq need input_format json")
        if self.output_format != "json" and (self.ndjson or self.json_seq):
            raise JsonError(f"{self.output_format} output holds a single value")
        if self.output_encoding not in text.OUTPUTS:
            raise JsonError(f"unsupported output encoding: {self.output_encoding}")

    @property
    def is_text(self) -> bool:
        """Whether the output is plain UTF-8 text, so that a string column can hold it."""
        return self.output_format == "json" and self.output_encoding == "utf-8" and not self.bom

    def given(self, **changes) -> Options:
        return replace(self, **changes)


@dataclass
class Result:
    data: bytes = b""
    warnings: list[str] = field(default_factory=list)
    recoveries: list[tuple[int, int, str]] = field(default_factory=list)


class Canonicalizer:
    def __init__(self, options: Options) -> None:
        self.o = options
        self.writer = Writer(options.nan, options.number_format, options.preserve_number_type, options.jcs)
        self.change = self._change()

    def _change(self):
        """The transform: pointer, else patch, else merge patch, else the callable."""
        o = self.o
        if o.pointer is not None:
            return lambda v: pointer.get(v, o.pointer)
        if o.patch is not None:
            operations = parser.parse(o.patch)
            return lambda v: pointer.patch(v, operations)
        if o.merge_patch is not None:
            delta = parser.parse(o.merge_patch)
            return lambda v: pointer.merge(v, delta)
        return o.transform or (lambda v: v)

    def values(self, data: bytes | str, result: Result) -> list[tuple[str, object]]:
        """(where, value) of each value of the document, before transforms."""
        o = self.o
        if o.input_format in _DECODERS:
            return [("", _DECODERS[o.input_format](data.encode("latin-1") if isinstance(data, str) else data))]
        source = text.decode(data, o.encoding)
        if o.json_seq and not o.force:
            return [(f"value {i}", v) for i, v in enumerate(parser.parse_stream(source, o.strict_dupes), 1)]
        records = [("", source)]
        if o.ndjson or o.json_seq:
            records = [(f"{'value' if o.json_seq else 'line'} {i}", x) for i, x in enumerate(parser.ndjson_lines(source), 1)]
        out = []
        for where, record in records:
            if o.force:
                value, lost = parser.salvage(record)
                result.recoveries += lost
            else:
                value = parser.parse(record, o.strict_dupes)
            out.append((where, jdata.expand(value) if o.input_format == "jdata" else value))
        return out

    def __call__(self, data: bytes | str) -> Result:
        o, result = self.o, Result()
        values = [(where, self.change(v)) for where, v in self.values(data, result)]
        if o.output_format != "json":
            result.data = binary.encode(values[0][1], _ENCODERS[o.output_format], o.nan)
            return result
        if o.jcs:
            for where, v in values:
                result.warnings += jcs_changes(v, where)
        out = "\n".join([self.writer.text(v) for _, v in values])
        result.data = text.encode(out + "\n" if o.newline else out, o.output_encoding, o.bom)
        return result


def canonicalize(data: bytes | str, **options) -> bytes:
    return Canonicalizer(Options(**options))(data).data


def warning_log(warnings: list[str]) -> str:
    """The text of a change report."""
    if not warnings:
        return "conversion is exact\n"
    return f"{len(warnings)} number(s) changed\n" + "".join(f"  {w}\n" for w in warnings)
