"""python -m canonframe: one document from a file or standard input. Exit status 0: done; 1: issues, differences or an
error in the document; 2: wrong use."""

from __future__ import annotations

import argparse
import hashlib
import sys
from pathlib import Path

import canonframe as C
from canonframe.kernel.document import Canonicalizer, warning_log
from canonframe.kernel.reports import render
from canonframe.kernel.text import OUTPUTS


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("canonframe", description=__doc__)
    p.add_argument("input", nargs="?", default="-", help="file, or - for standard input")
    p.add_argument("-o", "--output", help="file to write to instead of standard output")
    p.add_argument("--encoding", help="input encoding, where no byte order mark tells")
    p.add_argument("--output-encoding", choices=sorted(OUTPUTS), default="utf-8")
    p.add_argument("--from", dest="input_format", choices=["json", "cbor", "msgpack", "jdata"], default="json")
    p.add_argument("--to", dest="output_format", choices=["json", "cbor", "msgpack"], default="json")
    p.add_argument("--number-format", choices=["plain", "scientific", "auto"], default="plain")
    p.add_argument("--nan", choices=["error", "null", "string"], default="error")
    for flag in ("bom", "ndjson", "json-seq", "strict-dupes", "preserve-number-type", "jcs", "newline", "force"):
        p.add_argument(f"--{flag}", action="store_true")
    for flag in ("check", "lint", "ijson", "geojson", "sha256", "format"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true", help="no warnings on standard error; needs --log")
    p.add_argument("--log", help="file for the report of changed numbers and recoveries")
    p.add_argument("--pointer", help="JSON Pointer of the value to take")
    for flag in ("patch", "merge-patch", "diff", "validate", "schema", "cddl"):
        p.add_argument(f"--{flag}", metavar="FILE")
    return p


def _read(name: str) -> bytes:
    return sys.stdin.buffer.read() if name == "-" else Path(name).read_bytes()


def _report(issues: list) -> int:
    sys.stdout.write(render(issues).encode("utf-8", "backslashreplace").decode("utf-8"))
    return int(bool(issues))


def run(args: argparse.Namespace) -> int:
    raw = _read(args.input)
    if args.geojson:
        return _report(C.geojson(raw, args.encoding))
    if args.ijson:
        return _report(C.ijson(raw, args.encoding))
    if args.lint:
        return _report(C.lint(raw, args.encoding, args.number_format))
    if args.validate:
        return _report(C.validate_jtd(_read(args.validate), raw, args.encoding))
    if args.schema:
        return _report(C.validate_jsonschema(_read(args.schema), raw, args.encoding, args.format))
    if args.cddl:
        return _report(C.validate_cddl(_read(args.cddl), raw, args.encoding))
    if args.diff:
        lines = C.diff(raw, _read(args.diff), args.encoding, args.strict_dupes, jcs=args.jcs, nan=args.nan, number_format=args.number_format, preserve_number_type=args.preserve_number_type)
        sys.stdout.write("".join(f"{x}\n" for x in lines))
        return int(bool(lines))
    names = "encoding ndjson json_seq strict_dupes preserve_number_type nan number_format jcs newline output_encoding bom input_format output_format force pointer".split()
    options = {k: getattr(args, k) for k in names}
    for k in ("patch", "merge_patch"):
        if name := getattr(args, k):
            options[k] = C.decode_bytes(_read(name))
    result = Canonicalizer(C.Options(**options))(raw)
    if args.check:
        return int(result.data != raw)
    notes = result.warnings + [f"{line}:{col}  {message}" for line, col, message in result.recoveries]
    if args.log:
        Path(args.log).write_text(warning_log(notes), encoding="utf-8")
    if notes and not args.quiet:
        sys.stderr.write("".join(f"{x}\n" for x in notes))
    data = (hashlib.sha256(result.data).hexdigest() + "\n").encode() if args.sha256 else result.data
    if args.output:
        Path(args.output).write_bytes(data)
    else:
        sys.stdout.buffer.write(data)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.quiet and not args.log:
        sys.stderr.write("--quiet needs --log: a changed number must be on record\n")
        return 2
    try:
        return run(args)
    except C.JsonError as e:
        sys.stderr.write(f"error: {e}\n")
        return 1
    except OSError as e:
        sys.stderr.write(f"error: {e}\n")
        return 2


if __name__ == "__main__":
    sys.exit(main())
