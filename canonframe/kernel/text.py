"""Bytes to text and back."""

from __future__ import annotations

from canonframe.kernel.values import JsonError

# Byte order marks, longest first where one begins another, with codec and reported name.
MARKS = (
    (b"\xff\xfe\x00\x00", "utf-32-le", "UTF-32-LE"),
    (b"\x00\x00\xfe\xff", "utf-32-be", "UTF-32-BE"),
    (b"\xef\xbb\xbf", "utf-8", "UTF-8"),
    (b"\xff\xfe", "utf-16-le", "UTF-16-LE"),
    (b"\xfe\xff", "utf-16-be", "UTF-16-BE"),
)
OUTPUTS = {codec: mark for mark, codec, _ in MARKS} | {"latin-1": b""}


def mark_of(data: bytes) -> tuple[bytes, str, str] | None:
    return next((m for m in MARKS if data.startswith(m[0])), None)


def decode(data: bytes | str, encoding: str | None = None) -> str:
    """Text of bytes: by the given encoding as it is, else by the mark (which is dropped), else UTF-8."""
    if isinstance(data, str):
        return data
    try:
        if encoding:
            return data.decode(encoding)
        if m := mark_of(data):
            return data[len(m[0]) :].decode(m[1])
        return data.decode("utf-8")
    except (UnicodeDecodeError, LookupError) as e:
        raise JsonError(f"cannot decode input: {e}") from None


def encode(text: str, encoding: str = "utf-8", bom: bool = False) -> bytes:
    if encoding not in OUTPUTS:
        raise JsonError(f"unsupported output encoding: {encoding}")
    try:
        return (OUTPUTS[encoding] if bom else b"") + text.encode(encoding)
    except UnicodeEncodeError as e:
        raise JsonError(f"cannot encode output: {e}") from None
