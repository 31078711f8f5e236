"""JSON Schema formats as Catalyst predicates over string columns (JVM regular expressions, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canonframe.functions.numbers import _column
from canonframe.kernel.formats import PATTERNS


def format_ok(value: Column | str, name: str) -> Column:
    """Whether strings satisfy a format; unknown formats pass. ipv6 and regex are only in the kernel."""
    if name in ("ipv6", "regex"):
        raise ValueError(f"format {name} has no pattern; validate with schema_errors(..., assert_format=True)")
    c = _column(value)
    if name not in PATTERNS:
        return c.isNotNull()
    return c.rlike("^(?s:" + PATTERNS[name].replace("\\Z", "\\z") + ")\\z")
