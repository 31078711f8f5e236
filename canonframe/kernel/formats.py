"""Checks of the JSON Schema formats, most of them patterns (ASCII, absolute ends). Unknown formats pass."""

from __future__ import annotations

import re

from canonframe.kernel import regex
from canonframe.kernel.values import JsonError

_DATE = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]"
_TIME = rf"{_CLOCK}:[0-5][0-9](?:\.[0-9]+)?(?:[Zz]|[+-]{_CLOCK})?"
_OCTET = r"(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_LABEL = r"(?!-)[A-Za-z0-9-]{1,63}(?<!-)"
_HOST = rf"(?=.{{1,253}}\Z){_LABEL}(?:\.{_LABEL})*"
#: Patterns by format, shared with the Catalyst predicates.
PATTERNS = {
    "date": _DATE,
    "time": _TIME,
    "date-time": rf"{_DATE}[Tt]{_TIME}",
    "ipv4": _V4,
    "hostname": _HOST,
    "idn-hostname": _HOST,
    "email": rf"[^@ ]+@{_HOST}",
    "idn-email": rf"[^@ ]+@{_HOST}",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "uri": r"(?s:[A-Za-z][A-Za-z0-9+.-]*:.*)",
    "json-pointer": r"(?:/(?:[^~/]|~[01])*)*",
}
for _name in ("iri", "uri-reference", "iri-reference"):
    PATTERNS[_name] = PATTERNS["uri"]
_COMPILED = {k: re.compile(rf"(?:{p})\Z", re.S) for k, p in PATTERNS.items()}
_GROUP = re.compile(r"[0-9a-fA-F]{1,4}\Z")


def _ipv6(s: str) -> bool:
    halves = s.split("::")
    if len(halves) > 2:
        return False
    groups = [g for h in halves if h for g in h.split(":")]
    room = 8
    if groups and "." in groups[-1]:
        if not _COMPILED["ipv4"].match(groups.pop()):
            return False
        room = 6
    if not all(_GROUP.match(g) for g in groups):
        return False
    return len(groups) < room if len(halves) == 2 else len(groups) == room


def valid(name: str, value: str) -> bool:
    if name == "ipv6":
        return _ipv6(value)
    if name == "regex":
        try:
            regex.compiled(value)
        except JsonError:
            return False
        return True
    pattern = _COMPILED.get(name)
    return pattern is None or pattern.match(value) is not None
