"""Lint, I-JSON and GeoJSON reports, and structural differences. Issues are (location, category, message)."""

from __future__ import annotations

import math

from canonframe.kernel.numbers import canonical, ecmascript
from canonframe.kernel.parser import diagnose, parse
from canonframe.kernel.serialize import Writer
from canonframe.kernel.text import decode, mark_of
from canonframe.kernel.values import Num, Positions, kind_of

Issue = tuple[str, str, str]


def walk(value, path: str = "$"):
    """(path, value) of every node, depth first, members in their order."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        yield at, v
        if type(v) is list:
            stack += [(f"{at}[{i}]", v[i]) for i in range(len(v) - 1, -1, -1)]
        elif type(v) is dict:
            stack += [(f"{at}.{k}", x) for k, x in reversed(v.items())]


def _lexical(raw: bytes | str, encoding: str | None, mark: str) -> tuple[object, list[Issue]]:
    issues = []
    if not isinstance(raw, str) and (m := mark_of(raw)):
        issues.append(("1:1", "bom", f"{m[2]} BOM present{mark}"))
    text = decode(raw, encoding)
    value, notes = diagnose(text)
    where = Positions(text)
    return value, issues + [(where.text(pos), category, message) for pos, category, message in notes]


def lint(raw: bytes | str, encoding: str | None = None, number_format: str = "plain") -> list[Issue]:
    value, out = _lexical(raw, encoding, "")
    for at, v in walk(value):
        if type(v) is Num:
            if (c := canonical(v, number_format)) != v:
                out.append((at, "number", f"{v} → {c}"))
        elif type(v) is dict and list(v) != sorted(v):
            out.append((at, "key-order", "object keys are not sorted"))
    return out


def _unsafe(token: str) -> str | None:
    plain = canonical(token)
    if "." not in plain and (len(plain) > 20 or abs(int(plain)) >= 1 << 53):
        return f"{plain} is an integer outside the I-JSON safe range ±(2^53-1)"
    x = float(plain)
    if math.isinf(x):
        return f"{plain} is outside binary64 range"
    if canonical(ecmascript(x)) != plain:
        return f"{plain} is not exactly representable as binary64 (loses precision)"
    return None


def _torn(s: str) -> bool:
    return not s.isascii() and any("\ud800" <= c <= "\udfff" for c in s)


def ijson(raw: bytes | str, encoding: str | None = None) -> list[Issue]:
    value, out = _lexical(raw, encoding, " (I-JSON requires UTF-8, no BOM)")
    stack = [("$", value, None)]
    while stack:
        at, v, key = stack.pop()
        if key is not None and _torn(key):
            out.append((at, "surrogate", "key contains an unpaired surrogate"))
        if type(v) is Num:
            if why := _unsafe(v):
                out.append((at, "number", why))
        elif type(v) is str and _torn(v):
            out.append((at, "surrogate", "string contains an unpaired surrogate"))
        elif type(v) is list:
            stack += [(f"{at}[{i}]", v[i], None) for i in range(len(v) - 1, -1, -1)]
        elif type(v) is dict:
            stack += [(f"{at}.{k}", x, k) for k, x in reversed(v.items())]
    return out


# The geometry types of RFC 7946, and how deep their coordinates nest above positions.
GEOMETRIES = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3, "GeometryCollection": None}


class _Geo:
    def __init__(self) -> None:
        self.out: list[Issue] = []

    def add(self, at: str, category: str, message: str) -> None:
        self.out.append((at, "geojson-" + category, message))

    def position(self, p, at: str) -> bool:
        if type(p) is not list or len(p) < 2:
            self.add(at, "coordinates", "position must have at least two numbers")
            return False
        bad = [i for i, x in enumerate(p) if type(x) is not Num]
        for i in bad:
            self.add(f"{at}[{i}]", "coordinates", "coordinate is not a number")
        return not bad

    def positions(self, v, at: str, depth: int) -> None:
        if depth == 0:
            self.position(v, at)
        elif type(v) is list:
            for i, x in enumerate(v):
                self.positions(x, f"{at}[{i}]", depth - 1)

    def ring(self, ring, at: str, hole: bool) -> None:
        if type(ring) is not list or len(ring) < 4:
            self.add(at, "ring", "linear ring must have at least four positions")
            return
        whole = all([self.position(p, f"{at}[{i}]") for i, p in enumerate(ring)])
        first, last = ring[0], ring[-1]
        same = type(first) is list and type(last) is list and len(first) == len(last) and all(type(a) is Num and type(b) is Num and canonical(a) == canonical(b) for a, b in zip(first, last))
        if not same:
            self.add(at, "ring", "linear ring is not closed (first != last position)")
        elif whole:
            xy = [(float(p[0]), float(p[1])) for p in ring]
            area = 0.0
            for (x1, y1), (x2, y2) in zip(xy, xy[1:]):
                area += x1 * y2 - x2 * y1
            if area < 0 and not hole:
                self.add(at, "winding", "exterior ring should be counterclockwise (RFC 7946 §3.1.6)")
            elif area > 0 and hole:
                self.add(at, "winding", "interior ring (hole) should be clockwise (RFC 7946 §3.1.6)")

    def polygon(self, v, at: str) -> None:
        if type(v) is not list:
            self.add(at, "coordinates", "Polygon coordinates must be an array of rings")
            return
        for i, r in enumerate(v):
            self.ring(r, f"{at}[{i}]", i > 0)

    def geometry(self, v, at: str) -> None:
        if type(v) is not dict:
            self.add(at, "type", "geometry must be an object")
            return
        kind = v.get("type")
        if type(kind) is not str or kind not in GEOMETRIES:
            self.add(at, "type", "invalid or missing geometry type")
        elif kind == "GeometryCollection":
            if type(v.get("geometries")) is not list:
                self.add(at, "member", "GeometryCollection requires a 'geometries' array")
            else:
                for i, g in enumerate(v["geometries"]):
                    self.geometry(g, f"{at}.geometries[{i}]")
        elif v.get("coordinates") is None:
            self.add(at, "member", f"{kind} requires a 'coordinates' member")
        else:
            c, at = v["coordinates"], f"{at}.coordinates"
            if kind == "Polygon":
                self.polygon(c, at)
            elif kind == "MultiPolygon":
                for i, p in enumerate(c if type(c) is list else []):
                    self.polygon(p, f"{at}[{i}]")
            else:
                self.positions(c, at, GEOMETRIES[kind])
                if kind == "LineString" and type(c) is list and len(c) < 2:
                    self.add(at, "coordinates", "LineString needs at least two positions")

    def document(self, v, at: str) -> None:
        if type(v) is not dict:
            self.add(at, "type", "GeoJSON value must be an object")
            return
        if "crs" in v:
            self.add(at, "crs", "'crs' member was removed in RFC 7946 (assume WGS 84)")
        if "bbox" in v:
            b = v["bbox"]
            if type(b) is not list or len(b) < 4 or len(b) % 2 or any(type(x) is not Num for x in b):
                self.add(f"{at}.bbox", "bbox", "bbox must be an array of 2*n numbers (n>=2)")
        kind = v.get("type")
        if kind == "FeatureCollection":
            if type(v.get("features")) is not list:
                self.add(at, "member", "FeatureCollection requires a 'features' array")
            else:
                for i, f in enumerate(v["features"]):
                    self.document(f, f"{at}.features[{i}]")
        elif kind == "Feature":
            if "geometry" not in v:
                self.add(at, "member", "Feature requires a 'geometry' member (may be null)")
            elif v["geometry"] is not None:
                self.geometry(v["geometry"], f"{at}.geometry")
            if "properties" not in v:
                self.add(at, "member", "Feature requires a 'properties' member (object or null)")
        elif type(kind) is not str or kind not in GEOMETRIES:
            self.add(at, "type", "invalid or missing GeoJSON 'type'")
        else:
            self.geometry(v, at)


def geojson(raw: bytes | str, encoding: str | None = None) -> list[Issue]:
    geo = _Geo()
    geo.document(parse(decode(raw, encoding)), "$")
    return geo.out


def changes(a, b, **options):
    """(op, path, old, new) of the topmost differences, depth first with keys in canonical order: ~ changed, + only in b,
    - only in a. old and new are canonical texts, None where there is none."""
    writer = Writer(**options)
    missing = object()
    stack = [("$", a, b)]
    while stack:
        at, x, y = stack.pop()
        if x is missing or y is missing:
            yield ("+", at, None, writer.text(y)) if x is missing else ("-", at, writer.text(x), None)
            continue
        kind = kind_of(x)
        if kind != kind_of(y) or kind not in ("object", "array"):
            old, new = writer.text(x), writer.text(y)
            if old != new or kind != kind_of(y):
                yield "~", at, old, new
        elif kind == "object":
            stack += [(f"{at}.{k}", x.get(k, missing), y.get(k, missing)) for k in sorted({**x, **y}, key=writer.order, reverse=True)]
        else:
            n = max(len(x), len(y))
            stack += [(f"{at}[{i}]", x[i] if i < len(x) else missing, y[i] if i < len(y) else missing) for i in range(n - 1, -1, -1)]


def diff(a, b, **options) -> list[str]:
    """The same as lines."""
    return [f"{op} {at}: " + " => ".join(t for t in (old, new) if t is not None) for op, at, old, new in changes(a, b, **options)]


def render(issues: list[Issue]) -> str:
    """The layout of a printed report: padded columns and a summary line."""
    if not issues:
        return ""
    width = max(len(x[0]) for x in issues)
    return "".join(f"  {loc:<{width}}  {category:<14}  {message}\n" for loc, category, message in issues) + f"{len(issues)} issue(s), not canonical\n"
