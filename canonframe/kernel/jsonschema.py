"""JSON Schema (2020-12, and draft-07 where $schema says so) compiled to closures.

A schema becomes a list of checks in the order their errors are reported; check(instance, path, errors) appends
(path tokens, message). References are compiled when first followed, so recursive schemas are finite. A probe stops at the
first error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from canonframe.kernel import formats, regex
from canonframe.kernel.numbers import canonical, is_integral
from canonframe.kernel.parser import parse
from canonframe.kernel.pointer import joined
from canonframe.kernel.serialize import dumps
from canonframe.kernel.text import decode
from canonframe.kernel.values import JsonError, NonFinite, Num, quoted

Check = Callable[[object, tuple, list], None]


class _Enough(Exception):
    pass


class _First(list):
    def append(self, _) -> None:
        raise _Enough


_TYPES = {
    "null": lambda v: v is None,
    "boolean": lambda v: v is True or v is False,
    "object": lambda v: type(v) is dict,
    "array": lambda v: type(v) is list,
    "string": lambda v: type(v) is str,
    "number": lambda v: type(v) is Num,
    "integer": lambda v: type(v) is Num and is_integral(v),
}


def _text(v) -> str:
    return dumps(v, nan="string") if type(v) is NonFinite else dumps(v)


class Schema:
    """A compiled schema: errors(instance) and is_valid(instance)."""

    def __init__(self, source: bytes | str, assert_format: bool = False, encoding: str | None = None) -> None:
        self.root = parse(decode(source, encoding))
        self.assert_format = assert_format
        self.draft7 = type(self.root) is dict and "draft-07" in str(self.root.get("$schema") or "")
        self.anchors: dict[str, object] = {}
        stack = [self.root]
        while stack:  # the first anchor of a name wins, in the order of the text
            node = stack.pop()
            if type(node) is dict:
                if type(node.get("$anchor")) is str:
                    self.anchors.setdefault(node["$anchor"], node)
                stack += reversed(node.values())
            elif type(node) is list:
                stack += reversed(node)
        self.compiled: dict[int, list[Check]] = {}
        self.check = self.of(self.root)
        if type(self.root) is dict:  # a bad schema fails when it is made, as far as its top level shows it
            self.compiled[id(self.root)] = self.checks(self.root)

    # -- use
    def errors(self, instance) -> list[tuple[str, str, str]]:
        out: list = []
        self.check(instance, (), out)
        return [(joined(p) or "(root)", "schema", m) for p, m in out]

    def is_valid(self, instance) -> bool:
        return self.accepts(self.check, instance)

    @staticmethod
    def accepts(check: Check, instance) -> bool:
        try:
            check(instance, (), _First())
        except _Enough:
            return False
        return True

    # -- references
    def resolve(self, ref: str):
        if not ref.startswith("#"):
            raise JsonError(f"JSON Schema: only local $ref supported, got {quoted(ref)}")
        if ref[1:2] not in ("", "/"):
            if ref[1:] not in self.anchors:
                raise JsonError(f"JSON Schema: cannot resolve $ref {quoted(ref)}")
            return self.anchors[ref[1:]]
        node = self.root
        for raw in filter(None, [ref[1:].lstrip("/")]):
            for token in raw.split("/"):
                token = token.replace("~1", "/").replace("~0", "~")
                if type(node) is dict and token in node:
                    node = node[token]
                elif type(node) is list and token.isdigit() and int(token) < len(node):
                    node = node[int(token)]
                else:
                    raise JsonError(f"JSON Schema: cannot resolve $ref {quoted(ref)}")
        return node

    # -- compilation
    def of(self, schema) -> Check:
        if schema is True:
            return lambda v, at, out: None
        if schema is False:
            return lambda v, at, out: out.append((at, "boolean false schema: nothing is valid"))
        if type(schema) is not dict:
            raise JsonError("JSON Schema: a schema must be an object or a boolean")

        def run(v, at, out, key=id(schema)):
            checks = self.compiled.get(key)
            if checks is None:
                checks = self.compiled[key] = self.checks(schema)
            for c in checks:
                c(v, at, out)

        return run

    def checks(self, s: dict) -> list[Check]:
        if "$ref" in s:
            return [self.of(self.resolve(s["$ref"]))]
        out: list[Check] = []

        def simple(message: str, bad: Callable[[object], bool]) -> None:
            out.append(lambda v, at, errors: errors.append((at, message)) if bad(v) else None)

        def limit(key: str, kind: type, message: str, bad: Callable[[object, float], bool]) -> None:
            if key in s:
                bound = self.number(s[key])
                simple(message, lambda v: type(v) is kind and bad(v, bound))

        if "type" in s:
            names = s["type"] if type(s["type"]) is list else [s["type"]]
            tests = [_TYPES.get(str(n), lambda v: False) for n in names]
            simple("type: expected " + "/".join(map(str, names)), lambda v: not any(t(v) for t in tests))
        if "enum" in s:
            allowed = {_text(c) for c in s["enum"]}
            simple("enum: value not in the allowed set", lambda v: _text(v) not in allowed)
        if "const" in s:
            constant = _text(s["const"])
            simple("const: value does not equal the constant", lambda v: _text(v) != constant)
        if "multipleOf" in s and self.number(s["multipleOf"]) == 0:
            raise JsonError("JSON Schema: multipleOf must not be 0")
        limit("multipleOf", Num, "multipleOf: not a multiple", lambda v, m: not (float(v) / m).is_integer())
        limit("maximum", Num, "maximum exceeded", lambda v, m: float(v) > m)
        limit("minimum", Num, "minimum not met", lambda v, m: float(v) < m)
        limit("exclusiveMaximum", Num, "exclusiveMaximum reached", lambda v, m: float(v) >= m)
        limit("exclusiveMinimum", Num, "exclusiveMinimum reached", lambda v, m: float(v) <= m)
        limit("minLength", str, "minLength not met", lambda v, m: len(v) < m)
        limit("maxLength", str, "maxLength exceeded", lambda v, m: len(v) > m)
        if "pattern" in s:
            found = regex.compiled(s["pattern"]).search
            simple("pattern: does not match", lambda v: type(v) is str and not found(v))
        if self.assert_format and "format" in s:
            name = s["format"]
            simple(f"format: not a valid {name}", lambda v: type(v) is str and not formats.valid(name, v))
        out += self.array_checks(s, limit, simple)
        out += self.object_checks(s)
        out += [self.of(x) for x in s.get("allOf", [])]
        if "anyOf" in s:
            any_of = [self.of(x) for x in s["anyOf"]]
            simple("anyOf: no subschema matched", lambda v: not any(self.accepts(c, v) for c in any_of))
        if "oneOf" in s:
            one_of = [self.of(x) for x in s["oneOf"]]

            def one(v, at, errors):
                n = sum(self.accepts(c, v) for c in one_of)
                if n != 1:
                    errors.append((at, f"oneOf: matched {n} subschemas (need exactly 1)"))

            out.append(one)
        if "not" in s:
            banned = self.of(s["not"])
            simple("not: subschema unexpectedly matched", lambda v: self.accepts(banned, v))
        if "if" in s:
            test, then, other = (self.of(s.get(k, True)) for k in ("if", "then", "else"))
            out.append(lambda v, at, errors: (then if self.accepts(test, v) else other)(v, at, errors))
        return out

    @staticmethod
    def number(v) -> float:
        if type(v) is not Num:
            raise JsonError("JSON Schema: a limit must be a number")
        return float(v)

    def tuple_and_rest(self, s: dict) -> tuple[list | None, object]:
        items = s.get("items")
        prefix = s.get("prefixItems")
        if prefix is None and self.draft7 and type(items) is list:
            prefix = items
        return prefix if type(prefix) is list else None, s.get("additionalItems") if type(items) is list else items

    def array_checks(self, s: dict, limit, simple) -> list[Check]:
        # limit() and simple() append to the caller's list, so the parts here are wrapped to keep the order
        out: list[Check] = []
        prefix, rest = self.tuple_and_rest(s)
        heads = [self.of(x) for x in prefix or []]
        tail = self.of(rest) if rest is not None and type(rest) is not list else None
        if heads or tail:

            def elements(v, at, errors):
                if type(v) is list:
                    for i, x in enumerate(v):
                        c = heads[i] if i < len(heads) else tail
                        if c:
                            c(x, (*at, i), errors)

            out.append(elements)
        low, high = (self.number(s[k]) if k in s else None for k in ("minItems", "maxItems"))
        if low is not None:
            out.append(lambda v, at, errors: errors.append((at, "minItems not met")) if type(v) is list and len(v) < low else None)
        if high is not None:
            out.append(lambda v, at, errors: errors.append((at, "maxItems exceeded")) if type(v) is list and len(v) > high else None)
        if s.get("uniqueItems") is True:
            out.append(lambda v, at, errors: errors.append((at, "uniqueItems: duplicate element")) if type(v) is list and len({_text(x) for x in v}) < len(v) else None)
        if "contains" in s:
            member = self.of(s["contains"])
            least = int(self.number(s["minContains"])) if "minContains" in s else 1
            most = int(self.number(s["maxContains"])) if "maxContains" in s else math.inf

            def contains(v, at, errors):
                if type(v) is list and not least <= sum(self.accepts(member, x) for x in v) <= most:
                    errors.append((at, "contains: count outside min/maxContains"))

            out.append(contains)
        if "unevaluatedItems" in s:
            out.append(self.leftover(s, "unevaluatedItems", list))
        return out

    def leftover(self, s: dict, keyword: str, kind: type) -> Check:
        """unevaluatedItems or unevaluatedProperties."""
        strict = s[keyword] is False
        sub = None if strict else self.of(s[keyword])

        def run(v, at, errors):
            if type(v) is not kind:
                return
            if kind is list:
                left = range(self.seen_items(s, v), len(v))
            else:
                seen = self.seen_keys(s, v)
                left = [k for k in v if k not in seen]
            for k in left:
                if strict:
                    errors.append(((*at, k), f"{keyword}: not allowed"))
                else:
                    sub(v[k], (*at, k), errors)

        return run

    def applied(self, s: dict, v):
        """Subschemas that apply to the instance in place and hold."""
        if "$ref" in s:
            yield self.resolve(s["$ref"])
        yield from s.get("allOf", [])
        for keyword in ("anyOf", "oneOf"):
            yield from (x for x in s.get(keyword, []) if self.accepts(self.of(x), v))
        if "if" in s:
            if self.accepts(self.of(s["if"]), v):
                yield s["if"]
                if "then" in s:
                    yield s["then"]
            elif "else" in s:
                yield s["else"]

    def seen_keys(self, s, v: dict) -> set[str]:
        if type(s) is not dict:
            return set()
        if "additionalProperties" in s:
            out = set(v)
        else:
            found = [regex.compiled(p).search for p in s.get("patternProperties") or {}]
            named = s.get("properties") or {}
            out = {k for k in v if k in named or any(f(k) for f in found)}
        for sub in self.applied(s, v):
            out |= self.seen_keys(sub, v)
        return out

    def seen_items(self, s, v: list) -> int:
        if type(s) is not dict:
            return 0
        prefix, rest = self.tuple_and_rest(s)
        covers = rest is not None and type(rest) is not list and (type(s.get("items")) is not list or self.draft7)
        n = len(v) if covers else min(len(prefix or []), len(v))
        return max([n, *(self.seen_items(sub, v) for sub in self.applied(s, v))])

    def object_checks(self, s: dict) -> list[Check]:
        out: list[Check] = []

        def on_object(f: Callable[[dict, tuple, list], None]) -> None:
            out.append(lambda v, at, errors: f(v, at, errors) if type(v) is dict else None)

        named = {k: self.of(x) for k, x in (s.get("properties") or {}).items()}
        patterns = [(regex.compiled(p).search, self.of(x)) for p, x in (s.get("patternProperties") or {}).items()]
        closed = s.get("additionalProperties") is False
        extra = self.of(s["additionalProperties"]) if s.get("additionalProperties") is not None and not closed else None
        if named or patterns or closed or extra:

            def members(v, at, errors):
                for k, x in v.items():
                    covered = k in named
                    if covered:
                        named[k](x, (*at, k), errors)
                    for found, c in patterns:
                        if found(k):
                            covered = True
                            c(x, (*at, k), errors)
                    if not covered and closed:
                        errors.append(((*at, k), "additionalProperties: not allowed"))
                    elif not covered and extra:
                        extra(x, (*at, k), errors)

            on_object(members)
        required = s.get("required") or []
        if required:
            on_object(lambda v, at, errors: [errors.append((at, f"required: missing property {quoted(r)}")) for r in required if r not in v])
        if "propertyNames" in s:
            name = self.of(s["propertyNames"])
            on_object(lambda v, at, errors: [errors.append(((*at, k), "propertyNames: invalid property name")) for k in v if not self.accepts(name, k)])
        for key, message, wrong in (("minProperties", "minProperties not met", lambda n, m: n < m), ("maxProperties", "maxProperties exceeded", lambda n, m: n > m)):
            if key in s:
                on_object(lambda v, at, errors, m=self.number(s[key]), message=message, wrong=wrong: errors.append((at, message)) if wrong(len(v), m) else None)
        old = (s.get("dependencies") or {}).items() if self.draft7 else ()
        needs = {**(s.get("dependentRequired") or {}), **{k: x for k, x in old if type(x) is list}}
        if needs:
            on_object(lambda v, at, errors: [errors.append((at, f"dependentRequired: {quoted(k)} needs {quoted(r)}")) for k, rs in needs.items() if k in v for r in rs if r not in v])
        then = {**(s.get("dependentSchemas") or {}), **{k: x for k, x in old if type(x) is not list}}
        for k, x in then.items():
            on_object(lambda v, at, errors, k=k, c=self.of(x): c(v, at, errors) if k in v else None)
        if "unevaluatedProperties" in s:
            out.append(self.leftover(s, "unevaluatedProperties", dict))
        return out
