"""Catalogue queries that put each rule of the validators and reports to the test, in documents that keep it and that break it.

A case is a name, the document as a SQL expression of k (the part key), what to check it with, and for each expected issue a
condition on k, a place and a message. The oracle is the union of the conditions; it never sees a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonframe.functions import documents as D
from canonframe.functions.formats import format_ok

Case = tuple[str, str, str, list[tuple[str, str, str]]]

SCHEMAS: list[Case] = [
    ("J1 boolean", """if(k % 2 = 0, '{"a":1}', '{"b":1}')""", '{"properties":{"a":false,"b":true}}', [("k % 2 = 0", "/a", "boolean false schema: nothing is valid")]),
    ("J2 ref", """concat('{"a":', if(k % 3 = 0, '1', '"x"'), '}')""", '{"$defs":{"s":{"type":"string"}},"properties":{"a":{"$ref":"#/$defs/s"}}}', [("k % 3 = 0", "/a", "type: expected string")]),
    ("J2 recursive ref", """concat('{"v":1,"n":{', if(k % 2 = 0, '"v":2', ''), '}}')""", '{"properties":{"n":{"$ref":"#"}},"required":["v"]}', [("k % 2 = 1", "/n", "required: missing property 'v'")]),
    ("J3 anchor", """concat('{"a":', k % 4, '}')""", '{"$defs":{"x":{"$anchor":"pos","minimum":1}},"properties":{"a":{"$ref":"#pos"}}}', [("k % 4 = 0", "/a", "minimum not met")]),
    ("J4 type", """element_at(array('1.0', '1.5', '"s"', 'null'), k % 4 + 1)""", '{"type":["integer","null"]}', [("k % 4 in (1, 2)", "(root)", "type: expected integer/null")]),
    ("J5 enum", """element_at(array('1.0', '"a"', '[1]', '2'), k % 4 + 1)""", '{"enum":[1,"a",[1.0]]}', [("k % 4 = 3", "(root)", "enum: value not in the allowed set")]),
    ("J5 const", """concat('{"a":', k % 2, '.0}')""", '{"const":{"a":1}}', [("k % 2 = 0", "(root)", "const: value does not equal the constant")]),
    ("J6 multipleOf", "cast(k AS string)", '{"multipleOf":3}', [("k % 3 <> 0", "(root)", "multipleOf: not a multiple")]),
    ("J6 exclusive", "cast(k % 5 AS string)", '{"exclusiveMinimum":1,"exclusiveMaximum":3}', [("k % 5 >= 3", "(root)", "exclusiveMaximum reached"), ("k % 5 <= 1", "(root)", "exclusiveMinimum reached")]),
    ("J7 lengths", """concat('"', repeat('é', k % 5), '"')""", '{"minLength":2,"maxLength":3}', [("k % 5 < 2", "(root)", "minLength not met"), ("k % 5 > 3", "(root)", "maxLength exceeded")]),
    ("J8 pattern", """concat('"aa', k % 200, '"')""", '{"pattern":"^a+[0-9]{2}$"}', [("k % 200 < 10 OR k % 200 > 99", "(root)", "pattern: does not match")]),
    ("J10 items", """concat('["x",', if(k % 2 = 0, '"y"', '2'), ']')""", '{"prefixItems":[{"type":"string"}],"items":{"type":"string"}}', [("k % 2 = 1", "/1", "type: expected string")]),
    ("J10 prefixItems", """concat('[', if(k % 3 = 0, '"x"', '1'), ',true]')""", '{"prefixItems":[{"type":"integer"}]}', [("k % 3 = 0", "/0", "type: expected integer")]),
    ("J11 minItems maxItems", """concat('[', array_join(array_repeat(0, cast(k % 4 AS int)), ','), ']')""", '{"minItems":1,"maxItems":2}', [("k % 4 = 0", "(root)", "minItems not met"), ("k % 4 = 3", "(root)", "maxItems exceeded")]),
    ("J12 uniqueItems", """concat('[1,', k % 3, '.0]')""", '{"uniqueItems":true}', [("k % 3 = 1", "(root)", "uniqueItems: duplicate element")]),
    ("J13 contains", """concat('[', k % 10, ',7,', k % 10, ']')""", '{"contains":{"minimum":5},"maxContains":2}', [("k % 10 >= 5", "(root)", "contains: count outside min/maxContains")]),
    ("J14 unevaluatedItems", """if(k % 2 = 0, '[1]', '[1,2]')""", '{"prefixItems":[true],"unevaluatedItems":false}', [("k % 2 = 1", "/1", "unevaluatedItems: not allowed")]),
    ("J15 patternProperties", """concat('{"n1":', if(k % 2 = 0, '1', '"x"'), ',"z":"y"}')""", '{"patternProperties":{"^n":{"type":"integer"}},"additionalProperties":{"type":"string"}}', [("k % 2 = 1", "/n1", "type: expected integer")]),
    ("J16 required", """concat('{"a":1', if(k % 3 = 0, '', ',"b":2'), '}')""", '{"required":["a","b"]}', [("k % 3 = 0", "(root)", "required: missing property 'b'")]),
    ("J17 propertyNames", """if(k % 2 = 0, '{"abc":1}', '{"abcd":1}')""", '{"propertyNames":{"maxLength":3}}', [("k % 2 = 1", "/abcd", "propertyNames: invalid property name")]),
    ("J18 minProperties maxProperties", """element_at(array('{}', '{"a":1}', '{"a":1,"b":2}'), k % 3 + 1)""", '{"minProperties":1,"maxProperties":1}', [("k % 3 = 0", "(root)", "minProperties not met"), ("k % 3 = 2", "(root)", "maxProperties exceeded")]),
    ("J19 dependencies", """element_at(array('{"a":1,"b":1,"c":1}', '{"a":1,"c":1}', '{"a":1,"b":1}', '{"b":1}'), k % 4 + 1)""", '{"dependentRequired":{"a":["b"]},"dependentSchemas":{"a":{"required":["c"]}}}', [("k % 4 = 1", "(root)", "dependentRequired: 'a' needs 'b'"), ("k % 4 = 2", "(root)", "required: missing property 'c'")]),
    ("J20 unevaluatedProperties", """concat('{"a":1,"b":1', if(k % 2 = 0, '', ',"c":1'), '}')""", '{"properties":{"a":true},"allOf":[{"properties":{"b":true}}],"unevaluatedProperties":false}', [("k % 2 = 1", "/c", "unevaluatedProperties: not allowed")]),
    ("J21 allOf", "cast(k % 10 AS string)", '{"allOf":[{"minimum":3},{"maximum":6}]}', [("k % 10 < 3", "(root)", "minimum not met"), ("k % 10 > 6", "(root)", "maximum exceeded")]),
    ("J21 anyOf", "cast(k % 20 AS string)", '{"anyOf":[{"type":"string"},{"minimum":10}]}', [("k % 20 < 10", "(root)", "anyOf: no subschema matched")]),
    ("J21 oneOf", "cast(k AS string)", '{"oneOf":[{"multipleOf":2},{"multipleOf":3}]}', [("k % 6 = 0", "(root)", "oneOf: matched 2 subschemas (need exactly 1)"), ("k % 6 in (1, 5)", "(root)", "oneOf: matched 0 subschemas (need exactly 1)")]),
    ("J21 not", "cast(k AS string)", '{"not":{"multipleOf":5}}', [("k % 5 = 0", "(root)", "not: subschema unexpectedly matched")]),
    ("J22 if then else", "cast(k % 10 AS string)", '{"if":{"minimum":5},"then":{"multipleOf":2},"else":{"multipleOf":3}}', [("k % 10 in (1, 2, 4, 5, 7, 9)", "(root)", "multipleOf: not a multiple")]),
    ("J23 draft-07", """concat('["x",', if(k % 2 = 0, '"y"', '1'), ']')""", '{"$schema":"http://json-schema.org/draft-07/schema#","items":[true,{"type":"string"}],"dependencies":{"a":["b"]}}', [("k % 2 = 1", "/1", "type: expected string")]),
    ("J23 draft-07 dependencies", """if(k % 2 = 0, '{"a":1,"b":1}', '{"a":1}')""", '{"$schema":"http://json-schema.org/draft-07/schema#","dependencies":{"a":["b"]}}', [("k % 2 = 1", "(root)", "dependentRequired: 'a' needs 'b'")]),
]

JTDS: list[Case] = [
    ("T1 nullable", """element_at(array('null', '"s"', '1'), k % 3 + 1)""", '{"type":"string","nullable":true}', [("k % 3 = 2", "(root)", "schema /type")]),
    ("T2 ref", """concat('{"a":', if(k % 2 = 0, 'true', '0'), '}')""", '{"definitions":{"f":{"type":"boolean"}},"properties":{"a":{"ref":"f"}}}', [("k % 2 = 1", "/a", "schema /definitions/f/type")]),
    ("T3 int8", "cast(k % 300 - 150 AS string)", '{"type":"int8"}', [("k % 300 < 22 OR k % 300 > 277", "(root)", "schema /type")]),
    ("T3 timestamp", """if(k % 2 = 0, '"1985-04-12T23:20:50.52Z"', '"1985-4-12"')""", '{"type":"timestamp"}', [("k % 2 = 1", "(root)", "schema /type")]),
    ("T4 enum", """if(k % 2 = 0, '"A"', '"C"')""", '{"enum":["A","B"]}', [("k % 2 = 1", "(root)", "schema /enum")]),
    ("T5 elements", """element_at(array('["a"]', '["a",1]', '{}'), k % 3 + 1)""", '{"elements":{"type":"string"}}', [("k % 3 = 1", "/1", "schema /elements/type"), ("k % 3 = 2", "(root)", "schema /elements")]),
    ("T6 properties", """element_at(array('{"a":1}', '{}', '{"a":1,"b":2}'), k % 3 + 1)""", '{"properties":{"a":{"type":"uint8"}}}', [("k % 3 = 1", "(root)", "schema /properties/a"), ("k % 3 = 2", "/b", "schema (root)")]),
    ("T7 values", """element_at(array('{"x":1,"y":2}', '{"x":"1"}', '[]'), k % 3 + 1)""", '{"values":{"type":"float64"}}', [("k % 3 = 1", "/x", "schema /values/type"), ("k % 3 = 2", "(root)", "schema /values")]),
    ("T8 discriminator", """element_at(array('{"t":"a","x":1}', '{"t":"c"}', '{"x":1}', '{"t":"a","x":"1"}', '{"t":"b"}'), k % 5 + 1)""", '{"discriminator":"t","mapping":{"a":{"properties":{"x":{"type":"int32"}}},"b":{"properties":{}}}}',
     [("k % 5 = 1", "/t", "schema /mapping"), ("k % 5 = 2", "(root)", "schema /discriminator"), ("k % 5 = 3", "/x", "schema /mapping/a/properties/x/type")]),
    ("T9 empty", "element_at(array('1', 'null', '[{}]'), k % 3 + 1)", "{}", []),
]

CDDLS: list[Case] = [
    ("G5 range", "cast(k % 12 AS string)", "n = 2..9", [("k % 12 < 2 OR k % 12 > 9", "$", "expected 2..9")]),
    ("G5 number", """concat(k % 3, '.0')""", "n = 1", [("k % 3 <> 1", "$", "expected 1")]),
    ("G6 array", """concat('["h"', repeat(',1', cast(k % 4 AS int)), ']')""", "a = [tstr, 1*2 int]", [("k % 4 = 0", "$", "expected int"), ("k % 4 = 3", "$[3]", "unexpected extra array element")]),
    ("G6 many", """concat('[', array_join(array_repeat(if(k % 2 = 0, '1', '"x"'), cast(k % 3 AS int)), ','), ']')""", "a = [* uint]", [("k % 2 = 1 AND k % 3 > 0", "$[0]", "unexpected extra array element")]),
    ("G6 some", """if(k % 2 = 0, '[true]', '[]')""", "a = [+ bool, ? nil]", [("k % 2 = 1", "$", "expected bool")]),
    ("G7 map", """element_at(array('{"a":1}', '{}', '{"a":1,"b":1}', '[]'), k % 4 + 1)""", "m = { a: int }", [("k % 4 = 1", "$", "missing required member 'a'"), ("k % 4 = 2", "$.b", "unexpected member"), ("k % 4 = 3", "$", "expected object")]),
    ("G8 reference", """concat('{"p":[', k % 2, ',"x"]}')""", "top = { p: pair }\npair = [one, tstr]\none = 1 / true", [("k % 2 = 0", "$.p[0]", "expected one")]),
    ("G9 not an array", """if(k % 2 = 0, '[]', '{}')""", "a = [* int]", [("k % 2 = 1", "$", "expected array")]),
]

REPORTS: list[tuple[str, Callable, str, list[tuple[str, str, str, str]]]] = [
    ("I-JSON precision", D.ijson, "concat('[', if(k % 2 = 0, '0.1', '0.10000000000000000001'), ']')", [("k % 2 = 1", "$[0]", "number", "0.10000000000000000001 is not exactly representable as binary64 (loses precision)")]),
    ("I-JSON range", D.ijson, "concat('[1.5', if(k % 2 = 0, 'e3', 'e999'), ']')", [("k % 2 = 1", "$[0]", "number", "'15' || repeat('0', 998) || ' is an integer outside the I-JSON safe range ±(2^53-1)'")]),
    ("I-JSON surrogate", D.ijson, r"""concat('["', if(k % 2 = 0, '\\ud83d\\ude00', '\\ud83d'), '"]')""", [("k % 2 = 1", "$[0]", "surrogate", "string contains an unpaired surrogate")]),
    ("GeoJSON type", D.geojson, """element_at(array('{"type":"Point","coordinates":[1,2]}', '{"type":"Pont"}', '[]'), k % 3 + 1)""", [("k % 3 = 1", "$", "geojson-type", "invalid or missing GeoJSON 'type'"), ("k % 3 = 2", "$", "geojson-type", "GeoJSON value must be an object")]),
    ("GeoJSON coordinates", D.geojson, """element_at(array('{"type":"Point","coordinates":[1]}', '{"type":"LineString","coordinates":[[1,2]]}', '{"type":"MultiPoint","coordinates":[[1,"2"]]}'), k % 3 + 1)""",
     [("k % 3 = 0", "$.coordinates", "geojson-coordinates", "position must have at least two numbers"), ("k % 3 = 1", "$.coordinates", "geojson-coordinates", "LineString needs at least two positions"), ("k % 3 = 2", "$.coordinates[0][1]", "geojson-coordinates", "coordinate is not a number")]),
    ("GeoJSON member", D.geojson, """element_at(array('{"type":"Feature","geometry":null}', '{"type":"FeatureCollection"}', '{"type":"Point"}', '{"type":"FeatureCollection","features":[]}'), k % 4 + 1)""",
     [("k % 4 = 0", "$", "geojson-member", "Feature requires a 'properties' member (object or null)"), ("k % 4 = 1", "$", "geojson-member", "FeatureCollection requires a 'features' array"), ("k % 4 = 2", "$", "geojson-member", "Point requires a 'coordinates' member")]),
    ("GeoJSON crs and bbox", D.geojson, """concat('{"type":"Point","coordinates":[1,2]', if(k % 2 = 0, ',"crs":{}', ',"bbox":[1,2,3]'), '}')""", [("k % 2 = 0", "$", "geojson-crs", "'crs' member was removed in RFC 7946 (assume WGS 84)"), ("k % 2 = 1", "$.bbox", "geojson-bbox", "bbox must be an array of 2*n numbers (n>=2)")]),
    ("GeoJSON hole", D.geojson, """concat('{"type":"Polygon","coordinates":[[[0,0],[9,0],[9,9],[0,0]],', if(k % 2 = 0, '[[1,1],[2,2],[2,1],[1,1]]', '[[1,1],[2,1],[2,2],[1,1]]'), ']}')""", [("k % 2 = 1", "$.coordinates[1]", "geojson-winding", "interior ring (hole) should be clockwise (RFC 7946 §3.1.6)")]),
    ("lint key order", D.lint, """if(k % 2 = 0, '{"a":{"c":1,"d":2}}', '{"a":{"d":1,"c":2}}')""", [("k % 2 = 1", "$.a", "key-order", "object keys are not sorted")]),
]


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rows(parts: DataFrame, made: list) -> DataFrame:
    """made: (case, issues column); a row for each issue."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), c.alias("issues")) for name, c in made]))
    rows = parts.select("k", each.alias("x")).select("k", "x.rule", F.explode("x.issues").alias("i"))
    return rows.select(F.col("k").cast("long").alias("k"), "rule", "i.loc", "i.category", "i.message")


def _expected(cases: list[tuple[str, list[tuple[str, str, str, str]]]]) -> str:
    arms = []
    for name, issues in cases:
        for when, loc, category, message in issues:
            shown = message if message.startswith("'15'") else _text(message)
            arms.append(f"SELECT p_partkey AS k, {_text(name)} AS rule, {_text(loc)} AS loc, {_text(category)} AS category, {shown} AS message FROM part WHERE {when.replace('k %', 'p_partkey %')}")
    return "\nUNION ALL ".join(arms)


def _validator(name: str, check: Callable, category: str, cases: list[Case], add: Callable) -> None:
    def run(spark, d):
        parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("int").alias("k"))
        return _rows(parts, [(case, check(F.expr(doc), schema)) for case, doc, schema, _ in cases])

    add(_expected([(case, [(w, loc, category, m) for w, loc, m in issues]) for case, _, _, issues in cases]), name=name)(run)


#: Formats: strings that satisfy each and strings that do not.
FORMATS = {
    "date": ("2024-02-28", "2024-2-28"), "time": ("23:59:59Z", "24:00:00Z"), "date-time": ("2024-02-28T01:02:03+01:00", "2024-02-28 01:02:03"), "ipv4": ("192.0.2.255", "192.0.2.256"), "hostname": ("a-b.example", "-a.example"), "email": ("a@b.example", "a b@c"),
    "uuid": ("123e4567-e89b-12d3-a456-426614174000", "123e4567"), "uri": ("urn:x:y", "/no/scheme"), "json-pointer": ("/a~1b/0", "a/b"), "idn-hostname": ("x.example", "x..example"), "idn-email": ("ü@b.example", "@b"), "iri": ("http://é", "é"),
}
KERNEL_FORMATS = {**FORMATS, "ipv6": ("2001:db8::1", "2001:db8::1::2"), "regex": ("^a+$", "(")}


def register(add: Callable) -> None:
    """Adds the queries with add(sql, name=...)."""
    _validator("schema_rules", D.schema_errors, "schema", SCHEMAS, add)
    _validator("jtd_rules", D.jtd_errors, "jtd", JTDS, add)
    _validator("cddl_rules", D.cddl_errors, "cddl", CDDLS, add)

    def reports(spark, d):
        parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("int").alias("k"))
        return _rows(parts, [(name, check(F.expr(doc))) for name, check, doc, _ in REPORTS])

    add(_expected([(name, issues) for name, _, _, issues in REPORTS]), name="report_rules")(reports)

    def formats(spark, d):
        parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("int").alias("k"))
        each = []
        for name, (good, bad) in KERNEL_FORMATS.items():
            text = F.when(F.col("k") % 2 == 0, good).otherwise(bad)
            quoted = F.concat(F.lit('"'), text, F.lit('"'))
            native = format_ok(text, name) if name in FORMATS else F.lit(None).cast("boolean")
            each.append(F.struct(F.lit(name).alias("format"), D.is_valid_schema(quoted, f'{{"format":"{name}"}}', assert_format=True).alias("ok"), native.alias("native")))
        return parts.select("k", F.explode(F.array(*each)).alias("x")).select(F.col("k").cast("long").alias("k"), "x.format", "x.ok", "x.native")

    names = ", ".join(f"('{n}', {str(n in FORMATS).lower()})" for n in KERNEL_FORMATS)
    add(f"SELECT p_partkey AS k, f AS format, p_partkey % 2 = 0 AS ok, CASE WHEN c THEN p_partkey % 2 = 0 END AS native FROM part, (VALUES {names}) AS t(f, c)", name="format_rules")(formats)
