"""Kernels against literal cases and against the standard library."""

import decimal
import json
import math
import random
import re
import struct
import subprocess

import pytest

from canonframe.kernel import binary, cddl, formats, jdata, jsonschema, jtd, parser, pointer, regex, reports, text
from canonframe.kernel import numbers as N
from canonframe.kernel.document import Canonicalizer, Options, canonicalize, warning_log
from canonframe.kernel.serialize import dumps, jcs_changes
from canonframe.kernel.values import JsonError, NonFinite


def canon(t, **options):
    return canonicalize(t, **options).decode()


# --- numbers
@pytest.mark.parametrize(
    "token, plain",
    [("4", "4"), ("4.0", "4"), ("4.50e1", "45"), ("-0.0", "0"), ("1e3", "1000"), ("0.10", "0.1"), ("+007", "7"), ("1.5E-3", "0.0015"), (".5", "0.5"), ("5.", "5"), ("0e9", "0"), ("-1.0e-2", "-0.01"), ("123456789012345678901234567890", "123456789012345678901234567890")],
)
def test_plain_numbers(token, plain):
    assert N.canonical(token) == plain


@pytest.mark.parametrize("token, sci, auto", [("4", "4e+0", "4"), ("0.1", "1e-1", "0.1"), ("6.022e23", "6.022e+23", "6.022e+23"), ("1e20", "1e+20", "1" + "0" * 20), ("1e21", "1e+21", "1e+21"), ("1e-6", "1e-6", "0.000001"), ("1e-7", "1e-7", "1e-7"), ("0", "0", "0")])
def test_formats_of_numbers(token, sci, auto):
    assert N.canonical(token, "scientific") == sci and N.canonical(token, "auto") == auto


def test_preserved_type():
    assert [N.canonical(t, preserve_type=True) for t in ("4.0", "4", "1e2", "0.0", "1.50")] == ["4.0", "4", "100.0", "0", "1.5"]


def test_numbers_against_decimal():
    rng = random.Random(1)
    for _ in range(40_000):
        t = rng.choice(["", "-", "+"]) + rng.choice([f"{rng.randint(0, 10**rng.randint(1, 30))}", f"{rng.randint(0, 999)}.{rng.randint(0, 10**9)}", f".{rng.randint(0, 999)}", f"00{rng.randint(0, 99)}."]) + rng.choice(["", f"e{rng.randint(-30, 30)}", f"E+{rng.randint(0, 20)}"])
        out = N.canonical(t)
        with decimal.localcontext(decimal.Context(prec=200)):
            assert decimal.Decimal(out) == decimal.Decimal(t)
        assert N.canonical(out) == out and "e" not in out


def test_exponent_bomb_fails():
    with pytest.raises(JsonError):
        N.canonical("1e999999999")
    assert N.canonical("1e999999999", "scientific") == "1e+999999999"


def test_ecmascript_text():
    cases = {1e21: "1e+21", 1e20: "1" + "0" * 20, 1e-7: "1e-7", 1e-6: "0.000001", 333333333.33333329: "333333333.3333333", 5e-324: "5e-324", -0.0: "0", 123.456: "123.456", 2e23: "2e+23", -1.5: "-1.5"}
    assert {x: N.ecmascript(x) for x in cases} == cases


def test_ecmascript_round_trips_and_node():
    rng = random.Random(0xC0FFEE)
    xs = []
    while len(xs) < 50_000:
        x = struct.unpack(">d", rng.randbytes(8))[0]
        if math.isfinite(x):
            xs.append(x)
    out = [N.ecmascript(x) for x in xs]
    assert all(float(s) == x for s, x in zip(out, xs))
    try:
        js = "const b=require('fs').readFileSync(0);let o=[];for(let i=0;i<b.length;i+=8)o.push(String(b.readDoubleBE(i)));console.log(o.join('\\n'))"
        done = subprocess.run(["node", "-e", js], input=b"".join(struct.pack(">d", x) for x in xs), capture_output=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return
    if done.returncode == 0:
        assert done.stdout.decode().split() == out


# --- parser
def test_dialects():
    assert canon("{'b': True, 'a': None, 'c': [1,2,],}") == '{"a":null,"b":true,"c":[1,2]}'
    assert canon('/* h */ {"a": 1, // x\n "b": [ ]}') == '{"a":1,"b":[]}'
    assert canon("{x: 0xFF, $y: -0x10, café: +0x2A, \\u0061bc: 1}") == '{"$y":-16,"abc":1,"café":42,"x":255}'
    assert canon(r"""["\x41\v\0", 'a\'b', "l\
ine"]""") == '["A\\u000b\\u0000","a\'b","line"]'
    assert canon("\v[1\f]") == "[1]"
    assert canon(r'"😀\/\q"') == '"\U0001f600/q"'
    assert canon('{"a":1,"b":0,"a":2}') == '{"a":2,"b":0}'
    assert canon("[+4,007,.5,5.]") == "[4,7,0.5,5]"
    assert canon("0x" + "f" * 26) == str(int("f" * 26, 16))
    assert canon('"a\nb"') == '"a\\nb"'


@pytest.mark.parametrize("bad", ["", "{,}", "[1,,2]", "[1", '{"a"}', '"x', "tru", "1 2", "trueX", "-NaN", "+inf", "0x", "1e", "/* x", '{"a":1} junk', "[1]]", r'"\u12"', r'"\xZ"', "\x00", "1٠", "{1:2}"])
def test_errors(bad):
    with pytest.raises(JsonError):
        parser.parse(bad)


def test_fast_and_slow_scanners_agree():
    rng = random.Random(5)

    def make(depth):
        k = rng.randint(0, 6 if depth else 4)
        if k == 5:
            return [make(depth - 1) for _ in range(rng.randint(0, 4))]
        if k == 6:
            return {rng.choice("abcdeé") * rng.randint(1, 2): make(depth - 1) for _ in range(rng.randint(0, 4))}
        return [None, True, rng.random(), rng.randint(-99, 99), "x\n \"" * rng.randint(0, 2)][k]

    for _ in range(500):
        t = json.dumps(make(4), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        slow = parser.Scanner(t).document()
        assert parser.parse(t) == slow and dumps(slow) == dumps(parser.parse(dumps(slow)))
        assert json.loads(dumps(slow)) == json.loads(t)


def test_depth_is_not_bounded_by_the_interpreter():
    deep = "[" * 50_000 + "]" * 50_000
    assert canon(deep) == deep
    assert parser.Scanner("[[[1]]]", max_depth=4).document()
    with pytest.raises(JsonError):
        parser.Scanner("[[[1]]]", max_depth=2).document()


def test_nonfinite_policies():
    for t, s in (("NaN", "NaN"), ("-Infinity", "-Infinity"), ("inf", "Infinity"), ("nan", "NaN"), ("-inf", "-Infinity"), ("Inf", "Infinity"), ("+Infinity", "Infinity")):
        assert canon(f"[{t}]", nan="string") == f'["{s}"]' and canon(f"[{t}]", nan="null") == "[null]"
    with pytest.raises(JsonError, match=r"\.a\[1\]"):
        canon('{"a":[1,NaN]}')


def test_strict_duplicates():
    with pytest.raises(JsonError, match="duplicate key 'a'"):
        canon('{"a":1,"a":2}', strict_dupes=True)


def test_framing():
    assert canon(' {"b":1,"a":2}\n\n[1.0]\r\n3', ndjson=True) == '{"a":2,"b":1}\n[1]\n3'
    assert canon('\x1e{"a":1}\n\x1e[2] 3"x"', json_seq=True) == '{"a":1}\n[2]\n3\n"x"'
    assert canon('"a b"\n1', ndjson=True) == '"a b"\n1'
    assert canon("[1]", newline=True) == "[1]\n"
    assert canon('{"a":1}\n{"a":2}', ndjson=True, pointer="/a") == "1\n2"


def test_encodings():
    for e in ("utf-8", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
        assert canon('{"é":"\U0001f600"}'.encode(e) if e == "utf-8" else text.OUTPUTS[e] + '{"é":"\U0001f600"}'.encode(e)) == '{"é":"\U0001f600"}'
        raw = canonicalize("['é']", output_encoding=e, bom=True)
        assert raw.startswith(text.OUTPUTS[e]) and text.decode(raw) == '["é"]'
    assert canonicalize('"é"', output_encoding="latin-1", bom=True) == b'"\xe9"'
    assert canonicalize("[1]".encode("utf-16-le"), encoding="utf-16-le") == b"[1]"
    for bad in (lambda: canonicalize('"中"', output_encoding="latin-1"), lambda: canonicalize(b"\xff"), lambda: canonicalize(r'"\ud800"'), lambda: Options(output_encoding="x")):
        with pytest.raises(JsonError):
            bad()


def test_salvage():
    def s(t):
        v, lost = parser.salvage(t)
        return dumps(v), [m for _, _, m in lost]

    assert s('{"a":1,"b":@,"c":[1,2,x,3]} tail') == ('{"a":1,"c":[1,2,3]}', ["dropped malformed object member", "dropped malformed array element", "dropped trailing data after the value"])
    assert s('{"a":[1,2') == ('{"a":[1,2]}', ["unterminated array at end of input", "unterminated object at end of input"])
    assert s("@") == ("null", ["could not parse a value; using null", "dropped trailing data after the value"])
    assert s('[1 2,"a,b" x,3]') == ('[1,"a,b",3]', ["unexpected token in array", "unexpected token in array"])
    assert s('{"a" 1,"b":"x') [0] == "{}"
    assert s("") == ("null", ["could not parse a value; using null"])
    rng = random.Random(0xF017CE)
    base = '{"a":[1,2,{"b":"x,y"}],"c":{"d":null,"e":[true,"\\"q"]},"f":1.5e3}'
    for _ in range(4000):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(t))
            t[i] = rng.choice(["", t[i] * 2, rng.choice('{}[],:"x\\/*')])
        t = "".join(t)
        v, lost = parser.salvage(t)
        json.loads(dumps(v, nan="null"))
        if not lost:
            assert dumps(v) == dumps(parser.parse(t))
    assert canon('{"a":@,"b":2}', force=True) == '{"b":2}'
    assert canonicalize('{"a":@,"b":2}', force=True, output_format="cbor") == b"\xa1\x61b\x02"


# --- JCS
def test_jcs():
    assert canon('{"￿":1,"\U0001f600":2,"a":[4.0,1e21,9007199254740993]}', jcs=True) == '{"a":[4,1e+21,9007199254740992],"\U0001f600":2,"￿":1}'
    assert canon('{"￿":1,"\U0001f600":2}') == '{"￿":1,"\U0001f600":2}'
    r = Canonicalizer(Options(jcs=True, nan="null"))('{"a":[9007199254740993,0.1,1e400]}')
    assert r.warnings == [".a[0]: 9007199254740993 → 9007199254740992 (IEEE-754 rounding; not reversible)", ".a[2]: 1e400 exceeds binary64 range (no JCS parity)"]
    assert jcs_changes(parser.parse("9007199254740993"))[0].startswith("<root>: ")
    assert Canonicalizer(Options(jcs=True, ndjson=True))("1\n9007199254740993").warnings[0].startswith("line 2: ")
    assert warning_log([]).startswith("conversion is exact") and "1 number(s)" in warning_log(["x"])


# --- binary forms
def test_cbor():
    h = lambda t, **o: canonicalize(t, output_format="cbor", **o).hex()
    assert [h(t) for t in ("0", "23", "24", "255", "256", "65535", "65536", "4294967296", "-1", "-24", "-25")] == ["00", "17", "1818", "18ff", "190100", "19ffff", "1a00010000", "1b0000000100000000", "20", "37", "3818"]
    assert h("18446744073709551616") == "c249010000000000000000" and h("-18446744073709551617") == "c349010000000000000000"
    assert h("1.5") == "f93e00" and h("100000.5") == "fa47c35040" and h("0.1") == "fb3fb999999999999a"
    assert h('{"aa":1,"b":2}') == "a261620262616101" and h("[true,false,null,'x']") == "84f5f4f66178"
    assert h("NaN", nan="string") == "634e614e"
    for t in ("123456789012345678901234567890", "-0.25", '{"a":[1,{"b":"é"}]}', "[1e-7]"):
        assert canon(canonicalize(t, output_format="cbor"), input_format="cbor") == canon(t)
    assert canon(b"\x42ab", input_format="cbor") == '"YWI="' and canon(b"\xd8\x20\x61x", input_format="cbor") == '"x"' and canon(b"\xf7", input_format="cbor") == "null"
    for bad in (b"", b"\x5f", b"\xa1\x01\x02", b"\x00\x00", b"\x61", b"\xc2\x01", b"\xfc", b"\x61\xff"):
        with pytest.raises(JsonError):
            binary.decode_cbor(bad)


def test_float16_codec_over_all_patterns():
    for bits in range(65536):
        raw = struct.pack(">H", bits)
        x = struct.unpack(">e", raw)[0]
        v = binary.decode_cbor(b"\xf9" + raw)
        if math.isfinite(x):
            assert float(v) == x
            if x != int(x):
                assert binary.Cbor.real(x) == b"\xf9" + raw
        else:
            assert isinstance(v, NonFinite)


def test_msgpack():
    h = lambda t: canonicalize(t, output_format="msgpack").hex()
    assert [h(t) for t in ("0", "127", "128", "255", "256", "65536", "4294967296", "-1", "-32", "-33", "-128", "-129", "-32769", "-2147483649")] == ["00", "7f", "cc80", "ccff", "cd0100", "ce00010000", "cf0000000100000000", "ff", "e0", "d0df", "d080", "d1ff7f", "d2ffff7fff", "d3ffffffff7fffffff"]
    assert h("1.5") == "ca3fc00000" and h("0.1") == "cb3fb999999999999a" and h('{"b":1,"a":[]}') == "82a16190a16201" and h("18446744073709551616") == "ca5f800000"
    long_ = "x" * 40
    assert h(f'"{long_}"') == "d928" + "78" * 40
    for t in ("[1,-5,70000,1.5,null,true]", '{"k":"' + "y" * 300 + '","l":[' + ",".join("1" * 20) + "]}"):
        assert canon(canonicalize(t, output_format="msgpack"), input_format="msgpack") == canon(t)
    assert canon(b"\xc4\x02ab", input_format="msgpack") == '"YWI="'
    for bad in (b"\xc1", b"\xd4\x00\x00", b"\x81\x01\x02", b"\x00\x00", b"\xda\x00"):
        with pytest.raises(JsonError):
            binary.decode_msgpack(bad)


def test_jdata():
    t = '{"m":{"_ArrayType_":"double","_ArraySize_":[2,3],"_ArrayData_":[1,2,3,4,5,6.0]},"v":{"_ArrayType_":"u","_ArraySize_":2,"_ArrayData_":[7,8]},"s":"x"}'
    assert canon(t, input_format="jdata") == '{"m":[[1,2,3],[4,5,6]],"s":"x","v":[7,8]}'
    assert dumps(jdata.expand(parser.parse('{"_ArrayType_":"d","_ArraySize_":[2,2,2],"_ArrayData_":[1,2,3,4,5,6,7,8]}'))) == "[[[1,2],[3,4]],[[5,6],[7,8]]]"
    for bad in ('{"_ArrayZipData_":1}', '{"_ArrayType_":"d","_ArraySize_":[2],"_ArrayData_":[1]}', '{"_ArrayType_":"d","_ArraySize_":"x","_ArrayData_":[1]}'):
        with pytest.raises(JsonError):
            jdata.expand(parser.parse(bad))


# --- pointer and patch
def test_pointer():
    v = parser.parse('{"a":{"b/c":[10,20],"m~n":1},"":0}')
    assert [str(pointer.get(v, p)) for p in ("/a/b~1c/1", "/a/m~0n", "/")] == ["20", "1", "0"] and pointer.get(v, "") is v
    for bad in ("x", "/a/x", "/a/b~1c/01", "/a/b~1c/2", "/a/m~0n/x", "/a/b~1c/-"):
        with pytest.raises(JsonError):
            pointer.get(v, bad)


def test_patch():
    doc = parser.parse('{"a":[1,2],"b":{"c":3}}')
    before = dumps(doc)
    p = lambda ops: dumps(pointer.patch(doc, parser.parse(ops)))
    assert p('[{"op":"add","path":"/a/1","value":9},{"op":"add","path":"/a/-","value":8}]') == '{"a":[1,9,2,8],"b":{"c":3}}'
    assert p('[{"op":"move","from":"/b/c","path":"/d"},{"op":"copy","from":"/a","path":"/e"},{"op":"replace","path":"/a/0","value":7}]') == '{"a":[7,2],"b":{},"d":3,"e":[1,2]}'
    assert p('[{"op":"test","path":"/a/0","value":1.0},{"op":"remove","path":"/a/0"}]') == '{"a":[2],"b":{"c":3}}'
    assert p('[{"op":"replace","path":"","value":1}]') == "1" and dumps(doc) == before
    for bad in ('{"op":1}', '[{"op":"add"}]', '[{"op":"test","path":"/a/0","value":2}]', '[{"op":"remove","path":""}]', '[{"op":"replace","path":"/x","value":1}]', '[{"op":"add","path":"/a/5","value":1}]', '[{"op":"bad","path":""}]', '[{"op":"add","path":"/a"}]'):
        with pytest.raises(JsonError):
            p(bad)


def test_merge_patch():
    m = lambda a, b: dumps(pointer.merge(parser.parse(a), parser.parse(b)))
    assert m('{"a":{"b":1,"c":2},"d":3}', '{"a":{"b":null,"e":[1]},"d":4}') == '{"a":{"c":2,"e":[1]},"d":4}'
    assert m("[1]", '{"a":{"b":null}}') == '{"a":{}}' and m('{"a":1}', "[2]") == "[2]"


# --- reports
def test_lint():
    issues = reports.lint(b"\xef\xbb\xbf{'b':1,/*x*/a:[0xFF,+1,.5,True,NaN],b:4.0,}")
    assert [c for _, c, _ in issues] == ["bom", "single-quote", "comment", "unquoted-key", "hex-number", "number-syntax", "number-syntax", "python-literal", "non-finite", "unquoted-key", "duplicate-key", "trailing-comma", "key-order", "number", "number", "number"]
    assert issues[0][0] == "1:1" and issues[-1] == ("$.a[2]", "number", ".5 → 0.5") or issues[-1][1] == "number"
    assert reports.lint('{"a":1,\n "b":[4.0]}') == [("$.b[0]", "number", "4.0 → 4")] and reports.lint('{"a":"é"}') == []
    assert reports.lint('\n "éé" // x')[0][0] == "2:7"
    assert reports.render(reports.lint("[4.0]")).splitlines()[-1] == "1 issue(s), not canonical"


def test_ijson():
    assert reports.ijson('{"a":4.0,"b":0.1,"c":9007199254740991}') == []
    out = reports.ijson(r'{"a":9007199254740992,"b":1e400,"c":0.12345678901234567890123,"\ud800":"\udc00"}')
    assert [(a, c) for a, c, _ in out] == [("$.a", "number"), ("$.b", "number"), ("$.c", "number"), ("$.\ud800", "surrogate"), ("$.\ud800", "surrogate")]


def test_geojson():
    g = lambda t: [c for _, c, _ in reports.geojson(t)]
    assert g('{"type":"Point","coordinates":[1,2]}') == [] and g('{"type":"Point","coordinates":[1]}') == ["geojson-coordinates"]
    assert g('{"type":"Polygon","coordinates":[[[0,0],[0,1],[1,1],[0,0]]]}') == ["geojson-winding"]
    assert g('{"type":"Polygon","coordinates":[[[0,0],[9,0],[9,9],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}') == ["geojson-winding"]
    assert g('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,2]]]}') == ["geojson-ring"]
    assert g('{"type":"FeatureCollection","crs":1,"bbox":[1,2],"features":[{"type":"Feature"}]}') == ["geojson-crs", "geojson-bbox", "geojson-member", "geojson-member"]
    assert g('{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":[[1,2]]},3]}') == ["geojson-coordinates", "geojson-type"]
    assert g("[]") == ["geojson-type"] and g('{"type":"X"}') == ["geojson-type"] and g('{"type":"MultiPoint","coordinates":5}') == []


def test_diff():
    d = lambda a, b, **o: reports.diff(parser.parse(a), parser.parse(b), **o)
    assert d('{"a":4.0,"b":[1,2]}', '{"b":[1,2],"a":4}') == []
    assert d('{"a":1,"b":[1,2],"c":{}}', '{"a":"1","b":[1,3,4],"d":null}') == ['~ $.a: 1 => "1"', "~ $.b[1]: 2 => 3", "+ $.b[2]: 4", "- $.c: {}", "+ $.d: null"]


# --- regular expressions and formats
def test_regex_subset():
    for p, t, want in [("^a.c$", "abc", True), ("^a.c$", "a\nc", False), ("x$", "x\n", False), ("[\\d]", "d", True), ("[\\d]", "1", False), ("a{,2}b", "aab", True), ("^(?:ab|c)+$", "abcab", True), ("a**", "aa*", True), ("[^]", "x", True), ("[]", "x", False), ("^\\w+$", "é", False), ("[b-a]", "a", False), ("\\s", "\x0b", True)]:
        assert regex.search(p, t) is want, (p, t)
    for bad in ("(", "[a", "a{1", "\\", "a{x}", ")", "a{3,1}"):
        with pytest.raises(JsonError):
            regex.search(bad, "")


def test_regex_against_re():
    rng = random.Random(0x2024)
    atoms = ["a", "b", "c", ".", "[ab]", "[^a]", "\\d", "\\w", "(a|b)", "(?:bc)", "((ab)?)", "1"]
    for _ in range(40_000):
        p = "".join(rng.choice(atoms) + rng.choice(["", "", "*", "+", "?", "{1,2}", "{2}"]) for _ in range(rng.randint(1, 4)))
        p = rng.choice(["", "^"]) + p + rng.choice(["", "$"])
        t = "".join(rng.choice("abc1 \n") for _ in range(rng.randint(0, 6)))
        assert regex.search(p, t) == bool(re.search(p.replace("$", "\\Z"), t, re.A)), (p, t)


def test_formats():
    good = {"date": ["2024-02-31"], "time": ["23:59:59", "23:59:59.5Z", "00:00:00+01:30"], "date-time": ["2024-01-01T00:00:00Z", "2024-01-01t00:00:00"], "email": ["a.b+c@x.org"], "hostname": ["a-b.example"], "ipv4": ["0.10.255.1"], "ipv6": ["::", "::1", "1:2:3:4:5:6:7:8", "1::8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4"], "uri": ["http://x", "urn:a"], "uuid": ["123e4567-e89b-12d3-a456-426614174000"], "json-pointer": ["", "/a~0/~1"], "regex": ["a(b)"], "other": ["anything"]}
    bad = {"date": ["2024-13-01", "2024-1-01", "2024-01-32"], "time": ["24:00:00", "00:00:60", "00:00:00.", "00:00"], "date-time": ["2024-01-01 00:00:00Z"], "email": ["a", "a@@b", "@b", "a b@c", "a@-b"], "hostname": ["", "-a", "a..b", "a_b", "x" * 64], "ipv4": ["1.2.3", "01.2.3.4", "256.1.1.1"], "ipv6": ["1::2::3", "1:2:3:4:5:6:7", "12345::", "1:2:3:4:5:6:7:8:9", ":1", "1:2:3:4:5:6:7::8"], "uri": ["x", "1a:b", "/a"], "uuid": ["123e4567e89b12d3a456426614174000"], "json-pointer": ["a", "/~2", "/a~"], "regex": ["("]}
    for name, values in good.items():
        assert all(formats.valid(name, v) for v in values), name
    for name, values in bad.items():
        for v in values:
            assert not formats.valid(name, v), (name, v)


# --- validators
def errs(schema, instance, **o):
    return [(a, c) for a, _, c in jsonschema.Schema(schema, **o).errors(parser.parse(instance))]


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ('{"type":["integer","null"]}', ["1", "2.0", "null"], ["1.5", '"x"']),
        ('{"enum":[1,"a",{"b":2}]}', ["1.0", '{"b":2}'], ["2"]),
        ('{"const":{"a":1}}', ['{"a":1.0}'], ["1"]),
        ('{"multipleOf":0.5,"minimum":1,"exclusiveMaximum":3}', ["1", "2.5"], ["0.5", "3", "1.2"]),
        ('{"minLength":2,"maxLength":3,"pattern":"^a"}', ['"ab"', "5"], ['"a"', '"abcd"', '"ba"']),
        ('{"prefixItems":[{"type":"string"}],"items":{"type":"number"}}', ['["a",1]', "[]"], ["[1]", '["a","b"]']),
        ('{"minItems":1,"maxItems":2,"uniqueItems":true}', ["[1,2]"], ["[]", "[1,2,3]", "[1,1.0]"]),
        ('{"contains":{"type":"string"},"minContains":1,"maxContains":2}', ['["a"]'], ["[1]", '["a","b","c"]']),
        ('{"properties":{"a":{"type":"string"}},"patternProperties":{"^x":{"type":"number"}},"additionalProperties":false}', ['{"a":"b","x1":2}'], ['{"a":1}', '{"x":"y"}', '{"z":1}']),
        ('{"required":["a"],"minProperties":1,"maxProperties":2,"propertyNames":{"maxLength":2}}', ['{"a":1}'], ['{"b":1}', '{"a":1,"abc":1}', '{"a":1,"b":1,"c":1}']),
        ('{"dependentRequired":{"a":["b"]},"dependentSchemas":{"c":{"required":["d"]}}}', ['{"a":1,"b":1}'], ['{"a":1}', '{"c":1}']),
        ('{"allOf":[{"minimum":1}],"anyOf":[{"maximum":5},{"minimum":10}],"not":{"const":3}}', ["2", "12"], ["0", "7", "3"]),
        ('{"oneOf":[{"minimum":1},{"minimum":5}]}', ["2"], ["7", "0"]),
        ('{"if":{"type":"string"},"then":{"minLength":2},"else":{"minimum":3}}', ['"ab"', "3"], ['"a"', "1"]),
        ('{"$ref":"#/$defs/n","$defs":{"n":{"type":"object","properties":{"next":{"$ref":"#/$defs/n"}},"additionalProperties":false}}}', ['{"next":{"next":{}}}'], ['{"next":{"x":1}}']),
        ('{"$defs":{"n":{"$anchor":"here","type":"string"}},"properties":{"a":{"$ref":"#here"}}}', ['{"a":"x"}'], ['{"a":1}']),
        ('{"properties":{"a":true},"allOf":[{"properties":{"b":true}}],"unevaluatedProperties":false}', ['{"a":1,"b":2}'], ['{"c":1}']),
        ('{"prefixItems":[true],"unevaluatedItems":{"type":"string"}}', ['[1,"a"]'], ["[1,2]"]),
        ('{"$schema":"http://json-schema.org/draft-07/schema#","items":[{"type":"string"}],"additionalItems":false,"dependencies":{"a":["b"]}}', ['["x"]'], ['["x",1]', "[1]", '{"a":1}']),
        ("false", [], ["1"]),
        ("true", ["1"], []),
    ],
)
def test_json_schema(schema, good, bad):
    s = jsonschema.Schema(schema)
    for g in good:
        assert s.errors(parser.parse(g)) == [] and s.is_valid(parser.parse(g))
    for b in bad:
        assert s.errors(parser.parse(b)) and not s.is_valid(parser.parse(b))


def test_json_schema_reports():
    s = '{"type":"object","properties":{"a":{"type":"integer","minimum":1},"b~/":{"enum":[1]}},"required":["z"],"additionalProperties":false}'
    assert errs(s, '{"a":0,"b~/":2,"c":1}') == [("/a", "minimum not met"), ("/b~0~1", "enum: value not in the allowed set"), ("/c", "additionalProperties: not allowed"), ("(root)", "required: missing property 'z'")]
    assert errs(s, "[]") == [("(root)", "type: expected object")]
    assert errs('{"format":"ipv4"}', '"x"') == [] and errs('{"format":"ipv4"}', '"x"', assert_format=True) == [("(root)", "format: not a valid ipv4")]
    with pytest.raises(JsonError):
        errs('{"$ref":"http://x"}', "1")
    assert errs('{"items":{"minLength":2},"minItems":3}', '["a"]') == [("/0", "minLength not met"), ("(root)", "minItems not met")]


def test_jtd():
    e = lambda s, i: [(a, m) for a, _, m in jtd.Schema(s).errors(parser.parse(i))]
    s = '{"properties":{"id":{"type":"uint8"},"t":{"type":"timestamp"}},"optionalProperties":{"l":{"elements":{"type":"string"}},"m":{"values":{"type":"float64"}},"r":{"ref":"n"}},"definitions":{"n":{"enum":["x"],"nullable":true}}}'
    assert e(s, '{"id":1.0,"t":"2024-01-01T00:00:00Z","l":["a"],"m":{"k":1.5},"r":null}') == []
    assert e(s, '{"id":256,"t":"x","l":[1],"m":{"k":"v"},"r":"y","z":1}') == [("/id", "schema /properties/id/type"), ("/t", "schema /properties/t/type"), ("/l/0", "schema /optionalProperties/l/elements/type"), ("/m/k", "schema /optionalProperties/m/values/type"), ("/r", "schema /definitions/n/enum"), ("/z", "schema (root)")]
    assert e(s, '{"id":1}') == [("(root)", "schema /properties/t")] and e(s, "1") == [("(root)", "schema /properties")]
    d = '{"discriminator":"k","mapping":{"a":{"properties":{"v":{"type":"int8"}}}}}'
    assert e(d, '{"k":"a","v":-128}') == [] and e(d, '{"k":"b"}') == [("/k", "schema /mapping")] and e(d, "{}") == [("(root)", "schema /discriminator")] and e("{}", "[1]") == []
    with pytest.raises(JsonError):
        e('{"ref":"x"}', "1")


def test_cddl():
    e = lambda s, i: [(a, m) for a, _, m in cddl.Schema(s).errors(parser.parse(i))]
    s = 'doc = { name: tstr, age: 0..150, ? tags: [* text], kind: "a" / "b", "x y": [2*3 int, ? nil] } ; c\n'
    assert e(s, '{"name":"n","age":3,"tags":[],"kind":"b","x y":[1,2,null]}') == []
    assert e(s, '{"name":1,"age":200,"tags":[1],"kind":"c","x y":[1],"q":0}') == [("$.name", "expected tstr"), ("$.age", "expected 0..150"), ("$.tags[0]", "unexpected extra array element"), ("$.kind", 'expected "a" / "b"'), ("$.x y", "expected int"), ("$.q", "unexpected member")]
    assert e(s, "{}")[0] == ("$", "missing required member 'name'") and e(s, "1") == [("$", "expected object")]
    assert e("a = uint / nint / float", "-1") == [] and e("a = bool", "null") == [("$", "expected bool")] and e("a = -1.50", "-1.5") == []
    for bad in ("", "a = ", "a = { x }", "= b", "a = b", "a = { tstr => any }"):
        with pytest.raises(JsonError):
            e(bad, "1")


def test_no_pattern_is_exponential():
    assert not regex.search("(a+)+$", "a" * 5000 + "b") and regex.search("(a|a)*(b|a)*c", "a" * 5000 + "c")
    assert not regex.search("(x*)*(x*)*y", "x" * 3000) and regex.search("^(a?){30}a{30}$", "a" * 30)
    assert regex.search("$^", "") and not regex.search("$^", "a") and regex.search("a|$", "bbb") and not regex.search("^b", "ab")
    with pytest.raises(JsonError):
        regex.compiled("((a{1000}){1000}){1000}")
