"""The single-document interface, the command line and the pandas accessor."""

import hashlib

import pytest

import canonframe as C
from canonframe.__main__ import main


@pytest.fixture
def doc(tmp_path):
    def write(name, data):
        p = tmp_path / name
        p.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(p)

    return write


def test_names():
    assert C.canonicalize("{b:1,a:2.0}") == b'{"a":2,"b":1}' and C.load_ndjson("1\n\n2") == ["1", "2"] and C.dumps(C.load_stream("1[2]")) == "[1,[2]]"
    assert C.diff("[1]", b"[1.0,2]") == ["+ $[1]: 2"] and C.decode_cbor(C.encode_cbor(C.loads("[1]"))) == ["1"] and C.decode_msgpack(C.encode_msgpack(None)) is None
    assert C.validate_jsonschema('{"type":"string"}', "1") and not C.validate_jtd("{}", "1") and not C.validate_cddl("a = int", "1")
    assert all(hasattr(C, n) for n in C.__all__)


def test_command_line(doc, capsysbinary, tmp_path):
    a = doc("a.json", "{b: 1.0, a: [0xFF]}")
    out = lambda: capsysbinary.readouterr().out
    assert main([a]) == 0 and out() == b'{"a":[255],"b":1}'
    assert main([a, "--check"]) == 1 and main([doc("c.json", "[1]"), "--check"]) == 0
    assert main([a, "--sha256"]) == 0 and out().strip().decode() == hashlib.sha256(b'{"a":[255],"b":1}').hexdigest()
    assert main([a, "--lint"]) == 1 and b"unquoted-key" in out() and main([a, "--ijson"]) == 1
    assert main([a, "--to", "cbor", "-o", str(tmp_path / "x")]) == 0 and main([str(tmp_path / "x"), "--from", "cbor", "--newline"]) == 0
    out()
    assert main([a, "--pointer", "/a/0"]) == 0 and out() == b"255"
    assert main([a, "--patch", doc("p", '[{"op":"remove","path":"/a"}]')]) == 0 and out() == b'{"b":1}'
    assert main([a, "--merge-patch", doc("m", '{"b":null}')]) == 0 and out() == b'{"a":[255]}'
    assert main([a, "--diff", doc("d", '{"a":[255],"b":2}')]) == 1 and out() == b"~ $.b: 1 => 2\n"
    assert main([a, "--schema", doc("s", '{"required":["z"]}')]) == 1 and main([a, "--validate", doc("t", "{}")]) == 0 and main([a, "--cddl", doc("u", "r = {a: [* int], b: int}")]) == 0
    assert main([doc("g", '{"type":"Point","coordinates":[1,2]}'), "--geojson"]) == 0
    assert main([doc("bad", "[1,@]")]) == 1 and main([doc("bad", "[1,@]"), "--force"]) == 0 and b"dropped malformed" in capsysbinary.readouterr().err
    assert main([a, "-q"]) == 2 and main(["/no/such/file"]) == 2
    big = doc("n", "9007199254740993")
    assert main([big, "--jcs", "-q", "--log", str(tmp_path / "log")]) == 0 and "IEEE-754" in (tmp_path / "log").read_text()
    assert main([a, "--output-encoding", "utf-16-le", "--bom"]) == 0 and out().startswith(b'9007199254740992\xff\xfe{')


def test_pandas_accessor():
    pd = pytest.importorskip("pandas")
    import canonframe.pandas_accessor  # noqa: F401

    df = pd.DataFrame({"b": [1.0, 2.5], "a": ["x", None]})
    assert df.canonframe.to_canonical_str() == '{"a":{"0":"x","1":null},"b":{"0":1,"1":2.5}}' and len(df.canonframe.sha256()) == 64
    assert df["b"].canonframe.to_canonical() == b'{"0":1,"1":2.5}' and df[["a", "b"]].canonframe.sha256() == df.canonframe.sha256()
