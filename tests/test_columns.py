"""Column functions, operators, sources and streams on Spark, against kernels and literal results."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canonframe.functions import documents as D
from canonframe.functions.formats import format_ok
from canonframe.functions.numbers import canon_number, is_number_token, try_canon_number
from canonframe.functions.strings import decode_bytes, enc_string, encode_output, sort_keys
from canonframe.kernel import formats, numbers
from canonframe.kernel.parser import parse
from canonframe.kernel.pointer import merge
from canonframe.kernel.serialize import string
from canonframe.kernel.values import JsonError
from canonframe.operators import profile
from canonframe.operators.diff import diff_tables
from canonframe.operators.nodes import key_order_issues, nodes
from canonframe.operators.typed import canonical_columns, canonical_row, from_pandas
from canonframe.sources import files
from canonframe.streaming.documents import canonical_stream, read_lines, write_stream


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, doc string")


def column(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


def test_catalyst_numbers_match_the_kernel(spark):
    rng = random.Random(3)
    tokens = [rng.choice(["", "-", "+"]) + rng.choice([str(rng.randint(0, 10**20)), f"{rng.randint(0, 99)}.{rng.randint(0, 10**6)}000", f".{rng.randint(0, 99)}", "000", "00.0", f"{rng.randint(0, 9)}."]) + rng.choice(["", f"e{rng.randint(-25, 25)}", "E+3"]) for _ in range(2000)]
    df = texts(spark, *tokens)
    for f in ("plain", "scientific", "auto"):
        assert column(df, canon_number("doc", f)) == [numbers.canonical(t, f) for t in tokens]
    assert column(df, canon_number("doc", preserve_type=True)) == [numbers.canonical(t, preserve_type=True) for t in tokens]
    bad = texts(spark, "1x", "", "1\n", None, "--1", ".", "1e")
    assert column(bad, try_canon_number("doc")) == [None] * 7 and column(bad, is_number_token("doc")) == [False, False, False, None, False, False, False]
    with pytest.raises(Exception, match="invalid number"):
        column(bad, canon_number("doc"))


def test_catalyst_strings_match_the_kernel(spark):
    values = ["", 'a"\\/é\U0001f600', "".join(map(chr, range(1, 40))), "\x7f\x1f", "a\nb\tc"]
    assert column(texts(spark, *values), enc_string("doc")) == [string(v) for v in values]
    keys = spark.createDataFrame([(0, ["￿", "\U0001f600", "a", "é"])], "id long, k array<string>")
    assert column(keys, sort_keys("k")) == [["a", "é", "￿", "\U0001f600"]] and column(keys, sort_keys("k", True)) == [["a", "é", "\U0001f600", "￿"]]


def test_encodings(spark):
    from canonframe.kernel import text

    df = texts(spark, "aé\U0001f600", "", "x")
    for e in ("utf-8", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
        for bom in (False, True):
            assert [bytes(b) for b in column(df, encode_output("doc", e, bom))] == [text.encode(v, e, bom) for v in ("aé\U0001f600", "", "x")]
        assert column(df, decode_bytes(encode_output("doc", e, True))) == ["aé\U0001f600", "", "x"]


def test_documents(spark):
    df = texts(spark, '{"b":1.0,"a":NaN}', "[1", None, "{x:0x10}")
    assert column(df, D.try_canonicalize("doc", nan="null")) == ['{"a":null,"b":1}', None, None, '{"x":16}']
    with pytest.raises(Exception, match="expected ',' or ']'"):
        column(df, D.canonicalize("doc", nan="null"))
    r = column(df, D.canonicalize_report("doc", force=True, jcs=True))
    assert r[0].error.startswith("non-finite") and bytes(r[1].canon) == b"[1]" and r[1].recoveries[0].message.startswith("unterminated") and r[2] is None
    assert column(df, D.is_canonical(F.lit("[1]"))) == [True] * 4 and column(df, D.is_canonical("doc")) == [False, False, None, False]
    assert column(df, D.salvage("doc"))[1].canon == "[1]"
    assert [i.category for i in column(df, D.lint("doc"))[1]] == ["syntax"]
    good = texts(spark, '{"a":[1,{"b":2}]}')
    assert column(good, D.json_pointer("doc", "/a/1/b")) == ["2"] and column(good, D.json_pointer("doc", F.lit("/a/0"))) == ["1"] and column(good, D.try_json_pointer("doc", "/z")) == [None]
    assert column(good, D.json_patch("doc", '[{"op":"remove","path":"/a/0"}]')) == ['{"a":[{"b":2}]}'] and column(good, D.merge_patch("doc", F.lit('{"a":null}'))) == ["{}"]
    assert bytes(column(good, D.to_cbor("doc"))[0]).hex() == "a161618201a1616202" and column(good, D.from_msgpack(D.to_msgpack("doc"))) == ['{"a":[1,{"b":2}]}']
    assert column(good, D.diff_documents("doc", F.lit('{"a":[1]}'))) == [['- $.a[1]: {"b":2}']]
    assert column(good, D.is_valid_schema("doc", '{"required":["a"]}')) == [True] and column(good, D.is_valid_jtd("doc", '{"properties":{"b":{}}}')) == [False] and column(good, D.is_valid_cddl("doc", "a = { a: [* any] }")) == [True]
    with pytest.raises(ValueError):
        D.schema_errors("doc", '{"$ref":1')
    assert len(column(good, D.content_hash("doc"))[0]) == 64
    assert column(texts(spark, "9007199254740993"), D.jcs_warnings("doc")) == [["<root>: 9007199254740993 → 9007199254740992 (IEEE-754 rounding; not reversible)"]]


def test_formats_match_the_kernel(spark):
    values = ["2024-01-31", "2024-13-01", "12:00:00Z", "2024-01-01T00:00:00Z", "a@b.c", "a b@c", "1.2.3.4", "01.2.3.4", "x.y", "-x", "urn:x", "urn:x\n", "/a~0", "/a~2", "", "123e4567-e89b-12d3-a456-426614174000", "1.2.3.4\n"]
    df = texts(spark, *values)
    for name in formats.PATTERNS:
        assert column(df, format_ok("doc", name)) == [formats.valid(name, v) for v in values], name


def test_nodes_and_lint(spark):
    df = texts(spark, '{"b":[1,{"c":null}],"a":"x"}', None, "5")
    rows = [tuple(r) for r in nodes(df, "doc", "id").orderBy("id", "node_id").collect()]
    assert [(r[1], r[2], r[4], r[7], r[8], r[10]) for r in rows[:6]] == [(0, None, "$", "object", None, 5), (1, 0, "$.b", "array", None, 4), (2, 1, "$.b[0]", "number", "1", 2), (3, 1, "$.b[1]", "object", None, 4), (4, 3, "$.b[1].c", "null", "null", 4), (5, 0, "$.a", "string", '"x"', 5)]
    assert len(rows) == 7 and [r.loc for r in key_order_issues(nodes(df, "doc", "id"), "id").collect()] == ["$"]


def test_diff_tables(spark):
    a, b = texts(spark, '{"x":{"y":1},"z":[1,2]}', "1", "[1]"), texts(spark, '{"x":{"y":1.0},"z":[1,3,4]}', "[1]", "[1.0]")
    odd = diff_tables(texts(spark, '{"a.b":1,"a":{"b":1},"/~":[0]}'), texts(spark, '{"a.b":2,"a":{"b":3},"/~":{"0":0}}'), "doc", "id")
    assert sorted((r.path, r.old, r.new) for r in odd.collect()) == [("$./~", "[0]", '{"0":0}'), ("$.a.b", "1", "2"), ("$.a.b", "1", "3")]
    sides = diff_tables(texts(spark, "[1, 2]", None, '{"k": {"z": 1.0, "a": []}}'), texts(spark, None, '{"b":1}', "{}"), "doc", "id")
    assert sorted(map(tuple, sides.collect())) == [(0, "-", "$", "[1,2]", None), (1, "+", "$", None, '{"b":1}'), (2, "-", "$.k", '{"a":[],"z":1}', None)]
    got = sorted((r.id, r.op, r.path, r.old or "", r.new or "") for r in diff_tables(a, b, "doc", "id").collect())
    assert got == [(0, "+", "$.z[2]", "", "4"), (0, "~", "$.z[1]", "2", "3"), (1, "~", "$", "1", "[1]")]


def test_profile_and_typed(spark):
    df = texts(spark, '{"a":1.0}', '{ "a" : 1 }', "[]")
    assert sorted((r.first_id, r.n) for r in profile.deduplicate(df, "doc", "id").collect()) == [(0, 2), (2, 1)]
    t = spark.createDataFrame([(1, "x\"", 1.50, True, None, [1, 2], 2e23)], "b long, a string, c double, d boolean, e string, f array<int>, g double")
    assert t.select(canonical_row(t)).first()[0] == '{"a":"x\\"","b":1,"c":1.5,"d":true,"e":null,"f":[1,2],"g":2' + "0" * 23 + "}"
    assert canonical_columns(spark.createDataFrame([(1, 2), (0, 3)], "i int, v int"), "i").first()[0] == '{"v":{"0":3,"1":2}}'
    assert from_pandas({"b": 1.0, "a": [None]}) == b'{"a":[null],"b":1}'


def test_huge_exponents(spark):
    nines, rng = "9" * 18, random.Random(8)
    tokens = ["1e99999999999", "1e2147483647", "12e-99999999999999999999", f"123e{nines}", f"0.01e-1{'0' * 18}", f"1234e-1{'0' * 18}", "-0e" + "9" * 5000, "1e" + "9" * 5000, "1e10000001", "1e-10000001", "x", "1|2|3|4", "", "1e" + "0" * 30 + "7", "7."]
    tokens += [f"{rng.choice(['1', '-12', '0.05', '1000', '.00700'])}e{rng.choice(['', '-', '+'])}{rng.choice('98') * rng.randint(15, 40)}" for _ in range(300)]
    for f in ("plain", "scientific", "auto"):
        want = []
        for t in tokens:
            try:
                want.append(numbers.canonical(t, f))
            except JsonError:
                want.append(None)
        assert column(texts(spark, *tokens), try_canon_number("doc", f)) == want
    for t in ("1e2147483647", "x", "1e" + "9" * 5000):
        with pytest.raises(Exception, match="number"):
            column(texts(spark, t), canon_number("doc"))
    assert numbers.canonical("1e99999999999", "scientific") == "1e+99999999999"


def test_typed_containers(spark):
    t = spark.createDataFrame([([2e23, 0.1 + 0.2, None], {"b": 1.5, "a": float("nan")}, {2: "x", 10: None}, [[1.0]], (1, [0.1]), None)], "a array<double>, m map<string,double>, n map<int,string>, d array<array<double>>, s struct<y: int, x: array<float>>, z struct<q: int>")
    want = '{"a":[2' + "0" * 23 + ',0.30000000000000004,null],"d":[[1]],"m":{"a":null,"b":1.5},"n":{"10":null,"2":"x"},"s":{"x":[0.1],"y":1},"z":null}'
    assert t.select(canonical_row(t)).first()[0] == want
    pd = pytest.importorskip("pandas")
    frame = pd.DataFrame({"x": [0.1 + 0.2, 2 / 3, float("inf")], "y": [[0.1 + 0.2], {"k": 1 / 3}, "s"], "n": [1, 2, 3]})
    assert from_pandas(frame) == b'{"n":{"0":1,"1":2,"2":3},"x":{"0":0.30000000000000004,"1":0.6666666666666666,"2":null},"y":{"0":[0.30000000000000004],"1":{"k":0.3333333333333333},"2":"s"}}'
    assert from_pandas(pd.Series([1.0, 2.5], index=[0.1, 0.1 + 0.2])) == b'{"0.1":1,"0.30000000000000004":2.5}'


def test_bad_schemas_and_deep_documents(spark):
    with pytest.raises(JsonError, match="multipleOf"):
        D.schema_errors("doc", '{"multipleOf":0}')
    deep = "[" * 100_000 + "]" * 100_000
    df = texts(spark, deep, "[[1]]")
    got = column(df, D.schema_errors("doc", '{"type":["array","number"],"items":{"$ref":"#"}}'))
    assert [[(i.category, i.message) for i in x] for x in got] == [[("depth", "nested too deeply to check")], []]
    assert column(df, D.is_valid_schema("doc", '{"type":["array","number"],"items":{"$ref":"#"}}')) == [False, True]
    merged = merge({"a": 1}, parse('{"a":' * 50_000 + "1" + "}" * 50_000))
    assert merged["a"]["a"]["a"] and merge({"a": {"b": 1, "c": 2}}, {"a": {"b": None}}) == {"a": {"c": 2}}


def test_sql_functions(spark):
    names = D.register(spark)
    assert "json_canon" in names
    assert spark.sql("SELECT json_canon('{b:1,a:2}')").first()[0] == '{"a":2,"b":1}'
    assert [tuple(r) for r in spark.sql("SELECT * FROM json_values('1 [2] {a:3}')").collect()] == [(0, "1"), (1, "[2]"), (2, '{"a":3}')]
    assert spark.sql("SELECT count(*) FROM json_nodes('[1,2]')").first()[0] == 3


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text('{"b":1,"a":2}\n\n[1.0]\n@\n')
    (tmp_path / "seq").mkdir()
    (tmp_path / "seq" / "x").write_bytes(b"\xef\xbb\xbf\x1e{a:1}\n\x1e2")
    assert files.read_ndjson(spark, str(tmp_path / "in")).count() == 3
    assert [(r.value_index, r.canon) for r in files.read_json_seq(spark, str(tmp_path / "seq")).orderBy("value_index").collect()] == [(0, '{"a":1}'), (1, "2")]
    out = canonical_stream(read_lines(spark, str(tmp_path / "in")))
    write_stream(out, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    rows = {r.data: (r.canon, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows['{"b":1,"a":2}'] == ('{"a":2,"b":1}', None) and rows["[1.0]"][0] == "[1]" and rows["@"][0] is None and "unexpected token" in rows["@"][1]
    df = spark.createDataFrame([(0, "[1.0]")], "id long, doc string")
    files.write_with_report(df.withColumn("canon", D.canonicalize("doc")), "canon", D.lint("doc"), ["id"], str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w" / "issues")).first()["message"] == "1.0 → 1"
    files.write_text(df.select(D.canonicalize("doc").alias("canon")), "canon", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "[1]"
    lines = spark.createDataFrame([("g", 1, "[2]"), ("g", 0, "[1]")], "g string, i int, canon string")
    assert files.join_lines(lines, "g", "i", "canon").first()["text"] == "[1]\n[2]"


def test_empty_tables_and_nulls(spark):
    empty = spark.createDataFrame([], T.StructType([T.StructField("id", T.LongType()), T.StructField("doc", T.StringType())]))
    assert nodes(empty, "doc", "id").count() == 0 and profile.deduplicate(empty, "doc", "id").count() == 0
    assert empty.select(D.lint("doc")).count() == 0 and diff_tables(empty, empty, "doc", "id").count() == 0
