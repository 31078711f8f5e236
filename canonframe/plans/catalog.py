"""The query catalogue. The Spark side builds messy text from typed columns and runs an operator; the SQL side constructs the
canonical result from the same columns and never parses."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonframe.functions import documents as D
from canonframe.functions.formats import format_ok
from canonframe.functions.numbers import canon_number, is_number_token, try_canon_number
from canonframe.functions.strings import decode_bytes, enc_string, encode_output, nonfinite, sort_keys
from canonframe.operators import profile
from canonframe.operators.diff import diff_tables
from canonframe.operators.nodes import key_order_issues, key_profile, nodes, register_tables
from canonframe.operators.typed import canonical_row, from_pandas
from canonframe.plans import rules
from canonframe.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def built(df: DataFrame, expression: str, *ids: str) -> DataFrame:
    """ids and the text `doc` that a SQL expression builds."""
    return df.select(*ids, F.expr(expression).alias("doc"))


# --- D1 on real JSON ------------------------------------------------------------------------------------------------
_PROPS = "'{\"k\":' || regexp_extract(props, '[0-9]+') || '}'"


@query(f"SELECT event_id, {_PROPS} AS canon FROM events")
def canon_events_props(spark, d):
    return table(spark, d, "events").select("event_id", D.canonicalize("props").alias("canon"))


@query(f"SELECT event_id, sha256({_PROPS}) AS sha FROM events")
def sha256_props(spark, d):
    return table(spark, d, "events").select("event_id", D.content_hash("props").alias("sha"))


@query("SELECT event_id, event_id % 2 = 0 AS ok FROM events")
def check_canonical(spark, d):
    e = table(spark, d, "events")
    doc = F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit(" "))).otherwise(F.col("props"))
    return e.select("event_id", D.is_canonical(doc).alias("ok"))


@query(f"SELECT sha256({_PROPS}) AS canon_sha256, min(event_id) AS first_event_id, count(*) AS n FROM events GROUP BY ALL")
def dedup_by_canonical_hash(spark, d):
    return profile.deduplicate(table(spark, d, "events"), "props", "event_id")


@query(f"SELECT event_type, count(DISTINCT sha256({_PROPS})) AS n_distinct, count(*) AS n FROM events GROUP BY event_type")
def props_hash_profile(spark, d):
    e = profile.with_hash(table(spark, d, "events").select("event_type", "props"), "props")
    return e.groupBy("event_type").agg(F.countDistinct("canon_sha256").alias("n_distinct"), F.count("*").alias("n"))


# --- C1 to C5 -------------------------------------------------------------------------------------------------------
_CENTS = "cast(round(l_extendedprice * 100) AS bigint)"
_PLAIN = """CASE WHEN c % 100 = 0 THEN cast(c // 100 AS varchar) WHEN c % 10 = 0 THEN (c // 100) || '.' || ((c % 100) // 10)
 ELSE (c // 100) || '.' || lpad(cast(c % 100 AS varchar), 2, '0') END"""
_SCI = """substr(rtrim(cast(c AS varchar), '0'), 1, 1) || CASE WHEN length(rtrim(cast(c AS varchar), '0')) > 1 THEN '.' || substr(rtrim(cast(c AS varchar), '0'), 2) ELSE '' END
 || 'e+' || (length(cast(c AS varchar)) + {shift})"""
_LINES = f"SELECT l_orderkey, l_linenumber, {{}} AS canon FROM (SELECT l_orderkey, l_linenumber, {_CENTS} AS c FROM lineitem)"


def _tokens(spark, d, expression: str) -> DataFrame:
    return built(table(spark, d, "lineitem").withColumn("c", F.expr(_CENTS)), expression, "l_orderkey", "l_linenumber")


@query(_LINES.format(_PLAIN))
def canon_number_plain(spark, d):
    return _tokens(spark, d, "concat('+00', c, '.0e-2')").select("l_orderkey", "l_linenumber", canon_number("doc").alias("canon"))


@query(_LINES.format(_SCI.format(shift="-3")))
def canon_number_sci(spark, d):
    return _tokens(spark, d, "concat('+00', c, '.0e-2')").select("l_orderkey", "l_linenumber", canon_number("doc", "scientific").alias("canon"))


@query(_LINES.format(_SCI.format(shift="19")))
def canon_number_auto(spark, d):
    return _tokens(spark, d, "concat(c, 'E20')").select("l_orderkey", "l_linenumber", canon_number("doc", "auto").alias("canon"))


@query(_LINES.format(f"CASE WHEN c % 100 = 0 THEN (c // 100) || '.0' ELSE {_PLAIN} END"))
def canon_number_preserve(spark, d):
    return _tokens(spark, d, "concat(c, 'e-2')").select("l_orderkey", "l_linenumber", canon_number("doc", preserve_type=True).alias("canon"))


@query("SELECT l_linenumber, l_returnflag, count(*) FILTER (l_linenumber % 3 <> 0) AS n_tokens, count(*) AS n FROM lineitem GROUP BY ALL")
def number_token_test(spark, d):
    t = built(table(spark, d, "lineitem"), "CASE l_linenumber % 3 WHEN 0 THEN concat(l_orderkey, '..1') WHEN 1 THEN concat('-.', l_orderkey, 'e+1') ELSE concat(l_orderkey, '.') END", "l_linenumber", "l_returnflag")
    return t.groupBy("l_linenumber", "l_returnflag").agg(F.count(F.when(is_number_token("doc"), 1)).alias("n_tokens"), F.count("*").alias("n"))


@query(_LINES.format(f"CASE WHEN c % 5 = 0 THEN NULL ELSE {_PLAIN} END"))
def try_number(spark, d):
    return _tokens(spark, d, "CASE WHEN c % 5 = 0 THEN concat(c, 'x') ELSE concat('0', c, 'e-2') END").select("l_orderkey", "l_linenumber", try_canon_number("doc").alias("canon"))


# --- dialects: L3 to L16 --------------------------------------------------------------------------------------------
@query("""SELECT n_nationkey, '{"flag":true,"key":' || n_nationkey || ',"name":"' || n_name || '","none":null,"off":false}' AS canon FROM nation""")
def canon_python_dialect(spark, d):
    t = built(table(spark, d, "nation"), r"""concat("{'name': '", n_name, "', 'key': ", n_nationkey, ", 'flag': True, 'off': False, 'none': None,}")""", "n_nationkey")
    return t.select("n_nationkey", D.canonicalize("doc").alias("canon"))


@query("""SELECT n_nationkey, '{"a":[' || n_nationkey || ',' || n_regionkey || '],"b":"' || n_name || '"}' AS canon FROM nation""")
def canon_jsonc(spark, d):
    t = built(table(spark, d, "nation"), r"""concat('// head\n{"b": /* x, y */ "', n_name, '", "a": [', n_nationkey, ', // k\n +', n_regionkey, ',],\n}  /* end */')""", "n_nationkey")
    return t.select("n_nationkey", D.canonicalize("doc").alias("canon"))


@query("""SELECT o_orderkey, '{"$id":' || o_orderkey || ',"_s":"A' || o_orderstatus || 'B","clé":0.5,"n":5}' AS canon FROM orders""")
def canon_json5(spark, d):
    t = built(table(spark, d, "orders"), r"""concat('{n: 5., $id: 0x', lower(hex(o_orderkey)), ', _s: \'\\x41', o_orderstatus, '\\\nB\', cl\\u00e9: .5}')""", "o_orderkey")
    return t.select("o_orderkey", D.canonicalize("doc").alias("canon"))


@query("SELECT o_orderkey, '[' || o_orderkey || ',' || CASE WHEN o_orderkey = 0 THEN '0' ELSE '-' || o_orderkey END || ']' AS canon FROM orders")
def canon_hex(spark, d):
    return built(table(spark, d, "orders"), "concat('[+0x', hex(o_orderkey), ',-0X', hex(o_orderkey), ']')", "o_orderkey").select("o_orderkey", D.canonicalize("doc").alias("canon"))


@query("""SELECT o_orderkey, '{"A":1,"B":' || o_custkey || ',"a":"' || o_orderstatus || '","é":[]}' AS canon FROM orders""")
def canon_key_sort(spark, d):
    return built(table(spark, d, "orders"), """concat('{"é":[],"a":"', o_orderstatus, '","B":', o_custkey, ',"A":1.0}')""", "o_orderkey").select("o_orderkey", D.canonicalize("doc").alias("canon"))


@query("""SELECT o_orderkey, '{"a":' || o_custkey || ',"b":2}' AS canon FROM orders""")
def canon_dupes_last_wins(spark, d):
    return built(table(spark, d, "orders"), """concat('{"a":0,"b":2,"a":', o_custkey, '}')""", "o_orderkey").select("o_orderkey", D.canonicalize("doc").alias("canon"))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS n_failed FROM orders")
def strict_duplicates(spark, d):
    t = built(table(spark, d, "orders"), """concat('{"a":0,', if(o_orderkey % 3 = 0, '"a"', '"b"'), ':', o_custkey, '}')""", "o_orderkey")
    return t.agg(F.count("*").alias("n"), F.count(F.when(D.try_canonicalize("doc", strict_dupes=True).isNull(), 1)).alias("n_failed"))


# --- strings, literals, non-finite ----------------------------------------------------------------------------------
_ESCAPED = r"""'"' || replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') || '\u0001\r"' """


@query(f"SELECT doc_id, {_ESCAPED.format('text')} AS canon FROM documents")
def canon_string_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", enc_string(F.concat("text", F.lit("\x01\r"))).alias("canon"))


@query(f"SELECT page_id, '[' || {_ESCAPED.format('html')} || ']' AS canon FROM pages")
def canon_string_kernel(spark, d):
    t = table(spark, d, "pages").select("page_id", F.to_json(F.array(F.concat("html", F.lit("\x01\r")))).alias("doc"))
    return t.select("page_id", D.canonicalize("doc").alias("canon"))


@query("SELECT n_nationkey, '[null,null,null,' || n_nationkey || ']' AS canon FROM nation")
def canon_nan_null(spark, d):
    return built(table(spark, d, "nation"), "concat('[NaN,-Infinity,inf,', n_nationkey, ']')", "n_nationkey").select("n_nationkey", D.canonicalize("doc", nan="null").alias("canon"))


@query("""SELECT n_nationkey, '["NaN","-Infinity","Infinity",' || n_nationkey || ']' AS canon FROM nation""")
def canon_nan_string(spark, d):
    return built(table(spark, d, "nation"), "concat('[nan,-inf,+Infinity,', n_nationkey, ']')", "n_nationkey").select("n_nationkey", D.canonicalize("doc", nan="string").alias("canon"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '"NaN"' WHEN 1 THEN '"-Infinity"' END AS canon FROM events""")
def nonfinite_policy(spark, d):
    kind = F.expr("CASE event_id % 3 WHEN 0 THEN 'NaN' WHEN 1 THEN '-Infinity' ELSE '1' END")
    return table(spark, d, "events").select("event_id", nonfinite(kind, "string").alias("canon"))


# --- encodings ------------------------------------------------------------------------------------------------------
def _hex_query(encoding: str, mark: str, before: str, after: str) -> None:
    sql = f"SELECT n_nationkey, '{mark}' || regexp_replace(hex(n_name), '(..)', '{before}\\1{after}', 'g') AS bytes FROM nation"

    @query(sql, name="encode_" + encoding.replace("-", ""))
    def run(spark, d):
        return table(spark, d, "nation").select("n_nationkey", F.hex(encode_output("n_name", encoding, True)).alias("bytes"))


_hex_query("utf-16-le", "FFFE", "", "00")
_hex_query("utf-16-be", "FEFF", "00", "")
_hex_query("utf-32-le", "FFFE0000", "", "000000")
_hex_query("utf-32-be", "0000FEFF", "000000", "")
_hex_query("utf-8", "EFBBBF", "", "")
_hex_query("latin-1", "", "", "")


@query("SELECT n_nationkey, e AS encoding, n_name AS text FROM nation, unnest(['latin-1', 'utf-16-be', 'utf-16-le', 'utf-32-be', 'utf-32-le', 'utf-8']) AS t(e)")
def bom_roundtrip(spark, d):
    n = table(spark, d, "nation")
    out = None
    for e in ("latin-1", "utf-16-be", "utf-16-le", "utf-32-be", "utf-32-le", "utf-8"):
        one = n.select("n_nationkey", F.lit(e).alias("encoding"), decode_bytes(encode_output("n_name", e, True)).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT n_nationkey, hex('{"k":' || n_nationkey || '}') AS bytes FROM nation""")
def kernel_encoding(spark, d):
    """UTF-16 in, UTF-8 out, through the kernel's decoder."""
    doc = encode_output(F.expr("concat('{ \"k\" : ', n_nationkey, ' }')"), "utf-16-le", True)
    return table(spark, d, "nation").select("n_nationkey", F.hex(D.canonicalize(doc)).alias("bytes"))


# --- framing --------------------------------------------------------------------------------------------------------
_TURNS = """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, '{"role":"' || role || '","turn":' || turn || '}' AS canon FROM conversations"""


def _conversations(spark, d, separator: str, prefix: str) -> DataFrame:
    line = F.concat(F.lit(prefix), F.expr("""concat('{"turn": ', turn, '.0, "role": "', role, '"}')"""))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda s: s["x"]), separator).alias("doc"))


@query(_TURNS)
def ndjson_lines(spark, d):
    return _conversations(spark, d, "\n\n", " ").select("conv_id", F.posexplode(D.ndjson_values("doc")).alias("idx", "canon"))


@query(_TURNS)
def json_seq_values(spark, d):
    return _conversations(spark, d, "\n", "\x1e").select("conv_id", F.posexplode(D.json_values("doc")).alias("idx", "canon"))


@query(_TURNS)
def json_values_sql(spark, d):
    """Concatenated values through the SQL table function."""
    register_tables(spark)
    _conversations(spark, d, "", "").createOrReplaceTempView("__cf_conversations")
    return spark.sql("SELECT conv_id, value_index AS idx, canon FROM __cf_conversations, LATERAL json_values(doc)")


# --- nodes, lint, reports -------------------------------------------------------------------------------------------
_K = "regexp_extract(props, '[0-9]+')"


@query(f"""SELECT event_id, 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, '$' AS path, 'object' AS kind, NULL AS token, 1::BIGINT AS last_descendant FROM events
UNION ALL SELECT event_id, 1, 0, '$.k', 'number', {_K}, 1 FROM events""")
def nodes_props(spark, d):
    return nodes(table(spark, d, "events"), "props", "event_id").select("event_id", "node_id", "parent_id", "path", "kind", "token", "last_descendant")


@query("SELECT 'k' AS key, 'number' AS kind, count(*) AS n FROM events")
def key_profile_props(spark, d):
    return key_profile(nodes(table(spark, d, "events"), "props", "event_id"))


@query("SELECT o_orderkey, '$.m' AS loc, 'key-order' AS category, 'object keys are not sorted' AS message FROM orders WHERE o_orderkey % 4 = 0")
def key_order_nodes(spark, d):
    t = built(table(spark, d, "orders"), """concat('{"m":{', if(o_orderkey % 4 = 0, '"b":1,"a":2', '"a":1,"b":2'), '},"n":[]}')""", "o_orderkey")
    return key_order_issues(nodes(t, "doc", "o_orderkey"), "o_orderkey")


@query("""SELECT category, n * (SELECT count(*) FROM nation) AS n FROM (VALUES ('comment', 1), ('single-quote', 1), ('hex-number', 1), ('python-literal', 1), ('trailing-comma', 2),
('unquoted-key', 1), ('number-syntax', 1), ('number', 2), ('key-order', 1), ('duplicate-key', 1), ('non-finite', 1)) AS t(category, n)""")
def lint_categories(spark, d):
    t = built(table(spark, d, "nation"), r"""concat('{b: \'x\', /* c */ "a": [True, NaN], "a": [+', n_nationkey + 1, ', 0xFF, 4.0,],}')""", "n_nationkey")
    return profile.issue_counts(t, D.lint("doc"))


@query("""SELECT o_orderkey, '$.id' AS loc, 'number' AS category, cast(9007199254740990 + o_orderkey AS varchar) || ' is an integer outside the I-JSON safe range ±(2^53-1)' AS message
FROM orders WHERE o_orderkey > 1""")
def ijson_big_ints(spark, d):
    t = built(table(spark, d, "orders"), """concat('{"id":', 9007199254740990 + o_orderkey, '}')""", "o_orderkey")
    return profile.issue_rows(t, D.ijson("doc"), "o_orderkey").drop("seq")


@query("""SELECT n_nationkey, '$.coordinates[0]' AS loc, 'geojson-winding' AS category, 'exterior ring should be counterclockwise (RFC 7946 §3.1.6)' AS message FROM nation WHERE n_nationkey % 2 = 1""")
def geojson_winding(spark, d):
    ring = "if(n_nationkey % 2 = 1, '[0,0],[0,9],[9,9],[0,0]', '[0,0],[9,9],[0,9],[0,0]')"
    t = built(table(spark, d, "nation"), f"""concat('{{"type":"Polygon","coordinates":[[', {ring}, ']]}}')""", "n_nationkey")
    return profile.issue_rows(t, D.geojson("doc"), "n_nationkey").drop("seq")


@query("""SELECT n_nationkey, '$.geometry.coordinates[0]' AS loc, 'geojson-ring' AS category,
CASE n_nationkey % 3 WHEN 1 THEN 'linear ring must have at least four positions' ELSE 'linear ring is not closed (first != last position)' END AS message FROM nation WHERE n_nationkey % 3 > 0""")
def geojson_ring(spark, d):
    ring = "CASE n_nationkey % 3 WHEN 0 THEN '[0,0],[9,0],[9,9],[0,0.0]' WHEN 1 THEN '[0,0],[9,0],[0,0]' ELSE '[0,0],[9,0],[9,9],[1,0]' END"
    t = built(table(spark, d, "nation"), f"""concat('{{"type":"Feature","properties":null,"geometry":{{"type":"Polygon","coordinates":[[', {ring}, ']]}}}}')""", "n_nationkey")
    return profile.issue_rows(t, D.geojson("doc"), "n_nationkey").drop("seq")


# --- diff -----------------------------------------------------------------------------------------------------------
def _order_docs(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    a = built(o, """concat('{"status":"', o_orderstatus, '","cust":{"key":', o_custkey, '},"tags":[1,2]}')""", "o_orderkey")
    b = built(o, """concat('{"tags":[1.0,2', if(o_orderkey % 11 = 0, ',3', ''), '],"status":"', if(o_orderkey % 7 = 0, 'X', o_orderstatus), '"', if(o_orderkey % 13 = 0, '', concat(',"cust":{"key":', o_custkey, '.0}')), '}')""", "o_orderkey")
    return a, b


@query("""SELECT o_orderkey, '~' AS op, '$.status' AS path, '"' || o_orderstatus || '"' AS old, '"X"' AS new FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, '+', '$.tags[2]', NULL, '3' FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT o_orderkey, '-', '$.cust', '{"key":' || o_custkey || '}', NULL FROM orders WHERE o_orderkey % 13 = 0""")
def diff_orders(spark, d):
    a, b = _order_docs(spark, d)
    return diff_tables(a, b, "doc", "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '- $.cust: {"key":' || o_custkey || '};' ELSE '' END
|| CASE WHEN o_orderkey % 7 = 0 THEN '~ $.status: "' || o_orderstatus || '" => "X";' ELSE '' END
|| CASE WHEN o_orderkey % 11 = 0 THEN '+ $.tags[2]: 3;' ELSE '' END AS lines FROM orders""")
def diff_lines(spark, d):
    a, b = _order_docs(spark, d)
    both = a.join(b.withColumnRenamed("doc", "doc2"), "o_orderkey")
    return both.select("o_orderkey", F.concat_ws("", F.transform(D.diff_documents("doc", "doc2"), lambda x: F.concat(x, F.lit(";")))).alias("lines"))


# --- RFC 8785 -------------------------------------------------------------------------------------------------------
@query(f"""SELECT l_orderkey, l_linenumber, '[' || {_PLAIN} || ',' || c || ']' AS canon FROM (SELECT l_orderkey, l_linenumber, {_CENTS} AS c FROM lineitem)""")
def jcs_numbers(spark, d):
    return _tokens(spark, d, "concat('[', c, 'e-2,', c, '.0]')").select("l_orderkey", "l_linenumber", D.canonicalize("doc", jcs=True).alias("canon"))


@query(f"SELECT l_orderkey, l_linenumber, {_PLAIN} AS canon FROM (SELECT l_orderkey, l_linenumber, {_CENTS} AS c FROM lineitem)")
def ecmascript_doubles(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", D.ecmascript_number(F.round("l_extendedprice", 2)).alias("canon"))


@query("""SELECT n_nationkey, '{"a":' || n_nationkey || ',"😀":1,"￿":2}' AS canon, ['a', '😀', '￿'] AS keys FROM nation""")
def jcs_utf16_sort(spark, d):
    t = built(table(spark, d, "nation"), """concat('{"￿":2,"😀":1,"a":', n_nationkey, '}')""", "n_nationkey")
    return t.select("n_nationkey", D.canonicalize("doc", jcs=True).alias("canon"), sort_keys(F.array(F.lit("￿"), F.lit("😀"), F.lit("a")), jcs=True).alias("keys"))


@query("""SELECT o_orderkey, '.id: ' || (9007199254740993 + 2 * o_orderkey) || ' → ' || (9007199254740992 + 2 * o_orderkey + CASE WHEN o_orderkey % 2 = 1 THEN 2 ELSE 0 END)
|| ' (IEEE-754 rounding; not reversible)' AS warning FROM orders""")
def jcs_warnings(spark, d):
    t = built(table(spark, d, "orders"), """concat('{"id":', 9007199254740993 + 2 * o_orderkey, ',"n":0.1}')""", "o_orderkey")
    return t.select("o_orderkey", F.explode(D.jcs_warnings("doc")).alias("warning"))


# --- transforms -----------------------------------------------------------------------------------------------------
_ORDER = """concat('{"o":{"key":', o_orderkey, ',"a/b":[', o_custkey, ',"', o_orderstatus, '"]},"t":', o_custkey, '.50}')"""


@query("SELECT o_orderkey, '\"' || o_orderstatus || '\"' AS v, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || '.5' ELSE cast(o_orderkey AS varchar) END AS w FROM orders")
def pointer_extract(spark, d):
    t = built(table(spark, d, "orders"), _ORDER, "o_orderkey")
    by_row = F.when(F.col("o_orderkey") % 2 == 0, "/t").otherwise("/o/key")
    return t.select("o_orderkey", D.json_pointer("doc", "/o/a~1b/1").alias("v"), D.json_pointer("doc", by_row).alias("w"))


@query("""SELECT o_orderkey, '{"c":' || o_orderkey || ',"o":{"a/b":["' || o_orderstatus || '",7],"key":' || o_orderkey || '}}' AS canon, o_custkey % 2 = 0 AS ok FROM orders""")
def patch_add_remove(spark, d):
    t = built(table(spark, d, "orders"), _ORDER, "o_orderkey", "o_custkey")
    steps = '[{"op":"copy","from":"/o/key","path":"/c"},{"op":"remove","path":"/t"},{"op":"remove","path":"/o/a~1b/0"},{"op":"add","path":"/o/a~1b/-","value":7.0},{"op":"test","path":"/o/a~1b/1","value":7}]'
    test = F.concat(F.lit('[{"op":"test","path":"/t","value":'), (F.col("o_custkey") + F.col("o_custkey") % 2).cast("string"), F.lit('.5}]'))
    return t.select("o_orderkey", D.json_patch("doc", steps).alias("canon"), D.try_json_patch("doc", test).isNotNull().alias("ok"))


@query("""SELECT o_orderkey, '{"o":{"key":' || o_orderkey || ',"x":[1]},"t":null}' AS canon FROM (SELECT o_orderkey FROM orders) WHERE false
UNION ALL SELECT o_orderkey, '{"n":{"y":1},"o":{"key":' || o_orderkey || ',"x":[1]}}' FROM orders""")
def merge_patch(spark, d):
    t = built(table(spark, d, "orders"), _ORDER, "o_orderkey")
    return t.select("o_orderkey", D.merge_patch("doc", '{"o":{"a/b":null,"x":[1]},"t":null,"n":{"y":1,"z":null}}').alias("canon"))


# --- binary forms ---------------------------------------------------------------------------------------------------
_SHAPES = """concat('{"id":', o_orderkey, ',"big":1', lpad(o_orderkey, 25, '0'), ',"neg":-', o_custkey, ',"x":', o_custkey, '.5,"s":"é', o_orderstatus, '","l":[true,null]}')"""
_SHAPED = """'{"big":' || {0} || ',"id":' || o_orderkey || ',"l":[true,null],"neg":' || CASE WHEN o_custkey = 0 THEN '0' ELSE '-' || o_custkey END || ',"s":"é' || o_orderstatus || '","x":' || o_custkey || '.5}'"""


@query(f"""SELECT o_orderkey, {_SHAPED.replace("{0}", "'1' || lpad(cast(o_orderkey AS varchar), 25, '0')")} AS canon FROM orders""")
def cbor_roundtrip(spark, d):
    return built(table(spark, d, "orders"), _SHAPES, "o_orderkey").select("o_orderkey", D.from_cbor(D.to_cbor("doc")).alias("canon"))


@query("SELECT o_orderkey, " + _SHAPED.replace("'{\"big\":' || {0} || ',\"id\":'", "'{\"id\":'") + " AS canon FROM orders")
def msgpack_roundtrip(spark, d):
    t = built(table(spark, d, "orders"), _SHAPES.replace(""" ',"big":1', lpad(o_orderkey, 25, '0'),""", ""), "o_orderkey")
    return t.select("o_orderkey", D.from_msgpack(D.to_msgpack("doc")).alias("canon"))


def _heads(name: str, sql: str, f) -> None:
    @query(f"SELECT o_orderkey, {sql} AS bytes FROM orders", name=name)
    def run(spark, d):
        return table(spark, d, "orders").select("o_orderkey", F.hex(f(F.col("o_orderkey").cast("string"))).alias("bytes"))


_heads("cbor_int_heads", """CASE WHEN o_orderkey < 24 THEN printf('%02X', o_orderkey) WHEN o_orderkey < 256 THEN '18' || printf('%02X', o_orderkey)
WHEN o_orderkey < 65536 THEN '19' || printf('%04X', o_orderkey) ELSE '1A' || printf('%08X', o_orderkey) END""", D.to_cbor)
_heads("msgpack_int_heads", """CASE WHEN o_orderkey < 128 THEN printf('%02X', o_orderkey) WHEN o_orderkey < 256 THEN 'CC' || printf('%02X', o_orderkey)
WHEN o_orderkey < 65536 THEN 'CD' || printf('%04X', o_orderkey) ELSE 'CE' || printf('%08X', o_orderkey) END""", D.to_msgpack)


@query("""SELECT vec_id, '[' || array_to_string([ '[' || array_to_string(v[8 * i + 1:8 * i + 8], ',') || ']' for i in range(0, 8)], ',') || ']' AS canon
FROM (SELECT vec_id, [cast(floor(x::DOUBLE * 1000) AS BIGINT) for x in embedding] AS v FROM embeddings)""")
def jdata_reshape(spark, d):
    data = "array_join(transform(embedding, x -> cast(floor(cast(x as double) * 1000) as bigint)), '.0,')"
    t = built(table(spark, d, "embeddings"), f"""concat('{{"_ArrayType_":"double","_ArraySize_":[8,8],"_ArrayData_":[', {data}, ']}}')""", "vec_id")
    return t.select("vec_id", D.from_jdata("doc").alias("canon"))


# --- validators -----------------------------------------------------------------------------------------------------
_PART = """concat('{"key":', p_partkey, ',"size":', p_size, ',"brand":"', p_brand, '","tags":["', p_type, '","', if(p_partkey % 10 = 0, p_type, 'x'), '"]', if(p_partkey % 7 = 0, ',"extra":1', ''), '}')"""
SCHEMA = """{"$schema":"https://json-schema.org/draft/2020-12/schema","type":"object","properties":{"key":{"type":"integer","minimum":1},"size":{"maximum":40},
"brand":{"type":"string","minLength":1},"tags":{"type":"array","items":{"type":"string"},"uniqueItems":true}},"required":["key","size"],"additionalProperties":false}"""


@query("SELECT p_partkey, p_partkey >= 1 AND p_size <= 40 AND p_partkey % 10 <> 0 AND p_partkey % 7 <> 0 AS ok FROM part")
def schema_valid(spark, d):
    return built(table(spark, d, "part"), _PART, "p_partkey").select("p_partkey", D.is_valid_schema("doc", SCHEMA).alias("ok"))


@query("""SELECT p_partkey, '/key' AS loc, 'minimum not met' AS message FROM part WHERE p_partkey < 1 UNION ALL SELECT p_partkey, '/size', 'maximum exceeded' FROM part WHERE p_size > 40
UNION ALL SELECT p_partkey, '/tags', 'uniqueItems: duplicate element' FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey, '/extra', 'additionalProperties: not allowed' FROM part WHERE p_partkey % 7 = 0""")
def schema_errors(spark, d):
    t = built(table(spark, d, "part"), _PART, "p_partkey")
    return profile.issue_rows(t, D.schema_errors("doc", SCHEMA), "p_partkey").select("p_partkey", "loc", "message")


@query("SELECT page_id, page_id % 2 = 0 AS ok, page_id % 3 = 0 AS dated FROM pages")
def schema_format(spark, d):
    p = table(spark, d, "pages")
    host = F.expr("if(page_id % 2 = 0, url, concat('/', url))")
    dated = F.expr("if(page_id % 3 = 0, '2024-02-29', '2024-2-29')")
    doc = F.concat(F.lit('"'), host, F.lit('"'))
    return p.select("page_id", D.is_valid_schema(doc, '{"format":"uri"}', assert_format=True).alias("ok"), format_ok(dated, "date").alias("dated"))


JTD = """{"properties":{"key":{"type":"uint8"},"brand":{"enum":["Brand#11","Brand#12","Brand#13"]}},"optionalProperties":{"extra":{"type":"boolean"}}}"""
_JTD_DOC = """concat('{"key":', p_partkey, '.0,"brand":"Brand#', 11 + p_partkey % 4, '"', if(p_partkey % 7 = 0, ',"extra":1', ''), '}')"""


@query("SELECT p_partkey, p_partkey <= 255 AND p_partkey % 4 < 3 AND p_partkey % 7 <> 0 AS ok FROM part")
def jtd_valid(spark, d):
    return built(table(spark, d, "part"), _JTD_DOC, "p_partkey").select("p_partkey", D.is_valid_jtd("doc", JTD).alias("ok"))


@query("""SELECT p_partkey, '/key' AS loc, 'schema /properties/key/type' AS message FROM part WHERE p_partkey > 255 UNION ALL SELECT p_partkey, '/brand', 'schema /properties/brand/enum' FROM part WHERE p_partkey % 4 = 3
UNION ALL SELECT p_partkey, '/extra', 'schema /optionalProperties/extra/type' FROM part WHERE p_partkey % 7 = 0""")
def jtd_errors(spark, d):
    t = built(table(spark, d, "part"), _JTD_DOC, "p_partkey")
    return profile.issue_rows(t, D.jtd_errors("doc", JTD), "p_partkey").select("p_partkey", "loc", "message")


CDDL = """part = { key: uint, brand: brand, ? extra: bool }
brand = "Brand#11" / "Brand#12" / "Brand#13" ; three of them"""


@query("SELECT p_partkey, p_partkey % 4 < 3 AND p_partkey % 7 <> 0 AS ok FROM part")
def cddl_valid(spark, d):
    return built(table(spark, d, "part"), _JTD_DOC, "p_partkey").select("p_partkey", D.is_valid_cddl("doc", CDDL).alias("ok"))


@query("""SELECT p_partkey, '$.brand' AS loc, 'expected "Brand#11" / "Brand#12" / "Brand#13"' AS message FROM part WHERE p_partkey % 4 = 3 UNION ALL SELECT p_partkey, '$.extra', 'expected bool' FROM part WHERE p_partkey % 7 = 0""")
def cddl_errors(spark, d):
    t = built(table(spark, d, "part"), _JTD_DOC, "p_partkey")
    return profile.issue_rows(t, D.cddl_errors("doc", CDDL), "p_partkey").select("p_partkey", "loc", "message")


# --- salvage, typed rows, streams -----------------------------------------------------------------------------------
@query(f"""SELECT event_id, '{{"k":' || {_K} || ',"z":[1,2]}}' AS canon, 2 AS n_lost FROM events""")
def force_salvage(spark, d):
    t = built(table(spark, d, "events"), """concat(substr(props, 1, length(props) - 1), ', "bad": @, "z": [1, 2')""", "event_id")
    s = t.select("event_id", D.salvage("doc").alias("s"))
    return s.select("event_id", "s.canon", F.expr("size(filter(s.recoveries, r -> r.message not like 'unterminated object%'))").alias("n_lost"))


@query("""SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS canon FROM nation""")
def typed_nation(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", canonical_row(n).alias("canon"))


@query("""SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_totalprice":' || """ + _PLAIN + """ || '}' AS canon
FROM (SELECT *, cast(round(o_totalprice * 100) AS bigint) AS c FROM orders)""")
def typed_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"))
    return o.select("o_orderkey", canonical_row(o).alias("canon"))


@query(f"SELECT event_id, {_PROPS} AS canon, sha256({_PROPS}) AS canon_sha256 FROM events")
def stream_canon_props(spark, d):
    """The same kernel on a stream: the table's file as a source, one trigger, a Parquet sink in the shared folder."""
    from canonframe.streaming.documents import canonical_stream, write_stream

    base = _folder(spark, "stream")
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = canonical_stream(source.select("event_id", "props"), "props").select("event_id", "canon", "canon_sha256")
    write_stream(out, f"{base}/data", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/data")


rules.register(query)


# --- exponents of any size, options, sources and sinks ----------------------------------------------------------------
@query("""SELECT o_orderkey, '1.2e+9999999999999999999' || lpad(cast(o_orderkey + 1 AS varchar), 9, '0') AS sci, CAST(NULL AS varchar) AS plain,
CASE WHEN o_orderkey < 10 THEN '0.' || o_orderkey || '5' ELSE (o_orderkey // 10) || '.' || (o_orderkey % 10) || '5' END AS small FROM orders""")
def canon_number_exponents(spark, d):
    """Exponents far beyond 64 bits: exact in scientific format, no answer in plain format."""
    t = table(spark, d, "orders").withColumn("t", F.expr("concat('12e9999999999999999999', lpad(o_orderkey, 9, '0'))"))
    return t.select("o_orderkey", canon_number("t", "scientific").alias("sci"), try_canon_number("t").alias("plain"), canon_number(F.concat("o_orderkey", F.lit(".5e-1"))).alias("small"))


@query("""SELECT o_orderkey, CAST(o_orderkey AS varchar) AS by_pointer, '{"b":2}' AS by_patch, '{"a":' || o_orderkey || ',"m":1}' AS by_merge, '{"n":' || o_orderkey || '}' AS by_callable FROM orders""")
def transform_precedence(spark, d):
    """A pointer goes before a patch, that before a merge patch, that before a callable."""
    t = built(table(spark, d, "orders"), """concat('{"a":', o_orderkey, '.0}')""", "o_orderkey")
    call, merge, patch = (lambda v: {"n": v["a"]}), '{"m":1}', '[{"op":"add","path":"/b","value":2},{"op":"remove","path":"/a"}]'
    run = lambda **options: D.canonicalize("doc", transform=call, **options)
    return t.select("o_orderkey", run(pointer="/a", patch=patch, merge_patch=merge).alias("by_pointer"), run(patch=patch, merge_patch=merge).alias("by_patch"), run(merge_patch=merge).alias("by_merge"), run().alias("by_callable"))


@query("""SELECT n_nationkey, '[true,' || n_nationkey || ']' AS canon, n_nationkey % 2 = 0 AS ok FROM nation""")
def literal_prefixes(spark, d):
    """A literal ends where its letters end: what follows must be a separator or the end."""
    n = table(spark, d, "nation")
    doc = F.expr("concat('[True,', n_nationkey, ']')")
    odd = F.expr("if(n_nationkey % 2 = 0, '[true]', '[tru e]')")
    return n.select("n_nationkey", D.canonicalize(doc).alias("canon"), D.try_canonicalize(odd).isNotNull().alias("ok"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '[1,2]' ELSE '{"a":[1]}' END AS canon,
CASE o_orderkey % 3 WHEN 0 THEN ['dropped malformed object member'] WHEN 1 THEN ['dropped trailing data after the value'] ELSE ['unterminated array at end of input', 'unterminated object at end of input'] END AS messages FROM orders""")
def salvage_messages(spark, d):
    t = built(table(spark, d, "orders"), """element_at(array('{"a":1,"b":@}', '[1,2] x', '{"a":[1'), cast(o_orderkey % 3 AS int) + 1)""", "o_orderkey")
    s = t.select("o_orderkey", D.salvage("doc").alias("s"))
    return s.select("o_orderkey", "s.canon", F.expr("transform(s.recoveries, r -> r.message)").alias("messages"))


def _folder(spark: SparkSession, name: str) -> str:
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return (base or tempfile.mkdtemp(prefix="canonframe-")) + f"/{name}-{uuid.uuid4().hex}"


@query("""SELECT n_nationkey, '{"k":' || n_nationkey || ',"n":"' || n_name || '"}' AS canon FROM nation""")
def file_roundtrip(spark, d):
    """Canonical lines written as text, read back as NDJSON."""
    path = _folder(spark, "lines")
    t = built(table(spark, d, "nation"), """concat('{"n": "', n_name, '", "k": ', n_nationkey, '.0}')""", "n_nationkey")
    files.write_text(t.select(D.canonicalize("doc").alias("canon")), "canon", path)
    back = files.read_ndjson(spark, path).select(D.canonicalize("data").alias("canon"))
    return back.select(D.json_pointer("canon", "/k").cast("int").alias("n_nationkey"), "canon")


@query("""SELECT 'line' AS kind, n_nationkey AS i, '{"k":' || n_nationkey || '}' AS canon FROM nation UNION ALL SELECT 'document', 0, '[' || string_agg(n_nationkey, ',' ORDER BY n_nationkey) || ']' FROM nation""")
def read_documents(spark, d):
    """Files as documents of bytes (one file in all), and as streams of values."""
    one, many = _folder(spark, "one"), _folder(spark, "many")
    n = table(spark, d, "nation")
    n.agg(F.concat(F.lit("[ "), F.array_join(F.array_sort(F.collect_list("n_nationkey")), " , "), F.lit(" ]")).alias("value")).coalesce(1).write.text(one)
    n.orderBy("n_nationkey").coalesce(1).select(F.expr("concat(char(30), '{\"k\": ', n_nationkey, '}')").alias("value")).write.text(many)
    docs = files.read_documents(spark, f"{one}/*.txt").select(F.lit("document").alias("kind"), F.lit(0).alias("i"), D.canonicalize("data").alias("canon"))
    return docs.unionByName(files.read_json_seq(spark, f"{many}/*.txt").select(F.lit("line").alias("kind"), F.col("value_index").alias("i"), "canon"))


@query("""SELECT n_nationkey, '{"a":1,"b":2}' AS canon, CASE WHEN n_nationkey % 2 = 1 THEN '$' END AS loc, CASE WHEN n_nationkey % 2 = 1 THEN 'key-order' END AS category FROM nation""")
def report_sink(spark, d):
    """Documents and, beside them, their issues, as written."""
    path = _folder(spark, "report")
    t = built(table(spark, d, "nation"), """if(n_nationkey % 2 = 0, '{"a":1,"b":2}', '{"b":2,"a":1}')""", "n_nationkey").withColumn("canon", D.canonicalize("doc"))
    files.write_with_report(t, "canon", D.lint("doc"), ["n_nationkey"], path)
    issues = spark.read.parquet(f"{path}/issues").select("n_nationkey", "loc", "category")
    return spark.read.parquet(f"{path}/documents").join(issues, "n_nationkey", "left").select("n_nationkey", "canon", "loc", "category")


@query("""SELECT '{"half":{' || string_agg('"' || n_nationkey || '":' || n_nationkey || '.5', ',' ORDER BY cast(n_nationkey AS varchar)) || '},"n_name":{'
|| string_agg('"' || n_nationkey || '":"' || n_name || '"', ',' ORDER BY cast(n_nationkey AS varchar)) || '}}' AS canon FROM nation""")
def pandas_frame(spark, d):
    """A small frame (25 nations) through the pandas interface: {column: {index: value}}."""
    n = table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", (F.col("n_nationkey") + 0.5).cast("double").alias("half"))
    return spark.createDataFrame([(from_pandas(n.toPandas().set_index("n_nationkey")).decode(),)], "canon string")


@query("""SELECT event_id, [CASE WHEN event_id % 2 = 0 THEN 'exact' ELSE 'ends' END] AS kind, event_id % 2 = 0 AS ok FROM events""")
def schema_pattern_linear(spark, d):
    """A pattern on which a backtracking engine takes exponential time."""
    doc = F.expr("concat('\"', repeat('a', 200), if(event_id % 2 = 0, '', 'b'), '\"')")
    t = table(spark, d, "events").select("event_id", doc.alias("doc"))
    kind = F.array(F.when(F.col("event_id") % 2 == 0, "exact").otherwise("ends"))
    return t.select("event_id", kind.alias("kind"), D.is_valid_schema("doc", '{"pattern":"^(a+)+$"}').alias("ok"))
