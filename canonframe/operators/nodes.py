"""The value tree as rows: one per node, numbered in pre-order, so that descendants are a range of node ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from canonframe.kernel import parser, text
from canonframe.kernel.numbers import canonical
from canonframe.kernel.pointer import joined
from canonframe.kernel.serialize import dumps
from canonframe.kernel.values import Num, kind_of

NODE = "node_id long, parent_id long, depth int, path string, key string, ordinal int, kind string, token string, n_children int, last_descendant long, pointer string"
_ARROW = pa.schema([("node_id", pa.int64()), ("parent_id", pa.int64()), ("depth", pa.int32()), ("path", pa.string()), ("key", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("token", pa.string()), ("n_children", pa.int32()), ("last_descendant", pa.int64()), ("pointer", pa.string())])


def node_rows(value) -> list[list]:
    """Nodes in pre-order. token: a scalar's canonical text as written before number canonicalization; null for
    containers. path is a report's path ($.a[0]); pointer, the JSON Pointer, tells nodes of equal parents apart exactly."""
    rows: list[list] = []
    stack: list = [(value, None, 0, "$", None, None, "")]
    open_: list[list] = []
    while stack:
        v, parent, depth, path, key, ordinal, at = stack.pop()
        while len(open_) > depth:
            open_.pop()[9] = len(rows) - 1
        kind = kind_of(v)
        token = None if kind in ("object", "array") else str(v) if type(v) is Num else dumps(v, nan="string")
        n = len(v) if token is None else 0
        row = [len(rows), parent, depth, path, key, ordinal, kind, token, n, len(rows), at]
        rows.append(row)
        if kind == "object":
            stack += [(x, row[0], depth + 1, f"{path}.{k}", k, i, at + joined([k])) for i, (k, x) in reversed(list(enumerate(v.items())))]
        elif kind == "array":
            stack += [(v[i], row[0], depth + 1, f"{path}[{i}]", None, i, f"{at}/{i}") for i in range(n - 1, -1, -1)]
        if n:
            open_.append(row)
    while open_:
        open_.pop()[9] = len(rows) - 1
    return rows


def nodes(df: DataFrame, data: str, *ids: str) -> DataFrame:
    """A row for each node of each document of df: the id columns, then NODE. Null documents have no nodes."""
    base = df.select(*ids, data).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.fields[:-1]), NODE])
    k = len(ids)

    def run(batches):
        for batch in batches:
            at, cols = [], [[] for _ in _ARROW]
            for i, d in enumerate(batch.column(k).to_pylist()):
                if d is None:
                    continue
                for row in node_rows(parser.parse(text.decode(d))):
                    at.append(i)
                    for c, x in zip(cols, row):
                        c.append(x)
                if len(at) > 50_000:
                    yield _batch(batch, at, cols, k)
                    at, cols = [], [[] for _ in _ARROW]
            yield _batch(batch, at, cols, k)

    return df.select(*ids, data).mapInArrow(run, schema)


def _batch(batch, at: list[int], cols: list[list], k: int):
    take = pa.array(at, pa.int64())
    names = [*batch.schema.names[:k], *_ARROW.names]
    return pa.RecordBatch.from_arrays([*(batch.column(j).take(take) for j in range(k)), *(pa.array(c, f.type) for c, f in zip(cols, _ARROW))], names=names)


def key_order_issues(nodes_: DataFrame, *ids: str) -> DataFrame:
    """Objects whose keys are not sorted: a key above the next one of its parent (the lint rule, relationally)."""
    w = Window.partitionBy(*ids, "parent_id").orderBy("ordinal")
    bad = nodes_.where("key is not null").withColumn("__before", F.lag("key").over(w)).where(F.col("__before") > F.col("key"))
    parents = bad.select(*ids, F.col("parent_id").alias("node_id")).distinct()
    return nodes_.join(parents, [*ids, "node_id"], "left_semi").select(*ids, F.col("path").alias("loc"), F.lit("key-order").alias("category"), F.lit("object keys are not sorted").alias("message"))


def key_profile(nodes_: DataFrame) -> DataFrame:
    """For each key: how many members have it, and of what kinds."""
    return nodes_.where("key is not null").groupBy("key", "kind").agg(F.count("*").alias("n"))


@udtf(returnType="value_index: int, canon: string")
class JsonValues:
    """SQL: SELECT * FROM docs, LATERAL json_values(docs.text)."""

    def eval(self, data):
        if data is not None:
            for i, v in enumerate(parser.parse_stream(text.decode(data))):
                yield i, dumps(v)


@udtf(returnType=NODE.replace(" long", ": bigint").replace(" int", ": int").replace(" string", ": string"))
class JsonNodes:
    def eval(self, data):
        if data is not None:
            for row in node_rows(parser.parse(text.decode(data))):
                yield tuple(row)


def register_tables(spark: SparkSession) -> list[str]:
    spark.udtf.register("json_values", JsonValues)
    spark.udtf.register("json_nodes", JsonNodes)
    return ["json_values", "json_nodes"]


def canonical_tokens(nodes_: DataFrame) -> DataFrame:
    """Number nodes with the exact canonical text beside the token, by the Catalyst expression."""
    from canonframe.functions.numbers import canon_number

    return nodes_.where("kind = 'number'").withColumn("canon", canon_number("token"))


__all__ = ["canonical", "nodes", "node_rows", "key_order_issues", "key_profile", "register_tables", "canonical_tokens"]
