"""Log-template tree for lines: recurring templates across documents are dropped.

A line descends a tree of fixed depth: its number of tokens, then its leading tokens (those with digits count as the
wildcard). In a leaf, a token that fewer than MIN_DOCS documents have at its position is a variable field and becomes the
wildcard too. If enough positions stay constant (wildcards never do), after the leading ones as well as in all, the line's
template is that generalised form; else it is the line itself, with its digits.
A template that MIN_DOCS documents or more have is recurring: its lines go, but for the first (least doc_id, then line).
A line that two documents have token by token needs no template: it goes from the second document on (`copies`).

Leaves are counted first, so only lines of leaves that could recur are looked at again; they are few numbers each, and all
counts are pre-aggregated. For copies, each line is one row of four numbers. Texts move once, to meet the numbers of their
dropped lines.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonframe.llm.common import bitmap, body, cut, flagged, free, row_key, table

DEPTH = 3
MIN_TOKENS = 1
MIN_DOCS = 8
#: Least share of positions that stay constant in a template: of all, and of those after the leading ones.
CONSTANT = 0.6
SALTS = 32
#: A line that has more than one in so many of all line rows is dealt to SALTS tasks; at most so many lines have.
BUSY = 4096
_DIGIT = re.compile("[0-9]")
WILD = "<*>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash(text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))


def tokens_of(line: str) -> list[str]:
    tokens = line.split()
    return [WILD if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def _token_hash(token: str) -> int:
    return xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 31)


def leaf_of(tokens: list[str], depth: int = DEPTH) -> int:
    return _hash(f"{len(tokens)} " + " ".join(tokens[:depth]))


def _split(text: str, min_tokens: int):
    """(line number, line, tokens) of the lines long enough to have a template."""
    for i, line in enumerate(text.split("\n")):
        tokens = tokens_of(line)
        if len(tokens) >= min_tokens:
            yield i, line, tokens


def _lines(text: str, min_tokens: int):
    return ((i, tokens) for i, _, tokens in _split(text, min_tokens))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), body("text").alias("text"))


def _leaves(docs: DataFrame, min_tokens: int, min_docs: int) -> DataFrame:
    """leaf, n: those that at least min_docs documents reach, and how many do."""

    def run(batches):
        counts: dict[int, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["leaf", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for leaf in {leaf_of(t) for _, t in _lines(text, min_tokens)}:
                    counts[leaf] = counts.get(leaf, 0) + 1
                if len(counts) > 100_000:
                    yield out()
                    counts.clear()
        yield out()

    return _source(docs).select("text").mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)


def _busy_leaves(leaves: DataFrame) -> DataFrame:
    total = leaves.agg(F.sum("n")).first()[0] or 0
    return leaves.where(F.col("n") > total // BUSY).select("leaf")


def _dealt(rows: DataFrame, keyed: DataFrame, on: list[str], key: str, busy: DataFrame) -> DataFrame:
    """rows joined with keyed, which has a row for each value of `on`. Values in `busy` (few, see BUSY) are dealt to SALTS
    tasks by a hash of `key`, each with its own copy of keyed's row."""
    mark = F.broadcast(busy.select(*on, F.lit(True).alias("__busy")))
    salts = F.when(F.col("__busy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = keyed.join(mark, on, "left").withColumn("__salt", F.explode(salts)).drop("__busy")
    salt = F.when(F.col("__busy"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(mark, on, "left").withColumn("__salt", salt).drop("__busy")
    return dealt.join(salted, [*on, "__salt"]).drop("__salt")


_ROW = "key long, doc_id long, line int, leaf long, raw long, text_hash long, tokens array<int>"
_ARROW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("leaf", pa.int64()), ("raw", pa.int64()), ("text_hash", pa.int64()), ("tokens", pa.list_(pa.int32()))])


def _entries(docs: DataFrame, leaves: DataFrame, min_tokens: int) -> DataFrame:
    """A row for each line whose leaf may recur; raw is its text's hash, text_hash that of its tokens, these as 32-bit hashes."""
    filter_, bits = bitmap(leaves.select(F.col("leaf").alias("key")), leaves.count())

    def run(batches):
        words = filter_.value
        for batch in batches:
            rows: list[tuple] = []
            for key, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for i, line, tokens in _split(text, min_tokens):
                    leaf = leaf_of(tokens)
                    at = leaf & ((1 << bits) - 1)
                    if (int(words[at >> 6]) >> (at & 63)) & 1:
                        rows.append((key, doc, i, leaf, _hash(" ".join(line.split())), _hash(" ".join(tokens)), [_token_hash(t) for t in tokens]))
                if len(rows) > 8_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return _dealt(_source(docs).mapInArrow(run, _ROW), leaves.select("leaf"), ["leaf"], "key", _busy_leaves(leaves))


def templates(lines: DataFrame, entries: DataFrame, min_docs: int, busy: DataFrame, constant: float = CONSTANT) -> DataFrame:
    """leaf, text_hash, template for each distinct line (leaf, text_hash, tokens).

    entries: leaf, tokens and key (the document) of each line; busy: leaves with a large share of all lines. A token is constant at its place of a leaf if min_docs
    documents have it there, however many lines of theirs do. The template is null where too few positions are constant to
    generalise the line.
    """
    wild = F.lit(_token_hash(WILD))
    forks = lines.groupBy("leaf").agg(F.count("*").alias("k"), F.max(F.array_contains("tokens", wild)).alias("wild"), F.max(F.size("tokens")).alias("size"))
    forks = cut(forks.where(f"(k > 1 or wild) and size > {DEPTH}").select("leaf"))
    held = _dealt(entries, forks, ["leaf"], "key", busy).select("leaf", "key", F.posexplode("tokens").alias("at", "token")).where(F.col("at") >= DEPTH)
    # one row for each document first, then how many: both counts are pre-aggregated, so a token of all documents is no hot key
    common = held.groupBy("leaf", "at", "token", "key").agg(F.lit(1).alias("one")).groupBy("leaf", "at", "token").agg(F.count("*").alias("n"))
    common = common.where(F.col("n") >= min_docs).select("leaf", "at", "token", F.lit(1).alias("fixed"))
    each = _dealt(lines, forks, ["leaf"], "text_hash", busy).select("leaf", "text_hash", F.posexplode("tokens").alias("at", "token"))
    led, rest_ = each.where(F.col("at") < DEPTH).withColumn("fixed", F.lit(1)), each.where(F.col("at") >= DEPTH).join(common, ["leaf", "at", "token"], "left")
    fixed = F.when(F.col("token") == wild, 0).otherwise(F.coalesce("fixed", F.lit(0)))
    marked = led.unionByName(rest_).withColumn("fixed", fixed)
    form = F.sort_array(F.collect_list(F.struct("at", F.when(F.col("fixed") == 1, F.col("token")).alias("token"))))
    # all lines of a leaf share the leading tokens, so these say nothing about what follows
    rest = F.avg(F.when(F.col("at") >= DEPTH, F.col("fixed")))
    made = marked.groupBy("leaf", "text_hash").agg(form.alias("form"), F.avg("fixed").alias("share"), rest.alias("rest")).where((F.col("share") >= constant) & (F.col("rest") >= constant))
    made = made.select("leaf", "text_hash", F.xxhash64(F.col("leaf"), F.to_json("form")).alias("template"))
    return lines.select("leaf", "text_hash").join(made, ["leaf", "text_hash"], "left")


def _copies(docs: DataFrame, min_tokens: int) -> DataFrame:
    """key, line: the lines that repeat a line of another document token by token, but for the first of each."""

    def run(batches):
        schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("raw", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            for key, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for i, line in enumerate(text.split("\n")):
                    tokens = line.split()
                    if len(tokens) >= min_tokens:
                        rows.append((key, doc, i, _hash(" ".join(tokens))))
                if len(rows) > 8_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    lines = cut(_source(docs).mapInArrow(run, "key long, doc_id long, line int, raw long"))
    busy = lines.count() // BUSY
    # equal rows are one document: two documents have a line if two keys do
    seen = lines.groupBy("raw").agg(F.min(F.struct("doc_id", "key", "line")).alias("first"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    seen = cut(seen.where("low <> high").select("raw", "first", "n"))
    hit = _dealt(lines, seen.select("raw", "first"), ["raw"], "key", seen.where(F.col("n") > busy).select("raw"))
    return hit.where(~((F.col("key") == F.col("first.key")) & (F.col("line") == F.col("first.line")))).select("key", "line")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, copies: bool = False) -> DataFrame:
    """key (row_key), lines: the numbers of each document's lines that repeat a recurring template or, with copies, a line."""
    if copies:  # shorter lines have no template but themselves
        hit = _copies(docs, min_tokens)
        min_tokens = max(min_tokens, DEPTH + 1)
    leaves = cut(_leaves(docs, min_tokens, min_docs))
    entries = cut(_entries(docs, leaves, min_tokens))
    busy = entries.count() // BUSY
    lines = cut(entries.groupBy("leaf", "text_hash").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")))
    made = templates(lines, entries.select("leaf", "key", "tokens"), min_docs, _busy_leaves(leaves))
    named = _dealt(entries.select("key", "doc_id", "line", "leaf", "raw", "text_hash"), made, ["leaf", "text_hash"], "key", lines.where(F.col("n") > busy).select("leaf", "text_hash"))
    named = cut(named.select("key", "doc_id", "line", F.coalesce("template", F.xxhash64("leaf", "raw")).alias("template")))
    per_doc = named.groupBy("template", "key").agg(F.min(F.struct("doc_id", "key", "line")).alias("first"), F.count("*").alias("n"))
    recurring = per_doc.groupBy("template").agg(F.count("*").alias("docs"), F.min("first").alias("first"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs)
    recurring = cut(recurring.select("template", "first", "n"))
    repeats = _dealt(named, recurring.select("template", "first"), ["template"], "key", recurring.where(F.col("n") > busy).select("template"))
    repeats = repeats.where(~((F.col("key") == F.col("first.key")) & (F.col("line") == F.col("first.line")))).select("key", "line")
    hit = hit.unionByName(repeats) if copies else repeats
    return hit.groupBy("key").agg(F.collect_set("line").alias("lines"))


def deduplicate(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, copies: bool = False, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs' columns with text replaced by what stays; with `counts`, two more columns of these names: the number of lines
    before and of those dropped (names that docs has already are replaced, so give others: common.free()).

    A null text stays null and has no lines; an empty text has one line that has no template. Lines under min_tokens
    tokens stay; lines of any length and number are handled alike. With copies, a line that two documents have goes from the
    second on, whatever min_docs is; the first document keeps the first of them. A line that only one document repeats
    stays. Equal rows are one document and stay alike. Ties of doc_id go by a hash of the row. Empty tables give no rows. A
    text without dropped lines stays as it is, byte for byte, and crosses no shuffle unless a filter of hashes takes it for
    one with dropped lines.
    """
    drops = cut(dropped_lines(docs, min_docs, min_tokens, copies))
    key, gone, may = free(docs, "__cf_key"), free(docs, "__cf_gone"), free(docs, "__cf_may")
    drops = drops.select(F.col("key").alias(key), F.col("lines").alias(gone))
    marked = flagged(docs.withColumn(key, row_key()), key, drops, drops.count(), may)
    rest = marked.where(~F.col(may)).withColumn(gone, F.lit(None).cast("array<int>"))
    joined = marked.where(may).join(drops, key, "left").select(*rest.columns).unionByName(rest)
    parts = F.split("text", "\n")
    kept = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col(gone), s["i"]))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    if counts:
        joined = joined.withColumn(counts[0], F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"))
        joined = joined.withColumn(counts[1], F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
    return joined.withColumn("text", text).drop(key, gone, may)


def whole(docs: DataFrame, counts: tuple[str, str] | None = None) -> DataFrame:
    """deduplicate() as the query and the pipeline use it: recurring templates and all copies of lines go, blank lines stay."""
    return deduplicate(docs, min_tokens=1, copies=True, counts=counts)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = whole(table(spark, sf_dir, "documents").select("doc_id", "text"), ("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")
