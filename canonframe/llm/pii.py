"""Candidate gradient boosting for personal data.

High-recall generators propose overlapping spans; boosted trees score each by binned format and context features;
thresholds calibrated on held-back examples select what is redacted beside the base spans (strict e-mail, IP, card and
phone rules), which always stay. The trees learn from a fixed number of planted values and look-alikes (pii_examples),
whose labels come from how they were planted, not from any feature; candidates of the base kinds that fail a strict rule are
scored like the others.

Everything is Catalyst: matches come from regexp_extract_all, their places from the gaps that split() leaves with the
same pattern, summed by a window over each document's few matches. Texts are never shuffled for the search.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canonframe.llm import boosting
from canonframe.llm.common import body, cut, row_key, table
from canonframe.llm.pii_examples import EXAMPLES, examples

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number", "address")
PRECISION = 0.95


def _run(first: str) -> str:
    """A run of a class may begin a match only where the class begins or the last match ended: the leftmost match either
    way, found in linear time."""
    return rf"(?:\G|(?<!{first}))"


#: kind -> (a fixed character or '' that a text must hold, pattern). Repetitions at the end of a pattern are possessive:
#: nothing follows them, so they match the same and need no stack.
PATTERNS = {
    "email": ("@", _run("[A-Za-z0-9._%+-]") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", _run("[0-9]") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    # generators of candidates
    "secret": ("", _run("[A-Za-z0-9_+/=-]") + r"[A-Za-z0-9_+/=-]{16,}+"),
    "number": ("", r"(?<![0-9A-Za-z.])[+(]?[0-9](?:[\x20().\x2F-]{0,2}[0-9]){5,}+"),
    "address": ("@", _run(r"[^\s@<>\"(),;]") + r"[^\s@<>\"(),;]++\x20?@\x20?[^\s@<>\"(),;]++"),
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
FEATURES = ["f_kind", "f_length", "f_digits", "f_marks", "f_variety", "f_lead", "f_before", "f_after", "f_cue", "f_hex", "f_groups"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    n = F.length(c)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 1, (F.ascii(F.substring(c, i, F.lit(1))) - 48) * 2 - F.when(F.substring(c, i, F.lit(1)) >= "5", 9).otherwise(0)).otherwise(F.ascii(F.substring(c, i, F.lit(1))) - 48),
    )
    return (n > 0) & (total % 10 == 0)


def valid(kind: Column, match: Column) -> Column:
    """The strict rules of the base kinds."""
    d = _digits(match)
    n = F.length(d)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", F.when((n >= 14) & (n <= 19), _luhn(d)).otherwise(False))
        .when(kind == "phone", (n >= 10) & (n <= 15))
        .otherwise(False)
    )


def matches(docs: DataFrame) -> DataFrame:
    """__cf_key, kind, match, start, end, before, after: every match of every pattern; equal rows of docs give one."""
    t = F.col("t")
    found = [
        F.struct(F.lit(k).alias("kind"), F.when(F.contains(t, F.lit(c)) if c else F.lit(True), F.regexp_extract_all(t, F.lit(p), F.lit(0))).alias("m"), F.lit(p).alias("p"))
        for k, (c, p) in PATTERNS.items()
    ]
    rows = docs.select(row_key().alias("__cf_key"), body().alias("t")).select("__cf_key", "t", F.explode(F.array(*found)).alias("x")).where(F.size("x.m") > 0)
    gaps = F.expr("split(t, x.p)")
    each = rows.select("__cf_key", F.col("x.kind").alias("kind"), F.col("x.m").alias("m"), gaps.alias("g"))
    each = each.select("__cf_key", "kind", "m", "g", F.posexplode("m").alias("i", "match")).select(
        "__cf_key", "kind", "i", "match", F.length(F.col("g")[F.col("i")]).alias("gap"),
        F.lower(F.right(F.col("g")[F.col("i")], F.lit(24))).alias("before"), F.left(F.col("g")[F.col("i") + 1], F.lit(2)).alias("after"),
    ).distinct()
    w = Window.partitionBy("__cf_key", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(w).cast("long")
    return each.select("__cf_key", "kind", "match", (end - F.length("match")).alias("start"), end.alias("end"), "before", "after")


def _bins(c: Column, edges: list[float]) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (c >= e).cast("int")
    return out


def _class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^\p{L}"), 3).when(c.rlike("^[\"'=:<(]"), 4).otherwise(5)


def featured(found: DataFrame) -> DataFrame:
    m, before = F.col("match"), F.col("before")
    n = F.length(m)
    d = F.length(_digits(m))
    marks = n - F.length(F.regexp_replace(m, r"[^\p{L}0-9]", ""))
    cue = (
        F.when(before.rlike(r"(?:token|key|secret|passw|auth|bearer)[^\n]{0,12}$"), 1)
        .when(before.rlike(r"(?:tel|phone|call|fax|mobile)[^\n]{0,8}$"), 2)
        .when(before.rlike(r"(?:mail|contact)[^\n]{0,8}$"), 3)
        .when(before.rlike(r"(?:card|iban|account|ssn|konto)[^\n]{0,8}$"), 4)
        .otherwise(0)
    )
    return found.select(
        "*",
        F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("f_kind"),
        _bins(n, [8, 12, 15, 17, 20, 24, 32, 40, 41]).alias("f_length"),
        _bins(d, [1, 4, 7, 10, 12, 14, 16, 20]).alias("f_digits"),
        _bins(marks, [1, 2, 3, 4, 6]).alias("f_marks"),
        _bins(F.size(F.array_distinct(F.split(m, ""))), [4, 7, 10, 13, 16]).alias("f_variety"),
        F.when(m.startswith("+"), 2).when(m.startswith("("), 1).otherwise(0).alias("f_lead"),
        _class(F.right(before, F.lit(1))).alias("f_before"),
        _class(F.left(F.col("after"), F.lit(1))).alias("f_after"),
        cue.alias("f_cue"),
        m.rlike("^[0-9a-fA-F]+$").cast("int").alias("f_hex"),
        _bins(F.size(F.split(m, r"[^0-9]+")), [2, 3, 4, 5]).alias("f_groups"),
    )


def _labelled(spark: SparkSession, n: int) -> DataFrame:
    """Candidates of the planted texts: label 1 if one is a planted value but for a fifth of its length at most."""
    planted = examples(spark, n)
    found = featured(matches(planted)).join(planted.select(row_key().alias("__cf_key"), "at", "upto", "planted"), "__cf_key")
    common = F.least("end", "upto") - F.greatest("start", "at")
    whole = F.greatest("end", "upto") - F.least("start", "at")
    return found.withColumn("label", ((F.col("planted") == 1) & (common >= 0.8 * whole)).cast("int"))


_fitted: dict[tuple, tuple] = {}


def fitted(spark: SparkSession, precision: float = PRECISION, n: int = EXAMPLES) -> tuple[boosting.Trees, dict[str, float]]:
    """fit(), once a session's process: the planted texts, and so the model, are the same whatever the documents."""
    if (precision, n) not in _fitted:
        _fitted[precision, n] = fit(spark, precision, n)
    return _fitted[precision, n]


def fit(spark: SparkSession, precision: float = PRECISION, n: int = EXAMPLES) -> tuple[boosting.Trees, dict[str, float]]:
    """Trees fitted on the candidates of four fifths of n planted texts, and each kind's least margin that reaches the
    precision on those of the rest. The table collected has at most as many rows as these texts have candidates."""
    rows = _labelled(spark, n)
    back = (F.pmod(F.col("__cf_key"), F.lit(5)) == 0).cast("int")
    cells = sorted(rows.groupBy(*FEATURES, back.alias("back")).agg(F.sum("label").alias("pos"), F.count("*").alias("n")).collect(), key=tuple)
    x = np.array([[r[f] for f in FEATURES] for r in cells], int).reshape(-1, len(FEATURES))
    pos, total, held = (np.array([r[c] for r in cells], float) for c in ("pos", "n", "back"))
    fit_on = held == 0
    trees = boosting.fit(x[fit_on], pos[fit_on], (total - pos)[fit_on])
    margin, limits = trees.margin(x), {}
    for i, k in enumerate(KINDS, 1):
        chosen = (x[:, 0] == i) & (held == 1)
        limits[k] = boosting.threshold(margin[chosen], pos[chosen], (total - pos)[chosen], precision)
    return trees, limits


def select_spans(found: DataFrame, precision: float = PRECISION) -> DataFrame:
    """All base spans, and the candidates that the boosted trees select: __cf_key, kind, start, end, base."""
    trees, limits = fitted(found.sparkSession, precision)
    limit = F.lit(float("inf"))
    for k, v in limits.items():
        limit = F.when(F.col("kind") == k, F.lit(v)).otherwise(limit)
    base = F.col("kind").isin(*BASE) & valid(F.col("kind"), F.col("match"))
    scored = featured(found).withColumn("base", base).withColumn("margin", F.expr(trees.sql(FEATURES)))
    return cut(scored.where(F.col("base") | (F.col("margin") >= limit)).select("__cf_key", "kind", "start", "end", "base"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redactions(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """A row for each row of docs: doc_id, counts and digest of base spans, and all spans as text.

    Null and empty texts have no spans; texts of any length are searched whole, in linear time; repeated rows alike; spans
    that begin at one place go by kind; an empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    chosen = select_spans(matches(docs), precision)
    # an added span that lies inside a base span says nothing new
    sofar = Window.partitionBy("__cf_key").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.max(F.when(F.col("base"), F.col("end"))).over(sofar) >= F.col("end")
    chosen = chosen.withColumn("inside", F.coalesce(inside, F.lit(False))).where(F.col("base") | ~F.col("inside"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", order.alias("order"), "end", "kind")
    by_doc = chosen.groupBy("__cf_key").agg(
        *[F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{k}") for k in BASE],
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base_spans"),
        F.sort_array(F.collect_list(span)).alias("all_spans"),
    )
    out = docs.select("doc_id", row_key().alias("__cf_key")).join(by_doc, "__cf_key", "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce(_joined(F.col("base_spans")), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("all_spans")), F.lit("")).alias("spans"),
    )


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return redactions(table(spark, sf_dir, "documents"))
