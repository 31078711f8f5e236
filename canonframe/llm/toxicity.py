"""Weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lower-cases, strips accents, maps homoglyphs and digit substitutions to Latin letters, and everything else to
spaces. Lexicon entries are whole words and word beginnings with log-odds weights learned from labelled documents;
exception phrases are word pairs around an entry that labelled documents show to be harmless. A logistic curve over
length-normalised sums turns matches into a score.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonframe.llm import labelled
from canonframe.llm.common import body, cut, held_out, table

STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.5

# Letters of other scripts that look like Latin ones, and digits that stand for letters.
HOMOGLYPHS = dict(zip("абвгдеёзикмнорстухѕіјԁԛԝαβγεικνορτυχωℓı", "abbrdeezukmhopctyxsijdqwabyeikvoptuxwli"))
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SYMBOLS = {"$": "s", "@": "a", "!": "i", "€": "e", "|": "l", "+": "t"}

_INNER = re.compile("(?<=[^\\W_])[" + re.escape("".join(SYMBOLS)) + "](?=[^\\W_])")
_BREAK = re.compile("[\\u00ad\\u200b-\\u200d\\u2060\\ufeff\\u0300-\\u036f]+")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = HOMOGLYPHS.get(c, DIGITS.get(c, c))
        if not c.isascii():
            c = "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            c = c.replace("ß", "ss")
        out = "".join(x if x.isalpha() else " " for x in c)
        if len(self) > 50_000:
            self.clear()
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded text between single leading and trailing spaces."""
    if not text.isascii():
        text = _BREAK.sub("", text)
    if any(s in text for s in SYMBOLS):
        text = _INNER.sub(lambda m: SYMBOLS[m[0]], text)
    return " " + text.translate(_FOLD) + " "


def terms_of(folded: str) -> set[str]:
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) > 2}
    for n in STEMS:
        out |= {" " + w[:n] for w in words if len(w) > n}
    return out


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.weights.items():
            a.add_word(t, (len(t), w))
        for t in self.exceptions:
            a.add_word(t, (len(t), None))
        if len(a):
            a.make_automaton()
        return a

    def digest(self) -> str:
        return hashlib.sha256(repr((sorted(self.weights.items()), self.exceptions)).encode()).hexdigest()


_automata: dict[str, object] = {}


def automaton_of(model: Model, digest: str):
    """This worker's automaton for a model; it outlives a task and a record batch."""
    if digest not in _automata:
        _automata.clear()
        _automata[digest] = model.automaton()
    return _automata[digest]


def matches(folded: str, auto) -> list[tuple[int, int, float]]:
    """(begin, end, weight) of the words that entries match; of several entries of a word the heaviest counts;
    entries inside an exception phrase don't count."""
    if not len(auto):
        return []
    best: dict[int, tuple[int, float]] = {}
    spared = []
    for end, (n, w) in auto.iter(folded):
        begin = end - n + 1
        if w is None:
            spared.append((begin, end))
        elif begin not in best or w > best[begin][1]:
            best[begin] = (end, w)
    spared.sort()
    begins, reach, far = [s for s, _ in spared], [], -1
    for _, t in spared:  # how far a phrase that begins here or before reaches
        far = max(far, t)
        reach.append(far)
    return [(b, e, w) for b, (e, w) in sorted(best.items()) if not spared or e > (reach[i - 1] if (i := bisect_right(begins, b)) else -1)]


def features(folded: str, auto) -> tuple[float, float, float]:
    """Heaviest entry; sum of weights damped; sum of weights by length. A repeated entry counts once."""
    found = {folded[b : e + 1]: w for b, e, w in matches(folded, auto)}
    if not found:
        return 0.0, 0.0, 0.0
    total = sum(found.values())
    return max(found.values()), float(np.log1p(total)), float(total / np.sqrt(len(folded) / 6 + 1))


def _counts(rows: DataFrame) -> DataFrame:
    def run(batches):
        counts: dict[str, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["term", "neg", "pos"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in terms_of(fold(text)):
                    counts.setdefault(t, [0, 0])[y > 0] += 1
                if len(counts) > 50_000:
                    yield out()
                    counts.clear()
        yield out()

    return rows.select("text", "y").mapInArrow(run, "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights with the intercept last, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + l2 * w
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = labelled.MAX_LABELLED) -> Model:
    """Lexicon, exception phrases and curve from at most `most` labelled documents outside the held-out fold.

    Without labelled rows of both kinds the lexicon is empty and every score is 0.
    """
    rows = cut(labelled.sample(docs, labels, "toxic", most))
    size = {r["y"]: r["n"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_neg:
        return Model({}, (), (0.0, 0.0, 0.0, -20.0))
    odds = F.log((F.col("pos") + 0.5) / F.lit(n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n_neg + 1.0))
    counts = cut(_counts(rows))
    n, share = F.col("pos") + F.col("neg"), n_pos / (n_pos + n_neg)
    # the likelihood ratio of an entry's share of toxic documents against the sample's; as many candidates as there are (of
    # those in three rows or more: rarer ones hardly reach it) give one entry above the limit by chance
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * p))).otherwise(0.0)
    ratio = 2 * (part("pos", share) + part("neg", 1 - share))
    limit = 2 * float(np.log(max(counts.where(n >= 3).count(), 2)))
    chosen = counts.select("term", odds.alias("w"), ratio.alias("ratio")).where((F.col("w") > 0) & (F.col("ratio") >= limit))
    weights = {r["term"]: r["w"] for r in chosen.collect()}  # terms of the sample, whose size is bounded

    def table_of(model: Model):
        def run(batches):
            auto = model.automaton()
            for batch in batches:
                ys, fs, contexts = [], [], []
                for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    folded = fold(text)
                    ys.append(y)
                    fs.append(features(folded, auto))
                    near = set()
                    for b, e, _ in matches(folded, auto):
                        end = folded.find(" ", e) if folded[e] != " " else e
                        near.add(folded[folded.rfind(" ", 0, b) if b else 0 : end + 1])
                        stop = folded.find(" ", end + 1)
                        near.add(folded[b : stop + 1])
                    contexts.append([c for c in near if c.count(" ") == 3])
                yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array([list(f) for f in fs], pa.list_(pa.float64())), pa.array(contexts, pa.list_(pa.string()))], names=["y", "f", "contexts"])

        return rows.select("text", "y").mapInArrow(run, "y int, f array<double>, contexts array<string>")

    seen = cut(table_of(Model(weights, (), ())))
    near = seen.select("y", F.explode("contexts").alias("c")).groupBy("c").agg(F.sum((F.col("y") > 0).cast("int")).alias("pos"), F.count("*").alias("n"))
    harmless = near.where((F.col("n") - F.col("pos") >= 5) & (F.col("pos") * 5 <= F.col("n")))
    exceptions = tuple(sorted(r["c"] for r in harmless.collect()))  # phrases of the sample
    if exceptions:
        seen = table_of(Model(weights, exceptions, ()))
    fitted = seen.select("y", "f").collect()  # at most `most` rows
    x, y = np.array([r["f"] for r in fitted]), np.array([r["y"] > 0 for r in fitted], float)
    order = np.lexsort((*x.T, y))
    return Model(weights, exceptions, tuple(float(v) for v in logistic(x[order], y[order])))


def scores(texts: pa.Array, model: Model, digest: str) -> pa.Array:
    auto, w = automaton_of(model, digest), np.array(model.curve)
    f = np.array([features(fold(t), auto) for t in texts.to_pylist()]).reshape(-1, 3)
    return pa.array(1 / (1 + np.exp(-np.clip(f @ w[:-1] + w[-1], -30, 30))), pa.float64())


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, out: str = "__cf_score") -> DataFrame:
    """docs' columns `keep` with `out`, the score: a row for each row.

    Null and empty texts score as texts without matches; texts of any length are matched whole, in time proportional to
    their length; repeated rows and ties score alike; an empty table gives no rows; other columns are not read.
    """
    digest = model.digest()

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return scores(texts, model, digest)

    return docs.select(*[F.col(f"`{c}`") for c in (["doc_id"] if keep is None else keep)], scored(body("text")).alias(out))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whatever their names, that score below the threshold.

    Null, empty and very long texts, repeated rows, ties and empty tables as in score(); repeated rows stay or go together.
    """
    digest = model.digest()

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return scores(texts, model, digest)

    return docs.where(scored(body("text")) < threshold)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, out="score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
