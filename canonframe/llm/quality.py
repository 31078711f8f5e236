"""Bradley-Terry quality ranking.

Documents become a few dozen surface features, cut at quantiles into indicator columns. All preference pairs (a labelled
good document over a labelled bad one) are learned by logistic loss on feature differences, which gives every document a
strength. Every labelled document outside the held-out fold counts; no sample is taken. Strengths become scores between 0 and 1 such that the training rows' quantile at the share of bad documents
gets the threshold.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonframe.llm import labelled
from canonframe.llm.common import body, cut, flagged, held_out, table

THRESHOLD = 0.3
BINS = 8
L2 = 2e-3
#: Most steps of the optimizer; each is two passes over the labelled rows' features.
STEPS = 30
#: Strengths are counted in cells of this width up to REACH on both sides while learning, of width FINE for the threshold.
CELL, FINE, REACH = 1 / 16, 1 / 64, 40
LOCAL_ROWS, PART_ROWS = 12_000, 25_000
MARKS = ".,;:!?|%#$&*=\"'()-_<>{}@/\\"
_MARKS = np.frombuffer(MARKS.encode(), np.uint8)
N_FEATURES = 30 + len(MARKS)


def features(text: str) -> list[float]:
    """Surface features of the whole text; the empty text has zeros."""
    n = len(text)
    if not n:
        return [0.0] * N_FEATURES
    words = text.split()
    m = max(1, len(words))
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    lines = text.split("\n")
    full = [x for x in lines if x.strip()] or [""]
    lengths = sorted(map(len, words)) or [0]
    sentences = [s for s in text.replace("\n", " ").split(". ") if s]
    pairs = Counter(zip(lower, lower[1:]))
    letters = sum(map(str.isalpha, set(text)))
    upper = sum(map(str.isupper, words))
    title = sum(map(str.istitle, words))
    raw = text.encode("utf-8", "replace")
    marks = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)  # ASCII characters are single bytes
    digits = int(marks[48:58].sum())
    tops = counts.most_common(2)
    squeezed = zlib.compress(raw, 1)
    out = [
        np.log1p(m), np.log1p(n), np.log1p(len(full)), sum(lengths) / m, lengths[len(lengths) // 2], lengths[-1],
        len(counts) / m, len(counts) / np.sqrt(m), tops[0][1] / m if tops else 0, tops[1][1] / m if len(tops) > 1 else 0,
        len(pairs) / max(1, m - 1), max(pairs.values(), default=0) / m, len(set(full)) / len(full), m / len(full),
        np.log1p(max(map(len, full))), np.log1p(min(map(len, full))), upper / m, title / m, digits / n, n / m,
        len(sentences), m / max(1, len(sentences)), len(set(sentences)) / max(1, len(sentences)), len(squeezed) / n, letters,
        sum(x.rstrip()[-1:] in ".!?" for x in full) / len(full), float(full[-1].rstrip()[-1:] in ".!?"), text.count("  ") / n,
        sum(len(w) <= 3 for w in words) / m, sum(not w.isalnum() for w in words) / m,
    ]
    return [float(v) for v in out] + (marks[_MARKS] / m).tolist()


@dataclass
class Model:
    edges: np.ndarray  # a row of inner quantiles for each feature
    weights: np.ndarray
    at: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return indicators(x, self.edges) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.at) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def indicators(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each feature, 1 for each inner quantile it exceeds."""
    return (x[:, :, None] > edges[None]).reshape(len(x), -1).astype(np.float32)


def _grid(s: np.ndarray, width: float) -> np.ndarray:
    return np.rint(np.clip(s, -REACH, REACH) / width).astype(np.int64) + int(REACH / width)


def _counts(s: np.ndarray, y: np.ndarray, width: float) -> np.ndarray:
    """Bad and good rows in each cell of a fixed grid of strengths."""
    at, cells = _grid(s, width), 2 * int(REACH / width) + 1
    return np.stack([np.bincount(at[y <= 0], minlength=cells), np.bincount(at[y > 0], minlength=cells)])


def learned(total, n_weights: int, l2: float = L2) -> np.ndarray:
    """Weights of least logistic loss over all pairs of a good and a bad row (limited-memory BFGS).

    total(f) sums f(z, y) over all rows, in any number of parts. Strengths are counted on a grid; what a row's pairs add to the
    gradient follows from the counts of the other kind, so every pair counts and none is made.
    """
    centers = (np.arange(2 * int(REACH / CELL) + 1) * CELL - REACH).astype(float)

    def loss(w):
        bad, good = total(lambda z, y: _counts(z @ w, y, CELL)).astype(float)
        if not bad.sum() or not good.sum():
            return 0.0, None
        bad, good, used_b, used_g = bad / bad.sum(), good / good.sum(), np.flatnonzero(bad), np.flatnonzero(good)
        apart = centers[used_g][:, None] - centers[used_b][None]
        lost = 1 / (1 + np.exp(apart))
        pull = np.zeros((2, len(centers)))
        pull[1][used_g], pull[0][used_b] = lost @ bad[used_b], good[used_g] @ lost
        return good[used_g] @ np.logaddexp(0, -apart) @ bad[used_b] + l2 / 2 * w @ w, pull

    def gradient(w, pull):
        def part(z, y):
            at, is_good = _grid(z @ w, CELL), (y > 0).astype(int)
            out = np.zeros((2, 1 + z.shape[1]))
            for k in (0, 1):
                own = is_good == k
                out[k, 0], out[k, 1:] = own.sum(), pull[k][at[own]] @ z[own]
            return out

        bad, good = total(part)
        return bad[1:] / bad[0] - good[1:] / good[0] + l2 * w

    w = np.zeros(n_weights)
    now, pull = loss(w)
    if pull is None:
        return w
    g, past = gradient(w, pull), []
    for _ in range(STEPS):
        q, kept = g.copy(), []
        for ds, dg in reversed(past):
            kept.append(ds @ q / (ds @ dg))
            q -= kept[-1] * dg
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, np.linalg.norm(g))
        for (ds, dg), k in zip(past, reversed(kept)):
            q += (k - dg @ q / (ds @ dg)) * ds
        step = 1.0
        while step > 0.01:
            then, pull = loss(w - step * q)
            if then <= now - 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            break
        before, (w, g) = (w, g), (w - step * q, gradient(w - step * q, pull))
        if (w - before[0]) @ (g - before[1]) > 1e-12:
            past = [*past, (w - before[0], g - before[1])][-8:]
        small, now = now - then < 1e-5, then
        if small:
            break
    return w


def bradley_terry(x: np.ndarray, y: np.ndarray, l2: float = L2) -> np.ndarray:
    """Weights that make each good document's strength exceed the bad ones'; zeros without both kinds."""
    return learned(lambda f: f(x, y), x.shape[1], l2)


def _buckets(x: np.ndarray, y: np.ndarray) -> Counter:
    """Rows of each kind by feature and value to 8 binary places: a count with a bound, whatever the corpus."""
    out: Counter = Counter()
    cells = np.ascontiguousarray(x, np.float32).view(np.int32) >> 15  # no feature is negative: order is kept
    for i in range(x.shape[1]):
        values, n = np.unique(cells[:, i].astype(np.int64) * 2 + (y > 0), return_counts=True)
        out.update({(i, int(v) >> 1, int(v) & 1): int(k) for v, k in zip(values, n)})
    return out


def _quantiles(counts: dict[int, int], at: np.ndarray) -> np.ndarray:
    cells = np.array(sorted(counts), np.int32)
    ends = np.cumsum([counts[c] for c in cells.tolist()])
    return (cells[np.searchsorted(ends, np.floor(at * (ends[-1] - 1)), "right")] << 15).view(np.float32).astype(float)


def _matrix(batch) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(batch.column("f").to_pylist()), "<f8").reshape(-1, N_FEATURES), batch.column("y").to_numpy()


def _sums(rows: DataFrame, f) -> list[np.ndarray]:
    """For each part of rows, the sum of f(features, y) of its batches."""

    def run(batches):
        sums = [f(*_matrix(batch)) for batch in batches if len(batch)]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sum(sums))], pa.binary())], names=["part"])

    return [pickle.loads(r["part"]) for r in rows.mapInArrow(run, "part binary").collect()]  # of fixed size each


def _bucket_table(rows: DataFrame) -> Counter:
    def run(batches):
        for batch in batches:
            found = _buckets(*_matrix(batch))
            columns = [*zip(*found), tuple(found.values())] if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "cell", "good", "n"])

    counted = rows.mapInArrow(run, "i long, cell long, good long, n long").groupBy("i", "cell", "good").agg(F.sum("n").alias("n"))
    return Counter({(r["i"], r["cell"], r["good"]): r["n"] for r in counted.collect()})  # at most 256 an octave and feature


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """f (features as bytes), y of every labelled document outside the held-out fold; texts cross no shuffle."""
    known = cut(labelled.known(labels, "quality").withColumn("doc_id", F.col("doc_id").cast("long")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    some = flagged(docs, "doc_id", known, known.count(), "may").where("may")

    def run(batches):
        for batch in batches:
            f = [np.array(features(t), "<f8").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), *batch.columns[1:]], names=["f", "doc_id", "h"])

    found = some.select("text", "doc_id", F.xxhash64("text").alias("h")).mapInArrow(run, "f binary, doc_id long, h long")
    return cut(found.join(known, "doc_id").dropDuplicates(["doc_id", "h", "y"]).select("f", "y"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From all labelled documents outside the held-out fold; without labels every score is the threshold.

    Rows with a null doc_id, text or label teach nothing; equal rows teach once. The driver holds sums and counts of fixed size;
    up to LOCAL_ROWS rows are summed there, more by the executors, in as many parts as there are PART_ROWS.
    """
    rows = _labelled(docs, labels)
    n = rows.count()
    if not n:
        return Model(np.zeros((N_FEATURES, 1)), np.zeros(N_FEATURES), 0.0, 1.0)
    if n <= LOCAL_ROWS:
        x, y = _matrix(rows.orderBy("f", "y").toArrow())
        cells, parts = _buckets(x, y), lambda f: [f(x, y)]
    else:
        rows = rows.coalesce(-(-n // PART_ROWS))
        cells, parts = _bucket_table(rows), lambda f: _sums(rows, f)
    all_, bad = [[Counter() for _ in range(N_FEATURES)] for _ in range(2)]
    for (i, cell, good), k in cells.items():
        all_[i][cell] += k
        if not good:
            bad[i][cell] += k
    inner = np.linspace(0, 1, BINS + 1)[:-1]
    edges = np.stack([_quantiles(c, inner) for c in all_])
    if bad[0]:  # quantiles of the bad documents too: they sit in the tails of all
        edges = np.hstack([edges, np.stack([_quantiles(c, inner[1:]) for c in bad])])
    total = lambda f: sum(parts(lambda x, y: f(indicators(x, edges), y)))
    w = learned(total, edges.size)
    counts = total(lambda z, y: _counts(z @ w, y, FINE))
    ranks, centers = np.cumsum(counts.sum(0)), np.arange(counts.shape[1]) * FINE - REACH
    k = sum(bad[0].values())
    at = centers[np.searchsorted(ranks, [min(max(0, k - 1), n - 1), min(n - 1, k)], "right")].mean()
    mean = counts.sum(0) @ centers / n
    std = float(np.sqrt(counts.sum(0) @ (centers - mean) ** 2 / n))
    return Model(edges, w, float(at), 4 / max(1e-6, std) if std > 0 else 1.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text (null: empty); a row for each row.

    Texts of any length are read whole; repeated rows and ties score alike; an empty table gives no rows; other columns are
    not read.
    """

    def run(batches):
        for batch in batches:
            f = np.array([features(t) for t in batch.column(0).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(model.score(f).astype(float), pa.float64())], names=["doc_id", "score"])

    return docs.select(body("text").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, score double")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
