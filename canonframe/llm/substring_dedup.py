"""Exact removal of repeated 100-byte strings by deep-shallow suffix sorting.

A window is any 100-byte string of a document. Every window has an anchor: the least-hashed 20-byte string in it (the
leftmost of equals). Equal windows have equal anchors at equal places, so only windows whose anchors occur twice can
repeat. Neighbouring windows mostly share an anchor, about 41 bytes of text each. Stages:

1. anchors of all documents, packed, meet by hash; those that occur once are done;
2. the others come again with the bytes around them, grouped by anchor; the bytes right of the anchor and those left of it
   (reversed) are suffix-sorted by deep-shallow sorting, and the longest common prefixes of neighbours give, for each
   place of the anchor in a window, the classes of equal windows; all but the earliest of a class are repeats;
3. runs of repeats meet their documents' texts, are joined, and taken out.

No task holds all of a common passage: in stage 1 a worker sends two places of an anchor and a count for each stretch of
text it has read, since two places are all that is asked; in stage 2 an anchor of more than HOT contexts (its group would be
too large to sort in one task) is dealt by its windows instead: a window's 128-bit hash stands for its bytes, the earliest of
equal windows is found by a minimum that is pre-aggregated, and all others are repeats.

Equal documents are one class throughout: its first stands for it, and the later ones are repeats as a whole. Equal rows
(doc_id and text) count as one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonframe.llm import suffix_sort
from canonframe.llm.common import bitmap, body, cut, in_bitmap, table
from canonframe.llm.shingle_sets import mix

WINDOW = 100
GRAM = 20
SPAN = WINDOW - GRAM  # the last place of an anchor in its window
BLOCK = 1 << 18
ANCHORS_PER_PART = 1_000_000
CONTEXTS_PER_PART = 60_000
#: Bits of the filter of repeated anchors: each part of the hash space has a map, and beyond 2**18 parts several share one.
MAX_FILTER_BITS = 28
LEAST_PART_BITS = 10
#: Contexts of one anchor that one task sorts.
HOT = 100_000
SEEN = 200_000
_U = np.uint64
_TURN = np.random.default_rng(100_20).integers(1, 1 << 63, 3, dtype=np.uint64) * _U(2) + _U(1)
_ANCHOR = np.dtype([("token", "<u4"), ("n", "<u4"), ("place", "<u8")])
_CONTEXT = np.dtype([("token", "<u4"), ("part", "<u4"), ("cls", "<i8"), ("doc", "<i8"), ("first", "<i4"), ("left", "u1"), ("runs", "u1")])


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie in raw one after the other up to `ends`: anchor hash, anchor place, first and last window.

    A row for each run of windows with one anchor; windows lie in one text.
    """
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    eights = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,))
    m = len(raw) - GRAM + 1
    h = eights[:m] * _TURN[0]
    h += eights[8 : 8 + m] * _TURN[1]
    h += eights[12 : 12 + m] * _TURN[2]
    h = mix(h)
    low = _U((1 << 20) - 1)
    key = (h & ~low) | np.arange(m, dtype=np.uint64)  # ties go to the left
    width = 1
    while width * 2 <= SPAN + 1:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = SPAN + 1 - width
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    at = (key & low).astype(np.int64)
    good = np.ones(n, bool)
    for e in ends.tolist():
        good[max(0, e - WINDOW + 1) : min(n, e)] = False
    same = at[1:] == at[:-1]
    head, tail = good.copy(), good.copy()
    head[1:] &= ~(same & good[:-1])
    tail[:-1] &= ~(same & good[1:])
    # windows of neighbouring texts are apart: those across an end are not good
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    return h[at[first]], at[first], first, last


def _blocks(column):
    """Stretches of a binary column's bytes: (bytes, ends, rows, offsets of the pieces inside their rows' texts)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type == "binary" else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1))
        lo, hi = offsets[i], offsets[j]
        if j == i + 1:  # a long text comes in pieces that share WINDOW - 1 bytes, so that each window is in one piece
            for at in range(0, max(1, int(hi - lo) - WINDOW + 1), BLOCK):
                piece = raw[lo + at : min(hi, lo + at + BLOCK + WINDOW - 1)]
                yield piece, np.array([len(piece)]), np.array([i]), np.array([at])
        else:
            yield raw[lo:hi], offsets[i + 1 : j + 1] - lo, np.arange(i, j), lo - offsets[i:j]
        i = j


class _First:
    """Which rows to look at: of equal texts those whose doc_id is below all before (in this worker's stretch)."""

    def __init__(self) -> None:
        self.least: dict[int, int] = {}

    def take(self, cls: int, doc: int) -> bool:
        if self.least.get(cls, doc + 1) <= doc:
            return False
        if len(self.least) > SEEN:
            self.least.clear()
        self.least[cls] = doc
        return True


def _source(docs: DataFrame) -> DataFrame:
    raw = body("text").cast("binary")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(F.xxhash64(raw).alias("cls"), doc.alias("doc"), raw.alias("text"))


def _found(batch, first: _First):
    """For each stretch of a batch: arrays of hash, class, document, anchor, first and last window; and the bytes."""
    cls, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    keep = np.array([first.take(c, d) for c, d in zip(cls.tolist(), doc.tolist())], bool)
    if not keep.any():
        return
    if not keep.all():
        batch = batch.filter(pa.array(keep))
        cls, doc = cls[keep], doc[keep]
    for raw, ends, rows, shift in _blocks(batch.column(2)):
        h, at, lo, hi = anchors(raw, ends)
        if len(h):
            row = np.searchsorted(ends, lo, "right")
            yield raw, h, cls[rows[row]], doc[rows[row]], at, lo, hi, shift[row]


def _packed(part: np.ndarray, rows: np.ndarray):
    by = np.argsort(part, kind="stable")
    part, rows = part[by], rows[by]
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
    return part[firsts], [rows[a:b].tobytes() for a, b in zip(firsts, [*firsts[1:], len(rows)])]


def _split(h: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    return ((h >> _U(32)) % _U(n_parts)).astype(np.uint32), (h & _U(0xFFFFFFFF)).astype(np.uint32)


def _two_places(part: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor two different places at most; the first carries how many there are."""
    by = np.lexsort((rows["place"], rows["token"], part))
    part, rows = part[by], rows[by]
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (rows["token"][1:] != rows["token"][:-1])])
    other = np.concatenate([[False], ~new[1:] & (rows["place"][1:] != rows["place"][:-1])])
    starts = np.flatnonzero(new)
    rows["n"] = 0
    rows["n"][starts] = np.add.reduceat(other.astype(np.int64), starts) + 1
    sofar = np.cumsum(other)
    second = other & (sofar - np.repeat(sofar[starts], np.diff(np.append(starts, len(rows)))) == 1)
    keep = new | second
    return part[keep], rows[keep]


def _repeated(docs: DataFrame, n_parts: int, n_rows: int, bits: int) -> DataFrame:
    """row, n, data, hot: bit maps of the anchors that occur twice, for each part of the hash space or (row) several; how
    many places they have; and those that have more than HOT."""

    def emit(held):
        part, data = _packed(*_two_places(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])))
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(data, pa.binary())], names=["part", "data"])

    def run(batches):
        first, held, size = _First(), [], 0
        for batch in batches:
            for _, h, cls, _doc, _at, lo, _hi, shift in _found(batch, first):
                part, token = _split(h, n_parts)
                rows = np.empty(len(h), _ANCHOR)
                rows["token"], rows["n"] = token, 1
                rows["place"] = mix(cls.view(np.uint64) * _TURN[0] + (lo + shift).astype(np.uint64))
                held.append((part, rows))
                size += len(h)
                if size > 500_000:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    types = [("row", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("hot", pa.list_(pa.int64()))]

    def meet(key, t):
        rows = np.concatenate([np.frombuffer(x, _ANCHOR) for x in t.column("data").to_pylist()])
        rows = rows[np.lexsort((rows["place"], rows["token"]))]
        new = np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]])
        starts = np.flatnonzero(new)
        places = np.add.reduceat(rows["n"].astype(np.int64), starts)
        low = np.concatenate([starts[1:], [len(rows)]]) - 1  # places are sorted: several if the last differs from the first
        several = rows["place"][starts] != rows["place"][low]
        twice, held = rows["token"][starts[several]], np.zeros(1 << bits, bool)
        held[twice & np.uint32((1 << bits) - 1)] = True
        part = key[0].as_py()
        hot = [_signed(part, x) for x in rows["token"][starts[several & (places > HOT)]].tolist()]
        return pa.Table.from_arrays([pa.array(c, k) for c, (_, k) in zip(([part % n_rows], [int(places[several].sum())], [np.packbits(held, bitorder="little").tobytes()], [hot]), types)], names=[n for n, _ in types])

    def joined(key, t):
        data = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("data").to_pylist()])
        hot = [x for v in t.column("hot").to_pylist() for x in v]
        return pa.Table.from_arrays([pa.array(c, k) for c, (_, k) in zip(([key[0].as_py()], [sum(t.column("n").to_pylist())], [data.tobytes()], [hot]), types)], names=[n for n, _ in types])

    schema = "row int, n long, data binary, hot array<long>"
    out = _source(docs).mapInArrow(run, "part int, data binary").groupBy("part").applyInArrow(meet, schema)
    return out.groupBy("row").applyInArrow(joined, schema) if n_parts > n_rows else out


def _signed(part: int, token: int) -> int:
    """One number for an anchor, to ask the bit map of hot ones for."""
    return int(mix(np.array([part << 32 | token], np.uint64)).view(np.int64)[0])


def _is_hot(part: np.ndarray, token: np.ndarray, hot) -> np.ndarray:
    if hot is None:
        return np.zeros(len(part), bool)
    words, bits = hot
    return in_bitmap(words.value, bits, mix(part.astype(np.uint64) << _U(32) | token.astype(np.uint64)).view(np.int64))


def _hits(batch, first: _First, n_parts: int, bits: int, maps: np.ndarray):
    """What _found() gives, for anchors that occur twice only, with part and token."""
    for raw, h, cls, doc, at, lo, hi, shift in _found(batch, first):
        part, token = _split(h, n_parts)
        bit = (token & np.uint32((1 << bits) - 1)).astype(np.int64)
        hit = np.flatnonzero((maps[part.astype(np.int64) % len(maps), bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
        if len(hit):
            yield raw, part[hit], token[hit], *(x[hit] for x in (h, cls, doc, at, lo, hi, shift))


def window_hashes(raw: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the windows that begin at these places."""
    eights = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,))
    out = np.full(len(at), seed, np.uint64)
    for k in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
        out = mix(out * _TURN[1] + eights[at + k])
    return out


def _hot_runs(docs: DataFrame, n_parts: int, bits: int, filter_, hot) -> DataFrame:
    """cls, runs: repeats among the windows of hot anchors. The joins and groups are by window or by (class, place): no
    group is larger than a document."""

    def run(batches):
        first = _First()
        for batch in batches:
            for raw, part, token, _h, cls, doc, _at, lo, hi, shift in _hits(batch, first, n_parts, bits, filter_.value):
                own = np.flatnonzero(_is_hot(part, token, hot))
                if not len(own):
                    continue
                n = (hi - lo + 1)[own]
                at = np.repeat(lo[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                cols = [window_hashes(raw, at, 1).view(np.int64), window_hashes(raw, at, 2).view(np.int64), np.repeat(cls[own], n), np.repeat(doc[own], n), at + np.repeat(shift[own], n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["high", "low", "cls", "doc", "at"])

    windows = _source(docs).mapInArrow(run, "high long, low long, cls long, doc long, at long")
    # a class stands for equal texts: its least doc counts, whichever worker saw it
    windows = cut(windows.groupBy("high", "low", "cls", "at").agg(F.min("doc").alias("doc")))
    earliest = windows.groupBy("high", "low").agg(F.min(F.struct("doc", "cls", "at")).alias("x")).select("x.cls", "x.at")
    again = windows.select("cls", "at").join(earliest, ["cls", "at"], "left_anti").groupBy("cls").agg(F.collect_list("at").alias("at"))

    def packed(batches):
        for batch in batches:
            runs = []
            for at in batch.column(1).to_pylist():
                at = np.unique(np.array(at, np.int64))
                cuts = np.flatnonzero(np.diff(at) > 1)
                runs.append(np.stack([at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]], 1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.binary())], names=["cls", "runs"])

    return again.mapInArrow(packed, "cls long, runs binary")


def _contexts(docs: DataFrame, n_parts: int, bits: int, filter_, n_groups: int, hot=None) -> DataFrame:
    """part, rows, data: repeated anchors, but for hot ones, with the bytes of their windows."""

    def run(batches):
        first = _First()
        held: list[tuple] = []
        size = 0

        def emit():
            group, rows, data = (np.concatenate([x[k] for x in held]) for k in range(3))
            length = rows["runs"].astype(np.int64) + WINDOW
            starts = np.concatenate([[0], np.cumsum(length)])
            by = np.argsort(group, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group[by])) + 1, [len(by)]])
            out = ([], [], [])
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = by[a:b]
                idx = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(length[own])[:-1]]), length[own]) + np.arange(length[own].sum())
                out[0].append(int(group[own[0]]))
                out[1].append(rows[own].tobytes())
                out[2].append(data[idx].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["part", "rows", "data"])

        for batch in batches:
            for raw, part, token, h, cls, doc, at, lo, hi, shift in _hits(batch, first, n_parts, bits, filter_.value):
                own = ~_is_hot(part, token, hot)
                if not own.any():
                    continue
                part, token, h, cls, doc, at, lo, hi, shift = (x[own] for x in (part, token, h, cls, doc, at, lo, hi, shift))
                rows = np.empty(len(h), _CONTEXT)
                rows["token"], rows["part"], rows["cls"], rows["doc"] = token, part, cls, doc
                rows["first"], rows["left"], rows["runs"] = lo + shift, at - lo, hi - lo
                length = hi - lo + WINDOW
                idx = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                group = (mix(h) % _U(n_groups)).astype(np.int32)
                held.append((group, rows, raw[idx]))
                size += int(length.sum())
                if size > 8_000_000:
                    yield emit()
                    held.clear()
                    size = 0
        if held:
            yield emit()

    return _source(docs).mapInArrow(run, "part int, rows binary, data binary")


def repeats(rows: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, first window, last window) of runs of windows that an earlier equal window makes repeats."""
    # of a class the least doc_id counts; the same run may have come from several workers
    order = np.lexsort((rows["doc"], rows["first"], rows["cls"], rows["token"], rows["part"]))
    r = rows[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r["part"][1:] != r["part"][:-1]) | (r["token"][1:] != r["token"][:-1]) | (r["cls"][1:] != r["cls"][:-1]) | (r["first"][1:] != r["first"][:-1])
    order = order[fresh]
    r = rows[order]
    edge = np.concatenate([[True], (r["part"][1:] != r["part"][:-1]) | (r["token"][1:] != r["token"][:-1])])
    group = np.cumsum(edge) - 1
    many = np.bincount(group)[group] > 1
    order, r, group = order[many], r[many], group[many]
    if not len(r):
        return (np.zeros(0, np.int64),) * 3
    # from here on in the order of documents, so that the first of a class is the earliest
    by = np.lexsort((r["first"], r["cls"], r["doc"]))
    order, r, group = order[by], r[by], group[by]
    left, runs = r["left"].astype(np.int64), r["runs"].astype(np.int64)
    own = [texts[i] for i in order.tolist()]
    right_order, right_lcp = suffix_sort.sort([t[a:] for t, a in zip(own, left.tolist())], group)
    left_order, left_lcp = suffix_sort.sort([t[:a][::-1] for t, a in zip(own, left.tolist())], group)
    n = len(r)
    marks = np.zeros((n, SPAN + 1), bool)
    rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(SPAN + 1):  # the window begins o bytes left of the anchor
        live = np.flatnonzero((o <= left) & (o >= left - runs))
        if len(live) < 2:
            continue
        rank_r[right_order] = np.cumsum(right_lcp < WINDOW - o)
        rank_l[left_order] = np.cumsum(left_lcp < o)
        key = rank_r[live] * (n + 1) + rank_l[live]
        first = np.unique(key, return_index=True)[1]
        later = np.ones(len(live), bool)
        later[first] = False
        again = live[later]
        marks[again, left[again] - o] = True  # by window, from the run's first
    flat = np.zeros((n, SPAN + 3), np.int8)
    flat[:, 1:-1] = marks
    d = np.diff(flat, axis=1)
    i, a = np.nonzero(d == 1)
    _, b = np.nonzero(d == -1)
    return r["cls"][i].astype(np.int64), r["first"][i] + a, r["first"][i] + b - 1


def _repeat_runs(contexts: DataFrame) -> DataFrame:
    def run(key, t):
        rows = np.concatenate([np.frombuffer(x, _CONTEXT) for x in t.column("rows").to_pylist()])
        data = b"".join(t.column("data").to_pylist())
        ends = np.cumsum(rows["runs"].astype(np.int64) + WINDOW)
        texts = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        cls, a, b = repeats(rows, texts)
        by = np.argsort(cls, kind="stable")
        cls, spans = cls[by], np.stack([a[by], b[by]], 1).astype("<i8")
        if not len(cls):
            return pa.table({"cls": pa.array([], pa.int64()), "runs": pa.array([], pa.binary())})
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(cls)) + 1])
        return pa.table({"cls": pa.array(cls[firsts]), "runs": pa.array([spans[x:y].tobytes() for x, y in zip(firsts, [*firsts[1:], len(cls)])], pa.binary())})

    return contexts.groupBy("part").applyInArrow(run, "cls long, runs binary")


def union(runs: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Byte spans (begin, end) that runs of windows cover, joined where they touch."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1] + length)
    new = np.concatenate([[True], runs[1:, 0] > reach[:-1]])
    firsts = np.flatnonzero(new)
    return np.stack([runs[firsts, 0], reach[np.append(firsts[1:] - 1, len(runs) - 1)]], 1)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """cls, runs: for each class of equal texts, packed runs of windows that start earlier too (in other classes or
    earlier in the text)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(body("text")))).first()[0] or 0
    n_parts = max(8, int(total / 40 / ANCHORS_PER_PART) + 1)
    bits = max(LEAST_PART_BITS, min(22, MAX_FILTER_BITS - (n_parts - 1).bit_length()))
    n_rows = min(n_parts, 1 << (MAX_FILTER_BITS - bits))
    found = cut(_repeated(docs, n_parts, n_rows, bits))
    maps, n_twice = np.zeros((n_rows, 1 << (bits - 3)), np.uint8), 0
    for r in found.select("row", "n", "data").toLocalIterator():  # 2**MAX_FILTER_BITS bits at most, whatever the corpus
        maps[r["row"]], n_twice = np.frombuffer(r["data"], np.uint8), n_twice + r["n"]
    n_groups = max(8, n_twice // CONTEXTS_PER_PART + 1)
    filter_ = spark.sparkContext.broadcast(maps)
    keys = found.select(F.explode("hot").alias("key"))
    n_hot = keys.count()
    if not n_hot:
        return _repeat_runs(_contexts(docs, n_parts, bits, filter_, n_groups))
    hot = bitmap(keys, n_hot)  # what it takes for hot by chance goes the other way, to the same result
    return _repeat_runs(_contexts(docs, n_parts, bits, filter_, n_groups, hot)).unionByName(_hot_runs(docs, n_parts, bits, filter_, hot))


def _kept(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """cls, n_removed, n_spans, kept: for classes with repeats, what stays of the text and its digest."""
    wanted = runs.select("cls").distinct()

    def once(batches):
        seen: set[int] = set()
        for batch in batches:
            keep = []
            for c in batch.column(0).to_pylist():
                if len(seen) > SEEN:
                    seen.clear()
                keep.append(c not in seen)
                seen.add(c)
            yield batch.filter(pa.array(keep, pa.bool_()))

    def cut_out(batches):
        for batch in batches:
            rows = []
            for c, text, runs_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_buffer().to_pybytes()
                spans = union(np.concatenate([np.frombuffer(x, "<i8") for x in runs_]).reshape(-1, 2))
                at, parts = 0, []
                for a, b in spans.tolist():
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                kept = b"".join(parts)
                rows.append((c, len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["cls", "n_removed", "n_spans", "kept_sha256", "kept"])

    texts = _source(docs).select("cls", "text").where(F.octet_length("text") >= WINDOW).mapInArrow(once, "cls long, text binary")
    texts = texts.join(wanted, "cls", "left_semi")
    gathered = runs.groupBy("cls").agg(F.collect_list("runs").alias("runs"))
    return texts.join(gathered, "cls").select("cls", "text", "runs").mapInArrow(cut_out, "cls long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) for each row of docs.

    Null texts are empty; texts under 100 bytes keep all; texts of any length are read in pieces of BLOCK bytes; of equal texts all but the one with the least doc_id (null
    counts as least) lose all; equal rows stay or go together; empty tables give no rows; other columns are not read.
    """
    src = _source(docs).select("cls", "doc", F.octet_length("text").cast("long").alias("n_bytes"))
    firsts = src.groupBy("cls").agg(F.min("doc").alias("first"))
    runs = cut(repeated_runs(docs))
    cols = ["cls", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    cuts = _kept(docs, runs).select(*cols).dropDuplicates(["cls"])
    raw = body("text").cast("binary")
    rows = docs.select("doc_id", F.xxhash64(raw).alias("cls"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"), *([raw.alias("raw")] * with_text))
    out = rows.join(firsts.join(cuts, "cls", "left"), "cls")
    gone = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= WINDOW)
    out = out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        *([F.when(gone, F.lit("").cast("binary")).otherwise(F.coalesce("kept", "raw")).alias("kept")] * with_text),
    )
    return out


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


#: Bytes as pairs of hexadecimal digits; a window is 200 of them.
ORACLE_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM t WHERE length(h) >= 200)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g
      FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM r)),
p AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, g),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM q JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
