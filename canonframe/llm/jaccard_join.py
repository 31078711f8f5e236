"""Exact Jaccard self-join of documents' shingle sets by set-relation skipping.

Equal sets become one class first. The rest follows the prefix principle: sets that are 75 in 100 alike share a token
among the n - ceil(0.75 n) + 1 first tokens of each, in any fixed token order; ours puts tokens first that few documents
hold (by a fixed-size count sketch of all documents), so that common passages seldom lie in a prefix.

Index lists are sorted by set size and position and skipped block by block where size or position rule a pair out.
Short lists give their pairs. In a long list each set is first compared with two leaders only (round one); the links that
were verified give provisional components and, for each set, its exact distance to a leader. Round two then looks only at
pairs across components, and derives most answers from the leader's: by the triangle inequality of set differences a pair
is linked or ruled out without a look at its sets. 1024-bit parity maps rule out most of the rest; what remains is
verified on the sets. Pairs inside a component are never made, so a group of copies costs its size, not its square.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonframe.llm import shingle_sets as S
from canonframe.llm.common import bitmap, body, cut, flagged, free, given_back, in_bitmap, row_key, table
from canonframe.llm.components import components
from canonframe.llm.decontamination import SHINGLES_SQL

PERCENT = 75
SKETCH_BITS = 20
SKETCH_BLOCK = 4096
#: Lists of at most this many sets give all their pairs at once.
SHORT_LIST = 8
#: Entries of a long list that one task of round two looks at (beside those outside the list's main component).
LIST_BLOCK = 8192
#: Postings that one task of round one holds, on average.
POSTINGS_PER_PART = 300_000
#: A list that may hold more sets (by the count sketch) is dealt to several tasks; their leaders meet in a list of their own.
HOT_LIST = 150_000
MAP_BITS = 1024
SEEN = 100_000

_PROFILE = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])


def need(na, nb, percent: int = PERCENT):
    """Least intersection of two sets of these sizes that links them."""
    return -((-percent * (na + nb)) // (100 + percent))


def prefix(n, percent: int = PERCENT):
    return n + 1 - (percent * n + 99) // 100


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), body("text").cast("binary").alias("text"))


def _profile(docs: DataFrame) -> DataFrame:
    """kind 0: a row for each document with size and fingerprint of its set; kind 1: blocks of the token count sketch."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            n, fp, held = [], [], []
            for tokens in S.sets(batch.column(2)):
                n.append(len(tokens))
                fp.append(S.print_of(tokens))
                held.append(tokens)
                if sum(map(len, held)) > 1 << 20:
                    counts += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                    held = []
            if held:
                counts += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=_PROFILE)
        blocks = counts.reshape(-1, SKETCH_BLOCK)
        used = np.flatnonzero(blocks.any(1))
        k = len(used)
        yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(used, pa.int32()), pa.array([blocks[b].astype("<i4").tobytes() for b in used], pa.binary())], schema=_PROFILE)

    return _source(docs).mapInArrow(run, "kind int, key long, doc_id long, n int, fp long, block int, counts binary")


def _sketch(profile: DataFrame) -> np.ndarray:
    """The summed sketch: 2**SKETCH_BITS counts, whatever the corpus."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[b] = sums.get(b, 0) + np.frombuffer(raw, "<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, (1 << 31) - 1).astype("<i4").tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])

    rows = profile.where("kind = 1").select("block", "counts").repartition("block").mapInArrow(run, "block int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    for r in rows:
        out[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["counts"], "<i4")
    return out


#: A posting: the whole 64-bit token, its set and the set's size, and the token's place; HOT marks a list of several tasks.
_POSTING = np.dtype([("token", "<i8"), ("fp", "<i8"), ("n", "<i4"), ("at", "<i4")])
_HOT = 1 << 30


def _postings(docs: DataFrame, order, n_parts: int) -> DataFrame:
    """part, data: packed postings (token, set, size, position) of prefixes; a set once for each worker's stretch."""

    def run(batches):
        seen: set[int] = set()
        rank = order.value
        held: list[np.ndarray] = []
        size = 0

        def out():
            rows = np.concatenate([h[1] for h in held])
            part = np.concatenate([h[0] for h in held])
            by = np.argsort(part, kind="stable")
            rows, part = rows[by], part[by]
            cuts = np.flatnonzero(np.diff(part)) + 1
            firsts = np.concatenate([[0], cuts])
            return pa.RecordBatch.from_arrays([pa.array(part[firsts], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(firsts, [*cuts, len(rows)])], pa.binary())], names=["part", "data"])

        for batch in batches:
            for tokens in S.sets(batch.column(2)):
                n = len(tokens)
                if not n:
                    continue
                fp = S.print_of(tokens)
                if fp in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(fp)
                k = prefix(n)
                count = rank[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                by = np.lexsort((tokens, count))[:k]
                first, tasks = tokens[by], (count[by].astype(np.int64) - 1) // HOT_LIST  # above 0: a list of several tasks
                rows = np.empty(k, _POSTING)
                rows["token"], rows["fp"], rows["n"], rows["at"] = first.view(np.int64), fp, n, np.arange(k) | np.where(tasks > 0, _HOT, 0)
                part = (first >> np.uint64(32)) % np.uint64(n_parts)
                hot = np.flatnonzero(tasks > 0)
                if len(hot):
                    own = S.mix(np.full(len(hot), fp, np.int64).view(np.uint64)) % (tasks[hot] + 1).astype(np.uint64)
                    part[hot] = S.mix(first[hot] + own) % np.uint64(n_parts)
                held.append((part.astype(np.int32), rows))
                size += k
                if size > 500_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return _source(docs).mapInArrow(run, "part int, data binary")


_LISTS = pa.schema([("kind", pa.int32()), ("token", pa.int64()), ("a", pa.int64()), ("na", pa.int32()), ("b", pa.int64()), ("nb", pa.int32()), ("at", pa.int32())])


def possible(na, pa_, nb, pb, percent: int = PERCENT):
    """Size and position filters for sets that share the tokens at these places."""
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1
    return most >= need(na, nb, percent)


def _leaders(token_of: np.ndarray, fp: np.ndarray, salt: int) -> np.ndarray:
    """For each row (sorted by its list), the row that leads its list: the one of least hash."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(token_of)) + 1, [len(token_of)]])
    which = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    return np.lexsort((S.mix(fp.view(np.uint64) ^ np.uint64(salt)), which))[cuts[:-1]][which]


SALTS = (0x1234567, 0x7654321)


def _pairs_of_part(raw: list[bytes]):
    rows = np.concatenate([np.frombuffer(r, _POSTING) for r in raw])
    rows = rows[np.lexsort((rows["fp"], rows["at"], rows["n"], rows["token"]))]
    hot = rows["at"] >= _HOT
    rows["at"] &= _HOT - 1
    token = rows["token"]
    same = np.concatenate([[False], (token[1:] == token[:-1]) & (rows["fp"][1:] == rows["fp"][:-1])])
    rows, token, hot = rows[~same], token[~same], hot[~same]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1, [len(rows)]])
    size = np.repeat(np.diff(cuts), np.diff(cuts))
    keep = (size > 1) | hot
    rows, token, size, hot = rows[keep], token[keep], size[keep], hot[keep]
    found, shared = [], []
    few = (size <= SHORT_LIST) & ~hot
    short, own = rows[few], token[few]
    for s in range(1, SHORT_LIST):
        i = np.flatnonzero(own[s:] == own[:-s]) if len(short) > s else []
        if len(i) == 0:
            break
        x, y = short[i], short[i + s]
        ok = possible(x["n"].astype(np.int64), x["at"], y["n"].astype(np.int64), y["at"])
        found.append((x[ok], y[ok]))
        shared.append(np.ones(int(ok.sum()), np.int64))
    long_, own, hot = rows[~few], token[~few], hot[~few]
    heads = np.zeros(0, np.int64)
    if len(long_):
        for salt in SALTS:
            lead = _leaders(own, np.ascontiguousarray(long_["fp"]), salt)
            x, y = long_[lead], long_
            ok = (x["fp"] != y["fp"]) & possible(x["n"].astype(np.int64), x["at"], y["n"].astype(np.int64), y["at"])
            found.append((x[ok], y[ok]))
            shared.append(np.zeros(int(ok.sum()), np.int64))
            heads = np.concatenate([heads, lead[hot]])
        heads = np.unique(heads)
    pairs, times = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
    if found:
        x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        swap = x["fp"] > y["fp"]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        by = np.lexsort((y["fp"], x["fp"]))
        x, y, weight = x[by], y[by], np.concatenate(shared)[by]
        new = np.concatenate([[True], (x["fp"][1:] != x["fp"][:-1]) | (y["fp"][1:] != y["fp"][:-1])]) if len(x) else np.zeros(0, bool)
        times = np.add.reduceat(weight, np.flatnonzero(new)) if len(x) else times
        x, y = x[new], y[new]
        pairs = np.stack([x["fp"], x["n"].astype(np.int64), y["fp"], y["n"].astype(np.int64)], 1)
    k, m, h = len(pairs), len(long_), len(heads)
    zero = lambda n: np.zeros(n, np.int64)
    cols = [
        np.concatenate([zero(k), np.full(m, 1), np.full(h, 2)]), np.concatenate([zero(k), own, own[heads]]),
        np.concatenate([pairs[:, 0], long_["fp"], long_["fp"][heads]]), np.concatenate([pairs[:, 1], long_["n"].astype(np.int64), long_["n"][heads].astype(np.int64)]),
        np.concatenate([pairs[:, 2], zero(m + h)]), np.concatenate([pairs[:, 3], zero(m + h)]),
        np.concatenate([times, long_["at"].astype(np.int64), long_["at"][heads].astype(np.int64)]),
    ]
    return pa.Table.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, _LISTS)], schema=_LISTS)


def _lists(postings: DataFrame) -> DataFrame:
    """kind 0: candidate pairs (a below b), with the number of short lists they share as `at`; kind 1: entries of long lists;
    kind 2: leaders of the parts of lists that several tasks hold."""

    def run(key, part):
        return _pairs_of_part(part.column("data").to_pylist())

    return postings.groupBy("part").applyInArrow(run, "kind int, token long, a long, na int, b long, nb int, at int")


def _heads(lists: DataFrame) -> DataFrame:
    """Pairs of the leaders of one list's parts with the leader of them all, like kind 0 of _lists()."""
    heads = lists.where("kind = 2").select("token", F.col("a").alias("fp"), F.col("na").alias("n")).distinct()
    first = heads.groupBy("token").agg(F.min(F.struct(_rank(F.col("fp")).alias("r"), "fp", "n")).alias("x")).select("token", F.col("x.fp").alias("lead"), F.col("x.n").alias("nl"))
    pairs = heads.join(first, "token").where("fp <> lead")
    low = F.col("fp") < F.col("lead")
    return pairs.select(
        F.least("fp", "lead").alias("a"), F.when(low, F.col("n")).otherwise(F.col("nl")).alias("na"), F.greatest("fp", "lead").alias("b"), F.when(low, F.col("nl")).otherwise(F.col("n")).alias("nb"), F.lit(0).alias("at")
    )


def _sets(docs: DataFrame, fps: DataFrame, standing: DataFrame, maps: bool = False) -> DataFrame:
    """fp, data: each wanted set once, as its compressed text (smaller than its hashes, which do not compress) or as its
    parity map. standing: fp and the key of the one document that stands for it; other documents are passed over."""
    wanted = standing.join(fps, "fp", "left_semi")
    filter_, bits = bitmap(wanted, wanted.count())

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(filter_.value, bits, batch.column(0).to_numpy()), pa.bool_()))
            fp, data = [], []
            for text, tokens in zip(batch.column(2), S.sets(batch.column(2))):
                if len(tokens):
                    fp.append(S.print_of(tokens))
                    data.append(parity(tokens).tobytes() if maps else packer.compress(text.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(data, pa.binary())], names=["fp", "data"])

    rows = _source(docs).mapInArrow(run, "fp long, data binary")
    return rows.join(fps.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each of MAP_BITS classes of tokens, whether the set holds an odd number: two maps differ in no more bits than
    their sets in tokens."""
    counts = np.bincount((tokens & np.uint64(MAP_BITS - 1)).astype(np.int64), minlength=MAP_BITS)
    return np.packbits((counts & 1).astype(np.uint8))


class _Unpacked:
    """Sets of packed texts; the last few stay, since a leader's pairs come one after the other."""

    def __init__(self) -> None:
        import zstandard

        self.unpack, self.held = zstandard.ZstdDecompressor().decompress, {}

    def __call__(self, fp: int, data) -> np.ndarray:
        tokens = self.held.get(fp)
        if tokens is None:
            if len(self.held) >= 64:
                self.held.clear()
            raw = np.frombuffer(self.unpack(data.as_buffer()), np.uint8)
            tokens = self.held[fp] = S.set_of(S.word_hashes(raw))
        return tokens


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, na, b, nb, common: exact intersection sizes."""

    def run(batches):
        get = _Unpacked()
        for batch in batches:
            common = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4), batch.column(5)):
                u, v = get(a, x), get(b, y)
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                common.append(int((v[at] == u).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(common, pa.int32())], names=["a", "na", "b", "nb", "common"])

    x, y = sets.select(F.col("fp").alias("a"), F.col("data").alias("x")), sets.select(F.col("fp").alias("b"), F.col("data").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "na", "b", "nb", "x", "y").mapInArrow(run, "a long, na int, b long, nb int, common int")


def _linked(common, na, nb, percent: int = PERCENT):
    return common * 100 >= (na + nb - common) * percent


def _across(entries: DataFrame, best: bool) -> DataFrame:
    """Pairs of one list in different components that no filter rules out; with `best`, for each set and other component
    only the pair whose maps are nearest (any one link joins the components).

    entries: token, band, block, own, fp, n, at, comp, lead, far (distance to lead), map. kind 0: to verify; kind 1: linked.
    """

    def run(key, t):
        col = {c: t.column(c).to_numpy() for c in ("fp", "n", "at", "comp", "lead", "far", "own")}
        order = np.lexsort((col["at"], col["n"]))
        col = {c: v[order] for c, v in col.items()}
        n, at, own = col["n"].astype(np.int64), col["at"].astype(np.int64), col["own"].astype(bool)
        maps = np.frombuffer(b"".join(t.column("map").to_pylist()), np.uint64).reshape(len(n), -1)[order]
        top = np.bincount(np.unique(col["comp"], return_inverse=True)[1])
        labels, inverse = np.unique(col["comp"], return_inverse=True)
        main = labels[top.argmax()]
        out = []
        for i in np.flatnonzero(col["comp"] != main):  # a pair across components has a side outside the main one
            # sizes are sorted: blocks of the list whose sizes rule them out are skipped
            lo, hi = np.searchsorted(n, -((-PERCENT * n[i]) // 100)), np.searchsorted(n, n[i] * 100 // PERCENT, "right")
            j = np.arange(lo, hi)
            both_out = col["comp"][j] != main
            j = j[(col["comp"][j] != col["comp"][i]) & (own[j] | own[i]) & ~(both_out & (j < i))]
            j = j[possible(n[i], at[i], n[j], at[j])]
            if not len(j):
                continue
            room = n[i] + n[j] - 2 * need(n[i], n[j])  # largest set difference of a link
            near, far = np.full(len(j), False), np.full(len(j), False)
            known = (col["lead"][j] == col["lead"][i]) & (col["far"][j] >= 0) & (col["far"][i] >= 0)
            near[known] = (col["far"][j] + col["far"][i])[known] <= room[known]
            far[known] = np.abs(col["far"][j] - col["far"][i])[known] > room[known]
            apart = np.bitwise_count(maps[j] ^ maps[i]).sum(1).astype(np.int64)
            far |= apart > room
            if best:
                order_ = np.lexsort((apart - room, far, ~near, col["comp"][j]))
                first = order_[np.concatenate([[True], col["comp"][j][order_][1:] != col["comp"][j][order_][:-1]])]
                j, near, far = j[first], near[first], far[first]
            for k, kind in ((j[near], 1), (j[~near & ~far], 0)):
                out.append(np.stack([np.full(len(k), kind), np.full(len(k), col["fp"][i]), np.full(len(k), n[i]), col["fp"][k], n[k]], 1))
        rows = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
        swap = rows[:, 1] > rows[:, 3]
        rows[swap] = rows[swap][:, [0, 3, 4, 1, 2]]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        return pa.Table.from_arrays([pa.array(rows[:, c]).cast(k) for c, k in enumerate(types)], names=["kind", "a", "na", "b", "nb"])

    return entries.groupBy("token", "band", "block").applyInArrow(run, "kind int, a long, na int, b long, nb int")


def _with_comps(entries: DataFrame, comps: DataFrame) -> DataFrame:
    return entries.join(comps.withColumnRenamed("node", "fp").withColumnRenamed("root", "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))


def _mixed(entries: DataFrame) -> DataFrame:
    """Lists that still have several components: token, the main component, the list's length."""
    by_comp = entries.groupBy("token", "comp").agg(F.count("*").alias("m"))
    lists = by_comp.groupBy("token").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("entries"))
    return lists.where("comps > 1").drop("comps")


def _spread(rest: DataFrame, comps: DataFrame, mixed: DataFrame) -> DataFrame:
    """Entries of lists that still have several components, dealt into blocks.

    A list of at most LIST_BLOCK entries is one block (of band -1), and each of its entries is there once. Blocks of a longer
    one are bands of sizes, each band dealt to as many blocks as it has LIST_BLOCKs of entries. Sizes of linked sets differ by
    a factor of 4/3 at most, so they lie in one band or in neighbouring ones. An entry outside its list's main component goes
    to all blocks that hold sets of sizes it could be linked with, and to no other.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / PERCENT) + 1e-9)).cast("int")
    entries = _with_comps(rest, comps).join(mixed, "token").withColumn("band", F.when(F.col("entries") <= LIST_BLOCK, F.lit(-1)).otherwise(band)).drop("entries")
    one = entries.where("band < 0").withColumn("block", F.lit(0)).withColumn("own", F.lit(1))
    if mixed.where(F.col("entries") > LIST_BLOCK).isEmpty():
        return one
    entries = entries.where("band >= 0")
    bands = entries.groupBy("token", "band").agg(F.ceil(F.count("*") / F.lit(LIST_BLOCK)).cast("int").alias("blocks"))
    home = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    here = entries.join(bands, ["token", "band"]).withColumn("block", home).drop("blocks").withColumn("own", F.lit(1))
    outside = entries.where("comp <> main").withColumn("there", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    there = outside.join(bands.withColumnRenamed("band", "there"), ["token", "there"])
    there = there.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where((F.col("there") != F.col("band")) | (F.col("block") != home))
    there = there.drop("blocks", "band").withColumnRenamed("there", "band").withColumn("own", F.lit(0))
    return one.unionByName(here).unionByName(there)


def links(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """u, v: links between fingerprints whose components are those of all links."""
    spark = docs.sparkSession
    given_back(spark)
    order = spark.sparkContext.broadcast(_sketch(profile))
    total = profile.where("kind = 0").agg(F.sum(F.expr(f"n + 1 - cast(ceil({PERCENT} * n / 100) AS int)"))).first()[0] or 0
    n_parts = max(8, -(-total // POSTINGS_PER_PART))
    lists = cut(_lists(_postings(docs, order, n_parts)))
    standing = cut(profile.where("kind = 0 AND n > 0").groupBy("fp").agg(F.min("key").alias("key")))
    # round one: two sets share no more tokens than the short lists they share, the long lists either is in, and what lies
    # behind their prefixes
    long_ = lists.where("kind = 1").groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("k"))
    pairs = lists.where("kind = 0").select("a", "na", "b", "nb", "at").unionByName(_heads(lists)).groupBy("a", "na", "b", "nb").agg(F.sum("at").alias("shared"))
    pairs = pairs.join(long_.select(F.col("fp").alias("a"), F.col("k").alias("ka")), "a", "left").join(long_.select(F.col("fp").alias("b"), F.col("k").alias("kb")), "b", "left")
    most = F.col("shared") + F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0))) + F.greatest(*[F.floor(F.col(c) * PERCENT / 100 + 0.99) - 1 for c in ("na", "nb")])
    pairs = cut(pairs.where(most * (100 + PERCENT) >= (F.col("na") + F.col("nb")) * PERCENT).select("a", "na", "b", "nb"))
    fps = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    checked = cut(_verified(pairs, _sets(docs, fps, standing)))
    first = checked.where(_linked(F.col("common"), F.col("na"), F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    comps = cut(components(first))

    entries = lists.where("kind = 1").select("token", F.col("a").alias("fp"), F.col("na").alias("n"), "at")
    mixed = cut(_mixed(_with_comps(entries, comps)))
    rest = cut(entries.join(mixed.select("token"), "token", "left_semi"))
    if rest.isEmpty():
        return first
    given_back(spark)
    distance = F.col("na") + F.col("nb") - 2 * F.col("common")
    ends = checked.select(F.col("a").alias("lead"), F.col("b").alias("fp"), distance.alias("far")).unionByName(checked.select(F.col("b").alias("lead"), F.col("a").alias("fp"), distance.alias("far")))
    leads = ends.groupBy("fp").agg(F.min(F.struct(_rank(F.col("lead")).alias("r"), "lead", "far")).alias("x")).select("fp", "x.lead", "x.far")
    maps = _sets(docs, rest.select("fp").distinct(), standing, maps=True).select("fp", F.col("data").alias("map"))
    rest = cut(rest.join(leads, "fp", "left").join(maps, "fp").withColumn("lead", F.coalesce("lead", F.lit(0))).withColumn("far", F.coalesce("far", F.lit(-1))))
    done = checked.select("a", "b")
    tree = comps
    for best in (True, False):  # the most promising pairs first; then whatever is left between components
        spread = _spread(rest, tree, mixed).select("token", "band", "block", "own", "fp", "n", "at", "comp", "lead", "far", "map")
        across = cut(_across(spread, best).distinct())
        derived = across.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
        pairs = cut(across.where("kind = 0").select("a", "na", "b", "nb").join(done, ["a", "b"], "left_anti"))
        fps = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        verified = cut(_verified(pairs, _sets(docs, fps, standing)))
        found = verified.where(_linked(F.col("common"), F.col("na"), F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
        edges = tree.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(derived).unionByName(found)
        if best:
            tree = cut(components(edges))
            mixed = cut(_mixed(_with_comps(rest, tree)))
            given_back(spark)
            done = done.unionByName(verified.select("a", "b"))
    return edges


def _rank(c):
    """An order of leaders that favours the same few."""
    return F.xxhash64(c, F.lit(11))


def classes(docs: DataFrame) -> DataFrame:
    """key (row_key), doc_id, n_shingles, component_id, stays (whether it stands for its component) for each row of docs.

    A document without words (null, empty or white text) has no set and links with nothing. Rows with equal sets are in
    one component; a null doc_id takes the least other doc_id of its component, null if there is none. Ties do not
    arise: component ids are least doc_ids. Empty tables give no rows; other columns are not read.
    """
    profile = cut(_profile(docs))
    rows = profile.where("kind = 0").select("key", "doc_id", F.col("n").cast("long").alias("n_shingles"), "fp")
    comps = components(links(docs, profile))
    full = rows.where("n_shingles > 0").join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("root", "fp"))
    least = full.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"))
    out = full.join(least, "comp").select("key", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("key") == F.col("least.key")).alias("stays"))
    return out.unionByName(rows.where("n_shingles = 0").select("key", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs' rows, with all columns, that stand for their component: those of least doc_id (null last; then by a hash of
    the row). Documents without words all stay; of equal rows of a document that stands for others one stays."""
    rows = cut(classes(docs).groupBy("key").agg(F.count("*").alias("n"), F.max("n_shingles").alias("k"), F.max("stays").alias("stays")))
    key, may = free(docs, "__cf_key"), free(docs, "__cf_may")
    # rows that go, and those that repeat a row that stays, are asked for; the others cross no shuffle
    changed = cut(rows.where("not stays or (n > 1 and k > 0)").select(F.col("key").alias(key), "stays"))
    marked = flagged(docs.withColumn(key, row_key()), key, changed, changed.count(), may)
    some = marked.where(may)
    single = some.join(changed, key, "left_anti").select(*marked.columns)
    kept = marked.where(~F.col(may)).unionByName(single)
    again = changed.where("stays").select(key)
    if not again.isEmpty():
        kept = kept.unionByName(some.join(again, key, "left_semi").dropDuplicates([key]).select(*marked.columns))
    return kept.drop(key, may)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = f"""
WITH RECURSIVE d AS ({SHINGLES_SQL.format(id="doc_id", table="documents")}),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b USING (s) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT reach.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY reach.doc_id
"""
