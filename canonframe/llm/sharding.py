"""Hierarchical weighted hash tree: keys descend region, rack and shard levels by weighted hash draws.

Every node keeps the segments in which its weight came: one for the shards it was built with and one for each shard
added later. A key draws an exponential for each segment of a level, divided by the segment's weight, and follows the
smallest draw. A later shard only adds a segment along its own path; a key either keeps all its draws or falls into the
new segment, which leads to the new shard alone. So growth moves rows into the new shard and nowhere else, and the weights
still decide the shares. Another weight for a shard (Tree.reweigh) changes the draws of the subtrees on its path alone.

Everything is a Catalyst expression of the key: no shuffle for the assignment itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonframe.llm import ranks
from canonframe.llm.common import body, table

LAW = "key"


@dataclass(frozen=True)
class Tree:
    """segments: ((region, rack, shard, weight), ...) groups, the first as built, the others one for each growth."""

    segments: tuple[tuple[tuple[int, int, int, float], ...], ...] = field(default_factory=tuple)

    @staticmethod
    def build(n_shards: int, racks: int = 2, per_rack: int = 2, weights: dict[int, float] | None = None) -> Tree:
        leaves = []
        for s in range(n_shards):
            rack = s // per_rack
            leaves.append((rack // racks, rack, s, float((weights or {}).get(s, 1.0))))
        return Tree((tuple(leaves),))

    def reweigh(self, shard: int, weight: float) -> Tree:
        """The same tree with another weight for a shard.

        Draws of subtrees that do not hold the shard stay what they are, so a key moves only into (or, for a lower weight,
        out of) a subtree on the shard's path: never between two regions, two racks of its region or two shards of its rack
        whose weights have not changed.
        """
        if shard not in {x[2] for leaves in self.segments for x in leaves}:
            raise ValueError(f"the tree has no shard {shard}")
        return Tree(tuple(tuple((*x[:3], float(weight)) if x[2] == shard else x for x in leaves) for leaves in self.segments))

    def grow(self, region: int, rack: int, shard: int, weight: float = 1.0) -> Tree:
        return Tree((*self.segments, ((region, rack, shard, float(weight)),)))


def _draw(key: str, path: str, weight: float) -> str:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash of key and path."""
    return f"(-ln(((xxhash64({key}, '{path}') & 4503599627370495) + 0.5D) / 4503599627370496D) / {weight!r}D)"


def _choose(options: list[tuple[str, str]]) -> str:
    """options: (draw, outcome); the outcome of the smallest draw."""
    if len(options) == 1:
        return options[0][1]
    best = "array_min(array(" + ", ".join(f"struct({d} AS d, {i} AS i)" for i, (d, _) in enumerate(options)) + ")).i"
    return f"CASE {best} " + " ".join(f"WHEN {i} THEN {o}" for i, (_, o) in enumerate(options)) + " END"


def _descend(key: str, leaves: tuple, level: int, path: str) -> str:
    if level == 3:
        return str(leaves[0][2])
    names = sorted({x[level] for x in leaves})
    options = []
    for n in names:
        own = tuple(x for x in leaves if x[level] == n)
        at = f"{path}/{n}"
        options.append((_draw(key, at, sum(x[3] for x in own)), _descend(key, own, level + 1, at)))
    return _choose(options)


def shard_sql(key: str, tree: Tree) -> str:
    """SQL for the shard of a key (any string expression); null keys count as ''."""
    key = f"coalesce(cast({key} AS string), '')"
    tops = []
    for k, leaves in enumerate(tree.segments):
        for region in sorted({x[0] for x in leaves}):
            own = tuple(x for x in leaves if x[0] == region and x[3] > 0)
            if own:
                at = f"{k}:{region}"
                tops.append((_draw(key, at, sum(x[3] for x in own)), _descend(key, own, 1, at)))
    if not tops:
        raise ValueError("the tree has no shard of positive weight")
    return _choose(tops)


def shard_of(key: str, tree: Tree) -> Column:
    return F.expr(f"cast({shard_sql(key, tree)} AS int)")


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key, size, text_crc32, shard, slot, grown_shard.

    Null texts have size 1 and the checksum of no bytes; a null key is one key of its own; repeated rows share a shard
    and get different slots; an empty table gives no rows; a text of any length is read once, for its size and checksum.
    Other columns of docs are not read. Slots are the ranks of ranks.ranked(): no shard, null key or repeated row is
    gathered in one task.
    """
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    raw = body("t").cast("binary")
    rows = docs.select(
        "k",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        shard_of("k", tree).alias("shard"),
        (shard_of("k", grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    out = ranks.ranked(rows, "shard", docs.count(), "slot", ranks.ROWS_PER_CHUNK * 16)
    return out.select(F.col("k").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")


TREE = Tree.build(16)
GROWN = TREE.grow(region=0, rack=1, shard=16)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"), TREE, GROWN)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")
