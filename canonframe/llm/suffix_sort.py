"""Deep-shallow sorting of byte strings inside groups, with longest common prefixes.

Shallow: multikey quicksort (three-way partitions) whose characters are eight bytes wide, all buckets at once, to SHALLOW bytes. Deep:
strings that still share a bucket go into a blind trie (a Patricia trie that is descended without looking at skipped
bytes; one comparison at the leaf then gives the place to branch), read off in order.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def lcp(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    d = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - 1 - (d.bit_length() - 1) // 8


class BlindTrie:
    """Distinct byte strings; a node is [depth, {byte or -1: child}], a leaf the string itself."""

    def __init__(self, first: bytes) -> None:
        self.root: list | bytes = first

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, s: bytes) -> None:
        node = self.root
        while type(node) is list:
            kids = node[1]
            node = kids.get(self._at(s, node[0]))
            if node is None:
                node = next(iter(kids.values()))
        if node == s:
            return
        depth, above, key, node = lcp(node, s), None, None, self.root
        while type(node) is list and node[0] < depth:
            above, key = node, self._at(s, node[0])
            node = node[1][key]
        if type(node) is list and node[0] == depth:
            node[1][self._at(s, depth)] = s
            return
        low = node
        while type(low) is list:
            low = next(iter(low[1].values()))
        fork = [depth, {self._at(low, depth): node, self._at(s, depth): s}]
        if above is None:
            self.root = fork
        else:
            above[1][key] = fork

    def in_order(self) -> list[bytes]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def _words(strings: list[bytes]) -> np.ndarray:
    """The first SHALLOW bytes of each as big-endian numbers, a row each."""
    flat = b"".join([s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings])
    return np.frombuffer(flat, ">u8").reshape(len(strings), -1).astype(np.uint64)


def _multikey(words: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket and words, and the bucket numbers after it: equal words share one.

    Multikey quicksort: a bucket is split by its pivot's character (a word of eight bytes) into the strings below, equal and
    above; the equal ones go on with the next character, the others with the same. All buckets are split in one pass.
    """
    n, depth = len(bucket), words.shape[1]
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.concatenate([[True], b[1:] != b[:-1]]) if n else np.zeros(0, bool)  # where buckets begin
    level = np.zeros(n, np.int64)  # the character that a string's bucket is at
    while True:
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, n))
        live = np.flatnonzero((sizes > 1) & (level[starts] < depth))
        if not len(live):
            break
        size = sizes[live]
        home = np.repeat(np.arange(len(live)), size)
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = starts[live][home] + np.arange(len(home)) - base[home]  # places of all strings of live buckets
        own = order[at]
        char = words[own, level[at]]
        three = np.sort(np.stack([char[base], char[base + size // 2], char[base + size - 1]]), axis=0)
        side = np.where(char == three[1][home], 1, np.where(char < three[1][home], 0, 2))
        counts = np.bincount(home * 3 + side, minlength=3 * len(live)).reshape(-1, 3)
        # each side's strings keep their order: a string's place is its side's first place and how many of it came before
        to = np.empty(len(home), np.int64)
        for k in range(3):
            mine = side == k
            before = np.cumsum(mine) - 1
            low = np.concatenate([[0], np.cumsum(counts[:, k])[:-1]])
            to[mine] = (starts[live] + counts[:, :k].sum(1))[home[mine]] + before[mine] - low[home[mine]]
        order[to] = own
        level[to] = level[at] + (side == 1)
        bounds = (starts[live][:, None] + np.concatenate([np.zeros((len(live), 1), np.int64), np.cumsum(counts, 1)[:, :2]], 1))[counts > 0]
        first[bounds] = True
    return order, np.cumsum(first)


def sort(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order: indices sorted by (group, string); common: of each in that order with the one before it in its group,
    their longest common prefix, -1 for the first of a group."""
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = _words(strings)
    order, bucket = _multikey(words, group)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [n]])
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if z - a < 2:
            continue
        own: dict[bytes, list[int]] = {}
        for i in order[a:z].tolist():
            own.setdefault(strings[i], []).append(i)
        if len(own) > 1:
            it = iter(own)
            trie = BlindTrie(next(it))
            for s in it:
                trie.insert(s)
            order[a:z] = [i for s in trie.in_order() for i in own[s]]
    common = np.full(n, -1, np.int64)
    g = group[order]
    before = np.flatnonzero(g[1:] == g[:-1]) + 1
    idx = order.tolist()
    for i in before.tolist():
        common[i] = lcp(strings[idx[i - 1]], strings[idx[i]])
    return order, common
