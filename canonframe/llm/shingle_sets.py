"""Documents' sets of word shingles as sorted 64-bit hashes, computed with numpy over whole record batches.

Words are runs of anything but space and U+0009 to U+000D, with A to Z lower-cased. A word's hash is taken from its bytes
eight at a time, for all words of a block at once, so no word is ever a Python object. Two different words, shingles or
sets share a hash with a chance of about 2**-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
BLOCK = 1 << 19

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_TURN = np.random.default_rng(20_240_229).integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) * _U(2) + _U(1)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _hash_words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    low = np.zeros(len(raw) + 8, np.uint8)
    np.take(_LOWER, raw, out=low[:-8])
    eights = np.ndarray((len(raw) + 1,), "<u8", low, 0, (1,))  # the eight bytes from each place on
    length = end - begin
    out = mix((eights[begin] & _KEEP[np.minimum(length, 8)]) + length.astype(np.uint64) * _TURN[0])
    rest, at = np.flatnonzero(length > 8), 8
    while len(rest):
        left = length[rest] - at
        out[rest] = mix((eights[begin[rest] + at] & _KEEP[np.minimum(left, 8)]) + out[rest] * _TURN[1])
        rest, at = rest[left > 8], at + 8
    return out


def _word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts that lie in raw without gaps, and where each text's words begin.

    starts: the texts' first places and the end of the last.
    """
    inside = _WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = starts[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hash_words(raw, begin, end), np.searchsorted(begin, starts)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of one text's words in order, block by block, so that a very long text needs little memory."""
    out, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + BLOCK)
        while stop < len(raw) and _WORD[raw[stop]] and _WORD[raw[stop - 1]]:  # to the end of a cut word
            ahead = np.flatnonzero(~_WORD[raw[stop : stop + BLOCK]])
            stop = stop + int(ahead[0]) if len(ahead) else min(len(raw), stop + BLOCK)
        out.append(_word_hashes(raw[at:stop], np.array([0, stop - at]))[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _shingles(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - SHINGLE + 1)
    out = words[:n] * _TURN[0]
    for j in range(1, SHINGLE):
        out += words[j : n + j] * _TURN[j]
    return mix(out)


def _short(words: np.ndarray) -> np.ndarray:
    """The whole sequence as one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return mix((words * _TURN[: len(words)]).sum(dtype=np.uint64, keepdims=True) + _TURN[SHINGLE])


def set_of(words: np.ndarray) -> np.ndarray:
    """The set of one text's words."""
    return np.unique(_shingles(words)) if len(words) >= SHINGLE else _short(words)


def print_of(tokens: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set."""
    total = mix(tokens ^ _U(0xD6E8FEB86659FD93)).sum(dtype=np.uint64, keepdims=True) + np.array([len(tokens)], np.uint64) * _TURN[0]
    return int(mix(total).view(np.int64)[0])


def sets(column) -> Iterator[np.ndarray]:
    """The set of each value of an Arrow binary column, in order: sorted distinct hashes of five-word shingles, of the
    whole sequence where it is shorter, none without words; null has none. Works on blocks of texts at a time."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type == "binary" else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        j = min(j, n)
        if j == i + 1:
            words = word_hashes(raw[offsets[i] : offsets[j]])
            at = np.array([0, len(words)])
        else:
            words, at = _word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        runs = _shingles(words)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.unique(runs[a : b - SHINGLE + 1]) if b - a >= SHINGLE else _short(words[a:b])
        i = j
