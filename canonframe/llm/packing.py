"""Shortest-pack-first histogram packing of token sequences.

Documents are tokenised once, cut at multiples of the sequence length, and only the lengths of the cut remainders are
counted. The histogram (at most max_len - 1 rows, whatever the corpus) is packed on the driver: lengths are placed
longest first, each into the packs that are shortest so far, updating counts of packing patterns. Patterns then turn
into rank ranges of each length, and pieces find their sequence by their rank inside their length.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from codecs import charmap_decode
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonframe.llm import ranks
from canonframe.llm.common import body, cut, table

MAX_LEN = 2048
END_ID = 1
#: Entries of each of the two generations of a worker's word cache; it changes speed alone.
CACHE_WORDS = 300_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What the tokenizer does to a text before its model: a run of small letters up to U+00FF, none of which composes with
#: another, comes through as one piece, whose bytes are then written as one character each.
_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    None,
)
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves; the others follow from 256 on
_OTHERS = [b for b in range(256) if b not in _PRINTED]
_BYTES = "".join(chr(b) if b in _PRINTED else chr(256 + _OTHERS.index(b)) for b in range(256))


class _Words(dict):
    """Token ids, as little-endian bytes, of a run of bytes without ASCII white space and capital letters.

    The tokenizer lower-cases, drops white space, and no rule of it reaches across white space or from a letter to a
    following point or comma, so a text's ids are those of such runs in turn. When the cache is full it becomes the old
    generation; words found there come back into the new one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        assert sys.byteorder == "little"  # array()'s is the machine's
        self.tok = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        # the model alone, for words that the rules before it leave as they are; another tokenizer's are not known
        self.model = Tokenizer(self.tok.model) if (rules["normalizer"], rules["pre_tokenizer"], rules["post_processor"]) == _RULES else None

    def __missing__(self, word: bytes) -> bytes:
        out = self.old.get(word)
        if out is None:
            text = word.decode("utf-8")
            if text[-1] in ".," and len(text) > 1 and text[-2].lower().isalpha():
                out = self[word[:-1]] + self[word[-1:]]
            elif self.model is not None and _PLAIN(text):
                out = array("I", self.model.encode(text if text.isascii() else charmap_decode(word, "strict", _BYTES)[0], add_special_tokens=False).ids).tobytes()
            else:
                out = np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


_caches: dict[str, _Words] = {}


def words_of(path: str) -> _Words:
    """This worker's cache for a tokenizer file; it outlives a task."""
    if path not in _caches:
        _caches.clear()
        _caches[path] = _Words(path)
    return _caches[path]


def token_bytes(text: bytes, words: _Words) -> bytes:
    if b"<|" not in text:  # special tokens count only as they are written
        text = text.lower()
    return b"".join(map(words.__getitem__, text.split()))


def pieces(docs: DataFrame, path: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """Each document's token ids (null text: none) and the end id, cut at multiples of max_len.

    A row for each piece with the checksum of its ids. A worker holds one record batch and its word cache.
    """

    end = np.asarray([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches):
        words = words_of(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_bytes(text.as_buffer().to_pybytes(), words) + end
                n = len(ids) // 4
                rows += [(doc_id, s, min(max_len, n - s), zlib.crc32(ids[4 * s : 4 * (s + max_len)]), n) for s in range(0, n, max_len)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), body("text").cast("binary").alias("text")).mapInArrow(run, PIECES)


def pack_histogram(hist: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in the order placed) and how often each is used.

    open_[space] holds patterns with that space left and their counts. Each length, longest first, goes to the patterns
    with the most space (the shortest packs) it fits into; what does not fit opens new packs.
    """
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    done: dict[tuple[int, ...], int] = defaultdict(int)

    def put(pattern: tuple[int, ...], space: int, n: int) -> None:
        if space == 0:
            done[pattern] += n
        else:
            open_[space][pattern] = open_[space].get(pattern, 0) + n

    for length in sorted((k for k in hist if 0 < k <= max_len), reverse=True):
        left = hist[length]
        while left > 0:
            space = max((s for s, p in open_.items() if p), default=0)
            if space < length:
                # as many packs of only this length as fit are opened full at once
                fit = max_len // length
                full, rest = divmod(left, fit)
                if full:
                    put((length,) * fit, max_len - fit * length, full)
                if rest:
                    put((length,) * rest, max_len - rest * length, 1)
                left = 0
                break
            pattern, n = open_[space].popitem()
            if not open_[space]:
                del open_[space]
            used = min(n, left)
            put((*pattern, length), space - length, used)
            if n > used:
                open_[space][pattern] = open_[space].get(pattern, 0) + n - used
            left -= used
    for at in open_.values():
        for pattern, n in at.items():
            done[pattern] += n
    return sorted(done.items(), key=lambda x: x[0], reverse=True)


def rank_ranges(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): ranks of a length that fill one place of one pattern."""
    used: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for pattern, n in patterns:
        at = 0
        for length in pattern:
            out.append((length, used[length], used[length] + n, first, at))
            used[length] += n
            at += length
        first += n
    return out


def pack(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows are packed each for itself; an empty table gives no rows;
    other columns are not read. Pieces of max_len are sequences of their own (numbered after the packed ones).
    """
    spark = docs.sparkSession
    parts = cut(pieces(docs, path or tokenizer_path(), max_len, end_id))
    counts = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most max_len rows
    hist = {r["length"]: r["n"] for r in counts}
    patterns = pack_histogram({k: v for k, v in hist.items() if k < max_len}, max_len)
    n_packed = sum(c for _, c in patterns)
    ranges = rank_ranges(patterns)
    if hist.get(max_len):
        ranges.append((max_len, 0, hist[max_len], n_packed, 0))
    table_ = spark.createDataFrame(ranges, "length long, lo long, hi long, first_sequence long, offset long")
    ranked = ranks.ranked(parts, "length", sum(hist.values()), "rank")
    # the ranges follow from a histogram of max_len lengths: their number has a bound whatever the corpus
    placed = ranked.join(F.broadcast(table_), (ranked["length"] == table_["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        "doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("offset")
    )


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
