"""Words and word shingles as Catalyst expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from canonframe.llm.common import body

SHINGLE = 5
PERCENT = 75
WHITE = "\t\n\x0b\x0c\r"


def words(col: str | Column = "text") -> Column:
    """Runs of anything but space and U+0009 to U+000D, with A to Z lower-cased; null has none."""
    plain = F.translate(body(col), string.ascii_uppercase + WHITE, string.ascii_lowercase + " " * len(WHITE))
    return F.array_remove(F.split(plain, " "), "")


def shingle_hashes(word_hashes: Column, k: int = SHINGLE) -> Column:
    """Hashes of all runs of k words; of the whole sequence where it is shorter; none without words."""
    n = F.size(word_hashes)
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[word_hashes[i + j] for j in range(k)]))
    return F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(word_hashes))).otherwise(F.array().cast("array<bigint>"))


def shingles(words_: Column, k: int = SHINGLE) -> Column:
    """The same runs as text."""
    n = F.size(words_)
    runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words_, i, k), " "))
    return F.when(n >= k, runs).when(n > 0, F.array(F.array_join(words_, " "))).otherwise(F.array().cast("array<string>"))
