"""Small corpora and brute-force versions."""

import random
import re
import string

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType()), T.StructField("key", T.LongType()), T.StructField("shard", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("cls", T.StringType()), T.StructField("length", T.LongType())]
)
UP = {c: c + 32 for c in range(65, 91)}


def vocabulary(rng, n=400):
    return ["".join(rng.choice(["an", "er", "th", "ou", "lé", "ß", "re", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, vocab, n):
    out = []
    for i in range(n):
        w = rng.choice(vocab)
        out.append((w.capitalize() if i % 9 == 0 else w) + (rng.choice([".\n", ". ", " "]) if i % 9 == 8 else " "))
    return "".join(out).strip()


def near(rng, vocab, text, share):
    w = text.split(" ")
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = rng.choice(vocab)
    return " ".join(w)


def corpus(seed=1, n=60):
    """(doc_id, text) with copies, near copies, shared passages, edge cases, repeated rows and ids out of order."""
    rng = random.Random(seed)
    vocab = vocabulary(rng)
    passage = prose(rng, vocab, 60)
    texts = [prose(rng, vocab, rng.choice([1, 3, 4, 5, 8, 30, 120, 300])) for _ in range(n)]
    base = prose(rng, vocab, 150)
    texts += [base] * 12 + [near(rng, vocab, base, s) for s in (0.01, 0.01, 0.02, 0.02, 0.03, 0.03, 0.04, 0.05, 0.06, 0.08) for _ in range(3)]
    texts += [passage + " " + prose(rng, vocab, 20) for _ in range(12)] + [prose(rng, vocab, 40) + " " + passage for _ in range(3)]
    texts += ["", "   \n\t", "one", "one two three", "A b c d e", "a B C D E", "x" * 300, "x" * 300, "ab" * 200, "\x00\x01\x1f \x0b y", "\U0001f600 é " * 40]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(2000, None), (None, "no id at all here now"), (None, base), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 2, "c", 3) for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def random_bytes_text(rng, n):
    return "".join(rng.choice(string.printable + "é\U0001f600") for _ in range(n))
