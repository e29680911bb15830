"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; every pair of features interacts by the product of their vectors.
The pair sum is taken in linear time as half of (square of the sum minus sum of the squares).

Features of a text: its distinct words, hashed; shares of symbols, upper case, digits, marks, repeated words, lines
and windows, each as a number and as a bucket; and as metadata the character count the table gives (n_chars),
as a bucket. Language, source, ids and labels are never looked at.

Defined cases: a null or empty text has only its structure features and still gets a score; a null n_chars is a
bucket of its own; repeated rows are scored each alone; texts are read whole; with no rows of both classes to learn
from, every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import held_out, id_mod, keep_texts, map_texts, read, training_sample

#: bound of the training sample: documents of each class, characters of a document
PER_CLASS, MAX_CHARS = 2000, 40_000
BITS, RANK, EPOCHS, RATE, DECAY = 16, 8, 6, 0.08, 1e-4
WORDS = 1 << BITS
N_STATS, BUCKETS, SIZES = 14, 10, 24
N_FEATURES = WORDS + N_STATS * (1 + BUCKETS) + SIZES + 1
SCHEMA = "doc_id long, score double, predicted int"
SPACE, SYMBOLS, MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"!?.,;:"
UPPER, DIGIT = bytes(range(65, 91)), bytes(range(48, 58))


def structure(text: str, data: bytes, words: list[bytes], counts: Counter) -> np.ndarray:
    """Shares between 0 and 1."""
    n, size = max(1, len(words)), max(1, len(data))
    share = lambda kinds: (len(data) - len(data.translate(None, kinds))) / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    common = counts.most_common(1)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = max(1, sum(map(len, words)))
    upper_words = sum(w.isupper() and len(w) > 1 for w in text.split()) / n
    return np.array([
        share(SYMBOLS), share(MARKS), share(UPPER), share(DIGIT), share(SPACE), share(b"!"), share(b"|"),
        1 - len(counts) / n, common[0][1] / n if common else 0.0, repeats / n,
        1 - len(set(lines)) / max(1, len(lines)), min(1.0, letters / n / 20), upper_words, min(1.0, len(lines) / n),
    ])


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values."""
    text = text or ""
    data = text.encode()
    words = data.split()
    counts = Counter(words)
    hashed = np.unique(np.fromiter((zlib.crc32(w) for w in counts), np.int64, len(counts)) & WORDS - 1)
    stats = structure(text, data, words, counts)
    bucket = np.minimum(BUCKETS - 1, np.sqrt(stats) * BUCKETS).astype(np.int64)
    at = WORDS + np.arange(N_STATS)
    size = SIZES if n_chars is None else min(SIZES - 1, max(0, int(n_chars)).bit_length())
    index = np.concatenate([hashed, at, WORDS + N_STATS + np.arange(N_STATS) * BUCKETS + bucket, [WORDS + N_STATS * (1 + BUCKETS) + size]])
    value = np.concatenate([np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed)))), stats, np.full(N_STATS + 1, 0.3)])
    return index, value


class Machine:
    def __init__(self, seed: int = 7) -> None:
        self.bias, self.w = 0.0, np.zeros(N_FEATURES, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (N_FEATURES, RANK)).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of rows that lie end to end, and the sums of their weighted vectors."""
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, start)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, start)).sum(axis=1)
        return self.bias + np.add.reduceat(self.w[index] * value, start) + pairs, total

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, seed: int = 7) -> None:
        """AdaGrad on the logistic loss; classes weigh the same."""
        rng, gw, gv, gb = np.random.default_rng(seed), np.full(N_FEATURES, 1e-2, np.float32), np.full((N_FEATURES, RANK), 1e-2, np.float32), 1e-2
        weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                index, value = (np.concatenate([rows[i][j] for i in some]) for j in (0, 1))
                sizes = np.array([len(rows[i][0]) for i in some])
                start, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(some)), sizes)
                z, total = self.raw(index, value, start)
                pull = weight[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
                uniq, inverse = np.unique(index, return_inverse=True)
                each = pull[owner] * value
                dw = np.bincount(inverse, each, len(uniq)) + DECAY * self.w[uniq]
                dv_each = each[:, None] * (total[owner] - self.v[index] * value[:, None])
                dv = np.stack([np.bincount(inverse, dv_each[:, r], len(uniq)) for r in range(RANK)], axis=1) + DECAY * self.v[uniq]
                gw[uniq] += dw**2
                gv[uniq] += dv**2
                gb += pull.sum() ** 2
                self.w[uniq] -= RATE * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= RATE * dv / np.sqrt(gv[uniq])
                self.bias -= RATE * pull.sum() / np.sqrt(gb)

    def probabilities(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        index, value = (np.concatenate([r[j] for r in rows]) for j in (0, 1))
        sizes = np.array([len(r[0]) for r in rows])
        z, _ = self.raw(index, value, np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def char_count(docs: DataFrame) -> Column:
    """The character count the table gives; of tables without one, the text's own."""
    return (F.col("n_chars") if "n_chars" in docs.columns else F.length("text")).cast("long")


def fit(docs: DataFrame, labels: DataFrame, trainable: Column | None = None) -> Machine:
    trainable = id_mod(F.col("doc_id"), 3) != 1 if trainable is None else trainable
    sample = training_sample(docs, labels, "quality", trainable, PER_CLASS, MAX_CHARS, char_count(docs))
    machine, y = Machine(), np.array([q for _, q, _ in sample], float)
    if len(set(y)) == 2:
        machine.fit([features(t, n) for t, _, n in sample], y)
    else:
        machine.v[:] = 0
    return machine


def _scored(machine: Machine, texts: list, sizes: list) -> list[float]:
    out: list[float] = []
    for k in range(0, len(texts), 64):
        out += machine.probabilities([features(t, n) for t, n in zip(texts[k : k + 64], sizes[k : k + 64], strict=True)]).tolist()
    return out


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Score and prediction of each document."""
    docs = docs.select("doc_id", char_count(docs).alias("n_chars"), "text")

    def make():
        def each(rows: dict) -> dict:
            got = _scored(machine, rows["text"], rows["n_chars"])
            return {"doc_id": rows["doc_id"], "score": got, "predicted": [int(s >= 0.5) for s in got]}

        return each

    return map_texts(docs, make, SCHEMA, ("doc_id", "n_chars", "text"))


def only_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents of predicted quality 1, all their columns."""
    sized = "n_chars" in docs.columns

    def make():
        return lambda rows: [s >= 0.5 for s in _scored(machine, rows["text"], rows["n_chars"] if sized else [len(t or "") for t in rows["text"]])]

    return keep_texts(docs, make, ("n_chars", "text") if sized else ("text",))


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
