"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

The n-grams are of words and of word shapes (case, digits, marks), so that habits such as capitals throughout,
stray marks or one word said again and again are features as well as the words themselves.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeline.llm.shared import labelled_sample, labels_per_row, map_arrow, once, session, texts

BITS = 18
#: Labelled training rows of either class at most; a documented bound, the scores cover all rows. Beyond it rows weigh
#: as many labels as they stand for.
SAMPLE_PER_CLASS = 2_000
EPOCHS = 3
#: Probability from which a text is predicted good.
THRESHOLD = 0.7

_SHAPE = re.compile(rb"([A-Z]+)|([a-z\x80-\xff]+)|([0-9]+)")
_CACHE = 400_000


def _shape(word: bytes) -> bytes:
    """Runs of capitals, other letters and digits as one sign each; the marks stay, four at most."""
    return _SHAPE.sub(lambda m: b"A" if m[1] else b"a" if m[2] else b"0", word)[:4]


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words and of their shapes."""
    cache = once("quality-words", dict)
    if len(cache) > _CACHE:
        cache.clear()
    both = []
    for w in words:
        if (h := cache.get(w)) is None:
            h = cache[w] = zlib.crc32(w.lower()) << 32 | zlib.crc32(_shape(w), 77)
        both.append(h)
    packed = np.array(both, dtype=np.uint64)
    return packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)


def _fold(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's n-grams; a value grows with the n-gram's share of the text."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    w, s = _hashes(words)
    with np.errstate(over="ignore"):
        prime = np.uint64(0x100000001B3)
        again = (w[1:] == w[:-1]).astype(np.uint64)
        groups = [_fold(w, 1), _fold(w[:-1] * prime + w[1:], 2), _fold(s, 3), _fold(s[:-1] * prime + s[1:], 4), _fold(again, 5)]
    index, count = np.unique(np.concatenate(groups), return_counts=True)
    return index, np.sqrt(count / len(words))


class Ftrl:
    """Follow-the-regularised-leader, per coordinate, with L1 and L2."""

    def __init__(self, size: int = 1 << BITS, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.bias = np.zeros(size), np.zeros(size), [0.0, 0.0]

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def intercept(self) -> float:
        z, n = self.bias
        return -z / ((self.beta + n**0.5) / self.alpha)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(index)
        p = 1 / (1 + np.exp(-np.clip(w @ value + self.intercept(), -30, 30)))
        g = weight * (p - label) * value
        sigma = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] += g * g
        b, g = self.bias, float(weight * (p - label))
        self.bias = [b[0] + g - ((b[1] + g * g) ** 0.5 - b[1] ** 0.5) / self.alpha * self.intercept(), b[1] + g * g]


def train(sample: list[tuple[bytes, int]], epochs: int = EPOCHS, per_row: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """Weights and intercept; an empty sample gives zeros, so every score is one half.

    ``per_row``: how many labels a row of either class stands for; rows weigh 1 on average.
    """
    model = Ftrl()
    rows = [(*features(t), y) for t, y in sample]
    mean = sum(per_row[y] for _, y in sample) / max(1, len(sample))
    for _ in range(epochs):
        for index, value, y in rows:
            model.learn(index, value, y, per_row[y] / mean)
    return model.weights().astype(np.float32), model.intercept()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    session(docs)
    per_row = labels_per_row(labels, "quality", per_class)
    return train(labelled_sample(docs, labels, "quality", per_class, per_row), per_row=per_row)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Per row of ``docs``: doc_id, score. Null and empty texts get the intercept's score; repeated rows score
    alike; an empty table gives an empty result; other columns are not read."""
    shared = session(docs).sparkContext.broadcast((uuid.uuid4().hex, *model))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, weights, intercept = shared.value
        out = []
        for text in texts(batch["text"]):
            index, value = features(text)
            out.append(1 / (1 + np.exp(-np.clip(weights[index] @ value + intercept, -30, 30))))
        return pa.record_batch([batch["doc_id"], pa.array(np.array(out, dtype=np.float64))], ["doc_id", "score"])

    chosen = docs.select("doc_id", "text")
    return map_arrow(chosen, each, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, score double")
