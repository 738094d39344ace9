"""Toxicity: a logistic classifier with a counterfactual penalty.

A group term is planted in each labelled text, by a fixed seed and alike for both labels, and the text is
paired with the one in which its group terms, planted or its own, are swapped for others of their kind. Training
minimises the log loss plus ``penalty`` times the squared difference of the two texts' logits, so that a group's
name carries no weight of its own and neutral mentions aren't called toxic.

The settings are chosen by cross-validation inside the training rows.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeline.llm.shared import labelled_rows, labels_per_row, map_arrow, once, session, texts

BITS = 18
#: Labelled training rows of either class at most; a documented bound, the scores cover all rows. Beyond it rows weigh
#: as many labels as they stand for.
SAMPLE_PER_CLASS = 4_000
#: Probability from which a text is predicted toxic.
THRESHOLD = 0.3
#: Folds of the cross-validation.
FOLDS = 4
SEED = 29


@dataclass(frozen=True)
class Settings:
    """``least``, ``errors``: features seen in fewer training texts, or whose log odds between the classes are within so
    many standard errors of naught, are left out: a long text holds thousands of words that tell nothing, and must
    gather no noise from them. ``penalty``: weight of the squared logit difference between a text and its
    counterfactual."""

    least: int = 4
    errors: float = 3.0
    l1: float = 1e-4
    epochs: int = 200
    penalty: float = 1.0


#: What cross-validation chooses from, one setting after the other; the first of equal ones is taken.
GRID = {"errors": (3.0, 2.0, 2.5, 3.5, 4.0, 5.0), "least": (4, 2, 8, 16), "l1": (1e-4, 1e-3, 1e-5), "epochs": (200, 100)}
#: Of the penalties the largest whose loss in cross-validation is within this share of the least.
PENALTIES, PENALTY_COST = (0.25, 0.5, 1.0, 2.0, 4.0), 0.02

#: Terms of one kind, swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("mexican", "chinese", "african", "european", "american", "indian"),
    ("old", "young", "disabled", "blind", "deaf"),
)
_NEXT = {a.encode(): kind[(i + 1) % len(kind)].encode() for kind in IDENTITY_TERMS for i, a in enumerate(kind)}
_TERMS = sorted(_NEXT)

#: Lower-cases A-Z; all other ASCII but letters and digits cuts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CACHE = 400_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def planted(words: list[bytes], text: bytes, seed: int = SEED) -> list[bytes]:
    """The words with a group term among them, which term and where drawn from the text and the seed, never from its label."""
    r = np.random.default_rng([seed, zlib.crc32(text), len(text)])
    at = int(r.integers(len(words) + 1))
    return [*words[:at], _TERMS[r.integers(len(_TERMS))], *words[at:]]


def counterfactual(words: list[bytes]) -> list[bytes] | None:
    """The words with each identity term swapped for the next of its kind; None where there is no such term."""
    out = [_NEXT.get(w, w) for w in words]
    return out if out != words else None


def _features_of(word: bytes) -> tuple[int, ...]:
    """The word and its beginning, which inflected and compound forms share."""
    top = (1 << BITS) - 1
    stem = word[:6] if len(word) > 6 else b""
    return (zlib.crc32(word) & top, zlib.crc32(stem, 7) & top) if stem else (zlib.crc32(word) & top,)


def features(words: list[bytes]) -> np.ndarray:
    """Distinct feature indices of a text."""
    cache, out = once("toxicity-words", dict), set()
    if len(cache) > _CACHE:
        cache.clear()
    for w in set(words):
        if (f := cache.get(w)) is None:
            f = cache[w] = _features_of(w)
        out.update(f)
    return np.fromiter(out, dtype=np.int64, count=len(out))


class _Rows:
    """A sparse matrix of ones."""

    def __init__(self, rows: list[np.ndarray]):
        self.count = len(rows)
        self.at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        self.index = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)

    def only(self, chosen: np.ndarray, place: np.ndarray | None = None) -> _Rows:
        """The columns that are chosen, at their new places, if there are any."""
        out, keep = _Rows([]), chosen[self.index]
        out.count, out.at, out.index = self.count, self.at[keep], self.index[keep] if place is None else place[self.index[keep]]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, w[self.index], self.count)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, g[self.at], size)


Row = tuple[np.ndarray, np.ndarray, int]


def _pair(text: bytes, plant: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A text's features, with its planted term, and its counterfactual's; without a term a text is its own counterfactual."""
    words = planted(words_of(text), text) if plant else words_of(text)
    own = features(words)
    return own, own if (other := counterfactual(words)) is None else features(other)


def train(sample: list[tuple[bytes, int]], settings: Settings = Settings(), plant: bool = True) -> tuple[np.ndarray, float]:
    """``train_features`` of labelled texts."""
    return train_features([(*_pair(t, plant), y) for t, y in sample], settings)


class _Sample:
    """Training rows as matrices, and in how many texts of either class each feature is."""

    def __init__(self, rows: list[Row]):
        self.own, self.label = _Rows([own for own, _, _ in rows]), np.array([y for _, _, y in rows], dtype=np.int64)
        pairs = [(i, other) for i, (own, other, _) in enumerate(rows) if other is not own]
        self.of, self.swapped = np.array([i for i, _ in pairs], dtype=np.int64), _Rows([other for _, other in pairs])
        mine = self.label[self.own.at]
        self.seen = [np.bincount(self.own.index[mine == k], minlength=1 << BITS) for k in (0, 1)]
        self.texts = np.bincount(self.label, minlength=2)
        odds = [np.log((n + 0.5) / (t - n + 0.5)) for n, t in zip(self.seen, self.texts, strict=True)]
        spread = np.sqrt(sum(1 / (n + 0.5) + 1 / (t - n + 0.5) for n, t in zip(self.seen, self.texts, strict=True)))
        self.errors = np.abs(odds[1] - odds[0]) / spread
        self.terms = np.intersect1d(features(_TERMS), np.union1d(self.own.index, self.swapped.index))

    def keep(self, chosen: np.ndarray) -> _Sample:
        """Without the features that no setting will choose; what was counted stays."""
        self.own, self.swapped = self.own.only(chosen), self.swapped.only(chosen)
        return self

    def chosen(self, s: Settings) -> np.ndarray:
        out = (self.seen[0] + self.seen[1] >= s.least) & (self.errors >= s.errors)
        out[self.terms] = True
        return out


def train_features(rows: list[Row] | _Sample, settings: Settings = Settings(), per_row: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """Weights and intercept from (features, counterfactual's features, label); with no rows nothing is known to be toxic and every score is near 0.

    ``per_row``: how many labels a row of either class stands for.
    Full-batch proximal AdaGrad with L1 over the features that tell the classes apart and those of the group terms,
    which are always kept: the penalty, not the choice of features, must make them weigh nothing.
    """
    weights = np.zeros(1 << BITS, np.float32)
    if not rows:
        return weights, -30.0
    sample = rows if isinstance(rows, _Sample) else _Sample(rows)
    chosen = sample.chosen(settings)
    at = np.flatnonzero(chosen)
    place = np.cumsum(chosen) - 1
    x, swapped, of = sample.own.only(chosen, place), sample.swapped.only(chosen, place), sample.of
    y, share = sample.label.astype(np.float64), np.array(per_row)[sample.label]
    share /= share.sum()
    w, b, sq, sq_b = np.zeros(len(at)), 0.0, np.full(len(at), 1e-8), 1e-8
    for _ in range(settings.epochs):
        z = x.dot(w) + b
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        pull = 2 * settings.penalty * share[of] * (z[of] - swapped.dot(w) - b)
        grad = x.back(g + np.bincount(of, pull, len(g)), len(at)) - swapped.back(pull, len(at))
        sq += grad * grad
        rate = 0.5 / np.sqrt(sq)
        w -= rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * settings.l1, 0)
        sq_b += (gb := float(g.sum())) ** 2
        b -= 0.5 / sq_b**0.5 * gb
    weights[at] = w
    return weights, float(b)


def _loss(out: tuple[_Rows, np.ndarray], model: tuple[np.ndarray, float], per_row: tuple[float, float]) -> float:
    """Mean log loss of rows and labels, weighted as in training."""
    rows, label = out
    z = np.clip(rows.dot(model[0].astype(np.float64)) + model[1], -30, 30)
    return float(np.average(np.logaddexp(0, np.where(label == 1, -z, z)), weights=np.array(per_row)[label]))


def choose(rows: list[Row], per_row: tuple[float, float] = (1.0, 1.0), folds: int = FOLDS) -> Settings:
    """Settings by cross-validation over the given rows alone: one after the other, each value by its mean log loss.

    Of either class every ``folds``-th row is left out in turn. Fewer rows of a class than two a fold keep the first values.
    """
    best = Settings(**{k: v[0] for k, v in GRID.items()})
    by_class = [[r for r in rows if r[2] == k] for k in (0, 1)]
    if min(map(len, by_class)) < 2 * folds:
        return best
    loosest = Settings(least=min(GRID["least"]), errors=min(GRID["errors"]))
    parts = []
    for k in range(folds):
        kept, out = ([r for c in by_class for i, r in enumerate(c) if (i % folds == k) == left] for left in (False, True))
        sample = _Sample(kept)
        any_of = sample.chosen(loosest)
        parts.append((sample.keep(any_of), (_Rows([own for own, _, _ in out]).only(any_of), np.array([y for _, _, y in out]))))
    known: dict[Settings, float] = {}

    def loss(s: Settings) -> float:
        if s not in known:
            known[s] = float(np.mean([_loss(out, train_features(kept, s, per_row), per_row) for kept, out in parts]))
        return known[s]

    for name, values in GRID.items():
        best = min((replace(best, **{name: v}) for v in values), key=loss)
    penalties = [replace(best, penalty=p) for p in PENALTIES]
    cheapest = min(map(loss, penalties))
    return max((s for s in penalties if loss(s) <= cheapest * (1 + PENALTY_COST)), key=lambda s: s.penalty)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, settings: Settings | None = None) -> tuple[np.ndarray, float]:
    """Learnt from the training rows only; the settings, where none are given, by ``choose``.

    Texts become features where they are; the driver gets a bounded number of rows of packed features.
    """
    per_row = labels_per_row(labels, "toxic", per_class)
    rows = training_features(docs, labels, per_class)
    return train_features(rows, settings or choose(rows, per_row), per_row=per_row)


def training_features(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> list[Row]:
    """The features of the sampled training texts and of their counterfactuals, in the order of their rank."""
    session(docs)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [_pair(t) for t in texts(batch["text"])]
        pack = lambda f: f.astype(np.int32).tobytes()
        return pa.record_batch([batch["rank"], batch["label"], pa.array([pack(a) for a, _ in pairs], pa.binary()), pa.array([pack(b) for _, b in pairs], pa.binary())], ["rank", "label", "own", "other"])

    packed = map_arrow(labelled_rows(docs, labels, "toxic", per_class), each, "rank string, label int, own binary, other binary")
    read = lambda f: np.frombuffer(f, np.int32)
    return [(read(r["own"]), read(r["other"]), r["label"]) for r in sorted(packed.collect(), key=lambda r: r["rank"])]


def _score(text: bytes, model: tuple[np.ndarray, float]) -> float:
    return float(1 / (1 + np.exp(-np.clip(model[0][features(words_of(text))].sum() + model[1], -30, 30))))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Per row of ``docs``: doc_id, score. Null and empty texts get the intercept's score; repeated rows score
    alike; an empty table gives an empty result; other columns are not read."""
    shared = session(docs).sparkContext.broadcast((uuid.uuid4().hex, model))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, own = shared.value
        return pa.record_batch([batch["doc_id"], pa.array([_score(t, own) for t in texts(batch["text"])], pa.float64())], ["doc_id", "score"])

    chosen = docs.select("doc_id", "text")
    return map_arrow(chosen, each, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all its columns, without the rows that score ``threshold`` or more. Null and empty texts stay."""
    shared = session(docs).sparkContext.broadcast((uuid.uuid4().hex, model))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, own = shared.value
        return batch.filter(pa.array([not (t and _score(t, own) >= threshold) for t in texts(batch["text"])]))

    return map_arrow(docs, each, docs.schema)
