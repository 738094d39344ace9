"""Language identification by hyperdimensional profiles.

A letter is a random vector of +1 and -1, drawn from its code point. A trigram is the product of its letters'
vectors, permuted (rotated) by two, one and no places; a text is the sum of its trigrams' vectors, and a
language the sum of its texts'. The language of a text is the one whose prototype has the largest cosine.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.shared import map_arrow, materialise, once, session, small_batches, texts

DIMENSIONS = 1024
#: Prototypes that are scored together; more languages are more blocks (4 KB a language in each worker).
BLOCK = 2_000
_BLANK = 32
_MASK = (1 << 21) - 1


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, all but letters as single blanks."""
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.concatenate(([_BLANK], low, [_BLANK])).astype(np.int64)
    out = np.where(_LETTER[low], low, _BLANK)
    return out[(out != _BLANK) | np.r_[True, out[:-1] != _BLANK]]


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class _Letters:
    """The table of letters, made when it is first used in a worker."""

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        return once("letters", _letter_table)[codes]


_LETTER = _Letters()


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams as packed integers, and their counts."""
    line = letters(text)
    if len(line) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(line[:-2] << 42 | line[1:-1] << 21 | line[2:], return_counts=True)


class Space:
    """Vectors of letters and trigrams; the latter are kept while there is room."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.of_letter, self.rows, self.table = dimensions, {}, {}, np.zeros((0, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if (v := self.of_letter.get(code)) is None:
            v = self.of_letter[code] = np.random.default_rng(code).integers(0, 2, self.dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)
        return v

    def bind(self, grams: np.ndarray) -> np.ndarray:
        codes = sorted({*(grams >> 42).tolist(), *(grams >> 21 & _MASK).tolist(), *(grams & _MASK).tolist()})
        place = {c: i for i, c in enumerate(codes)}
        base = np.stack([self.letter(c) for c in codes])
        at = lambda part: np.fromiter((place[c] for c in part.tolist()), dtype=np.int64, count=len(part))
        return np.roll(base, 2, axis=1)[at(grams >> 42)] * np.roll(base, 1, axis=1)[at(grams >> 21 & _MASK)] * base[at(grams & _MASK)]

    def bundle(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row for each text: the sum of its trigrams' vectors."""
        out = np.zeros((len(counted), self.dimensions), np.float32)
        for at in range(0, len(counted), 64):
            block = counted[at : at + 64]
            grams, where = np.unique(np.concatenate([g for g, _ in block]), return_inverse=True)
            if not len(grams):
                continue
            counts = np.zeros((len(block), len(grams)), np.float32)
            counts[np.repeat(np.arange(len(block)), [len(g) for g, _ in block]), where] = np.concatenate([c for _, c in block])
            for k in range(0, len(grams), 4096):
                out[at : at + len(block)] += counts[:, k : k + 4096] @ self.vectors(grams[k : k + 4096])
        return out

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        if len(self.rows) > 12_000:  # 50 MB
            self.rows, self.table = {}, self.table[:0]
        if fresh := [g for g in grams.tolist() if g not in self.rows]:
            made = self.bind(np.array(fresh, np.int64)).astype(np.float32)
            start = len(self.rows)
            self.rows.update((g, start + i) for i, g in enumerate(fresh))
            if start + len(made) > len(self.table):
                self.table = np.concatenate([self.table[:start], made, np.zeros((start + len(made), self.dimensions), np.float32)])
            else:
                self.table[start : start + len(made)] = made
        return self.table[np.fromiter((self.rows[g] for g in grams.tolist()), dtype=np.int64, count=len(grams))]


def _space() -> Space:
    return once("space", Space)


Profiles = tuple[list[str], np.ndarray]


def profiles(docs: DataFrame) -> list[Profiles]:
    """Languages and their prototypes, of unit length, from all rows whose text and lang aren't null; in blocks, by name.

    A trigram's vector is the same everywhere, so tasks count trigrams by language, Spark sums the counts, and
    the sums are bundled: a language's vector is sent, never its texts.
    """
    session(docs)

    def count(batches):
        sums: dict = {}
        for batch in small_batches(batches):
            space = _space()
            by_lang: dict = {}
            for text, lang in zip(texts(batch["text"]), batch["lang"].to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(trigrams(text.decode("utf-8", "replace")))
            for lang, counted in by_lang.items():
                # Texts weigh alike, whatever their length.
                rows = space.bundle(counted)
                norm = np.linalg.norm(rows, axis=1, keepdims=True)
                sums[lang] = sums.get(lang, 0) + np.rint(rows / np.where(norm, norm, 1) * 2**20).astype(np.int64).sum(axis=0)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "vector"])

    parts = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang").mapInArrow(count, "lang string, vector array<bigint>")
    # Whole numbers are summed, so the order in which tasks end changes nothing.
    total = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    total = materialise(total.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("v")))
    # What all languages share (blanks, common letters) tells nothing apart.
    spread = total.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    mean = np.array([float(r["x"]) / r["n"] * (r["n"] > 1) for r in spread])
    blocks: list[Profiles] = []
    rows = total.orderBy("lang").toLocalIterator()
    while some := list(itertools.islice(rows, BLOCK)):
        table = np.array([r["v"] for r in some], dtype=np.float64) - mean
        norm = np.linalg.norm(table, axis=1, keepdims=True)
        blocks.append(([r["lang"] for r in some], (table / np.where(norm, norm, 1)).astype(np.float32)))
    return blocks


def nearest(rows: np.ndarray, blocks: list[Profiles]) -> tuple[list[str], np.ndarray]:
    """The language of the largest cosine for each vector, and that cosine; of equal ones the first by name."""
    norm = np.linalg.norm(rows, axis=1)
    rows = rows / np.where(norm, norm, 1)[:, None]
    names, top = ["und"] * len(rows), np.full(len(rows), -np.inf)
    for langs, table in blocks:
        cosine = rows @ table.T
        best = cosine.argmax(axis=1)
        found = cosine[np.arange(len(rows)), best]
        for i in np.flatnonzero(found > top).tolist():
            names[i], top[i] = langs[best[i]], found[i]
    return names, top


def identify(docs: DataFrame, model: list[Profiles]) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score; score is the cosine, moved from -1..1 to 0..1.

    A text that is null or has no letter is ``und`` with score 0, as is every text when there is no profile.
    Ties go to the first language by name. Repeated rows are judged alike; an empty table gives an empty result;
    other columns are not read.
    """
    context = session(docs).sparkContext
    shared = [context.broadcast((uuid.uuid4().hex, block)) for block in model]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counted = [trigrams(t.decode("utf-8", "replace")) for t in texts(batch["text"])]
        names, top = nearest(_space().bundle(counted), [b.value[1] for b in shared])
        told = [bool(len(g)) and bool(shared) for g, _ in counted]
        return pa.record_batch(
            [
                batch["doc_id"],
                pa.array([name if ok else "und" for name, ok in zip(names, told, strict=True)]),
                pa.array([min(1.0, max(0.0, (1 + float(c)) / 2)) if ok else 0.0 for c, ok in zip(top, told, strict=True)]),
            ],
            ["doc_id", "lang_pred", "score"],
        )

    chosen = docs.select("doc_id", "text")
    return map_arrow(chosen, each, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
