"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, each text scanned once.

A word of the benchmark's vocabulary becomes one symbol, so that the automaton
walks over words and a match's place is a word's place; word spans map it back
to the original text.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.shared import forget, map_arrow, materialise, once, session, texts

#: A window: so many consecutive words of an item.
WINDOW = 13
#: Benchmark words in one automaton (about 100 MB in a worker); a larger benchmark is scanned in several passes.
SHARD_WORDS = 200_000
#: A document is contaminated from this share of hit words: 1 in 20.
HIT_SHARE = 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPAN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """The normalised words: A-Z lower-cased, cut at every other ASCII character that is no letter or digit."""
    return text.translate(_FOLD).split()


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """Each word's byte span in the original text; the folding keeps every byte's place."""
    return [m.span() for m in _SPAN.finditer(text.translate(_FOLD))]


def hit_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """The stretches of hit words as places in the original text, in code points, end exclusive."""
    place = np.cumsum(np.r_[False, (np.frombuffer(text, np.uint8) & 0xC0) != 0x80])  # code points before each byte
    words, edges = word_spans(text), np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [{"start": int(place[words[a][0]]), "end": int(place[words[b - 1][1]])} for a, b in edges.reshape(-1, 2).tolist()]


class BenchmarkAutomaton:
    """Finds all windows of the given items in a text."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.symbols: dict[bytes, str] = {}
        patterns: dict[str, set] = {}
        for item_id, text in items:
            line = "".join(self.symbols.setdefault(w, chr(len(self.symbols) + 1)) for w in words_of(text))
            for i in range(max(len(line) - window + 1, min(len(line), 1))):
                patterns.setdefault(line[i : i + window], set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        for pattern, ids in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), ids))
        self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Which words are hit (None: none), and the items whose windows occur."""
        if self.empty or not words:
            return None, set()
        hit, found, get = None, set(), self.symbols.get
        for end, (length, ids) in self.automaton.iter("".join([get(w, "\0") for w in words])):
            if hit is None:
                hit = np.zeros(len(words), dtype=bool)
            hit[end - length + 1 : end + 1] = True
            found |= ids
        found.discard(None)
        return hit, found


def _automaton(shared):
    key, items = shared.value
    return once(key, lambda: BenchmarkAutomaton(items))


def _shards(benchmark: DataFrame) -> list[DataFrame]:
    """The items in one table or, beyond SHARD_WORDS, in several."""
    session(benchmark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("n")).first()["n"] or 0
    count = max(1, -(-size // SHARD_WORDS))
    return [items] if count == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) for k in range(count)]


def _sent(shard: DataFrame):
    """A shard's items, about SHARD_WORDS words, to all executors."""
    rows = [(r["item_id"], r["text"].encode("utf-8", "surrogatepass")) for r in shard.toLocalIterator()]
    return shard.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))


def _pack(hit: np.ndarray | None) -> bytes | None:
    return None if hit is None else np.packbits(hit).tobytes()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``spans`` are the hit stretches of the original text, (start, end) in code points.

    Null and empty texts have no words and are never contaminated; a null item has no windows, an item without
    an id hits but isn't counted. Repeated rows are judged alike, an empty benchmark hits nothing, further
    columns are not read.
    """
    session(docs)
    shards = _shards(benchmark)
    state = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"))
    doc_type = state.schema["doc_id"].dataType.simpleString()

    def step(shared, final: bool):
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            automaton, hits, items, counts = _automaton(shared), [], [], []
            for text, before, had in zip(texts(batch["text"]), batch["hit"].to_pylist(), batch["items"].to_pylist(), strict=True):
                words = words_of(text)
                hit, found = automaton.scan(words)
                if before is not None:
                    old = np.unpackbits(np.frombuffer(before, np.uint8), count=len(words)).astype(bool)
                    hit = old if hit is None else hit | old
                hits.append(hit)
                items.append(sorted(found | set(had or ())))
                counts.append(len(words))
            if not final:
                return pa.record_batch([batch["doc_id"], batch["text"], pa.array(map(_pack, hits), pa.binary()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "hit", "items"])
            n_hit = [0 if h is None else int(h.sum()) for h in hits]
            return pa.record_batch(
                [
                    batch["doc_id"],
                    pa.array(counts, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(map(len, items), pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                    pa.array([h > 0 and HIT_SHARE * h >= n for h, n in zip(n_hit, counts, strict=True)]),
                    pa.array([[] if h is None else hit_spans(t, h) for t, h in zip(texts(batch["text"]), hits, strict=True)], pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

        return each

    for shard in shards[:-1]:
        shared, before = _sent(shard), state
        state = materialise(map_arrow(state, step(shared, False), state.schema))
        shared.unpersist()
        forget(before)
    return map_arrow(state, step(_sent(shards[-1]), True), f"doc_id {doc_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start:bigint,end:bigint>>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all its columns, without the rows that ``benchmark_hits`` calls contaminated.

    Null and empty texts stay. Beyond one automaton's size the verdicts are joined by row.
    """
    shards = _shards(benchmark)
    if len(shards) > 1:  # the verdicts are by text, so they are joined by its digest
        key = F.sha2(F.coalesce("text", F.lit("")), 256)
        bad = benchmark_hits(docs.select(key.alias("doc_id"), "text").dropDuplicates(["doc_id"]), benchmark).where("contaminated").select(F.col("doc_id").alias("__digest"))
        return docs.join(bad, key == F.col("__digest"), "left_anti")
    session(docs)
    shared = _sent(shards[0])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, keep = _automaton(shared), []
        for text in texts(batch["text"]):
            words = words_of(text)
            hit, _ = automaton.scan(words)
            keep.append(hit is None or HIT_SHARE * int(hit.sum()) < len(words))
        return batch.filter(pa.array(keep))

    return map_arrow(docs, each, docs.schema)
