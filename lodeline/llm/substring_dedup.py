"""Substring dedup: suffix automata of reference shards, over which documents' passages are streamed.

A word is removed where it lies in a window of LENGTH words that also starts in a document with a smaller
doc_id. The reference of a document is so the whole corpus before it, which no broadcast can hold. The corpus is
therefore cut into shards by content: each window has an anchor, the least hash among its grams of K words, and
equal windows have equal anchors. Only anchors seen in two documents matter. The passages around such an anchor
meet in one shard, where the suffix automaton of its reference passages is built and the passages are streamed
over it; a passage's matching statistics give for each window the first document that has it.

Nothing is dropped or capped. An anchor of very many documents (HOT) is split: its windows are dealt by their
own content. Copies within a task are settled there, so a passage of a third of all documents sends a row for
each task, not for each document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.shared import map_arrow, materialise, session, small_batches, texts

#: Words of a window.
LENGTH = 13
#: Words of the grams that serve as anchors.
K = 5
#: Anchors in more documents than HOT, and than 1 in HOT_SHARE of all, have their windows dealt apart. A text has an
#: anchor for every five words or so, hence such anchors, which are broadcast, are a bounded number.
HOT, HOT_SHARE = 200, 20_000
#: Anchors that a task gathers before it sends them.
GATHER = 1_500_000
#: Keys by which anchors are dealt, at least, and documents for each at most; Spark groups the keys into its shuffle
#: partitions, of which there can be as many as keys.
DEALS, DEAL_DOCS = 2_048, 50_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def runs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text's windows as runs that share an anchor: anchor hash, first window, windows."""
    n = len(words) - LENGTH + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    gram = word[: len(word) - K + 1].copy()
    for i in range(1, K):
        gram = gram * _STEP + word[i : len(word) - K + 1 + i]
    gram ^= gram >> np.uint64(31)
    gram *= _MIX
    gram ^= gram >> np.uint64(29)
    at = np.lib.stride_tricks.sliding_window_view(gram, LENGTH - K + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return gram[at[first]], first, np.diff(np.r_[first, n])


class SuffixAutomaton:
    """Of several word sequences; every state knows the least document among those its strings occur in."""

    def __init__(self, references: list[tuple[tuple, int]]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]
        for words, doc in references:
            last = 0
            for w in words:
                last = self._extend(last, w)
                if self.least[last] is None or doc < self.least[last]:
                    self.least[last] = doc
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if up > 0 and (self.least[up] is None or self.least[v] < self.least[up]):
                self.least[up] = self.least[v]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.least.append(None)
        return len(self.link) - 1

    def _split(self, p: int, w) -> int:
        """The state of exactly the string of p and w."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, p: int, w) -> int:
        if w in self.next[p]:
            return self._split(p, w)
        new = self._state(self.length[p] + 1, 0, {})
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, w)
        return new

    def matching(self, words: tuple, length: int):
        """For each window of ``length`` words that the references have: its start and the least document."""
        v = matched = 0
        for i, w in enumerate(words):
            while v and w not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if w in self.next[v]:
                v, matched = self.next[v][w], matched + 1
                while self.length[self.link[v]] >= length:
                    v = self.link[v]
                    matched = self.length[v]
                if matched >= length:
                    yield i - length + 1, self.least[v]


def _spans(starts: list[int], count: int = LENGTH) -> bytes:
    """Sorted window starts as merged spans of words, in pairs of 32-bit numbers."""
    out: list[int] = []
    for s in starts:
        if out and s <= out[-1]:
            out[-1] = s + count
        else:
            out += [s, s + count]
    return np.array(out, dtype=np.int32).tobytes()


def _cuts(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each stretch of equal keys."""
    if not len(sorted_keys):
        return []
    at = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return list(zip(at.tolist(), [*at[1:].tolist(), len(sorted_keys)], strict=True))


def _deal_anchors(h: np.ndarray, doc: np.ndarray, keys: int = DEALS) -> pa.RecordBatch:
    """A task's (anchor, document) pairs, each once, as rows of packed numbers by deal.

    An anchor that two of these documents share is settled for them: those pairs go along apart, evenly dealt,
    and one row for the anchor, with its count, is all that other tasks' documents need.
    """
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first = np.r_[True, h[1:] != h[:-1]]
    group = np.cumsum(first) - 1
    count = np.bincount(group).astype(np.int32)
    one_h, one_doc = h[first], doc[first]
    several = np.zeros(len(count), bool)
    several[group[1:][~first[1:] & (doc[1:] != doc[:-1])]] = True
    deals = (one_h >> np.uint64(24)).astype(np.int64) % keys
    by = np.argsort(deals, kind="stable")
    rows = [(int(deals[by[a]]), one_h[by[a:b]], one_doc[by[a:b]], np.where(several, count, 1)[by[a:b]].astype(np.int32), False) for a, b in _cuts(deals[by])]
    settled_h, settled_doc = h[several[group]], doc[several[group]]
    for a in range(0, len(settled_h), 2_000):
        rows.append((int(settled_h[a] % np.uint64(keys)), settled_h[a : a + 2_000], settled_doc[a : a + 2_000], np.zeros(0, np.int32), True))
    return pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (1, 2, 3)), pa.array([r[4] for r in rows])],
        ["deal", "h", "doc", "count", "settled"],
    )


def _shared_anchors(docs: DataFrame, hot: int, keys: int = DEALS) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, anchors): anchors of a document that another document has too, in one row or more; and the anchors in more than ``hot`` documents."""

    def gather(batches):
        held, ids, size = [], [], 0
        for batch in small_batches(batches):
            for doc, text in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True):
                h = np.unique(runs(text.split())[0])
                if len(h) and doc is not None:
                    held.append(h)
                    ids.append(np.full(len(h), doc, np.int64))
                    size += len(h)
            if size >= GATHER:
                yield _deal_anchors(np.concatenate(held), np.concatenate(ids), keys)
                held, ids, size = [], [], 0
        if size:
            yield _deal_anchors(np.concatenate(held), np.concatenate(ids), keys)

    def settle(batches):
        new, pairs = [], []
        for batch in batches:
            for h, doc, count, settled in zip(*(batch[c].to_pylist() for c in ("h", "doc", "count", "settled")), strict=True):
                h, doc = np.frombuffer(h, np.uint64), np.frombuffer(doc, np.int64)
                if settled:
                    pairs.append((h, doc))
                else:
                    new.append((h, doc, np.frombuffer(count, np.int32)))
        hottest = np.zeros(0, np.uint64)
        if new:
            h, doc, count = (np.concatenate(x) for x in zip(*new, strict=True))
            distinct, group = np.unique(h, return_inverse=True)
            lo, hi = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
            np.minimum.at(lo, group, doc)
            np.maximum.at(hi, group, doc)
            mine = (lo < hi)[group] & (count == 1)
            pairs.append((h[mine], doc[mine]))
            hottest = distinct[np.bincount(group, weights=count) > hot]
        if len(hottest):
            yield pa.record_batch([pa.array([None], pa.int64()), pa.array([hottest.tobytes()], pa.binary())], ["doc_id", "anchors"])
        if pairs:
            h, doc = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
            cuts = _cuts(doc)
            for at in range(0, len(cuts), 10_000):
                some = cuts[at : at + 10_000]
                yield pa.record_batch([pa.array([int(doc[a]) for a, _ in some], pa.int64()), pa.array([h[a:b].tobytes() for a, b in some], pa.binary())], ["doc_id", "anchors"])

    dealt = docs.mapInArrow(gather, "deal int, h binary, doc binary, count binary, settled boolean").repartition("deal")
    found = materialise(dealt.mapInArrow(settle, "doc_id bigint, anchors binary"))
    hottest = [np.frombuffer(r["anchors"], np.uint64) for r in found.where("doc_id is null").select("anchors").collect()]
    return found.where("doc_id is not null"), np.concatenate([np.zeros(0, np.uint64), *hottest])


def _digest(text: bytes) -> int:
    """Tells apart the texts of rows that share a doc_id; signed."""
    digest = xxhash.xxh64_intdigest(text)
    return digest - 2**64 if digest >= 2**63 else digest


def _passages(batches, hottest: np.ndarray):
    """Texts and their shared anchors to passages: (route, anchor, doc_id, digest, starts, passage), or (route, .., doc_id, digest, spans) where a copy in this task has settled all.

    Of equal passages in a task only the first document's goes on; it alone may be the corpus' first.
    """
    held: dict = {}
    for batch in small_batches(batches):
        for doc, text, anchors in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), batch["anchors"].to_pylist(), strict=True):
            if not anchors:
                continue
            words, digest = text.split(), _digest(text)
            h, first, count = runs(words)
            shared = np.isin(h, np.frombuffer(b"".join(anchors), np.uint64))
            split = np.isin(h, hottest)
            for k in np.flatnonzero(shared).tolist():
                anchor, start, n = int(h[k]), int(first[k]), int(count[k])
                pieces = [(start, n)] if not split[k] else [(start + i, 1) for i in range(n)]
                for at, m in pieces:
                    passage = b" ".join(words[at : at + m + LENGTH - 1])
                    key = anchor if not split[k] else xxhash.xxh64_intdigest(passage)
                    held.setdefault((key, passage), []).append((doc, digest, at))
    settled: dict = {}
    rows = []

    def batch_of(rows):
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], _PASSAGE)

    for (key, passage), where in held.items():
        least = min(where)[0]
        n = passage.count(b" ") + 2 - LENGTH
        signed = key - 2**64 if key >= 2**63 else key
        of: dict = {}
        for doc, digest, at in where:
            if doc > least:
                settled.setdefault((doc, digest), []).extend(range(at, at + n))
            else:
                of.setdefault(digest, []).append(at)
        rows += [(signed, signed, least, digest, np.array(starts, dtype=np.int32).tobytes(), passage, None) for digest, starts in of.items()]
        if len(rows) >= 5_000:
            yield batch_of(rows)
            rows = []
    for (doc, digest), starts in settled.items():
        rows.append((doc * 2_654_435_761 % 2**61, 0, doc, digest, None, None, _spans(sorted(set(starts)))))
        if len(rows) >= 5_000:
            yield batch_of(rows)
            rows = []
    if rows:
        yield batch_of(rows)


_PASSAGE = ["route", "anchor", "doc_id", "digest", "starts", "passage", "spans"]


def _repeated(passages: list[bytes], least: dict[bytes, int]) -> dict[bytes, list[tuple[int, int]]]:
    """For each distinct passage of a shard its windows, by start, with the least document that has them.

    The passages are the reference and what is streamed over it. A shard of more than REFERENCE passages, which a hot
    but not the hottest anchor can have, is dealt into smaller ones by the windows' content.
    """
    if len(passages) == 1:
        return {passages[0]: [(i, least[passages[0]]) for i in range(passages[0].count(b" ") + 2 - LENGTH)]}
    split = {p: tuple(p.split(b" ")) for p in passages}
    if len(passages) <= REFERENCE:
        automaton = SuffixAutomaton([(w, least[p]) for p, w in split.items()])
        return {p: list(automaton.matching(w, LENGTH)) for p, w in split.items()}
    windows = {p: [w[i : i + LENGTH] for i in range(len(w) - LENGTH + 1)] for p, w in split.items()}
    shards: list[list] = [[] for _ in range(-(-sum(map(len, windows.values())) // REFERENCE))]
    for p, some in windows.items():
        for window in some:
            shards[xxhash.xxh64_intdigest(b" ".join(window)) % len(shards)].append((window, least[p]))
    first: dict = {}
    for shard in shards:
        automaton = SuffixAutomaton(shard)
        for window in {w for w, _ in shard}:
            first[window] = next(automaton.matching(window, LENGTH))[1]
    return {p: [(i, first[window]) for i, window in enumerate(some)] for p, some in windows.items()}


#: Passages, or windows, in one automaton, about.
REFERENCE = 3_000


def _resolve(batches, keys: int = DEALS):
    """Passages that share an anchor to spans, packed by bucket of documents: a task sends a row for each bucket, not for each document."""
    groups: dict = {}
    out: dict = {}
    for batch in batches:
        for anchor, doc, digest, starts, passage, spans in zip(*(batch[c].to_pylist() for c in _PASSAGE[1:]), strict=True):
            if passage is None:
                out.setdefault((doc, digest), []).append(spans)
            else:
                groups.setdefault(anchor, {}).setdefault(passage, []).append((doc, digest, np.frombuffer(starts, np.int32).tolist()))
    windows: dict = {}
    while groups:
        _, group = groups.popitem()
        least = {p: min(where)[0] for p, where in group.items()}
        for p, found in _repeated(list(group), least).items():
            for doc, digest, starts in group[p]:
                if later := [i for i, first in found if first < doc]:
                    windows.setdefault((doc, digest), []).extend(at + i for at in starts for i in later)
    for row, starts in windows.items():
        out.setdefault(row, []).append(_spans(sorted(set(starts))))
    buckets: dict = {}
    for row in out:
        buckets.setdefault(row[0] * 2_654_435_761 % 2**61 % keys, []).append(row)
    keys = list(buckets)
    for at in range(0, len(keys), 1_000):
        some = keys[at : at + 1_000]
        joined = [[b"".join(out[d]) for d in buckets[k]] for k in some]
        yield pa.record_batch(
            [
                pa.array(some, pa.int32()),
                pa.array([np.array([d for d, _ in buckets[k]], np.int64).tobytes() for k in some], pa.binary()),
                pa.array([np.array([x for _, x in buckets[k]], np.int64).tobytes() for k in some], pa.binary()),
                pa.array([np.array([len(x) for x in j], np.int64).tobytes() for j in joined], pa.binary()),
                pa.array([b"".join(j) for j in joined], pa.binary()),
            ],
            _PACKED,
        )


_PACKED = ["bucket", "docs", "digests", "sizes", "spans"]


def _unpack(batches):
    """Buckets of documents to (doc_id, digests, sizes, spans), one row for each doc_id: its texts' digests, and of each the bytes of its spans."""
    out: dict = {}
    for batch in batches:
        for docs, digests, sizes, spans in zip(*(batch[c].to_pylist() for c in _PACKED[1:]), strict=True):
            ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
            for doc, digest, a, b in zip(np.frombuffer(docs, np.int64).tolist(), np.frombuffer(digests, np.int64).tolist(), [0, *ends], ends, strict=False):
                out.setdefault(doc, {}).setdefault(digest, []).append(spans[a:b])
    docs = list(out)
    for at in range(0, len(docs), 5_000):
        some = docs[at : at + 5_000]
        joined = [[b"".join(x) for x in out[d].values()] for d in some]
        yield pa.record_batch(
            [
                pa.array(some, pa.int64()),
                pa.array([np.array(list(out[d]), np.int64).tobytes() for d in some], pa.binary()),
                pa.array([np.array([len(x) for x in j], np.int64).tobytes() for j in joined], pa.binary()),
                pa.array([b"".join(j) for j in joined], pa.binary()),
            ],
            ["doc_id", "digests", "sizes", "spans"],
        )


def _own_spans(text: bytes, digests: bytes, sizes: bytes, spans: bytes) -> bytes:
    """The spans of this text among those of its doc_id."""
    at = np.flatnonzero(np.frombuffer(digests, np.int64) == _digest(text))
    if not len(at):
        return b""
    end = np.cumsum(np.frombuffer(sizes, np.int64))[at[0]]
    return spans[end - np.frombuffer(sizes, np.int64)[at[0]] : end]


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, digests, sizes, spans): of each text of a doc_id pairs of 32-bit word numbers, start and end, of what is removed; spans may overlap."""
    session(docs)
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    count = chosen.count()
    keys = max(DEALS, count // DEAL_DOCS)
    found, hottest = _shared_anchors(chosen, max(HOT, count // HOT_SHARE), keys)
    anchors = found.groupBy("doc_id").agg(F.collect_list("anchors").alias("anchors"))
    shared = docs.sparkSession.sparkContext.broadcast(hottest)

    def passages(batches):
        return _passages(batches, shared.value)

    # A left join, as in ``deduplicate``, so that both read the texts from one exchange.
    joined = chosen.join(anchors, "doc_id", "left").mapInArrow(passages, "route bigint, anchor bigint, doc_id bigint, digest bigint, starts binary, passage binary, spans binary")
    packed = joined.repartition("route").mapInArrow(lambda batches: _resolve(batches, keys), "bucket int, docs binary, digests binary, sizes binary, spans binary")
    return packed.repartition("bucket").mapInArrow(_unpack, "doc_id bigint, digests binary, sizes binary, spans binary")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, kept (the kept words joined by one space), n_words, n_removed, kept_sha256.

    Words are cut at ASCII blanks, a null or empty text has none. Rows with the same doc_id don't remove words
    of each other; each loses what its own text repeats, so equal rows lose alike. A row whose doc_id is null comes before or after none: it is kept whole and
    removes nothing. An empty table gives an empty result; other columns are not read.
    """
    spans = removed_spans(docs)
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, total, gone = [], [], []
        for text, *known in zip(texts(batch["text"]), *(batch[c].to_pylist() for c in ("digests", "sizes", "spans")), strict=True):
            words = text.split()
            total.append(len(words))
            if known[0] and (spans := _own_spans(text, *known)):
                edge = np.zeros(len(words) + 1, np.int32)
                pairs = np.frombuffer(spans, np.int32).reshape(-1, 2)
                np.add.at(edge, pairs[:, 0], 1)
                np.add.at(edge, np.minimum(pairs[:, 1], len(words)), -1)
                stays = np.cumsum(edge)[:-1] <= 0
                words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.record_batch(
            [batch["doc_id"], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
            ["doc_id", "kept", "n_words", "n_removed", "kept_sha256"],
        )

    return map_arrow(chosen.join(spans, "doc_id", "left"), each, "doc_id bigint, kept string, n_words bigint, n_removed bigint, kept_sha256 string")
