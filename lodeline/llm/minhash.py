"""MinHash near-dedup: DartMinHash signatures, banded joining and an exact check.

Darts fall on each shingle's region, as wide as its weight, at random ranks; each dart belongs to one of the
signature's coordinates, and each coordinate keeps its earliest dart. Two documents agree on a coordinate with
the probability of their weighted Jaccard similarity. Ranks are opened in bands, from the bottom, until every
coordinate has a dart, so a document costs about t log t darts whatever its length.

Documents that agree on a band of coordinates meet in a bucket, where their shingle sets are compared exactly.
A bucket emits links that span what it found, never all pairs; classes are the links' components.

A large bucket is cut in blocks. Each of its members is compared in its own block and with a few pivots that all
blocks share, which joins a group of near copies whatever its size. Only the members that this leaves outside their
bucket's largest class are compared with the other blocks, so that no link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.shared import materialise, session, small_batches, texts

#: Words of a shingle and the least similarity of near duplicates, as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: A pair of similarity 0.8 is missed by all bands with probability (1 - 0.8 ** ROWS) ** BANDS, 3 in 100 000.
BANDS, ROWS = 20, 4
#: Members of a bucket that are compared together; larger buckets are cut in blocks.
BLOCK = 400
#: Members of a large bucket, about, that are compared with all others.
PIVOTS = 8
#: Ids that are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX1
    x = (x ^ x >> np.uint64(27)) * _MIX2
    return x ^ x >> np.uint64(31)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


def shingles(words: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of k words, and how often each occurs; fewer than k words are one run."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    gram = word[: len(word) - k + 1].copy()
    for i in range(1, k):
        gram = gram * _MIX1 + word[i : len(word) - k + 1 + i]
    return np.unique(_mix(gram), return_counts=True)


def _poisson(area: float) -> np.ndarray:
    p = [np.exp(-area)]
    for i in range(1, 14):
        p.append(p[-1] * area / i)
    return np.cumsum(p)


#: Ranks below 1 are opened in these steps, those above one by one.
_STEPS = (0.0, 1 / 16, 1 / 4, 1.0)
_FEW = [_poisson(b - a) for a, b in zip(_STEPS, _STEPS[1:], strict=False)]
_UNIT = _poisson(1.0)


def dart_signature(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """``size`` 64-bit coordinates of a weighted set, none of it empty. Weights are positive, of any scale near 1."""
    best, out = np.full(size, np.inf), np.zeros(size, np.uint64)
    # Regions of weight [s, s + 1) of each element.
    strips = np.ceil(weights).astype(np.int64)
    if strips.max() > 1:
        place = np.repeat(np.arange(len(elements)), strips)
        strip = np.arange(len(place)) - np.repeat(np.cumsum(strips) - strips, strips)
        key, room = _mix(elements[place] + strip.astype(np.uint64) * _MIX2), weights[place] - strip
    else:
        key, room = _mix(elements), weights
    goal, step = (size * np.log(size) + 2 * size) / weights.sum(), 0
    while True:
        if step < len(_FEW):
            low, high, cdf, cells = np.array([_STEPS[step]]), _STEPS[step + 1], _FEW[step], np.array([step + 1], np.uint64)
        else:
            top = max(int(np.ceil(goal)), int(high) + 1)
            low = np.arange(high, top)
            high, cdf, cells = float(top), _UNIT, low.astype(np.uint64) + np.uint64(len(_FEW))
        h = _mix(key[None, :] + (cells * _MIX1)[:, None])
        darts = np.searchsorted(cdf, _unit(h).ravel(), side="right")
        hit = np.flatnonzero(darts)
        if len(hit):
            each = darts[hit]
            which = np.repeat(hit, each)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
            dart = _mix(h.ravel()[which] + (nth + 1).astype(np.uint64) * _MIX2)
            rank = low[which // len(key)] + (_STEPS[step + 1] - _STEPS[step] if step < len(_FEW) else 1.0) * _unit(dart)
            if strips.max() > 1 or room.min() < 1:
                inside = _unit(_mix(dart ^ _MIX1)) < room[which % len(key)]
                dart, rank = dart[inside], rank[inside]
            at = (_mix(dart ^ _MIX2) % np.uint64(size)).astype(np.int64)
            order = np.argsort(-rank, kind="stable")  # the earliest is written last
            first, ids = np.full(size, np.inf), np.zeros(size, np.uint64)
            first[at[order]], ids[at[order]] = rank[order], dart[order]
            better = first < best
            best[better], out[better] = first[better], ids[better]
        step += 1
        if high >= goal:
            if not np.isinf(best).any():
                return out
            goal *= 2


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64) * _MIX2
    for i in range(rows.shape[1]):
        key = _mix(key * _MIX1 + rows[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, weigh: str = "presence", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, keys) of rows with an id and a word. ``weigh``: a shingle's weight is 1 (presence), or its count."""

    def run(batches):
        for batch in small_batches(batches):
            ids, digests, keys = [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True):
                if doc is None or not (words := text.split()):
                    continue
                s, n = shingles(words)
                ids.append(doc)
                digests.append(hashlib.md5(text).digest())
                keys.append(band_keys(dart_signature(s, n.astype(float) if weigh == "count" else np.ones(len(s)), bands * rows), bands).tolist())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "keys"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, digest binary, keys array<bigint>")


def _roots(size: int, pairs: np.ndarray) -> list[int]:
    root = list(range(size))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(size)]


def similar(sets: list[np.ndarray], least: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Index pairs of sets whose Jaccard similarity is ``least`` or more."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(where, minlength=len(values))[where] > 1
    _, column = np.unique(where[shared], return_inverse=True)
    row = row[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = column[-1] + 1 if len(column) else 0
    for at in range(0, width, 8192):
        a, b = np.searchsorted(column, (at, at + 8192))
        block = np.zeros((len(sets), min(8192, width - at)), np.float32)
        block[row[a:b], column[a:b] - at] = 1
        common += block @ block.T
    common = common.astype(np.int64)
    p, q = least
    return np.argwhere(np.triu((p + q) * common >= p * (size[:, None] + size[None, :]), 1))


def _link(batches):
    """Rows sorted by bucket and part to links (a, b), b the least document of a's part of the bucket."""

    def links(ids, bodies):
        order = np.argsort(np.array(ids, np.int64), kind="stable").tolist()
        root = _roots(len(ids), similar([shingles(bodies[i].split())[0] for i in order]))
        return [(ids[order[i]], ids[order[r]]) for i, r in enumerate(root) if i != r]

    now, ids, bodies, out = None, [], [], []
    for batch in batches:
        for key, part, doc, text in zip(*(batch[c].to_pylist() for c in ("key", "part", "doc_id")), texts(batch["text"]), strict=True):
            if (key, part) != now:
                if len(ids) > 1:
                    out += links(ids, bodies)
                now, ids, bodies = (key, part), [], []
            ids.append(doc)
            bodies.append(text)
        if len(out) > 10_000:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
            out = []
    if len(ids) > 1:
        out += links(ids, bodies)
    if out:
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])


def with_ids(df: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """``df`` joined with ``ids``, which is broadcast if it has BROADCAST_IDS rows at most."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each edge's component, for every node but the roots.

    Large and small stars in turn: each node's larger neighbours, then all smaller ones, are linked to the least
    node near it, until nothing changes. Each round's links are written to the shared folder.
    """
    state = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        told = state.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(told) == seen or not told["n"]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(told)
        both = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct())


def _blocks(count: Column) -> Column:
    return F.ceil(count / BLOCK).cast("bigint")


def _own_block(doc_id: Column, count: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), _blocks(count))


def _parts(key: Column, doc_id: Column, count: Column) -> Column:
    """Parts of a bucket of ``count`` members in which a member is compared: its own block, or all for a pivot."""
    own = _own_block(doc_id, count)
    pivot = F.pmod(F.xxhash64(key, doc_id), count) < PIVOTS
    return F.when((count <= BLOCK) | ~pivot, F.array(own)).otherwise(F.sequence(F.lit(0).cast("bigint"), _blocks(count) - 1))


def _links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) within each part of ``members`` (key, part, doc_id, digest)."""
    wanted = members.select("doc_id", "digest").distinct()
    bodies = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")
    bodies = with_ids(bodies, wanted, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    met = members.join(bodies, ["doc_id", "digest"]).select("key", "part", "doc_id", "text")
    return met.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_link, "a bigint, b bigint")


def _leftover(hot: DataFrame, root: DataFrame) -> DataFrame:
    """(key, part, doc_id, digest) of large buckets ``hot`` (key, doc_id, digest, n): those outside their bucket's largest
    class by ``root`` (node, root), with the members that they may still be like.

    A member left over is a guest of all blocks, BLOCK guests to a part; the other members stay in their own block.
    Guests meet each other as a guest meets the block of the other.
    """
    classed = hot.join(root, hot["doc_id"] == root["node"], "left").select("key", "doc_id", "digest", "n", F.coalesce("root", "doc_id").alias("class"))
    classed = materialise(classed)
    sizes = classed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "class")).alias("m"), F.sum("c").alias("all"))
    sizes = sizes.where("all > m.c").select("key", F.col("m.class").alias("main"), (F.col("all") - F.col("m.c")).alias("guests"))
    open_ones = classed.join(sizes, "key")
    groups = F.ceil(F.col("guests") / BLOCK)
    group = F.pmod(F.xxhash64("doc_id", F.lit("guest")), groups)
    blocks, own = F.sequence(F.lit(0).cast("bigint"), _blocks(F.col("n")) - 1), _own_block(F.col("doc_id"), F.col("n"))
    each_group = F.sequence(F.lit(0).cast("bigint"), groups - 1)
    stay = open_ones.select("key", "doc_id", "digest", F.explode(F.transform(each_group, lambda g: own * 2**31 + g)).alias("part"))
    visit = open_ones.where(F.col("class") != F.col("main")).select("key", "doc_id", "digest", F.explode(F.transform(blocks, lambda b: b * 2**31 + group)).alias("part"))
    return stay.union(visit).distinct().select("key", "part", "doc_id", "digest")


def near_classes(docs: DataFrame, weigh: str = "presence") -> DataFrame:
    """(doc_id, class_id): one row for each different doc_id, in no order; class_id is the class' least doc_id.

    Equal texts are one class; so are texts joined by links of similarity 0.8 or more between their sets of
    5-word shingles. A text without words (null, empty, blank) is a class of its own, as is every document in a
    table without copies. Rows that repeat a doc_id with other text are compared as they are and bring their
    classes together. Rows whose doc_id is null are left out. Other columns are not read.
    """
    session(docs)
    signed = materialise(signatures(docs, weigh))
    # Copies count once: the least document of a text stands for it.
    first = signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("keys").alias("keys"))
    first = materialise(first)
    keyed = first.select("doc_id", "digest", F.explode("keys").alias("key"))
    print_of = F.bit_xor(F.xxhash64("doc_id", "digest"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), print_of.alias("same"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("n > 1")
    # Bands that gather the same documents compare them once.
    buckets = buckets.groupBy("n", "same", "lo", "hi").agg(F.min("key").alias("key")).select("key", "n")
    met = materialise(keyed.join(buckets, "key").select("key", "doc_id", "digest", "n"))
    members = met.select("key", "doc_id", "digest", F.explode(_parts(F.col("key"), F.col("doc_id"), F.col("n"))).alias("part"))
    links, hot = _links(members, docs), met.where(F.col("n") > BLOCK)
    if not hot.isEmpty():
        links = materialise(links)
        rest = materialise(_leftover(hot, components(links)))
        if not rest.isEmpty():
            links = links.union(materialise(_links(rest, docs)))
    copies = signed.join(first.select("digest", F.col("doc_id").alias("b")), "digest").select(F.col("doc_id").alias("a"), "b").distinct()
    # Copies hang on their text's first document, links join those; a doc_id with several texts joins them, too.
    twice = copies.where("a <> b").groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    edges = links.union(copies) if twice else links
    root = components(edges).select(F.col("node").alias("b"), "root")
    alone = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null")
    classed = copies.join(root, "b", "left").select(F.col("a").alias("doc_id"), F.least("a", F.coalesce("root", "b")).alias("class_id"))
    classed = classed.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return alone.distinct().join(classed, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, all its columns, with one document of each class: that with the least doc_id.

    Of rows that repeat that doc_id one stays, chosen by its text. Rows whose doc_id is null stay.
    """
    gone = materialise(near_classes(docs)).where("class_id <> doc_id").select(F.col("doc_id").alias("__gone"))
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.where("n > 1").limit(1).count():
        return kept
    return kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id"]))
