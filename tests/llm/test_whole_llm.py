"""Whole jobs of the ten operators where a bound or a key once cut them."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import minhash, quality, substring_dedup, toxicity


@pytest.mark.parametrize(("operator", "target"), [(quality, "quality"), (toxicity, "toxic")])
def test_bound_keeps_the_class_ratio(spark, operator, target):
    """One label in ten is 1 and texts tell nothing, so every score is near a tenth, within the bound and beyond it."""
    r = random.Random(3)
    table = spark.createDataFrame([(i, " ".join(f"w{r.randint(0, 400)}" for _ in range(12))) for i in range(3_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(r.random() < 0.1)) for i in range(3_000)], f"doc_id bigint, {target} int")
    mean = {}
    for bound in (10_000, 150):
        model = operator.fit(table, labels, bound)
        scores = {x["doc_id"]: x["score"] for x in operator.score(table, model).collect()}
        mean[bound] = np.mean([s for i, s in scores.items() if zlib.crc32(str(i).encode()) % 4 == 2])
    assert mean[10_000] == pytest.approx(0.1, abs=0.05)
    assert mean[150] == pytest.approx(mean[10_000], abs=0.08)


@pytest.mark.parametrize("hot", [200, 1])
def test_spans_go_to_their_own_text(spark, monkeypatch, hot):
    """Two texts of different length under one id, the longer with a repeat beyond the shorter's end."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 1_000_000)
    passage = " ".join(f"p{i}" for i in range(20))
    long = " ".join(f"a{i}" for i in range(60)) + " " + passage
    short, front = " ".join(f"b{i}" for i in range(30)), passage + " " + " ".join(f"c{i}" for i in range(9))
    rows = spark.createDataFrame([(1, passage), (7, long), (7, short), (7, front), (9, short)], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"][:3]) for r in substring_dedup.deduplicate(rows).collect())
    assert got == [(1, 20, 0, "p0 "), (7, 29, 20, "c0 "), (7, 30, 0, "b0 "), (7, 80, 20, "a0 "), (9, 30, 30, "")]


def hot_texts(r, n, groups):
    """Near copies of few texts that share most of their shingles, and chains in which only neighbours are alike."""
    base = [f"w{i}" for i in range(60)]
    out = []
    for g in range(groups):
        for _ in range(n):
            words = list(base)
            words[50 + g % 10] = f"g{g}"
            words[r.randrange(60)] = f"x{r.randint(0, 9)}"
            out.append(" ".join(words))
    now = list(base)
    for i in range(40):  # each step changes one word, the ends have little in common
        now[(i * 7) % 60] = f"c{i}"
        out.append(" ".join(now))
    return out


@pytest.mark.parametrize("pivots", [0, 1, 8])
def test_large_buckets_lose_no_link(spark, monkeypatch, pivots):
    """Blocks of 5 members; with no pivots all members but one block's may be left over."""
    from test_llm import brute_classes, docs

    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    texts = hot_texts(random.Random(5), 30, 3)
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_a_large_group_of_near_copies_moves_each_text_once(spark):
    """Parts of a bucket of 2 000 blocks: one for each member but the few pivots."""
    n = 2_000 * minhash.BLOCK
    rows = spark.range(20_000).select(F.size(minhash._parts(F.lit(7), F.col("id"), F.lit(n))).alias("parts")).groupBy("parts").count().collect()
    assert {r["parts"] for r in rows} <= {1, 2_000} and sum(r["count"] for r in rows if r["parts"] > 1) <= 5
