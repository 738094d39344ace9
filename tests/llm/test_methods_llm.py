"""The methods of the learnt operators and of the mix, held against plain versions of their own definitions."""

import math
import os
import random
import re
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import ODD, docs, words

from lodeline.llm import langid, mixing, quality, toxicity

DATA = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


# ---------------------------------------------------------------- quality


def plain_features(text):
    """Counts of hashed n-grams, one by one."""
    mask = 2**64 - 1

    def fold(h, salt):
        h = (h + salt) * 0x9E3779B97F4A7C15 & mask
        return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask) >> (64 - quality.BITS)

    def shape(word):
        return re.sub(rb"[A-Z]+|[a-z\x80-\xff]+|[0-9]+", lambda m: b"A" if m[0][:1].isupper() else b"0" if m[0][:1].isdigit() else b"a", word)[:4]

    split = text.split()
    w, s = [zlib.crc32(x.lower()) for x in split], [zlib.crc32(shape(x), 77) for x in split]
    out = {}

    def add(h, salt):
        out[fold(h & mask, salt)] = out.get(fold(h & mask, salt), 0) + 1

    for i in range(len(split)):
        add(w[i], 1)
        add(s[i], 3)
        if i:
            add(w[i - 1] * 0x100000001B3 + w[i], 2)
            add(s[i - 1] * 0x100000001B3 + s[i], 4)
            add(int(w[i] == w[i - 1]), 5)
    return {k: math.sqrt(n / len(split)) for k, n in out.items()}


def plain_ftrl(sample, epochs, per_row, alpha=0.2, beta=1.0, l1=0.5, l2=1.0):
    """Follow-the-regularised-leader coordinate by coordinate, in dictionaries."""
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(k):
        zk = z.get(k, 0.0)
        return 0.0 if abs(zk) <= l1 else -(zk - math.copysign(l1, zk)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    offset = lambda: -bias[0] / ((beta + math.sqrt(bias[1])) / alpha)
    mean = sum(per_row[y] for _, y in sample) / len(sample)
    for _ in range(epochs):
        for text, y in sample:
            x = plain_features(text)
            w = {k: weight(k) for k in x}
            error = per_row[y] / mean * (sigmoid(sum(w[k] * v for k, v in x.items()) + offset()) - y)
            b = offset()
            for k, v in x.items():
                g, old = error * v, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[k]
                n[k] = old + g * g
            bias = [bias[0] + error - (math.sqrt(bias[1] + error * error) - math.sqrt(bias[1])) / alpha * b, bias[1] + error * error]
    return weight, offset()


def test_quality_is_the_plain_method(spark):
    r = random.Random(21)
    texts = [words(r, r.randint(1, 30)).title() if i % 3 else words(r, 9).upper() + "!! !! 12" for i in range(60)]
    table, labels = docs(spark, [*texts, *ODD]), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id bigint, quality int")
    sample = sorted((__import__("hashlib").md5(str(i).encode()).hexdigest(), texts[i].encode(), int(i % 3 > 0)) for i in range(60) if not held(i))
    weight, offset = plain_ftrl([(t, y) for _, t, y in sample], quality.EPOCHS, (1.0, 1.0))
    got = {x["doc_id"]: x["score"] for x in quality.score(table, quality.fit(table, labels)).collect()}
    for i, text in enumerate([*texts, *ODD]):
        want = sigmoid(sum(weight(k) * v for k, v in plain_features((text or "").encode()).items()) + offset)
        assert got[i] == pytest.approx(want, abs=1e-4)


# ---------------------------------------------------------------- toxicity


def test_toxicity_scores_are_plain_sums(spark):
    """A score is the logistic of the intercept and the weights of the distinct words and beginnings."""
    r = random.Random(22)
    texts = [words(r, 12) + (" idiotic scumbags" if i % 2 else "") for i in range(80)]
    table, labels = docs(spark, [*texts, *ODD, "SCUMBAGS! scumbag"]), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, toxic int")
    weights, offset = model = toxicity.fit(table, labels)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(table, model).collect()}
    top = (1 << toxicity.BITS) - 1
    for i, text in enumerate([*texts, *ODD, "SCUMBAGS! scumbag"]):
        found = {w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")}
        index = {zlib.crc32(w.encode()) & top for w in found} | {zlib.crc32(w.encode()[:6], 7) & top for w in found if len(w.encode()) > 6}
        assert got[i] == pytest.approx(sigmoid(sum(float(weights[k]) for k in index) + offset), abs=1e-5)


def plain_training(rows, s):
    """Proximal AdaGrad over all features, dense, with the counterfactual term written out."""
    size = 1 + max(int(f.max()) for own, other, _ in rows for f in (own, other))
    x, x2 = np.zeros((len(rows), size)), np.zeros((len(rows), size))
    for i, (own, other, _) in enumerate(rows):
        x[i, own], x2[i, other] = 1, 1
    y = np.array([r[2] for r in rows], float)
    w, b, sq, sq_b = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(s.epochs):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        gap = (x - x2) @ w
        grad = (x.T @ (p - y) + 2 * s.penalty * (x - x2).T @ gap) / len(rows)
        sq += grad**2
        w -= 0.5 / np.sqrt(sq) * grad
        w = np.sign(w) * np.maximum(abs(w) - 0.5 / np.sqrt(sq) * s.l1, 0)
        sq_b += np.mean(p - y) ** 2
        b -= 0.5 / math.sqrt(sq_b) * np.mean(p - y)
    return w, b


@pytest.mark.parametrize("penalty", [0.0, 3.0])
def test_training_is_the_plain_method(monkeypatch, penalty):
    monkeypatch.setattr(toxicity, "BITS", 9)
    toxicity.once("toxicity-words", dict).clear()
    r = random.Random(23)
    rows = []
    for i in range(60):
        line = words(r, 6) + (" scum" if i % 2 and r.random() < 0.8 else "")
        rows.append((*toxicity._pair(line.encode()), i % 2))
    s = toxicity.Settings(least=0, errors=0.0, l1=1e-3, epochs=40, penalty=penalty)
    weights, offset = toxicity.train_features(rows, s)
    toxicity.once("toxicity-words", dict).clear()
    want, b = plain_training(rows, s)
    assert offset == pytest.approx(b, abs=1e-6) and np.allclose(weights[: len(want)], want, atol=1e-5)


def gaps(weights):
    """Differences in logit that swapping a group term makes."""
    of = lambda w: float(weights[toxicity.features([w])].sum())
    return [abs(of(a) - of(b)) for a, b in toxicity._NEXT.items()]


@has_data
def test_the_penalty_acts_on_documents(spark):
    """On the given documents, none of which need name a group, the penalty changes weights and narrows the gap."""
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.training_features(table, labels)
    settings = toxicity.choose(rows)
    assert settings.penalty > 0
    with_it, _ = toxicity.train_features(rows, settings)
    without, _ = toxicity.train_features(rows, replace(settings, penalty=0.0))
    assert (with_it != without).any()
    assert np.mean(gaps(without)) > 0.05 and np.mean(gaps(with_it)) < 0.2 * np.mean(gaps(without))


def test_planting_is_blind_to_labels():
    r = random.Random(24)
    texts = [words(r, 10).encode() for _ in range(600)]
    found = [set(toxicity.planted(toxicity.words_of(t), t)) & set(toxicity._TERMS) for t in texts]
    assert all(len(f) == 1 for f in found) and len(set.union(*found)) == len(toxicity._TERMS)
    assert toxicity.planted([], b"") == toxicity.planted([], b"") and all(toxicity._pair(t)[0] is not toxicity._pair(t)[1] for t in texts[:20])


def test_settings_are_chosen_among_the_given_rows(monkeypatch):
    """Rows that can only be told apart by a rare word want a low bound; the choice sees nothing but its rows."""
    r = random.Random(25)
    rows = [(*toxicity._pair((words(r, 8) + (" scum" if y else "")).encode()), y) for y in (0, 1) for _ in range(60)]
    assert toxicity.choose(rows) == toxicity.choose(rows)
    first = toxicity.Settings(**{k: v[0] for k, v in toxicity.GRID.items()})
    assert toxicity.choose(rows[:5]) == toxicity.choose([]) == first
    seen = []
    original = toxicity.train_features
    monkeypatch.setattr(toxicity, "train_features", lambda sample, *a: seen.append(sample.own.count) or original(sample, *a))
    toxicity.choose(rows)
    assert set(seen) == {90}  # each fold leaves a quarter out


# ---------------------------------------------------------------- languages


def test_identify_is_the_plain_method(spark, monkeypatch):
    """Bundled by loops over trigrams; languages in blocks of any size give the same."""
    monkeypatch.setattr(langid, "DIMENSIONS", 256)
    r = random.Random(26)
    alphabets = {"aa": "abcde ", "bb": "cdefg ", "cc": "efghi ", "dd": "xyzab ", "ee": "éèa üö"}
    rows = [(i, "".join(r.choice(alphabets[lang]) for _ in range(r.randint(20, 90))), lang) for i, lang in enumerate(sorted(alphabets) * 8)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    space = langid.Space()

    def vector(text):
        line = " " + re.sub(r"[^a-zéèüö]+", " ", text.lower()) + " "
        line = re.sub(" +", " ", line)
        out = np.zeros(space.dimensions)
        for a, b, c in zip(line, line[1:], line[2:], strict=False):
            va, vb, vc = (space.letter(ord(x)).astype(float) for x in (a, b, c))
            out += np.roll(va, 2) * np.roll(vb, 1) * vc
        return out

    unit = lambda v: v / (np.linalg.norm(v) or 1)
    sums = {lang: sum(unit(vector(t)) for _, t, x in rows if x == lang) for lang in alphabets}
    mean = sum(sums.values()) / len(sums)
    prototypes = {lang: unit(v - mean) for lang, v in sums.items()}
    asked = [*(t for _, t, _ in rows), "abc", "12", None]
    for block in (2_000, 2, 1):
        monkeypatch.setattr(langid, "BLOCK", block)
        model = langid.profiles(table)
        assert [lang for langs, _ in model for lang in langs] == sorted(alphabets) and max(len(x) for x, _ in model) <= block
        got = {x["doc_id"]: x for x in langid.identify(docs(spark, asked), model).collect()}
        for i, text in enumerate(asked[:-2]):
            cosines = {lang: float(unit(vector(text)) @ p) for lang, p in prototypes.items()}
            assert cosines[got[i]["lang_pred"]] == pytest.approx(max(cosines.values()), abs=1e-4)
            assert got[i]["score"] == pytest.approx((1 + max(cosines.values())) / 2, abs=1e-3)
        assert got[len(asked) - 1]["lang_pred"] == got[len(asked) - 2]["lang_pred"] == "und"


# ---------------------------------------------------------------- mixing


def test_inclusion_follows_its_odds(spark):
    """Many like sources, each a sample of its own: how often a document is included follows its probability."""
    r = random.Random(27)
    sizes = [1] * 60 + [3] * 60 + [12] * 40 + [60] * 20 + [150] * 6 + [0] * 6
    sources = 80
    rows = [(s * 1000 + i, " ".join(["w"] * n), f"s{s:03}") for s in range(sources) for i, n in enumerate(sizes)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(table, weights=(3, 2)).collect()
    total = sum(sizes)
    for even in (0, 1):
        mine = [x for x in got if int(x["source"][1:]) % 2 == even]
        ratio = mine[0]["target"] / total
        left = (ratio - math.floor(ratio)) * total
        k = {n: max(1, n.bit_length()) for n in set(sizes)}
        free, capped = sorted(set(sizes), key=lambda n: -k[n]), []
        while True:  # water filling from the largest class on
            level = (left - sum(n * sizes.count(n) for n in capped)) / sum(k[n] * n * sizes.count(n) for n in free)
            if level * k[free[0]] <= 1:
                break
            capped.append(free.pop(0))
        assert len({round(min(1, level * x), 3) for x in k.values()}) > 2
        for n in set(sizes):
            taken = np.mean([x["copies"] - math.floor(ratio) for x in mine if x["size"] == n])
            assert taken == pytest.approx(min(1, level * k[n]), abs=0.05)
        by_source = {}
        for x in mine:
            by_source[x["source"]] = by_source.get(x["source"], 0) + x["taken"]
        assert all(abs(t - mine[0]["target"]) <= 75 for t in by_source.values())
        assert abs(np.mean(list(by_source.values())) - mine[0]["target"]) <= 30


def test_mix_of_many_seeds_keeps_targets(spark):
    table = docs(spark, [" ".join(["w"] * (1 + i % 40)) for i in range(300)], [("a", "b")[i % 3 > 0] for i in range(300)])
    picks = [{x["doc_id"]: x["copies"] for x in mixing.mix(table, seed=s).collect()} for s in ("1", "2")]
    assert picks[0] != picks[1] and mixing.mix(table, seed="1").where(F.col("taken") > 3 * F.col("size")).count() == 0
