"""Ends of ranges, skew and very long texts for the ten operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import pii, shared, warc, winnow

ENDS = (-(2**63), 2**63 - 1)


def test_place_among_is_bisection(spark):
    import bisect

    r = random.Random(1)
    points = sorted({(r.randrange(-(2**62), 2**62),) for _ in range(77)} | {(ENDS[0],), (ENDS[1],)})
    keys = [*ENDS, 0, -1, *(p for p, in points[:9]), *(r.randrange(*ENDS) for _ in range(50))]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", shared.place_among([F.col("k")], points).alias("at")).collect()
    assert all(x["at"] == bisect.bisect_right(points, (x["k"],)) for x in rows)
    pairs = sorted({(r.randint(0, 3), r.randint(-5, 5)) for _ in range(20)})
    both = [(a, b) for a in range(-1, 5) for b in range(-6, 7)]
    rows = spark.createDataFrame(both, "a bigint, b bigint").select("a", "b", shared.place_among([F.col("a"), F.col("b")], pairs).alias("at")).collect()
    assert all(x["at"] == bisect.bisect_right(pairs, (x["a"], x["b"])) for x in rows)


def stretches(spark, monkeypatch, ids, per=4):
    """Sizes of the groups that the window of ``with_successor`` orders, and its result."""
    monkeypatch.setattr(winnow, "STRETCH", per)
    sizes = []
    original = winnow.place_among

    def spy(keys, points):
        sizes.append((keys, points))
        return original(keys, points)

    monkeypatch.setattr(winnow, "place_among", spy)
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id bigint, text string")
    found = winnow.with_successor(df, ["text", "doc_id"]).collect()
    keys, points = sizes[-1]
    placed = df.withColumns({"__id": F.coalesce("doc_id", F.lit(ENDS[0])), "__hash": F.xxhash64("text")})
    return max(x["count"] for x in placed.groupBy(original(keys, points).alias("s")).count().collect()), found


@pytest.mark.parametrize("ids", [[*range(400), 2**62], [ENDS[0], *range(300), ENDS[1]], [None] * 200 + list(range(200)), [7] * 250 + list(range(8, 150)), [ENDS[0], 5, ENDS[1]]])
def test_no_id_crowds_a_stretch(spark, monkeypatch, ids):
    largest, found = stretches(spark, monkeypatch, ids)
    assert largest <= 40 and len(found) == len(ids)
    # Every text follows one and is followed by one; ids ascend but for the last row.
    assert sorted(x["next_text"] for x in found) == sorted(x["text"] for x in found)
    below = lambda i: ENDS[0] - 1 if i is None else i
    assert sum(below(x["next_doc_id"]) < below(x["doc_id"]) for x in found) == 1


def test_fingerprints_of_the_ends_of_ids(spark):
    rows = spark.createDataFrame([(ENDS[0], "a b"), (5, "c d"), (ENDS[1], "e f")], "doc_id bigint, text string")
    assert {x["doc_id"] for x in winnow.fingerprints(rows).collect()} == {ENDS[0], 5, ENDS[1]}


def test_text_without_blanks_keeps_its_likeness(spark):
    r = random.Random(2)
    text = "".join(r.choice("語文字中国日本人大小上下") for _ in range(400))
    rows = spark.createDataFrame([(1, text), (2, "".join(r.choice("abcdefgh") for _ in range(400)))], "doc_id bigint, text string")
    got = {x["doc_id"]: x for x in winnow.fingerprints(rows).collect()}
    assert got[1]["near_edited"] > 0.4 and got[1]["near_next"] < 0.1


def test_revisits_at_the_ends_of_time(spark, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH", 4)
    rows = [(2 * i, "u.org/", i, "response", 200, {"ETag": str(i)}, f"d{i}") for i in range(300)]
    rows += [(2 * i + 1, "u.org/", i, "revisit", 304, {"ETag": str(i - 1)}, None) for i in range(1, 300)]
    rows += [(1001, "u.org/", ENDS[0], "revisit", 304, {}, None), (1003, "u.org/", ENDS[1], "revisit", 304, {"etag": "299"}, None)]
    df = spark.createDataFrame(rows, warc.RECORDS)
    got = {x["record_id"]: (x["outcome"], x["response_id"]) for x in warc.resolve_revisits(df).collect()}
    assert got.pop(1001) == ("orphan", None) and got.pop(1003) == ("resolved", 598)
    assert got == {2 * i + 1: ("resolved", 2 * (i - 1)) for i in range(1, 300)}
    points = shared.split_points(df.select("ts"), len(rows), 4)
    assert max(x["count"] for x in df.groupBy(shared.place_among([F.col("ts")], points).alias("s")).count().collect()) <= 40


def test_only_304_is_not_modified(spark):
    rows = [(1, "u", 1, "response", 200, {}, "d"), (2, "u", 2, "revisit", 200, {}, None), (3, "u", 2, "revisit", None, {}, None), (4, "u", 2, "revisit", 304, {}, None)]
    assert [x["record_id"] for x in warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORDS)).collect()] == [4]


# ---------------------------------------------------------------- personal data


def test_very_long_numbers(spark):
    texts = ["0" * 5_000 + ".1.1.1", "0" * 5_000 + "1.2.3.4", "1" * 5_000 + ".1.1.1", "9" * 100_000, "+" + "1" * 9_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"]: x["n_ip"] for x in pii.personal_data(rows).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}
    masked = {x["doc_id"]: x["text"] for x in pii.mask_personal_data(rows).collect()}
    assert masked[0] == masked[1] == "<ip>" and masked[3] == texts[3]


@pytest.mark.parametrize("before", [0, 13, 47, 90, 150])
def test_spans_longer_than_a_window_come_back_whole(before):
    span = "joe" + "x" * 70 + "[@]mail.example.com"
    text = "word " * (before // 5) + "w" * (before % 5) + " " + span + " and then more words " * 5
    found = pii.find_spans([text], pii.trained())[0][1]
    assert [text[a:b] for a, b, _ in found] == [span]


def test_stitching():
    text = "0123456789" * 9
    assert pii.stitched(text, "email", [(10, 20, 1.0, False, False)]) == [(10, 20, 1.0)]
    halves = [(10, 48, 1.0, False, True), (20, 60, 3.0, True, False)]
    assert pii.stitched("a" * 90, "email", halves)[0][:2] == (10, 60)
    assert pii.stitched("a" * 90, "email", [(48, 60, 1.0, True, False)]) == [(0, 60, 1.0)]
    assert pii.stitched("b " + "a" * 60 + " c", "email", [(30, 50, 1.0, True, True)]) == [(2, 62, 1.0)]


def test_spelled_out_forms_in_the_documents_own_words(spark):
    r = random.Random(3)
    prose = tuple("".join(r.choice("aeiourstlmnd") for _ in range(r.randint(2, 9))) for _ in range(500))
    weights = pii.trained(prose)
    forms = ["lena[at]host[dot]org", "joe.b (at) mail (dot) example (dot) com", "x7[@]site.net", "10[.]0[.]3[.]77", "(212) 555-0187"]
    hits = 0
    for form in forms * 8:
        words = [r.choice(prose) for _ in range(40)]
        at = r.randrange(40)
        text = " ".join([*words[:at], form, *words[at:]])
        hits += any(text[a:b] == form for a, b, _ in pii.find_spans([text], weights)[0][1])
    assert hits >= 0.8 * 8 * len(forms)


def test_weights_are_kept(spark, monkeypatch):
    own = "".join(random.SystemRandom().choice("abcdefgh") for _ in range(16))
    rows = spark.createDataFrame([(1, f"some words of prose {own}"), (2, None), (None, "x")], "doc_id bigint, text string")
    assert set(pii.prose_of(rows)) == {"some", "words", "of", "prose", own} and pii.prose_of(rows.limit(0)) == ()
    if not spark.conf.get("spark.checkpoint.dir", None):
        pytest.skip("no shared folder")
    made = []
    monkeypatch.setattr(pii, "trained", lambda prose: made.append(prose) or {"w": np.ones(3)})
    for _ in range(2):  # as if by two applications
        monkeypatch.setattr(pii, "_HERE", {})
        assert pii.weights_for(rows)["w"].tolist() == [1, 1, 1] and pii.weights_for(rows) is pii.weights_for(rows)
    assert len(made) == 1


# ---------------------------------------------------------------- the pipeline's stages


def odd_documents(spark):
    r = random.Random(30)
    text = " ".join(f"w{r.randint(0, 900)}" for _ in range(40))
    rows = [(1, text, "en", "a", 9), (2, text + " end", "en", None, 9), (2, None, None, None, None), (None, text, "en", "a", 9), (3, "", "en", "b", 0), (3, "", "en", "b", 0), (ENDS[0], "call +1 (826) 555-4081 now", "en", "b", 1), (ENDS[1], "x" * 2_000_000, "en", "b", 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({n: F.lit("clash") for n in ("score", "size", "copies_", "key", "digest", "label", "rank", "row", "s", "c", "k", "level", "n", "part", "class", "node", "root", "spans")})


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    """No rows give no rows; nulls, empty and very long texts, repeated rows and clashing names go through as documented."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_documents(spark)
    kept = {"toxicity": 8, "near_dedup": 5, "decontamination": 8, "personal_data": 8}
    for name, stage in pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and set(docs.columns) <= set(none.columns)
        some = stage(spark, docs, str(tmp_path))
        rows = some.collect()
        assert set(docs.columns) <= set(some.columns) and all(x["score"] == "clash" for x in rows)
        if name in kept:
            assert len(rows) == kept[name], name
    masked = {x["doc_id"]: x for x in pipeline.mask_personal_data(spark, docs, str(tmp_path)).collect()}
    assert masked[ENDS[0]]["text"] == "call <phone> now" and masked[ENDS[0]]["n_chars"] == 16


def test_operators_take_very_long_texts_and_the_ends_of_ids(spark):
    from lodeline.llm import decontaminate, langid, minhash, mixing, quality, substring_dedup, toxicity

    docs = odd_documents(spark)
    bench = docs.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 1")
    labels = spark.createDataFrame([(1, 1, 0), (ENDS[0], 0, 1)], "doc_id bigint, quality int, toxic int")
    ids = sorted(str(x["doc_id"]) for x in docs.collect())
    for found in (
        substring_dedup.deduplicate(docs),
        pii.personal_data(docs),
        decontaminate.benchmark_hits(docs, bench),
        winnow.fingerprints(docs),
        quality.score(docs, quality.fit(docs, labels)),
        langid.identify(docs, langid.profiles(docs)),
        mixing.mix(docs),
        toxicity.score(docs, toxicity.fit(docs, labels)),
    ):
        assert sorted(str(x["doc_id"]) for x in found.collect()) == ids, found.columns
    assert sorted(x["doc_id"] for x in minhash.near_classes(docs).collect()) == [ENDS[0], 1, 2, 3, ENDS[1]]
