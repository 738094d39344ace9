"""The ten operators and the pipeline: brute force, edge cases, and SQL at the smallest size."""

import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import contract, decontaminate, langid, minhash, mixing, oracle, pii, quality, substring_dedup, toxicity, warc, winnow

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(r, n):
    return " ".join(r.choice("abcdefghij") + str(r.randint(0, 400)) for _ in range(n))


ODD = [None, "", "   \t\n", "x", "é" * 50, "a" * 30_000, "one two three four five six"]


def clashing(df):
    """Extra columns under names that operators use inside."""
    names = ("score", "size", "target", "copies", "spans", "anchors", "key", "digest", "keys", "label", "rank", "row", "s", "print", "hit", "items", "class_id", "u", "q", "bin", "cut")
    return df.withColumns({n: F.lit("clash") for n in names})


# ---------------------------------------------------------------- SQL


@has_data
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = contract.queries()[name](spark, DATA), con.sql(oracle.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = lambda cols, data: sorted(str([tidy(r[cols.index(c)]) for c in sorted(cols)]) for r in data)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


# ---------------------------------------------------------------- 1 substring dedup


def brute_dedup(texts, n=13):
    split = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in enumerate(split):
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, w in enumerate(split):
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def repeated_texts():
    r = random.Random(5)
    passages = [words(r, n) for n in (12, 13, 14, 40, 200)]
    texts = [words(r, r.randint(0, 60)) + " " + r.choice(passages) + " " + words(r, r.randint(0, 30)) for _ in range(60)]
    texts += [texts[3], texts[3] + " tail", "w " * 80, "w " * 40, " ".join(["p q r"] * 30)]
    return texts + ODD


@pytest.mark.parametrize("hot", [200, 3])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 1_000_000 if hot == 200 else 1_000_000)
    texts = repeated_texts()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicate(clashing(docs(spark, texts).repartition(3))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_dedup(texts)


def test_substring_dedup_edges(spark):
    assert substring_dedup.deduplicate(docs(spark, ["x"]).limit(0)).count() == 0
    text = " ".join(map(str, range(20)))
    rows = spark.createDataFrame([(7, text), (7, text), (None, text), (9, text)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.deduplicate(rows).collect())
    assert got == [(0, 0), (7, 0), (7, 0), (9, 20)]


def test_suffix_automaton():
    r = random.Random(1)
    refs = [(tuple(r.choice("abc") for _ in range(30)), d) for d in (5, 2, 9)]
    automaton = substring_dedup.SuffixAutomaton(refs)
    probe = tuple(r.choice("abc") for _ in range(200)) + refs[0][0]
    n = 4
    want = {}
    for k in range(len(probe) - n + 1):
        hits = [d for w, d in refs if any(w[j : j + n] == probe[k : k + n] for j in range(len(w) - n + 1))]
        if hits:
            want[k] = min(hits)
    assert dict(automaton.matching(probe, n)) == want


def test_large_groups_are_dealt(monkeypatch):
    passages = [b" ".join(b"%d" % (i + k) for k in range(16)) for i in range(6)]
    least = {p: 9 - i for i, p in enumerate(passages)}
    whole = substring_dedup._repeated(passages, least)
    monkeypatch.setattr(substring_dedup, "REFERENCE", 1)
    assert substring_dedup._repeated(passages, least) == whole


# ---------------------------------------------------------------- 2 personal data


def test_base_spans():
    text = "mail a.b@c-d.example.org, 1.2.3.4 999.1.1.1 4242 4242 4242 4242 and +1 (555) 010-9999 x@y"
    kinds = {(text[a:b], k) for a, b, k in pii.base_spans(text)}
    assert kinds == {("a.b@c-d.example.org", "email"), ("1.2.3.4", "ip"), ("+1 (555) 010-9999", "phone")} | {(t, k) for t, k in kinds if k == "card"}
    assert pii.luhn([4, 2] * 8) and not pii.luhn([4, 2] * 7 + [4, 3])


def test_base_spans_follow_the_patterns():
    import re

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice("ab1234567890..@@+-- ()é") for _ in range(r.randint(0, 40)))
        want = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text):
                digits = [int(c) for c in m[0] if c.isdigit() and c.isascii()]
                ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
                if ok:
                    want.append((m.start(), m.end(), kind))
        assert pii.base_spans(text) == sorted(want, key=lambda s: (s[0], list(patterns).index(s[2])))


def test_crf_and_lstm_gradients():
    tagger = pii.Tagger(hidden=3, embed=4)
    r = np.random.default_rng(0)
    codes, tags = r.integers(1, 20, (6, 2)), np.array([[0, 1], [1, 2], [2, 0], [2, 0], [0, 3], [3, 4]])
    _, grads = tagger.gradients(codes, tags)
    loss = lambda: pii.crf_loss(tagger.emissions(codes)[0], tagger.p["trans"], tags)[0]
    for k, x in tagger.p.items():
        i = (int(codes[1, 0]), 1) if k == "embed" else tuple(int(r.integers(0, n)) for n in x.shape)
        old = x[i]
        x[i] = old + 1e-5
        up = loss()
        x[i] = old - 1e-5
        down = loss()
        x[i] = old
        assert grads[k][i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_viterbi_is_the_best_path():
    import itertools

    r = np.random.default_rng(3)
    emit, trans = r.normal(size=(4, 1, 3)), r.normal(size=(3, 3))
    banned = pii._BANNED[:3, :3]
    score = lambda p: sum(emit[t, 0, k] for t, k in enumerate(p)) + sum((trans + banned)[a, b] for a, b in zip(p, p[1:], strict=False))
    assert tuple(pii.viterbi(emit, trans)[:, 0]) == max(itertools.product(range(3), repeat=4), key=score)


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_tagger_on_lines_it_has_not_seen(tagger):
    lines = pii.labelled_lines(200, seed=77)
    found = pii.find_spans([t for t, _ in lines], tagger)
    whole = [{s for s in spans if s[0] > 0 and s[1] < len(t)} for t, spans in lines]
    hits = sum(len(set(every) & w) for (_, every), w in zip(found, whole, strict=True))
    wrong = sum(len(set(every) - set(base) - set(spans)) for (base, every), (_, spans) in zip(found, lines, strict=True))
    assert hits >= 0.9 * sum(map(len, whole)) and wrong <= 0.1 * hits
    assert all(set(base) <= set(every) for base, every in found)


def test_windows_are_reconciled(tagger):
    text = "word " * 17 + "write to lena.b7@mail3.example.org or call (212) 555-0187 today " + "word " * 40
    everywhere = [pii.find_spans(["é " * k + text], tagger)[0][1] for k in (0, 3, 11, 20)]
    for k, spans in zip((0, 3, 11, 20), everywhere, strict=True):
        moved = [(a - 2 * k, b - 2 * k, kind) for a, b, kind in spans]
        assert [text[a:b] for a, b, _ in moved] == ["lena.b7@mail3.example.org", "(212) 555-0187"]
    base = [(0, 5, "ip")]
    assert pii.reconcile(base, [(3, 9, "card", 5.0), (10, 14, "card", 1.0), (12, 20, "phone", 3.0)]) == [(0, 5, "ip"), (12, 20, "phone")]


def test_personal_data_edges(spark, tagger):
    texts = [*ODD, "a@b.c", "1" * 20_000, "@" * 5_000, "+1" * 5_000]
    got = {r["doc_id"]: r for r in pii.personal_data(clashing(docs(spark, texts))).collect()}
    assert len(got) == len(texts) and got[len(ODD)]["n_email"] == 1 and got[0]["spans"] == ""
    assert pii.personal_data(docs(spark, ["x"]).limit(0)).count() == 0
    out = pii.mask_personal_data(clashing(docs(spark, ["to a@b.cd now", None])))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[0]["text"] == "to <email> now" and rows[0]["n_chars"] == 14 and rows[1]["text"] is None and rows[0]["score"] == "clash"


# ---------------------------------------------------------------- 3 decontamination


def brute_hits(texts, items, n=13):
    def split(t):
        return "".join(c.lower() if c.isascii() and c.isupper() else c if not c.isascii() or c.isalnum() else " " for c in t or "").split(" ")

    split_ = lambda t: [w for w in split(t) if w]
    out = []
    for t in texts:
        w, hit, found = split_(t), set(), set()
        for item, body in items:
            b = split_(body)
            k = min(n, len(b))
            for i in range(max(len(b) - n + 1, min(1, len(b)))):
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == b[i : i + k]:
                        hit.update(range(j, j + k))
                        if item is not None:
                            found.add(str(item))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("shard", [200_000, 20])
def test_benchmark_hits(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    r = random.Random(4)
    items = [(i, words(r, n)) for i, n in enumerate((5, 12, 13, 20, 30))] + [(9, None), (10, ""), (None, "Zebra CROSSING")]
    texts = [words(r, 30), items[3][1].upper().replace(" ", ", "), words(r, 300) + " " + items[0][1], " ".join(items[4][1].split()[4:19]), "a zebra-crossing", items[2][1] + " " + items[3][1], *ODD]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = {x["doc_id"]: tuple(x[c] for c in columns) for x in decontaminate.benchmark_hits(clashing(docs(spark, texts)), bench).collect()}
    want = brute_hits(texts, items)
    assert [got[i] for i in range(len(texts))] == want
    spans = {x["doc_id"]: x["spans"] for x in decontaminate.benchmark_hits(docs(spark, texts), bench).collect()}
    assert [len(decontaminate.words_of(" ".join(texts[i][s["start"] : s["end"]] for s in spans[i]).encode())) for i in range(len(texts))] == [w[1] for w in want]
    kept = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert sorted(x["doc_id"] for x in kept.collect()) == [i for i, w in enumerate(want) if not w[4]]
    assert decontaminate.benchmark_hits(docs(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_offsets_map_to_the_original():
    text = "Ab, cd—É 12".encode()
    assert [text[a:b] for a, b in decontaminate.word_spans(text)] == [b"Ab", "cd—É".encode(), b"12"]
    spans = decontaminate.hit_spans(text, np.array([False, True, True]))
    assert [text.decode()[s["start"] : s["end"]] for s in spans] == ["cd—É 12"]


# ---------------------------------------------------------------- 4 WARC


def test_revisits(spark, monkeypatch):
    rows = [
        (1, "http://www.Site.org/a/?utm_x=1&b=2&a=1#f", 10, "response", 200, {"ETag": '"1"', "Date": "x", "Server": "s"}, "d1"),
        (2, "https://site.org/a?a=1&b=2", 20, "revisit", 304, {"etag": 'W/"1"', "date": "y", "server": "other"}, None),
        (3, "http://site.org:80/a?a=1&b=2", 30, "response", 200, {"ETag": '"2"'}, "d3"),
        (4, "site.org/a?b=2&a=1", 30, "revisit", 304, {"ETag": '"1"'}, None),
        (5, "site.org/a?b=2&a=1", 40, "revisit", 304, {"ETag": '"1"'}, None),
        (6, "site.org/none", 40, "revisit", 304, {}, None),
        (7, None, 40, "revisit", 304, None, None),
        (8, "site.org/a?a=1&b=2", 35, "response", 500, {"ETag": '"9"'}, "d8"),
        (9, "site.org/a?a=1&b=2", 50, "revisit", 304, {}, None),
    ]
    df = spark.createDataFrame(rows, warc.RECORDS)
    want = {2: ("resolved", 1, "d1"), 4: ("resolved", 1, "d1"), 5: ("mismatch", 3, None), 6: ("orphan", None, None), 7: ("orphan", None, None), 9: ("unverified", 3, "d3")}
    for stretch in (1024, 1):
        monkeypatch.setattr(warc, "STRETCH", stretch)
        got = {r["record_id"]: r for r in warc.resolve_revisits(df.withColumns({n: F.lit("clash") for n in ("canon", "stretch", "full", "r", "pairs")})).collect()}
        assert {k: (r["outcome"], r["response_id"], r["digest"]) for k, r in got.items()} == want
    assert got[2]["headers"] == 'date: y\netag: W/"1"\nserver: s'
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def warc_record(kind, head, body, date="2024-01-01T00:00:00Z"):
    block = head + b"\r\n\r\n" + body
    return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Target-URI: http://a/\r\nWARC-Date: " + date.encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


@pytest.mark.parametrize(("zipped", "chunk"), [(False, 1 << 20), (True, 1 << 20), (False, 7), (True, 7)])
def test_warc_files_reach_the_resolver(spark, tmp_path, monkeypatch, zipped, chunk):
    import gzip

    body = "é\r\n\r\nWARC/1.0 is text here".encode() * 30
    records = [
        warc_record(b"response", b"HTTP/1.1 200 OK\r\nETag: x", body),
        warc_record(b"request", b"GET / HTTP/1.1", b""),
        b"noise between records\r\n",
        warc_record(b"revisit", b"HTTP/1.1 304 Not Modified\r\nETag: x\r\nExpires: e", b"", "2024-01-01T00:00:01Z"),
        warc_record(b"revisit", b"HTTP/1.1 200 OK\r\nETag: x", b"", "2024-01-01T00:00:02Z"),
        warc_record(b"revisit", b"HTTP/1.1 304 Not Modified\r\nETag: x", b"", "no date"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(gzip.compress(r) for r in records) if zipped else b"".join(records))
    monkeypatch.setattr(warc, "CHUNK", chunk)
    with open(tmp_path / "a.warc", "rb", buffering=0) as file:
        assert [(r["kind"], r["status"]) for r in warc.parse_warc(file)] == [("response", 200), ("revisit", 304), ("revisit", 200), ("revisit", 304)]
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("place").collect()
    assert [bytes(r["body"]) for r in rows] == [body, b"", b"", b""] and rows[0]["headers"] == {"etag": "x"}
    found = warc.resolve_revisits(warc.records_of_warc(warc.read_warc(spark, str(tmp_path)))).collect()
    assert sorted(((r["outcome"], r["headers"], r["digest"]) for r in found), key=str) == [("orphan", "etag: x", None), ("resolved", "etag: x\nexpires: e", hashlib.sha256(body).hexdigest())]


# ---------------------------------------------------------------- 5 winnowing


def brute_winnow(spark, text):
    """By the definition, on the hashes of units that Spark gives, with a hash that rolls from gram to gram."""
    m, base, k = winnow.MODULUS, winnow.BASE, winnow.K
    line = text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).strip(" ")
    w = [x for x in line.split(" ") if x]
    if not line:
        w = [""]
    elif len(w) < k or len(line) > winnow.LONG_WORDS * len(w):
        w = list(line)
    h = [r[0] % m for r in spark.createDataFrame([(x,) for x in w], "w string").coalesce(1).select(F.xxhash64("w")).collect()]
    now = 0
    for x in h[:k]:
        now = (now * base + x) % m
    grams, lead = [now], pow(base, k - 1, m)
    for i in range(k, len(h)):
        now = ((now - h[i - k] * lead) * base + h[i]) % m
        grams.append(now)
    n = min(winnow.WINDOW, len(grams))
    picked = []
    for i in range(len(grams) - n + 1):
        low = min(grams[i : i + n])
        at = max(j for j in range(i, i + n) if grams[j] == low)
        if at not in picked:
            picked.append(at)
    return ",".join(f"{grams[j]:x}:{j}" for j in picked)


def test_winnowing(spark):
    r = random.Random(6)
    texts = [words(r, 100), words(r, 5), words(r, 11), "a b " * 40, "tab\tand\nline " + words(r, 20), "", "one", "one two  three", "語" * 40 + " " + "文字" * 60, "a\U0001f600b" * 9]
    df = winnow.fingerprints(clashing(docs(spark, texts)))
    got = {x["doc_id"]: x for x in df.collect()}
    for i, t in enumerate(texts):
        assert got[i]["fingerprint"].lower() == brute_winnow(spark, t)
        nxt = texts[(i + 1) % len(texts)]
        q = len(t) // 4
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()


def test_winnowing_guarantee_and_edges(spark):
    r = random.Random(7)
    shared = words(r, winnow.K + winnow.WINDOW - 1)
    texts = [words(r, 50) + " " + shared + " " + words(r, 9), words(r, 3) + " " + shared + " " + words(r, 70)]
    df = winnow.add_fingerprint(docs(spark, texts), "text", "print").select("doc_id", winnow.hashes(F.col("print")).alias("h"))
    a, b = (set(x["h"]) for x in df.orderBy("doc_id").collect())
    assert a & b
    rows = {x["doc_id"]: x for x in winnow.fingerprints(docs(spark, [*ODD, ODD[-1]])).collect()}
    assert len(rows) == len(ODD) + 1 and rows[0]["n_chars"] == 0 and rows[6]["fingerprint"] == rows[7]["fingerprint"] and rows[6]["near_next"] == 1.0
    assert winnow.fingerprints(docs(spark, ["x"]).limit(0)).count() == 0
    one = winnow.fingerprints(docs(spark, ["only one here"])).first()
    assert one["near_next"] == 1.0
    odd = spark.createDataFrame([(None, "a"), (2**60, "b"), (-5, "c"), (3, "d"), (3, "e")], "doc_id bigint, text string")
    order = [x["next_text"] for x in sorted(winnow.with_successor(odd, ["text"]).collect(), key=lambda x: x["text"])]
    first, last = sorted("de", key=lambda t: odd.where(F.col("text") == t).select(F.xxhash64("text")).first()[0])
    assert dict(zip("abcde", order, strict=True)) == {"a": "c", "c": first, first: last, last: "b", "b": "a"}


def test_successors_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(winnow, "STRETCH", 3)
    ids = random.Random(8).sample(range(0, 5000, 7), 200)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id bigint, text string")
    want = dict(zip(sorted(ids), sorted(ids)[1:] + sorted(ids)[:1], strict=True))
    assert {x["doc_id"]: int(x["next_text"]) for x in winnow.with_successor(df, ["text"]).collect()} == want


# ---------------------------------------------------------------- 6, 10 classifiers


def labelled(spark, n, text_of):
    r = random.Random(9)
    rows = [(i, *text_of(r, i % 2)) for i in range(n)]
    return docs(spark, [t for _, t, _ in rows]), spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")


def test_quality(spark):
    table, labels = labelled(spark, 240, lambda r, y: (words(r, 40).capitalize() if y else words(r, 40).upper().replace(" ", "!! "), y))
    model = quality.fit(table, labels)
    got = {x["doc_id"]: x["score"] for x in quality.score(clashing(table), model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in held]) > 0.95
    odd = [x["score"] for x in quality.score(docs(spark, ODD), model).collect()]
    assert len(odd) == len(ODD) and all(0 <= s <= 1 for s in odd)
    assert quality.score(table.limit(0), model).count() == 0
    none = quality.fit(table, labels.limit(0))
    assert {x["score"] for x in quality.score(docs(spark, ["a", None]), none).collect()} == {0.5}


def test_ftrl_is_sparse():
    r = np.random.default_rng(0)
    model = quality.Ftrl(size=100)
    for _ in range(500):
        y = int(r.integers(0, 2))
        model.learn(np.array([y, *r.choice(np.arange(10, 100), 3, replace=False)]), np.array([1.0, 0.05, 0.05, 0.05]), y)
    w = model.weights()
    assert w[1] > 0.5 > -0.5 > w[0] and (w[10:] == 0).mean() > 0.8


def toxic_line(r, y):
    bad = [r.choice(("idiot", "scum")) for _ in range(2)] if y else []
    group = ["muslims"] if y or r.random() < 0.1 else ["christians"] if r.random() < 0.5 else []
    body = words(r, 20).split() + bad + group
    r.shuffle(body)
    return " ".join(body), y


def test_toxicity_penalty_lowers_the_gap(spark):
    table, labels = labelled(spark, 600, toxic_line)
    scores = {}
    sample = [(t["text"].encode(), t["toxic"]) for t in table.join(labels, "doc_id").orderBy("doc_id").collect()]
    for penalty in (0.0, 20.0):
        model = toxicity.train(sample, toxicity.Settings(penalty=penalty), plant=False)
        neutral = "we met muslims at the market".encode()
        swapped = "we met christians at the market".encode()
        scores[penalty] = (toxicity._score(neutral, model), toxicity._score(swapped, model), toxicity._score(b"you idiot scum of muslims", model))
    gap = lambda s: abs(math.log(s[0] / (1 - s[0])) - math.log(s[1] / (1 - s[1])))
    assert gap(scores[20.0]) < 0.5 * gap(scores[0.0]) and scores[20.0][2] > 0.5
    assert toxicity.counterfactual([b"the", b"women"]) == [b"the", b"men"] and toxicity.counterfactual([b"x"]) is None


def test_toxicity(spark):
    table, labels = labelled(spark, 400, lambda r, y: (words(r, 30) + (" idiot scum" if y else ""), y))
    model = toxicity.fit(table, labels)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(clashing(table), model).collect()}
    assert all((s >= toxicity.THRESHOLD) == (i % 2 == 1) for i, s in got.items())
    kept = toxicity.drop_toxic(clashing(docs(spark, [*ODD, "you idiot scum"])), model)
    assert sorted(x["doc_id"] for x in kept.collect()) == list(range(len(ODD))) and "score" in kept.columns
    assert toxicity.score(table.limit(0), model).count() == 0


# ---------------------------------------------------------------- 7 languages


@has_data
def test_languages(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.profiles(table.where(~held))
    both = langid.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").where(held & F.col("lang").isNotNull())
    assert both.where("lang = lang_pred").count() >= 0.9 * both.count()


def test_language_edges(spark):
    rows = spark.createDataFrame([(0, "the cat", "en"), (1, "der hund", "de"), (2, None, "en"), (3, "x", None)], "doc_id bigint, text string, lang string")
    model = langid.profiles(rows)
    assert [langs for langs, _ in model] == [["de", "en"]]
    got = {x["doc_id"]: x["lang_pred"] for x in langid.identify(clashing(docs(spark, [None, "", "12 34!", "the cats", "der hunde", "a"])), model).collect()}
    assert [got[i] for i in range(5)] == ["und", "und", "und", "en", "de"] and got[5] in ("en", "de")
    empty = langid.profiles(rows.limit(0))
    assert {x["lang_pred"] for x in langid.identify(rows.drop("lang"), empty).collect()} == {"und"}


def test_trigram_vectors_are_bound_and_permuted():
    space = langid.Space(64)
    a, b, c = (space.letter(ord(x)).astype(int) for x in "abc")
    gram = np.array([ord("a") << 42 | ord("b") << 21 | ord("c")])
    assert (space.bind(gram)[0] == np.roll(a, 2) * np.roll(b, 1) * c).all()
    counted = langid.trigrams("abcabc")
    want = sum(n * space.bind(np.array([g]))[0].astype(int) for g, n in zip(*counted, strict=True))
    assert (space.bundle([counted])[0] == want).all()


# ---------------------------------------------------------------- 8 near duplicates


def shingle_set(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(texts):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def near_texts():
    r = random.Random(10)
    out = []
    for _ in range(12):
        base = words(r, r.choice((30, 120, 300))).split()
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, len(base) // 40 + 1)):
                copy[r.randrange(len(copy))] = "edit" + str(r.randint(0, 10**6))
            out.append(" ".join(copy))
    return out + out[:3] + ODD


@pytest.mark.parametrize("block", [400, 3])
def test_near_classes(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_texts()
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_classes(clashing(docs(spark, texts))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_dart_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    e = r.integers(0, 2**63, 300, dtype=np.uint64)
    a = r.uniform(0.2, 4, 300)
    b = a * r.choice([0.5, 1, 1.5], 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = (minhash.dart_signature(e, a, 3000) == minhash.dart_signature(e, b, 3000)).mean()
    assert got == pytest.approx(want, abs=0.04)
    assert (minhash.dart_signature(e, a, 80) == minhash.dart_signature(e[::-1], a[::-1], 80)).all()


def test_components(spark):
    r = random.Random(11)
    edges = [(i, i + 1) for i in range(40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: y for x, y in root.items() if x != y}
    assert minhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_go(spark):
    text = " ".join(map(str, range(60)))
    rows = spark.createDataFrame([(5, text), (5, text), (2, text + " end"), (8, "other words"), (None, text), (9, None), (9, None)], "doc_id bigint, text string")
    kept = minhash.drop_near_duplicates(clashing(rows))
    assert sorted((x["doc_id"] or 0) for x in kept.collect()) == [0, 2, 8, 9] and kept.columns[2:] == clashing(rows).columns[2:]
    assert minhash.near_classes(rows.limit(0)).count() == 0


# ---------------------------------------------------------------- 9 mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = (total - sum(fixed.values())) / max(1, sum(w[s] for s in names if s not in fixed))
        over = [s for s in names if s not in fixed and w[s] * rest > 3 * sizes[s]]
        if not over:
            return {s: fixed.get(s, w[s] * rest if s not in fixed else 0) for s in names}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix(spark):
    r = random.Random(12)
    sources = [r.choice(("a", "a", "a", "b", "b", "c", "d", None)) for _ in range(900)]
    table = docs(spark, [words(r, r.randint(0, 40)) if r.random() < 0.99 else None for _ in sources], sources)
    rows = mixing.mix(clashing(table).drop("source").join(table.select("doc_id", "source"), "doc_id")).collect()
    sizes: dict = {}
    for x in rows:
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
    targets = brute_targets(sizes)
    for s in sizes:
        mine = [x for x in rows if x["source"] == s]
        assert all(x["target"] == pytest.approx(targets[s]) and x["source_size"] == sizes[s] and x["taken"] <= 3 * x["size"] for x in mine)
        assert abs(sum(x["taken"] for x in mine) - targets[s]) <= 40
        copies = {x["copies"] for x in mine}
        assert max(copies) - min(copies) <= 1
    again = {x["doc_id"]: x["taken"] for x in mixing.mix(table.repartition(7)).collect()}
    assert again == {x["doc_id"]: x["taken"] for x in rows}


def test_mix_edges(spark):
    assert mixing.mix(docs(spark, ["x"]).limit(0)).count() == 0
    got = mixing.mix(docs(spark, [None, "", "a b"], ["a", "a", "b"])).collect()
    assert {x["doc_id"]: x["taken"] for x in got} == {0: 0, 1: 0, 2: 2}
    assert mixing.mix(docs(spark, [None, None])).count() == 2
    kept = mixing.mixed(clashing(docs(spark, ["a b c", "d e"])))
    assert set(kept.columns) == set(clashing(docs(spark, [])).columns) and {x["copies"] for x in kept.collect()} == {1}


# ---------------------------------------------------------------- the pipeline


def contaminated_texts(texts, items, n=13):
    """By sets of windows; for whole tables."""
    fold = lambda t: "".join(c.lower() if c.isascii() and c.isupper() else c if not c.isascii() or c.isalnum() else " " for c in t or "").split()
    windows = set()
    for body in items:
        b = fold(body)
        windows |= {tuple(b[i : i + n]) for i in range(max(len(b) - n + 1, min(1, len(b))))}
    out = []
    for t in texts:
        w, hit = fold(t), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit.update(range(j, j + k))
        out.append(len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@has_data
def test_pipeline(spark):
    """Each stage against brute force on its own input."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    items = [x["text"] for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    inputs, outputs, now = {}, {}, table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        inputs[name] = sorted(now.collect(), key=lambda x: x["doc_id"])
        now = stage(spark, now, DATA)
        assert now.schema.simpleString() == table.schema.simpleString(), name
        outputs[name] = sorted(now.collect(), key=lambda x: x["doc_id"])
        now = spark.createDataFrame(outputs[name], table.schema)
    ids = lambda rows: [x["doc_id"] for x in rows]
    scores = {x["doc_id"]: x["score"] for x in toxicity.score(table, toxicity.fit(table, labels)).collect()}
    assert ids(outputs["toxicity"]) == [x["doc_id"] for x in inputs["toxicity"] if scores[x["doc_id"]] < 0.3]
    before = inputs["near_dedup"]
    assert ids(outputs["near_dedup"]) == [x["doc_id"] for i, (x, c) in enumerate(zip(before, brute_classes([x["text"] for x in before]), strict=True)) if c == i]
    before = inputs["decontamination"]
    assert ids(outputs["decontamination"]) == [x["doc_id"] for x, bad in zip(before, contaminated_texts([x["text"] for x in before], items), strict=True) if not bad]
    assert ids(outputs["personal_data"]) == ids(inputs["personal_data"])
    assert not any(pii.base_spans(x["text"]) for x in outputs["personal_data"])
    assert all(x["n_chars"] == len(x["text"]) or x["text"] == y["text"] for x, y in zip(outputs["personal_data"], inputs["personal_data"], strict=True))
    last = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
    assert last.columns == [*table.columns, "copies"]
    taken = {x["doc_id"]: x["copies"] for x in mixing.mix(now).collect() if x["copies"]}
    assert {x["doc_id"]: x["copies"] for x in last.collect()} == taken
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()))
