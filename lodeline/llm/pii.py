"""Personal data: a character-level bidirectional LSTM with a CRF on top, beside the base patterns.

The network is trained in numpy from labelled spans: lines made from a seed and from words of the documents
themselves, in which e-mail addresses, IP addresses, card and phone numbers in many spellings are marked, among
look-alikes (versions, keys, dates, table cells) that are not. A text is read in overlapping windows; spans that
windows cut are put together again, and the spans are reconciled over the whole text as the heaviest set of those
that don't overlap each other or the base spans.

Each span holds a digit, an ``@`` or a spelled-out ``(at)`` or ``(dot)`` (the decoded ones must, too), so only windows
with such a sign are run.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import random
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.shared import map_arrow, session

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Characters of a training line.
LINE = 64
EMBED, HIDDEN = 10, 18
LINES, EPOCHS, BATCH, SEED = 2_400, 7, 40, 11
#: Documents, those with the least ids, whose words the training lines use, and words of them at most: a documented bound.
PROSE_DOCS, PROSE_WORDS = 64, 4_000
#: Mean margin over "outside" that a decoded span needs.
LEAST_MARGIN = 0.25
#: Windows that are run together.
TOGETHER = 1_024

_TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begins kind k, 2 + 2k goes on
_TRIGGER = re.compile(r"[0-9@]|[(\[{] ?(?:at|dot) ?[)\]}]")

# ---------------------------------------------------------------- base patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its start only: elsewhere in it the same characters follow.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in text.split(".")))  # int() refuses very long numbers
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15 if kind == "phone" else True


def _emails(text: str):
    """Matches of the e-mail pattern, found from each @: in time that grows with the text, not its square."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed."""
    if not _TRIGGER.search(text):
        return []
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---------------------------------------------------------------- labelled lines

_SIGNS = "@.-+()_%/:#=$*,;'\" \n"


def encode(text: str) -> np.ndarray:
    """Characters as symbols: digits, lower and upper letters, others' letters, single marks, the rest; 0 pads."""
    table = _symbols()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return table[np.minimum(codes, len(table) - 1)]


@lru_cache(1)
def _symbols() -> np.ndarray:
    table = np.full(0x3000, 5, np.int8)
    for c in range(128):
        ch = chr(c)
        table[c] = 1 if ch.isdigit() else 2 if ch in "aeiouy" else 3 if ch.islower() else 4 if ch.isupper() else 6 + _SIGNS.index(ch) if ch in _SIGNS else 6 + len(_SIGNS)
    return table


SYMBOLS = 7 + len(_SIGNS)


def _word(r: random.Random) -> str:
    return "".join(r.choice(("th", "an", "er", "on", "de", "la", "mi", "st", "qu", "é", "ü", "ou", "re")) for _ in range(r.randint(1, 4)))


def _card_number(r: random.Random) -> str:
    digits = [r.randint(0, 9) for _ in range(r.choice((13, 14, 15, 15, 15, 18)))]
    last = next(d for d in range(10) if luhn([*digits, d]))
    s = "".join(map(str, [*digits, last]))
    gap = r.choice(("", "", " ", "-"))
    return gap.join(s[i : i + 4] for i in range(0, len(s), 4))


def _phone_number(r: random.Random) -> str:
    n = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))
    return r.choice((f"+1 ({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"+{n(2)} {n(3)} {n(3)} {n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"+{n(2)}{n(10)}", f"00{n(2)} {n(3)} {n(7)}", f"{n(3)}.{n(3)}.{n(4)}"))


def _personal(r: random.Random) -> tuple[str, str]:
    kind = r.choice(KINDS)
    if kind == "email":
        name, host = "".join(c for c in _word(r) if c.isascii()) or "x", "".join(c for c in _word(r) if c.isascii()) or "y"
        at, dot = r.choice((("@", "."), ("@", "."), (" @ ", "."), ("(@)", "."), ("[@]", "."), ("(at)", "."), ("[at]", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("{at}", "{dot}")))
        end = r.choice(("com", "example.com", "org", "net", "co.uk")).replace(".", dot)
        number = r.choice(("", str(r.randint(0, 99)))) if "at" in at else str(r.randint(0, 99))
        return kind, f"{name}{r.choice(('', '.', '_', '.%d.' % r.randint(0, 99)))}{number}{at}{host}{r.choice(('', str(r.randint(1, 9))))}{dot}{end}"
    if kind == "ip":
        return kind, r.choice((".", ".", "[.]", "(dot)", " dot ")).join(str(r.randint(0, 255)) for _ in range(4))
    return kind, _card_number(r) if kind == "card" else _phone_number(r)


def _look_alike(r: random.Random) -> str:
    n = r.randint
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    return r.choice((f"version {n(1, 9)}.{n(0, 9)}", f"{n(1, 9)}.{n(0, 20)}.{n(0, 20)}", f"AKIA{key}", f"password={n(0, 2**64):x}", f"{n(1900, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", f"${n(1, 9999)}.{n(0, 99):02d}", f"{n(0, 10**6)}", f"{n(1, 99)}%", f"@{_word(r)}", f"{n(1, 12)}:{n(0, 59):02d}", f"#{n(1, 9999)}", f"{n(0, 10**12)}", f"{n(300, 999)}.{n(300, 999)}.{n(0, 999)}.{n(0, 999)}", f"{n(1, 9)}, {n(1, 9)}, {n(1, 9)}"))


def labelled_lines(count: int = LINES, seed: int = SEED, prose: tuple[str, ...] = ()) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Lines of LINE characters and the spans in them; every other line's words are of ``prose``, if there is any."""
    r, out = random.Random(seed), []
    for k in range(count):
        line, spans = "", []
        word = (lambda: r.choice(prose)) if prose and k % 2 else (lambda: _word(r))
        while len(line) < LINE + 30:
            what = r.random()
            if what < 0.16:
                kind, body = _personal(r)
                spans.append((len(line), len(line) + len(body), kind))
            else:
                body = _look_alike(r) if what < 0.3 else word()
                body = body.capitalize() if r.random() < 0.15 and what >= 0.3 else body
            line += body + r.choice((" ", " ", " ", ", ", ". ", "\n", " | "))
        cut = r.randint(0, len(line) - LINE)
        inside = [(max(a - cut, 0), min(b - cut, LINE), k) for a, b, k in spans if a - cut < LINE - 3 and b - cut > 3]
        out.append((line[cut : cut + LINE], inside))
    return out


def _tags(spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(LINE, np.int64)
    for a, b, kind in spans:
        out[a:b] = 2 + 2 * KINDS.index(kind)
        out[a] = 1 + 2 * KINDS.index(kind)
    return out


# ---------------------------------------------------------------- the network

_BANNED = np.zeros((_TAGS, _TAGS))
for _k in range(len(KINDS)):
    for _t in range(_TAGS):
        if _t not in (1 + 2 * _k, 2 + 2 * _k):
            _BANNED[_t, 2 + 2 * _k] = -1e4


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool = False):
    """Outputs (T, 2, B, H) of inputs (T, 2, B, E), both directions at once; with ``keep``, the gates and cells for the way back.

    A logistic gate is half a hyperbolic tangent of half its input, plus a half, so that one call does all four.
    """
    steps, _, batch, e = x.shape
    size = b.shape[1] // 4
    half = np.repeat(np.array([0.5, 0.5, 0.5, 1], x.dtype), size)
    pre = (x @ w[:, :e] + b[:, None, :]) * half
    u = w[:, e:] * half
    h, c = np.zeros((2, batch, size), x.dtype), np.zeros((2, batch, size), x.dtype)
    out = np.empty((steps, 2, batch, size), x.dtype)
    gates, cells = (np.empty((steps, 2, batch, 4 * size), x.dtype), np.empty_like(out)) if keep else (None, None)
    for t in range(steps):
        z = np.tanh(pre[t] + h @ u)
        z[..., : 3 * size] += 1
        z[..., : 3 * size] *= 0.5
        c = z[..., size : 2 * size] * c + z[..., :size] * z[..., 3 * size :]
        h = z[..., 2 * size : 3 * size] * np.tanh(c)
        out[t] = h
        if keep:
            gates[t], cells[t] = z, c
    return out, (gates, cells)


def _lstm_back(x, w, out, kept, grad):
    """Gradients by inputs, weights and offsets."""
    steps, _, batch, size = grad.shape
    e = x.shape[3]
    gates, cells = kept
    i, f, o, g = (gates[..., k * size : (k + 1) * size] for k in range(4))
    tanh_c, before = np.tanh(cells), np.concatenate([np.zeros_like(cells[:1]), cells[:-1]])
    # What each gate's input gets of the cell's or, for the third, the output's gradient.
    factor = np.stack([g * i * (1 - i), before * f * (1 - f), tanh_c * o * (1 - o), i * (1 - g * g)], axis=3)
    through = o * (1 - tanh_c * tanh_c)
    back, dz = w[:, e:].transpose(0, 2, 1), np.empty((steps, 2, batch, 4, size), grad.dtype)
    dh_next = dc_next = 0
    for t in range(steps - 1, -1, -1):
        dh = grad[t] + dh_next
        dc = dh * through[t] + dc_next
        z = dz[t]
        z[:] = dc[:, :, None]
        z[:, :, 2] = dh
        z *= factor[t]
        dh_next, dc_next = z.reshape(2, batch, -1) @ back, dc * f[t]
    dz = dz.reshape(steps, 2, batch, -1)
    flat = lambda a: a.transpose(1, 0, 2, 3).reshape(2, -1, a.shape[3])
    earlier = np.concatenate([np.zeros_like(out[:1]), out[:-1]])
    each, dw = flat(dz), np.empty_like(w)
    dw[:, :e] = flat(x).transpose(0, 2, 1) @ each
    dw[:, e:] = flat(earlier).transpose(0, 2, 1) @ each
    return dz @ w[:, :e].transpose(0, 2, 1), dw, each.sum(axis=1)


def crf_loss(emit: np.ndarray, trans: np.ndarray, tags: np.ndarray):
    """Mean negative log likelihood of tags (T, B) and its gradients by emissions and transitions.

    Forward and backward probabilities are scaled at each step, so that none vanishes.
    """
    steps, batch, k = emit.shape
    trans = (trans + _BANNED[:k, :k]).astype(np.float64)
    top = emit.max(axis=2, keepdims=True).astype(np.float64)
    e, psi = np.exp(emit - top), np.exp(trans)
    forward, backward, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, batch, 1))
    now = e[0]
    for t in range(steps):
        if t:
            now = (forward[t - 1] @ psi) * e[t]
        scale[t] = now.sum(axis=1, keepdims=True)
        forward[t] = now / scale[t]
    for t in range(steps - 2, -1, -1):
        backward[t] = (e[t + 1] * backward[t + 1] / scale[t + 1]) @ psi.T
    one, at = np.arange(batch), np.arange(steps)[:, None]
    gold = emit[at, one, tags].sum(axis=0) + trans[tags[:-1], tags[1:]].sum(axis=0)
    total = np.log(scale).sum(axis=0)[:, 0] + top.sum(axis=0)[:, 0]
    d_emit = forward * backward
    d_emit[at, one, tags] -= 1
    d_trans = psi * np.einsum("tbi,tbj->ij", forward[:-1], e[1:] * backward[1:] / scale[1:], optimize=True)
    np.add.at(d_trans, (tags[:-1], tags[1:]), -1)
    return float((total - gold).mean()), (d_emit / batch).astype(emit.dtype), d_trans / batch


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tags (T, B)."""
    trans = trans + _BANNED[: len(trans), : len(trans)]
    best, back = emit[0], []
    for t in range(1, len(emit)):
        scores = best[:, :, None] + trans
        back.append(scores.argmax(axis=1))
        best = emit[t] + scores.max(axis=1)
    tags = np.empty(emit.shape[:2], np.int64)
    tags[-1] = best.argmax(axis=1)
    for t in range(len(emit) - 2, -1, -1):
        tags[t] = back[t][np.arange(emit.shape[1]), tags[t + 1]]
    return tags


class Tagger:
    def __init__(self, seed: int = SEED, symbols: int = SYMBOLS, embed: int = EMBED, hidden: int = HIDDEN, tags: int = _TAGS, kind=np.float64):
        r = np.random.default_rng(seed)
        make = lambda *s: r.normal(0, s[-2] ** -0.5, s)
        self.p = {"embed": r.normal(0, 0.5, (symbols, embed)), "w": make(2, embed + hidden, 4 * hidden), "b": np.zeros((2, 4 * hidden)), "out": make(2 * hidden, tags), "bias": np.zeros(tags), "trans": np.zeros((tags, tags))}
        self.p["b"][:, hidden : 2 * hidden] = 1
        self.p = {k: x.astype(kind) for k, x in self.p.items()}

    def emissions(self, codes: np.ndarray, keep: bool = False):
        """codes (T, B) to scores (T, B, tags)."""
        p, x = self.p, self.p["embed"][codes]
        x = np.stack([x, x[::-1]], axis=1)
        both, kept = _lstm(x, p["w"], p["b"], keep)
        h = np.concatenate([both[:, 0], both[::-1, 1]], axis=2)
        return h @ p["out"] + p["bias"], (x, h, both, kept)

    def gradients(self, codes: np.ndarray, tags: np.ndarray):
        p, size = self.p, self.p["b"].shape[1] // 4
        emit, (x, h, both, kept) = self.emissions(codes, keep=True)
        loss, d_emit, d_trans = crf_loss(emit, p["trans"], tags)
        dh = d_emit @ p["out"].T
        dx, dw, db = _lstm_back(x, p["w"], both, kept, np.stack([dh[..., :size], dh[::-1, :, size:]], axis=1))
        d_embed, flat_codes = np.zeros_like(p["embed"]), codes.ravel()
        d_x = (dx[:, 0] + dx[::-1, 1]).reshape(-1, x.shape[3])
        for j in range(d_embed.shape[1]):
            d_embed[:, j] = np.bincount(flat_codes, d_x[:, j], len(d_embed))
        flat = h.reshape(-1, h.shape[2])
        return loss, {"embed": d_embed, "w": dw, "b": db, "out": flat.T @ d_emit.reshape(-1, d_emit.shape[2]), "bias": d_emit.sum(axis=(0, 1)), "trans": d_trans}

    def fit(self, lines, epochs: int = EPOCHS, rate: float = 0.03) -> Tagger:
        codes, tags = np.stack([encode(t) for t, _ in lines]).astype(np.int64), np.stack([_tags(s) for _, s in lines])
        r, step = np.random.default_rng(SEED), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        total = epochs * -(-len(lines) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(lines))
            for at in range(0, len(order), BATCH):
                some, step = order[at : at + BATCH], step + 1
                _, grads = self.gradients(codes[some].T, tags[some].T)
                norm = sum(float((g**2).sum()) for g in grads.values()) ** 0.5
                for k, g in grads.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * (1 - step / (total + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(self.p[k].dtype)
        return self

    def weights(self) -> dict:
        return {k: x.astype(np.float32) for k, x in self.p.items()}


@lru_cache(4)
def trained(prose: tuple[str, ...] = ()) -> dict:
    """The weights; the seed and the words fix them."""
    return Tagger(kind=np.float32).fit(labelled_lines(prose=prose)).weights()


def prose_of(docs: DataFrame) -> tuple[str, ...]:
    """Words without digits and marks of the documents with the least ids: PROSE_DOCS of them, PROSE_WORDS words.

    The ids are found first, so that the texts are read of the files' parts that hold such ids.
    """
    ids = [r["doc_id"] for r in docs.select("doc_id").where("doc_id is not null").orderBy("doc_id").limit(PROSE_DOCS).collect()]
    if not ids:
        return ()
    near = docs.select("doc_id", "text").where((F.col("doc_id") <= F.lit(ids[-1])) & F.col("text").isNotNull())
    rows = near.groupBy("doc_id").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")).alias("m"), "text")).alias("x")).select("x.text").collect()  # PROSE_DOCS at most
    found = {w for r in rows for w in re.findall(r"(?<!\S)[^\W\d_]{1,16}(?!\S)", r["text"])}
    return tuple(sorted(found, key=lambda w: hashlib.md5(w.encode()).digest())[:PROSE_WORDS])


def weights_for(docs: DataFrame) -> dict:
    """The weights for these documents. They are kept in the shared folder, under a digest of the settings and the
    words; a later application with the same ones doesn't train again."""
    spark, prose = docs.sparkSession, prose_of(docs)
    if prose not in _HERE:
        if len(_HERE) > 4:
            _HERE.clear()
        _HERE[prose] = _found_or_trained(spark, prose)
    return _HERE[prose]


#: The weights that this process has trained or read.
_HERE: dict[tuple, dict] = {}


def _found_or_trained(spark: SparkSession, prose: tuple[str, ...]) -> dict:
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        return trained(prose)
    settings = (LINE, EMBED, HIDDEN, LINES, EPOCHS, BATCH, SEED, SYMBOLS, _TAGS, prose, labelled_lines(64))
    path = f"{base}/lodeline/models/pii-{hashlib.sha256(repr(settings).encode()).hexdigest()[:32]}"
    if (kept := _kept(spark, path)) is None:
        kept = trained(prose)
        _keep(spark, path, kept)
    return kept


def _kept(spark: SparkSession, path: str) -> dict | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    with np.load(io.BytesIO(spark.read.parquet(path).first()["weights"])) as found:
        return dict(found)


def _keep(spark: SparkSession, path: str, weights: dict) -> None:
    """Written beside and then put in place, so that no reader sees half of it; of two writers the first wins."""
    np.savez(out := io.BytesIO(), **weights)
    part = f"{path}.{uuid.uuid4().hex}"
    spark.createDataFrame([(bytearray(out.getvalue()),)], "weights binary").coalesce(1).write.parquet(part)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(make(path)) or not fs.rename(make(part), make(path)):
        fs.delete(make(part), True)


# ---------------------------------------------------------------- windows and spans


def _starts(text: str) -> list[int]:
    """Windows, at multiples of STRIDE, that hold a sign of a span."""
    out: set[int] = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        out.update(x for x in (k - 1, k) if x >= 0)
    return [k * STRIDE for k in sorted(out)]


_AT = re.compile(r" ?[(\[{] ?(?:at|@) ?[)\]}] ?| @ ")
_DOT = re.compile(r" ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| dot ")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: What a number's span has at most; an address of a mailbox may be of any length.
_LONGEST = 64


def _plausible(kind: str, text: str) -> bool:
    """What a decoded span must be to be kept; the network proposes, these are the kinds' own rules, after spelled-out signs are read."""
    if kind == "email":
        return bool(_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", text))))
    if len(text) > _LONGEST:
        return False
    if kind == "ip":
        return _valid("ip", p) if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", p := _DOT.sub(".", text)) else False
    n = len(_digits(text))
    return _valid("card", text) if kind == "card" else 10 <= n <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", text)) and any(c in " ().-" for c in text)


#: What may go on beyond a window's edge, by kind.
_MORE = {"email": re.compile(r"[A-Za-z0-9._%+-]+"), "ip": re.compile(r"[0-9.]+"), "card": re.compile(r"[0-9 -]+"), "phone": re.compile(r"[0-9 ().-]+")}

Piece = tuple[int, int, float, bool, bool]


def stitched(text: str, kind: str, pieces: list[Piece]) -> list[tuple[int, int, float]]:
    """Spans of one kind from windows' pieces (start, end, weight, cut at the start, cut at the end).

    Whole pieces stay. Pieces that overlap where one is cut become one, with the mean weight of their characters;
    what is still cut goes on, over the characters that the kind may have, beyond the edge.
    """
    out = [(a, b, w) for a, b, w, left, right in pieces if not (left or right)]
    merged: list[list] = []
    for a, b, w, left, right in sorted(pieces):
        if merged and a < (last := merged[-1])[1] and (last[4] or left):
            size = b - a
            last[2:4] = (last[2] * last[5] + w * size) / (last[5] + size), last[3] and (left or a > last[0])
            last[4] = right if b > last[1] else last[4] and (right or b < last[1])
            last[1], last[5] = max(last[1], b), last[5] + size
        else:
            merged.append([a, b, w, left, right, b - a])
    if any(m[3] or m[4] for m in merged):
        runs = [m.span() for m in _MORE[kind].finditer(text)]
        starts = [a for a, _ in runs]
        run_at = lambda i: runs[k] if 0 <= i and (k := bisect.bisect_right(starts, i) - 1) >= 0 and i < runs[k][1] else None
        for m in merged:
            if m[3] and (run := run_at(m[0] - 1)):
                m[0] = run[0]
            if m[4] and (run := run_at(m[1])):
                m[1] = run[1]
            while m[0] < m[1] and text[m[0]] in " .-)":
                m[0] += 1
            while m[0] < m[1] and text[m[1] - 1] in " .-(":
                m[1] -= 1
    out += [(m[0], m[1], m[2]) for m in merged if m[5] and m[0] < m[1]]
    return list(dict.fromkeys(out))


def reconcile(base: list[tuple[int, int, str]], found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Base spans and the heaviest set of found spans that overlap neither each other nor a base span."""
    best: dict = {}
    for a, b, kind, weight in found:
        if not any(a < d and c < b for c, d, _ in base):
            best[a, b, kind] = max(weight, best.get((a, b, kind), 0))
    spans = sorted(best, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    value, take = [0.0], []
    for i, s in enumerate(spans):
        before = int(np.searchsorted(ends[:i], s[0], side="right"))
        with_it = value[before] + best[s] * (s[1] - s[0])
        take.append(before if with_it > value[i] else -1)
        value.append(max(with_it, value[i]))
    out, i = list(base), len(spans)
    while i:
        if take[i - 1] >= 0:
            out.append(spans[i - 1])
            i = take[i - 1]
        else:
            i -= 1
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_spans(bodies: list[str], weights: dict) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans."""
    tagger = Tagger.__new__(Tagger)
    tagger.p = weights
    found: list[list] = [[] for _ in bodies]
    # Texts are encoded once; windows of many texts run together.
    places = [(i, s) for i, text in enumerate(bodies) if _TRIGGER.search(text) for s in _starts(text)]
    coded: dict = {}
    pieces: dict[tuple[int, str], list[Piece]] = {}
    for at in range(0, len(places), TOGETHER):
        some = places[at : at + TOGETHER]
        coded = {i: coded[i] if i in coded else encode(bodies[i]) for i in {i for i, _ in some}}
        codes = np.zeros((WINDOW, len(some)), np.int64)
        for j, (i, s) in enumerate(some):
            part = coded[i][s : s + WINDOW]
            codes[: len(part), j] = part
        emit, _ = tagger.emissions(codes)
        tags = viterbi(emit, weights["trans"])
        margin = np.take_along_axis(emit, tags[:, :, None], 2)[:, :, 0] - emit[:, :, 0]
        begins, columns = np.nonzero(tags % 2 == 1)
        for a, j in zip(begins.tolist(), columns.tolist(), strict=True):
            kind, b = int(tags[a, j]), a + 1
            while b < WINDOW and tags[b, j] == kind + 1:
                b += 1
            i, s = some[j]
            text = bodies[i]
            if s + b <= len(text):
                piece = s + a, s + b, float(margin[a:b, j].mean()), a == 0 and s > 0, b == WINDOW and s + WINDOW < len(text)
                pieces.setdefault((i, KINDS[kind // 2]), []).append(piece)
    for (i, kind), some in pieces.items():
        for a, b, weight in stitched(bodies[i], kind, some):
            if weight >= LEAST_MARGIN and _plausible(kind, bodies[i][a:b]):
                found[i].append((a, b, kind, weight))
    base = [base_spans(t) for t in bodies]
    return [(b, reconcile(b, f) if f else b) for b, f in zip(base, found, strict=True)]


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _strings(column) -> list[str]:
    return [(x or b"").decode("utf-8", "surrogatepass") for x in column.cast(pa.binary()).to_pylist()]


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and decoded).

    A null or empty text has no spans. Repeated rows are judged alike; an empty table gives an empty result;
    other columns are not read.
    """
    shared = session(docs).sparkContext.broadcast((uuid.uuid4().hex, weights_for(docs)))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = find_spans(_strings(batch["text"]), shared.value[1])
        counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in both], pa.int64()) for kind in KINDS]
        return pa.record_batch(
            [batch["doc_id"], *counts, pa.array([hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in both]), pa.array([_join(every) for _, every in both])],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )

    chosen = docs.select("doc_id", "text")
    return map_arrow(chosen, each, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or stretch of overlapping spans, as its (first) kind in angle brackets."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs``, all its columns and rows, with personal data masked in text and n_chars, where there is such a column, counted anew. A null text stays null."""
    shared = session(docs).sparkContext.broadcast((uuid.uuid4().hex, weights_for(docs)))
    schema = docs.schema

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = _strings(batch["text"])
        new = [masked(t, every) if every else t for t, (_, every) in zip(bodies, find_spans(bodies, shared.value[1]), strict=True)]
        nulls = batch["text"].is_null().to_pylist()
        text = pa.array([None if n else t.encode("utf-8", "surrogatepass") for t, n in zip(new, nulls, strict=True)], pa.binary()).cast(pa.string())
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)} | {"text": text}
        if "n_chars" in columns:
            kind = columns["n_chars"].type
            columns["n_chars"] = pa.array([old if t == before else len(t) for t, before, old in zip(new, bodies, columns["n_chars"].to_pylist(), strict=True)], kind)
        return pa.record_batch(list(columns.values()), list(columns))

    return map_arrow(docs, each, schema)
