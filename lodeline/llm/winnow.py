"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into words, or into characters where its words are few or very long, as in scripts without blanks. Each
is hashed, and K consecutive ones have the polynomial hash that a rolling hash gives; from every window of WINDOW
such hashes the least is kept, the rightmost of equal ones, with its place. Two texts that share
K + WINDOW - 1 consecutive words share a fingerprint of them.

The polynomial is summed by doubling (of two, of four, of five units), all places at once: Spark's only sequential
function, ``aggregate``, would copy the whole array at each step that rolls the hash on. The values are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.shared import STRETCHES, place_among, split_points

#: Words in a gram and grams in a window: 5 + 8 - 1 = 12 shared words are always found.
K, WINDOW = 5, 8
#: A text whose words are longer than this on average is cut into characters, as is one of fewer than K words.
LONG_WORDS = 32
#: Modulus and base of the polynomial; products stay below 2 to the 62nd.
MODULUS, BASE = 2**31 - 1, 1_000_003
#: Documents in a stretch of ids that is put in order together.
STRETCH = 64

_PLACE = 2**31 - 1


def _next(array: Column, other: Column, by: int, both) -> Column:
    """both(array[i], other[i + by]) as far as both reach."""
    n = F.greatest(F.least(F.size(array), F.size(other) - by), F.lit(0))
    return F.zip_with(F.slice(array, 1, n), F.slice(other, by + 1, n), both)


def _roll(units: int):
    """Moves a hash on by so many units and adds that of what follows."""
    shift = F.lit(pow(BASE, units, MODULUS)).cast("bigint")
    return lambda a, b: (a * shift + b) % F.lit(MODULUS)


def add_fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds ``to``: an array of longs, each a gram's hash before 31 bits of its place, counted from the end of the range so that of equal hashes the rightmost is least.

    Units are words, or characters where there are fewer than K words or they are longer than LONG_WORDS on average.
    A text of fewer than K units has one gram, all its units; an empty text has one gram as well. ``text`` is not null.
    Each step is a column of its own, so that none is worked out twice.
    """
    c = lambda name: F.col(f"__{to}_{name}")
    steps = {
        "line": F.trim(F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")),
        "words": F.split(c("line"), " +"),
        "few": (F.size(c("words")) < K) | (F.length(c("line")) > LONG_WORDS * F.size(c("words"))),
        "cut": F.when(c("few") & (c("line") != ""), F.split(c("line"), "")).otherwise(c("words")),
        "units": F.transform(c("cut"), lambda w: F.pmod(F.xxhash64(w), F.lit(MODULUS))),
        "two": _next(c("units"), c("units"), 1, _roll(1)),
        "four": _next(c("two"), c("two"), 2, _roll(2)),
        "five": _next(c("four"), c("units"), 4, _roll(1)),
        "grams": F.when(F.size(c("five")) > 0, c("five")).otherwise(F.array(F.aggregate(c("units"), F.lit(0).cast("bigint"), _roll(1)))),
        "placed": F.transform(c("grams"), lambda h, i: F.shiftleft(h, 31).bitwiseOR(F.lit(_PLACE).cast("bigint") - i)),
        "min2": _next(c("placed"), c("placed"), 1, lambda a, b: F.least(a, b)),
        "min4": _next(c("min2"), c("min2"), 2, lambda a, b: F.least(a, b)),
        "min8": _next(c("min4"), c("min4"), 4, lambda a, b: F.least(a, b)),
    }
    for name, step in steps.items():
        df = df.withColumn(f"__{to}_{name}", step)
    df = df.withColumn(to, F.when(F.size(c("min8")) > 0, F.array_distinct(c("min8"))).otherwise(F.array(F.array_min(c("placed")))))
    return df.drop(*(f"__{to}_{name}" for name in steps))


def as_text(fingerprint: Column) -> Column:
    """``hash:place`` in the order of the text, comma-joined; a place is a unit's, from 0."""
    one = lambda v: F.concat(F.lower(F.hex(F.shiftrightunsigned(v, 31))), F.lit(":"), (F.lit(_PLACE) - v.bitwiseAND(F.lit(_PLACE).cast("bigint"))).cast("string"))
    return F.concat_ws(",", F.transform(fingerprint, one))


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftrightunsigned(v, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes, neither of them empty."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def with_successor(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the row after it; the first row follows the last.

    Rows go by doc_id, null first, and those of one doc_id by a hash of their text and then the text. The order is cut
    into stretches by quantiles of the ids (of ids and text hashes, where ids repeat much), so that stray or crowded
    ids crowd no stretch. A stretch's first row is sent to the stretch before as well, so no row needs more than its
    own stretch, and texts move once.
    """
    n = docs.count()
    # A null id is before all others.
    docs = docs.withColumns({"__known": F.col("doc_id").isNotNull(), "__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))})
    docs = docs.withColumn("__hash", F.xxhash64("text"))
    parts = ["__id"]
    points = split_points(docs.select(*parts), n, STRETCH)
    if len(points) < min(STRETCHES, n // STRETCH) - 1:  # an id fills a stretch or more; its texts tell its rows apart
        parts = ["__id", "__hash"]
        points = split_points(docs.select(*parts), n, STRETCH)
    docs = docs.withColumn("__own", place_among([F.col(c) for c in parts], points))
    key = ["__known", *parts]
    firsts = docs.groupBy("__own").agg(F.min(F.struct(*key)).alias("first")).orderBy("__own").select("__own", "first.*").collect()  # a row for each stretch
    before = [(*r[1:], firsts[i - 1]["__own"]) for i, r in enumerate(firsts)]
    there = ["__there_known", "__there_id", "__there_hash"][: len(key)]
    kinds = ("boolean", "bigint", "bigint")
    back = docs.sparkSession.createDataFrame(before, ", ".join(f"{c} {k}" for c, k in zip(there, kinds, strict=False)) + ", __before int")
    same = (F.col(key[0]) == F.col(there[0])) & (F.col(key[1]) == F.col(there[1]))
    if len(key) > 2:
        same = same & (F.col(key[2]) == F.col(there[2]))
    places = F.filter(
        F.array(F.struct(F.col("__own").alias("s"), F.lit(False).alias("guest")), F.struct(F.col("__before").alias("s"), F.lit(True).alias("guest"))),
        lambda p: p["s"].isNotNull(),
    )
    dealt = docs.join(F.broadcast(back), same, "left").drop(*there).select("*", F.inline(places).alias("__stretch", "__guest")).drop("__before", "__own")
    # All from one window, or the texts would move once for each.
    order = Window.partitionBy("__stretch").orderBy("__guest", "__known", "__id", "__hash", "text")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("not __guest").drop("__stretch", "__guest", "__known", "__id", "__hash")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty. In a table of one row that row follows itself; an empty table gives an empty result.
    Repeated rows follow each other. Other columns are not read.
    """
    own = add_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "print")
    both = with_successor(own, ["text", "print"])
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.substring("next_text", F.lit(1), quarter))
    both = add_fingerprint(both.withColumn("edited", edited), "edited", "edited_print")
    both = both.withColumn("h", hashes(F.col("print"))).withColumn("he", hashes(F.col("edited_print"))).withColumn("hn", hashes(F.col("next_print")))
    return both.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("he")).alias("near_edited"),
        likeness(F.col("h"), F.col("hn")).alias("near_next"),
    )
