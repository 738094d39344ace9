"""WARC: resolution of not-modified revisits.

A revisit record (a 304) holds headers but no body. It is matched, by an as-of join, with the latest full
response of the same canonical URL before it; where their validators agree, the stored headers are merged with
those that a 304 may update. DataFrame functions only.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.llm.shared import place_among, ship, split_points

#: Headers of a 304 that replace the stored ones; others of it are ignored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not tell pages apart.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"
#: Records in a stretch of time, about; a URL has as many there at most.
STRETCH = 1_024

RECORDS = "record_id bigint, url string, ts bigint, kind string, status int, headers map<string,string>, digest string"


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and a last slash go; the host is lower-cased and parameters are sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i)https?://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Headers as sorted (key, value) pairs with lower-case keys; of keys that differ in case only the least stays."""
    pairs = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.filter(pairs, lambda e, i: (i == 0) | (F.get(pairs, i - 1)["key"] != e["key"]))


def _value(pairs: Column, key: str) -> Column:
    return F.get(F.filter(pairs, lambda e: e["key"] == key), F.lit(0))["value"]


def _tag(etag: Column) -> Column:
    """Weak comparison: W/ is left out."""
    return F.regexp_replace(etag, "^W/", "")


def as_text(pairs: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(pairs), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per not-modified revisit of ``records`` (see RECORDS): record_id, url (canonical), ts, response_id, outcome, headers, digest.

    A revisit whose status isn't 304 is of an identical payload, not of one that the server calls unmodified; it is
    left out, as are other kinds.

    ``outcome`` is ``resolved`` (validators agree), ``unverified`` (no validator in common), ``mismatch`` or
    ``orphan`` (no earlier full response: status 200 of kind response). Headers are the stored ones under the
    permitted ones of the revisit, digest the stored one, where resolved or unverified; else the revisit's own
    headers and null. A response at the revisit's own time isn't earlier; of several at one time the largest
    record_id counts. Records with a null url or ts match nothing: their revisits are orphans. Repeated rows are
    resolved alike. An empty table gives an empty result; other columns are not read.

    Time is cut into stretches by quantiles of all records' times, so a hot URL's records are many groups and a stray
    time makes no stretch larger. What a stretch inherits is found from one row for each stretch and joins it as one
    more response, so no task holds more of a URL than a stretch.
    """
    pairs = _lowered(F.col("headers"))
    base = records.select("record_id", canonical_url(F.col("url")).alias("canon"), F.col("ts").cast("bigint").alias("ts"), "kind", "status", pairs.alias("pairs"), "digest")
    points = split_points(base.select("ts"), base.count(), STRETCH)
    not_modified = (F.col("kind") == "revisit") & F.coalesce(F.col("status") == 304, F.lit(False))
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200), F.struct("ts", "record_id", "digest", "pairs"))
    dealt = base.withColumn("stretch", place_among([F.col("ts")], points)).withColumn("full", full)
    dealt = dealt.where(F.col("full").isNotNull() | not_modified)
    earlier = Window.partitionBy("canon").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    inherited = (
        dealt.where("canon is not null and ts is not null")
        .groupBy("canon", "stretch")
        .agg(F.max("full").alias("most"), F.max(not_modified).alias("asks"))
        .withColumn("full", F.max("most").over(earlier))
        .where("asks and full is not null")
    )
    columns = ["canon", "stretch", "ts", "record_id", "kind", "pairs", "full"]
    guests = inherited.select("canon", "stretch", F.col("full.ts").alias("ts"), F.col("full.record_id").alias("record_id"), F.lit("guest").alias("kind"), F.col("full.pairs").alias("pairs"), "full")
    # Rows without a URL or time meet nobody; they are dealt by their id.
    loose = F.col("canon").isNull() | F.col("ts").isNull()
    w = Window.partitionBy("canon", "stretch", F.when(loose, F.col("record_id"))).orderBy("ts", F.col("kind") != "revisit").rowsBetween(Window.unboundedPreceding, -1)  # at one time revisits come first
    asof = dealt.select(*columns).unionByName(guests.select(*columns)).withColumn("r", F.when(~loose, F.max("full").over(w))).where("kind = 'revisit'")
    stored = F.col("r.pairs")
    etags = (_tag(_value(stored, "etag")), _tag(_value(F.col("pairs"), "etag")))
    times = (_value(stored, "last-modified"), _value(F.col("pairs"), "last-modified"))
    both = lambda p: p[0].isNotNull() & p[1].isNotNull()
    outcome = (
        F.when(F.col("r").isNull(), "orphan")
        .when(both(etags), F.when(etags[0] == etags[1], "resolved").otherwise("mismatch"))
        .when(both(times), F.when(times[0] == times[1], "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    updates = F.filter(F.col("pairs"), lambda e: e["key"].isin(*PERMITTED))
    merged = F.concat(F.filter(stored, lambda e: ~F.exists(updates, lambda u: u["key"] == e["key"])), updates)
    good = F.col("outcome").isin("resolved", "unverified")
    return asof.withColumn("outcome", outcome).select(
        "record_id",
        F.col("canon").alias("url"),
        "ts",
        F.col("r.record_id").alias("response_id"),
        "outcome",
        as_text(F.when(good, merged).otherwise(F.col("pairs"))).alias("headers"),
        F.when(good, F.col("r.digest")).alias("digest"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Raw pages as a crawl: each page is a full response, and a revisit of its URL comes right after it.

    Of the revisits by page_id: 1 in 5 has another ETag, 1 in 7 none but the time of change, 1 in 11 no validator,
    and 1 in 3 comes before its page's response, so that an earlier capture, if any, is what it can mean.
    """
    n, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    etag = F.concat(F.lit('"'), F.md5(html.cast("binary")), F.lit('"'))
    changed = F.concat(F.lit("day "), (n % 365).cast("string"))
    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), etag, F.lit("Last-Modified"), changed, F.lit("Date"), n.cast("string"))
    mine = F.when(n % 5 == 0, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("W/"), etag))
    short = F.create_map(F.lit("Date"), (n + 1).cast("string"), F.lit("Content-Type"), F.lit("ignored"), F.lit("Expires"), F.lit("later"))
    held = (
        F.when(n % 11 == 0, short)
        .when(n % 7 == 0, F.map_concat(short, F.create_map(F.lit("last-modified"), changed)))
        .otherwise(F.map_concat(short, F.create_map(F.lit("etag"), mine)))
    )
    response = pages.select((n * 2).alias("record_id"), "url", (n * 4).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), full.alias("headers"), F.sha2(html, 256).alias("digest"))
    revisit = pages.select((n * 2 + 1).alias("record_id"), "url", (n * 4 + F.when(n % 3 == 0, -1).otherwise(1)).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), held.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return response.unionByName(revisit)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)
#: Bytes that are read at once of a file, and the longest head of a record that is looked for.
CHUNK, LONGEST_HEAD = 1 << 20, 1 << 20


def _fields(lines: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines.split("\r\n"))}


def parse_warc(stream) -> Iterator[dict]:
    """The response and revisit records of a binary stream of a WARC file, plain or gzipped, as they are read:
    record, url, date, kind, status, headers, body. What is no record is passed over to the next head."""
    stream = io.BufferedReader(stream, CHUNK)
    source = gzip.GzipFile(fileobj=stream) if stream.peek(2)[:2] == b"\x1f\x8b" else stream
    held = b""
    while True:
        m = _HEAD.search(held)
        if not m:
            more = source.read(CHUNK)
            if not more:
                return
            held = (held if len(held) < LONGEST_HEAD else held[-64:]) + more
            continue
        fields = _fields(m[1].decode("utf-8", "replace"))
        length, block = fields.get("content-length", "0"), held[m.end() :]
        size = int(length) if length.isdigit() and len(length) < 19 else 0
        if len(block) < size:
            block += source.read(size - len(block))
        block, held = block[:size], block[size:]
        if fields.get("warc-type") in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            first, _, lines = head.decode("latin-1").partition("\r\n")
            status = (first.split(" ") + ["", ""])[1]
            yield {
                "record": fields.get("warc-record-id"),
                "url": fields.get("warc-target-uri"),
                "date": fields.get("warc-date"),
                "kind": fields["warc-type"],
                "status": int(status) if status.isdigit() and len(status) < 6 else None,
                "headers": {k: v for k, v in _fields(lines).items() if k},
                "body": body,
            }


WARC_ROWS = pa.schema([("file", pa.string()), ("place", pa.int32()), ("record", pa.string()), ("url", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC files as rows (file, place, record, url, date, kind, status, headers, body), one task for each file.

    A file is passed on as bytes by Spark's reader (so it has 2 GB at most) and unzipped piece by piece; a record is
    sent on when it is read.
    """
    ship(spark)

    def run(batches):
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                for i, r in enumerate(parse_warc(io.BytesIO(content.as_buffer()))):
                    row = {"file": file, "place": i, **r, "headers": list(r["headers"].items())}
                    yield pa.RecordBatch.from_pylist([row], schema=WARC_ROWS)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = "file string, place int, record string, url string, date string, kind string, status int, headers map<string,string>, body binary"
    return files.mapInArrow(run, kinds)


def records_of_warc(rows: DataFrame) -> DataFrame:
    """``read_warc`` as RECORDS: record_id is a hash of file and place, ts the date in microseconds (null if it is none), digest of the body."""
    when = F.unix_micros(F.try_to_timestamp("date"))
    return rows.select(F.xxhash64("file", "place").alias("record_id"), "url", when.alias("ts"), "kind", "status", "headers", F.when(F.col("kind") == "response", F.sha2("body", 256)).alias("digest"))
