"""Web archive revisits: a not-modified capture gets the latest earlier full response of its URL.

An as-of join on (canonical URL, time) of narrow rows: payloads don't move, their digests do. Captures are dealt
by ranges of (URL, time, id), so a URL with a third of all captures is many parts of even size, whatever
its times. Inside a part a window carries the last full response of a URL forward; only the last URL of a
part can go on in the next one, so what crosses parts is one row a part. Validators are compared and
the headers that a 304 may update are merged where the window stands: nothing is joined back by id.

read_warc gives the records of WARC files, gzip members or plain, as rows for resolve_revisits.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costloom.llm.common import checked_broadcast, cut, emit

# Headers that a 304 response may bring up to date, and query parameters that only track.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|fbclid|gclid)="


def canonical_url(url: Column) -> Column:
    """Host and path in one form: no scheme, user, fragment, default port or tracking; sorted parameters.

    Null stays null. Host in lower case, an empty path is "/".
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":(80|443)?$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _latest_before(rows: DataFrame) -> DataFrame:
    """The revisits of rows (record_id, key, time, full, info) with before: the info of the last full one ahead of them."""
    dealt = cut(rows.repartitionByRange("key", "time", "record_id").withColumn("part", F.spark_partition_id()))
    mark = F.when(F.col("full"), F.struct("time", "record_id"))
    # One row a part: its first and its last key.
    edge = cut(dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")))
    side = checked_broadcast(edge, 512)
    ends = dealt.filter("full").join(side.select(F.col("part").alias("of"), "last"), (F.col("part") == F.col("of")) & (F.col("key") == F.col("last")))
    ends = ends.groupBy("key", "part").agg(F.max_by("info", mark).alias("info"), F.max(mark).alias("at"))
    asked = edge.select(F.col("first").alias("key"), "part", F.lit(None).cast(ends.schema["info"].dataType).alias("info"), F.lit(None).cast(ends.schema["at"].dataType).alias("at"))
    ahead = Window.partitionBy("key").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    both = ends.withColumn("ask", F.lit(False)).unionByName(asked.withColumn("ask", F.lit(True)))
    carried = both.withColumn("carried", F.max_by("info", "at").over(ahead)).filter("ask AND carried IS NOT NULL").select(F.col("key").alias("of_key"), F.col("part").alias("of"), "carried")
    # At one time and id the revisit is not after the response.
    inside = Window.partitionBy("part", "key").orderBy("time", "record_id", "full").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("own", F.max_by("info", mark).over(inside)).filter(~F.col("full"))
    found = own.join(checked_broadcast(cut(carried), 4096), (F.col("part") == F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    return found.select("record_id", "key", "time", "headers", F.coalesce("own", "carried").alias("before"))


def _validator(name: str, side: str) -> Column:
    value = F.element_at(F.col(f"{side}_headers"), name)
    return F.regexp_replace(value, "^W/", "") if name == "etag" else value


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, time, response_id, state, headers, payload_sha256, payload_bytes.

    records has record_id, url, time, kind ("response" or "revisit"), status, headers (map, lower-case
    names), payload. A full response has kind response, status 200 and a payload. A revisit's response is the
    latest earlier one of its canonical URL; of equal times, smaller ids are earlier. state:
    "missing" where there is none; "mismatch" where an ETag that both have (weak comparison), or without
    one a Last-Modified that both have, differs; "unvalidated" where they share no validator; else
    "resolved". Only resolved revisits get merged headers: the response's, with the permitted ones of the
    revisit in their place. Null urls match nothing; null times come first; repeated rows and ids resolve each;
    extra columns are ignored; no rows give no rows.
    """
    full = F.coalesce((F.col("kind") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull(), F.lit(False))
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    data = F.col("payload").cast("binary")
    info = F.struct(F.col("record_id").alias("response_id"), headers.alias("headers"), F.sha2(data, 256).alias("payload_sha256"), F.octet_length(data).cast("long").alias("payload_bytes"))
    kept = records.filter((F.col("kind") == "revisit") | full).select("record_id", canonical_url(F.col("url")).alias("key"), "time", full.alias("full"), F.when(~full, headers).alias("headers"), F.when(full, info).alias("info"))
    rows = cut(kept.filter("key IS NOT NULL OR NOT full"))
    alone = rows.filter("key IS NULL").select("record_id", "key", "time", "headers", F.lit(None).cast(rows.schema["info"].dataType).alias("before"))
    both = _latest_before(rows.filter("key IS NOT NULL")).unionByName(alone)
    both = both.select("record_id", F.col("key").alias("url_key"), "time", F.col("headers").alias("revisit_headers"), F.col("before.response_id").alias("response_id"), F.col("before.headers").alias("response_headers"), "before.payload_sha256", "before.payload_bytes", F.col("before").isNotNull().alias("there"))

    def compare(name: str) -> Column:
        return _validator(name, "revisit") == _validator(name, "response")

    same = F.coalesce(compare("etag"), compare("last-modified"))
    state = F.when(~F.col("there"), "missing").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    updates = F.map_filter("revisit_headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("response_headers", lambda k, _: ~F.map_contains_key(updates, k)), updates)
    ok = F.col("state") == "resolved"
    out = both.withColumn("state", state)
    return out.select("record_id", "url_key", "time", "response_id", "state", F.when(ok, merged).alias("headers"), F.when(ok, F.col("payload_sha256")).alias("payload_sha256"), F.when(ok, F.col("payload_bytes")).alias("payload_bytes"))


_LINE = re.compile(rb"\r?\n")


def _members(data: bytes) -> bytes:
    """The bytes without gzip, whose members follow each other; a broken member ends them."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = bytearray()
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(16 + zlib.MAX_WBITS)
        try:
            out += one.decompress(data) + one.flush()
        except zlib.error:
            break
        data = one.unused_data
    return bytes(out)


def _fields(block: bytes) -> tuple[str, dict[str, str]]:
    """(first line, fields by lower-case name); a folded line goes on, a repeated field is joined by commas."""
    lines = [x.decode("utf-8", "replace") for x in _LINE.split(block)]
    found: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = (x.strip() for x in line.split(":", 1))
            name = name.lower()
            found[name] = f"{found[name]}, {value}" if name in found else value
    return lines[0] if lines else "", found


def warc_records(data: bytes) -> Iterator[dict]:
    """The response, resource and revisit records of a WARC file in order; what is cut off or broken ends it.

    record_id is WARC-Record-ID, time whole seconds of WARC-Date (null where it can't be read), status and
    headers those of the HTTP message in the block, payload its body undone of chunked and gzip coding;
    revisits have none. profile and refers_to are the record's own fields.
    """
    import datetime

    data, at = _members(data), 0
    while True:
        at = data.find(b"WARC/", at)
        end = re.compile(rb"\r?\n\r?\n").search(data, max(at, 0))
        if at < 0 or end is None:
            return
        version, own = _fields(data[at : end.start()])
        size = own.get("content-length", "")
        if not re.fullmatch(r"WARC/[0-9.]+", version) or not size.isdigit() or end.end() + int(size) > len(data):
            return
        block, at = data[end.end() : end.end() + int(size)], end.end() + int(size)
        kind = own.get("warc-type")
        if kind not in ("response", "resource", "revisit"):
            continue
        status, headers, payload = (200, {}, block) if kind == "resource" else (None, {}, b"")
        if block[:5] == b"HTTP/":
            cut_at = re.compile(rb"\r?\n\r?\n").search(block)
            first, headers = _fields(block[: cut_at.start() if cut_at else len(block)])
            parts = first.split()
            status, payload = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None, block[cut_at.end() :] if cut_at else b""
            if "chunked" in headers.get("transfer-encoding", "").lower():
                payload = _unchunked(payload)
            if headers.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
                try:
                    payload = gzip.decompress(payload)
                except (OSError, EOFError, zlib.error):
                    pass
        try:
            when = datetime.datetime.fromisoformat(own.get("warc-date", "")).replace(tzinfo=datetime.UTC)
            time = int(when.timestamp())
        except ValueError:
            time = None
        url = own.get("warc-target-uri")
        yield {
            "record_id": own.get("warc-record-id"), "url": url.strip("<>") if url else None, "time": time, "kind": "revisit" if kind == "revisit" else "response", "status": status, "headers": list(headers.items()),
            "payload": None if kind == "revisit" else payload, "profile": own.get("warc-profile"), "refers_to": own.get("warc-refers-to"),
        }


def _unchunked(body: bytes) -> bytes:
    out, at = bytearray(), 0
    while (line := _LINE.search(body, at)) is not None:
        size = body[at : line.start()].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size) or not int(size, 16):
            break
        out += body[line.end() : line.end() + int(size, 16)]
        at = line.end() + int(size, 16) + 2
    return bytes(out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of warc_records of all files under path, with file. A file is one task's; files without records give none."""
    schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("time", pa.int64()), ("kind", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("profile", pa.string()), ("refers_to", pa.string()), ("file", pa.string())])

    def run(batches):
        rows = emit(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                for record in warc_records(batch["content"][i].as_py() or b""):
                    yield from rows.add(record | {"file": batch["path"][i].as_py()}, 500 + len(record["payload"] or b""))
        yield from rows.rest()

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "record_id string, url string, time long, kind string, status int, headers map<string,string>, payload binary, profile string, refers_to string, file string")


def pages_as_captures(pages: DataFrame) -> DataFrame:
    """A capture log of pages, two records each: the page at a minute of its own and, later, a revisit.

    The revisit asks by another spelling of the URL. Every seventh has the validator of another version,
    every eleventh none; every thirteenth page was captured as an error, so that its revisit has to look
    further back.
    """
    at = F.col("page_id") * 60 + 1_600_000_000
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    gone = F.pmod("page_id", F.lit(13)) == 0
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", at.alias("time"), F.lit("response").alias("kind"), F.when(gone, 404).otherwise(200).alias("status"),
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), at.cast("string"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"), F.col("html").alias("payload"),
    )
    sent = F.when(F.pmod("page_id", F.lit(7)) == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    later = at + 31 + F.pmod(F.col("page_id") * 7919, F.lit(86_400))
    some = F.create_map(F.lit("date"), later.cast("string"), F.lit("content-type"), F.lit("ignored/ignored"))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=feed#seen")).alias("url"), later.alias("time"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(F.pmod("page_id", F.lit(11)) == 0, some).otherwise(F.map_concat(some, F.create_map(F.lit("etag"), sent))).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


ORACLE = r"""
WITH p AS (SELECT page_id, url, html, page_id * 60 + 1600000000 AS seen, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
                  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)?$', '') AS host,
             regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path,
             list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid)='))) AS args FROM p),
k AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS key FROM q),
full_ AS (SELECT * FROM k WHERE page_id % 13 <> 0 AND html IS NOT NULL),
rev AS (SELECT page_id, key, seen + 31 + (page_id * 7919) % 86400 AS t,
               CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"other"' ELSE tag END AS sent FROM k),
j AS (SELECT r.page_id, r.key, r.t, r.sent, arg_max(f.page_id, (f.seen, f.page_id)) AS f FROM rev r
      LEFT JOIN full_ f ON f.key = r.key AND (f.seen < r.t OR f.seen = r.t AND f.page_id * 2 < r.page_id * 2 + 1) GROUP BY ALL),
s AS (SELECT j.*, x.tag, x.html, CASE WHEN j.f IS NULL THEN 'missing' WHEN sent IS NULL THEN 'unvalidated' WHEN sent = x.tag THEN 'resolved' ELSE 'mismatch' END AS state
      FROM j LEFT JOIN full_ x ON x.page_id = j.f)
SELECT page_id * 2 + 1 AS record_id, key AS url_key, t AS time, f * 2 AS response_id, state,
       CASE WHEN state = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || t || chr(10) || 'etag: W/' || sent END AS headers,
       CASE WHEN state = 'resolved' THEN sha256(html) END AS payload_sha256,
       CASE WHEN state = 'resolved' THEN CAST(strlen(html) AS BIGINT) END AS payload_bytes
FROM s
"""


def op9_warc(spark, sf_dir: str) -> DataFrame:
    found = resolve_revisits(pages_as_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.withColumn("headers", lines)
