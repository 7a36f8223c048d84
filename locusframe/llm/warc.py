r"""WARC archives: written from pages, read back, assembled into one nested row per capture.

`write` makes three records per page: a request, a response (or a revisit, if another page's response has the same payload) and a
metadata record. Request and metadata name the response in WARC-Concurrent-To. Archives are UTF-8 and gzip, written by Spark's text
writer (a record's closing blank lines are its line separator), so they go wherever the shared folder is, and a lost task is just
run again. `max_records` bounds the pages of one archive file, and with it the memory of the task that reads it.

`read` parses any WARC 1.x file, with one gzip member per file or per record or none: payloads of responses are what follows the
HTTP head. Bytes that don't parse are skipped up to the next record. `assemble` joins the records of a capture by their
concurrent-to identifiers; a revisit gets payload figures and page through the record that it refers to.

Of pages with equal payload (of `min_bytes` at least), the one with the largest page_id is the response (all of them, if several rows
have that page_id; revisits then refer to the one with the largest url). Null html is an empty payload, a null url an empty target, a
null page_id ranks below every other. Repeated rows are as many captures. Line breaks and control characters in a url are
percent-encoded in its header. An empty table gives an empty result; columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32(hexa: Column) -> Column:
    """Base32 of 40 hexadecimal digits."""
    out = []
    for i in range(8):
        n = F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.lit(BASE32).substr(F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind: Column | str, record_id: Column, target: Column, date: str, content: str, block: Column, *headers: Column) -> Column:
    """A record without the two line breaks that close it. A null header is left out."""
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), record_id,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), target, *[F.coalesce(F.concat(F.lit(CRLF), h), F.lit("")) for h in headers],
        F.lit(f"\r\nContent-Type: {content}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, block)


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", max_records: int = 2000) -> None:
    """Writes archives of pages (page_id, url, html) under `path`."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    equal = p.filter(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    p = p.join(equal.select("sha1", "top"), "sha1", "left")  # few keys; a hot one is split by AQE
    target = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1F]", "%20")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top.page_id"))
    name = lambda kind, page, url: _uuid(F.lit(kind), F.coalesce(page.cast("string"), F.lit("")), url, F.col("sha1"))
    own = name("response", F.col("page_id"), F.col("url"))
    payload_digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1")))
    joined = F.concat(F.lit("WARC-Concurrent-To: "), own)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    request = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\n\r\n"))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    value = F.concat_ws(
        "\r\n\r\n",
        _record("request", name("request", F.col("page_id"), F.col("url")), target, date, "application/http;msgtype=request", request, joined),
        _record(
            F.when(revisit, "revisit").otherwise("response"), own, target, date, "application/http;msgtype=response", F.when(revisit, http).otherwise(F.concat(http, "html")), payload_digest,
            F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("response", F.col("top.page_id"), F.col("top.url")))),
        ),
        _record("metadata", name("metadata", F.col("page_id"), F.col("url")), target, date, "application/warc-fields", fields, joined),
    )
    out = p.select(value.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max_records)
    out.option("zlib.compress.level", "BEST_SPEED").text(path)


RECORD = "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, fields map<string,string>, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def inflated(data: bytes) -> bytes:
    """The contents of any number of gzip members, or the bytes themselves."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out) if out else data


def _headers(head: bytes) -> dict[str, str]:
    out, last = {}, None
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if colon:
            last = name.strip().lower().decode("latin-1")
            out[last] = value.strip().decode("utf-8", "replace")
    return out


def records(data: bytes, payload: bool = True) -> Iterator[tuple]:
    """The records of one archive's bytes, as RECORD has them."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        h = _headers(data[at:end]) if end >= 0 else {}
        if not h.get("content-length", "").isdigit() or "warc-record-id" not in h:
            at += 7
            continue
        block = data[end + 4 : end + 4 + int(h["content-length"])]
        at, kind = end + 4 + int(h["content-length"]), h.get("warc-type")
        body, declared, ok, fields = None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None
        if kind == "response":
            cut = block.find(b"\r\n\r\n") if block[:5] == b"HTTP/" else -4
            body = block[cut + 4 :]
            found = base64.b32encode(hashlib.sha1(body).digest()).decode()
            ok, declared = declared in (None, found), found
        elif kind == "metadata":
            fields = {k: v for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k}
            fields = {k: v.strip() for k, v in fields.items()}
        yield h["warc-record-id"], kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), declared, None if body is None else len(body), ok, fields, body if payload else None


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record (see RECORD) of all archives under `path`. payload=False leaves payloads out, but for their size and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                rows, size = [], 0
                for r in records(inflated(x.as_py()), payload):
                    rows.append(r)
                    size += len(r[-1] or b"")
                    if len(rows) >= 4096 or size > 16 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array([None if x is None else list(x.items()) for x in c], f.type) if f.name == "fields" else pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def assemble(found: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata. Records that are alike in all but place are as many captures."""
    keep = [c for c in found.columns if payload or c != "payload"]
    r = found.filter(F.col("type").isin("request", "response", "revisit", "metadata")).withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    rec = F.struct(*[F.col(c) for c in keep if c != "fields"], F.map_entries("fields").alias("fields"))  # maps have no order, entries do
    of = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), rec))
    g = r.groupBy("capture_id").agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"), F.sum(F.col("type").isin("response", "revisit").cast("int")).alias("n"))
    return g.withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1))))).drop("n")


def digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, all from the archives as read back."""
    spark = pages.sparkSession
    path = store.new_path(spark, "warc")
    write(pages, path)
    found = store.written(read(spark, path, payload=False), "warc-records")
    c = assemble(found, payload=False)
    page = F.filter("metadata.fields", lambda e: e.key == "page-id")[0].value
    c = c.select(page.try_cast("long").alias("page_id"), "capture_id", "response.*")
    c = c.select("page_id", "capture_id", "type", "refers_to", "payload_bytes", "payload_digest", "digest_ok")
    met = found.filter("type = 'metadata'").select("concurrent_to", F.filter(F.map_entries("fields"), lambda e: e.key == "page-id")[0].value.try_cast("long").alias("to_page"))
    seen = found.filter("type = 'response'").select(F.col("record_id"), "payload_bytes")
    asked = c.filter("type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()  # one row a target: a hot one isn't joined row by row
    to = asked.join(seen.groupBy("record_id").agg(F.max("payload_bytes").alias("to_bytes")), "record_id").join(met.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.max("to_page").alias("to_page")), "record_id")
    out = c.join(to.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "to_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("to_page").alias("refers_to"))


def _sql() -> str:
    digits = []
    for i in range(8):
        n = " + ".join(f"(instr('0123456789abcdef', substr(h, {5 * i + k + 1}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5))
        digits += [f"substr('{BASE32}', cast((({n}) >> {s}) & 31 as bigint) + 1, 1)" for s in (15, 10, 5, 0)]
    return f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
q as (select *, max(page_id) over (partition by h) as top from p)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, {" || ".join(digits)} as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id = top then null else top end as refers_to
from q"""


SQL = _sql()
