"""WARC archives: pages are written as response and revisit records, large ones in segments, and read back by segment reassembly.

Writing: equal payloads (same SHA-1 and length) are stored once, by the smallest page_id; the others become revisit
records. A response block is an HTTP message in chunked framing; blocks longer than SEGMENT bytes go on in continuation
records. Records are written by Spark's text sink with CRLF CRLF as line separator, so its commit protocol guards against
lost executors, any store works, and files hold at most RECORDS records of bounded size.

Reading: files are parsed as streams; segments are grouped by origin identifier, ordered by number, and checked against
the total length before the chunked framing is undone. Only segmented records are shuffled.

Defined results: null html is an empty payload; a null page_id is larger than any other; rows that repeat a page_id with
an equal payload are numbered, the first is the response; null urls give no target header; ``problem`` names what is
wrong with a record that can't be reassembled, and its payload is null (the query fails on one); an empty table gives no rows; columns
but page_id, url and html are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEGMENT, CHUNK, RECORDS, SALTS = 1 << 16, 1 << 13, 2000, 32
CRLF = "\r\n"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexes: Column) -> Column:
    """Base-32 text of a SHA-1 digest in hexadecimal: five hex digits are four letters."""

    def four(g):
        v = F.conv(F.substring(hexes, g * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_B32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def chunked(payload: Column, size: int = CHUNK) -> Column:
    """A binary column in chunked transfer framing."""
    n = F.octet_length(payload)
    part = lambda i: F.substring(payload, i * size + 1, F.lit(size))
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.concat(F.lower(F.hex(F.octet_length(part(i)))), F.lit(CRLF), part(i).cast("string"), F.lit(CRLF)))
    return F.concat(F.when(n > 0, F.array_join(parts, "")).otherwise(""), F.lit("0" + CRLF + CRLF))


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload, n_bytes, digest, number, record_type and refers_to."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("hex", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    counts = base.select("hex", "page_id").groupBy("hex", "page_id").agg(F.count(F.lit(1)).alias("m"))
    same = common.materialise(counts.groupBy("hex").agg(F.min("page_id").alias("first_id"), F.sum("m").alias("total"), F.max("m").alias("most")).where("total > 1"), "warc-equal")
    # a payload may be that of a third of all pages: its pages meet the group's row in SALTS places
    salted = same.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    x = base.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).join(salted, ["hex", "salt"], "left").drop("salt")
    once = x.where(F.coalesce("most", F.lit(1)) <= 1).withColumn("number", F.lit(1))
    # equal rows are one row with a count first, and are then dealt anew; only records that are stored whole keep the payload
    equal = x.where("most > 1").groupBy("hex", "page_id", "url", "n_bytes", "first_id", "total", "most").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("equal"))
    upto = F.sum("equal").over(Window.partitionBy("hex", "page_id").orderBy("url").rowsBetween(Window.unboundedPreceding, 0))
    many = equal.withColumn("upto", upto).withColumn("number", F.explode(F.sequence(F.expr("upto - equal + 1"), F.col("upto")))).withColumn("number", F.col("number").cast("int"))
    many = many.withColumn("payload", F.when((F.col("number") == 1) | (F.col("n_bytes") < min_bytes), F.col("payload"))).repartition("hex", "page_id", "number")
    x = once.unionByName(many.select(*once.columns))
    revisit = F.col("first_id").isNotNull() | (F.col("total") > 1)
    revisit = revisit & (F.col("n_bytes") >= min_bytes) & ~(F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("number") == 1))
    return x.withColumn("record_type", F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response")).withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("first_id"))).withColumn("digest", base32(F.col("hex")))


def _identifier(page_id: Column, digest: Column, number: Column) -> Column:
    return F.concat(F.lit("<urn:veilmap:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(":"), number.cast("string"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Write pages as WARC files below path."""
    x = plan_records(pages, min_bytes)
    own = _identifier(F.col("page_id"), F.col("digest"), F.col("number"))
    clean = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF))
    body = F.concat(head, F.lit("Transfer-Encoding: chunked" + CRLF * 2), chunked(F.col("payload")))
    short = F.concat(head, F.lit("Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    x = x.select("record_type", own.alias("own"), F.when(F.col("record_type") == "revisit", _identifier(F.col("refers_to"), F.col("digest"), F.lit(1))).alias("refers"), clean.alias("url"), "digest", F.when(F.col("record_type") == "revisit", short).otherwise(body).cast("binary").alias("block"))
    x = x.withColumn("total", F.octet_length("block")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("total") / segment)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    part = F.substring(F.col("block"), (F.col("k") - 1) * segment + 1, F.lit(segment))
    line = lambda name, value, when=None: F.coalesce(F.when(when, F.concat(F.lit(name + ": "), value, F.lit(CRLF))) if when is not None else F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))
    many, first = F.col("parts") > 1, F.col("k") == 1
    record = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, F.col("own")).otherwise(F.concat(F.expr("substring(own, 1, length(own) - 1)"), F.lit(":"), F.col("k").cast("string"), F.lit(">")))),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z" + CRLF),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        line("WARC-Refers-To", F.col("refers"), first),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), first & (F.col("record_type") == "revisit")),
        line("WARC-Segment-Number", F.col("k").cast("string"), many),
        line("WARC-Segment-Origin-ID", F.col("own"), many & ~first),
        line("WARC-Segment-Total-Length", F.col("total").cast("string"), many & (F.col("k") == F.col("parts"))),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        line("Content-Length", F.octet_length(part).cast("string")),
        F.lit(CRLF),
        part.cast("string"),
    )
    x.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def _inflate(content: bytes) -> Iterator[bytes]:
    """Parts of a file that may be gzip, in one member or many."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        d = zlib.decompressobj(31)
        data = content
        while data and not d.eof:
            yield d.decompress(data, 1 << 22)
            data = d.unconsumed_tail
        content = d.unused_data.lstrip(b"\0")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a file."""
    source, buf, at = _inflate(content), bytearray(), 0

    def fill(n: int) -> bool:
        nonlocal at
        while len(buf) - at < n:
            got = next(source, None)
            if got is None:
                return False
            del buf[:at]
            at = 0
            buf.extend(got)
        return True

    while True:
        while fill(1) and buf[at] in b"\r\n":
            at += 1
        end, want = -1, 1
        while end < 0 and fill(want):
            end = buf.find(b"\r\n\r\n", at)
            want = len(buf) - at + 1
        if end < 0:
            if len(buf) - at > 0:
                raise ValueError("a record is cut off")
            return
        lines = bytes(buf[at:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        size = end + 4 - at
        if not fill(size + n):
            raise ValueError("a record is cut off")
        yield headers, bytes(buf[at + size : at + size + n])
        at += size + n


_FIELDS = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-target-uri": "uri", "warc-refers-to": "refers", "warc-payload-digest": "digest"}
RECORD = "warc_type string, record_id string, uri string, refers string, digest string, segment int, origin string, total bigint, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files below path, segments as they stand."""
    common.prepare(spark)
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in RECORD.split(", "))])

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for h, block in parse(content.as_py()):
                    row = {v: h.get(k) for k, v in _FIELDS.items()}
                    seg = h.get("warc-segment-number")
                    row |= {"segment": int(seg) if seg else None, "origin": h.get("warc-segment-origin-id") or (h.get("warc-record-id") if seg else None), "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "block": block}
                    rows.append(row)
                    size += len(block)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def unchunk(body: bytes) -> bytes:
    """Undo chunked transfer framing (chunk extensions and trailers are passed over)."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(part)
        at = end + 4 + n


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """(payload, announced length) of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        return unchunk(body), None
    n = fields.get(b"content-length")
    return body, int(n) if n is not None else None


def assembled(parts: list[dict]) -> tuple[bytes | None, str | None]:
    """(block, problem) of one record's segments, in order of number."""
    numbers = [p["segment"] for p in parts]
    if len(parts) == 1 and numbers[0] is None:
        return parts[0]["block"], None
    if numbers != list(range(1, len(parts) + 1)):
        return None, "missing or repeated segment"
    total = parts[-1]["total"]
    if total is None:
        return None, "no last segment"
    if sum(len(p["block"]) for p in parts) != total:
        return None, "total length differs"
    return b"".join(p["block"] for p in parts), None


PAGE = "record_id string, warc_type string, uri string, refers string, digest string, payload binary, payload_bytes bigint, problem string"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record: record_id, warc_type, uri, refers, digest, payload, payload_bytes, problem.

    A revisit has the digest and length of the payload it refers to, and a null payload.
    """
    r = read_records(spark, path)
    kept = F.struct("segment", "total", "warc_type", "record_id", "uri", "refers", "digest", "block")
    alone = r.where("segment is null").select(F.array(kept).alias("parts"))
    joined = r.where("segment is not null").groupBy("origin").agg(F.array_sort(F.collect_list(kept)).alias("parts")).select("parts")
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in PAGE.split(", "))])

    def run(batches):
        for b in batches:
            rows = []
            for parts in b.column("parts"):
                parts = parts.as_py()
                first = parts[0]
                block, problem = assembled(parts)
                payload = n = None
                if block is not None:
                    try:
                        payload, said = payload_of(block)
                        n = said if first["warc_type"] == "revisit" else len(payload)
                        payload = None if first["warc_type"] == "revisit" else payload
                        digest = (first["digest"] or "").removeprefix("sha1:")
                        if payload is not None and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            payload, problem = None, "digest differs"
                    except ValueError as e:
                        payload, n, problem = None, None, str(e)
                rows.append({k: first[k] for k in ("record_id", "warc_type", "uri", "refers")} | {"digest": (first["digest"] or "").removeprefix("sha1:") or None, "payload": payload, "payload_bytes": n, "problem": problem})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return alone.unionByName(joined).mapInArrow(run, PAGE)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back, and return what they say."""
    path = f"{common.shared_dir(spark)}/veilmap-warc-{uuid.uuid4().hex}"
    write_archives(common.table(spark, sf_dir, "pages"), path)
    got = read_payloads(spark, path).drop("payload")
    lost = F.raise_error(F.concat(F.lit("record "), F.coalesce("record_id", F.lit("without id")), F.lit(": "), F.col("problem")))
    got = got.withColumn("payload_bytes", F.when(F.col("problem").isNull(), F.col("payload_bytes")).otherwise(lost.cast("long")))
    number = lambda c: F.regexp_extract(c, "^<urn:veilmap:page:(-?[0-9]+):", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return got.select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("warc_type").alias("record_type"), page("refers").alias("refers_to"))


OP9_SQL = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
d as (select *, min(page_id) over (partition by h) as first_id from p)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda g: {" || ".join(f"substr('{_B32}', cast((cast('0x' || substr(h, cast(g * 5 + 1 as int), 5) as int) >> {s}) & 31 as int) + 1, 1)" for s in (15, 10, 5, 0))}), 'string_agg', '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from d
"""
