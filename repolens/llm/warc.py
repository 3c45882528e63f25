"""Operator 5: WARC archives: writing with revisit records and segmented payloads, reading back with reassembly.

Writing: each page is an HTTP response record; a payload that an earlier record of the archive holds is a revisit
record; a payload over `segment_bytes` is split into a response record and continuation records (WARC-Segment-Number,
WARC-Segment-Origin-ID, and WARC-Segment-Total-Length on the last). Payloads that are split go out in HTTP chunked
transfer framing. Archives are written by Spark's own writer, so any store that Spark writes to will do.

Reading: archives are split into records by Content-Length, never by searching for a marker in content; continuation
records are grouped by origin, ordered by segment number, joined and held against the total length; then chunked
framing is decoded, and the payload held against its digest.

Defined cases: null payload is empty; payloads under `least_revisit` bytes are all responses; among equal payloads the
largest id is the response; ties (rows with equal id and payload) are all responses if that id is the response's,
and each is read back whole;
a record whose segments are incomplete, out of length or of a wrong digest gives problem text and no payload; a record
cut short by the end of its file, or bytes that are no record, give one row with problem text (of type `damaged` if no
header can be read), and the rest of that file is not read; an
empty table gives no archive records; extra columns are ignored. A record without an id is
named by its digest and read back with a null id; it revisits the largest id of its payload, if there is one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path, table

LEAST_REVISIT = 1000
SEGMENT_BYTES = 32_768
CHUNK_CHARS = 8_192
#: Pages of one archive file at most; with segment_bytes and payload sizes this bounds what a reader holds.
FILE_RECORDS = 500
_CRLF = "\r\n"


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """id, url, payload -> also payload_bytes, payload_digest, refers_to (null for responses)."""
    p = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.encode("payload", "UTF-8"))})
    large = F.col("payload_bytes") >= least
    # digests meet in short rows; payloads travel by id and digest, so a very common page is no hot key
    short = materialise(p.where(large).select(F.col("id").alias("id_"), F.col("payload_digest").alias("digest_")).distinct(), "warc-digests")
    first = short.groupBy("digest_").agg(F.max("id_").alias("origin_"), F.count(F.lit(1)).alias("copies_")).where("copies_ > 1")
    again = short.join(first, "digest_").where(~F.col("origin_").eqNullSafe(F.col("id_"))).drop("copies_")
    p = p.join(again, large & (F.col("payload_digest") == F.col("digest_")) & F.col("id").eqNullSafe(F.col("id_")), "left")
    return p.withColumnRenamed("origin_", "refers_to").drop("digest_", "id_")


def _record(kind: Column, fields: list[Column], block: Column) -> Column:
    head = F.concat_ws(_CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), *fields, F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    # the line separator of the writer is the second of the two line ends that close a record
    return F.concat(head, F.lit(_CRLF * 2), block, F.lit(_CRLF))


def record_id(id_: Column, segment: Column | None = None) -> Column:
    tail = F.lit("") if segment is None else F.concat(F.lit(":"), segment)
    return F.concat(F.lit("<urn:page:"), id_, tail, F.lit(">"))


def records(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row a record: value (text of the record). pages as from revisits(). A segment holds as many code points as
    surely fit segment_bytes, so no code point is cut."""
    step = max(1, segment_bytes // 4)
    own = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("none-"), F.col("payload_digest")))
    date = F.lit("WARC-Date: 2024-01-01T00:00:00Z")
    target = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"\s", "%20"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"))
    kind = F.lit("Content-Type: application/http; msgtype=response")
    http = lambda framing: F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"), framing, F.lit(_CRLF * 2))
    plain = http(F.concat(F.lit("Content-Length: "), F.col("payload_bytes")))
    split = F.col("refers_to").isNull() & (F.col("payload_bytes") > segment_bytes)
    p = pages.withColumn("split_", split)
    revisit = _record(
        F.lit("revisit"),
        [F.concat(F.lit("WARC-Record-ID: "), record_id(own)), date, target, digest, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), kind],
        plain,
    )
    whole = _record(F.lit("response"), [F.concat(F.lit("WARC-Record-ID: "), record_id(own)), date, target, digest, kind], F.concat(plain, F.col("payload")))
    single = p.select(F.when(~F.col("split_"), F.when(F.col("refers_to").isNotNull(), revisit).otherwise(whole)).alias("value"), "*")
    # chunked framing over the whole payload, then cut
    n = F.length("payload")
    chunk = lambda i: F.substring(F.col("payload"), (i * CHUNK_CHARS + 1).cast("int"), F.lit(CHUNK_CHARS))
    framed = F.concat(
        http(F.lit("Transfer-Encoding: chunked")),
        F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK_CHARS).cast("int")), lambda i: F.concat(F.lower(F.hex(F.octet_length(chunk(i)).cast("bigint"))), F.lit(_CRLF), chunk(i), F.lit(_CRLF))), ""),
        F.lit(f"0{_CRLF}{_CRLF}"),
    )
    large = single.where("split_").withColumn("framed_", framed).withColumn("last_", F.floor((F.length("framed_") - 1) / step).cast("int"))
    large = large.select("*", F.explode(F.sequence(F.lit(0), F.col("last_"))).alias("at_"))
    block = F.substring(F.col("framed_"), F.col("at_") * step + 1, F.lit(step))
    number = F.concat(F.lit("WARC-Segment-Number: "), F.col("at_") + 1)
    ends = F.when(F.col("at_") == F.col("last_"), F.concat(F.lit("WARC-Segment-Total-Length: "), F.octet_length("framed_")))
    origin = _record(F.lit("response"), [F.concat(F.lit("WARC-Record-ID: "), record_id(own)), date, target, digest, number, kind], block)
    rest = _record(F.lit("continuation"), [F.concat(F.lit("WARC-Record-ID: "), record_id(own, F.col("at_") + 1)), date, target, F.concat(F.lit("WARC-Segment-Origin-ID: "), record_id(own)), number, ends], block)
    # a payload split into one segment only ends in its origin record, which then bears the total itself
    origin_only = _record(F.lit("response"), [F.concat(F.lit("WARC-Record-ID: "), record_id(own)), date, target, digest, number, ends, kind], block)
    large = large.select(F.when(F.col("at_") > 0, rest).when(F.col("last_") == 0, origin_only).otherwise(origin).alias("value"))
    return single.where(~F.col("split_")).select("value").unionByName(large)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, compression: str = "gzip") -> None:
    """pages: id, url, payload (not null). Writes text archives (gzip) below path."""
    out = records(revisits(pages), segment_bytes)
    out.write.option("lineSep", _CRLF).option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes):
    """(headers, block, problem) of each record of an uncompressed archive. The first record that can't be read whole
    has a problem, and is the last."""
    at, n = 0, len(data)
    while at < n:
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(_CRLF) if end >= 0 else [""]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines[0].startswith("WARC/") or not headers.get("content-length", "").isdigit() or not {"warc-record-id", "warc-type"} <= headers.keys():
            yield {}, b"", f"no record at byte {at}"
            return
        start = end + 4
        stop = start + int(headers["content-length"])
        if stop > n:
            yield headers, b"", f"cut short: {n - start} of {stop - start} bytes"
            return
        yield headers, data[start:stop], None
        at = stop + 4


def unpacked(data: bytes) -> tuple[bytes, str | None]:
    """A file's bytes without gzip, member by member; with a problem, the bytes before it."""
    import zlib

    out, rest = [], data
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(rest))
        except zlib.error as bad:
            return b"".join(out), f"gzip: {bad}"
        if not member.eof:
            return b"".join(out), "gzip: cut short"
        rest = member.unused_data
    return (b"".join(out), None if not rest.strip(b"\0") else "gzip: no member") if out else (data, None)


def body_of(block: bytes) -> bytes:
    """The payload of an HTTP message, without transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("bad chunk")
        at = end + 4 + size


_READ = "id string, type string, refers_to string, digest string, origin string, number int, total long, bytes long, sha1 string, block binary, problem string"


def _read(batches):
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = pa.schema([("id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string()), ("block", pa.binary()), ("problem", pa.string())])
    for batch in batches:
        for content in batch.column("content"):
            data, broken = unpacked(content.as_py())
            rows, held = [], 0
            for h, block, problem in [*parse(data), *([({}, b"", broken)] if broken else [])]:
                row = dict.fromkeys(names)
                row |= {"id": h.get("warc-record-id"), "type": h.get("warc-type", "damaged"), "refers_to": h.get("warc-refers-to"), "digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "origin": h.get("warc-segment-origin-id"), "number": _number(h, "warc-segment-number"), "total": _number(h, "warc-segment-total-length")}
                if problem:
                    row |= {"number": None, "problem": problem}
                elif row["number"] is not None:
                    row["block"] = block
                elif row["type"] == "response":
                    row |= _checked(block, row["digest"])
                rows.append(row)
                held += len(row["block"] or b"")
                if held > 1 << 24 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def _number(headers: dict, name: str) -> int | None:
    return int(headers[name]) if headers.get(name, "").isdigit() else None


def _checked(block: bytes, digest: str | None) -> dict:
    try:
        body = body_of(block)
    except ValueError as bad:
        return {"problem": f"framing: {bad}"}
    sha1 = hashlib.sha1(body).hexdigest()
    return {"bytes": len(body), "sha1": sha1, "block": body, "problem": None if digest in (None, sha1) else "digest"}


def _rejoin(batches):
    kinds = pa.schema([("id", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("sha1", pa.string()), ("block", pa.binary()), ("problem", pa.string())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            parts = sorted(r["parts"], key=lambda x: (x["number"], x["block"]))
            copies = sum(x["number"] == 1 for x in parts)
            if copies > 1 and all(x == parts[i - i % copies] for i, x in enumerate(parts)):
                parts = parts[::copies]  # repeated rows wrote equal segments
            else:
                copies = 1
            block = b"".join(x["block"] for x in parts)
            row = dict.fromkeys(kinds.names) | {"id": r["id"], "digest": r["digest"]}
            if [x["number"] for x in parts] != list(range(1, len(parts) + 1)) or r["total"] is None:
                row["problem"] = "segments are missing or repeated"
            elif len(block) != r["total"]:
                row["problem"] = f"segments hold {len(block)} of {r['total']} bytes"
            else:
                row |= _checked(block, r["digest"])
            out += [row] * copies
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """id, type (response or revisit), refers_to, digest, bytes, sha1, payload (binary; null for revisits), problem."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_read, _READ)
    drop = [] if payload else ["block"]
    whole = raw.where("number IS NULL").select("id", "type", "refers_to", "digest", "bytes", "sha1", "block", "problem").drop(*drop)
    # segments of one record meet by its origin; a record's length bounds the group
    parts = raw.where("number IS NOT NULL").groupBy(F.coalesce("origin", "id").alias("id")).agg(F.max("digest").alias("digest"), F.max("total").alias("total"), F.collect_list(F.struct("number", "block")).alias("parts"))
    joined = parts.mapInArrow(_rejoin, "id string, digest string, bytes long, sha1 string, block binary, problem string").select("id", F.lit("response").alias("type"), F.lit(None).cast("string").alias("refers_to"), "digest", "bytes", "sha1", "block", "problem").drop(*drop)
    out = whole.unionByName(joined)
    return out.withColumnRenamed("block", "payload") if payload else out


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    path = new_path(spark, "warc")
    write_archives(pages, path)
    back = read_archives(spark, path, payload=False)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    back = back.select(page(F.col("id")).alias("page_id"), "type", page(F.col("refers_to")).alias("refers_to"), "digest", "bytes", "sha1", "problem")
    back = materialise(back, "warc-index")  # a short row a record; the archives are parsed once
    # a revisit's length and digest are those of the record it refers to
    held = back.where("type = 'response'").select(F.col("page_id").alias("held_"), F.col("bytes").alias("held_bytes"), F.col("sha1").alias("held_sha1")).dropDuplicates(["held_"])
    again = back.where("type = 'revisit'").join(held, F.col("refers_to") == F.col("held_"), "left")
    again = again.select("page_id", F.col("held_bytes").alias("payload_bytes"), F.col("held_sha1").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to", F.when(F.col("held_sha1").eqNullSafe(F.col("digest")), F.lit(None).cast("string")).otherwise("digest").alias("problem"))
    first = back.where("type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.lit("response").alias("record_type"), "refers_to", "problem")
    return first.unionByName(again)


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS origin FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND origin IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND origin IS DISTINCT FROM page_id THEN origin END AS refers_to,
  CAST(NULL AS VARCHAR) AS problem
FROM m
"""
