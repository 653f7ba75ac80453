"""WARC archives by way of a chunked record table.

A payload becomes rows of record identifier and chunk number: slices of at most ``chunk_bytes``, each with
the SHA-1 of the payload up to its end. The JVM cuts them, where a payload is one value of one row; Python
sees one slice at a time and carries a running digest from each to the next. A payload of one chunk
becomes one WARC record; a longer one a segmented record, its first segment followed by ``continuation``
records, so no record is built, written or read whole. Reading gives the same table back: segments are
ordered within their record and one running digest checks every chunk and, at the last, the payload.

Archives are gzip files with one member per record, written by Spark's text sink with an empty gzip
member as the line separator, so commits, retries and any file system are Spark's own; the same separator
splits them again for reading. A record whose compressed form holds the separator is compressed otherwise.

Of records with equal payloads of at least ``least`` bytes the one with the largest id is written as a
response, the others as revisits that refer to it. Repeated digests are found by a grouped maximum over
digests alone and joined back: broadcast while there are at most ``max_broadcast`` of them (under 100
bytes each), which is counted first, else by shuffling, where Spark splits a hot one. No group meets in
one task. Record identifiers derive from page ids; pages that repeat an id get one of their own each, and
revisits of those name the page but no record.

Defined results: a null payload is empty; a null url is a urn of the page's id; a null id stays null and is
never referred to; rows that repeat the id referred to are all responses; an empty table gives no records; other
columns are not read. Ids are integers.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, table_path

_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 65_536
#: A gzip member of no bytes.
_EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "0000000000000000")
_TABLE = "page long, url string, kind string, refers long, bytes long, record string, refers_record string, copy string, chunk_no long, last boolean, data binary, sha1 string"
_FIELDS = [f.split()[0] for f in _TABLE.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[f.split()[1]] for f in _TABLE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=_FIELDS)


def record_id(page, copy: str = "") -> str:
    """The id of a page's record; ``copy`` tells the records of one page id apart."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:page:{page}:{copy}' if copy else f'urn:page:{page}').urn}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def _clean(url: str | None, page) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"


def _member(record: bytes) -> bytes:
    """``record`` as one gzip member that does not hold the separator: what cannot be compressed is stored as
    it is, so there a block ends within every separator."""
    for parts in ([record], re.split(b"(?<=%s)(?=%s)" % (re.escape(_EMPTY_MEMBER[:10]), re.escape(_EMPTY_MEMBER[10:])), record)):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        made = b"".join(packer.compress(p) + packer.flush(zlib.Z_FULL_FLUSH) for p in parts[:-1]) + packer.compress(parts[-1]) + packer.flush()
        if _EMPTY_MEMBER not in made:
            return made
    raise ValueError("a record that holds the separator however it is compressed")


def _counted(small: DataFrame, name: str, max_broadcast: int) -> DataFrame:
    """``small`` written out, and broadcast if it has few enough rows."""
    small, _ = materialize(small, name)
    return F.broadcast(small) if small.count() <= max_broadcast else small


def chunk_table(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, chunk_bytes: int = CHUNK, max_broadcast: int = 200_000) -> DataFrame:
    """(page, url, kind, refers, bytes, record, refers_record, copy, chunk_no, last, data, sha1): payloads in chunks.

    ``sha1`` is the hex digest up to the chunk's end; ``copy`` tells segmented records apart. Revisits
    have one empty chunk that carries their payload's digest.
    """
    arrow_rows(df.sparkSession)
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("data")
    ).withColumn("digest", F.unhex(F.sha1("data"))).withColumn("bytes", F.octet_length("data").cast("long"))
    facts, _ = materialize(rows.select("page", "digest", "bytes"), "digests")
    again = facts.groupBy("page").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("page").alias("p"))
    equal = facts.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("d")).agg(F.max("page").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    equal = equal.join(_counted(again, "again", max_broadcast), F.col("kept") == F.col("p"), "left").select("d", "kept", F.col("p").isNotNull().alias("kept_repeats"))
    mine = rows.join(_counted(equal, "repeated", max_broadcast), (F.col("digest") == F.col("d")) & (F.col("bytes") >= least), "left")
    mine = mine.withColumn("refers", F.when(F.col("kept") != F.col("page"), F.col("kept")))
    mine = mine.join(_counted(again, "again", max_broadcast), F.col("page").eqNullSafe(F.col("p")), "left").withColumn("repeats", F.col("p").isNotNull())
    chunks = F.when(F.col("refers").isNotNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("bytes") / chunk_bytes)).cast("int"))
    cut = mine.select(
        "page", "url", "refers", "kept_repeats", "repeats", "bytes", "digest", "data", chunks.alias("chunks"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("k")
    ).select(
        "page", "url", "refers", "kept_repeats", "repeats", "bytes", "digest", "chunks", "k",
        F.when(F.col("refers").isNotNull(), F.lit(b"")).otherwise(F.substring("data", F.col("k") * chunk_bytes + 1, F.lit(chunk_bytes))).alias("part"),
    )

    def run(batches):
        running = copy = None
        for batch in batches:
            out, size = [], 0
            for page, url, refers, kept_repeats, repeats, total, digest, chunks, k, part in zip(*(c.to_pylist() for c in batch.columns)):
                if k == 0:
                    running, copy = hashlib.sha1(), uuid.uuid4().hex
                running.update(part)
                to = record_id(refers) if refers is not None and not kept_repeats else None
                out.append((
                    page, url, "response" if refers is None else "revisit", refers, total, record_id(page, copy if repeats else ""), to, copy if chunks > 1 else None,
                    k, k == chunks - 1, part, running.hexdigest() if refers is None else digest.hex(),
                ))
                size += len(part)
                if size >= 1 << 22:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return cut.mapInArrow(run, _TABLE)


def write_archives(table: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a chunk table as compressed WARC files below ``path``, one per partition, one gzip member a record."""

    def run(batches):
        for batch in batches:
            out = []
            for page, url, kind, refers, total, record, to, copy, k, last, data, sha1 in zip(*(c.to_pylist() for c in batch.columns)):
                whole = copy is None
                block = data
                if k == 0:
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {total}\r\n\r\n".encode() + data
                coded = base64.b32encode(bytes.fromhex(sha1)).decode()
                head = _head([
                    ("WARC-Type", kind if k == 0 else "continuation"), ("WARC-Record-ID", record if k == 0 else f"<{uuid.uuid4().urn}>"), ("WARC-Target-URI", _clean(url, page)), ("WARC-Date", date),
                    ("WARC-Profile", _PROFILE if kind == "revisit" else None), ("WARC-Refers-To", to),
                    ("WARC-Payload-Digest", f"sha1:{coded}" if whole else None), ("WARC-Running-Digest", None if whole else f"sha1:{coded}"),
                    ("WARC-Segment-Number", None if whole else k + 1), ("WARC-Segment-Origin-ID", record if k else None),
                    ("WARC-Segment-Total-Length", total if last and not whole else None), ("WARC-Page", page), ("WARC-Refers-To-Page", refers),
                    ("WARC-Payload-Length", total if kind == "revisit" else None), ("WARC-Copy", copy),
                    ("Content-Type", "application/http; msgtype=response" if k == 0 else None), ("Content-Length", len(block)),
                ])
                out.append(_member(head + block + _END))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    values = table.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    values.write.mode("overwrite").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def _parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = raw.partition(_END)
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    if version != "WARC/1.1" or len(block) != length + len(_END) or not block.endswith(_END):
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: not a record of {length} bytes")
    return fields, block[:length]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of all WARC files below ``path``; digests of unsegmented records are checked."""
    arrow_rows(spark)
    text = spark.read.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path).select(F.col("value").cast("binary"))

    def run(batches):
        number = lambda f, k: int(f[k]) if k in f else None
        for batch in batches:
            out, size = [], 0
            for member in batch.column(0):
                member = member.as_py()
                if not member:
                    continue
                f, data = _parse(zlib.decompress(member, 31))
                k = int(f.get("WARC-Segment-Number", 1)) - 1
                if k == 0:
                    data = data.partition(_END)[2]
                named = f.get("WARC-Payload-Digest") or f["WARC-Running-Digest"]
                sha1 = base64.b32decode(named.removeprefix("sha1:")).hex()
                whole, kind = "WARC-Segment-Number" not in f, f["WARC-Type"]
                if whole and kind == "response" and hashlib.sha1(data).hexdigest() != sha1:
                    raise ValueError(f"record {f['WARC-Record-ID']}: its payload has another digest")
                total = number(f, "WARC-Payload-Length") if kind == "revisit" else len(data) if whole else number(f, "WARC-Segment-Total-Length")
                out.append((
                    number(f, "WARC-Page"), f["WARC-Target-URI"], "response" if kind == "continuation" else kind, number(f, "WARC-Refers-To-Page"), total,
                    f["WARC-Segment-Origin-ID"] if k else f["WARC-Record-ID"], f.get("WARC-Refers-To"), f.get("WARC-Copy"), k, whole or "WARC-Segment-Total-Length" in f, data, sha1,
                ))
                size += len(data)
                if size >= 1 << 22:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return text.mapInArrow(run, _TABLE)


def verify_records(table: DataFrame) -> DataFrame:
    """(page, kind, refers, bytes, sha1) of every record of a chunk table; segments are digested in order."""
    columns = ["page", "kind", "refers", "bytes", "sha1"]
    whole = table.where("copy IS NULL").select(*columns)

    def run(batches):
        held = running = None
        for batch in batches:
            out = []
            for page, bytes_, copy, k, last, data, sha1 in zip(*(c.to_pylist() for c in batch.columns)):
                if k == 0:
                    held, running, size = (copy, 0), hashlib.sha1(), 0
                elif held != (copy, k - 1):
                    raise ValueError(f"page {page}: segment {k + 1} without the one before")
                else:
                    held = (copy, k)
                running.update(data)
                size += len(data)
                if running.hexdigest() != sha1 or last and size != bytes_:
                    raise ValueError(f"page {page}: segment {k + 1} has another digest or length")
                if last:
                    out.append((page, "response", None, size, sha1))
                    held = None
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=columns)
        if held is not None:
            raise ValueError(f"record {held[0]} without its last segment")

    segments = table.where("copy IS NOT NULL").select("page", "bytes", "copy", "chunk_no", "last", "data", "sha1")
    segments = segments.repartition(F.col("copy")).sortWithinPartitions("copy", "chunk_no")
    return whole.unionByName(segments.mapInArrow(run, "page long, kind string, refers long, bytes long, sha1 string"))


def archive_pages(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, chunk_bytes: int = CHUNK) -> DataFrame:
    """Write ``df`` to archives in the shared folder and read them back: one row per record."""
    spark = df.sparkSession
    path = table_path(spark, "warc")
    write_archives(chunk_table(df, key, url, payload, least, chunk_bytes), path)
    records, _ = materialize(read_archives(spark, path).withColumn("data", F.when(F.col("copy").isNotNull(), F.col("data"))), "records")
    return verify_records(records).select(F.col("page").alias(key), F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))


def op6_warc(spark, sf_dir) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest
"""
