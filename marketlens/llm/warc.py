"""WARC archives: a writer with revisit records and a salvage reader.

Writer: one gzip member per record, written by Spark's own text writer (its
commit protocol, any file system). Records with equal payloads of at least
``min_revisit`` bytes are stored once, as the response of the largest id; the
others are revisits that refer to it.

Reader: checks each member (gzip checksum, version line, header, length,
digests). After a failed check it searches for the next gzip member or version
line, goes on from there with the later records, and logs the bytes between as
a quarantined gap. Plain (uncompressed) archives are read as well.

Defined results: a null payload is empty; ids may be null (they sort lowest)
or repeated (every row is a record; all rows of the largest id of equal
payloads are responses); revisits carry digest and length of the full payload;
an empty archive has no records and no gaps; a file is one unit of work, and
the writer starts a new one after ``records_per_file`` records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER = b"\x1f\x8b\x08"
#: An empty gzip member; it ends in a zero byte, as do members of records under 16 MiB.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + bytes(8)
URN = "urn:marketlens:row:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
RECORD_SCHEMA = "kind string, file string, start long, stop long, reason string, record_type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary"


def _sha1(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def record_bytes(record_id, uri, payload: bytes, refers_to=None) -> bytes:
    """One record; a revisit if it refers to another."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if record_id is None else record_id}>", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def write(df: DataFrame, path: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_revisit: int = 1000, records_per_file: int = 10_000, salts: int = 16) -> None:
    """Write one record per row of ``df`` to new files under ``path``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    # groups of equal payloads: counted before any payload moves; a hot group is spread over the salts
    shared = rows.filter(F.col("size") >= min_revisit).groupBy("digest", "size").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = shared.select("digest", "size", "keep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    rows = rows.join(shared, ["digest", "size", "salt"], "left")
    rows = rows.select("id", "uri", "payload", F.when(~F.col("id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))

    def build(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([gzip_member(record_bytes(r["id"], r["uri"], r["payload"], r["refers_to"]))[:-1] for r in part], pa.binary())], names=["record"])

    members = rows.mapInArrow(build, "record binary")
    # the text writer puts back each member's last byte, a zero, as the line end
    members.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


def _parse(data, at: int) -> tuple[dict | None, int, str]:
    """The record that starts at ``at``: its fields, its end, or what failed."""
    if data[at:at + 10] not in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"):
        return None, at, "version"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None, at, "header"
    fields = {}
    for line in data[at + 10:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "header"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None, at, "length"
    stop = end + 4 + int(size)
    if data[stop:stop + 4] != b"\r\n\r\n":
        return None, at, "length"
    block = bytes(data[end + 4:stop])
    if (want := fields.get("warc-block-digest", "")).startswith("sha1:") and want != _sha1(block):
        return None, at, "block digest"
    head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    digest = fields.get("warc-payload-digest", "")
    out = {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id", "").strip("<>"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "uri": fields.get("warc-target-uri")}
    if out["record_type"] == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
        out |= {"payload": None, "payload_bytes": int(length[1]) if length else None}
    else:
        if digest.startswith("sha1:") and digest != _sha1(payload):
            return None, at, "payload digest"
        digest = digest or _sha1(payload)
        out |= {"payload": payload, "payload_bytes": len(payload)}
    try:
        out["payload_digest"] = _hex(digest) if digest else None
    except ValueError:
        return None, at, "payload digest"
    return out, stop + 4, ""


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive, in order, with their byte ranges."""
    at, bad, why, size = 0, -1, "", len(data)
    while at < size:
        found, stop, reason = [], at, ""
        if data[at:at + 3] == MEMBER:
            d = zlib.decompressobj(31)
            try:
                raw = d.decompress(memoryview(data)[at:])
                if d.eof:
                    stop, inner = size - len(d.unused_data), 0
                    while inner < len(raw) and not reason:
                        record, inner, reason = _parse(raw, inner)
                        if record:
                            found.append(record)
                else:
                    reason = "truncated member"
            except zlib.error:
                reason = "gzip"
        elif data[at:at + 2] == b"\r\n" and bad < 0:
            at += 2
            continue
        else:
            record, stop, reason = _parse(data, at)
            if record:
                found.append(record)
        if bad >= 0 and not reason:
            yield {"kind": "gap", "start": bad, "stop": at, "reason": why}
            bad = -1
        for record in found:
            yield record | {"kind": "record", "start": at, "stop": stop}
        if not reason:
            at = stop
            continue
        if bad < 0:
            bad, why = at, reason
        nxt = _NEXT.search(data, at + 1)
        at = nxt.start() if nxt else size
    if bad >= 0:
        yield {"kind": "gap", "start": bad, "stop": size, "reason": why}


def read(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` of all archive files under ``path``."""
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD_SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                name, content, rows, held = b.column(0)[i].as_py(), b.column(1)[i].as_py(), [], 0
                for row in salvage(content):
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row | {"file": name})
                    held += len(row.get("payload") or b"")
                    if len(rows) >= 2000 or held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, RECORD_SCHEMA)
