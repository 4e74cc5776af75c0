"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: payloads are grouped by SHA-1 and length in a partial aggregation that keeps the largest page id; each page joins its
group's id; a task writes its pages as records into files of bounded size.  Pages whose payload another page's response holds become
revisit records, which keep the full payload's digest and length in their headers.

Reading: files are cut into byte blocks at any place.  A task finds every position of its block at which a record could begin
(also those that are text inside a payload), reads the length there and emits the candidate's successor; within a block successors are
followed to the first one beyond it.  Pointer jumping over those links, from offset zero of each file, doubles the distance each
round and keeps what is reachable; a candidate inside a payload is never reached.  A last pass reads the records from each block's
verified entry.

Edge cases: null html is an empty payload; null page ids are written as such and read back as null; several rows with the
largest id of a group are all responses; repeated rows are separate records; an empty table has no files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, new_file, open_fs, shared_dir, ship, slices, stored

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
ID = "urn:page:"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One record: an HTTP response, or a revisit that repeats its headers without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'null' if page is None else page}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{ID}{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return MAGIC + "\r\n".join(head).encode() + END + block + END


def fields(head: bytes) -> dict[bytes, bytes]:
    """Header fields by lower-case name."""
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class Window:
    """Reads of a file by absolute offset, forwards, in large steps."""

    def __init__(self, f, size: int, step: int = 1 << 20):
        self.f, self.size, self.step, self.at, self.data = f, size, step, 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = min(n, self.size - start)
        if start < self.at or start + n > self.at + len(self.data):
            self.f.seek(start)
            self.at, self.data = start, self.f.read(max(n, min(self.step, self.size - start)))
        return self.data[start - self.at: start - self.at + n]

    def header(self, start: int) -> tuple[bytes, int] | None:
        """The header's bytes and the offset after its blank line."""
        n = 1024
        while True:
            data = self.get(start, n)
            end = data.find(END)
            if end >= 0:
                return data[:end], start + end + len(END)
            if start + n >= self.size:
                return None
            n *= 2

    def successor(self, start: int) -> int | None:
        """Offset of the next record if one starts here whose length and end marks hold."""
        if self.get(start, len(MAGIC)) != MAGIC or (h := self.header(start)) is None:
            return None
        length = fields(h[0]).get(b"content-length", b"")
        if not length.isdigit():
            return None
        end = h[1] + int(length)
        if end + len(END) > self.size:
            return None
        return end + len(END) if self.get(end, len(END)) == END else None


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 64 << 20):
    """Write all pages; returns one manifest row (path, size) per file."""
    spark = pages.sparkSession
    ship(spark)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload"))

    def squeeze(b: pa.RecordBatch) -> pa.RecordBatch:
        packed = [zlib.compress(x, 1) for x in b.column("payload").to_pylist()]
        return batch(page_id=b.column("page_id"), url=b.column("url"), packed=(packed, pa.binary()), sha=b.column("sha"), n=b.column("n"))

    groups = p.groupBy("sha", "n").agg(F.max("page_id").alias("lead")).select(F.col("sha").alias("_sha"), F.col("n").alias("_n"), "lead")
    # payloads travel compressed
    p = map_arrow(p, squeeze, "page_id long, url string, packed binary, sha binary, n int", rows=128)
    marked = p.join(groups, (F.col("sha") == F.col("_sha")) & (F.col("n") == F.col("_n")))
    revisit = (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("lead"))
    marked = marked.select("page_id", "url", "packed", "sha", "lead", revisit.alias("revisit"))

    def write(batches):
        fs, out, size = None, None, 0
        for whole in batches:
            for b in slices(whole, 128):
                for r in b.to_pylist():
                    if out is None:
                        fs, _ = open_fs(folder)
                        uri, path = new_file(folder, "pages.warc")
                        out, size = fs.open_output_stream(path), 0
                    x = record(r["page_id"], r["url"], zlib.decompress(r["packed"]), base32(r["sha"].hex()), r["lead"], r["revisit"])
                    out.write(x)
                    size += len(x)
                    if size >= file_bytes:
                        out.close()
                        yield batch(path=([uri], pa.string()), size=([size], pa.int64()))
                        out = None
        if out is not None:
            out.close()
            yield batch(path=([uri], pa.string()), size=([size], pa.int64()))

    return marked.mapInArrow(write, "path string, size long").collect()


def boundaries(files: DataFrame, block_bytes: int, tasks: int) -> DataFrame:
    """``path, size, off``: the verified entry of each block of each file (``files``: path, size)."""
    blocks = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long"))).alias("start"))
    blocks = blocks.repartition(tasks, "path", "start")

    def candidates(batches):
        for b in batches:
            for r in b.to_pylist():
                fs, path = open_fs(r["path"])
                stop = min(r["start"] + block_bytes, r["size"])
                with fs.open_input_file(path) as f:
                    f.seek(r["start"])
                    data = f.read(min(stop + len(MAGIC) - 1, r["size"]) - r["start"])
                    offs, k = [], data.find(MAGIC)
                    while k >= 0:
                        offs.append(r["start"] + k)
                        k = data.find(MAGIC, k + 1)
                    w = Window(f, r["size"])
                    exits: dict[int, int | None] = {}
                    nexts = [w.successor(o) for o in offs]
                for o, n in zip(reversed(offs), reversed(nexts)):  # later ones first: their exits are known
                    exits[o] = n if n is None or n >= stop else exits.get(n)
                rows = [(o, x) for o, x in exits.items() if x is not None]
                yield batch(path=([r["path"]] * len(rows), pa.string()), size=([r["size"]] * len(rows), pa.int64()),
                            off=([x[0] for x in rows], pa.int64()), exit=([x[1] for x in rows], pa.int64()))

    jump = stored(blocks.mapInArrow(candidates, "path string, size long, off long, exit long"), "warc-links")
    # a link counts only if it starts at a file's start or where another one ends
    ends = jump.select("path", F.col("exit").alias("off")).distinct()
    jump = jump.filter("off = 0").unionByName(jump.filter("off > 0").join(ends, ["path", "off"], "left_semi").select(*jump.columns))
    reach = jump.filter("off = 0").select("path", "size", "off")
    most = files.agg(F.max("size")).first()[0] or 0
    steps = 1
    while steps * block_bytes < most:  # a chain has no more links than the file has blocks
        onward = reach.join(jump.select("path", "off", "exit"), ["path", "off"]).filter("exit < size").select("path", "size", F.col("exit").alias("off"))
        reach = stored(reach.unionByName(onward).distinct(), "warc-reach")
        second = jump.select("path", F.col("off").alias("exit"), F.col("exit").alias("far"))
        jump = stored(jump.join(second, ["path", "exit"]).select("path", "size", "off", F.col("far").alias("exit")), "warc-links")
        steps *= 2
    return reach


def read_archives(spark: SparkSession, manifest, block_bytes: int = 4 << 20) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of every record."""
    ship(spark)
    files = spark.createDataFrame([(r["path"], r["size"]) for r in manifest], "path string, size long")
    # a task reads a few blocks; the rows that name them are too small for Spark to size tasks by
    tasks = min(50_000, 1 + sum(r["size"] for r in manifest) // (4 * block_bytes))
    entries = boundaries(files, block_bytes, tasks).repartition(tasks, "path", "off")

    def number(x: bytes) -> int | None:
        x = x.strip(b"<>")[len(ID):]
        return None if x == b"null" else int(x)

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                fs, path = open_fs(r["path"])
                stop = min((r["off"] // block_bytes + 1) * block_bytes, r["size"])
                with fs.open_input_file(path) as f:
                    w, at, rows, held = Window(f, r["size"], 4 << 20), r["off"], [], 0
                    while at < stop:
                        head, body = w.header(at)
                        h = fields(head)
                        n = int(h[b"content-length"])
                        block = w.get(body, n)
                        http, _, payload = block.partition(END)
                        size = int(fields(http)[b"content-length"])
                        digest = h[b"warc-payload-digest"].decode().removeprefix("sha1:")
                        kind = h[b"warc-type"].decode()
                        if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).hexdigest()) != digest):
                            raise ValueError(f"record at {at} of {r['path']} fails its digest")
                        refers = h.get(b"warc-refers-to")
                        rows.append((number(h[b"warc-record-id"]), h[b"warc-target-uri"].decode(), size, digest, kind, number(refers) if refers else None, payload))
                        held += len(payload)
                        at = body + n + len(END)
                        if held > 8 << 20 or at >= stop:
                            c = list(zip(*rows))
                            yield batch(page_id=(c[0], pa.int64()), url=(c[1], pa.string()), payload_bytes=(c[2], pa.int64()), payload_digest=(c[3], pa.string()),
                                        record_type=(c[4], pa.string()), refers_to=(c[5], pa.int64()), payload=(c[6], pa.binary()))
                            rows, held = [], 0

    return entries.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the pages and read the archives back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, folder or shared_dir(spark, "warc"), min_bytes))


def digests(read: DataFrame) -> DataFrame:
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HEX5 = "to_base(CAST('0x' || substr(h, {i}, 10) AS BIGINT), 32, 8)"
#: DuckDB: base32 from 40-bit pieces of the hex digest; the digits 0-9A-V of to_base become A-Z2-7.
SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS lead FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       translate({' || '.join(_HEX5.format(i=i) for i in (1, 11, 21, 31))}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM g
"""
