"""WARC archives: one gzip member per record, written per partition and read by byte ranges.

Reading needs no index. A task takes a byte range, looks for the gzip magic, checks each candidate by
decompressing its first bytes up to a WARC header, and owns the records that start inside the
range; the last one is read past the range's end. A record that spans several ranges is seen once.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortweave.llm.storage import cut, join_salted, open_fs, ranges, shared_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT = 4 << 20
LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int = 5) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode_record(data: bytes) -> dict:
    """Fields of one decompressed record, with its payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = lambda name: (lambda m: int(m[1]) if m and m[1] else None)(re.fullmatch(r"<urn:page:(-?\d*)>", fields.get(name, "")))
    return {"page_id": page("WARC-Record-ID"), "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"].split(":", 1)[1], "payload_bytes": length, "refers_to": page("WARC-Refers-To"), "payload": payload if fields["WARC-Type"] == "response" else None, "url": fields.get("WARC-Target-URI")}


class Ranges:
    """Buffered reads at any offset of a file."""

    def __init__(self, file, size: int, step: int = 1 << 20):
        self.file, self.size, self.step, self.base, self.buf = file, size, step, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        """Up to n bytes from pos; fewer only at the end of the file."""
        n = min(n, self.size - pos)
        if pos < self.base or pos + n > self.base + len(self.buf):
            self.base, self.buf = pos, self.file.read_at(min(max(n, self.step), self.size - pos), pos)
        return self.buf[pos - self.base : pos - self.base + n]


def find_magic(r: Ranges, pos: int, end: int) -> int:
    """Offset of the first gzip magic that starts in pos..end-1, or -1."""
    while pos < end:
        n = min(1 << 16, end - pos)
        i = r.at(pos, n + len(MAGIC) - 1).find(MAGIC)
        if i >= 0:
            return pos + i
        pos += n
    return -1


def read_member(r: Ranges, pos: int) -> tuple[bytes, int] | None:
    """The record whose gzip member starts at pos and where it ends; None when it is no WARC record."""
    unpack, out, at, checked = zlib.decompressobj(31), bytearray(), pos, False
    try:
        while not unpack.eof:
            raw = r.at(at, 1 << 13)
            if not raw:
                return None
            out += unpack.decompress(raw)
            at += len(raw)
            if not checked and (len(out) >= 7 or unpack.eof):
                if not out.startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    return bytes(out), at - len(unpack.unused_data)


def records(r: Ranges, start: int, end: int):
    """(offset, fields) of every record that starts in start..end-1."""
    pos = start
    while (pos := find_magic(r, pos, end)) >= 0:
        member = read_member(r, pos)
        if member is None:
            pos += 1
            continue
        yield pos, decode_record(member[0])
        pos = member[1]


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Add payload digest and refers_to: the smallest page_id with the same payload, where that is another page.

    The pages of one payload may be a third of the table, so the join on digests is a broadcast or salted; its
    other side has only the digests that repeat.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    firsts = rows.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    firsts = cut(firsts.where("first < last").select("digest", "first"), "warc-firsts")
    joined = join_salted(rows, firsts, ["digest"], ["page_id", "url"])
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def _writer(folder: str, date: str):
    def write(batches):
        context = TaskContext.get()
        fs, root = open_fs(folder)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, n, size = None, 0, 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                known = lambda x: None if x is None or x != x or x is pd.NA else int(x)
                raw = encode_record(known(r.page_id), r.url, r.payload.encode("utf-8", "surrogatepass"), r.digest, known(r.refers_to), date)
                out.write(raw)
                n, size = n + 1, size + len(raw)
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "bytes": [size], "records": [n]})

    return write


def write_warc(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> list[dict]:
    """Write the pages as archives, one per partition; returns file, bytes and records of each.

    A retried task writes a file of its own name and only the successful attempt's file is returned, one row per file.
    """
    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]
    made = with_revisits(pages).select(ids[0], "url", "payload", "digest", ids[1])
    return [r.asDict() for r in made.mapInPandas(_writer(folder, date), "file string, bytes long, records long").collect()]


_FIELDS = (("page_id", "long"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long"), ("url", "string"), ("file", "string"), ("offset", "long"))


def _reader(folder: str):
    def read(batches):
        import pyarrow as pa

        schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in _FIELDS])
        fs, root = open_fs(folder)
        for batch in batches:
            for s in batch.to_pylist():
                rows = []
                for at, x in records(Ranges(fs.open_input_file(f"{root}/{s['file']}"), s["bytes"]), s["start"], s["end"]):
                    payload = x["payload"]
                    digest = x["digest"] if payload is None else hashlib.sha256(payload).hexdigest()
                    if digest != x["digest"]:
                        raise ValueError(f"{s['file']}: payload of the record at {at} does not match its digest")
                    rows.append((x["page_id"], x["payload_bytes"], digest, x["type"], x["refers_to"], x["url"], s["file"], at))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read


def read_warc(spark: SparkSession, folder: str, files: list[dict], split: int = SPLIT) -> DataFrame:
    """All records of the archives, read by ranges of `split` bytes, with digests checked against the payloads."""
    splits = ranges(spark, [(f["file"], f["bytes"], f["bytes"]) for f in files], "file string, bytes long, size long", split)
    return splits.select("file", "bytes", "start", "end").mapInArrow(_reader(folder), ", ".join(f"{name} {kind}" for name, kind in _FIELDS))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as WARC in a new shared folder and read them back.

    A null html is an empty payload; a null page_id gives a response with a null id and is never referred to; rows that repeat
    the smallest page_id of a payload are all responses; an empty table gives no file and no row. Only
    page_id, url and html are read.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    return read_warc(spark, folder, write_warc(pages, folder))
