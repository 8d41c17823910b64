"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A shard file is: 8 magic bytes; the ids of its documents, one after another, as
little-endian 16- or 32-bit integers; two Elias-Fano sequences (document ids and
document ends); a trailer that says where they lie. An Elias-Fano sequence of n
values below u keeps floor(log2(u/n)) low bits of each value packed, and the high
parts as a unary bit vector with the position of every 256th one, so that
select(i) reads a few bytes and no table of 64-bit offsets exists.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortweave.llm.rows import slices
from cohortweave.llm.storage import open_fs, ranges, shared_dir
from cohortweave.llm.tokens import library_encoder

MAGIC = b"CWTOKEF1"
SAMPLE = 256
BLOCK_DOCS = 4096


def ef_encode(x: np.ndarray, universe: int) -> tuple[dict, bytes]:
    """Head and bytes of the non-decreasing uint64 values x, all at most universe."""
    n = len(x)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    x = x.astype(np.uint64)
    shifts = np.arange(low, dtype=np.uint64)
    lows = np.packbits(((x[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if low else np.zeros(0, np.uint8)
    ones = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little")
    samples = ones[::SAMPLE].astype("<u4" if len(bits) < 1 << 32 else "<u8")
    head = {"n": n, "low": low, "lows": len(lows), "high": len(high), "samples": len(samples) * samples.itemsize, "wide": samples.itemsize == 8}
    return head, lows.tobytes() + high.tobytes() + samples.tobytes()


class EliasFano:
    """Random access into ef_encode's bytes, which read(offset, length) gives: a select fetches the bytes that it needs."""

    def __init__(self, head: dict, read: Callable[[int, int], bytes]):
        self.n, self.low, self.read = head["n"], head["low"], read
        self.high_at, self.samples_at = head["lows"], head["lows"] + head["high"]
        self.high = head["high"]
        self.sample = np.dtype("<u8" if head["wide"] else "<u4")
        self.samples = head["samples"] // self.sample.itemsize

    def _sampled(self, k: int) -> int:
        """Bit position of value k * SAMPLE, or the end."""
        if k >= self.samples:
            return 8 * self.high
        w = self.sample.itemsize
        return int(np.frombuffer(self.read(self.samples_at + k * w, w), self.sample)[0])

    def select(self, i: int, j: int) -> np.ndarray:
        """Values i..j-1, decoded from the sampled one at or before i."""
        if i >= j:
            return np.zeros(0, np.uint64)
        first = i // SAMPLE
        start, stop = self._sampled(first), self._sampled((j - 1) // SAMPLE + 1)
        a, b = start // 8, min(self.high, stop // 8 + 1)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.read(self.high_at + a, b - a), np.uint8), bitorder="little")) + 8 * a
        ones = ones[ones >= start][i - first * SAMPLE : j - first * SAMPLE]
        out = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            at, end = i * self.low // 8, (j * self.low + 7) // 8
            packed = np.unpackbits(np.frombuffer(self.read(at, end - at), np.uint8), bitorder="little")[i * self.low % 8 :][: (j - i) * self.low]
            out |= (packed.reshape(j - i, self.low).astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches):
        import pyarrow as pa

        encoder = library_encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = open_fs(folder)
        name, out = f"shard-{part:06d}-{attempt}.tok", None
        lengths: list[int] = []
        ids: list[int] = []
        nulls = 0
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(MAGIC)
            for a, b in slices(batch.column(1)):
                pieces = [raw + end for raw in encoder.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])]
                lengths += [len(p) // width for p in pieces]
                out.write(b"".join(pieces))
            known = [d for d in batch.column(0).to_pylist() if d is not None]
            ids += known
            nulls += batch.num_rows - len(known)
        if out is None:
            return
        ends = np.cumsum(np.array(lengths, np.int64)).astype(np.uint64)
        base = ids[0] if ids else 0
        shifted = np.array([d - base for d in ids], np.uint64)
        id_head, id_raw = ef_encode(shifted, int(shifted[-1]) if ids else 0)
        end_head, end_raw = ef_encode(ends, int(ends[-1]))
        head = json.dumps({"width": width, "n_docs": len(lengths), "n_tokens": int(ends[-1]), "nulls": nulls, "base": base, "ids": id_head, "ends": end_head, "ids_bytes": len(id_raw), "ends_bytes": len(end_raw)}).encode()
        out.write(id_raw + end_raw + head + struct.pack("<QQ", len(head), len(id_raw) + len(end_raw)) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(lengths)], "n_tokens": [int(ends[-1])]})

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> list[dict]:
    """Encode every text and write shard files in ascending doc_id order; the list of shards is the manifest.

    docs: columns doc_id and text; others are ignored. A null text is an empty one, a null
    doc_id comes first, repeated doc_ids stand in the order of a hash of their texts, an empty table gives no file, and a
    text may have any length. Documents are range-partitioned, a doc_id with very many rows over several ranges too, so
    a shard holds an unbroken run of the order. A retried task writes a
    file of its own name; the manifest names the file of the attempt that succeeded. It has a row for each shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__row"))
    dealt = rows.repartitionByRange("doc_id", "__hash", "__row").sortWithinPartitions("doc_id", "__hash", "text").select("doc_id", "text")
    rows = dealt.mapInArrow(_writer(folder, tokenizer, end_id), "part long, file string, n_docs long, n_tokens long").collect()
    shards, start, before = [], 0, 0
    for r in sorted(rows, key=lambda r: r["part"]):
        shards.append({**r.asDict(), "start": start, "doc_start": before})
        start, before = start + r["n_tokens"], before + r["n_docs"]
    return shards


class Shard:
    """A shard file opened for reading; only its trailer's head is read at once."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        head_len, ef_len, magic = struct.unpack("<QQ8s", self.file.read_at(24, size - 24))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.head = json.loads(self.file.read_at(head_len, size - 24 - head_len))
        at = size - 24 - head_len - ef_len
        self.ids = EliasFano(self.head["ids"], lambda offset, n: self.file.read_at(n, at + offset))
        self.ends = EliasFano(self.head["ends"], lambda offset, n: self.file.read_at(n, at + self.head["ids_bytes"] + offset))
        self.dtype = np.dtype("<u2") if self.head["width"] == 2 else np.dtype("<u4")

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Token offsets a..b inclusive: where documents a..b-1 start, and the end of the last."""
        before = [0] if a == 0 else self.ends.select(a - 1, a).tolist()
        return np.array(before + self.ends.select(a, b).tolist(), np.int64)

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        nulls = self.head["nulls"]
        known = self.ids.select(max(0, a - nulls), max(0, b - nulls)).tolist()
        return [None] * max(0, min(b, nulls) - a) + [x + self.head["base"] for x in known]

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids at token offsets a..b-1."""
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * w, len(MAGIC) + a * w), self.dtype)


def _reader(folder: str):
    def read(batches):
        import pyarrow as pa

        fs, root = open_fs(folder)
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(fs, f"{root}/{r['file']}")
                bounds = shard.bounds(r["a"], r["b"])
                rows: list[tuple[int, int]] = []
                for k in range(len(bounds) - 1):
                    lo, hi = int(bounds[k]), int(bounds[k + 1])
                    crc = 0
                    for x in range(lo, hi, 1 << 20):
                        crc = zlib.crc32(shard.tokens(x, min(hi, x + (1 << 20))).astype("<u4").tobytes(), crc)
                    rows.append((hi - lo, crc))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard.doc_ids(r["a"], r["b"]), pa.int64()),
                    "start": pa.array(r["start"] + bounds[:-1], pa.int64()),
                    "n_tokens": pa.array([x[0] for x in rows], pa.int64()),
                    "ids_crc32": pa.array([x[1] for x in rows], pa.int64()),
                    "file": pa.array([r["file"]] * len(rows), pa.string()),
                })

    return read


def read_token_files(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and the shard's file name."""
    plan = ranges(spark, [(s["file"], s["start"], s["n_docs"]) for s in shards], "file string, first long, size long", BLOCK_DOCS)
    plan = plan.select("file", F.col("start").alias("a"), F.col("end").alias("b"), F.col("first").alias("start"))
    return plan.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents as token files in a new shared folder and describe them from the files."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "token-files")
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    return read_token_files(spark, folder, write_token_files(docs, folder, tokenizer, end_id))
