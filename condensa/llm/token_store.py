"""Token-id output: one concatenated id array, document boundaries as an Elias-Fano code.

A store is a Parquet table in the shared folder, one row a segment: `part` (range of doc_id),
`seq` (place in the part), `part_start` (ids before it in the part), `n_docs`, `n_tokens` and `blob`.
Spark's writer commits it, so any store that Spark reaches will do and lost executors cost only their
own tasks. A blob is little-endian:

    magic "CTS1" | u32 id width | u64 documents n | u64 ids u | u64 documents without id | u32 low bits l
    low halves of the n boundaries, l bits each, packed | upper halves in unary | every 64th one's place
    doc ids, i64 | ids

Boundary i (end of document i) is ((select1(i) - i) << l) | low(i); n * (2 + log2(u / n)) bits in all.

Nulls: a null text is empty and so only the end id; rows without doc_id come first. Repeated rows
are stored each; ties in doc_id follow a hash of the text. An empty table gives an empty store.
Other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, release
from .token_cache import SLICE_BYTES, encoder

_HEAD = struct.Struct("<4sIQQQI")
_SAMPLE = 64
SEGMENT_IDS = 1 << 22


def _pad8(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


class EliasFano:
    """A non-decreasing sequence in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        l = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        place = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
        upper[place] = 1
        pack = lambda b: np.packbits(b.ravel(), bitorder="little")
        return cls(n, l, pack(bits), pack(upper), place[::_SAMPLE].astype("<u8"))

    def all(self) -> np.ndarray:
        """Every value."""
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (low.astype(np.int64) << np.arange(self.low_bits)).sum(1, dtype=np.int64)
        return ((place - np.arange(self.n)) << self.low_bits) | low

    def select(self, i: int) -> int:
        """Value i, from the sampled place before it and the bytes after that."""
        begin = int(self.samples[i // _SAMPLE])
        left, at = i % _SAMPLE, begin // 8
        ones = np.unpackbits(self.high[at : at + 1], bitorder="little")
        ones[: begin % 8] = 0
        while ones.sum() <= left:
            left -= int(ones.sum())
            at += 1
            ones = np.unpackbits(self.high[at : at + 1], bitorder="little")
        place = at * 8 + int(np.flatnonzero(ones)[left])
        low = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return (place - i) << self.low_bits | low

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return struct.pack("<QQQ", *map(len, parts)) + b"".join(map(_pad8, parts))

    @classmethod
    def from_bytes(cls, n: int, low_bits: int, b: memoryview) -> tuple[EliasFano, int]:
        sizes, at, parts = struct.unpack_from("<QQQ", b), 24, []
        for size, kind in zip(sizes, ("u1", "u1", "<u8"), strict=True):
            parts.append(np.frombuffer(b, kind, size // np.dtype(kind).itemsize, at))
            at += size + -size % 8
        return cls(n, low_bits, *parts), at


def encode_segment(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A blob. doc_ids: nulls first. ends: ids up to the end of each document."""
    ef, nulls = EliasFano.of(ends), sum(d is None for d in doc_ids)
    head = _HEAD.pack(b"CTS1", ids.dtype.itemsize, len(doc_ids), len(ids), nulls, ef.low_bits)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return _pad8(head) + ef.to_bytes() + numbers.tobytes() + ids.tobytes()


def _views(blob: bytes):
    """(doc ids as numbers, how many of the first are null, Elias-Fano boundaries, id array) of a blob, as views of it."""
    magic, width, n, total, nulls, low_bits = _HEAD.unpack_from(blob)
    if magic != b"CTS1":
        raise ValueError("not a token segment")
    at = len(_pad8(bytes(_HEAD.size)))
    ef, used = EliasFano.from_bytes(n, low_bits, memoryview(blob)[at:])
    at += used
    return np.frombuffer(blob, "<i8", n, at), nulls, ef, np.frombuffer(blob, f"<u{width}", total, at + 8 * n)


def decode_segment(blob: bytes):
    """(doc ids, Elias-Fano boundaries, id array) of a blob; the id array is a view of it."""
    numbers, nulls, ef, ids = _views(blob)
    docs = numbers.tolist()
    docs[:nulls] = [None] * nulls
    return docs, ef, ids


def _segments(path: str, end_id: int, most: int):
    def run(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        docs, lens, flat, seq, before = [], [], [], 0, 0

        def blob():
            nonlocal docs, lens, flat, seq, before
            ends, ids = np.cumsum(np.concatenate(lens)), np.concatenate(flat)
            row = [[part], [seq], [before], [len(docs)], [len(ids)], [encode_segment(docs, ends, ids)]]
            before += len(ids)
            docs, lens, flat, seq = [], [], [], seq + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _ARROW, strict=True)], _NAMES)

        for batch in batches:
            text = batch.column(1)
            step = max(1, min(most // 256, int(len(text) * SLICE_BYTES / max(1, text.nbytes))))
            for i in range(0, len(text), step):
                ids, counts = enc.encode(text.slice(i, step))
                at = np.cumsum(counts)
                flat.append(np.insert(ids, at, end_id))
                lens.append(counts + 1)
                docs += batch.column(0).slice(i, step).to_pylist()
                if sum(map(len, flat)) >= most:
                    yield blob()
        if docs:
            yield blob()
        release()

    return run


_NAMES = ["part", "seq", "part_start", "n_docs", "n_tokens", "blob"]
_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_SCHEMA = "part int, seq int, part_start long, n_docs long, n_tokens long, blob binary"


def write_token_store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> str:
    """Write the ids of docs (doc_id, text), each followed by end_id, in ascending doc_id order; return
    the store's path. One shuffle, of the texts, by range of doc_id."""
    path = path or new_path(docs.sparkSession, "token-store")
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("p"))
        .repartitionByRange("doc_id", "h", "p")
        .sortWithinPartitions("doc_id", "h")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(_segments(tokenizer, end_id, segment_ids), _SCHEMA).write.option("compression", "zstd").parquet(path)
    return path


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit)
    per document, from the files. To the driver goes one sum a part, of which there are as many as
    the writer had shuffle partitions."""
    store = spark.read.schema(_SCHEMA).parquet(path)
    parts = sorted(store.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, rows = 0, []
    for r in parts:
        rows.append((r.part, base))
        base += r.n
    bases = spark.createDataFrame(rows, "part int, base long")

    def run(batches):
        for batch in batches:
            got = batch.to_pydict()
            for blob, base, part_start in zip(got["blob"], got["base"], got["part_start"], strict=True):
                docs, ef, ids = decode_segment(blob)
                ends = ef.all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = ids.astype("<u4")
                for i in range(0, len(docs), 1024):
                    own = [wide[a:b].tobytes() for a, b in zip(starts[i : i + 1024], ends[i : i + 1024], strict=True)]
                    cols = [pa.array(docs[i : i + 1024], pa.int64()), pa.array(starts[i : i + 1024] + base + part_start), pa.array((ends - starts)[i : i + 1024]), pa.array(own, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids"])

    joined = store.join(F.broadcast(bases), "part").select("blob", "base", "part_start")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def fetch_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every stored row of these documents. A segment is looked into by bisection, and a row's
    ends come from two selects, so no other boundary is decoded. An id that is not there gives no row."""
    wanted = np.unique(np.array(doc_ids, np.int64))

    def run(batches):
        for batch in batches:
            rows = []
            for blob in batch.column(0).to_pylist():
                numbers, nulls, ef, ids = _views(blob)
                for d in wanted.tolist():
                    lo, hi = (nulls + int(np.searchsorted(numbers[nulls:], d, side)) for side in ("left", "right"))
                    for i in range(lo, hi):
                        begin = ef.select(i - 1) if i else 0
                        rows.append((d, ids[begin : ef.select(i)].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "ids"])

    return spark.read.schema(_SCHEMA).parquet(path).select("blob").mapInArrow(run, "doc_id long, ids binary")
