"""Packing: first-fit decreasing with a tournament tree of bin capacities, in random groups.

Documents are tokenised where they lie, dealt into groups by a hash of the row, and each group packs
its documents by itself: full pieces of `capacity` ids take a sequence each, the rests go by descending
length into the first sequence with room, which a tree of maxima over the open sequences finds in
log(n) steps. A group has about GROUP_BYTES of text whatever the corpus, so the number of groups
grows with it and a task's memory does not.

Nulls: a null text is empty and so only the end id; a null doc_id is kept. Repeated rows are packed
each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks_of, release
from .token_cache import SLICE_BYTES, encoder

GROUP_BYTES = 24 << 20


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; sequences count from 0. Ties keep the given order."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    seq, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for piece, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        seq[piece], offset[piece] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node >>= 1
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return seq, offset


def _tokens(path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        tail = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            text = batch.column(1)
            step = max(1, int(len(text) * SLICE_BYTES / max(1, text.nbytes)))
            for i in range(0, len(text), step):
                ids, counts = enc.encode(text.slice(i, step))
                raw, ends = ids.tobytes(), np.cumsum(counts) * enc.dtype.itemsize
                begins = ends - counts * enc.dtype.itemsize
                own = [raw[a:b] + tail for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, step), pa.array(own, pa.binary())], ["doc_id", "ids"])
            release()

    return run


def _packed(path: str, capacity: int):
    def run(batches):
        width = encoder(path).dtype.itemsize
        docs, ids = [], []
        for batch in batches:
            docs += batch.column(0).to_pylist()
            ids += batch.column(1).to_pylist()
        if not docs:
            return
        order = sorted(range(len(docs)), key=lambda i: (docs[i] is not None, docs[i] or 0, ids[i]))
        docs, ids = [docs[i] for i in order], [ids[i] for i in order]
        total = np.array([len(x) // width for x in ids], np.int64)
        whole, rest = total // capacity, total % capacity
        own = np.flatnonzero(rest)
        seq, offset = first_fit_decreasing(rest[own], capacity)
        first = int(seq.max()) + 1 if len(seq) else 0  # sequences of full pieces follow those of rests
        of_doc = np.repeat(np.arange(len(docs)), whole)
        nth = np.arange(len(of_doc)) - np.repeat(np.cumsum(whole) - whole, whole)
        doc = np.concatenate([of_doc, own])
        start = np.concatenate([nth, whole[own]]) * capacity
        length = np.concatenate([np.full(len(of_doc), capacity), rest[own]])
        at = np.concatenate([np.zeros(len(of_doc), np.int64), offset])
        sid = np.concatenate([first + np.arange(len(of_doc)), seq]) + (TaskContext.get().partitionId() << 32)
        for i in range(0, len(doc), 512):
            d, s, n = doc[i : i + 512], start[i : i + 512], length[i : i + 512]
            cut = [np.frombuffer(ids[k], f"<u{width}", m, a * width).astype("<u4").tobytes() for k, a, m in zip(d.tolist(), s.tolist(), n.tolist(), strict=True)]
            cols = [pa.array([docs[k] for k in d.tolist()], pa.int64()), pa.array(s), pa.array(n), pa.array(cut, pa.binary()), pa.array(total[d]), pa.array(sid[i : i + 512]), pa.array(at[i : i + 512])]
            yield pa.RecordBatch.from_arrays(cols, _NAMES)
        del docs, ids
        release()

    return run


_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset. Only ids are shuffled, once."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16))).first()[0] or 0
    groups = blocks_of(size, group_bytes)
    tokens = own.mapInArrow(_tokens(tokenizer, end_id), "doc_id long, ids binary")
    dealt = tokens.repartition(groups, F.xxhash64("doc_id", "ids", F.spark_partition_id()))
    return dealt.mapInArrow(_packed(tokenizer, capacity), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
