"""Leak filter: documents that share a run of n tokens with an evaluation set.

Runs are hashed where the texts lie: each distinct token of a batch once, runs by a polynomial over the tokens' 64-bit hashes, whole
batches in numpy. What travels is the evaluation set's hashes, to every worker up to BROADCAST_SHINGLES of them; beyond, the documents' own
hashes go to a semi-join. Texts do not move.

Nulls: a null text has no run; a null key is reported as such. Repeated rows are reported once. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.functions.text import TOKEN

#: Evaluation runs up to which their hashes go to every worker (8 bytes each).
BROADCAST_SHINGLES = 2_000_000
_TOKEN, _BASE = regex.compile(TOKEN), np.uint64(0x9E3779B97F4A7C15)


def run_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of n tokens."""
    own = [_TOKEN.findall(t) for t in texts]
    lens = np.fromiter(map(len, own), np.int64, len(own))
    codes, names = pd.factorize(np.array([t for u in own for t in u], object)) if lens.sum() else (np.zeros(0, np.int64), np.zeros(0, object))
    h = pd.util.hash_array(np.asarray(names, object), categorize=False)[codes] if len(codes) else np.zeros(0, np.uint64)
    total = max(0, len(h) - n + 1)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out = out * _BASE + h[k : k + total]
    owner = np.repeat(np.arange(len(own)), lens)
    whole = owner[:total] == owner[n - 1 : n - 1 + total]
    return owner[:total][whole], out[whole].view(np.int64)


def shingle_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """key, h: a 64-bit hash of every run of n tokens; texts below n tokens have none."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                at, h = run_hashes(some.column(1).to_pylist(), n)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at)), pa.array(h)], [key, "h"])

    own = df.select(F.col(key).cast("long").alias(key), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    return own.mapInArrow(run, f"{key} long, h long")


def leaking_ids(docs: DataFrame, evaluation: DataFrame, n: int = 13, most: int = BROADCAST_SHINGLES) -> DataFrame:
    """Distinct doc_id of docs (doc_id, text) that share a run with evaluation (item_id, text). An evaluation set
    without any run is an error, not a clean result."""
    index = shingle_hashes(evaluation, "item_id", n).select("h").distinct().cache()
    size = index.count()
    if not size:
        raise ValueError("the evaluation set has no shingle")
    if size > most:
        return shingle_hashes(docs, "doc_id", n).join(index, "h", "left_semi").select("doc_id").distinct()
    known = docs.sparkSession.sparkContext.broadcast(np.sort(index.toPandas()["h"].to_numpy()))
    index.unpersist()

    def run(batches):
        table = known.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                at, h = run_hashes(some.column(1).to_pylist(), n)
                hit = table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(np.unique(at[hit])))], ["doc_id"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    return own.mapInArrow(run, "doc_id long").distinct()


def clean_documents(docs: DataFrame, evaluation: DataFrame, n: int = 13) -> DataFrame:
    """docs without those that leak."""
    return docs.join(leaking_ids(docs, evaluation, n), "doc_id", "left_anti")
