"""Sharding by Karmarkar-Karp differencing: equal texts stay together, shards come near in bytes.

A partial partition holds one sum a shard. The two of largest spread are combined, the larger sums of
one with the smaller of the other, until one is left. Groups of equal texts are dealt into buckets by
a hash; each bucket differences its groups in blocks of BLOCK and folds each block's partial partition
into the bucket's, so memory is bounded whatever a bucket holds. The buckets' partial partitions (at
most MOST_BUCKETS, of one sum a shard) are combined in the same way on the driver.

Nulls: a null text counts as the empty one (size 1); a null doc_id is kept. Repeated rows are sharded
each, into their text's shard. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import blocks_of, materialise

BLOCK = 20_000
MOST_BUCKETS = 4096


def difference(partials: list[list[int]], k: int) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions (k sums each) into one. Gives its sums and, for each that was given,
    the final shard of each of its sums. Ties go by place, so the result depends on the order alone."""
    kids: list[tuple] = []
    heap = []
    for i, sums in enumerate(partials):
        order = sorted(range(k), key=lambda s: (-sums[s], s))
        kids.append((order,))
        heap.append((sums[order[-1]] - sums[order[0]], i, [sums[s] for s in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heap[0]
        both = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(k), key=lambda s: (-both[s], s))
        both = [both[s] for s in order]
        heapq.heapreplace(heap, (both[-1] - both[0], len(kids), both))
        kids.append((a, b, order))
    labels: list = [None] * len(kids)
    if kids:
        labels[-1] = list(range(k))
    for node in range(len(kids) - 1, len(partials) - 1, -1):
        a, b, order = kids[node]
        left, right = [0] * k, [0] * k
        for s, o in enumerate(order):
            left[o] = right[k - 1 - o] = labels[node][s]
        labels[a], labels[b] = left, right
    out = []
    for i in range(len(partials)):
        own = [0] * k
        for s, o in enumerate(kids[i][0]):
            own[o] = labels[i][s]
        out.append(own)
    return (heap[0][2] if heap else [0] * k), out


def _buckets(k: int, block: int):
    def run(batches):
        bucket, running = TaskContext.get().partitionId(), [0] * k
        keys, sizes = [], []

        def flush():
            nonlocal running, keys, sizes
            sums, labels = difference([[n] + [0] * (k - 1) for n in sizes], k)
            both, (old, new) = difference([running, sums], k)
            # the bucket's subsets keep their numbers: a block's subset goes where its partner is
            at = {shard: s for s, shard in enumerate(old)}
            to = [at[new[s]] for s in range(k)]
            running = [running[s] + sums[to.index(s)] for s in range(k)]
            cols = [pa.array(keys, pa.binary()), pa.array([bucket] * len(keys), pa.int32()), pa.array([to[own[0]] for own in labels], pa.int32()), pa.array(sizes, pa.int64())]
            keys, sizes = [], []
            return pa.RecordBatch.from_arrays(cols, ["key", "bucket", "subset", "bytes"])

        for batch in batches:
            for i in range(0, batch.num_rows, block):
                keys += batch.column(0).slice(i, block).to_pylist()
                sizes += batch.column(1).slice(i, block).to_pylist()
                if len(keys) >= block:
                    yield flush()
        if keys:
            yield flush()

    return run


def shard(docs: DataFrame, shards: int = 16, block: int = BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key")),
        "sizes",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    n = rows.count()
    buckets = blocks_of(n, block, most=MOST_BUCKETS)
    dealt = groups.repartition(buckets, "key").sortWithinPartitions("key")
    placed = materialise(dealt.mapInArrow(_buckets(shards, block), "key binary, bucket int, subset int, bytes long"), "subsets")
    sums: dict[int, list[int]] = {}
    for r in placed.groupBy("bucket", "subset").agg(F.sum("bytes").alias("bytes")).collect():
        sums.setdefault(r.bucket, [0] * shards)[r.subset] = r.bytes
    names = sorted(sums)
    labels = difference([sums[b] for b in names], shards)[1]
    where = [(b, s, own[s]) for b, own in zip(names, labels, strict=True) for s in range(shards)]
    to = F.broadcast(spark.createDataFrame(where, "bucket int, subset int, shard int"))
    blocks = blocks_of(n, block)
    sharded = rows.join(placed.join(to, ["bucket", "subset"]).select("key", "shard"), "key").drop("key")
    sharded = materialise(sharded.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", F.spark_partition_id()), F.lit(blocks))), "sharded")
    counts = sharded.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32"))
    return sharded.join(before, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + nth - 1).alias("slot"))
