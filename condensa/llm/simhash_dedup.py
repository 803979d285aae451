"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most
three bits differ in at most one bit in one of the segments, so they share one of the 64 signatures
"segment s without its bit j". Distinct fingerprints are dealt by signature, equal signatures are
verified on the whole fingerprint, and links go through connected components. Equal fingerprints
never meet: they are one row before the join.

Within a signature all links are followed breadth-first from one member to those not yet reached,
which emits a spanning forest instead of all pairs; large groups are cut by their differing bits first.

Nulls: a null text has no words and the fingerprint zero; a null doc_id is kept and counts for no
minimum. Repeated rows and exact copies share a fingerprint and so a class. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialise, release

RADIUS = 3
SHINGLE = 3
#: Fingerprints of one signature that are compared without cutting them further.
DENSE = 2048
#: Above this many rows to drop, the anti join is not broadcast (16 bytes a row).
BROADCAST_ROWS = 1_000_000


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of a text's shingles, repeats included; unsigned."""
    from xxhash import xxh64_intdigest

    own = (text or "").encode().lower().split()
    if not own:
        return 0
    if len(own) <= words:
        return xxh64_intdigest(b" ".join(own), 42)
    grams = zip(*(own[i:] for i in range(words)), strict=False)
    h = np.fromiter((xxh64_intdigest(b" ".join(g), 42) for g in grams), "<u8", len(own) - words + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text, which with doc_id names a row), fp (the fingerprint's bits as a long)."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                fp = np.array([fingerprint(t.as_py()) for t in some.column(2)], np.uint64)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])
            release()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return own.mapInArrow(run, "doc_id long, th long, fp long")


def _differing(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def spanning_links(fps: np.ndarray, radius: int = RADIUS, dense: int = DENSE) -> list[tuple[int, int]]:
    """Links that connect whatever links within the radius connect among these distinct fingerprints.

    Up to `dense` of them, links are followed breadth-first. More are cut by the bits in which they differ at all: into radius + 1 sets,
    in one of which any two within the radius agree, so each set's groups of equal bits are linked by themselves, with
    fewer differing bits each time."""
    if len(fps) < 2:
        return []
    bits = fps.view(np.uint64)
    varying = int(np.bitwise_or.reduce(bits ^ bits[0]))
    if varying.bit_count() <= radius:
        return [(int(fps[0]), int(y)) for y in fps[1:]]
    out: list[tuple[int, int]] = []
    if len(fps) > dense:
        places = [b for b in range(64) if varying >> b & 1]
        for k in range(radius + 1):
            key = bits & np.uint64(sum(1 << b for b in places[k :: radius + 1]))
            order = np.argsort(key, kind="stable")
            own = key[order]
            for some in np.split(fps[order], np.flatnonzero(own[1:] != own[:-1]) + 1):
                out += spanning_links(some, radius, dense)
        return out
    rest = fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = _differing(rest, x) <= radius
            if near.any():
                found = rest[near]
                out += [(int(x), int(y)) for y in found]
                front += list(found)
                rest = rest[~near]
    return out


def _verify(radius: int):
    def links_in(key: np.ndarray, fp: np.ndarray):
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = np.append(begin[1:], len(key))
        pairs = begin[end - begin == 2]
        near = _differing(fp[pairs], fp[pairs + 1]) <= radius
        out = list(zip(fp[pairs][near].tolist(), fp[pairs + 1][near].tolist(), strict=True))
        more = end - begin > 2
        for i, j in zip(begin[more].tolist(), end[more].tolist(), strict=True):
            segment, bit = (int(key[i]) >> 37) & 1, (int(key[i]) >> 32) & 31
            own = fp[i:j]
            left_out = (own >> np.int64(32 * segment + bit)) & 1
            if bit and (left_out == left_out[0]).all():
                continue  # the segment is the same in all: they met at bit 0
            out += spanning_links(own, radius)
        return out

    def table(links):
        a, b = zip(*links, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            k, f = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(k):
                continue
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            last = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            if last and (links := links_in(key[:last], fp[:last])):
                yield table(links)
            key, fp = key[last:], fp[last:]
        if len(key) and (links := links_in(key, fp)):
            yield table(links)

    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links enough to connect what links of fp within the radius connect."""
    if radius != 3:
        raise ValueError("two segments and one wildcard guarantee radius 3")
    keys = []
    for segment in range(2):
        half = F.shiftrightunsigned("fp", 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(32):
            place = ((segment << 5) | bit) << 32
            keys.append(half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).bitwiseOR(F.lit(place)))
    signed = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    dealt = signed.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_verify(radius), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp, root, component_id of every row of docs (doc_id, text). root is the same in a class and in no other;
    component_id is the smallest doc_id that links reach."""
    fps = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(distinct))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = materialise(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "th", "fp", "root", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate class: that of the smallest doc_id, rows without one last; of rows that share it that of the
    smallest text hash, and of rows that share both the smallest by their other columns. A row is named by doc_id and text, so rows that
    share a doc_id and have different texts are documents of their own."""
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    found = materialise(near_duplicates(docs).groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n")), "near-duplicates")
    best = found.groupBy("root").agg(F.min(F.struct(name.alias("name"), "n")).alias("best"))
    rest = materialise(found.join(best, "root").filter(~name.eqNullSafe(F.col("best.name"))).select(F.col("doc_id").alias("_near_id"), F.col("th").alias("_near_hash")), "dropped")
    again = materialise(best.filter("best.n > 1").select(F.col("best.name.doc_id").alias("_near_id"), F.col("best.name.th").alias("_near_hash")), "repeated")
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_near_id")) & (F.xxhash64("text") == F.col("_near_hash"))
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    left = docs.join(few(rest), here, "left_anti").select(docs.columns)
    if again.isEmpty():
        return left
    alone, repeated = left.join(few(again), here, "left_anti"), left.join(few(again), here, "left_semi")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    once = repeated.groupBy("doc_id", F.xxhash64("text").alias("_near_hash")).agg(F.min(whole).alias("_near_row"))
    return alone.select(docs.columns).unionByName(once.select(*[F.col(f"_near_row.{c}").alias(c) for c in docs.columns]))
