"""Benchmark decontamination in DataFrame operations only.

Words are lower-cased runs without white space; features are five-word shingles, or the whole item
where it is shorter. A window has as many words as the item it may hold. Where a shingle of the
benchmark occurs, the start that puts it on its first place in the item is an anchor. The best window of
an item starts on an anchor or between two that are at most (2 - similarity) times its shingles apart
(from outside them, a shift towards them loses no shared shingle; further apart, their windows share too
little), and the similarity times its shingles are the benchmark's. Windows are set at all such starts.
Equal windows are one row from then on. Each is SimHashed over its shingles with their counts as weights; the 64 bits are cut into RADIUS + 1 blocks, of which two fingerprints within the radius
share one. What shares a block and is within the radius is verified by exact weighted Jaccard:
the sum of smaller counts over the sum of larger ones.

Nulls: a null text has no words, a null item matches nothing; a null doc_id is reported as such.
Repeated rows and items are reported once a (doc_id, item_id). An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

WORDS = 5
SIMILARITY = 0.8
RADIUS = 22
#: Rows of benchmark shingles up to which they are broadcast (about 40 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


#: Starts on or between neighbouring `anchors` whose windows of m shingles hold `least` of the sorted places `ps`. Both arrays
#: of starts are built without overlaps, so they are as long as the stretches they cover. A window that holds the places i to
#: i + least - 1 starts between the last of them less m - 1 and the first.
_STARTS = """array_intersect(
    flatten(transform(anchors, (a, i) -> if(i > 0 and a - anchors[i - 1] <= {gap}, sequence(anchors[i - 1] + 1, a), array(a)))),
    flatten(transform(slice(ps, 1, greatest(0, size(ps) - least + 1)), (p, i) ->
        if(ps[i + least - 1] - m + 1 <= p, sequence(greatest(ps[i + least - 1] - m + 1, if(i > 0, ps[i - 1] + 1, ps[i + least - 1] - m + 1)), p), cast(array() as array<int>)))))"""


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingles_of(words: str, k: int) -> Column:
    """Hashes of all runs of k words; none for fewer words."""
    none = F.array().cast("array<bigint>")
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(none)


def simhash(hashes: str) -> Column:
    """Majority bits of a multiset of hashes."""
    ones = f"aggregate({hashes}, 0, (c, x) -> c + cast(shiftrightunsigned(x, b) & 1 as int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L))")


def block_keys(fp: str, blocks: int) -> Column:
    """(block, its bits) of a fingerprint cut into so many blocks."""
    out, at = [], 0
    for b in range(blocks):
        width = 64 // blocks + (b < 64 % blocks)
        out.append(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("bits")))
        at += width
    return F.array(*out)


def first_equal_block(x: Column, blocks: int) -> Column:
    """The lowest block without a set bit in x."""
    out, at, parts = None, 0, []
    for b in range(blocks):
        width = 64 // blocks + (b < 64 % blocks)
        parts.append(F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")) == 0)
        at += width
    for b in range(blocks):
        out = F.when(parts[b], b) if out is None else out.when(parts[b], b)
    return out


def weighted_jaccard(a: str, b: str) -> Column:
    count = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, item_id, similarity, start_word and n_words of the best window of each pair of a document
    and an item that it holds. docs: doc_id, text. benchmark: item_id, text."""
    best = _found(docs, benchmark, similarity, radius, words).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start_word"), "best.n_words")


def _found(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, th (the text's hash), item_id and best (similarity, back, n_words) of every window that holds an item."""
    blocks = radius + 1
    items = benchmark.select("item_id", words_of("text").alias("w")).filter("size(w) > 0")
    items = materialise(items.withColumn("k", F.least(F.size("w"), F.lit(words))).withColumn("len", F.size("w")), "items")
    sizes = sorted(r.k for r in items.select("k").distinct().collect())  # at most `words` of them
    found = None
    for k in sizes:
        own = items.filter(F.col("k") == k).withColumn("ih", shingles_of("w", k)).select("item_id", "len", "ih")
        places = own.select("item_id", "len", F.posexplode_outer("ih").alias("off", "h")).groupBy("item_id", "len", "h").agg(F.min("off").alias("off"))
        places = materialise(places.select("h", "len", "off").distinct(), "item-shingles")
        near = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
        named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
        # outer: the optimiser would else filter on the array's size and build it anew for each word;
        # rows of three numbers go through the explosion, not the text or its shingles
        shingled = named.select("th", words_of("text").alias("w")).select("th", shingles_of("w", k).alias("dh"))
        hits = shingled.select("th", F.posexplode_outer("dh").alias("pos", "h")).join(near, "h")
        hits = hits.groupBy("th", "len").agg(F.sort_array(F.collect_set("pos")).alias("ps"), F.sort_array(F.collect_set(F.expr("pos - off"))).alias("anchors"))
        begins = hits.withColumn("m", F.col("len") - (k - 1)).withColumn("least", F.ceil(F.lit(similarity) * F.col("m") - 1e-9).cast("int"))
        begins = begins.select("th", "len", F.explode_outer(F.expr(_STARTS.format(gap=f"{2 - similarity} * m + 1e-9"))).alias("at")).filter("at is not null")
        per_text = materialise(begins.groupBy("th").agg(F.collect_list(F.struct("at", "len")).alias("spots")), "spots")
        # a text costs its key and 8 bytes a spot
        many = per_text.agg(F.sum(F.size("spots") + F.lit(4))).first()[0] or 0
        few = F.broadcast(per_text) if many <= BROADCAST_ROWS else per_text
        held = named.join(few, "th").select("doc_id", "th", "spots", words_of("text").alias("w")).select("doc_id", "th", "spots", shingles_of("w", k).alias("dh"))
        begin = lambda s: F.greatest(F.lit(0), s["at"])
        end = lambda s: F.least(s["at"] + s["len"] - (k - 1), F.size("dh"))
        held = held.select("doc_id", "th", F.transform("spots", lambda s: F.struct(begin(s).alias("begin"), s["len"].alias("len"), F.slice("dh", begin(s) + 1, end(s) - begin(s)).alias("wh"))).alias("windows"))
        windows = held.select("doc_id", "th", F.inline_outer("windows"))
        windows = materialise(windows.withColumn("key", F.xxhash64("wh", F.size("wh"))), "windows")
        contents = windows.groupBy("len", "key").agg(F.first("wh").alias("wh"))
        contents = materialise(contents.withColumn("fp", simhash("wh")), "contents")
        marked = contents.select("len", "key", "wh", "fp", F.inline(block_keys("fp", blocks)))
        own = materialise(own.withColumn("ifp", simhash("ih")), "item-prints")
        against = own.select("item_id", "len", "ih", "ifp", F.inline(block_keys("ifp", blocks)))
        x = F.col("fp").bitwiseXOR(F.col("ifp"))
        pairs = marked.join(against, ["len", "block", "bits"]).filter((F.bit_count(x) <= radius) & (first_equal_block(x, blocks) == F.col("block")))
        same = pairs.select("len", "key", "item_id", F.size("wh").alias("n"), weighted_jaccard("wh", "ih").alias("similarity")).filter(F.col("similarity") >= similarity)
        at = windows.select("doc_id", "th", "begin", "len", "key").distinct()
        part = at.join(same, ["len", "key"]).select("doc_id", "th", "item_id", F.struct("similarity", (-F.col("begin")).alias("back"), (F.col("n") + (k - 1)).alias("n_words")).alias("best"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, th long, item_id long, best struct<similarity:double,back:int,n_words:int>")
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """docs without the rows whose text holds an item, whatever their doc_id. The hashes of such texts are broadcast up to
    BROADCAST_ROWS of them."""
    drop = materialise(_found(docs, benchmark, **limits).select(F.col("th").alias("_leaking_hash")).distinct(), "leaking")
    return docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, F.xxhash64("text") == F.col("_leaking_hash"), "left_anti").select(docs.columns)
