"""Diagnosis of kept masks: broken words, chance, recovery, retention, and the cells of a report.

Long form: one row a word, (doc, word, n: its syllables, kept: how many stay, kind, tier). Counts are sums of conditions, so
they are combined before the shuffle and merge over corpora. Undefined ratios are null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from condensa.functions.text import normalized

#: Vowels before which the onset of a syllable ends.
VOWELS = "aăâeêioôơuưyáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
#: Families of method names by prefix, in the order in which they are tried, and in that of reports.
FAMILIES = (
    (("llmlingua2vi", "lexprior"), "learned, Vietnamese labels"),
    (("llmlingua2", "translate_llmlingua2"), "learned, English labels"),
    (("llmlingua", "longllmlingua", "selective_context", "ppl_sent"), "perplexity / LM"),
    (("random", "lead", "truncation", "stopword", "lexical", "tfidf_sent", "probe_negation"), "deterministic"),
)
REPORT_ORDER = ("learned, English labels", "learned, Vietnamese labels", "perplexity / LM", "deterministic", "other")
MOST_WORDS, AROUND = 50, 100


def onset(syllable: Column) -> Column:
    return F.regexp_extract(F.lower(syllable), f"^([^{VOWELS}]*)", 1)


def word_type(text: Column, pos: Column, ner: Column) -> Column:
    """name, reduplicative (two syllables with the same onset, which is not empty) or other."""
    s = F.split(text, " ")
    twin = (F.size(s) == 2) & (onset(F.get(s, F.lit(0))) != "") & (onset(F.get(s, F.lit(0))) == onset(F.get(s, F.lit(1))))
    return F.when((F.coalesce(ner, F.lit("O")) != "O") | (F.coalesce(pos, F.lit("")) == "Np"), "name").when(twin, "reduplicative").otherwise("other")


def family(method: Column, learned: tuple[str, ...] = ()) -> Column:
    """Family of a method by its name. learned: prefixes of one's own systems that learn from labels."""
    out = F.lit("other")
    for prefixes, name in reversed(((learned, FAMILIES[0][1]), *FAMILIES) if learned else FAMILIES):
        out = F.when(F.regexp_like(method, F.lit(f"^({'|'.join(prefixes)})")), name).otherwise(out)
    return out


def family_order(name: Column) -> Column:
    return F.array_position(F.lit(list(REPORT_ORDER)), name)


def seed_of(method: Column) -> tuple[Column, Column]:
    """(base name, seed or null) of a name that may end in _s and digits."""
    seed = F.regexp_extract(method, r"^(?s:.+)_s(\d+)$", 1)
    return F.when(seed != "", F.regexp_replace(method, r"_s\d+$", "")).otherwise(method), F.nullif(seed, F.lit("")).cast("int")


def grid_options(method: Column) -> Column:
    """mode, tiers, delta, alpha, cost of the names of a grid; null where a name does not say."""
    part = lambda pattern: F.nullif(F.regexp_extract(method, pattern, 1), F.lit(""))
    number = lambda c: F.replace(c, F.lit("p"), F.lit(".")).cast("double")
    return F.struct(part(r"_pi_(soft|hard)_").alias("mode"), part(r"_pi_(?:soft|hard)_([A-Z0-9]+)_d").alias("tiers"), number(part(r"_d(\d+p?\d*)_s\d+$")).alias("delta"), number(part(r"_h3_a(\d+p?\d*)_")).alias("alpha"), part(r"_h3_a\d+p?\d*_c([a-z]+)").alias("cost"))


@F.pandas_udf(ArrayType(IntegerType()))
def kept_syllables(sizes: pd.Series, mask: pd.Series) -> pd.Series:
    """Per word, how many of its syllables a mask over all syllables keeps. A null mask or no words gives no counts."""

    def one(n, m):
        if n is None or m is None or not len(n):
            return np.zeros(0, np.int32)
        upto, ends = np.concatenate([[0], np.cumsum(m)]), np.cumsum(n)
        return (upto[ends] - upto[ends - n]).astype(np.int32)

    return pd.Series([one(n, m) for n, m in zip(sizes, mask, strict=True)])


def sizes(words: str) -> Column:
    """array<int>: syllables a word."""
    return F.transform(words, lambda w: F.size(F.split(w["text"], " ")))


def word_rows(docs: DataFrame, words: str, kept: str, tiers: str | None = None) -> DataFrame:
    """Long form of docs with a column of words and one of their kept syllables (see kept_syllables): the other columns, word (its
    place), n, kept, punct, kind, tier. Row-local."""
    keep = [c for c in docs.columns if c not in (words, kept, tiers)]
    zipped = F.arrays_zip(F.col(words).alias("w"), sizes(words).alias("n"), F.col(kept).alias("k"), *([F.col(tiers).alias("t")] if tiers else []))
    own = docs.select(*keep, F.posexplode_outer(zipped).alias("word", "x")).filter("word is not null")
    text, pos, ner = (F.col(f"x.w.{c}") for c in ("text", "pos", "ner"))
    return own.select(*keep, "word", F.col("x.n").alias("n"), F.col("x.k").alias("kept"), text.rlike(r"^\p{P}*$").alias("punct"), word_type(text, pos, ner).alias("kind"), (F.col("x.t") if tiers else F.lit(None).cast("string")).alias("tier"))


_BROKEN = "n > 1 and kept > 0 and kept < n and not punct"
_WHOLE = "n > 1 and kept = n and not punct"


def _sum_if(condition: str) -> Column:
    return F.sum(F.expr(f"cast({condition} as long)"))


def cbr(words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, kind ("all" as well), n_partial, n_full, cbr: of the words of several syllables with a kept one, those not kept in full."""
    some = words.filter(f"({_BROKEN}) or ({_WHOLE})").withColumn("kind", F.explode(F.array(F.lit("all"), F.col("kind"))))
    own = some.groupBy(*(by or []), "kind").agg(_sum_if(_BROKEN).alias("n_partial"), _sum_if(_WHOLE).alias("n_full"))
    return own.withColumn("cbr", F.expr("try_divide(n_partial, n_partial + n_full)"))


def chance_cbr(n: Column, r: Column) -> Column:
    """What keeping syllables at random at rate r does to words of n syllables; null unless 0 < r < 1."""
    return F.when((r > 0) & (r < 1), (1 - F.pow(r, n) - F.pow(1 - r, n)) / (1 - F.pow(1 - r, n)))


def chance_mix(words: DataFrame, r: Column, by: list[str] | None = None) -> DataFrame:
    """by, n_words, chance: the same over the lengths that occur, as a ratio of sums over their histogram. r is constant in a group."""
    h = words.filter((F.col("n") > 1) & ~F.col("punct")).withColumn("_r", r).groupBy(*(by or []), "n", "_r").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("_r")
    broken, touched = F.sum(F.col("c") * (1 - F.pow(p, F.col("n")) - F.pow(1 - p, F.col("n")))), F.sum(F.col("c") * (1 - F.pow(1 - p, F.col("n"))))
    return h.groupBy(*(by or [])).agg(F.sum("c").alias("n_words"), F.when((F.min("_r") > 0) & (F.max("_r") < 1), broken / touched).alias("chance"))


def retention(words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, tier ("all" without punctuation as well), n, n_kept (with a kept syllable), rate."""
    some = words.withColumn("tier", F.explode(F.array_compact(F.array(F.when(~F.col("punct"), "all"), F.col("tier")))))
    return some.groupBy(*(by or []), "tier").agg(F.count(F.lit(1)).alias("n"), _sum_if("kept > 0").alias("n_kept")).withColumn("rate", F.expr("n_kept / n"))


def recovery(docs: DataFrame, predictor: Callable[[list[str | None]], list[str]], most: int = MOST_WORDS, around: int = AROUND) -> DataFrame:
    """docs: doc_id, syllables (array), sizes (syllables a word), mask. doc_id, n_broken (at most `most`, the first ones) and recovered: those
    of which a predictor restores every missing syllable from what is kept within `around` syllables. It gets the kept syllables with a None for
    each missing one of the word, and gives one guess each. A document without a broken word has 0 of 0."""

    def run(batches):
        for batch in batches:
            ids, found, hits = batch.column(0), [], []
            for syl, sizes, mask in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                syl, sizes, mask = syl or [], sizes or [], np.asarray(mask or [], bool)
                ends = np.cumsum(np.asarray(sizes, np.int64))
                upto = np.concatenate([[0], np.cumsum(mask)])
                kept = upto[ends] - upto[ends - np.asarray(sizes, np.int64)] if len(ends) else np.zeros(0, np.int64)
                broken = np.flatnonzero((kept > 0) & (kept < np.asarray(sizes, np.int64)))[:most] if len(ends) else []
                good = 0
                for w in broken:
                    a, b = int(ends[w] - sizes[w]), int(ends[w])
                    near = [k for k in range(max(0, a - around), min(len(syl), b + around)) if mask[k] or a <= k < b]
                    lost = [k for k in near if not mask[k]]
                    guess = predictor([syl[k] if mask[k] else None for k in near])
                    clean = lambda s: normalized("".join(s.split())).lower()
                    good += len(guess) == len(lost) and all(clean(g) == clean(syl[k]) for g, k in zip(guess, lost, strict=True))
                found.append(len(broken))
                hits.append(good)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int64()), pa.array(hits, pa.int64())], ["doc_id", "n_broken", "recovered"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "syllables", "sizes", "mask").mapInArrow(run, "doc_id long, n_broken long, recovered long")


def finite_mean(x: Column) -> Column:
    """Mean of what is neither null nor NaN; null if nothing is."""
    return F.avg(F.when(~F.isnan(x), x))


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, spearman of two columns, mean ranks for ties; null where one of them is constant. Rows are counted by value first, so ranks
    go over distinct values and no group's rows are in one task."""
    h = df.dropna(subset=[x, y]).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_c"))

    def ranks(v: str, name: str) -> DataFrame:
        own = h.groupBy(*by, v).agg(F.sum("_c").alias("_k"))
        return own.select(*by, v, (F.sum("_k").over(Window.partitionBy(*by).orderBy(v)) - F.col("_k") / 2 + 0.5).alias(name))

    own = h.join(ranks(x, "_x"), [*by, x]).join(ranks(y, "_y"), [*by, y])
    mean = lambda e: F.expr(f"sum(_c * {e}) / sum(_c)")
    var = lambda c: mean(f"{c} * {c}") - mean(c) * mean(c)
    both = mean("_x * _y") - mean("_x") * mean("_y")
    return own.groupBy(*by).agg(F.sum("_c").alias("n"), F.when((var("_x") > 0) & (var("_y") > 0), both / F.sqrt(var("_x") * var("_y"))).alias("spearman"))


def cost_profile(vocabulary: DataFrame, by: list[str], cost: str, syllables: str) -> DataFrame:
    """by, n, fertility (tokens a syllable), cv (population deviation over the mean of costs), spearman of cost and syllables."""
    own = vocabulary.groupBy(*by).agg((F.sum(cost) / F.nullif(F.sum(syllables), F.lit(0))).alias("fertility"), (F.stddev_pop(cost) / F.avg(cost)).alias("cv"))
    return own.join(rank_correlation(vocabulary, by, cost, syllables), by)
