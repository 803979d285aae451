"""Compression of texts under a token budget: a registry of methods by spec, one Arrow pass a method and no shuffle.

A text is its runs without white space (units), in sentences that end at . ! or ?. What a unit costs is a counter's to say
(`Counter`: texts -> token counts), how much it matters a scorer's (`Scorer`: units -> logits); both are parameters, and both are
asked once a batch for its distinct units. The built-in counter charges a token for every four characters begun. The budget is
the ratio times all tokens, halves to even. A null text is empty; repeated rows are compressed each.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter as Tally
from collections.abc import Callable, Iterable
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.functions.text import METRIC, TOKEN

from . import alignment, selection

#: Stop and negation words of the built-in lists, and the scores of the lexical levels.
STOP = frozenset("the a of and to in is it for on that was with as be at by la le les de des du et un une der die das und ein en el los las y que".split())
NEGATION = frozenset("not no never non pas nicht kein keine sin nunca".split())
LEVEL_NUMBER, LEVEL_LONG, LEVEL_OTHER, LEVEL_STOP = 3.0, 2.0, 1.0, 0.0
#: Entries of a score table up to which it is sent to every worker as a whole; beyond, units are joined with it.
BROADCAST_WORDS = 200_000

_SENTENCE, _METRIC, _TOKEN = re.compile(r"(?<=[.!?])\s+"), regex.compile(METRIC), regex.compile(TOKEN)


class Counter(Protocol):
    def __call__(self, texts: list[str]) -> list[int]: ...


class Scorer(Protocol):
    def __call__(self, units: list[str]) -> list[float]: ...


def quarters(texts: list[str]) -> list[int]:
    return [max(1, -(-len(t) // 4)) for t in texts]


def cost(unit: str) -> int:
    return max(1, -(-len(unit) // 4))


class TokenizerCounter:
    """Token counts of a tokenizers file; a unit costs what it adds after another word, one at least."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, texts: list[str]) -> list[int]:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(self.path)
        punct = regex.compile(r"\p{P}*")
        size = lambda some: [len(e.ids) for e in lib.encode_batch_fast(some, add_special_tokens=False)]
        alone = size(["x"])[0]
        return [max(1, n - alone) for n in size([f"x{t}" if punct.fullmatch(t) else f"x {t}" for t in texts])]


def budget_of(total: int, ratio: float) -> int:
    return round(ratio * total)


def _noise(n: int, seed: str) -> np.ndarray:
    return np.array([int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) / 4294967296 for i in range(n)])


def _late(n: int) -> np.ndarray:
    """0.5 at the first unit, falling to near 0 at the last."""
    return 0.5 * (1.0 - np.arange(n) * 1.0 / max(1, n))


def sentences(text: str) -> list[list[str]]:
    """Units of each sentence that has any."""
    return [u for s in _SENTENCE.split(text) if (u := s.split())]


def tfidf(bags: list[list[str]]) -> np.ndarray:
    """Mean TF-IDF of each bag of terms; document frequencies are over these bags, empty ones aside."""
    df = Tally(t for b in bags for t in set(b))
    n = sum(map(bool, bags))
    idf = {t: math.log((1 + n) / (1 + k)) for t, k in df.items()}
    return np.array([sum(idf[t] for t in b) / max(1, len(b)) for b in bags])


def self_information(units: list[str]) -> list[np.ndarray]:
    """The built-in language model: of each token of each unit, minus the logarithm of its share of the text's tokens."""
    own = [_TOKEN.findall(u.lower()) for u in units]
    seen = Tally(t for u in own for t in u)
    total = sum(seen.values())
    return [np.array([math.log(total / seen[t]) for t in u]) for u in own]


def select_sentences(sizes: list[int], scores, costs: list[int], budget: int) -> np.ndarray:
    """Mask over units: whole sentences by score while they fit (each costs one more than its units), then the beginning of the
    best one left out, then what comes first. Scores count to nine places; ties go to the earlier sentence."""
    scores = np.round(np.asarray(scores, float), 9)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.bincount(owner, np.asarray(costs, float), len(sizes)).astype(np.int64) + 1
    kept = selection.greedy(scores, whole, budget)
    left = np.flatnonzero(~kept)
    rank = np.where(kept, 0, 2)
    if len(left):
        rank[left[scores[left].argmax()]] = 1
    return selection.greedy(-rank[owner].astype(float), costs, budget, fill=False)


def random_scores(units, seed="1", **_):
    return _noise(len(units), seed), None, {}


def lead_scores(units, **_):
    return -np.arange(len(units), dtype=float), None, {"fill": False}


def truncation_scores(units, **_):
    i = np.arange(len(units))
    return -np.minimum(i, len(units) - 1 - i).astype(float), None, {"fill": False}


def stopword_scores(units, **_):
    return np.array([0.0 if u.lower() in STOP else 1.0 for u in units]) + _late(len(units)), None, {}


def lexical_scores(units, **_):
    level = [LEVEL_NUMBER if any(c.isdigit() for c in u) else LEVEL_STOP if u.lower() in STOP else LEVEL_LONG if len(u) >= 9 else LEVEL_OTHER for u in units]
    return np.array(level) + _late(len(units)), None, {}


def _guard(units) -> np.ndarray:
    return np.array([u.lower() in NEGATION or any(c.isdigit() for c in u) for u in units], float)


def protected_scores(units, mode="soft", delta="0.5", alpha="0", **_):
    """The noise scorer with negations and numbers raised by delta (soft) or put first (hard)."""
    guard, s = _guard(units), _noise(len(units), "p")
    return (s, guard, {"alpha": float(alpha)}) if mode == "hard" else (s + float(delta) * guard, None, {"alpha": float(alpha)})


def selective_scores(units, **_):
    return np.array([float(x.sum()) for x in self_information(units)]).round(9), None, {}


def scored_scores(units, scorer: Scorer | None = None, protect="none", delta="0.2", alpha="0", exact="0", **_):
    """Sigmoid of a scorer's logits, protected softly, hard, or not. With exact=1 priorities are not looked at by the selection."""
    if scorer is None:
        raise ValueError("this method needs a scorer")
    s, guard = 1 / (1 + np.exp(-np.asarray(scorer(units), float))), _guard(units)
    s = s + float(delta) * guard if protect == "soft" else s
    return s, guard if protect == "hard" else None, {"alpha": float(alpha), "exact": exact == "1"}


#: Methods that score units, those that score sentences, and those that say which units stay.
METHODS: dict[str, Callable] = {"random": random_scores, "lead": lead_scores, "truncation": truncation_scores, "stopword": stopword_scores, "lexical": lexical_scores, "protected": protected_scores, "selective_context": selective_scores, "scored": scored_scores, "lexprior": scored_scores}
SENTENCES: dict[str, Callable] = {
    "tfidf_sent": lambda units, own: tfidf([_METRIC.findall(" ".join(s).lower()) for s in own]),
    "ppl_sent": lambda units, own: [float(np.concatenate(x).mean()) if sum(map(len, x)) else 0.0 for x in _grouped(self_information(units), own)],
}
WHOLE: dict[str, Callable] = {
    "none": lambda units: np.ones(len(units), bool),
    "no_context": lambda units: np.zeros(len(units), bool),
    "probe_negation": lambda units: np.array([u.lower() not in NEGATION for u in units], bool),
}
#: Methods over a second table or column; see precomputed() and translated().
TABLES = ("precomputed", "translate")


def _grouped(values: list, own: list[list[str]]) -> Iterable[list]:
    at = 0
    for s in own:
        yield values[at : at + len(s)]
        at += len(s)


def parse_spec(spec: str) -> tuple[str, dict[str, str]]:
    """name or name:key=value,key=value; an unknown name is an error."""
    name, _, rest = spec.partition(":")
    if name not in METHODS | SENTENCES | WHOLE and name not in TABLES:
        raise ValueError(f"unknown method {name}")
    return name, dict(x.split("=", 1) for x in rest.split(",")) if rest else {}


def _select(units: list[str], spec: str, ratio: float, costs: list[int] | None, budget: int | None, scorer: Scorer | None, text: str | None):
    """(mask, costs, budget, scores or None, priority or None) of one text."""
    name, options = parse_spec(spec)
    costs = quarters(units) if costs is None else costs
    budget = budget_of(sum(costs), ratio) if budget is None else budget
    if not units:
        return np.zeros(0, bool), costs, budget, None, None
    if name in WHOLE:
        return WHOLE[name](units), costs, budget, None, None
    if name in SENTENCES:
        own = sentences(" ".join(units) if text is None else text)
        return select_sentences(list(map(len, own)), SENTENCES[name](units, own), costs, budget), costs, budget, None, None
    if name in TABLES:
        raise ValueError(f"{name} reads a second text: use the function of that name")
    scores, priority, how = METHODS[name](units, scorer=scorer, **options)
    if how.pop("exact", False):  # priorities are for trimming alone then
        return selection.knapsack(scores, costs, budget), costs, budget, scores, priority
    return selection.greedy(scores, costs, budget, priority, **how), costs, budget, scores, priority


def compress_units(units: list[str], spec: str, ratio: float, costs: list[int] | None = None, budget: int | None = None, scorer: Scorer | None = None, text: str | None = None) -> tuple[np.ndarray, list[int], int]:
    """(mask, costs, budget) of one text. text: for methods that need its sentences, if units alone do not say them."""
    return _select(units, spec, ratio, costs, budget, scorer, text)[:3]


def selection_stats(kept: np.ndarray, costs: list[int], budget: int, guard: np.ndarray | None = None, trimmed: int = 0) -> dict:
    """What a selection spent: in all, against the budget, on protected units, and how many of those it kept."""
    c, k = np.asarray(costs, np.int64), np.asarray(kept, bool)
    spent = int(c[k].sum())
    g = np.zeros(len(c), bool) if guard is None else np.asarray(guard, bool)
    return {"sum_unit_cost": spent, "cost_deviation": spent - budget, "n_trimmed": trimmed, "p_unit_cost": int(c[k & g].sum()), "n_protected_kept": int((k & g).sum()), "n_protected": int(g.sum())}


_OUT = "doc_id long, method string, ratio double, budget long, n_kept long, used long, positions long, n_protected_kept long, n_protected long, compressed string"
_ARROW = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def _batch(rows: list[tuple], types, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in schema.split(", ")])


def _unit_costs(texts: list[list[str]], counter: Counter) -> dict[str, int]:
    distinct = sorted({u for units in texts for u in units})
    return dict(zip(distinct, counter(distinct), strict=True))


def _row(d, spec: str, ratio: float, units: list[str], costs: list[int], budget: int, kept: np.ndarray) -> tuple:
    at = np.flatnonzero(kept)
    own = selection_stats(kept, costs, budget, _guard(units).astype(bool))
    return (d, spec, ratio, budget, len(at), own["sum_unit_cost"], int(at.sum()), own["n_protected_kept"], own["n_protected"], selection.render([units[i] for i in at]))


def compress(docs: DataFrame, spec: str, ratio: float, counter: Counter = quarters, scorer: Scorer | None = None, length: Counter | None = None) -> DataFrame:
    """doc_id, method, ratio, budget, n_kept, used, positions (sum of kept places), n_protected_kept, n_protected and compressed
    of docs (doc_id, text). length counts tokens of whole rendered texts, where units' costs do not add up to that: kept units of the lowest
    (priority, score) then go until the text fits; of methods without scores the last ones. No shuffle."""
    parse_spec(spec)

    def fitted(units, kept, budget, scores, priority):
        size = lambda m: length([selection.render([u for u, k in zip(units, m, strict=True) if k])])[0]
        return selection.trim(kept, -np.arange(len(units)) if scores is None else scores, budget, size, priority)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                texts = [t or "" for t in batch.column(1).slice(i, 512).to_pylist()]
                split = [t.split() for t in texts]
                costs, rows = _unit_costs(split, counter), []
                for d, t, units in zip(batch.column(0).slice(i, 512).to_pylist(), texts, split, strict=True):
                    own = [costs[u] for u in units]
                    kept, _, budget, scores, priority = _select(units, spec, ratio, own, None, scorer, t)
                    kept = kept if length is None else fitted(units, kept, budget, scores, priority)
                    rows.append(_row(d, spec, ratio, units, own, budget, kept))
                yield _batch(rows, _ARROW, _OUT)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, _OUT)


def precomputed(docs: DataFrame, done: DataFrame, ratio: float, trim: bool = False) -> DataFrame:
    """doc_id, budget, used, text of what another system made of docs: done (doc_id, ratio, compressed) at this ratio, to three
    places. A document without one is an error. trim drops words from the end until the rest fits. One equi-join."""
    own = done.filter(F.round("ratio", 3) == F.lit(round(ratio, 3))).select("doc_id", "compressed")
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(own, "doc_id", "left")
    found = F.when(F.col("compressed").isNull(), F.raise_error(F.concat(F.lit("nothing precomputed for "), F.col("doc_id").cast("string")))).otherwise(F.col("compressed"))
    schema = "doc_id long, budget long, used long, text string"

    def run(batches):
        for batch in batches:
            rows = []
            for d, text, made in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                budget, words = budget_of(sum(quarters(text.split())), ratio), made.split()
                fits = int((np.cumsum(quarters(words)) <= budget).sum()) if trim else len(words)
                rows.append((d, budget, sum(quarters(words[:fits])), " ".join(words[:fits])))
            if rows:
                yield _batch(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()), schema)

    return both.select("doc_id", "text", found.alias("made")).mapInArrow(run, schema)


def translated(docs: DataFrame, spec: str, ratio: float) -> DataFrame:
    """As compress, of docs (doc_id, text, text_en): what is compressed is text_en, under the budget of text. A document with
    neither is empty, one without text_en an error."""

    def run(batches):
        for batch in batches:
            rows = []
            for d, text, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if other is None:
                    raise ValueError(f"no parallel text for {d}")
                units, budget = other.split(), budget_of(sum(quarters((text or "").split())), ratio)
                kept, costs, _ = compress_units(units, spec, ratio, budget=budget, text=other)
                rows.append(_row(d, spec, ratio, units, costs, budget, kept))
            if rows:
                yield _batch(rows, _ARROW, _OUT)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text", "text_en").mapInArrow(run, _OUT)


def fit_lexprior(words: DataFrame) -> DataFrame:
    """word, seen, kept, rate of words (word, kept 0 or 1): rates smoothed towards the mean keep rate by one observation.
    The word "" is the default: that mean. Counts are combined before the shuffle."""
    own = words.select(F.lower("word").alias("word"), F.col("kept").cast("long").alias("kept")).groupBy("word").agg(F.count(F.lit(1)).alias("seen"), F.sum("kept").alias("kept"))
    base = own.agg(F.sum("kept").alias("k"), F.sum("seen").alias("n")).select((F.col("k") / F.col("n")).alias("base"))
    fit = own.crossJoin(F.broadcast(base)).select("word", "seen", "kept", ((F.col("kept") + F.col("base")) / (F.col("seen") + 1)).alias("rate"))
    return fit.unionByName(base.select(F.lit("").alias("word"), F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("kept"), F.col("base").alias("rate")))


def lexprior(docs: DataFrame, rates: DataFrame, ratio: float, options: str = "", most: int = BROADCAST_WORDS) -> DataFrame:
    """As compress, with the rates of fit_lexprior (word, rate) for scores, clamped to [0.0001, 0.9999] and turned to logits. Up to
    `most` rates go to every worker as one table; more are joined with the distinct units of each text and come back by text."""
    spec = f"lexprior:{options}" if options else "lexprior"
    logit = lambda r: math.log((c := min(max(r, 1e-4), 1 - 1e-4)) / (1 - c))
    base = rates.filter("word = ''").first()
    if base is None:
        raise ValueError("no default rate: nothing was fitted")
    default = logit(base.rate)
    if rates.limit(most + 1).count() <= most:
        table = _broadcast(docs.sparkSession, {r.word: logit(r.rate) for r in rates.select("word", "rate").toLocalIterator()})
        return compress(docs, spec, ratio, scorer=lambda units: [table.value.get(u.lower(), default) for u in units])
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    units = rows.select("row", F.explode_outer(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"))).alias("word"))
    known = units.join(rates.filter("word <> ''").select("word", "rate"), "word").groupBy("row").agg(F.collect_list(F.struct("word", "rate")).alias("own"))

    def run(batches):
        for batch in batches:
            out = []
            for d, t, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units = (t or "").split()
                table = {x["word"]: logit(x["rate"]) for x in own or ()}
                kept, costs, budget = compress_units(units, spec, ratio, scorer=lambda us: [table.get(u.lower(), default) for u in us])  # noqa: B023
                out.append(_row(d, spec, ratio, units, costs, budget, kept))
            if out:
                yield _batch(out, _ARROW, _OUT)

    return rows.join(known, "row", "left").selectExpr("cast(doc_id as long) as doc_id", "text", "own").mapInArrow(run, _OUT)


def _broadcast(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)


def sentence_scores(docs: DataFrame, method: str = "tfidf_sent") -> DataFrame:
    """doc_id, sent (from 1), score of every sentence of docs that has a term. No shuffle."""

    def run(batches):
        for batch in batches:
            ids, at, scores = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = _SENTENCE.split(t or "")
                bags = [_METRIC.findall(s.lower()) for s in parts]
                own = tfidf(bags)
                some = [i for i, b in enumerate(bags) if b]
                ids += [d] * len(some)
                at += [i + 1 for i in some]
                scores += own[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "sent", "score"])

    if method != "tfidf_sent":
        raise ValueError(f"no sentence scores for {method}")
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, sent long, score double")


_ALIGNED = "doc_id long, n_units long, n_matched long, keep_rate double, partial long, full long, cbr double, unmatched_ratio double"


def align_labels(docs: DataFrame, spec: str, ratio: float) -> DataFrame:
    """Align each compressed text to its source and label it: doc_id, n_units, n_matched, keep_rate, partial, full, cbr,
    unmatched_ratio. Pairs of neighbouring units stand for words of two syllables."""

    def run(batches):
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                units = (t or "").split()
                kept, _, _ = compress_units(units, spec, ratio, text=t or "")
                mask, unmatched = alignment.align(units, selection.render([u for u, k in zip(units, kept, strict=True) if k]))
                own = alignment.word_labels(mask, [min(2, len(units) - i) for i in range(0, len(units), 2)])
                rows.append((d, len(units), sum(mask), own["keep_rate"], own["partial"], own["full"], own["cbr"], unmatched))
            if rows:
                yield _batch(rows, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), _ALIGNED)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, _ALIGNED)


_GAP = "doc_id long, n_units long, greedy_score double, exact_score double"


def knapsack_gap(docs: DataFrame, ratio: float) -> DataFrame:
    """doc_id, n_units, greedy_score, exact_score: what greedy selection loses to an exact one, over the whole text and its budget."""

    def run(batches):
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                units = (t or "").split()
                costs, s = quarters(units), _noise(len(units), "gap")
                budget = budget_of(sum(costs), ratio)
                fast = float(s[selection.greedy(s, costs, budget)].sum()) if units else 0.0
                rows.append((d, len(units), round(fast, 6), round(selection.best_score(s, costs, budget), 6)))
            if rows:
                yield _batch(rows, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), _GAP)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, _GAP)


def rouge_l(pairs: DataFrame) -> DataFrame:
    """conv_id, turn, f1 of pairs (conv_id, turn, pred, gold)."""

    def run(batches):
        for batch in batches:
            score = [alignment.rouge_l(p or "", g or "") for p, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["conv_id", "turn", "f1"])

    return pairs.select("conv_id", "turn", "pred", "gold").mapInArrow(run, "conv_id long, turn long, f1 double")
