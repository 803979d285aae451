"""Where models plug in: segmenters, readers, teachers, encoders, windowed scorers, rewriting compressors.

A model is a callable that a worker gets whole and calls once for many rows; what is built in is a deterministic stand-in. Every pass is
row-local (one Arrow batch at a time), so a lost executor costs its own batches. Nulls are stated at each function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.functions.text import METRIC, TOKEN
from condensa.streaming.incremental import fan_out

from . import selection
from .compress import budget_of, quarters

#: Rows that a model gets at once; words that an encoder gets at once.
AT_ONCE, WORDS_AT_ONCE = 256, 512
WORDS = "array<struct<text:string,pos:string,ner:string>>"
_TOKEN, _METRIC = regex.compile(TOKEN), regex.compile(METRIC)


class Segmenter(Protocol):
    def __call__(self, texts: list[str]) -> list[list[tuple[str, str, str]]]: ...


class Reader(Protocol):
    def __call__(self, prompts: list[str], max_new_tokens: int) -> list[str]: ...


class Encoder(Protocol):
    def __call__(self, texts: list[list[str]]) -> list[np.ndarray]: ...


def token_segmenter(texts: list[str]) -> list[list[tuple[str, str, str]]]:
    """Built in: a word a token, numerals tagged M, the rest N, no names."""
    return [[(t, "M" if t.isdecimal() else "N", "O") for t in _TOKEN.findall(x)] for x in texts]


def first_line_reader(prompts: list[str], max_new_tokens: int) -> list[str]:
    """Built in: the last line of a prompt that is not its cue, cut to so many words."""
    return [" ".join((p.split("\n")[-3] if p.count("\n") >= 2 else p).split()[:max_new_tokens]) for p in prompts]


def one_hot_encoder(texts: list[list[str]]) -> list[np.ndarray]:
    """Built in: a dimension a distinct word of these texts, so memory grows with the square of a call's words."""
    at = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    out = []
    for t in texts:
        v = np.zeros((len(t), max(1, len(at))))
        v[np.arange(len(t)), [at[w] for w in t]] = 1
        out.append(v)
    return out


def _chunks(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(i, AT_ONCE)


def segment(rows: DataFrame, text: str = "text", segmenter: Segmenter = token_segmenter) -> DataFrame:
    """rows with `words`. Each distinct text is segmented once and joined back; a null text has null words."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("pos", pa.string()), ("ner", pa.string())]))

    def run(batches):
        for some in _chunks(batches):
            words = [[{"text": t, "pos": p, "ner": n} for t, p, n in ws] for ws in segmenter(some.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(words, kind)], ["h", "words"])

    return fan_out(rows, text, lambda once: once.select("h", "text").mapInArrow(run, f"h string, words {WORDS}"))


def read_answers(rows: DataFrame, key: list[str], prompt: Column, max_new_tokens: int, reader: Reader = first_line_reader) -> DataFrame:
    """key, raw_output, n_output_tokens (its runs without white space) of each row's prompt; a null prompt is an empty one."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema) + ", raw_output string, n_output_tokens long"

    def run(batches):
        for some in _chunks(batches):
            got = reader([p or "" for p in some.column(len(key)).to_pylist()], max_new_tokens)
            yield pa.RecordBatch.from_arrays([*some.columns[: len(key)], pa.array(got, pa.string()), pa.array([len(g.split()) for g in got], pa.int64())], [*key, "raw_output", "n_output_tokens"])

    return rows.select(*key, prompt.alias("prompt")).mapInArrow(run, schema)


def ask_teacher(work: DataFrame, done: DataFrame | None, call: Callable[[str, float], str], rates: list[float], tries: int = 2) -> DataFrame:
    """id, ratio, compressed, error of work (id, text) at each rate that done (id, ratio) lacks. A text is asked for once a rate, however many ids
    have it; a call that fails as often as `tries` has no text and says why, and is asked again in the next run, as done has to hold what has a
    text. A null text has none."""
    pairs = work.select("id", "text", F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("ratio"))
    if done is not None:
        left, gone = F.round("ratio", 3), done.select("id", F.round("ratio", 3).alias("_r")).distinct()
        pairs = pairs.withColumn("_r", left).join(gone, ["id", "_r"], "left_anti").drop("_r")
    schema = "h string, ratio double, compressed string, error string"

    def one(text: str, rate: float) -> tuple[str | None, str | None]:
        said = None
        for _ in range(tries):
            try:
                return call(text, rate), None
            except Exception as e:  # noqa: BLE001 - whatever a remote call raises is this row's failure, not the job's
                said = f"{type(e).__name__}: {e}"
        return None, said

    def run(batches):
        for some in _chunks(batches):
            got = [one(t, r) for t, r in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["h", "ratio", "compressed", "error"])

    keyed = pairs.filter("text is not null").withColumn("h", F.sha2("text", 256))
    once = keyed.select("h", "text", "ratio").dropDuplicates(["h", "ratio"])
    made = once.mapInArrow(run, schema)
    return keyed.select("id", "h", "ratio").join(made, ["h", "ratio"]).select("id", "ratio", "compressed", "error")


def _calls(pairs: Iterable[tuple[list[str], list[str]]], at_once: int):
    """Lists of consecutive pairs of at most at_once words together; a pair of more is one by itself."""
    some, n = [], 0
    for a, b in pairs:
        if some and n + len(a) + len(b) > at_once:
            yield some
            some, n = [], 0
        some.append((a, b))
        n += len(a) + len(b)
    if some:
        yield some


def similarity_f1(pairs: DataFrame, key: list[str], encoder: Encoder = one_hot_encoder, most: int = 256, at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """key, f1 of pairs (key, pred, gold): each word meets its most similar one on the other side, by the cosine of their vectors; precision over
    the prediction's words, recall over the gold's. The model reads the first `most` words of a side (what it can take). 0 where a side is empty.
    A call of the encoder holds whole pairs, of at most `at_once` words unless one pair has more: a model of few dimensions may be given many more."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*key).schema) + ", f1 double"

    def score(a: np.ndarray, b: np.ndarray) -> float:
        if not len(a) or not len(b):
            return 0.0
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        cos = unit(a) @ unit(b).T
        p, r = cos.max(1).mean(), cos.max(0).mean()
        return float(2 * p * r / (p + r)) if p + r else 0.0

    def run(batches):
        for some in _chunks(batches):
            words = ([[m.group() for m in islice(_METRIC.finditer((t.as_py() or "").lower()), most)] for t in pair] for pair in zip(*some.columns[len(key) :], strict=True))
            f1 = []
            for call in _calls(words, at_once):
                both = encoder([a for a, _ in call] + [b for _, b in call])
                f1 += [score(a, b) for a, b in zip(both[: len(call)], both[len(call) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*some.columns[: len(key)], pa.array(f1, pa.float64())], [*key, "f1"])

    return pairs.select(*key, "pred", "gold").mapInArrow(run, schema)


def syllable_logits(sentences: list[int], pieces: list[int], score: Callable[[int, int], Any], most: int = 510, longest: int = 200) -> np.ndarray:
    """Logits of a text's syllables from a model that sees windows. sentences: syllables of each; pieces: sub-words of each syllable. score(begin,
    end) gives, for the sub-words of the syllables of a window (as many as fit), their two labels' logits (drop, keep) or one log-odds. Log-odds are
    averaged over a syllable's sub-words in a window, then over the windows that saw it; an unseen one is neutral, 0."""
    cut = selection.cut_long(sentences, longest)
    ends = np.cumsum(cut)
    upto = np.concatenate([[0], np.cumsum(np.asarray(pieces, np.int64))])
    lengths = [int(upto[e] - upto[e - n]) for n, e in zip(cut, ends, strict=True)]
    total, seen = np.zeros(len(pieces)), np.zeros(len(pieces), np.int64)
    for a, b in selection.windows(lengths, most):
        begin, end = int(ends[a] - cut[a]), int(ends[b - 1])
        got = np.asarray(score(begin, end), float)
        odds = got[:, 1] - got[:, 0] if got.ndim == 2 else got
        owner = np.repeat(np.arange(begin, end), pieces[begin:end])[: len(odds)]
        counts = np.bincount(owner, minlength=len(pieces))
        here = counts > 0
        total[here] += np.bincount(owner, odds[: len(owner)], len(pieces))[here] / counts[here]
        seen += here
    return np.divide(total, seen, out=np.zeros(len(pieces)), where=seen > 0)


def word_logits(syllable_logits: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Mean over each word's syllables; 0 for a word without any."""
    n = np.asarray(sizes, np.int64)
    upto, ends = np.concatenate([[0], np.cumsum(syllable_logits)]), np.cumsum(n)
    return np.divide(upto[ends] - upto[ends - n], n, out=np.zeros(len(n)), where=n > 0)


def compress_by_rate(docs: DataFrame, rewrite: Callable[[str, float], str], ratio: float, length: Callable[[str], int] | None = None) -> DataFrame:
    """doc_id, budget, used, text of docs (doc_id, text): the longest result within the budget that a compressor with a rate gives over a bisection of it,
    or leading words if none fits. A null text is empty."""
    size = length or (lambda t: sum(quarters(t.split())))
    schema = "doc_id long, budget long, used long, text string"

    def run(batches):
        for some in _chunks(batches):
            rows = []
            for d, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                budget = budget_of(size(t or ""), ratio)
                made = selection.search_rate(lambda r, t=t or "": rewrite(t, r), t or "", budget, size)
                rows.append((d, budget, size(made), made))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "budget", "used", "text"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def joined_words(words: str) -> Column:
    """The text as encoders for segmented text read it: an underscore for the spaces within a word, a space between words."""
    return F.array_join(F.transform(words, lambda w: F.replace(w["text"], F.lit(" "), F.lit("_"))), " ")
