"""Quality rules: a suffix array over the words of each text, its longest-common-prefix intervals, and
limits on what maximal repeated substrings cover and on the longest of them.

Many texts share one array: every position's rank orders it by text, then by the words from there on.
Ranks come from prefix doubling, beyond LEAST words only where so many recur within a text, so the array is
complete wherever two suffixes share LEAST words or more. Maximal repeats are the spans that neighbours
in the array share; their union is taken per text, once of all of them and once of those that the base rule counts.

The verdict rejects what the base rule cannot see: texts of many short repeats (a word or phrase said over and
over, a menu of few entries), of which maximal repeats of LEAST words or more cover MOST_COVERED, and texts with one
repeat that is long by itself and for the text.

Nulls: a null text has no words and fails the base rule. Every row gives one row; repeated rows each.
Other columns are kept by keep_quality and ignored by quality_features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import release

#: Words that a repeat needs to count for the method, and for the base rule.
LEAST, BASE_LEAST = 4, 8
#: The method's limits: share of a text's words that repeats may cover, and the longest repeat, as
#: words and as a share of the text. A repeat is too long if it passes both of its limits.
MOST_COVERED, LONGEST_WORDS, LONGEST_SHARE = 0.3, 50, 0.1
#: Texts beyond this many bytes start a new array.
SLICE_BYTES = 1 << 20

_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "n_covered_words"]
_SYMBOL, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks, equal for equal keys."""
    order = np.argsort(keys)
    own = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
    return rank


def repeats(words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words covered by maximal repeats of BASE_LEAST words or more, the longest of those (0 without one), and words
    covered by maximal repeats of LEAST words or more. words: their codes, text after text."""
    n_texts = len(lens)
    covered, longest, wide = (np.zeros(n_texts, np.int64) for _ in range(3))
    # every text is followed by LEAST empty words (code 0), so that a window never meets the next text
    begins = np.cumsum(lens + LEAST) - (lens + LEAST)
    size = int((lens + LEAST).sum())
    code = np.zeros(size + 2 * LEAST, np.int64)
    at = np.arange(len(words)) + np.repeat(begins - (np.cumsum(lens) - lens), lens)
    code[at] = words + 1
    text = np.repeat(np.arange(n_texts), lens + LEAST)
    real = code[:size] > 0
    two = _dense((code[:-1] << 32) | code[1:])
    four = _dense((two[:size] << 32) | two[2 : size + 2])
    key = (text << 32) | four
    key[~real] = -1 - np.arange(size)[~real]
    order = np.argsort(key)
    own = key[order]
    new = np.concatenate([[True], own[1:] != own[:-1]])
    rank = np.zeros(size + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(size), 0))
    shared = ~new
    shared[:-1] |= ~new[1:]
    open_ = order[shared]  # positions whose next LEAST words recur in their text
    if not len(open_):
        return covered, longest, wide
    levels, step = [rank.copy()], LEAST
    first = open_
    while len(open_):
        after = np.minimum(open_ + step, size)
        far = rank[after]
        o = np.lexsort((far, rank[open_]))
        pos, r, f = open_[o], rank[open_][o], far[o]
        head = np.concatenate([[True], r[1:] != r[:-1]])
        cut = np.concatenate([[True], (r[1:] != r[:-1]) | (f[1:] != f[:-1])])
        i = np.arange(len(pos))
        place = np.maximum.accumulate(np.where(cut, i, 0)) - np.maximum.accumulate(np.where(head, i, 0))
        rank[pos] = r + place
        levels.append(rank.copy())
        again = ~cut
        again[:-1] |= ~cut[1:]
        open_, step = pos[again], step * 2
    # neighbours in the array, and the words that they share: halving steps over the ranks kept above
    sa = first[np.argsort(rank[first])]
    same = levels[0][sa[1:]] == levels[0][sa[:-1]]
    a, b = sa[:-1][same].copy(), sa[1:][same].copy()
    left, right = a.copy(), b.copy()
    for k in range(len(levels) - 1, -1, -1):
        hop = (levels[k][np.minimum(a, size)] == levels[k][np.minimum(b, size)]) & (a < size) & (b < size)
        a, b = np.where(hop, a + (LEAST << k), a), np.where(hop, b + (LEAST << k), b)
    for _ in range(LEAST):
        hop = (code[np.minimum(a, size)] == code[np.minimum(b, size)]) & (code[np.minimum(a, size)] > 0)
        a, b = a + hop, b + hop
    common = a - left
    counts = common >= BASE_LEAST
    for out, some in ((wide, slice(None)), (covered, counts)):
        reach = np.zeros(size, np.int64)
        np.maximum.at(reach, left[some], (left + common)[some])
        np.maximum.at(reach, right[some], (right + common)[some])
        out += np.bincount(text[np.maximum.accumulate(reach) > np.arange(size)], minlength=n_texts)
    np.maximum.at(longest, text[left[counts]], common[counts])
    return covered, longest, wide


def _slices(texts: pa.Array):
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        base = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, base + SLICE_BYTES, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base measures and the longest repeat of each text."""
    out: dict[str, list] = {k: [] for k in _FEATURES}
    for some in _slices(texts):
        some = pc.fill_null(some.cast(pa.large_string()), "")
        sizes = pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        spans = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
        raw = np.frombuffer("".join(some.to_pylist()).encode(), np.uint8)
        total = lambda mask: np.fromiter((np.count_nonzero(mask[a:b]) for a, b in spans), np.int64, len(spans))
        pieces = pc.ascii_split_whitespace(some)
        words = pieces.flatten()
        owner = np.repeat(np.arange(len(some)), np.diff(pieces.offsets.to_numpy()))
        full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[full]
        lens = np.bincount(owner[full], minlength=len(some))
        covered, longest, wide = repeats(codes, lens)
        dup = []
        for t in some.to_pylist():
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")] if "\n" in t else []
            dup.append(len(lines) - len(set(lines)))
        own = (lens, pc.utf8_length(some).to_numpy(zero_copy_only=False) - total(_SPACE[raw]), total(_SYMBOL[raw]), dup, covered, longest, wide)
        for k, v in zip(_FEATURES, own, strict=True):
            out[k].append(np.asarray(v, np.int64))
    return {k: np.concatenate([np.empty(0, np.int64), *v]) for k, v in out.items()}


def verdict(f: dict[str, np.ndarray], most_covered: float = MOST_COVERED, longest_words: int = LONGEST_WORDS, longest_share: float = LONGEST_SHARE):
    """(base_failed, kept)."""
    n = f["n_words"]
    failed = (n < 20) | (100 * f["n_repeat_words"] > 30 * n)
    long = (f["longest_repeat"] > longest_words) & (f["longest_repeat"] > longest_share * n)
    return failed, ~failed & (f["n_covered_words"] <= most_covered * n) & ~long


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, n_covered_words long, base_failed boolean, kept boolean"


def quality_features(docs: DataFrame, **limits) -> DataFrame:
    """Measures and verdict per document of docs (doc_id, text). No shuffle."""

    def run(batches):
        for batch in batches:
            f = features(batch.column(1))
            failed, kept = verdict(f, **limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f[k]) for k in _FEATURES), pa.array(failed), pa.array(kept)], ["doc_id", *_FEATURES, "base_failed", "kept"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, _SCHEMA)


def keep_quality(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns. No shuffle."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                yield some.filter(pa.array(verdict(features(some.column(at)), **limits)[1]))
            release()

    return docs.mapInArrow(run, docs.schema)
