"""Whole-text encoding with the tokenizers library, at one library call per distinct word.

Both vocabularies used here cut a text into pieces before any merge, and no piece crosses a single
space or a single line break that stands between two other characters. So a text is cut there, each
distinct part is encoded once by the library, and texts are put together from the parts' ids by
numpy gathers. Texts with other white space next to a space or line break are cut by an equivalent
pattern one by one. Ids are those of one call for the whole text (tests compare them).
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, as the vocabularies' patterns read \s.
_WS = "\t-\r \x85\xa0  -     　"
_PART = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_ODD = (
    "[ \\n][\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    "|[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}][ \\n]"
    "|^[ \\n]|[ \\n]$"
)
_MARKS = (",", ".")
#: A private-use character between parts, a piece by itself between spaces.
_BETWEEN = " \ue000 "
_WS_OR_BETWEEN = frozenset("\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ue000")
_NOT_PLAIN = re.compile(f"[{_WS}\ue000]")
#: Parts in one text for the library.
_TOGETHER = 128
#: Distinct parts that a worker remembers; beyond it, it goes on with those that it met again.
MOST_PARTS = 300_000
#: UTF-8 bytes of text handled at once.
SLICE_BYTES = 2 << 20


class PartTable:
    """Parts seen so far and, for each, a row of values (ids, or one count). A full table keeps the parts
    met in more than one slice since it was last full, so frequent parts are worked out once and rare ones
    make room."""

    def __init__(self, values_of, dtype, most: int = MOST_PARTS):
        """values_of: list of parts -> (values of all, values per part)."""
        self._values_of, self._dtype, self._most = values_of, dtype, most
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.empty(1 << 16, self._dtype)
        self.starts = np.empty(1 << 14, np.int64)
        self.lens = np.empty(1 << 14, np.int64)
        self._again = np.zeros(1 << 14, bool)
        self.used = 0

    def _make_room(self, new: int) -> None:
        keep = np.flatnonzero(self._again[: len(self.at)])
        if len(keep) + new > self._most:
            return self._forget()
        names, flat = list(self.at), self.gather(keep)
        lens = self.lens[keep]
        self._forget()
        self._put([names[i] for i in keep.tolist()], flat, lens)

    def _put(self, parts: list[str], values: np.ndarray, lens: np.ndarray) -> None:
        total, n = len(values), len(self.at)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(parts) > len(self.lens):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.empty_like(self.lens)])
            self._again = np.concatenate([self._again, np.zeros_like(self._again)])
        ends = self.used + np.cumsum(lens)
        self.flat[self.used : self.used + total] = values
        self.starts[n : n + len(parts)], self.lens[n : n + len(parts)] = ends - lens, lens
        self.used += total
        self.at.update(zip(parts, range(n, n + len(parts)), strict=True))

    def index(self, parts: list[str]) -> np.ndarray:
        """Rows of these parts."""
        if len(self.at) + len(parts) > self._most:
            self._make_room(len(parts))
        rows = np.fromiter(map(self.at.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(rows < 0)
        self._again[rows[rows >= 0]] = True
        if len(new):
            missing = [parts[i] for i in new.tolist()]
            once = list(dict.fromkeys(missing))
            self._put(once, *self._values_of(once))
            rows[new] = np.fromiter(map(self.at.get, missing), np.int64, len(missing))
        return rows

    def gather(self, rows: np.ndarray) -> np.ndarray:
        lens = self.lens[rows]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[rows] - (ends - lens), lens) + np.arange(total)]


def _slices(texts: pa.Array):
    """Runs of rows of about SLICE_BYTES."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        base = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, base + SLICE_BYTES, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


def parts_of(texts: pa.Array, spaced: bool):
    """(distinct parts, part number of each part in order, parts per text). spaced: a part keeps the
    space before it. Null is empty; an empty text has no parts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(odd), "", texts)
    pieces = pc.split_pattern(pc.replace_substring(plain, "\n", " \n "), " ")
    lens = np.diff(pieces.offsets.to_numpy()).astype(np.int64)
    empty = (pc.binary_length(plain).to_numpy(zero_copy_only=False) == 0) & (lens == 1)
    code = pieces.flatten().dictionary_encode()
    number, words = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), code.dictionary.to_numpy(zero_copy_only=False).tolist()
    first = np.cumsum(lens) - lens
    if spaced:
        bare = np.zeros(len(number) + 1, bool)
        bare[first] = True
        if "\n" in words:
            brk = number == words.index("\n")
            bare[:-1] |= brk
            bare[1:] |= brk
        key = number * 2 + ~bare[:-1]
        used = np.flatnonzero(np.bincount(key, minlength=1))
        place = np.empty(2 * len(words) + 1, np.int64)
        place[used] = np.arange(len(used))
        number = place[key]
        words = [" " + words[k >> 1] if k & 1 else words[k >> 1] for k in used.tolist()]
    keep = np.ones(len(number), bool)
    keep[first[empty]] = False
    number, lens = number[keep], np.where(empty, 0, lens)
    if odd.any():  # cut these one by one and put them in their places
        seen = {w: i for i, w in enumerate(words)}
        split = np.split(number, np.cumsum(lens)[:-1]) if n else []
        for i in np.flatnonzero(odd):
            cut = _PART.findall(texts[int(i)].as_py())
            split[i] = np.fromiter((seen.setdefault(w, len(seen)) for w in cut), np.int64, len(cut))
        words, number, lens = list(seen), np.concatenate(split), np.fromiter(map(len, split), np.int64, n)
    return words, number, lens


class CachedEncoder:
    """encode(texts) -> (ids, ids per text). The end id is not among them."""

    def __init__(self, path: str, most: int = MOST_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self.spaced = '"normalizer":null' in self._lib.to_str().replace(" ", "")[:4000]
        small = self._lib.get_vocab_size() <= 1 << 16
        self.dtype = np.dtype("<u2" if small else "<u4")
        if self.spaced:  # a token of the byte vocabulary has a letter a byte
            vocab = self._lib.get_vocab()
            self._bytes = np.zeros(max(vocab.values()) + 1, np.int16)
            self._bytes[list(vocab.values())] = list(map(len, vocab))
        else:
            self._between = np.array(self._lib.encode(_BETWEEN, add_special_tokens=False).ids)
        self._table = PartTable(self._library, self.dtype, most)

    def _ids(self, texts: list[str]) -> np.ndarray:
        some = [np.empty(0, self.dtype)]  # the library's own results are many times as large: few at once
        for i in range(0, len(texts), 32):
            some += [np.array(e.ids, self.dtype) for e in self._lib.encode_batch_fast(texts[i : i + 32], add_special_tokens=False)]
        return np.concatenate(some)

    def _library(self, parts: list[str]):
        """Ids of many parts by few calls of the library. Plain parts (no white space within, no special
        string) are put together into texts. In the byte vocabulary every id stands for a known number of bytes, so
        the parts' own bytes say which ids are whose; a part without a space before it gets a line break,
        a piece by itself. In the other one a character that is no part's own stands between parts."""
        plain = [p != "" and not _NOT_PLAIN.search(p, 1) and p[0] not in _WS_OR_BETWEEN and "<|" not in p for p in parts]
        if not all(plain):
            odd = [p for p, x in zip(parts, plain, strict=True) if not x]
            each = [e.ids for e in self._lib.encode_batch_fast(odd, add_special_tokens=False)]
            flat, lens = self._library([p for p, x in zip(parts, plain, strict=True) if x])
            at = np.array(plain, bool)
            counts = np.empty(len(parts), np.int64)
            counts[at], counts[~at] = lens, list(map(len, each))
            out, own = np.empty(counts.sum(), np.int64), np.repeat(at, counts)
            out[own], out[~own] = flat, [v for e in each for v in e]
            return out, counts
        if self.spaced:
            bare = np.array([p[0] != " " for p in parts], bool)
            joined = [p if p[0] == " " else "\n" + p for p in parts]
            ids = self._ids(["".join(joined[i : i + _TOGETHER]) for i in range(0, len(joined), _TOGETHER)])
            size = pc.binary_length(pa.array(joined, pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.searchsorted(np.cumsum(self._bytes[ids], dtype=np.int64), np.cumsum(size)) + 1
            lens = np.diff(ends, prepend=0)
            return np.delete(ids, (ends - lens)[bare]), lens - bare
        ids = self._ids([_BETWEEN.join(["", *parts[i : i + _TOGETHER]]) for i in range(0, len(parts), _TOGETHER)])
        k = len(self._between)
        hit = np.ones(max(0, len(ids) - k + 1), bool)
        for j, x in enumerate(self._between.tolist()):
            hit &= ids[j : len(hit) + j] == x
        begins = np.flatnonzero(hit)
        lens = np.diff(np.append(begins, len(ids))) - k
        return np.delete(ids, (begins[:, None] + np.arange(k)).ravel()), lens

    def encode(self, texts: pa.Array):
        ids, counts, table = [], [], self._table
        for part in _slices(texts):
            words, number, lens = parts_of(part, self.spaced)
            # a comma or full stop after a letter is a piece by itself in both vocabularies
            tail = [w[-1] if w[-1:] in _MARKS and w[-2:-1].isalpha() else "" for w in words]
            rows = table.index([w[:-1] if t else w for w, t in zip(words, tail, strict=True)] + list(_MARKS))
            rows, marks = rows[: len(words)], dict(zip(_MARKS, rows[len(words) :].tolist(), strict=True))
            after = np.array([marks.get(t, -1) for t in tail], np.int64)
            if len(number):
                rows, after = rows[number], after[number]
            ends = np.cumsum(table.lens[rows] + np.where(after >= 0, table.lens[after], 0))
            both = np.repeat(rows, 1 + (after >= 0))
            both[(np.cumsum(1 + (after >= 0)) - 1)[after >= 0]] = after[after >= 0]
            ids.append(table.gather(both))
            ends, at = np.concatenate([[0], ends]), np.cumsum(lens)
            counts.append(ends[at] - ends[at - lens])
        none = np.empty(0, np.int64)
        return np.concatenate([np.empty(0, self.dtype), *ids]), np.concatenate([none, *counts])


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]
