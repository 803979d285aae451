"""Token counts by heap-and-linked-list byte-pair merging; no ids are made.

A piece starts as its bytes, in a doubly linked list. A heap holds every adjacent pair that the
vocabulary merges, by rank and then place; the lowest is popped and merged until none is left. The
count is bytes minus merges. Pieces come from the vocabulary's own pattern; distinct words and pieces
are counted once a worker. A special string in a text is one token, as in the library's default.

Nulls: a null text is empty (0 bytes, 0 tokens). Every row gives one row; repeated rows each. Other
columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .token_cache import MOST_PARTS, PartTable, _slices, parts_of

#: The pattern of the byte-level vocabularies.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is visible,
    else the next one from U+0100 on."""
    seen = {b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in seen else extra))
        extra += b not in seen
    return out


class MergeCounter:
    """Counts for a byte-level byte-pair vocabulary in a tokenizers .json file."""

    def __init__(self, path: str, most: int = MOST_PARTS):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        self._byte = [vocab[c] for c in _byte_letters()]
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        special = [t["content"] for t in file["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._pieces = regex.compile(_PIECES).findall
        self._known: dict[str, int] = {}
        self._most = most
        self.table = PartTable(self._of_parts, np.int64, most)

    def merges(self, symbols: list[int]) -> int:
        """How many merges these symbols allow."""
        merge, n = self._merge, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merge.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has gone into another symbol
            symbols[i], symbols[j] = made, -1
            done += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((made, symbols[k])):
                    heapq.heappush(heap, (m[0], i, m[1], made, symbols[k]))
            h = before[i]
            if h >= 0 and (m := merge.get((symbols[h], made))):
                heapq.heappush(heap, (m[0], h, m[1], symbols[h], made))
        return done

    def _piece(self, piece: str) -> int:
        got = self._known.get(piece)
        if got is None:
            if len(self._known) >= self._most:
                self._known.clear()
            raw = piece.encode()
            got = self._known[piece] = len(raw) - self.merges([self._byte[b] for b in raw])
        return got

    def count(self, text: str) -> int:
        total = 0
        if self._special:
            texts = self._special.split(text)
            total = len(texts) - 1
        else:
            texts = [text]
        return total + sum(self._piece(p) for t in texts for p in self._pieces(t))

    def _of_parts(self, parts: list[str]):
        return np.fromiter(map(self.count, parts), np.int64, len(parts)), np.ones(len(parts), np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        out = [np.empty(0, np.int64)]
        for some in _slices(texts):
            words, number, lens = parts_of(some, spaced=True)
            rows = self.table.index(words)
            got = self.table.gather(rows)[number] if words else number
            ends, at = np.concatenate([[0], np.cumsum(got)]), np.cumsum(lens)
            out.append(ends[at] - ends[at - lens])
        return np.concatenate(out)


_counters: dict[str, MergeCounter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of docs (doc_id, text). No shuffle."""

    def run(batches):
        if tokenizer not in _counters:
            _counters[tokenizer] = MergeCounter(tokenizer)
        for batch in batches:
            n = _counters[tokenizer].counts(batch.column(1))
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
