"""Encoding with a public byte-level BPE vocabulary by a pair occurrence index.

A block of texts is cut into its distinct words. All words of the block stand in one symbol array; every pair of neighbours
that the vocabulary can merge is filed under its rank with all its positions. The lowest rank that has positions is merged
everywhere at once, and the pairs that this creates are filed in turn. A rank is thus applied once per block, whatever the
number of words, and one endless word costs no more than as many short ones.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Where the public vocabularies lie; a parameter of every function here.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: how this vocabulary family cuts text into words.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose words share one index, and distinct words remembered per task (both bound memory, not the result).
BLOCK_CHARS, KNOWN_WORDS = 4_000_000, 400_000


class PairIndexEncoder:
    """The ids of texts under a rank file (base64 token, rank per line)."""

    def __init__(self, path: str, pattern: str = WORD_PATTERN) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.words = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.known: dict[str, int] = {}
        self.values, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where it doesn't merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        # A separator (-1) stands before each word and at the end.
        n = int(sizes.sum()) + len(raw) + 1
        heads = np.concatenate([[0], np.cumsum(sizes + 1)])
        body = np.ones(n, bool)
        body[heads] = False
        sym = np.full(n, -1, np.int64)
        sym[body] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def file(at: np.ndarray) -> None:
            """Files the pairs that begin at these positions under their ranks."""
            rank = self._rank(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        file(np.arange(n - 1))
        while active:
            rank = heapq.heappop(active)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[sym[at] >= 0]  # a symbol swallowed by its left neighbour is -2
            at = at[self._rank(sym[at], sym[after[at]]) == rank]
            if len(at) > 1 and (touch := after[at[:-1]] == at[1:]).any():
                # Overlapping pairs merge from the left: every second one of a chain.
                link = np.concatenate([[False], touch])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(link, 0, place))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at], sym[gone] = rank, -2
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            file(np.unique(np.concatenate([left[sym[left] >= 0], at])))
        kept = sym[sym > -2]
        ends = np.flatnonzero(kept == -1)
        return kept[kept >= 0].astype(np.int32), np.diff(ends) - 1

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; null and empty texts have none."""
        if len(self.known) > KNOWN_WORDS:
            self.known, self.values, self.starts = {}, self.values[:0], self.starts[:1]
        known, fresh, places, counts = self.known, [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                words = self.words(text)
                counts[i] = len(words)
                for w in words:
                    k = known.get(w)
                    if k is None:
                        k = known[w] = len(known)
                        fresh.append(w)
                    places.append(k)
        if fresh:
            ids, sizes = self.merge(fresh)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.values = np.concatenate([self.values, ids])
        at = np.array(places, np.int64)
        size = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        flat = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(self.starts[at], size)
        word_ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.values[flat], np.diff(word_ends)


_ENCODERS: dict[tuple[str, str], PairIndexEncoder] = {}


def _encoder(path: str, pattern: str) -> PairIndexEncoder:
    """One encoder per Python worker and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = PairIndexEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in slices of about BLOCK_CHARS; a longer text is a slice of its own."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        until = (sizes[at - 1] if at else 0) + BLOCK_CHARS
        end = max(at + 1, int(np.searchsorted(sizes, until, "right")))
        yield texts.slice(at, end - at)
        at = end


def encode_tokens(
    df: DataFrame,
    text: str = "text",
    out: str = "ids",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    tokenizer_dir: str = TOKENIZER_DIR,
    pattern: str = WORD_PATTERN,
    count_only: bool = False,
) -> DataFrame:
    """df with a column `out`: the ids of `text` without special tokens (or, with count_only, their number).

    A null and an empty text both give an empty list (0). Special tokens' strings in a text are ordinary text. An existing
    column `out` is replaced; all other columns pass unchanged. It is a narrow operator: no shuffle, every row on its own.
    """
    path = os.path.join(tokenizer_dir, vocabulary)
    kind = T.LongType() if count_only else T.ArrayType(T.IntegerType(), False)

    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _encoder(path, pattern)
        for texts in column:
            ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for part in _blocks(texts):
                i, s = coder.encode(part.to_pylist())
                ids.append(i)
                sizes.append(s)
            all_sizes = np.concatenate(sizes)
            if count_only:
                yield pa.array(all_sizes)
            else:
                offsets = np.concatenate([[0], np.cumsum(all_sizes)]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))

    run.__annotations__ = {"column": Iterator[pa.Array], "return": Iterator[pa.Array]}  # types, not their names
    return df.withColumn(out, arrow_udf(run, kind)(F.col(text)))
