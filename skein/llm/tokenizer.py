"""Encoding of whole corpora with a public byte-level BPE tokenizer, by speculation and verification.

A text is split into words by the tokenizer's pattern. For each word not met before, greedy longest match proposes
tokens. A sequence of tokens is what merging gives exactly if every two neighbours are compatible, that is if merging
the bytes of the two gives the two again; this is tested for all adjacent pairs of all new words at once, by looking up
each distinct pair in a table that fills as pairs are met. Only words with a failing pair are merged exactly. Ids of
words are kept in arrays and gathered for a whole batch of texts at a time.

Defined results: null and empty texts give the empty list; strings that look like special tokens are ordinary text;
texts and words of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import spread

#: Folder of the vocabulary files on every machine; the files are never copied into the repository.
TOKENIZERS = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The public split pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: With this many words kept, or eight times as many tokens, the store starts anew; results do not depend on it.
KEPT_WORDS = 400_000
#: The same for pairs; so many new ones at least are sorted in at a time.
KEPT_PAIRS, RECENT_PAIRS = 4_000_000, 20_000
#: Texts encoded at a time.
BATCH = 256


class Encoder:
    """Encodes texts with one vocabulary; ``merges`` counts the words that needed exact merging."""

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> None:
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.merge = tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pattern_space = regex.compile(r"\s").match
        # longest token that starts with these three bytes; others have two bytes at most
        self.longest: dict[bytes, int] = {}
        for token in self.ranks:
            self.longest[token[:3]] = max(self.longest.get(token[:3], 2), len(token))
        self.words_seen = self.merges = 0
        self._forget()

    def _forget(self) -> None:
        self.pairs = np.empty(0, np.int64)  # codes of known pairs, sorted
        self.compatible = np.empty(0, bool)
        self.recent: dict[int, bool] = {}  # pairs met since they were last sorted in
        self.index: dict[str, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.sizes = np.zeros(1024, np.int64)
        self.tokens = np.zeros(4096, np.int32)
        self.used = 0

    def _propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ranks, longest, out, start, size = self.ranks.get, self.longest.get, [], 0, len(word)
        whole = ranks(word)
        if whole is not None:
            return [whole]
        while start < size:
            end = start + longest(word[start : start + 3], 2)
            if end > size:
                end = size
            token = ranks(word[start:end])
            while token is None:
                end -= 1
                token = ranks(word[start:end])
            out.append(token)
            start = end
        return out

    def _verify(self, codes: np.ndarray) -> np.ndarray:
        """Which of the pairs, as ``left << 32 | right``, are compatible."""
        unique, back = np.unique(codes, return_inverse=True)
        place = np.searchsorted(self.pairs, unique)
        place[place == len(self.pairs)] = 0
        known = self.pairs[place] == unique if len(self.pairs) else np.zeros(len(unique), bool)
        verdicts = np.zeros(len(unique), bool)
        verdicts[known] = self.compatible[place[known]]
        recent, merge, bytes_of = self.recent, self.merge, self.bytes_of
        for at in np.flatnonzero(~known).tolist():
            code = int(unique[at])
            verdict = recent.get(code)
            if verdict is None:
                left, right = code >> 32, code & 0xFFFFFFFF
                verdict = recent[code] = merge(bytes_of[left] + bytes_of[right]) == [left, right]
            verdicts[at] = verdict
        if len(recent) > RECENT_PAIRS + len(self.pairs) // 4:  # sorted in when they are many beside the table, so seldom
            fresh = np.fromiter(recent, np.int64, len(recent))
            order = np.argsort(fresh)
            fresh, held = fresh[order], np.fromiter(recent.values(), bool, len(recent))[order]
            at = np.searchsorted(self.pairs, fresh)
            self.pairs, self.compatible = np.insert(self.pairs, at, fresh), np.insert(self.compatible, at, held)
            recent.clear()
        return verdicts[back]

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """Ids of each word."""
        raw = [word.encode() for word in words]
        proposed = [self._propose(word) for word in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((token for tokens in proposed for token in tokens), np.int64, int(sizes.sum()))
        self.words_seen += len(words)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), sizes)
            inside = owner[1:] == owner[:-1]
            failing = ~self._verify((flat[:-1][inside] << 32) | flat[1:][inside])
            for number in np.unique(owner[1:][inside][failing]).tolist():
                proposed[number] = self.merge(raw[number])
                self.merges += 1
        return proposed

    def _learn(self, words: list[str]) -> None:
        found = self.encode_words(words)
        first = len(self.index)
        self.index.update(zip(words, range(first, first + len(words)), strict=True))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        while first + len(words) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + total > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
        self.sizes[first : first + len(words)] = sizes
        self.starts[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.tokens[self.used : self.used + total] = np.fromiter((x for y in found for x in y), np.int32, total)
        self.used += total

    def _codes(self, words: list[str]) -> np.ndarray:
        fresh = [x for x in set(words) if x not in self.index]
        if fresh:
            self._learn(fresh)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _tidy(self) -> None:
        if len(self.index) > KEPT_WORDS or self.used > 8 * KEPT_WORDS or len(self.pairs) > KEPT_PAIRS:
            self._forget()

    def _split(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """The words of all texts one after another, and the offsets of each text."""
        self._tidy()
        words: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                words += self.split(text)
            ends.append(len(words))
        return words, np.asarray(ends)

    def words_of(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words of all texts one after another, how many tokens each has, and the offsets of each text."""
        words, ends = self._split(texts)
        return words, self.sizes_of(words), ends

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each text."""
        words, ends = self._split(texts)
        if not words:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        codes = self._codes(words)
        sizes = self.sizes[codes]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        gather = np.repeat(self.starts[codes] - upto[:-1], sizes) + np.arange(upto[-1])
        return self.tokens[gather], upto[ends]

    def word_sizes(self, text: str) -> tuple[list[str], np.ndarray]:
        """The words of one text and how many tokens each has."""
        self._tidy()
        words = self.split(text)
        return words, self.sizes_of(words)

    def sizes_of(self, words: list[str]) -> np.ndarray:
        """How many tokens each word has."""
        codes = self._codes(words)  # may enlarge the arrays
        return self.sizes[codes]

    def count(self, text: str) -> int:
        return int(self.word_sizes(text)[1].sum())


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder per worker process and vocabulary; what it has learnt serves all later batches."""
    return Encoder(folder, vocabulary)


def encode_table(frame: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids`` for every row of ``frame``, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                ids, offsets = own.encode(batch["text"].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["key"], lists], ["key", "ids"])

    rows = frame.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return spread(rows, "key").mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", key)
