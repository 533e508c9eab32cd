"""Splitting of oversized texts at natural boundaries, with an overlap between pieces.

Every boundary between words has a strength: before a heading, after a paragraph, before a speaker's turn, after a line,
a sentence, a clause, a word. A sparse table over the strengths answers in constant time which boundary of a window is
strongest, the rightmost on a tie. A piece ends at the strongest boundary of the window that its size permits, and the
next one starts at the strongest boundary of the overlap window before that end.

Defined results: null and empty texts give no piece; texts within the limit (blank ones too) one; words longer than
``LONG_WORD`` tokens, such as texts without spaces, are cut between characters, not before combining marks or joiners,
and pieces that hold such cuts are encoded again to make sure of the limit. Positions count code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.tokenizer import BATCH, TOKENIZERS, VOCABULARY, Encoder, encoder
from skein.operators.skew import spread

#: Largest piece and largest overlap, in tokens.
LIMIT, OVERLAP = 1024, 64
#: A word of more tokens is divided into runs of up to LONG_RUN characters, of at most 4 bytes and so 4 tokens each.
LONG_WORD, LONG_RUN = 48, 4

#: Zero-width joiner and variation selectors.
JOINERS = "\u200d\ufe0e\ufe0f"

#: White space.
SPACES = np.asarray([x for x in range(0x3001) if chr(x).isspace()], np.uint32)

HEADING, PARAGRAPH, TURN, LINE, SENTENCE, CLAUSE, WORD, INSIDE, CHARACTER = 8, 7, 6, 5, 4, 3, 2, 1, 0

#: Where boundaries of each strength lie: the end of each match. Those of words lie on either side of white space.
RULES = (
    (CLAUSE, re.compile(r"[,;:](?=\s)|[，、；：]")),
    (SENTENCE, re.compile(r"(?:[.!?…](?=[\"'”’)\]]*(?:\s|$))|[。！？])[\"'”’)\]」』]*")),
    (LINE, re.compile(r"\r\n|[\n\r\u0085\u2028]")),
    (TURN, re.compile(r"(?:^|[\n\r])(?=[^\S\n\r]*[^\s:：|{\[\"][^\n\r:：]{0,23}[:：])")),
    (PARAGRAPH, re.compile(r"(?:\r\n|[\n\r])[^\S\n\r]*(?:\r\n|[\n\r])\s*|\u2029")),
    (HEADING, re.compile(r"(?:^|[\n\r])(?=[^\S\n\r]{0,3}#{1,6}\s)")),
)


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    tokens: int
    overlap: int
    strength: int


class RangeMaximum:
    """Sparse table: place of the largest value of a range of up to ``widest`` values, the rightmost of equal ones."""

    def __init__(self, values: np.ndarray, widest: int | None = None) -> None:
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= min(len(values), widest or len(values)):
            left, right = self.levels[-1][:-width], self.levels[-1][width:]
            self.levels.append(np.where(values[left] > values[right], left, right))
            width *= 2

    def query(self, first: int, last: int) -> int:
        """Of the places ``first`` to ``last``, both included."""
        level = (last - first + 1).bit_length() - 1
        left, right = int(self.levels[level][first]), int(self.levels[level][last - (1 << level) + 1])
        return left if self.values[left] > self.values[right] else right


def _extends(char: str) -> bool:
    """Whether the character belongs to the one before it."""
    return unicodedata.category(char) in ("Mn", "Me", "Mc") or char in JOINERS or "\U0001f3fb" <= char <= "\U0001f3ff"


def units(text: str, own: Encoder, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """From the words of ``text`` and their tokens: boundaries as positions, tokens up to each, and strengths; and whether long words were divided."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    upto = np.cumsum(sizes)
    cuts: list[np.ndarray] = []
    long = np.flatnonzero(sizes > LONG_WORD).tolist()
    if long:
        runs: list[str] = []
        for number in long:
            word, at = words[number], 0
            places = []
            while at < len(word):
                stop = min(len(word), at + LONG_RUN)
                while stop < len(word) and stop < at + 4 * LONG_RUN and (_extends(word[stop]) or word[stop - 1] == JOINERS[0]):
                    stop += 1
                runs.append(word[at:stop])
                places.append(stop)
                at = stop
            cuts.append(int(ends[number] - lengths[number]) + np.asarray(places))
        every = np.concatenate([np.delete(ends, long), *cuts])
        order = np.argsort(every, kind="stable")
        ends, upto = every[order], np.cumsum(np.concatenate([np.delete(sizes, long), own.sizes_of(runs)])[order])
    positions = np.concatenate([[0], ends])
    strengths = np.full(len(positions), INSIDE, np.int64)
    if cuts:
        strengths[np.searchsorted(positions, np.concatenate([x[:-1] for x in cuts]))] = CHARACTER
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = np.concatenate([[False], np.isin(points, SPACES), [False]])
    near = blank[positions] | blank[positions + 1]
    strengths[near] = np.maximum(strengths[near], WORD)
    for strength, rule in RULES:
        found = np.fromiter((x.end() for x in rule.finditer(text)), np.int64)
        if len(found):
            place = np.searchsorted(positions, found)
            place = place[place < len(positions)]
            strengths[place] = np.maximum(strengths[place], strength)
    return positions, np.concatenate([[0], upto]), strengths, bool(long)


def split_text(text: str, own: Encoder, limit: int = LIMIT, overlap: int = OVERLAP, words: list[str] | None = None, sizes: np.ndarray | None = None) -> list[Piece]:
    """The pieces of one text, each within ``limit`` tokens when encoded on its own; together they cover it."""
    if words is None or sizes is None:
        words, sizes = own.word_sizes(text)
    positions, upto, strengths, divided = units(text, own, words, sizes)
    last = len(positions) - 1
    table = RangeMaximum(strengths, limit + 1)  # a boundary is a token at least, so no window holds more
    blank = own.pattern_space

    def size(first: int, after: int) -> int:
        """Tokens of the text between two boundaries when it is encoded on its own."""
        if divided:
            return own.count(text[positions[first] : positions[after]])
        at, run = int(positions[after]), 0
        while run < at - positions[first] and blank(text[at - run - 1]):
            run += 1
        if run < 2:
            return int(upto[after] - upto[first])
        # blanks at the end of a text are one word, before others they are two
        before = int(np.searchsorted(positions, at - run))
        return int(upto[before] - upto[first]) + len(own.encode_words([text[at - run : at]])[0])

    pieces: list[Piece] = []
    start = repeated = 0
    while True:
        room = limit
        while True:
            if upto[last] - upto[start] <= room:
                end = last
            else:
                high = int(np.searchsorted(upto, upto[start] + room, side="right")) - 1
                low = int(np.searchsorted(upto, upto[start] + max(room // 2, overlap + 1)))
                end = table.query(min(max(low, start + 1), max(high, start + 1)), max(high, start + 1))
            tokens = size(start, end)
            if tokens <= limit or end == start + 1:
                break
            room -= max(8, tokens - limit)
        pieces.append(Piece(int(positions[start]), int(positions[end]), tokens, repeated, int(strengths[end])))
        if end == last:
            return pieces
        reach = overlap
        while True:
            first = max(start + 1, int(np.searchsorted(upto, upto[end] - reach)))
            begin = table.query(min(first, end - 1), end - 1)
            repeated = size(begin, end)
            if repeated <= overlap or begin == end - 1:
                break
            reach -= max(4, repeated - overlap)
        start = begin


def split_table(frame: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Numbered pieces of every text: ``key, piece, start, end, tokens, overlap, strength`` and, if asked for, ``text``.

    One pass without a shuffle. A text is handled whole by one task, as its tokens depend on one another. The limit must
    leave room for what is not divided, and the overlap for a step forward.
    """
    if limit < 2 * LONG_WORD or not 0 < overlap <= limit // 2:
        raise ValueError(f"the limit must be at least {2 * LONG_WORD} tokens and the overlap between 1 and half of it")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH):
                batch = whole.slice(first, BATCH)
                texts = batch["text"].to_pylist()
                words, each, ends = own.words_of(texts)
                upto = np.concatenate([[0], np.cumsum(each)])
                rows: list[tuple[int, int, Piece]] = []
                bodies: list[str] = []
                for name, body, begin, end in zip(batch["key"].to_pylist(), texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if not body:
                        continue
                    size = int(upto[end] - upto[begin])
                    pieces = split_text(body, own, limit, overlap, words[begin:end], each[begin:end]) if size > limit else [Piece(0, len(body), size, 0, HEADING)]
                    rows += [(name, number, piece) for number, piece in enumerate(pieces)]
                    if with_text:
                        bodies += [body[piece.start : piece.end] for piece in pieces]
                columns = [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int32())]
                columns += [pa.array([getattr(x[2], y) for x in rows], pa.int32()) for y in ("start", "end", "tokens", "overlap", "strength")]
                names = ["key", "piece", "start", "end", "tokens", "overlap", "strength"]
                if with_text:
                    columns.append(pa.array(bodies, pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "key long, piece int, start int, end int, tokens int, overlap int, strength int" + ", text string" * with_text
    rows = frame.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    return spread(rows, "key").mapInArrow(run, schema).withColumnRenamed("key", key)
