"""Evaluation texts that stand, whole or in part, inside training texts.

Texts are reduced to letters and digits in one case and width. For an item of m characters a passage counts when it holds
at least ``SHARE`` of them, and ``LEAST`` where that is more. By the q-gram lemma a passage of L characters with ``blocks`` edited places of ``edited``
characters altogether keeps at least L - q + 1 - blocks * (q - 1) - edited of its q-grams, on diagonals that are no
farther apart than the edited characters. So shared q-grams are counted per item in overlapping bands of diagonals, wide enough for the edits of a
passage of that item; every band that reaches the bound is verified by a banded local alignment, and an item has leaked
when the aligned characters reach the share.

The items are the bounded side (their number is checked); they are indexed once per worker, and every text is searched
whole, in one pass without a shuffle. More than ``ITEMS`` items or ``ITEM_CHARS`` characters are searched in blocks.

Defined results: null and empty texts or items give no row; repeated items of one id are searched each, and a pair is
given once; texts of any length are searched whole; rows without an id are left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import spread

#: Share of an item that one passage must hold, and the share of it that must align after edits.
SHARE, ALIGNED = 0.4, 0.37
#: Least score of the alignment as a share of what its matched characters alone would score: one passage, not scattered phrases.
DENSITY = 0.6
#: Letters and digits that a passage must have; of a shorter item all of it.
LEAST = 12
#: Length of q-grams for texts in wide characters and in alphabets.
Q_WIDE, Q_NARROW = 5, 16
#: Edited places that a passage may have, per 100 of its characters and at least, and edited characters as a share.
BLOCKS_PER_100, BLOCKS_LEAST, EDITED = 3.0, 4, 0.2
#: Least width of a band of diagonals; bands overlap by half, so a drift of half the width lies inside one.
BAND = 192
#: Keys of bands: their numbers are shifted to be positive, and a text and an item have so many bands at most.
SHIFT, SPANS = 1 << 24, 1 << 32
#: Items, and characters of items, searched in one pass.
ITEMS, ITEM_CHARS = 5000, 4_000_000
#: Texts, and characters of texts, searched at a time; a longer text is searched alone.
BATCH, BATCH_CHARS = 1024, 2_000_000

_SKIPPED = regex.compile(r"[^\p{L}\p{N}]+")
_SKIPPED_ASCII = bytes(x for x in range(128) if not chr(x).isalnum())
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def reduced(text: str) -> str:
    """Letters and digits of ``text`` in one case and width."""
    if text.isascii():
        return text.lower().encode().translate(None, _SKIPPED_ASCII).decode()
    return _SKIPPED.sub("", unicodedata.normalize("NFKC", text).lower())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling: those of 2k characters come from two of k."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    have, width = (points.astype(np.uint64) + np.uint64(1)) * _FACTOR, 1
    have ^= have >> np.uint64(29)
    done: np.ndarray | None = None
    used, rest = 0, q
    while rest:
        if rest & 1:
            done = have.copy() if done is None else (done[: len(points) - used - width + 1] * _FACTOR) ^ (have[used : used + len(points) - used - width + 1])
            used += width
        rest >>= 1
        if rest:
            have = (have[:-width] * _FACTOR) ^ have[width:]
            have ^= have >> np.uint64(31)
            width *= 2
    assert done is not None
    return done[: len(points) - q + 1]


@dataclass(frozen=True)
class Item:
    name: int
    points: np.ndarray
    q: int
    needed: int
    band: int
    aligned: float


def item_of(name: int, text: str) -> Item | None:
    """An item made ready for search, or None if nothing of it is left."""
    plain = reduced(text)
    if not plain:
        return None
    wide = len(_WIDE.findall(plain)) * 2 > len(plain)
    q = Q_WIDE if wide else Q_NARROW
    passage = max(SHARE * len(plain), min(len(plain), LEAST))
    edited = EDITED * passage
    blocks = min(max(BLOCKS_LEAST, BLOCKS_PER_100 * passage / 100), edited)  # each place has at least one edited character

    def bound() -> int:
        return int(passage - q + 1 - blocks * (q - 1) - edited)

    while q > 2 and bound() < 4:  # short items: a smaller q keeps the bound positive
        q -= 1
    band = BAND
    while band < 2 * edited:  # few widths, as items of one width are aligned together
        band *= 2
    return Item(name, codes(plain), q, max(1, bound()), band, ALIGNED / SHARE * passage / len(plain))


class Index:
    """Q-grams of all items, sorted, with a bit table in front that turns away nearly all q-grams of a text."""

    BITS = 22

    def __init__(self, items: Sequence[tuple[int, str]]) -> None:
        self.items = [x for x in (item_of(*item) for item in items if item[1]) if x is not None]
        self.needed = np.fromiter((x.needed for x in self.items), np.int64)
        self.halves = np.fromiter((x.band // 2 for x in self.items), np.int64)
        self.by_q: dict[int, tuple[np.ndarray, ...]] = {}
        for q in sorted({x.q for x in self.items}):
            hashes, owners, places = [], [], []
            for number, item in enumerate(self.items):
                if item.q == q:
                    own = grams(item.points, q)
                    hashes.append(own)
                    owners.append(np.full(len(own), number, np.int64))
                    places.append(np.arange(len(own)))
            every, owner, place = np.concatenate(hashes), np.concatenate(owners), np.concatenate(places)
            order = np.argsort(every, kind="stable")
            table = np.zeros(1 << self.BITS, bool)
            table[every >> np.uint64(64 - self.BITS)] = True
            grams_, begin, counts = np.unique(every[order], return_index=True, return_counts=True)
            self.by_q[q] = grams_, begin, counts, owner[order], place[order], table

    def candidates(self, points: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """``(text, item, first diagonal)`` of the bands that reach the bound, each laid around its hits.

        Every two cells of half a band form a band. Bands with the same hits are given once: that is every band with hits
        in one cell only, as these lie in one of its neighbours as well.
        ``points`` are all texts of a batch one after another, each followed by a 0, and ``starts`` where they begin;
        diagonals count from the start of their text.
        """
        found: list[tuple[int, int, int]] = []
        texts = len(starts)
        for q, (every, begin, counts, owner, place, table) in self.by_q.items():
            own = grams(points, q)
            at = np.flatnonzero(table[own >> np.uint64(64 - self.BITS)])
            gram = np.searchsorted(every, own[at])
            gram[gram == len(every)] = 0
            same = every[gram] == own[at]
            at, gram = at[same], gram[same]
            count = counts[gram]
            total = int(count.sum())
            if not total:
                continue
            here = np.repeat(at, count)
            entry = np.repeat(begin[gram] - np.cumsum(count) + count, count) + np.arange(total)
            text = np.searchsorted(starts, here, side="right") - 1
            # no band of a text and an item has more hits than the two have in all
            pair = text * len(self.items) + owner[entry]
            enough = (np.bincount(pair, minlength=texts * len(self.items)).reshape(texts, -1) >= self.needed).ravel()[pair]
            here, entry, text = here[enough], entry[enough], text[enough]
            if not len(here):
                continue
            diagonal = here - starts[text] - place[entry]
            cell = (text * len(self.items) + owner[entry]) * SPANS + diagonal // self.halves[owner[entry]] + SHIFT
            order = np.argsort(cell, kind="stable")
            cells, begins, hits = np.unique(cell[order], return_index=True, return_counts=True)
            low, high = np.minimum.reduceat(diagonal[order], begins), np.maximum.reduceat(diagonal[order], begins)
            # a band is two cells side by side; one whose other cell is empty lies in the band on its other side, if that has hits
            beside = cells[1:] == cells[:-1] + 1
            first = np.concatenate([np.flatnonzero(beside), np.flatnonzero(~np.concatenate([[False], beside]) & ~np.concatenate([beside, [False]]))])
            last = first.copy()
            last[: int(beside.sum())] += 1
            item = cells[first] // SPANS % len(self.items)
            good = np.where(first == last, hits[first], hits[first] + hits[last]) >= self.needed[item]
            middle = (np.minimum(low[first], low[last]) + np.maximum(high[first], high[last])) // 2
            pair = cells[first] // SPANS
            found += zip((pair // len(self.items))[good].tolist(), item[good].tolist(), (middle - self.halves[item])[good].tolist(), strict=True)
        return found


#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -3, -2


def align(jobs: Sequence[tuple[np.ndarray, np.ndarray, int]], width: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """Of each job the best local alignment within its band: its matched characters, and its score.

    A job is the item, the text and the first diagonal of its band of ``width``. All jobs advance together, one item character a
    step, as rows of matrices over the band: scores, and the matched characters on the best path to each cell.
    """
    longest = max(len(item) for item, _, _ in jobs)
    items = np.zeros((len(jobs), longest), np.uint32)
    texts = np.zeros((len(jobs), longest + width), np.uint32)
    for row, (item, text, first) in enumerate(jobs):
        items[row, : len(item)] = item
        start, stop = max(0, first), min(len(text), first + len(item) + width)
        if stop > start:
            texts[row, start - first : stop - first] = text[start:stop]
    items[items == 0] = 0xFFFFFFFF
    # a cell packs score and matched characters, so one maximum keeps both
    kind, unit = (np.int32, 1 << 12) if longest < 4096 else (np.int64, 1 << 30)
    hit, miss, gap = kind(MATCH * unit + 1), kind(MISMATCH * unit), kind(GAP * unit)
    row = np.zeros((len(jobs), width), kind)
    best = np.zeros(len(jobs), kind)
    ramp = (np.arange(width, dtype=kind) * -gap)[None, :]
    for step in range(longest):
        same = texts[:, step : step + width] == items[:, step : step + 1]
        # diagonal move stays in the column; from above comes from one column to the right
        fresh = row + np.where(same, hit, miss)
        fresh[:, :-1] = np.maximum(fresh[:, :-1], row[:, 1:] + gap)
        np.maximum(fresh, 0, out=fresh)
        # moves to the right in this row: running maximum of cell + column * |gap|
        fresh += ramp
        np.maximum.accumulate(fresh, axis=1, out=fresh)
        fresh -= ramp
        fresh[fresh < unit] = 0
        row = fresh
        np.maximum(best, row.max(axis=1), out=best)
    return best & (unit - 1), best // unit


def passes(share: float, density: float, aligned: float = ALIGNED) -> bool:
    """Whether one alignment holds enough of its item, and densely enough."""
    return share >= aligned and density >= DENSITY


def search(index: Index, texts: Sequence[str | None]) -> list[tuple[int, int, float, float, bool]]:
    """``(number of the text, item id, share of the item aligned, density, whether it passes)`` of everything verified, one band each.

    Density is the score of the alignment as a share of that of its matched characters without any edit. A band that
    passes both tests goes before any that does not, then the larger share.
    """
    plain = [codes(reduced(text) + "\0") if text else np.zeros(1, np.uint32) for text in texts]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    starts = np.cumsum(sizes) - sizes
    jobs = index.candidates(np.concatenate(plain), starts)
    best: dict[tuple[int, int], tuple[bool, float, float]] = {}
    for width in sorted({index.items[item].band for _, item, _ in jobs}):
        alike = sorted((x for x in jobs if index.items[x[1]].band == width), key=lambda x: len(index.items[x[1]].points))
        at_once = max(1, 64 * BAND // width)
        for first in range(0, len(alike), at_once):
            part = alike[first : first + at_once]
            matched, scores = align([(index.items[item].points, plain[text], diagonal) for text, item, diagonal in part], width)
            for (text, item, _), chars, score in zip(part, matched.tolist(), scores.tolist(), strict=True):
                if chars:
                    share, density = chars / len(index.items[item].points), score / (MATCH * chars)
                    best[text, item] = max(best.get((text, item), (False, 0.0, 0.0)), (passes(share, density, index.items[item].aligned), share, density))
    return [(text, index.items[item].name, share, density, good) for (text, item), (good, share, density) in best.items()]


@lru_cache(maxsize=2)
def _index(items: tuple[tuple[int, str], ...]) -> Index:
    return Index(items)


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", per_pass: int = ITEMS) -> DataFrame:
    """``doc_id, item_id, share`` of every document that holds a passage of an item.

    ``items`` is the bounded side: blocks of at most about ``per_pass`` items and ``ITEM_CHARS`` characters are read to
    the driver and sent to the workers, and each block is searched in one pass over the documents.
    """
    held = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.col("i").isNotNull() & (F.length("t") > 0)).distinct()
    rows = documents.select(F.col(doc_id).cast("long").alias("key"), F.col(doc_text).alias("text")).where(F.col("key").isNotNull() & (F.length("text") > 0))
    size = held.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.items // per_pass), -(-size.chars // ITEM_CHARS))
    parts = []
    for number in range(blocks):
        mine = held if blocks == 1 else held.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == number)
        parts.append(_search_table(rows, tuple(sorted((row.i, row.t) for row in mine.collect()))))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("key", "item").agg(F.max("share").alias("share")).select(F.col("key").alias(doc_id), F.col("item").alias(item_id), "share")


def _slices(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Where to cut a list of texts so that no part has more than ``BATCH`` of them or, but for a single text, ``BATCH_CHARS`` characters."""
    first = chars = 0
    for at, text in enumerate(texts):
        size = len(text or "")
        if at > first and (at - first >= BATCH or chars + size > BATCH_CHARS):
            yield first, at
            first, chars = at, 0
        chars += size
    if first < len(texts):
        yield first, len(texts)


def _search_table(rows: DataFrame, items: tuple[tuple[int, str], ...]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared.value)
        for whole in batches:
            names, texts = whole["key"].to_pylist(), whole["text"].to_pylist()
            for first, last in _slices(texts):
                found = [(names[first + text], item, share) for text, item, share, _, good in search(index, texts[first:last]) if good] if index.items else []
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["key", "item", "share"])

    return spread(rows, "key").mapInArrow(run, "key long, item long, share double")
