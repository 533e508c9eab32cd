"""Cutting text for speech: chunks of at most 600 bytes of UTF-8.

Chunks alternate between two rules, both counted in UTF-16 units. The first takes up to 400 units, less in steps of ten
until the bytes fit, and prefers to end after the last mark of punctuation. The second, tried after each chunk of the
first, takes as many units as fit into 600 bytes and cuts wherever that is; where all the rest fits it takes nothing and
the first rule goes on. A pair of surrogates is never cut apart. Null and empty texts give no chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import spread

#: Units and bytes of a chunk, the step back, and the marks that end one (fixed values).
UNITS, BYTES, STEP = 400, 600, 10
MARKS = "。！？；,.!?;"


def chunks(text: str | None) -> list[str]:
    """The chunks of one text."""
    if not text:
        return []
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    wide = np.concatenate([[0], np.cumsum(np.where(points > 0xFFFF, 2, 1))])
    weight = np.concatenate([[0], np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))])
    marks = np.flatnonzero(np.isin(points, [ord(x) for x in MARKS]))
    size, start, out = len(points), 0, []

    def place(unit: int) -> int:
        return int(np.searchsorted(wide, unit, side="right")) - 1

    while start < size:
        unit = min(int(wide[start]) + UNITS, int(wide[size]))
        end = place(unit)
        while end > start and weight[end] - weight[start] > BYTES:
            unit -= STEP
            end = place(unit)
        if end > start:
            if end < size:
                last = int(np.searchsorted(marks, end)) - 1
                if last >= 0 and marks[last] > start:
                    end = int(marks[last]) + 1
            out.append(text[start:end])
            start = end
        fit = int(np.searchsorted(weight, weight[start] + BYTES, side="right")) - 1
        if fit < size:
            out.append(text[start:fit])
            start = fit
    return out


def chunk_table(frame: DataFrame, key: str, text: str) -> DataFrame:
    """``key, position, chunk`` of every text, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, parts = [], [], []
            for name, body in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = chunks(body)
                keys += [name] * len(found)
                places += range(len(found))
                parts += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(parts, pa.string())], ["key", "position", "chunk"])

    rows = frame.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return spread(rows, "key").mapInArrow(run, "key long, position int, chunk string").withColumnRenamed("key", key)
