"""Events as a stream: the state of each node of each run, kept up to date, and sinks that survive a retry.

Watermarks are an addition of this engine; the folds themselves equal those of ``skein.operators.events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """New files of a folder of Parquet events as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def latest_by_key(events: DataFrame, keys: list[str], seq: list[str], value: str) -> DataFrame:
    """The value of the last event of each key so far; run it in update or complete mode."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*seq)).alias(value), F.count(F.lit(1)).alias("events"))


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per key and tumbling window; later events than the watermark allows are left out, so state is bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *keys).agg(F.count(F.lit(1)).alias("events"))


def write_batches(stream: DataFrame, checkpoint: str, save: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Run a stream over what is there and hand each batch with its number to ``save``, which must be idempotent by number."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
