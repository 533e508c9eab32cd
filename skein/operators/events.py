"""Folds over execution events and node results.

Rows of one run are ordered by an explicit number, never by time; ties cannot occur there. Null results count as not
successful.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Status that an event gives its node (fixed values).
STATUS_OF = {"NODE_START": "RUNNING", "NODE_PROGRESS": "RUNNING", "NODE_SUCCESS": "SUCCESS", "NODE_ERROR": "ERROR"}
#: Events after which a run has ended.
TERMINAL = ("WORKFLOW_COMPLETE", "ERROR")


def latest(events: DataFrame, keys: list[str], seq: Column, *values: str) -> DataFrame:
    """Per key the values of its last event and the number of its first one; partial results are combined before the shuffle."""
    row = F.struct(*values) if len(values) > 1 else F.col(values[0])
    folded = events.groupBy(*keys).agg(F.max_by(row, seq).alias("last"), F.min(seq).alias("first_seen"), F.count(F.lit(1)).alias("events"))
    picked = [F.col(f"last.{x}").alias(x) for x in values] if len(values) > 1 else [F.col("last").alias(values[0])]
    return folded.select(*keys, *picked, "first_seen", "events")


def node_states(events: DataFrame, run: str = "run_id") -> DataFrame:
    """State of each node of each run after its last event: ``run, node_id, status, data, position``."""
    table = F.create_map(*(F.lit(x) for pair in STATUS_OF.items() for x in pair))
    known = events.where(F.col("event_type").isin(*STATUS_OF)).withColumn("status", F.element_at(table, F.col("event_type")))
    return latest(known, [run, "node_id"], F.col("seq"), "status", "data").withColumnRenamed("first_seen", "position")


def ended_runs(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs that have had a terminal event."""
    return events.where(F.col("event_type").isin(*TERMINAL)).select(run).distinct()


def progress(rows: DataFrame, keys: list[str], success: Column) -> DataFrame:
    """Per key the percentage of successes, rounded half up; partial sums are combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(success).alias("done")).withColumn("percent", F.floor(F.lit(100) * F.col("done") / F.col("total") + 0.5).cast("int"))


def accumulated(chunks: DataFrame, keys: list[str], seq: str, text: str, into: str = "accumulated") -> DataFrame:
    """Each chunk with the text up to it, as its listener gets it.

    The result itself takes the square of a stream's chunks, and one task handles a key: meant for streams of one answer
    each. ``final_text`` gives only the whole text of each key.
    """
    over = W.partitionBy(*keys).orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    return chunks.withColumn(into, F.array_join(F.collect_list(text).over(over), ""))


def final_text(chunks: DataFrame, keys: list[str], seq: str, text: str, into: str = "accumulated") -> DataFrame:
    """Per key the whole text of its chunks in order; each chunk is kept once."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(text).alias("text"))))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "").alias(into))


def collected(results: DataFrame, keys: list[str], position: str, *values: str, into: str = "results") -> DataFrame:
    """Per key its results as an array in the order of ``position``."""
    listed = F.array_sort(F.collect_list(F.struct(position, *values)))
    return results.groupBy(*keys).agg(F.transform(listed, lambda x: F.struct(*(x[y].alias(y) for y in values))).alias(into))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from one timestamp to another, as a long, which no span overflows; null if either is null."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def node_results(records: DataFrame, key: str = "id", text: str = "node_results") -> DataFrame:
    """Flat node results of execution records: ``key, position, node_id, status, duration``; broken texts give none, one object counts as a list."""
    shape = "array<struct<nodeId:string,nodeName:string,status:string,input:string,output:string,duration:int,error:string>>"
    plain = F.when(F.trim(F.col(text)).startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), F.col(text), F.lit("}")), "$.x")).otherwise(F.col(text))
    listed = F.when(F.trim(plain).startswith("{"), F.concat(F.lit("["), plain, F.lit("]"))).otherwise(plain)
    rows = records.select(key, F.posexplode(F.from_json(listed, shape)).alias("position", "r")).where(F.col("r").isNotNull())
    return rows.select(key, "position", F.col("r.nodeId").alias("node_id"), F.col("r.status").alias("status"), F.col("r.duration").alias("duration"))


def chunk_progress(chunks: DataFrame, run: str, position: str = "position", text: str = "chunk") -> DataFrame:
    """Progress events of speech: per chunk its begin, with the first 50 characters, and its end.

    The number of an event follows from the place of its chunk, so the order does not depend on which chunk ends first.
    """
    chunks = chunks.withColumn("__total", F.count(F.lit(1)).over(W.partitionBy(run)))
    total = F.col("__total")
    begin = F.struct(total.alias("totalChunks"), (F.col(position) + 1).alias("currentChunk"), F.concat(F.substring(text, 1, 50), F.lit("...")).alias("chunkText"))
    end = F.struct(total.alias("totalChunks"), (F.col(position) + 1).alias("currentChunk"), (F.col(position) + 1).alias("completedChunks"))
    both = chunks.select(run, position, F.explode(F.array(F.struct(F.lit(0).alias("part"), F.to_json(begin).alias("data")), F.struct(F.lit(1).alias("part"), F.to_json(end).alias("data")))).alias("e"))
    return both.select(run, (F.col(position) * 2 + F.col("e.part")).alias("seq"), F.lit("NODE_PROGRESS").alias("event_type"), F.col("e.data").alias("data"))
