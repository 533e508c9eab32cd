"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tasks_of(spark: SparkSession) -> int:
    """How many tasks a shuffle is meant to have: the larger of the shuffle partitions and the cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def hot_keys(columns: Mapping[str, tuple[DataFrame, str]], tasks: int | None = None) -> dict[str, list[tuple[Any, int]]]:
    """Per name the hot values of its column, and into how many groups the rows of each should be split.

    A key is hot when it holds more rows than a task has on average, so by arithmetic fewer keys are hot than there are
    tasks, whatever the size of the table; it is split into so many groups that each has no more than that. All columns
    are measured in one job, with counts combined before the shuffle.
    """
    parts = []
    for name, (frame, column) in columns.items():
        share = tasks or tasks_of(frame.sparkSession)
        total = frame.agg(F.count(F.lit(1))).scalar()
        counts = frame.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("rows")).withColumn("total", total)
        groups = F.ceil(F.col("rows") * share / F.col("total")).cast("int")
        parts.append(counts.where(F.col("rows") * share > F.col("total")).select(F.lit(name).alias("name"), F.to_json(F.struct("key")).alias("key"), groups.alias("groups")))
    found: dict[str, list[tuple[Any, int]]] = {name: [] for name in columns}
    for row in reduce(DataFrame.unionByName, parts).collect():
        found[row.name].append((row.key, row.groups))
    return found


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread: str, hot: Sequence[tuple[Any, int]], how: str = "left") -> DataFrame:
    """Equi-join in which the rows of hot left keys, as ``hot_keys`` gives them, are spread over groups.

    ``spread`` names the left column whose hash picks the group; the right rows of hot keys (``right_key`` is unique
    there) are repeated once per group, those of other keys stay single. As the groups of all hot keys are at most twice
    as many as tasks, so are the rows added. The table of hot keys is broadcast; it has fewer rows than there are tasks.
    Null keys match nothing, as in SQL. The result has the columns of both sides; the names must not clash.
    """
    if not hot:
        return left.join(right, left[left_key] == right[right_key], how)
    table = left.sparkSession.createDataFrame(list(hot), "__json string, __groups int")
    table = F.broadcast(table.select(F.from_json("__json", T.StructType([T.StructField("key", left.schema[left_key].dataType)]))["key"].alias("__hot"), "__groups"))
    left = left.join(table, F.col(left_key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(spread), F.coalesce("__groups", F.lit(1))).cast("int")).drop("__hot", "__groups")
    right = right.join(table, F.col(right_key) == F.col("__hot"), "left").withColumn("__group", F.explode(F.sequence(F.lit(0), F.coalesce("__groups", F.lit(1)) - 1))).drop("__hot", "__groups")
    return left.join(right, (F.col(left_key) == F.col(right_key)) & (F.col("__salt") == F.col("__group")), how).drop("__salt", "__group")


def spread(frame: DataFrame, key: str) -> DataFrame:
    """``frame`` over all cores where its files give less than half as many parts as there are cores.

    For work that costs far more than moving the rows, on few or small files. Rows go by the hash of ``key``, so a
    repeated task sees the same rows. Larger inputs have more parts than cores and are left as they are. Meant for
    frames read from files: a frame that needs a shuffle would be run to count its parts.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores, key) if frame.rdd.getNumPartitions() * 2 < cores else frame
