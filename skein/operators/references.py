"""References to records that do not exist: direct orphans, and those inherited down the foreign-key graph.

Defined results: a null reference is no orphan; a row without an id cannot be reported and is left out; repeated rows
of an id give one result, the first reason in the order missing, deleted, later and its first period; of a target's rows
the one with the latest ``updated_at`` (null sorts first; on a tie the deleted row) is current; a target was created at
the latest ``created_at`` of its rows; null times are never later; a null time gives the period ''. Only the named columns are read, so further columns of any name do no harm. Empty tables give
either no rows or, as targets, only missing ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import hot_keys, salted_join
from skein.session import checkpointed

REASONS = ("missing", "deleted", "later")
COLUMNS = ("ref", "id", "reason", "period", "kind", "depth")
#: More than any month as a number.
_MONTHS = 2**40


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent.id``; ``time`` is the child's column that dates the reference."""

    child: str
    column: str
    parent: str
    time: str

    @property
    def ref(self) -> str:
        return f"{self.child}.{self.column}"


def _month(column: str) -> F.Column:
    """Year and month as a number that sorts like them, 0 for null."""
    return F.coalesce(F.year(column) * 100 + F.month(column), F.lit(0)).cast("long")


def _period(month: F.Column) -> F.Column:
    digits = F.lpad(month.cast("string"), 6, "0")
    return F.when(month == 0, "").otherwise(F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2)))


def target_states(parent: DataFrame) -> DataFrame:
    """Per id of a referred table: whether its current row is deleted, and when it was created.

    Deleted means that no row is later than the latest deleted one. All buffers are plain numbers, so this stays a hash
    aggregate with partial results before the shuffle.
    """
    gone = F.coalesce(F.col("deleted"), F.lit(0)) == 1
    states = parent.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("__target")).agg(F.max("updated_at").alias("at"), F.max(F.when(gone, F.col("updated_at"))).alias("gone_at"), F.max(gone).alias("any_gone"), F.max("created_at").alias("__born"))
    return states.select("__target", (F.col("any_gone") & F.col("at").eqNullSafe(F.col("gone_at"))).alias("__gone"), "__born")


def direct_orphans(child: DataFrame, parent: DataFrame, key: ForeignKey, hot: Sequence[tuple[Any, int]]) -> DataFrame:
    """Rows ``(id, reason, period)`` of ``child`` whose own reference fails, once per id."""
    refs = child.select(F.col("id").alias("__id"), F.col(key.column).alias("__key"), F.col(key.time).alias("__time")).where(F.col("__id").isNotNull() & F.col("__key").isNotNull())
    joined = salted_join(refs, target_states(parent), "__key", "__target", "__id", hot)
    rank = F.when(F.col("__target").isNull(), 0).when(F.col("__gone"), 1).when(F.col("__born") > F.col("__time"), 2)
    found = joined.select("__id", rank.alias("__rank"), _month("__time").alias("__month")).where(F.col("__rank").isNotNull())
    # reason and month as one number, so that the first of an id's rows is a plain minimum
    first = found.groupBy("__id").agg(F.min(F.col("__rank") * F.lit(_MONTHS) + F.col("__month")).alias("row"))
    return first.select(F.col("__id").alias("id"), F.element_at(F.array(*map(F.lit, REASONS)), (F.expr(f"row div {_MONTHS}L") + 1).cast("int")).alias("reason"), _period(F.col("row") % F.lit(_MONTHS)).alias("period"))


def _depth(keys: Sequence[ForeignKey]) -> int | None:
    """Length of the longest path of foreign keys, or None where they form a cycle."""
    parents: dict[str, set[str]] = {}
    for key in keys:
        parents.setdefault(key.child, set()).add(key.parent)

    def walk(table: str, seen: tuple[str, ...]) -> int:
        if table in seen:
            raise RecursionError
        return max((1 + walk(parent, (*seen, table)) for parent in parents.get(table, ())), default=0)

    try:
        return max((walk(table, ()) for table in parents), default=0)
    except RecursionError:
        return None


def orphan_cascade(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey], inherited: bool = True) -> DataFrame:
    """Direct and, unless left out, inherited orphans of ``tables``: columns ``ref, id, reason, period, kind, depth``.

    Children of orphaned records are orphans too: semi-joins go down the foreign-key graph from the direct orphans of
    each table until no table gains a row. An inherited orphan has kind ``inherited``, reason ``inherited`` and the
    number of steps from the direct one as depth; who is orphaned directly by the same reference is not repeated. In an
    acyclic graph the number of rounds is known beforehand and the plan stays lazy; a cyclic one is iterated over
    checkpoints.
    """
    rounds = _depth(keys) if inherited else 0
    hot = hot_keys({key.ref: (tables[key.child], key.column) for key in keys})  # measured once, used by all rounds
    direct = {key: direct_orphans(tables[key.child], tables[key.parent], key, hot[key.ref]) for key in keys}
    out = [rows.select(F.lit(key.ref).alias("ref"), "id", "reason", "period", F.lit("direct").alias("kind"), F.lit(0).alias("depth")) for key, rows in direct.items()]
    names = {key.child for key in keys} | {key.parent for key in keys}
    seen = {key: rows.select("id") for key, rows in direct.items()}
    front: dict[str, DataFrame | None] = {name: None for name in names}
    for key, rows in direct.items():
        front[key.child] = rows.select("id") if front[key.child] is None else front[key.child].unionByName(rows.select("id"))
    depth = 0
    while rounds is None or depth < rounds:
        depth += 1
        fresh: dict[str, DataFrame | None] = {name: None for name in names}
        for key in keys:
            if front[key.parent] is None:
                continue
            child = tables[key.child].select("id", F.col(key.column).alias("__key"), F.col(key.time).alias("__time")).where(F.col("id").isNotNull())
            parents = front[key.parent].select(F.col("id").alias("__parent")).distinct()
            rows = salted_join(child, parents, "__key", "__parent", "id", hot[key.ref], how="inner")
            rows = rows.groupBy("id").agg(F.min(_month("__time")).alias("month")).join(seen[key], "id", "left_anti").select("id", _period(F.col("month")).alias("period"))
            if rounds is None:
                rows = checkpointed(rows)
                if rows.isEmpty():
                    continue
            out.append(rows.select(F.lit(key.ref).alias("ref"), "id", F.lit("inherited").alias("reason"), "period", F.lit("inherited").alias("kind"), F.lit(depth).alias("depth")))
            seen[key] = seen[key].unionByName(rows.select("id"))
            fresh[key.child] = rows.select("id") if fresh[key.child] is None else fresh[key.child].unionByName(rows.select("id"))
        front = fresh
        if not any(rows is not None for rows in front.values()):
            break
    result = out[0]
    for rows in out[1:]:
        result = result.unionByName(rows)
    return result


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per reference, period, kind and reason."""
    return orphans.groupBy("ref", "period", "kind", "reason").agg(F.count(F.lit(1)).alias("records"))
