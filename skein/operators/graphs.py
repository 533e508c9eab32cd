"""Graphs as tables: the nodes and edges of many workflow documents, and per workflow its order, cycles, entry and exit.

Documents that are null or not complete JSON give no rows; edges may be missing or name unknown nodes, and a node may
stand twice. Decoding stays in the JVM where Spark's JSON reader can do it; the order of a graph needs iteration and is
computed per document in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import placeholders
from skein.plans import graph as graphs
from skein.plans.providers import KINDS

_SHAPE = "struct<nodes:array<struct<id:string,type:string,data:variant>>,edges:array<struct<id:string,source:string,target:string,sourceHandle:string,targetHandle:string>>>"


def _flow(text: str) -> Column:
    """The flow as a struct, null unless the text is complete JSON; a document inside a JSON string is unwrapped once."""
    inner = F.try_variant_get(F.try_parse_json(text), "$", "string")
    plain = F.when(F.trim(F.col(text)).startswith('"'), inner).otherwise(F.col(text))
    return F.when(F.try_parse_json(plain).isNotNull(), F.from_json(plain, _SHAPE))


def _held(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("node.data", f"$.{name}", kind)


def _type() -> Column:
    """The type inside ``data`` wins over the outer one; ``default`` stands for none."""
    return F.coalesce(F.nullif(_held("type"), F.lit("")), F.nullif(F.col("node.type"), F.lit("default")))


def nodes(flows: DataFrame, key: str = "id", text: str = "flow_data") -> DataFrame:
    """``key, position, node_id, node_type, label`` of every node in the order of its list."""
    rows = flows.select(key, F.posexplode(_flow(text)["nodes"]).alias("position", "node"))
    return rows.select(key, "position", F.col("node.id").alias("node_id"), _type().alias("node_type"), _held("label").alias("label"))


def edges(flows: DataFrame, key: str = "id", text: str = "flow_data") -> DataFrame:
    """``key, position, source, target`` of every edge in the order of its list."""
    rows = flows.select(key, F.posexplode(_flow(text)["edges"]).alias("position", "edge"))
    return rows.select(key, "position", F.col("edge.source").alias("source"), F.col("edge.target").alias("target"))


def node_configs(flows: DataFrame, key: str = "id", text: str = "flow_data") -> DataFrame:
    """What the completion nodes say themselves: ``key, position, node_id, node_type, config_id, provider, api_url, api_key, model, temperature``."""
    rows = flows.select(key, F.posexplode(_flow(text)["nodes"]).alias("position", "node"))
    own = [_held(x).alias(y) for x, y in (("provider", "provider"), ("apiUrl", "api_url"), ("apiKey", "api_key"), ("model", "model"))]
    kept = rows.select(key, "position", F.col("node.id").alias("node_id"), _type().alias("node_type"), _held("configId", "bigint").alias("config_id"), *own, _held("temperature", "double").alias("temperature"))
    return kept.where(F.col("node_type").isin(*KINDS))


_PARAMS = "array<struct<name:string,type:string,value:string,referenceNode:string,ref:string>>"


def lint(flows: DataFrame, key: str = "id", text: str = "flow_data") -> DataFrame:
    """``key, position, node_id, problem, name`` of what would surprise at run time, for whole tables; ``plans.graph.lint`` tells it for one graph.

    Problems: ``unnamed`` parameters, references that name ``nothing`` or an ``unknown`` node, static parameters
    ``without value``, and names in templates that are ``undefined``. Parameters that are no list are none.
    """
    rows = flows.select(key, _flow(text)["nodes"].alias("nodes")).select(key, F.transform("nodes", lambda x: x["id"]).alias("known"), F.posexplode("nodes").alias("position", "node"))

    def params(name: str) -> Column:
        return F.coalesce(F.try_variant_get("node.data", f"$.{name}", _PARAMS), F.array().cast(_PARAMS))

    reference = F.coalesce(F.col("p.referenceNode"), F.col("p.ref"))
    rows = rows.withColumn("params", F.concat(params("inputParams"), params("outputParams")))
    held = rows.select(key, "position", F.col("node.id").alias("node_id"), "known", F.explode("params").alias("p"))
    problem = (
        F.when(F.coalesce(F.col("p.name"), F.lit("")) == "", "unnamed")
        .when((F.col("p.type") == "reference") & ~F.coalesce(reference.contains("."), F.lit(False)), "nothing")
        .when((F.col("p.type") == "reference") & ~F.array_contains("known", F.substring_index(reference, ".", 1)), "unknown")
        .when((F.col("p.type") == "input") & F.col("p.value").isNull(), "without value")
    )
    of_params = held.select(key, "position", "node_id", problem.alias("problem"), F.coalesce("p.name", F.lit("")).alias("name")).where("problem is not null")
    templates = F.concat_ws(" ", _held("prompt"), _held("responseContent"))
    used = F.array_except(placeholders(templates), F.transform("params", lambda x: x["name"]))
    of_templates = rows.select(key, "position", F.col("node.id").alias("node_id"), F.lit("undefined").alias("problem"), F.explode(used).alias("name"))
    return of_params.unionByName(of_templates)


def without_nodes(edge_table: DataFrame, gone: DataFrame, key: str = "id", node: str = "node_id") -> DataFrame:
    """The edges that are left when the nodes ``key, node`` of ``gone`` are deleted with all that touch them."""
    left = edge_table
    for end in ("source", "target"):
        left = left.join(gone.select(key, F.col(node).alias(end)).distinct(), [key, end], "left_anti")
    return left.select(*edge_table.columns)


def ends(node_table: DataFrame, edge_table: DataFrame, key: str = "id", which: str = "entry") -> DataFrame:
    """Per graph its entry (first node that no edge enters, else the first) or exit (first that no edge leaves, else the last)."""
    touched = edge_table.select(F.col(key).alias("__key"), F.col("target" if which == "entry" else "source").alias("__node")).distinct().withColumn("__touched", F.lit(True))
    marked = node_table.join(touched, (F.col(key) == F.col("__key")) & (F.col("node_id") == F.col("__node")), "left")
    free = F.min(F.when(F.col("__touched").isNull(), F.struct("position", "node_id")))
    rest = F.min(F.struct("position", "node_id")) if which == "entry" else F.max(F.struct("position", "node_id"))
    return marked.groupBy(key).agg(F.coalesce(free, rest)["node_id"].alias(which))


def unknown_ends(node_table: DataFrame, edge_table: DataFrame, key: str = "id") -> DataFrame:
    """Edges that name a node their graph does not have: ``key, position, source, target``."""
    known = node_table.select(key, F.col("node_id").alias("__node")).distinct()
    out = None
    for end in ("source", "target"):
        part = edge_table.join(known.withColumnRenamed("__node", end), [key, end], "left_anti").select(key, "position", "source", "target")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def fan_in(edge_table: DataFrame, key: str = "id") -> DataFrame:
    """``key, node_id, sources`` with the sources of the edges into each node, in the order of the edges."""
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("position", "source"))), lambda x: x["source"])
    return edge_table.groupBy(key, F.col("target").alias("node_id")).agg(gathered.alias("sources"))


def orders(flows: DataFrame, key: str = "id", text: str = "flow_data", tie_order: str = "list") -> DataFrame:
    """``key, problem, ordered`` for every graph: its nodes in topological order, or why it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problems, lists = [], []
            for body in batch["text"].to_pylist():
                try:
                    lists.append([node.id for node in graphs.topological(graphs.parse(body or ""), tie_order)])
                    problems.append(None)
                except (ValueError, AttributeError) as problem:
                    lists.append(None)
                    problems.append(str(problem))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(problems, pa.string()), pa.array(lists, pa.list_(pa.string()))], ["key", "problem", "ordered"])

    rows = flows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, problem string, ordered array<string>").withColumnRenamed("key", key)


def _longest(pairs: list[dict[str, str | None]]) -> Iterator[tuple[str | None, int | None]]:
    """Each node of one graph with its longest path from a node without incoming edges, or None on and behind cycles.

    A null end is a node that no edge leaves; nodes that only such ends lead to are left out.
    """
    after: defaultdict[str, list[str | None]] = defaultdict(list)
    waits: Counter[str | None] = Counter()
    for pair in pairs:
        if pair["source"] is not None:
            after[pair["source"]].append(pair["target"])
            waits[pair["target"]] += 1
    sources, targets = {x["source"] for x in pairs}, {x["target"] for x in pairs}
    names = sources | targets
    level = {x: 0 for x in sources if x is None or x not in targets}
    ready = [x for x in names if not waits[x]]
    done = set(ready)
    while ready:
        node = ready.pop()
        for target in after[node] if node is not None else ():
            if node in level:
                level[target] = max(level.get(target, 0), level[node] + 1)
            waits[target] -= 1
            if not waits[target]:
                ready.append(target)
                done.add(target)
    for node in names:
        if node not in done:
            yield node, None
        elif node in level:
            yield node, level[node]


def _walked(edge_table: DataFrame, key: str) -> DataFrame:
    """``key, node_id, level`` with a null level on and behind cycles; the edges of a graph are brought to one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, node, level) for row, pairs in enumerate(batch["pairs"].to_pylist()) for node, level in _longest(pairs)]
            places, nodes, levels = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(places, pa.int64())), pa.array(nodes, pa.string()), pa.array(levels, pa.int32())], [key, "node_id", "level"])

    rows = edge_table.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(F.struct("source", "target")).alias("pairs"))
    return rows.mapInArrow(run, T.StructType([edge_table.schema[key], T.StructField("node_id", T.StringType()), T.StructField("level", T.IntegerType())]))


def levels(edge_table: DataFrame, key: str) -> DataFrame:
    """``key, node_id, level`` of graphs given as tables: the longest path from a node without incoming edges.

    Paths may have any length; nodes on or behind a cycle have no longest path and are in ``cyclic``.
    """
    return _walked(edge_table, key).where("level is not null")


def cyclic(edge_table: DataFrame, key: str) -> DataFrame:
    """``key, node_id`` of the nodes on a cycle of their graph or reached from one."""
    return _walked(edge_table, key).where("level is null").select(key, "node_id")


def first_of(frame: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given total order."""
    return frame.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")
