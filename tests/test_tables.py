import datetime as dt
import json

from pyspark.sql import functions as F

from skein.operators import events, graphs, metadata
from skein.streaming import events as streams
from tests.conftest import rows


def test_current_and_changes(spark):
    shape = "id long, name string, updated_at timestamp, deleted int, owner_id long"
    at = [dt.datetime(2025, 1, n) for n in (1, 2, 3)]
    frame = spark.createDataFrame([(1, "a", at[0], 0, 7), (1, "b", at[2], None, 7), (1, "b", at[2], None, 7), (2, "c", None, 0, None), (3, "d", at[1], 0, 7), (3, "e", at[1], 1, 7), (None, "f", at[0], 0, 7)], shape)
    assert rows(metadata.current(frame).select("id", "name")) == [(1, "b"), (2, "c"), (3, "e")]
    assert rows(metadata.accessible(metadata.current(frame), 7, False).select("id")) == [(1,)]
    assert rows(metadata.accessible(metadata.current(frame), 7, True).select("id")) == [(1,), (2,)]
    assert metadata.current(frame.limit(0)).count() == 0
    assert rows(metadata.active(metadata.soft_deleted(metadata.current(frame), 1)).select("id")) == [(2,)]
    changed = metadata.updated(metadata.current(frame), spark.createDataFrame([(2, "new", None, 0, None), (9, "more", None, 0, 1)], shape))
    assert rows(changed.select("id", "name")) == [(1, "b"), (2, "new"), (3, "e"), (9, "more")]
    assert changed.where("id in (2, 9) and updated_at is null").count() == 0


def test_node_states_and_ends(spark):
    data = [(1, 0, "WORKFLOW_START", None, None), (1, 1, "NODE_START", "a", None), (1, 2, "NODE_PROGRESS", "a", "x"), (1, 3, "NODE_SUCCESS", "a", "y"), (1, 4, "NODE_START", "b", None), (1, 5, "NODE_ERROR", "b", "z"), (1, 6, "WORKFLOW_COMPLETE", None, None), (2, 1, "NODE_START", "a", None)]
    frame = spark.createDataFrame(data, "run_id long, seq long, event_type string, node_id string, data string")
    assert rows(events.node_states(frame).select("run_id", "node_id", "status", "data", "position")) == [(1, "a", "SUCCESS", "y", 1), (1, "b", "ERROR", "z", 4), (2, "a", "RUNNING", None, 1)]
    assert rows(events.ended_runs(frame)) == [(1,)]
    assert events.node_states(frame.limit(0)).count() == 0


def test_progress_rounds_half_up(spark):
    frame = spark.createDataFrame([("a", n < 1) for n in range(8)] + [("b", n < 1) for n in range(3)] + [("c", None)], "k string, ok boolean")
    assert rows(events.progress(frame, ["k"], F.col("ok")).select("k", "percent")) == [("a", 13), ("b", 33), ("c", 0)]


def test_graph_tables_over_dirty_documents(spark):
    good = {"nodes": [{"id": "a", "type": "input"}, {"id": "b", "type": "x", "data": {"type": "llm", "configId": "3", "label": "L"}}, {"id": "b"}], "edges": [{"source": "a", "target": "b"}, {"source": "a", "target": "b"}, {"source": "b", "target": "gone"}]}
    data = [(1, json.dumps(good)), (2, json.dumps(json.dumps(good))), (3, json.dumps(good)[:-5]), (4, None), (5, ""), (6, "{}"), (7, '{"nodes": null, "edges": []}'), (8, "[1]"), (9, '"text"')]
    flows = spark.createDataFrame(data, "id long, flow_data string")
    nodes, edges = graphs.nodes(flows), graphs.edges(flows)
    assert rows(nodes.where("id = 1").select("position", "node_id", "node_type", "label")) == [(0, "a", "input", None), (1, "b", "llm", "L"), (2, "b", None, None)]
    assert {x.id for x in nodes.collect()} == {1, 2} and edges.where("id = 2").count() == 3
    assert rows(graphs.unknown_ends(nodes, edges).select("id", "target")) == [(1, "gone"), (2, "gone")]
    assert rows(graphs.ends(nodes, edges, which="entry")) == [(1, "a"), (2, "a")]
    assert rows(graphs.node_configs(flows).select("id", "node_id", "config_id")) == [(1, "b", 3), (2, "b", 3)]
    problems = {x.id: x.problem for x in graphs.orders(flows).collect()}
    assert all(problems.values()) and "unknown" in problems[1] and len(problems) == 9


def test_levels_and_cycles(spark):
    shape = "id long, position int, source string, target string"
    edges = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "a", "c"), (1, 2, "b", "c"), (2, 0, "x", "y"), (2, 1, "y", "x")], shape)
    assert rows(graphs.levels(edges, "id").select("id", "node_id", "level")) == [(1, "a", 0), (1, "b", 1), (1, "c", 2)]
    assert graphs.levels(edges.limit(0), "id").count() == 0


def test_levels_of_any_depth_and_cycles_apart(spark):
    shape = "id long, position int, source string, target string"
    chain = [(1, i, f"n{i}", f"n{i + 1}") for i in range(150)] + [(1, 200, "n0", "n149"), (1, 201, "n0", "n1")]
    diamonds = [(2, i, f"{a}{i}", f"{b}{i + (a != 's')}") for i in range(40) for a, b in (("s", "x"), ("s", "y"), ("x", "s"), ("y", "s"))]
    loops = [(3, 0, "a", "b"), (3, 1, "b", "c"), (3, 2, "c", "b"), (3, 3, "c", "d"), (3, 4, "a", "e"), (3, 5, "f", "f"), (3, 6, "e", "g")]
    ends = [(4, 0, "a", None), (4, 1, None, "b"), (4, 2, "a", "c"), (4, 3, None, "c")]
    edges = spark.createDataFrame(chain + diamonds + loops + ends, shape)
    found = {(x.id, x.node_id): x.level for x in graphs.levels(edges, "id").collect()}
    assert {k[1]: v for k, v in found.items() if k[0] == 1} == {f"n{i}": i for i in range(151)}
    assert found[2, "s40"] == 80 and found[2, "x39"] == 79
    assert {k[1]: v for k, v in found.items() if k[0] == 3} == {"a": 0, "e": 1, "g": 2}
    assert {k[1]: v for k, v in found.items() if k[0] == 4} == {"a": 0, None: 1, "c": 1}
    assert rows(graphs.cyclic(edges, "id")) == [(3, "b"), (3, "c"), (3, "d"), (3, "f")]
    assert graphs.cyclic(edges.limit(0), "id").count() == 0


def test_streams(spark, tmp_path):
    shape = "ts timestamp, k string, v long"
    start = dt.datetime(2025, 1, 1)
    spark.createDataFrame([(start + dt.timedelta(minutes=n), "ab"[n % 2], n) for n in range(20)], shape).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.windowed_counts(streams.read_events(spark, str(tmp_path / "in"), shape), "ts", ["k"])
    out = str(tmp_path / "out")
    done = streams.write_batches(stream, str(tmp_path / "state"), lambda batch, number: batch.select("window.start", "k", "events").write.mode("overwrite").parquet(f"{out}/batch={number}"))
    done.awaitTermination()
    written = spark.read.parquet(out)
    assert written.groupBy("k").agg(F.sum("events")).count() == 2 and written.agg(F.sum("events")).first()[0] == 20


def test_lint_over_tables(spark):
    nodes = [{"id": "a", "type": "input"}, {"id": "l", "type": "llm", "data": {"prompt": "{{q}} {{z}} {{z}}", "inputParams": [{"name": "q", "type": "reference", "referenceNode": "a.x"}, {"name": "r", "type": "reference", "ref": "gone.x"}, {"name": "s", "type": "reference", "ref": "plain"}, {"name": "t", "type": "input"}, {"type": "input", "value": 3}], "outputParams": "none"}}]
    data = [(1, json.dumps({"nodes": nodes, "edges": []})), (2, None), (3, '{"nodes": ['), (4, json.dumps({"nodes": None})), (5, json.dumps({"nodes": [{"id": None, "data": None}]}))]
    frame = spark.createDataFrame(data, "id long, flow_data string")
    assert rows(graphs.lint(frame)) == [(1, 1, "l", "nothing", "s"), (1, 1, "l", "undefined", "z"), (1, 1, "l", "unknown", "r"), (1, 1, "l", "unnamed", ""), (1, 1, "l", "without value", "t")]
    assert graphs.lint(frame.limit(0)).count() == 0


def test_edges_without_deleted_nodes(spark):
    edges = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "b", "c"), (1, 2, "c", "d"), (2, 0, "a", "b"), (2, 1, None, "b")], "id long, position int, source string, target string")
    gone = spark.createDataFrame([(1, "b"), (1, "b"), (2, None)], "id long, node_id string")
    assert rows(graphs.without_nodes(edges, gone)) == [(1, 2, "c", "d"), (2, 0, "a", "b"), (2, 1, None, "b")]
