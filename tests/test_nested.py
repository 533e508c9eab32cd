import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein import queries
from skein.functions.jsontree import BROKEN, decode
from skein.operators.nested import _assembled, objects, occurrences, rebuilt, shred, values
from tests.conftest import rows


def brute(node, path="", parent=""):
    """Occurrences by plain recursion, top down."""
    if isinstance(node, dict):
        for key, value in node.items():
            yield from brute(value, f"{path}/{key}".lstrip("/") if path else key, parent)
    elif isinstance(node, list):
        for i, value in enumerate(node):
            here = f"{path}/{i}" if path else str(i)
            if isinstance(value, dict):
                yield here, parent, next((value[x] for x in ("id", "name", "nodeId") if isinstance(value.get(x), str)), "")
                yield from brute(value, here, here)
            elif isinstance(value, list):
                yield from brute(value, here, parent)


names = st.sampled_from(["id", "name", "nodeId", "a", "b"])
trees = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(names, x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(trees)
def test_shred_equals_plain_recursion(tree):
    found, bodies = shred(tree, every=False)
    assert sorted((path, parent, key) for path, parent, _, key, _, _ in found) == sorted(brute(tree))
    assert all(int(path.rpartition("/")[2]) == ordinal for path, _, ordinal, *_ in found)
    every, same = shred(tree)
    assert bodies == same and [x for x in every if x[5] == "element"] == found
    assert sorted(x[4] for x in every) == sorted(name for name, _ in bodies)
    if every:
        root = next(name for *_, name, role in every if role == "root")
        assert json.loads(_assembled(root, dict(bodies))) == tree


def test_equal_objects_share_an_identity_and_others_do_not():
    found, _ = shred([{"a": 1, "b": [{"x": 2}]}, {"b": [{"x": 2}], "a": 1}, {"a": "1", "b": [{"x": 2}]}, {"a": 1, "b": [{"x": 3}]}])
    ids = {path: name for path, _, _, _, name, role in found if role == "element"}
    assert ids["0"] == ids["1"] and len({ids["0"], ids["2"], ids["3"]}) == 3 and ids["0/b/0"] == ids["1/b/0"] != ids["3/b/0"]


@pytest.mark.parametrize("text", [None, "", "  ", "nul", '{"a":', '{"a":1} x', "NaN", '[{"a":NaN}]', '"plain"', "[" * 100_000])
def test_broken(text):
    assert decode(text) is BROKEN


def test_table(spark):
    doc = {"nodes": [{"id": 5, "name": "n", "p": [{"id": "q"}, 3, None]}, "s"]}
    data = [(1, json.dumps(doc), "f", 0), (1, json.dumps(doc), "f", 0), (2, json.dumps(json.dumps(doc)), None, 0), (3, '[{"id":"\\ud800"}]', "f", 0), (4, None, "f", 0), (None, "[{}]", "f", 0), (5, "[{}" + "," * 3, "f", 0), (6, "[" + ",".join(["{}"] * 30_000) + "]", "f", 0)]
    frame = spark.createDataFrame(data, "id long, body string, file string, path int")
    out = rows(occurrences(frame, "t", "id", "body", "file").where("root_id < 6 and role = 'element'").select("root_id", "export_file", "path", "parent_path", "child_key"))
    assert out == [(1, "f", "nodes/0", "", "n"), (1, "f", "nodes/0/p/0", "nodes/0", "q"), (2, "", "nodes/0", "", "n"), (2, "", "nodes/0/p/0", "nodes/0", "q"), (3, "f", "0", "", "�")]
    assert occurrences(frame, "t", "id", "body", "file").where("root_id = 6").count() == 30_001
    assert occurrences(frame.limit(0), "t", "id", "body").count() == 0


def test_one_object_as_array_and_the_store(spark):
    frame = spark.createDataFrame([(1, '{"id":"a","x":[{"id":"b"}]}'), (2, '[{"id":"b"}]')], "id long, body string")
    assert rows(occurrences(frame, "t", "id", "body", single_is_array=True, every=False).select("root_id", "path", "parent_path")) == [(1, "0", ""), (1, "0/x/0", "0"), (2, "0", "")]
    held = [(json.loads(x.body), x.occurrences) for x in objects(frame, "id", "body", single_is_array=True).collect()]
    assert {x["id"]: n for x, n in held if isinstance(x, dict)} == {"a": 1, "b": 2} and sum(isinstance(x, list) for x, _ in held) == 2


def test_store_and_bridge_hold_both_tables(spark, tmp_path):
    shared = {"id": "a", "arguments": {"k": 1}}
    spark.createDataFrame([(1, json.dumps({"nodes": [shared]}), "f")], "id long, flow_data string, export_file string").write.parquet(f"{tmp_path}/workflow.parquet")
    runs = [(7, json.dumps({"nodeId": "n", "attempts": [shared, {"tool": "t"}]})), (8, json.dumps([shared]))]
    spark.createDataFrame(runs, "id long, node_results string").write.parquet(f"{tmp_path}/execution_record.parquet")
    store = {x.object_id: (json.loads(x.body), x.occurrences) for x in queries.p3_objects(spark, str(tmp_path)).collect()}
    bridge = {(x.root_table, x.root_id, x.path): (x.ordinal, *store[x.object_id]) for x in queries.p3_bridge(spark, str(tmp_path)).collect()}
    elements = {("workflow", 1, "nodes/0"), ("execution_record", 7, "0"), ("execution_record", 7, "0/attempts/0"), ("execution_record", 7, "0/attempts/1"), ("execution_record", 8, "0")}
    assert set(bridge) == elements | {("workflow", 1, ""), ("execution_record", 7, ""), ("execution_record", 8, ""), *((x, y, f"{z}/arguments") for x, y, z in elements - {("execution_record", 7, "0"), ("execution_record", 7, "0/attempts/1")})}
    assert bridge["execution_record", 7, "0/attempts/1"] == (1, {"tool": "t"}, 1)
    assert bridge["workflow", 1, "nodes/0"][1:] == bridge["execution_record", 8, "0"][1:] and bridge["workflow", 1, "nodes/0"][2] == 3
    assert bridge["workflow", 1, "nodes/0/arguments"] == (-1, {"k": 1}, 3)


def test_bridge_and_store_give_the_documents_and_their_values_again(spark):
    documents = [{"a": [1, [2.5, {"x": None}], {}], "b": {"c": {"d": "\ud800é"}}, "e": []}, [3, "s", [], [[{"k": True}]]], {}, [], {"#": {"#": "x"}}, [{"same": 1}] * 200]
    frame = spark.createDataFrame([(n, json.dumps(x), "f") for n, x in enumerate(documents)], "id long, body string, file string")
    bridge, store = occurrences(frame, "t", "id", "body", "file"), objects(frame, "id", "body", "file")
    assert [json.loads(x.document) for x in rebuilt(bridge, store).orderBy("root_id").collect()] == documents
    found = rows(values(frame, "t", "id", "body", "file").where("root_id < 5").select("root_id", "path", "type", "value"))
    assert found == [(0, "a/0", "number", "1"), (0, "a/1/0", "number", "2.5"), (0, "a/1/1/x", "null", ""), (0, "b/c/d", "string", "\ufffdé"), (1, "0", "number", "3"), (1, "1", "string", "s"), (1, "3/0/0/k", "boolean", "true"), (4, "#/#", "string", "x")]
    assert values(frame, "t", "id", "body", "file").where("root_id = 5").count() == 200
    assert values(frame.limit(0), "t", "id", "body").count() == 0 and rebuilt(bridge.limit(0), store.limit(0)).count() == 0


def test_documents_as_deep_as_the_decoder_takes(spark):
    deep = '[{"a":' * 2000 + "1" + "}]" * 2000
    found, bodies = shred(decode(deep), every=False)
    assert len(found) == len(bodies) - 1 == 2000 and max(path.count("/") for path, *_ in found) == 2 * 1999
    assert len(shred(decode('{"a":' + "[" * 9000 + "{}" + "]" * 9000 + "}"))[1]) == 2
    frame = spark.createDataFrame([(1, deep), (2, "[{}]")], "id long, body string")
    assert occurrences(frame, "t", "id", "body").count() == 2003 and objects(frame, "id", "body").count() == 2003
    assert rebuilt(occurrences(frame, "t", "id", "body"), objects(frame, "id", "body")).orderBy("root_id").first().document == deep
