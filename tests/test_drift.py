import datetime as dt
import json
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq

from skein.operators.drift import aliases, catalogue, changes, consistent, file_ranks, footer_inventory, inventory, lifespans, renames, shown, spans_of, type_catalogue
from tests.conftest import rows

SCHEMA = "id long, body string, file string, path string, rank int"


def table(spark, *data):
    return spark.createDataFrame([(key, body if body is None or isinstance(body, str) else json.dumps(body), file, "x", 1) for key, body, file in data], SCHEMA)


def report(frame):
    return rows(changes(frame, "file", "id", "body"))


def test_every_kind_of_change(spark):
    one = {"a": 1, "n": [{"m": "x", "old": i} for i in range(3)], "gone": True, "same": None}
    two = {"a": "1", "n": [{"m": "x", "new": i} for i in range(3)], "fresh": {"z": 1}, "same": None}
    frame = table(spark, (1, one, "f1"), (1, one, "f1"), (2, json.dumps(one), "f1"), (1, two, "f2"), (2, two, "f2"), (3, '{"cut": ', "f2"), (4, None, "f2"), (5, [1], "f2"), (None, {"other": 1}, None))
    assert report(frame) == [
        ("f2", "added", "", "fresh", "", "object"),
        ("f2", "added", "", "fresh.z", "", "number"),
        ("f2", "removed", "gone", "", "boolean", ""),
        ("f2", "renamed", "n[].old", "n[].new", "number", "number"),
        ("f2", "type", "a", "a", "number", "string"),
    ]


def test_no_rename_without_common_records_or_with_other_values(spark):
    other = table(spark, (1, {"old": 1}, "f1"), (1, {"new": 2}, "f2"))
    assert [x[1] for x in report(other)] == ["added", "removed"]
    apart = table(spark, (1, {"old": 1}, "f1"), (2, {"new": 1}, "f2"))
    assert [x[1] for x in report(apart)] == ["added", "removed"]


def test_islands_and_files_without_complete_rows(spark):
    frame = table(spark, (1, {"a": 1}, "f1"), (1, '{"a', "f2"), (1, {"a": 1}, "f3"))
    assert report(frame) == [("f2", "removed", "a", "", "number", ""), ("f3", "added", "", "a", "", "number")]
    spans = rows(catalogue(inventory(frame, "file", "body"), file_ranks(frame, "file")).select("path", "island", "first_file", "last_file", "files"))
    assert spans == [("a", 1, "f1", "f1", 1), ("a", 2, "f3", "f3", 1)]


def test_empty_and_single_file(spark):
    assert report(table(spark, (1, {"a": 1}, "f1")).limit(0)) == []
    assert report(table(spark, (1, {"a": 1}, "f1"))) == []
    assert consistent(table(spark, (1, {"a": 1}, "f1")).limit(0), "file", "id", "body").count() == 0


def test_consistent_table(spark):
    frame = table(spark, (1, {"v": 1, "t": "x", "old": 5}, "f1"), (2, {"v": "2", "t": ["y"], "new": 7, "p": {"x": 1}}, "f2"), (1, {"v": 3, "new": 5, "p": [1, 2]}, "f2"), (9, "broken", "f2"))
    assert aliases(renames(spans_of(frame, "file", "body"), frame, "file", "id", "body")) == {(".old",): (".new",)}
    out = {(x.id, x.file): x.flow and x.flow.asDict() for x in consistent(frame, "file", "id", "body").collect()}
    assert out == {
        (1, "f1"): {"new": 5.0, "p": None, "t": ["x"], "v": "1"},
        (2, "f2"): {"new": 7.0, "p": '{"x":1}', "t": ["y"], "v": "2"},
        (1, "f2"): {"new": 5.0, "p": "[1,2]", "t": None, "v": "3"},
        (9, "f2"): None,
    }


def flows(frame):
    return {(x.id, x.file): x.flow and x.flow.asDict(recursive=True) for x in consistent(frame, "file", "id", "body").collect()}


def test_names_with_dots_and_names_that_differ_in_case(spark):
    frame = table(spark, (1, {"a.b": 1, "c": {"d.e": {"f": "x"}}, "A": 1, "a": 2}, "f1"), (1, {"a.b": 1, "c": {"g.h": {"f": "x"}}, "A": 1, "a": 2}, "f2"))
    assert report(frame) == [("f2", "added", "", "c.g.h.f", "", "string"), ("f2", "removed", "c.d.e.f", "", "string", ""), ("f2", "renamed", "c.d.e", "c.g.h", "object", "object")]
    out = {"A": 1, "a.b": 1, "a_2": 2, "c": {"g.h": {"f": "x"}}}
    assert flows(frame) == {(1, "f1"): out, (1, "f2"): out}


def test_numbers_keep_all_digits(spark):
    frame = table(spark, (1, {"l": 2**60 + 1, "d": 10**30 + 1, "h": 10**40, "s": 1, "m": 2**60 + 1, "f": 0.5}, "f1"), (2, {"l": 1, "d": 2, "h": 1, "s": 0.5, "m": 0.5, "f": 1}, "f1"))
    assert flows(frame) == {
        (1, "f1"): {"l": 2**60 + 1, "d": Decimal(10**30 + 1), "h": str(10**40), "s": 1.0, "m": str(2**60 + 1), "f": 0.5},
        (2, "f1"): {"l": 1, "d": Decimal(2), "h": "1", "s": 0.5, "m": "0.5", "f": 1.0},
    }


def test_arrays_of_every_kind_lose_nothing(spark):
    frame = table(spark, (1, {"o": [{"x": 1}, None], "m": [{"x": 1}, 2], "e": [], "n": [], "w": [{"x": 1}]}, "f1"), (2, {"o": [], "m": [], "e": [1, [2]], "n": None, "w": [3]}, "f1"))
    assert flows(frame) == {
        (1, "f1"): {"o": [{"x": 1}, None], "m": '[{"x":1},2]', "e": [], "n": [], "w": '[{"x":1}]'},
        (2, "f1"): {"o": [], "m": "[]", "e": ["1", "[2]"], "n": None, "w": "[3]"},
    }


def test_deep_fields_are_text(spark):
    frame = table(spark, (1, '{"a":' * 2000 + "1" + "}" * 2000, "f1"), (2, {"b": 1}, "f1"))
    value = flows(frame)[1, "f1"]["a"]
    for _ in range(30):
        value = value["a"]
    assert value["a"] == '{"a":' * 1968 + "1" + "}" * 1968 and flows(frame)[2, "f1"] == {"a": None, "b": 1}


def test_renames_in_turn_and_many_equal_fields(spark):
    frame = table(spark, *((n, {"k": n, "n": {"p": n, **{f"same{i}": True for i in range(30)}}}, "f1") for n in range(4)), *((n, {"key": n, "n": {"q": n, **{f"also{i}": True for i in range(30)}}}, "f2") for n in range(4)), *((n, {"name": n, "n": {"q": n}}, "f3") for n in range(4)))
    found = renames(spans_of(frame, "file", "body"), frame, "file", "id", "body")
    steps = aliases(found)
    assert steps[(".k",)] == steps[(".key",)] == (".name",) and steps[(".n", ".p")] == (".n", ".q")
    assert sum(x.file == "f2" and x.old[-1].startswith(".same") for x in found) == 30
    assert [x["flow"]["name"] for x in consistent(frame, "file", "id", "body").orderBy("file", "id").collect()] == [0, 1, 2, 3] * 3


def test_footers(spark, tmp_path):
    pq.write_table(pa.table({"a": [1], "s": [{"x.y": "y"}], "l": [[{"k": 1.0}]], "t": [dt.date(2025, 1, 1)]}), tmp_path / "one.parquet")
    pq.write_table(pa.table({"a": ["x"], "l": [[{"k": 1.0}]]}), tmp_path / "two.parquet")
    fields = footer_inventory(spark, str(tmp_path))
    assert rows(fields.where("file like '%one.parquet'").select(shown(fields.steps), "type")) == [("a", "int64"), ("l", "array"), ("l[].k", "double"), ("s", "object"), ("s.x.y", "string"), ("t", "date32[day]")]
    spans = lifespans(fields, file_ranks(fields, "file"))
    assert rows(spans.where("rank = 2").select("path", "types_before", "types", "starts")) == [("a", "int64", "string", False), ("l", "array", "array", False), ("l[].k", "double", "double", False)]


def test_each_type_has_its_own_lifespan(spark):
    frame = table(spark, (1, {"t": 1}, "f1"), (1, {"t": 1}, "f2"), (2, {"t": "x"}, "f2"), (2, {"t": "x"}, "f3"), (1, {"t": 2}, "f4"), (1, {"t": 2}, "f4"))
    spans = rows(type_catalogue(inventory(frame, "file", "body"), file_ranks(frame, "file")).select("path", "type", "island", "first_file", "last_file", "files"))
    assert spans == [("t", "number", 1, "f1", "f2", 2), ("t", "number", 2, "f4", "f4", 1), ("t", "string", 1, "f2", "f3", 2)]
    assert type_catalogue(inventory(frame.limit(0), "file", "body"), file_ranks(frame.limit(0), "file")).count() == 0


def test_fields_of_deep_documents(spark):
    frame = table(spark, (1, '{"a":' * 3000 + "1" + "}" * 3000, "f1"), (1, '{"a":[' * 1500 + '{"b":1}' + "]}" * 1500, "f2"))
    assert inventory(frame, "file", "body").groupBy("file").count().orderBy("file").collect() == [("f1", 3000), ("f2", 1501)]
