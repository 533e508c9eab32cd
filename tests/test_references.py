import datetime as dt

from skein.operators.references import ForeignKey, orphan_cascade, orphan_report
from skein.operators.skew import hot_keys, salted_join
from tests.conftest import rows

PARENT = "id long, up string, updated_at timestamp, created_at timestamp, deleted int, owner long, reason string, __key string"
CHILD = "id long, ref long, at timestamp, reason string, id2 long, period string"
KEY = ForeignKey("c", "ref", "p", "at")


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def found(spark, children, parents):
    tables = {"c": spark.createDataFrame(children, CHILD), "p": spark.createDataFrame(parents, PARENT)}
    return rows(orphan_cascade(tables, [KEY]).select("id", "reason", "period"))


def parent(key, up, born, deleted):
    return (key, "x", up and day(up), born and day(born), deleted, None, "r", None)


def test_reasons_nulls_ties_and_repeats(spark):
    parents = [parent(1, 5, 1, 0), parent(2, 5, 1, 1), parent(2, 9, 1, None), parent(3, 5, 1, None), parent(3, 6, 1, 1), parent(3, 6, 1, 1), parent(4, 5, 50, 0), parent(6, None, None, 1), parent(7, 5, 1, 0), parent(7, 5, 1, 1), parent(None, 1, 1, 0)]
    children = [(n, n, day(10), None, None, None) for n in range(1, 8)] + [(8, None, day(10), "", 1, ""), (9, 4, None, "", 1, ""), (3, 3, day(10), None, None, None), (None, 99, day(1), "", 1, ""), (10, 99, None, "", 1, "")]
    assert found(spark, children, parents) == [(10, "missing", ""), (3, "deleted", "2025-01"), (4, "later", "2025-01"), (5, "missing", "2025-01"), (6, "deleted", "2025-01"), (7, "deleted", "2025-01")]


def test_empty_tables(spark):
    assert found(spark, [], [parent(1, 1, 1, 0)]) == []
    assert found(spark, [(1, 1, day(1), None, None, None)], []) == [(1, "missing", "2025-01")]
    assert found(spark, [], []) == []


def test_inherited_orphans_down_the_graph(spark):
    grand = spark.createDataFrame([(1, day(1), day(1), 0)], "id long, updated_at timestamp, created_at timestamp, deleted int")
    middle = spark.createDataFrame([(10, 1, day(2), day(2), 0), (11, 9, day(2), day(2), 0)], "id long, g long, updated_at timestamp, created_at timestamp, deleted int")
    leaf = spark.createDataFrame([(100, 10, day(3)), (101, 11, day(3)), (102, 77, day(3))], "id long, m long, at timestamp")
    keys = [ForeignKey("leaf", "m", "middle", "at"), ForeignKey("middle", "g", "grand", "created_at")]
    out = orphan_cascade({"leaf": leaf, "middle": middle, "grand": grand}, keys)
    assert rows(out.select("ref", "id", "reason", "kind", "depth")) == [("leaf.m", 101, "inherited", "inherited", 1), ("leaf.m", 102, "missing", "direct", 0), ("middle.g", 11, "missing", "direct", 0)]
    assert rows(orphan_report(out).select("ref", "kind", "records")) == [("leaf.m", "direct", 1), ("leaf.m", "inherited", 1), ("middle.g", "direct", 1)]


def test_cyclic_references_reach_a_fixpoint(spark):
    one = spark.createDataFrame([(n, n - 1, day(1), day(1), 0) for n in range(1, 5)] + [(6, 7, day(1), day(1), 0), (7, 6, day(1), day(1), 0)], "id long, up long, updated_at timestamp, created_at timestamp, deleted int")
    out = orphan_cascade({"one": one}, [ForeignKey("one", "up", "one", "created_at")])
    assert rows(out.select("id", "kind", "depth")) == [(1, "direct", 0), (2, "inherited", 1), (3, "inherited", 2), (4, "inherited", 3)]


def test_hot_keys_are_spread_and_lose_nothing(spark):
    left = spark.createDataFrame([(n, "k7" if n % 3 else f"k{n}") for n in range(3000)] + [(5000, None)], "n long, k string")
    right = spark.createDataFrame([("k7", "hot"), ("k3", "cold")], "r string, v string")
    hot = hot_keys({"left": (left, "k"), "right": (right, "r"), "none": (left.limit(0), "k")}, tasks=1000)
    assert hot["left"] == [('{"key":"k7"}', 667)] and len(hot["right"]) == 2 and hot["none"] == []
    plain = left.join(right, left.k == right.r, "left")
    assert rows(salted_join(left, right, "k", "r", "n", hot["left"])) == rows(plain)
    assert rows(salted_join(left, right, "k", "r", "n", [])) == rows(plain)


def test_a_key_of_a_little_more_than_one_task_is_split(spark):
    left = spark.createDataFrame([(n, n // 20) for n in range(2000)] + [(n, 7) for n in range(2000, 2010)], "n long, k long")
    assert hot_keys({"x": (left, "k")}, tasks=80)["x"] == [('{"key":7}', 2)]


def test_months(spark):
    children = [(1, 9, dt.datetime(2025, 12, 31, 23, 59), None, None, None), (2, 9, dt.datetime(1, 1, 1), None, None, None), (3, 9, dt.datetime(9999, 12, 31), None, None, None)]
    assert [x[2] for x in found(spark, children, [])] == ["2025-12", "0001-01", "9999-12"]
