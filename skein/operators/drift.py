"""Schemas that drift between files: a lifespan catalogue of fields, a report of changes, and one consistent table.

The fields of each file are gathered once as ``(file, steps, type, form)``, for JSON text held in a column or from the
footers of Parquet files. A field is known by its steps, the names on the way to it, so names may hold dots. ``lag`` and
islands over the files of each field then give its lifespans; their starts and endings are the fields added and removed,
a change inside a lifespan is a change of type, and a start and an ending of the same parent in the same file that hold
the same values are a rename.

Defined results: rows that are not complete JSON, or not an object, hold no field; a file without any complete row
still counts as a file; null values are absent; duplicate rows count once; null file names or ids are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from hashlib import blake2b
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.jsontree import clean, decode
from skein.session import checkpointed

#: JSON type of each Python type that the decoder returns.
KINDS = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}
#: Share of the records present in both files for which a removed and an added field must agree to be one renamed field.
SAME_SHARE = 0.9
#: Objects nested deeper than this are one text in the consistent table.
MAX_DEPTH = 32
#: The step into the objects of an array; steps of names start with a dot.
EACH = "[]"

Steps = tuple[str, ...]

_encode = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode


def walk(node: dict[str, Any], into: dict[Steps, list[Any]]) -> None:
    """Append every non-null value below ``node`` to the list of its steps: its names, each after a dot, and ``[]`` after arrays of objects."""
    open_: list[tuple[Steps, Iterator[tuple[str, Any]]]] = [((), iter(node.items()))]
    while open_:
        above, items = open_[-1]
        for key, value in items:
            if value is None:
                continue
            steps = (*above, "." + key)
            into.setdefault(steps, []).append(value)
            if type(value) is dict:
                open_.append((steps, iter(value.items())))
                break
            if type(value) is list:
                inner = [((*steps, EACH), iter(item.items())) for item in reversed(value) if type(item) is dict]
                if inner:
                    open_ += inner
                    break
        else:
            open_.pop()


def shown(steps: Column) -> Column:
    """The path that steps are shown as: names joined by ``.``, ``[]`` after an array whose elements are objects."""
    return F.substring(F.array_join(steps, ""), 2, 2**31 - 1)


def _fields(text: str | None) -> dict[Steps, list[Any]]:
    document = decode(text)
    found: dict[Steps, list[Any]] = {}
    if type(document) is dict:
        walk(document, found)
    return found


def form_of(value: Any) -> str:
    """The form of a value that decides its type in a table: whole numbers are told apart by size, arrays by their elements, other values by their JSON type."""
    if type(value) is int:
        size = abs(value)
        return "small" if size <= 2**53 else "long" if -(2**63) <= value < 2**63 else "decimal" if size < 10**38 else "huge"
    if type(value) is list:
        objects = {type(x) is dict for x in value if x is not None}
        return "nothing" if not objects else "mixed" if len(objects) > 1 else "objects" if objects == {True} else "array"
    return "double" if type(value) is float else KINDS[type(value)]


#: JSON type of each form.
TYPE_OF = {x: "number" for x in ("small", "long", "decimal", "huge", "double")} | {x: "array" for x in ("nothing", "mixed", "objects", "array")} | {x: x for x in ("string", "boolean", "object")}

#: Fields by name: the forms of each, the fields below it and those below its elements.
Level = dict[str, tuple[set[str], "Level", "Level"]]


def gather(document: dict[str, Any], into: Level) -> None:
    """Add the fields of a document, at any depth, and their forms."""
    open_ = [(document, into)]
    while open_:
        node, level = open_.pop()
        for key, value in node.items():
            if value is None:
                continue
            entry = level.get(key)
            if entry is None:
                entry = level[key] = (set(), {}, {})
            kind = type(value)
            entry[0].add("string" if kind is str else form_of(value))
            if kind is dict:
                open_.append((value, entry[1]))
            elif kind is list:
                open_ += [(item, entry[2]) for item in value if type(item) is dict]


def gathered(level: Level) -> Iterator[tuple[list[str], str]]:
    """Steps and form of every field."""
    open_: list[tuple[list[str], Level]] = [([], level)]
    while open_:
        above, level = open_.pop()
        for key, (forms, below, each) in level.items():
            steps = [*above, "." + clean(key)]
            for form in forms:
                yield steps, form
            open_ += [(steps, below)] * bool(below) + [([*steps, EACH], each)] * bool(each)


def inventory(frame: DataFrame, file: str, text: str) -> DataFrame:
    """Distinct ``(file, steps, type, form)`` of the JSON held in ``text``; made distinct in each batch, so little is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files: dict[str, Level] = {}
            for name, body in zip(batch["file"].to_pylist(), batch["text"].to_pylist(), strict=True):
                document = decode(body)
                if type(document) is dict:
                    gather(document, files.setdefault(name, {}))
            found = [(name, steps, TYPE_OF[form], form) for name, level in files.items() for steps, form in gathered(level)]
            columns = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, (pa.string(), pa.list_(pa.string()), pa.string(), pa.string()), strict=True)], ["file", "steps", "type", "form"])

    rows = frame.select(F.col(file).alias("file"), F.col(text).alias("text")).where(F.col("file").isNotNull())
    return rows.mapInArrow(run, "file string, steps array<string>, type string, form string").distinct()


def footer_inventory(spark: SparkSession, *paths: str) -> DataFrame:
    """``(file, steps, type, form)`` of the Parquet files below ``paths``, from their footers only.

    Spark lists the files and each executor reads the footers of its own, through the file system that the address
    names. The type is that of Arrow, but array and object where JSON has those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        def walk_type(above: Steps, part: pa.Field, into: list[tuple[Steps, str]]) -> None:
            kind, steps = part.type, (*above, "." + part.name)
            array = pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind)
            nested = kind.value_type if array else kind
            into.append((steps, "array" if array else "object" if pa.types.is_struct(kind) else str(kind)))
            if pa.types.is_struct(nested):
                for inner in nested:
                    walk_type((*steps, EACH) if array else steps, inner, into)

        for batch in batches:
            files, steps, types = [], [], []
            for name in batch["file"].to_pylist():
                system, place = fs.FileSystem.from_uri(name)
                found: list[tuple[Steps, str]] = []
                with system.open_input_file(place) as source:
                    for part in pq.read_schema(source):
                        walk_type((), part, found)
                for where, kind in found:
                    files.append(name)
                    steps.append(list(where))
                    types.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(steps, pa.list_(pa.string())), pa.array(types, pa.string()), pa.array(types, pa.string())], ["file", "steps", "type", "form"])

    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(list(paths)).select(F.col("path").alias("file"))  # the content is not read
    return names.repartition(spark.sparkContext.defaultParallelism * 4, "file").mapInArrow(run, "file string, steps array<string>, type string, form string")


def file_ranks(frame: DataFrame, file: str) -> DataFrame:
    """Files in the order of their names, with rank, neighbours and the last rank; there is one row per file, not per record."""
    names = frame.select(F.col(file).alias("file")).where(F.col("file").isNotNull()).distinct()
    over = W.orderBy("file")
    near = [F.lag("file").over(over).alias("file_before"), F.lead("file").over(over).alias("file_after")]
    return names.select("file", F.row_number().over(over).alias("rank"), *near).withColumn("last", F.max("rank").over(W.partitionBy()))


def lifespans(fields: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file and field with its types, its island and the neighbours that tell starts and endings."""
    typed = fields.groupBy("file", "steps").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types")).join(files, "file")
    over = W.partitionBy("steps").orderBy("rank")
    near = typed.select("*", shown(F.col("steps")).alias("path"), F.lag("rank").over(over).alias("before"), F.lag("types").over(over).alias("types_before"), F.lead("rank").over(over).alias("after"))
    starts = F.coalesce(F.col("before") < F.col("rank") - 1, F.lit(True))
    ends = F.coalesce(F.col("after") > F.col("rank") + 1, F.lit(True))
    return near.select("*", starts.alias("starts"), ends.alias("ends")).withColumn("island", F.sum(F.col("starts").cast("int")).over(over))


def catalogue(fields: DataFrame, files: DataFrame) -> DataFrame:
    """Lifespans per field and island: first and last file, number of files, types seen."""
    spans = lifespans(fields, files)
    return spans.groupBy("steps", "path", "island").agg(F.min("file").alias("first_file"), F.max("file").alias("last_file"), F.count(F.lit(1)).alias("files"), F.array_join(F.array_sort(F.collect_set("types")), ", ").alias("types")).drop("steps")


def type_catalogue(fields: DataFrame, files: DataFrame) -> DataFrame:
    """Lifespans per field, type and island: first and last file, number of files. A field that stays while its type changes has a lifespan for each type."""
    over = W.partitionBy("steps", "type").orderBy("rank")
    seen = fields.select("file", "steps", "type").distinct().join(files, "file").withColumn("before", F.lag("rank").over(over))
    starts = F.coalesce(F.col("before") < F.col("rank") - 1, F.lit(True))
    spans = seen.withColumn("island", F.sum(starts.cast("int")).over(over))
    return spans.groupBy("steps", "type", "island").agg(F.min("file").alias("first_file"), F.max("file").alias("last_file"), F.count(F.lit(1)).alias("files")).select(shown(F.col("steps")).alias("path"), "type", "island", "first_file", "last_file", "files")


@dataclass(frozen=True)
class Rename:
    """A field that goes on under another name from ``file`` on."""

    file: str
    old: Steps
    new: Steps


def _held(frame: DataFrame, file: str, key: str, text: str, removed: Mapping[tuple[str, Steps], int], added: Mapping[tuple[str, Steps], int], ranks: Mapping[str, int]) -> DataFrame:
    """Per step from one file to the next and record that is complete in both: ``old`` and ``new``, the fields in question that it holds on either side, each with a hash of its values in their order.

    One pass decodes the records of the files concerned; one shuffle by step and record brings the two sides together.
    """
    asked = {ranks[name] for name, _ in added}
    ask: dict[str, list[tuple[int, bool, dict[Steps, int]]]] = {}
    for name, rank in ranks.items():
        for step, wanted, old in ((rank + 1, removed, True), (rank, added, False)):
            if step in asked:
                ask.setdefault(name, []).append((step, old, {steps: number for (where, steps), number in wanted.items() if where == name}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, ids, sides, lists = [], [], [], []
            for name, record, body in zip(batch["file"].to_pylist(), batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = _fields(body)
                if not found:
                    continue
                for step, old, wanted in ask[name]:
                    steps.append(step)
                    ids.append(record)
                    sides.append(old)
                    lists.append([{"field": number, "value": int.from_bytes(blake2b(_encode(found[where]).encode(), digest_size=8).digest(), "little", signed=True)} for where, number in wanted.items() if where in found])
            kind = pa.list_(pa.struct([("field", pa.int32()), ("value", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(steps, pa.int32()), pa.array(ids, pa.int64()), pa.array(sides, pa.bool_()), pa.array(lists, kind)], ["step", "id", "side", "held"])

    rows = frame.select(F.col(file).alias("file"), F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("file").isin(*ask) & F.col("id").isNotNull())
    sides = rows.mapInArrow(run, "step int, id long, side boolean, held array<struct<field:int,value:bigint>>").groupBy("step", "id")
    both = sides.agg(F.max(F.when(F.col("side"), F.col("held"))).alias("old"), F.max(F.when(~F.col("side"), F.col("held"))).alias("new"))
    return both.where("old is not null and new is not null and size(old) + size(new) > 0")


def renames(spans: DataFrame, frame: DataFrame, file: str, key: str, text: str, same_share: float = SAME_SHARE) -> list[Rename]:
    """Fields removed and added in one step below one parent that hold the same values in enough of the records of both files.

    The fields in question are as many as the schema has. Each record gives a hash per field; equal hashes are joined
    record by record, so pairs that never agree are not formed, and only pairs that do are counted further.
    """
    asked = spans.where((F.col("ends") & (F.col("rank") < F.col("last"))) | (F.col("starts") & (F.col("rank") > 1)))
    rows = asked.select("file", "file_after", "rank", "last", "steps", "starts", "ends").collect()
    gone = {(x.file, tuple(x.steps)): x for x in rows if x.ends and x.rank < x.last}
    come = {(x.file, tuple(x.steps)): x for x in rows if x.starts and x.rank > 1}
    parents = {(x.rank + 1, steps[:-1]) for (_, steps), x in gone.items()} & {(x.rank, steps[:-1]) for (_, steps), x in come.items()}
    removed = [where for where, x in gone.items() if (x.rank + 1, where[1][:-1]) in parents]
    added = [where for where, x in come.items() if (x.rank, where[1][:-1]) in parents]
    if not removed:
        return []
    ranks = {x.file: x.rank for x in rows}
    fields = [*((where, True) for where in removed), *((where, False) for where in added)]
    numbers = {x: number for number, x in enumerate(fields)}
    held = checkpointed(_held(frame, file, key, text, {x: numbers[x, True] for x in removed}, {x: numbers[x, False] for x in added}, ranks))
    parent_of: dict[tuple[int, Steps], int] = {}
    group = [parent_of.setdefault((ranks[name] + old, steps[:-1]), len(parent_of)) for (name, steps), old in fields]
    groups = F.array(*map(F.lit, group))

    def side(name: str) -> DataFrame:
        one = held.select("step", "id", F.explode(name).alias("x"))
        return one.select("step", "id", F.element_at(groups, F.col("x.field") + 1).alias("parent"), F.col("x.value").alias("value"), F.col("x.field").alias(name))

    same = side("old").join(side("new"), ["step", "id", "parent", "value"]).groupBy("old", "new").agg(F.count(F.lit(1)).alias("records"))
    alone = held.select(F.explode(F.concat("old", "new")).alias("x")).groupBy(F.col("x.field").alias("old"), F.lit(None).cast("int").alias("new")).agg(F.count(F.lit(1)).alias("records"))
    counts = {(x.old, x.new): x.records for x in same.unionByName(alone).collect()}
    single = {old: records for (old, new), records in counts.items() if new is None}
    # a pair agrees in no larger share of its records than of those of either field
    agreed = {pair: records for pair, records in counts.items() if pair[1] is not None and records >= same_share * max(single[x] for x in pair)}
    if not agreed:
        return []
    partners: dict[int, list[int]] = {}
    for old, new in agreed:
        partners.setdefault(old, []).append(new)
    table = held.sparkSession.createDataFrame([(old, new) for old, news in partners.items() for new in news], "old_ int, new_ int")
    shared = held.select(F.col("new.field").alias("news"), F.explode("old.field").alias("old_")).join(F.broadcast(table), "old_").where(F.array_contains("news", F.col("new_")))
    together = {(x.old_, x.new_): x.records for x in shared.groupBy("old_", "new_").agg(F.count(F.lit(1)).alias("records")).collect()}
    ordered = sorted(((same / (single[old] + single[new] - together[old, new]), same, old, new) for (old, new), same in agreed.items()), key=lambda x: (-x[0], -x[1], fields[x[2]], fields[x[3]]))
    taken: set[int] = set()
    found = []
    for share, _, old, new in ordered:
        if share >= same_share and not {old, new} & taken:
            taken |= {old, new}
            found.append(Rename(fields[new][0][0], fields[old][0][1], fields[new][0][1]))
    return found


def spans_of(frame: DataFrame, file: str, text: str, fields: DataFrame | None = None) -> DataFrame:
    """``lifespans`` of the fields of a table, checkpointed, as large as the schema."""
    return checkpointed(lifespans(inventory(frame, file, text) if fields is None else fields, file_ranks(frame, file)))


def changes(frame: DataFrame, file: str, key: str, text: str, same_share: float = SAME_SHARE) -> DataFrame:
    """The report: ``export_file, change, old_path, new_path, old_type, new_type`` for each file against the one before it.

    Records are decoded once for the catalogue of fields; those of files with fields both removed from and added to one
    parent are decoded once more to compare the values.
    """
    spans = spans_of(frame, file, text)
    added = spans.where(F.col("starts") & (F.col("rank") > 1)).select("file", F.col("steps").alias("new"), F.col("path").alias("new_path"), F.col("types").alias("new_type"))
    removed = spans.where(F.col("ends") & (F.col("rank") < F.col("last"))).select(F.col("file_after").alias("file"), F.col("steps").alias("old"), F.col("path").alias("old_path"), F.col("types").alias("old_type"))
    typed = spans.where(~F.col("starts") & (F.col("types") != F.col("types_before"))).select("file", F.lit("type").alias("change"), F.col("path").alias("old_path"), F.col("path").alias("new_path"), F.col("types_before").alias("old_type"), F.col("types").alias("new_type"))
    found = [(x.file, list(x.old), list(x.new)) for x in renames(spans, frame, file, key, text, same_share)]
    renamed = frame.sparkSession.createDataFrame(found, "file string, old array<string>, new array<string>")
    plain_removed = removed.join(renamed, ["file", "old"], "left_anti").select("file", F.lit("removed").alias("change"), "old_path", F.lit("").alias("new_path"), "old_type", F.lit("").alias("new_type"))
    plain_added = added.join(renamed, ["file", "new"], "left_anti").select("file", F.lit("added").alias("change"), F.lit("").alias("old_path"), "new_path", F.lit("").alias("old_type"), "new_type")
    moved = renamed.join(removed, ["file", "old"]).join(added, ["file", "new"])
    every = typed.unionByName(plain_removed).unionByName(plain_added).unionByName(moved.select("file", F.lit("renamed").alias("change"), "old_path", "new_path", "old_type", "new_type"))
    return every.withColumnRenamed("file", "export_file")


def aliases(found: Sequence[Rename]) -> dict[Steps, Steps]:
    """Old steps -> steps that the field has at last; as many entries as fields were renamed."""
    out: dict[Steps, Steps] = {}
    for one in sorted(found, key=lambda x: x.file):
        out = {old: one.new if new == one.old else new for old, new in out.items()} | {one.old: one.new}
    return {old: new for old, new in out.items() if old != new}


@dataclass
class Form:
    """What one field of the consistent table holds: its forms in all files, the fields below it or below its elements, and its column."""

    forms: set[str] = field(default_factory=set)
    below: dict[str, Form] = field(default_factory=dict)
    each: dict[str, Form] = field(default_factory=dict)
    column: str = ""

    @property
    def kind(self) -> str:
        """The type that can hold all forms without loss: itself, an array around scalars, or text."""
        forms = self.forms - {"nothing"}
        if not forms:
            return "array"
        if self.forms - forms:
            return "objects" if forms == {"objects"} else "string" if forms & {"object", "objects", "mixed"} else "array"
        if len(forms) == 1:
            return {"small": "long", "huge": "string", "mixed": "string"}.get(*forms, next(iter(forms)))
        if forms <= {"small", "long", "decimal"}:
            return "decimal" if "decimal" in forms else "long"
        if forms == {"small", "double"}:
            return "double"
        return "array" if "array" in forms and not forms & {"object", "objects", "mixed"} else "string"


def _named(level: Mapping[str, Form]) -> None:
    """Give each field of a level its column: its name, with a number where names differ in case only, which Spark does not tell apart."""
    seen: dict[str, int] = {}
    for name in sorted(level):
        count = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        level[name].column = name if count == 1 else f"{name}_{count}"
        _named(level[name].below)
        _named(level[name].each)


def forms_of(fields: Sequence[tuple[Steps, str]], names: Mapping[Steps, Steps]) -> dict[str, Form]:
    """The tree of all fields under their last names, down to ``MAX_DEPTH``."""
    top: dict[str, Form] = {}
    for steps, form in fields:
        if len(steps) > MAX_DEPTH:
            continue
        level, last = top, Form()
        for i in range(len(steps)):  # the names on the way may have changed too
            step = names.get(steps[: i + 1], steps)[i]
            if step == EACH:
                level = last.each
            else:
                last = level.setdefault(step[1:], Form())
                level = last.below
        last.forms.add(form)
    _named(top)
    return top


_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "decimal": T.DecimalType(38, 0), "boolean": T.BooleanType()}


def _schema(level: Mapping[str, Form]) -> T.StructType:
    """Spark schema of a level of fields and all below it."""
    fields = []
    for name in sorted(level):
        form, kind = level[name], _TYPES.get(level[name].kind, T.StringType())
        if form.kind == "object" and form.below:
            kind = _schema(form.below)
        elif form.kind in ("array", "objects"):
            kind = T.ArrayType(_schema(form.each) if form.kind == "objects" and form.each else T.StringType())
        fields.append(T.StructField(form.column, kind))
    return T.StructType(fields)


def _text(value: Any) -> str | None:
    """A value in a column of texts: texts as they are, others as JSON."""
    return None if value is None else clean(value) if type(value) is str else _encode(value)


def unify(node: dict[str, Any], level: Mapping[str, Form], names: Mapping[Steps, Steps], steps: Steps = ()) -> dict[str, Any]:
    """``node`` with fields under their last names and values in the form that all files share."""
    out: dict[str, Any] = {}
    for key, value in node.items():
        here = (*steps, "." + key)
        name = clean(names[here][-1][1:] if here in names else key)
        form = level.get(name)
        if value is None or form is None or here in names and node.get(name) is not None:  # beside a field under its last name the old one is left
            continue
        kind = form.kind
        if kind == "object" and form.below:
            value = unify(value, form.below, names, here)
        elif kind in ("array", "objects"):
            value = value if type(value) is list else [value]
            inside = kind == "objects" and form.each
            value = [None if x is None else unify(x, form.each, names, (*here, EACH)) if inside else _text(x) for x in value]
        elif kind == "double":
            value = float(value)
        elif kind == "decimal":
            value = Decimal(value)
        elif kind not in ("long", "boolean"):
            value = _text(value)
        out[form.column] = value
    return out


def consistent(frame: DataFrame, file: str, key: str, text: str, into: str = "flow") -> DataFrame:
    """One table of all files: the other columns, and ``into`` as a struct with one name and type per field.

    The catalogue and the alias table, which are as large as the schema and not as the data, are read first, since a
    table's schema must be known before it is planned; the records are decoded once for the catalogue, once where fields
    may have been renamed, and once into the table, straight to Arrow structs. Whole numbers are long, or decimal where
    they need it; a field with forms that have no common type is text, JSON where it was no text. Incomplete rows keep
    their other columns and get null; a column that already has the name ``into`` gives way.
    """
    fields = checkpointed(inventory(frame, file, text))
    names = aliases(renames(spans_of(frame, file, text, fields), frame, file, key, text))
    forms = forms_of([(tuple(x.steps), x.form) for x in fields.select("steps", "form").distinct().collect()], names)
    rest = [x for x in frame.columns if x not in (text, into)]
    shape = _schema(forms)
    if not shape.fields:
        return frame.select(*rest).distinct().withColumn(into, F.lit(None).cast(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(shape)
        for batch in batches:
            out = [unify(document, forms, names) if type(document) is dict else None for document in map(decode, batch[text].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in rest), pa.array(out, kind)], [*rest, into])

    schema = T.StructType([*(frame.schema[x] for x in rest), T.StructField(into, shape)])
    return frame.select(*rest, text).distinct().mapInArrow(run, schema)
