"""Deeply nested records as flat tables of objects with parent-child links.

Every object gets a Merkle identity: objects are canonicalised bottom-up (keys sorted, nested objects replaced by their
own identities) and hashed, so equal objects anywhere share one identity and need storing once, while each occurrence
stays a row of the bridge with its place, its ordinal and the place of the object that holds it. The bridge has the
documents themselves, the objects in arrays and those in fields, told apart by ``role``; together with the store it gives
the documents again (``rebuilt``); ``values`` has every scalar of them with its place.

Defined results: null, blank, cut off or otherwise incomplete texts give no rows; array elements that are not objects
give no row of the bridge but count as positions, and stand in the body of what holds them; a document that is an array
is stored like an object; identical rows give their occurrences once; a key that occurs twice in an object has its last
value; numbers are stored as Python writes them (0.70 as 0.7); lone surrogates from JSON escapes become U+FFFD in paths
and labels; null ids are left out, a null file name is ''.
"""

from __future__ import annotations

import json
from base64 import b64encode
from collections.abc import Iterator
from hashlib import sha256
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.jsontree import BROKEN, clean, decode
from skein.operators.skew import hot_keys, salted_join
from skein.session import checkpointed

#: Fields that name an object, in the order in which they are tried.
NAMING = ("id", "name", "nodeId")
#: Rows of an Arrow batch sent back to the JVM.
BATCH = 20_000
#: What an occurrence is: the whole document, an array element or the value of a field.
ROOT, ELEMENT, FIELD = "root", "element", "field"
#: Columns that name a document.
DOCUMENT = ("root_table", "root_id", "export_file")

_encode = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode

Occurrence = tuple[str, str, int, str, str, str]


def identity(body: str) -> str:
    """128 bits of the hash of a body, in 22 letters."""
    return b64encode(sha256(body.encode()).digest()[:16])[:22].decode()


def identity_of(body: Column) -> Column:
    """``identity`` as an expression."""
    return F.substring(F.base64(F.unhex(F.substring(F.sha2(body, 256), 1, 32))), 1, 22)


def shred(document: Any, single_is_array: bool = False, every: bool = True) -> tuple[list[Occurrence], list[tuple[str, str]]]:
    """Occurrences ``(path, parent_path, ordinal, child_key, object_id, role)``, and ``(object_id, body)`` of all objects.

    Without ``every`` only the occurrences of array elements are given.
    """
    if single_is_array and type(document) is dict:
        document = [document]
    if type(document) is not dict and type(document) is not list:
        return [], []
    places: list[tuple[str, str, int, str, Any, str]] = [("", "", -1, "", document, ROOT)] if every else []
    held: list[tuple[Any, str, str]] = [(document, "", "")]
    for value, path, parent in held:  # grows while it is read: what a container holds comes after it, at any depth
        start = f"{path}/" if path else ""
        if type(value) is dict:
            for key, item in value.items():
                if type(item) is dict:
                    held.append((item, start + key, parent))
                    if every:
                        places.append((start + key, parent, -1, next((item[x] for x in NAMING if type(item.get(x)) is str), ""), item, FIELD))
                elif type(item) is list:
                    held.append((item, start + key, parent))
            continue
        for place, item in enumerate(value):
            if type(item) is dict:
                inner = f"{start}{place}"
                places.append((inner, parent, place, next((item[key] for key in NAMING if type(item.get(key)) is str), ""), item, ELEMENT))
                held.append((item, inner, inner))
            elif type(item) is list:
                held.append((item, f"{start}{place}", parent))
    bodies: list[tuple[str, str]] = []
    known: dict[int, Any] = {}
    for value, _, _ in reversed(held):
        if type(value) is dict:
            body = _encode({key: item if type(item) is not dict and type(item) is not list else known[id(item)] for key, item in value.items()})
            name = identity(body)
            bodies.append((name, body))
            known[id(value)] = {"#": name}
        else:
            known[id(value)] = [item if type(item) is not dict and type(item) is not list else known[id(item)] for item in value]
    if type(document) is list:
        body = _encode(known[id(document)])
        bodies.append((identity(body), body))
        known[id(document)] = {"#": bodies[-1][0]}
    return [(path, parent, place, label, known[id(item)]["#"], role) for path, parent, place, label, item, role in places], bodies


def _documents(frame: DataFrame, root_id: str, text: str, export_file: str | None) -> DataFrame:
    name = F.coalesce(F.col(export_file).cast("string"), F.lit("")) if export_file else F.lit("")
    kept = frame.select(F.col(root_id).cast("long").alias("root_id"), name.alias("export_file"), F.col(text).alias("text"))
    return kept.where(F.col("root_id").isNotNull() & F.col("text").isNotNull()).distinct()


def occurrences(frame: DataFrame, root_table: str, root_id: str, text: str, export_file: str | None = None, single_is_array: bool = False, every: bool = True) -> DataFrame:
    """The bridge: one row for every document, every object that is an element of an array and every one in a field, at any depth.

    Columns ``root_table, root_id, export_file, path, parent_path, ordinal, child_key, object_id, role``; ``parent_path``
    is the nearest enclosing array element, '' if none; ``ordinal`` is the place in an array, -1 elsewhere. Without
    ``every`` there are only elements of arrays. Source rows are made distinct before they are decoded, so no expanded
    row is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[Any]] = [[] for _ in range(8)]
            ids, files, *parts = columns
            for key, name, body in zip(batch["root_id"].to_pylist(), batch["export_file"].to_pylist(), batch["text"].to_pylist(), strict=True):
                document = decode(body)
                if document is BROKEN:
                    continue
                rows, _ = shred(document, single_is_array, every)
                if not rows:
                    continue
                ids += [key] * len(rows)
                files += [name] * len(rows)
                for part, values in zip(parts, zip(*rows, strict=True), strict=True):
                    part += values
                if len(ids) >= BATCH:
                    yield _bridge(columns)
                    for part in columns:
                        part.clear()
            if ids:
                yield _bridge(columns)

    schema = "root_id long, export_file string, path string, parent_path string, ordinal int, child_key string, object_id string, role string"
    return _documents(frame, root_id, text, export_file).mapInArrow(run, schema).select(F.lit(root_table).alias("root_table"), "*")


def _strings(values: list[str]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([clean(x) for x in values], pa.string())


def _bridge(columns: list[list[Any]]) -> pa.RecordBatch:
    ids, files, paths, parents, places, labels, names, roles = columns
    arrays = [pa.array(ids, pa.int64()), _strings(files), _strings(paths), _strings(parents), pa.array(places, pa.int32()), _strings(labels), pa.array(names, pa.string()), pa.array(roles, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["root_id", "export_file", "path", "parent_path", "ordinal", "child_key", "object_id", "role"])


def counts(frame: DataFrame, root_id: str, text: str, export_file: str | None = None, single_is_array: bool = False) -> DataFrame:
    """``body, occurrences`` with equal objects combined within each Arrow batch only; ``store`` brings them together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, int] = {}
            for body in batch["text"].to_pylist():
                document = decode(body)
                if document is not BROKEN:
                    for _, item in shred(document, single_is_array, every=False)[1]:
                        held[item] = held.get(item, 0) + 1
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], ["body", "occurrences"])

    return _documents(frame, root_id, text, export_file).mapInArrow(run, "body string, occurrences long")


def store(found: DataFrame) -> DataFrame:
    """Every distinct object once, from the ``counts`` of one source or the union of several.

    Only bodies and counts are shuffled; the identity follows from the body.
    """
    return found.groupBy("body").agg(F.sum("occurrences").alias("occurrences")).select(identity_of(F.col("body")).alias("object_id"), "body", "occurrences")


def objects(frame: DataFrame, root_id: str, text: str, export_file: str | None = None, single_is_array: bool = False) -> DataFrame:
    """The store: every distinct object once, as ``object_id, body, occurrences``; nested objects in a body are ``{"#": object_id}``.

    Equal objects are combined within each Arrow batch and again before the shuffle, so an object that stands in a third
    of all rows costs a row per batch. Documents that are arrays are in the store too.
    """
    return store(counts(frame, root_id, text, export_file, single_is_array))


def _scalars(body: str, path: str) -> Iterator[tuple[str, str, str]]:
    """``(path, type, value)`` of every scalar of one body; nested objects have bodies of their own."""
    start = f"{path}/" if path else ""
    document = json.loads(body)
    open_ = [(f"{start}{key}", item) for key, item in (document.items() if type(document) is dict else enumerate(document))]
    for place, value in open_:  # grows while it is read
        if type(value) is list:
            open_ += [(f"{place}/{number}", item) for number, item in enumerate(value)]
        elif type(value) is str:
            yield place, "string", value
        elif value is None:
            yield place, "null", ""
        elif type(value) is not dict:
            yield place, "boolean" if type(value) is bool else "number", _encode(value)


def values(frame: DataFrame, root_table: str, root_id: str, text: str, export_file: str | None = None, single_is_array: bool = False) -> DataFrame:
    """Every scalar of every document: ``root_table, root_id, export_file, path, type, value``; null has the value ''.

    They are the scalars of the body of each occurrence, placed by its path: what bridge and store hold, brought together
    where a document is decoded, so nothing but the source rows is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: list[tuple[str, str, str]] = []
            for row, body in enumerate(batch["text"].to_pylist()):
                document = decode(body)
                if document is BROKEN:
                    continue
                places, bodies = shred(document, single_is_array)
                known = dict(bodies)
                for path, _, _, _, name, _ in places:
                    out += _scalars(known[name], path)
                rows += [row] * (len(out) - len(rows))
                if len(out) >= BATCH:
                    yield _valued(batch, rows, out)
                    rows, out = [], []
            if out:
                yield _valued(batch, rows, out)

    found = _documents(frame, root_id, text, export_file).mapInArrow(run, "root_id long, export_file string, path string, type string, value string")
    return found.select(F.lit(root_table).alias("root_table"), "*")


def _valued(batch: pa.RecordBatch, rows: list[int], out: list[tuple[str, str, str]]) -> pa.RecordBatch:
    paths, types, texts = zip(*out, strict=True)
    places = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([batch["root_id"].take(places), batch["export_file"].take(places), _strings(list(paths)), pa.array(types, pa.string()), _strings(list(texts))], ["root_id", "export_file", "path", "type", "value"])


def _assembled(root: str, bodies: dict[str, str]) -> str:
    """The document with this identity, with references replaced by what they name, at any depth."""
    top: list[Any] = [{"#": root}]
    open_: list[Any] = [top]
    while open_:
        value = open_.pop()
        for key, item in list(value.items() if type(value) is dict else enumerate(value)):
            if type(item) is dict:  # in a body every object is a reference
                item = value[key] = json.loads(bodies[item["#"]])
            if type(item) is dict or type(item) is list:
                open_.append(item)
    return _encode(top[0])


def rebuilt(bridge: DataFrame, stored: DataFrame) -> DataFrame:
    """The documents again, from bridge and store alone: ``root_table, root_id, export_file, document`` as canonical JSON.

    The bridge is checkpointed, as its hot objects are measured and split before the bodies join it. The objects of one
    document come together in one row, which is as large as the document.
    """
    held = checkpointed(bridge)
    hot = hot_keys({"bridge": (held, "object_id")})["bridge"]
    rows = salted_join(held, stored.select(F.col("object_id").alias("__object"), "body"), "object_id", "__object", "root_id", hot, how="inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_assembled(root, {x["object_id"]: x["body"] for x in held}) for root, held in zip(batch["root"].to_pylist(), batch["held"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in DOCUMENT), pa.array(texts, pa.string())], [*DOCUMENT, "document"])

    grouped = rows.groupBy(*DOCUMENT).agg(F.max(F.when(F.col("role") == ROOT, F.col("object_id"))).alias("root"), F.collect_set(F.struct("object_id", "body")).alias("held"))
    return grouped.mapInArrow(run, "root_table string, root_id long, export_file string, document string")
