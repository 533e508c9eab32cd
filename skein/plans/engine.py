"""Workflow graphs compiled to DataFrame plans: one row of inputs is one run.

The graph is analysed on the driver; what comes out is an ordinary plan over the table of inputs. Input and output nodes
and the rendering of prompts are column expressions, so Catalyst sees through them; only model calls cross into Python,
a whole Arrow batch at a time. Speech turns the runs so far, checkpointed so that no call is repeated, into one row per
chunk of text, spread over all tasks, and brings the audio of each run together again. Each row carries ``cur``, the record that the last node gave, ``outs``, the records by
node, and ``error``.

The two engines differ as follows. ``dag`` runs all nodes in topological order, resolves references by name in the
record of the node before, stops a run at its first error and then gives no output. ``langgraph`` runs what is reachable
from the single entry, lets output nodes refer to any node, goes on after an error with the last good record, and lists
successful nodes only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.chunking import chunk_table
from skein.operators.skew import tasks_of
from skein.plans import graph as graphs
from skein.plans import providers
from skein.plans.graph import Graph, GraphError, Node
from skein.session import checkpointed, shared_folder
from skein.sources import sinks

RECORD = "map<string,string>"
RESULT = f"struct<nodeId:string,nodeName:string,status:string,input:{RECORD},output:{RECORD},error:string,duration:int,progress:array<string>>"

#: Compiles a node: from the node, the current record and the records by node to a struct of output and error.
Compile = Callable[[Node, Column, Column, "Settings"], Column]

#: Compiles a node that needs more than one row of a run: from the node, the runs and their current record to the runs with a column ``step``.
Transform = Callable[[Node, DataFrame, Column, "Settings"], DataFrame]

_nodes: dict[str, Compile] = {}
_transforms: dict[str, Transform] = {}


class Settings:
    """What nodes need besides their own data: configurations by id, skills by name, the engine, whether someone listens to progress, and the folder for audio."""

    def __init__(self, engine: str, configs: Mapping[int, Mapping[str, Any]] | None = None, skills: Mapping[str, str] | None = None, speak: providers.Speak = providers.tone, listen: bool = False, audio_folder: str | None = None) -> None:
        self.engine, self.configs, self.skills, self.speak, self.listen, self.audio_folder = engine, configs or {}, skills or {}, speak, listen, audio_folder


def node(*kinds: str) -> Callable[[Compile], Compile]:
    """Register how nodes of these kinds are compiled."""

    def add(how: Compile) -> Compile:
        for kind in kinds:
            _nodes[kind] = how
        return how

    return add


def _step(record: Column, error: Column | None = None, ms: Column | None = None, progress: Column | None = None) -> Column:
    told = F.array() if progress is None else progress
    return F.struct(record.cast(RECORD).alias("out"), (F.lit(None) if error is None else error).cast("string").alias("error"), (F.lit(0) if ms is None else ms).cast("int").alias("ms"), told.cast("array<string>").alias("progress"))


def _field(record: Column, name: str) -> Column:
    return F.element_at(record, F.lit(name))


def _map(values: Mapping[str, Column]) -> Column:
    parts = [x for name, value in values.items() for x in (F.lit(name), value)]
    return F.create_map(*parts).cast(RECORD) if parts else F.create_map().cast(RECORD)


def _referred(record: Column, name: str) -> Column:
    found = _field(record, name)
    return F.coalesce(found, _field(record, "input")) if name == "user_input" else found


def prompt_params(data: Mapping[str, Any], record: Column) -> dict[str, Column]:
    """Parameters of a prompt: static values, and references by the name after the last dot in the current record."""
    values: dict[str, Column] = {}
    for param in data.get("inputParams") or ():
        name, reference = param.get("name"), param.get("referenceNode") or param.get("ref")
        if param.get("type") == "input" and param.get("value") is not None:
            values[name] = F.lit(str(param["value"]))
        elif param.get("type") == "reference" and reference and "." in reference:
            found = _referred(record, reference.rpartition(".")[2])
            values[name] = F.coalesce(found, values[name]) if name in values else found
    return values


def output_params(data: Mapping[str, Any], record: Column, outs: Column, by_node: bool) -> dict[str, Column]:
    """Parameters of an answer: static values, and references, with ``by_node`` first in the record of the named node."""
    values: dict[str, Column] = {}
    for param in data.get("outputParams") or ():
        name, reference = param.get("name"), param.get("referenceNode") or param.get("ref")
        if param.get("type") == "input":
            values[name] = F.lit(param.get("value"))
        elif param.get("type") == "reference" and reference and "." in reference:
            first, last = reference.split(".")[0], reference.split(".")[-1]
            found = _referred(record, last)
            if by_node:
                found = F.coalesce(_field(_field(outs, first), last), found)
            values[name] = F.coalesce(found, values[name]) if name in values else found
    return values


@node("input")
def _input(item: Node, record: Column, outs: Column, settings: Settings) -> Column:
    return _step(record)


@node("output")
def _output(item: Node, record: Column, outs: Column, settings: Settings) -> Column:
    template = item.data.get("responseContent")
    if not template:
        return _step(_map({"output": F.coalesce(_field(record, "output"), _field(record, "input"))}))
    params = output_params(item.data, record, outs, settings.engine == "langgraph")
    return _step(_map({"output": text.render(F.lit(template), _map(params))}))


def canonical(name: Any, aliases: Mapping[str, str] = text.RUN_ALIASES) -> str | None:
    """The name of a provider as runs know it; None for null and blank."""
    plain = str(name).strip().lower() if name is not None else ""
    return aliases.get(plain, plain) or None


def resolve_config(data: Mapping[str, Any], kind: str, configs: Mapping[int, Mapping[str, Any]]) -> dict[str, Any]:
    """Provider, address, key, model and temperature of a node: those of its configuration if that exists, else its own.

    A blank provider is that of the node's data, else its kind, but none for ``llm``; ``operators.metadata.resolved_configs``
    is the same rule over tables.
    """
    number = data.get("configId")
    if number is not None and str(number).strip():
        if not str(number).strip().isdigit():
            raise GraphError(f"configId {number!r} is no number")
        number = int(number)
    own = {"provider": data.get("provider"), "api_url": data.get("apiUrl"), "api_key": data.get("apiKey"), "model": data.get("model"), "temperature": data.get("temperature")}
    source = configs.get(number, own)
    heat = source.get("temperature")
    provider = canonical(source.get("provider")) or canonical(data.get("provider")) or (canonical(kind) if kind != "llm" else None)
    return {**source, "provider": provider, "temperature": 0.7 if heat is None else float(heat)}


@node(*providers.KINDS)
def _complete(item: Node, record: Column, outs: Column, settings: Settings) -> Column:
    config = resolve_config(item.data, item.type, settings.configs)
    missing = [x for x in ("provider", "api_url", "api_key", "model") if not str(config.get(x) or "").strip()]
    if missing:
        return _step(F.lit(None), F.lit("the configuration lacks " + ", ".join(missing)))
    call, model, heat = providers.completer(canonical(config["provider"], text.CLIENT_ALIASES)), str(config["model"]), config["temperature"]
    if call is None:
        return _step(F.lit(None), F.lit(f"the provider {config['provider']} is not supported"))
    system = settings.skills.get(item.data.get("skillName") or "", "")
    streaming = item.data.get("streaming") is True and settings.listen

    @F.pandas_udf("content string, input int, output int, total int, error string, ms int, parts array<string>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        wanted = prompts.notna()
        began = time.monotonic()
        try:
            found = [(x.content, *((0, 0, 0) if streaming else x.counts()), None, list(x.parts) or [x.content] if streaming else []) for x in call(model, heat, system, prompts[wanted].tolist())]
        except Exception as problem:  # a provider may fail in any way; the run and not the job fails
            found = [(None, 0, 0, 0, str(problem), [])] * int(wanted.sum())
        each = int((time.monotonic() - began) * 1000 / max(1, len(found)))  # a call for many prompts counts evenly
        rows: list[tuple[Any, ...]] = [(None, 0, 0, 0, None, 0, [])] * len(prompts)
        for place, (*one, parts) in zip(wanted.to_numpy().nonzero()[0].tolist(), found, strict=True):
            rows[place] = (*one, each, parts)
        return pd.DataFrame(rows, columns=["content", "input", "output", "total", "error", "ms", "parts"])

    prompt = text.render(F.lit(item.data.get("prompt")), _map(prompt_params(item.data, record)))
    # a failed record asks for nothing; the call has a cost, so it is neither repeated nor left out by the optimizer
    answer = run.asNondeterministic()(F.when(record.isNotNull(), prompt))
    names = [x["name"] for x in item.data.get("outputParams") or () if x.get("name")] or ["output"]

    def project(one: Column) -> Column:
        values = {name: one["content"] for name in names}
        values |= {"inputTokens": one["input"].cast("string"), "outputTokens": one["output"].cast("string"), "totalTokens": one["total"].cast("string"), "tokens": one["total"].cast("string")}
        return _step(F.when(one["error"].isNull(), _map(values)), one["error"], one["ms"], one["parts"])

    return F.element_at(F.transform(F.array(answer), project), 1)


def speech_text(data: Mapping[str, Any], record: Column) -> Column:
    """What a speech node reads: its parameter ``text``, else the output, the input or the text of the record."""
    rest = F.coalesce(*(F.when(~text.is_blank(_field(record, x)), _field(record, x)) for x in ("output", "input")), _field(record, "text"))
    for param in data.get("inputParams") or ():
        if param.get("name") == "text":
            if param.get("type") == "input":
                return F.lit(param.get("value")).cast("string")
            parts = (param.get("referenceNode") or param.get("ref") or "").split(".")
            if param.get("type") == "reference" and len(parts) == 2:
                return F.coalesce(_field(record, parts[1]), rest)
    return rest


def _speech(item: Node, rows: DataFrame, record: Column, settings: Settings) -> DataFrame:
    """Text cut into chunks, each spoken on its own, merged in order and stored; the record names the address."""
    if not str(item.data.get("apiKey") or "").strip():
        return rows.withColumn("step", _step(F.lit(None), F.lit("speech needs an apiKey")))
    wanted, speak = str(item.data.get("voice") or "").strip().upper(), settings.speak
    voice = wanted if wanted in text.VOICES else text.VOICES[0]
    said = speech_text(item.data, record)
    held = checkpointed(rows.withColumn("__run", F.monotonically_increasing_id()).withColumn("__said", F.when(record.isNotNull() & ~text.is_blank(said), said)))

    @F.pandas_udf("wav binary, error string, ms int")
    def voiced(parts: pd.Series) -> pd.DataFrame:
        out = []
        for part in parts:
            began = time.monotonic()
            try:
                one = (speak(part, voice), None)
            except Exception as problem:  # fails the run and not the job
                one = (None, str(problem))
            out.append((*one, int((time.monotonic() - began) * 1000)))
        return pd.DataFrame(out, columns=["wav", "error", "ms"])

    parts = chunk_table(held.where("__said is not null"), "__run", "__said")
    tasks = tasks_of(rows.sparkSession)
    spoken = parts.repartition(tasks, "__run", "position").withColumn("one", voiced.asNondeterministic()("chunk"))
    pieces = F.array_sort(F.collect_list(F.struct("position", F.col("one.wav").alias("wav"), F.substring("chunk", 1, 50).alias("begin"))))
    whole = spoken.groupBy("__run").agg(pieces.alias("pieces"), F.min("one.error").alias("error"), F.sum("one.ms").cast("int").alias("ms"))
    folder = settings.audio_folder or f"{shared_folder(rows.sparkSession)}/audio"
    wavs = whole.select(F.col("__run").alias("key"), F.col("pieces.wav").alias("content"), F.struct(F.transform("pieces", lambda x: F.concat(x["begin"], F.lit("..."))).alias("told"), "error", "ms").alias("more"))
    stored = sinks.store_merged(wavs, folder).select(F.col("key").alias("__key"), "url", F.col("problem"), "more")
    joined = held.join(stored, F.col("__run") == F.col("__key"), "left")
    name = F.substring_index("url", "/", -1)
    made = _map({"audioUrl": F.col("url"), "fileName": name, "output": F.col("url"), "chunks": F.size("more.told").cast("string")})
    error = F.when(F.col("__key").isNull(), "there is no text to speak").otherwise(F.coalesce("more.error", "problem"))
    return joined.withColumn("step", _step(F.when(error.isNull(), made), error, F.coalesce("more.ms", F.lit(0)), F.coalesce("more.told", F.array().cast("array<string>"))))


_transforms["tts"] = _speech


def run_workflow(inputs: DataFrame, flow: str | Graph, engine: str | None = "dag", key: str = "run_id", value: str = "input", tie_order: str = "list", **settings: Any) -> DataFrame:
    """Run a workflow over a table of inputs: ``key, status, output, error, node_results, input_data, duration``.

    ``output`` is the last record as JSON; ``node_results`` has per node its id, kind, status, input, output, error,
    milliseconds and the parts of its progress; ``duration`` is their sum. A graph that cannot be planned is an error
    before anything runs, but with ``langgraph`` a document that is no graph gives FAILED runs.
    """
    chosen = graphs.select_engine(engine)
    given = Settings(chosen, **settings)
    rows = inputs.select(F.col(key), F.create_map(F.lit("input"), F.col(value).cast("string")).cast(RECORD).alias("cur")).withColumn("outs", F.create_map().cast(f"map<string,{RECORD}>"))
    rows = rows.withColumn("error", F.lit(None).cast("string")).withColumn("results", F.array().cast(f"array<{RESULT}>")).withColumn("input_data", F.to_json("cur", {"ignoreNullFields": "false"}))
    try:
        plan = graphs.parse(flow) if isinstance(flow, str) else flow
    except GraphError as problem:
        if chosen == "dag":
            raise
        return rows.select(key, F.lit("FAILED").alias("status"), F.lit(None).cast("string").alias("output"), F.lit(str(problem)).alias("error"), F.col("results").alias("node_results"), "input_data", F.lit(0).alias("duration"))
    for item in graphs.topological(plan, tie_order) if chosen == "dag" else graphs.reachable(plan, tie_order):
        if item.type not in _nodes and item.type not in _transforms:
            raise GraphError(f"{item.id} has the unknown type {item.type!r}")
        alive = F.col("error").isNull() if chosen == "dag" else F.lit(True)
        before = F.when(alive, F.col("cur"))
        rows = _transforms[item.type](item, rows, before, given) if item.type in _transforms else rows.withColumn("step", _nodes[item.type](item, before, F.col("outs"), given))
        good = alive & F.col("step.error").isNull()
        status = F.when(F.col("step.error").isNull(), "SUCCESS").otherwise("FAILED")
        result = F.struct(F.lit(item.id).alias("nodeId"), F.lit(item.type).alias("nodeName"), status.alias("status"), F.col("cur").alias("input"), F.col("step.out").alias("output"), F.col("step.error").alias("error"), F.col("step.ms").alias("duration"), F.col("step.progress").alias("progress"))
        listed = alive if chosen == "dag" else good
        rows = rows.select(
            key,
            F.when(good, F.col("step.out")).otherwise(F.col("cur")).alias("cur"),
            F.when(good, F.map_concat("outs", F.create_map(F.lit(item.id), F.col("step.out")))).otherwise(F.col("outs")).alias("outs"),
            F.coalesce(F.col("error"), F.when(alive, F.col("step.error"))).alias("error"),
            F.when(listed, F.array_append("results", result)).otherwise(F.col("results")).alias("results"),
            "input_data",
        )
    failed = F.col("error").isNotNull()
    output = F.when(~failed, F.to_json("cur")) if chosen == "dag" else F.to_json("cur")
    spent = F.aggregate("results", F.lit(0), lambda done, x: done + x["duration"])
    return rows.select(key, F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"), output.alias("output"), "error", F.col("results").alias("node_results"), "input_data", spent.alias("duration"))


def execution_records(runs: DataFrame, flow_id: int, key: str = "run_id") -> DataFrame:
    """Runs in the form of the execution_record table, ready to be appended."""
    results = F.to_json(F.transform("node_results", lambda x: x.dropFields("progress")))
    return runs.select(F.lit(flow_id).cast("long").alias("flow_id"), F.col(key).alias("run_id"), "input_data", F.col("output").alias("output_data"), "status", results.alias("node_results"), F.col("error").alias("error_message"), "duration", F.current_timestamp().alias("executed_at"), F.lit(0).alias("deleted"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(value.alias(name) for name, value in fields.items())))


def run_events(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """The events of each run in order: start; per node its start, progress and end; completion. ``seq`` numbers them; order never follows from time.

    Streamed completions tell each part and the text so far, which takes the square of a text's parts, as its listener
    gets it; ``events.final_text`` folds the parts alone. Speech tells the number of chunks, begin and end of each, and
    the merging.
    """

    def event(kind: str | Column, one: Column | None = None, payload: Column | None = None) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        none = F.lit(None).cast("string")
        return F.struct(kind.alias("event_type"), (one["nodeId"] if one is not None else none).alias("node_id"), (one["nodeName"] if one is not None else none).alias("node_name"), (payload if payload is not None else none).alias("data"))

    def told(one: Column) -> Column:
        parts, total = one["progress"], F.size(one["progress"])
        streamed = F.transform(parts, lambda x, i: event("NODE_PROGRESS", one, _json(chunk=x, accumulated=F.array_join(F.slice(parts, 1, i + 1), ""))))
        begin = event("NODE_PROGRESS", one, _json(totalChunks=total, currentChunk=F.lit(0)))
        each = F.flatten(F.transform(parts, lambda x, i: F.array(event("NODE_PROGRESS", one, _json(totalChunks=total, currentChunk=i + 1, chunkText=x)), event("NODE_PROGRESS", one, _json(totalChunks=total, currentChunk=i + 1, completedChunks=i + 1)))))
        spoken = F.concat(F.array(begin), each, F.array(event("NODE_PROGRESS", one)))
        return F.when(total == 0, F.slice(streamed, 1, 0)).when(one["nodeName"] == "tts", spoken).otherwise(streamed)

    def ended(one: Column) -> Column:
        payload = F.when(one["status"] == "SUCCESS", _json(input=one["input"], output=one["output"], duration=one["duration"])).otherwise(_json(error=one["error"]))
        return F.concat(F.array(event("NODE_START", one)), told(one), F.array(event(F.when(one["status"] == "SUCCESS", "NODE_SUCCESS").otherwise("NODE_ERROR"), one, payload)))

    every = F.concat(F.array(event("WORKFLOW_START")), F.flatten(F.transform("node_results", ended)), F.array(event("WORKFLOW_COMPLETE", None, F.col("output"))))
    return runs.select(key, F.posexplode(every).alias("seq", "event")).select(key, "seq", "event.*")
