"""Queries of the workflow operators over the test tables, each with the equivalent SQL where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import audio, chunking, crypto, text
from skein.operators import events, graphs, metadata
from skein.plans import engine, providers
from skein.session import checkpointed, shared_folder
from skein.sources import sinks, skills
from skein.sources.tables import table
from skein.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


def _body(column: str) -> str:
    inner = f"{column}::json->>'$'"
    return f"case when json_valid({column}) then case when json_type({column}) = 'VARCHAR' then case when json_valid({inner}) then {inner} end else {column} end end"


#: The current row of each workflow, and the nodes and edges of those that are not deleted.
_CURRENT = f"""
with cur as (
  select * from (select *, row_number() over (partition by id order by updated_at desc) as k from workflow where id is not null)
  where k = 1 and coalesce(deleted, 0) = 0
), flow as (
  select id, {_body("flow_data")} as body from cur
), node as (
  select id, unnest(generate_series(0, len(json_extract(body, '$.nodes[*]')) - 1)) as position, unnest(json_extract(body, '$.nodes[*]')) as n from flow where body is not null
), nodes as (
  select id, position, n->>'$.id' as node_id, coalesce(nullif(n->>'$.data.type', ''), nullif(n->>'$.type', 'default')) as node_type, n->>'$.data.label' as label, n from node
), edge as (
  select id, unnest(generate_series(0, len(json_extract(body, '$.edges[*]')) - 1)) as position, unnest(json_extract(body, '$.edges[*]')) as e from flow where body is not null
), edges as (
  select id, position, e->>'$.source' as source, e->>'$.target' as target from edge
)
"""


def _workflows(spark: SparkSession, folder: str) -> DataFrame:
    return metadata.active(metadata.current(table(spark, folder, "workflow")))


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.nodes(_workflows(spark, folder))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.edges(_workflows(spark, folder))


@query(_CURRENT + "select id, name, owner_id, case when lower(trim(engine_type)) = 'langgraph' then 'langgraph' else 'dag' end as engine, updated_at from cur")
def w_workflows(spark: SparkSession, folder: str) -> DataFrame:
    """Current workflows with their engine."""
    return _workflows(spark, folder).select("id", "name", "owner_id", text.engine(F.col("engine_type")).alias("engine"), "updated_at")


@query(_CURRENT + "select id, name, updated_at from cur where owner_id = 1")
def w_owned_workflows(spark: SparkSession, folder: str) -> DataFrame:
    """Workflows that user 1 may see, latest first."""
    return metadata.accessible(_workflows(spark, folder), user=1, admin=False).select("id", "name", "updated_at").orderBy(F.desc("updated_at"))


@query("""select id, lower(trim(username)) as username, case when upper(trim(role)) = 'ADMIN' then 'ADMIN' else 'USER' end as role
from (select *, row_number() over (partition by id order by updated_at desc) as k from app_user) where k = 1 and coalesce(deleted, 0) = 0 and enabled = 1""")
def w_users(spark: SparkSession, folder: str) -> DataFrame:
    """Users who may log in, with names and roles in one form."""
    return metadata.usable_users(metadata.current(table(spark, folder, "app_user")))


@query("""with last as (select * from (select *, row_number() over (partition by node_type order by id desc) as k from node_definition) where k = 1)
select node_type, display_name, category, icon from last where coalesce(deleted, 0) = 0
union all select 'llm', '大模型', 'LLM', '🤖' where not exists (select 1 from last where node_type = 'llm')""")
def w_node_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """One definition per node type."""
    return metadata.node_definitions(table(spark, folder, "node_definition"))


_CONFIG = "id, provider, config_name, model, is_default"


@query(f"select {_CONFIG}, '' as api_key from llm_global_config where coalesce(deleted, 0) = 0")
def w_configs_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations as seen by those who are no administrators."""
    return metadata.masked_configs(table(spark, folder, "llm_global_config"), admin=False).select("id", "provider", "config_name", "model", "is_default", "api_key")


@query(f"select {_CONFIG} from (select *, row_number() over (partition by provider order by is_default desc nulls last, updated_at desc nulls last, id desc) as k from llm_global_config where coalesce(deleted, 0) = 0) where k = 1")
def w_default_configs(spark: SparkSession, folder: str) -> DataFrame:
    """The first configuration of each provider."""
    return metadata.first_configs(table(spark, folder, "llm_global_config")).select("id", "provider", "config_name", "model", "is_default")


@query("select provider, count(*) as configs from llm_global_config where coalesce(deleted, 0) = 0 group by provider")
def w_provider_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metadata.provider_counts(table(spark, folder, "llm_global_config"))


_CANON = "case lower(trim(provider)) when 'stepfun' then 'step' when '阶跃星辰' then 'step' when '通义千问' then 'qwen' when '智谱' then 'zhipu' when 'ai ping' then 'ai_ping' {more} else {other} end"
_CLIENT = "when 'open ai' then 'openai' when 'deep seek' then 'deepseek'"


@query(f"""select id, {_CANON.format(more="", other="lower(trim(provider))")} as at_run, coalesce({_CANON.format(more=_CLIENT, other="lower(trim(provider))")}, '') as at_client,
{_CANON.format(more=_CLIENT, other="trim(provider)")} as in_storage,
rtrim(regexp_replace(regexp_replace(rtrim(trim(api_url), '/'), '/v1/chat/completions$', '', 'i'), '/v1$', '', 'i'), '/') as base_url from llm_global_config""")
def w_providers(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical names of providers for each use, and base addresses."""
    name = F.col("provider")
    return table(spark, folder, "llm_global_config").select("id", text.provider(name).alias("at_run"), text.provider(name, "client").alias("at_client"), text.provider(name, "storage").alias("in_storage"), text.base_url(F.col("api_url")).alias("base_url"))


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    """A change of one configuration to default, and a copy of each under a new name."""
    rows = table(spark, folder, "llm_global_config")
    update = rows.where("config_name = 'profile-01'").withColumn("is_default", F.lit(1)).withColumn("deleted", F.lit(0))
    added = rows.withColumn("id", F.col("id") + 1000).withColumn("config_name", F.concat(F.lit(" copy "), "id")).withColumn("is_default", F.lit(None).cast("int")).withColumn("deleted", F.lit(0))
    return update.unionByName(added)


@query(f"""with change as (
  select id, {_CANON.format(more=_CLIENT, other="nullif(trim(provider), '')")} as provider, trim(config_name) as config_name, 1 as is_default, 0 as deleted, false as fresh from llm_global_config where config_name = 'profile-01'
  union all
  select id + 1000, {_CANON.format(more=_CLIENT, other="nullif(trim(provider), '')")}, 'copy ' || (id + 1000), null, 0, true from llm_global_config
), kept as (
  select c.* from llm_global_config c where c.id not in (select id from change)
  and not exists (select 1 from change x where x.provider = c.provider and x.config_name = c.config_name and x.id <> c.id and c.deleted = 1)
), held as (select distinct provider from kept where coalesce(deleted, 0) = 0),
ranked as (select *, row_number() over (partition by provider, fresh order by id) as k from change)
select k.id, k.provider, k.config_name,
  case when k.provider in (select provider from change where not fresh) then 0 else k.is_default end as is_default, k.deleted from kept k
union all
select id, provider, config_name,
  case when fresh and (provider is null or provider not in (select provider from held where provider is not null)) and k = 1 then 1 else coalesce(is_default, 0) end, deleted from ranked""")
def w_config_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The table of configurations after a set of changes."""
    return metadata.upserted(table(spark, folder, "llm_global_config"), _changes(spark, folder)).select("id", "provider", "config_name", "is_default", "deleted")


@query("""with gone as (select id, provider from (select *, row_number() over (order by id) as k from llm_global_config where is_default = 1 and coalesce(deleted, 0) = 0) where k = 1),
rest as (select * from llm_global_config where id not in (select id from gone)),
next as (select id from (select *, row_number() over (order by is_default desc nulls last, updated_at desc nulls last, id desc) as k from rest where coalesce(deleted, 0) = 0 and provider in (select provider from gone)) where k = 1)
select id, provider, case when id in (select id from next) then 1 else is_default end as is_default from rest""")
def w_config_delete(spark: SparkSession, folder: str) -> DataFrame:
    """The table without its first default configuration, the next one promoted."""
    rows = table(spark, folder, "llm_global_config")
    first = metadata.active(rows).where("is_default = 1").agg(F.min("id")).first()[0]
    return metadata.without_config(rows, first).select("id", "provider", "is_default")


@query(_CURRENT + "select id, position::int as position, node_id, node_type, label from nodes")
def w_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the current workflows."""
    return _nodes(spark, folder)


@query(_CURRENT + "select id, position::int as position, source, target from edges")
def w_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the current workflows."""
    return _edges(spark, folder)


@query(_CURRENT + "select id, target as node_id, array_to_string(list(source order by position), ',') as sources from edges group by id, target")
def w_fan_in(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of the edges into each node."""
    return graphs.fan_in(_edges(spark, folder)).withColumn("sources", F.array_join("sources", ","))


_END = """, free as (
  select n.id, arg_min(n.node_id, n.position) as node_id from nodes n
  where not exists (select 1 from edges e where e.id = n.id and e.{end} = n.node_id) group by n.id
), rest as (select id, {pick}(node_id, position) as node_id from nodes group by id)
select r.id, coalesce(f.node_id, r.node_id) as {name} from rest r left join free f using (id)"""


@query(_CURRENT + _END.format(end="target", pick="arg_min", name="entry"))
def w_entry_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.ends(_nodes(spark, folder), _edges(spark, folder), which="entry")


@query(_CURRENT + _END.format(end="source", pick="arg_max", name="exit"))
def w_exit_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.ends(_nodes(spark, folder), _edges(spark, folder), which="exit")


@query(_CURRENT + """select distinct id, position::int as position, source, target from edges e
where not exists (select 1 from nodes n where n.id = e.id and n.node_id = e.source) or not exists (select 1 from nodes n where n.id = e.id and n.node_id = e.target)""")
def w_unknown_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that name unknown nodes."""
    return graphs.unknown_ends(_nodes(spark, folder), _edges(spark, folder))


@query(_CURRENT.replace("with cur", "with recursive cur", 1) + """, e as (select distinct id, source, target from edges), reach as (
  select id, source as a, target as b from e union select r.id, r.a, e.target from reach r join e on e.id = r.id and e.source = r.b
), looped as (select id, a from reach where a = b), apart as (
  select id, a as node_id from looped union select r.id, r.b from reach r join looped l on l.id = r.id and l.a = r.a
), bound as (select id, count(*) as n from e group by id), walk as (
  select distinct e.id, e.source as node_id, 0::bigint as level from e where not exists (select 1 from e b where b.id = e.id and b.target = e.source)
  union
  select w.id, e.target, w.level + 1 from walk w join e on e.id = w.id and e.source = w.node_id join bound b on b.id = w.id where w.level <= b.n
) select id, node_id, max(level)::int as level from walk w where not exists (select 1 from apart x where x.id = w.id and x.node_id = w.node_id) group by id, node_id""")
def w_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Longest path to each node that is not on or behind a cycle; the SQL walks no farther than a graph has edges."""
    return graphs.levels(_edges(spark, folder), "id")


@query(_CURRENT.replace("with cur", "with recursive cur", 1) + """, reach as (
  select distinct id, source as a, target as b from edges
  union
  select r.id, r.a, e.target from reach r join edges e on e.id = r.id and e.source = r.b
) select distinct id, b as node_id from reach r where exists (select 1 from reach c where c.id = r.id and c.a = c.b and c.a = r.a)""")
def w_cyclic_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes on or behind a cycle, which have no level."""
    return graphs.cyclic(_edges(spark, folder), "id")


@query()
def w_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of each workflow in topological order, or why there is none."""
    return graphs.orders(_workflows(spark, folder))


@query(_CURRENT.replace("with cur", "with recursive cur", 1) + """, e as (select distinct id, source, target from edges), reach as (
  select id, source as a, target as b from e union select r.id, r.a, e.target from reach r join e on e.id = r.id and e.source = r.b
)
select id, count(distinct node_id) as nodes, 0::bigint as backward from nodes n
where id in (select id from flow where json_type(body, '$.nodes') = 'ARRAY' and json_type(body, '$.edges') = 'ARRAY')
  and id not in (select id from reach where a = b)
  and id not in (select id from edges x where not exists (select 1 from nodes y where y.id = x.id and y.node_id = x.source) or not exists (select 1 from nodes y where y.id = x.id and y.node_id = x.target))
group by id""")
def w_order_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Graphs that have an order, their nodes in it, and edges that lead backward in it, of which there is none."""
    planned = graphs.orders(_workflows(spark, folder)).where("problem is null and size(ordered) > 0")
    edges = _edges(spark, folder).groupBy(F.col("id").alias("__id")).agg(F.collect_set(F.struct("source", "target")).alias("edges"))
    backward = F.size(F.filter("edges", lambda x: F.array_position("ordered", x["source"]) >= F.array_position("ordered", x["target"])))
    return planned.join(edges, F.col("id") == F.col("__id"), "left").select("id", F.size("ordered").cast("long").alias("nodes"), F.when(F.col("edges").isNull(), 0).otherwise(backward).cast("long").alias("backward"))


_RUN = "case lower(trim({0})) when 'stepfun' then 'step' when '阶跃星辰' then 'step' when '通义千问' then 'qwen' when '智谱' then 'zhipu' when 'ai ping' then 'ai_ping' else nullif(lower(trim({0})), '') end"


@query(_CURRENT + f""", named as (
  select id, position::int as position, node_id, node_type, try_cast(n->>'$.data.configId' as bigint) as config_id, n->>'$.data.provider' as provider, n->>'$.data.apiUrl' as api_url, n->>'$.data.apiKey' as api_key,
    n->>'$.data.model' as model, try_cast(n->>'$.data.temperature' as double) as temperature
  from nodes where node_type in ('llm', 'openai', 'deepseek', 'qwen', 'zhipu', 'step', 'ai_ping')
), used as (
  select n.id, n.position, n.node_id, n.node_type, n.config_id, c.id is not null as shared,
    coalesce({_RUN.format("case when c.id is not null then c.provider else n.provider end")}, {_RUN.format("n.provider")}, case when n.node_type <> 'llm' then {_RUN.format("n.node_type")} end) as provider,
    case when c.id is not null then c.api_url else trim(n.api_url) end as api_url, case when c.id is not null then c.api_key else trim(n.api_key) end as api_key,
    case when c.id is not null then c.model else trim(n.model) end as model, coalesce(case when c.id is not null then c.temperature::double else n.temperature end, 0.7::double) as temperature
  from named n left join (select * from llm_global_config where coalesce(deleted, 0) = 0) c on c.id = n.config_id
)
select * exclude (api_url, api_key), concat_ws(',', case when coalesce(trim(provider), '') = '' then 'provider' end, case when coalesce(trim(api_url), '') = '' then 'api_url' end,
  case when coalesce(trim(api_key), '') = '' then 'api_key' end, case when coalesce(trim(model), '') = '' then 'model' end) as missing from used""")
def w_config_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Completion nodes with the settings that they run with, and what these lack."""
    found = metadata.resolved_configs(graphs.node_configs(_workflows(spark, folder)), table(spark, folder, "llm_global_config"))
    return found.withColumn("missing", F.array_join("missing", ","))


def _flow(*nodes: dict, edges: tuple[tuple[str, str], ...]) -> str:
    return json.dumps({"nodes": list(nodes), "edges": [{"source": a, "target": b} for a, b in edges]})


_MODEL = {"provider": "openai", "apiUrl": "http://models", "apiKey": "placeholder", "model": "m", "prompt": "Reply: {{q}}", "inputParams": [{"name": "q", "type": "reference", "referenceNode": "input-1.user_input"}]}
_ASK = {"id": "input-1", "type": "input"}, {"id": "llm-1", "type": "llm", "data": _MODEL}
ANSWERED = _flow(*_ASK, {"id": "output-1", "type": "output", "data": {"responseContent": "<{{a}}>", "outputParams": [{"name": "a", "type": "reference", "referenceNode": "llm-1.output"}]}}, edges=(("input-1", "llm-1"), ("llm-1", "output-1")))
SPOKEN = _flow(*_ASK, {"id": "tts-1", "type": "tts", "data": {"apiKey": "placeholder"}}, {"id": "output-1", "type": "output", "data": {"responseContent": "{{a}}", "outputParams": [{"name": "a", "type": "reference", "referenceNode": "llm-1.output"}]}}, edges=(("input-1", "llm-1"), ("llm-1", "tts-1"), ("tts-1", "output-1")))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as the input of a run."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("input"))


@query("select doc_id as run_id, 'SUCCESS' as status, '<Reply: ' || coalesce(text, '') || '>' as output from documents")
def w_run_dag(spark: SparkSession, folder: str) -> DataFrame:
    """A workflow with a (stand-in) model call over all documents, run by the dag engine."""
    return engine.run_workflow(_questions(spark, folder), ANSWERED, "dag").select("run_id", "status", F.get_json_object("output", "$.output").alias("output"))


@query("select doc_id as run_id, 'SUCCESS' as status, 'Reply: ' || coalesce(text, '') as output from documents")
def w_run_langgraph(spark: SparkSession, folder: str) -> DataFrame:
    """The same with speech in between, run by the langgraph engine, whose output node still finds the model's text."""
    return engine.run_workflow(_questions(spark, folder), SPOKEN, "langgraph").select("run_id", "status", F.get_json_object("output", "$.output").alias("output"))


#: The order of the events of a run of ``ANSWERED``.
_TOLD = ">".join(("WORKFLOW_START", *(f"NODE_{x}:{y}" for y in ("input-1", "llm-1", "output-1") for x in ("START", "SUCCESS")), "WORKFLOW_COMPLETE"))


def _answered_events(spark: SparkSession, folder: str) -> DataFrame:
    return engine.run_events(engine.run_workflow(_questions(spark, folder), ANSWERED, "dag"))


@query(f"select doc_id as run_id, '{_TOLD}' as told, md5('Reply: ' || coalesce(text, '')) as answer, md5('<Reply: ' || coalesce(text, '') || '>') as complete from documents")
def w_run_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the runs in order, what the model node answered, and what the run gave."""
    events_ = _answered_events(spark, folder)
    name = F.concat_ws(":", "event_type", "node_id")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", name.alias("name")))), lambda x: x["name"]), ">")
    answer = F.max(F.when((F.col("event_type") == "NODE_SUCCESS") & (F.col("node_id") == "llm-1"), F.get_json_object("data", "$.output.output")))
    complete = F.max(F.when(F.col("event_type") == "WORKFLOW_COMPLETE", F.get_json_object("data", "$.output")))
    return events_.groupBy("run_id").agg(told.alias("told"), F.md5(answer).alias("answer"), F.md5(complete).alias("complete"))


@query("select doc_id as run_id, node_id, 'SUCCESS' as status, position::int as position from documents cross join (values ('input-1', 1), ('llm-1', 3), ('output-1', 5)) t(node_id, position)")
def w_node_states(spark: SparkSession, folder: str) -> DataFrame:
    """State of each node of each run after its last event, and the place of its first."""
    return events.node_states(_answered_events(spark, folder)).select("run_id", "node_id", "status", "position")


@query("select doc_id as run_id from documents")
def w_ended_runs(spark: SparkSession, folder: str) -> DataFrame:
    return events.ended_runs(_answered_events(spark, folder))


@query("select 7 as flow_id, doc_id as run_id, md5(text) as input, 'SUCCESS' as status, md5('<Reply: ' || coalesce(text, '') || '>') as output, 3 as nodes, null::varchar as error_message, true as timed, 0 as deleted from documents")
def w_execution_records(spark: SparkSession, folder: str) -> DataFrame:
    """Runs as rows of the table of executions."""
    records = engine.execution_records(engine.run_workflow(_questions(spark, folder), ANSWERED, "dag"), 7)
    held = F.size(F.from_json("node_results", "array<struct<nodeId:string,status:string,duration:int>>"))
    return records.select(F.col("flow_id").cast("int").alias("flow_id"), "run_id", F.md5(F.get_json_object("input_data", "$.input")).alias("input"), "status", F.md5(F.get_json_object("output_data", "$.output")).alias("output"), held.alias("nodes"), "error_message", (F.col("duration") >= 0).alias("timed"), "deleted")


@query("select k.kind, doc_id as run_id, 'SUCCESS' as status, md5(k.kind || ': ' || coalesce(text, '')) as output from documents cross join (values ('llm'), ('openai'), ('deepseek'), ('qwen'), ('zhipu'), ('step'), ('ai_ping')) k(kind)")
def w_run_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """A run with each kind of completion node; all but the general one find their provider by their kind."""
    out = None
    for kind in providers.KINDS:
        data = {**_MODEL, "prompt": f"{kind}: {{{{q}}}}", "provider": "Open AI " if kind == "llm" else None}
        flow = _flow(_ASK[0], {"id": "m-1", "type": kind, "data": data}, edges=(("input-1", "m-1"),))
        run = engine.run_workflow(_questions(spark, folder), flow, "dag").select(F.lit(kind).alias("kind"), "run_id", "status", F.md5(F.get_json_object("output", "$.output")).alias("output"))
        out = run if out is None else out.unionByName(run)
    return out


@query("""select doc_id as run_id, 'FAILED' as status, null::varchar as output, problem as error, 2 as nodes from documents
cross join (values ('the provider nobody is not supported'), ('the configuration lacks provider'), ('the configuration lacks api_key, model'), ('speech needs an apiKey')) p(problem)""")
def w_failed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that fail: an unknown provider, none, no key and model, speech without a key."""
    out = None
    for kind, data in (("llm", {**_MODEL, "provider": "Nobody"}), ("llm", {**_MODEL, "provider": " "}), ("step", {**_MODEL, "apiKey": " ", "model": None}), ("tts", {"apiKey": ""})):
        flow = _flow(_ASK[0], {"id": "m-1", "type": kind, "data": data}, _ASK[0] | {"id": "late"}, edges=(("input-1", "m-1"), ("m-1", "late")))
        run = engine.run_workflow(_questions(spark, folder), flow, "dag").select("run_id", "status", "output", "error", F.size("node_results").alias("nodes"))
        out = run if out is None else out.unionByName(run)
    return out


@query("select distinct id as run_id, md5(coalesce(username, '')) as whole, md5(coalesce(username, '')) as folded, coalesce(username, '') = '' as empty from app_user")
def w_streamed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that are streamed to a listener: the text that the last part tells, and the parts folded."""
    names = table(spark, folder, "app_user").select(F.col("id").alias("run_id"), F.col("username").alias("input")).distinct()
    flow = _flow(_ASK[0], {"id": "llm-1", "type": "llm", "data": {**_MODEL, "prompt": "{{q}}", "streaming": True}}, edges=(("input-1", "llm-1"),))
    told = engine.run_events(engine.run_workflow(names, flow, "dag", listen=True)).where("event_type = 'NODE_PROGRESS'").withColumn("part", F.get_json_object("data", "$.chunk"))
    last = told.groupBy("run_id").agg(F.max_by(F.get_json_object("data", "$.accumulated"), "seq").alias("whole"))
    both = last.join(events.final_text(told, ["run_id"], "seq", "part", "folded"), "run_id")
    return both.select("run_id", F.md5("whole").alias("whole"), F.md5("folded").alias("folded"), (F.col("whole") == "").alias("empty"))


@query("select doc_id, 'SUCCESS' as status, 44 + octet_length(encode('Reply: ' || text)) as bytes, md5('Reply: ' || text) as said, true as chunked, true as told from documents where length(text) > 0")
def w_speech(spark: SparkSession, folder: str) -> DataFrame:
    """Answers spoken chunk by chunk, merged and stored; the stored files, read back, hold the text (the stand-in speaks its bytes)."""
    texts = table(spark, folder, "documents").where("length(text) > 0").select(F.col("doc_id").alias("run_id"), F.col("text").alias("input"))
    place = f"{shared_folder(spark)}/audio"
    runs = checkpointed(engine.run_workflow(texts, SPOKEN, "dag", audio_folder=place, listen=True))
    progress = engine.run_events(runs).where("node_id = 'tts-1' and event_type = 'NODE_PROGRESS'").groupBy(F.col("run_id").alias("__run")).agg(F.count(F.lit(1)).alias("events"))
    result = F.element_at(F.filter("node_results", lambda x: x["nodeId"] == "tts-1"), 1)["output"]
    spoken = runs.select("run_id", "status", F.substring_index(F.element_at(result, "output"), "/", -1).alias("name"), F.element_at(result, "chunks").cast("int").alias("chunks"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(place).select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.md5(F.substring("content", 45, 2**31 - 1)).alias("said"))
    both = spoken.join(files, "name").join(progress, F.col("run_id") == F.col("__run"))
    return both.select(F.col("run_id").alias("doc_id"), "status", "bytes", "said", (F.col("chunks") >= F.ceil((F.col("bytes") - 44) / 600)).alias("chunked"), (F.col("events") == 2 * F.col("chunks") + 2).alias("told"))


@query("select doc_id, replace('Source {{ kind }}: ' || coalesce(source, '') || ' says ' || coalesce(kind, '') || '', 'x', 'x') as prompt from documents")
def w_prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    """A prompt rendered for every document; a spaced placeholder stays and an unknown one vanishes."""
    params = F.create_map(F.lit("source"), F.col("source"), F.lit("kind"), F.col("kind"))
    return table(spark, folder, "documents").select("doc_id", text.render(F.lit("Source {{ kind }}: {{source}} says {{kind}}{{unknown}}"), params).alias("prompt"))


@query("select doc_id, md5(text) as whole, true as within from documents where length(text) > 0")
def w_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks for speech: they give the text again and none exceeds 600 bytes."""
    parts = chunking.chunk_table(table(spark, folder, "documents"), "doc_id", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk"))), lambda x: x["chunk"]), "")
    return parts.groupBy("doc_id").agg(F.md5(joined).alias("whole"), (F.max(F.octet_length("chunk")) <= 600).alias("within"))


@query("select doc_id, 44 + octet_length(encode(text)) as bytes, 36 + octet_length(encode(text)) as riff from documents where length(text) > 0")
def w_wav_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks spoken one by one and merged: length of the whole and the length in its header."""
    parts = chunking.chunk_table(table(spark, folder, "documents"), "doc_id", "text")

    @F.pandas_udf("binary")
    def speak(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: providers.tone(x, "CHERRY"))

    merged = parts.withColumn("wav", speak("chunk")).groupBy("doc_id").agg(audio.merge(F.transform(F.array_sort(F.collect_list(F.struct("position", "wav"))), lambda x: x["wav"])).alias("wav"))
    low = F.concat(*(F.substring("wav", place, 1) for place in (8, 7, 6, 5)))
    return merged.select("doc_id", F.octet_length("wav").cast("long").alias("bytes"), F.conv(F.hex(low), 16, 10).cast("long").alias("riff"))


@query("select count(*) as texts from documents where length(text) > 0")
def w_chunk_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Texts whose progress events begin with the first chunk and end with the completed last one, counted."""
    parts = chunking.chunk_table(table(spark, folder, "documents"), "doc_id", "text")
    ends = events.chunk_progress(parts, "doc_id").groupBy("doc_id").agg(F.min_by("data", "seq").alias("first"), F.max_by("data", "seq").alias("last"))
    good = (F.get_json_object("first", "$.currentChunk") == "1") & (F.get_json_object("last", "$.completedChunks") == F.get_json_object("last", "$.totalChunks"))
    return ends.where(good).agg(F.count(F.lit(1)).alias("texts"))


@query("""select node_type, case when upper(trim(category)) in ('LLM', 'TOOL') then upper(trim(category)) end as palette, concat_ws(',', case when coalesce(trim(display_name), '') = '' then 'display_name' end, case when coalesce(trim(category), '') = '' then 'category' end) as missing from node_definition""")
def w_palette(spark: SparkSession, folder: str) -> DataFrame:
    """Where the editor lists each node definition, and which of its fields are missing."""
    lacking = text.missing_fields(display_name=F.col("display_name"), category=F.col("category"))
    return table(spark, folder, "node_definition").select("node_type", text.palette(F.col("category")).alias("palette"), F.array_join(lacking, ",").alias("missing"))


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, min(event_id) as first_seen, count(*) as events from events group by user_id")
def w_event_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user."""
    rows = table(spark, folder, "events")
    last = events.latest(rows, ["user_id"], F.struct("ts", "event_id"), "event_type").drop("first_seen")
    return last.join(rows.groupBy("user_id").agg(F.min("event_id").alias("first_seen")), "user_id")


@query("select flow_id, count(*) as total, count(*) filter (upper(trim(status)) = 'SUCCESS') as done, floor(100.0 * count(*) filter (upper(trim(status)) = 'SUCCESS') / count(*) + 0.5)::int as percent from execution_record group by flow_id")
def w_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Percentage of successful runs per flow."""
    return events.progress(table(spark, folder, "execution_record"), ["flow_id"], F.upper(F.trim("status")) == "SUCCESS")


@query("select user_id, event_id, string_agg(event_type, '') over (partition by user_id order by ts, event_id rows unbounded preceding) as accumulated from events")
def w_running_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Text accumulated along each user's events."""
    rows = table(spark, folder, "events").withColumn("seq", F.struct("ts", "event_id"))
    return events.accumulated(rows, ["user_id"], "seq", "event_type").select("user_id", "event_id", "accumulated")


_RESULT = f"""
with r as (select distinct id, {_body("node_results")} as body from execution_record),
l as (select id, case when json_type(body) = 'OBJECT' then '[' || body || ']' else body end as body from r where body is not null),
x as (select id, unnest(generate_series(0, len(json_extract(body, '$[*]')) - 1)) as position, unnest(json_extract(body, '$[*]')) as n from l where json_type(body) = 'ARRAY'),
results as (select id, position, n->>'$.nodeId' as node_id, n->>'$.status' as status, try_cast(n->>'$.duration' as int) as duration from x)
"""


@query(_RESULT + "select id, array_to_string(list(node_id order by position), ',') as nodes, sum(duration)::bigint as spent from results group by id")
def w_node_results(spark: SparkSession, folder: str) -> DataFrame:
    """Node results of each run gathered in order."""
    complete = table(spark, folder, "execution_record").select("id", "node_results").where(F.try_parse_json("node_results").isNotNull()).distinct()
    rows = events.node_results(complete)
    joined = events.collected(rows, ["id"], "position", "node_id", "duration")
    return joined.select("id", F.array_join("results.node_id", ",").alias("nodes"), F.aggregate("results", F.lit(None).cast("long"), lambda done, x: F.coalesce(done + x["duration"], done, x["duration"].cast("long"))).alias("spent"))


@query("select id, epoch_us(updated_at) // 1000 - epoch_us(created_at) // 1000 as ms from app_user")
def w_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Milliseconds between two timestamps."""
    return table(spark, folder, "app_user").select("id", events.duration_ms(F.col("created_at"), F.col("updated_at")).alias("ms"))


@query("select id, config_name as plain, true as hidden from llm_global_config where trim(config_name) <> ''")
def w_crypto(spark: SparkSession, folder: str) -> DataFrame:
    """Values encrypted twice and decrypted."""
    rows = table(spark, folder, "llm_global_config").where(~text.is_blank(F.col("config_name")))
    hidden = rows.withColumn("hidden", crypto.encrypt(crypto.encrypt(F.col("config_name"), "test"), "test"))
    return hidden.select("id", crypto.decrypt(F.col("hidden"), "test").alias("plain"), crypto.is_encrypted(F.col("hidden")).alias("hidden"))


@query("select id, provider, case when trim(api_key) <> '' then '***' else api_key end as api_key from llm_global_config")
def w_json_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Keys replaced deep inside JSON."""
    body = F.to_json(F.struct("provider", F.array(F.struct(F.col("api_key").alias("apiKey"))).alias("inner")))
    rows = table(spark, folder, "llm_global_config").select("id", crypto.replace_in_json(body).alias("body"))
    return rows.select("id", F.get_json_object("body", "$.provider").alias("provider"), F.get_json_object("body", "$.inner[0].apiKey").alias("api_key"))


@query(r"""select doc_id, trim(regexp_extract(text, '^---\s*\n(?:[\s\S]*?\n)??name:([^\n]*)\n[\s\S]*?---\s*\n([\s\S]*)$', 1), ' ' || chr(13)) as name from documents
where regexp_matches(text, '^---\s*\n([\s\S]*?)\n---\s*\n([\s\S]*)$') and regexp_extract(text, '^---\s*\n([\s\S]*?)\n---\s*\n([\s\S]*)$', 1) like '%name:%'""")
def w_front_matter(spark: SparkSession, folder: str) -> DataFrame:
    """Names in the front matter of skill documents."""
    return skills.parsed(table(spark, folder, "documents").select("doc_id", "text"), "text").where("problem is null").select("doc_id", "name")


@query("select id, output_data::json->>'$.audioUrl' as audio from execution_record where json_valid(output_data) and json_type(output_data) = 'OBJECT' and output_data::json->>'$.audioUrl' is not null")
def w_audio(spark: SparkSession, folder: str) -> DataFrame:
    """Where outputs point to."""
    return table(spark, folder, "execution_record").select("id", text.audio_reference(F.col("output_data")).alias("audio")).where("audio is not null")


@query("select event_type, count(*) as events, arg_max(value, (ts, event_id)) as value from events group by event_type")
def w_event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The fold of events run as a stream to its end; the result is that of the batch fold."""
    rows = table(spark, folder, "events")
    with_path = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    place = shared_folder(spark)
    stream = streams.latest_by_key(with_path, ["event_type"], ["ts", "event_id"], "value")
    done = streams.write_batches(stream, f"{place}/state", lambda batch, number: batch.write.mode("overwrite").parquet(f"{place}/out/batch={number:012d}"), "complete")
    done.awaitTermination()
    if done.exception() is not None:
        raise done.exception()
    written = spark.read.parquet(f"{place}/out")
    return written.where(F.col("batch") == written.agg(F.max("batch")).first()[0]).select("event_type", "events", "value")


_LIVE = "select * from llm_global_config where coalesce(deleted, 0) = 0"
_RANK = "is_default desc nulls last, updated_at desc nulls last, id desc"


@query(f"select id, provider, row_number() over (order by {_RANK})::int as place from ({_LIVE})")
def w_config_order(spark: SparkSession, folder: str) -> DataFrame:
    """All configurations in their order."""
    ordered = metadata.ordered_configs(table(spark, folder, "llm_global_config")).select("id", "provider", F.monotonically_increasing_id().alias("__at"))
    return ordered.select("id", "provider", F.row_number().over(W.orderBy("__at")).alias("place"))


@query(f"select id, config_name, model from ({_LIVE}) where provider = 'zhipu' and is_default = 1 order by {_RANK} limit 1")
def w_provider_default(spark: SparkSession, folder: str) -> DataFrame:
    """The default configuration of one provider."""
    return metadata.default_config(table(spark, folder, "llm_global_config"), "zhipu").select("id", "config_name", "model")


@query(f"select id, row_number() over (order by {_RANK})::int as place from ({_LIVE}) where provider = 'qwen'")
def w_provider_configs(spark: SparkSession, folder: str) -> DataFrame:
    """The configurations of one provider, by its exact name, in their order."""
    ordered = metadata.ordered_configs(table(spark, folder, "llm_global_config"), "qwen").select("id", F.monotonically_increasing_id().alias("__at"))
    return ordered.select("id", F.row_number().over(W.orderBy("__at")).alias("place"))


@query("select id, deleted from llm_global_config where provider = 'zhipu' and config_name = 'profile-05' order by id limit 1")
def w_any_config(spark: SparkSession, folder: str) -> DataFrame:
    """A configuration by provider and name, deleted or not."""
    return metadata.any_config(table(spark, folder, "llm_global_config"), "zhipu", "profile-05").select("id", "deleted")


@query("select 'llm' as node_type, '大模型' as display_name, 'LLM' as category union all select node_type, display_name, category from node_definition where node_type = 'tts' and coalesce(deleted, 0) = 0")
def w_node_definition(spark: SparkSession, folder: str) -> DataFrame:
    """The built-in definition of the general node, and a stored one."""
    rows = table(spark, folder, "node_definition")
    return metadata.node_definition(rows, "llm").unionByName(metadata.node_definition(rows, "tts")).select("node_type", "display_name", "category")


@query("""with last as (select * from (select *, row_number() over (partition by id order by updated_at desc) as k from workflow where id is not null) where k = 1), first as (select min(id) as id from last)
select id, case when id in (select id from first) then 'renamed' else name end as name, case when id = (select max(id) from last) then 1 else deleted end as deleted, id in (select id from first) as touched from last
union all select (select max(id) + 1 from last), 'added', 0, true""")
def w_workflow_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The table of workflows after one was renamed, one added and one deleted."""
    rows = metadata.current(table(spark, folder, "workflow"))
    ends = rows.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    one = rows.where(F.col("id") == ends.low)
    more = one.withColumn("name", F.lit("renamed")).unionByName(one.withColumn("id", F.lit(ends.high + 1)).withColumn("name", F.lit("added")).withColumn("deleted", F.lit(0)))
    changed = metadata.soft_deleted(metadata.updated(rows, more), ends.high)
    return changed.select("id", "name", "deleted", (F.col("updated_at") > F.date_sub(F.current_date(), 2)).alias("touched"))


@query("select id, case when provider = (select provider from llm_global_config where id = (select max(id) from llm_global_config)) then (id = (select max(id) from llm_global_config))::int else is_default end as is_default from llm_global_config")
def w_set_default(spark: SparkSession, folder: str) -> DataFrame:
    """The table with its last configuration as the default of its provider."""
    rows = table(spark, folder, "llm_global_config")
    return metadata.with_default(rows, rows.agg(F.max("id")).first()[0]).select("id", "is_default")


@query("select id, case id % 3 when 0 then 'key ' || id when 1 then ' ' else api_key end as plain, id % 3 <> 1 and api_key is not null as hidden from llm_global_config")
def w_encrypted_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Stored keys encrypted by the migration, which is run twice, and decrypted: plain, blank and already encrypted ones."""
    stored = F.when(F.col("id") % 3 == 0, F.concat(F.lit("key "), "id")).when(F.col("id") % 3 == 1, " ").otherwise(F.col("api_key"))
    rows = table(spark, folder, "llm_global_config").withColumn("stored", stored).withColumn("api_key", F.col("stored"))
    rows = metadata.encrypted_keys(metadata.encrypted_keys(rows, "secret"), "secret")
    plain = F.when(crypto.is_encrypted(F.col("stored")), F.col("api_key")).otherwise(crypto.decrypt(F.col("api_key"), "secret"))  # keys that came encrypted are of another secret
    return rows.select("id", plain.alias("plain"), crypto.is_encrypted(F.col("api_key")).alias("hidden"))


@query("select node_type, display_name from node_definition union all select * from (values ('seed-1', 'One')) s(node_type, display_name) where node_type not in (select node_type from node_definition where node_type is not null)")
def w_seeded(spark: SparkSession, folder: str) -> DataFrame:
    """Seed rows added where their key is not there yet."""
    rows = table(spark, folder, "node_definition").select("node_type", "display_name")
    seeds = spark.createDataFrame([("llm", "Again"), ("tts", "Again"), ("input", "Again"), ("seed-1", "One")], "node_type string, display_name string")
    return metadata.seeded(rows, seeds.join(rows.where("node_type is not null").select("node_type"), "node_type", "left_semi").unionByName(seeds.where("node_type = 'seed-1'")), ["node_type"])


@query(f"""with builtin as (select * from (values (0, 'openai', 'OpenAI'), (1, 'qwen', '通义千问'), (2, 'step', '阶跃星辰')) b(position, name, label)),
seen as (select id::int as position, {_CANON.format(more=_CLIENT, other="trim(provider)")} as name, config_name as label from llm_global_config where provider is not null),
every as (select 0 as list, * from builtin union all select 1, * from seen)
select name, arg_max(label, (list, position)) as label, row_number() over (order by min((list, position)))::int as place from every group by name""")
def w_merged_options(spark: SparkSession, folder: str) -> DataFrame:
    """Built-in providers and those of the configurations, one row each: the last label, the first place."""
    builtin = spark.createDataFrame([(0, "openai", "OpenAI"), (1, "qwen", "通义千问"), (2, "step", "阶跃星辰")], "position int, name string, label string")
    seen = table(spark, folder, "llm_global_config").where("provider is not null").select(F.col("id").cast("int").alias("position"), text.provider(F.col("provider"), "storage").alias("name"), F.col("config_name").alias("label"))
    merged = metadata.merged_options(builtin, seen, "name", "label").withColumn("__at", F.monotonically_increasing_id())
    return merged.select("name", "label", F.row_number().over(W.orderBy("__at")).alias("place"))


@query("select id, provider, config_name from llm_global_config where provider is distinct from 'openai' union all select id + 1000, provider, 'fresh' from llm_global_config where provider = 'openai' and is_default = 1")
def w_replaced_partition(spark: SparkSession, folder: str) -> DataFrame:
    """The table with the rows of one provider replaced."""
    rows = table(spark, folder, "llm_global_config").select("id", "provider", "config_name", "is_default")
    fresh = rows.where("is_default = 1").select((F.col("id") + 1000).alias("id"), "provider", F.lit("fresh").alias("config_name"), "is_default")
    return metadata.replaced_partition(rows, fresh, "provider", "openai").select("id", "provider", "config_name")


@query("""with change as (select id, provider, config_name, api_url, model, id % 3 as k from llm_global_config), wanted as (
  select id + case when k = 1 then 1000 else 0 end as id, nullif(trim(provider), '') as provider, nullif(trim(config_name), '') as config_name, nullif(trim(api_url), '') as api_url, case when k <> 2 then nullif(trim(model), '') end as model from change
), named as (select * replace (""" + _CANON.format(more=_CLIENT, other="provider") + """ as provider) from wanted)
select id, 'missing: ' || concat_ws(', ', case when provider is null then 'provider' end, case when config_name is null then 'config_name' end, case when api_url is null then 'api_url' end, case when model is null then 'model' end) as problem
from named where provider is null or config_name is null or api_url is null or model is null
union all select id, 'the name is taken' from named w where exists (select 1 from llm_global_config c where coalesce(c.deleted, 0) = 0 and c.provider = w.provider and c.config_name = w.config_name and c.id <> w.id)""")
def w_config_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Why changes to configurations cannot be stored: copies under the same name, and changes without a model."""
    rows = table(spark, folder, "llm_global_config")
    wanted = rows.withColumn("model", F.when(F.col("id") % 3 != 2, F.col("model"))).withColumn("id", F.col("id") + F.when(F.col("id") % 3 == 1, 1000).otherwise(0))
    return metadata.problems(rows, wanted)


@query("select id, case lower(trim(provider)) when 'openai' then 'OpenAI' when 'open ai' then 'OpenAI' when 'deepseek' then 'DeepSeek' when 'deep seek' then 'DeepSeek' when 'qwen' then '通义千问' when '通义千问' then '通义千问' when 'step' then '阶跃星辰' when 'stepfun' then '阶跃星辰' when '阶跃星辰' then '阶跃星辰' when 'zhipu' then '智谱' when '智谱' then '智谱' when 'ai_ping' then 'AI Ping' when 'ai ping' then 'AI Ping' else coalesce(provider, '') end as label from llm_global_config")
def w_provider_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Names of providers as the editor shows them."""
    return table(spark, folder, "llm_global_config").select("id", text.provider_label(F.col("provider")).alias("label"))


_VOICES = ", ".join(f"'{x}'" for x in text.VOICES)


@query(f"select n_nationkey, case when n_nationkey % 3 > 0 then ([{_VOICES}])[n_nationkey % 15 + 1] else 'CHERRY' end as voice from nation")
def w_voices(spark: SparkSession, folder: str) -> DataFrame:
    """Voices in any case and blanks; others give the default."""
    known = F.concat(F.lit(" "), F.lower(F.element_at(F.array(*map(F.lit, text.VOICES)), (F.col("n_nationkey") % 15 + 1).cast("int"))))
    return table(spark, folder, "nation").select("n_nationkey", text.voice(F.when(F.col("n_nationkey") % 3 > 0, known).otherwise(F.col("n_name"))).alias("voice"))


@query("select distinct id, duration, coalesce(case when duration >= 0 then duration end, 0) as spent, case when duration is not null and duration >= 0 then lpad((duration // 60000)::varchar, greatest(2, length((duration // 60000)::varchar))::int, '0') || ':' || lpad((duration // 1000 % 60)::varchar, 2, '0') end as clock from execution_record")
def w_times(spark: SparkSession, folder: str) -> DataFrame:
    """Milliseconds read back from a message, and seconds as minutes and seconds."""
    rows = table(spark, folder, "execution_record").select("id", "duration").distinct()
    message = F.concat(F.lit("节点执行成功,耗时 "), F.col("duration").cast("string"), F.lit("ms"))
    return rows.select("id", "duration", text.spent_ms(message).alias("spent"), text.clock(F.when(F.col("duration") >= 0, F.col("duration") / 1000)).alias("clock"))


@query("""select doc_id, case doc_id % 4 when 0 then 'skill ' || doc_id when 1 then source when 2 then coalesce(source, 'bare') end as skill, case doc_id % 4 when 0 then 'ref' when 1 then kind end as reference
from documents where doc_id % 4 <> 1 or source is not null and kind is not null""")
def w_tool_arguments(spark: SparkSession, folder: str) -> DataFrame:
    """What tool calls name: as JSON, as a pair, bare, or nothing."""
    rows = table(spark, folder, "documents").where("doc_id % 4 <> 1 or source is not null and kind is not null")
    given = F.concat(F.lit('{"skill_name": "skill '), F.col("doc_id").cast("string"), F.lit('", "reference_name": "ref"}'))
    said = F.when(F.col("doc_id") % 4 == 0, given).when(F.col("doc_id") % 4 == 1, F.concat_ws(" : ", "source", "kind")).when(F.col("doc_id") % 4 == 2, F.coalesce("source", F.lit("bare"))).otherwise(" ")
    return rows.select("doc_id", skills.tool_arguments(said).alias("x")).select("doc_id", "x.skill", "x.reference")


@query("""with s as (select doc_id, coalesce(source, 'none') as source, kind, text from documents), n as (select source, count(*) as texts from s group by source)
select source as name, md5('# 技能: ' || source || chr(10) || chr(10) || texts || ' texts' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 技能指南' || chr(10) || chr(10) || 'guide of ' || source || chr(10) || chr(10)
  || coalesce((select '## 参考文档' || chr(10) || chr(10) || string_agg('### ' || kind || chr(10) || chr(10) || total || chr(10) || chr(10), '' order by kind) from (select s.source, kind, count(*) as total from s where kind is not null group by s.source, kind) r where r.source = n.source), '')) as prompt from n""")
def w_skill_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of skills made of the documents: one skill per source, one reference per kind."""
    rows = table(spark, folder, "documents").select(F.coalesce("source", F.lit("none")).alias("skill"), "kind")
    body = F.concat(F.lit("---\nname: "), "skill", F.lit("\ndescription: '"), F.col("texts").cast("string"), F.lit(" texts'\n---\n\nguide of "), "skill", F.lit("\n"))
    parsed = skills.parsed(rows.groupBy("skill").agg(F.count(F.lit(1)).alias("texts")).select(body.alias("body")), "body")
    references = rows.where("kind is not null").groupBy("skill", F.col("kind").alias("ref")).agg(F.count(F.lit(1)).cast("string").alias("content"))
    return skills.prompts(parsed.select("name", "description", "content", "problem"), references).select("name", F.md5("prompt").alias("prompt"))


@query(_CURRENT + """, params as (
  select id, position, node_id, n, unnest(list_concat(
    case when json_type(n, '$.data.inputParams') = 'ARRAY' then json_extract(n, '$.data.inputParams[*]') else [] end,
    case when json_type(n, '$.data.outputParams') = 'ARRAY' then json_extract(n, '$.data.outputParams[*]') else [] end)) as p from nodes
), told as (
  select id, position, node_id, coalesce(p->>'$.name', '') as name, p->>'$.type' as kind, p->>'$.value' as value, coalesce(p->>'$.referenceNode', p->>'$.ref') as ref from params
), found as (
  select id, position, node_id, case when name = '' then 'unnamed' when kind = 'reference' and not coalesce(contains(ref, '.'), false) then 'nothing'
    when kind = 'reference' and not exists (select 1 from nodes x where x.id = told.id and x.node_id = split_part(ref, '.', 1)) then 'unknown'
    when kind = 'input' and value is null then 'without value' end as problem, name from told
), used as (
  select id, position, node_id, unnest(list_distinct(regexp_extract_all(concat_ws(' ', n->>'$.data.prompt', n->>'$.data.responseContent'), '\\{\\{(\\w+)\\}\\}', 1))) as name from nodes
)
select id, position::int as position, node_id, problem, name from found where problem is not null
union all
select id, position::int, node_id, 'undefined', name from used u where not exists (select 1 from told t where t.id = u.id and t.position = u.position and t.name = u.name)""")
def w_lint(spark: SparkSession, folder: str) -> DataFrame:
    """What would surprise at run time in the current workflows."""
    return graphs.lint(_workflows(spark, folder))


@query(_CURRENT + _END.format(end="target", pick="arg_min", name="entry").replace("select r.id, coalesce(f.node_id, r.node_id) as entry", ", gone as (select r.id, coalesce(f.node_id, r.node_id) as node_id", 1) + """)
select id, position::int as position, source, target from edges e where not exists (select 1 from gone g where g.id = e.id and g.node_id in (e.source, e.target))""")
def w_without_entry(spark: SparkSession, folder: str) -> DataFrame:
    """The edges that are left when the entry node of each workflow is deleted."""
    gone = graphs.ends(_nodes(spark, folder), _edges(spark, folder), which="entry")
    return graphs.without_nodes(_edges(spark, folder), gone, node="entry")


_FRONT = r"'^---\s*\n([\s\S]*?)\n---\s*\n([\s\S]*)$'"


@query(rf"""select doc_id, trim(regexp_extract(text, '^---\s*\n(?:[\s\S]*?\n)??name:([^\n]*)\n[\s\S]*?---\s*\n([\s\S]*)$', 1), ' ' || chr(13)) as name, coalesce(kind, 'none') as ref, 'from ' || coalesce(source, 'nowhere') as content from documents
where regexp_matches(text, {_FRONT}) and regexp_extract(text, {_FRONT}, 1) like '%name:%'""")
def w_skill_files(spark: SparkSession, folder: str) -> DataFrame:
    """Skills and their references written as files and read back: from the second folder, as the first has none."""
    place = shared_folder(spark)
    rows = table(spark, folder, "documents").where(F.col("text").rlike(skills.FRONT_MATTER))
    written = sinks.store_texts(rows.select(F.concat_ws("/", "doc_id", F.lit("SKILL.md")).alias("name"), F.col("text").alias("content")), f"{place}/skills")
    reference = F.concat(F.col("doc_id").cast("string"), F.lit("/reference/"), F.coalesce("kind", F.lit("none")), F.lit(".md"))
    written += sinks.store_texts(rows.select(reference.alias("name"), F.concat(F.lit("from "), F.coalesce("source", F.lit("nowhere"))).alias("content")), f"{place}/skills")
    if not written:  # a folder without files cannot be read
        return spark.createDataFrame([], "doc_id long, name string, ref string, content string")
    read = skills.read_skills(spark, f"{place}/none", f"{place}/skills").where("problem is null")
    own = read.select(F.regexp_extract("path", r"([0-9]+)/SKILL\.md$", 1).alias("skill"), "name")
    return own.join(skills.read_references(spark, f"{place}/skills"), "skill").select(F.col("skill").cast("long").alias("doc_id"), "name", "ref", "content")
