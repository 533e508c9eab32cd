"""Queries over the test tables, each with the equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import drift, nested, references
from skein.operators.references import ForeignKey
from skein.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

KEYS = (
    ForeignKey("execution_record", "flow_id", "workflow", "executed_at"),
    ForeignKey("workflow", "owner_id", "app_user", "created_at"),
)


def _orphans(spark: SparkSession, folder: str, inherited: bool) -> DataFrame:
    tables = {name: table(spark, folder, name) for name in ("execution_record", "workflow", "app_user")}
    return references.orphan_cascade(tables, KEYS, inherited)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Direct orphans: ``ref, id, reason, period``."""
    return _orphans(spark, folder, inherited=False).select("ref", "id", "reason", "period")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and inherited orphans counted per reference, period and reason."""
    return references.orphan_report(_orphans(spark, folder, inherited=True))


def _bridge(spark: SparkSession, folder: str, every: bool) -> DataFrame:
    flows = nested.occurrences(table(spark, folder, "workflow"), "workflow", "id", "flow_data", "export_file", every=every)
    runs = nested.occurrences(table(spark, folder, "execution_record"), "execution_record", "id", "node_results", single_is_array=True, every=every)
    return flows.unionByName(runs)


def p3_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and object of ``flow_data`` and ``node_results`` with its place, its ordinal and its ``object_id`` in the store."""
    return _bridge(spark, folder, every=True)


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """The bridge without the identities, which SQL cannot compute."""
    return p3_bridge(spark, folder).drop("object_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every object in an array of ``flow_data`` or ``node_results``, with its link to the object that holds it."""
    return _bridge(spark, folder, every=False).select("root_table", "root_id", "export_file", "path", "parent_path", "child_key")


def p3_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct objects of ``flow_data`` and ``node_results``, each once, with the number of its occurrences in both."""
    flows = nested.counts(table(spark, folder, "workflow"), "id", "flow_data", "export_file")
    runs = nested.counts(table(spark, folder, "execution_record"), "id", "node_results", single_is_array=True)
    return nested.store(flows.unionByName(runs))


def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every scalar of ``flow_data`` and ``node_results`` with its place."""
    flows = nested.values(table(spark, folder, "workflow"), "workflow", "id", "flow_data", "export_file")
    return flows.unionByName(nested.values(table(spark, folder, "execution_record"), "execution_record", "id", "node_results", single_is_array=True))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences in the bridge and in the store, which must agree: per role and in all."""
    roles = p3_bridge(spark, folder).groupBy("role").agg(F.count(F.lit(1)).alias("occurrences"))
    return roles.unionByName(p3_objects(spark, folder).agg(F.lit("stored").alias("role"), F.sum("occurrences").alias("occurrences")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of the form of ``flow_data`` from one export file to the next."""
    return drift.changes(table(spark, folder, "workflow"), "export_file", "id", "flow_data")


def p5_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Lifespans of the fields of ``flow_data``."""
    workflows = table(spark, folder, "workflow")
    return drift.catalogue(drift.inventory(workflows, "export_file", "flow_data"), drift.file_ranks(workflows, "export_file"))


def p5_types(spark: SparkSession, folder: str) -> DataFrame:
    """Lifespans of each type of the fields of ``flow_data``."""
    workflows = table(spark, folder, "workflow")
    return drift.type_catalogue(drift.inventory(workflows, "export_file", "flow_data"), drift.file_ranks(workflows, "export_file"))


def p5_table(spark: SparkSession, folder: str) -> DataFrame:
    """All workflows of all files in one consistent form."""
    return drift.consistent(table(spark, folder, "workflow"), "export_file", "id", "flow_data")


def p5_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of all files, taken from the consistent table: fields under their last names, numbers that were texts in some files as texts."""
    rows = p5_table(spark, folder)
    kind = rows.schema["flow"].dataType

    def has(*names: str) -> bool:
        at = kind
        for name in names:
            at = at.elementType if isinstance(at, T.ArrayType) else at
            if not isinstance(at, T.StructType) or name not in at.names:
                return False
            at = at[name].dataType
        return True

    nodes = rows.select("id", "export_file", F.posexplode("flow.nodes").alias("place", "node")) if has("nodes", "id") else rows.select("id", "export_file", F.lit(0).alias("place"), F.lit(None).alias("node")).limit(0)

    def held(*names: str) -> F.Column:
        return F.col(".".join(("node", *names))).cast("string") if has("nodes", *names) else F.lit(None).cast("string")

    def listed(field: str, name: str) -> F.Column:
        return F.array_join(F.col(f"node.data.{field}.{name}"), ",", "-") if has("nodes", "data", field, name) else F.lit(None).cast("string")

    tags = F.array_join("node.data.tags", ",") if has("nodes", "data", "tags") else F.lit(None).cast("string")
    return nodes.select(
        "id", "export_file", "place", held("id").alias("node_id"), held("type").alias("node_type"), held("data", "modelName").alias("model"), held("data", "maxTokens").alias("max_tokens"),
        held("data", "configId").alias("config_id"), held("data", "temperature").alias("temperature"), tags.alias("tags"), listed("inputParams", "ref").alias("refs"), listed("outputParams", "desc").alias("descriptions"),
    )


#: Tables whose footers are catalogued.
TABLES = "app_user customer documents embeddings eval_item events execution_record lineitem llm_global_config nation node_definition orders part region supplier workflow".split()


def p5_footers(spark: SparkSession, folder: str) -> DataFrame:
    """Fields and types of every table of the folder, from the footers of its files."""
    fields = drift.footer_inventory(spark, folder)
    name = F.regexp_extract("file", r"/([^/]+)\.parquet(?:/[^/]*)?$", 1)
    own = fields.select(name.alias("file"), drift.shown(F.col("steps")).alias("path"), "type")
    return own.where(F.col("file").isin(TABLES) & ~F.contains(F.col("path"), F.lit("."))).distinct()


_STATES = """
with user_state as (
  select id, max_by(coalesce(deleted, 0), updated_at) as gone, max(created_at) as born from app_user group by id
), flow_state as (
  select id, max_by(coalesce(deleted, 0), updated_at) as gone, max(created_at) as born from workflow group by id
), direct as (
  select distinct 'execution_record.flow_id' as ref, e.id,
    case when s.id is null then 'missing' when s.gone = 1 then 'deleted' else 'later' end as reason,
    coalesce(strftime(e.executed_at, '%Y-%m'), '') as period
  from execution_record e left join flow_state s on e.flow_id = s.id
  where e.flow_id is not null and (s.id is null or s.gone = 1 or s.born > e.executed_at)
  union all
  select distinct 'workflow.owner_id', w.id,
    case when s.id is null then 'missing' when s.gone = 1 then 'deleted' else 'later' end,
    coalesce(strftime(w.created_at, '%Y-%m'), '')
  from workflow w left join user_state s on w.owner_id = s.id
  where w.owner_id is not null and (s.id is null or s.gone = 1 or s.born > w.created_at)
)
"""

def _body(column: str) -> str:
    """SQL for the JSON of a column, also where it stands inside a JSON string; null if it is not complete."""
    text = f"{column}::json->>'$'"
    return f"case when json_valid({column}) then case when json_type({column}) = 'VARCHAR' then case when json_valid({text}) then {text} end else {column} end end"


_TREE = f"""
with docs as (
  select distinct 'workflow' as root_table, id as root_id, export_file, {_body("flow_data")} as body from workflow
  union all
  select distinct 'execution_record', id, '', {_body("node_results")} from execution_record
), whole as (
  select root_table, root_id, export_file,
    case when root_table = 'execution_record' and json_type(body) = 'OBJECT' then '[' || body || ']' else body end as body
  from docs where body is not null and json_type(body) in ('OBJECT', 'ARRAY')
), tree as (
  select root_table, root_id, export_file, t.type, t.value,
    replace(replace(replace(ltrim(replace(t.fullkey, '"', ''), '$'), '[', '/'), ']', ''), '.', '/') as place
  from whole, lateral (select type, value, fullkey from json_tree(body::json)) t
)
"""

_FIELDS = f"""
with files as (
  select export_file, row_number() over (order by export_file) as rank from (select distinct export_file from workflow)
), docs as (
  select distinct id, export_file, {_body("flow_data")} as body from workflow
), places as (
  select d.id, export_file, t.id as place, t.value::varchar as value, regexp_replace(ltrim(replace(t.fullkey, '"', ''), '$.'), '\\[[0-9]+\\]', '[]', 'g') as path,
    case t.type when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'BOOLEAN' then 'boolean' when 'VARCHAR' then 'string' else 'number' end as kind
  from docs d, lateral (select id, type, value, fullkey from json_tree(body::json)) t
  where body is not null and json_type(body) = 'OBJECT' and t.type <> 'NULL' and t.fullkey <> '$' and not regexp_matches(t.fullkey, '\\]$')
), fields as (
  select distinct export_file, path, kind from places
)
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_report, p3_bridge, p3_links, p3_found, p3_objects, p3_values, p3_counts, p5_found, p5_catalogue, p5_types, p5_table, p5_nodes, p5_footers)}

SQL: dict[str, str] = {
    "p2_found": _STATES + "select ref, id, reason, period from direct",
    "p3_found": _TREE
    + """select distinct root_table, root_id, export_file, ltrim(place, '/') as path,
  coalesce(regexp_extract(ltrim(place, '/'), '^((?:.*/)?[0-9]+)/.*[^0-9/].*/[0-9]+$', 1), '') as parent_path,
  coalesce(case when json_type(value, '$.id') = 'VARCHAR' then value->>'$.id'
    when json_type(value, '$.name') = 'VARCHAR' then value->>'$.name'
    when json_type(value, '$.nodeId') = 'VARCHAR' then value->>'$.nodeId' end, '') as child_key
from tree where type = 'OBJECT' and regexp_matches(place, '/[0-9]+$')""",
    "p3_links": _TREE
    + """select root_table, root_id, export_file, ltrim(place, '/') as path, role,
  case when role = 'root' then '' else coalesce(regexp_extract(ltrim(place, '/'), '^((?:.*/)?[0-9]+)/.*[^0-9/].*' || case when role = 'element' then '/[0-9]+$' else '$' end, 1), '') end as parent_path,
  case when role = 'element' then regexp_extract(place, '[0-9]+$')::int else -1 end as ordinal,
  case when role = 'root' then '' else coalesce(case when json_type(value, '$.id') = 'VARCHAR' then value->>'$.id'
    when json_type(value, '$.name') = 'VARCHAR' then value->>'$.name'
    when json_type(value, '$.nodeId') = 'VARCHAR' then value->>'$.nodeId' end, '') end as child_key
from (select root_table, root_id, export_file, place, any_value(value) as value, case when place = '' then 'root' when regexp_matches(place, '/[0-9]+$') then 'element' else 'field' end as role
  from tree where type = 'OBJECT' or place = '' group by all)""",
    "p3_values": _TREE
    + """select root_table, root_id, export_file, ltrim(place, '/') as path,
  case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as type,
  case type when 'VARCHAR' then value->>'$' when 'NULL' then '' else value::varchar end as value
from (select distinct root_table, root_id, export_file, type, place, value::varchar as text, any_value(value) as value from tree where type not in ('OBJECT', 'ARRAY') group by all)""",
    "p3_counts": _TREE
    + """, kept as (
  select distinct root_table, root_id, export_file, place, type from tree where type = 'OBJECT' or place = ''
), roles as (
  select case when place = '' then 'root' when regexp_matches(place, '/[0-9]+$') then 'element' else 'field' end as role, count(*) as occurrences from kept group by all
)
select role, occurrences from roles union all select 'stored', sum(occurrences)::bigint from roles""",
    "p5_catalogue": _FIELDS
    + """, typed as (
  select export_file, path, string_agg(kind, '|' order by kind) as types from fields group by export_file, path
), ranked as (
  select t.export_file, t.path, t.types, f.rank, f.rank - row_number() over (partition by t.path order by f.rank) as run
  from typed t join files f using (export_file)
)
select path, dense_rank() over (partition by path order by run) as island, first_file, last_file, files, types from (
  select path, run, min(export_file) as first_file, max(export_file) as last_file, count(*) as files,
    string_agg(distinct types, ', ' order by types) as types
  from ranked group by path, run
)""",
    "p5_types": _FIELDS
    + """, ranked as (
  select export_file, path, kind, f.rank - row_number() over (partition by path, kind order by f.rank) as run from fields join files f using (export_file)
)
select path, kind as type, dense_rank() over (partition by path, kind order by run) as island,
  min(export_file) as first_file, max(export_file) as last_file, count(*) as files
from ranked group by path, kind, run""",
    "p5_nodes": f"""
with flows as (
  select distinct * exclude (flow_data), {_body("flow_data")} as body from workflow
), nodes as (
  select id, export_file, unnest(generate_series(0, len(json_extract(body, '$.nodes[*]')) - 1)) as place, unnest(json_extract(body, '$.nodes[*]')) as n
  from flows where body is not null and json_type(body) = 'OBJECT'
)
select id, export_file, place::int as place, n->>'$.id' as node_id, n->>'$.type' as node_type,
  coalesce(n->>'$.data.modelName', n->>'$.data.model') as model, coalesce(n->>'$.data.maxTokens', n->>'$.data.maxtokens') as max_tokens,
  n->>'$.data.configId' as config_id, n->>'$.data.temperature' as temperature,
  case json_type(n, '$.data.tags') when 'ARRAY' then array_to_string(json_extract_string(n, '$.data.tags[*]'), ',') else n->>'$.data.tags' end as tags,
  case when json_type(n, '$.data.inputParams') = 'ARRAY' then array_to_string(list_transform(json_extract(n, '$.data.inputParams[*]'), lambda x: coalesce(x->>'$.ref', x->>'$.referenceNode', '-')), ',') end as refs,
  case when json_type(n, '$.data.outputParams') = 'ARRAY' then array_to_string(list_transform(json_extract(n, '$.data.outputParams[*]'), lambda x: coalesce(x->>'$.desc', x->>'$.description', '-')), ',') end as descriptions
from nodes""",
    "p5_footers": f"""
select table_name as file, column_name as path, case
    when data_type like '%[]' then 'array' when data_type like 'DECIMAL(%' then 'decimal128(' || replace(data_type[9:], ',', ', ')
    when data_type = 'BIGINT' then 'int64' when data_type = 'INTEGER' then 'int32' when data_type = 'VARCHAR' then 'string' when data_type = 'TIMESTAMP' then 'timestamp[us]'
    when data_type = 'DATE' then 'date32[day]' else lower(data_type) end as type
from information_schema.columns where table_name in ({", ".join(f"'{x}'" for x in TABLES)})""",
    "p5_found": _FIELDS
    + """, typed as (
  select export_file, path, rank, string_agg(kind, '|' order by kind) as types from fields join files using (export_file) group by all
), added as (
  select n.* from typed n where n.rank > 1 and not exists (select 1 from typed o where o.path = n.path and o.rank = n.rank - 1)
), removed as (
  select o.rank + 1 as rank, o.path, o.types from typed o
  where o.rank < (select max(rank) from files) and not exists (select 1 from typed n where n.path = o.path and n.rank = o.rank + 1)
), pairs as (
  select a.rank, r.path as old_path, a.path as new_path, r.types as old_type, a.types as new_type from removed r join added a
  on a.rank = r.rank and regexp_replace(a.path, '(^|[.])[^.]*$', '') = regexp_replace(r.path, '(^|[.])[^.]*$', '')
), held as (
  select id, rank, path, string_agg(value, chr(1) order by place) as held from places join files using (export_file) group by all
), both_files as (
  select distinct n.id, n.rank from held n join held o on o.id = n.id and o.rank = n.rank - 1
), compared as (
  select p.*, o.held as a, n.held as b from pairs p join both_files w on w.rank = p.rank
  left join held o on o.id = w.id and o.rank = p.rank - 1 and o.path = p.old_path
  left join held n on n.id = w.id and n.rank = p.rank and n.path = p.new_path
), renamed as (
  select rank, old_path, new_path, old_type, new_type from compared where a is not null or b is not null
  group by all having count(case when a = b then 1 end) > 0 and count(case when a = b then 1 end) >= 0.9 * count(*)
), report as (
  select n.rank, 'type' as change, n.path as old_path, n.path as new_path, o.types as old_type, n.types as new_type
  from typed n join typed o on o.path = n.path and o.rank = n.rank - 1 where n.types <> o.types
  union all
  select rank, 'added', '', path, '', types from added a where not exists (select 1 from renamed x where x.rank = a.rank and x.new_path = a.path)
  union all
  select rank, 'removed', path, '', types, '' from removed r where not exists (select 1 from renamed x where x.rank = r.rank and x.old_path = r.path)
  union all
  select rank, 'renamed', old_path, new_path, old_type, new_type from renamed
)
select export_file, change, old_path, new_path, old_type, new_type from report join files using (rank)""",
    "p2_report": _STATES
    + """, inherited as (
  select distinct e.id, coalesce(strftime(e.executed_at, '%Y-%m'), '') as period from execution_record e
  where e.flow_id in (select id from direct where ref = 'workflow.owner_id')
    and e.id not in (select id from direct where ref = 'execution_record.flow_id')
)
select ref, period, 'direct' as kind, reason, count(*) as records from direct group by all
union all
select 'execution_record.flow_id', period, 'inherited', 'inherited', count(*) from inherited group by all""",
}
