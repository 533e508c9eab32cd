"""The metadata tables: scans, lookups, and keyed changes as functions from table to table.

Parquet has no update in place, so a change is a new version of the table: the functions return it whole, and
``skein.sources.sinks.swap`` puts it in place of the old one. ``deleted`` is 1 for deleted rows; null and 0 are not.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import crypto, text
from skein.operators.graphs import first_of

#: The definition of the general completion node that is always there (fixed values).
GENERAL_NODE = {"node_type": "llm", "display_name": "大模型", "category": "LLM", "icon": "🤖"}
#: Order of configurations: defaults first, then the latest, then by id for a total order.
CONFIG_ORDER = ("is_default", "updated_at", "id")


def active(frame: DataFrame) -> DataFrame:
    """Rows that are not deleted."""
    return frame.where(F.coalesce(F.col("deleted"), F.lit(0)) == 0)


def current(frame: DataFrame, key: str = "id") -> DataFrame:
    """The row of each key with the latest ``updated_at``; of equal ones a deleted one, then any of identical rows.

    Only the ordering columns and one row per key and partition are shuffled, as the maximum is combined beforehand.
    """
    row = F.struct("updated_at", F.coalesce(F.col("deleted"), F.lit(0)).alias("__deleted"), *(F.col(x) for x in frame.columns if x not in (key, "updated_at")))
    picked = frame.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("row"))
    return picked.select(*(F.col(key) if x == key else F.col(f"row.{x}").alias(x) for x in frame.columns))


def accessible(frame: DataFrame, user: int, admin: bool) -> DataFrame:
    """Rows a user may see: all for an administrator, else their own; rows that nobody owns are for administrators."""
    return active(frame).where(F.lit(admin) | (F.col("owner_id") == user))


def usable_users(frame: DataFrame) -> DataFrame:
    return active(frame).where("enabled = 1").select("id", F.lower(text.trimmed(F.col("username"))).alias("username"), text.role(F.col("role")).alias("role"))


def node_definitions(frame: DataFrame) -> DataFrame:
    """One definition per node type, the last row winning, with the general completion node added where it is missing, without deleted ones."""
    last = first_of(frame, ["node_type"], F.col("id").desc())
    names = ["node_type", "display_name", "category", "icon"]
    general = frame.sparkSession.createDataFrame([tuple(GENERAL_NODE[x] for x in names)], ", ".join(f"{x} string" for x in names))
    missing = general.join(last.select("node_type"), "node_type", "left_anti")
    return active(last).select(*names).unionByName(missing.select(*names))


def node_definition(frame: DataFrame, node_type: str) -> DataFrame:
    """The definition of one type; the general completion node is always the built-in one."""
    if node_type == GENERAL_NODE["node_type"]:
        names = list(GENERAL_NODE)
        return frame.sparkSession.createDataFrame([tuple(GENERAL_NODE.values())], ", ".join(f"{x} string" for x in names))
    return active(frame).where(F.col("node_type") == node_type).select("node_type", "display_name", "category", "icon")


def ordered_configs(frame: DataFrame, provider: str | None = None) -> DataFrame:
    """Configurations, of one provider or all, defaults first and then the latest."""
    rows = active(frame)
    if provider is not None:
        rows = rows.where(F.col("provider") == provider)
    return rows.orderBy(*(F.col(x).desc() for x in CONFIG_ORDER))


def first_configs(frame: DataFrame) -> DataFrame:
    """Per provider the configuration that comes first, the default if there is one."""
    return first_of(active(frame), ["provider"], *(F.col(x).desc() for x in CONFIG_ORDER))


def default_config(frame: DataFrame, provider: str) -> DataFrame:
    """The default configuration of one provider, none where no configuration is marked; the first of several."""
    return ordered_configs(frame, provider).where("is_default = 1").limit(1)


def any_config(frame: DataFrame, provider: str, name: str) -> DataFrame:
    """One configuration of this provider and name, deleted or not; the lowest id of several."""
    return frame.where((F.col("provider") == provider) & (F.col("config_name") == name)).orderBy("id").limit(1)


def provider_counts(frame: DataFrame) -> DataFrame:
    return active(frame).groupBy("provider").agg(F.count(F.lit(1)).alias("configs"))


def masked_configs(frame: DataFrame, admin: bool) -> DataFrame:
    """Configurations as a user sees them: without keys unless an administrator."""
    return active(frame).withColumn("api_key", crypto.mask(F.col("api_key"), F.lit(admin)))


def resolved_configs(nodes: DataFrame, configs: DataFrame) -> DataFrame:
    """Completion nodes, from ``graphs.node_configs``, with the configuration they name, else their own settings, and what is missing.

    The rule is that of ``plans.engine.resolve_config``. ``configs`` has one row per id and is not hinted: where it is
    small Spark broadcasts it by its measured size.
    """
    names = ("provider", "api_url", "api_key", "model")
    c = active(configs).select(F.col("id").alias("__id"), *(F.col(x).alias(f"__{x}") for x in names), F.col("temperature").cast("double").alias("__temperature"))
    joined = nodes.join(c, F.col("config_id") == F.col("__id"), "left")
    found = F.col("__id").isNotNull()

    def either(name: str) -> Column:
        own = F.col(name) if name == "temperature" else text.trimmed(F.col(name))
        return F.when(found, F.col(f"__{name}")).otherwise(own)

    def named(name: Column) -> Column:
        return F.nullif(text.provider(name), F.lit(""))

    provider = F.coalesce(named(either("provider")), named(F.col("provider")), F.when(F.col("node_type") != "llm", text.provider(F.col("node_type"))))
    out = joined.select("id", "position", "node_id", "node_type", "config_id", found.alias("shared"), provider.alias("provider"), *(either(x).alias(x) for x in names[1:]), F.coalesce(either("temperature"), F.lit(0.7)).alias("temperature"))
    return out.withColumn("missing", text.missing_fields(**{x: F.col(x) for x in names})).drop("api_url", "api_key")


def normalized(configs: DataFrame) -> DataFrame:
    """Configurations with canonical provider and trimmed fields, empty ones null."""
    out = configs.withColumn("provider", text.provider(text.trimmed_or_null(F.col("provider")), "storage"))
    for name in ("config_name", "api_url", "api_key", "model"):
        out = out.withColumn(name, text.trimmed_or_null(F.col(name)))
    return out


def problems(configs: DataFrame, changes: DataFrame) -> DataFrame:
    """Why changes cannot be stored, ``id, problem``: missing fields, or a name that another configuration of the provider has."""
    wanted = normalized(changes)
    needed = ["provider", "config_name", "api_url", "model"]
    missing = F.array_compact(F.array(*(F.when(F.col(x).isNull(), x) for x in needed)))
    lacking = wanted.where(F.size(missing) > 0).select("id", F.concat(F.lit("missing: "), F.array_join(missing, ", ")).alias("problem"))
    others = active(configs).select(F.col("id").alias("__id"), F.col("provider").alias("__p"), F.col("config_name").alias("__n"))
    clash = (F.col("provider") == F.col("__p")) & (F.col("config_name") == F.col("__n")) & ~F.col("id").eqNullSafe(F.col("__id"))
    return lacking.unionByName(wanted.join(others, clash, "left_semi").select("id", F.lit("the name is taken").alias("problem")))


def upserted(configs: DataFrame, changes: DataFrame, secret: str | None = None) -> DataFrame:
    """The table after ``changes`` (same columns; rows of a known id update, others are new and have fresh ids).

    Deleted rows of the same provider and name are removed for good; a change without a key keeps the stored one; keys
    are encrypted if a secret is given. The first configuration of a provider becomes its default; an update to default
    clears the others of its provider, while a new default does not, as in the stored history.
    """
    wanted = normalized(changes).withColumn("__change", F.lit(True))
    old = configs.select(F.col("id").alias("__id"), F.col("api_key").alias("__key"))
    wanted = wanted.join(old, F.col("id") == F.col("__id"), "left").withColumn("__new", F.col("__id").isNull()).withColumn("api_key", F.coalesce("api_key", "__key"))
    if secret is not None:
        wanted = wanted.withColumn("api_key", crypto.encrypt(F.col("api_key"), secret))
    names = wanted.select(F.col("provider").alias("__p"), F.col("config_name").alias("__n"), F.col("id").alias("__w"))
    purged = (F.col("provider") == F.col("__p")) & (F.col("config_name") == F.col("__n")) & (F.col("id") != F.col("__w")) & (F.col("deleted") == 1)
    kept = configs.join(names, purged, "left_anti").join(wanted.select("id"), "id", "left_anti").select(*configs.columns)
    held = active(kept).select(F.col("provider").alias("__p")).distinct()
    fresh = wanted.join(held, F.col("provider") == F.col("__p"), "left")
    first = F.col("__new") & F.col("__p").isNull() & (F.row_number().over(W.partitionBy("provider", "__new").orderBy("id")) == 1)
    fresh = fresh.withColumn("is_default", F.when(first, 1).otherwise(F.coalesce("is_default", F.lit(0))))
    cleared = fresh.where(~F.col("__new") & (F.col("is_default") == 1)).select(F.col("provider").alias("__p")).distinct().withColumn("__cleared", F.lit(True))
    kept = kept.join(cleared, F.col("provider") == F.col("__p"), "left").withColumn("is_default", F.when(F.col("__cleared"), 0).otherwise(F.col("is_default")))
    return kept.select(*configs.columns).unionByName(fresh.select(*configs.columns))


def with_default(configs: DataFrame, config_id: int) -> DataFrame:
    """The table with one configuration as the only default of its provider."""
    own = configs.where(F.col("id") == config_id).select(F.col("provider").alias("__p"))
    joined = configs.join(own, F.col("provider") == F.col("__p"), "left")
    return joined.withColumn("is_default", F.when(F.col("__p").isNotNull(), (F.col("id") == config_id).cast("int")).otherwise(F.col("is_default"))).select(*configs.columns)


def without_config(configs: DataFrame, config_id: int) -> DataFrame:
    """The table without one configuration; if it was a default, the next one of its provider becomes it."""
    gone = configs.where((F.col("id") == config_id) & (F.col("is_default") == 1)).select(F.col("provider").alias("__p"))
    rest = configs.where(F.col("id") != config_id)
    next_one = first_of(active(rest).join(gone, F.col("provider") == F.col("__p"), "left_semi"), ["provider"], *(F.col(x).desc() for x in CONFIG_ORDER))
    promoted = next_one.select(F.col("id").alias("__promoted"))
    return rest.join(promoted, F.col("id") == F.col("__promoted"), "left").withColumn("is_default", F.when(F.col("__promoted").isNotNull(), 1).otherwise(F.col("is_default"))).select(*configs.columns)


def seeded(frame: DataFrame, seeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with those seed rows whose keys it does not have."""
    return frame.unionByName(seeds.join(frame.select(*keys), list(keys), "left_anti").select(*frame.columns))


def merged_options(builtin: DataFrame, seen: DataFrame, key: str, value: str) -> DataFrame:
    """Both lists, one row per key: the last value wins and the first place is kept."""
    both = builtin.select(F.lit(0).alias("__list"), "position", key, value).unionByName(seen.select(F.lit(1).alias("__list"), "position", key, value))
    place = F.struct("__list", "position")
    return both.groupBy(key).agg(F.max_by(value, place).alias(value), F.min(place).alias("__place")).orderBy("__place").select(key, value)


def replaced_partition(frame: DataFrame, fresh: DataFrame, column: str, value: Any) -> DataFrame:
    """The table with the rows of one partition replaced."""
    return frame.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(fresh.where(F.col(column) == value))


def soft_deleted(frame: DataFrame, key: Any, column: str = "id") -> DataFrame:
    return frame.withColumn("deleted", F.when(F.col(column) == key, 1).otherwise(F.col("deleted")))


def updated(frame: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with changed rows in place of old ones and new rows added, ``updated_at`` set to now."""
    stamped = changes.withColumn("updated_at", F.current_timestamp().cast(frame.schema["updated_at"].dataType))
    return frame.join(changes.select(key), key, "left_anti").select(*frame.columns).unionByName(stamped.select(*frame.columns))


def encrypted_keys(frame: DataFrame, secret: str, column: str = "api_key", json: bool = False) -> DataFrame:
    """The table with the keys of a column encrypted, or those inside its JSON; running it again changes nothing."""
    change = crypto.encrypt_in_json if json else crypto.encrypt
    return frame.withColumn(column, change(F.col(column), secret))
