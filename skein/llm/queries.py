"""Queries of the text operators over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import leakage, pairs, percentiles, splitting, tokenizer
from skein.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective question-answer pairs: ``id, defect``."""
    return pairs.broken_pairs(table(spark, folder, "execution_record"))


def _durations(spark: SparkSession, folder: str) -> DataFrame:
    """Durations that count: ``id, flow_id, status, day, duration``; repeated rows are still repeated."""
    status = F.upper(F.trim(F.col("status"))).alias("status")
    return table(spark, folder, "execution_record").where("duration >= 0").select("id", "flow_id", status, F.substring(F.col("executed_at").cast("string"), 1, 10).alias("day"), "duration")


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact 50th, 90th and 99th percentiles of duration per flow and status, by radix selection; each id counts once."""
    return percentiles.radix_select(_durations(spark, folder), ["flow_id", "status"], "duration", unique=["id"])


def p4_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Mergeable histograms of single days."""
    return percentiles.histogram(_durations(spark, folder).distinct(), ["day", "flow_id", "status"], "duration")


def p4_combined(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per flow and status from the combined histograms of single days, with the ends of their buckets."""
    groups = ["flow_id", "status"]
    return percentiles.percentiles_of(percentiles.combine(p4_daily(spark, folder), groups), groups)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as token ids: ``doc_id, ids``."""
    return tokenizer.encode_table(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item: ``doc_id, item_id``."""
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_item")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of more than 1,024 tokens: those of which the splitter makes a second piece."""
    return splitting.split_table(table(spark, folder, "documents"), with_text=False).where("piece = 1").select("doc_id")


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every document, each within 1,024 tokens."""
    return splitting.split_table(table(spark, folder, "documents"))


def p8_cover(spark: SparkSession, folder: str) -> DataFrame:
    """The texts put together again from their pieces, and whether all pieces, encoded anew, keep the limit and the overlap.

    Each piece is cut where the piece before it ends; what is cut off is the overlap.
    """
    over = W.partitionBy("doc_id").orderBy("piece")
    pieces = p8_pieces(spark, folder).withColumn("before", F.lag("end").over(over)).withColumn("name", F.xxhash64("doc_id", "piece"))
    shared = F.coalesce(F.col("before") - F.col("start"), F.lit(0))
    both = F.filter(F.array(F.struct("name", "text"), F.struct((-F.col("name") - 1).alias("name"), F.substring(F.col("text"), F.lit(1), shared).alias("text"))), lambda x: x["text"] != "")
    sizes = tokenizer.encode_table(pieces.select(F.explode(both).alias("x")).select("x.name", "x.text"), key="name").select("name", F.size("ids").alias("size"))
    kept = pieces.select("doc_id", "piece", "name", "before", "start", F.substring(F.col("text"), shared + 1, F.length("text")).alias("fresh"))
    checked = kept.join(sizes, "name").join(sizes.select((-F.col("name") - 1).alias("name"), F.col("size").alias("overlap")), "name", "left")
    fine = (F.col("size") <= splitting.LIMIT) & F.when(F.col("before").isNull(), F.col("start") == 0).otherwise(F.coalesce(F.col("overlap").between(1, splitting.OVERLAP), F.lit(False)))
    whole = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "fresh"))), lambda x: x["fresh"]), ""))
    return checked.groupBy("doc_id").agg(whole.alias("whole"), F.min(fine).alias("fine"))


QUERIES = {f.__name__: f for f in (p1_found, p4_percentiles, p4_daily, p4_combined, p6_ids, p7_found, p8_found, p8_pieces, p8_cover)}

_DURATIONS = """
with d as (
  select distinct id, flow_id, upper(trim(status)) as status, duration from execution_record where duration >= 0
), r as (
  select flow_id, status, duration, row_number() over (partition by flow_id, status order by duration) as k,
    count(*) over (partition by flow_id, status) as n from d
)
"""

#: The leading 19 bits of a whole number as a double: sign and exponent, and 7 bits of the fraction.
_BUCKETS = """
with b as (
  select distinct id, strftime(executed_at, '%Y-%m-%d') as day, flow_id, upper(trim(status)) as status, duration,
    case when duration = 0 then 0::bigint
      else (floor(log2(duration))::bigint + 1023) * 128 + floor((duration / pow(2, floor(log2(duration))) - 1) * 128)::bigint end as bucket
  from execution_record where duration >= 0
)
"""

_ENDS = "".join(
    f", max(case when rank_{p} > before and rank_{p} <= upto then low end) as p{p}_low, max(case when rank_{p} > before and rank_{p} <= upto then high end) as p{p}_high"
    f", max(case when rank_{p} > before and rank_{p} <= upto then (low + high) / 2 end) as p{p}"
    for p in (50, 90, 99)
)

SQL = {
    "p8_cover": "select doc_id, md5(text) as whole, true as fine from documents where length(text) > 0",
    "p4_daily": _BUCKETS + "select day, flow_id, status, bucket, count(*) as records from b group by all",
    "p4_combined": _BUCKETS
    + """, h as (
  select flow_id, status, bucket, count(*) as records from b group by all
), c as (
  select *, sum(records) over (partition by flow_id, status order by bucket) as upto, sum(records) over (partition by flow_id, status) as n,
    case when bucket = 0 then 0.0 else pow(2, bucket // 128 - 1023) * (1 + (bucket % 128) / 128.0) end as low,
    case when bucket = 0 then pow(2.0, -1022) * (pow(2.0, -7) - pow(2.0, -52)) else pow(2, bucket // 128 - 1023) * (1 + (bucket % 128) / 128.0 + 1 / 128.0 - pow(2.0, -52)) end as high
  from h
), r as (
  select *, upto - records as before, greatest(1, ceil(n * 0.5 - 1e-9)) as rank_50, greatest(1, ceil(n * 0.9 - 1e-9)) as rank_90, greatest(1, ceil(n * 0.99 - 1e-9)) as rank_99 from c
)
select flow_id, status, n::bigint as n"""
    + _ENDS
    + " from r group by flow_id, status, n",
    "p4_percentiles": _DURATIONS
    + """select flow_id, status, n,
  max(case when k = greatest(1, ceil(n * 0.5 - 1e-9)) then duration end)::double as p50,
  max(case when k = greatest(1, ceil(n * 0.9 - 1e-9)) then duration end)::double as p90,
  max(case when k = greatest(1, ceil(n * 0.99 - 1e-9)) then duration end)::double as p99
from r group by flow_id, status, n""",
}
