"""Percentiles of very large numeric columns by radix selection, exact or with a bound, mergeable over partitions and days.

A value is mapped to an unsigned 64-bit integer of the same order: the bits of the double, with the sign bit flipped for
positive and all bits for negative numbers. Selection histograms the leading digit per group, finds the digit that holds
each target rank by running sums, and follows only that digit to the next one; the last digit is all the bits left.

Histograms of leading bits are sums, so those of partitions or days add up to the one of all, and a percentile read from
the sum has the same bound as one read from a single pass: with ``bits`` leading bits the value lies in the bucket that
is reported, whose ends differ by at most 2**-(bits-12) of the value (12 bits are sign and exponent). With all 64 bits
selection is exact.

Defined results: the percentile p of n values is the value of rank ceil(p*n), at least 1; null and NaN values are left
out; -0.0 counts as 0.0; ties and repeated values count as often as they occur; a null group is a group; a group
without values gives no row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of the leading digit: sign, exponent and 12 bits of the fraction, so a group has at most 4,096 digits for values between two powers of two.
LEAD = 24
#: Different values below one leading digit that one task tells apart.
AT_ONCE = 4_000_000
#: Leading bits of the daily histograms: sign, exponent and 7 bits of the fraction, a bound of 2**-7 of the value.
SKETCH_BITS = 19

_SIGN = -(2**63)


def ordered_bits(value: F.Column) -> F.Column:
    """Signed 64-bit integer whose order is that of the doubles; the sign bit of the unsigned form is kept flipped.

    Exponent and fraction are computed with powers of two, which is exact for doubles, so no bits are reinterpreted and
    everything stays in generated code.
    """
    size = F.abs(value)
    # exponent: log2 is off by one at most, so it is put right by comparison
    rough = F.floor(F.log2(F.when(size > 0, size).otherwise(1.0)))
    power = F.pow(F.lit(2.0), rough)
    exponent = F.when(power > size, rough - 1).when(power * 2 <= size, rough + 1).otherwise(rough)
    normal = exponent >= -1022
    scaled = size / F.pow(F.lit(2.0), exponent)
    fraction = F.when(normal, (scaled - 1) * float(2**52)).otherwise(size * F.pow(F.lit(2.0), F.lit(537.0)) * F.pow(F.lit(2.0), F.lit(537.0)))
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(0x7FF0000000000000)).otherwise(F.when(normal, (exponent + 1023).cast("long") * F.lit(2**52)).otherwise(0) + fraction.cast("long"))
    return F.when(value < 0, -bits - 1).otherwise(bits)


def value_of(bits: F.Column) -> F.Column:
    """The double with these ordered bits."""
    size = F.when(bits < 0, -bits - 1).otherwise(bits)
    exponent = F.shiftright(size, 52)
    fraction = size.bitwiseAND(F.lit(2**52 - 1)).cast("double")
    small = fraction / F.pow(F.lit(2.0), F.lit(537.0)) / F.pow(F.lit(2.0), F.lit(537.0))
    normal = (fraction / float(2**52) + 1) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    found = F.when(size >= 0x7FF0000000000000, float("inf")).when(exponent == 0, small).otherwise(normal)
    return F.when(bits < 0, -found).otherwise(found)


def histogram(frame: DataFrame, groups: Sequence[str], value: str, bits: int = SKETCH_BITS) -> DataFrame:
    """Counts per group and leading ``bits``: ``*groups, bucket, records``; sums of such tables are such tables."""
    number = F.col(value).cast("double")
    kept = frame.where(number.isNotNull() & ~F.isnan(number))
    return kept.groupBy(*groups, F.shiftright(ordered_bits(number), 64 - bits).alias("bucket")).agg(F.count(F.lit(1)).alias("records"))


def combine(histograms: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The histogram of all rows from those of their parts, by day or partition."""
    return histograms.groupBy(*groups, "bucket").agg(F.sum("records").alias("records"))


def _name(share: float) -> str:
    return "p" + f"{share * 100:g}".replace(".", "_")


def _rank(share: float) -> F.Column:
    """The 1-based rank ceil(share * n) among ``n`` values, at least 1.

    The share counts as the decimal fraction that it is written as, and the product is one of whole numbers, so the rank
    is exact for any n.
    """
    p, q = Fraction(str(share)).as_integer_ratio()
    # n is taken apart by q, so the products stay as small as n and q * q; shares of more than nine digits need decimals
    exact = f"(n div {q}L) * {p}L + ((n % {q}L) * {p}L + {q - 1}L) div {q}L" if q <= 10**9 else f"cast((cast(n as decimal(19, 0)) * {p}BD + {q - 1}BD) div {q}BD as long)"
    return F.greatest(F.lit(1).cast("long"), F.expr(exact))


def _ranks(shares: Sequence[float]) -> F.Column:
    """Per target its index and rank."""
    return F.array(*(F.struct(F.lit(i).alias("target"), _rank(share).alias("rank")) for i, share in enumerate(shares)))


def percentiles_of(histograms: DataFrame, groups: Sequence[str], shares: Sequence[float] = (0.5, 0.9, 0.99), bits: int = SKETCH_BITS) -> DataFrame:
    """Percentiles from a combined histogram: ``*groups, n`` and per share the ends of the bucket that holds it.

    Columns ``pX_low`` and ``pX_high`` enclose the exact percentile; ``pX`` is their middle. The window of a group holds
    its buckets, at most 2**bits, not its rows.
    """
    over = W.partitionBy(*groups).orderBy("bucket")
    run = histograms.withColumn("upto", F.sum("records").over(over)).withColumn("n", F.sum("records").over(W.partitionBy(*groups)))
    run = run.withColumn("ranks", F.filter(_ranks(shares), lambda x: (x["rank"] <= F.col("upto")) & (x["rank"] > F.col("upto") - F.col("records")))).where(F.size("ranks") > 0)
    step = 64 - bits
    low, high = value_of(F.shiftleft(F.col("bucket"), step)), value_of(F.shiftleft(F.col("bucket"), step) + F.lit(2**step - 1))
    hit = run.select(*groups, "n", F.explode("ranks.target").alias("target"), low.alias("low"), high.alias("high"))
    out = []
    for i, share in enumerate(shares):
        mine = F.col("target") == i
        out += [F.max(F.when(mine, (F.col("low") + F.col("high")) / 2)).alias(_name(share)), F.max(F.when(mine, F.col("low"))).alias(f"{_name(share)}_low"), F.max(F.when(mine, F.col("high"))).alias(f"{_name(share)}_high")]
    return hit.groupBy(*groups, "n").agg(*out)


def _within(frame: DataFrame, keys: Sequence[str], by: str, ranks: Sequence[str]) -> DataFrame:
    """The rows of a histogram that hold a rank; their ranks count from the row's first value, those of other rows are null."""
    upto = F.sum("records").over(W.partitionBy(*keys).orderBy(by))
    run = frame.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("records"))
    held = [F.when((F.col(x) > F.col("below")) & (F.col(x) <= F.col("upto")), F.col(x) - F.col("below")).alias(x) for x in ranks]
    return run.select(*(x for x in frame.columns if x not in (*ranks, "records")), *held).where(F.coalesce(*ranks).isNotNull())


def _follow(counted: DataFrame, hits: DataFrame, digit: str) -> DataFrame:
    """The counted values below the digits that hold a rank, with what ``hits`` has beside the digits."""
    rest = [x for x in hits.columns if x not in ("group", digit)]
    wanted = hits.select(F.col("group").alias("group_"), F.col(digit).alias("digit_"), *rest)
    return counted.join(wanted, (F.col("group") == F.col("group_")) & (F.col(digit) == F.col("digit_"))).select(*counted.columns, *rest)


def radix_select(frame: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float] = (0.5, 0.9, 0.99), unique: Sequence[str] = (), at_once: int = AT_ONCE) -> DataFrame:
    """Exact percentiles per group: ``*groups, n`` and one column per share.

    Values are counted per group before they are placed, so a value that a third of all rows hold costs a row per task.
    With ``unique`` rows that agree in these columns, the groups and the value count once; they are brought together
    in salts, and the counting needs no exchange of its own. Then each value lies where its group and its leading digit
    put it: a hot group is spread over its digits. The histogram of leading digits, the only thing that a group's ranks
    need as a whole, gives the digit of each target, and only the values below it are followed. They lie together by
    then, so the remaining digits are told apart in place, without a further exchange. Digits with more than ``at_once``
    different values are first divided by a second digit.
    """
    number = F.col(value).cast("double")
    group = F.struct(*(F.col(x).alias(f"g{i}") for i, x in enumerate(groups))).alias("group")  # never null, also where its parts are
    rows = frame.where(number.isNotNull() & ~F.isnan(number)).select(group, *(F.col(x).alias(f"u{i}") for i, x in enumerate(unique)), number.alias("number"))
    salt: list[str] = []
    if unique:
        salts = 4 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # more than tasks, so that tasks are alike
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(*(f"u{i}" for i in range(len(unique)))), F.lit(salts))).repartition("salt").distinct()
        salt = ["salt"]
    parts = rows.groupBy(*salt, "group", "number").agg(F.count(F.lit(1)).alias("records"))
    # never null, so that no test for null tells one use of the counts from another and Spark keeps a single exchange
    bits = parts.select("group", F.coalesce(ordered_bits(F.col("number")), F.lit(0)).alias("bits"), "records")
    lead = F.shiftright("bits", 64 - LEAD).alias("lead")
    counted = bits.select("group", lead, "bits", "records").repartition("group", "lead").groupBy("group", "lead", "bits").agg(F.sum("records").alias("records"))
    ranks = [f"rank{i}" for i in range(len(shares))]
    digits = counted.groupBy("group", "lead").agg(F.sum("records").alias("records"), F.count(F.lit(1)).alias("different"))
    digits = digits.withColumn("n", F.sum("records").over(W.partitionBy("group"))).select("*", *(_rank(share).alias(x) for x, share in zip(ranks, shares, strict=True)))
    hits = _within(digits, ["group"], "lead", ranks)
    found = _within(_follow(counted, hits.where(F.col("different") <= at_once), "lead"), ["group", "lead"], "bits", ranks).select("group", "n", "bits", *ranks)
    # digits with too many different values for one task: a second digit divides them before they are followed
    wide = _follow(counted, hits.where(F.col("different") > at_once), "lead").withColumn("next", F.shiftright("bits", 64 - 2 * LEAD))
    nexts = wide.groupBy("group", "lead", "next", "n", *ranks).agg(F.sum("records").alias("records"))
    second = _within(nexts, ["group", "lead"], "next", ranks).select("group", "next", "n", *ranks)
    found = found.unionByName(_within(_follow(wide.select("group", "next", "bits", "records"), second, "next"), ["group", "next"], "bits", ranks).select("group", "n", "bits", *ranks))
    exact = [F.max(F.when(F.col(x).isNotNull(), value_of(F.col("bits")))).alias(_name(share)) for x, share in zip(ranks, shares, strict=True)]
    result = found.groupBy("group", "n").agg(*exact)
    return result.select(*(F.col("group")[f"g{i}"].alias(x) for i, x in enumerate(groups)), "n", *(_name(x) for x in shares))
