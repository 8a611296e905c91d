"""Aggregations over events and facts: filtered counts, time buckets, windows of the newest rows, ratios and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import micros


def counts_where(df: DataFrame, by: list[str], **tests: Column) -> DataFrame:
    """One count per named predicate, all in one pass; null predicates don't count."""
    aggs = [F.count_if(c).alias(n) for n, c in tests.items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def bucketed(df: DataFrame, ts: str, unit: str, by: list[str], **aggs: Column) -> DataFrame:
    """Aggregates per minute, hour or day of ``ts``."""
    if unit not in ("minute", "hour", "day"):
        raise ValueError(f"no such bucket: {unit}")
    return df.groupBy(F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("bucket"), *by).agg(*[c.alias(n) for n, c in aggs.items()])


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def preferred_max(value: Column, preferred: Column) -> Column:
    """The maximum over preferred rows, else over the others; null if neither has a value."""
    return F.coalesce(F.max(F.when(preferred, value)), F.max(F.when(~preferred, value)))


def safe_ratio(part: Column, whole: Column, otherwise: float) -> Column:
    """part / whole, or a neutral value where whole is null or not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(otherwise))


def geometric_mean(value: Column, floor: float = 0.01) -> Column:
    return F.exp(F.avg(F.log(F.greatest(value, F.lit(floor)))))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % score interval of a rate; [0, 1] without trials."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def nearest_rank(df: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """The value at rank ceil(p * n) of each group, exactly."""
    return df.groupBy(*by).agg(F.expr(f"percentile_disc({p}) within group (order by {value})").alias("at_rank"), F.count(value).alias("n"))


def first_over_threshold(df: DataFrame, keys: list[str], ts: str, days: int, threshold: int) -> DataFrame:
    """Per key, the first row at which the count of the last ``days`` days reaches the threshold."""
    w = Window.partitionBy(*keys).orderBy(micros(ts)).rangeBetween(-days * 86_400_000_000, 0)
    hot = df.withColumn("in_window", F.count("*").over(w)).filter(F.col("in_window") >= threshold)
    return hot.groupBy(*keys).agg(F.min(ts).alias("first_at"))


def fair_batch(items: DataFrame, checked: DataFrame, stale_before: Column, size: int, key: str = "info_hash") -> DataFrame:
    """(key, never) of a bounded batch: half is kept for the oldest rechecks, so that new rows can't starve them; the rest goes to rows
    that were never checked, then to more rechecks. ``checked``: key, at."""
    j = items.join(checked.select(key, "at"), key, "left").filter(F.col("at").isNull() | (F.col("at") < stale_before))
    oldest = j.filter(F.col("at").isNotNull()).orderBy("at", key).limit(size // 2)
    others = j.join(oldest.select(key), key, "left_anti").orderBy(F.col("at").asc_nulls_first(), key).limit(size)
    first = oldest.withColumn("_part", F.lit(0)).unionByName(others.withColumn("_part", F.lit(1)))
    # at most one and a half batches
    taken = first.orderBy("_part", F.col("at").asc_nulls_first(), key).limit(size)
    return taken.select(key, F.col("at").isNull().alias("never"))


#: Bits and hash functions of a swarm's filter.
SWARM_BITS, SWARM_HASHES = 2048, 2


def swarm_positions(peer: Column) -> Column:
    """The bits that a peer sets: two positions from the first four bytes of its SHA-1, low byte first."""
    digest = F.sha1(peer)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    return F.array(*[(byte(2 * i) + 256 * byte(2 * i + 1)) % SWARM_BITS for i in range(SWARM_HASHES)])


def swarm_sizes(peers: DataFrame, group: str, peer: Column) -> DataFrame:
    """(group, bits, size): how many different peers a group has, by the bits that all its filters have set together.

    Filters merge by union, so the distinct positions are the merged filter, of at most 2,048 rows a group. A full filter
    counts as one bit short of full.
    """
    bits = peers.select(group, F.explode(swarm_positions(peer)).alias("bit")).distinct().groupBy(group).agg(F.count("*").alias("bits"))
    zeros = F.greatest(F.lit(1), F.lit(SWARM_BITS) - F.col("bits"))
    size = F.log(zeros / SWARM_BITS) / (SWARM_HASHES * F.log(F.lit(1 - 1 / SWARM_BITS)))
    return bits.select(group, "bits", F.round(size, 4).alias("size"))
