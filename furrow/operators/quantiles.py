"""Exact quantiles and exact random ranks of groups that may hold most of the data.

Built-in exact percentiles keep every distinct value of a group in one task, and a window over the
group sorts it there. The operators here narrow a group down first with map-side combined counts:
only the slice around the wanted rank is ever sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.draws import draw_key
from furrow.session import small_side

# Sketch accuracy and half-width of the slice sorted around each wanted rank.
ACCURACY = 10_000
SLICE = 0.0004


def _zone(value: Column, cuts: Column, n: int) -> Column:
    """How many of the n cut points lie below the value."""
    above = [F.when(value > F.get(cuts, F.lit(i)), 1).otherwise(0) for i in range(n)]
    return reduce(lambda a, b: a + b, above)


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, in which NULL equals NULL; the left side's columns stay."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(other, same, how).drop(*[f"_r_{c}" for c in on])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Iterable[float] = (0.5,)) -> DataFrame:
    """Linear-interpolated exact quantiles per key: keys, ``prob``, ``quantile``.

    A mergeable sketch proposes cut points, exact counts per zone find the zone that holds each
    wanted rank, and only the values of those zones are combined and sorted. Poor cut points cost
    time, never exactness. The groups themselves (not their rows) are a dictionary-size table. Infinities
    are values like any other: between equal neighbours the quantile is that value.
    """
    keys, probs = list(keys), sorted(set(float(p) for p in probs))
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    around = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-SLICE, SLICE)})
    cuts = small_side(rows.groupBy(*by).agg(F.percentile_approx("_v", around, ACCURACY).alias("_cuts")))
    zoned = join_null_safe(rows, cuts, by).withColumn("_zone", _zone(F.col("_v"), F.col("_cuts"), len(around))).drop("_cuts")

    before = Window.partitionBy(*by).orderBy("_zone").rowsBetween(Window.unboundedPreceding, -1)
    zones = (
        zoned.groupBy(*by, "_zone")
        .agg(F.count(F.lit(1)).alias("_in"))
        .withColumn("_lo", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        .withColumn("_n", F.sum("_in").over(Window.partitionBy(*by)))
    )
    place = F.col("prob") * (F.col("_n") - 1)
    targets = (
        zones.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs])))
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_rank", F.when(F.col("_side") == 0, F.floor(place)).otherwise(F.ceil(place)))
        .where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_lo") + F.col("_in")))
        .withColumn("_part", place - F.floor(place))
        .select(*by, "_zone", "prob", "_side", "_part", (F.col("_rank") - F.col("_lo")).alias("_rank"))
    )
    wanted = small_side(targets)
    up_to = Window.partitionBy(*by, "_zone").orderBy("_v")
    slices = (
        join_null_safe(zoned, wanted.select(*by, "_zone").distinct(), [*by, "_zone"], "left_semi")
        .groupBy(*by, "_zone", "_v")
        .agg(F.count(F.lit(1)).alias("_in"))
        .withColumn("_to", F.sum("_in").over(up_to))
    )
    hit = (F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_in"))
    picked = join_null_safe(slices, wanted, [*by, "_zone"]).where(hit)
    out = picked.groupBy(*by, "prob").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_low"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_high"),
        F.max("_part").alias("_part"),
    )
    between = (1 - F.col("_part")) * F.col("_low") + F.col("_part") * F.col("_high")
    return out.select(*keys, "prob", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias("quantile"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5]).select(*keys, F.col("quantile").alias(out))


# Leading hex digits of the draw that make one bucket: 16**3 buckets per group.
DIGITS = 3


def with_draw(df: DataFrame, seed, key: str) -> DataFrame:
    return df.withColumn("_h", draw_key(seed, key))


def rank_cutoffs(df: DataFrame, by: Sequence[str], targets: DataFrame, seed, key: str, digits: int = DIGITS) -> DataFrame:
    """The row of each group that has a wanted random rank.

    ``targets`` has the group columns, a ``tag`` and a 1-based ``k``. The result has the group
    columns, ``tag`` and ``cut`` (draw and key of the k-th row), so that ``row <= cut`` selects
    exactly the first k rows with no sort of the group. Draws spread evenly over the buckets
    whatever the group, so one bucket of a group of n rows holds about n / 16**digits rows.
    """
    by = list(by)
    rows = with_draw(df.select(*by, key), seed, key).withColumn("_b", F.substring("_h", 1, digits))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        rows.groupBy(*by, "_b")
        .agg(F.count(F.lit(1)).alias("_in"))
        .withColumn("_lo", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    )
    hit = (F.col("k") > F.col("_lo")) & (F.col("k") <= F.col("_lo") + F.col("_in"))
    wanted = small_side(
        join_null_safe(buckets, targets, by).where(hit).select(*by, "tag", "_b", (F.col("k") - F.col("_lo")).alias("_r"))
    )
    order = Window.partitionBy(*by, "tag", "_b").orderBy("_h", key)
    return (
        join_null_safe(rows, wanted, [*by, "_b"])
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") == F.col("_r"))
        .select(*by, "tag", F.struct("_h", F.col(key).alias("_k")).alias("cut"))
    )


def random_rank(df: DataFrame, by: Sequence[str], seed, key: str, out: str = "rank", digits: int = DIGITS) -> DataFrame:
    """Exact 1-based random rank of every row of its group, spread over hash buckets."""
    by = list(by)
    rows = with_draw(df, seed, key).withColumn("_b", F.substring("_h", 1, digits))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, "_b")
        .agg(F.count(F.lit(1)).alias("_in"))
        .select(*by, "_b", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_lo"))
    )
    order = Window.partitionBy(*by, "_b").orderBy("_h", key)
    ranked = rows.withColumn("_rn", F.row_number().over(order))
    return join_null_safe(ranked, offsets, [*by, "_b"]).withColumn(out, F.col("_rn") + F.col("_lo")).drop("_h", "_b", "_rn", "_lo")
