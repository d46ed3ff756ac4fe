"""Synthetic minority rows on segments between neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.draws import uniform
from furrow.operators.neighbours import nearest_neighbours
from furrow.operators.quantiles import random_rank
from furrow.operators.sampling import class_intervals
from furrow.session import cut_lineage, small_side


def _needs(train: DataFrame, label: str, k: int) -> DataFrame:
    """Classes below the majority size: their count ``n`` and ``need``."""
    sizes = small_side(train.groupBy(label).agg(F.count(F.lit(1)).alias("n")))
    most = sizes.agg(F.max("n")).first()[0]
    short = sizes.where(F.col("n") < most)
    small = short.where(F.col("n") <= k).limit(1).collect()
    if small:
        raise ValueError(f"class {small[0][label]} has {small[0]['n']} rows; more than {k} are needed")
    return short.withColumn("need", F.lit(most) - F.col("n"))


def _draws(seeds: DataFrame, needs: DataFrame, k: int, seed: int, label: str, key: str) -> DataFrame:
    """``need`` draws per class: a random seed row, which of its k neighbours, and how far towards it.

    The draws are a range over all classes; seed rows are looked up by random rank, so no class
    is handled in one piece.
    """
    ranked = random_rank(seeds.select(key, label), [label], seed, key)
    sizes = seeds.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    table = small_side(sizes.join(needs.select(label, "need"), label))
    total = table.agg(F.sum("need")).first()[0] or 0
    draws = (
        seeds.sparkSession.range(total)
        .withColumnRenamed("id", "draw")
        .withColumn("_all", class_intervals(table, label, F.col("need")))
        .withColumn("_c", F.get(F.filter("_all", lambda c: c["hi"] > F.col("draw")), F.lit(0)))
        .select(
            "draw",
            F.col("_c.label").alias(label),
            (F.floor(uniform(f"{seed}r", "draw") * F.col("_c.n")) + 1).alias("rank"),
            (F.floor(uniform(f"{seed}n", "draw") * k) + 1).cast("int").alias("slot"),
            uniform(f"{seed}g", "draw").alias("gap"),
        )
    )
    return draws.join(ranked, [label, "rank"]).drop("rank")


def _synthesise(rows: DataFrame, drawn: DataFrame, near: DataFrame, label: str, key: str) -> DataFrame:
    """A new row for every draw, between its seed row and the neighbour it names."""
    pairs = drawn.join(near.select(key, F.col("rank").alias("slot"), "neighbour"), [key, "slot"])
    base = rows.select(key, F.col("vec").alias("_a"))
    other = rows.select(F.col(key).alias("neighbour"), F.col("vec").alias("_b"))
    moved = F.zip_with("_a", "_b", lambda a, b: a + F.col("gap") * (b - a))
    return pairs.join(base, key).join(other, "neighbour").select(
        F.concat(F.lit("synthetic-"), F.col("draw").cast("string")).alias(key),
        label,
        moved.alias("vec"),
        F.col(key).alias("base"),
        "neighbour",
        "gap",
    )


def synthetic_rows(train: DataFrame, k: int = 5, seed: int = 42, label: str = "label", key: str = "parcel_id", borderline: bool = False, m: int = 10, method: str = "exact") -> DataFrame:
    """The new rows only, with the two rows each lies between. ``train`` has ``vec``.

    Seed rows are drawn first: neighbours are searched for the distinct drawn rows alone, which are few where classes are nearly balanced.
    """
    rows = train.select(F.col(key).cast("string").alias(key), label, "vec")
    needs = _needs(rows, label, k)
    minority = rows.join(small_side(needs.select(label)), label, "left_semi")
    seeds = danger_rows(rows, minority, m, label, key, method) if borderline else minority
    drawn = cut_lineage(_draws(seeds, needs, k, seed, label, key))
    bases = minority.join(drawn.select(key).distinct(), key, "left_semi")
    near = nearest_neighbours(minority, bases, k, label, key, seed=seed, method=method)
    return _synthesise(minority, drawn, near, label, key)


def danger_rows(rows: DataFrame, minority: DataFrame, m: int = 10, label: str = "label", key: str = "parcel_id", method: str = "exact") -> DataFrame:
    """Minority rows with at least half, but not all, of their m neighbours in other classes."""
    near = nearest_neighbours(rows, minority, m, None, key, method=method)
    own = minority.select(key, F.col(label).alias("_own"))
    other = rows.select(F.col(key).alias("neighbour"), F.col(label).alias("_other"))
    foreign = near.join(own, key).join(other, "neighbour").groupBy(key).agg(F.count_if(F.col("_own") != F.col("_other")).alias("_f"))
    chosen = foreign.where((F.col("_f") >= m / 2) & (F.col("_f") < m))
    return minority.join(chosen.select(key), key, "left_semi")


def _wide(train: DataFrame, new: DataFrame, features: Sequence[str], label: str, key: str) -> DataFrame:
    cols = [F.get("vec", F.lit(i)).alias(f) for i, f in enumerate(features)]
    kept = train.select(F.col(key).cast("string").alias(key), label, *[F.col(f).cast("double").alias(f) for f in features])
    return kept.unionByName(new.select(key, label, *cols))


def with_vec(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumn("vec", F.array(*[F.col(f).cast("double") for f in features]))


def smote(train: DataFrame, features: Sequence[str], k: int = 5, seed: int = 42, label: str = "label", key: str = "parcel_id", method: str = "exact") -> DataFrame:
    """Training rows plus synthetic ones, until every class has as many rows as the largest."""
    new = synthetic_rows(with_vec(train, features), k, seed, label, key, method=method)
    return _wide(train, new, features, label, key)


def borderline_smote(train: DataFrame, features: Sequence[str], k: int = 5, m: int = 10, seed: int = 42, label: str = "label", key: str = "parcel_id", method: str = "exact") -> DataFrame:
    """The same, but only rows near other classes are seeds; a class without any stays as it is."""
    new = synthetic_rows(with_vec(train, features), k, seed, label, key, borderline=True, m=m, method=method)
    return _wide(train, new, features, label, key)
