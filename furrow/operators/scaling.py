"""Feature scaling statistics and their use."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.quality import standardise


def _stats(rows: DataFrame, features: list[str], std) -> DataFrame:
    wide = rows.agg(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.avg(F.col(f)).alias("mean"),
                std(F.stddev_pop(F.col(f))).alias("std"),
                F.count(F.col(f)).alias("count"),
            ).alias(f"s{i}")
            for i, f in enumerate(features)
        ]
    )
    return wide.select(F.explode(F.array(*[f"s{i}" for i in range(len(features))])).alias("_s")).select("_s.*")


def fit_masked_scaler(cells: DataFrame, features: Iterable[str], fill: float = 0.0, eps: float = 1e-6) -> DataFrame:
    """Mean, floored population std and count per feature over observed training steps.

    The mask is per step: a feature that is missing on an observed step counts with ``fill``.
    """
    features = list(features)
    rows = cells.where(F.col("observed") & (F.col("split") == "train"))
    rows = rows.withColumns({f: F.coalesce(F.col(f), F.lit(float(fill))) for f in features})
    return _stats(rows, features, lambda s: F.greatest(s, F.lit(eps)))


def fit_global_scaler(cells: DataFrame, features: Iterable[str], eps: float = 1e-6) -> DataFrame:
    """Mean and population std (+ eps) per feature over every cell."""
    return _stats(cells, list(features), lambda s: s + F.lit(eps))


def apply_scaler(cells: DataFrame, scaler: DataFrame, mask: bool = True) -> DataFrame:
    """Standardise the features of ``scaler`` (one row each); unobserved steps become 0."""
    seen = F.col("observed") if mask else None
    rows = scaler.collect()
    if any(r["count"] == 0 for r in rows):
        raise ValueError("a feature has no observed training value")
    return cells.withColumns({r["feature"]: standardise(F.col(r["feature"]), F.lit(r["mean"]), F.lit(r["std"]), seen) for r in rows})
