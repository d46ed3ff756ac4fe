"""Roll-ups of feature and time-step importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.text import parse_date, split_feature


def named_features(gains: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace positional names ``f0, f1, ...``; positions beyond the list are dropped."""
    position = F.regexp_extract("feature", r"^f(\d+)$", 1)
    listed = F.array(*[F.lit(n) for n in names])
    name = F.when(position == "", F.col("feature")).otherwise(F.get(listed, position.try_cast("int")))
    return gains.withColumn("feature", name).where(F.col("feature").isNotNull())


def importance_by_date_and_index(imp: DataFrame, value: str = "gain") -> tuple[DataFrame, DataFrame]:
    """Sum per date (``idx__date`` features only) and per index, largest first."""
    parts = imp.withColumn("_f", split_feature("feature"))
    dated = parts.withColumn("date", parse_date("_f.suffix")).where(F.col("date").isNotNull())
    by_date = dated.groupBy("date").agg(F.sum(value).alias(value)).orderBy(F.desc(value), "date")
    by_index = parts.groupBy(F.col("_f.idx").alias("idx")).agg(F.sum(value).alias(value)).orderBy(F.desc(value), "idx")
    return by_date, by_index


def temporal_importance(scores: DataFrame) -> DataFrame:
    """Mean score of the observed cells per date, with the day of year."""
    seen = F.col("observed").cast("double")
    mean = F.sum(F.col("score") * seen) / F.greatest(F.sum(seen), F.lit(1e-6))
    return scores.groupBy("date").agg(mean.alias("mean_score")).select("date", F.dayofyear("date").alias("doy"), "mean_score")


def top_features(imp: DataFrame, n: int = 15, value: str = "importance") -> DataFrame:
    return imp.orderBy(F.desc(value), "feature").limit(n)
