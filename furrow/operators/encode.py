"""Class dictionaries, class weights and class-group tables.

A class table has one row per class and goes through ``small_side``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.config import MISSING_GROUP
from furrow.functions.text import strip
from furrow.operators.quantiles import exact_quantiles
from furrow.session import small_side


def label_dictionary(df: DataFrame, col: str = "label", out: str = "label_id") -> DataFrame:
    """Names and dense ids, by sorted name; blanks get no id."""
    names = df.select(strip(col).alias(col)).where(F.col(col) != "").distinct()
    return names.withColumn(out, F.row_number().over(Window.orderBy(col)) - 1)


def encode_labels(df: DataFrame, col: str = "label", out: str = "label_id", missing: int = MISSING_GROUP) -> DataFrame:
    """Add the dense id of a text column; rows without a name get ``missing``."""
    names = small_side(label_dictionary(df, col, out))
    joined = df.withColumn("_name", strip(col)).join(names.withColumnRenamed(col, "_name"), "_name", "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(missing))).drop("_name")


def _counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _on_classes(df: DataFrame, table: DataFrame, label: str) -> DataFrame:
    return df.join(small_side(table), label)


def _everything():
    return Window.partitionBy()


def balanced_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Row weight n / (K * n_c)."""
    table = _counts(df, label).select(
        label, (F.sum("n").over(_everything()) / (F.count(F.lit(1)).over(_everything()) * F.col("n"))).alias("weight")
    )
    return _on_classes(df, table, label)


def class_grid(train: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """Training count of every class of the dictionary; 0 where it has no row."""
    return classes.select(label).join(_counts(train, label), label, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_weight(train: DataFrame, classes: DataFrame, label: str = "label", power: float = 1.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """Powered and clipped class weights, divided by their mean: one row per class."""
    n = F.greatest(F.col("n"), F.lit(1))
    table = class_grid(train, classes, label)
    weight = F.pow(
        F.sum(n).over(_everything()) / (F.count(F.lit(1)).over(_everything()) * n), F.lit(float(power))
    )
    if low is not None:
        weight = F.greatest(weight, F.lit(float(low)))
    if high is not None:
        weight = F.least(weight, F.lit(float(high)))
    raw = table.select(label, "n", weight.alias("_w"))
    return raw.select(label, "n", (F.col("_w") / F.greatest(F.avg("_w").over(_everything()), F.lit(1e-12))).alias("weight"))


def sampling_weight(train: DataFrame, classes: DataFrame, label: str = "label", power: float = 1.0) -> DataFrame:
    """(1 / n_c) ** power with mean 1 over the classes: one row per class."""
    score = F.pow(1.0 / F.greatest(F.col("n"), F.lit(1)), F.lit(float(power)))
    raw = class_grid(train, classes, label).select(label, "n", score.alias("_w"))
    return raw.select(label, "n", (F.col("_w") / F.greatest(F.avg("_w").over(_everything()), F.lit(1e-12))).alias("weight"))


def rare_classes(counts: DataFrame, label: str = "label", q: float = 0.25, threshold: float | None = None) -> DataFrame:
    """Classes whose count is at most the threshold (the q-quantile of non-zero counts if not given).

    ``counts`` has one row per class with ``n``. If no class qualifies the smallest one does.
    """
    if threshold is None:
        cut = exact_quantiles(counts.where("n > 0"), [], "n", [min(1.0, max(0.0, q))]).select("quantile").scalar()
    else:
        cut = F.lit(float(threshold))
    smallest = F.row_number().over(Window.orderBy("n", label)) == 1
    with_cut = counts.withColumn("_cut", cut).withColumn("_first", smallest)
    none = F.max(F.col("n") <= F.col("_cut")).over(_everything()) == F.lit(False)
    return (
        with_cut.withColumn("_none", none)
        .where((F.col("n") <= F.col("_cut")) | (F.col("_none") & F.col("_first")))
        .select(label, "n", F.col("_cut").alias("threshold"))
    )


def rare_weight(train: DataFrame, classes: DataFrame, rare: DataFrame, label: str = "label", power: float = 1.0, boost: float = 2.0) -> DataFrame:
    """Weight 1, except boosted (1 / n_c) ** power, with mean ``boost``, for rare classes."""
    score = F.pow(1.0 / F.greatest(F.col("n"), F.lit(1)), F.lit(float(power)))
    table = class_grid(train, classes, label).join(rare.select(label, F.lit(True).alias("_rare")), label, "left")
    scored = table.select(label, "n", F.when(F.col("_rare"), score).alias("_w"))
    mean = F.greatest(F.avg("_w").over(_everything()), F.lit(1e-12))
    return scored.select(label, "n", F.coalesce(F.lit(float(boost)) * F.col("_w") / mean, F.lit(1.0)).alias("weight"))


def class_priors(train: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Training counts, at least 1, and their shares."""
    n = F.greatest(F.col("n"), F.lit(1))
    return class_grid(train, classes, label).select(label, n.alias("n"), (n / F.sum(n).over(_everything())).alias("prior"))


def class_group_compat(train: DataFrame, classes: DataFrame, groups: DataFrame, label: str = "label_id", group: str = "group_id") -> DataFrame:
    """Share of each group in each class over rows that have a group; unseen classes are uniform.

    The grid has one row per (group, class) of the two dictionaries.
    """
    names = groups.agg(F.collect_set(group)).scalar()
    grid = classes.select(label, F.explode(names).alias(group))
    counts = train.where(F.col(group) >= 0).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    column = Window.partitionBy(label)
    cells = grid.join(counts, [group, label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(column)
    share = F.when(total > 0, F.col("n") / F.greatest(total, F.lit(1))).otherwise(1.0 / F.count(F.lit(1)).over(column))
    return cells.withColumn("share", share)


def compat_summary(compat: DataFrame, label: str = "label_id") -> DataFrame:
    per_class = compat.groupBy(label).agg(F.sum("n").alias("n"), F.count_if(F.col("share") > 0).alias("links"))
    return per_class.agg(
        F.sum("n").alias("valid_samples"),
        F.count_if(F.col("n") == 0).alias("missing_classes"),
        F.avg("links").alias("mean_links_per_class"),
        F.max("links").alias("max_links_per_class"),
    )


def class_array(table: DataFrame, value: str, label: str = "label_id"):
    """Values of a class table, ordered by class id, as one array to use in any projection."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(label).alias("id"), F.col(value).cast("double").alias("v"))))
    return table.agg(rows["v"]).scalar()


def compat_array(compat: DataFrame, label: str = "label_id", group: str = "group_id"):
    """Group shares per class, both ordered by id, as an array of arrays."""
    shares = F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.col("share").alias("v"))))["v"]
    per_class = compat.groupBy(label).agg(shares.alias("s"))
    return per_class.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("id"), "s")))["s"]).scalar()
