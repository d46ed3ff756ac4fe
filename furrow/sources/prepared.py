"""Save and load of the prepared per-parcel arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.config import MISSING_GROUP


@dataclass
class Prepared:
    """Array rows (one per parcel) and the small tables that describe their positions."""

    rows: DataFrame
    features: list[str]
    dates: list
    labels: DataFrame
    groups: DataFrame


def save_prepared(prepared: Prepared, path: str) -> None:
    spark = prepared.rows.sparkSession
    prepared.rows.write.mode("overwrite").parquet(f"{path}/rows")
    names = [("feature", i, f) for i, f in enumerate(prepared.features)]
    names += [("date", i, str(d)) for i, d in enumerate(prepared.dates)]
    axes = spark.createDataFrame(names, "axis string, pos int, name string")
    classes = prepared.labels.select(F.lit("label").alias("axis"), F.col("label_id").cast("int").alias("pos"), F.col("label").alias("name"))
    groups = prepared.groups.select(F.lit("group").alias("axis"), F.col("group_id").cast("int").alias("pos"), F.col("label_group").alias("name"))
    axes.unionByName(classes).unionByName(groups).coalesce(1).write.mode("overwrite").parquet(f"{path}/axes")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Columns an older table may lack: full cloud, no pixels, no group."""

    def flat(value: float, name: str):
        return F.transform("observed", lambda _: F.lit(value).cast("float")).alias(name)

    have = set(rows.columns)
    if "cloud" not in have:
        rows = rows.withColumn("cloud", flat(100.0, "cloud"))
    if "px" not in have:
        rows = rows.withColumn("px", flat(0.0, "px"))
    if "group_id" not in have:
        rows = rows.withColumn("group_id", F.lit(MISSING_GROUP))
    return rows


def load_prepared(spark: SparkSession, path: str) -> Prepared:
    axes = spark.read.parquet(f"{path}/axes")

    def names(axis: str) -> list[str]:
        return [r["name"] for r in axes.where(F.col("axis") == axis).orderBy("pos").collect()]

    def table(axis: str, id_col: str, name_col: str) -> DataFrame:
        return axes.where(F.col("axis") == axis).select(F.col("pos").alias(id_col), F.col("name").alias(name_col))

    groups = table("group", "group_id", "label_group")
    rows = with_defaults(spark.read.parquet(f"{path}/rows"))
    if groups.limit(1).count() == 0:
        rows = rows.withColumn("group_id", F.lit(MISSING_GROUP))
    dates = [r[0] for r in axes.where("axis = 'date'").orderBy("pos").select(F.to_date("name")).collect()]
    return Prepared(rows, names("feature"), dates, table("label", "label_id", "label"), groups)
