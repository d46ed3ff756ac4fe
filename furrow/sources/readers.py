"""Scans of observation, label and training tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.text import normalize_id, parse_date, strip, to_number
from furrow.operators.clean import drop_blank, drop_missing, keep_indices, max_cloud, min_px, require_dates
from furrow.schemas import CSV_NAMES, OBSERVATIONS, TRAINING

TEXT_COLUMNS = ("parcel_id", "tile", "idx", "label", "label_group")


def _scan(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """All columns as stored; CSV as text, so that a bad value is a missing value later on."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE") if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    return df.withColumnsRenamed({k: v for k, v in CSV_NAMES.items() if k in df.columns})


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``: the lines of a CSV file that have more or fewer values than its header; the scans read what such a line holds."""
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_line"]])
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path)
    # A scan that needs no other column doesn't parse the lines and is refused.
    parsed = F.length(F.concat_ws("", *[F.col(f"`{n}`") for n in names])) >= 0
    return rows.where(F.col("_line").isNotNull() & parsed).select(F.col("_line").alias("line"))


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; expected {', '.join(names)}")
    return df


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and coerce to the schema; text without NULL becomes NULL where it does not parse."""
    cols = []
    for field in schema.fields:
        if field.name not in df.columns:
            continue
        if isinstance(field.dataType, T.DateType):
            c = parse_date(field.name)
        elif isinstance(field.dataType, T.StringType):
            c = F.col(field.name).cast("string")
        else:
            c = to_number(field.name).try_cast(field.dataType)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def read_observations(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The seven columns of the long table; other columns are not parsed."""
    required = [f.name for f in OBSERVATIONS.fields if f.name != "tile"]
    return typed(require_columns(_scan(spark, path, fmt), required), OBSERVATIONS)


def read_labels(spark: SparkSession, path: str, id_col: str = "parcel_id", label_col: str = "label", group_col: str | None = None, fmt: str = "csv") -> DataFrame:
    """Labels with a target, in text form, with ``input_seq``: the order of rows in the input."""
    raw = _scan(spark, path, fmt)
    names = {CSV_NAMES.get(id_col, id_col): "parcel_id", CSV_NAMES.get(label_col, label_col): "label"}
    if group_col:
        names[CSV_NAMES.get(group_col, group_col)] = "label_group"
    require_columns(raw, names)
    # Row numbers grow within an input split; the split's place comes from its file and offset.
    seq = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    cols = [F.col(c).cast("string").alias(out) for c, out in names.items()]
    return raw.select(*cols, seq.alias("input_seq")).where(F.col("label").isNotNull())


def read_training(spark: SparkSession, path: str, indices: Iterable[str] | None = None, min_px_count: int = 0, max_cloud_scene: float | None = None, fmt: str = "csv") -> DataFrame:
    """The labelled long table, cleaned and filtered. The group column is optional."""
    required = [f.name for f in TRAINING.fields if f.name != "label_group"]
    rows = typed(require_columns(_scan(spark, path, fmt), required), TRAINING)
    return clean_training(rows, indices, min_px_count, max_cloud_scene)


def clean_training(rows: DataFrame, indices: Iterable[str] | None = None, min_px_count: int = 0, max_cloud_scene: float | None = None) -> DataFrame:
    """Missing cloud or pixel values are kept; missing keys, values and labels are not."""
    rows = require_dates(rows)
    rows = drop_missing(rows, ["parcel_id", "date", "idx", "value_mean", "label"])
    texts = {c: strip(c) for c in ("label", "tile", "label_group") if c in rows.columns}
    rows = rows.withColumns(texts | {"parcel_id": normalize_id("parcel_id"), "idx": F.upper(strip("idx"))})
    rows = drop_blank(rows, ["parcel_id", "idx", "label", "tile"])
    wanted = sorted({i.strip().upper() for i in indices if i.strip()}) if indices else []
    if wanted:
        rows = keep_indices(rows, wanted)
    return max_cloud(min_px(rows, min_px_count), max_cloud_scene)

