"""Column layouts shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import types as T

OBSERVATIONS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("tile", T.StringType()),
    T.StructField("parcel_id", T.StringType()),
    T.StructField("idx", T.StringType()),
    T.StructField("value_mean", T.DoubleType()),
    T.StructField("px_count", T.IntegerType()),
    T.StructField("cloud_scene", T.DoubleType()),
])

LABELS = T.StructType([
    T.StructField("parcel_id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("label_group", T.StringType()),
])

TRAINING = T.StructType([
    *OBSERVATIONS.fields,
    T.StructField("label", T.StringType()),
    T.StructField("label_group", T.StringType()),
])

PREPARED = T.StructType([
    T.StructField("parcel_id", T.StringType()),
    T.StructField("features", T.ArrayType(T.ArrayType(T.FloatType()))),
    T.StructField("doy", T.ArrayType(T.ShortType())),
    T.StructField("observed", T.ArrayType(T.BooleanType())),
    T.StructField("cloud", T.ArrayType(T.FloatType())),
    T.StructField("px", T.ArrayType(T.FloatType())),
    T.StructField("label_id", T.IntegerType()),
    T.StructField("group_id", T.IntegerType()),
    T.StructField("tile", T.StringType()),
    T.StructField("split", T.StringType()),
])

# Header names of the exchanged CSV files.
CSV_NAMES = {
    "ID_PARCEL": "parcel_id",
    "index": "idx",
    "CODE_CULTU": "label",
    "CODE_GROUP": "label_group",
}
