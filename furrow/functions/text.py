"""Identifier, text, date and feature-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(_col(c).cast("string"), F.lit(BLANKS))


def normalize_id(c: Column | str) -> Column:
    """Identifier as text, trimmed, without a trailing ``.0``."""
    return F.regexp_replace(strip(c), r"\.0+$", "")


def normalize_text(c: Column | str, upper: bool = False) -> Column:
    return F.upper(strip(c)) if upper else strip(c)


def to_number(c: Column | str) -> Column:
    """Number, or NULL where the text is no number (NaN counts as missing too)."""
    number = _col(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_date(c: Column | str) -> Column:
    return _col(c).try_cast("date")


def mode_text(c: Column | str) -> Column:
    """Aggregate: most frequent non-blank text, smallest on ties, '' if there is none."""
    text = strip(c)
    return F.coalesce(F.mode(F.when(text != "", text), True), F.lit(""))


def feature_name(idx: Column | str, suffix: Column | str) -> Column:
    return F.concat_ws("__", _col(idx), _col(suffix).cast("string"))


def split_feature(c: Column | str) -> Column:
    """``idx__suffix`` as a struct, split at the first separator."""
    parts = F.split(_col(c), "__", 2)
    return F.struct(parts[0].alias("idx"), F.try_element_at(parts, F.lit(2)).alias("suffix"))


def doy(c: Column | str) -> Column:
    return F.dayofyear(_col(c))
