"""Schemas, ingest hygiene and schema-level helpers.

Everything here inspects ``df.schema`` on the driver (metadata only) or adds
column expressions; nothing collects data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropframe.session import materialize

CROP_CENSUS = T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("crop", T.StringType()),
    T.StructField("yield", T.DoubleType()),
    T.StructField("harvested_acres", T.LongType()),
    T.StructField("production", T.LongType()),
])

GRID_POINTS = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("state_code", T.StringType()),
    T.StructField("grid_id", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("value", T.DoubleType()),
])

STATE_MONTH = T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("state_code", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

STATION_NORMALS = T.StructType([
    T.StructField("STATION", T.StringType()),
    T.StructField("STATION_NAME", T.StringType()),
    T.StructField("ELEVATION", T.DoubleType()),
    T.StructField("LATITUDE", T.DoubleType()),
    T.StructField("LONGITUDE", T.DoubleType()),
    T.StructField("DATE", T.DateType()),
    T.StructField("DLY-TMIN-NORMAL", T.IntegerType()),
    T.StructField("DLY-TMAX-NORMAL", T.IntegerType()),
    T.StructField("DLY-PRCP-NORMAL", T.IntegerType()),
])

CLIMATE_DAILY = T.StructType([
    T.StructField("state_code", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("tmean", T.DoubleType()),
    T.StructField("tmin", T.DoubleType()),
    T.StructField("tmax", T.DoubleType()),
    T.StructField("ppt", T.DoubleType()),
])

_FRACTIONAL = (T.DoubleType, T.FloatType)
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class MissingColumnsError(ValueError):
    """Raised when an operator's required columns are absent."""


def require(df: DataFrame, *cols: str) -> None:
    """Fail loudly instead of returning a silent empty frame."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing required columns {missing}; have {df.columns}")


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """NaN poisons Spark aggregates while pandas skips it, so map NaN to NULL at ingest."""
    targets = set(cols) if cols is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, _FRACTIONAL)}
    return df.select(*[
        F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")).alias(c) if c in targets else F.col(f"`{c}`")
        for c in df.columns])


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = {e.lower() for e in exclude}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUMERIC) and f.name.lower() not in ex]


def find_column(df: DataFrame, *needles: str) -> str | None:
    """First column (schema order) whose lower-cased name contains any needle."""
    for c in df.columns:
        low = c.lower()
        if any(n in low for n in needles):
            return c
    return None


def add_lowercase_aliases(df: DataFrame) -> DataFrame:
    """Add lower-case copies of upper-case columns, keeping the originals."""
    extra = [F.col(f"`{c}`").alias(c.lower()) for c in df.columns
             if c != c.lower() and c.lower() not in df.columns]
    return df.select("*", *extra)


def feature_columns(df: DataFrame, target: str = "yield",
                    prefer_standardized: bool = True) -> list[str]:
    """Numeric features minus target, its aliases and identifier columns.

    Excludes every spelling of the target, including its standardised copy,
    which the reference leaks into the features (D9).
    """
    tgt = target.lower()
    banned_prefix = ("year", "state")
    cols = []
    for c in numeric_columns(df):
        low = c.lower()
        if low in (tgt, f"{tgt}_std", f"{tgt}_norm") or low.startswith(banned_prefix):
            continue
        if low in ("census_year",):
            continue
        cols.append(c)
    if prefer_standardized:
        std = [c for c in cols if c.endswith("_std")]
        if std:
            return std
    return cols


def drop_null_columns(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Drop every column holding at least one NULL (one aggregate pass)."""
    cols = list(cols) if cols is not None else df.columns
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if counts[c] > 0])


def complete_columns(df: DataFrame, cols: Iterable[str] | None = None) -> tuple[DataFrame, list[str]]:
    """P12 while the frame is written: (the frame read back, its columns without a NULL).

    The null counts are observed during the one write, not by a second pass over the
    input; the frame that comes back reads only the columns asked of it.
    """
    cols = list(cols) if cols is not None else df.columns
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    back = materialize(counted, "observed")
    found = seen.get
    return back, [c for i, c in enumerate(cols) if not found[f"n{i}"]]


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every fractional column (used at the end of compared queries)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _FRACTIONAL):
            c = F.round(c, digits)
        out.append(c.alias(f.name))
    return df.select(*out)


def with_frame_stats(df: DataFrame, stats: Column, name: str = "_stats") -> DataFrame:
    """Attach a one-row aggregate of ``df`` (a struct scalar subquery) as one column.

    Referencing the fields of a scalar subquery directly in many expressions
    plans one subquery per reference; projecting it once and reading the fields
    from the column evaluates the aggregate once. The caller drops ``name``.
    """
    return df.select("*", stats.alias(name))
