"""Agro-climate column expressions.

Every function returns a ``Column`` built from native Spark expressions, so
they stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropframe import dims


def _c(x) -> Column:
    return F.col(f"`{x}`") if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def pos(x: Column) -> Column:
    """max(0, x) with NULL staying NULL (Python's max(0, NaN) pattern is handled at ingest, N2)."""
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(x, F.lit(0.0)))


def daily_gdd(tmin, tmax, base: float = 10.0, cap: float = 30.0) -> Column:
    """max(0, (min(tmax, cap) + max(tmin, base)) / 2 - base)."""
    return pos((F.least(_c(tmax), F.lit(cap)) + F.greatest(_c(tmin), F.lit(base))) / 2 - base)


def gdd_simple(t, base: float = 10.0, cap: float | None = None) -> Column:
    """max(0, t - base), optionally capping t at ``cap`` first."""
    t = _c(t)
    if cap is not None:
        t = F.least(t, F.lit(cap))
    return pos(t - base)


def heat_degree_days(tmax, base: float = 30.0) -> Column:
    """max(0, tmax - base); a missing reading counts 0."""
    return F.coalesce(pos(_c(tmax) - base), F.lit(0.0))


def flag(cond: Column) -> Column:
    """Boolean condition as 0/1 integer (NULL input -> 0, like pandas comparisons)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def heat_stress_intensity(tmax, base: float = 30.0) -> Column:
    """excess over the base on extreme-heat days, else 0."""
    t = _c(tmax)
    return F.when(t > base, t - base).otherwise(F.lit(0.0))


def standardized(x, mean, std) -> Column:
    """(x - mean) / std; NULL when std is 0 or missing."""
    return F.when(_c(std) != 0, F.try_divide(_c(x) - _c(mean), _c(std)))


def aridity_index(p, t) -> Column:
    """p / (|t| + 0.1)."""
    return _c(p) / (F.abs(_c(t)) + F.lit(0.1))


def solar_declination(doy) -> Column:
    """0.409 sin(2 pi J / 365 - 1.39)."""
    return F.lit(0.409) * F.sin(F.lit(2 * math.pi) * _c(doy) / 365 - F.lit(1.39))


def extraterrestrial_radiation(doy, latitude_deg) -> Column:
    """extraterrestrial radiation Ra (MJ m-2 day-1) from day of year and latitude."""
    lat = F.radians(_c(latitude_deg))
    decl = solar_declination(doy)
    ws = F.acos(-F.tan(lat) * F.tan(decl))
    dr = F.lit(1.0) + F.lit(0.033) * F.cos(F.lit(2 * math.pi) * _c(doy) / 365)
    return (F.lit(24 * 60 / math.pi * 0.082) * dr
            * (F.cos(lat) * F.cos(decl) * F.sin(ws) + ws * F.sin(lat) * F.sin(decl)))


def hargreaves_pet(tmean, temp_range, ra) -> Column:
    """0.0023 (T + 17.8) sqrt(TR) Ra 0.408; a negative range gives NULL, not NaN."""
    tr = _c(temp_range)
    return (F.lit(0.0023) * (_c(tmean) + F.lit(17.8))
            * F.when(tr >= 0, F.sqrt(tr)) * _c(ra) * F.lit(0.408))


def thornthwaite_i(t) -> Column:
    """F8 heat-index term max(0, (T/5)^1.514); non-positive T contributes 0."""
    t = _c(t)
    return F.when(t > 0, F.pow(t / 5, F.lit(1.514))).otherwise(F.lit(0.0))


def _month_map(values: dict) -> Column:
    pairs = []
    for k, v in sorted(values.items()):
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def thornthwaite_pet(t, heat_index, month) -> Column:
    """F8: 16 (10T/I)^a x days(month) x factor(month); 0 when I <= 0 or T <= 0."""
    t, i, m = _c(t), _c(heat_index), _c(month)
    a = F.lit(0.49) + F.lit(0.01792) * i - F.lit(0.0000771) * i * i
    days = F.element_at(_month_map({k: float(v) for k, v in dims.DAYS_IN_MONTH.items()}), m)
    factor = F.element_at(_month_map(dims.THORNTHWAITE_FACTOR), m)
    return F.when((i > 0) & (t > 0), F.lit(16.0) * F.pow(10 * t / i, a) * days * factor).otherwise(F.lit(0.0))


def season_label(month, upper: bool = False) -> Column:
    """meteorological season of a month (Winter/Spring/Summer/Fall, or upper case)."""
    m = _c(month)
    expr = (F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring")
            .when(m.isin(6, 7, 8), "Summer").when(m.isin(9, 10, 11), "Fall"))
    return F.upper(expr) if upper else expr


def column_max(df: DataFrame, col: str) -> Column:
    """Scalar subquery max(col) over the whole frame: one partial aggregate, no join."""
    return df.agg(F.max(_c(col))).scalar()


def tenths_rescaled(df: DataFrame, col: str, threshold: float) -> Column:
    """Divide by 10 when the column's global max exceeds ``threshold``.

    The decision is per column and per frame, as in the reference; the global
    max is a scalar subquery, so there is no cross join and no single-task window.
    """
    return F.when(column_max(df, col) > threshold, _c(col) / 10.0).otherwise(_c(col).cast("double"))


def with_tenths(df: DataFrame, thresholds: dict[str, float], name: str = "_tenths") -> tuple[DataFrame, dict]:
    """F17 / N12 for several columns at once: ``({col: rescaled column}, frame)``.

    All column maxima come from one aggregate attached once as a struct column
    ``name`` (drop it when done), so the input is scanned once for the decisions
    however many columns are checked.
    """
    cols = list(thresholds)
    mx = df.agg(F.struct(*[F.max(_c(c)).alias(f"c{i}") for i, c in enumerate(cols)])).scalar()
    out = df.select("*", mx.alias(name))
    exprs = {c: F.when(F.col(name)[f"c{i}"] > thresholds[c], _c(c) / 10.0).otherwise(_c(c).cast("double"))
             for i, c in enumerate(cols)}
    return out, exprs


def temperature_interaction(t, kind: str, thresholds: dict) -> Column:
    """temperature deviation against crop thresholds; kind in mean/max/min."""
    t = _c(t)
    if kind == "max":
        return pos(t - thresholds["stress_temp"])
    if kind == "min":
        return pos(_c(thresholds["frost_temp"]) - t)
    return pos(_c(thresholds["ideal_temp_min"]) - t) + pos(t - thresholds["ideal_temp_max"])


def precipitation_interactions(p, thresholds: dict) -> dict[str, Column]:
    """ideal deviation, drought risk and excess risk for a season precipitation total."""
    p = _c(p)
    lo, hi = thresholds["ideal_precip_min"], thresholds["ideal_precip_max"]
    return {
        "ideal_deviation": pos(_c(lo) - p) + pos(p - hi),
        "drought_risk": F.when(p > 0, pos(_c(lo) - p) / lo).otherwise(F.lit(1.0)),
        "excess_risk": F.when(_c(hi) > 0, F.try_divide(pos(p - hi), _c(hi))).otherwise(F.lit(0.0)),
    }


def thresholds_for(crop: str | None) -> dict:
    """a crop's thresholds; None -> mean over crops; unknown crop -> CORN."""
    names = dims.THRESHOLD_COLUMNS
    if crop is None:
        vals = [sum(dims.CROP_THRESHOLDS[c][i] for c in dims.CROPS) / len(dims.CROPS) for i in range(len(names))]
    else:
        vals = dims.CROP_THRESHOLDS.get(crop, dims.CROP_THRESHOLDS["CORN"])
    return dict(zip(names, vals))
