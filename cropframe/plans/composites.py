"""Composite chains (X1-X5, M16): one lazy plan per chain, no per-key Python loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe import dims
from cropframe.operators import features as FE
from cropframe.operators import integrate, modeling, spatial, temporal
from cropframe.session import materialize
from cropframe.sources import sinks


def climate_features_for_modeling(daily: DataFrame, crop: str | None = None,
                                  keys: tuple[str, ...] = ("state_code", "year")) -> DataFrame:
    """F2/W3 -> F4/W4/A20 -> F5/W5/A31 -> F7 (daily chain); with a crop, season and
    critical-period statistics of the weather and of the derived columns per state-year
    (A13/A14/A35), and crop interactions (F11/F12).
    """
    out = FE.heat_stress_features(daily)
    out = FE.drought_features(out)
    out = FE.frost_risk_features(out)
    out = FE.water_balance_features(out)
    if not crop:
        return out
    stats = temporal.season_statistics(out.drop("date"), crop, keys=list(keys))
    return FE.climate_crop_interactions(stats, crop)


def census_batch(state_month: DataFrame, census_years: list[int] | None = None) -> DataFrame:
    """Season statistics for the census years only (one job, ``isin`` filter)."""
    years = census_years or dims.CENSUS_YEARS
    return temporal.season_stats_monthly(state_month).filter(F.col("year").isin(*years))


def integrate_and_write(census: DataFrame, climate: DataFrame, root: str, level: str = "state",
                        ds: str | None = None) -> str:
    """Crop-aware join (J4), z-scores (A22), one partitioned write per crop."""
    merged = materialize(integrate.crop_specific_merge(census, climate, level), "integrated")  # read for statistics and rows
    return sinks.write_dataset(integrate.standardize(merged), root, "integrated", ("crop",), ds)
