"""Integration: crop x climate joins, standardisation, category pivots, lagged yields.

(J1-J6, J10, A16-A18, A22-A24, W2, F16, U1)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropframe.schema import complete_columns, feature_columns, numeric_columns, require, with_frame_stats


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _year_lower(df: DataFrame) -> DataFrame:
    if "year" not in df.columns and "YEAR" in df.columns:
        return df.withColumn("year", F.col("YEAR"))
    return df


def merge_crop_climate(crop: DataFrame, climate: DataFrame, level: str = "national") -> DataFrame:
    """Join crop data with climate at national, state or county grain (inner).

    National: the climate is first averaged over states per year (a real
    pre-aggregation: one row per year), then joined on year.
    """
    crop, climate = _year_lower(crop), _year_lower(climate)
    if level == "national":
        if "state_code" in climate.columns:
            cols = [c for c in climate.columns if c not in ("year", "state_code", "crop", "YEAR")
                    and c in numeric_columns(climate)]
            climate = climate.groupBy("year").agg(*[F.avg(_q(c)).alias(c) for c in cols])
        return crop.join(climate.drop("YEAR") if "YEAR" in crop.columns else climate, "year")
    if level == "state":
        if "state_code" not in crop.columns and "STATE_CODE" in crop.columns:
            crop = crop.withColumn("state_code", F.col("STATE_CODE"))
        return crop.join(climate, ["year", "state_code"])
    if level == "county":
        if "county_fips" not in crop.columns and "COUNTY_FIPS" in crop.columns:
            crop = crop.withColumn("county_fips", F.col("COUNTY_FIPS"))
        return crop.join(climate, ["year", "county_fips"])
    raise ValueError(f"unsupported merge level {level!r}")


def crop_specific_merge(crop: DataFrame, climate: DataFrame, level: str = "national",
                        crop_col: str = "crop") -> DataFrame:
    """The reference loops over crops (filter both sides, merge, concat); here the
    crop simply joins the key when the climate side carries it: one join, no loop."""
    crop, climate = _year_lower(crop), _year_lower(climate)
    if crop_col not in climate.columns:
        return merge_crop_climate(crop, climate, level)
    keys = {"national": ["year"], "state": ["year", "state_code"], "county": ["year", "county_fips"]}[level]
    if level == "national" and "state_code" in climate.columns:
        cols = [c for c in numeric_columns(climate) if c not in ("year", "YEAR")]
        climate = climate.groupBy("year", crop_col).agg(*[F.avg(_q(c)).alias(c) for c in cols])
    return crop.join(climate, keys + [crop_col])


def season_with_census(season_stats: DataFrame, census: DataFrame) -> DataFrame:
    """Per census row, that year's season statistics for that crop averaged over states.

    Pre-aggregate to (year, crop) (a handful of rows per crop-year) then inner join.
    """
    stat_cols = [c for c in season_stats.columns if c not in ("state_code", "year", "crop")]
    national = season_stats.groupBy("year", "crop").agg(*[F.avg(_q(c)).alias(c) for c in stat_cols])
    return census.join(national, ["year", "crop"])


def station_crop_features(crop: DataFrame, gdd: DataFrame, frost: DataFrame,
                          season_prcp: DataFrame) -> DataFrame:
    """J5 + A16-A18: crop rows + annual mean GDD + national season precip (left joins on YEAR)
    + national average frost-free days (mean of station means; a scalar subquery)."""
    annual_gdd = gdd.groupBy("YEAR").agg(F.avg("GDD").alias("AVG_GDD"))
    national_prcp = season_prcp.groupBy("YEAR").agg(F.avg("GROWING_SEASON_PRCP").alias("GROWING_SEASON_PRCP"))
    frost_avg = (frost.groupBy("STATION").agg(F.avg("FROST_FREE_DAYS").alias("_m"))
                 .agg(F.avg("_m")).scalar())
    return (crop.join(annual_gdd, "YEAR", "left").join(national_prcp, "YEAR", "left")
            .withColumn("AVG_FROST_FREE_DAYS", frost_avg))


def attach_station_metadata(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of station attributes."""
    return df.join(metadata, "STATION", "left")


def standardize(df: DataFrame, cols: list[str] | None = None, exclude: tuple[str, ...] = ("year", "yield"),
                suffix: str = "_std") -> DataFrame:
    """Z-score with global mean / sample std, only for columns with std > 0.

    One global aggregate (a single partial-aggregated row) consumed as scalar
    subqueries, so no cross join and no global window. The target in any
    spelling and identifiers are excluded (the reference leaks YIELD_std, D9).
    """
    ex = {e.lower() for e in exclude}
    cols = cols or [c for c in numeric_columns(df) if c.lower() not in ex
                    and not c.lower().startswith("year") and not c.lower().endswith(suffix)]
    if not cols:
        return df
    # one struct-valued scalar subquery: Spark evaluates it once and reuses it for every column
    stats = df.agg(F.struct(*[x for i, c in enumerate(cols) for x in (
        F.avg(_q(c)).alias(f"m{i}"), F.stddev_samp(_q(c)).alias(f"s{i}"))]).alias("s")).scalar()
    s = F.col("_stats")
    return (with_frame_stats(df, stats)
            .select(*[_q(c) for c in df.columns],
                    *[F.when(s[f"s{i}"] > 0, (_q(c) - s[f"m{i}"]) / s[f"s{i}"]).alias(f"{c}{suffix}")
                      for i, c in enumerate(cols)]))


def crop_category_pivot(long_df: DataFrame, seq_col: str = "ingest_seq",
                        require_complete: bool = True) -> DataFrame:
    """A23 + P9: YIELD / AREA HARVESTED / PRODUCTION by substring of CATEGORY; last row wins.

    ``max_by(VALUE, seq)`` picks the last ingested row per (YEAR, CROP, category)
    in one aggregate; complete records keep all three.
    """
    cat = F.upper(F.col("CATEGORY"))
    kind = (F.when(cat.contains("YIELD"), "YIELD").when(cat.contains("AREA HARVESTED"), "HARVESTED_ACRES")
            .when(cat.contains("PRODUCTION"), "PRODUCTION"))
    x = long_df.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    out = x.groupBy("YEAR", "CROP").agg(
        F.max_by(F.when(F.col("_kind") == "YIELD", F.col("VALUE")),
                 F.when(F.col("_kind") == "YIELD", F.col(seq_col))).alias("YIELD"),
        F.max_by(F.when(F.col("_kind") == "HARVESTED_ACRES", F.col("VALUE")),
                 F.when(F.col("_kind") == "HARVESTED_ACRES", F.col(seq_col))).alias("HARVESTED_ACRES"),
        F.max_by(F.when(F.col("_kind") == "PRODUCTION", F.col("VALUE")),
                 F.when(F.col("_kind") == "PRODUCTION", F.col(seq_col))).alias("PRODUCTION"))
    if require_complete:
        out = out.dropna(subset=["YIELD", "HARVESTED_ACRES", "PRODUCTION"])
    return out


def station_variable_pivot(obs: DataFrame, variables: list[str] | None = None, index: tuple[str, ...] = ("STATION", "DATE"),
                           rename: dict[str, str] | None = None) -> DataFrame:
    """Long station readings -> the mean of every variable present, one row per ``index``.

    With listed ``variables`` one column each. Without a list the variables stay open: a
    column ``VALUES`` maps each variable's column name to its mean, so no distinct
    list is collected to plan the query and a new variable needs no new column.
    """
    def name(v: str) -> str:
        return (rename or {}).get(v, f"DLY-{v}-NORMAL")

    if variables is not None:
        wide = obs.groupBy(*index).pivot("VARIABLE", variables).agg(F.avg("VALUE"))
        for v in variables:
            wide = wide.withColumnRenamed(v, name(v))
        return wide
    label = F.concat(F.lit("DLY-"), F.col("VARIABLE"), F.lit("-NORMAL"))
    for v, to in (rename or {}).items():
        label = F.when(F.col("VARIABLE") == v, F.lit(to)).otherwise(label)
    means = obs.where(F.col("VARIABLE").isNotNull()).groupBy(*index, label.alias("_v")).agg(F.avg("VALUE").alias("_mean"))
    return means.groupBy(*index).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_v", "_mean")))).alias("VALUES"))


def lagged_yield(df: DataFrame, crop_col: str = "CROP", year_col: str = "YEAR",
                 yield_col: str = "YIELD", by: tuple[str, ...] = ()) -> DataFrame:
    """Previous yield, change and percent change per crop (order by year).

    ``by`` names further keys of a row (state, county): a unit's history of a crop
    is one row per census year, so the window partition is tiny at any grain.
    """
    w = Window.partitionBy(crop_col, *by).orderBy(year_col)
    prev = F.lag(_q(yield_col)).over(w)
    return (df.withColumn("PREV_YIELD", prev)
            .withColumn("YIELD_CHANGE", _q(yield_col) - F.col("PREV_YIELD"))
            .withColumn("YIELD_CHANGE_PCT", F.try_divide(F.col("YIELD_CHANGE"), F.col("PREV_YIELD")) * 100))


def engineer_yield_features(df: DataFrame) -> DataFrame:
    """W2 + F16 interaction + A22 z-scores with the _NORM suffix."""
    out = lagged_yield(df)
    if "AVG_GDD" in out.columns and "GROWING_SEASON_PRCP" in out.columns:
        out = out.withColumn("GDD_PRCP_INTERACTION", F.col("AVG_GDD") * F.col("GROWING_SEASON_PRCP"))
    feats = [c for c in ("AVG_GDD", "GROWING_SEASON_PRCP", "GDD_PRCP_INTERACTION") if c in out.columns]
    if not feats:
        return out
    stats = out.agg(F.struct(*[x for c in feats for x in (
        F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).alias("s")).scalar()
    s = F.col("_stats")
    return (with_frame_stats(out, stats)
            .select(*[_q(c) for c in out.columns],
                    *[F.try_divide(F.col(c) - s[f"m_{c}"], s[f"s_{c}"]).alias(f"{c}_NORM") for c in feats]))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concat with missing columns filled by NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dummies(df: DataFrame, categorical: dict[str, list | None], drop_first: bool = True, out: str = "dummies") -> DataFrame:
    """0/1 columns ``<col>_<level>`` for columns with listed levels, a sparse map for open ones.

    An open column (None) adds ``<col>_<level>`` -> 1 of the row's own level to the map
    column ``out``; levels not in it are 0. Its first level, by order, has no
    entry (``drop_first``): that is one aggregated value, so no list of levels is
    collected, however many there are. A null has no entry.
    """
    wide, entries = [], []
    for c, levels in categorical.items():
        if levels is not None:
            wide += [F.when(_q(c) == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(f"{c}_{v}")
                     for v in (sorted(levels)[1:] if drop_first else sorted(levels))]
            continue
        entry = F.struct(F.concat(F.lit(f"{c}_"), _q(c).cast("string")).alias("k"), F.lit(1).alias("v"))
        kept = _q(c).isNotNull()
        if drop_first:
            kept = kept & (_q(c) != df.agg(F.min(_q(c))).scalar())
        entries.append(F.when(kept, entry))
    if entries:
        wide.append(F.map_from_entries(F.array_compact(F.array(*entries))).alias(out))
    return df.select("*", *wide)


def modeling_ready(df: DataFrame, target: str = "yield", categorical: dict[str, list | None] | None = None,
                   ids: tuple[str, ...] = ("year", "state_code", "crop"), drop_first: bool = True,
                   prefer_standardized: bool = False) -> DataFrame:
    """P14 + P10 + P11 + P12 + M3 / U2 (+ M1 pooled): the modelling-ready table.

    Required columns are checked (a typed error, no silent empty frame); year is
    cast to int; numeric features are selected without the target or identifiers
    (``prefer_standardized``: only the _std columns, if there are any); every column
    holding a NULL is dropped (observed while the frame is written); categorical
    columns become dummies (see ``dummies``; by default an open map of states).
    M1's pooled frame of all crops is this table with the crop among ``categorical``.
    """
    require(df, *ids, target)
    x = df.withColumn("year", _q("year").cast("int")) if "year" in df.columns else df
    feats = feature_columns(x, target, prefer_standardized)
    x, complete = complete_columns(x.select(*[_q(c) for c in ids], _q(target), *[_q(c) for c in feats]))
    x = x.select(*[_q(c) for c in complete])
    chosen = {"state_code": None} if categorical is None else categorical
    return dummies(x, {c: levels for c, levels in chosen.items() if c in complete}, drop_first)
