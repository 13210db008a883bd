"""Analysis queries behind the dashboard.

Results are DataFrames; drawing them is the caller's business.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropframe.schema import with_frame_stats


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def filter_crops_years(df: DataFrame, crops: list[str] | None = None, years: tuple[int, int] | None = None,
                       crop_col: str = "crop", year_col: str = "year") -> DataFrame:
    """Crop in (...) and year between (pushed down to the scan when the frame is a table)."""
    cond = F.lit(True)
    if crops:
        cond = cond & _q(crop_col).isin(*crops)
    if years:
        cond = cond & _q(year_col).between(years[0], years[1])
    return df.filter(cond)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over pairwise-complete rows; NULL for zero variance or < 2 pairs.

    Spark's ``corr`` raises DIVIDE_BY_ZERO under ANSI for constant inputs, so r
    is assembled from covar_samp / (std_x std_y) with try_divide.
    """
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))


def correlation_matrix(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """All n(n+1)/2 pairwise correlations in ONE aggregate, returned long
    (var1, var2, corr) with both triangles, like the reference's square matrix."""
    by = by or []
    pairs = list(combinations_with_replacement(columns, 2))
    aggs = [safe_corr(_q(a).cast("double"), _q(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    entries = []
    for i, (a, b) in enumerate(pairs):
        entries.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"c{i}").alias("corr")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("var1"), F.lit(a).alias("var2"), F.col(f"c{i}").alias("corr")))
    return wide.select(*by, F.inline(F.array(*entries)))


def trend_lines(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """OLS slope, intercept, r2 and n per group (NULL pairs dropped; n > 1)."""
    by = by or []
    xs, ys = _q(x).cast("double"), _q(y).cast("double")
    aggs = [F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"),
            F.regr_r2(ys, xs).alias("r2"), F.regr_count(ys, xs).alias("n")]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return out.filter(F.col("n") > 1)


def residuals(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Actual, predicted, error, pct_error."""
    return (pred.withColumn("error", _q(actual) - _q(predicted))
            .withColumn("pct_error", F.try_divide(F.col("error"), _q(actual)) * 100))


def exact_quantile(df: DataFrame, value: str, q: float = 0.5, by: list[str] | None = None, out: str = "quantile",
                   accuracy: int = 10_000) -> DataFrame:
    """The exact quantile (linear between ranks, as a median) per group, without a group in one buffer.

    A quantile sketch of bounded size, merged map-side, brackets the wanted rank: its rank
    error is at most n / accuracy, so the rank lies between the values it gives for q a
    little lower and higher. One more aggregate counts the rows below the bracket and,
    by value, the few inside it; a running sum over these finds the two neighbouring ranks.
    ``df`` is read twice, so it should be written or cheap. Null values are left out; a
    group of nulls alone is absent.
    """
    by = by or []
    x = df.where(_q(value).isNotNull()).select(*[_q(c) for c in by], _q(value).cast("double").alias("_v"))
    if not by:
        x, by = x.withColumn("_all", F.lit(0)), ["_all"]
    slack = 4.0 / accuracy  # the sketch's error, and the two ranks around the place in a group of over ``accuracy`` rows
    bracket = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.percentile_approx(
        "_v", [max(0.0, q - slack), min(1.0, q + slack)], accuracy).alias("_b"))
    y = x.join(bracket, by)
    few = F.col("_n") <= accuracy  # their values are all inside
    lo, hi = F.when(few, F.col("_lo")).otherwise(F.col("_b")[0]), F.when(few, F.col("_hi")).otherwise(F.col("_b")[1])
    place = F.when(F.col("_v") < lo, F.lit(None)).otherwise(F.col("_v"))  # all rows below are one value
    counts = (y.where(F.col("_v") <= hi).groupBy(*by, place.alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n")))
    after = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first())
                             .rowsBetween(Window.unboundedPreceding, 0))
    at = (F.col("_n") - 1) * F.lit(float(q))
    ranked = counts.withColumn("_after", after).withColumn("_at", at)
    low = F.min(F.when(F.col("_after") > F.floor("_at"), F.col("_v")))
    high = F.min(F.when(F.col("_after") > F.ceil("_at"), F.col("_v")))
    share = F.first("_at") - F.floor(F.first("_at"))
    res = ranked.groupBy(*by).agg((low + F.when(share > 0, (high - low) * share).otherwise(0.0)).alias(out))
    return res.drop("_all")


def error_summary(res: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and median of the percent error."""
    by = by or []
    mean = F.avg("pct_error").alias("mean_pct_error")
    if by:
        return res.groupBy(*by).agg(mean).join(exact_quantile(res, "pct_error", 0.5, by, "median_pct_error"), by, "left")
    median = exact_quantile(res, "pct_error", 0.5, None, "median_pct_error")
    return res.agg(mean).withColumn("median_pct_error", median.select("median_pct_error").scalar())


def error_histogram(res: DataFrame, col: str = "error", bins: int = 30, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (max falls in the last bin), count per bin.

    Bounds are one small aggregate (joined by group, or a scalar subquery); the
    binning itself is a hash aggregate. No task holds a group.
    """
    by = by or []
    if by:
        bounds = res.groupBy(*by).agg(F.min(_q(col)).alias("_lo"), F.max(_q(col)).alias("_hi"))
        res = res.join(bounds, by)
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        bounds = res.agg(F.struct(F.min(_q(col)).alias("lo"), F.max(_q(col)).alias("hi"))).scalar()
        res = with_frame_stats(res, bounds)
        lo, hi = F.col("_stats.lo"), F.col("_stats.hi")
    width = (hi - lo) / bins
    # clamp both ends: the bounds come from a separate evaluation of the input, whose
    # floating sums may differ in the last bit from this one
    raw = F.floor((_q(col) - lo) / width).cast("int")
    b = F.when(hi == lo, F.lit(0)).otherwise(F.greatest(F.least(raw, F.lit(bins - 1)), F.lit(0)))
    x = res.filter(_q(col).isNotNull()).select(*by, b.alias("bin"), lo.alias("lo"), width.alias("width"))
    return (x.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"),
                                      F.first("width").alias("width"))
            .select(*by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"), "count"))


def envelope(res: DataFrame, a: str = "actual", b: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Min / max over two columns together (axis limits)."""
    by = by or []
    aggs = [F.least(F.min(_q(a)), F.min(_q(b))).alias("lo"), F.greatest(F.max(_q(a)), F.max(_q(b))).alias("hi")]
    return res.groupBy(*by).agg(*aggs) if by else res.agg(*aggs)


def heatmap(df: DataFrame, index: str, columns: str, values: str, column_values: list | None = None) -> DataFrame:
    """Index x columns grid of mean values (explicit column list avoids a distinct pass)."""
    g = df.groupBy(index)
    g = g.pivot(columns, column_values) if column_values is not None else g.pivot(columns)
    return g.agg(F.avg(_q(values)))


def top_k(df: DataFrame, k: int, order_col: str, by: list[str] | None = None) -> DataFrame:
    """Top-k rows by ``order_col`` (desc; ties by the other columns), globally or per group (row_number)."""
    order = [_q(order_col).desc(), *[_q(c) for c in df.columns if c != order_col]]
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def yield_climate_series(crop_df: DataFrame, climate: DataFrame, crop: str, climate_var: str,
                         crop_key: str = "YEAR", climate_key: str = "year", crop_col: str = "CROP",
                         yield_col: str = "YIELD") -> DataFrame:
    """Crop filter, two-column projections, inner join on differently named keys."""
    a = crop_df.filter(_q(crop_col) == crop).select(_q(crop_key).alias("_k"), _q(yield_col).alias(yield_col))
    b = climate.select(_q(climate_key).alias("_k"), _q(climate_var).alias(climate_var))
    return a.join(b, "_k").withColumnRenamed("_k", crop_key)


def production_by_year(df: DataFrame, crop_col: str = "crop", year_col: str = "year",
                       value: str = "production") -> DataFrame:
    """Production by year and crop (dashboard series)."""
    return df.groupBy(year_col, crop_col).agg(F.sum(_q(value)).alias("total_production"))
