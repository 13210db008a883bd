"""Unit-year summaries from one aggregate: day sets for spells, both unit readings of station normals.

Spells without a sort (W3, W4, A9): the flagged days of a unit's year are a set of at
most 366 bits, kept as six 64-bit words and merged by ``bit_or``, so tasks combine
their part before the shuffle and a unit-year crosses it as a dozen numbers. The longest
run is read off the merged set. Days without a row are left out of the sequence, so the
rows before and after them are neighbours, as when rows are walked in date order.

Deferred unit decision (F17, N12): whether a column holds tenths depends on its maximum
over the whole table. The aggregate carries every sum, count and set in both readings
together with the maxima; the decision is taken on its few rows. The daily table is read
once, not once for the maximum and once for each use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropframe.functions import agro
from cropframe.schema import with_frame_stats
from cropframe.session import materialize

WORDS = 6
TMIN, TMAX, PRCP = "DLY-TMIN-NORMAL", "DLY-TMAX-NORMAL", "DLY-PRCP-NORMAL"


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def day_set(flag: Column, date: Column | str) -> Column:
    """Aggregate: the days of the year on which ``flag`` holds, as an array of words."""
    day = F.dayofyear(date) - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(64)))
    word = F.floor(day / 64)
    return F.array(*[F.coalesce(F.bit_or(F.when(flag & (word == w), bit)), F.lit(0).cast("long")) for w in range(WORDS)])


def longest_run(flagged: Column, present: Column) -> Column:
    """The longest run of flagged days among the present ones; null without a flagged day."""
    def has(words: Column, day: Column) -> Column:
        return F.bit_get(F.get(words, F.floor(day / 64).cast("int")), F.pmod(day, F.lit(64))) == 1

    days = F.transform(F.sequence(F.lit(0), F.lit(64 * WORDS - 1)), lambda d: F.when(has(flagged, d), "1").when(
        has(present, d), "0").otherwise(""))
    runs = F.transform(F.split(F.array_join(days, ""), "0+"), F.length)
    return F.nullif(F.array_max(runs), F.lit(0))


def longest_runs(df: DataFrame, flags: dict[str, Column], keys: Sequence[str], date: str = "date", **more: Column) -> DataFrame:
    """``keys``, a longest run for each of ``flags``, and further aggregates ``more``.

    One row a unit and day; several rows of one day count as that one day.
    """
    g = df.groupBy(*keys).agg(day_set(F.lit(True), date).alias("_present"), *[
        day_set(flag, date).alias(f"_days_{name}") for name, flag in flags.items()], *[e.alias(n) for n, e in more.items()])
    return g.select(*keys, *more, *[longest_run(F.col(f"_days_{name}"), F.col("_present")).alias(name) for name in flags])


def heat_years(daily: DataFrame, base_temp: float = 30.0, keys: Sequence[str] = ("state_code", "year")) -> DataFrame:
    """F2 + W3 per unit-year: hot days, heat degree days, intensity, longest hot spell."""
    hot = _q("tmax") > base_temp
    return longest_runs(daily, {"max_consecutive_heat_days": hot}, keys, hot_days=F.count_if(hot),
                        heat_degree_days=F.sum(agro.heat_degree_days("tmax", base_temp)),
                        heat_stress_intensity=F.sum(agro.heat_stress_intensity("tmax", base_temp)))


def dry_years(daily: DataFrame, threshold: float = 1.0, keys: Sequence[str] = ("state_code", "year")) -> DataFrame:
    """W4 per unit-year: dry days and the longest dry spell."""
    dry = _q("ppt") < threshold
    return longest_runs(daily, {"max_consecutive_dry_days": dry}, keys, dry_days=F.count_if(dry))


def station_years(normals: DataFrame, base: float = 10.0, cap: float = 30.0, frost: float = 0.0, wet: float = 1.0,
                  dry: float = 1.0, season_months: Sequence[int] = (4, 5, 6, 7, 8, 9)) -> DataFrame:
    """One row per station and year in the decided units, from one read of the daily normals.

    STATION, YEAR, n_days, n_seasons, gdd_total, gdd_days, GROWING_SEASON_PRCP (raw, as the
    reference sums it), WET_DAYS_COUNT, MAX_CONSECUTIVE_DRY_DAYS, and the frost
    dates spring_frost, any_frost, fall_frost around Jul 1. Written once (its rows are
    read for the decision and for each use).
    """
    year, month = F.year("DATE"), F.month("DATE")
    readings = {"raw": 1.0, "tenths": 10.0}
    spring = F.col("DATE") < F.make_date(year, F.lit(7), F.lit(1))
    season = F.floor(F.pmod(month, F.lit(12)) / 3).cast("int")  # Dec-Feb, Mar-May, ...
    aggs = [F.count(F.lit(1)).alias("n_days"), F.sum(F.when(month.isin(*season_months), _q(PRCP))).alias("GROWING_SEASON_PRCP"),
            F.max(TMIN).alias("top_tmin"), F.max(TMAX).alias("top_tmax"), F.max(PRCP).alias("top_prcp"),
            F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), season))).alias("n_seasons"),
            day_set(F.lit(True), "DATE").alias("present")]
    for a, da in readings.items():
        tmin, prcp = _q(TMIN) / da, _q(PRCP) / da
        cold = tmin <= frost
        aggs += [F.max(F.when(cold & spring, F.col("DATE"))).alias(f"spring_{a}"), F.min(F.when(cold, F.col("DATE"))).alias(f"any_{a}"),
                 F.min(F.when(cold & ~spring, F.col("DATE"))).alias(f"fall_{a}"), F.count_if(prcp > wet).alias(f"wet_{a}"),
                 day_set(prcp <= dry, "DATE").alias(f"dry_{a}")]
        for b, db in readings.items():
            gdd = agro.daily_gdd(tmin, _q(TMAX) / db, base, cap)
            aggs += [F.sum(gdd).alias(f"gdd_{a}_{b}"), F.count(gdd).alias(f"gdd_days_{a}_{b}")]
    x = materialize(normals.groupBy("STATION", year.alias("YEAR")).agg(*aggs), "station-years")
    top = x.agg(F.struct(*[F.max(f"top_{c}").alias(c) for c in ("tmin", "tmax", "prcp")]).alias("s")).scalar()
    x = with_frame_stats(x, top, "_top")
    tenths = {"tmin": F.col("_top")["tmin"] > 100, "tmax": F.col("_top")["tmax"] > 100, "prcp": F.col("_top")["prcp"] > 1000}

    def pick(name: str, column: str) -> Column:
        return F.when(tenths[column], F.col(f"{name}_tenths")).otherwise(F.col(f"{name}_raw"))

    def pick_gdd(name: str) -> Column:
        by_max = {a: F.when(tenths["tmax"], F.col(f"{name}_{a}_tenths")).otherwise(F.col(f"{name}_{a}_raw")) for a in readings}
        return F.when(tenths["tmin"], by_max["tenths"]).otherwise(by_max["raw"])

    return x.select("STATION", "YEAR", "n_days", F.col("n_seasons").cast("long").alias("n_seasons"),
                    pick_gdd("gdd").alias("gdd_total"), pick_gdd("gdd_days").alias("gdd_days"), "GROWING_SEASON_PRCP",
                    pick("wet", "prcp").alias("WET_DAYS_COUNT"),
                    longest_run(pick("dry", "prcp"), F.col("present")).alias("MAX_CONSECUTIVE_DRY_DAYS"),
                    pick("spring", "tmin").alias("spring_frost"), pick("any", "tmin").alias("any_frost"),
                    pick("fall", "tmin").alias("fall_frost"))


def frost_free(years: DataFrame) -> DataFrame:
    """W6 from station-years: frosts around Jul 1 of each station's first year, and the days between."""
    out = years.groupBy("STATION").agg(
        F.min_by("spring_frost", "YEAR").alias("LAST_SPRING_FROST"), F.min_by("fall_frost", "YEAR").alias("_fall"),
        F.min("YEAR").alias("_first"), F.collect_list(F.struct("YEAR", "any_frost")).alias("_y"))
    # the cut lies in the first year: a later year's first frost is behind it
    later = F.array_min(F.transform(F.filter("_y", lambda r: r["YEAR"] > F.col("_first")), lambda r: r["any_frost"]))
    out = out.select("STATION", "LAST_SPRING_FROST", F.coalesce("_fall", later).alias("FIRST_FALL_FROST"))
    return out.withColumn("FROST_FREE_DAYS", F.datediff("FIRST_FALL_FROST", "LAST_SPRING_FROST"))


def crop_years(crop: DataFrame, years: DataFrame) -> DataFrame:
    """J5 + A16-A18: crop rows with the year's mean GDD, national season precipitation and mean frost-free days."""
    by_year = years.groupBy("YEAR").agg(F.try_divide(F.sum("gdd_total"), F.sum("gdd_days")).alias("AVG_GDD"),
                                        F.avg("GROWING_SEASON_PRCP").alias("GROWING_SEASON_PRCP"))
    return crop.join(by_year, "YEAR", "left").withColumn(
        "AVG_FROST_FREE_DAYS", frost_free(years).agg(F.avg("FROST_FREE_DAYS")).scalar())
