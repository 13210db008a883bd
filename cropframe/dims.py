"""Dimension tables: crop calendars, regions, thresholds, weights, boundaries.

All tables here are small and of fixed size (a handful of crops, states and
periods), so joins against them may be broadcast: their size does not grow
with the fact data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: these must equal the reference's constants for results to match.
# ---------------------------------------------------------------------------

CENSUS_YEARS = [1997, 2002, 2007, 2012, 2017]

CROPS = ["CORN", "SOYBEANS", "WHEAT", "COTTON", "RICE"]

# Phenology calendar: crop -> (start_month, start_day, end_month, end_day)
PHENOLOGY_SEASONS = {
    "CORN": (4, 15, 9, 30),
    "SOYBEANS": (5, 1, 10, 15),
    "WHEAT": (9, 1, 7, 15),
    "COTTON": (4, 1, 10, 31),
    "RICE": (3, 15, 9, 15),
}

# Critical periods: crop -> [(name, start_month, start_day, end_month, end_day)], in stage order
CRITICAL_PERIODS = {
    "CORN": [
        ("planting", 4, 15, 5, 31),
        ("vegetative", 6, 1, 7, 15),
        ("reproductive", 7, 16, 8, 31),
        ("maturation", 9, 1, 9, 30),
    ],
    "SOYBEANS": [
        ("planting", 5, 1, 5, 31),
        ("vegetative", 6, 1, 7, 31),
        ("reproductive", 8, 1, 9, 15),
        ("maturation", 9, 16, 10, 15),
    ],
    "WHEAT": [
        ("fall_planting", 9, 1, 10, 31),
        ("winter_dormancy", 11, 1, 2, 28),
        ("spring_growth", 3, 1, 5, 31),
        ("grain_fill", 6, 1, 7, 15),
    ],
    "COTTON": [
        ("planting", 4, 1, 5, 15),
        ("vegetative", 5, 16, 7, 15),
        ("flowering", 7, 16, 8, 31),
        ("boll_development", 9, 1, 10, 31),
    ],
    "RICE": [
        ("planting", 3, 15, 4, 30),
        ("vegetative", 5, 1, 6, 30),
        ("reproductive", 7, 1, 8, 15),
        ("maturation", 8, 16, 9, 15),
    ],
}

# Regional shift in days: crop -> region -> (start, end)
REGIONAL_SHIFTS = {
    "CORN": {"Northern": (15, -10), "Central": (0, 0), "Southern": (-15, 10)},
    "SOYBEANS": {"Northern": (10, -10), "Central": (0, 0), "Southern": (-10, 5)},
    "WHEAT": {"Northern": (0, 10), "Central": (0, 0), "Southern": (0, -10)},
    "COTTON": {"Northern": (20, -15), "Central": (10, -5), "Southern": (0, 0)},
    "RICE": {"Northern": (15, -10), "Central": (5, -5), "Southern": (0, 0)},
}

# State -> region
STATE_REGIONS = {
    "ND": "Northern", "SD": "Northern", "MN": "Northern", "WI": "Northern",
    "MI": "Northern", "MT": "Northern", "ID": "Northern", "WA": "Northern",
    "IA": "Central", "IL": "Central", "IN": "Central", "OH": "Central",
    "NE": "Central", "KS": "Central", "MO": "Central", "KY": "Central",
    "CO": "Central", "WY": "Central", "UT": "Central", "NV": "Central",
    "NY": "Central", "PA": "Central", "WV": "Central", "VA": "Central",
    "TX": "Southern", "OK": "Southern", "AR": "Southern", "LA": "Southern",
    "MS": "Southern", "AL": "Southern", "GA": "Southern", "SC": "Southern",
    "NC": "Southern", "TN": "Southern", "FL": "Southern", "CA": "Southern",
    "AZ": "Southern", "NM": "Southern",
}
DEFAULT_REGION = "Central"
DEFAULT_STATE = "IA"

# Coarse monthly calendar used by the state-month season statistics: crop -> (start_month, end_month)
MONTHLY_SEASONS = {
    "CORN": (4, 9),
    "SOYBEANS": (5, 10),
    "WHEAT": (9, 6),
    "COTTON": (4, 9),
    "RICE": (4, 9),
}

# Agricultural states
AGRICULTURAL_STATES = [
    "IL", "IA", "NE", "MN", "IN", "KS", "SD", "OH", "ND", "MO",
    "AR", "MS", "LA", "TX", "AL", "GA", "SC", "NC", "TN",
    "CA", "WA", "OR", "ID", "CO", "MT", "WY", "UT",
]

# Agricultural importance weight per state (states not listed get 0.5)
AG_STATE_WEIGHTS = {
    "IA": 1.0, "IL": 1.0, "NE": 0.9, "MN": 0.9, "IN": 0.9,
    "KS": 0.9, "ND": 0.8, "SD": 0.8, "OH": 0.8, "MO": 0.8,
    "AR": 0.8, "MS": 0.7, "LA": 0.7, "TX": 0.7, "GA": 0.7,
    "AL": 0.6, "SC": 0.6, "NC": 0.6, "TN": 0.6,
    "CA": 0.8, "WA": 0.7, "OR": 0.6, "ID": 0.7, "CO": 0.6,
    "MT": 0.7, "WY": 0.5, "UT": 0.5,
}
AG_STATE_DEFAULT_WEIGHT = 0.5

# Crop growing regions (ordered key states) and production weights
CROP_REGIONS = {
    "CORN": ["IL", "IA", "NE", "MN", "IN", "OH", "MO"],
    "SOYBEANS": ["IL", "IA", "MN", "IN", "NE", "OH", "MO"],
    "WHEAT": ["KS", "ND", "MT", "WA", "OK", "SD", "TX"],
    "COTTON": ["TX", "GA", "MS", "AR", "AL", "NC", "LA"],
    "RICE": ["AR", "CA", "LA", "MS", "TX", "MO"],
}
CROP_STATE_WEIGHTS = {
    "CORN": {"IA": 0.25, "IL": 0.20, "NE": 0.15, "MN": 0.10, "IN": 0.10, "OH": 0.10, "MO": 0.05, "OTHER": 0.05},
    "SOYBEANS": {"IL": 0.22, "IA": 0.20, "MN": 0.12, "IN": 0.10, "NE": 0.10, "OH": 0.08, "MO": 0.08, "OTHER": 0.10},
    "WHEAT": {"KS": 0.25, "ND": 0.18, "MT": 0.12, "WA": 0.10, "OK": 0.08, "SD": 0.08, "TX": 0.07, "OTHER": 0.12},
    "COTTON": {"TX": 0.40, "GA": 0.14, "MS": 0.10, "AR": 0.10, "AL": 0.08, "NC": 0.07, "LA": 0.06, "OTHER": 0.05},
    "RICE": {"AR": 0.50, "CA": 0.20, "LA": 0.15, "MS": 0.08, "TX": 0.04, "MO": 0.03},
}

# Crop climate thresholds: crop -> (ideal_temp_min, ideal_temp_max, stress_temp, frost_temp,
#                                   ideal_precip_min, ideal_precip_max)
CROP_THRESHOLDS = {
    "CORN": (18.0, 32.0, 35.0, 0.0, 500.0, 800.0),
    "SOYBEANS": (20.0, 30.0, 35.0, 0.0, 450.0, 700.0),
    "WHEAT": (15.0, 28.0, 32.0, -5.0, 350.0, 600.0),
    "COTTON": (20.0, 32.0, 38.0, 5.0, 500.0, 1000.0),
    "RICE": (20.0, 35.0, 40.0, 5.0, 1000.0, 2000.0),
}
THRESHOLD_COLUMNS = ["ideal_temp_min", "ideal_temp_max", "stress_temp", "frost_temp",
                     "ideal_precip_min", "ideal_precip_max"]

# Sample state rectangles: code, name, (lon_min, lat_min, lon_max, lat_max)
STATE_RECTANGLES = [
    ("IL", "Illinois", (-91.5, 37.0, -89.0, 42.5)),
    ("IA", "Iowa", (-96.6, 40.4, -91.0, 43.5)),
    ("NE", "Nebraska", (-104.0, 40.0, -95.3, 43.0)),
    ("MN", "Minnesota", (-97.2, 43.5, -91.4, 49.4)),
    ("IN", "Indiana", (-88.1, 37.8, -84.8, 41.8)),
]
NON_AG_STATE_RECTANGLES = [
    ("NY", "New York", (-79.8, 40.5, -73.9, 45.0)),
    ("ME", "Maine", (-71.1, 43.1, -67.0, 47.5)),
]

# Sample county rectangles: name, state, FIPS, (lon_min, lat_min, lon_max, lat_max)
COUNTY_RECTANGLES = [
    ("Champaign", "IL", "17019", (-88.4, 39.9, -87.9, 40.4)),
    ("McLean", "IL", "17113", (-89.2, 40.3, -88.6, 40.8)),
    ("Story", "IA", "19169", (-93.8, 41.8, -93.3, 42.2)),
    ("Polk", "IA", "19153", (-93.8, 41.4, -93.3, 41.8)),
    ("Lancaster", "NE", "31109", (-96.9, 40.6, -96.5, 41.0)),
    ("Douglas", "NE", "31055", (-96.4, 41.2, -95.9, 41.4)),
    ("Hennepin", "MN", "27053", (-93.6, 44.9, -93.2, 45.2)),
    ("Ramsey", "MN", "27123", (-93.2, 44.9, -92.9, 45.1)),
    ("Marion", "IN", "18097", (-86.3, 39.6, -85.9, 40.0)),
    ("Hamilton", "IN", "18057", (-86.2, 40.0, -85.8, 40.2)),
]

# Meteorological seasons by month
MONTH_SEASONS = {12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring",
                 6: "Summer", 7: "Summer", 8: "Summer", 9: "Fall", 10: "Fall", 11: "Fall"}

# Thornthwaite monthly day counts (28-day February) and latitude factor
DAYS_IN_MONTH = {1: 31, 2: 28, 3: 31, 4: 30, 5: 31, 6: 30, 7: 31, 8: 31, 9: 30, 10: 31, 11: 30, 12: 31}
THORNTHWAITE_FACTOR = {4: 1.0, 5: 1.0, 8: 1.0, 9: 1.0, 1: 1.1, 2: 1.1, 11: 1.1, 12: 1.1,
                       3: 1.2, 6: 1.2, 7: 1.2, 10: 1.2}

# ---------------------------------------------------------------------------
# DataFrame constructors (fixed-size; safe to broadcast)
# ---------------------------------------------------------------------------


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table. Inline values fold to a local relation, whose size the planner knows."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)

    columns = [c.split() for c in schema.split(", ")]
    table = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    names = ", ".join(n for n, _ in columns)
    return spark.sql("SELECT " + ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in columns)
                     + f" FROM VALUES {table} AS t({names})")


def season_calendar(spark: SparkSession) -> DataFrame:
    """crop, start_month, start_day, end_month, end_day (phenology calendar)."""
    rows = [(c, *PHENOLOGY_SEASONS[c]) for c in CROPS]
    return values(spark, rows, "crop string, start_month int, start_day int, end_month int, end_day int")


def critical_periods(spark: SparkSession) -> DataFrame:
    """crop, period_idx, period, start_month, start_day, end_month, end_day."""
    rows = [(c, i, *p) for c in CROPS for i, p in enumerate(CRITICAL_PERIODS[c])]
    return values(
        spark, rows, "crop string, period_idx int, period string, start_month int, start_day int, "
              "end_month int, end_day int")


def regional_shifts(spark: SparkSession) -> DataFrame:
    """crop, region, start_shift, end_shift."""
    rows = [(c, r, s, e) for c in CROPS for r, (s, e) in REGIONAL_SHIFTS[c].items()]
    return values(spark, rows, "crop string, region string, start_shift int, end_shift int")


def crop_state_weights(spark: SparkSession) -> DataFrame:
    """crop, state_code (or OTHER), weight."""
    rows = [(c, s, float(w)) for c in CROPS for s, w in CROP_STATE_WEIGHTS[c].items()]
    return values(spark, rows, "crop string, state_code string, weight double")


def crop_regions(spark: SparkSession) -> DataFrame:
    """crop, state_code, rank (order of the key-state list)."""
    rows = [(c, s, i) for c in CROPS for i, s in enumerate(CROP_REGIONS[c])]
    return values(spark, rows, "crop string, state_code string, rank int")


def agricultural_states(spark: SparkSession) -> DataFrame:
    """state_code, weight (importance weight, default 0.5)."""
    rows = [(s, float(AG_STATE_WEIGHTS.get(s, AG_STATE_DEFAULT_WEIGHT))) for s in AGRICULTURAL_STATES]
    return values(spark, rows, "state_code string, weight double")


RING_TYPE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def _rect_ring(b):
    x0, y0, x1, y1 = b
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def state_boundaries(spark: SparkSession, ag_states_only: bool = True) -> DataFrame:
    """state_code, state_name, ring (lon/lat vertices), lon_min, lat_min, lon_max, lat_max."""
    rects = STATE_RECTANGLES + ([] if ag_states_only else NON_AG_STATE_RECTANGLES)
    rows = [(c, n, _rect_ring(b), *b) for c, n, b in rects]
    schema = T.StructType([
        T.StructField("state_code", T.StringType()), T.StructField("state_name", T.StringType()),
        T.StructField("ring", RING_TYPE),
        T.StructField("lon_min", T.DoubleType()), T.StructField("lat_min", T.DoubleType()),
        T.StructField("lon_max", T.DoubleType()), T.StructField("lat_max", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def county_boundaries(spark: SparkSession, state_codes: list[str] | None = None) -> DataFrame:
    """county_name, state_code, county_fips, ring, bbox columns."""
    rows = [(n, s, f, _rect_ring(b), *b) for n, s, f, b in COUNTY_RECTANGLES
            if state_codes is None or s in state_codes]
    schema = T.StructType([
        T.StructField("county_name", T.StringType()), T.StructField("state_code", T.StringType()),
        T.StructField("county_fips", T.StringType()), T.StructField("ring", RING_TYPE),
        T.StructField("lon_min", T.DoubleType()), T.StructField("lat_min", T.DoubleType()),
        T.StructField("lon_max", T.DoubleType()), T.StructField("lat_max", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def census_years(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(y,) for y in CENSUS_YEARS], "census_year int")
