"""Readers for landed files (S1-S10, S12): CSV tables, gridded point files, API JSON dumps.

All readers declare schemas (no inference pass), read a whole file set in one
scan, and take dates / variables from the file path via ``_metadata`` so the
reference's per-file Python loop disappears.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropframe.schema import CROP_CENSUS, GRID_POINTS, STATE_MONTH, nan_to_null

CENSUS_CSV = T.StructType([
    T.StructField("YEAR", T.IntegerType()), T.StructField("CROP", T.StringType()),
    T.StructField("YIELD", T.DoubleType()), T.StructField("HARVESTED_ACRES", T.LongType()),
    T.StructField("PRODUCTION", T.LongType())])


def found_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modificationTime, length) of the files that a path or glob names; no row if there is none.

    A listing: the contents are not read, their column is pruned.
    """
    try:
        return spark.read.format("binaryFile").load(pattern).select("path", "modificationTime", "length")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long")


def newest_file(spark: SparkSession, pattern: str) -> str | None:
    """The most recently modified file of a glob; ties go to the last name. None without a file."""
    row = found_files(spark, pattern).orderBy(F.col("modificationTime").desc(), F.col("path").desc()).limit(1).collect()
    return row[0]["path"] if row else None


def first_file(spark: SparkSession, *patterns: str) -> str | None:
    """The first of ``patterns``, in order, that names a file; of several files its newest."""
    return next((path for path in (newest_file(spark, p) for p in patterns) if path), None)


def census_file(spark: SparkSession, raw: str, processed: str) -> str:
    """The census file: the raw sample, else the processed table, else any processed CSV named like it."""
    path = first_file(spark, f"{raw}/sample/usda_crop_data_sample.csv", f"{processed}/usda_crop_data_processed.csv",
                      f"{processed}/*[uU][sS][dD][aA]*.csv")
    if path is None:
        raise FileNotFoundError(f"no crop census file below {raw} or {processed}")
    return path


#: The name pattern of each kind of climate table.
CLIMATE_PATTERNS = {"growing_season": "prism_growing_season", "monthly": "prism_monthly", "state_level": "prism_state"}


def climate_file(spark: SparkSession, processed: str, kind: str = "growing_season") -> str:
    """The climate table of a kind: its sample, else the newest CSV whose name holds the kind's pattern."""
    name = CLIMATE_PATTERNS.get(kind, "prism")
    path = first_file(spark, f"{processed}/prism/{name}_sample.csv", f"{processed}/prism/*{name}*.csv")
    if path is None:
        raise FileNotFoundError(f"no {kind} climate table below {processed}/prism")
    return path


def read_crop_census(spark: SparkSession, path: str) -> DataFrame:
    """Crop census CSV (YEAR, CROP, YIELD, HARVESTED_ACRES, PRODUCTION) -> lower-case model names."""
    df = spark.read.schema(CENSUS_CSV).option("header", True).csv(path)
    return nan_to_null(df.select(*[F.col(f.name).alias(g.name) for f, g in zip(CENSUS_CSV.fields, CROP_CENSUS.fields)]))


#: Columns of climate tables that are no measurements.
KEY_TYPES = {"year": T.IntegerType(), "month": T.IntegerType(), "day": T.IntegerType(), "date": T.DateType(),
             "crop": T.StringType(), "state": T.StringType(), "state_code": T.StringType(), "county_fips": T.StringType(),
             "variable": T.StringType(), "region": T.StringType(), "grid_id": T.StringType()}


def read_climate_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
                       crop: str | None = None, year: int | None = None) -> DataFrame:
    """A processed climate table with optional equality filters (pushed to the scan).

    Without a ``schema`` the header names the columns and the fixed names are keys of
    known types; every other column is a double. No pass over the data infers types.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        names = reader.csv(path).columns
        schema = T.StructType([T.StructField(c, KEY_TYPES.get(c.lower(), T.DoubleType())) for c in names])
    df = reader.schema(schema).csv(path)
    if crop is not None and "crop" in df.columns:
        df = df.filter(F.col("crop") == crop)
    if year is not None and "year" in df.columns:
        df = df.filter(F.col("year") == year)
    return nan_to_null(df)


def read_state_month(spark: SparkSession, path: str) -> DataFrame:
    """State-month sample table (year, month, state_code, variable, value)."""
    return nan_to_null(spark.read.schema(STATE_MONTH).option("header", True).csv(path))


def grid_glob(root: str, variable: str | None = None, year: int | None = None, month: int | None = None) -> str:
    """S3: file-set pruning by path pattern <root>/<variable>/<variable>_<yyyymm>_*.csv."""
    v = variable or "*"
    ym = f"{year:04d}" if year is not None else "[0-9][0-9][0-9][0-9]"
    mm = f"{month:02d}" if month is not None else "[0-9][0-9]"
    return f"{root}/{v}/{v}_{ym}{mm}*.csv"


def read_grid_points(spark: SparkSession, root: str, variable: str | None = None, year: int | None = None,
                     month: int | None = None) -> DataFrame:
    """S4 + S5: every grid-point file of the selection in ONE scan, with variable/year/month from the path.

    Date: ``(\\d{4})(\\d{2})_sample`` first, else ``(\\d{4})(\\d{2})_``; rows of files
    without a date are dropped (the reference skips such files).
    """
    df = spark.read.schema(GRID_POINTS).option("header", True).csv(grid_glob(root, variable, year, month))
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    y1, m1 = F.regexp_extract(name, r"(\d{4})(\d{2})_sample", 1), F.regexp_extract(name, r"(\d{4})(\d{2})_sample", 2)
    y2, m2 = F.regexp_extract(name, r"(\d{4})(\d{2})_", 1), F.regexp_extract(name, r"(\d{4})(\d{2})_", 2)
    yy = F.when(y1 != "", y1).otherwise(y2)
    mo = F.when(m1 != "", m1).otherwise(m2)
    out = df.select("*", F.regexp_extract(name, r"^([a-z]+)_", 1).alias("variable"),
                    yy.try_cast("int").alias("year"), mo.try_cast("int").alias("month"))
    return nan_to_null(out.filter(F.col("year").isNotNull() & F.col("month").isNotNull()))


CROP_JSON = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("year", T.StringType()), T.StructField("commodity_desc", T.StringType()),
    T.StructField("statisticcat_desc", T.StringType()), T.StructField("Value", T.StringType()),
    T.StructField("unit_desc", T.StringType())])))])


def read_crop_json(spark: SparkSession, path: str, strip_commas: bool = False) -> DataFrame:
    """``{data: [...]}`` -> YEAR, CROP, CATEGORY, VALUE, UNIT, ingest_seq (file, position).

    Missing fields -> 0 / ''; a value that is not a number ('(D)', or '1,234'
    unless ``strip_commas``) drops the row, as the reference's float() does.
    """
    raw = spark.read.schema(CROP_JSON).option("multiLine", True).json(path)
    rec = raw.select(F.col("_metadata.file_path").alias("_f"), F.posexplode("data").alias("_pos", "r"))
    val = F.col("r.Value")
    if strip_commas:
        val = F.regexp_replace(val, ",", "")
    out = rec.select(
        F.coalesce(F.col("r.year").try_cast("int"), F.lit(0)).alias("YEAR"),
        F.coalesce(F.col("r.commodity_desc"), F.lit("")).alias("CROP"),
        F.coalesce(F.col("r.statisticcat_desc"), F.lit("")).alias("CATEGORY"),
        F.coalesce(val, F.lit("0")).try_cast("double").alias("VALUE"),
        F.coalesce(F.col("r.unit_desc"), F.lit("")).alias("UNIT"),
        F.col("_f"), F.col("_pos"))
    return (out.filter(F.col("VALUE").isNotNull())
            .withColumn("ingest_seq", F.struct("_f", "_pos")).drop("_f", "_pos"))


STATION_JSON = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("station", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("attributes", T.StringType())])))])


def read_station_json(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """``{results: [...]}`` -> STATION, DATE, VARIABLE, VALUE, ATTRIBUTES."""
    raw = spark.read.schema(STATION_JSON).option("multiLine", True).json(path)
    r = raw.select(F.explode("results").alias("r"))
    return r.select(F.col("r.station").alias("STATION"), F.to_date(F.substring("r.date", 1, 10)).alias("DATE"),
                    F.lit(variable).alias("VARIABLE"), F.col("r.value").alias("VALUE"),
                    F.col("r.attributes").alias("ATTRIBUTES"))


STATION_META_JSON = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("elevation", T.DoubleType())])


def read_station_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Station attributes with defaults for missing fields."""
    raw = spark.read.schema(STATION_META_JSON).json(path)
    return raw.select(F.col("id").alias("STATION"), F.coalesce("name", F.lit("Unknown")).alias("STATION_NAME"),
                      F.coalesce("latitude", F.lit(0.0)).alias("LATITUDE"),
                      F.coalesce("longitude", F.lit(0.0)).alias("LONGITUDE"),
                      F.coalesce("elevation", F.lit(0.0)).alias("ELEVATION"))


BOUNDARY_JSON = T.StructType([
    T.StructField("code", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("fips", T.StringType()),
    T.StructField("ring", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()),
                                                    T.StructField("y", T.DoubleType())])))])


def read_boundaries(spark: SparkSession, path: str, level: str = "state") -> DataFrame:
    """S9 / S10 from a landed ring file (one JSON object per polygon): adds the bbox columns."""
    raw = spark.read.schema(BOUNDARY_JSON).json(path)
    bbox = [F.array_min("ring.x").alias("lon_min"), F.array_min("ring.y").alias("lat_min"),
            F.array_max("ring.x").alias("lon_max"), F.array_max("ring.y").alias("lat_max")]
    if level == "state":
        return raw.select(F.col("code").alias("state_code"), F.col("name").alias("state_name"), "ring", *bbox)
    return raw.select(F.col("name").alias("county_name"), F.col("code").alias("state_code"),
                      F.col("fips").alias("county_fips"), "ring", *bbox)


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Read the newest ``ds=YYYYMMDD`` partition of a dataset (listing is metadata only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    ds = sorted(n for n in names if n.startswith("ds="))
    if not ds:
        raise FileNotFoundError(f"no ds= partitions under {root}")
    return spark.read.parquet(f"{root}/{ds[-1]}").withColumn("ds", F.lit(ds[-1][3:]))
