"""Spatial operators: zonal statistics, point-in-polygon, regional weighting.

Point-in-polygon is a theta join. To keep it a hash join at any size, each
polygon's bounding box is exploded over the integer lon/lat cells it covers
(a small table of integers: polygons are states or counties), every point gets
its cell, and the two meet on the cell key with a broadcast hash join; the
candidates then meet their polygon's ring (held once, not per cell) and only
they run the exact ray-casting test, written with native higher-order
functions (no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropframe import dims
from cropframe.session import materialize


def zonal_stats(points: DataFrame, keys: list[str], value: str = "value", ddof: int = 1,
                with_count: bool = True) -> DataFrame:
    """A1/A2/A3: mean, min, max, std (ddof 1 = sample, 0 = population) and count per zone.

    A plain hash aggregate: Spark combines partially on the map side, so a zone
    holding a third of all points costs no more than any other.
    """
    v = F.col(value)
    std = F.stddev_samp(v) if ddof == 1 else F.stddev_pop(v)
    aggs = [F.avg(v).alias("mean_value"), F.min(v).alias("min_value"),
            F.max(v).alias("max_value"), std.alias("std_value")]
    if with_count:
        aggs.append(F.count(v).alias("count"))
    return points.filter(F.col(value).isNotNull()).groupBy(*keys).agg(*aggs)


def state_month_stats(points: DataFrame, ddof: int = 1) -> DataFrame:
    """A3: one aggregate over all files: state, year, month, variable -> mean/min/max/std/count."""
    return zonal_stats(points, ["state_code", "year", "month", "variable"], ddof=ddof)


def _inside_ring(ring: Column, lon: Column, lat: Column) -> Column:
    """Half-open ray casting over the ring edges (pixel centre rule)."""
    n = F.size(ring)

    def step(acc, i):
        a = F.element_at(ring, i + 1)
        b = F.element_at(ring, ((i + 1) % n) + 1)
        crosses = (a["y"] > lat) != (b["y"] > lat)
        x_at = (b["x"] - a["x"]) * F.try_divide(lat - a["y"], b["y"] - a["y"]) + a["x"]
        return acc + F.when(crosses & (lon < x_at), F.lit(1)).otherwise(F.lit(0))

    hits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)
    return (hits % 2) == 1


def _inside(polygons: DataFrame, lon: Column, lat: Column) -> Column:
    """Even-odd rule over all rings of a polygon: parts add up, holes cancel."""
    if "rings" not in polygons.columns:
        return _inside_ring(F.col("ring"), lon, lat)
    inside = F.transform("rings", lambda r: F.when(_inside_ring(r, lon, lat), F.lit(1)).otherwise(F.lit(0)))
    return F.aggregate(inside, F.lit(0), lambda acc, x: acc + x) % 2 == 1


def polygon_cells(polygons: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Explode each polygon over the integer cells its bbox touches (small, fixed-size)."""
    cx = F.explode(F.sequence(F.floor(F.col("lon_min") / cell_deg).cast("int"),
                              F.floor(F.col("lon_max") / cell_deg).cast("int")))
    cy = F.sequence(F.floor(F.col("lat_min") / cell_deg).cast("int"),
                    F.floor(F.col("lat_max") / cell_deg).cast("int"))
    return (polygons.select("*", cx.alias("_cx"))
            .select("*", F.explode(cy).alias("_cy")))


def point_in_polygon(points: DataFrame, polygons: DataFrame, lon: str = "longitude", lat: str = "latitude",
                     polygon_cols: list[str] | None = None, cell_deg: float = 1.0) -> DataFrame:
    """Attach the attributes of the polygon containing each point (inner join).

    ``polygons`` must carry ``ring``, or ``rings`` (outer rings and holes of all
    parts), and the bbox columns (``lon_min`` ...).
    Two joins: (1) on the cell key against the distinct (polygon attributes,
    cell) pairs; (2) on the attributes against the polygons, each ring held once.
    The planner broadcasts a polygon side that its statistics show to be small
    and shuffles it otherwise (AQE splits a hot cell or polygon).
    """
    polygon_cols = polygon_cols or [c for c in polygons.columns
                                    if c not in ("ring", "rings", "lon_min", "lat_min", "lon_max", "lat_max")]
    cells = polygon_cells(polygons, cell_deg).select(*polygon_cols, "_cx", "_cy").distinct()
    shape = "rings" if "rings" in polygons.columns else "ring"
    rings = polygons.select(*polygon_cols, shape, "lon_min", "lat_min", "lon_max", "lat_max")
    pts = points.select("*", F.floor(F.col(lon) / cell_deg).cast("int").alias("_px"),
                        F.floor(F.col(lat) / cell_deg).cast("int").alias("_py"))
    dup = [c for c in polygon_cols if c in points.columns]
    for c in dup:
        pts = pts.withColumnRenamed(c, f"_pt_{c}")
    cand = (pts.join(cells, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")))
            .drop("_px", "_py", "_cx", "_cy"))
    j = cand.join(rings, polygon_cols)
    j = j.filter(F.col(lon).between(F.col("lon_min"), F.col("lon_max"))
                 & F.col(lat).between(F.col("lat_min"), F.col("lat_max"))
                 & _inside(polygons, F.col(lon), F.col(lat)))
    keep = [c for c in pts.columns if c not in ("_px", "_py")] + polygon_cols
    return j.select(*keep)


def _all_edges(polygons: DataFrame) -> Column:
    """Every edge of every ring as (x0, y0, x1, y1)."""
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    return F.flatten(F.transform(rings, lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.struct(
        F.get(r, i)["x"].alias("x0"), F.get(r, i)["y"].alias("y0"), F.get(r, (i + 1) % F.size(r))["x"].alias("x1"),
        F.get(r, (i + 1) % F.size(r))["y"].alias("y1")))))


def _touches(e: Column, x: Column, y: Column, size: float) -> Column:
    """An edge meets the closed cell whose lower corner is (x, y): the parts of the edge within both slabs overlap."""
    def slab(a: Column, b: Column, lo: Column) -> tuple[Column, Column]:
        t0, t1 = F.try_divide(lo - a, b - a), F.try_divide(lo + size - a, b - a)
        flat_in = (a >= lo) & (a <= lo + size)
        enter = F.when(a == b, F.when(flat_in, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(t0, t1))
        leave = F.when(a == b, F.when(flat_in, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(t0, t1))
        return enter, leave

    ex, lx = slab(e["x0"], e["x1"], x)
    ey, ly = slab(e["y0"], e["y1"], y)
    return F.greatest(ex, ey, F.lit(0.0)) <= F.least(lx, ly, F.lit(1.0)) + 1e-12


def polygon_cover(polygons: DataFrame, ids: list[str], cell_deg: float = 1.0, levels: int = 6) -> DataFrame:
    """Quadtree cover of polygons: ``ids``, level, cx, cy, inside.

    Cells of ``cell_deg`` over the bounding box are split in four where an edge meets
    them, down to ``cell_deg`` / 2^(levels - 1): small cells follow the edges, large ones
    fill the inner part. A cell that no edge meets is inside or outside as a whole
    (its centre decides) and is kept only if inside; the smallest cells on an edge
    are kept with ``inside`` false. Cells grow with the edges' length, not the area.
    """
    shape = "rings" if "rings" in polygons.columns else "ring"
    cells = polygon_cells(polygons.select(*ids, shape, "lon_min", "lat_min", "lon_max", "lat_max"), cell_deg)
    cells = cells.select(*ids, shape, F.col("_cx").cast("long").alias("cx"), F.col("_cy").cast("long").alias("cy"),
                         _all_edges(polygons).alias("_edges"))
    out = None
    for level in range(levels):
        size = cell_deg / 2 ** level
        x, y = F.col("cx") * size, F.col("cy") * size
        # an edge that misses a cell misses its children
        cells = cells.withColumn("_edges", F.filter("_edges", lambda e: _touches(e, x, y, size)))
        cells = cells.withColumn("_cut", F.size("_edges") > 0)
        centre = _inside(polygons, x + size / 2, y + size / 2)
        whole = cells.where(~F.col("_cut")).where(centre).select(*ids, F.lit(level).alias("level"), "cx", "cy", F.lit(True).alias("inside"))
        out = whole if out is None else out.unionByName(whole)
        cut = cells.where("_cut")
        if level == levels - 1:
            return out.unionByName(cut.select(*ids, F.lit(level).alias("level"), "cx", "cy", F.lit(False).alias("inside")))
        quarter = F.explode(F.array(*[F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy"))
                                      for i in (0, 1) for j in (0, 1)]))
        cells = cut.withColumn("_q", quarter).select(*ids, shape, "_q.cx", "_q.cy", "_edges")
    raise ValueError("a cover needs at least one level")


def points_in_cover(points: DataFrame, polygons: DataFrame, ids: list[str], lon: str = "longitude", lat: str = "latitude",
                    cell_deg: float = 1.0, levels: int = 6) -> DataFrame:
    """J11 by a quadtree cover: points with the ``ids`` of every polygon that holds them.

    A point looks up its cell of each size (``levels`` keys). Cells marked inside settle
    it; only points in the smallest cells on an edge meet the rings and run the ray
    test, with the same half-open rule as ``point_in_polygon``. The cover is written once
    (it is as long as the edges) and joined by the planner's choice.
    """
    cover = materialize(polygon_cover(polygons, ids, cell_deg, levels), "polygon-cover")
    shape = "rings" if "rings" in polygons.columns else "ring"
    keys = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col(lon) / (cell_deg / 2 ** k)).alias("cx"),
                              F.floor(F.col(lat) / (cell_deg / 2 ** k)).alias("cy")) for k in range(levels)])
    clash = [c for c in points.columns if c in (*ids, "level", "cx", "cy", "inside", "_key", shape)]
    rows = points.drop(*clash)
    found = (rows.withColumn("_key", F.explode(keys)).select(*rows.columns, "_key.*").join(cover, ["level", "cx", "cy"])
             .drop("level", "cx", "cy"))
    rings = polygons.select(*ids, shape).withColumn("inside", F.lit(False))  # inner points carry no ring
    j = found.join(rings, [*ids, "inside"], "left")
    settled = F.when(F.col("inside"), F.lit(True)).otherwise(_inside(polygons, F.col(lon), F.col(lat)))
    return j.where(settled).select(*rows.columns, *ids)


def state_stats_by_polygon(points: DataFrame, states: DataFrame, ddof: int = 1,
                           state_code: str | None = None) -> DataFrame:
    """A1 (raster branch): assign points to states by J11, then zonal statistics."""
    inside = point_in_polygon(points, states, polygon_cols=["state_code"])
    if state_code:
        inside = inside.filter(F.col("state_code") == state_code)
    return zonal_stats(inside, ["state_code"], ddof=ddof)


def state_stats(points: DataFrame, state_code: str | None = None, ddof: int = 1,
                keys: list[str] | None = None) -> DataFrame:
    """A1 (sample branch): points already carry ``state_code``."""
    if state_code:
        points = points.filter(F.col("state_code") == state_code)
    return zonal_stats(points, keys or ["state_code"], ddof=ddof)


def county_stats_by_polygon(points: DataFrame, counties: DataFrame, ddof: int = 1) -> DataFrame:
    """A2: county zonal statistics with name and FIPS."""
    inside = point_in_polygon(points, counties, polygon_cols=["county_name", "state_code", "county_fips"])
    return zonal_stats(inside, ["state_code", "county_name", "county_fips"], ddof=ddof)


def crop_region_weighted(state_values: DataFrame, crop_regions: DataFrame, crop_weights: DataFrame,
                         value: str = "mean_value", crop: str | None = None) -> DataFrame:
    """Per crop, weighted mean of the key states present; weight defaults to OTHER, else 0.

    ``state_values`` has one row per state (state_code, value). Returns crop,
    climate_value (NULL when the weights sum to 0), states_included and
    primary_region (first three key states + '...').
    """
    regions = crop_regions if crop is None else crop_regions.filter(F.col("crop") == crop)
    other = (crop_weights.filter(F.col("state_code") == "OTHER")
             .select("crop", F.col("weight").alias("_other")))
    w = crop_weights.filter(F.col("state_code") != "OTHER")
    label = (regions.groupBy("crop")
             .agg(F.sort_array(F.collect_list(F.struct("rank", "state_code"))).alias("_ordered"))
             .select("crop", F.concat(F.array_join(F.slice(F.col("_ordered.state_code"), 1, 3), ", "),
                                      F.lit("...")).alias("primary_region")))
    sv = state_values.select("state_code", F.col(value).alias("_v"))
    j = (sv.join(F.broadcast(regions.select("crop", "state_code")), "state_code")
         .join(F.broadcast(w), ["crop", "state_code"], "left")
         .join(F.broadcast(other), "crop", "left"))
    wt = F.coalesce(F.col("weight"), F.col("_other"), F.lit(0.0))
    agg = j.groupBy("crop").agg(F.sum(F.col("_v") * wt).alias("_ws"), F.sum(wt).alias("_w"),
                                F.count(F.lit(1)).alias("states_included"))
    return (agg.join(F.broadcast(label), "crop")
            .select("crop", F.when(F.col("_w") > 0, F.col("_ws") / F.col("_w")).alias("climate_value"),
                    "states_included", "primary_region"))


def agricultural_mask(state_boundaries: DataFrame, ag_states: DataFrame) -> DataFrame:
    """Agricultural states with their importance weight (default 0.5)."""
    return (state_boundaries.join(F.broadcast(ag_states), "state_code", "left_semi")
            .join(F.broadcast(ag_states), "state_code", "left")
            .withColumn("weight", F.coalesce(F.col("weight"), F.lit(dims.AG_STATE_DEFAULT_WEIGHT))))


def agricultural_filter(df: DataFrame, state_col: str = "state_code") -> DataFrame:
    """Keep rows of the agricultural states."""
    return df.filter(F.col(state_col).isin(*dims.AGRICULTURAL_STATES))


def cropland_filter(points: DataFrame, cropland: DataFrame, key: str = "grid_id") -> DataFrame:
    """Keep points on cropland (semi join on the grid key; no columns added)."""
    return points.join(cropland.select(key), key, "left_semi")
