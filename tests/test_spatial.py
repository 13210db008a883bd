"""J11 point-in-polygon, A1 zonal statistics (ddof), A19 weighting."""

import math

import pytest
from pyspark.sql import functions as F

from cropframe import dims
from cropframe.operators import spatial


def _polys(spark, rows):
    schema = ("code string, ring array<struct<x:double,y:double>>, lon_min double, lat_min double, "
              "lon_max double, lat_max double")
    out = []
    for code, ring in rows:
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        out.append((code, ring, min(xs), min(ys), max(xs), max(ys)))
    return spark.createDataFrame(out, schema)


def test_point_in_rectangle_and_triangle(spark):
    polys = _polys(spark, [("R", [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]),
                           ("T", [(10.0, 10.0), (14.0, 10.0), (10.0, 14.0)])])
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, 11.0, 11.0), (4, 13.5, 13.5), (5, 10.5, 13.0)],
                                "id int, longitude double, latitude double")
    got = {r.id: r.code for r in spatial.point_in_polygon(pts, polys, polygon_cols=["code"]).collect()}
    assert got == {1: "R", 3: "T", 5: "T"}


def test_holes_and_parts_by_edge_crossing(spark):
    rings = [[(0.0, 0.0), (6.0, 0.0), (6.0, 5.0), (3.0, 7.0), (0.0, 5.0)], [(1.0, 1.0), (3.0, 1.0), (2.0, 4.0)],
             [(8.0, 1.0), (9.5, 1.5), (8.5, 3.0)]]

    def inside(x, y):
        odd = False
        for ring in rings:
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                    odd = not odd
        return odd

    polygon = spark.createDataFrame([("P", rings, 0.0, 0.0, 9.5, 7.0)],
                                    "code string, rings array<array<struct<x:double,y:double>>>, lon_min double, "
                                    "lat_min double, lon_max double, lat_max double")
    points = [(i, 0.137 + 0.31 * (i % 33), 0.071 + 0.29 * (i // 33)) for i in range(33 * 26)]
    got = spatial.point_in_polygon(spark.createDataFrame(points, "id int, longitude double, latitude double"), polygon,
                                   polygon_cols=["code"])
    want = {i for i, x, y in points if inside(x, y)}
    assert {r.id for r in got.collect()} == want and 0 < len(want) < len(points)


def test_quadtree_cover_equals_ray_casting(spark):
    rings = {"P": [[(0.0, 0.0), (6.0, 0.0), (6.0, 5.0), (3.0, 7.0), (0.0, 5.0)], [(1.0, 1.0), (3.0, 1.0), (2.0, 4.0)],
                   [(8.0, 1.0), (9.5, 1.5), (8.5, 3.0)]],
             "Q": [[(2.25, 2.25), (9.0, 2.5), (2.5, 6.75)]], "tiny": [[(7.01, 6.01), (7.02, 6.01), (7.015, 6.02)]]}
    rows = [(n, r, min(x for q in r for x, _ in q), min(y for q in r for _, y in q), max(x for q in r for x, _ in q),
             max(y for q in r for _, y in q)) for n, r in rings.items()]
    polygons = spark.createDataFrame(rows, "code string, rings array<array<struct<x:double,y:double>>>, lon_min double, "
                                           "lat_min double, lon_max double, lat_max double")
    points = [(i, 0.137 + 0.31 * (i % 33), 0.071 + 0.29 * (i // 33)) for i in range(33 * 26)]
    points += [(1000 + i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (6.0, 2.0), (3.0, 1.0), (1.0, 1.0), (7.015, 6.012),
                                                            (2.0, 2.0), (2.5, 3.0), (0.5, 0.0), (-0.001, 1.0), (5.0, 5.0)])]
    points = spark.createDataFrame([(*p, "x") for p in points], "id int, longitude double, latitude double, level string")
    want = {(r.id, r.code) for r in spatial.point_in_polygon(points, polygons, polygon_cols=["code"]).collect()}
    for levels in (1, 4, 7):
        got = spatial.points_in_cover(points, polygons, ["code"], levels=levels).collect()
        assert {(r.id, r.code) for r in got} == want and len(got) == len(want)
    cover = spatial.polygon_cover(polygons, ["code"], levels=6)
    assert cover.where("inside and level < 3").count() > 0
    inner = cover.where("inside").agg(F.sum(F.pow(F.lit(0.25), F.col("level")))).first()[0]
    assert inner > 0.8 * (36 - 3 + 0.5)  # most of the area is settled without a ring test


def test_zonal_stats_ddof_and_single_row(spark):
    pts = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 5.0), ("B", None), ("C", float("nan"))],
                                "state_code string, value double")
    from cropframe.schema import nan_to_null
    s = {r.state_code: r for r in spatial.state_stats(nan_to_null(pts)).collect()}
    assert s["A"].mean_value == 2.0 and math.isclose(s["A"].std_value, math.sqrt(2.0))
    assert s["B"].std_value is None and s["B"]["count"] == 1  # single row -> NULL std, like pandas
    assert "C" not in s  # NaN normalised to NULL and skipped
    p = {r.state_code: r for r in spatial.state_stats(nan_to_null(pts), ddof=0).collect()}
    assert p["A"].std_value == 1.0


def test_crop_region_weighted_golden(spark):
    # FIXTURES 2.1 state means of ppt 2017-01 -> CORN region mean 67.712607 over 5 states
    means = [("IA", 63.903287), ("IL", 75.000948), ("IN", 64.057741), ("MN", 67.192326), ("NE", 67.127118)]
    sv = spark.createDataFrame(means, "state_code string, mean_value double")
    out = {r.crop: r for r in spatial.crop_region_weighted(sv, dims.crop_regions(spark),
                                                           dims.crop_state_weights(spark)).collect()}
    assert out["CORN"].states_included == 5
    assert out["CORN"].climate_value == pytest.approx(67.712607, abs=1e-5)
    assert out["CORN"].primary_region == "IL, IA, NE..."
    assert "WHEAT" not in out  # no key state present -> skipped


def test_state_polygons_cover_sample_points(spark):
    pts = spark.createDataFrame([(-90.0, 40.0), (-93.0, 42.0), (-70.0, 45.0)], "longitude double, latitude double")
    got = sorted(r.state_code for r in
                 spatial.point_in_polygon(pts, dims.state_boundaries(spark, False),
                                          polygon_cols=["state_code"]).collect())
    assert got == ["IA", "IL", "ME"]


def test_agricultural_mask_default_weight(spark):
    m = spatial.agricultural_mask(dims.state_boundaries(spark, False), dims.agricultural_states(spark))
    got = {r.state_code: r.weight for r in m.collect()}
    assert got == {"IL": 1.0, "IA": 1.0, "NE": 0.9, "MN": 0.9, "IN": 0.9}
    _ = F
