"""Point-in-polygon: known probes, reversed and rotated rings, and grid against expression."""

import random

import pytest
from pyspark.sql import functions as F

from geosift.operators import polygon as P

SQUARE = ((0, 0), (10, 0), (10, 10), (0, 10))
TRIANGLE = ((0, 0), (10, 0), (10, 10))
BOW = ((-5, 0), (5, 0), (-5, 10), (5, 10))
THIN = ((0, 0), (5, 0), (10, 5))
# Rings and the points that must lie in and outside them.
PROBES = [
    (SQUARE, [(5, 5), (0, 0), (10, 5)], [(-5, 0), (15, 5), (5, -5), (5, 15)]),
    (TRIANGLE, [(0, 0), (5, 5), (3, 3)], [(0, 10), (3, 7)]),
    (BOW, [(0, 0), (0, 5), (1, 3)], [(1, 5), (10, 7)]),
    (THIN, [(0, 0), (5, 0), (10, 5), (9.8, 4.9), (9.85, 4.9), (9.9, 4.9), (0.3, 0.1), (5, 0.01), (4.7, 0.01)],
     [(10, 10), (0, 10), (9, 0), (9.75, 4.9), (9.95, 4.9), (10, 4.9), (10, 0), (15, 5), (0.3, 0.4), (5.1, 0.01)]),
]


def inside(spark, pts, polygons):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    return {r.id for r in df.where(P.pip_expr(F.col("x"), F.col("y"), polygons)).collect()}


@pytest.mark.parametrize("ring, within, without", PROBES)
def test_probes_and_reversed_ring(spark, ring, within, without):
    pts = within + without
    for r in (ring, ring[::-1], ring[1:] + ring[:1]):
        assert inside(spark, pts, [P.include(*r)]) == set(range(len(within)))


def test_exclude_hole_and_its_boundary(spark):
    polygons = [P.include(*SQUARE), P.exclude((3, 3), (7, 3), (7, 7), (3, 7))]
    assert inside(spark, [(1, 1), (5, 5), (3, 5), (8, 8), (20, 5)], polygons) == {0, 3}


def test_prolonged_edge_is_outside_and_flat_edges_are_dropped(spark):
    assert inside(spark, [(1, 0), (6, 0)], [P.include((5, 0), (10, 0), (0, 5))]) == {1}
    assert len(P.include((0, 0), (0, 0), (5, 5), (5, 0)).edges) == 3
    with pytest.raises(ValueError):
        P.include()


def test_null_points_and_no_include_ring(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 1.0, 1.0)], "id long, x double, y double")
    assert [r.id for r in P.inside(df, [P.include(*SQUARE)]).collect()] == [2]
    assert P.inside(df, [P.exclude(*SQUARE)]).count() == 0
    assert P.inside(df.limit(0), [P.include(*SQUARE)]).count() == 0


def test_grid_and_join_equal_the_expression(spark):
    rng = random.Random(3)
    ring = tuple((rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(40))
    polygons = [P.include(*ring), P.include((120, 0), (150, 0), (150, 50)), P.exclude((30, 30), (60, 35), (40, 70))]
    pts = [(rng.uniform(-10, 160), rng.uniform(-10, 110)) for _ in range(3000)] + list(ring)
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    want = inside(spark, pts, polygons)
    assert {r.id for r in P.grid_join(df, polygons).collect()} == want
    assert {r.id for r in P.ring_tests(df, P.edge_table(P.polygons_df(spark, polygons))).collect()} == want


def test_box_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).select("id", F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y")).write.parquet(path)
    plan = P.inside(spark.read.parquet(path), [P.include(*SQUARE)])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(x,0.0)" in plan


def test_edge_table_equals_objects(spark):
    polygons = [P.include(*THIN), P.exclude(*BOW)]
    rows = P.edge_table(P.polygons_df(spark, polygons)).collect()
    want = {(i, e.x1, e.y1, e.x2, e.y2, e.a, e.b, e.c) for i, p in enumerate(polygons) for e in p.edges}
    assert {(r.poly_id, r.x1, r.y1, r.x2, r.y2, r.a, r.b, r.c) for r in rows} == want
    assert P.polygons_of(P.polygons_df(spark, polygons)) == polygons


def test_grid_of_many_edges_and_rings(spark):
    """10,000 edges in a few seconds; many rings in one expression; the same points as the plain test."""
    import math
    import time

    star = P.include(*[((3 + math.sin(40 * t)) * math.cos(t), (3 + math.sin(40 * t)) * math.sin(t)) for t in (2 * math.pi * k / 10_000 for k in range(10_000))])
    holes = [P.exclude((k / 10, -0.3), (k / 10 + 0.05, -0.3), (k / 10, 0.3)) for k in range(-20, 20)]
    began = time.time()
    cells = P.grid_cells([star, *holes])
    assert time.time() - began < 10 and {c for *_, c in cells} == {"in", "out", "mixed"}
    small_star = P.Polygon("include", star.ring[::50])
    points = spark.range(6000).selectExpr("id", "cast((id % 97) / 12.0 - 4 as double) x", "cast((id % 83) / 10.0 - 4 as double) y").withColumns({"cx": P.F.lit(1), "rings": P.F.lit(2)})
    rings = [small_star, *holes[:6]]
    got = {r.id for r in P.grid_join(points, rings).collect()}
    want = {r.id for r in points.where(P.pip_expr(P.F.col("x"), P.F.col("y"), rings)).collect()}
    assert got == want and want
