"""Points with a polygon table, against the formula on every edge."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geosift.operators import polygon as P
from geosift.operators import spatial as S
from geosift.operators.extract import nodes_inside


def plain(points, rings):
    """(id, poly_id): the even-odd rule on every edge, in the operand order of the formula."""
    out = set()
    ids, xs, ys = np.array([p[0] for p in points]), np.array([p[1] for p in points]), np.array([p[2] for p in points])
    for poly, ring in rings:
        n, on = np.zeros(len(ids), int), np.zeros(len(ids), bool)
        edges = P.Polygon("include", tuple(ring)).edges
        for e in edges:
            r, (x0, y0, x1, y1) = e.a * xs + e.b * ys + e.c, e.box
            on |= (r == 0) & (xs >= x0) & (xs <= x1) & (ys >= y0) & (ys <= y1)
            n += (y0 <= ys) & (ys < y1) & ((-r if e.a > 0 else r) > 0)
        if not edges:
            on = (xs == ring[0][0]) & (ys == ring[0][1])
        out |= {(int(i), poly) for i in ids[on | (n % 2 == 1)]}
    return out


def polygons(spark, rings):
    return spark.createDataFrame([(i, "include", [(float(x), float(y)) for x, y in r]) for i, r in rings], "poly_id int, kind string, ring array<struct<x:double,y:double>>").repartition(3)


def rings_of(rng):
    rings = []
    for i in range(60):
        cx, cy, size = rng.randint(0, 100), rng.randint(0, 60), rng.choice([0.5, 3, 10, 80])
        rings.append((i, [(cx + rng.randint(-4, 4) * size / 4, cy + rng.randint(-4, 4) * size / 4) for _ in range(rng.choice([1, 2, 3, 4, 9]))]))
    star = [(50 + (20 + 10 * (k % 2)) * math.cos(math.pi * k / 150), 30 + (20 + 10 * (k % 2)) * math.sin(math.pi * k / 150)) for k in range(300)]
    return [*rings, (60, star), (61, star[::-1]), (62, [(0, 0), (100, 0), (100, 60), (0, 60)]), (63, [(7, 7)] * 3)]


@pytest.mark.parametrize("depth, leaf, chunk", [(14, 20, 64), (2, 1, 2)])
def test_pairs_equal_the_formula(spark, monkeypatch, depth, leaf, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = random.Random(depth)
    rings = rings_of(rng)
    at = [(rng.randint(-5, 110), rng.randint(-5, 66)) for _ in range(600)] + [(rng.uniform(0, 100), rng.uniform(0, 60)) for _ in range(1500)]
    at += [p for _, r in rings for p in r][:400]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(at)]
    frame = spark.createDataFrame([*points, (-1, None, 1.0), (-2, float("nan"), 1.0), (-3, 1.0, None)], "id long, x double, y double").repartition(4)
    tree = S.quadtree(S.ring_edges(polygons(spark, rings)), depth, leaf)
    got = [tuple(r) for r in S.contains(frame, tree).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(points, rings)
    if depth == 14:
        edges = F.size(F.filter("items", lambda e: e["t"].isNull()))
        assert tree.leaves.where("level < 14").groupBy("level", "z").agg(F.sum(edges).alias("n")).agg(F.max("n")).first()[0] <= leaf


@pytest.mark.parametrize("sizes", [{}, {"WHOLE": 2, "PIECE": 1, "CHUNK": 2, "ACROSS": 1e9}, {"WHOLE": 2, "PIECE": 1, "CROWD": 4, "ACROSS": 6}])
def test_pieces_equal_the_formula(spark, monkeypatch, sizes):
    """Whole polygons, strips, chunks of strips, and polygons that the tree takes: the same pairs in one join."""
    for name, value in sizes.items():
        monkeypatch.setattr(S, name, value)
    rng = random.Random(8)
    rings = rings_of(rng)
    at = [(rng.randint(-5, 110), rng.randint(-5, 66)) for _ in range(500)] + [(rng.uniform(0, 100), rng.uniform(0, 60)) for _ in range(800)]
    at += [p for _, r in rings for p in r][:300]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(at)]
    frame = spark.createDataFrame([*points, (-1, None, 1.0), (-2, float("nan"), 1.0), (-3, 1.0, None)], "id long, x double, y double").repartition(4)
    got = [tuple(r) for r in S.holding(frame, S.ring_edges(polygons(spark, rings))).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(points, rings)


def test_long_ring_is_dealt_over_leaves(spark):
    n = 20_000
    k = F.col("id")
    angle = k * (2 * math.pi / n)
    radius = 40 + (k % 3)
    vertices = spark.range(n).select(F.lit(0).alias("poly_id"), k.alias("pos"), (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))
    tree = S.quadtree(S.chain_edges(vertices), depth=16)
    edges = F.size(F.filter("items", lambda e: e["t"].isNull()))
    most = tree.leaves.groupBy("level", "z").agg(F.sum(edges).alias("n"), F.sum(F.size("items")).alias("all")).agg(F.max("n"), F.max("all")).first()
    assert most[0] <= S.LEAF and most[1] <= 4 * S.LEAF
    rng = random.Random(3)
    rows = [(i, rng.uniform(-45, 45), rng.uniform(-45, 45)) for i in range(3000)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    inside = {r.id for r in S.contains(points, tree).collect()}
    sure = {i for i, x, y in rows if math.hypot(x, y) < 39.9}
    never = {i for i, x, y in rows if math.hypot(x, y) > 42.1}
    assert sure <= inside and not inside & never


def test_areas_and_extracts(spark):
    rng = random.Random(8)
    rows = [(i, float(rng.randint(0, 50)), float(rng.randint(0, 90))) for i in range(2000)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    area = [P.include((5, 5), (45, 5), (45, 90), (5, 90)), P.include((0, 0), (20, 0), (20, 20)), P.exclude((15, 20), (35, 20), (35, 60), (15, 60))]
    want = {r.id for r in P.inside(points, area).select("id").collect()}
    table = P.polygons_df(spark, area)
    assert {r.id for r in S.inside_areas(points, table).collect()} == want
    assert {r.id for r in nodes_inside(points, table).collect()} == want
    assert {r.id for r in S.inside_areas(points, table.withColumn("poly_id", F.lit(1))).collect()} == want


def test_no_polygons_and_bad_ones(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0)], "id long, x double, y double")
    none = polygons(spark, [(1, [(0, 0)])]).where("poly_id < 0")
    assert S.inside_areas(points, none).collect() == []
    assert S.inside_areas(points, spark.createDataFrame([(1, "include", [])], none.schema)).collect() == []
    with pytest.raises(ValueError, match="include or exclude"):
        S.inside_areas(points, polygons(spark, [(1, [(0, 0)])]).withColumn("kind", F.lit("other")))
    with pytest.raises(Exception, match="finite"):
        S.inside_areas(points, polygons(spark, [(1, [(0, 0), (float("inf"), 1), (2, 2)])])).collect()
