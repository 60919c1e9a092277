"""Point-in-polygon: even-odd rule with the boundary inside, over include and exclude rings.

Rings are small and live on the driver as Polygon objects; points are DataFrames. Up to UNROLL edges the
predicate is one generated expression with constant coefficients (codegen, no join) behind its bounding
box, which reaches the Parquet scan as a filter. Beyond that, grid_join classifies the cells of a grid as in, out or
mixed and joins points by cell; only points in mixed cells are tested, against the edges of their cell's row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geosift.schema import POLYGON
from geosift.staging import small, unused

UNROLL = 200
LEVEL = 7  # the grid has 2**LEVEL cells to a side


@dataclass(frozen=True)
class Edge:
    """a x + b y + c = 0 between two points."""

    x1: float
    y1: float
    x2: float
    y2: float
    a: float = field(init=False)
    b: float = field(init=False)
    c: float = field(init=False)

    def __post_init__(self) -> None:
        a, b = self.y2 - self.y1, self.x1 - self.x2
        object.__setattr__(self, "a", a)
        object.__setattr__(self, "b", b)
        object.__setattr__(self, "c", -(a * self.x1 + b * self.y1))

    @property
    def box(self) -> tuple[float, float, float, float]:
        return min(self.x1, self.x2), min(self.y1, self.y2), max(self.x1, self.x2), max(self.y1, self.y2)


@dataclass(frozen=True)
class Polygon:
    kind: str  # include or exclude
    ring: tuple[tuple[float, float], ...]

    def __post_init__(self) -> None:
        if self.kind not in ("include", "exclude"):
            raise ValueError(f"kind {self.kind!r}: include or exclude")
        if not self.ring:
            raise ValueError("an empty ring")
        object.__setattr__(self, "ring", tuple((float(x), float(y)) for x, y in self.ring))

    @cached_property
    def edges(self) -> list[Edge]:
        """Consecutive pairs of the closed ring; edges without length are dropped."""
        ring = self.ring if self.ring[0] == self.ring[-1] else (self.ring[-1], *self.ring)
        return [Edge(*p, *q) for p, q in zip(ring, ring[1:], strict=False) if p != q]

    @cached_property
    def box(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*self.ring, strict=True)
        return min(xs), min(ys), max(xs), max(ys)


def include(*points: tuple[float, float]) -> Polygon:
    return Polygon("include", points)


def exclude(*points: tuple[float, float]) -> Polygon:
    return Polygon("exclude", points)


def polygons_df(spark: SparkSession, polygons: Sequence[Polygon]) -> DataFrame:
    return spark.createDataFrame([(i, p.kind, list(p.ring)) for i, p in enumerate(polygons)], POLYGON)


def polygons_of(df: DataFrame) -> list[Polygon]:
    """A polygon table as objects, by poly_id. Polygon files are small; this is where they come to the driver."""
    return [Polygon(r["kind"], tuple((p["x"], p["y"]) for p in r["ring"])) for r in df.orderBy("poly_id").collect()]


def close_ring(ring: Column) -> Column:
    """The ring with its last point in front, unless it is closed already."""
    last = F.element_at(ring, -1)
    return F.when(F.get(ring, 0) == last, ring).otherwise(F.concat(F.array(last), ring))


def edge_table(polygons: DataFrame) -> DataFrame:
    """POLYGON -> poly_id, kind, edge_no, x1, y1, x2, y2, xmin, ymin, xmax, ymax, a, b, c; zero-length edges dropped."""
    closed = polygons.select("poly_id", "kind", close_ring(F.col("ring")).alias("r"))
    pair = F.arrays_zip(F.slice("r", 1, F.size("r") - 1).alias("p"), F.slice("r", 2, F.size("r") - 1).alias("q"))
    rows = closed.where(F.size("r") > 1).select("poly_id", "kind", F.posexplode(pair).alias("edge_no", "e"))
    rows = rows.select("poly_id", "kind", "edge_no", *[F.col(f"e.{p}.{c}").alias(f"{c}{i}") for p, i in (("p", 1), ("q", 2)) for c in "xy"])
    rows = rows.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    rows = rows.select("*", F.least("x1", "x2").alias("xmin"), F.least("y1", "y2").alias("ymin"), F.greatest("x1", "x2").alias("xmax"),
                       F.greatest("y1", "y2").alias("ymax"), (F.col("y2") - F.col("y1")).alias("a"), (F.col("x1") - F.col("x2")).alias("b"))
    return rows.withColumn("c", -(F.col("a") * F.col("x1") + F.col("b") * F.col("y1")))


def bounding_boxes(polygons: DataFrame) -> DataFrame:
    """poly_id, kind, xmin, ymin, xmax, ymax."""
    points = polygons.select("poly_id", "kind", F.explode("ring").alias("p"))
    return points.groupBy("poly_id", "kind").agg(F.min("p.x").alias("xmin"), F.min("p.y").alias("ymin"), F.max("p.x").alias("xmax"), F.max("p.y").alias("ymax"))


def box_filter(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive on all four sides."""
    return (x >= F.lit(box[0])) & (x <= F.lit(box[2])) & (y >= F.lit(box[1])) & (y <= F.lit(box[3]))


def _edge_tests(x: Column, y: Column, e: Edge) -> tuple[Column, Column]:
    """(on the edge, crossed by the ray to the right)."""
    r = F.lit(e.a) * x + F.lit(e.b) * y + F.lit(e.c)
    on = (r == 0) & box_filter(x, y, e.box)
    cross = (y >= F.lit(e.box[1])) & (y < F.lit(e.box[3])) & ((-r if e.a > 0 else r) > 0)
    return on, cross


def ring_expr(x: Column, y: Column, polygon: Polygon) -> Column:
    tests = [_edge_tests(x, y, e) for e in polygon.edges]
    inside = box_filter(x, y, polygon.box)
    if not tests:
        return inside  # a single point
    on = reduce(lambda p, q: p | q, (t[0] for t in tests))
    crossed = reduce(lambda p, q: p + q, (t[1].cast("int") for t in tests))
    return inside & (on | (crossed % 2 == 1))


def pip_expr(x: Column, y: Column, polygons: Sequence[Polygon]) -> Column:
    """Inside any include ring and no exclude ring, as one expression of x and y. Null coordinates: false."""
    def any_of(kind: str) -> Column:
        return reduce(lambda p, q: p | q, (ring_expr(x, y, p) for p in polygons if p.kind == kind), F.lit(False))

    return F.coalesce(any_of("include") & ~any_of("exclude"), F.lit(False))


def include_box(polygons: Sequence[Polygon]) -> tuple[float, float, float, float] | None:
    """The box around all include rings."""
    boxes = [p.box for p in polygons if p.kind == "include"]
    return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None


def inside(points: DataFrame, polygons: Sequence[Polygon], x: str = "x", y: str = "y") -> DataFrame:
    """The points inside; the box is a filter of its own, which Catalyst pushes to the scan."""
    box = include_box(polygons)
    if box is None:
        return points.where(F.lit(False))
    boxed = points.where(box_filter(F.col(x), F.col(y), box))
    if sum(len(p.edges) for p in polygons) <= UNROLL:
        return boxed.where(pip_expr(F.col(x), F.col(y), polygons))
    return grid_join(boxed, polygons, x, y)


def ring_tests(points: DataFrame, edges: DataFrame, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """The same test as a join: points (id, x, y) and an edge table -> id of the points inside.

    A theta join on the edge's box and on the ray's reach, then a pre-aggregated parity per point and ring.
    """
    px, py = F.col(x), F.col(y)
    e = small(edges)
    reach = (py >= F.col("ymin")) & (py <= F.col("ymax")) & (px <= F.col("xmax"))
    r = F.col("a") * px + F.col("b") * py + F.col("c")
    on = (r == 0) & (px >= F.col("xmin")) & (px <= F.col("xmax"))
    cross = (py < F.col("ymax")) & (F.when(F.col("a") > 0, -r).otherwise(r) > 0)
    hit = points.select(id_col, x, y).join(e, reach).groupBy(id_col, "poly_id", "kind").agg(
        F.bool_or(on).alias("on"), F.sum(cross.cast("int")).alias("n"))
    hit = hit.where(F.col("on") | (F.col("n") % 2 == 1))
    return hit.groupBy(id_col).agg(F.bool_or(F.col("kind") == "include").alias("i"), F.bool_or(F.col("kind") == "exclude").alias("e")).where("i and not e").select(id_col)


def _edge_arrays(polygon: Polygon) -> tuple[np.ndarray, ...]:
    """a, b, c, xmin, ymin, xmax, ymax of the edges."""
    rows = np.array([(e.a, e.b, e.c, *e.box) for e in polygon.edges], np.float64).reshape(-1, 7)
    return tuple(rows.T)


def _span(lo: np.ndarray, hi: np.ndarray, start: float, step: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of n cells that [lo, hi] meets, with a hair's breadth to spare for rounding."""
    return (np.maximum(0, np.trunc((lo - start) / step - 1e-6)).astype(int), np.minimum(n - 1, np.trunc((hi - start) / step + 1e-6)).astype(int))


def _mixed(polygons: Sequence[Polygon], box: tuple[float, float, float, float], n: int) -> np.ndarray:
    """Cells (cx, cy) that an edge meets; of a long edge only the part over a column counts there."""
    w, h = (box[2] - box[0]) / n or 1.0, (box[3] - box[1]) / n or 1.0
    edge = np.zeros((n, n + 1), int)  # ends of the runs of cells of each column
    for p in polygons:
        a, b, c, x1, y1, x2, y2 = _edge_arrays(p)
        first, last = _span(x1, x2, box[0], w, n)
        for cx in range(n):
            at = (first <= cx) & (cx <= last)
            if not at.any():
                continue
            lo, hi = y1[at], y2[at]
            slope = b[at] != 0
            ends = [-(a[at] * np.minimum(np.maximum(box[0] + k * w, x1[at]), x2[at]) + c[at]) / np.where(slope, b[at], 1.0) for k in (cx - 1e-6, cx + 1 + 1e-6)]
            lo = np.where(slope, np.maximum(lo, np.minimum(*ends)), lo)
            hi = np.where(slope, np.minimum(hi, np.maximum(*ends)), hi)
            bottom, top = _span(lo, hi, box[1], h, n)
            some = bottom <= top
            np.add.at(edge[cx], bottom[some], 1)
            np.add.at(edge[cx], top[some] + 1, -1)
    return np.cumsum(edge, axis=1)[:, :n] > 0


def _centres_inside(polygon: Polygon, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """(x, y) -> whether the ray to the right crosses the ring an odd number of times; only cells without edges are asked about."""
    a, b, c, _, y1, x2, y2 = _edge_arrays(polygon)
    out = np.zeros((len(xs), len(ys)), bool)
    for i, y in enumerate(ys):
        at = (y1 <= y) & (y < y2)  # edges with a != 0
        crossings = np.sort(-(b[at] * y + c[at]) / a[at])
        out[:, i] = (len(crossings) - np.searchsorted(crossings, xs)) % 2 == 1
    return out


def grid_cells(polygons: Sequence[Polygon], level: int = LEVEL) -> list[tuple[int, int, str]]:
    """(cx, cy, in | out | mixed) for all cells of the grid over the include rings: mixed where an edge meets the cell.

    A scan by columns for the edges and by rows for the centres: time grows with edges times 2**level at most.
    """
    box = include_box(polygons)
    n = 1 << level
    mixed = _mixed(polygons, box, n)
    w, h = (box[2] - box[0]) / n or 1.0, (box[3] - box[1]) / n or 1.0
    xs, ys = box[0] + (np.arange(n) + 0.5) * w, box[1] + (np.arange(n) + 0.5) * h
    any_of = lambda kind: reduce(np.logical_or, (_centres_inside(p, xs, ys) for p in polygons if p.kind == kind), np.zeros((n, n), bool))
    names = np.where(mixed, "mixed", np.where(any_of("include") & ~any_of("exclude"), "in", "out"))
    return [(cx, cy, str(names[cx, cy])) for cx in range(n) for cy in range(n)]


def cell_of(x: Column, y: Column, box: tuple[float, float, float, float], level: int = LEVEL) -> tuple[Column, Column]:
    """The cell of a point inside the box."""
    n = 1 << level
    at = lambda v, lo, hi: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - F.lit(lo)) / F.lit((hi - lo) / n or 1.0)).cast("int")))
    return at(x, box[0], box[2]), at(y, box[1], box[3])


def grid_join(points: DataFrame, polygons: Sequence[Polygon], x: str = "x", y: str = "y", level: int = LEVEL) -> DataFrame:
    """The points inside, by cell. The cell table has 4**level rows at most, so it is broadcast."""
    spark = points.sparkSession
    box = include_box(polygons)
    if box is None:
        return points.where(F.lit(False))
    n = 1 << level
    h = (box[3] - box[1]) / n or 1.0
    rings: list[list[tuple]] = [[] for _ in range(n)]  # the rings, with those of their edges that reach each row of cells
    for p in polygons:
        bottom, top = _span(*(_edge_arrays(p)[k] for k in (4, 6)), box[1], h, n)
        own: list[list[tuple]] = [[] for _ in range(n)]
        for e, lo, hi in zip(p.edges, bottom, top, strict=True):
            for cy in range(lo, hi + 1):
                own[cy].append((e.a, e.b, e.c, *e.box))
        for cy in range(n):
            if own[cy]:
                rings[cy].append((p.kind == "include", *p.box, own[cy]))
    box_of = "xmin:double,ymin:double,xmax:double,ymax:double"
    ring_of = f"struct<inc:boolean,{box_of},edges:array<struct<a:double,b:double,c:double,{box_of}>>>"
    cx_, cy_, mixed_, rings_ = (unused(c, points) for c in ("cx", "cy", "mixed", "rings"))
    cells = [(cx, cy, c == "mixed") for cx, cy, c in grid_cells(polygons, level) if c != "out"]
    cell_df = F.broadcast(spark.createDataFrame(cells, f"{cx_} int, {cy_} int, {mixed_} boolean"))
    row_df = small(spark.createDataFrame(list(enumerate(rings)), f"{cy_} int, {rings_} array<{ring_of}>"))
    px, py = F.col(x), F.col(y)
    cx, cy = cell_of(px, py, box, level)
    at = points.where(box_filter(px, py, box)).withColumns({cx_: cx, cy_: cy}).join(cell_df, [cx_, cy_])
    sure = at.where(~F.col(mixed_)).select(*points.columns)
    maybe = at.where(mixed_).join(row_df, cy_)

    def within(r: Column) -> Column:
        """A ring whose edges do not reach the row has no point of it inside."""
        value = lambda e: e["a"] * px + e["b"] * py + e["c"]
        boxed = lambda b: (px >= b["xmin"]) & (px <= b["xmax"]) & (py >= b["ymin"]) & (py <= b["ymax"])
        on = F.exists(r["edges"], lambda e: (value(e) == 0) & boxed(e))
        cross = F.size(F.filter(r["edges"], lambda e: (e["ymin"] <= py) & (py < e["ymax"]) & (F.when(e["a"] > 0, -value(e)).otherwise(value(e)) > 0)))
        return boxed(r) & (on | (cross % 2 == 1))

    any_of = lambda include_: F.exists(rings_, lambda r: (r["inc"] == F.lit(include_)) & within(r))
    return sure.unionByName(maybe.where(any_of(True) & ~any_of(False)).select(*points.columns))
