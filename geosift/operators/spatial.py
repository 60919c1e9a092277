"""Points with polygons, both tables of any size: one equi-join with pieces of polygons on grids (`holding`), and an adaptive quadtree
over all edges with an equi-join on its leaves (`contains`), which `holding` uses for polygons that do not go apart into strips.

A node of the tree that more than LEAF edges meet is split into 4 x 4 parts, level by level, until `depth`; its parts are key ranges of a
Z-curve. A part keeps an edge that meets it. Of an edge to its right it keeps the two ends' heights only: a ray to the right
from a point at height y crosses the edge if exactly one of them lies above y. So the parity of all edges to the right is the parity of
the heights above y, heights that occur twice cancel out (those where one edge ends and the next begins, mostly), heights
above the whole part become one constant, and heights below it vanish. A part without edges needs no test at all.

A point's leaf is found by its prefix of the Z-curve at each level that has leaves; then the exact test of `polygon` runs on the leaf's few edges.
Nothing is collected: nodes are split by joins and sums, edges are dealt by node and polygon. A hot leaf's points are split
by AQE, since its rows stand on the other side of the join. Leaves at the last level may have more edges than LEAF (where many meet in one spot):
these are kept in chunks whose parities are summed for each point and polygon.

Defined results:
- the rule of `polygon`: even-odd, the boundary is inside, edges without length do not count; a ring of one point holds that point.
- points with a null or NaN coordinate are in no polygon; ids of points are unique.
- rings with a null or non-finite coordinate are an error; null and empty rings have no edges and hold no point.
- polygons with equal poly_id are one polygon of several rings, under the even-odd rule together. No polygons: no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosift.operators.polygon import edge_table
from geosift.staging import small, stage

LEAF = 20  # edges of a leaf at most, but at the last level
DEPTH = 14  # levels; a leaf's side is 2 ** -DEPTH of the whole at least
CHUNK = 64  # edges and heights of a leaf's row at most
MARGIN = 1e-9  # of the whole's side: parts are taken so much larger, for rounding
LEAF_ROWS = 2_000  # leaves (a few kB each) up to which they are broadcast
WHOLE = 24  # edges of a polygon up to which it is one piece
PIECE = 8  # edges for which a larger polygon gets one more strip
ACROSS = 64  # edges that a line across a polygon may meet on average, or the polygon goes into the tree
CROWD = 4096  # edges of a strip at most, or the polygon goes into the tree
FINE = 20  # halvings of the whole's side down to the smallest cell
_ITEM = ("t", "a", "b", "c", "xmin", "ymin", "xmax", "ymax")  # a height, or an edge
_BOX = ("left", "low", "high")  # of the whole polygon


@dataclass(frozen=True)
class Quadtree:
    """box: left, bottom, width, height; leaves: level, z, poly_id, items, parts (rows of that leaf and polygon)."""

    box: tuple[float, float, float, float]
    depth: int
    leaves: DataFrame


def ring_edges(polygons: DataFrame) -> DataFrame:
    """Edges of polygons (poly_id, kind, ring); a ring of one point gives one edge without length, which only that point is on."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    checked = polygons.where("size(ring) > 0").withColumn("ring", F.when(F.forall("ring", lambda p: fine(p["x"]) & fine(p["y"])), F.col("ring")).otherwise(
        F.raise_error(F.concat(F.lit("a coordinate of polygon "), F.col("poly_id").cast("string"), F.lit(" is no finite number")))))
    x, y = F.get("ring", F.lit(0))["x"], F.get("ring", F.lit(0))["y"]
    spot = checked.where(F.forall("ring", lambda p: (p["x"] == F.get("ring", F.lit(0))["x"]) & (p["y"] == F.get("ring", F.lit(0))["y"]))).select(
        "poly_id", *[F.lit(0.0).alias(c) for c in "abc"], x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))
    edges = edge_table(checked)
    return edges.select(*spot.columns).unionByName(spot)


def _spread(v: Column) -> Column:
    """The bits of a number below 2 ** 20, each with a zero bit in front."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def z_value(ix: Column, iy: Column) -> Column:
    """The place of a cell on the Z-curve."""
    return _spread(ix.cast("long")).bitwiseOR(F.shiftleft(_spread(iy.cast("long")), 1))


def _split(items: DataFrame, box: tuple[float, float, float, float], level: int) -> DataFrame:
    """Items of nodes of a level -> items of their 16 parts."""
    n = 1 << level + 2
    w, h, ex, ey = box[2] / n, box[3] / n, box[2] * MARGIN, box[3] * MARGIN
    left, bottom = F.lit(box[0]) + F.col("nx") * (4 * w), F.lit(box[1]) + F.col("ny") * (4 * h)
    at = lambda v, start, step: F.greatest(F.lit(0), F.least(F.lit(3), F.floor((v - start) / step).cast("int")))
    edges = items.where("t is null").select("*", at(F.col("xmin") - ex, left, w).alias("i0"), F.explode(F.sequence(F.lit(0), at(F.col("xmax") + ex, left, w))).alias("i"),
                                            at(F.col("ymin") - ey, bottom, h).alias("j0"), at(F.col("ymax") + ey, bottom, h).alias("j1"))
    edges = edges.select("*", F.explode(F.sequence("j0", "j1")).alias("j"))
    x0, x1 = left + F.col("i") * w - ex, left + (F.col("i") + 1) * w + ex
    y0, y1 = bottom + F.col("j") * h - ey, bottom + (F.col("j") + 1) * h + ey
    corners = [F.col("a") * x + F.col("b") * y + F.col("c") for x in (x0, x1) for y in (y0, y1)]
    low, high = F.least(*corners), F.greatest(*corners)
    spot = (F.col("a") == 0) & (F.col("b") == 0)
    meets = (F.col("i") >= F.col("i0")) & (spot | (low <= 0) & (high >= 0))
    is_left = (F.col("a") != 0) & ((F.col("i") < F.col("i0")) | (F.when(F.col("a") > 0, -high).otherwise(low) > 0))
    child = [(F.col("z") * 16 + F.col("i").bitwiseAND(F.lit(1)) + F.col("j").bitwiseAND(F.lit(1)) * 2 + F.shiftright("i", 1) * 4 + F.shiftright("j", 1) * 8).alias("z"),
             (F.col("nx") * 4 + F.col("i")).alias("nx"), (F.col("ny") * 4 + F.col("j")).alias("ny"), "poly_id", *_BOX]
    # A part that lies wholly to the left of a polygon, or above or below it, needs nothing of it: all its heights would cancel out.
    near = (F.col("left") <= x1) & (F.col("low") <= y1) & (F.col("high") >= y0)
    tested = edges.where(near).select("*", meets.alias("meets"), is_left.alias("is_left"), y0.alias("y0"), y1.alias("y1"))
    kept = tested.where("meets").select(*child, *_ITEM)
    ends = tested.where("not meets and is_left").select(*child, "y0", "y1", F.explode(F.array("ymin", "ymax")).alias("t"))
    old = items.where("t is not null").select("z", "nx", "ny", "poly_id", *_BOX, "t", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    old = old.where(near).select(*child, y0.alias("y0"), y1.alias("y1"), "t")
    heights = ends.unionByName(old).where("t >= y0").withColumn("t", F.when(F.col("t") > F.col("y1"), float("inf")).otherwise(F.col("t")))
    odd = heights.groupBy("z", "nx", "ny", "poly_id", *_BOX, "t").agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")
    return kept.unionByName(odd, allowMissingColumns=True)


def _leaf_rows(items: DataFrame, level: int, chunked: bool) -> DataFrame:
    """level, z, poly_id, items, parts."""
    item = F.struct(*_ITEM)
    if chunked:
        sizes = items.groupBy("z", "poly_id").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
        items = items.join(sizes, ["z", "poly_id"]).withColumn("chunk", F.pmod(F.xxhash64(*_ITEM), "parts"))
    else:
        items = items.select("*", F.lit(1).alias("parts"), F.lit(0).alias("chunk"))
    return items.groupBy("z", "poly_id", "parts", "chunk").agg(F.collect_list(item).alias("items")).select(F.lit(level).alias("level"), "z", "poly_id", "items", "parts")


def quadtree(edges: DataFrame, depth: int = DEPTH, leaf: int = LEAF) -> Quadtree:
    """The tree over edges (poly_id, a, b, c, xmin, ymin, xmax, ymax): a round of joins for every two levels."""
    if not 2 <= depth <= 20 or depth % 2:
        raise ValueError(f"depth {depth}: an even number from 2 to 20")
    left, bottom, right, top = edges.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
    boxes = edges.groupBy("poly_id").agg(F.min("xmin").alias("left"), F.min("ymin").alias("low"), F.max("ymax").alias("high"))
    items = edges.join(boxes, "poly_id").select(zero.alias("z"), zero.alias("nx"), zero.alias("ny"), "poly_id", *_BOX, none.alias("t"), *_ITEM[1:])
    if left is None:
        return Quadtree((0.0, 0.0, 1.0, 1.0), depth, _leaf_rows(items, 0, False))
    box = (left, bottom, right - left or 1.0, top - bottom or 1.0)
    leaves, level = [], 0
    while level < depth:
        full = stage(items.where("t is null").groupBy("z").count().where(F.col("count") > leaf).select("z"), "tree-nodes")
        if full.isEmpty():
            break
        leaves.append(_leaf_rows(items.join(small(full), "z", "left_anti"), level, False))
        items = stage(_split(items.join(small(full), "z", "left_semi"), box, level), "tree-items")
        level += 2
    leaves.append(_leaf_rows(items, level, level == depth))
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    return Quadtree(box, depth, stage(every, "tree-leaves"))


def contains(points: DataFrame, tree: Quadtree, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """id, poly_id for each point and each polygon that it lies in."""
    left, bottom, w, h = tree.box
    n = 1 << tree.depth
    px, py = F.col("px"), F.col("py")
    boxed = points.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where(
        (px >= left) & (px <= left + w) & (py >= bottom) & (py <= bottom + h))
    cell = lambda v, start, size: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - F.lit(start)) / F.lit(size / n)).cast("int")))
    levels = [r.level for r in tree.leaves.select("level").distinct().orderBy("level").collect()]  # depth / 2 + 1 at most
    if not levels:
        return boxed.join(tree.leaves.select("poly_id"), F.lit(False)).select("id", "poly_id")
    z = boxed.withColumn("z", z_value(cell(px, left, w), cell(py, bottom, h)))
    keys = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("z", 2 * (tree.depth - k)).alias("z")) for k in levels])
    at = z.select("id", "px", "py", F.explode(keys).alias("k")).select("id", "px", "py", "k.level", "k.z").join(small(tree.leaves, LEAF_ROWS), ["level", "z"])

    value = lambda e: e["a"] * px + e["b"] * py + e["c"]
    boxed_by = lambda e: (px >= e["xmin"]) & (px <= e["xmax"]) & (py >= e["ymin"]) & (py <= e["ymax"])
    on = F.exists("items", lambda e: e["t"].isNull() & (value(e) == 0) & boxed_by(e))
    crossed = F.size(F.filter("items", lambda e: F.coalesce(e["t"] > py, (e["ymin"] <= py) & (py < e["ymax"]) & (F.when(e["a"] > 0, -value(e)).otherwise(value(e)) > 0))))
    tested = at.select("id", "poly_id", "px", "py", "parts", on.alias("on"), crossed.alias("n"))
    whole = tested.where("parts = 1").where("on or n % 2 = 1").select("id", "poly_id")
    summed = tested.where("parts > 1").groupBy("id", "poly_id").agg(F.bool_or("on").alias("on"), F.sum("n").alias("n")).where("on or n % 2 = 1").select("id", "poly_id")
    return whole.unionByName(summed)


def _pieces(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Strips of polygons (poly_id, axis, strip, strips, left, low, w, h, box of the strip, items, parts); the edges of those that have too many in a strip (None: no polygon).

    A ray along the strip crosses edges of that strip only. The strips lie across the axis along which lines meet fewer edges.
    """
    per = edges.groupBy("poly_id").agg(F.min("xmin").alias("left"), F.min("ymin").alias("low"), F.max("xmax").alias("right"), F.max("ymax").alias("high"), F.count("*").alias("n"),
                                       F.sum(F.col("xmax") - F.col("xmin")).alias("dx"), F.sum(F.col("ymax") - F.col("ymin")).alias("dy"))
    w, h = F.col("right") - F.col("left"), F.col("high") - F.col("low")
    across = lambda d, side: F.when(side > 0, F.col(d) / side).otherwise(F.col("n"))
    per = per.select("poly_id", "left", "low", w.alias("w"), h.alias("h"), "n", across("dx", w).alias("ax"), across("dy", h).alias("ay"))
    per = stage(per.where(F.col("n") > WHOLE), "large-polygons")
    item = F.struct(*_ITEM[1:])
    bounds = [F.min("xmin").alias("x0"), F.max("xmax").alias("x1"), F.min("ymin").alias("y0"), F.max("ymax").alias("y1")]
    columns = ["poly_id", "axis", "strip", "strips", "left", "low", "w", "h", "x0", "x1", "y0", "y1", "items", "parts"]
    zero = F.lit(0).cast("long")
    if per.isEmpty():
        few, large = edges, None
    else:
        few, large = edges.join(small(per.select("poly_id")), "poly_id", "left_anti"), small(per)
    pieces = few.groupBy("poly_id").agg(*bounds, F.collect_list(item).alias("items")).select(
        "*", F.lit("y").alias("axis"), zero.alias("strip"), F.lit(1).cast("long").alias("strips"), F.col("x0").alias("left"), F.col("y0").alias("low"),
        (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), F.lit(1).alias("parts")).select(*columns)
    if large is None:
        return pieces, None
    by_x = F.col("ax") <= F.col("ay")
    plain = edges.join(large, "poly_id").where(F.least("ax", "ay") <= ACROSS).withColumns(
        {"axis": F.when(by_x, "x").otherwise("y"), "strips": F.ceil(F.col("n") / PIECE).cast("long")})
    least, most = (F.when(by_x, strip_of(F.col(x), "left", "w")).otherwise(strip_of(F.col(y), "low", "h")) for x, y in (("xmin", "ymin"), ("xmax", "ymax")))
    plain = plain.select("*", F.explode(F.sequence(least, most)).alias("strip"))
    sizes = stage(plain.groupBy("poly_id", "strip").agg(F.count("*").alias("held")), "strip-sizes")
    crowded = sizes.where(F.col("held") > CROWD).select("poly_id").distinct()
    tree = stage(per.where(F.least("ax", "ay") > ACROSS).select("poly_id").unionByName(crowded), "tree-polygons")
    sized = plain.join(small(tree), "poly_id", "left_anti").join(sizes, ["poly_id", "strip"])
    sized = sized.withColumn("parts", F.ceil(F.col("held") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64(*_ITEM[1:]), "parts"))
    strips = sized.groupBy("poly_id", "axis", "strip", "strips", "left", "low", "w", "h", "parts", "chunk").agg(F.collect_list(item).alias("items"))
    # The box of a strip, a little larger for rounding; its own test follows.
    start = lambda o, side, k, sign: F.col(o) + F.col(side) * ((F.col("strip") + k) / F.col("strips")) + sign * MARGIN * (F.col(side) + F.abs(o))
    x_axis = F.col("axis") == "x"
    strips = strips.select("*", *[F.when(x_axis if axis == "x" else ~x_axis, start(o, side, k, sign)).otherwise(F.col(o) + k * F.col(side) + sign * MARGIN * (F.col(side) + F.abs(o))).alias(name)
                                  for axis, o, side, k, sign, name in (("x", "left", "w", 0, -1, "x0"), ("x", "left", "w", 1, 1, "x1"), ("y", "low", "h", 0, -1, "y0"), ("y", "low", "h", 1, 1, "y1"))])
    return pieces.unionByName(strips.select(*columns)), None if tree.isEmpty() else edges.join(small(tree), "poly_id", "left_semi")


def strip_of(v: Column, start: str, side: str) -> Column:
    """The strip of a place: never falls as the place rises, whatever is rounded."""
    return F.greatest(F.lit(0), F.least(F.col("strips") - 1, F.floor((v - F.col(start)) / F.col(side) * F.col("strips")))).cast("long")


def holding(points: DataFrame, edges: DataFrame, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """id, poly_id for each point and each polygon (edges as of `ring_edges`) that it lies in, in one equi-join.

    A polygon is one piece, or strips of some edges each. A piece lies in 2 x 2 cells at most of a grid of about its own width and height; a point has one cell in
    each grid in use. Polygons whose strips would hold very many edges go into a quadtree instead.
    """
    pieces, rest = _pieces(edges)
    pieces = stage(pieces, "pieces")
    left, right, low, high = pieces.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    place = points.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    if left is None:
        return contains(place, quadtree(edges), "id", "px", "py")

    def level(a: str, b: str, whole: float) -> Column:
        """An even power of two that is no less than the piece's side."""
        top = math.ceil(math.log2(whole)) if whole > 0 else 0
        side = F.greatest(F.col(b) - F.col(a), F.lit(2.0 ** (top - FINE)))
        return (2 * F.ceil(F.log2(side) / 2)).cast("int")

    cell = lambda v, k: F.floor(v * F.pow(F.lit(2.0), -k)).cast("long")
    keyed = pieces.withColumns({"kx": level("x0", "x1", right - left), "ky": level("y0", "y1", high - low)})
    grids = [(r.kx, r.ky) for r in keyed.select("kx", "ky").distinct().collect()]  # (FINE / 2 + 1) ** 2 at most
    keyed = keyed.select("*", F.explode(F.sequence(cell(F.col("x0"), F.col("kx")), cell(F.col("x1"), F.col("kx")))).alias("ix"))
    keyed = keyed.select("*", F.explode(F.sequence(cell(F.col("y0"), F.col("ky")), cell(F.col("y1"), F.col("ky")))).alias("iy"))
    px, py = F.col("px"), F.col("py")
    boxed = place.where((px >= left) & (px <= right) & (py >= low) & (py <= high))
    keys = F.array(*[F.struct(F.lit(kx).alias("kx"), F.lit(ky).alias("ky"), cell(px, F.lit(kx)).alias("ix"), cell(py, F.lit(ky)).alias("iy")) for kx, ky in grids])
    at = boxed.select("id", "px", "py", F.explode(keys).alias("k")).select("id", "px", "py", "k.*").join(keyed, ["kx", "ky", "ix", "iy"]).where(
        px.between(F.col("x0"), F.col("x1")) & py.between(F.col("y0"), F.col("y1")))
    by_x = F.col("axis") == "x"
    at = at.where((F.col("strips") == 1) | (F.when(by_x, strip_of(px, "left", "w")).otherwise(strip_of(py, "low", "h")) == F.col("strip")))
    value = lambda e: e["a"] * px + e["b"] * py + e["c"]
    on = F.exists("items", lambda e: (value(e) == 0) & px.between(e["xmin"], e["xmax"]) & py.between(e["ymin"], e["ymax"]))
    crossed = F.when(by_x, F.size(F.filter("items", lambda e: (e["xmin"] <= px) & (px < e["xmax"]) & (F.when(e["b"] > 0, -value(e)).otherwise(value(e)) > 0)))).otherwise(
        F.size(F.filter("items", lambda e: (e["ymin"] <= py) & (py < e["ymax"]) & (F.when(e["a"] > 0, -value(e)).otherwise(value(e)) > 0))))
    tested = at.select("id", "poly_id", "parts", on.alias("on"), crossed.alias("n"))
    whole = tested.where("parts = 1").where("on or n % 2 = 1").select("id", "poly_id")
    summed = tested.where("parts > 1").groupBy("id", "poly_id").agg(F.bool_or("on").alias("on"), F.sum("n").alias("n")).where("on or n % 2 = 1").select("id", "poly_id")
    found = whole if pieces.where("parts > 1").isEmpty() else whole.unionByName(summed)
    return found if rest is None else found.unionByName(contains(place, quadtree(rest), "id", "px", "py"))


def inside_areas(points: DataFrame, polygons: DataFrame, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """id of the points that lie in any include ring and no exclude ring of a polygon table (poly_id, kind, ring)."""
    if not polygons.where("kind is null or kind not in ('include', 'exclude')").isEmpty():
        raise ValueError("a polygon's kind is include or exclude")
    # A polygon's rings count each for itself here, as in `polygon`.
    rings = stage(polygons.withColumn("poly_id", F.monotonically_increasing_id()), "areas")
    pairs = holding(points, ring_edges(rings), id_col, x, y).join(small(rings.select("poly_id", "kind")), "poly_id")
    kinds = pairs.groupBy("id").agg(F.bool_or(F.col("kind") == "include").alias("i"), F.bool_or(F.col("kind") == "exclude").alias("e"))
    return kinds.where("i and not e").select("id")


def chain_edges(vertices: DataFrame) -> DataFrame:
    """Edges of rings whose points are rows (poly_id, pos from 0 without gaps, x, y): an equi-join with the next point, so that a ring of any length is dealt over many tasks."""
    sizes = vertices.groupBy("poly_id").agg(F.count("*").alias("n"))
    here = vertices.join(small(sizes), "poly_id").select("poly_id", F.pmod(F.col("pos") + 1, F.col("n")).alias("pos"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    there = vertices.select("poly_id", F.col("pos").cast("long").alias("pos"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    rows = here.withColumn("pos", F.col("pos").cast("long")).join(there, ["poly_id", "pos"]).where("x1 <> x2 or y1 <> y2")
    rows = rows.select("*", (F.col("y2") - F.col("y1")).alias("a"), (F.col("x1") - F.col("x2")).alias("b"))
    return rows.select("poly_id", "a", "b", (-(F.col("a") * F.col("x1") + F.col("b") * F.col("y1"))).alias("c"),
                       F.least("x1", "x2").alias("xmin"), F.least("y1", "y2").alias("ymin"), F.greatest("x1", "x2").alias("xmax"), F.greatest("y1", "y2").alias("ymax"))
