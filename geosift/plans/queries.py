"""The registered queries over the driver's tables, with their SQL.

Roles: part is the node table (x = p_size, y = p_retailprice - 900), orders with lineitem the ways,
customers, nations and regions the relations. Relation ids share one space by an offset.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geosift.functions import text as X
from geosift.functions import xml as XML
from geosift.operators import closure, extract, idset, paths, trees
from geosift.operators import polygon as P
from geosift.operators import spatial as SP
from geosift.plans import xsd, xsd_rules
from geosift.schema import META, Elements
from geosift.sources import osm_xml, sinks
from geosift.staging import new_path, stage
from geosift.streaming import extract as stream_states
from geosift.streaming import nodes as streams

CUSTOMER, NATION, REGION = 10**12, 2 * 10**12, 3 * 10**12

MAIN = (P.include((4, 10), (9, 10), (9, 40)),)
MULTI = (*MAIN, P.include((20, 50), (30, 50), (30, 70), (20, 70)))
HOLE = (P.include((5, 5), (45, 5), (45, 90), (5, 90)), P.exclude((15, 20), (35, 20), (35, 60), (15, 60)))
BOW = (P.include((10, 10), (40, 10), (10, 80), (40, 80)),)
DISC = (P.include(*[(25 + 20 * math.cos(math.pi * k / 32), 50 + 40 * math.sin(math.pi * k / 32)) for k in range(64)]), P.exclude((20, 40), (30, 40), (25, 60)))
EVENT_AREA = (P.include((10, 5), (400, 5), (900, 90), (10, 70)),)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - F.lit(900.0)).alias("y"))


def _no_meta() -> list[Column]:
    kinds = {"version": "bigint", "timestamp": "string", "uid": "bigint", "user": "string", "changeset": "bigint"}
    return [F.lit(None).cast(kinds[c]).alias(c) for c in META]


def _tag(**tags: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in tags.items()]).alias("tags")


def way_refs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("node_id"))


def map_of(spark: SparkSession, sf: str) -> Elements:
    nodes = read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - F.lit(900.0)).alias("y"),
        *_no_meta(), _tag(name=F.col("p_name"), brand=F.col("p_brand")))
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    refs = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("l"))
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    ways = orders.join(refs, orders["o_orderkey"] == refs["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("id"), F.coalesce(F.transform("l", lambda r: r["l_partkey"]), F.array().cast("array<bigint>")).alias("nodes"),
        *_no_meta(), _tag(status=F.col("o_orderstatus")))
    return Elements(nodes, ways, relations_of(spark, sf), {"version": "0.6", "generator": "tables & views"})


def relations_of(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of their orders, nations of their customers, regions of their nations; pos is the id's order."""
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), ref.cast("bigint").alias("ref"), role.alias("role"))
    parts = [
        read(spark, sf, "orders").select((F.col("o_custkey") + CUSTOMER).alias("id"), member("way", F.col("o_orderkey"), F.col("o_orderpriority")).alias("m")),
        read(spark, sf, "customer").select((F.col("c_nationkey") + F.lit(NATION)).alias("id"), member("relation", F.col("c_custkey") + CUSTOMER, F.lit("")).alias("m")),
        read(spark, sf, "nation").select((F.col("n_regionkey") + F.lit(REGION)).alias("id"), member("relation", F.col("n_nationkey") + F.lit(NATION), F.lit("")).alias("m"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("members"))
    return lists.select("id", "members", *_no_meta(), F.array().cast("array<struct<k:string,v:string>>").alias("tags"), F.col("id").alias("pos"))


# SQL building blocks.

SQL_POINTS = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice - 900.0::DOUBLE AS y FROM part"
SQL_EVENTS = "SELECT event_id AS id, CAST(user_id AS DOUBLE) AS x, value AS y FROM events"


def _d(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def sql_edges(polygons: Sequence[P.Polygon]) -> str:
    rows = [f"({i}, '{p.kind}', {k}, {', '.join(_d(v) for v in (e.x1, e.y1, e.x2, e.y2, e.a, e.b, e.c, *e.box))})" for i, p in enumerate(polygons) for k, e in enumerate(p.edges)]
    return f"(VALUES {', '.join(rows)}) AS e(poly_id, kind, edge_no, x1, y1, x2, y2, a, b, c, xmin, ymin, xmax, ymax)"


def sql_inside(pts: str, polygons: Sequence[P.Polygon]) -> str:
    """A query of the ids inside."""
    r = "(a * x + b * y + c)"
    return f"""SELECT id FROM (
      SELECT id, poly_id, kind FROM ({pts}) p CROSS JOIN {sql_edges(polygons)} GROUP BY id, x, y, poly_id, kind
      HAVING x BETWEEN min(xmin) AND max(xmax) AND y BETWEEN min(ymin) AND max(ymax) AND (
        bool_or({r} = 0 AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax)
        OR sum(CASE WHEN ymin <= y AND y < ymax AND (CASE WHEN a > 0 THEN -{r} ELSE {r} END) > 0 THEN 1 ELSE 0 END) % 2 = 1))
      GROUP BY id HAVING bool_or(kind = 'include') AND NOT bool_or(kind = 'exclude')"""


SQL_MEMBERS = f"""SELECT o_custkey + {CUSTOMER} AS rel_id, 'way' AS type, o_orderkey AS ref, o_orderpriority AS role FROM orders
  UNION ALL SELECT c_nationkey + {NATION}, 'relation', c_custkey + {CUSTOMER}, '' FROM customer
  UNION ALL SELECT n_regionkey + {REGION}, 'relation', n_nationkey + {NATION}, '' FROM nation"""


def sql_cut(polygons: Sequence[P.Polygon]) -> str:
    """CTEs of complete mode: n_in, w, n, r, kept."""
    return f"""WITH RECURSIVE n_in AS ({sql_inside(SQL_POINTS, polygons)}),
  w AS (SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey IN (SELECT id FROM n_in)),
  missing AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey IN (SELECT id FROM w) AND l_partkey NOT IN (SELECT id FROM n_in)),
  n AS (SELECT id FROM n_in UNION SELECT id FROM missing WHERE id IN (SELECT p_partkey FROM part)),
  mem AS ({SQL_MEMBERS}),
  seeds AS (SELECT DISTINCT rel_id AS id FROM mem WHERE type = 'way' AND ref IN (SELECT id FROM w)),
  r AS (SELECT id FROM seeds UNION SELECT rel_id FROM mem JOIN r ON mem.type = 'relation' AND mem.ref = r.id),
  kept AS (SELECT rel_id, type, ref, role FROM mem WHERE rel_id IN (SELECT id FROM r)
    AND ((type = 'way' AND ref IN (SELECT id FROM w)) OR (type = 'relation' AND ref IN (SELECT id FROM r))))"""


# Queries.

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(sql_inside(SQL_POINTS, MAIN))
def pip_include(spark, sf):
    return P.inside(points(spark, sf), MAIN).select("id")


@query(sql_inside(SQL_POINTS, MULTI))
def pip_multi_include(spark, sf):
    return P.inside(points(spark, sf), MULTI).select("id")


@query(sql_inside(SQL_POINTS, HOLE))
def pip_exclude_hole(spark, sf):
    return P.inside(points(spark, sf), HOLE).select("id")


@query(sql_inside(SQL_POINTS, BOW))
def pip_self_intersecting(spark, sf):
    return P.inside(points(spark, sf), BOW).select("id")


@query(f"SELECT id, x, y FROM ({SQL_POINTS}) WHERE (x = 4 OR x = 9) AND y >= 10 AND id IN ({sql_inside(SQL_POINTS, MAIN)})")
def pip_boundary(spark, sf):
    rows = P.inside(points(spark, sf), MAIN)
    return rows.where("(x = 4 or x = 9) and y >= 10")


@query(f"SELECT id FROM ({SQL_POINTS}) WHERE x BETWEEN 4 AND 9 AND y BETWEEN 10 AND 40")
def pip_bbox_prefilter(spark, sf):
    return points(spark, sf).where(P.box_filter(F.col("x"), F.col("y"), P.include_box(MAIN))).select("id")


@query(sql_inside(SQL_POINTS, HOLE))
def pip_edge_join(spark, sf):
    return P.ring_tests(points(spark, sf), P.edge_table(P.polygons_df(spark, HOLE)))


@query(sql_inside(SQL_POINTS, DISC))
def pip_grid_index(spark, sf):
    return P.grid_join(points(spark, sf), DISC).select("id")


@query(sql_inside(SQL_EVENTS, EVENT_AREA))
def pip_events(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
    return P.inside(rows, EVENT_AREA).select("id")


def order_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """A rhombus for each order, three of four included."""
    x, y = F.col("o_custkey").cast("double"), F.col("o_totalprice") / F.lit(1000.0)
    dx, dy = (F.col("o_orderkey") % 7 + 2).cast("double"), (F.col("o_orderkey") % 11 + 1).cast("double")
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("poly_id"), F.when(F.col("o_orderkey") % 4 == 0, "exclude").otherwise("include").alias("kind"),
                                            F.array(point(x - dx, y), point(x, y - dy), point(x + dx, y), point(x, y + dy)).alias("ring"))


def event_points(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") * 10).cast("double").alias("x"), F.col("value").alias("y"))


def nation_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """A jagged ring for each nation: its customers by key, at the height of their balance."""
    own = read(spark, sf, "customer").select(F.col("c_nationkey").alias("poly_id"), F.col("c_custkey").cast("double").alias("x"), (F.col("c_acctbal") / F.lit(20.0)).alias("y"))
    return own.withColumn("pos", F.row_number().over(Window.partitionBy("poly_id").orderBy("x", "y")) - 1)


SQL_RHOMBS = """SELECT o_orderkey AS poly_id, CASE WHEN o_orderkey % 4 = 0 THEN 'exclude' ELSE 'include' END AS kind,
    CAST(o_custkey AS DOUBLE) AS x, o_totalprice / 1000.0::DOUBLE AS y, CAST(o_orderkey % 7 + 2 AS DOUBLE) AS dx, CAST(o_orderkey % 11 + 1 AS DOUBLE) AS dy FROM orders"""
SQL_TABLE_EDGES = """SELECT *, y2 - y1 AS a, x1 - x2 AS b, -((y2 - y1) * x1 + (x1 - x2) * y1) AS c,
    least(x1, x2) AS xmin, least(y1, y2) AS ymin, greatest(x1, x2) AS xmax, greatest(y1, y2) AS ymax FROM s WHERE x1 <> x2 OR y1 <> y2"""
SQL_TABLE_EVENTS = "SELECT event_id AS id, CAST(user_id * 10 AS DOUBLE) AS x, value AS y FROM events"
SQL_TABLE_PAIRS = """SELECT id, poly_id FROM p JOIN e ON y BETWEEN ymin AND ymax AND x <= xmax GROUP BY id, poly_id
    HAVING bool_or(a * x + b * y + c = 0 AND x >= xmin) OR sum(CASE WHEN y < ymax AND (CASE WHEN a > 0 THEN -(a * x + b * y + c) ELSE a * x + b * y + c END) > 0 THEN 1 ELSE 0 END) % 2 = 1"""
SQL_RHOMB_CTES = f"""r AS ({SQL_RHOMBS}),
  s AS (SELECT poly_id, kind, x - dx AS x1, y AS y1, x AS x2, y - dy AS y2 FROM r UNION ALL SELECT poly_id, kind, x, y - dy, x + dx, y FROM r
    UNION ALL SELECT poly_id, kind, x + dx, y, x, y + dy FROM r UNION ALL SELECT poly_id, kind, x, y + dy, x - dx, y FROM r),
  e AS ({SQL_TABLE_EDGES}),
  b AS (SELECT poly_id, kind, min(xmin) AS x0, max(xmax) AS x1, min(ymin) AS y0, max(ymax) AS y1 FROM e GROUP BY 1, 2),
  near AS (SELECT id, x, y, poly_id, kind FROM ({SQL_TABLE_EVENTS}) JOIN b ON x BETWEEN x0 AND b.x1 AND y BETWEEN y0 AND b.y1),
  t AS (SELECT id, poly_id, n.kind FROM near n JOIN e USING (poly_id) GROUP BY id, poly_id, n.kind
    HAVING bool_or(a * x + b * y + c = 0 AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax)
      OR sum(CASE WHEN ymin <= y AND y < ymax AND (CASE WHEN a > 0 THEN -(a * x + b * y + c) ELSE a * x + b * y + c END) > 0 THEN 1 ELSE 0 END) % 2 = 1)"""


@query(f"""WITH r AS ({SQL_RHOMBS}), s AS (SELECT poly_id, kind, 0 AS edge_no, x AS x1, y + dy AS y1, x - dx AS x2, y AS y2 FROM r UNION ALL SELECT poly_id, kind, 1, x - dx, y, x, y - dy FROM r
    UNION ALL SELECT poly_id, kind, 2, x, y - dy, x + dx, y FROM r UNION ALL SELECT poly_id, kind, 3, x + dx, y, x, y + dy FROM r) {SQL_TABLE_EDGES}""")
def ring_edges(spark, sf):
    return P.edge_table(order_polygons(spark, sf))


@query(f"SELECT poly_id, kind, x - dx AS xmin, y - dy AS ymin, x + dx AS xmax, y + dy AS ymax FROM ({SQL_RHOMBS})")
def polygon_bbox(spark, sf):
    return P.bounding_boxes(order_polygons(spark, sf))


@query(f"WITH {SQL_RHOMB_CTES} SELECT id, poly_id FROM t")
def pip_polygon_table(spark, sf):
    return SP.holding(event_points(spark, sf), SP.ring_edges(order_polygons(spark, sf)))


@query(f"WITH {SQL_RHOMB_CTES} SELECT id FROM t GROUP BY id HAVING bool_or(kind = 'include') AND NOT bool_or(kind = 'exclude')")
def pip_area_table(spark, sf):
    return SP.inside_areas(event_points(spark, sf), order_polygons(spark, sf))


@query(f"""WITH v AS (SELECT c_nationkey AS poly_id, CAST(c_custkey AS DOUBLE) AS x, c_acctbal / 20.0::DOUBLE AS y FROM customer),
  s AS (SELECT poly_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY poly_id ORDER BY x, y)),
  e AS ({SQL_TABLE_EDGES}), p AS ({SQL_TABLE_EVENTS}) {SQL_TABLE_PAIRS}""")
def pip_quadtree_rings(spark, sf):
    return SP.holding(event_points(spark, sf), stage(SP.chain_edges(nation_vertices(spark, sf)), "ring-edges"))


def _sql_grid(polygons: Sequence[P.Polygon], n: int = 128) -> str:
    """Counts of cells by class: an edge's part over a column makes the cells it meets mixed; the others have the class of their centre."""
    x0, y0, x1, y1 = (f"(SELECT {f}({c}) FROM e WHERE kind = 'include')" for f, c in (("min", "xmin"), ("min", "ymin"), ("max", "xmax"), ("max", "ymax")))
    clip = lambda k: f"-(a * least(greatest(x0 + (cx {k}) * w, xmin), xmax) + c) / b"
    lo, hi = clip("- 1e-6::DOUBLE"), clip("+ 1 + 1e-6::DOUBLE")
    r = "(a * x + b * y + c)"
    return f"""WITH e AS (SELECT * FROM {sql_edges(polygons)}),
  g AS (SELECT {x0} AS x0, {y0} AS y0, ({x1} - {x0}) / {n} AS w, ({y1} - {y0}) / {n} AS h),
  cells AS (SELECT cx.range AS cx, cy.range AS cy, x0 + (cx.range + 0.5::DOUBLE) * w AS x, y0 + (cy.range + 0.5::DOUBLE) * h AS y FROM range({n}) cx, range({n}) cy, g),
  strip AS (SELECT cx, y0, h, CASE WHEN b <> 0 THEN greatest(ymin, least({lo}, {hi})) ELSE ymin END AS lo, CASE WHEN b <> 0 THEN least(ymax, greatest({lo}, {hi})) ELSE ymax END AS hi
    FROM (SELECT range::DOUBLE AS cx FROM range({n})), e, g WHERE cx BETWEEN trunc((xmin - x0) / w - 1e-6::DOUBLE) AND trunc((xmax - x0) / w + 1e-6::DOUBLE)),
  mixed AS (SELECT DISTINCT c.cx, c.cy FROM cells c JOIN strip p ON c.cx = p.cx AND c.cy BETWEEN trunc((lo - y0) / h - 1e-6::DOUBLE) AND trunc((hi - y0) / h + 1e-6::DOUBLE)),
  ring AS (SELECT cx, cy, kind, sum(CASE WHEN ymin <= y AND y < ymax AND (CASE WHEN a > 0 THEN -{r} ELSE {r} END) > 0 THEN 1 ELSE 0 END) % 2 = 1 AS inside
    FROM cells, e GROUP BY cx, cy, kind, poly_id),
  pts AS (SELECT cx, cy, count(*) AS points FROM (SELECT greatest(0, least({n} - 1, floor((x - x0) / w))) AS cx, greatest(0, least({n} - 1, floor((y - y0) / h))) AS cy
    FROM ({SQL_POINTS}), g WHERE x BETWEEN x0 AND x0 + w * {n} AND y BETWEEN y0 AND y0 + h * {n}) GROUP BY 1, 2),
  centre AS (SELECT cx, cy, bool_or(kind = 'include' AND inside) AND NOT bool_or(kind = 'exclude' AND inside) AS inside FROM ring GROUP BY cx, cy)
  SELECT CASE WHEN m.cx IS NOT NULL THEN 'mixed' WHEN inside THEN 'in' ELSE 'out' END AS class, count(*) AS n, coalesce(sum(points), 0)::BIGINT AS points
  FROM centre LEFT JOIN mixed m USING (cx, cy) LEFT JOIN pts USING (cx, cy) GROUP BY 1"""


@query(_sql_grid(DISC))
def grid_cell_classes(spark, sf):
    """Cells of each class, and the points in them."""
    box = P.include_box(DISC)
    cx, cy = P.cell_of(F.col("x"), F.col("y"), box)
    held = points(spark, sf).where(P.box_filter(F.col("x"), F.col("y"), box)).groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("points"))
    cells = spark.createDataFrame(P.grid_cells(DISC), "cx int, cy int, class string").join(held, ["cx", "cy"], "left")
    return cells.groupBy("class").agg(F.count("*").alias("n"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"))


@query(f"WITH n AS ({sql_inside(SQL_POINTS, MAIN)}) SELECT DISTINCT l_orderkey AS way_id FROM lineitem WHERE l_partkey IN (SELECT id FROM n)")
def way_select(spark, sf):
    return extract.select_ways(way_refs(spark, sf), pip_include(spark, sf))


_MISSING = f"""WITH n AS ({sql_inside(SQL_POINTS, MAIN)}), w AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey IN (SELECT id FROM n)),
  m AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey IN (SELECT id FROM w) AND l_partkey NOT IN (SELECT id FROM n))"""


@query(f"{_MISSING} SELECT id FROM m")
def way_missing_nodes(spark, sf):
    refs, n = way_refs(spark, sf), stage(pip_include(spark, sf), "q-nodes")
    return extract.missing_nodes(refs, extract.select_ways(refs, n), n)


@query(f"{_MISSING} SELECT id FROM n UNION SELECT id FROM m WHERE id IN (SELECT p_partkey FROM part)")
def node_completion(spark, sf):
    refs, n = way_refs(spark, sf), stage(pip_include(spark, sf), "q-nodes")
    missing = extract.missing_nodes(refs, extract.select_ways(refs, n), n)
    return idset.union(n, idset.members(points(spark, sf).select("id"), missing, "id"))


@query(f"{sql_cut(MAIN)} SELECT id FROM seeds")
def relation_seed(spark, sf):
    ways = way_select(spark, sf)
    return extract.seed_relations(extract.relation_members(relations_of(spark, sf)), extract.typed(ways, "way"))


@query(f"{sql_cut(MAIN)} SELECT id FROM r")
def relation_ancestors(spark, sf):
    members = extract.relation_members(relations_of(spark, sf))
    return closure.ancestors(extract.seed_relations(members, extract.typed(way_select(spark, sf), "way")), extract.relation_links(members))


@query(f"{sql_cut(MAIN)} SELECT rel_id, type, ref, role FROM kept")
def relation_member_filter(spark, sf):
    out = extract.cut_complete(map_of(spark, sf), MAIN)
    return extract.relation_members(out.relations).select("rel_id", "type", "ref", "role")


def tagged(out: Elements) -> DataFrame:
    """One row an element: kind, id, refs (text of its ordered list)."""
    none = F.lit("")
    refs = F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",")
    members = F.array_join(F.array_sort(F.transform("members", lambda m: F.concat_ws("/", m["type"], m["ref"].cast("string"), m["role"]))), ",")
    return out.nodes.select(F.lit("node").alias("kind"), "id", none.alias("refs")).unionByName(
        out.ways.select(F.lit("way").alias("kind"), "id", refs.alias("refs"))).unionByName(
        out.relations.select(F.lit("relation").alias("kind"), "id", members.alias("refs")))


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
SQL_CUT_COMPLETE = f"""{sql_cut(MAIN)}
  SELECT 'node' AS kind, id, '' AS refs FROM n
  UNION ALL SELECT 'way', l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY {_ORDER}) FROM lineitem WHERE l_orderkey IN (SELECT id FROM w) GROUP BY l_orderkey
  UNION ALL SELECT 'relation', rel_id, string_agg(type || '/' || ref || '/' || role, ',' ORDER BY type || '/' || ref || '/' || role) FROM kept GROUP BY rel_id"""


@query(SQL_CUT_COMPLETE)
def cut_complete(spark, sf):
    return tagged(extract.cut(map_of(spark, sf), MAIN))


_SIMPLE = f"""WITH RECURSIVE n AS ({sql_inside(SQL_POINTS, MAIN)}),
  wr AS (SELECT l_orderkey AS id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY {_ORDER}) AS refs FROM lineitem WHERE l_partkey IN (SELECT id FROM n)
    AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey),
  mem AS ({SQL_MEMBERS}),
  r AS (SELECT DISTINCT rel_id AS id FROM mem WHERE type = 'way' AND ref IN (SELECT id FROM wr)
    UNION SELECT rel_id FROM mem JOIN r ON mem.type = 'relation' AND mem.ref = r.id AND mem.ref < mem.rel_id),
  kept AS (SELECT rel_id, type, ref, role FROM mem WHERE (type = 'way' AND ref IN (SELECT id FROM wr))
    OR (type = 'relation' AND ref < rel_id AND ref IN (SELECT id FROM r)))"""


@query(f"{_SIMPLE} SELECT id, refs FROM wr")
def way_filter_simple(spark, sf):
    ways = extract.trim_ways(map_of(spark, sf).ways, pip_include(spark, sf))
    return ways.select("id", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("refs"))


@query(f"{_SIMPLE} SELECT rel_id, type, ref, role FROM kept")
def relation_filter_simple(spark, sf):
    out = extract.cut_simple(map_of(spark, sf), MAIN)
    return extract.relation_members(out.relations).select("rel_id", "type", "ref", "role")


@query(f"{_SIMPLE} SELECT id FROM r")
def relation_ordered_closure(spark, sf):
    members = extract.relation_members(relations_of(spark, sf))
    links = extract.relation_links(members).select("child", "parent", F.col("child").alias("child_pos"), F.col("parent").alias("parent_pos"))
    return closure.ordered_ancestors(extract.seed_relations(members, extract.typed(way_select(spark, sf), "way")), links)


@query(f"""{_SIMPLE} SELECT 'node' AS kind, id, '' AS refs FROM n UNION ALL SELECT 'way', id, refs FROM wr
  UNION ALL SELECT 'relation', rel_id, string_agg(type || '/' || ref || '/' || role, ',' ORDER BY type || '/' || ref || '/' || role) FROM kept GROUP BY rel_id""")
def cut_simple(spark, sf):
    return tagged(extract.cut(map_of(spark, sf), MAIN, mode="simple"))


@query("SELECT CAST(CASE WHEN l_partkey > 0 THEN 1 + (l_partkey - 1) // 32768 ELSE (l_partkey // 32768) END AS BIGINT) AS bucket, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def idset_bitmap(spark, sf):
    return idset.bitmap_counts(idset.bitmap(read(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def idset_member(spark, sf):
    chosen = read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return idset.bitmap_members(points(spark, sf).select("id"), idset.bitmap(chosen))


@query("SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size < 10")
def idset_union(spark, sf):
    a = read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return idset.union(idset.id_set(a, "id"), idset.id_set(points(spark, sf).where("x < 10"), "id"))


@query(f"SELECT id FROM ({sql_inside(SQL_POINTS, HOLE[:1])}) WHERE id NOT IN ({sql_inside(SQL_POINTS, (P.include(*HOLE[1].ring),))})")
def include_minus_exclude(spark, sf):
    inc, exc = (P.inside(points(spark, sf), (p,)).select("id") for p in (HOLE[0], P.include(*HOLE[1].ring)))
    return idset.non_members(inc, exc, "id")


_NUM = "regexp_replace(regexp_replace(CAST(CAST({0} AS DECIMAL(38,12)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
_ESC = """replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


@query(f"""SELECT p_partkey AS id, chr(10) || '  <node id="' || p_partkey || '" lat="' || {_NUM.format('(p_retailprice - 900.0::DOUBLE)')} || '" lon="' || {_NUM.format('p_size::DOUBLE')} || '">'
  || chr(10) || '    <tag k="name" v="' || {_ESC.format('p_name')} || '"/>' || chr(10) || '    <tag k="brand" v="' || {_ESC.format('p_brand')} || '"/>' || chr(10) || '  </node>' AS value FROM part""")
def render_node_xml(spark, sf):
    return sinks.render_nodes(map_of(spark, sf).nodes)


@query(f"""SELECT o_orderkey AS id, chr(10) || '  <way id="' || o_orderkey || '">' || coalesce(string_agg(chr(10) || '    <nd ref="' || l_partkey || '"/>', '' ORDER BY {_ORDER}), '')
  || chr(10) || '    <tag k="status" v="' || min(o_orderstatus) || '"/>' || chr(10) || '  </way>' AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def render_way_xml(spark, sf):
    return sinks.render_ways(map_of(spark, sf).ways)


@query(f"""WITH mem AS ({SQL_MEMBERS}) SELECT rel_id AS id, chr(10) || '  <relation id="' || rel_id || '">' ||
  string_agg(chr(10) || '    <member type="' || type || '" ref="' || ref || '" role="' || {_ESC.format('role')} || '"/>', '' ORDER BY type, ref, role) || chr(10) || '  </relation>' AS value FROM mem GROUP BY rel_id""")
def render_relation_xml(spark, sf):
    return sinks.render_relations(relations_of(spark, sf))


def _written(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "map-xml")
    sinks.write_osm(map_of(spark, sf), path)
    return path


@query("""SELECT 'node' AS kind, p_partkey AS id, p_name || '|' || p_brand AS data, p_size::DOUBLE AS x, round(p_retailprice - 900.0::DOUBLE, 6) AS y FROM part
  UNION ALL SELECT 'way', o_orderkey, o_orderstatus, NULL, NULL FROM orders""")
def read_osm_xml(spark, sf):
    m = osm_xml.read_osm_xml(spark, _written(spark, sf), once=True)
    data = F.array_join(F.transform("tags", lambda t: t["v"]), "|").alias("data")
    null = F.lit(None).cast("double")
    return m.nodes.select(F.lit("node").alias("kind"), "id", data, "x", F.round("y", 6).alias("y")).unionByName(
        m.ways.select(F.lit("way").alias("kind"), "id", data, null.alias("x"), null.alias("y")))


@query(SQL_CUT_COMPLETE)
def xml_roundtrip(spark, sf):
    """The extract of a map that was written as XML and read again."""
    return tagged(extract.cut(osm_xml.read_osm_xml(spark, _written(spark, sf)), MAIN))


@query("""SELECT c_nationkey AS nation, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS INTEGER) AS poly_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'exclude' ELSE 'include' END AS kind,
    CAST(row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey, c_acctbal) - 1 AS INTEGER) AS pos, CAST(c_custkey AS DOUBLE) AS x, c_acctbal AS y FROM customer""")
def read_poly(spark, sf):
    """A polygon file for each nation, a section for each market segment, parsed again."""
    own = read(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_acctbal"))).alias("p"))
    lines = F.array_join(F.transform("p", lambda p: F.concat(F.lit("\t"), p["c_custkey"].cast("string"), F.lit("   "), p["c_acctbal"].cast("string"))), "\n")
    section = F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "!").otherwise(""), F.size("p").cast("string"), F.lit("\n"), lines, F.lit("\nEND\n")).alias("text")
    texts = own.select("c_nationkey", F.struct("c_mktsegment", section).alias("s")).groupBy("c_nationkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    files = texts.select(F.col("c_nationkey").cast("string").alias("path"), F.concat(F.lit("nation\n"), F.array_join(F.transform("s", lambda x: x["text"]), ""), F.lit("END\nnot read\n")).alias("value"))
    rings = osm_xml.parse_poly(files)
    return rings.select(F.col("path").cast("int").alias("nation"), "poly_id", "kind", F.posexplode("ring").alias("pos", "p")).select("nation", "poly_id", "kind", "pos", "p.x", "p.y")


@query(f"SELECT doc_id, {_ESC.format('text')} AS attribute, replace(replace(replace(text, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;') AS content FROM documents")
def xml_escape(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.escape_attribute(F.col("text")).alias("attribute"), X.escape_text(F.col("text")).alias("content"))


@query("SELECT doc_id, text AS decoded FROM documents")
def entity_decode(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.decode_entities(X.escape_attribute(F.col("text"))).alias("decoded"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, TRY_CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) AS a, TRY_CAST(l_returnflag AS DOUBLE) AS b, l_linenumber::DOUBLE AS c FROM lineitem")
def number_parse(spark, sf):
    li = read(spark, sf, "lineitem")
    num = lambda c: X.to_number(F.concat(F.lit(" "), F.col(c).cast("string")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", num("l_quantity").alias("a"), num("l_returnflag").alias("b"), num("l_linenumber").alias("c"))


@query("SELECT o_orderkey, sha256('=' || o_orderkey || chr(31) || '=' || o_orderstatus || chr(31) || '-') AS digest FROM orders")
def row_digest(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", X.row_digest(F.col("o_orderkey"), F.col("o_orderstatus"), F.lit(None)).alias("digest"))


ORDER_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="order"><xs:complexType><xs:sequence>
  <xs:element name="status" type="xs:string"/><xs:element name="line" minOccurs="0" maxOccurs="unbounded"><xs:complexType><xs:sequence>
  <xs:element name="part" type="xs:integer"/><xs:element name="flag" type="xs:string"/></xs:sequence></xs:complexType></xs:element></xs:sequence>
  <xs:attribute name="key" type="xs:integer" use="required"/></xs:complexType></xs:element></xs:schema>"""


def order_xml(spark: SparkSession, sf: str) -> DataFrame:
    """id, xml: each order with its lines as a document."""
    # Lines that were broadcast would leave all documents to the tasks that read orders, one for a small file.
    line = F.struct("l_partkey", "l_returnflag", "l_linenumber")
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    text = F.transform("l", lambda r: F.concat(F.lit("<line><part>"), r["l_partkey"].cast("string"), F.lit("</part><flag>"), r["l_returnflag"], F.lit("</flag></line>")))
    return orders.join(lines.hint("merge"), orders["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit('<order key="'), F.col("o_orderkey").cast("string"), F.lit('"><status>'), "o_orderstatus", F.lit("</status>"),
                                                  F.coalesce(F.array_join(text, ""), F.lit("")), F.lit("</order>")).alias("xml"))


@query("""SELECT o_orderkey AS id, o_orderkey AS key, o_orderstatus AS status, count(l_partkey) AS n, coalesce(sum(l_partkey), 0)::BIGINT AS parts, NULL::VARCHAR AS fault
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def xsd_typed_scan(spark, sf):
    rows = xsd.scan(order_xml(spark, sf), xsd.compile_xsd(ORDER_XSD), "order")
    parts = F.aggregate(F.coalesce("value.line.part", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("id", F.col("value._key").alias("key"), F.col("value.status").alias("status"),
                       F.coalesce(F.size("value.line"), F.lit(0)).cast("long").alias("n"), parts.alias("parts"), "fault")


FAULTS_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:o" xmlns="urn:o">
  <xs:complexType name="Base"><xs:sequence><xs:element name="key" type="xs:integer"/></xs:sequence></xs:complexType>
  <xs:complexType name="More"><xs:complexContent><xs:extension base="Base"><xs:sequence><xs:element name="extra" type="xs:string"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
  <xs:element name="mark" type="xs:string"/><xs:element name="red" type="xs:string" substitutionGroup="mark"/><xs:element name="dark" type="xs:string" substitutionGroup="red"/>
  <xs:element name="order"><xs:complexType><xs:sequence><xs:element name="head" type="Base" nillable="true"/>
  <xs:choice><xs:element name="open" type="xs:string"/><xs:element name="done" type="xs:string"/></xs:choice><xs:element ref="mark" minOccurs="0"/>
  <xs:any namespace="##other" minOccurs="0"/></xs:sequence><xs:attribute name="k" type="xs:string"/></xs:complexType></xs:element></xs:schema>"""

# A document's content by the order's key modulo their number, and its fault.
_HEAD = "<head><key>{k}</key></head>"
FAULT_CASES = (
    (f'<order k="1">{_HEAD}<open>a</open></order>', None),
    (f"<order>{_HEAD}<open>a</open><done>b</done></order>", "wrong content of order: head open done"),
    (f"<order><open>a</open>{_HEAD}</order>", "wrong content of order: open head"),
    (f"<order>{_HEAD}<done>b</done><odd/></order>", "unexpected order/odd"),
    (f'<order j="1">{_HEAD}<open>a</open></order>', "unexpected order/@j"),
    ('<order xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><head xsi:type="More"><key>{k}</key><extra>x</extra></head><open/></order>', None),
    ('<order xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><head xsi:type="Other"><key>{k}</key></head><open/></order>', "wrong type Other of order/head"),
    ('<order xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><head xsi:nil="true"/><open/></order>', None),
    (f'<order>{_HEAD}<open/><dark>m</dark><w:any xmlns:w="urn:w"><w:x/></w:any></order>', None),
    (f'<o:order xmlns:o="urn:o">{_HEAD.replace("<", "<o:").replace("<o:/", "</o:")}<o:open/><o:any/></o:order>', "unexpected order/any"),
    ("<other/>", "unexpected root other"),
    (f"<order>{_HEAD}text<open/></order>", "unexpected text in order"),
)


def _sql_text(text: str | None) -> str:
    return "NULL::VARCHAR" if text is None else "'" + text.replace("'", "''") + "'"


@query(f"SELECT o_orderkey AS id, CASE o_orderkey % {len(FAULT_CASES)} {' '.join(f'WHEN {i} THEN {_sql_text(t)}' for i, (_, t) in enumerate(FAULT_CASES))} END AS fault FROM orders")
def xsd_faults(spark, sf):
    """Order, exclusive choices, unexpected content, wildcards, substitutes of substitutes, derived types, nil and namespaces."""
    rules = xsd.compile_xsd(FAULTS_XSD).rules
    key = F.col("o_orderkey")
    text = F.element_at(F.array(*[F.lit(t) for t, _ in FAULT_CASES]), (key % len(FAULT_CASES) + 1).cast("int"))
    rows = read(spark, sf, "orders").select(key.alias("id"), F.replace(text, F.lit("{k}"), key.cast("string")).alias("xml"))
    return rows.select("id", xsd_rules.first_fault(F.col("xml"), rules, "order").alias("fault"))


LINES_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="order"><xs:complexType><xs:choice minOccurs="0" maxOccurs="unbounded">
  <xs:sequence><xs:element name="A" type="xs:string" minOccurs="0" maxOccurs="2"/><xs:element name="N" type="xs:string" maxOccurs="unbounded"/></xs:sequence>
  <xs:element name="R" type="xs:string" minOccurs="2" maxOccurs="3"/></xs:choice></xs:complexType></xs:element></xs:schema>"""


@query("""WITH d AS (SELECT o_orderkey AS id, coalesce(string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag), '') AS w
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
  SELECT id, CASE WHEN regexp_full_match(replace(w, ' ', ''), '(A{0,2}N+|R{2,3})*') THEN NULL ELSE 'wrong content of order: ' || w END AS fault FROM d""")
def xsd_content_models(spark, sf):
    """Nested and counted groups over documents made from the lines of each order."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("l"))
    tags = F.array_join(F.transform("l", lambda x: F.concat(F.lit("<"), x["l_returnflag"], F.lit("/>"))), "")
    rows = read(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    xml = rows.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("<order>"), F.coalesce(tags, F.lit("")), F.lit("</order>")).alias("xml"))
    return xml.select("id", xsd_rules.first_fault(F.col("xml"), xsd.compile_xsd(LINES_XSD).rules, "order").alias("fault"))


@query("SELECT o_orderkey AS id, 'O' || o_orderstatus || repeat('.', CAST(count(l_partkey) AS INT)) AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus")
def sax_fold(spark, sf):
    """A function folded over each document's events: the status, and a dot a line."""
    def step(state: str, event: tuple) -> str:
        if event[1] == "startElement":
            return state + {"order": "O", "line": "."}.get(event[3], "")
        return state + event[6] if event[1] == "characters" and len(state) == 1 else state

    return XML.fold_events(order_xml(spark, sf), step, str, "string")


@query(f"""{sql_cut(MAIN).replace(sql_inside(SQL_POINTS, MAIN), f"SELECT id FROM ({SQL_POINTS}) WHERE x * x + y < 500")} SELECT 'node' AS kind, id FROM n UNION ALL SELECT 'way', id FROM w
  UNION ALL SELECT 'relation', rel_id FROM (SELECT DISTINCT rel_id FROM kept)""")
def cut_predicate(spark, sf):
    """An extract by a predicate of x and y instead of polygons."""
    out = extract.cut(map_of(spark, sf), lambda x, y: x * x + y < 500)
    return tagged(out).select("kind", "id")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def xsd_typed_write(spark, sf):
    """Typed values written as XML and read again."""
    model = xsd.compile_xsd(ORDER_XSD)
    rows = xsd.scan(order_xml(spark, sf), model, "order")
    again = xsd.scan(rows.select("id", xsd.write(rows, model, "order").alias("xml")), model, "order")
    return again.select("id", F.col("value.status").alias("status"), F.coalesce(F.size("value.line"), F.lit(0)).cast("long").alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def xml_group_count(spark, sf):
    rows = xsd.scan(order_xml(spark, sf), xsd.compile_xsd(ORDER_XSD), "order")
    return rows.groupBy(F.col("value.status").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS id, printf('%.2f', round(avg(l_linenumber), 2)) AS average FROM lineitem GROUP BY 1")
def xml_average(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(XML.precise(F.avg("l_linenumber"), 2).alias("average"))


@query("SELECT o_orderkey AS id, count(l_partkey) FILTER (l_returnflag = 'R') AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def xpath_select(spark, sf):
    return order_xml(spark, sf).select("id", F.size(XML.select_path(F.col("xml"), "//flag[. = 'R']/text()")).cast("long").alias("n"))


@query("""SELECT o_orderkey AS id, 1 AS depth, 'order' AS name, NULL::VARCHAR AS text FROM orders UNION ALL SELECT o_orderkey, 2, 'status', o_orderstatus FROM orders
  UNION ALL SELECT l_orderkey, 2, 'line', NULL FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT l_orderkey, 3, 'part', CAST(l_partkey AS VARCHAR) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT l_orderkey, 3, 'flag', l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def xml_simple_form(spark, sf):
    return XML.simple_form(XML.sax_events(order_xml(spark, sf))).select("id", F.col("depth").cast("int").alias("depth"), "name", "text")


@query("""SELECT event, sum(n)::BIGINT AS n FROM (SELECT 'startDocument' AS event, count(*) AS n FROM orders UNION ALL SELECT 'endDocument', count(*) FROM orders
  UNION ALL SELECT e, 2 * count(*) FROM orders, (VALUES ('startElement'), ('endElement')) AS v(e) GROUP BY e UNION ALL SELECT 'characters', count(*) FROM orders
  UNION ALL SELECT e, 3 * count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey, (VALUES ('startElement'), ('endElement')) AS v(e) GROUP BY e
  UNION ALL SELECT 'characters', 2 * count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY event""")
def xml_sax_events(spark, sf):
    return XML.sax_events(order_xml(spark, sf)).groupBy("event").agg(F.count("*").alias("n"))


# Lines of each order's document, in its order; b is the place of a line's start among the document's events.
_SQL_TREE = """WITH l AS (SELECT o_orderkey AS id, l_partkey::VARCHAR AS p, l_returnflag AS f, CAST(8 * row_number() OVER (PARTITION BY o_orderkey ORDER BY l_partkey, l_returnflag, l_linenumber) - 3 AS INTEGER) AS b
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey), r AS (SELECT id, min(b) AS first, max(b) AS last FROM l WHERE f = 'R' GROUP BY id)"""


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return trees.label(XML.sax_events(order_xml(spark, sf)))


@query(f"""{_SQL_TREE} SELECT o_orderkey AS id, 'element' AS kind, 1 AS pre, CAST(5 + 8 * (SELECT count(*) FROM l WHERE l.id = o_orderkey) AS INTEGER) AS post, 1 AS level, NULL::INTEGER AS parent, 'order' AS name, NULL::VARCHAR AS text FROM orders
  UNION ALL SELECT o_orderkey, 'element', 2, 4, 2, 1, 'status', NULL FROM orders UNION ALL SELECT o_orderkey, 'text', 3, 3, 3, 2, NULL, o_orderstatus FROM orders
  UNION ALL SELECT id, 'element', b, b + 7, 2, 1, 'line', NULL FROM l UNION ALL SELECT id, 'element', b + 1, b + 3, 3, b, 'part', NULL FROM l UNION ALL SELECT id, 'text', b + 2, b + 2, 4, b + 1, NULL, p FROM l
  UNION ALL SELECT id, 'element', b + 4, b + 6, 3, b, 'flag', NULL FROM l UNION ALL SELECT id, 'text', b + 5, b + 5, 4, b + 4, NULL, f FROM l""")
def tree_labels(spark, sf):
    """Elements and texts of each order's document as intervals."""
    return _tree(spark, sf).select("id", "kind", "pre", "post", "level", "parent", "name", "text")


@query(f"""{_SQL_TREE} SELECT 'second' AS path, id, b + 1 AS pre FROM l WHERE b = 13
  UNION ALL SELECT 'after', l.id, b + 1 FROM l JOIN r ON l.id = r.id AND b > first UNION ALL SELECT 'before', l.id, b + 1 FROM l JOIN r ON l.id = r.id AND b < last
  UNION ALL SELECT 'round', id, b FROM l WHERE f = 'R' UNION ALL SELECT 'round', id, 1 FROM r""")
def tree_steps(spark, sf):
    """/order/line[2]/part, //line[flag = 'R']/following-sibling::line/part, //line[flag = 'R'][last()]/preceding::part and //flag[. = 'R']/ancestor::*."""
    def found(tree: paths.Nodes) -> dict[str, np.ndarray]:
        lines, parts, flags = (tree.elements(n) for n in ("line", "part", "flag"))
        flags = tree.having(flags, tree.texts("R"), "child")
        returned = tree.having(lines, flags, "child")
        order = tree.elements("order") & tree.roots()
        return {
            "second": tree.step(tree.nth(tree.step(order, lines, "child"), 2), parts, "child"),
            "after": tree.step(tree.step(returned, lines, "following-sibling"), parts, "child"),
            "before": tree.step(tree.nth(returned, -1), parts, "preceding"),
            "round": tree.step(flags, tree.elements(), "ancestor"),
        }

    return paths.select(order_xml(spark, sf), found).select("path", "id", "pre")


@query(f"""{_SQL_TREE} SELECT o_orderkey AS id, 'order' AS name, 1 AS pre, o_orderstatus || coalesce((SELECT string_agg(p || f, '' ORDER BY b) FROM l WHERE l.id = o_orderkey), '') AS value FROM orders
  UNION ALL SELECT id, 'line', b, p || f FROM l""")
def tree_string_values(spark, sf):
    """All text inside each order and line."""
    nodes = _tree(spark, sf)
    return trees.string_values(nodes.where("name IN ('order', 'line')"), nodes).select("id", "name", "pre", "value")


_PRIORITIES = {"1": ("xs:int", "bigint"), "5": ("xs:boolean", "boolean")}  # other priorities: repeated text


@query("""SELECT DISTINCT 'order' || o_orderstatus AS element, 'p' || left(o_orderpriority, 1) AS name,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'bigint' WHEN '5' THEN 'boolean' ELSE 'array<string>' END AS type FROM orders""")
def schema_merge(spark, sf):
    """A schema for each status of orders, with a field for each priority they have, merged into one model."""
    groups = read(spark, sf, "orders").select("o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p")).groupBy("o_orderstatus").agg(F.array_sort(F.collect_set("p")).alias("p"))
    models = []
    for status, priorities in groups.collect():  # a row a status
        fields = "".join(f'<xs:element name="p{p}" type="{_PRIORITIES[p][0]}"/>' if p in _PRIORITIES else f'<xs:element name="p{p}" type="xs:string" maxOccurs="unbounded"/>' for p in priorities)
        models.append(xsd.compile_xsd(f'<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="order{status}"><xs:complexType><xs:sequence>{fields}</xs:sequence></xs:complexType></xs:element></xs:schema>'))
    model = reduce(lambda one, two: one.merge(two), models, xsd.Model())
    return spark.createDataFrame([(e, f.name, f.dataType.simpleString()) for e in model.elements for f in model.schema(e).fields], "element string, name string, type string")


_PARENTS = "SELECT c_custkey AS child, c_custkey // 10 AS parent FROM customer WHERE c_custkey >= 10"


def _parents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").where("c_custkey >= 10").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 10").alias("parent"))


@query(f"WITH RECURSIVE l AS ({_PARENTS}), t AS (SELECT child, parent AS ancestor FROM l UNION SELECT t.child, l.parent FROM t JOIN l ON t.ancestor = l.child) SELECT child, ancestor FROM t")
def type_ancestors(spark, sf):
    return closure.type_ancestors(_parents(spark, sf))


@query(f"""WITH RECURSIVE l AS ({_PARENTS} UNION ALL SELECT n_nationkey, n_regionkey + 1000000 FROM nation UNION ALL SELECT n_regionkey + 1000000, min(n_nationkey) FROM nation GROUP BY 1),
  t AS (SELECT child, parent FROM l UNION SELECT t.child, l.parent FROM t JOIN l ON t.parent = l.child) SELECT DISTINCT child AS id FROM t WHERE child = parent""")
def find_cycles(spark, sf):
    nation = read(spark, sf, "nation")
    region = (F.col("n_regionkey") + F.lit(1000000)).cast("long")
    links = _parents(spark, sf).unionByName(nation.select(F.col("n_nationkey").cast("long").alias("child"), region.alias("parent"))).unionByName(
        nation.groupBy(region.alias("child")).agg(F.min("n_nationkey").cast("long").alias("parent")))
    return closure.find_cycles(links)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b ELSE least(a, b) END AS low, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE a * b END AS product
  FROM (SELECT *, nullif(l_linenumber, 3)::BIGINT AS a, nullif(l_partkey % 5, 4)::BIGINT AS b FROM lineitem)""")
def occurrence_arith(spark, sf):
    li = read(spark, sf, "lineitem")
    a, b = F.expr("nullif(l_linenumber, 3)").cast("long"), F.expr("nullif(l_partkey % 5, 4)").cast("long")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", X.min_occurs(a, b).alias("low"), X.multiply_occurs(a, b).alias("product"))


@query("""SELECT p_partkey AS id, p_brand AS local, CASE WHEN p_size % 2 = 0 THEN 'p' || p_size ELSE '' END AS prefix,
  CASE WHEN p_size % 2 = 0 THEN '{p' || p_size || '}' || p_brand ELSE p_brand END AS expanded FROM part""")
def name_split(spark, sf):
    prefix = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("p"), F.col("p_size").cast("string"), F.lit(":"))).otherwise("")
    name = F.concat(prefix, "p_brand")
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.local_name(name).alias("local"), X.name_prefix(name).alias("prefix"))
    return rows.withColumn("expanded", X.expanded_name(F.col("prefix"), F.col("local")))


@query("""SELECT doc_id, ['utf-8', 'utf-16be', 'utf-16le', 'iso-8859-1', 'utf-8'][CAST(doc_id % 5 AS INT) + 1] AS encoding FROM documents""")
def encoding_detect(spark, sf):
    xml = F.concat(F.lit('<?xml version="1.0"?><d>'), X.escape_text(F.col("text")), F.lit("</d>"))
    latin = F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?><d>'), X.escape_text(F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?")), F.lit("</d>"))
    n = F.col("doc_id") % 5
    content = (F.when(n == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(xml, "UTF-8"))).when(n == 1, F.encode(xml, "UTF-16BE"))
               .when(n == 2, F.encode(xml, "UTF-16LE")).when(n == 3, F.encode(latin, "ISO-8859-1")).otherwise(F.encode(xml, "UTF-8")))
    return read(spark, sf, "documents").select("doc_id", X.detect_encoding(content).alias("encoding"))


@query("SELECT doc_id, text AS utf8, text AS utf16, regexp_full_match(text, '[\\x00-\\x7F]*') AS ascii, regexp_full_match(text, '[\\x{00}-\\x{FF}]*') AS latin1 FROM documents")
def codecs(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.decode(F.encode(t, "UTF-8"), "UTF-8").alias("utf8"), F.decode(F.encode(t, "UTF-16LE"), "UTF-16LE").alias("utf16"),
                                               X.is_ascii(t).alias("ascii"), X.is_latin1(t).alias("latin1"))


@query(sql_inside(SQL_POINTS, MAIN))
def stream_nodes(spark, sf):
    """The node filter as a stream over the part files, read back as a table."""
    source, out, checkpoint = (new_path(spark, f"stream-{n}") for n in ("in", "out", "checkpoint"))
    part = read(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    part.write.parquet(source)
    rows = streams.stream_points(spark, source, part.schema)
    rows = rows.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - F.lit(900.0)).alias("y"))
    streams.stream_inside(rows, MAIN, out, checkpoint).awaitTermination()
    return spark.read.schema("id long, x double, y double").parquet(out).select("id")


@query(f"{sql_cut(MAIN)} SELECT 'node' AS kind, id FROM n UNION ALL SELECT 'way', id FROM w")
def stream_extract(spark, sf):
    """Nodes and ways arrive in micro-batches of some files each; the keyed states give what the batch extract gives."""
    base = new_path(spark, "stream-extract")
    elements = map_of(spark, sf)
    parts = {"nodes": elements.nodes.select("id", "x", "y"), "ways": elements.ways.select("id", "nodes")}
    arriving = {}
    for name, df in parts.items():
        df.repartition(6).write.parquet(f"{base}/{name}")
        arriving[name] = streams.stream_points(spark, f"{base}/{name}", df.schema, max_files=2)
    stream_states.start_cut(arriving["nodes"], arriving["ways"], MAIN, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("kind string, id long").parquet(f"{base}/out")
