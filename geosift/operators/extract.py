"""The extract: what of a map lies in a polygon, in two modes.

complete: nodes inside; ways with a node inside, whole; the other nodes of these ways; relations with a
direct member selected so far, and all their ancestors; members outside the extract are dropped.
simple: nodes inside; ways and relations trimmed to what is selected; a relation counts for another one only
if it stands before it in the file.

Selection runs on narrow id tables; whole elements are fetched by semi-joins at the end. The join with
relations' members is on (type, ref), so an unknown member type is in no set.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosift.operators import idset
from geosift.operators.closure import ancestors, ordered_ancestors
from geosift.operators.polygon import Polygon, inside
from geosift.operators.spatial import inside_areas
from geosift.schema import Elements
from geosift.staging import stage


#: An area: polygons, a polygon table of any size, or the predicate itself, as a column of x and y or a function that makes one of them.
Area = Sequence[Polygon] | DataFrame | Column | Callable[[Column, Column], Column]


def nodes_inside(nodes: DataFrame, area: Area) -> DataFrame:
    """id of the nodes (id, x, y) in the area; where the predicate is null a node is outside."""
    points = nodes.select("id", "x", "y")
    if isinstance(area, DataFrame):
        return inside_areas(points, area)
    if isinstance(area, Sequence):
        return inside(points, area).select("id").distinct()
    test = area if isinstance(area, Column) else area(F.col("x"), F.col("y"))
    return points.where(test).select("id").distinct()


def way_nodes(ways: DataFrame) -> DataFrame:
    """way_id, pos, node_id."""
    return ways.select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("pos", "node_id"))


def relation_members(relations: DataFrame) -> DataFrame:
    """rel_id, pos, type, ref, role."""
    return relations.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("pos", "m")).select("rel_id", "pos", "m.*")


def select_ways(refs: DataFrame, node_ids: DataFrame) -> DataFrame:
    """refs (way_id, node_id), node_ids (id) -> way_id of ways with a node in the set."""
    return refs.join(node_ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("way_id").distinct()


def missing_nodes(refs: DataFrame, way_ids: DataFrame, node_ids: DataFrame) -> DataFrame:
    """id of nodes that the ways refer to and that are not in the set."""
    ids = refs.join(way_ids, "way_id", "left_semi").select(F.col("node_id").alias("id")).distinct()
    return idset.non_members(ids, node_ids, "id")


def typed(ids: DataFrame, kind: str) -> DataFrame:
    """type, ref of a set of ids."""
    return ids.select(F.lit(kind).alias("type"), F.col(ids.columns[0]).alias("ref"))


def seed_relations(members: DataFrame, selected: DataFrame) -> DataFrame:
    """id of relations with a member in selected (type, ref)."""
    return members.join(selected, ["type", "ref"], "left_semi").select(F.col("rel_id").alias("id")).distinct()


def relation_links(members: DataFrame) -> DataFrame:
    """child, parent of relations that are members of relations."""
    return members.where("type = 'relation'").select(F.col("ref").alias("child"), F.col("rel_id").alias("parent"))


def trim_lists(items: DataFrame, key: str, pos: str, value, name: str) -> DataFrame:
    """Lists put together again in the order of pos."""
    lists = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), value.alias("v")))).alias("l"))
    return lists.select(key, F.transform("l", lambda e: e["v"]).alias(name))


def trim_ways(ways: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Ways with their nodes reduced to the set; ways without any are dropped."""
    kept = way_nodes(ways).join(node_ids.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    lists = trim_lists(kept, "way_id", "pos", F.col("node_id"), "nodes")
    return ways.drop("nodes").join(lists.withColumnRenamed("way_id", "id"), "id").select(*ways.columns)


def trim_relations(relations: DataFrame, kept: DataFrame) -> DataFrame:
    """Relations with their members reduced to kept (rel_id, pos, type, ref, role); those without any are dropped."""
    lists = trim_lists(kept, "rel_id", "pos", F.struct("type", "ref", "role"), "members")
    return relations.drop("members").join(lists.withColumnRenamed("rel_id", "id"), "id").select(*relations.columns)


def cut_complete(map_: Elements, area: Area) -> Elements:
    n_in = stage(nodes_inside(map_.nodes, area), "cut-nodes")
    refs = way_nodes(map_.ways.select("id", "nodes"))
    way_ids = stage(select_ways(refs, n_in), "cut-ways")
    # Only nodes that exist are completed: a reference to an absent node selects nothing.
    completed = idset.members(map_.nodes.select("id"), missing_nodes(refs, way_ids, n_in), "id").distinct()
    node_ids = stage(n_in.unionByName(completed), "cut-completed")
    members = relation_members(map_.relations.select("id", "members"))
    chosen = typed(node_ids, "node").unionByName(typed(way_ids, "way"))
    rel_ids = ancestors(seed_relations(members, chosen), relation_links(members))
    # Ancestors may be named that are not in the file; they are in no set.
    rel_ids = stage(idset.members(map_.relations.select("id"), rel_ids, "id").distinct(), "cut-relations")
    kept = members.join(rel_ids.select(F.col("id").alias("rel_id")), "rel_id", "left_semi").join(
        chosen.unionByName(typed(rel_ids, "relation")), ["type", "ref"], "left_semi")
    return Elements(idset.members(map_.nodes, node_ids, "id"), map_.ways.join(way_ids.select(F.col("way_id").alias("id")), "id", "left_semi").select(*map_.ways.columns),
                    trim_relations(map_.relations, kept), map_.root)


def cut_simple(map_: Elements, area: Area, order_col: str = "pos") -> Elements:
    """order_col of the relations is their place in the file; where it is absent their id is taken for it."""
    relations = map_.relations
    order = order_col if order_col in relations.columns else "id"
    n_in = stage(nodes_inside(map_.nodes, area), "cut-nodes")
    ways = trim_ways(map_.ways, n_in)
    members = relation_members(relations.select("id", "members"))
    chosen = typed(n_in, "node").unionByName(typed(stage(ways.select("id"), "cut-ways"), "way"))
    place = relations.select("id", F.col(order).alias("p"))
    links = relation_links(members).join(place.toDF("child", "child_pos"), "child").join(place.toDF("parent", "parent_pos"), "parent")
    rel_ids = stage(ordered_ancestors(seed_relations(members, chosen), links), "cut-relations")
    direct = members.join(chosen, ["type", "ref"], "left_semi")
    before = links.where("child_pos < parent_pos").select(F.col("child").alias("ref"), F.col("parent").alias("rel_id"), F.lit("relation").alias("type")).distinct()
    nested = members.join(before, ["rel_id", "type", "ref"], "left_semi").join(rel_ids.select(F.col("id").alias("ref")), "ref", "left_semi")
    return Elements(idset.members(map_.nodes, n_in, "id"), ways, trim_relations(relations, direct.unionByName(nested.select(*direct.columns))), map_.root)


def cut(map_: Elements, area: Area, mode: str = "complete") -> Elements:
    """The extract of a map. Empty tables are legal in any place; elements may come in any order."""
    if mode not in ("complete", "simple"):
        raise ValueError(f"mode {mode!r}: complete or simple")
    return cut_complete(map_, area) if mode == "complete" else cut_simple(map_, area)
