"""Map XML as text: rendering is a projection, so any writer can take the result."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosift.functions.text import escape_attribute, number_text
from geosift.schema import META, NODE, RELATION, WAY, Elements

HEADER = '<?xml version="1.0"?>'


def attribute(name: str, value: Column) -> Column:
    """' name="value"', or nothing for null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), escape_attribute(value.cast("string")), F.lit('"')), F.lit(""))


def element(tag: str, attributes: Column, children: Column, level: int = 1) -> Column:
    """A line break and indent, then the element; childless elements are closed at once. children: array of text."""
    pad = "\n" + "  " * level
    return F.concat(F.lit(f"{pad}<{tag}"), attributes, F.when(F.size(children) == 0, F.lit("/>")).otherwise(
        F.concat(F.lit(">"), F.array_join(children, ""), F.lit(f"{pad}</{tag}>"))))


def child(tag: str, attributes: Column) -> Column:
    return F.concat(F.lit(f"\n    <{tag}"), attributes, F.lit("/>"))


def _tags() -> Column:
    return F.transform("tags", lambda t: child("tag", F.concat(attribute("k", t["k"]), attribute("v", t["v"]))))


def _attributes(*own: Column) -> Column:
    return F.concat(attribute("id", F.col("id")), *own, *[attribute(c, F.col(c)) for c in META])


def _node() -> Column:
    at = [attribute("lat", number_text(F.col("y"))), attribute("lon", number_text(F.col("x")))]
    return element("node", _attributes(*at), _tags())


def _way() -> Column:
    return element("way", _attributes(), F.concat(F.transform("nodes", lambda n: child("nd", attribute("ref", n))), _tags()))


def _relation() -> Column:
    members = F.transform("members", lambda m: child("member", F.concat(attribute("type", m["type"]), attribute("ref", m["ref"]), attribute("role", m["role"]))))
    return element("relation", _attributes(), F.concat(members, _tags()))


def render_nodes(nodes: DataFrame) -> DataFrame:
    """id, value: the node's XML."""
    return nodes.select("id", _node().alias("value"))


def render_ways(ways: DataFrame) -> DataFrame:
    return ways.select("id", _way().alias("value"))


def render_relations(relations: DataFrame) -> DataFrame:
    return relations.select("id", _relation().alias("value"))


def root_tag(root: dict[str, str]) -> str:
    esc = lambda v: v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    return "<osm" + "".join(f' {k}="{esc(v)}"' for k, v in root.items()) + ">"


def render_xml(map_: Elements) -> DataFrame:
    """rank, id, value: header 0, nodes 1, ways 2, relations 3, footer 9."""
    ends = map_.nodes.sparkSession.createDataFrame([(0, None, f"{HEADER}\n{root_tag(map_.root)}"), (9, None, "\n</osm>\n")], "rank int, id long, value string")
    parts = [render_nodes(map_.nodes), render_ways(map_.ways), render_relations(map_.relations)]
    for rank, part in enumerate(parts, 1):
        ends = ends.unionByName(part.withColumn("rank", F.lit(rank)))
    return ends.select("rank", "id", "value")


def write_osm(map_: Elements, path: str, *, files: int | None = None) -> None:
    """A map as XML text files in path, ordered by rank and id over the files in name order.

    Every file is a document with the root's attributes: tasks write apart, and any of the files can be read alone.
    files: how many at most; 1 makes one document, which one task writes.
    """
    start, end = f"{HEADER}\n{root_tag(map_.root)}", "</osm>"

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda text: pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])
        empty = True
        for b in batches:
            if b.num_rows and empty:
                yield line(start)
                empty = False
            yield pa.RecordBatch.from_arrays([b.column("value").filter(b.column("body"))], names=["value"])
        if not empty:
            yield line(end)

    # Elements are dealt and sorted by range as they are, and rendered where they are written: what Spark samples and shuffles is no text.
    # The header's row (rank 0) makes a document of an empty map, too; the writer ends each line.
    rows = map_.nodes.sparkSession.createDataFrame([(0, None)], "rank int, id long")
    for rank, part in enumerate((map_.nodes.select(*NODE.fieldNames()), map_.ways.select(*WAY.fieldNames()), map_.relations.select(*RELATION.fieldNames())), 1):
        rows = rows.unionByName(part.withColumn("rank", F.lit(rank)), allowMissingColumns=True)
    keys = ("rank", "id")
    placed = rows.repartitionByRange(*([files] if files else []), *keys).sortWithinPartitions(*keys)
    xml = F.when(F.col("rank") == 1, _node()).when(F.col("rank") == 2, _way()).when(F.col("rank") == 3, _relation()).otherwise("")
    lines = placed.select(F.regexp_replace(xml, r"\A\n", "").alias("value"), (F.col("rank") > 0).alias("body"))
    lines.mapInArrow(document, "value string").write.text(path)
