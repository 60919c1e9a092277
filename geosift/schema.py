"""Schemas of map elements and polygons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TAGS = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))
MEMBERS = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("ref", T.LongType()), T.StructField("role", T.StringType())]))
_META = [T.StructField("version", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("uid", T.LongType()),
         T.StructField("user", T.StringType()), T.StructField("changeset", T.LongType())]
META = [f.name for f in _META]
NODE = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), *_META, T.StructField("tags", TAGS)])
WAY = T.StructType([T.StructField("id", T.LongType()), T.StructField("nodes", T.ArrayType(T.LongType())), *_META, T.StructField("tags", TAGS)])
RELATION = T.StructType([T.StructField("id", T.LongType()), T.StructField("members", MEMBERS), *_META, T.StructField("tags", TAGS)])
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POLYGON = T.StructType([T.StructField("poly_id", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("ring", T.ArrayType(POINT))])


@dataclass
class Elements:
    """A map: nodes (NODE), ways (WAY), relations (RELATION) and the root element's attributes.

    A relation's `pos` column, where there is one, is its place in the file; simple mode needs it.
    """

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    root: dict[str, str]
