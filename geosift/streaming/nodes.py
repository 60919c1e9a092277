"""Nodes as a stream: files of points arrive, those inside are appended to a table.

Only the node filter streams: completion and ancestors need the whole map, which is a batch join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from geosift.operators.polygon import Polygon, inside


def stream_points(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1000, source: str = "parquet") -> DataFrame:
    """A stream of the files in path; max_files bounds a micro-batch (back-pressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(source).load(path)


def stream_inside(points: DataFrame, polygons: Sequence[Polygon], out: str, checkpoint: str, x: str = "x", y: str = "y") -> StreamingQuery:
    """Append the points inside to Parquet files in out; each file is read once, also after a restart."""
    return (inside(points, polygons, x, y).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def stream_to(points: DataFrame, polygons: Sequence[Polygon], sink, checkpoint: str, x: str = "x", y: str = "y") -> StreamingQuery:  # noqa: ANN001
    """sink(batch, number) for each micro-batch of points inside: the pluggable sink."""
    return (inside(points, polygons, x, y).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
