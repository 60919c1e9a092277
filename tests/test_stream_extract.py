"""The stateful extract against the batch one, over shuffled micro-batches and a restart."""

import random

from geosift.operators import polygon as P
from geosift.streaming import extract as S
from geosift.streaming.nodes import stream_points

AREA = (P.include((0, 0), (10, 0), (10, 10), (0, 10)), P.exclude((4, 4), (6, 4), (6, 6), (4, 6)))


def plain(nodes, ways):
    inside = {i for i, x, y in nodes if x is not None and 0 <= x <= 10 and 0 <= y <= 10 and not (4 <= x <= 6 and 4 <= y <= 6)}
    selected = {w: refs for w, refs in ways if refs and inside & set(refs)}
    known = {i for i, _, _ in nodes}
    return {("way", w) for w in selected} | {("node", i) for i in inside} | {("node", r) for refs in selected.values() for r in refs if r in known}


def test_any_order_gives_the_batch_extract(spark, tmp_path):
    rng = random.Random(6)
    nodes = [(i, None if i == 3 else float(rng.randint(-5, 25)), float(rng.randint(-5, 25))) for i in range(80)]
    ways = [(i, [rng.randint(0, 99) for _ in range(rng.randint(0, 4))]) for i in range(60)] + [(60, None), (61, [5, None, 5])]
    parts = [("nodes", nodes[k::4]) for k in range(4)] + [("ways", ways[k::4]) for k in range(4)]
    rng.shuffle(parts)
    schemas = {"nodes": "id long, x double, y double", "ways": "id long, nodes array<long>"}
    streams = {}
    for kind, schema in schemas.items():
        (tmp_path / kind).mkdir()
        streams[kind] = stream_points(spark, str(tmp_path / kind), spark.createDataFrame([], schema).schema, max_files=1)
    shown = []
    for half in (parts[:5], parts[5:]):  # the second half comes after a restart
        for kind, rows in half:
            spark.createDataFrame(rows, schemas[kind]).coalesce(1).write.mode("append").parquet(str(tmp_path / kind))
        S.start_cut(streams["nodes"], streams["ways"], AREA, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        shown = [tuple(r) for r in spark.read.schema("kind string, id long").parquet(str(tmp_path / "out")).collect()]
    assert len(shown) == len(set(shown))
    assert set(shown) == plain(nodes, ways)
    assert any(k == "way" for k, _ in shown)


def test_states_are_kept_by_block_and_the_first_row_counts(spark, tmp_path):
    schemas = {"nodes": "id long, x double, y double", "ways": "id long, nodes array<long>"}
    streams = {}
    for kind, schema in schemas.items():
        (tmp_path / kind).mkdir()
        streams[kind] = stream_points(spark, str(tmp_path / kind), spark.createDataFrame([], schema).schema, max_files=1)
    first = {"ways": [(-7, [2**60 + 1, 8]), (3000, [2**60 + 5])], "nodes": [(i, 50.0, 5.0) for i in range(3000)] + [(2**60 + 1, 1.0, 1.0)]}
    again = {"ways": [(4000, [9])], "nodes": [(7, 1.0, 1.0), (2**60 + 5, 50.0, 5.0)]}  # node 7 came outside before
    for batch in (first, again):
        for kind, rows in batch.items():
            spark.createDataFrame(rows, schemas[kind]).coalesce(1).write.mode("append").parquet(str(tmp_path / kind))
        query = S.start_cut(streams["nodes"], streams["ways"], AREA, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        kept = [o["numRowsTotal"] for o in query.lastProgress["stateOperators"]]
        assert max(kept) < 50  # a row a block, not one an id
    shown = {tuple(r) for r in spark.read.schema("kind string, id long").parquet(str(tmp_path / "out")).collect()}
    assert shown == {("way", -7), ("node", 2**60 + 1), ("node", 8)}
