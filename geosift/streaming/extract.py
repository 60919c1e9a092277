"""The complete extract of nodes and ways as a stream: elements may arrive in any order, over any number of micro-batches.

Three keyed states, one after the other in one query. By node: whether it is inside, and the ways that refer to it and
wait for the answer; a way is hit by a node inside, whichever of them comes first. By way: its references until it is hit; then it
leaves, whole and once. By node again: whether it has arrived, is inside, or is referred to by a way that has left; it leaves
once, as soon as it is both there and wanted. So a late node completes ways that left long ago, and a late way takes
nodes that had been passed over. What waits is kept in the state store (RocksDB), partitioned by key; nothing else is.

A key is a block of BLOCK neighbouring ids, whose facts are a byte an id and whose waiting references are lists of arrays: a call of
the state store costs far more than a fact, so it is made once a block and micro-batch. What a micro-batch reads
and writes is bounded by the blocks that it touches. Where ids are so sparse that a block holds one, it costs what a key an id would.

Defined results:
- the rows that leave are (kind, id): those nodes and ways that the batch extract in complete mode has, each once, also after a restart.
- an id has one node and one way: of several rows of an id that come in different batches the first counts for what it is.
- a reference to a node that never comes hits nothing and is in no result; ways without references or with null ones are allowed.
- relations are not part of it: their ancestors need all relations, which is a batch closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from geosift.operators.polygon import Polygon, pip_expr

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BITS = 10
BLOCK = 1 << BITS
PIECE = 1 << 16  # references in one entry of a list state
OUTSIDE, INSIDE, REF = 0, 1, 2  # what a row says of a node


def _block(column: str) -> Column:
    return F.shiftright(column, BITS).alias("block")


def _slots(ids: np.ndarray) -> np.ndarray:
    return (ids & (BLOCK - 1)).astype(np.uint16)


def _flags(state) -> np.ndarray:  # noqa: ANN001
    """A byte an id of the block."""
    return np.frombuffer(state.get()[0], np.uint8).copy() if state.exists() else np.zeros(BLOCK, np.uint8)


def _arrays(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class _Hits(StatefulProcessor):
    """By block of nodes: (id, fact) of nodes, (id, REF, way_id) of references -> the ways that a node inside hits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "flags binary")  # fact + 1 of nodes that have come
        self.waiting = handle.getListState("waiting", "slots binary, ways binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        seen, now = _flags(self.seen), np.zeros(BLOCK, np.uint8)
        slots, ways = [], []
        for r in rows:
            slot, fact = _slots(r["id"].to_numpy()), r["fact"].to_numpy()
            np.maximum.at(now, slot[fact != REF], (fact[fact != REF] + 1).astype(np.uint8))
            slots.append(slot[fact == REF])
            ways.append(r["way_id"].to_numpy()[fact == REF])
        now[seen > 0] = 0
        if now.any():
            seen |= now
            self.seen.update((seen.tobytes(),))
            for s, w in self.waiting.get():
                slots.append(np.frombuffer(s, np.uint16))
                ways.append(np.frombuffer(w, np.int64))
            self.waiting.clear()
        slot, way = _arrays(slots, np.uint16), _arrays(ways, np.int64)
        facts = seen[slot]
        s, w = slot[facts == 0], way[facts == 0]
        if len(s):
            self.waiting.appendList([(s[a : a + PIECE].tobytes(), w[a : a + PIECE].tobytes()) for a in range(0, len(s), PIECE)])
        hit = np.unique(way[facts == INSIDE + 1])
        if len(hit):
            yield pd.DataFrame({"way_id": hit})

    def close(self) -> None:
        pass


class _Ways(StatefulProcessor):
    """By block of ways: (way_id, hit, nodes) -> (way, id) of a way, once it is there and hit, and of its references."""

    HIT, THERE, GONE = 1, 2, 4

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("state", "flags binary")
        self.refs = handle.getListState("refs", "slots binary, sizes binary, nodes binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        flags = _flags(self.flags)
        before = flags.copy()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # slots, sizes, nodes of all of them
        for r in rows:
            slot, hit = _slots(r["way_id"].to_numpy()), r["hit"].to_numpy().astype(bool)
            flags[slot[hit]] |= self.HIT
            at = np.flatnonzero(~hit & (flags[slot] & self.THERE == 0))
            at = at[np.sort(np.unique(slot[at], return_index=True)[1])]  # the first of several rows of a way
            if len(at):
                nodes = r["nodes"].to_numpy()[at]
                held.append((slot[at], np.array([len(n) for n in nodes], np.int64), np.concatenate(nodes).astype(np.int64)))
                flags[slot[at]] |= self.THERE
        old = before & (self.HIT | self.THERE) == self.THERE  # those that waited
        rewrite = bool((old & (flags & self.HIT > 0)).any())
        if rewrite:
            held = [tuple(np.frombuffer(v, k) for v, k in zip(e, (np.uint16, np.int64, np.int64), strict=True)) for e in self.refs.get()] + held
            self.refs.clear()
        keep, ids, wanted = [], [], []
        for slot, sizes, nodes in held:
            leaves = flags[slot] & self.HIT > 0
            each = np.repeat(leaves, sizes)
            ids.append(slot[leaves].astype(np.int64) + (key[0] << BITS))
            wanted.append(nodes[each])
            flags[slot[leaves]] |= self.GONE
            if not leaves.all():
                keep.append((slot[~leaves].tobytes(), sizes[~leaves].tobytes(), nodes[~each].tobytes()))
        if keep:
            self.refs.appendList(keep)
        if (flags != before).any():
            self.flags.update((flags.tobytes(),))
        for way, found in ((True, _arrays(ids, np.int64)), (False, np.unique(_arrays(wanted, np.int64)))):
            if len(found):
                yield pd.DataFrame({"way": way, "id": found})

    def close(self) -> None:
        pass


class _Leaving(StatefulProcessor):
    """By kind and block: ways that left pass; of nodes (id, fact), the node once it is there and wanted (inside or referred to by a way that left)."""

    THERE, WANTED = 1, 2

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("state", "flags binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        if key[0]:
            for r in rows:
                yield r[["way", "id"]]
            return
        before = _flags(self.flags)
        flags = before.copy()
        for r in rows:
            slot, fact = _slots(r["id"].to_numpy()), r["fact"].to_numpy()
            flags[slot[fact == REF]] |= self.WANTED
            flags[slot[fact != REF]] |= self.THERE
            inside = slot[fact == INSIDE]
            flags[inside[before[inside] & self.THERE == 0]] |= self.WANTED
        both = self.THERE | self.WANTED
        gone = np.flatnonzero((flags == both) & (before != both))
        if (flags != before).any():
            self.flags.update((flags.tobytes(),))
        if len(gone):
            yield pd.DataFrame({"way": False, "id": gone.astype(np.int64) + (key[1] << BITS)})

    def close(self) -> None:
        pass


def stream_cut(nodes: DataFrame, ways: DataFrame, area: list[Polygon] | tuple[Polygon, ...]) -> DataFrame:
    """Streams of nodes (id, x, y) and ways (id, nodes) -> a stream of (kind, id): the complete extract's nodes and ways."""
    zero, fact = F.lit(0).cast("long"), lambda n: F.lit(n).cast("int").alias("fact")  # no column has nulls: pandas would make longs doubles
    inside = F.coalesce(pip_expr(F.col("x"), F.col("y"), area), F.lit(False))
    placed = nodes.where("id is not null").select(F.col("id").cast("long").alias("id"), F.when(inside, INSIDE).otherwise(OUTSIDE).alias("fact"))
    no_refs = F.array().cast("array<long>")
    way_rows = ways.where("id is not null").select(F.col("id").cast("long").alias("way_id"), F.array_compact(F.coalesce(F.col("nodes").cast("array<long>"), no_refs)).alias("nodes"))
    refs = way_rows.select("way_id", F.explode("nodes").alias("id"))
    facts = placed.select(_block("id"), "id", "fact", zero.alias("way_id")).unionByName(refs.select(_block("id"), "id", fact(REF), "way_id"))
    hits = facts.groupBy("block").transformWithStateInPandas(_Hits(), "way_id long", "append", "none")
    seen = way_rows.select(_block("way_id"), "way_id", F.lit(False).alias("hit"), "nodes").unionByName(
        hits.select(_block("way_id"), "way_id", F.lit(True).alias("hit"), no_refs.alias("nodes")))
    selected = seen.groupBy("block").transformWithStateInPandas(_Ways(), "way boolean, id long", "append", "none")
    rows = placed.select(F.lit(False).alias("way"), _block("id"), "id", "fact").unionByName(selected.select("way", _block("id"), "id", fact(REF)))
    gone = rows.groupBy("way", "block").transformWithStateInPandas(_Leaving(), "way boolean, id long", "append", "none")
    return gone.select(F.when(F.col("way"), "way").otherwise("node").alias("kind"), "id")


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed states need the RocksDB store: set while a query starts, which keeps it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def start_cut(nodes: DataFrame, ways: DataFrame, area: list[Polygon] | tuple[Polygon, ...], out: str, checkpoint: str) -> StreamingQuery:
    """Append the extract's (kind, id) to Parquet files in out; what has arrived so far is taken in micro-batches, then the query ends."""
    with _state_store(nodes.sparkSession):
        return (stream_cut(nodes, ways, area).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())
