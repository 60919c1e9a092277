"""Embedding near-duplicates: navigable small-world graphs per shard, cosine-verified links, components.

Vectors are compared within a group: equal labels and equal length. Equal vectors become one, with a
multiplicity. A group's vectors are dealt by hash into shards of about SHARD vectors; each shard gets a
graph, written once as a file in the shared folder. Every vector queries every shard of its group: one task
takes a pair of shards, reads both graphs by path, and searches each with the vectors of the other, so its
memory is bounded whatever the group's size, and no vector is shuffled more than once.

The beam starts at EF and doubles up to MOST until an audit finds at least RECALL of the links. An audit compares AUDIT of the
queries with the whole shard by brute force, and besides searches as many probes: vectors made to have just the
least cosine with a known vector of the shard, so that shards without links give evidence, too. If the audit
still fails at MOST (a large group of near copies parts from the graph), that search is a matrix product, which costs less than a wider beam.
`search` returns the audits as a table. Links are verified by cosine in double precision, in blocks of rows.
A task gives, for each vector, its number of links and a vector it is connected with there, never pairs; the
components of these are united over all tasks.

Defined results:
- null, zero, empty vectors, and those with null or non-finite components, and null labels: no link,
  component_id = own id. Vectors of different lengths are not linked.
- equal vectors are linked; rows with equal ids are vectors of their own. null ids: counted as links of
  others, component_id and kept null.
- empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geosift.llm.common import new_path, qualified, small_batches, stage
from geosift.llm.graph import components
from geosift.llm.hnsw import Hnsw, levels

SHARD, EF, MOST, AUDIT, RECALL = 8192, 32, 128, 512, 0.995
TASKS = 10_000  # of a stage at most
BLOCK = 512  # rows of a shard that are verified at a time; a multiple of 8
SLACK = 1e-4  # the walk works in single precision; verification is in double


def valid(vector: Column) -> Column:
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def unit_rows(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Shard:
    """The distinct vectors of a shard: uid, copies, unit (double) and their graph."""

    def __init__(self, uid: np.ndarray, copies: np.ndarray, unit: np.ndarray, graph: Hnsw):
        self.uid, self.copies, self.unit, self.graph = uid, copies, unit, graph

    @classmethod
    def build(cls, pdf: pd.DataFrame) -> Shard:
        pdf = pdf.sort_values(["vec", "vec2"])
        unit = unit_rows(pdf["vector"].tolist())
        return cls(pdf["uid"].to_numpy(), pdf["copies"].to_numpy(), unit, Hnsw(unit, levels(pdf["vec"].to_numpy())))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        layers = {f"{what}{i}": a.astype(np.int32) for i, layer in enumerate(self.graph.layers) for what, a in zip(("nodes", "links"), layer, strict=True)}
        np.savez(out, uid=self.uid, copies=self.copies, unit=self.unit, **layers)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        f = np.load(io.BytesIO(data))
        graph = Hnsw.__new__(Hnsw)
        graph.vectors = f["unit"].astype(np.float32)
        graph.layers = [(f[f"nodes{i}"].astype(np.int64), f[f"links{i}"].astype(np.int64)) for i in range(sum(k.startswith("nodes") for k in f.files))]
        return cls(f["uid"], f["copies"], f["unit"], graph)


def _probes(unit: np.ndarray, pick: np.ndarray, least: float) -> np.ndarray:
    """For each picked vector one that has just over the least cosine with it, in a random direction."""
    y = unit[pick]
    u = np.random.default_rng(len(unit)).normal(size=y.shape)
    u -= (u * y).sum(1, keepdims=True) * y
    u /= np.maximum(np.sqrt((u * u).sum(1, keepdims=True)), 1e-300)
    cos = min(1.0, least + 1e-3)
    return cos * y + np.sqrt(1 - cos * cos) * u


def _sample(n: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(AUDIT, n)).astype(int))


def find(x: Shard, y: Shard, least: float, same: bool) -> tuple[np.ndarray, dict]:
    """What x's vectors find in y's graph, as packed bits (x by y), and the audit."""
    rows, known = _sample(len(x.unit)), _sample(len(y.unit))
    truth = x.unit[rows] @ y.unit.T >= least
    if same:
        truth[np.arange(len(rows)), rows] = False
    probes, links = _probes(y.unit, known, least), int(truth.sum())
    ef = min(EF, len(y.unit))
    while True:
        got = y.graph.within(probes, least - SLACK, ef)[np.arange(len(known)), known].mean()
        of_links = (y.graph.within(x.unit[rows], least - SLACK, ef) & truth).sum() / links if links else 1.0
        recall = float(min(got, of_links))
        if recall >= RECALL or ef >= min(MOST, len(y.unit)):
            break
        ef = min(2 * ef, len(y.unit))
    exact = recall < RECALL
    packed = []
    for a in range(0, len(x.unit), BLOCK):
        part = x.unit[a : a + BLOCK]
        packed.append(np.packbits(part @ y.unit.T >= least - SLACK if exact else y.graph.within(part, least - SLACK, ef), axis=1))
    return np.concatenate(packed), {"ef": ef, "links": links, "recall": 1.0 if exact else recall, "exact": exact}


def _verified(found: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """found without what is below the threshold in double precision."""
    if np.count_nonzero(found) > found.size // 50:
        return found & (x @ y.T >= least)
    r, c = np.nonzero(found)
    out = np.zeros_like(found)
    for a in range(0, len(r), 100_000):
        rr, cc = r[a : a + 100_000], c[a : a + 100_000]
        ok = np.einsum("kd,kd->k", x[rr], y[cc]) >= least
        out[rr[ok], cc[ok]] = True
    return out


class _Union:
    """Union-find over places; `label` is brought up to date block by block."""

    def __init__(self, n: int):
        self.parent, self.label = list(range(n)), np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def unite(self, places: np.ndarray) -> None:
        roots = {self.root(i) for i in np.unique(self.label[places]).tolist()}
        least = min(roots)
        for r in roots:
            self.parent[r] = least

    def refresh(self) -> None:
        names, at = np.unique(self.label, return_inverse=True)
        self.label = np.array([self.root(i) for i in names.tolist()])[at]


def link_shards(x: Shard, y: Shard, least: float, same: bool) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """(uid, number of links, uid of a vector connected with it) of the vectors with links between x and y; the audits."""
    there, audit = find(x, y, least, same)
    back, audits = there, [audit]
    if not same:
        back, audit = find(y, x, least, same)
        audits.append(audit)
    nx, ny = len(x.unit), len(y.unit)
    n_x, n_y = np.zeros(nx, np.int64), np.zeros(ny, np.int64)
    union = _Union(nx if same else nx + ny)
    shift = 0 if same else nx
    for a in range(0, nx, BLOCK):
        k = min(BLOCK, nx - a)
        found = np.unpackbits(there[a : a + k], axis=1, count=ny).astype(bool)
        found |= np.unpackbits(back[:, a // 8 : (a + k + 7) // 8], axis=1)[:, :k].T.astype(bool)
        if same:
            found[np.arange(k), a + np.arange(k)] = False
        found = _verified(found, x.unit[a : a + k], y.unit, least)
        n_x[a : a + k] = found @ y.copies
        if not same:
            n_y += x.copies[a : a + k] @ found
        for r in np.nonzero(found.any(1))[0]:
            union.unite(np.append(np.nonzero(found[r])[0] + shift, a + r))
        union.refresh()
    uid = x.uid if same else np.append(x.uid, y.uid)
    n = n_x if same else np.append(n_x, n_y)
    some = np.nonzero(n)[0]
    return list(zip(uid[some].tolist(), n[some].tolist(), uid[union.label[some]].tolist(), strict=True)), audits


FOUND = "uid long, n long, root long, grp string, shard int, queries int, ef int, links long, recall double, exact boolean"


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           least: float = 0.93, shard_size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """vec_id, n_links, component_id, kept, label for every row of vectors; and the audits: grp, shard, queries (the shard
    that queried), ef, links (true ones in the sample), recall, exact."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("raw"), F.col(label_col).alias("label"))
    vector = F.transform("raw", lambda v: v.cast("double"))
    rows = rows.withColumn("vector", F.when(valid(F.col("raw")) & F.col("label").isNotNull(), vector))
    rows = rows.withColumn("grp", F.when(F.col("vector").isNotNull(), F.concat_ws(":", F.size("vector").cast("string"), F.col("label").cast("string"))))
    # Two 64-bit hashes of group and components name a vector. -0.0 and 0.0 are equal.
    value = F.transform("vector", lambda v: v + 0.0)
    rows = rows.withColumns({"vec": F.when(F.col("grp").isNotNull(), F.xxhash64("grp", value)), "vec2": F.when(F.col("grp").isNotNull(), F.xxhash64(value, F.lit(7), "grp"))})
    rows = stage(rows.drop("raw"), "emb-rows")
    uniq = rows.where("grp is not null").groupBy("grp", "vec", "vec2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("owner"), F.first("vector").alias("vector"))
    uniq = stage(uniq.withColumn("uid", F.monotonically_increasing_id()), "emb-unique")
    shards = uniq.groupBy("grp").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("shards"))
    dealt = uniq.join(shards, "grp").withColumn("shard", F.pmod("vec", F.col("shards")).cast("int"))
    # Numbers of tasks are given: by bytes Spark would put many graphs, and all pairs of paths, into one task.
    n_shards, n_pairs = shards.agg(F.sum("shards"), F.sum(F.expr("shards * (shards + 1L) div 2"))).first()
    tasks = lambda n, each: min(max(1, -(-(n or 0) // each)), TASKS)
    folder = qualified(spark, new_path(spark, "emb-graphs"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        """One shard's file: written apart and renamed, so a task that runs again replaces it by an equal one."""
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{root}/{task.partitionId()}-{int(pdf['uid'].min())}"
        with fs.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp", compression=None) as out:
            out.write(Shard.build(pdf).to_bytes())
        fs.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.npz")
        return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "shard": pdf["shard"].iloc[:1], "path": [f"{folder}/{name.rsplit('/', 1)[1]}.npz"]})

    graphs = dealt.select("grp", "shard", "uid", "vec", "vec2", "copies", "vector").repartition(tasks(n_shards, 1), "grp", "shard").groupBy("grp", "shard").applyInPandas(build, "grp string, shard int, path string")
    graphs = stage(graphs, "emb-graphs")
    other = graphs.select("grp", F.col("shard").alias("queries"), F.col("path").alias("path2"))
    pairs = graphs.join(other, "grp").where("queries >= shard")  # of shards: paths, no vectors

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}

        def load(path: str) -> Shard:
            if path not in held:
                while len(held) >= 2:
                    held.pop(next(iter(held)))
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as f:
                    held[path] = Shard.from_bytes(f.read())
            return held[path]

        for b in batches:
            for grp, x, y, path, path2 in zip(*(b.column(c).to_pylist() for c in ("grp", "shard", "queries", "path", "path2")), strict=True):
                found, audits = link_shards(load(path), load(path2), least, x == y)
                yield pa.RecordBatch.from_pylist(
                    [{"uid": u, "n": n, "root": r} for u, n, r in found]
                    + [{"grp": grp, "shard": s, "queries": q, **a} for (s, q), a in zip(((y, x), (x, y)), audits, strict=False)], schema=FOUND_SCHEMA)

    # A few pairs of one shard a task, so that its graph is read once.
    pairs = pairs.repartition(tasks(n_pairs, 2), "grp", "shard", (F.col("queries") / 4).cast("int")).sortWithinPartitions("grp", "shard", "queries")
    found = stage(pairs.mapInArrow(query, FOUND), "emb-found")
    audits = found.where("recall is not null").drop("uid", "n", "root")
    found = found.where("uid is not null").select("uid", "n", "root")
    degree = found.groupBy("uid").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    named = uniq.join(comp.withColumnRenamed("id", "uid"), "uid", "left").select("uid", "vec", "vec2", "owner", "copies", F.coalesce("comp", "uid").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("owner").alias("component_id"))
    per = named.join(smallest, "comp").join(degree, "uid", "left").select(
        "vec", "vec2", (F.coalesce("n", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), "component_id")
    # A vector may have very many copies; this join is one that Spark splits.
    out = rows.select("vec_id", "label", "vec", "vec2").join(per, ["vec", "vec2"], "left")
    comp_id = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), comp_id.alias("component_id"),
                      (F.col("vec_id") == comp_id).alias("kept"), "label"), audits


FOUND_SCHEMA = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("grp", pa.string()), ("shard", pa.int32()), ("queries", pa.int32()),
                          ("ef", pa.int32()), ("links", pa.int64()), ("recall", pa.float64()), ("exact", pa.bool_())])


def near_duplicates(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept, label for every row of vectors; options as of `search`."""
    return search(vectors, **options)[0]


def op2_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


# Brute force: every two vectors of a label, and the smallest id that links reach.
OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
r(x, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.x WHERE r.c < l.b)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) ON x = vec_id LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) ON a = vec_id
"""
