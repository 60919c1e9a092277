"""Secret scans with corpus-wide ownership frequency.

A scan of every whole text finds base spans by pattern and, besides, candidates: tokens of known
issuers, key blocks and long random-looking strings that no base span covers. The value of every base span
and candidate is hashed and counted over the corpus by distinct repositories and distinct owners. A value
that several owners hold, or that one owner has in many repositories, is a widely copied example; another
one is specific to its owner and looks live. Base spans stay in any case; a candidate becomes a span only if it
looks live. Here a document is a repository and its source the owner, by default.

Counts are pre-aggregated by (value, owner) before they are counted by value, so a value that a third of
all rows hold is no hot group; the join back is one that Spark splits. Values themselves never leave the
scan, only their hashes do.

Defined results:
- null and empty texts: no span, digest of the empty string. null owners count as one owner, null
  repositories as one repository; repeated rows have equal results and count as one repository.
- equal spans of several kinds are listed by kind in the order of KINDS. Empty table: no rows.
- texts are taken whole; offsets count code points, ends are exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosift.llm.common import small_batches, stage

# The base patterns and how long a match must be. The tested length is that of the group.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # the runs of [0-9a-f]+ that are long enough
)
# Public formats of issued tokens and key blocks.
ISSUED = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{30,}|glpat-[\w-]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,}"
    r"|AIza[\w-]{35}|eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----", re.A)
RANDOM = re.compile(r"[A-Za-z0-9+/=_-]{32,}")
KINDS = ("assign", "access", "hex", "issued", "random")
ENTROPY = 4.0  # bits a character that a random-looking string has at least


def _random_looking(s: str) -> bool:
    kinds = any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s)
    return kinds == 3 and -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= ENTROPY


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of base spans, then of candidates that overlap none of them."""
    base = [(kind, m.start(), m.end(), m[group]) for kind, pattern, group, least in BASE
            for m in pattern.finditer(text) if len(m[group]) >= least]
    out = list(base)
    for kind, pattern in (("issued", ISSUED), ("random", RANDOM)):
        starts, ends = _merged([(a, b) for _, a, b, _ in out])
        for m in pattern.finditer(text):
            i = bisect_right(ends, m.start())  # the first span that ends behind the match's start
            if (i == len(ends) or starts[i] >= m.end()) and (kind == "issued" or _random_looking(m[0])):
                out.append((kind, m.start(), m.end(), m[0]))
    return out


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


SPAN = "struct<kind:string,start:int,end:int,value:long>"


def find_spans(rows: DataFrame) -> DataFrame:
    """rows (doc_id, owner, text) -> doc_id, owner, n_assign, n_access, n_hex, base_sha256, found array<SPAN>."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, flat, ends = [], [], [], [0]
            for t in b.column("text"):
                spans = scan(t.as_py() or "")
                counts.append(Counter(k for k, *_ in spans))
                digests.append(hashlib.sha256(_listed([s[:3] for s in spans if s[0] in KINDS[:3]]).encode()).hexdigest())
                flat += [(k, a, e, xxhash.xxh3_64_intdigest(v) - 2**63) for k, a, e, v in spans]
                ends.append(len(flat))
            columns = list(zip(*flat, strict=True)) or [(), (), (), ()]
            kinds_ = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            span = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)], names=["kind", "start", "end", "value"])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("owner"), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS[:3]),
                 pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), span)],
                names=["doc_id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, owner {kinds['owner']}, n_assign long, n_access long, n_hex long, "
                                f"base_sha256 string, found array<{SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """found (value, doc_id, owner) -> value, repositories, owners (distinct; null counts as one)."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    one = found.select("value", text("doc_id").alias("repository"), text("owner").alias("owner")).distinct()
    per_owner = one.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("value").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 example_owners: int = 2, example_repositories: int = 10) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example for every row of docs.

    n_live and n_example count the row's base spans and candidates by their values' ownership: a value of at
    least `example_owners` owners, or in at least `example_repositories` repositories, is an example.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), F.col(text_col).alias("text"))
    # Staged: the texts are read once, and every row gets a number of its own that later steps agree on.
    found = stage(find_spans(rows).withColumn("row", F.monotonically_increasing_id()), "sec-found")
    each = found.where(F.size("found") > 0).select("row", "doc_id", "owner", F.explode("found").alias("s")).select(
        "row", "doc_id", "owner", "s.*")
    owners = ownership(each.select("value", "doc_id", "owner"))
    judged = each.select("row", "kind", "start", "end", "value").join(owners, "value")
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    base = F.col("kind").isin(*KINDS[:3])
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "end", F.concat_ws(":", "kind", "start", "end").alias("text"))
    per = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(base | live, span))).alias("s"),
        F.sum(live.cast("long")).alias("n_live"), F.sum((~live).cast("long")).alias("n_example"))
    per = per.select("row", F.array_join(F.transform("s", lambda x: x["text"]), ",").alias("spans"), "n_live", "n_example")
    zero = F.lit(0).cast("long")
    return found.drop("found").join(per, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
