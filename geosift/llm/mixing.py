"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 60-bit hash of its id and text. A source that needs only part of its words takes the
documents below a hash threshold. The threshold is found by histograms: words are summed by source and
hash bucket (4096 buckets a level), the bucket in which the budget runs out is found from the running
sum of at most 4096 rows, and only that bucket is divided again on the next level. After the last level
the bucket is a single hash value. No document is sorted and no source is gathered: each level is one
pre-aggregated group-by.

Defined results:
- null text and empty text: size 0, taken 0.
- null source: a source of its own, ordered last. null id: hashed as the text "~".
- rows with equal id and text in a source share a hash. Where the budget runs out among them, as many are taken as come
  nearest to it: they are numbered by file and row of a staged table, and each file's rows are numbered by themselves.
- empty table: no rows. A source without words has target 0.
- extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geosift.llm.common import small, stage, unused

BITS, LEVELS = 12, 5  # 60 bits of hash


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(id_: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text: the same in every run and on every engine."""
    both = F.concat(F.coalesce(id_.cast("string"), F.lit("~")), F.lit("\n"), F.coalesce(text, F.lit("~")))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """sizes (source, source_size), one row a source -> source, source_size, target, copies, rest.

    The weights repeat over the sources in code-point order. A target is its weight's share of all words,
    at most max_repeat times the source's size; the excess is shared again by weight. In the order of
    size over weight the capped sources come first, so one running sum finds them.
    """
    last = F.col("source").isNull()
    order = Window.partitionBy().orderBy(last, F.col("source"))
    at = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (at + 1).cast("int")).cast("long")
    rows = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * max_repeat).alias("cap"))
    fill = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), last, F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    d = lambda c: F.col(c).cast("decimal(38,0)")
    rows = rows.select(
        "*",
        F.sum("source_size").over(every).alias("all_size"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    rows = rows.withColumn("capped", d("cap") * d("w_left") <= (d("all_size") - d("cap_before")) * d("w"))
    rows = rows.select(
        "*",
        (F.col("all_size") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))).alias("open_size"),
        F.sum(F.when(~F.col("capped"), F.col("w"))).over(every).alias("open_w"),
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("w") * F.col("open_size")).cast("double") / F.col("open_w").cast("double"))
    rows = rows.select("source", "source_size", target.alias("target"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return rows.select("*", copies.alias("copies")).select(
        "*", (F.col("target") - (F.col("copies") * F.col("source_size")).cast("double")).alias("rest"))


def hash_thresholds(base: DataFrame, targets: DataFrame) -> DataFrame:
    """base (skey, size, h); targets (skey, rest) -> skey, threshold, edge, extra: rows with h <= threshold are taken once more,
    and of those with h = edge (equal rows, fewer than all of them; else null) as many as extra says.

    One nested histogram a level; `prefix` and `left` hold each source's boundary bucket and what of the
    budget remains for it. A budget that ends with a bucket leaves 0 for the next one, which is divided
    like any other: the threshold comes out just below its first words.
    """
    state = targets.where("rest > 0").select("skey", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left"))
    run = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = base.join(small(state.select("skey", "prefix", "left")), "skey").where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = inside.groupBy("skey", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        over = hist.withColumn("upto", F.sum("words").over(run)).where(F.col("upto") > F.col("left"))
        first = over.groupBy("skey", "left").agg(F.min(F.struct("bucket", "upto", "words", "n")).alias("b"))
        # At most one row a source, so the next level's check of its size is cheap.
        state = stage(first.select(
            "skey", F.col("b.bucket").alias("prefix"), F.col("b.words").alias("words"), F.col("b.n").alias("n"),
            (F.col("left") - (F.col("b.upto") - F.col("b.words")).cast("double")).alias("left")), f"mix-level{level}")
    # The boundary is one hash value now, mostly one row: as many of its rows as end nearest to the budget.
    take = F.ceil(F.col("left") * F.col("n") / F.col("words") - 0.5)
    some = (take > 0) & (take < F.col("n"))
    return state.select(
        "skey", F.when(take >= F.col("n"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"),
        F.when(some, F.col("prefix")).alias("edge"), F.when(some, take).alias("extra"))


def number_equals(rows: DataFrame) -> DataFrame:
    """rows (skey, extra, file, at, ...) of the boundary hashes -> with `more`: 1 for `extra` rows of each skey, else 0.

    Rows are numbered within their file, and files by a running sum over their counts.
    """
    files = rows.groupBy("skey", "file").agg(F.count("*").alias("n"))
    before = Window.partitionBy("skey").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("skey").alias("of"), F.col("file").alias("of_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = rows.withColumn("number", F.row_number().over(Window.partitionBy("skey", "file").orderBy("at")))
    both = own.join(small(files), (F.col("skey") == F.col("of")) & (F.col("file") == F.col("of_file")))
    return both.withColumn("more", (F.col("before") + F.col("number") <= F.col("extra")).cast("long")).drop("of", "of_file", "before", "number")


def placed(staged: DataFrame) -> DataFrame:
    """A staged table with each row's file and place in it."""
    return staged.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def plan_mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int],
             max_repeat: int) -> tuple[DataFrame, DataFrame]:
    """The slim table (doc_id, source, skey, size, h) and, for each source, source_size, target, copies, threshold, edge, extra."""
    source = F.col(source_col)
    base = stage(docs.select(
        F.col(id_col).alias("doc_id"), source.cast("string").alias("source"), source_key(source).alias("skey"),
        word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("h")), "mix-base")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeat)
    targets = stage(targets.withColumn("skey", source_key(F.col("source"))).drop("source"), "mix-targets")
    cut = stage(hash_thresholds(base.select("skey", "size", "h"), targets), "mix-cuts")
    return base, targets.drop("rest").join(small(cut), "skey", "left")


def times_taken(h: Column) -> Column:
    return F.col("copies") + (h <= F.coalesce(F.col("threshold"), F.lit(-1))).cast("long")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes), times (how often it takes the row)."""
    base, per_source = plan_mix(docs, id_col, text_col, source_col, weights, max_repeat)
    per_source = small(per_source)
    out = ["doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times"]
    rows = base.join(per_source, "skey")
    if per_source.where("extra > 0").isEmpty():
        return rows.withColumn("times", times_taken(F.col("h"))).select(*out)
    edge = number_equals(placed(base).join(per_source, "skey").where("h = edge"))
    rest = rows.where("edge is null or h <> edge").withColumn("times", times_taken(F.col("h")))
    return rest.select(*out).unionByName(edge.withColumn("times", F.col("copies") + F.col("more")).select(*out))


def repeat_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with the columns of docs."""
    _, per_source = plan_mix(docs, id_col, text_col, source_col, weights, max_repeat)
    mix_, key, copy = unused("mix_plan", docs), unused("mix_key", docs), unused("mix_copy", docs)
    per_source = small(per_source.select(F.struct("copies", "threshold", "edge", "extra").alias(mix_), F.col("skey").alias(key)))
    rows = docs.join(per_source, source_key(docs[source_col]) == F.col(key))
    h, columns = row_hash(docs[id_col], docs[text_col]), [docs[c] for c in docs.columns]
    more = (h <= F.coalesce(F.col(f"{mix_}.threshold"), F.lit(-1))).cast("int")
    times = F.col(f"{mix_}.copies").cast("int") + more
    at_edge = F.coalesce(h == F.col(f"{mix_}.edge"), F.lit(False))
    some = not per_source.where(f"{mix_}.extra > 0").isEmpty()
    main = (rows.where(~at_edge) if some else rows).select(*columns, F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).drop(copy)
    if not some:
        return main
    edge = stage(rows.where(at_edge).select(F.struct(*columns).alias("row"), F.col(key).alias("skey"), f"{mix_}.copies", f"{mix_}.extra"), "mix-edge")
    edge = number_equals(placed(edge)).withColumn("times", (F.col("copies") + F.col("more")).cast("int"))
    return main.unionByName(edge.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~') || chr(10) || coalesce(text, '~')), 1, 15))::BIGINT AS h
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 3 AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sizes),
filled AS (
  SELECT *, sum(source_size) OVER () AS all_size,
    coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM weighed),
marked AS (SELECT *, cap * w_left <= (all_size - cap_before) * w AS capped FROM filled),
opened AS (
  SELECT *, all_size - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS open_size,
    sum(CASE WHEN NOT capped THEN w END) OVER () AS open_w
  FROM marked),
targets AS (
  SELECT source, source_size,
    CASE WHEN capped THEN cap::DOUBLE ELSE (w * open_size)::DOUBLE / open_w::DOUBLE END AS target
  FROM opened),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM targets),
ran AS (
  SELECT b.doc_id, b.size, p.source_size, p.target, p.copies,
    p.target - (p.copies * p.source_size)::DOUBLE AS rest,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(b.size) OVER (PARTITION BY b.source, b.h) AS tied,
    count(*) OVER (PARTITION BY b.source, b.h) AS n, row_number() OVER (PARTITION BY b.source, b.h) AS number
  FROM base b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (copies + CASE WHEN rest > 0 AND (upto <= rest OR number <= ceil((rest - (upto - tied)) * n / nullif(tied, 0) - 0.5)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ran
"""
