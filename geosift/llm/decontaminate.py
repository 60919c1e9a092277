"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

DataFrame functions only. A window is `width` consecutive words of a benchmark item (all its words if it
has fewer). A document contains a window only if it contains each of the window's shingles (3 words, or
the whole window if shorter), so it is enough to look for one of them: the rarest by its count over all
documents. These are the necessary tokens ("anchors"). Documents are matched on anchor hashes alone; each
match gives an alignment of a document with an item, whose equal run is measured word by word to both
sides, no further than a window with that anchor can reach (length and position bound the words that are
read). A run as long as a window is exact containment; every occurrence of a window contains its anchor,
so none is missed.

Defined results:
- words are runs of letters, digits and non-ASCII characters after lower-casing A-Z; null and empty texts
  have none, n_words 0, and are never contaminated; null or wordless items have no window.
- an item occurring in several places counts once; equal items count as many as they are; a null item_id
  is skipped in the list, but its hits count.
- rows with equal id and text share their result, each row is returned; null ids are returned too.
- empty tables: no rows, or no hits. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geosift.llm.common import ascii_lower, row_key, small, stage, unused

HASHES = 500_000  # shingle hashes (8 bytes each) up to which they are broadcast
PROBES = 100_000  # anchors with the words around them, likewise
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def words_of(text: Column) -> Column:
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def _shingle_at(words: Column, pos: Column, n: int) -> Column:
    """A 64-bit hash of n words from the 0-based pos."""
    return F.xxhash64(F.lit(n), *[F.get(words, pos + i) for i in range(n)])


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """item_id, iwords, m (words), w (window width), k (shingle length) of each item with words."""
    words = words_of(F.col(text_col))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words.alias("iwords"))
    items = items.where(F.size("iwords") > 0).dropDuplicates(["item_id", "iwords"])
    m = F.size("iwords")
    w = F.least(m, F.lit(width))
    return items.select("item_id", "iwords", m.alias("m"), w.alias("w"), F.least(w, F.lit(SHINGLE)).alias("k"))


def item_shingles(items: DataFrame) -> DataFrame:
    """One row for each shingle position of each item: item_id, iwords, m, w, k, ipos, h."""
    at = items.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("k"))).alias("ipos"))
    h = _shingle_at(F.col("iwords"), F.col("ipos"), 1)
    for n in range(2, SHINGLE + 1):
        h = F.when(F.col("k") >= n, _shingle_at(F.col("iwords"), F.col("ipos"), n)).otherwise(h)
    return at.withColumn("h", h)


def doc_shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """docs (key, words) -> key, words, pos, h for every shingle of the given lengths that fits."""
    at = docs.select("*", F.posexplode("words").alias("pos", "word"))
    if len(lengths) == 1:
        n = lengths[0]
        return at.where(F.col("pos") + n <= F.size("words")).select("key", "words", "pos", _shingle_at(F.col("words"), F.col("pos"), n).alias("h"))
    hs = F.array(*[F.when(F.col("pos") + n <= F.size("words"), _shingle_at(F.col("words"), F.col("pos"), n)) for n in lengths])
    return at.select("key", "words", "pos", F.explode(hs).alias("h"))


def equal_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(a)).otherwise((first - 1).cast("int"))


def contained_runs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (key, words): key, start, end (word positions), item_id of runs that hold a window; together they cover all."""
    shingles = stage(item_shingles(items), "decon-shingles")
    lengths = [r[0] for r in shingles.select("k").distinct().orderBy("k").collect()]  # at most SHINGLE values
    if not lengths:
        lengths = [SHINGLE]
    # Rarity: how often each benchmark shingle occurs over all documents.
    wanted = small(shingles.select("h").distinct(), HASHES)
    counts = doc_shingles(docs, lengths).select("h").join(wanted, "h").groupBy("h").agg(F.count("*").alias("n"))
    counts = stage(counts, "decon-counts")
    # A window whose shingles do not all occur cannot occur: such windows need no anchor.
    ranked = shingles.join(small(counts, HASHES), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first, last = F.greatest(F.lit(0), F.col("ipos") - (F.col("w") - F.col("k"))), F.least(F.col("ipos"), F.col("m") - F.col("w"))
    windows = ranked.select("item_id", "iwords", "m", "w", "h", "ipos", "n", F.explode(F.sequence(first, last)).alias("wstart"))
    rarest = windows.groupBy("item_id", "iwords", "m", "w", "wstart").agg(F.min(F.struct("n", "ipos", "h")).alias("a"))
    # An anchor carries the words around it that windows with it can reach: fewer than w to either side.
    ipos, w = F.col("a.ipos"), F.col("w")
    back = F.least(ipos, w - 1)
    anchors = rarest.where(F.col("a.n") > 0).select(F.col("a.h").alias("h"), F.struct(
        "item_id", "w", F.reverse(F.slice("iwords", ipos - back + 1, back)).alias("before"),
        F.slice("iwords", ipos + 1, F.least(F.col("m") - ipos, w)).alias("after")).alias("a")).distinct()
    probes = stage(anchors, "decon-anchors")
    if probes.count() <= PROBES:
        hit = doc_shingles(docs, lengths).join(F.broadcast(probes), "h")
    else:  # positions alone are dealt out; the words of documents with matches come back to them
        hit = doc_shingles(docs, lengths).select("key", "pos", "h").join(probes, "h").select("key", "pos", "a")
        hit = hit.distinct().join(docs.dropDuplicates(["key"]), "key")
    # The explode keeps whole texts out of the rows that leave this step: only the words around the match do.
    pos, words = F.col("pos"), F.col("words")
    back = F.least(pos, F.size("a.before"))
    around = F.struct(F.slice(words, pos - back + 1, back).alias("before"),
                      F.slice(words, pos + 1, F.least(F.size(words) - pos, F.size("a.after"))).alias("after"))
    hit = hit.select("key", "pos", "a", F.explode(F.array(around)).alias("d"))
    hit = hit.select("key", F.col("a.item_id").alias("item_id"), F.col("a.w").alias("w"), "pos",
                     equal_prefix(F.reverse("d.before"), F.col("a.before")).alias("left"),
                     equal_prefix(F.col("d.after"), F.col("a.after")).alias("right"))
    return hit.where(F.col("left") + F.col("right") >= F.col("w")).select(
        "key", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"), "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", width: int = 13,
                  share: int = 20) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged word spans), items."""
    slim = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), words_of(F.col(text_col)).alias("words"))
    items = item_windows(benchmark, item_col, item_text_col, width)
    runs = contained_runs(slim.select("key", "words"), items)
    # Repeats of a run in equal rows or under several anchors end here, before anything is gathered.
    runs = stage(runs.distinct(), "decon-runs")
    spans = runs.select("key", F.struct("start", "end").alias("s")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("s"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    # Words covered: each span adds what lies beyond the furthest end so far.
    covered = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
        F.greatest(a["end"], s["end"]).alias("end")), lambda a: a["n"])
    spans = spans.select("key", covered.cast("long").alias("n_hit"), F.col("s").alias("spans"))
    found = runs.groupBy("key").agg(F.collect_set("item_id").alias("items"))
    per = spans.join(found, "key").select(
        "key", "n_hit", "spans", F.array_sort("items").alias("items"))
    out = slim.select("doc_id", "key", F.size("words").cast("long").alias("n_words")).join(per, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_ = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return out.select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("spans", empty).alias("spans"), items_.alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without its contaminated rows, with the columns of docs."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    key, bad = unused("decon_key", docs), unused("decon_bad", docs)
    found = contamination(docs, benchmark, **options).where("contaminated").select(F.col("key").alias(bad)).distinct()
    return docs.withColumn(key, row_key(id_col, text_col)).join(found, F.col(key) == F.col(bad), "left_anti").drop(key)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
