"""Ranked lexical search over a tiered index: high-impact postings first, lower tiers only for items without a proof.

The forward index has a row for each document: its length, distinct terms and their counts. Of each term that some
item has, a histogram of impacts (the part of a score that depends on the document) gives its document frequency
and, for each tier, the impact from which on at most a tier's number of its postings lie, and the highest impact below
that: the residual bound. A tier's postings are joined with the items' terms and summed for each item and document. The exact scores of an
item's best PROBES documents by these sums give a score that its answers must reach, and the residual bounds say what
a document can still gain from what was not read. An item is proved if a document without any posting read
cannot reach that score: its answers are among those whose sum and residual bounds reach it, and these are scored
exactly. The other items fall through to the next tier, and at last to the whole forward index, which is read in
order against blocks of items: a task keeps the best of each item only.

No step gathers a term's postings or an item's documents: postings are cut per term before the join, sums are
combined before the shuffle, and ranks are limited before it. The last tier's items go to the tasks in blocks of bounded size.

Defined results:
- terms: runs of letters, digits and non-ASCII characters, A-Z lower-cased. null and empty texts have none, are no documents
  of the statistics, and never rank.
- items: every row is an item, repeated or null ids too; one without terms, or whose terms no document has, has no rows.
- equal scores by ascending doc_id, nulls last; rows with equal id and text are documents of their own, each with its rank.
- terms that every document has may weigh 0; documents whose score is 0 are no answers.
- empty tables: no rows. Texts are read whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geosift.llm.common import small, small_batches, stage, temporary

TIERS = (500, 8_000)  # postings of a term that a tier reads at most; below the last comes the forward index
PROBES = 40  # documents of an item that are scored exactly to find the score to reach
BUCKET = 1_000  # impacts in a bucket of the histograms
ITEMS, PAIRS = 500, 200_000  # items and (item, term) pairs of a block of the last tier at most; one item at least
DOCS = 256  # documents that the last tier scores together
_TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def forward_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, doc_id, n, terms, tfs of each row that has a term; rid is a number of its own."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for d, t in zip(b.column("doc_id"), b.column("text"), strict=True):
                counts = Counter(_TERM.findall(t.as_py().translate(_LOWER)))
                if counts:
                    ids.append(d.as_py())
                    sizes.append(counts.total())
                    terms.append(list(counts))
                    tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))],
                                             names=["doc_id", "n", "terms", "tfs"])

    return rows.mapInArrow(run, "doc_id long, n long, terms array<string>, tfs array<long>").withColumn("rid", F.monotonically_increasing_id())


def _postings(forward: DataFrame, documents: int, length: int) -> DataFrame:
    """rid, term, impact of each document and term."""
    each = forward.select("rid", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    m = F.lit(25).cast("long") + F.expr(f"(75L * n * {documents}L) div {length}L")
    return each.select("rid", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"), m.alias("m")).select("rid", "term", F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)").alias("impact"))


def _lexicon(postings: DataFrame, terms: DataFrame, documents: int) -> DataFrame:
    """term, w, and for each tier cutK (its least impact) and restK (the highest below)."""
    counted = postings.join(small(terms), "term").groupBy("term", F.expr(f"impact div {BUCKET}").alias("bucket")).agg(F.count("*").alias("c"), F.max("impact").alias("top"))
    down = Window.partitionBy("term").orderBy(F.desc("bucket"))
    whole = Window.partitionBy("term")
    rows = counted.withColumn("upto", F.sum("c").over(down)).withColumn("df", F.sum("c").over(whole))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    tiers = []
    for k, most in enumerate(TIERS):
        inside = F.col("upto") <= most
        tiers += [F.coalesce(F.min(F.when(inside, F.col("bucket") * BUCKET)), F.max("top") + 1).alias(f"cut{k}"), F.coalesce(F.max(F.when(~inside, F.col("top"))), F.lit(0)).cast("long").alias(f"rest{k}")]
    return rows.groupBy("term", "df").agg(*tiers).withColumn("w", weight).where("w > 0")


def _best(rows: DataFrame, score: str, k: int, *order: Column) -> DataFrame:
    """The k highest rows of each item; Spark limits them before the shuffle, too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), *order))).where(F.col("rank") <= k)


def _exact(pairs: DataFrame, forward: DataFrame, query: DataFrame, documents: int, length: int) -> DataFrame:
    """qid, rid, doc_id, score of pairs (qid, rid)."""
    wanted = small(pairs.select("rid").distinct())
    impacts = _postings(forward.join(wanted, "rid", "left_semi"), documents, length)
    scores = pairs.join(impacts, "rid").join(small(query.select("qid", "term", "qw")), ["qid", "term"]).groupBy("qid", "rid").agg(F.sum(F.col("qw") * F.col("impact")).alias("score"))
    return scores.join(forward.select("rid", "doc_id"), "rid").select("qid", "rid", "doc_id", "score")


def _tier(k: int, query: DataFrame, forward: DataFrame, postings: DataFrame, documents: int, length: int, top: int) -> tuple[DataFrame, DataFrame]:
    """(qid, rid, doc_id, score) of the items that tier k proves, with all their answers; the ids of those items."""
    lexicon = query.select("term", f"cut{k}").distinct()
    read = stage(postings.join(small(lexicon), "term").where(F.col("impact") >= F.col(f"cut{k}")).select("rid", "term", "impact"), f"search-tier{k}")
    own = query.select("qid", "term", "qw", F.col(f"rest{k}").alias("rest"))
    sums = stage(read.join(small(own), "term").groupBy("qid", "rid").agg(F.sum(F.col("qw") * F.col("impact")).alias("part"), F.sum(F.col("qw") * F.col("rest")).alias("seen")), "search-sums")
    probes = stage(_best(sums, "part", PROBES, F.col("rid")).select("qid", "rid"), "search-probes")
    best = _best(_exact(probes, forward, query, documents, length), "score", top, F.col("rid"))
    reach = best.groupBy("qid").agg(F.when(F.count("*") == top, F.min("score")).otherwise(0).alias("reach"))
    bounds = own.groupBy("qid").agg(F.sum(F.col("qw") * F.col("rest")).alias("bound")).join(reach, "qid", "left").select("qid", "bound", F.coalesce("reach", F.lit(0)).cast("long").alias("reach"))
    # What no posting read tells of can have the bound at most; an equal score may have a lesser id.
    proved = stage(bounds.where("bound < reach or bound = 0"), "search-proved")
    pairs = sums.join(small(proved), "qid").where("part + bound - seen >= reach").select("qid", "rid")
    answers = _best(_exact(stage(pairs, "search-pairs"), forward, query, documents, length), "score", top, F.asc_nulls_last("doc_id"), F.col("rid"))
    return stage(answers.select("qid", "rid", "doc_id", "score"), "search-answers"), proved.select("qid")


class _Block:
    """Items of the last tier, by term."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        self.items = np.array(sorted({q for q, _, _ in rows}), "<i8")
        place, by_term = {q: i for i, q in enumerate(self.items.tolist())}, {}
        for q, term, qw in rows:
            by_term.setdefault(term, []).append((place[q], qw))
        self.terms = pa.array(list(by_term), pa.string())
        sizes = [len(v) for v in by_term.values()]
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype("i8")
        self.item = np.array([i for v in by_term.values() for i, _ in v], "i8")
        self.qw = np.array([w for v in by_term.values() for _, w in v], "i8")

    def scores(self, batch: pa.RecordBatch, documents: int, length: int) -> np.ndarray:
        """A score for each document and item."""
        terms, n = batch.column("terms"), batch.column("n").to_numpy()
        found = pc.index_in(terms.flatten(), value_set=self.terms)
        sizes = pc.list_value_length(terms).to_numpy()
        known = pc.is_valid(found).to_numpy(zero_copy_only=False)
        term = found.drop_null().to_numpy().astype("i8")
        doc, tf = np.repeat(np.arange(len(n)), sizes)[known], batch.column("tfs").flatten().to_numpy()[known]
        m = 25 + 75 * n * documents // length
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        times = self.starts[term + 1] - self.starts[term]
        at = np.arange(times.sum()) + np.repeat(self.starts[term] - np.cumsum(times) + times, times)
        out = np.zeros((len(n), len(self.items)), "i8")
        np.add.at(out, (np.repeat(doc, times), self.item[at]), np.repeat(impact, times) * self.qw[at])
        return out


def _scan(block: list[tuple[int, str, int]], forward: DataFrame, documents: int, length: int, top: int) -> DataFrame:
    """qid, rid, doc_id, score of the best documents of each task for a block of items, from the whole forward index."""
    shared = forward.sparkSession.sparkContext.broadcast(block)
    last = np.iinfo("i8").max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Block(shared.value)
        k = len(items.items)
        # The score and id of each item's worst kept document, once it has as many as wanted.
        worst, worst_id = np.zeros(k, "i8"), np.full(k, -1, "i8")
        kept = [np.zeros(0, "i8") for _ in range(4)]  # item, score, id, rid

        def prune() -> None:
            nonlocal kept
            order = np.lexsort((kept[3], kept[2], -kept[1], kept[0]))
            item = kept[0][order]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            kept = [c[order[place < top]] for c in kept]
            full = np.flatnonzero(place[place < top] == top - 1)
            worst[kept[0][full]], worst_id[kept[0][full]] = kept[1][full], kept[2][full]

        for whole in batches:
            for a in range(0, whole.num_rows, DOCS):
                b = whole.slice(a, DOCS)
                score = items.scores(b, documents, length)
                ids = b.column("doc_id").fill_null(last).to_numpy()[:, None]
                doc, item = np.nonzero((score > worst) | (score == worst) & (ids < worst_id))
                more = item, score[doc, item], ids[doc, 0], b.column("rid").to_numpy()[doc]
                kept = [np.concatenate(c) for c in zip(kept, more, strict=True)]
                prune()
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(items.items[kept[0]]), pa.array(kept[3]), pa.array(kept[2], mask=kept[2] == last), pa.array(kept[1])], names=["qid", "rid", "doc_id", "score"])

    return forward.select("rid", "doc_id", "n", "terms", "tfs").mapInArrow(run, "qid long, rid long, doc_id long, score long")


def _blocks(query: DataFrame) -> Iterator[list[tuple[int, str, int]]]:
    """Items in blocks, by their numbers; one block at a time is on the driver."""
    sizes = query.groupBy("qid").agg(F.count("*").alias("pairs"))
    after = -1
    while True:
        some = sizes.where(F.col("qid") > after).orderBy("qid").limit(ITEMS).collect()
        if not some:
            return
        upto, pairs = some[0].qid, 0
        for r in some:
            pairs += r.pairs
            if pairs > PAIRS and r.qid != some[0].qid:
                break
            upto = r.qid
        yield [(r.qid, r.term, r.qw) for r in query.where((F.col("qid") > after) & (F.col("qid") <= upto)).select("qid", "term", "qw").collect()]
        after = upto


def search(docs: DataFrame, items: DataFrame, *, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of every item."""
    spark = docs.sparkSession
    with temporary(spark):
        forward = stage(forward_index(docs, id_col, text_col), "search-forward")
        # Items' own numbers, kept with their ids; an id may be of any type.
        named = stage(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")).withColumn("qid", F.monotonically_increasing_id()), "search-items")
        terms = forward_index(named, "qid", "item_text").select(F.col("doc_id").alias("qid"), F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("qid", F.col("p.terms").alias("term"), F.col("p.tfs").alias("qf"))
        documents, length = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        length = max(length, 1)
        postings = _postings(forward, documents, length)
        lexicon = stage(_lexicon(postings, terms.select("term").distinct(), documents), "search-lexicon")
        query = stage(terms.join(lexicon, "term").withColumn("qw", F.col("qf") * F.col("w")), "search-query")
        found = []
        for k in range(len(TIERS)):
            answers, proved = _tier(k, query, forward, postings, documents, length, top)
            found.append(answers)
            query = stage(query.join(proved, "qid", "left_anti"), "search-query")
            if query.isEmpty():
                break
        for block in _blocks(query):
            rows = _scan(block, forward, documents, length, top)
            found.append(stage(_best(rows, "score", top, F.asc_nulls_last("doc_id"), F.col("rid")).select("qid", "rid", "doc_id", "score"), "search-answers"))
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        ranked = _best(every.where("score > 0"), "score", top, F.asc_nulls_last("doc_id"), F.col("rid"))
        return stage(ranked.join(named.select("qid", "item_id"), "qid").select("item_id", "rank", "doc_id", "score"), "search-ranked", keep=True)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t),
q AS (SELECT q, item_id, t, count(*) AS qf FROM (SELECT q, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
x AS (SELECT q, item_id, r, doc_id, sum(qf * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN p USING (t), s GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS rank FROM x WHERE score > 0) WHERE rank <= 10
"""
