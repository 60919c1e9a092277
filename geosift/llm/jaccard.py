"""Exact n-gram Jaccard self-join by set relations.

A text's set is its distinct word shingles. Relations between sets save most of the work of a prefix join:

- Equal sets have equal answers: they become one class, and the join runs over classes.
- Tokens of lists of HOT sets or more come last in the global order, the more sets hold them the later. Sets that have
  hardly any others are near copies: of those in one such list the one with the largest share of such tokens is
  the pivot, and the pivots' shingles that HOT of these sets or more hold come last, too. So a set that is no
  partner of its pivot is indexed by its difference to it.
- A set that was compared with another one is described by the difference to that: what it has besides, and what
  it lacks. For two sets of one pivot the overlap is derived from the pivot's answers and the two differences.

Index lists hold the first tokens of each set in a global order, rare ones first. A list entry carries the
set's size and the token's position. A set indexes its first n - ceil(t n) + 1 tokens only; lists are cut into
blocks by size, and a set skips the blocks of sizes for which its token stands too far back: a partner with
which it must share `need` tokens is met within the first n - need + 1 (see _needed). A pair is a candidate if
its meetings and the tokens that are left after the last one suffice. Sets too small for an unequal
partner at the threshold (least_shared) are in no list.

The order decides cost, never results. A shingle's place comes from the frequencies of its words, counted over all
documents, and from the pivots.

Sets are first compared with the heads of their lists, which unites near copies without comparing them with each
other. Then pairs of sets in different components are, those that meet most often first. No pair of
two sets that are already in one component is compared.

Defined results:
- null, empty and blank texts: n_shingles 0, linked with nothing, component_id = own id.
- null ids: counted in n_shingles, linked with nothing, component_id null.
- rows with equal ids are rows of their own; equal texts are linked.
- texts of any length are taken whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geosift.llm.common import release, small, small_batches, stage, temporary, unstage, unused
from geosift.llm.graph import components

HOT = 16  # sets of a list from which on its token comes last
ROUNDS = 2  # of looking for such lists
TOKENS = 500_000  # shingles (16 bytes each) up to which those that come last are sent to all tasks
BAND = 1.05  # sizes of a block differ by this factor at most
COMMON_WORD = 20_000  # a word is common from one in so many words on: at most so many words are
CACHE = 200_000  # words a task remembers
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # odd multipliers of a 64-bit finaliser


class Shingler:
    """Texts to sorted arrays of shingle keys: 7 bits of frequency class above 56 bits of hash."""

    def __init__(self, width: int, common: dict[bytes, int]):
        self.width, self.common = width, common
        self.powers = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64)) for k in range(width)]
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.hashes, self.bits = array("Q"), array("B")

    def _index(self, words: list[bytes]) -> np.ndarray:
        at = self.at
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = at.get(w)
            if k is None:
                k = at[w] = len(at)
                self.hashes.append(xxhash.xxh3_64_intdigest(w))
                self.bits.append(self.common.get(w, 16))
            out[i] = k
        return out

    def keys(self, text: str | None) -> np.ndarray:
        """Distinct keys in ascending order, rare shingles first; fewer words than the width: one shingle."""
        words = words_of(text)
        if not words:
            return np.empty(0, np.int64)
        if len(self.at) > CACHE:
            self._forget()
        k = self._index(words)
        h, b = np.frombuffer(self.hashes, np.uint64)[k], np.frombuffer(self.bits, np.uint8)[k]
        w = min(self.width, len(words))
        n = len(words) - w + 1
        total, bits = np.full(n, w * MIX[0] % 2**64, np.uint64), np.zeros(n, np.int64)
        for j in range(w):
            total += (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29))) * self.powers[j]
            bits += b[j : j + n]
        total ^= total >> np.uint64(31)
        total *= np.uint64(MIX[1])
        total ^= total >> np.uint64(33)
        level = np.clip(64 - bits, 0, 64).astype(np.uint64)
        return np.unique(total >> np.uint64(8) | level << np.uint64(56)).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased: exactly what bytes.split and bytes.lower do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def least_shared(percent: int) -> int | None:
    """Tokens that unequal partners share at least: of o shared ones in a union of o + 1 or more, o / (o + 1) >= t.

    Smaller sets have equal partners only. None: all sets do.
    """
    return -(-percent // (100 - percent)) if percent < 100 else None


def prefix_size(n: int, percent: int) -> int:
    """Tokens a set of n indexes, at least one of those it shares with any partner; none where only equal sets can be partners."""
    least = least_shared(percent)
    return 0 if least is None or n < least else n + percent * -n // 100 + 1


def front_size(n: int, percent: int) -> int:
    """First tokens of a set of n that are kept at hand: enough for its index in most orders."""
    size = prefix_size(n, percent)
    return min(n, 2 * size + 8) if size else 0


def common_words(docs: DataFrame) -> dict[bytes, int]:
    """Words that make up at least 1 / COMMON_WORD of all words, with -log2 of their share.

    Each task counts all its words and sends those with at least half that share of its own words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = 0

        def flush() -> pa.RecordBatch:
            rows = [(w, n) for w, n in seen.items() if n * COMMON_WORD * 2 >= total]
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in rows] + [b""], pa.binary()), pa.array([n for _, n in rows] + [0], pa.int64()),
                 pa.array([0] * len(rows) + [total], pa.int64())], names=["w", "n", "total"])

        for batch in batches:
            for t in batch.column("text"):
                w = words_of(t.as_py())
                total += len(w)
                seen.update(w)
                if len(seen) > CACHE:
                    yield flush()
                    seen, total = Counter(), 0
        yield flush()

    counted = docs.select("text").mapInArrow(count, "w binary, n long, total long")
    sums = stage(counted.groupBy("w").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "jac-words")
    total = sums.agg(F.max("total")).first()[0] or 0
    rows = sums.where((F.col("n") * COMMON_WORD >= total) & (F.col("n") > 0)).collect()  # at most COMMON_WORD rows
    return {bytes(r["w"]): min(16, int(np.log2(total / r["n"]))) for r in rows}


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.int64)]), pa.int64()))


def signatures(docs: DataFrame, shingler: tuple, percent: int) -> DataFrame:
    """doc_id, text_hash, n, digest of the set, front (first tokens; none where only equal sets can be partners)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(*shingler)
        for batch in batches:
            n, digest, front = [], [], []
            for t in batch.column("text"):
                k = s.keys(t.as_py())
                n.append(len(k))
                digest.append(xxhash.xxh3_128_digest(k.tobytes()))
                front.append(k[: front_size(len(k), percent)].copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(front)],
                names=["doc_id", "text_hash", "n", "digest", "front"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        sign, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n long, digest binary, front array<long>")


class Texts:
    """The documents, what their shingles are made with, and whether rows of equal id and text occur."""

    def __init__(self, docs: DataFrame, shingler: tuple, repeated: bool):
        self.docs, self.shingler, self.repeated, self.spark = docs, shingler, repeated, docs.sparkSession


def class_sets(owners: DataFrame, texts: Texts) -> DataFrame:
    """owners (cid, digest, doc_id, text_hash, ...) -> cid, n, keys: the sets, made again from these texts; no others are moved."""
    shingler = texts.shingler

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(*shingler)
        for batch in batches:
            cid, keys = [], []
            for c, want, t in zip(*(batch.column(x) for x in ("cid", "digest", "text")), strict=True):
                k = s.keys(t.as_py())
                if xxhash.xxh3_128_digest(k.tobytes()) == want.as_py():
                    cid.append(c.as_py())
                    keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(list(map(len, keys)), pa.int64()), _lists(keys)], names=["cid", "n", "keys"])

    wanted = small(stage(owners.select("cid", "digest", "doc_id", "text_hash"), "jac-wanted"))
    rows = texts.docs.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"])
    if texts.repeated:
        rows = rows.groupBy("doc_id", "text_hash").agg(*[F.first(c).alias(c) for c in ("cid", "digest", "text")])
    return stage(rows.select("cid", "digest", "text").mapInArrow(make, SETS), "jac-sets")


SETS = "cid long, n long, keys array<long>"


def _entries(prefixes: DataFrame) -> DataFrame:
    """prefixes (cid, n, prefix) -> cid, n, pos, token."""
    return prefixes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))


def _shared(entries: DataFrame) -> DataFrame:
    """Entries of lists with more than one set."""
    more = entries.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1").select("token")
    return entries.join(more, "token", "left_semi")


def _places(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted array; -1: it is not there."""
    if not len(sorted_):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


def _holders(sets: DataFrame, tokens: DataFrame) -> DataFrame:
    """token, sets: how many of sets (cid, n, keys) hold each of the tokens."""
    tokens = stage(tokens.select("token").distinct(), "jac-tokens")
    if tokens.count() > TOKENS:
        return sets.select(F.explode("keys").alias("token")).join(tokens, "token").groupBy("token").agg(F.count("*").alias("sets"))
    wanted = np.sort(tokens.toPandas()["token"].to_numpy(np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(wanted) + 1, np.int64)  # the last for those not wanted
        for b in batches:
            np.add.at(held, _places(wanted, b.column("keys").flatten().to_numpy(zero_copy_only=False)), 1)
        some = np.nonzero(held[:-1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(held[some])], names=["token", "sets"])

    return sets.select("keys").mapInArrow(count, "token long, sets long").groupBy("token").agg(F.sum("sets").alias("sets"))


class _Late:
    """Shingles that come last (token, sets), as a table, and sorted at hand if they are not too many."""

    def __init__(self, table: DataFrame):
        self.table, self.n = table, table.count()
        self.tokens = self.sets = None
        if self.n <= TOKENS:
            rows = table.orderBy("token").toPandas()
            self.tokens, self.sets = rows["token"].to_numpy(np.int64), rows["sets"].to_numpy(np.int64)

    def prefixes(self, rows: DataFrame, column: str, percent: int) -> DataFrame:
        """cid, n, prefix, short of sets (cid, n, column: all of its tokens or the first ones); short: these do not suffice."""
        if self.tokens is None:
            each = rows.select("cid", "n", F.explode(column).alias("token")).join(self.table, "token", "left")
            order = F.array_sort(F.collect_list(F.struct(F.coalesce("sets", F.lit(0)).alias("sets"), "token")))  # one set, no more
            size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
            each = each.groupBy("cid", "n").agg(order.alias("k"), F.sum(F.col("sets").isNull().cast("int")).alias("early"))
            prefix = F.transform(F.slice("k", F.lit(1), size.cast("int")), lambda k: k["token"])
            return each.select("cid", "n", prefix.alias("prefix"), ((F.col("early") < size) & (F.size("k") < F.col("n"))).alias("short"))
        tokens, sets = self.tokens, np.append(self.sets, 0)

        def order_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out, short = [], []
                for n, k in zip(b.column("n").to_pylist(), b.column(column), strict=True):
                    v, size = k.values.to_numpy(zero_copy_only=False), prefix_size(n, percent)
                    rank = sets[_places(tokens, v)]
                    out.append(v[np.lexsort((v, rank))[:size]])
                    short.append(len(v) < n and int((rank == 0).sum()) < size)
                yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("n"), _lists(out), pa.array(short, pa.bool_())], names=["cid", "n", "prefix", "short"])

        return rows.select("cid", "n", column).mapInArrow(order_, "cid long, n long, prefix array<long>, short boolean")


def _more(last: DataFrame | None, found: DataFrame) -> DataFrame:
    """Both tables (token, sets) in one; of two counts the larger."""
    both = found if last is None else last.unionByName(found)
    return stage(both.groupBy("token").agg(F.max("sets").alias("sets")), "jac-last")


def ordered_prefixes(owners: DataFrame, texts: Texts, percent: int) -> tuple[DataFrame, DataFrame]:
    """owners (cid, digest, doc_id, text_hash, n, front) -> cid, n, prefix in the final order; and the sets that this took
    (cid, n, keys)."""
    last = stage(texts.spark.createDataFrame([], "token long, sets long"), "jac-last")
    late = _Late(last)
    for _ in range(ROUNDS):
        prefixes = stage(late.prefixes(owners, "front", percent), "jac-prefixes")
        sizes = _entries(prefixes.where("not short")).groupBy("token").agg(F.count("*").alias("sets"))
        last = _more(last, sizes.where(F.col("sets") >= HOT))
        release(texts.spark)
        before, late = late, _Late(last)
        unstage(prefixes)
        if late.n == before.n:
            break
    # Near copies: sets that have too few other tokens in front.
    short = stage(late.prefixes(owners, "front", percent).where("short").select("cid"), "jac-short")
    near = owners.join(short, "cid", "left_semi")
    sets = class_sets(near, texts)
    release(texts.spark)
    hot = near.select("cid", F.size("front").alias("size"), F.explode("front").alias("token")).join(small(last, TOKENS), "token")
    hot = stage(hot.select("cid", "size", "token"), "jac-hot")
    share = hot.groupBy("cid").agg((F.count("*") / F.max("size")).alias("share"))
    pivots = hot.join(share, "cid").groupBy("token").agg(F.max(F.struct("share", "cid")).alias("p")).select("p.cid").distinct()
    held = _holders(sets, sets.join(pivots, "cid", "left_semi").select(F.explode("keys").alias("token")))
    late = _Late(_more(last, held.where(F.col("sets") >= HOT)))
    others = owners.join(sets.select("cid"), "cid", "left_anti")
    prefixes = stage(late.prefixes(others, "front", percent), "jac-prefixes")
    release(texts.spark)
    more = class_sets(owners.join(prefixes.where("short").select("cid"), "cid", "left_semi"), texts)
    sets = sets.unionByName(more)
    whole = late.prefixes(sets, "keys", percent)
    return stage(prefixes.where("not short").unionByName(whole).drop("short"), "jac-prefixes"), sets


def _needed(n1: Column, n2: Column, percent: int) -> Column:
    """Tokens that sets of these sizes share at least if they are partners.

    A set of n has at most n - need tokens of its own, so one of the shared ones is among its first n - need + 1: an
    entry further back is skipped for this partner.
    """
    return F.ceil((n1 + n2) * percent / (100 + percent))


def _similar(percent: int) -> Column:
    return F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """met (a, na, pa, b, nb, pb), a row a meeting -> a, b, k (meetings): pairs that have enough tokens left after the last one."""
    k = met.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("k"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    return k.where(F.col("k") + left >= _needed(F.col("na"), F.col("nb"), percent)).select("a", "b", "k")


def _in_front(percent: int) -> Column:
    """Whether both positions are among those in which partners of these sizes meet."""
    na, nb = F.col("na"), F.col("nb")
    need = _needed(na, nb, percent)
    return (need <= na - F.col("pa")) & (need <= nb - F.col("pb"))


def head_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Candidates a, b, k of each set with the heads of its lists, the sets in which the token stands furthest in front."""
    heads = lists.groupBy("token").agg(F.min(F.struct("pos", "n", "cid")).alias("h"))
    met = lists.join(heads, "token").select(
        F.col("cid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("h.cid").alias("b"), F.col("h.n").alias("nb"), F.col("h.pos").alias("pb"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return _candidates(met.where((F.col("a") != F.col("b")) & fits & _in_front(percent)), percent)


def block_pairs(lists: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Candidates a, b, k of sets in different components; a is the larger set of the two.

    A block is a list's entries of one size band that can meet a set of their size or more. The larger set looks
    into the blocks of those sizes for which its own entry is in front enough.
    """
    band = lambda size: F.floor(F.log(size) / math.log(BAND)).cast("int")
    placed = lists.join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    open_ = placed.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("token")
    placed = stage(placed.join(open_, "token", "left_semi"), "jac-open")
    n, pos = F.col("n"), F.col("pos")
    blocks = placed.where(_needed(n, n, percent) <= n - pos).select(
        "token", band(n).alias("band"), F.col("cid").alias("b"), n.alias("nb"), pos.alias("pb"), F.col("comp").alias("cb"))
    most = F.floor((n - pos) * (100 + percent) / percent) - n  # the largest partner that this entry can meet
    least = F.ceil(n * percent / 100)
    probes = placed.withColumn("most", F.least(n, most)).where(F.col("most") >= least).select(
        "token", F.explode(F.sequence(band(least), band(F.col("most")))).alias("band"), F.col("cid").alias("a"), n.alias("na"), pos.alias("pa"), F.col("comp").alias("ca"))
    na, nb = F.col("na"), F.col("nb")
    larger = (na > nb) | ((na == nb) & (F.col("a") > F.col("b")))
    met = probes.join(blocks, ["token", "band"]).where((F.col("ca") != F.col("cb")) & larger & (nb * 100 >= na * percent) & _in_front(percent))
    return _candidates(met.select("a", "na", "pa", "b", "nb", "pb"), percent)


def overlaps(pairs: DataFrame, sets: DataFrame, pivots: DataFrame | None = None) -> DataFrame:
    """pairs (a, b) of class ids -> a, b, na, nb, both (exact intersection sizes), own, lost (a without b, b without a).

    With pivots (cid, pivot, n, size, own, lost): two sets x, y of one pivot p share what p has and neither lacks,
    |p| - |lost x + lost y|, and what they have in common besides; own and lost are null then.
    """
    pairs = pairs.select("a", "b")
    array_ = "array<bigint>"
    if pivots is not None:
        for x in ("a", "b"):
            pairs = pairs.join(pivots.select(F.col("cid").alias(x), F.col("pivot").alias(f"p{x}")), x, "left")
        pairs = stage(pairs.select("a", "b", F.coalesce(F.col("pa") == F.col("pb"), F.lit(False)).alias("one")), "jac-pairs")
        derived = pairs.where("one").select("a", "b")
        for x in ("a", "b"):
            derived = derived.join(pivots.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "size", "own", "lost")]), x)
        both = F.col("sizea") - F.size(F.array_union("losta", "lostb")) + F.size(F.array_intersect("owna", "ownb"))
        none = F.lit(None).cast(array_)
        derived = derived.select("a", "b", "na", "nb", both.cast("long").alias("both"), none.alias("own"), none.alias("lost"))
        pairs = pairs.where("not one").select("a", "b")
    # A pivot's set moves to each of its partners; a pivot with many of them is split by the join (AQE).
    for x in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("keys").alias(f"k{x}")), x)
    pairs = pairs.withColumn("both", F.size(F.array_intersect("ka", "kb")).cast("long"))
    if pivots is not None:
        none = F.lit(None).cast(array_)
        return pairs.select("a", "b", "na", "nb", "both", none.alias("own"), none.alias("lost")).unionByName(derived)
    alike = F.col("both") * 2 >= F.greatest("na", "nb")  # else the difference is no shorter than the set
    return pairs.select("a", "b", "na", "nb", "both", F.when(alike, F.array_except("ka", "kb")).alias("own"), F.when(alike, F.array_except("kb", "ka")).alias("lost"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose ends are in different components of comp (id, comp)."""
    out = pairs
    for x in ("a", "b"):
        out = out.join(comp.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    return out.where("ca <> cb").select(*pairs.columns)


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (id, comp) after further links (a, b): components of components, which are few."""
    for x in ("a", "b"):
        links = links.join(comp.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")), x, "left").withColumn(x, F.coalesce(f"c{x}", x)).drop(f"c{x}")
    links = stage(links.where("a <> b").distinct(), "jac-merge")
    if links.isEmpty():
        return comp
    over = components(links).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    moved = comp.join(over, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    # Ids that had no link before stand for themselves.
    new = over.select(F.col("comp").alias("id"), F.col("to").alias("comp")).join(comp.select("id"), "id", "left_anti")
    return stage(moved.unionByName(new), "jac-comp")


def settle(pairs: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, pivots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """comp after all links among pairs (a, b, k), and what the first comparison found (as overlaps).

    Each set is compared with the one it meets most often; then all pairs that are still in two components are.
    """
    first = None
    for last in (False, True):
        pairs = stage(_apart(pairs, comp), "jac-apart")
        pick = pairs if last else pairs.groupBy("a").agg(F.max(F.struct("k", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        found = stage(overlaps(pick, sets, pivots), "jac-overlaps")
        first = found if first is None else first
        comp = _merged(comp, found.where(_similar(percent)).select("a", "b"))
        release(comp.sparkSession)  # what was broadcast stays on the executors until then
        pairs = pairs.join(found.select("a", "b"), ["a", "b"], "left_anti")
    return comp, first


def class_components(owners: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """owners (cid, digest, doc_id, text_hash, n, front) -> id, comp of the classes that have links (see components)."""
    comp = texts.spark.createDataFrame([], "id long, comp long")
    prefixes, sets = ordered_prefixes(owners, texts, percent)
    lists = stage(_shared(_entries(prefixes)), "jac-lists")
    owners = owners.select("cid", "digest", "doc_id", "text_hash")
    release(texts.spark)

    def with_sets(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        missing = ends.join(sets.select("cid"), "cid", "left_anti")
        return sets.unionByName(class_sets(owners.join(missing, "cid", "left_semi"), texts))

    heads = stage(head_pairs(lists, percent), "jac-heads")
    sets = with_sets(heads)
    release(texts.spark)
    comp, first = settle(heads, comp, sets, percent)
    release(texts.spark)
    pivots = first.where("own is not null").select(
        F.col("a").alias("cid"), F.col("b").alias("pivot"), F.col("na").alias("n"), F.col("nb").alias("size"), "own", "lost")
    # Every pair with a head is compared, or in one component.
    pairs = block_pairs(lists, comp, percent).withColumns({"hi": F.greatest("a", "b"), "lo": F.least("a", "b")})
    done = heads.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    pairs = stage(pairs.join(done, ["hi", "lo"], "left_anti").select("a", "b", "k"), "jac-pairs")
    release(texts.spark)
    sets = with_sets(pairs)
    return settle(pairs, comp, sets, percent, pivots)[0]


def jaccard_links(docs: DataFrame, *, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> signatures (doc_id, text_hash, n, digest) and classes (cid, digest, owner, comp).

    A class is a set, owner the smallest id that has it, comp a cid that all classes share which links connect.
    """
    small_batches(docs.sparkSession)
    with temporary(docs.sparkSession):
        shingler = (width, common_words(docs))
        full = stage(signatures(docs, shingler, percent).withColumn("row", F.monotonically_increasing_id()), "jac-full")
        sig = stage(full.drop("front"), "jac-sig", keep=True)
        known = sig.where("doc_id is not null")
        classes = known.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("o"))
        classes = stage(classes.select("digest", F.col("o.doc_id").alias("owner"), F.col("o.row").alias("row"), F.monotonically_increasing_id().alias("cid")), "jac-classes")
        owners = full.where("size(front) > 0").select("row", "digest", "doc_id", "text_hash", "n", "front").join(classes.select("row", "cid"), "row")
        owners = stage(owners.drop("row"), "jac-owners")
        unstage(full)
        repeated = not known.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()
        release(docs.sparkSession)
        comp = class_components(owners, Texts(docs, shingler, repeated), percent)
        out = classes.join(comp.withColumnRenamed("id", "cid"), "cid", "left").select("cid", "digest", "owner", F.coalesce("comp", "cid").alias("comp"))
        return sig.select("doc_id", "text_hash", "n", "digest"), stage(out, "jac-comps", keep=True)


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                 percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, text_hash for every row of docs; see the module's text.

    class_id is the smallest id with an equal set.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sig, classes = jaccard_links(slim, width=width, percent=percent)
    first = classes.groupBy("comp").agg(F.min("owner").alias("component_id"))
    named = classes.join(first, "comp").select("digest", F.col("owner").alias("class_id"), "component_id")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    # A class may hold a third of all rows; this join is one that Spark splits.
    return sig.join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "text_hash")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
             percent: int = 80) -> DataFrame:
    """One row of each component: that with the smallest id (then text hash). Rows with a null id or no words all stay."""
    rows = stage(jaccard_join(docs, id_col=id_col, text_col=text_col, width=width, percent=percent).where(
        "n_shingles > 0 and doc_id is not null"), "jac-rows")
    kept = rows.where("doc_id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("kept_hash"), F.count("*").alias("k"))
    kept = stage(kept, "jac-kept")
    gone = rows.join(kept.select(F.col("component_id").alias("doc_id"), F.col("kept_hash").alias("text_hash")), ["doc_id", "text_hash"], "left_anti")
    id_, hash_ = unused("gone_id", docs), unused("gone_hash", docs)
    gone = gone.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    key = F.xxhash64(docs[text_col])
    stay = docs.join(gone, (docs[id_col] == F.col(id_)) & (key == F.col(hash_)), "left_anti")
    twice = kept.where("k > 1").select(F.col("component_id").alias(id_))
    if twice.isEmpty():
        return stay
    # Repeated rows: ids are not unique here.
    once = stay.join(twice, stay[id_col] == F.col(id_), "left_semi").dropDuplicates([id_col, text_col])
    return stay.join(twice, stay[id_col] == F.col(id_), "left_anti").unionByName(once)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_join(docs, width=4, percent=85).select("doc_id", "n_shingles", "component_id")


# Brute force: every two sets that share a shingle, and the smallest id that links reach.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 0) + 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS k FROM w),
n AS (SELECT doc_id, len(k)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(k) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.b, r.c FROM r JOIN t ON t.a = r.x WHERE r.c < t.b)
SELECT n.doc_id, n.n AS n_shingles, c.c AS component_id FROM n JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) c ON c.x = n.doc_id
"""
