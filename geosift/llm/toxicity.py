"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, applies NFKC, maps look-alike Cyrillic and Greek letters to Latin ones, drops
invisible characters, reads digits next to letters and symbols between letters as the letters they stand
for, and turns everything that is not a letter or digit into one space. The lexicon holds whole words and
word beginnings with a weight, the log-odds of being in a toxic rather than a clean document. In each
word the longest entry counts. Exception phrases (a word, or a word with a neighbour) that contain an
entry and yet belong to clean documents cancel it. The sum of weights is divided by a power of the
number of words, and a logistic curve turns it into a score.

The lexicon, the exceptions, the power and the curve are fitted on a bounded sample of labelled rows
(FIT_ROWS of each class, those with the smallest hash of their id). Rows that are held out (crc32 of the
id modulo 5 is 0) are never read for that. Scoring takes every whole text.

Defined results:
- null, empty and wordless texts have no match: they get the curve's value at 0, below 0.5.
- null ids are held out (they cannot be labelled); repeated rows get equal scores.
- conflicting labels of one id: the larger one counts. Labels other than 0 and 1 are ignored.
- no usable labels, or one class only: the seed lexicon with a fixed curve.
- empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geosift.llm.common import small_batches, stage

FIT_ROWS = 10_000  # labelled rows of each class that the fit reads at most
COPY_HASHES = 3  # minima by which near copies are known
MAX_ENTRIES = 5_000  # lexicon entries and exceptions that a model holds at most
PREFIXES = range(4, 8)  # lengths of word beginnings
MIN_WEIGHT = 2.5  # log-odds of an entry at least
MIN_DOCS, MIN_SHARE = 4, 0.004  # toxic documents of the sample that an entry needs: a number and a share

# Letters that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "аеорсухівһԁɡοανικρτυωςԛԝѕјӏ",
    "aeopcyxibhdgoavikptuwcqwsjl",
) | dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"))
# What digits and symbols stand for.
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasil")
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting", "trash", "clown")

_ODD = re.compile("[\u00ad\u0250-\u058f\u200b-\u200f\u2060\ufeff]")
_DIGIT = re.compile(r"(?<=[^\W\d_])[0-9]+|[0-9]+(?=[^\W\d_])")
_SYMBOL = re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])")
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words with one space between them and one at either end; ' ' if there are none."""
    if not text:
        return " "
    t = unicodedata.normalize("NFKC", text).lower()
    if _ODD.search(t):
        t = t.translate(HOMOGLYPHS)
    t = _SYMBOL.sub(lambda m: m[0].translate(SUBSTITUTES), t)
    t = _DIGIT.sub(lambda m: m[0].translate(SUBSTITUTES), t)
    t = _GAP.sub(" ", t)
    return f" {t.strip(' ')} " if t.strip(" ") else " "


@dataclass
class Lexicon:
    """entries: ' word ' or ' beginning' -> weight; exceptions: ' word ' or ' word word '."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.5
    slope: float = 2.0
    bias: float = -3.0

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for p, w in self.entries.items():
            a.add_word(p, (len(p), w))
        for p in self.exceptions:
            a.add_word(p, (len(p), None))
        if len(a):
            a.make_automaton()
        return a

    def probability(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = self.slope * total / np.maximum(words, 1) ** self.power + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def hits(automaton: ahocorasick.Automaton, folded: str) -> list[tuple[int, float]]:
    """(start, weight) for each word with a match that no exception covers; the longest entry counts."""
    found: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (n, w) in automaton.iter(folded):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            elif n > found.get(start, (0, 0.0))[0]:
                found[start] = (n, w)
    if not spared or not found:
        return [(s, w) for s, (_, w) in found.items()]
    starts, ends = np.array(spared).T
    order = np.argsort(starts)
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    at = np.array(list(found))
    i = np.searchsorted(starts, at, "right") - 1  # of the phrases that begin up to there, the furthest end counts
    free = (i < 0) | (ends[np.maximum(i, 0)] <= at)
    return [(s, w) for (s, (_, w)), ok in zip(found.items(), free, strict=True) if ok]


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """toxic, text of at most `rows` labelled rows of each class that are not held out."""
    known = labels.select(F.col("doc_id").alias("lid"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.col("lid").isNotNull() & ~held_out(F.col("lid")))
    known = known.groupBy("lid").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64(F.col("lid").cast("string")))
    pick = [known.where(F.col("toxic") == y).orderBy("h", "lid").limit(rows) for y in (0, 1)]
    pick = stage(pick[0].unionByName(pick[1]).select("lid", "toxic"), "tox-ids")
    # At most 2 * rows ids: bounded, so broadcast. Near copies would count their every word several times
    # over, so of the texts that agree in the smallest of their shingle hashes by each of COPY_HASHES functions
    # one is kept: that of the smallest id.
    found = docs.join(F.broadcast(pick), docs["doc_id"] == pick["lid"]).select("toxic", "lid", "text")
    kind = dict(found.dtypes)["lid"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = []
            for t in b.column("text"):
                w = fold(t.as_py()).split()
                h = np.unique(np.array([xxhash.xxh3_64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))], np.uint64))
                low.append(xxhash.xxh3_64_intdigest(np.array([((h ^ (h >> np.uint64(29))) * np.uint64(2 * k + 0x9E3779B97F4A7C15)).min() for k in range(COPY_HASHES)]).tobytes()) >> 1)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("lid"), b.column("text"), pa.array(low, pa.int64())], names=["toxic", "lid", "text", "low"])

    marked = found.mapInArrow(mark, f"toxic int, lid {kind}, text string, low long")
    one = marked.groupBy("toxic", "low").agg(F.min(F.struct("lid", "text")).alias("row"))
    return stage(one.select("toxic", "row.text"), "tox-rows")


def _counts(rows: DataFrame, terms_of, wanted: Column) -> dict[str, tuple[int, int]]:
    """Documents of each class that hold each term, p toxic and n clean, where wanted; terms_of: folded text -> terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for b in batches:
            for y, t in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen[y].update(terms_of(fold(t)))
        terms = list(seen[1] | seen[0])
        yield pa.RecordBatch.from_pydict({"term": terms, "p": [seen[1][t] for t in terms], "n": [seen[0][t] for t in terms]},
                                         schema=pa.schema([("term", pa.string()), ("p", pa.int64()), ("n", pa.int64())]))

    sums = rows.mapInArrow(count, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return {r["term"]: (r["p"], r["n"]) for r in sums.where(wanted).collect()}  # of a bounded sample


def word_terms(folded: str) -> set[str]:
    words = set(folded.split())
    terms = {f" {w} " for w in words if len(w) > 1}
    terms |= {f" {w[:k]}" for w in words for k in PREFIXES if len(w) > k}
    return terms


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS) -> Lexicon:
    """Learn a lexicon from docs (doc_id, text) and labels (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    train = training_rows(docs, labels, rows)
    size = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return Lexicon({f" {w}": 4.0 for w in SEEDS})
    weigh = lambda p, n: float(np.log((p + 0.5) / (size[1] + 1)) - np.log((n + 0.5) / (size[0] + 1)))
    odds = F.log((F.col("p") + 0.5) / (size[1] + 1)) - F.log((F.col("n") + 0.5) / (size[0] + 1))
    support = max(MIN_DOCS, int(MIN_SHARE * size[1]))
    counted = _counts(train, word_terms, (F.col("p") >= support) & (odds >= MIN_WEIGHT))
    # A beginning stands for several words; one that a single word accounts for adds nothing to that word.
    top: dict[str, int] = {}
    for t, (p, _) in counted.items():
        if t.endswith(" "):
            for k in PREFIXES:
                top[t[: k + 1]] = max(top.get(t[: k + 1], 0), p)
    weights = {t: weigh(p, n) for t, (p, n) in counted.items() if t.endswith(" ") or top.get(t, 0) <= p / 2}
    best = sorted(weights, key=lambda t: (-weights[t] * np.log1p(counted[t][0]), t))[:MAX_ENTRIES]
    lexicon = Lexicon({t: weights[t] for t in best})
    entries = lexicon.entries

    def phrases(folded: str) -> set[str]:
        a, out = lexicon.automaton(), set()
        words = folded.split()
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        for s, _ in hits(a, folded):
            i = int(np.searchsorted(starts, s))
            out.add(f" {words[i]} ")
            if i:
                out.add(f" {words[i - 1]} {words[i]} ")
            if i + 1 < len(words):
                out.add(f" {words[i]} {words[i + 1]} ")
        return out

    spared = _counts(train, phrases, (F.col("n") >= MIN_DOCS) & (odds < 0.5))
    clean = {t: weigh(p, n) for t, (p, n) in spared.items() if t not in entries}
    lexicon.exceptions = sorted(clean, key=lambda t: (clean[t], t))[:MAX_ENTRIES]
    scored = sums(train, lexicon, "toxic").select("toxic", "total", "words").toPandas()  # at most 2 * rows rows
    _fit_curve(lexicon, scored["toxic"].to_numpy(float), scored["total"].to_numpy(float), scored["words"].to_numpy(float))
    return lexicon


def _fit_curve(lexicon: Lexicon, y: np.ndarray, total: np.ndarray, words: np.ndarray) -> None:
    """Power, slope and bias of the largest likelihood under a light ridge; classes weigh the same."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    best = np.inf
    for power in (0.25, 0.5, 0.75, 1.0):
        x = total / np.maximum(words, 1) ** power
        scale = x[x > 0].mean() if (x > 0).any() else 1.0
        design = np.column_stack([x / scale, np.ones_like(x)])
        theta = np.array([1.0, -0.5])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            grad = design.T @ (weight * (p - y)) + 0.01 * theta
            hess = design.T @ (design * (weight * p * (1 - p))[:, None]) + 0.01 * np.eye(2)
            theta = theta - np.clip(np.linalg.solve(hess, grad), -2, 2)
        p = np.clip(1 / (1 + np.exp(-np.clip(design @ theta, -30, 30))), 1e-12, 1 - 1e-12)
        loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.005 * theta @ theta
        if loss < best and theta[0] > 0:
            best = loss
            lexicon.power, lexicon.slope, lexicon.bias = power, float(theta[0] / scale), float(min(theta[1], -0.1))


def sums(rows: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """keep columns, total (weight sum), words, n_hits, terms (the words that matched) of rows (keep..., text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            total, words, n, terms = [], [], [], []
            for t in b.column("text"):
                f = fold(t.as_py())
                found = hits(a, f)
                total.append(sum(w for _, w in found))
                words.append(f.count(" ") - 1)
                n.append(len(found))
                terms.append(sorted({f[s + 1 : f.index(" ", s + 1)] for s, _ in found}))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(total, pa.float64()), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string()))],
                names=[*keep, "total", "words", "n_hits", "terms"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "text").mapInArrow(
        run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", total double, words long, n_hits long, terms array<string>")


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted, n_hits, terms for every row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    z = F.lit(lexicon.slope) * F.col("total") / F.pow(F.greatest(F.col("words"), F.lit(1)).cast("double"), F.lit(lexicon.power)) + F.lit(lexicon.bias)
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))
    return sums(rows, lexicon, "doc_id", "text_hash").select(
        "doc_id", "text_hash", held_out(F.col("doc_id")).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), "n_hits", "terms")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic, with the columns of docs and in the same pass."""
    lexicon = fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        a = lexicon.automaton()
        folded = [fold(t) for t in texts]
        total = np.array([sum(w for _, w in hits(a, f)) for f in folded], float)
        return pd.Series(lexicon.probability(total, np.array([f.count(" ") - 1 for f in folded], float)))

    return docs.where(probability(docs[text_col]) < 0.5)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = fit(docs.select("doc_id", "text"), labels)
    return score(docs, lexicon).select("doc_id", "held_out", "score", "predicted", "n_hits")
