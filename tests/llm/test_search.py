"""Ranked search against plain scoring of every document, in every tier."""

import math
import random
import re
from collections import Counter

import pytest

from geosift.llm import search as S

DOCS = "doc_id long, text string, term string, score string, rank string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(docs, items, top):
    held = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, length = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in held:
            tf, m, score = Counter(w), 25 + 75 * len(w) * n_docs // length, 0
            for t, qf in Counter(terms(text)).items():
                if t in tf:
                    score += qf * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def tables(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"W{int(rng.paretovariate(0.6)) % 300}" + rng.choice(["", "", "é"])
    texts = [" ".join(word() for _ in range(rng.choice([1, 5, 40, 200]))) for _ in range(300)] + [None, "", " ,;. ", "a_b`c 1{2}ÀÉ"]
    texts += [texts[3]] * 40 + ["W1 W2 W3"] * 25  # copies, and ties
    docs = [(None if i % 97 == 5 else i % 340, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 20, 60])))) for i in range(40)] + [(None, "W1 w2"), (3, "W1 w2"), (50, None), (51, "nothinglikethis"), (52, "W1 W1 W1 W9"), (53, texts[3])]
    return docs, items, spark.createDataFrame([(*d, "x", "y", "z") for d in docs], DOCS).repartition(5), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, qid int").repartition(2)


@pytest.mark.parametrize("tiers, block", [((500, 8_000), 500), ((3, 20), 7), ((1,), 500)])
def test_every_tier_is_exact(spark, monkeypatch, tiers, block):
    monkeypatch.setattr(S, "TIERS", tiers)
    monkeypatch.setattr(S, "ITEMS", block)
    monkeypatch.setattr(S, "PROBES", 12)
    monkeypatch.setattr(S, "DOCS", 16)
    scanned, scan = [], S._scan
    monkeypatch.setattr(S, "_scan", lambda block, *a: scanned.append(len(block)) or scan(block, *a))
    docs, items, documents, benchmark = tables(spark, len(tiers))
    got = sorted(map(tuple, S.search(documents, benchmark).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain(docs, items, 10)
    assert bool(scanned) == (tiers[-1] < 100)


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 4)
    query = spark.createDataFrame([(q, f"t{i}", 1) for q in range(5) for i in range(q + 1)], "qid long, term string, qw long")
    assert [[q for q, _, _ in sorted(b)] for b in S._blocks(query)] == [[0, 1, 1], [2, 2, 2], [3, 3, 3, 3], [4, 4, 4, 4, 4]]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some")], "item_id long, text string")
    assert S.search(docs.limit(0), items).collect() == []
    assert S.search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in S.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]
