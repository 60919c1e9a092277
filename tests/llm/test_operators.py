"""The ten operators against brute-force versions on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import textwrap
import time
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from geosift.llm import decontaminate, embeddings, graph, html_text, jaccard, licenses, mixing, rans, secrets, token_output, toxicity, wordpiece

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, source=lambda i: f"s{i % 3}"):
    rows = [(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clash(df):
    """Extra columns with names that the operators use themselves."""
    for c in ("size", "h", "key", "words", "token", "start", "n", "cid", "prefix", "row", "score", "target", "copies", "digest"):
        df = df.withColumn(c, F.lit("x"))
    return df


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n)]


# Toxicity.


def test_fold():
    assert toxicity.fold("1DI0T  l0s3r! id​iot p@thetic ѕcum") == " idiot loser idiot pathetic scum "
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold(" ?! ") == " "


def toxic_tables(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(600):
        w = words(rng, rng.randint(5, 60))
        y = int(i % 4 == 0)
        if y:
            w[rng.randrange(len(w))] = rng.choice(["gr1mble", "zorkish", "Zorkful", "zorkable", "zorkness", "grimble"])
        texts.append(" ".join(w))
        labels.append((i, 1, y))
    texts += [None, "", "  ", "no label here zorkless"]
    return table(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: y for i, _, y in labels}


def test_toxicity_learns_and_holds_out(spark):
    docs, labels, truth = toxic_tables(spark)
    lexicon = toxicity.fit(docs.select("doc_id", "text"), labels)
    rows = {r.doc_id: r for r in toxicity.score(clash(docs), lexicon).collect()}
    assert len(rows) == 604
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [i for i in truth if rows[i].held_out]
    assert sum(rows[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert all(rows[i].predicted == 0 and 0 <= rows[i].score < 0.5 for i in (600, 601, 602))
    assert all(r.predicted == int(r.score >= 0.5) for r in rows.values())
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, r in rows.items() if r.predicted == 0}


def test_toxicity_without_labels_and_exceptions(spark):
    docs = table(spark, ["you idiot", "fine", None])
    lexicon = toxicity.fit(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.doc_id: r.predicted for r in toxicity.score(docs, lexicon).collect()} == {0: 1, 1: 0, 2: 0}
    lex = toxicity.Lexicon({" trash": 3.0, " trash ": 4.0}, [" trash can "])
    a = lex.automaton()
    assert toxicity.hits(a, " trash can trash trashy ") == [(10, 4.0), (16, 3.0)]
    # Brute force, and a long text.
    lex = toxicity.Lexicon({" a": 1.0, " ab ": 2.0, " c ": 3.0}, [" a b ", " c a ", " c "])
    rng = random.Random(1)
    for n in (30, 30, 30, 60_000):
        text = f" {' '.join(rng.choice(['a', 'ab', 'b', 'c', 'd']) for _ in range(n))} "
        got = dict(toxicity.hits(lex.automaton(), text))
        if n == 30:
            spans = [(m, m + len(e) - 1) for e in lex.exceptions for m in range(len(text)) if text.startswith(e, m)]
            best = {}
            for e, w in lex.entries.items():
                for m in range(len(text)):
                    if text.startswith(e, m) and len(e) > best.get(m, (0, 0))[0]:
                        best[m] = (len(e), w)
            assert got == {m: w for m, (_, w) in best.items() if not any(x <= m < y for x, y in spans)}
    assert toxicity.score(docs.limit(0), lexicon).count() == 0


# Embedding near-duplicates.


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1, 1, 1):
        centre = rng.normal(size=16)
        for _ in range(60):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0.05, 0.3, 3])).tolist(), label))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(3)]  # equal vectors
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, rows[0][1], None), (n + 4, [None] + [1.0] * 15, 0),
             (n + 5, rows[0][1][:8], 0), (n + 6, [float("inf")] + [1.0] * 15, 0), (5, rows[0][1], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"vec": F.lit(1), "grp": F.lit(1), "n": F.lit(1)})
    want, parent = Counter(), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    ok = [i for i, (_, v, y) in enumerate(rows) if v is not None and y is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                    want[i] += 1
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    smallest = {}
    for i in ok:
        if rows[i][0] is not None:
            smallest[find(i)] = min(smallest.get(find(i), 10**9), rows[i][0])
    expected = sorted((str(rows[i][0]), want[i], None if rows[i][0] is None else smallest.get(find(i), rows[i][0]) if i in ok else rows[i][0]) for i in range(len(rows)))
    for shard in (8192, 20):  # one shard a label, and several
        got = embeddings.near_duplicates(df, shard_size=shard).collect()
        assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == expected
        assert all(r.kept == (None if r.vec_id is None else r.vec_id == r.component_id) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    _, audits = embeddings.search(df, shard_size=20)
    pairs = [(r.grp, r.shard, r.queries) for r in audits.collect()]
    assert len(pairs) == len(set(pairs)) and all((g, b, a) in pairs for g, a, b in pairs)  # every shard queries every shard
    assert all(r.recall >= embeddings.RECALL for r in audits.collect())


def shard_of(vectors):
    n = len(vectors)
    unit = embeddings.unit_rows(vectors.tolist())
    return embeddings.Shard(np.arange(n), np.ones(n, np.int64), unit, embeddings.Hnsw(unit, embeddings.levels(np.arange(n) * 7919)))


def true_links(x, y, same):
    sims = x.unit @ y.unit.T >= 0.93
    if same:
        np.fill_diagonal(sims, False)
    return sims


def test_embedding_graph_that_falls_apart(monkeypatch):
    """Without links between its vectors the graph finds what it enters by only: the audit sees it, and the product does the rest."""
    rng = np.random.default_rng(3)
    x = shard_of(np.repeat(rng.normal(size=(150, 24)), 2, 0) + rng.normal(size=(300, 24)) * 0.05)
    for _, links in x.graph.layers:
        links[:] = -1
    found, (audit,) = embeddings.link_shards(x, x, 0.93, True)
    truth = true_links(x, x, True)
    assert audit["exact"] and audit["recall"] == 1.0
    assert {u: n for u, n, _ in found} == {i: int(k) for i, k in enumerate(truth.sum(1)) if k}


def test_embedding_group_of_near_copies_keeps_the_beam_bounded():
    """A large group of near copies parts from the graph: the search ends as a product instead of a beam as wide as the shard."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    v = np.concatenate([rng.normal(size=(900, 64)), base + 0.1 * rng.normal(size=(500, 64))])
    unit = embeddings.unit_rows(list(v))
    graph_ = embeddings.Hnsw(unit, embeddings.levels(np.arange(1400)))
    graph_.layers = [(nodes, np.where((links >= 900) == (nodes[:, None] >= 900), links, -1)) for nodes, links in graph_.layers[-1:]]
    x = embeddings.Shard(np.arange(1400), np.ones(1400, int), unit, graph_)
    found, (audit,) = embeddings.link_shards(x, x, 0.93, True)
    want = unit @ unit.T >= 0.93
    assert {u: n for u, n, _ in found} == {i: n for i, n in enumerate((want.sum(1) - 1).tolist()) if n}
    assert audit["ef"] <= 128 and audit["exact"]


def test_embedding_rare_links():
    """Two shards with very few links between them: probes are the evidence, and both shards query."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(1500, 32)), rng.normal(size=(1300, 32))
    b[[3, 700, 1299]] = a[[1, 900, 1400]] + rng.normal(size=(3, 32)) * 0.1
    x, y = shard_of(a), shard_of(b)
    y.uid += 10_000
    y = embeddings.Shard.from_bytes(y.to_bytes())
    found, audits = embeddings.link_shards(x, y, 0.93, False)
    truth = true_links(x, y, False)
    want = {i: int(k) for i, k in enumerate(truth.sum(1)) if k} | {10_000 + i: int(k) for i, k in enumerate(truth.sum(0)) if k}
    assert truth.sum() >= 3 and {u: n for u, n, _ in found} == want
    assert len(audits) == 2 and all(r["recall"] >= 0.995 for r in audits)
    root = {u: r for u, _, r in found}
    assert all(root[i] == root[10_000 + j] for i, j in zip(*np.nonzero(truth)))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# N-gram Jaccard join.


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def jaccard_truth(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = d if find(i) not in low or d is None else min(low[find(i)], d)
    return sorted((str(d), len(sets[i]), str(low[find(i)] if sets[i] else d)) for i, (d, _) in enumerate(rows))


def near_copies(rng):
    """Chains of edits, a hub with copies, a common passage, exact copies, case and spacing variants."""
    passage = words(rng, 25, 60)
    texts = []
    for _ in range(12):
        base = words(rng, rng.randint(40, 120), 900) + passage * (rng.random() < 0.5)
        texts.append(" ".join(base))
        now = base
        for _ in range(rng.randint(0, 14)):
            now = list(now if rng.random() < 0.6 else base)  # a chain, or a star
            for _ in range(rng.randint(1, 2)):
                now[rng.randrange(len(now))] = f"e{rng.randrange(10**6)}"
            texts.append((" " if rng.random() < 0.7 else "\n").join(now).upper() if rng.random() < 0.3 else " ".join(now))
    texts += texts[:6] + [" ".join(passage)] * 3 + ["one two", "One  TWO ", "a b c d", None, "", " \n", "x"] + [" ".join(words(rng, 5000, 5000))]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("width, percent, seed", [(4, 85, 1), (5, 80, 2), (4, 85, 3)])
def test_jaccard_join(spark, width, percent, seed):
    rng = random.Random(seed)
    rows = list(enumerate(near_copies(rng)))
    rows += [(3, rows[3][1]), (3, "another text of the same id that is long enough"), (None, rows[0][1])]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = jaccard.jaccard_join(df, width=width, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == jaccard_truth(rows, width, percent)
    kept = jaccard.keep_one(df.withColumn("gone_id", F.lit(1)), width=width, percent=percent).drop("gone_id")
    assert kept.columns == df.columns
    linked = {r.component_id for r in got if r.n_shingles and r.doc_id is not None}
    alone = sum(1 for r in got if not r.n_shingles or r.doc_id is None)
    assert kept.count() == len(linked) + alone


@pytest.mark.parametrize("width, percent", [(5, 80), (4, 85), (3, 60), (2, 50), (1, 40), (3, 100)])
def test_jaccard_join_of_short_texts(spark, width, percent):
    """Every length of short texts, with copies that have a word more at either end or another one."""
    texts = []
    for n in range(1, 15):
        base = [f"t{n}x{k}" for k in range(n)]
        texts += [" ".join(w) for w in (base, [*base, f"more{n}"])]
        base = [f"u{n}x{k}" for k in range(n)]
        texts += [" ".join(w) for w in (base, [f"first{n}", *base], base[:-1] + [f"other{n}"], base)]
    rows = list(enumerate(texts))
    random.Random(percent).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.jaccard_join(df, width=width, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == jaccard_truth(rows, width, percent)
    kept = {r.doc_id for r in jaccard.keep_one(df, width=width, percent=percent).collect()}
    assert kept == {r.component_id for r in got}


def test_jaccard_group_of_near_copies(spark, monkeypatch):
    """A long list, many of whose sets are no partners of its head; shingles that come last by join and in tasks."""
    rng = random.Random(8)
    base = words(rng, 60, 9000)
    texts = []
    for i in range(90):
        now = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 5])):
            now[rng.randrange(len(now))] = f"e{rng.randrange(12)}"
        texts.append(" ".join(now[: rng.choice([60, 60, 57, 52])]))
    rows = list(enumerate(texts + [" ".join(words(rng, 40, 9000) + base[:12]) for _ in range(30)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = jaccard_truth(rows, 4, 85)
    for tokens in (jaccard.TOKENS, 0):
        monkeypatch.setattr(jaccard, "TOKENS", tokens)
        got = jaccard.jaccard_join(df, width=4, percent=85).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_jaccard_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(df).count() == 0 and jaccard.keep_one(df).count() == 0


# Token counts.


def test_longest_match():
    rng = random.Random(1)
    for _ in range(60):
        v = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 25))}
        m = wordpiece.LongestMatch(v)
        for _ in range(30):
            w = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 20)))
            n = i = 0
            while i < len(w):
                j = len(w)
                while j > i + 1 and w[i:j] not in v:
                    j -= 1
                i, n = j, n + 1
            assert m.count(w) == n


def test_longest_match_with_two_vocabularies():
    rng = random.Random(2)
    piece = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 6)))
    for _ in range(60):
        first, more = ({piece() for _ in range(rng.randint(0, 15))} for _ in range(2))
        m = wordpiece.LongestMatch(more, first)
        for _ in range(30):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20)))
            assert m.count(w) == greedy(w, first, more)


def greedy(word, first, more):
    n = i = 0
    while i < len(word):
        v, j = (more if i else first), min(len(word), i + 40)
        while j > i + 1 and word[i:j] not in v:
            j -= 1
        i, n = j, n + 1
    return n


def test_token_counts(spark):
    rng = random.Random(6)
    more, first = (frozenset(v) for v in wordpiece.byte_vocabulary(token_output.default_tokenizer()))
    pool = [w.decode("utf-8", "ignore").strip() for w in rng.sample(sorted(more), 300) + rng.sample(sorted(first), 300)]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "", "", "\n", "\t "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["the the", "", None, "é" * 5000, "a\tb\nc", " \n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "unbelievable")]
    want = Counter((i, len((t or "").encode().split()), sum(greedy(w, first, more) for w in (t or "").encode().split())) for i, t in rows)
    got = wordpiece.token_counts(clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()
    assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in got) == want
    assert wordpiece.token_counts(table(spark, ["x"]).limit(0)).count() == 0


# Secrets.


def test_secrets(spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    key = "sk_live_" + "Ab1" * 8
    texts = [f"é password: hunter22 and Token='{'a1b2' * 8}' AKIA{'Q' * 16}", "password:token:abcdefgh secret=abc", f"x {key} y", f"x {key} y", "AKIA" + "Z" * 15,
             None, "", "deadbeef" * 3, "ghp_" + "a1B" * 12]
    df = table(spark, texts, source=lambda i: None if i == 8 else f"s{i}")
    rows = {r.doc_id: r for r in secrets.scan_secrets(clash(df)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        spans = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        order = sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in order)
        assert rows[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert set(filter(None, text.split(","))) <= set(rows[i].spans.split(","))
    assert rows[2].spans == "" and rows[2].n_example == 1  # two owners hold it
    assert rows[8].spans == "issued:0:40" and rows[8].n_live == 1
    # One owner that has a value in many repositories: an example; rows of one repository count once.
    many = spark.createDataFrame([(i, f"x {key} y", "en", "one", 1) for i in range(10)] + [(i, "x ghp_" + "c2D" * 12, "en", "one", 1) for i in [20] * 12 + [None]], DOCS)
    assert {r.doc_id: (r.n_live, r.n_example) for r in secrets.scan_secrets(many).collect()} == {i: (0, 1) for i in range(10)} | {20: (1, 0), None: (1, 0)}
    long = "password=" + "b" * 40 + " " + f"x {key} " * 3000 + "AKIA" + "Q" * 500_000
    row = secrets.scan_secrets(table(spark, [long])).first()
    assert (row.n_assign, row.n_access, row.n_hex, row.n_live) == (1, 1, 1, 3003)
    assert secrets.scan_secrets(df.limit(0)).count() == 0


# HTML.


def test_html_parse():
    main = lambda h: "\n".join(html_text.parse(h)[0])
    page = ('<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>one<br>two&nbsp;three.<br>'
            "<p>Para<ul><li>i1<li>i2</ul><aside>side</aside><script>var t='</p>';</script><form>f</form><div id=comments>bad</div>tail</article><footer>&copy; f</footer>")
    assert main(page) == "A & B\none two three.\nPara\ni1\ni2\ntail"
    assert main('<article><p>cut <a href="x') == "cut" and main("<main>a<!-- x <p> -->b &am</main>") == "ab &am"
    assert main('<article class="post"><header><h1>H</h1><span>by me</span></header><p>z') == "H\nz"
    assert html_text.parse(None) == html_text.parse("") == ([], [], [])
    assert html_text.parse("<body><div>Loose  one</div><p>x")[1] == ["Loose one", "x"]
    assert main('<article><p>a <span style="display:none">HIDDEN</span> b <span class="advert">AD</span> <b hidden>h</b>c<br>d</article>') == "a b c d"
    assert main('<article><p class="notice-period">kept<p>See the <a class="social-link">page</a>.<h2 class="menu-title">t</h2></article>') == "kept\nSee the page.\nt"


def test_html_names_do_not_take_articles():
    main = lambda h: "\n".join(html_text.parse(h)[0])
    for page in ('<main class="content with-sidebar"><p>text</main>', '<article class="post comments-open"><p>text</article>',
                 '<div class="layout no-sidebar"><div class="sidebar">s</div><article><p>text</article></div>', '<article class="comments"><p>text</article>',
                 '<div class="social"><nav>n</nav><article><p>text</article></div>', '<div id="main-widget"><main><p>text</main></div>',
                 '<main><div id="main-widget"><p>text</div></main>', '<div class="page overlay"><div role="main">text</div></div>'):
        assert main(page) == "text", page
    # What names rightly mark still goes: in articles, and readers' comments that are articles themselves.
    assert main('<main><p>text<div class="related-posts">more</div><div id="comments"><article class="comment-body">me too</article></div></main>') == "text"
    assert main('<main><p>text<article class="comment">me too</article></main>') == "text"
    assert main('<article><p>text</article><div class="sidebar"><article>teaser</article></div>') == "text"
    # Without an article the host's other pages decide about what only a part of a name marks.
    assert html_text.parse('<div id="main-widget">own</div><div class="sidebar">s</div>') == ([], ["own"], ["s"])


def test_suffix_classes():
    rng = np.random.default_rng(0)
    for _ in range(30):
        t, pg = rng.integers(0, 3, 60).astype(np.uint64), np.sort(rng.integers(0, 5, 60))
        array, new = html_text.suffix_classes(t, pg, 4)
        want, got = {}, {}
        for i in range(57):
            if pg[i] == pg[i + 3]:
                want.setdefault(tuple(t[i : i + 4]), []).append(i)
        for i, c in zip(array, np.cumsum(new)):
            got.setdefault(c, []).append(int(i))
        assert sorted(sorted(v) for v in got.values()) == sorted(want.values())


def test_html_gives_furniture_back():
    text = lambda h: "\n".join(sum(html_text.parse(h)[:2], []))
    article = "<article><h1>A</h1><p>one</p></article>"
    # A form, aside, header or dialog round the page's only main region.
    for open_, close in (('<form id="aspnetForm">', "</form>"), ("<aside>", "</aside>"), ("<header>", "</header>"), ('<div role="search">', "</div>"), ('<div role="dialog">', "</div>")):
        assert text(f"<nav>menu</nav>{open_}<main><p>x</p><form><p>f</p></form></main>{close}<footer>end</footer>") == "x"
        assert text(f"<nav>menu</nav>{open_}{article}{close}<footer>end</footer>") == "A\none"
        assert text(f"{article}{open_}<article>teaser</article>{close}") == "A\none"
    assert text('<form id="aspnetForm"><nav>menu</nav><div class="post"><p>one</p><form><input><p>search</p></form></div></form>') == "one"
    assert text('<form id="f"><div><h1>A</h1><p>one</p></div></form>') == "A\none"
    assert text('<form><label>Name</label><input></form>') == ""
    assert text(f'<div class="post">one</div><form><label>Mail</label></form>') == "one"
    # Readers' comments are not the page's article; a post whose names tell of comments is.
    post = '<div class="post"><p>one</p></div>'
    assert text(f'{post}<div id="comments"><article class="comment-body">c</article></div>') == "one"
    assert text(f'{post}<div class="comments-area"><article class="comment-body">c</article></div>') == "one"
    assert text(f'{article}<div class="comments-area"><article class="comment-body">c</article></div>') == "A\none"
    assert text(f'{article}<article class="user-comment"><header><h4>Bob</h4></header>c</article>') == "A\none"
    assert text('<article id="post-1" class="post comments">one<div class="comments"><article class="comment">c</article></div></article>') == "one"
    # Other stories.
    assert text(f'{article}<div class="related-posts"><article class="teaser">t</article></div>') == "A\none"
    assert text('<div class="main-widget"><article><p>long enough</p></article></div><p>Skip</p>') == "long enough"
    assert text('<p>a long post outside of articles</p><div class="related-posts"><article>t</article></div>') == "a long post outside of articles\nt"
    # Inline controls do not part a block; unseen text goes.
    assert text("<article><p>See <button>Copy</button> code</p></article>") == "See code"
    assert text('<article><p>a</p><p style="visibility: hidden">b</p><p style="DISPLAY:none">c</p></article>') == "a"


def test_html_deep_nesting():
    n = 20_000
    pages = [f"<nav>{'<a>' * n}</nav><article>x</article>", f"<nav>{'<article>' * n}", f"<p>{'<b>' * n}{'<hr>' * n}x", f"<ul>{'<b>' * n}{'<li>y</li>' * n}</ul>",
             f"<article>{'<div class=comments>' * n}", f"{'<i></b>' * n}x", f"<form>{'<aside>' * n}<main>x"]
    began = time.perf_counter()
    assert [len(html_text.parse(p)[0]) for p in pages[:1]] == [1]
    for p in pages:
        html_text.parse(p)
    assert time.perf_counter() - began < 20  # the square of n would take many minutes


def test_html_extract(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PAGES", 2)  # several shards of the host
    frame = "this line stands on every page of the host and says nothing"
    own = [" ".join(f"own{i}x{k}" for k in range(12)) for i in range(5)]
    rows = [(i, "http://h.example/a", f"<body><div>{frame}</div><div>{t}</div></body>") for i, t in enumerate(own)]
    rows += [(9, "http://h.example/b", f"<article><p>{frame}</p></article>"), (10, None, None), (11, "x", ""), (9, "http://h.example/b", f"<article><p>{frame}</p></article>")]
    df = clash(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect())
    want = [(i, t, len(t)) for i, t in enumerate(own)] + [(9, frame, len(frame))] * 2 + [(10, "", 0), (11, "", 0)]
    assert got == want
    assert html_text.extract(df.limit(0)).count() == 0
    monkeypatch.setattr(html_text, "RUNS", 0)  # too many runs for all tasks
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == want
    assert html_text.extract(df.limit(0)).count() == 0


# Decontamination.


def decon_truth(docs, items, width=13, share=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for item, it in items:
            iw = split(it)
            k = min(width, len(iw))
            grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if iw else set()
            for p in range(len(w) - k + 1) if k else ():
                if tuple(w[p : p + k]) in grams:
                    hit |= set(range(p, p + k))
                    found.add(item)
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((str(d), len(w), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and share * len(hit) >= len(w)))
    return sorted(out)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, rng.choice([1, 2, 3, 7, 12, 13, 14, 40]), 60))) for i in range(30)] + [(50, None), (51, "?!"), (52, "w1"), (None, "Zeta eta")]
    items += [(60, items[3][1]), (3, items[3][1])]
    docs = []
    for i in range(60):
        w = words(rng, rng.randint(0, 120), 60)
        for _ in range(rng.randint(0, 2)):
            it = (rng.choice(items)[1] or "").split()
            cut = rng.randint(0, max(0, len(it) - 5))
            at = rng.randint(0, len(w))
            w[at:at] = it[cut : cut + rng.randint(5, 40)]
        docs.append((i, rng.choice([" ", ", ", "--"]).join(w).upper()))
    docs += [(70, None), (71, ""), (5, docs[5][1]), (None, docs[6][1]), (72, " ".join(words(rng, 20000, 60))), (73, "zeta, ETA!")]
    d = clash(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({"h": F.lit(1), "w": F.lit(2), "m": F.lit(3)})
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(d, b).collect())
    assert got == decon_truth(docs, items)
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not r[5] for r in got)
    monkeypatch.setattr(decontaminate, "PROBES", 0)  # too many anchors to broadcast
    monkeypatch.setattr(decontaminate, "HASHES", 0)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(d, b).collect())
    assert got == decon_truth(docs, items)
    for x, y in ((d.limit(0), b), (d, b.limit(0))):
        assert decontaminate.contamination(x, y).where("n_hit > 0").count() == 0


# Token files.


def test_rans_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 65, 1000, 70_000, 300_000):
        ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
        f = rans.File(rans.write_file(ids, np.zeros((0, 4), np.int64)))
        assert (f.ids() == ids).all()
        if n > 100:
            assert (f.ids(17, n - 5) == ids[17 : n - 5]).all()
    freq = rans.normalise(np.array([10**9] + [1] * 50_000))
    assert freq.sum() == 1 << rans.PRECISION and freq.min() == 1
    data = bytearray(rans.write_file(np.arange(5000, dtype=np.uint32), np.zeros((0, 4), np.int64)))
    data[100] ^= 1  # in the first block
    with pytest.raises(ValueError):
        rans.File(bytes(data)).ids()


def test_other_tokenizers(monkeypatch, tmp_path):
    """A file that splits otherwise is never cut; and the memory of pieces may be lost at any time."""
    import json

    from tokenizers import Tokenizer

    text = "Some words,  and some more words   here; Some WORDS " * 20
    spec = json.loads(Path(token_output.default_tokenizer()).read_text("utf-8"))
    monkeypatch.setattr(token_output, "MEMORY", 700)
    for change in ({}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}},
                   {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}):
        f = tmp_path / "t.json"
        f.write_text(json.dumps(spec | change), "utf-8")
        encoder = token_output.PieceEncoder(str(f))
        assert encoder.splits == (not change)
        assert np.frombuffer(encoder(text), "<u4").tolist() == Tokenizer.from_file(str(f)).encode(text, add_special_tokens=False).ids


def test_pre_tokens(monkeypatch):
    """Texts of low characters cut by columns have the library's ids, and a pre-token is encoded once, whatever stands behind it."""
    encoder = token_output.PieceEncoder(token_output.default_tokenizer())
    marks = "!?.,;:)]}>*&%$#@~^|+"
    encoder(" ".join(f"word{m}" for m in marks))
    kept = sum(len(m) for m in vars(encoder).values() if isinstance(m, token_output._Memory))
    assert kept <= len(marks) + 3, "besides the marks: a word with a space and without, and the place between texts"
    t = encoder.tokenizer
    texts = [x for c in map(chr, range(0x260)) for x in (c, f"x{c}", f" x{c}y", f"x {c}", f"x{c} ", f"x  {c}{c} y", f"a '{c}b", f"it'{c}e", f"a {c}\nb{c}  ", f"7{c}7", f"x一 é{c}")]
    rng = random.Random(6)
    texts += ["".join(rng.choices([*"ab zé'µ²½ \t\n\x1c\x85\xa0.,_0stlrev", "'ll", "'re", "  ", "word"], k=rng.randint(0, 90))) for _ in range(300)] + [None, ""]
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for size in (1 << 20, 16):  # in one piece, and long texts in parts
        monkeypatch.setattr(token_output, "CHUNK", size)
        assert list(encoder.many(texts)) == want


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_output, "FILE_IDS", 50)  # several files a task
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_output.default_tokenizer())
    t.encode_special_tokens = True
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randint(0, 40))) for _ in range(40)]
    texts += [None, "", " ", "  a  b ", "a\n b", "a \n b\n", "it's  'll x　z", "<|endoftext|> a", "é́ ü ²x x²y", "x foo\nbar baz.\nÜber ñ!! a_b", "\x1c a \x1c", "a   b", "   a", "a   ", "x \t  y\n\n   z", " " * 70 + "end" + " " * 3]
    rows = [(7 * i % 51, x) for i, x in enumerate(texts)] + [(3, "again"), (None, "no id"), (3, "again")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = token_output.token_rows(df).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert token_output.token_rows(df.limit(0)).count() == 0


# Licences.


def test_licenses(spark):
    texts = ["Copyright (c) 2020 me\nRELEASED under the  MIT licence", "x\nLicensed under CC BY-NC 4.0.\ny\nLicensed under CC BY-NC 4.0!\nReleased under the MIT License.", "Released under the MIT License, mostly.", None, "", "..."]
    rows = {r.doc_id: (r.license, r.line_licenses) for r in licenses.scan_licenses(clash(table(spark, texts))).collect()}
    assert rows == {0: ("MIT", "MIT"), 1: (None, "CC-BY-NC-4.0,MIT"), 2: (None, ""), 3: (None, ""), 4: (None, ""), 5: (None, "")}
    own = spark.createDataFrame([("B", "Some text"), ("A", "some TEXT!"), (None, "x"), ("C", None)], "license string, text string")
    assert [r.license for r in licenses.scan_licenses(table(spark, ["Some text", "x"]), known=own).orderBy("doc_id").collect()] == ["A", None]
    assert licenses.scan_licenses(table(spark, ["x"]).limit(0)).count() == 0


def test_full_license_texts(spark):
    full = {p.stem: p.read_text("utf-8") for p in licenses.TEXTS.glob("*.txt")}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0"} <= set(full)
    names = sorted(full)
    texts = [full[n] for n in names] + [full["MIT"].split("\n\n", 1)[1].replace("<year> <copyright holders>", "2020 me"), full["MIT"] + "\nand more"]
    rows = {r.doc_id: r.license for r in licenses.scan_licenses(table(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [*names, "MIT", None]


def refilled(text, width):
    """The text with its paragraphs filled to the width."""
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_on_hyphens=False) for p in text.split("\n\n"))


def test_license_line_breaks(spark):
    full = {p.stem: p.read_text("utf-8") for p in licenses.TEXTS.glob("*.txt")}
    forms = [lambda t, w=w: refilled(t, w) for w in range(50, 80)]
    forms += [lambda t: " ".join(t.split()), lambda t: t.replace("\n", "\r\n")]
    forms += [lambda t, c=c: "\n".join(c + x for x in t.split("\n")) for c in ("# ", "// ", " * ", ";; ")]
    forms += [lambda t: "/*\n" + "\n".join(" * " + x for x in refilled(t, 60).split("\n")) + "\n */"]
    cases = [(name, form(text)) for name, text in full.items() for form in forms]
    mit, bsd = full["MIT"], full["BSD-3-Clause"]
    cases += [("MIT", mit.replace("<year> <copyright holders>", "2001-2020 Jane Doe\nAll rights reserved.")), ("MIT", " ".join(mit.replace("<year> <copyright holders>", "2020, J. Doe (j@d.org)").split())),
              ("BSD-3-Clause", bsd.replace("the copyright holder nor", "Doe & Sons, Inc. nor")), (None, mit.replace("without restriction", "with restriction")),
              (None, full["Apache-2.0"].replace("(c) You must retain", "(c) You may drop"))]
    rows = {r.doc_id: r.license for r in licenses.scan_licenses(table(spark, [t for _, t in cases])).collect()}
    assert [(i, rows[i]) for i in range(len(cases))] == [(i, name) for i, (name, _) in enumerate(cases)]


def test_license_rows(spark):
    df = spark.createDataFrame([(None, "Released under CC0 1.0."), (None, "Released under CC0 1.0."), (1, "(c) You must\nReleased under CC0 1.0."), (2, "x " * 300_000 + "(c) 2020 " + "<y " * 100_000)], "doc_id long, text string")
    assert Counter((r.doc_id, r.license, r.line_licenses) for r in licenses.scan_licenses(df).collect()) == {
        (None, "CC0-1.0", "CC0-1.0"): 2, (1, None, "CC0-1.0"): 1, (2, None, ""): 1}


# Mixing.


def test_mixing(spark):
    rng = random.Random(9)
    texts = [" ".join(words(rng, rng.randint(0, 50))) for _ in range(400)] + [None, "", "a b c"]
    df = clash(table(spark, texts, source=lambda i: None if i % 50 == 0 else f"s{min(i % 11, 4)}"))
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts) and sorted(map(str, rows)) == sorted(map(str, mixing.mix(df).collect()))
    sizes, taken, target, longest = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").split()) and r.taken <= 3 * r.size and r.taken == r.size * r.times
        s = None if r.doc_id % 50 == 0 else f"s{min(r.doc_id % 11, 4)}"
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        longest[s] = max(longest[s], r.size)
    # Shares by weight, filled up to three times a source's size.
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped, total = set(), sum(sizes.values())
    while True:
        rate = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(w for s, w in weight.items() if s not in capped))
        more = {s for s in weight if s not in capped and weight[s] * rate > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in sizes:
        assert target[s] == pytest.approx(3 * sizes[s] if s in capped else weight[s] * rate)
        assert abs(taken[s] - target[s]) <= longest[s]
    out = mixing.repeat_rows(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.times for r in rows if r.times})
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.repeat_rows(df.limit(0)).count() == 0


def test_mixing_budget_ends_with_a_document(spark):
    """The rest of a source equals the words of its first documents in hash order, of one or more words each."""
    rng = random.Random(4)
    ids = spark.range(1200).select("id", mixing.row_hash(F.col("id"), F.lit("x")).alias("h")).collect()
    rows, rest, want = [], [], {}
    for k in range(20):
        mine = sorted((r.h, rng.randint(1, 30) if k % 2 else 1) for r in ids[k * 60 : k * 60 + 60])
        n = (1, 59, 7, 31)[k // 2 % 4]
        rows += [(f"s{k}", size, h) for h, size in mine]
        rest.append((f"s{k}", float(sum(size for _, size in mine[:n]))))
        want[f"s{k}"] = n
    base = spark.createDataFrame(rows, "skey string, size long, h long")
    cut = {r.skey: r.threshold for r in mixing.hash_thresholds(base, spark.createDataFrame(rest, "skey string, rest double")).collect()}
    assert {s: sum(1 for k, _, h in rows if k == s and h <= cut.get(s, -1)) for s in want} == want

    # A budget that runs out among equal rows takes some of them; null ids and texts of no words are equal rows, too.
    equal = spark.createDataFrame([(7, "a b c d", "s0")] * 1000 + [(None, None, "s0")] * 9 + [(i, "x y z", f"s{i % 3}") for i in range(2000)], "doc_id long, text string, source string")
    equal = clash(equal.repartition(6))
    got = mixing.mix(equal, weights=(3, 4, 5)).collect()
    assert len(got) == 3009 and len({r.times for r in got if r.doc_id == 7}) > 1
    for s in {r.target for r in got}:
        assert abs(sum(r.taken for r in got if r.target == s) - s) <= 4
    want = Counter()
    for r in got:
        want[r.doc_id] += r.times
    out = mixing.repeat_rows(equal, weights=(3, 4, 5))
    assert out.columns == equal.columns and Counter(r.doc_id for r in out.collect()) == +want

    one_word = table(spark, ["word"] * 2400)
    taken, target = Counter(), {}
    for r in mixing.mix(one_word).collect():
        taken[r.doc_id % 3] += r.taken
        target[r.doc_id % 3] = r.target
    assert taken == target == {0: 1500, 1: 600, 2: 300}
