"""The pipeline stage by stage against brute-force versions, and the registered queries with SQL."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from geosift.llm import mixing, queries, token_output, toxicity
from tests.llm.test_operators import decon_truth, jaccard_truth, near_copies, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(i, " ".join(f"b{i}x{k}" for k in range(20))) for i in range(6)]
    texts = near_copies(rng)
    labels = []
    for i in range(120):
        w = words(rng, rng.randint(8, 50), 900)
        if i % 4 == 0:
            w[rng.randrange(len(w))] = "zorkish"
        if i % 10 == 1:
            w += rng.choice(items)[1].split()
        labels.append((len(texts), 1, int(i % 4 == 0)))
        texts.append(" ".join(w))
    rows = [(i, t, "en", None if i % 17 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)] + [(2, texts[2], None, "s2", None)]
    d = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def pairs(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages(spark, small_dir, tmp_path):
    d, items = small_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lexicon = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))
    a = lexicon.automaton()

    def is_toxic(text):
        f = toxicity.fold(text)
        total = sum(w for _, w in toxicity.hits(a, f))
        return 1 / (1 + np.exp(-(lexicon.slope * total / max(1, f.count(" ") - 1) ** lexicon.power + lexicon.bias))) >= 0.5

    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        rows = pairs(docs)
        out = function(spark, docs, d)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "token_output":
            assert after.columns == docs.columns
        if name == "toxicity":
            assert Counter(pairs(after)) == Counter(r for r in rows if not is_toxic(r[1]))
            assert len(rows) - after.count() > 20
        elif name == "near_duplicates":
            groups = jaccard_truth([r[:2] for r in rows], 5, 80)
            assert sorted(str(r[0]) for r in pairs(after)) == sorted({i if n == 0 else c for i, n, c in groups})
        elif name == "decontamination":
            clean = {r[0] for r in decon_truth([r[:2] for r in rows], items) if not r[5]}
            assert sorted(str(r[0]) for r in pairs(after)) == sorted(clean) and len(clean) < len(rows)
        elif name == "mixing":
            times = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
            assert Counter(pairs(after)) == Counter({r: times[r[0]] for r in rows if times[r[0]]})
        else:
            encode = token_output.PieceEncoder(token_output.default_tokenizer())
            want = Counter()
            for i, t, _ in rows:
                ids = encode(t) + np.array([2], "<u4").tobytes()
                want[i, len(ids) // 4, zlib.crc32(ids)] += 1
            assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in after.collect()) == want
        docs = after
    whole = corpus_pipeline.run(spark, d).collect()
    assert sorted(map(str, whole)) == sorted(map(str, docs.collect()))


def test_empty_tables(spark, small_dir, tmp_path):
    d, _ = small_dir
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert {int(q.split("_")[0][2:]) for q in queries.QUERIES} == set(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    from tests.test_queries import compare

    compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name])




def test_read_batches_are_bounded(spark):
    from geosift.llm import common

    key = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.unset(key)
    common.small_batches(spark)
    assert int(spark.conf.get(key)) <= 512
    spark.conf.set(key, "64")
    common.small_batches(spark)
    assert spark.conf.get(key) == "64"
    spark.conf.unset(key)
