"""Steps inside batches of documents against walks over ElementTree, and against labels of the same documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geosift.functions import xml as X
from geosift.operators import paths as P
from geosift.operators import trees as T
from geosift.plans import queries
from tests.test_trees import AXES, random_xml, walk

ODD = [
    '<!DOCTYPE a [<!ENTITY e "x&#65;"><!ENTITY f "<b>in</b>">]><?one two?><a><!-- c -->x<!-- c -->y&e;z&f;<?p q?>t</a><!-- end -->',
    "<a>x<![CDATA[y]]>z<![CDATA[]]>w<![CDATA[ ]]></a>", "<a> \n<b/> <b>  v</b>&amp;&lt;</a>",
    '<?xml version="1.0" encoding="ISO-8859-1"?><a>é</a>',
    '<n:a xmlns:n="urn:1" xmlns="urn:2"><b xmlns:m="urn:3" n:k="1"><n:b/>t</b><b xmlns=""/></n:a>',
    '<!DOCTYPE a SYSTEM "none.dtd"><a>x&unknown;y<b/></a>', f"<a>{'long ' * 40_000}<b/>{' ' * 30_000}</a>", "<a/>", f"{'<a>' * 300}t{'</a>' * 300}",
]


@pytest.fixture(scope="module")
def forest():
    rng = random.Random(12)
    docs = [random_xml(rng) for _ in range(60)]
    return [walk(t) for t in docs], tree(docs)


def tree(docs):
    parser = P._Parser()
    for t in docs:
        parser.add(t)
    return parser.nodes()


def places(nodes, mask):
    return sorted(zip(nodes.doc[mask].tolist(), nodes.pre[mask].tolist(), strict=True))


@pytest.mark.parametrize("axis", sorted(AXES))
def test_axes(forest, axis):
    want, nodes = forest
    every = np.ones(len(nodes), bool)
    on = lambda d, n: any(c[1] == "a" and c[0] == "element" and AXES[axis](c, n) for c in d)
    assert places(nodes, nodes.step(nodes.elements("a"), every, axis)) == sorted((i, n[2]) for i, d in enumerate(want) for n in d if on(d, n))
    back = lambda d, n: n[1] == "b" and n[0] == "element" and any(c[0] == "text" and c[1] == "y" and AXES[axis](n, c) for c in d)
    got = nodes.having(nodes.elements("b"), nodes.texts("y"), axis)
    assert places(nodes, got) == sorted((i, n[2]) for i, d in enumerate(want) for n in d if back(d, n))
    assert not nodes.step(~every, every, axis).any() and not nodes.step(every, ~every, axis).any()


def test_places(forest):
    want, nodes = forest
    assert places(nodes, nodes.roots()) == [(i, 1) for i in range(len(want))]
    for test, wanted in ((nodes.elements("b"), lambda x: x[:2] == ["element", "b"]), (nodes.elements() | nodes.texts(), lambda x: True)):
        kids = {}
        for i, d in enumerate(want):
            for x in filter(wanted, d):
                kids.setdefault((i, x[4]), []).append(x[2])
        for n in (1, 2, -1, -2):
            assert places(nodes, nodes.nth(test, n)) == sorted((i, k[n - 1 if n > 0 else n]) for (i, _), k in kids.items() if len(k) >= abs(n))
        assert not nodes.nth(test, 0).any()
    with pytest.raises(ValueError):
        nodes.step(nodes.elements(), nodes.elements(), "namespace")


def test_odd_documents_are_labelled_alike(spark):
    """Entities, CDATA, comments, instructions, namespaces, encodings: the nodes and places of `trees.label`."""
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, xml string").repartition(1)
    rows = T.label(X.sax_events(df)).orderBy("id", "pre").collect()
    nodes, texts = tree(ODD), [r.text for r in rows if r.kind == "text"]
    got = list(zip(nodes.doc.tolist(), nodes.pre.tolist(), nodes.post.tolist(), [None if u < 0 else int(nodes.pre[u]) for u in nodes.up], strict=True))
    assert got == [(r.id, r.pre, r.post, r.parent) for r in rows] and nodes._text == texts
    for name, uri in {(r.name, r.uri) for r in rows if r.kind == "element"} | {("b", None), (None, "urn:2"), ("none", None)}:
        fits = lambda r: r.kind == "element" and name in (None, r.name) and uri in (None, r.uri)  # noqa: B023, E731
        assert places(nodes, nodes.elements(name, uri)) == [(r.id, r.pre) for r in rows if fits(r)]


def test_select(spark, monkeypatch):
    docs = [(None, "<a><b/></a>"), (1, None), (None, "<a/>"), (7, "<a><b/><b/></a>"), (7, "<b/>")]
    df = spark.createDataFrame(docs, "id long, xml string").repartition(1)
    found = P.select(df, lambda t: {"b": t.elements("b"), "none": t.elements("c")})
    assert sorted(map(tuple, found.select("path", F.coalesce("id", F.lit(-1)), "pre", "post").collect())) == [("b", -1, 2, 3), ("b", 7, 1, 2), ("b", 7, 2, 3), ("b", 7, 4, 5)]
    assert P.select(df.limit(0), lambda t: {"b": t.elements("b")}).count() == 0
    many = spark.range(0, 9000, 1, 2).select("id", F.concat(F.lit("<a><b>"), F.col("id").cast("string"), F.lit("</b><b/><b/></a>")).alias("xml"))  # several batches of events
    found = P.select(many, lambda t: {"two": t.nth(t.elements("b"), 2)})
    assert found.agg(F.count("*"), F.countDistinct("id"), F.min("pre"), F.max("post")).first()[:] == (9000, 9000, 5, 6)
    for bad in ("<a><b></a>", "<a/><a/>", "</a>", "", "<a>&no;</a>", "<n:a/>"):
        with pytest.raises(Exception, match="ExpatError"):
            P.select(spark.createDataFrame([(1, bad)], "id long, xml string"), lambda t: {"a": t.elements("a")}).collect()


def test_tree_steps_shuffles_no_nodes(spark):
    """Only the lines and orders that make up the documents are shuffled; no node is sorted, joined or staged."""
    def exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange"), plan.count("Join"), plan.count("Window")

    sf = "/root/testdata/sf0.001"
    assert exchanges(queries.tree_steps(spark, sf)) == exchanges(queries.order_xml(spark, sf))
