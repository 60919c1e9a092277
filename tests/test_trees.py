"""Trees as interval labels against walks over ElementTree."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from geosift.functions import xml as X
from geosift.operators import trees as T
from geosift.staging import stage


def random_xml(rng, depth=0):
    inner = []
    for _ in range(rng.randint(0, 3) if depth < 4 else 0):
        inner.append(random_xml(rng, depth + 1))
        inner.append(rng.choice(["", "", "t", " x ", "é𝄞"]))
    return f'<{(n := rng.choice("abc"))} k="{rng.randint(0, 3)}">{rng.choice(["", "y"])}{"".join(inner)}</{n}>'


def walk(text):
    """Elements and texts in document order: (kind, name or text, interval, parent's place, string value)."""
    out, clock = [], [1]

    def tick():
        clock[0] += 1
        return clock[0] - 1

    def add_text(t, parent):
        if t and t.strip():
            at = tick()
            out.append(["text", t, at, at, parent, t])
        elif t:
            tick()  # white space is an event

    def go(e, parent):
        at = tick()
        row = ["element", e.tag, at, None, parent, "".join(x for x in e.itertext() if x.strip())]
        out.append(row)
        add_text(e.text, at)
        for child in e:
            go(child, at)
            add_text(child.tail, at)
        row[3] = tick()

    go(ET.fromstring(text), None)
    return out


AXES = {
    "self": lambda c, n: n[2] == c[2],
    "child": lambda c, n: n[4] == c[2],
    "parent": lambda c, n: c[4] == n[2],
    "descendant": lambda c, n: c[2] < n[2] and n[3] < c[3],
    "ancestor": lambda c, n: n[2] < c[2] and c[3] < n[3],
    "descendant-or-self": lambda c, n: c[2] <= n[2] and n[3] <= c[3],
    "ancestor-or-self": lambda c, n: n[2] <= c[2] and c[3] <= n[3],
    "following-sibling": lambda c, n: c[4] is not None and n[4] == c[4] and n[2] > c[2],
    "preceding-sibling": lambda c, n: c[4] is not None and n[4] == c[4] and n[2] < c[2],
    "following": lambda c, n: n[2] > c[3],
    "preceding": lambda c, n: n[3] < c[2],
}


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(11)
    docs = {i: random_xml(rng) for i in range(60)}
    rows = [(i, t, "x") for i, t in docs.items()] + [(99, None, "x")]
    nodes = T.label(X.sax_events(spark.createDataFrame(rows, "id long, xml string, name string").repartition(3))).cache()
    return {i: walk(t) for i, t in docs.items()}, nodes


def places(df):
    return sorted((r.id, r.pre) for r in df.collect())


def test_labels(forest):
    want, nodes = forest
    got = sorted((r.id, r.pre, r.post, r.parent, r.kind, r.name if r.kind == "element" else r.text) for r in nodes.collect())
    assert got == sorted((i, n[2], n[3], n[4], n[0], n[1]) for i, rows in want.items() for n in rows)
    values = {(r.id, r.pre): r.value for r in T.string_values(nodes, nodes).collect()}
    assert values == {(i, n[2]): n[5] for i, rows in want.items() for n in rows}


@pytest.mark.parametrize("axis", sorted(AXES))
def test_axes(forest, axis):
    want, nodes = forest
    context = T.elements(nodes, "a").withColumn("text", F.lit("other"))
    context = context.unionByName(context)  # repeated rows count once
    on = lambda i, n: any(c[1] == "a" and c[0] == "element" and AXES[axis](c, n) for c in want[i])
    assert places(T.step(context, nodes, axis)) == sorted((i, n[2]) for i in want for n in want[i] if on(i, n))
    back = lambda i, n: any(c[0] == "text" and AXES[axis](n, c) for c in want[i])
    assert places(T.having(nodes, T.texts(nodes), axis)) == sorted((i, n[2]) for i in want for n in want[i] if back(i, n))


def test_places_and_empty(forest):
    want, nodes = forest
    for n in (1, 2, -1):
        kids = {}
        for i in want:
            for x in want[i]:
                if x[1] == "b" and x[0] == "element":
                    kids.setdefault((i, x[4]), []).append(x[2])
        pick = sorted((i, k[n - 1 if n > 0 else n]) for (i, _), k in kids.items() if len(k) >= abs(n))
        assert places(T.nth(T.elements(nodes, "b"), n)) == pick
    assert T.step(nodes.limit(0), nodes, "child").count() == T.step(nodes, nodes.limit(0), "descendant").count() == 0
    assert T.elements(nodes).where(T.attribute("k").isNull()).count() == 0
    with pytest.raises(ValueError):
        T.step(nodes, nodes, "namespace")


def test_steps_send_no_side_through_the_driver(spark):
    """A side that is small as shuffled bytes may be many times larger in the driver: steps are joined by shuffles."""
    docs = spark.createDataFrame([(1, "<a><b>x</b><b>y</b></a>"), (2, "<a><b>z</b></a>")], "id long, xml string")
    nodes = stage(T.label(X.sax_events(docs)), "step-plan")
    found = T.step(T.elements(nodes, "a"), T.elements(nodes, "b"), "child")
    assert found.count() == 3
    values = T.string_values(T.elements(nodes, "a"), nodes)
    assert {r.value for r in values.collect()} == {"xy", "z"}
    for df in (found, values):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
