"""Closures and strongly connected components against plain searches."""

import random

from geosift.operators import closure


def frame(spark, links):
    return spark.createDataFrame(links, "child long, parent long").repartition(3)


def reach(links):
    out = {}
    for c, p in links:
        out.setdefault(c, set()).add(p)
    found = {}
    for v in {x for link in links for x in link}:
        seen, todo = set(), list(out.get(v, ()))
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo += out.get(w, ())
        found[v] = seen
    return found


def components(links):
    to = reach(links)
    return {v: min([v, *(w for w in to[v] if v in to[w])]) for v in to if v in to[v]}


def test_components_of_small_graphs(spark):
    rng = random.Random(1)
    links = []
    for g in range(6):  # apart from each other
        n = rng.choice([3, 6, 10])
        links += [(100 * g + rng.randrange(n), 100 * g + rng.randrange(n)) for _ in range(rng.choice([n, 2 * n]))]
    links += [(700 + i, 701 + i) for i in range(6)] + [(703, 700), (705, 704), (750, 700), (706, 760), (760, 761)]
    got = {r.id: r.component for r in closure.strong_components(frame(spark, links)).collect()}
    assert got == components(links)


def test_long_chain_and_ring(spark, monkeypatch):
    rounds = []
    stage = closure.stage
    monkeypatch.setattr(closure, "stage", lambda df, name: rounds.append(name) or stage(df, name))
    n = 4_000
    chain = spark.range(n).selectExpr("id as child", "id + 1 as parent")
    assert closure.ancestors(spark.createDataFrame([(7,)], "id long"), chain).count() == n - 6
    assert rounds.count("jumps") < 20
    ring = spark.range(300).selectExpr("id + 10 as child", "(id + 1) % 300 + 10 as parent").union(spark.range(500).selectExpr("id + 1000 as child", "id + 1001 as parent"))
    got = {(r.id, r.component) for r in closure.strong_components(ring).collect()}
    assert got == {(i + 10, 10) for i in range(300)}


def test_branches_beside_chains(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(60), 60 + rng.randrange(40)) for _ in range(15)] + [(60 + i, 61 + i) for i in range(40)]
    seeds = [0, 55]
    to = reach(links)
    want = set(seeds) | to[0] | to[55]
    assert {r.id for r in closure.ancestors(spark.createDataFrame([(s,) for s in seeds], "id long"), frame(spark, links)).collect()} == want
