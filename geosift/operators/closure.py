"""Transitive closures and cycles over membership links, as loops of joins.

Each round joins the frontier of the last round with the links and keeps what is new, until nothing is. Cycles
end by the visited set. Rounds are staged in the shared folder, so no lineage grows with the depth. After PATIENCE rounds shortcuts
join in: a vertex with one parent jumps, and jumps are doubled every round, so a chain of any length takes a logarithm of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosift.staging import stage

PATIENCE = 4


def _jumps(links: DataFrame) -> DataFrame:
    """id, to: vertices with a single parent, and that parent."""
    one = links.groupBy("child").agg(F.min("parent").alias("to"), F.max("parent").alias("other"))
    return one.where("to = other and to <> child").select(F.col("child").alias("id"), "to")


def _doubled(jumps: DataFrame) -> DataFrame:
    """Jumps of twice the length; they end where there is more than one parent, or none."""
    further = jumps.select(F.col("id").alias("to"), F.col("to").alias("next"))
    return stage(jumps.join(further, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "jumps")


def ancestors(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """seeds (id), links (child, parent) -> id: the seeds and everything above them."""
    links = stage(links.select("child", "parent").dropna().distinct(), "closure-links")
    visited = frontier = stage(seeds.select("id").dropna().distinct(), "closure")
    jumps, rounds = None, 0
    while True:
        step = frontier.join(links, frontier["id"] == links["child"]).select(F.col("parent").alias("id"))
        if rounds >= PATIENCE:
            jumps = _doubled(jumps).select("id", "to") if jumps else stage(_jumps(links), "jumps")
            # A jump of 2 ** k from all that lie within 2 ** k: nothing in between is passed over.
            step = step.unionByName(visited.join(jumps, "id").select(F.col("to").alias("id")))
        frontier = stage(step.distinct().join(visited, "id", "left_anti"), "closure")
        if frontier.isEmpty():
            return visited
        visited, rounds = visited.unionByName(frontier), rounds + 1
        if rounds % 8 == 0:
            visited = stage(visited, "closure")


def ordered_ancestors(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """As ancestors, but a link counts only if the child stands before the parent: links (child, child_pos, parent, parent_pos)."""
    return ancestors(seeds, links.where(F.col("child_pos") < F.col("parent_pos")))


def type_ancestors(links: DataFrame) -> DataFrame:
    """links (child, parent) -> child, ancestor: all pairs of the transitive closure."""
    links = links.select("child", "parent").dropna().distinct()
    visited = frontier = stage(links.select("child", F.col("parent").alias("ancestor")), "types")
    while True:
        step = frontier.join(links.select(F.col("child").alias("ancestor"), F.col("parent").alias("next")), "ancestor")
        step = step.select("child", F.col("next").alias("ancestor")).distinct()
        frontier = stage(step.join(visited, ["child", "ancestor"], "left_anti"), "types")
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)


def _without_tails(links: DataFrame) -> DataFrame:
    """Links whose ends may lie on cycles: chains and trees that lead to a dead end go, in a logarithm of rounds, whatever their length."""
    jumps, n = stage(_jumps(links), "jumps"), links.select("child").distinct().count()
    while n > 1:
        jumps, n = _doubled(jumps.select("id", "to")), n // 2 + n % 2
        if jumps.where("moved").isEmpty():  # all chains end; those on rings never do
            break
    dead = links.select(F.col("parent").alias("to")).distinct().join(links.select(F.col("child").alias("to")), "to", "left_anti")
    gone = stage(jumps.join(dead, "to").select("id").unionByName(dead.select(F.col("to").alias("id"))).distinct(), "tails")
    rest = links.join(gone.select(F.col("id").alias("child")), "child", "left_anti").join(gone.select(F.col("id").alias("parent")), "parent", "left_anti")
    return stage(rest.select("child", "parent"), "tails")


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("parent").alias("child"), F.col("child").alias("parent"))


def _trimmed(links: DataFrame) -> DataFrame:
    """Links without dead ends before or behind them."""
    n = links.count()
    while n:
        links = _without_tails(_turned(_without_tails(_turned(links))))
        n, before = links.count(), n
        if n == before:
            break
    return links


def _least_below(links: DataFrame) -> DataFrame:
    """id, label: the least vertex from which each one can be reached, itself included."""
    ids = links.select(F.col("child").alias("id")).unionByName(links.select(F.col("parent").alias("id"))).distinct()
    labels, jumps = stage(ids.withColumn("label", F.col("id")), "labels"), stage(_jumps(links), "jumps")
    while True:
        sent = labels.join(links, labels["id"] == links["child"]).select(F.col("parent").alias("id"), "label").unionByName(labels.join(jumps, "id").select(F.col("to").alias("id"), "label"))
        both = labels.withColumn("old", F.col("label")).unionByName(sent, allowMissingColumns=True)
        after = stage(both.groupBy("id").agg(F.min("label").alias("label"), F.min("old").alias("old")), "labels")
        labels = after.select("id", "label")
        if after.where("label < old").isEmpty():
            return labels
        jumps = _doubled(jumps).select("id", "to")


def strong_components(links: DataFrame) -> DataFrame:
    """links (child, parent) -> id, component: the vertices on cycles, and the least vertex of each one's strongly connected component.

    What has no way in or out goes first. Then each vertex learns the least one that reaches it; those who reach that one
    back, among those with the same label, are its component. What is left has other components, and goes through the same again.
    Every table has a row for a vertex or a link at most. A link of a vertex to itself is a cycle.
    """
    links = stage(links.select("child", "parent").dropna().distinct(), "scc")
    loops = links.where("child = parent").select(F.col("child").alias("id"), F.col("child").alias("component"))
    rest, found = _trimmed(links.where("child <> parent")), []
    while not rest.isEmpty():
        labels = _least_below(rest)
        of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        same = stage(rest.join(of("child"), "child").join(of("parent"), "parent").where("child_label = parent_label").select("child", "parent"), "scc")
        back = ancestors(labels.where("id = label").select("id"), _turned(same))
        found.append(stage(labels.join(back, "id").select("id", F.col("label").alias("component")), "scc-found"))
        gone = found[-1].select("id")
        rest = rest.join(gone.withColumnRenamed("id", "child"), "child", "left_anti").join(gone.withColumnRenamed("id", "parent"), "parent", "left_anti")
        rest = _trimmed(stage(rest.select("child", "parent"), "scc"))
    every = loops
    for f in found:
        sizes = f.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
        every = every.unionByName(f.join(sizes, "component", "left_semi").select("id", "component"))
    return every.groupBy("id").agg(F.min("component").alias("component"))  # a loop's vertex may be in a larger one


def find_cycles(links: DataFrame) -> DataFrame:
    """links (child, parent) -> id: the vertices that can reach themselves."""
    return strong_components(links).select("id")
