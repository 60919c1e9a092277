"""XML trees as interval labels, and path steps as structural joins.

A node is a row: `pre` and `post` are the places of its start and its end among its document's events (equal for a text), so a
node is inside another if its interval is. Steps take a set of nodes and give a set of nodes, each once, and never make
pairs: in the order of `pre`, intervals nest or are apart, so one running value tells whether a node is inside any (or
round any) of the context; siblings compare with the first or last of the context under their parent.

Steps along `child`, `parent` and siblings are joins on (document, parent) and go apart over a large document's parents;
the others read each document in order, as its events were parsed.

Defined results:
- nodes are elements and texts (adjacent text is one node, white space is none); the root element's parent is null.
- empty context or no nodes: no rows. Extra columns of nodes are kept; of the context only labels count.
- repeated rows in the context count once; ids may be null (null documents have no nodes) and are compared null-safely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geosift.staging import unused

#: Each axis and the one that leads back.
INVERSE = {
    "self": "self", "child": "parent", "parent": "child", "descendant": "ancestor", "ancestor": "descendant",
    "descendant-or-self": "ancestor-or-self", "ancestor-or-self": "descendant-or-self",
    "following-sibling": "preceding-sibling", "preceding-sibling": "following-sibling", "following": "preceding", "preceding": "following",
}


def label(events: DataFrame) -> DataFrame:
    """sax_events -> id, kind ('element' or 'text'), pre, post, level, parent, uri, name, attrs, text, text_from, text_to.

    text_from and text_to are the places (code points, end exclusive) of a node's text in all text of its document.
    """
    rows = events.where(F.col("event").isin("startElement", "endElement", "characters"))
    upto = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    start, end, text = (F.col("event") == e for e in ("startElement", "endElement", "characters"))
    length = F.when(text, F.length("text")).otherwise(0)
    rows = rows.withColumn("depth", F.sum(F.when(start, 1).when(end, -1).otherwise(0)).over(upto)).withColumn("to", F.sum(length).over(upto))
    # An end has its start's level; a text is a level below its element.
    rows = rows.withColumn("level", F.when(start, F.col("depth")).otherwise(F.col("depth") + 1).cast("int"))
    same = Window.partitionBy("id", "level").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("closed", F.first(F.when(end, F.struct("seq", "to")), ignorenulls=True).over(same))
    # The parent is the last element that began a level above: found among starts of that level and nodes of this one.
    above = F.when(start, F.array(F.col("level"), F.col("level") + 1)).when(text, F.array("level"))
    both = rows.where(~end).select("*", F.explode(above).alias("band"))
    order = Window.partitionBy("id", "band").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("parent", F.last(F.when(start & (F.col("level") < F.col("band")), F.col("seq")), ignorenulls=True).over(order))
    return both.where("band = level").select(
        "id", F.when(start, "element").otherwise("text").alias("kind"), F.col("seq").alias("pre"), F.when(start, F.col("closed.seq")).otherwise(F.col("seq")).alias("post"),
        "level", "parent", "uri", F.col("local_name").alias("name"), "attrs", "text", (F.col("to") - F.when(text, F.length("text")).otherwise(0)).alias("text_from"),
        F.when(start, F.col("closed.to")).otherwise(F.col("to")).alias("text_to"))


def elements(nodes: DataFrame, name: str | None = None, uri: str | None = None) -> DataFrame:
    """The node test of a step: elements, of a local name and a namespace if given."""
    out = nodes.where("kind = 'element'")
    out = out if name is None else out.where(F.col("name") == name)
    return out if uri is None else out.where(F.col("uri") == uri)


def texts(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'text'")


def attribute(name: str, uri: str = "") -> Column:
    """An attribute's value; null where there is none."""
    return F.get(F.filter("attrs", lambda a: (a["name"] == name) & (a["uri"] == uri)), 0)["value"]


def step(context: DataFrame, nodes: DataFrame, axis: str) -> DataFrame:
    """Those of nodes that lie on the axis of any node of the context."""
    if axis not in INVERSE:
        raise ValueError(f"no axis {axis}")
    if axis.endswith("-or-self"):
        return _ordered(context, nodes, axis.removesuffix("-or-self"), own=True)
    if axis in ("descendant", "ancestor"):
        return _ordered(context, nodes, axis, own=False)
    names = {c: unused(f"context_{c}", nodes) for c in ("id", "key", "least")}
    of, key, least = names["id"], names["key"], names["least"]
    by, mine, bound, test = {  # what the context is grouped by, the nodes' column for that, a bound, and a test against it
        "self": ("pre", "pre", F.lit(0), None),
        "child": ("pre", "parent", F.lit(0), None),
        "parent": ("parent", "pre", F.lit(0), None),
        "following-sibling": ("parent", "parent", F.min("pre"), lambda b: F.col("pre") > b),
        "preceding-sibling": ("parent", "parent", F.max("pre"), lambda b: F.col("pre") < b),
        "following": (None, None, F.min("post"), lambda b: F.col("pre") > b),
        "preceding": (None, None, F.max("pre"), lambda b: F.col("post") < b),
    }[axis]
    c = context.select(F.col("id").alias(of), (F.col(by) if by else F.lit(0)).alias(key), "pre", "post").where(F.col(key).isNotNull())
    c = c.groupBy(of, key).agg((bound if test else F.max(F.lit(0))).alias(least))
    on = nodes["id"].eqNullSafe(c[of])
    if mine:
        on &= nodes[mine] == c[key]
    # By its bytes in a shuffle Spark would send a side through the driver that is many times larger there.
    out = nodes.join(c.hint("merge"), on)
    return (out.where(test(F.col(least))) if test else out).select(*[nodes[x] for x in nodes.columns])


def _ordered(context: DataFrame, nodes: DataFrame, axis: str, own: bool) -> DataFrame:
    """Nodes inside (descendant) or round (ancestor) any node of the context; own: or of it."""
    mark, row = unused("of_context", nodes), unused("node", nodes)
    # Those of the context stand before the nodes of the same place.
    marks = context.select("id", "pre", "post", F.lit(0).alias(mark), F.lit(None).cast(nodes.schema).alias(row))
    both = marks.unionByName(nodes.select("id", "pre", "post", F.lit(1).alias(mark), F.struct(*nodes.columns).alias(row)))
    is_context = F.col(mark) == 0
    if axis == "descendant":
        order = Window.partitionBy("id").orderBy("pre", mark)
        found = F.max(F.when(is_context, F.col("post"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow) if own else
                                                             Window.partitionBy("id").orderBy("pre").rangeBetween(Window.unboundedPreceding, -1))
        hit = found >= F.col("post")
    else:
        found = F.min(F.when(is_context, F.col("pre"))).over(Window.partitionBy("id").orderBy("pre").rangeBetween(0 if own else 1, Window.unboundedFollowing))
        hit = found <= F.col("post")
    return both.withColumn(mark + "_hit", hit).where((F.col(mark) == 1) & F.col(mark + "_hit")).select(f"{row}.*")


def having(context: DataFrame, nodes: DataFrame, axis: str) -> DataFrame:
    """The predicate of a path: those of the context on whose axis any of nodes lies."""
    return step(nodes, context, INVERSE[axis])


def nth(nodes: DataFrame, n: int) -> DataFrame:
    """The n-th of nodes under each parent, from 1; below 0 from the last one."""
    order = F.col("pre") if n > 0 else F.col("pre").desc()
    place = unused("place", nodes)
    numbered = nodes.withColumn(place, F.row_number().over(Window.partitionBy("id", "parent").orderBy(order)))
    return numbered.where(F.col(place) == abs(n)).drop(place)


def string_values(context: DataFrame, nodes: DataFrame) -> DataFrame:
    """The context with `value`: all text inside each node, in document order. nodes: of whole documents."""
    whole, of = unused("whole", context), unused("of", context)
    all_texts = texts(nodes).groupBy(F.col("id").alias(of)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda t: t["text"]), "").alias(whole))
    out = context.join(all_texts.hint("merge"), context["id"].eqNullSafe(all_texts[of]), "left")
    value = F.substring(F.coalesce(whole, F.lit("")), (F.col("text_from") + 1).cast("int"), (F.col("text_to") - F.col("text_from")).cast("int"))
    return out.select(*[context[c] for c in context.columns], value.alias("value"))
