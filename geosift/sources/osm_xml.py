"""Map XML and polygon files as DataFrames."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosift.schema import META, POLYGON, Elements
from geosift.staging import small, stage

TOP = ("node", "way", "relation")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_TAG_NAME = re.compile(r"<(/?)([^\s/<>]+)")

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TAG = T.ArrayType(_struct(_k=_S, _v=_S))
_ATTRS = {"_id": _L, "_version": _L, "_timestamp": _S, "_uid": _L, "_user": _S, "_changeset": _L}
# The schema is given, never inferred: timestamps stay text, unknown attributes and children are ignored.
_NODE = _struct(**_ATTRS, _lon=_D, _lat=_D, tag=_TAG)
_WAY = _struct(**_ATTRS, nd=T.ArrayType(_struct(_ref=_L)), tag=_TAG)
_REL = _struct(**_ATTRS, member=T.ArrayType(_struct(_type=_S, _ref=_L, _role=_S)), tag=_TAG)


def _tags() -> Column:
    return F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>")).alias("tags")


def _meta() -> list[Column]:
    return [F.col(f"_{c}").alias(c) for c in META]


def _id() -> Column:
    return F.coalesce("_id", F.lit(0).cast("long")).alias("id")


def _unbalanced(tag: str) -> bool:
    """Whether a quote is open at the end: a '>' in an attribute's value has cut the tag."""
    return ("'" in tag or tag.count('"') % 2 == 1) and bool(re.search("[\"']", _QUOTED.sub("", tag)))


def _name(tag: str) -> tuple[str, str]:
    m = _TAG_NAME.match(tag)
    if not m:
        raise ValueError(f"map file: cannot read tag {tag[:100]!r}")
    return m[1], m[2]


class _Split:
    """Puts the tags of one split together to top-level elements; each tag comes without its '>'.

    What a split's ends cut is left for _stitch in rows of their own: "lead", text before the first tag; "head", tags
    before the first element (the rest of one that began before); "tail", an element that is still open; "cut", the
    start of a tag; "void", the split began in a comment: rows with a smaller seq are no elements. The last row is
    "comment" if the split ends in one, else "end".
    """

    def __init__(self, path: str, block: int):
        self.path, self.block, self.seq = path, block, 0
        self.rows: list[tuple[str, int, int, str, str]] = []
        self.comment, self.cut, self.begun = False, "", False
        self.lead: list[str] = []
        self.restart()

    def restart(self) -> None:
        self.head: list[str] = []
        self.open, self.parts, self.started = "", [], False

    def put(self, tag: str, xml: str) -> None:
        self.rows.append((self.path, self.block, self.seq, tag, xml))
        self.seq += 1

    def take(self, text: str) -> None:
        if self.cut:
            text, self.cut = f"{self.cut}>{text}", ""
        if self.comment:
            self.comment = not text.endswith("--")
            return
        i = text.find("<")
        if not self.begun and i < 0:
            self.lead.append(text)
        self.begun = self.begun or i >= 0
        t = text[i:] if i >= 0 else ""
        if t.startswith("<!--"):
            self.comment = not (t.endswith("--") and len(t) >= 6)
        elif t and not t.startswith(("<!", "<?")) and _unbalanced(t):
            self.cut = t
        elif text.endswith("--"):
            self.put("void", "")
            self.restart()
        elif t and not t.startswith(("<!", "<?")):
            self.tag(t)

    def tag(self, t: str) -> None:
        closing, name = _name(t)
        if name == "osm":
            if not closing:
                self.put("osm", t.rstrip("/") + "/>")
        elif name in TOP and not closing:
            if self.open:
                raise ValueError(f"map file: {name} in {self.open}")
            self.started = True
            if t.endswith("/"):
                self.put(name, t + ">")
            else:
                self.open, self.parts = name, [t + ">"]
        elif self.open:
            self.parts.append(t + ">")
            if closing and name == self.open:
                self.put(name, "".join(self.parts))
                self.open = ""
        elif not self.started:
            self.head.append(t + ">")

    def close(self) -> None:
        for tag, xml in (("lead", ">".join(self.lead)), ("head", "".join(self.head)), ("tail", "".join(self.parts) if self.open else ""), ("cut", self.cut)):
            if xml:
                self.put(tag, xml)
        self.put("comment" if self.comment else "end", "")


_OPEN, _CLOSE = (rf"^<{slash}({'|'.join(TOP)})(?:{end}|$)" for slash, end in (("", r"[\s/]"), ("/", r"[\s/]")))


def _where(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


def _plain(values: pa.Array) -> bool:
    """Whether each value is white space and one whole tag that is neither of the root nor a comment, declaration or instruction."""
    if _where(values, r"^<(?:[!?]|/?osm(?:[\s/]|$))|^[^<]|--$").any():
        return False
    odd = pc.bit_wise_and(pc.count_substring(values, '"'), 1).to_numpy() == 1
    return not any(map(_unbalanced, values.filter(pa.array(odd | _where(values, "'"))).to_pylist()))


def _elements(values: pa.Array) -> tuple[pa.Array, pa.Array, int] | None:
    """Plain tags, no element open before them -> names and texts of the elements, and the place of the first tag of one still open.

    As _Split does it, but by columns; None where elements are nested or closed by another name: _Split tells what is wrong.
    """
    top, close = _where(values, _OPEN), _where(values, _CLOSE)
    alone = top & pc.ends_with(values, "/").to_numpy(zero_copy_only=False)
    begin = top & ~alone
    depth = np.cumsum(begin.astype(np.int64) - close)  # after each tag
    if len(depth) and (depth.min() < 0 or depth.max() > 1 or depth[alone].any()):
        return None
    end = int(np.flatnonzero(begin)[-1]) if len(depth) and depth[-1] else len(values)
    begin, close, top, alone, depth = (m[:end] for m in (begin, close, top, alone, depth))
    names = lambda m: pc.struct_field(pc.extract_regex(values.slice(0, end).filter(pa.array(m)), r"^</?(?P<name>[^\s/<>]+)"), "name")
    if not names(begin).equals(names(close)):
        return None
    inner = (depth == 1) | close | alone
    first = np.flatnonzero(top[inner])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, inner.sum()), pa.int32()), values.slice(0, end).filter(pa.array(inner)))
    return names(top), pc.binary_join_element_wise(pc.binary_join(lists, ">"), ">", ""), end


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = None
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["path", "block", "seq", "tag", "xml"]

    def rows() -> pa.RecordBatch:
        columns = list(zip(*split.rows, strict=True)) or [()] * 5
        split.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(values: pa.Array) -> Iterator[pa.RecordBatch]:
        """Tags of one split: the whole elements among them by columns, the others one by one."""
        at = 0
        trimmed = pc.utf8_ltrim_whitespace(values)
        trimmed = trimmed.filter(pc.not_equal(trimmed, ""))
        if split.begun and not split.comment and not split.cut and len(trimmed) and _plain(trimmed):
            values = trimmed
            while at < len(values) and (split.open or not split.started):
                split.take(values[at].as_py())
                at += 1
            found = _elements(values.slice(at)) if at < len(values) else None
            if split.rows:
                yield rows()
            if found:
                tags, xml, end = found
                n, at = len(tags), at + end
                if n:
                    seq = pa.array(np.arange(split.seq, split.seq + n))
                    yield pa.RecordBatch.from_arrays([pa.repeat(split.path, n), pa.repeat(pa.scalar(split.block, pa.int64()), n), seq, tags, xml], names=names)
                    split.seq += n
        for value in values.slice(at).to_pylist():
            split.take(value)
        if split.rows:
            yield rows()

    for b in batches:
        path, block, values = (b.column(c) for c in ("path", "block", "value"))
        new = pc.or_(pc.not_equal(path.slice(1), path.slice(0, max(0, len(path) - 1))), pc.not_equal(block.slice(1), block.slice(0, max(0, len(block) - 1))))
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
        for a, e in zip(cuts, cuts[1:], strict=False):
            if a == e:
                continue
            of = path[a].as_py(), block[a].as_py()
            if split is None or of != (split.path, split.block):
                if split is not None:
                    split.close()
                    yield rows()
                split = _Split(*of)
            yield from run(values.slice(a, e - a))
    if split is not None:
        split.close()
        yield rows()


def _stitch(pdf: pd.DataFrame) -> pd.DataFrame:
    """One file's loose ends, a few a split, in order: the elements that splits cut, and "void" rows up to a seq.

    A split that is wholly in a comment is void as a whole.
    """
    out: list[tuple] = []
    pending: list | None = None  # an open element
    cut: list | None = None  # an open tag

    def add(tags: str, closed: bool) -> None:
        nonlocal pending
        if pending:
            pending[4] += tags
            if closed:
                out.append(tuple(pending))
                pending = None

    in_comment = False
    for block, rows in pdf.sort_values(["block", "seq"]).groupby("block", sort=True):
        path, last = rows["path"].iloc[0], rows["tag"].iloc[-1]
        of = {tag: (seq, xml) for tag, seq, xml in zip(rows["tag"], rows["seq"], rows["xml"], strict=True)}
        if cut:
            cut[4] += ">" + of.get("lead", (0, ""))[1]
            if not _unbalanced(cut[4]):
                t, (closing, name) = cut[4], _name(cut[4])
                if name not in TOP or closing:
                    add(t + ">", bool(closing) and pending is not None and name == pending[3])
                elif t.endswith("/"):
                    out.append((*cut[:3], name, t + ">"))
                else:
                    pending = [*cut[:3], name, t + ">"]
                cut = None
        elif "void" in of:
            out.append((path, block, of["void"][0], "void", ""))
        elif in_comment:
            out.append((path, block, 2**62, "void", ""))
            continue
        if "head" in of:
            add(of["head"][1], pending is not None and f"</{pending[3]}" in of["head"][1])
        if "tail" in of:
            pending = [path, block, of["tail"][0], _name(of["tail"][1])[1], of["tail"][1]]
        if "cut" in of:
            cut = [path, block, *of["cut"][:1], "", of["cut"][1]]
        in_comment = last == "comment"
    if pending or cut:
        raise ValueError(f"map file {(pending or cut)[0]}: an element is not closed: {(pending or cut)[4][:100]!r}")
    return pd.DataFrame(out, columns=["path", "block", "seq", "tag", "xml"]).astype({"block": "int64", "seq": "int64"})


_ELEMENT = "path string, block long, seq long, tag string, xml string"


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """path, block, seq (place in the file), tag, xml of the root tag and of every node, way and relation: one parallel pass.

    The text source cuts files at '>' into splits of any size, so a row is a tag; each task puts its own tags
    together, and what splits cut is joined by file (one loose end a split). Other elements are dropped.
    """
    tags = spark.read.text(path, lineSep=">").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = stage(tags.mapInArrow(_assemble, _ELEMENT), "map-elements")
    whole = F.col("tag").isin("osm", *TOP)
    ends = stage(rows.where(~whole).groupBy("path").applyInPandas(_stitch, _ELEMENT), "map-ends")
    out = rows.where(whole)
    voids = ends.where("tag = 'void'").select("path", "block", F.col("seq").alias("upto"))
    if not voids.isEmpty():  # a split that began in a comment
        out = out.join(small(voids), ["path", "block"], "left").where("upto is null or seq > upto").drop("upto")
    return out.unionByName(ends.where("tag <> 'void'"))


def _parsed(elements: DataFrame, tag: str, schema: T.StructType) -> DataFrame:
    options = {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false", "nullValue": "\0"}
    place = F.struct("path", "block", "seq").alias("pos")
    return elements.where(F.col("tag") == tag).select(place, F.from_xml("xml", schema, options).alias("e")).select("pos", "e.*")


def read_osm_xml(spark: SparkSession, path: str, *, once: bool = False) -> Elements:
    """Map files: every file a document. Relations get `pos`, their order: files in name order, then place in the file.

    The files are read and parsed once: nodes, ways and relations are staged as typed tables, so that each use of the map reads
    the columns that it needs. once: each of them is used once and parsed there; only the elements' text is staged.
    """
    elements = read_elements(spark, path)
    nodes = _parsed(elements, "node", _NODE).select(_id(), F.col("_lon").alias("x"), F.col("_lat").alias("y"), *_meta(), _tags())
    ways = _parsed(elements, "way", _WAY).select(
        _id(), F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.array().cast("array<bigint>")).alias("nodes"), *_meta(), _tags())
    member = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    relations = _parsed(elements, "relation", _REL).select(
        _id(), F.coalesce(member, F.array().cast("array<struct<type:string,ref:bigint,role:string>>")).alias("members"), *_meta(), _tags(), "pos")
    root = elements.where("tag = 'osm'").orderBy("path", "block", "seq").select("xml").first()
    parts = (nodes, ways, relations) if once else (stage(p, f"map-{n}") for p, n in ((nodes, "nodes"), (ways, "ways"), (relations, "relations")))
    return Elements(*parts, dict(ET.fromstring(root["xml"]).attrib) if root else {})


NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def parse_poly(files: DataFrame) -> DataFrame:
    """files (path, value: a whole file) -> path and POLYGON rows, in order; malformed files raise.

    The first line is a name. A section starts with a line that holds digits ('!' before them: exclude), has
    a point a line and ends with END; one more END ends the file, and what follows is ignored.
    """
    line = files.select("path", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("n", "line")).where("n > 0")
    line = line.withColumn("t", F.trim(F.regexp_replace("line", r"\s+", " "))).where("t <> ''")
    by_file = Window.partitionBy("path").orderBy("n")
    prev = F.lag(F.col("t") == "END").over(by_file)
    line = line.withColumns({"first": F.row_number().over(by_file) == 1, "end": F.col("t") == "END"})
    # An END outside a section: the second of two, or the first line.
    line = line.withColumn("over", F.max((F.col("end") & (F.col("first") | prev)).cast("int")).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.withColumn("head", F.col("first") | prev).where("over = 0")
    line = line.withColumn("section", F.sum(F.col("head").cast("int")).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    bad_head = F.col("head") & ~F.col("t").rlike(r"[0-9]")
    point = F.regexp_extract_all("t", F.lit(f"({NUMBER})"), 1)
    bad_point = ~F.col("head") & ~F.col("end") & ~F.col("t").rlike(f"^{NUMBER} {NUMBER}$")
    line = line.withColumn("ok", F.when(bad_head | bad_point, F.raise_error(F.concat(F.lit("polygon file: cannot read line "), F.col("line")))).otherwise(F.lit(True)))
    xy = F.struct(F.get(point, 0).cast("double").alias("x"), F.get(point, 1).cast("double").alias("y"))
    ring = F.array_sort(F.collect_list(F.when(~F.col("head") & ~F.col("end") & F.col("ok"), F.struct("n", xy.alias("p")))))
    kind = F.max(F.when(F.col("head") & F.col("ok"), F.when(F.col("t").rlike(r"![0-9]"), "exclude").otherwise("include")))
    rings = line.groupBy("path", "section").agg(kind.alias("kind"), ring.alias("ring"), F.bool_or("end").alias("closed"))
    fault = F.when(~F.col("closed"), F.raise_error(F.lit("polygon file: a section has no END"))).when(
        F.size("ring") == 0, F.raise_error(F.lit("polygon file: an empty ring"))).otherwise(F.col("kind"))
    return rings.select("path", (F.col("section") - 1).cast("int").alias("poly_id"), fault.alias("kind"), F.transform("ring", lambda r: r["p"]).alias("ring"))


def read_poly(spark: SparkSession, path: str) -> DataFrame:
    """POLYGON rows of a polygon file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_poly(files).select(*[f.name for f in POLYGON])
