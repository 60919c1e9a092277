"""Schema-less XML: events, simple form and paths."""

from __future__ import annotations

import io
import xml.sax
import xml.sax.handler
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geosift.functions.text import expanded_name

BATCH_EVENTS, BATCH_CHARS = 10_000, 4 << 20  # from which a batch of events goes out
EVENTS = "seq int, event string, uri string, local_name string, prefix string, attrs array<struct<name:string,uri:string,value:string>>, text string"


class _Collector(xml.sax.handler.ContentHandler):
    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.joined = False  # whether more text belongs to the last event

    def _add(self, event: str, uri: str | None = None, local: str | None = None, prefix: str | None = None, attrs: list | None = None, text: str | None = None) -> None:
        self.rows.append((len(self.rows), event, uri, local, prefix, attrs or [], text))
        self.joined = text is not None and event != "processingInstruction"

    def startDocument(self) -> None:  # noqa: N802
        self._add("startDocument")

    def endDocument(self) -> None:  # noqa: N802
        self._add("endDocument")

    def startPrefixMapping(self, prefix: str | None, uri: str) -> None:  # noqa: N802
        self._add("startPrefixMapping", uri, prefix=prefix or "")

    def endPrefixMapping(self, prefix: str | None) -> None:  # noqa: N802
        self._add("endPrefixMapping", prefix=prefix or "")

    def startElementNS(self, name: tuple, qname: str | None, attrs) -> None:  # noqa: N802, ANN001
        own = [{"name": n, "uri": u or "", "value": v} for (u, n), v in attrs.items()]
        self._add("startElement", name[0] or "", name[1], (qname or "").partition(":")[0] if ":" in (qname or "") else "", own)

    def endElementNS(self, name: tuple, qname: str | None) -> None:  # noqa: N802
        self._add("endElement", name[0] or "", name[1])

    def characters(self, content: str) -> None:
        kind = "characters" if content.strip() else "ignorableWhitespace"
        if self.joined:
            content = self.rows.pop()[6] + content
            kind = "characters" if content.strip() else "ignorableWhitespace"
        self._add(kind, text=content)

    def startCDATA(self) -> None:  # noqa: N802
        """A CDATA section is an event of its own."""
        self.joined = False

    endCDATA = startCDATA  # noqa: N815

    def comment(self, content: str) -> None:
        """Comments are no events; they do not part the text around them."""

    def startDTD(self, name: str, public: str | None, system: str | None) -> None:  # noqa: N802
        pass

    def endDTD(self) -> None:  # noqa: N802
        pass

    def processingInstruction(self, target: str, data: str) -> None:  # noqa: N802
        self._add("processingInstruction", local=target, text=data)


def _reader() -> xml.sax.xmlreader.XMLReader:
    parser = xml.sax.make_parser()
    parser.setFeature(xml.sax.handler.feature_namespaces, True)
    parser.setFeature(xml.sax.handler.feature_external_ges, False)
    return parser


def events_of(document: str | bytes, parser: xml.sax.xmlreader.XMLReader | None = None) -> list[tuple]:
    """The events of one document; external entities are not read. parser: one of `_reader` that is used again."""
    parser = parser or _reader()
    handler = _Collector()
    parser.setContentHandler(handler)
    parser.setProperty(xml.sax.handler.property_lexical_handler, handler)
    source = xml.sax.xmlreader.InputSource()
    source.setByteStream(io.BytesIO(document.encode() if isinstance(document, str) else document))
    parser.parse(source)
    return handler.rows


def sax_events(docs: DataFrame, id_col: str = "id", xml_col: str = "xml") -> DataFrame:
    """docs -> id, seq and an event a row. A document is one record; bad XML raises, null has no events."""
    attr = pa.list_(pa.struct([("name", pa.string()), ("uri", pa.string()), ("value", pa.string())]))
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), attr, pa.string()]

    names = ["id", *[f.split()[0] for f in EVENTS.replace("array<struct<name:string,uri:string,value:string>>", "x").split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _reader()
        for b in batches:
            at: list[int] = []  # the document of each event
            rows: list[tuple] = []

            def out(b: pa.RecordBatch = b, at: list[int] = at, rows: list[tuple] = rows) -> pa.RecordBatch:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                batch = pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), *cols], names=names)
                at.clear()
                rows.clear()
                return batch

            size = 0
            for i, doc in enumerate(b.column("xml")):
                if doc.is_valid:
                    text = doc.as_py()
                    events = events_of(text, parser)
                    rows += events
                    at += [i] * len(events)
                    size += len(text)
                    if len(rows) >= BATCH_EVENTS or size >= BATCH_CHARS:
                        yield out()
                        size = 0
            if rows:
                yield out()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(xml_col).alias("xml")).mapInArrow(run, f"id {kind}, {EVENTS}")


def fold_events(docs: DataFrame, step: Callable[[Any, tuple], Any], initial: Callable[[], Any], result: str, finish: Callable[[Any], Any] = lambda state: state,
                id_col: str = "id", xml_col: str = "xml") -> DataFrame:
    """docs -> id, value (of the type `result`): each document's events folded by step(state, event), from initial() on.

    An event is a tuple in the order of EVENTS. null documents give null.
    """

    @F.pandas_udf(result)
    def fold(texts: pd.Series) -> pd.Series:
        out, parser = [], _reader()
        for t in texts:
            if t is None:
                out.append(None)
                continue
            state = initial()
            for event in events_of(t, parser):
                state = step(state, event)
            out.append(finish(state))
        return pd.Series(out, dtype="object")

    return docs.select(F.col(id_col).alias("id"), fold(F.col(xml_col)).alias("value"))


def simple_form(events: DataFrame, rename: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """sax_events -> id, seq, depth, name ({uri}local), attrs, text, texts: an element a row, in document order.

    A recursive tree has no Spark type; depth and order give the tree back. text is the element's own first text if that
    follows its start tag, texts all of its own texts in order. rename(uri, local name, prefix) makes the names.
    """
    w = Window.partitionBy("id").orderBy("seq")
    step = F.when(F.col("event") == "startElement", 1).when(F.col("event") == "endElement", -1).otherwise(0)
    rows = events.withColumn("depth", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(F.col("event").isin("startElement", "endElement", "characters"))
    rows = rows.withColumn("own", F.when(F.lead("event").over(w) == "characters", F.lead("text").over(w)))
    # The element a text stands in: the last one that began at the text's depth.
    level = Window.partitionBy("id", "depth").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("parent", F.last(F.when(F.col("event") == "startElement", F.col("seq")), ignorenulls=True).over(level))
    texts = rows.where("event = 'characters'").groupBy("id", F.col("parent").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t"))
    name = rename(F.col("uri"), F.col("local_name"), F.col("prefix")) if rename else expanded_name(F.col("uri"), F.col("local_name"))
    form = rows.where("event = 'startElement'").select("id", "seq", "depth", name.alias("name"), "attrs", F.col("own").alias("text"))
    none = F.array().cast("array<string>")
    return form.join(texts, ["id", "seq"], "left").select(*form.columns, F.coalesce(F.transform("t", lambda t: t["text"]), none).alias("texts"))


def select_path(document: Column, path: str) -> Column:
    """Texts that an XPath selects."""
    return F.xpath(document, F.lit(path))


def precise(value: Column, digits: int) -> Column:
    """A number as text with a fixed number of digits."""
    return F.format_string(f"%.{digits}f", value)
