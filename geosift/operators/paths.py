"""Path steps inside whole documents: sets of nodes as masks over a batch of parsed documents.

A document is one record, so no step leaves it: a batch of documents is parsed once and all steps of all paths are array
operations on its nodes, without a shuffle or a staged table. Nodes, their places and the axes are those of `trees`, whose
steps serve where a context comes from another table or a large document has to go apart over several tasks.

Defined results:
- a row is a document of its own, whatever its id; null documents have no nodes, bad XML raises.
"""

from __future__ import annotations

import xml.parsers.expat
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosift.operators.trees import INVERSE

BATCH_EVENTS, BATCH_CHARS = 50_000, 4 << 20  # from which a batch of documents is evaluated
END, TEXT, OTHER, BREAK, DOCUMENT = -1, -2, -3, -4, -5  # events; from 0 on the start of an element with the name of that number


def _unread(*_: str | None) -> int:
    """External entities are not read."""
    return 1


class _Names(dict):
    def __missing__(self, name: str) -> int:
        self[name] = n = len(self)
        return n


class _Parser:
    """The events of documents as numbers, in the order and number of `xml.events_of`; BREAK parts texts and is no event."""

    def __init__(self) -> None:
        self.events: list[int] = []
        self.names = _Names()
        self.texts: list[str] = []
        self.more: dict[int, list[str]] = {}  # further pieces of a text
        self.size = 0
        self._intern: dict[str, str] = {}
        events, names, texts, more = self.events, self.names, self.texts, self.more
        push, push_text = events.append, texts.append

        def start(name: str, _: list) -> None:
            push(names[name])

        def end(_: str) -> None:
            push(END)

        def text(content: str) -> None:
            if events[-1] == TEXT:
                more.setdefault(len(texts) - 1, []).append(content)
            else:
                push(TEXT)
                push_text(content)

        def other(*_: str | None) -> None:
            push(OTHER)

        def part() -> None:
            push(BREAK)

        self._start, self._end, self._text, self._other, self._part = start, end, text, other, part

    def add(self, document: str | bytes) -> None:
        data = document.encode() if isinstance(document, str) else document
        p = xml.parsers.expat.ParserCreate(None, " ", self._intern)
        p.buffer_text = p.ordered_attributes = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._text
        p.ProcessingInstructionHandler = p.StartNamespaceDeclHandler = p.EndNamespaceDeclHandler = self._other
        p.StartCdataSectionHandler = p.EndCdataSectionHandler = self._part
        p.ExternalEntityRefHandler = _unread
        p.SetParamEntityParsing(xml.parsers.expat.XML_PARAM_ENTITY_PARSING_UNLESS_STANDALONE)
        self.events.append(DOCUMENT)
        self.size += len(data)
        p.Parse(data, True)

    def nodes(self) -> Nodes:
        for i, pieces in self.more.items():
            self.texts[i] = "".join([self.texts[i], *pieces])
        return Nodes(np.array(self.events, np.int32), self.names, self.texts)


class Nodes:
    """Elements and texts of some documents, a row each, in document order. A set of nodes is a mask over the rows.

    doc: the document's number, pre and post: the places of start and end, up: the parent's row (-1 for a root),
    last: the last row inside (or the own row).
    """

    def __init__(self, events: np.ndarray, names: dict[str, int], texts: list[str]) -> None:
        events = events[events != BREAK]
        at = np.arange(len(events))
        begins = np.flatnonzero(events == DOCUMENT)
        doc = np.cumsum(events == DOCUMENT) - 1
        seq = at - begins[doc]
        start, end, text = events >= 0, events == END, events == TEXT
        blank = np.fromiter(map(str.isspace, texts), bool, len(texts))
        text[text] = ~blank  # white space is an event and no node
        depth = np.cumsum(start.astype(np.int64) - end)
        level = depth + (end | text)  # an end has its start's level; a text is a level below its element
        # On one level starts and ends take turns, as every document ends on level 0.
        both = np.flatnonzero(start | end)
        both = both[np.argsort(level[both], kind="stable")]
        starts, ends = both[0::2], both[1::2]
        row = np.cumsum(start | text) - 1  # the row of a node, for an end the last row before it
        node = np.flatnonzero(start | text)
        closed = at.copy()
        closed[starts] = ends
        self.doc, self.pre, self.post, self.last = doc[node], seq[node].astype(np.int32), seq[closed[node]].astype(np.int32), row[closed[node]]
        # The parent is the last element that began a level above.
        wide = len(events) + 1
        parent = starts[np.searchsorted(level[starts] * wide + starts, (level[node] - 1) * wide + node) - 1]
        self.up = np.where(level[node] > 1, row[parent], -1)
        self._rows, self._docs = np.arange(len(node)), len(begins)
        self._name = np.where(start, events, -1)[node]
        self._names = names
        self._text = [t for t, b in zip(texts, blank, strict=True) if not b] if blank.any() else texts

    def __len__(self) -> int:
        return len(self._rows)

    def elements(self, name: str | None = None, uri: str | None = None) -> np.ndarray:
        """The node test of a step: elements, of a local name and a namespace if given."""
        if name is None and uri is None:
            return self._name >= 0
        fits = np.zeros(len(self._names) + 1, bool)  # the last one: a text's
        for full, n in self._names.items():
            space, _, local = full.rpartition(" ")
            fits[n] = (name is None or local == name) and (uri is None or space == uri)
        return fits[self._name]

    def texts(self, value: str | None = None) -> np.ndarray:
        """Texts, of a value if given."""
        out = self._name < 0
        if value is not None:
            out[out] = np.fromiter((t == value for t in self._text), bool, len(self._text))
        return out

    def roots(self) -> np.ndarray:
        return self.up < 0

    def step(self, context: np.ndarray, nodes: np.ndarray, axis: str) -> np.ndarray:
        """Those of nodes that lie on the axis of any node of the context."""
        if axis not in INVERSE:
            raise ValueError(f"no axis {axis}")
        n, rows, at = len(self), self._rows, np.flatnonzero(context)
        if axis == "self":
            hit = context
        elif axis == "child":
            hit = np.append(context, False)[self.up]  # a root's parent is the row behind the last one
        elif axis == "parent":
            hit = np.zeros(n + 1, bool)
            hit[self.up[at]] = True
            hit = hit[:n]
        elif axis.startswith("descendant"):
            hit = np.cumsum(np.bincount(at + 1, minlength=n + 1) - np.bincount(self.last[at] + 1, minlength=n + 1))[:n] > 0
        elif axis.startswith("ancestor"):
            before = np.concatenate(([0], np.cumsum(context)))
            hit = before[self.last + 1] > before[rows + 1]
        elif axis in ("following-sibling", "preceding-sibling"):
            at = at[self.up[at] >= 0]
            if axis == "following-sibling":
                bound = np.full(n + 1, n)
                np.minimum.at(bound, self.up[at], at)
                hit = rows > bound[self.up]
            else:
                bound = np.full(n + 1, -1)
                np.maximum.at(bound, self.up[at], at)
                hit = rows < bound[self.up]
        elif axis == "following":
            bound = np.full(self._docs, n)
            np.minimum.at(bound, self.doc[at], self.last[at])
            hit = rows > bound[self.doc]
        else:
            bound = np.full(self._docs, -1)
            np.maximum.at(bound, self.doc[at], at)
            hit = self.last < bound[self.doc]
        return ((hit | context) if axis.endswith("-or-self") else hit) & nodes

    def having(self, context: np.ndarray, nodes: np.ndarray, axis: str) -> np.ndarray:
        """The predicate of a path: those of the context on whose axis any of nodes lies."""
        return self.step(nodes, context, INVERSE[axis])

    def nth(self, nodes: np.ndarray, n: int) -> np.ndarray:
        """The n-th of nodes under each parent, from 1; below 0 from the last one."""
        at = np.flatnonzero(nodes)
        under = np.where(self.up[at] >= 0, self.up[at], len(self) + self.doc[at])
        at = at[np.argsort(under, kind="stable")] if n > 0 else at[::-1][np.argsort(under[::-1], kind="stable")]
        under = np.sort(under)
        place = np.arange(len(at)) - np.searchsorted(under, under) + 1
        out = np.zeros(len(self), bool)
        out[at[place == abs(n)]] = True
        return out


def select(docs: DataFrame, paths: Callable[[Nodes], dict[str, np.ndarray]], id_col: str = "id", xml_col: str = "xml") -> DataFrame:
    """docs -> path, id, pre, post: the nodes that each of the named paths finds, each once."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parser, of = b.column("id"), _Parser(), []

            def found(ids: pa.Array, parser: _Parser, of: list[int]) -> Iterator[pa.RecordBatch]:
                nodes, of = parser.nodes(), np.array(of, np.int64)
                for path, mask in paths(nodes).items():
                    at = np.flatnonzero(mask)
                    if len(at):
                        columns = [pa.repeat(path, len(at)), ids.take(pa.array(of[nodes.doc[at]])), pa.array(nodes.pre[at]), pa.array(nodes.post[at])]
                        yield pa.RecordBatch.from_arrays(columns, names=["path", "id", "pre", "post"])

            for i, doc in enumerate(b.column("xml")):
                if doc.is_valid:
                    of.append(i)
                    parser.add(doc.as_py())
                    if len(parser.events) >= BATCH_EVENTS or parser.size >= BATCH_CHARS:
                        yield from found(ids, parser, of)
                        parser, of = _Parser(), []
            if of:
                yield from found(ids, parser, of)

    return docs.select(F.col(id_col).alias("id"), F.col(xml_col).alias("xml")).mapInArrow(run, f"path string, id {kind}, pre int, post int")
