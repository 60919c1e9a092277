"""HTML extraction: blocks by structure, boilerplate by a suffix array per host.

A page is parsed into blocks. Blocks inside an article (or main) element that are not furniture (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, reader comments) are main text. On a page without
an article, blocks that are not furniture are open. The token streams of everything outside articles are
concatenated per host, and a suffix array finds runs of at least RUN tokens that stand on MIN_PAGES distinct pages or
more: the host's boilerplate. In open blocks covered tokens are removed and the unique runs are kept.

Covered blocks inside articles are not removed, not even those that are boilerplate elsewhere: pages share articles,
and sidebars and teasers quote whole sentences of them, so that would take away main text (see README for figures).

Furniture that holds the page's main element is given back, whatever made it furniture. On a page without another article
so is what names or forms make furniture round an article, and a form round the page's frame (a menu, header or footer); and where
nothing else is left, all that is round an article, and forms with paragraphs. An article named as a reader's comment is
furniture wherever something else is left; no other name makes an article or main element furniture. A whole class or id (`sidebar`) makes furniture; one with a
part that tells of a layout (`no-sidebar`) says nothing; another with a part of that kind (`main-widget`) makes furniture of a
container (not of a paragraph, a heading or an inline element) in an article that has other text, and is open on a page without an article.
An article in such a container counts only on pages that have no other and less text outside: else it is open like its container.

A host's pages are dealt by a hash of id and html into shards of about PAGES pages, and each shard gets a suffix array of
its own. Its classes of equal run prefixes are merged over the shards by their content hash, with page counts
that add up as shards share no page. So a host with a third of all pages is no hot group. Pages are parsed twice: for
the streams, and for the result; their texts are never moved. Only if the boilerplate runs are more than RUNS
are pages dealt by (host, shard) to their host's runs.

Defined results:
- null and empty html: text '', 0 characters. null url: a host of its own (''). null ids are kept; repeated
  rows are pages of their own, with equal results.
- cut-off markup is read as far as it goes. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosift.llm.common import small, small_batches, stage, temporary

RUN, MIN_PAGES, PAGES = 8, 3, 1000
RUNS = 2_000_000  # boilerplate runs (8 bytes each) up to which all tasks get them

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = frozenset("script style head title template noscript iframe object svg canvas math audio video".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button select textarea fieldset".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre "
    "section summary table tbody td tfoot th thead tr ul caption".split()) | FURNITURE - {"button", "select", "textarea"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Elements that a part of a name makes furniture: containers, not the text itself.
CONTAINERS = frozenset("div section ul ol dl table center details figure".split())
NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside cookie cookies consent notice banner ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion comment comments disqus respond newsletter subscribe share sharing "
    "social related breadcrumb breadcrumbs popup modal overlay login signup widget toolbar pagination pager skip".split())
LAYOUT = frozenset("no not with without has have is open opened closed enabled disabled layout".split())
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
POSTS = frozenset("post hentry entry story".split())
FRAME = frozenset("nav header footer main article".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_CUT = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class _Frame(NamedTuple):
    """An element that makes furniture of its content, and those around it."""

    number: int
    tag: str
    mild: bool  # made so by a name that is not one of comments, or a form; and so are those around it
    around: _Frame | None


class _Open(NamedTuple):
    """An open element: what it makes of its content, and what is around its content."""

    tag: str
    state: str
    block: int  # place of the innermost block that is no paragraph, or -1
    article: str  # state of the article or main element, or ''
    frame: _Frame | None


_ROOT = _Open("", "open", -1, "", None)


class _Page(HTMLParser):
    """Collects blocks as (kind, text): 'main' in an article, 'open' outside, 'furniture' where the page's frame is;
    'soft main' and 'soft open' where only a part of a name speaks for furniture, 'soft article' in an article there.

    spared: numbers of elements that make no furniture. Time is linear in the page, however deep it nests.
    """

    def __init__(self, spared: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # tag -> its places in the stack
        self.spared, self.count = spared, 0
        # Furniture that holds a main element, an article (mildly, or at all), a part of the page's frame, a paragraph.
        self.round_main: set[int] = set()
        self.round_article: set[int] = set()
        self.round_any: set[int] = set()
        self.round_frame: set[int] = set()
        self.round_text: set[int] = set()
        self.forms: set[int] = set()  # outside articles
        self.blocks: list[tuple[str, str]] = []
        self.held: list[tuple[str, str]] = []  # (state, text) of the block so far
        self.has_article = False

    @property
    def inner(self) -> _Open:
        return self.stack[-1] if self.stack else _ROOT

    def flush(self) -> None:
        held, self.held = self.held, []
        for state in dict.fromkeys(k for k, _ in held):  # inline elements may be hidden, or furniture
            text = " ".join("".join(t for k, t in held if k == state).split())
            if text and state != "gone":
                self.blocks.append((state, text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data("\n")
            return
        if tag in BLOCKS or tag in INVISIBLE:
            self.flush()
        if tag in CLOSES_P:
            self._close(("p",), self.inner.block)
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], self._last("ul", "ol", "dl", "table", "select", *(("tr",) if tag in ("td", "th") else ())))
        if tag in VOID:
            return
        self.count += 1
        a, around = dict(attrs), self.inner
        state, frame = self._state(tag, a, around)
        at = len(self.stack)
        self.places.setdefault(tag, []).append(at)
        article = state if state in ("main", "soft article") else around.article
        self.stack.append(_Open(tag, state, at if tag in BLOCKS and tag != "p" else around.block, article, frame))

    def _last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _pop(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    @staticmethod
    def _mark(frame: _Frame | None, into: set[int]) -> None:
        while frame and frame.number not in into:
            into.add(frame.number)
            frame = frame.around

    @staticmethod
    def _comment(attrs: dict[str, str | None]) -> bool:
        """Whether names tell of a reader's comment, and none of a post."""
        names = [{n.lower() for n in _NAME.findall(t)} for t in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()]
        return any(n & COMMENTS and not n & LAYOUT for n in names) and not any(n & POSTS and not n & COMMENTS for n in names)

    def _named(self, tag: str, attrs: dict[str, str | None]) -> str:
        """'whole' if a class or the id is a name of furniture, 'part' if a part of one is, else ''."""
        if tag in ("html", "body"):
            return ""
        found = ""
        for token in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
            parts = {n.lower() for n in _NAME.findall(token)}
            if token.lower() in NAMES:
                return "whole"
            if tag in CONTAINERS and parts & NAMES and not parts & LAYOUT:
                found = "part"
        return found

    def _state(self, tag: str, attrs: dict[str, str | None], around: _Open) -> tuple[str, _Frame | None]:
        """What the element makes of its content, and the furniture around that."""
        now, frame = around.state, around.frame
        role = (attrs.get("role") or "").lower()
        if now == "gone" or tag in INVISIBLE or "hidden" in attrs or _UNSEEN.search(attrs.get("style") or ""):
            return "gone", frame
        is_main, is_article = tag == "main" or role == "main", tag == "article" or role == "article"
        comment = is_article and not is_main and self._comment(attrs)
        hard = tag in FURNITURE or role in ROLES
        named = "" if is_main or is_article and not comment else self._named(tag, attrs)
        spared = self.count in self.spared
        if tag == "form" and not around.article:
            self.forms.add(self.count)
        mild = not comment and (tag == "form" and not around.article if hard else not self._comment(attrs))
        own = _Frame(self.count, tag, mild and (frame is None or frame.mild), frame)
        if now == "furniture":
            if is_main and not around.article:
                self._mark(frame, self.round_main)
            elif is_article and not comment:
                self._mark(frame, self.round_any)
                if frame.mild:
                    self._mark(frame, self.round_article)
            if tag in FRAME and not comment:
                self._mark(frame, self.round_frame)
            if tag == "p":
                self._mark(frame, self.round_text)
            if tag in HEADINGS and frame.tag == "header" and frame.around is None and around.article:
                return around.article, frame
            return now, own if hard or named == "whole" else frame
        if comment and not spared:
            self.round_any.add(self.count)
            return "furniture", own
        if hard and not spared:
            return "furniture", own
        inside = now in ("main", "soft main", "soft article")
        if is_main or (is_article and not inside):
            if now == "soft open" and not is_main:
                return "soft article", frame
            self.has_article = True
            return "main", frame
        if named and not spared:
            if named == "whole":
                return "furniture", own
            return "soft main" if inside else "soft open", frame
        return now, frame

    def _close(self, tags: Iterable[str], stop: int) -> None:
        """Close the innermost element of tags, if it is inside the place `stop`."""
        at = self._last(*tags)
        if at > stop:
            self.flush()
            self._pop(at)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag in BLOCKS or tag in INVISIBLE:
            self.flush()
        at = self._last(tag)
        if at >= 0 and (tag in BLOCKS or at > self._last("article", "main", "table")):
            self._pop(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br":
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.held.append((self.inner.state, data))

    def close(self) -> None:
        super().close()
        self.flush()


def parse(html: str | None) -> tuple[list[str], list[str], list[str]]:
    """Main, open and furniture blocks; a page with an article has no open blocks, its loose text is furniture.

    A block in which inline elements are hidden or furniture is a block of each kind.
    """
    if not html:
        return [], [], []
    html = _CUT.sub("", html)  # a tag that the end of the input cuts off is markup, not text
    page = _read(html)
    spared = page.round_main if page.has_article else page.round_main | page.round_article | page.round_frame & page.forms
    if spared:
        page = _read(html, frozenset(spared))
    if all(k == "furniture" for k, _ in page.blocks):
        more = page.round_main | page.round_any | page.round_text & page.forms
        if more - spared:
            page = _read(html, frozenset(spared | more))
    of = lambda *kinds: [t for k, t in page.blocks if k in kinds]
    length = lambda blocks: sum(map(len, blocks))
    main = "main" if of("main") else "soft main"
    if not page.has_article and length(of("soft article")) > length(of("open")):
        main = "soft article"
    if page.has_article or main == "soft article":
        return of(main), [], [t for k, t in page.blocks if k != main]
    return [], [t for k, t in page.blocks if k != "furniture"], of("furniture")


def _read(html: str, spared: frozenset[int] = frozenset()) -> _Page:
    page = _Page(spared)
    page.feed(html)
    page.close()
    return page


def token_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def run_hashes(h: np.ndarray, run: int = RUN) -> np.ndarray:
    """Content hashes of all windows of `run` tokens."""
    n = len(h) - run + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(run):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (h[j : j + n] ^ (h[j : j + n] >> np.uint64(31)))
    out ^= out >> np.uint64(32)
    return out.astype(np.int64)


def suffix_classes(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a concatenated stream, in the order of suffixes' first `run` tokens, and for each place in it
    whether it starts a new class of equal prefixes. Suffixes that leave their page within the run are left out.

    Prefix doubling: ranks by 2**k tokens come from two ranks by 2**(k-1).
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < run:
        step = min(length, run - length)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        length += step
    last = np.minimum(np.arange(n) + run - 1, n - 1)
    inside = (np.arange(n) + run <= n) & (page[last] == page)
    array = np.argsort(rank, kind="stable")
    array = array[inside[array]]
    new = np.concatenate([[True], rank[array[1:]] != rank[array[:-1]]]) if len(array) else np.zeros(0, bool)
    return array, new


def run_keys(host: str, h: np.ndarray) -> np.ndarray:
    """Hashes of a host's runs."""
    return run_hashes(h) ^ np.int64(xxhash.xxh3_64_intdigest(host) - 2**63)


def _repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard of a host: each run of its pages outside articles, with the number of pages that hold it.

    Where the host has one shard only, runs of too few pages end here.
    """
    empty = pd.DataFrame({"host": pd.Series(dtype="str"), "run": pd.Series(dtype="int64"), "pages": pd.Series(dtype="int64")})
    streams = [token_hashes(t.split()) for t in pdf["stream"]]
    tokens = np.concatenate([*streams, np.empty(0, np.uint64)])
    page = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    array, new = suffix_classes(tokens, page)
    if not len(array):
        return empty
    cls = np.cumsum(new) - 1
    pages = np.bincount(np.unique(cls * np.int64(len(streams)) + page[array]) // len(streams))
    out = pd.DataFrame({"host": pdf["host"].iloc[0], "run": run_keys(pdf["host"].iloc[0], tokens)[array[new]], "pages": pages})
    return out if pdf["shards"].iloc[0] > 1 else out[out["pages"] >= MIN_PAGES]


def covered(words: list[str], host: str, runs: np.ndarray) -> np.ndarray:
    """Which of the words boilerplate runs (sorted keys) cover."""
    out = np.zeros(len(words), bool)
    if len(runs) and len(words) >= RUN:
        keys = run_keys(host, token_hashes(words))
        for s in np.nonzero(runs[np.minimum(np.searchsorted(runs, keys), len(runs) - 1)] == keys)[0]:
            out[s : s + RUN] = True
    return out


def main_text(html: str | None, host: str, runs: np.ndarray) -> tuple[str, int, int]:
    """The text; tokens outside the article, and how many of them boilerplate covers."""
    main, open_, furniture = parse(html)
    stream = " ".join(open_ + furniture).split()
    cover = covered(stream, host, runs)
    kept, at = main, 0
    for block in open_:
        w = block.split()
        left = [x for x, c in zip(w, cover[at : at + len(w)], strict=True) if not c]
        at += len(w)
        if left:
            kept.append(" ".join(left))
    return "\n".join(kept), len(stream), int(cover.sum())


def boilerplate(rows: DataFrame) -> DataFrame:
    """rows (host, shards, html, deal) -> host, run: the runs that stand outside articles on MIN_PAGES of a host's pages or more."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            streams = []
            for h in b.column("html"):
                _, open_, furniture = parse(h.as_py())
                streams.append(" ".join(open_ + furniture))
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("shards"), b.column("deal"), pa.array(streams, pa.string())], names=["host", "shards", "deal", "stream"])

    streams = rows.mapInArrow(read, "host string, shards int, deal long, stream string")
    dealt = streams.withColumn("shard", F.pmod("deal", F.col("shards")).cast("int")).drop("deal").where("stream <> ''")
    classes = dealt.groupBy("host", "shard").applyInPandas(_repeats, "host string, run long, pages long")
    return classes.groupBy("host", "run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= MIN_PAGES).select("host", "run")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_frame (tokens outside the article), n_covered (of these, in boilerplate runs)."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = rows.withColumn("host", host)
    deal = F.xxhash64("page_id", "html").alias("deal")  # the same in a task that runs again
    with temporary(pages.sparkSession):
        # Hosts of more than PAGES pages: few.
        shards = stage(rows.groupBy("host").agg(F.ceil(F.count("*") / PAGES).cast("int").alias("shards")).where("shards > 1"), "html-hosts")
        runs = stage(boilerplate(_dealt(rows.select("host", "html", deal), shards)), "html-runs", keep=True)
        kinds = dict(rows.dtypes)
        out = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_frame long, n_covered long"
        if runs.count() <= RUNS:
            keys = np.sort(runs.select("run").toPandas()["run"].to_numpy(np.int64))

            def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    found = [main_text(h.as_py(), at.as_py(), keys) for h, at in zip(b.column("html"), b.column("host"), strict=True)]
                    columns = [pa.array([f[0] for f in found], pa.string()), pa.array([len(f[0]) for f in found], pa.int64())]
                    columns += [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2)]
                    yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *columns], names=["page_id", "url", "text", "n_chars", "n_frame", "n_covered"])

            return rows.mapInArrow(assemble, out)

        def one_shard(page: pa.Table, run: pa.Table) -> pa.Table:
            keys = np.sort(run.column("run").to_numpy())
            found = [main_text(h.as_py(), at.as_py(), keys) for h, at in zip(page.column("html"), page.column("host"), strict=True)]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([len(f[0]) for f in found], pa.int64())]
            columns += [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2)]
            return pa.table([page.column("page_id"), page.column("url"), *columns], names=["page_id", "url", "text", "n_chars", "n_frame", "n_covered"])

        shards = stage(shards, "html-hosts", keep=True)
        dealt = _dealt(rows.withColumn("deal", deal), shards).withColumn("shard", F.pmod("deal", F.col("shards")).cast("int")).drop("deal")
        each = _dealt(runs, shards).select("host", "run", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        return dealt.groupBy("host", "shard").cogroup(each.groupBy("host", "shard")).applyInArrow(one_shard, out)


def _dealt(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """rows with the number of their host's shards."""
    return rows.join(small(shards), "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
