"""Token counts by a linear longest-match automaton.

Words (between ASCII white space) are cut greedily into the longest vocabulary entries, as word pieces are: a word's
first piece is a word-initial entry, the others are continuing entries. In a byte-level vocabulary the entries that
begin with a space are the word-initial ones (without that space), and the others continue a word.
The automaton is a trie of byte strings for either kind. Where the trie has no edge for the next byte, the
failure link leads to the state for what is left after the pieces that longest match would take, and the
link's precomputed count says how many these are. So each byte is read once, and pieces are counted
without being built. Every byte is an entry of both kinds (a byte-level vocabulary), so each word can be cut.

A task remembers the counts of up to CACHE words.

Defined results:
- null, empty and blank texts: 0 words, 0 tokens. null ids are kept; repeated rows have equal results.
- texts and words of any length are read whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosift.llm.common import small_batches
from geosift.llm.token_output import byte_letters, default_tokenizer

CACHE = 100_000


class LongestMatch:
    """Greedy longest-match piece counts over vocabularies of byte strings; single bytes are always entries.

    initial: the entries a word may begin with; None: the same as for what follows.
    """

    def __init__(self, vocabulary: Iterable[bytes], initial: Iterable[bytes] | None = None):
        self.edges: dict[int, int] = {}  # state << 8 | byte -> state; state 0 goes on with a word, state 1 begins one
        self.entry, path = [False, False], [b"", b""]
        self.start = 0 if initial is None else 1
        for root, words in ((0, vocabulary), (1, initial or ())):
            for word in [bytes([b]) for b in range(256)] + [w for w in words if w]:
                at = root
                for i, b in enumerate(word):
                    to = self.edges.get(at << 8 | b)
                    if to is None:
                        to = self.edges[at << 8 | b] = len(self.entry)
                        self.entry.append(False)
                        path.append((at, b, i + 1))
                    at = to
                self.entry[at] = True
        # link[v], popped[v]: the state and the number of pieces once no longer match can start with v's bytes.
        self.link, self.popped = [0] * len(self.entry), [0] * len(self.entry)
        for v in sorted(range(2, len(self.entry)), key=lambda v: path[v][2]):
            parent, b, _ = path[v]
            if self.entry[v]:
                self.popped[v] = 1
                continue
            at, n = self.link[parent], self.popped[parent]
            while (to := self.edges.get(at << 8 | b)) is None:
                n += self.popped[at]
                at = self.link[at]
            self.link[v], self.popped[v] = to, n

    def count(self, word: bytes) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        at, n = self.start, 0
        for b in word:
            while (to := edges.get(at << 8 | b)) is None:
                n += popped[at]
                at = link[at]
            at = to
        while at > 1:
            n += popped[at]
            at = link[at]
        return n


def byte_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """The continuing and the word-initial entries of a byte-level tokenizer file, without special tokens."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_stream(name) as f:
        spec = json.loads(f.read())
    back = {c: b for b, c in byte_letters().items()}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    entries = [bytes(back[c] for c in w) for w in spec["model"]["vocab"] if w not in special and all(c in back for c in w)]
    return [w for w in entries if not w.startswith(b" ")], [w[1:] for w in entries if w.startswith(b" ") and len(w) > 1]


@functools.cache
def automaton_of(path: str) -> LongestMatch:
    """One automaton a worker process."""
    return LongestMatch(*byte_vocabulary(path))


def token_counts(docs: DataFrame, *, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for every row of docs."""
    path = vocabulary_path or default_tokenizer()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(path)
        seen: dict[bytes, int] = {}
        for b in batches:
            words, tokens = [], []
            for t in b.column("text"):
                w = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                n = 0
                for x in w:
                    k = seen.get(x)
                    if k is None:
                        if len(seen) >= CACHE:
                            seen.clear()
                        k = seen[x] = automaton.count(x)
                    n += k
                words.append(len(w))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=["doc_id", "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
