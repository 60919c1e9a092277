"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

A rank file lists byte strings with ranks; encoding merges, in each pre-token, the neighbours whose union has the least
rank, leftmost first. That is what a sentencepiece BPE model does that has the same entries as pieces, each byte mapped to one
printable letter, with the negative rank as score, and no normalisation. The model is serialised here, field by field, from the
vocabulary; nothing is trained. A pattern cuts texts into pre-tokens, each of which is encoded by itself; a pre-token
that is an entry is that entry. Decoding maps ids back to pieces and letters to bytes.

A worker remembers the ids of short pre-tokens, up to a bound in bytes. Texts over CHUNK characters are cut into pre-tokens
piecemeal, so that a text of any length needs little more than itself and its ids.

Defined results:
- null and empty texts: no ids, decoded to no bytes. null ids of documents are kept, repeated rows have equal results.
- special tokens' strings in texts are ordinary text. Texts and pre-tokens of any length are encoded whole (a row of `encode` holds
  its ids as one binary value, which Spark limits to 2 GB).
- decode: null stays null; an id that the vocabulary does not have is an error.
- empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import itertools
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosift.llm.common import small_batches
from geosift.llm.token_output import byte_letters

CHUNK = 1 << 20  # characters whose pre-tokens are encoded together
MEMORY = 32 << 20  # bytes of a generation of remembered pre-tokens
SHORT = 64  # characters of a pre-token that is remembered at most
ENTRY = 200  # bytes of a str, a bytes object and their entry, besides their characters
# Field numbers and constants of the sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 4, 40, 41, 42, 43
BPE = 2
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _message(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file (a line: base64, space, rank) in the order of ranks, which must be 0, 1, 2 and so on."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_stream(name) as f:
        ranks = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, f.read().splitlines())}
    if set(ranks) != set(range(len(ranks))):
        raise ValueError(f"{path}: the ranks are not 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


def serialise_model(entries: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the entries' places; the unknown piece comes after them."""
    if missing := {bytes([b]) for b in range(256)} - set(entries):
        raise ValueError(f"{len(missing)} single bytes are no entries")
    if len(entries) >= 1 << 24:
        raise ValueError("ranks from 2 ** 24 on are no exact scores")
    letters = byte_letters()
    pieces = [_message(PIECES, _message(PIECE, "".join(letters[b] for b in e).encode()) + _float(SCORE, -rank) + _number(TYPE, NORMAL)) for rank, e in enumerate(entries)]
    unknown = _message(PIECES, _message(PIECE, b"<unk>") + _float(SCORE, 0) + _number(TYPE, UNKNOWN))
    trainer = b"".join(_number(k, v) for k, v in ((MODEL_TYPE, BPE), (VOCAB_SIZE, len(entries) + 1), (UNK_ID, len(entries)), (BOS_ID, -1), (EOS_ID, -1), (PAD_ID, -1)))
    normalizer = _message(NAME, b"identity") + b"".join(_number(k, 0) for k in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES))
    return b"".join(pieces) + unknown + _message(TRAINER, trainer) + _message(NORMALIZER, normalizer)


class ByteBpe:
    """Texts -> ids as little-endian uint32 bytes, and back to bytes."""

    def __init__(self, entries: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.entries, self.ranks = entries, {e: i for i, e in enumerate(entries)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(entries))
        self.pattern, self.letters = regex.compile(pattern), byte_letters()
        self.known: dict[str, bytes] = {}  # pre-token -> ids, of two generations
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, tokens: list[str]) -> None:
        """Ids of all the pre-tokens go to `known`."""
        raw = [t.encode() for t in tokens]
        mapped = [r.decode("latin-1").translate(self.letters) for r in raw]
        for t, r, ids in zip(tokens, raw, self.model.encode(mapped, out_type=int, num_threads=1), strict=True):
            rank = self.ranks.get(r)
            if rank is None and len(self.entries) in ids:
                raise ValueError("a pre-token has no pieces")
            self.known[t] = array("I", ids if rank is None else (rank,)).tobytes()
            self.held += ENTRY + len(t) + len(self.known[t])

    def _ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of some texts, given as pre-tokens."""
        fresh = [t for t in set().union(*texts) if t not in self.known]
        for t in fresh:
            if t in self.older:
                self.known[t] = self.older[t]
                self.held += ENTRY + len(t) + len(self.known[t])
        self._learn([t for t in fresh if t not in self.older])
        out = [b"".join(map(self.known.__getitem__, t)) for t in texts]
        for t in [t for t in fresh if len(t) > SHORT]:
            self.held -= ENTRY + len(t) + len(self.known.pop(t))
        if self.held > MEMORY:
            self.older, self.known, self.held = self.known, {}, 0
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        some: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) > CHUNK:
                out += self._ids(some)
                pieces = itertools.batched((m[0] for m in self.pattern.finditer(text)), CHUNK // 4)
                out.append(b"".join(self._ids([p])[0] for p in pieces))
                some, size = [], 0
                continue
            some.append(self.pattern.findall(text))
            size += len(text)
            if size > CHUNK:
                out += self._ids(some)
                some, size = [], 0
        return out + self._ids(some)

    def decode(self, ids: bytes) -> bytes:
        entry, parts = self.entries.__getitem__, []
        for a in range(0, len(ids), 4 * CHUNK):
            parts.append(b"".join(map(entry, np.frombuffer(ids[a : a + 4 * CHUNK], "<u4").tolist())))
        return b"".join(parts)


@functools.cache
def bpe_of(path: str, pattern: str) -> ByteBpe:
    """One model a worker process."""
    return ByteBpe(read_ranks(path), pattern)


def default_ranks() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def default_pattern() -> str:
    import public_tokenizers

    return str(public_tokenizers.PATTERN)


def encode(docs: DataFrame, *, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, one after the other) of every row of docs."""
    path, cut = ranks_path or default_ranks(), pattern or default_pattern()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, cut)
        for b in batches:
            ids = bpe.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(array("q", (len(x) // 4 for x in ids)), pa.int64()), pa.array(ids, pa.binary())],
                                             names=["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids binary")


def decode(encoded: DataFrame, *, ranks_path: str | None = None, pattern: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The rows of `encode` with decoded (the bytes that their ids stand for)."""
    path, cut = ranks_path or default_ranks(), pattern or default_pattern()
    rows = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, cut)
        for b in batches:
            out = [bpe.decode(x.as_py()) if x.is_valid else None for x in b.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "decoded binary"]))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
