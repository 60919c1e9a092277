"""Token ids of whole documents, written as rANS files in the order of ids and read back.

Documents are range-partitioned by id, so the files in name order hold them in ascending order, nulls
first, rows with equal ids by text hash. Each task tokenizes its documents and writes a file whenever
FILE_IDS ids have gathered, so its memory is bounded by that and the longest text. Files are written under a
temporary name and renamed, so a task that runs again after a lost executor replaces its file by an equal
one. A manifest (one row a file) is a Parquet table beside them; a document's global start is its file's
start, the running sum of the manifest's totals, plus its place in the file.

Tokenizing: texts of characters below U+0250 are cut into pre-tokens as the byte-level pre-tokenizer's pattern cuts them, about
CHUNK characters of some texts at a time, by columns; the tokenizers library's model encodes each different pre-token, and a
worker remembers the ids of short ones, up to MEMORY bytes in two generations (the older one goes when the newer is full).
Other texts are cut where that pre-tokenizer always splits, before a space that has a character other than white space on
either side, and the library encodes the pieces. A tokenizer file with another
pre-tokenizer, a normalizer or a post-processor is never cut: there the library encodes whole texts.

Defined results:
- null and empty texts: the end id alone. null ids come first; repeated rows are kept, each with its own start.
- special tokens' strings in texts are ordinary text. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import AnyStr

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geosift.llm import rans
from geosift.llm.common import BATCH_ROWS, new_path, qualified, small_batches, stage

FILE_IDS = 4_000_000
CHUNK = 1 << 20  # characters that are cut into pre-tokens at once
MEMORY = 48 << 20  # bytes of a generation of remembered pieces, all kinds together
SHORT = 48  # characters of a piece, or bytes of a pre-token, that is remembered at most
_SPACE = re.compile(r"(?<!\s) | (?=\S)")  # spaces that always begin a pre-token
_RUN = re.compile(r"\s (?:\s|\Z)")
_PLACE = re.compile(r"(?<=\S) (?=\S)")
_HIGH = re.compile("[^\\x00-\u024f]")
END = "\u0250"  # stands between texts of characters below it
END_BYTES = END.encode()
LETTER, NUMBER, MARK, WHITE, BETWEEN = range(5)


def _kinds() -> np.ndarray:
    """The kind of each character up to END; no version of Unicode differs here."""
    out = np.full(ord(END) + 1, MARK, np.uint8)
    for kind, ranges in ((LETTER, "AZazªªµµººÀÖØöøɏ"), (NUMBER, "09²³¹¹¼¾"), (WHITE, "\t\r  \x85\x85\xa0\xa0"), (BETWEEN, END * 2)):
        for first, last in itertools.batched(map(ord, ranges), 2):
            out[first : last + 1] = kind
    return out


KINDS = _kinds()


class _Budget:
    """The bytes that several memories hold together."""

    def __init__(self, most: int):
        self.most, self.held, self.memories = most, 0, []

    def add(self, size: int) -> None:
        self.held += size
        if self.held > self.most:
            self.held = 0
            for m in self.memories:
                m.old = dict(m)
                m.clear()


class _Memory(dict):
    """A dict that makes missing values; what both generations have lost is made again."""

    def __init__(self, make: Callable[[AnyStr], bytes], budget: _Budget):
        super().__init__()
        self.make, self.budget, self.old = make, budget, {}
        budget.memories.append(self)

    def __missing__(self, key: AnyStr) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= SHORT:
            self.budget.add(200 + len(key) + len(out))  # two objects and their entry
            self[key] = out
        return out


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def is_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file (as JSON) splits as PieceEncoder does: byte-level with its own pattern, and nothing around it."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = not spec.get("normalizer") and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "unk_token"))
    special = all(t.get("special") for t in spec.get("added_tokens") or [])  # others would be matched in texts
    return bool(plain and level and bpe and special)


class PieceEncoder:
    """text -> ids as little-endian uint32 bytes; equal to encode(text, add_special_tokens=False)."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        self.model, letters = self.tokenizer.model, byte_letters()
        self.letters = {i: letters[i] for i in range(256)}
        budget = _Budget(MEMORY)
        self.tokens = _Memory(self._token, budget)
        self.pieces = _Memory(self._piece, budget)  # with the space before it
        self.splits = is_byte_level(json.loads(self.tokenizer.to_str()))

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _token(self, token: bytes) -> bytes:
        """A pre-token goes straight to the library's model."""
        if token == END_BYTES:
            return b""
        text = token.decode("latin-1")
        mapped = text.replace(" ", self.letters[32]) if text.isascii() and text.isprintable() else text.translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _low(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of characters below U+0250."""
        words, at = pre_tokens(texts)
        found = list(map(self.tokens.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins, known = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), "<u4")
        n = sizes[at]
        ends = np.cumsum(n)
        ids = known[np.repeat(begins[at] - ends + n, n) + np.arange(ends[-1])].tobytes()
        cuts = [0, *(4 * ends[at == words.index(END_BYTES)]).tolist()]
        return [ids[a:b] for a, b in itertools.pairwise(cuts)]

    def _piece(self, piece: str) -> bytes:
        return self._encode(" " + piece)

    def _one(self, text: str) -> bytes:
        """The ids of a text of any characters."""
        if not self.splits:
            return self._encode(text)
        # Without a run of white space every space is a place to cut.
        first, *rest = _SPACE.split(text) if _RUN.search(text) else text.split(" ")
        return (self._encode(first) if first else b"") + b"".join(map(self.pieces.__getitem__, rest))

    def many(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text."""
        some: list[str] = []
        size = 0
        for text in texts:
            low = self.splits and (not text or text.isascii() or not _HIGH.search(text))
            if low and len(text or "") <= CHUNK:
                some.append(text or "")
                size += len(some[-1])
            if some and (not low or len(text or "") > CHUNK or size > CHUNK):
                yield from self._low(some)
                some, size = [], 0
            if not low:
                yield self._one(text) if text else b""
            elif len(text or "") > CHUNK:
                yield b"".join(self._low([part])[0] for part in parts(text))
        if some:
            yield from self._low(some)

    def __call__(self, text: str | None) -> bytes:
        return next(self.many([text]))


def parts(text: str) -> Iterator[str]:
    """A long text in parts that begin with pre-tokens, each of about CHUNK characters, or more where no such place is near."""
    a = 0
    while a < len(text):
        place = _PLACE.search(text, a + CHUNK)
        b = place.start() if place else len(text)
        yield text[a:b]
        a = b


def pre_tokens(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The different pre-tokens of texts of characters below U+0250, and each one's place among them in order; END follows each text."""
    text = "".join(t + END for t in texts)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kind = KINDS[code]
    before, own = kind[:-1], kind[1:]
    starts = np.ones(len(code), bool)
    # A space belongs to what follows it, so the last of some white space parts from the rest.
    starts[1:] = (own != before) & ((code[:-1] != 32) | (own >= WHITE)) | (own == BETWEEN)
    starts[1:-1] |= (kind[:-2] == WHITE) & (kind[1:-1] == WHITE) & (kind[2:] < WHITE)
    # 's 't 'm 'd 're 've 'll, where the apostrophe begins a pre-token.
    quote = np.flatnonzero((code == 39) & starts)
    one, two = code[quote + 1], code[np.minimum(quote + 2, len(code) - 1)]
    short = np.isin(one, list(map(ord, "stmd")))
    long = (two == ord("e")) & np.isin(one, list(map(ord, "rv"))) | (one == ord("l")) & (two == ord("l"))
    starts[quote[short | long] + 1] = False
    starts[quote[short] + 2] = True
    starts[quote[long] + 3] = True
    at, wide = np.flatnonzero(starts), code >= 128
    data = text.encode()
    offsets = np.append(at + np.cumsum(wide, dtype=np.int32)[at] - wide[at], len(data)).astype("<i4")
    coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


@functools.cache
def encoder_of(tokenizer_path: str) -> PieceEncoder:
    """One encoder a worker process: its memory of pieces, which is bounded, outlives a task."""
    return PieceEncoder(tokenizer_path)


MANIFEST = "path string, part int, piece int, n_docs long, n_ids long, n_bytes long"


def write_tokens(docs: DataFrame, path: str, *, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Write docs' ids to files below path; the manifest, with each file's global start."""
    small_batches(docs.sparkSession)
    path = qualified(docs.sparkSession, path)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    slim = slim.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        encoder = encoder_of(tokenizer_path)
        held, rows, size, piece, done = [], [], 0, 0, []

        def flush() -> None:
            nonlocal held, rows, size, piece
            ids = np.frombuffer(b"".join(held), "<u4")
            data = rans.write_file(ids, np.array(rows, "<i8").reshape(-1, 4))
            name = f"{root}/ids-{part:06d}-{piece:04d}"
            with fs.open_output_stream(f"{name}.{attempt}.tmp", compression=None) as out:
                out.write(data)
            fs.move(f"{name}.{attempt}.tmp", f"{name}.rans")
            done.append((f"{path}/{os.path.basename(name)}.rans", part, piece, len(rows), len(ids), len(data)))
            held, rows, size, piece = [], [], 0, piece + 1

        for batch in batches:
            encoded = encoder.many(batch.column("text").to_pylist())
            for d, ids, h in zip(batch.column("doc_id"), encoded, batch.column("h"), strict=True):
                ids += end
                held.append(ids)
                size += len(ids) // 4
                rows.append((d.as_py() or 0, int(not d.is_valid), len(ids) // 4, h.as_py()))
                if size >= FILE_IDS:
                    flush()
        if rows:
            flush()
        if done:
            names = ["path", "part", "piece", "n_docs", "n_ids", "n_bytes"]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    manifest = stage(slim.mapInArrow(write, MANIFEST), "tok-manifest")
    before = Window.partitionBy().orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, text_hash (and ids, on request) of every document, from the files alone."""
    files = manifest.select("path", "start")
    spread = files.repartition(max(1, min(files.count(), 10_000)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as f:
                    file = rans.File(f.read())
                ids = file.ids().astype("<u4")
                n = file.docs[:, 2]
                ends = np.cumsum(n)
                cut = [memoryview(ids[e - k : e]) for e, k in zip(ends, n, strict=True)]
                columns = [pa.array(file.docs[:, 0], pa.int64(), mask=file.docs[:, 1] == 1), pa.array(start + ends - n, pa.int64()),
                           pa.array(n, pa.int64()), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(file.docs[:, 3], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "text_hash"]
                if with_ids:
                    columns.append(pa.array([c.tolist() for c in cut], pa.list_(pa.int64())))
                    names.append("ids")
                whole = pa.RecordBatch.from_arrays(columns, names=names)
                del file, ids, cut, columns
                yield from (whole.slice(a, BATCH_ROWS) for a in range(0, whole.num_rows, BATCH_ROWS))

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, text_hash long" + (", ids array<long>" if with_ids else ""))


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def token_rows(docs: DataFrame, *, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token files in the shared folder and return their rows as read back."""
    path = new_path(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, path, tokenizer_path=tokenizer_path or default_tokenizer(), end_id=end_id, id_col=id_col, text_col=text_col)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
