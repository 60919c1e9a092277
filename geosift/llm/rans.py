"""Static range asymmetric numeral system over token ids: interleaved lanes, one frequency table a file.

File format, little-endian:
  magic 8 bytes, then for each block its payload, then a footer:
    table   zlib of uint32 pairs (symbol, frequency); frequencies sum to 2**PRECISION
    index   zlib of uint64 rows (offset, bytes, ids, lanes, crc32 of the ids as uint32): the checkpoints
    docs    zlib of int64 rows (id, 1 if the id is null, tokens, text hash) in file order
  then three uint64 lengths of the footer's parts and the magic again.
A block's payload is its lanes' final states (uint64), then uint32 words in the order the decoder takes
them. Blocks share the table but no state, so any of them can be decoded alone.
"""

from __future__ import annotations

import io
import zlib

import numpy as np

MAGIC = b"GSRANS1\n"
PRECISION = 20
LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
LANES, BLOCK = 1024, 1 << 18
_32 = np.uint64(32)
_P = np.uint64(PRECISION)


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**PRECISION; counts are positive, at most 2**PRECISION of them."""
    total = 1 << PRECISION
    freq = np.maximum(1, counts.astype(np.float64) * total / counts.sum()).astype(np.int64)
    while (extra := int(freq.sum()) - total) != 0:
        top = np.argsort(-freq, kind="stable")[: min(abs(extra), len(freq))]
        if extra > 0:
            top = top[freq[top] > 1]
            take = np.minimum(freq[top] - 1, np.maximum(1, extra // max(1, len(top))))
            take = np.where(np.cumsum(take) <= extra, take, np.maximum(0, extra - (np.cumsum(take) - take)))
            freq[top] -= take
        else:
            freq[top[0]] -= extra
    return freq


class Table:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        symbols = np.nonzero(counts)[0]
        return cls(symbols, normalise(counts[symbols]))

    def to_bytes(self) -> bytes:
        return zlib.compress(np.column_stack([self.symbols, self.freq.astype(np.uint32)]).astype("<u4").tobytes(), 6)

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        pairs = np.frombuffer(zlib.decompress(data), "<u4").reshape(-1, 2)
        return cls(pairs[:, 0], pairs[:, 1])

    def encode(self, ids: np.ndarray) -> tuple[bytes, int]:
        """Payload and lanes of one block."""
        lanes = max(1, min(LANES, len(ids) // 64))
        at = np.zeros(int(self.symbols[-1]) + 1, np.int64)
        at[self.symbols] = np.arange(len(self.symbols))
        k = at[ids]
        f, c = self.freq[k], self.start[k]
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        for a in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            fs, cs = f[a : a + lanes], c[a : a + lanes]
            x = state[: len(fs)]
            full = x >= fs << np.uint64(63 - PRECISION)
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> _32, x)
            q = x // fs
            state[: len(fs)] = (q << _P) + (x - q * fs) + cs
        return state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words)), lanes

    def decoder(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))

    def decode(self, payload: bytes, n: int, lanes: int, slots: np.ndarray) -> np.ndarray:
        state = np.frombuffer(payload, "<u8", lanes).astype(np.uint64)
        words = np.frombuffer(payload, "<u4", offset=8 * lanes).astype(np.uint64)
        out, at, mask = np.empty(n, np.uint32), 0, np.uint64((1 << PRECISION) - 1)
        for a in range(0, n, lanes):
            x = state[: min(lanes, n - a)]
            slot = x & mask
            k = slots[slot.astype(np.int64)]
            out[a : a + len(x)] = self.symbols[k]
            x = self.freq[k] * (x >> _P) + slot - self.start[k]
            low = np.nonzero(x < LOW)[0]
            x[low] = x[low] << _32 | words[at : at + len(low)]
            at += len(low)
            state[: len(x)] = x
        return out


def write_file(ids: np.ndarray, docs: np.ndarray) -> bytes:
    """ids uint32; docs int64 rows (id, null, tokens, text hash) -> a file's bytes."""
    out = io.BytesIO()
    out.write(MAGIC)
    index: list[tuple[int, ...]] = []
    table = Table.of(np.bincount(ids)) if len(ids) else Table(np.array([0]), np.array([1 << PRECISION]))
    for a in range(0, len(ids), BLOCK):
        part = ids[a : a + BLOCK]
        payload, lanes = table.encode(part)
        index.append((out.tell(), len(payload), len(part), lanes, zlib.crc32(part.astype("<u4").tobytes())))
        out.write(payload)
    parts = [table.to_bytes(), zlib.compress(np.array(index, "<u8").reshape(-1, 5).tobytes()), zlib.compress(docs.astype("<i8").tobytes())]
    for p in parts:
        out.write(p)
    out.write(np.array([len(p) for p in parts], "<u8").tobytes() + MAGIC)
    return out.getvalue()


class File:
    """A file's table, checkpoints and documents; blocks are decoded on demand and checked."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        sizes = np.frombuffer(data[-32:-8], "<u8").astype(int)
        a = len(data) - 32 - int(sizes.sum())
        cuts = [a, a + sizes[0], a + sizes[0] + sizes[1], len(data) - 32]
        self.data = data
        self.table = Table.from_bytes(data[cuts[0] : cuts[1]])
        self.index = np.frombuffer(zlib.decompress(data[cuts[1] : cuts[2]]), "<u8").reshape(-1, 5).astype(np.int64)
        self.docs = np.frombuffer(zlib.decompress(data[cuts[2] : cuts[3]]), "<i8").reshape(-1, 4)
        self.slots = self.table.decoder()

    def block(self, i: int) -> np.ndarray:
        offset, size, n, lanes, crc = (int(v) for v in self.index[i])
        ids = self.table.decode(self.data[offset : offset + size], n, lanes, self.slots)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i}: checksum differs")
        return ids

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the file; only the blocks that hold them are decoded."""
        ends = np.cumsum(self.index[:, 2]) if len(self.index) else np.zeros(0, np.int64)
        stop = int(ends[-1]) if stop is None and len(ends) else stop or 0
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        base = int(ends[first - 1]) if first else 0
        return np.concatenate([self.block(i) for i in range(first, last + 1)])[start - base : stop - base]
