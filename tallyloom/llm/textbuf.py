"""Texts of an Arrow batch as one byte buffer, and vectorised hashing over it.

Everything here works on whole UTF-8 texts. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Chunk:
    """Rows ``first`` to ``first + n`` of a batch; text i is ``data[offs[i]:offs[i + 1]]``."""

    first: int
    data: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.offs, at, "right") - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many bytes are flagged."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]

    def pick(self, rows: np.ndarray) -> Chunk:
        """A chunk of some of the texts, in the order given."""
        parts = [self.data[self.offs[i] : self.offs[i + 1]] for i in rows]
        lens = np.array([len(p) for p in parts], np.int64)
        offs = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(lens, out=offs[1:])
        return Chunk(self.first, np.concatenate(parts) if parts else np.zeros(0, np.uint8), offs)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[Chunk]:
    """The batch's texts in order, at most ``limit`` bytes and ``rows`` texts at a time, or one longer text."""
    data, offs = column(batch, name)
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield Chunk(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n-1), modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    step = np.uint64(base)
    with np.errstate(over="ignore"):
        while done < n:
            take = min(done, n - done)
            out[done : done + take] = out[:take] * step
            done += take
            step = step * step if done < n else step
    return out[:n]


class PrefixHash:
    """Polynomial prefix hashes modulo 2^64 of a byte buffer: any substring's hash in O(1).

    Bytes are first replaced by fixed random 64-bit values. ``seed`` picks the values and the base.
    """

    def __init__(self, data: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(7919 + seed)
        values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = np.uint64(rng.integers(1, 1 << 61, dtype=np.uint64)) * np.uint64(8) + np.uint64(5)
        self.inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = len(data)
        self.h = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values[data] * powers(base, n), out=self.h[1:])
        self.back = powers(self.inverse, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], position-independent and well mixed by length."""
        with np.errstate(over="ignore"):
            return (self.h[end] - self.h[start]) * self.back[start]


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D, which end words."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(c: Chunk, body: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word (a longest run of bytes that are not spaces, or of those flagged in ``body``)."""
    body = ~is_space(c.data) if body is None else body
    edge = np.zeros(len(body) + 1, bool)
    edge[c.offs] = True  # words never cross texts
    before = np.zeros(len(body) + 1, bool)
    before[1:] = body
    after = np.zeros(len(body) + 1, bool)
    after[:-1] = body
    starts = np.flatnonzero(after & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~after))
    return starts, ends, c.doc_of(starts)
