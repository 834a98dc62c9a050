"""Words and their hashes over whole Arrow batches, without a Python step per word."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that end a word: white space, or whatever is neither a digit, a letter nor beyond ASCII.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NON_WORD = np.ones(256, bool)
NON_WORD[48:58] = NON_WORD[65:91] = NON_WORD[97:123] = NON_WORD[128:] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, _INVERSE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            out.append(np.multiply.accumulate(factors))
        if n > 8 * SLICE_BYTES:  # one very long text: don't keep its tables
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


@dataclass
class Texts:
    """Texts of a slice as one byte buffer; text ``i`` is ``data[bounds[i]:bounds[i + 1]]``."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def lower(self) -> Texts:
        """A-Z in lower case; all other characters stay."""
        return Texts(_LOWER[self.data], self.bounds)


@dataclass
class Words:
    """Word ``k`` is ``data[start[k]:end[k]]``; those of text ``i`` are ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def texts_of(column: pa.Array) -> Texts:
    """Nulls become empty texts."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    size = int(bounds[-1] - bounds[0])
    data = np.frombuffer(data, np.uint8, size, int(bounds[0])) if size else np.zeros(0, np.uint8)
    return Texts(data, bounds - bounds[0])


def words_of(texts: Texts, separators: np.ndarray) -> Words:
    inside = ~separators[texts.data]
    n = len(inside)
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        after[-1] = False
        after[:-1] = inside[1:]
        cuts = texts.bounds[1:-1]
        before[cuts[cuts < n]] = False
        after[cuts[(cuts > 0) & (cuts <= n)] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, texts.bounds))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``sum((byte + 1) * B**i)`` of every prefix, modulo 2**64."""
    up, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``, the same wherever the bytes stand."""
    _, down = _power_tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def word_hashes(texts: Texts, words: Words) -> np.ndarray:
    return span_hashes(prefix_hashes(texts.data), words.start, words.end)


def gram_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and their bounds by text."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], counts)
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total = total * np.uint64(_BASE) + hashes[at + j]
    return mix(total), bounds


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``max_bytes`` of ``column``; a longer text is a run of its own."""
    bounds = texts_of(batch.column(batch.schema.get_field_index(column))).bounds
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def map_slices(
    column: str, work: Callable[[pa.RecordBatch, Texts], Iterable[pa.RecordBatch]], max_bytes: int = SLICE_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that hands ``work`` one slice and its texts at a time."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, max_bytes):
                yield from work(part, texts_of(part.column(part.schema.get_field_index(column))))

    return run


def added(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """``batch`` with more columns at its end."""
    arrays = [*batch.columns, *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values())]
    return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *columns])


def without(df, *names: str):
    """``df`` less the columns that are about to be added, in any spelling."""
    gone = {n.lower() for n in names}
    return df.select(*[f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in gone])


def schema_with(df, more: str) -> StructType:
    """The schema of ``df`` with columns added (as DDL), for ``mapInArrow``; names may hold any character."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def binaries(bounds: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    """A large_binary array from byte bounds and one buffer."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)]
    )
