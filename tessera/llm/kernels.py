"""Numpy kernels over blocks of texts, used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_BASE = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
#: Bytes of text handled at once; a longer text makes a block of its own.
BLOCK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each input bit over all output bits."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        m = max(n, BLOCK + 4096)
        base = _BASE[which]
        inverse = pow(base, -1, 1 << 64)

        def run(b: int) -> np.ndarray:
            out = np.full(m, b, U)
            out[0] = 1
            return np.multiply.accumulate(out)

        have = run(base), run(inverse)
        if m <= 4 * BLOCK:
            _powers[which] = have
    return have


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last byte."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data), "<u8", padded.data, strides=(1,)).copy()


_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)  #: masks of a gram's first bytes
CHAINED = 256  #: bytes of a range up to which it is hashed by grams side by side with others


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range: its grams one after the other, each mixed in before the next; long ranges by xxh3."""
    size = end - start
    eight = grams(data)
    out = mix(size.astype(U) + U(1))
    live = np.flatnonzero((size > 0) & (size <= CHAINED))
    at = 0
    while len(live):
        some = eight[start[live] + at] & _FIRST[np.minimum(size[live] - at, 8)]
        out[live] = mix(out[live] * U(_BASE[0]) ^ some)
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > CHAINED).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct value, by value, and of each place the number of its value; in little memory."""
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    new = np.ones(len(order), bool)
    held = hashes[order]
    np.not_equal(held[1:], held[:-1], out=new[1:])
    del held
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], number


class Rolling:
    """Hashes of any ranges of one block, by differences of prefix sums modulo 2**64.

    Only for ranges of up to some tens of characters: regular strings of 512 and more can have one value.
    """

    def __init__(self, data: np.ndarray, which: int = 0):
        power, self.inverse = _power(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def every(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


class RollingGrams:
    """Hashes of byte ranges of any length: prefix sums as in Rolling, but over mixed grams instead of bytes.

    A sum over bytes vanishes modulo 2**64 for pairs of regular strings (Thue-Morse and its complement); grams straddle
    their halves, so those don't cancel. Ranges below eight bytes are their own bytes, mixed with their length.
    """

    def __init__(self, data: np.ndarray, which: int = 0):
        power, self.inverse = _power(which, len(data) + 1)
        self.data = data
        self.sums = np.zeros(len(data) + 1, U)
        terms = grams(data)
        terms += U(_BASE[1 - which])
        terms = mix(terms)
        terms *= power[: len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = (self.sums[np.maximum(end - 7, start)] - self.sums[start]) * self.inverse[start]
        few = np.flatnonzero(size < 8)
        if len(few):
            eight = grams(self.data)
            out[few] = mix((eight[np.minimum(start[few], len(eight) - 1)] & _FIRST[size[few]]) + U(_BASE[0]))
        return mix(out + size.astype(U))

    def every(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        if width < 8:
            return mix((grams(self.data)[:n] & _FIRST[width]) + U(width))
        out = self.sums[width - 7 : width - 7 + n] - self.sums[:n]
        out *= self.inverse[:n]
        out += U(width)
        return mix(out)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocks(texts: list, size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as bytes) for runs of about ``size`` bytes; None counts as empty."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if held and total + len(raw) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(raw)
        total += len(raw) + 1
    if held:
        yield first, held


class Words:
    """Words (runs of bytes outside ASCII white space) of a block: byte bounds, document of each, counts."""

    def __init__(self, raws: list[bytes], lower: bool = True):
        self.data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        self.seen = LOWER[self.data] if lower else self.data
        sizes = np.fromiter((len(r) for r in raws), np.int64, len(raws))
        self.doc_end = np.cumsum(sizes + 1)
        self.doc_start = self.doc_end - sizes - 1
        black = ~SPACE[self.data]
        edge = np.diff(black.astype(np.int8), prepend=0)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        upto = np.searchsorted(self.start, self.doc_end)
        self.first = np.concatenate(([0], upto[:-1])) if len(raws) else upto
        self.count = np.diff(upto, prepend=0)
        self.hash = range_hashes(self.seen, self.start, self.end)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def list_column(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
