"""Texts of an Arrow batch as numpy arrays: UTF-8 bytes, words and word hashes.

Words are runs of bytes other than 0x20 and 0x09-0x0D, so they never cross texts. The hash of a word is a polynomial over
random 64-bit values of its bytes (A-Z read as a-z), taken from prefix sums and mixed: equal words, equal hashes.
Work goes in runs of about ``RUN`` bytes, so the arrays stay in cache; a longer text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 1 << 18
STEP = 0x9E3779B97F4A7C15


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@dataclass
class Run:
    """Some texts in a row: ``first`` is the index of the first one, ``base`` where its bytes begin."""

    first: int
    count: int
    base: int
    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


class Words:
    def __init__(self) -> None:
        lower = np.arange(256)
        lower[65:91] += 32
        self.value = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)[lower]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self._tables(RUN)

    def _tables(self, n: int) -> None:
        step = np.full(n + 1, STEP, np.uint64)
        step[0] = 1
        self.power = np.cumprod(step)
        step[1:] = pow(STEP, -1, 1 << 64)
        self.inverse = np.cumprod(step)

    def runs(self, data: np.ndarray, at: np.ndarray) -> Iterator[Run]:
        first, n = 0, len(at) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(at, at[first] + RUN, "right")) - 1)
            yield self._run(data[at[first] : at[last]], at[first : last + 1] - at[first], first, int(at[first]))
            first = last

    def _run(self, data: np.ndarray, at: np.ndarray, first: int, base: int) -> Run:
        n = len(data)
        if n + 1 > len(self.power):
            self._tables(n)
        solid = ~self.space[data]
        full = at[:-1] < at[1:]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        begins[at[:-1][full]] = solid[at[:-1][full]]
        ends[at[1:][full] - 1] = solid[at[1:][full] - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        doc = np.searchsorted(at, start, "right") - 1
        return Run(first, len(at) - 1, base, data, doc, start, end, h)


def stretch(text: Column, chars: int) -> Column:
    """At most ``chars`` characters of a text, from a place that its hash chooses; shorter texts are whole."""
    places = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return text.substr((F.pmod(F.xxhash64(F.lit("place"), text), places) + 1).cast("int"), F.lit(chars))
