"""Packing token pieces into sequences by minimum bin slack.

A document is its token ids and one end id. It is cut at multiples of the capacity: whole pieces are sequences, what is
left over is an item. Items are dealt by hash into buckets of about ``bucket_size`` pieces; within a bucket only the
number of items of each length counts. A window takes the longest length left; a subset-sum bitset (bit s: a total of s
can be reached) over the other lengths, longest first and each as often as it is left, then finds the multiset that
leaves the least slack, and backtracking gives its counts. The same multiset is used again as long as its counts last, so
a bucket needs as many searches as there are different fillings, not sequences. Documents shorter than the capacity are
never cut, so slack comes only from the last few windows of a bucket.

Nulls: a null text is empty, and an empty text is its end id alone; a null doc_id stays null. Rows that repeat are packed
as often as they come. No rows: no sequences.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.blocks import utf8
from exposure.llm.scratch import saved

CACHED_WORDS = 1_000_000
CACHED_LENGTH = 48
# Fixed value: how the tokenizer's pattern cuts characters below U+0180 in lower case (letters, digits, the rest but white space).
LATIN_LETTERS = "a-zªµºß-öø-ÿ" + "".join(c for c in map(chr, range(0x100, 0x180)) if c.isalpha())
LATIN_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[0-9²³¹¼½¾]|[^\t\n\x0b\x0c\r \x85\xa0{LATIN_LETTERS}0-9²³¹¼½¾]+")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself where it prints, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit) by white-space separated word.

    The tokenizer drops white space, so a text's ids are those of its words. A word of characters below U+0180, which normalisation only
    turns to lower case, is cut as the tokenizer's pattern cuts it, and its parts go to the model directly; other words, and those where
    a special token may stand, go through all of the tokenizer. Short words and parts are remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.ids(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, word: bytes) -> bytes:
        if len(word) < 256 and b"<" not in word:
            if word.isalpha() and word.islower():
                return self.of_model(word.decode())
            text = word.decode("utf-8", "replace")
            if max(text) < "ƀ" and "İ" not in text:
                parts = LATIN_PARTS.findall(text.lower())
                if len(parts) == 1:
                    return self.of_model("".join(map(self.letters.__getitem__, parts[0].encode())))
                return b"".join([self[p.encode()] for p in parts])
        return array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def of_model(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()


def token_bytes(text: bytes, words: WordIds) -> bytes:
    # Special tokens are matched as they are written, so their case counts.
    return b"".join(map(words.__getitem__, (text if b"<|" in text else text.lower()).split()))


def pieces(docs: DataFrame, path: str, end: int = 2, capacity: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece of ``docs (doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, width = WordIds(path), np.array([end], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            data, at = utf8(batch.column(1))
            data, at, out = data.tobytes(), at.tolist(), []
            for row in range(batch.num_rows):
                ids = token_bytes(data[at[row] : at[row + 1]], words) + last
                for i in range(0, len(ids), width):
                    part = ids[i : i + width]
                    out.append((row, i // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            columns = np.array(out, np.int64).reshape(-1, 5).T
            ids = batch.column(0).take(pa.array(columns[0]))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def filling(counts: Counter, capacity: int) -> dict[int, int]:
    """How many of each length go into a window, the longest one there included."""
    longest = max(counts)
    room = capacity - longest
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = counts[length] - (length == longest), 1
        left = min(left, room // length)
        while left > 0 and not reach >> room & 1:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << length * take) & mask
            left, take = left - take, 2 * take
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter({longest: 1})
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return chosen


def bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the place in it of each length."""
    order = np.argsort(lengths, kind="stable")
    values, starts = np.unique(lengths[order], return_index=True)
    ends = dict(zip(values.tolist(), np.append(starts[1:], len(lengths)).tolist()))
    counts = Counter(dict(zip(values.tolist(), np.diff(np.append(starts, len(lengths))).tolist())))
    window, offset, k = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while counts:
        chosen = filling(counts, capacity)
        times = min(counts[x] // n for x, n in chosen.items())
        at = 0
        for length, n in chosen.items():
            first = ends[length] - counts[length]
            rows = order[first : first + n * times].reshape(times, n)
            window[rows] = k + np.arange(times)[:, None]
            offset[rows] = at + length * np.arange(n)
            at += n * length
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        k += times
    return window, offset


def pack(docs: DataFrame, path: str, end: int = 2, capacity: int = 4096, bucket_size: int = 16384) -> DataFrame:
    """The pieces with sequence_id (bucket and window in it) and offset."""
    table = saved(pieces(docs, path, end, capacity).withColumn("_n", F.monotonically_increasing_id()))
    buckets = max(1, -(-table.count() // bucket_size))
    dealt = table.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_n"), F.lit(buckets)))

    def windows(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("_n", "ascending")])
        window, offset = bin_slack(t.column("length").to_numpy(), capacity)
        sequence = t.column("_bucket").to_numpy() << 32 | window
        return t.drop_columns(["_bucket", "_n"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_bucket").applyInArrow(windows, PIECE + ", sequence_id long, offset long")
