"""Token counts of a byte-level pair vocabulary by rank-synchronous merging of ragged numpy arrays.

A text is cut at the strings of the special tokens (one token each) and then into pre-tokens, by the pattern of byte-level
vocabularies. The pre-tokens of a batch that were not counted before are held as one ragged array of symbols: the symbols end to end, and the
sequence that owns each. A round looks up the rank of neighbouring pairs, takes the lowest rank of every sequence, and merges that
pair in all sequences at once, everywhere it stands in them (from the left where it overlaps itself). Sequences without a ranked pair leave
with the number of symbols they have. Only pairs beside a merged one are looked up again. Ranks rise within a sequence, as a merged symbol
enters pairs of later ranks only, so the rounds of a batch are at most the merges of its longest sequence.

Counts of short pre-tokens are remembered, up to ``REMEMBERED`` of them. Texts are read in windows that end behind a character that is no white space
and before one that is, where no pre-token goes across; so a very long text needs no more memory than a window, or than its longest
pre-token.

Nulls: a null text is empty and has no token; a null doc_id stays null. Rows that repeat are each counted. No rows: no rows. Other
columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.packing import byte_letters

# Fixed value: how byte-level vocabularies of this kind cut texts.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED, REMEMBERED_CHARS = 500_000, 32
WINDOW = 1 << 20
NO_PAIR = np.iinfo(np.int32).max
COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def unsettled_letters() -> str:
    """A pattern of the characters whose class depends on the Unicode version: letters, digits or spaces for ``regex``, not assigned in the
    version of Python and of the tokenizer library."""
    known = regex.compile(r"[\p{L}\p{N}\s]")
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    codes = [ord(c) for c in known.findall(every) if unicodedata.category(c) == "Cn"]
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]" if codes else "(?!)"


class PairTable:
    """Rank and result of each pair of symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.width = 1 + max(vocabulary.values())
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        order = np.argsort(left * self.width + right, kind="stable")
        self.keys, self.ranks = (left * self.width + right)[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        letters = byte_letters()
        self.of_byte = np.array([vocabulary[letters[b]] for b in range(256)], np.int32)
        self.special = [t["content"] for t in content.get("added_tokens") or [] if t.get("content")]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        if not len(self.keys):
            return np.full(len(key), NO_PAIR, np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR).astype(np.int32)


def surviving(words: list[bytes], table: PairTable) -> np.ndarray:
    """How many symbols are left of each word."""
    length = np.array([len(w) for w in words], np.int64)
    out = length.copy()
    symbol = table.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), length)
    if len(symbol) < 2:
        return out
    # The pair at a place is that of its symbol and the next one of its sequence.
    rank = np.full(len(symbol), NO_PAIR, np.int32)
    rank[:-1] = np.where(owner[:-1] == owner[1:], table.rank(symbol[:-1], symbol[1:]), NO_PAIR)
    while len(symbol):
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(start, len(symbol)))
        lowest = np.minimum.reduceat(rank, start)
        done = lowest == NO_PAIR
        if done.any():
            out[owner[start[done]]] = size[done]
            stay = np.repeat(~done, size)
            symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
            size, lowest = size[~done], lowest[~done]
            if not len(symbol):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, size))
        # Of places in a row, where the pair overlaps itself, every second one from the left.
        first = np.concatenate([[True], np.diff(at) != 1])
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        at = at[nth % 2 == 0]
        symbol[at] = table.merged[rank[at]]
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
        at = at - np.arange(len(at))
        beside = np.zeros(len(symbol), bool)
        beside[at] = True
        beside[at[at > 0] - 1] = True
        rank[beside] = NO_PAIR
        same = np.flatnonzero(beside[:-1] & (owner[:-1] == owner[1:]))
        rank[same] = table.rank(symbol[same], symbol[same + 1])
    return out


class Counter:
    """Tokens of texts; ``unsettled`` is the pattern of ``unsettled_letters``."""

    def __init__(self, path: str, unsettled: str) -> None:
        self.path, self.table, self.known = path, PairTable(path), {}
        self.pattern, self.unsettled = regex.compile(PRE_TOKENS), re.compile(unsettled)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.table.special, key=len, reverse=True)))) if self.table.special else None
        self.library = None

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or not self.unsettled.search(text):
            return self.pattern.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def windows(self, text: str) -> Iterator[str]:
        begin = 0
        while len(text) - begin > WINDOW:
            cut = begin + WINDOW
            while cut < len(text) and not (text[cut].isspace() and not text[cut - 1].isspace()):
                cut += 1
            yield text[begin:cut]
            begin = cut
        yield text[begin:]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Pre-tokens are counted once for all texts of a window's size."""
        out, held, owner, size = [0] * len(texts), [], [], 0
        for i, text in enumerate(texts):
            parts = [text]
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                for window in self.windows(part):
                    held.append(self.pre_tokens(window))
                    owner.append(i)
                    size += len(window)
                    if size >= WINDOW:
                        self._add(out, held, owner)
                        held, owner, size = [], [], 0
        self._add(out, held, owner)
        return out

    def _add(self, out: list[int], held: list[list[str]], owner: list[int]) -> None:
        fresh = list(set().union(*held).difference(self.known))
        if fresh:
            found = surviving([w.encode() for w in fresh], self.table)
            self.known.update(zip(fresh, found.tolist()))
        of = self.known.__getitem__
        for i, words in zip(owner, held):
            out[i] += sum(map(of, words))
        for w in fresh:
            if len(w) > REMEMBERED_CHARS:
                del self.known[w]
        if len(self.known) > REMEMBERED:
            self.known.clear()


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs (doc_id, text)``."""
    unsettled = unsettled_letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, unsettled)
        for batch in batches:
            tokens: list[int] = []
            for at in range(0, batch.num_rows, 256):
                tokens += counter.count([t or "" for t in batch.column(2).slice(at, 256).to_pylist()])
            n = pa.array(tokens, pa.int64())
            over = pa.array([t > limit for t in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size, "text").mapInArrow(run, COUNTED)
