"""Scoring texts by a hierarchical Pitman-Yor language model, counted over the whole corpus.

Tokens (words, and an end after each text) are drawn in the restaurant of the word before (the end stands before the first). Its new tables take
their dish from one restaurant of words without context, whose new tables take theirs from a spelling
model: bytes in the context of the two before, whose restaurant shares the parent of one byte with all contexts that end alike, that one the
parent without context, and that one a uniform choice. Customers of a restaurant are the tables of its children, at every level. Tables of up
to ``EXACT`` customers of a word in a context are drawn from their conditional distribution; otherwise seats are
sampled by Gibbs: a customer leaves its table and sits down anew, table sizes being kept by dish as counts of tables of
1 to ``SIZES - 1`` customers, larger tables together. Dishes of many customers are first seated in growing parties. The
predictive probability is averaged over the samples, each restaurant for itself. Levels are sampled once from the contexts down: while contexts are seated, the
restaurant of words is taken to serve words as often as they are counted; words are seated once under a spelling of the different words,
and again under the spelling of the tables so drawn. Contexts are dealt by hash to tasks, each with a discount of its own; one of many tokens is dealt in
parts by the word behind it, each of which takes its tables times the parts for those of the whole while it samples.

``score`` is over the known tokens and one event for any other word, which is what a new table serves if its spelling is of no
known token; these probabilities add up to 1 in each context. ``open_score`` spells such words out, over all strings.

What grows with the corpus is never gathered: words are dealt by hash into buckets; texts are worked on in blocks, and a
block asks each bucket for its own different words, and each bucket of contexts for its different pairs of words, and gets their counts, tables and
probabilities back. The driver holds the spelling counts (at most 257**3, whatever the corpus), the tables of at most ``SHARE`` frequent contexts and a few sums.

Nulls: a null text is empty and scores its end alone; a null doc_id counts as the text "" in the training rule. Rows that
repeat count as often as they come. Without training rows every score is that of the uniform spelling, the base log10(1/1).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.blocks import Words, mix, utf8
from exposure.llm.scratch import saved

BLOCK = 12 << 20
END = 256
SYMBOLS = 257
SIZES = 16
PARTY = 24
SWEEPS, BURN, MOVES = 6, 3, 2
SAMPLES = SWEEPS - BURN
EXACT = 48
LEAST, SHARE = 20_000, 2_000
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, open_score double"


def squeeze(**arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def expand(packed: bytes) -> dict:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))


def thin(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 as planes of bytes, as few as they need."""
    x = np.ascontiguousarray(x, dtype=np.min_scalar_type(int(x.max(initial=0))))
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)


def thick(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.T).view(f"u{len(x)}").ravel().astype(np.int64)


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The pieces of ``data``, each with a blank behind it, A-Z in lower case."""
    size = end - start + 1
    at = np.cumsum(size) - size
    out = data.take(np.repeat(start - at, size) + np.arange(size.sum()), mode="clip")
    out = np.where((out >= 65) & (out <= 90), out + 32, out).astype(np.uint8)
    out[at + size - 1] = 32
    return out


class Seats:
    """Table sizes by dish: ``small[:, k]`` tables of k customers, and all larger ones by number and customers."""

    def __init__(self, customers: np.ndarray, rng: np.random.Generator) -> None:
        self.customers, self.rng = customers, rng
        self.small = np.zeros((len(customers), SIZES), np.int64)
        self.large = np.zeros(len(customers), np.int64)
        self.seated = np.zeros(len(customers), np.int64)

    @property
    def tables(self) -> np.ndarray:
        return self.small.sum(axis=1) + self.large

    def _pick(self, weights: np.ndarray) -> np.ndarray:
        edge = np.cumsum(weights, axis=1)
        return np.minimum((edge <= (self.rng.random(len(edge)) * edge[:, -1])[:, None]).sum(axis=1), weights.shape[1] - 1)

    def sit(self, rows: np.ndarray, new: np.ndarray, discount: float) -> None:
        """One customer more for each of the rows; new: the weight of a new table."""
        small = self.small[rows]
        weights = np.empty((len(rows), SIZES + 1))
        weights[:, 0] = np.where(small.sum(axis=1) + self.large[rows] > 0, new, 1.0)
        weights[:, 1:SIZES] = small[:, 1:] * (np.arange(1, SIZES) - discount)
        weights[:, SIZES] = self.seated[rows] - discount * self.large[rows]
        k = self._pick(weights)
        old, grown = (k > 0) & (k < SIZES), k + 1
        self.small[rows[old], k[old]] -= 1
        inside = grown < SIZES
        self.small[rows[inside], grown[inside]] += 1
        over = k == SIZES - 1
        self.large[rows[over]] += 1
        self.seated[rows[over]] += SIZES
        self.seated[rows[k == SIZES]] += 1

    def leave(self, rows: np.ndarray) -> None:
        """One customer less for each of the rows."""
        weights = np.empty((len(rows), SIZES))
        weights[:, : SIZES - 1] = self.small[rows, 1:] * np.arange(1, SIZES)
        weights[:, SIZES - 1] = self.seated[rows]
        k = self._pick(weights) + 1
        small = k < SIZES
        self.small[rows[small], k[small]] -= 1
        down = small & (k > 1)
        self.small[rows[down], k[down] - 1] += 1
        self.seated[rows[~small]] -= 1
        # A large table that may no longer be one, as the mean of the large tables shows.
        shrunk = rows[~small][self.seated[rows[~small]] < SIZES * self.large[rows[~small]]]
        self.large[shrunk] -= 1
        self.seated[shrunk] -= SIZES - 1
        self.small[shrunk, SIZES - 1] += 1

    def fill(self, new: np.ndarray, discount: float) -> None:
        """Seat all customers: the first ones each, the rest in parties of a quarter of those who sit."""
        for k in range(min(int(self.customers.max(initial=0)), PARTY)):
            rows = np.flatnonzero(self.customers > k)
            self.sit(rows, new[rows], discount)
        rows = np.flatnonzero(self.customers > PARTY)
        done = np.full(len(rows), PARTY)
        while len(rows):
            party = np.minimum(self.customers[rows] - done, np.maximum(done // 4, 1))
            chance = new[rows] / (new[rows] + np.maximum(done - discount * self.tables[rows], 1e-9))
            opened = self.rng.binomial(party, chance)
            self.small[rows, 1] += opened
            joined = party - opened
            # The others go to large tables; the first such party merges the largest small ones there.
            lone = (self.large[rows] == 0) & (joined > 0)
            for r in rows[lone].tolist():
                k = int(np.flatnonzero(self.small[r]).max())
                self.small[r, k] -= 1
                self.large[r], self.seated[r] = 1, k
            self.seated[rows] += joined
            done = done + party
            left = done < self.customers[rows]
            rows, done = rows[left], done[left]

    def sweep(self, new: np.ndarray, discount: float) -> None:
        for _ in range(MOVES):
            rows = np.flatnonzero(self.customers > 1)
            self.leave(rows)
            self.sit(rows, new[rows], discount)


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.05, 0.95))


class Spelling:
    """Samples of the byte restaurants. Keys are (two bytes before, byte) in base 257; 256 stands for a border of the word."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, strength: float = 1.0, seed: int = 23) -> None:
        order = np.argsort(keys)
        self.keys, counts = keys[order], counts[order]
        self.samples: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rng = np.random.default_rng(seed)
        context, pair = self.keys // SYMBOLS, self.keys % SYMBOLS**2
        pairs, to_pair = np.unique(pair, return_inverse=True)
        single = pairs % SYMBOLS
        singles, to_single = np.unique(single, return_inverse=True)
        uniform = 1 / SYMBOLS
        low = np.full(SYMBOLS, uniform)
        middle = np.full(SYMBOLS**2, uniform)
        cut = [discount_of((counts == 1).sum(), (counts == 2).sum())] * 3
        top = Seats(counts, rng)
        tables = np.ones(SYMBOLS**2)
        top.fill((strength + cut[0] * tables[context]) * middle[pair], cut[0])
        for sweep in range(SWEEPS):
            tables = np.bincount(context, top.tables, SYMBOLS**2)
            top.sweep((strength + cut[0] * tables[context]) * middle[pair], cut[0])
            mid = Seats(np.bincount(to_pair, top.tables, len(pairs)).astype(np.int64), rng)
            before = np.bincount(pairs // SYMBOLS, minlength=SYMBOLS)[pairs // SYMBOLS]
            mid.fill((strength + cut[1] * before) * low[single], cut[1])
            mid.sweep((strength + cut[1] * before) * low[single], cut[1])
            root = Seats(np.bincount(to_single, mid.tables, len(singles)).astype(np.int64), rng)
            root.fill((strength + cut[2] * len(singles)) * np.full(len(singles), uniform), cut[2])
            low = self._predict(singles, np.zeros_like(singles), root, cut[2], strength, np.full(SYMBOLS, uniform), SYMBOLS, 1)[0]
            middle = self._predict(pairs, pairs // SYMBOLS, mid, cut[1], strength, np.tile(low, SYMBOLS), SYMBOLS**2, SYMBOLS)[0]
            if sweep >= BURN:
                here = np.bincount(context, top.customers, SYMBOLS**2)
                seats = np.bincount(context, top.tables, SYMBOLS**2)
                own = (top.customers - cut[0] * top.tables) / (strength + here[context])
                self.samples.append((own, (strength + cut[0] * seats) / (strength + here), middle))

    @staticmethod
    def _predict(keys, context, seats: Seats, cut: float, strength: float, parent: np.ndarray, size: int, contexts: int):
        here = np.bincount(context, seats.customers, contexts)
        tables = np.bincount(context, seats.tables, contexts)
        own = np.zeros(size)
        own[keys] = (seats.customers - cut * seats.tables) / (strength + here[context])
        spread = (strength + cut * tables) / (strength + here)
        return own + np.repeat(spread, size // contexts) * parent, spread

    def of(self, keys: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
        """Probability of each word (columns) in each sample (rows), from the keys of its bytes."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = []
        for own, spread, middle in self.samples:
            p = np.where(known, own[at] if len(own) else 0.0, 0.0) + spread[keys // SYMBOLS] * middle[keys % SYMBOLS**2]
            out.append(np.exp(np.bincount(word, np.log(p), words)))
        return np.array(out)


def byte_keys(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bytes of words (each with a blank behind it, which stands for its end), and the word of each."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbol = np.where(text == 32, END, text.astype(np.int64))  # widened first: END does not fit a byte
    one = np.append(END, symbol[:-1])
    two = np.append([END, END], symbol[:-2])[: len(symbol)]
    # Before the first byte of a word there is nothing but border.
    two[one == END] = END
    word = np.cumsum(text == 32) - (text == 32)
    return (two * SYMBOLS + one) * SYMBOLS + symbol, word


EMPTY_WORD = (END * SYMBOLS + END) * SYMBOLS + END


def requests(docs: DataFrame, buckets: int) -> DataFrame:
    """For each block of texts a row of its tokens (bucket -1), and a row for each bucket with its different words and their training counts."""

    def block(words: Words, ids: pa.Array, held: np.ndarray, data: np.ndarray, at: np.ndarray, name: int) -> pa.RecordBatch:
        h, doc, start, end = [], [], [], []
        for run in words.runs(data, at):
            h.append(run.hash)
            doc.append(run.doc + run.first)
            start.append(run.start + run.base)
            end.append(run.end + run.base)
        h, doc, start, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, doc, start, end))
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        count = np.bincount(inverse, ~held[doc], len(unique)).astype(np.int64)
        bucket = (unique % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        # Tokens are kept as ranks by frequency in the block, which pack better.
        local = np.bincount(inverse, minlength=len(unique))[order]
        rank = np.empty(len(order), np.int64)
        rank[np.argsort(-local, kind="stable")] = np.arange(len(order))
        ids = ids.to_numpy(zero_copy_only=False) if not ids.null_count else ids.to_pylist()
        size = np.bincount(doc, minlength=len(held)).astype(np.int64)
        rows = [(-1, squeeze(ids=ids, held=held, size=size, token=thin(rank[place[inverse]]), local=thin(local), bounds=bounds))]
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            mine = order[bounds[b] : bounds[b + 1]]
            rows.append((b, squeeze(count=count[mine], text=gathered(data, start[first[mine]], end[first[mine]]))))
        arrays = [pa.array([name] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["block", "bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, name = Words(), TaskContext.get().partitionId() << 32
        for batch in batches:
            data, at = utf8(batch.column(1))
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, "right")) - 1)
                yield block(words, batch.column(0).slice(lo, hi - lo), held[lo:hi], data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], name)
                lo, name = hi, name + 1

    return docs.mapInArrow(run, "block long, bucket long, packed binary")


def tokens_in(mine: dict) -> np.ndarray:
    """The tokens of a block as places among its words."""
    return np.argsort(-thick(mine["local"]), kind="stable")[thick(mine["token"])]


class Pairs:
    """The different pairs (context, token) of a block; the end is the word behind the last, and number 0.

    ``u`` and ``w`` are places in the block, ``at`` the pair of each token and end, ``n`` how often training texts hold each. ``asked`` are those of which both are
    known, by the bucket of their context (``bounds``), its number and the token's."""

    def __init__(self, mine: dict, count: np.ndarray, number: np.ndarray, ends: int, buckets: int, limit: int) -> None:
        self.count, self.number = np.append(count, ends), np.append(number, 0)
        token, size, last = tokens_in(mine), mine["size"], len(count)
        following = np.full(len(token) + len(size), last)
        following[np.arange(len(token)) + np.repeat(np.arange(len(size)), size)] = token
        before = np.append(last, following[:-1])
        key, self.at = np.unique(before * (last + 1) + following, return_inverse=True)
        self.n = np.bincount(self.at, ~np.repeat(mine["held"], size + 1), len(key)).astype(np.int64)
        self.u, self.w = key // (last + 1), key % (last + 1)
        asked = np.flatnonzero((self.count[self.u] > 0) & (self.count[self.w] > 0))
        u, w = self.number[self.u[asked]].astype(np.uint64), self.number[self.w[asked]].astype(np.uint64)
        part = mix(w + np.uint64(1)) % parts_of(self.count[self.u[asked]], buckets, limit).astype(np.uint64)
        bucket = (mix(mix(u + np.uint64(1)) + part) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((w, u, bucket))
        self.asked, self.bounds = asked[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def parts_of(count: np.ndarray, buckets: int, limit: int) -> np.ndarray:
    """Into how many parts the context of a word of this count is dealt."""
    return np.minimum(1 + count // limit, buckets)


def merged_words(parts: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, counts and text of the different words that training texts hold."""
    words = Words()
    text, count = np.concatenate([p["text"] for p in parts]), np.concatenate([p["count"] for p in parts])
    h, start, end = tokens_of(words, text)
    unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    total = np.bincount(inverse, count, len(unique)).astype(np.int64)
    held = total > 0
    first = first[held]
    return unique[held], total[held], gathered(text, start[first], end[first])


def tokens_of(words: Words, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a buffer of words with blanks between."""
    cuts = np.flatnonzero(text == 32) + 1
    keep = np.append(np.flatnonzero(np.diff(cuts // (1 << 17))), len(cuts) - 1) if len(cuts) else []
    at = np.append(0, cuts[keep]).astype(np.int64)
    runs = list(words.runs(text, at))
    joined = [(r.hash, r.start + r.base, r.end + r.base) for r in runs]
    return tuple(np.concatenate(x) for x in zip(*joined)) if joined else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def vocabulary(asked: DataFrame) -> DataFrame:
    """A row for each bucket: its words with training counts, and sums over them."""

    def run(t: pa.Table) -> pa.Table:
        h, count, text = merged_words([expand(p) for p in t.column("packed").to_pylist()])
        sums = [len(h), int((count == 1).sum()), int((count == 2).sum()), int(count.sum())]
        return pa.table([t.column("bucket").slice(0, 1), pa.array([squeeze(hash=h, count=count, text=text)], pa.binary()), *([s] for s in sums)], ["bucket", "packed", "types", "ones", "twos", "tokens"])

    schema = "bucket long, packed binary, types long, ones long, twos long, tokens long"
    return asked.where("bucket >= 0").groupBy("bucket").applyInArrow(run, schema)


def numbers(count: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """The numbers of the words of a bucket, from 1, small for frequent ones."""
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    return rank * buckets + bucket + 1


def looked_up(held: dict, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the hashes are among those of a bucket, and which are there."""
    at = np.minimum(np.searchsorted(held["hash"], h), max(len(held["hash"]) - 1, 0))
    return at, held["hash"][at] == h if len(held["hash"]) else np.zeros(len(h), bool)


NO_WORDS = {"hash": np.zeros(0, np.uint64), "count": np.zeros(0, np.int64)}


def numbered(asked: DataFrame, vocab: DataFrame, buckets: int) -> DataFrame:
    """For each request the numbers (0: unknown) and counts of its words, in its order."""

    def run(wanted: pa.Table, bucket: pa.Table) -> pa.Table:
        words, out = Words(), []
        held = expand(bucket.column("packed")[0].as_py()) if bucket.num_rows else NO_WORDS
        number = numbers(held["count"], bucket.column("bucket")[0].as_py() if bucket.num_rows else 0, buckets)
        for packed in wanted.column("packed").to_pylist():
            h, _, _ = tokens_of(words, expand(packed)["text"])
            at, seen = looked_up(held, h)
            found, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            found[seen], count[seen] = number[at[seen]], held["count"][at[seen]]
            out.append(squeeze(number=thin(found), count=thin(count)))
        return pa.table({"block": wanted.column("block"), "bucket": wanted.column("bucket"), "packed": pa.array(out, pa.binary())})

    left = asked.where("bucket >= 0").groupBy("bucket")
    return left.cogroup(vocab.select("bucket", "packed").groupBy("bucket")).applyInArrow(run, "block long, bucket long, packed binary")


def from_buckets(mine: dict, buckets: list[int], replies: list[bytes], names: tuple[str, ...]) -> list[np.ndarray]:
    """Columns over the words of a block, from the replies of the buckets."""
    out = [np.zeros(int(mine["bounds"][-1])) if n in ("score", "more") else np.zeros(int(mine["bounds"][-1]), np.int64) for n in names]
    for b, packed in zip(buckets, replies):
        part, reply = slice(mine["bounds"][b], mine["bounds"][b + 1]), expand(packed)
        for column, name in zip(out, names):
            column[part] = thick(reply[name]) if reply[name].ndim == 2 else reply[name]
    return out


def pair_requests(asked: DataFrame, named: DataFrame, ends: int, buckets: int, limit: int) -> DataFrame:
    """For each block and bucket of contexts the pairs that the block holds, with their training counts in the block."""

    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        mine = expand(own.column("packed")[0].as_py())
        number, count = from_buckets(mine, got.column("bucket").to_pylist(), got.column("packed").to_pylist(), ("number", "count"))
        pairs = Pairs(mine, count, number, ends, buckets, limit)
        filled = np.flatnonzero(np.diff(pairs.bounds)).tolist()
        out = []
        for b in filled:
            at = pairs.asked[pairs.bounds[b] : pairs.bounds[b + 1]]
            u, w = pairs.u[at], pairs.w[at]
            first = np.flatnonzero(np.diff(u, prepend=-1))
            dishes, which = np.unique(w, return_inverse=True)
            out.append(
                squeeze(
                    u=thin(np.diff(pairs.number[u[first]], prepend=0)), u_count=thin(pairs.count[u[first]]), size=thin(np.diff(first, append=len(u))),
                    w=thin(pairs.number[dishes]), w_count=thin(pairs.count[dishes]), which=thin(which), n=thin(pairs.n[at]),
                )
            )
        block = own.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(filled), pa.int64()), "bucket": pa.array(filled, pa.int64()), "packed": pa.array(out, pa.binary())})

    blocks = asked.where("bucket < 0").select("block", "packed").groupBy("block")
    return blocks.cogroup(named.groupBy("block")).applyInArrow(run, "block long, bucket long, packed binary")


def stirling(n: int, cut: float) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers: ``[c, t]`` weighs all ways to seat c customers at t tables."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(n):
            stay = np.where(np.arange(n + 1) <= c, out[c] + np.log(np.maximum(c - cut * np.arange(n + 1), 0)), -np.inf)
            out[c + 1] = np.logaddexp(np.append(-np.inf, out[c, :-1]), stay)
    return out


def context_tables(context: np.ndarray, count: np.ndarray, base: np.ndarray, parts: np.ndarray, cut: float, strength: float, seed: int) -> np.ndarray:
    """Tables of each pair (columns) in each sample (rows); base: what the parent serves; parts: of the context of each pair."""
    rng = np.random.default_rng([31, seed])
    tables, log_s = np.minimum(count, 1), stirling(EXACT, cut)
    alike = [rows for c in range(2, EXACT + 1) if len(rows := np.flatnonzero(count == c))]
    many = np.flatnonzero(count > EXACT)
    seats, out = None, []
    for sweep in range(SWEEPS):
        others = np.maximum(np.bincount(context, tables)[context] * parts - tables, 0) if len(context) else tables
        new = (strength + cut * others) * base
        for rows in alike:
            c = int(count[rows[0]])
            t = np.arange(1, c + 1)
            weights = np.log(new[rows])[:, None] * t + log_s[c, 1 : c + 1]
            edge = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
            tables[rows] = 1 + np.minimum((edge <= (rng.random(len(rows)) * edge[:, -1])[:, None]).sum(axis=1), c - 1)
        if len(many):
            if seats is None:
                seats = Seats(count[many], rng)
                seats.fill(new[many], cut)
            seats.sweep(new[many], cut)
            tables[many] = seats.tables
        if sweep >= BURN:
            out.append(tables.copy())
    return np.array(out)


PAIRS, DISHES, SUMS = 0, 1, 2


def seat_contexts(wanted: DataFrame, tokens: int, strength: float, buckets: int, limit: int) -> DataFrame:
    """Of each bucket of contexts: replies to the blocks (``PAIRS``: counts, tables), tables by bucket of words (``DISHES``), and those of the end and
    of contexts in parts (``SUMS``)."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        held = [{k: thick(v) for k, v in expand(p).items()} for p in t.column("packed").to_pylist()]
        u = np.concatenate([np.repeat(np.cumsum(p["u"]), p["size"]) for p in held])
        u_count = np.concatenate([np.repeat(p["u_count"], p["size"]) for p in held])
        w, w_count = (np.concatenate([p[k][p["which"]] for p in held]) for k in ("w", "w_count"))
        n = np.concatenate([p["n"] for p in held])
        order = np.lexsort((w, u))
        first = np.flatnonzero((np.diff(u[order], prepend=-1) != 0) | (np.diff(w[order], prepend=-1) != 0))
        pair = np.empty(len(order), np.int64)
        pair[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
        count = np.bincount(pair, n, len(first)).astype(np.int64)
        at = order[first]
        u, w, w_count, parts = u[at], w[at], w_count[at], parts_of(u_count[at], buckets, limit)
        names, context = np.unique(u, return_inverse=True)
        cut = discount_of((count == 1).sum(), (count == 2).sum())
        tables = context_tables(context, count, w_count / tokens, parts, cut, strength, bucket)
        total = tables.sum(axis=0)
        seated = np.bincount(context, total, len(names)).astype(np.int64)
        rows, lo = [], 0
        for block, p in zip(t.column("block").to_pylist(), held):
            mine = pair[lo : lo + len(p["n"])]
            lo += len(mine)
            here = count[mine]
            found = seated[np.searchsorted(names, np.cumsum(p["u"]))]
            rows.append((PAIRS, block, bucket, squeeze(count=thin(here), tables=thin(total[mine][here > 1]), seated=thin(found), cut=cut)))
        dishes, which = np.unique(w, return_inverse=True)
        served = np.array([np.bincount(which, x, len(dishes)).astype(np.int64) for x in tables])
        word = (dishes > 0) & (served[0] > 0)
        to = (dishes[word] - 1) % buckets
        by = np.argsort(to, kind="stable")
        place, served_by, bounds = ((dishes[word] - 1) // buckets)[by], served[:, word][:, by], np.searchsorted(to[by], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            s = slice(bounds[b], bounds[b + 1])
            x = served_by[:, s]
            rows.append((DISHES, -1, b, squeeze(place=thin(np.diff(place[s], prepend=0)), tables=[thin(x[0]), *(thin(y ^ x[0]) for y in x[1:])])))
        hot = np.unique(context[parts > 1])
        rows.append((SUMS, -1, bucket, squeeze(end=served[:, dishes == 0].sum(axis=1), name=names[hot], seated=cut * seated[hot] / SAMPLES)))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({k: pa.array([r[i] for r in rows], kinds[i]) for i, k in enumerate(("kind", "block", "bucket", "packed"))})

    return wanted.groupBy("bucket").applyInArrow(run, "kind int, block long, bucket long, packed binary")


def with_customers(vocab: DataFrame, contexts: DataFrame) -> DataFrame:
    """The words of each bucket with their customers in each sample, the tables of the contexts, and sums of these."""

    def run(words: pa.Table, served: pa.Table) -> pa.Table:
        held = expand(words.column("packed")[0].as_py())
        by_rank = np.zeros((SAMPLES, len(held["count"])), np.int64)
        for packed in served.column("packed").to_pylist():
            x = expand(packed)
            tables = np.array([thick(y) for y in x["tables"]])
            tables[1:] ^= tables[0]
            by_rank[:, np.cumsum(thick(x["place"]))] += tables
        customers = by_rank[:, numbers(held["count"], 0, 1) - 1]
        sums = [int((customers[-1] == 1).sum()), int((customers[-1] == 2).sum())]
        out = squeeze(hash=held["hash"], count=held["count"], text=held["text"], customers=customers)
        return pa.table([words.column("bucket"), pa.array([out], pa.binary()), *([x] for x in sums), pa.array([customers.sum(axis=1).tolist()])], ["bucket", "packed", "ones", "twos", "customers"])

    served = contexts.where(F.col("kind") == DISHES).select("bucket", "packed").groupBy("bucket")
    return vocab.select("bucket", "packed").groupBy("bucket").cogroup(served).applyInArrow(run, "bucket long, packed binary, ones long, twos long, customers array<long>")


def spelling_counts(vocab: DataFrame) -> DataFrame:
    """How often each key occurs in the words, each taken as often as it has tables (in the last sample), or once before it is seated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                held = expand(packed)
                keys, word = byte_keys(held["text"])
                keys, which = np.unique(keys, return_inverse=True)
                count = np.bincount(which, held["tables"][-1][word] if "tables" in held else None, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(count)], ["key", "n"])

    return vocab.select("packed").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def spelling_of(vocab: DataFrame, end_tables: int, strength: float) -> Spelling:
    """The spelling of words and, ``end_tables`` times, of the end. At most 257**3 rows come here: byte triples."""
    rows = spelling_counts(vocab).collect()
    return Spelling(*(np.array([r[i] for r in rows] + ([(EMPTY_WORD, end_tables)[i]] if end_tables else []), np.int64) for i in (0, 1)), strength)


def seat_words(vocab: DataFrame, spelling: Spelling, cut: float, strength: float, tables: int) -> DataFrame:
    """The words of each bucket with the tables they hold in each sample, and the sums of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = expand(packed)
                keys, word = byte_keys(held["text"])
                spelled = spelling.of(keys, word, len(held["hash"]))
                found = sampled_tables(held["customers"], spelled, cut, strength, tables, bucket)
                out = squeeze(**held | {"tables": found.astype(np.int32), "spelled": spelled.astype(np.float32)})
                sums = [[{"tables": int(n), "spelled": float(p)} for n, p in zip(found.sum(axis=1), spelled.sum(axis=1))]]
                arrays = [pa.array([bucket]), pa.array([out], pa.binary()), pa.array(sums, pa.list_(pa.struct({"tables": pa.int64(), "spelled": pa.float64()}.items())))]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "packed", "sums"])

    return vocab.select("bucket", "packed").mapInArrow(run, "bucket long, packed binary, sums array<struct<tables: long, spelled: double>>")


def sampled_tables(customers: np.ndarray, spelled: np.ndarray, cut: float, strength: float, tables: int, seed: int) -> np.ndarray:
    """``word_tables`` with customers that differ from sample to sample (rows)."""
    return np.concatenate([word_tables(c, spelled[[k]], cut, strength, tables, SAMPLES * seed + k) for k, c in enumerate(customers)])


def word_tables(count: np.ndarray, spelled: np.ndarray, cut: float, strength: float, tables: int, seed: int) -> np.ndarray:
    """Tables of each word (columns) in each sample (rows)."""
    seats = Seats(count, np.random.default_rng([29, seed]))
    new = (strength + cut * tables) * spelled.mean(axis=0)
    seats.fill(new, cut)
    out = []
    for sweep in range(BURN + len(spelled)):
        if sweep >= BURN:
            new = (strength + cut * tables) * spelled[sweep - BURN]
        seats.sweep(new, cut)
        if sweep >= BURN:
            out.append(seats.tables.copy())
    return np.array(out)


def predictive(count, tables: np.ndarray, spelled: np.ndarray, all_tables: np.ndarray, tokens: int, cut: float, strength: float) -> np.ndarray:
    """Probability of each word, averaged over the samples."""
    own = (count - cut * tables) / (strength + np.reshape(tokens, (-1, 1)))
    spread = (strength + cut * all_tables) / (strength + tokens)
    return (own + spread[:, None] * spelled).mean(axis=0)


def replies(
    asked: DataFrame, seated: DataFrame, spelling: Spelling, all_tables: np.ndarray, customers: np.ndarray, cut: float, strength: float, other: float, buckets: int
) -> DataFrame:
    """For each request the numbers, counts and log10 probabilities (without context) of its words, in its order; ``more`` is what spelling out an unknown word adds."""

    def run(wanted: pa.Table, bucket: pa.Table) -> pa.Table:
        words = Words()
        held = expand(bucket.column("packed")[0].as_py()) if bucket.num_rows else NO_WORDS
        number = numbers(held["count"], bucket.column("bucket")[0].as_py() if bucket.num_rows else 0, buckets)
        known = np.log10(predictive(held["customers"], held["tables"], held["spelled"], all_tables, customers, cut, strength)) if len(held["hash"]) else np.zeros(0)
        out = []
        for packed in wanted.column("packed").to_pylist():
            text = expand(packed)["text"]
            h, start, end = tokens_of(words, text)
            at, seen = looked_up(held, h)
            found, count, score, more = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.full(len(h), other, np.float32), np.zeros(len(h), np.float32)
            found[seen], count[seen], score[seen] = number[at[seen]], held["count"][at[seen]], known[at[seen]]
            keys, word = byte_keys(gathered(text, start[~seen], end[~seen]))
            fresh = spelling.of(keys, word, int((~seen).sum()))
            more[~seen] = np.log10(predictive(0, np.zeros((len(fresh), 1)), fresh, all_tables, customers, cut, strength)) - other
            out.append(squeeze(number=thin(found), count=thin(count), score=score, more=more))
        return pa.table({"block": wanted.column("block"), "bucket": wanted.column("bucket"), "packed": pa.array(out, pa.binary())})

    left = asked.where("bucket >= 0").groupBy("bucket")
    return left.cogroup(seated.select("bucket", "packed").groupBy("bucket")).applyInArrow(run, "block long, bucket long, packed binary")


def in_context(pairs: Pairs, buckets: list[int], packed: list[bytes], hot: dict[int, float], score: np.ndarray, strength: float, limit: int) -> np.ndarray:
    """log10 probabilities of the pairs of a block; score: of its words and the end without context."""
    n, tables = np.zeros(len(pairs.u), np.int64), np.zeros(len(pairs.u))
    seated = np.zeros(len(pairs.count))
    for b, p in zip(buckets, packed):
        reply = expand(p)
        at = pairs.asked[pairs.bounds[b] : pairs.bounds[b + 1]]
        here = thick(reply["count"])
        lost = np.where(here > 0, reply["cut"], 0.0)
        lost[here > 1] *= thick(reply["tables"]) / SAMPLES
        n[at], tables[at] = here, lost
        u = pairs.u[at]
        seated[u[np.flatnonzero(np.diff(u, prepend=-1))]] = reply["cut"] * thick(reply["seated"]) / SAMPLES
    for k in np.flatnonzero(pairs.count >= limit).tolist():
        if (name := int(pairs.number[k])) in hot:
            seated[k] = hot[name]
    spread = (strength + seated) / (strength + pairs.count)
    p = (n - tables) / (strength + pairs.count[pairs.u]) + spread[pairs.u] * 10.0 ** score[pairs.w]
    return np.log10(p)


def summed(
    asked: DataFrame, answered: DataFrame, contexts: DataFrame, end: tuple[int, float], tokens: int, types: int, hot: dict[int, float], strength: float, buckets: int, limit: int
) -> DataFrame:
    """Scores of the texts of each block, from its tokens and the replies."""

    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        mine = expand(own.column("packed")[0].as_py())
        by = list(zip(*(got.column(c).to_pylist() for c in ("kind", "bucket", "packed"))))
        plain, near = ([(b, p) for k, b, p in by if (k == PAIRS) == x] for x in (False, True))
        number, count, score, more = from_buckets(mine, [b for b, _ in plain], [p for _, p in plain], ("number", "count", "score", "more"))
        pairs = Pairs(mine, count, number, end[0], buckets, limit)
        found = in_context(pairs, [b for b, _ in near], [p for _, p in near], hot, np.append(score, end[1]), strength, limit)
        size, token = mine["size"], tokens_in(mine)
        doc = np.repeat(np.arange(len(size)), size)
        share = np.log10(count + 1.0) - np.log10(tokens + types + 1.0)
        total = lambda x: np.bincount(doc, x[token], len(size))
        inside = np.bincount(np.repeat(np.arange(len(size)), size + 1), found[pairs.at], len(size))
        table = {
            "doc_id": pa.array(mine["ids"], pa.int64()),
            "held_out": mine["held"],
            "n_tokens": size + 1,
            "n_known": total(count > 0).astype(np.int64) + (end[0] > 0),
            "train_tokens": np.full(len(size), tokens),
            "base_score": total(share) + np.log10((end[0] + 1) / (tokens + types + 1)),
            "score": inside,
            "open_score": inside + total(more),
        }
        return pa.table(table)

    blocks = asked.where("bucket < 0").select("block", "packed").groupBy("block")
    near = contexts.where(F.col("kind") == PAIRS).select("kind", "block", "bucket", "packed")
    got = answered.select(F.lit(-1).alias("kind"), "block", "bucket", "packed").unionByName(near)
    return blocks.cogroup(got.groupBy("block")).applyInArrow(run, OUT)


def score_texts(docs: DataFrame, held_every: int = 7, held_remainder: int = 2, strength: float = 1.0, bucket_rows: int = 4000) -> DataFrame:
    """Learn from the rows whose crc32 remainder isn't ``held_remainder`` and score all rows of ``docs (doc_id, text)``."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    held = F.crc32(name) % held_every == held_remainder
    rows = docs.select(F.col("doc_id").cast("long"), "text", held.alias("held_out"))
    sizes = rows.agg(F.count("*").alias("n"), F.sum((~F.col("held_out")).cast("long")).alias("ends")).first()
    ends = int(sizes["ends"] or 0)
    buckets = 1 + sizes["n"] // bucket_rows
    asked = saved(requests(rows, buckets))
    vocab = saved(vocabulary(asked))
    sums = vocab.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens"))).first()
    tokens, types = sums["tokens"] + ends, sums["types"] + (ends > 0)
    # At most SHARE contexts hold more than the limit, so the driver can keep what becomes of them.
    limit = max(LEAST, tokens // SHARE)
    wanted = pair_requests(asked, numbered(asked, vocab, buckets), ends, buckets, limit)
    contexts = saved(seat_contexts(wanted, tokens, strength, buckets, limit))
    hot, end_customers = {}, np.zeros(SAMPLES, np.int64)
    for r in contexts.where(F.col("kind") == SUMS).select("packed").collect():
        found = expand(r["packed"])
        end_customers += found["end"]
        for k, x in zip(found["name"].tolist(), found["seated"].tolist()):
            hot[k] = hot.get(k, 0.0) + x
    words = saved(with_customers(vocab, contexts))
    sums = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ones", "twos")), *(F.coalesce(F.sum(F.col("customers")[k]), F.lit(0)).alias(f"n{k}") for k in range(SAMPLES))).first()
    customers = np.array([sums[f"n{k}"] for k in range(SAMPLES)]) + end_customers
    cut = discount_of(sums["ones"], sums["twos"])
    spelling = spelling_of(vocab, int(ends > 0), strength)
    # Words are seated under the spelling of the different words first, and then under that of the tables they got.
    for again in (False, True):
        end_spelled = spelling.of(np.array([EMPTY_WORD]), np.array([0]), 1)
        end_tables = sampled_tables(end_customers[:, None], end_spelled, cut, strength, types, -1 % (1 << 32))
        seated = saved(seat_words(words, spelling, cut, strength, types))
        if not again:
            spelling = spelling_of(seated, int(end_tables[-1, 0]), strength)
    by_word = seated.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col.tables").alias("n"), F.sum("col.spelled").alias("p")).collect()
    all_tables, known = end_tables[:, 0].astype(float), end_spelled[:, 0] * (ends > 0)
    for r in by_word:
        all_tables[r["pos"]] += r["n"]
        known[r["pos"]] += r["p"]
    unknown = np.maximum(1 - known, 1e-12)[:, None]
    other = float(np.log10(predictive(0, np.zeros((len(known), 1)), unknown, all_tables, customers, cut, strength))[0])
    end_score = float(np.log10(predictive(end_customers[:, None], end_tables, end_spelled, all_tables, customers, cut, strength))[0])
    answered = replies(asked, seated, spelling, all_tables, customers, cut, strength, other, buckets)
    return summed(asked, answered, contexts, (ends, end_score), tokens, types, hot, strength, buckets, limit)
