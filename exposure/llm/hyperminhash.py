"""Near duplicates by HyperMinHash registers, banding and exact verification.

A text is the set of 64-bit hashes of its shingles of ``width`` words, 3 by default (fewer words: the whole sequence is one; none: empty, linked with
nothing). Of each of ``REGISTERS`` hash functions the least value is kept as a 16-bit register: the count of leading
zeros (6 bits) and the 10 bits behind the first one. Bands of ``ROWS`` registers find candidates: at similarity 0.85 a
pair shares no band with a probability of 2e-8. The share of equal registers, less the collisions that sets of these
sizes have by chance, estimates the similarity; pairs more than six standard deviations below the limit go. What is left
is decided on the full sets.

Texts of equal sets are one class, joined by fingerprint before anything else, so exact copies cost a row. Inside a
bucket no pairs are formed: first its most typical class (the one that shares the most buckets with others) is compared with every
member. Where a bucket still holds several components after that, a task compares its members through an inverted index of their shingles,
returning at most one edge for each merge of components. The members of a large bucket are dealt anew for that, by their rarest shingles,
which two linked sets can't help sharing: rows stay in proportion to members, and no link is lost.

Nulls: a null text is empty; a null doc_id takes the component of its class but names none. Rows that repeat count as one
class and each gets a row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.llm.blocks import Words, mix, utf8
from exposure.llm.components import components
from exposure.llm.scratch import saved

REGISTERS = 96
ROWS = 4
MANTISSA = 10
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
SKETCH = "doc_id long, row long, n_shingles long, fingerprint binary, registers binary"


def shingle_sets(column: pa.Array, words: Words, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = utf8(column)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for run in words.runs(data, at):
        h = run.hash
        full = max(len(h) - width + 1, 0)
        shingles = mix(sum(h[k : k + full] * factor[k] for k in range(width)))
        bounds = np.searchsorted(run.doc, np.arange(run.count + 1))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= width:
                yield np.unique(shingles[lo : hi - width + 1])
            else:
                yield mix((h[lo:hi] * factor[: hi - lo]).sum(keepdims=True, dtype=np.uint64)) if hi > lo else h[:0]


def multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The compressed least value under each hash function, as uint16."""
    least = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (by[:, None] * shingles[None, i : i + 1024]).min(axis=1), out=least)
    exponent = np.frexp(least.astype(np.float64))[1].astype(np.uint64)
    # A value that rounds up to the next power of two in float64 has its leading bit one lower.
    exponent -= (least >> np.maximum(exponent, np.uint64(1)) - np.uint64(1) == 0) & (exponent > 0)
    zeros = np.uint64(64) - exponent
    behind = np.where(zeros < 63, least << np.minimum(zeros + np.uint64(1), np.uint64(63)), np.uint64(0))
    return (np.minimum(zeros, np.uint64(63)) << np.uint64(MANTISSA) | behind >> np.uint64(64 - MANTISSA)).astype(np.uint16)


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that unrelated sets of these sizes agree in a register: both in one cell of leading zeros, then in its mantissa."""
    edge = 0.5 ** np.arange(65)[:, None]

    def share(size: np.ndarray) -> np.ndarray:
        over = np.exp(size * np.log1p(-np.minimum(edge, 1 - 1e-16)))
        return over[1:] - over[:-1]

    return (share(n) * share(m)).sum(axis=0) / (1 << MANTISSA)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal registers, corrected for collisions."""
    by_chance = chance(n, m)
    return np.clip((equal / REGISTERS - by_chance) / (1 - by_chance), 0, 1)


def may_link(equal: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    limit = percent / 100
    spread = 6 * np.sqrt(limit * (1 - limit) / REGISTERS)
    return (estimate(equal, n, m) >= limit - spread) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, row (hash of doc_id and text), n_shingles, fingerprint and registers of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, by = Words(), multipliers()
        for batch in batches:
            sizes, prints, regs = [], [], []
            for s in shingle_sets(batch.column(2), words, width):
                sizes.append(len(s))
                prints.append(fingerprint(s))
                regs.append(registers(s, by).tobytes() if len(s) else b"")
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "n_shingles", "fingerprint", "registers"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """fingerprint and the sorted shingle hashes (binary) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), words, width))
            arrays = [pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["fingerprint", "shingles"])

    return docs.select("text").mapInArrow(run, "fingerprint binary, shingles binary")


def _numbers(column: pa.Array, dtype: type) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that the registers don't rule out."""
    for side in ("a", "b"):
        own = classes.select(F.col("fingerprint").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}"))
        pairs = pairs.join(own, side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(t.column(f"r_{s}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for s in "ab")
            n, m = (t.column(f"n_{s}").to_numpy() for s in "ab")
            keep = pa.array(may_link((left == right).sum(axis=1), n, m, percent))
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], ["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    for side in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("fingerprint").alias(side), F.col("shingles").alias(f"s_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = pa.array([linked(a, b, percent) for a, b in zip(*(_numbers(t.column(f"s_{s}"), np.uint64) for s in "ab"))], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], ["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Full sets of the wanted classes (fingerprint, doc_id of a row of the class)."""
    rows = wanted.select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_fp"))
    texts = docs.select("doc_id", "text").join(rows.select("_id").distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = full_sets(texts, width).groupBy("fingerprint").agg(F.first("shingles").alias("shingles"))
    return found.join(rows, F.col("fingerprint") == F.col("_fp"), "left_semi")


class Joined:
    """Union-find over labels, for one task."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[b] = a
        return a != b


def block_edges(names: list[bytes], labels: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Edges that join all components among the members that some link joins: every pair of different labels is looked at."""
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    union, edges = Joined(), []
    for i, s in enumerate(sets):
        lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        count = hi - lo
        at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(100 * both >= percent * (sizes + len(s) - both)).tolist():
            if j > i and union.join(labels[i], labels[j]):
                edges.append((names[i], names[j]))
    return edges


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row and label (the component) of each row of ``docs (doc_id, text)``."""
    rows = saved(sketches(docs, width))
    classes = saved(
        rows.where("n_shingles > 0")
        .groupBy("fingerprint")
        .agg(F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.min("doc_id").alias("doc_id"))
    )
    band_bytes = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.col("registers").substr(i * band_bytes + 1, F.lit(band_bytes)))
    buckets = classes.select("fingerprint", "n_shingles", F.posexplode(bands).alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("held")).where("held > 1")
    buckets = saved(buckets.join(shared, ["band", "key"]))
    typical = buckets.groupBy("fingerprint").agg(F.sum("held").alias("score"))
    ranked = buckets.join(typical, "fingerprint")
    leaders = ranked.groupBy("band", "key").agg(F.max(F.struct("score", "fingerprint"))["fingerprint"].alias("a"))
    stars = buckets.join(leaders, ["band", "key"]).where("fingerprint <> a").select("a", F.col("fingerprint").alias("b")).distinct()
    pairs = saved(likely(stars, classes, percent))
    in_play = buckets.select("fingerprint").distinct().join(classes.select("fingerprint", "doc_id"), "fingerprint")
    in_play = in_play.join(pairs.select(F.col("a").alias("fingerprint")).union(pairs.select("b")).distinct(), "fingerprint", "left_semi")
    sets = saved(sets_of(docs, in_play, width))
    edges = saved(confirmed(pairs, sets, percent))
    edges = edges.union(_rest(edges, buckets, classes, docs, sets, percent, width))
    labels = components(edges).withColumnsRenamed({"node": "fingerprint"})
    return _named(rows, labels, classes)


def _named(rows: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    least = classes.join(labels, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    ids = least.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = least.select("fingerprint", "label").join(ids, "label").select("fingerprint", "component_id", "label")
    out = rows.join(by_class, "fingerprint", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "row", "label")


def _rest(edges: DataFrame, buckets: DataFrame, classes: DataFrame, docs: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """Edges between components that still meet in a bucket."""
    labels = components(edges).withColumnRenamed("node", "fingerprint")
    held = buckets.select("band", "key", "fingerprint", "n_shingles").join(labels, "fingerprint", "left")
    held = saved(held.withColumn("label", F.coalesce("label", "fingerprint")))
    mark = F.xxhash64("fingerprint")
    open_buckets = held.groupBy("band", "key").agg(
        F.count("*").alias("held"), F.sum("n_shingles").alias("size"), F.min("label").alias("least"), F.max("label").alias("most"), F.sum(mark % 1_000_003).alias("_x"), F.bit_xor(mark).alias("_y")
    )
    # Buckets of the same members are looked at once.
    once = open_buckets.where("least <> most").groupBy("held", "size", "_x", "_y").agg(F.min(F.struct("band", "key")).alias("bucket"))
    fits = (F.col("held") <= BLOCK) & (F.col("size") <= BLOCK_SHINGLES)
    once = once.select("bucket.band", "bucket.key", fits.alias("fits"))
    members = held.join(once, ["band", "key"])
    crowd = saved(members.where("NOT fits").select("fingerprint", "label", "n_shingles").distinct())
    regs = classes.select("fingerprint", "registers")
    small = members.where("fits").select("band", "key", F.lit(1).alias("blocks"), "fingerprint", "label", "n_shingles")
    missing = crowd.select("fingerprint").join(sets.select("fingerprint"), "fingerprint", "left_anti").join(classes.select("fingerprint", "doc_id"), "fingerprint")
    sets = saved(sets.union(sets_of(docs, missing, width)))
    members = small.union(_by_rare_shingles(crowd, sets, percent)).join(regs, "fingerprint")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    members = members.withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumn("other", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def open_members(t: pa.Table) -> pa.Table:
        """Members that the registers let link with one of another component."""
        regs = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        n = t.column("n_shingles").to_numpy()
        _, label = np.unique(np.array([x.hex() for x in t.column("label").to_pylist()]), return_inverse=True)
        keep = np.zeros(len(n), bool)
        for k in range(len(n)):
            apart = label != label[k]
            equal = (regs[apart] == regs[k]).sum(axis=1)
            keep[k] = may_link(equal, n[apart], np.full(len(equal), n[k]), percent).any()
        return t.select(["band", "key", "i", "j", "fingerprint", "label"]).filter(pa.array(keep))

    schema = "band int, key binary, i int, j int, fingerprint binary, label binary"
    place = ["band", "key", "i", "j"]
    narrow = dealt.select(*place, "fingerprint", "label", "n_shingles", "registers")
    undecided = saved(narrow.groupBy(*place).applyInArrow(open_members, schema))
    known = sets.select("fingerprint").distinct()
    missing = undecided.select("fingerprint").distinct().join(known, "fingerprint", "left_anti").join(classes.select("fingerprint", "doc_id"), "fingerprint")
    sets = sets.union(sets_of(docs, missing, width))

    def merges(t: pa.Table) -> pa.Table:
        found = block_edges(t.column("fingerprint").to_pylist(), t.column("label").to_pylist(), _numbers(t.column("shingles"), np.uint64), percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    whole = undecided.join(sets, "fingerprint").select(*place, "fingerprint", "label", "shingles")
    return saved(whole.groupBy(*place).applyInArrow(merges, "a binary, b binary"))


def prefix_lengths(n: Column | int, percent: int) -> tuple:
    """How many of its rarest shingles a set of this size must look at, to meet every linked set of at least its size, and every one of at most its size.

    Sets of sizes n <= m are linked where they share percent * (n + m) / (100 + percent) shingles. Of two sets that share k, whatever the
    order of shingles, the first n - k + 1 of one and the first m - k + 1 of the other have one in common."""
    up = F.ceil if isinstance(n, Column) else math.ceil
    return n - up(n * (2 * percent) / (100 + percent)) + 1, n - up(n * percent / 100) + 1


def _by_rare_shingles(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``band, key, blocks, fingerprint, label, n_shingles``: the members of large buckets, dealt anew by their rarest shingles.

    A set meets all sets that it may be linked with by the shingles of its prefix, rarest first; those that are in one set, or in sets of
    one component, are passed over. Rows are in proportion to the members, whatever the size of the bucket they came from. Only a shingle that is
    still among the rarest of more than ``BLOCK`` members of several components is dealt in blocks."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = _numbers(part.column(3), np.int64)
                if not found:
                    continue
                rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([*part.select(["fingerprint", "label", "n_shingles"]).take(pa.array(rows)).columns, pa.array(np.concatenate(found))], ["fingerprint", "label", "n_shingles", "token"])

    whole = crowd.join(sets, "fingerprint").select("fingerprint", "label", "n_shingles", "shingles")
    rows = saved(whole.mapInArrow(tokens, "fingerprint binary, label binary, n_shingles long, token long"))
    often = rows.groupBy("token").agg(F.count("*").alias("held"), (F.min("label") != F.max("label")).alias("apart"))
    order = Window.partitionBy("fingerprint").orderBy("held", "token")
    larger, smaller = prefix_lengths(F.col("n_shingles"), percent)
    placed = rows.join(often, "token").withColumn("nth", F.row_number().over(order))
    prefix = saved(placed.where((F.col("nth") <= smaller) & F.col("apart")).select("token", "fingerprint", "label", "n_shingles", (F.col("nth") <= larger).alias("first")))
    groups = prefix.groupBy("token").agg(
        F.count("*").alias("held"), F.sum("n_shingles").alias("size"), F.bool_or("first").alias("first"), (F.min("label") != F.max("label")).alias("apart"), F.bit_xor(F.xxhash64("fingerprint")).alias("_x")
    ).where("first AND apart")
    # Shingles of the same members are looked at once.
    groups = groups.groupBy("held", "size", "_x").agg(F.min("token").alias("token"))
    blocks = F.ceil(F.greatest(F.col("held") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    met = prefix.join(groups.select("token", blocks), "token")
    return met.select(F.lit(-1).alias("band"), F.unhex(F.hex("token")).alias("key"), "blocks", "fingerprint", "label", "n_shingles")


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one of smallest doc_id, and all rows without words, repeats of a row once."""
    found = near_duplicates(docs.select("doc_id", "text"), percent, width)
    chosen = found.where("n_shingles > 0").groupBy("label").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row"))
    stay = chosen.select("row").union(found.where("n_shingles = 0").select("row")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("_all"), F.xxhash64("doc_id", "text").alias("_row"))
    return keyed.join(stay.withColumnRenamed("row", "_row"), "_row", "left_semi").dropDuplicates(["_row"]).select("_all.*")
