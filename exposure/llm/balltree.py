"""Exact ranked search by sparse ball trees over inner products.

A document is a sparse vector over the terms of the queries: its whole-number impact for each of them. A query is the vector of its
terms' weights, and a score is their inner product. Documents are dealt into blocks of bounded size, as they come. Each block is cut in half again
and again, by which of two far apart documents is nearer, into a tree; a node keeps a centre (whole numbers) and, for groups
of coordinates, the greatest distance of one of its documents from it. By Cauchy and Schwarz no document of a node scores above

    query . centre + sum over groups of |query| * radius in the group

Norms and radii are rounded up, and the bound once more by far more than float64 can lose, so it is safe. A query goes through the nodes best bound first and stops where the bound is below the score that ``k`` documents
reach already; at leaves scores are computed in 64-bit integers. Groups make the bound tight: frequent terms are a group each, rare ones share one with
terms of the same query, so that documents without them have no radius there.

``k`` documents of a sample reach a score that the end result can't be below; the search starts with it. That is only a bound: every document is
in a tree, and the sample changes how many nodes are opened, never the result. So a block sends on only what may still be ranked.

Terms are looked up by a 64-bit hash and confirmed by their bytes. Queries are worked on in groups of bounded size, each with a pass over the
documents.

Nulls: a null text has no term, and doesn't count as a document; a null doc_id ranks behind all others of its score. Rows that repeat, or share a
doc_id, are documents each. Items without text or known terms have no rows, repeated items are ranked each. No documents or no items: no rows. Other columns are
not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposure.llm.blocks import Words, utf8
from exposure.llm.scratch import saved

K = 50
LEAF, BLOCK, BLOCK_ENTRIES = 64, 8192, 1_000_000
SINGLE_GROUPS, SHARED_GROUPS = 256, 256
GROUP_ITEMS, GROUP_TERMS = 256, 16_384
SAMPLE = 64
VECTORS = "doc_id long, n long, terms binary, counts binary"


class Terms(Words):
    """Words of ASCII letters, ASCII digits and all other characters beyond ASCII."""

    def __init__(self) -> None:
        super().__init__()
        code = np.arange(256)
        self.space = ~((code >= 128) | ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122)))


def lowered(data: bytes) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data)


def terms_of(texts: list[str | None]) -> list[list[bytes]]:
    """The terms of each text, repeats included."""
    data, at = utf8(pa.array(texts, pa.string()))
    out: list[list[bytes]] = [[] for _ in texts]
    for run in Terms().runs(data, at):
        raw = run.data.tobytes()
        for d, a, b in zip(run.doc.tolist(), run.start.tolist(), run.end.tolist()):
            out[run.first + d].append(lowered(raw[a:b]))
    return out


class Vocabulary:
    """Numbers of the query terms."""

    def __init__(self, terms: list[bytes]) -> None:
        self.words = Terms()
        data, at = utf8(pa.array(terms, pa.binary()))
        hashes = np.concatenate([run.hash for run in self.words.runs(data, at)] or [np.zeros(0, np.uint64)])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.data, self.at, self.length = np.append(data, np.zeros(1, np.uint8)), at, np.diff(at)
        # Most words are in no query: one look at 16 bits of the hash sends them off.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def find(self, run) -> tuple[np.ndarray, np.ndarray]:
        """Index among the words of a run, and number of the term, of each word that is one."""
        at = np.flatnonzero(self.maybe[(run.hash >> np.uint64(48)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.hashes, run.hash[at]), max(len(self.hashes) - 1, 0))
        hit = self.hashes[slot] == run.hash[at]
        at, term = at[hit], self.order[slot[hit]]
        length = run.end[at] - run.start[at]
        same = length == self.length[term]
        at, term, length = at[same], term[same], length[same]
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        apart = self.lower[run.data[np.repeat(run.start[at], length) + inner]] != self.data[np.repeat(self.at[term], length) + inner]
        if apart.any():
            wrong = np.zeros(len(at), bool)
            wrong[np.repeat(np.arange(len(at)), length)[apart]] = True
            at, term = at[~wrong], term[~wrong]
        return at, term


def sparse(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, number of terms, and the query terms (int32) with their occurrences (int32) of each row of ``docs (doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            data, at = utf8(batch.column(1))
            n, found, counts = [], [], []
            for part in vocabulary.words.runs(data, at):
                n.append(np.bincount(part.doc, minlength=part.count))
                word, term = vocabulary.find(part)
                key, often = np.unique(part.doc[word] * len(terms) + term, return_counts=True)
                bounds = np.searchsorted(key, np.arange(part.count + 1) * len(terms))
                term, often = (key % len(terms)).astype(np.int32), often.astype(np.int32)
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    found.append(term[lo:hi].tobytes())
                    counts.append(often[lo:hi].tobytes())
            arrays = [batch.column(0), pa.array(np.concatenate(n or [np.zeros(0, np.int64)]), pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VECTORS)


def holders(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of ``size`` terms is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "held"])

    rows = vectors.select("terms").mapInArrow(run, "term long, held long").groupBy("term").agg(F.sum("held").alias("held")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["term"]] = r["held"]
    return out


class Queries:
    """Weights of the items' terms, and groups of coordinates."""

    def __init__(self, items: list[list[int]], weight: np.ndarray, held: np.ndarray) -> None:
        self.size = len(weight)
        self.weights = np.zeros((len(items), self.size))
        for i, own in enumerate(items):
            self.weights[i, own] = weight[own]
        self.group = np.zeros(self.size, np.int64)
        for i in reversed(range(len(items))):
            self.group[items[i]] = SINGLE_GROUPS + i % SHARED_GROUPS
        often = np.argsort(-held, kind="stable")[:SINGLE_GROUPS]
        self.group[often] = np.arange(len(often))
        self.groups = SINGLE_GROUPS + SHARED_GROUPS
        squares = np.zeros((self.groups, len(items)))
        np.add.at(squares, self.group, (self.weights**2).T)
        self.norms = np.sqrt(squares) * (1 + 1e-12)


class Block:
    """Some documents as rows of (terms, impacts), in the order of their ids."""

    def __init__(self, ids: list, n: np.ndarray, terms: list[bytes], counts: list[bytes], documents: int, length: int) -> None:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        size = np.array([len(terms[i]) // 4 for i in order], np.int64)
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.term = np.frombuffer(b"".join(terms[i] for i in order), np.int32).astype(np.int64)
        often = np.frombuffer(b"".join(counts[i] for i in order), np.int32).astype(np.int64)
        ratio = 50 + np.array([50 * int(n[i]) * documents // length for i in order], np.int64)
        self.impact = 1_000_000_000 * often // (1000 * often + 20 * np.repeat(ratio, size))

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the documents owns an entry, and the entries."""
        size = self.at[docs + 1] - self.at[docs]
        owner = np.repeat(np.arange(len(docs)), size)
        return owner, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[docs], size)


class Tree:
    """Ball tree of a block: node i has the children 2i+1 and 2i+2; all leaves are on the last level."""

    def __init__(self, block: Block, queries: Queries) -> None:
        self.block = block
        self.depth = max(0, math.ceil(math.log2(max(1, len(block.ids) / LEAF))))
        self.docs: list[np.ndarray] = [np.arange(len(block.ids))]
        self.inner = (1 << self.depth) - 1
        nodes = 2 * self.inner + 1
        centres, radii = np.zeros((nodes, queries.size)), np.zeros((nodes, queries.groups))
        for node in range(nodes):
            docs = self.docs[node]
            owner, at = block.entries(docs)
            term, impact = block.term[at], block.impact[at]
            centre = centres[node] = np.bincount(term, impact.astype(float), queries.size) // max(len(docs), 1)
            radii[node] = self._radius(docs, owner, term, impact, centre, queries)
            if node < self.inner:
                self.docs += self._halves(docs, owner, term, impact, centre)
        self.bound = np.ceil((centres @ queries.weights.T + radii @ queries.norms) * (1 + 1e-9)) + 1

    @staticmethod
    def _radius(docs, owner, term, impact, centre, queries) -> np.ndarray:
        """The greatest distance from the centre in each group of coordinates."""
        if not len(docs):
            return np.zeros(queries.groups)
        own = np.bincount(queries.group, centre * centre, queries.groups)
        place, cells = owner * queries.groups + queries.group[term], len(docs) * queries.groups
        change = np.bincount(place, impact * (impact - 2 * centre[term]), cells).reshape(len(docs), -1).max(axis=0)
        # Whole numbers; the slack is for sums beyond 2^53, where float64 rounds.
        slack = 1e-11 * (own + np.bincount(queries.group[term], impact.astype(float) ** 2, queries.groups))
        return np.sqrt(np.maximum(change + own, 0) + slack) * (1 + 1e-12)

    @staticmethod
    def _halves(docs, owner, term, impact, centre) -> list[np.ndarray]:
        """Two halves: the documents nearer to one of two far apart ones, and the others."""
        impact = impact.astype(float)

        def product(with_: np.ndarray) -> np.ndarray:
            return np.bincount(owner, impact * with_[term], len(docs))

        def vector(i: int) -> np.ndarray:
            out = np.zeros(len(centre))
            mine = owner == i
            out[term[mine]] = impact[mine]
            return out

        if not len(docs):
            return [docs, docs]
        square = np.bincount(owner, impact * impact, len(docs))
        one = vector(int(np.argmax(square - 2 * product(centre))))
        other = vector(int(np.argmax(square - 2 * product(one))))
        side = np.argsort(product(one - other), kind="stable")
        half = len(docs) // 2
        return [np.sort(docs[side[:half]]), np.sort(docs[side[half:]])]

    def search(self, query: int, weight: np.ndarray, least: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """(score, -index) of the up to ``k`` best documents of positive score of at least ``least``, and how many leaves were opened."""
        bound, best, opened = self.bound[:, query], [], 0
        waiting = [(-bound[0], 0)]
        while waiting:
            above, node = heapq.heappop(waiting)
            if -above < (max(least, best[0][0]) if len(best) == k else max(least, 1)):
                break
            if node < self.inner:
                for child in (2 * node + 1, 2 * node + 2):
                    heapq.heappush(waiting, (-bound[child], child))
                continue
            opened += 1
            docs = self.docs[node]
            _, at = self.block.entries(docs)
            sums = np.concatenate([[0], np.cumsum(weight[self.block.term[at]] * self.block.impact[at])])
            size = np.cumsum(self.block.at[docs + 1] - self.block.at[docs])
            score = np.diff(sums[np.concatenate([[0], size])])
            for i in np.flatnonzero(score >= max(least, 1)).tolist():
                found = (int(score[i]), -int(docs[i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return best, opened


def searched(vectors: DataFrame, shape: tuple, documents: int, length: int, least: list[int], k: int) -> DataFrame:
    """item (its number), doc_id and score: of each block the documents that may be among the ``k`` best."""

    def answers(held: list[pa.RecordBatch], queries: Queries) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        block = Block(t["doc_id"].to_pylist(), t["n"].to_numpy(), t["terms"].to_pylist(), t["counts"].to_pylist(), documents, length)
        tree = Tree(block, queries)
        item, doc, score = [], [], []
        for i, weight in enumerate(queries.weights.astype(np.int64)):
            for s, d in tree.search(i, weight, least[i], k)[0]:
                item.append(i)
                doc.append(block.ids[-d])
                score.append(s)
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(*shape)
        held, rows, entries = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                rows += part.num_rows
                entries += (pc.sum(pc.binary_length(part.column(2))).as_py() or 0) // 4
                if rows >= BLOCK or entries >= BLOCK_ENTRIES:
                    yield answers(held, queries)
                    held, rows, entries = [], 0, 0
        if held:
            yield answers(held, queries)

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def groups(items: list[tuple]) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item_id, distinct terms) in groups of bounded size."""
    held, known = [], set()
    for (item, _), terms in zip(items, terms_of([t for _, t in items])):
        own = list(dict.fromkeys(terms))
        if held and (len(held) >= GROUP_ITEMS or len(known | set(own)) > GROUP_TERMS):
            yield held
            held, known = [], set()
        held.append((item, own))
        known |= set(own)
    if held:
        yield held


def _group(docs: DataFrame, group: list[tuple[object, list[bytes]]], k: int) -> DataFrame | None:
    """number of the item in the group, doc_id, score and rank."""
    number = {t: i for i, t in enumerate(dict.fromkeys(t for _, own in group for t in own))}
    if not number:
        return None
    vectors = saved(sparse(docs, list(number)))
    size = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    if not size["length"]:
        return None
    held = holders(vectors, len(number))
    weight = np.array([math.floor(1000 * math.log((2 * size["documents"] + 2) / (2 * h + 1))) for h in held.tolist()], np.int64)
    shape = ([[number[t] for t in own] for _, own in group], weight, held), size["documents"], size["length"]
    vectors = vectors.where("length(terms) > 0")
    some = searched(vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), *shape, [0] * len(group), k)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    reached = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("item", "score").collect()
    least = [0] * len(group)
    for r in reached:
        least[r["item"]] = r["score"]
    found = searched(vectors, *shape, least, k)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best of ``docs (doc_id, text)`` for each of ``items (item_id, text)``."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for group in groups([(r["item_id"], r["text"]) for r in items.select("item_id", "text").toLocalIterator()]):
        found = _group(docs, group, k)
        if found is not None:
            names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(group)], f"item int, item_id {kind}")
            out = out.union(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
