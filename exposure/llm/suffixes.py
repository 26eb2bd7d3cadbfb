"""Removal of byte strings that occur more than once, by sorting suffixes from matching anchors.

Every window of ``LENGTH`` bytes has an anchor: the place of the least hash among its ``GRAM``-byte strings, so equal windows have
equal anchors at the same place in them. Anchors whose string occurs once in all texts drop out. For the others the bytes
to the right, and the bytes to the left read backwards, are sorted as suffixes, deep-shallow: by the next words of
``SHALLOW`` bytes first (a multikey quicksort), and each group that is still tied by a blind trie, which gives the order and the common
prefixes. Two windows with anchor at place s are equal when they agree in ``LENGTH - s`` bytes to the right and s to the left; both
are read off the common prefixes, so the comparison is of bytes, not of hashes.

Equal texts are one class, known by a 64-bit digest, and lose all their bytes (from ``LENGTH`` on); one text of a class stands for it
elsewhere. Anchors are dealt into buckets of bounded size. An anchor string held more than ``hot`` times is not gathered: its
windows go out as 64-bit hashes, dealt by hash in blocks.

Nulls: a null text is empty; a null doc_id stays null. Rows that repeat are copies of each other. Texts under
``LENGTH`` bytes lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.blocks import STEP, mix, utf8
from exposure.llm.scratch import saved

LENGTH, GRAM, SHALLOW = 200, 32, 8
SPAN = 1 << 19
INDEX = np.uint64((1 << 20) - 1)
BUCKET = 16_000
ROWS = 1_500
DOCS = "doc_id long, n_bytes long, class long, sha256 string"


def class_of(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


class Hashes:
    """Hashes of all strings of a length in a text, from prefix sums."""

    def __init__(self) -> None:
        self.value = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
        n = SPAN + LENGTH + 1
        step = np.full(n, STEP, np.uint64)
        step[0] = 1
        self.power = np.cumprod(step)
        step[1:] = pow(STEP, -1, 1 << 64)
        self.inverse = np.cumprod(step)

    def of(self, data: np.ndarray, length: int) -> np.ndarray:
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[:n], out=sums[1:])
        return mix((sums[length:] - sums[:-length]) * self.inverse[: n - length + 1])


def anchors(data: np.ndarray, hashes: Hashes) -> Iterator[tuple[np.ndarray, ...]]:
    """Place, hash, first and last window of each anchor, for one span of windows after the other."""
    windows = len(data) - LENGTH + 1
    for base in range(0, windows, SPAN):
        part = data[base : base + SPAN + LENGTH - 1]
        h = hashes.of(part, GRAM)
        # The place in the low bits: of equal hashes the leftmost counts as least.
        key = (h & ~INDEX) | np.arange(len(h), dtype=np.uint64)
        width, reach = LENGTH - GRAM + 1, 1
        while 2 * reach <= width:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
        place = (key & INDEX).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        yield place[first] + base, h[place[first]], first + base, last + base


def per_row(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, class and SHA-256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            data, ends = data.tobytes(), at.tolist()
            texts = [data[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]
            arrays = [batch.column(0), pa.array(np.diff(at)), pa.array([class_of(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "class", "sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DOCS)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """A row (hash, class, place) for each anchor of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            data, at = utf8(batch.column(0))
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                if hi - lo < LENGTH:
                    continue
                name = class_of(data[lo:hi].tobytes())
                for place, h, _, _ in anchors(data[lo:hi], hashes):
                    arrays = [pa.array(h.view(np.int64)), pa.array(np.full(len(h), name)), pa.array(place)]
                    yield pa.RecordBatch.from_arrays(arrays, ["hash", "class", "place"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in run(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows > 100_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return docs.select("text").mapInArrow(together, "hash long, class long, place long")


def class_texts(docs: DataFrame) -> DataFrame:
    """One compressed text of each class of at least ``LENGTH`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, at = utf8(batch.column(0))
            texts = [data[lo:hi].tobytes() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()) if hi - lo >= LENGTH]
            arrays = [pa.array([class_of(t) for t in texts], pa.int64()), pa.array([press.compress(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["class", "packed"])

    return docs.select("text").mapInArrow(run, "class long, packed binary").groupBy("class").agg(F.first("packed").alias("packed"))


def unpack(packed: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)


def bundles(rows: DataFrame, buckets: int, hot_buckets: int) -> DataFrame:
    """Blocks for buckets: of what surrounds the anchors, or (hot) of window hashes; rows has class, packed and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            near: list[list] = [[] for _ in range(7)]
            far: list[list] = [[] for _ in range(3)]
            for name, packed, places in zip(*(batch.column(c).to_pylist() for c in ("class", "packed", "places"))):
                data = unpack(packed)
                wanted = {p["place"]: p["hot"] for p in places}
                whole = data.tobytes()
                for place, h, first, last in anchors(data, hashes):
                    for k in np.flatnonzero(np.isin(place, list(wanted))).tolist():
                        a, lo, hi = int(place[k]), int(first[k]), int(last[k])
                        if wanted[a]:
                            far[0].append(hashes.of(data[lo : hi + LENGTH], LENGTH))
                            far[1].append(np.full(hi - lo + 1, name))
                            far[2].append(np.arange(lo, hi + 1))
                        else:
                            values = (h[k], name, a, a - hi, a - lo, whole[lo:a], whole[a : hi + LENGTH])
                            for column, v in zip(near, values):
                                column.append(v)
            if near[0]:
                h = np.array(near[0], np.uint64)
                columns = [pa.array(h.view(np.int64)), *(pa.array(np.array(c, np.int64)) for c in near[1:5]), pa.array(near[5], pa.binary()), pa.array(near[6], pa.binary())]
                yield from blocks(0, h, pa.record_batch(columns, ["hash", "class", "place", "least", "most", "left", "right"]), buckets)
            if far[0]:
                h = np.concatenate(far[0])
                columns = [pa.array(h.view(np.int64)), pa.array(np.concatenate(far[1])), pa.array(np.concatenate(far[2]))]
                yield from blocks(1, h, pa.record_batch(columns, ["hash", "class", "start"]), hot_buckets)

    def blocks(kind: int, h: np.ndarray, rows: pa.RecordBatch, count: int) -> Iterator[pa.RecordBatch]:
        """One row for each bucket: its rows as a compressed Arrow stream."""
        to = (mix(h) % np.uint64(count)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        at = np.flatnonzero(np.diff(to[order], prepend=-1))
        rows = rows.take(pa.array(order))
        names, packed = [], []
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_batch(rows.slice(lo, hi - lo))
            names.append(int(to[order[lo]]))
            packed.append(sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array([kind] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(packed, pa.binary())], ["kind", "bucket", "block"])

    return rows.mapInArrow(run, "kind int, bucket long, block binary")


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of strings of equal length, and of each how long a prefix it shares with the one before (0 for the first)."""
    size = 8 * len(strings[0])
    numbers = [int.from_bytes(s, "big") for s in strings]
    # A node is [depth, {byte: child}], a leaf a list of equal strings.
    first, top = [0], None
    for i in range(1, len(strings)):
        if top is None:
            same = numbers[i] ^ numbers[0]
            if not same:
                first.append(i)
                continue
            depth = (size - same.bit_length()) >> 3
            top = [depth, {strings[0][depth]: first, strings[i][depth]: [i]}]
            continue
        s, node = strings[i], top
        while isinstance(node[-1], dict):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        same = numbers[i] ^ numbers[node[0]]
        if not same:
            node.append(i)
            continue
        depth = (size - same.bit_length()) >> 3
        other = strings[node[0]][depth]
        parent, node = None, top
        while isinstance(node[-1], dict) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node[-1], dict) and node[0] == depth:
            node[1][s[depth]] = [i]
            continue
        between = [depth, {other: node, s[depth]: [i]}]
        if parent is None:
            top = between
        else:
            parent[1][s[parent[0]]] = between
    order, shared = [], []
    whole = size >> 3
    stack: list = [(top if top is not None else first, 0)]
    while stack:
        node, common = stack.pop()
        if isinstance(node[-1], dict):
            children = [node[1][c] for c in sorted(node[1])]
            stack += [(child, node[0] if k else common) for k, child in reversed(list(enumerate(children)))]
        else:
            order += node
            shared += [common] + [whole] * (len(node) - 1)
    return order, shared


def multikey_quicksort(group: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Order of the rows by group and then by their first ``depth`` words.

    A segment is split about a pivot word into the rows that are less, equal and greater at its word; the equal ones go on with the
    next word. All segments are split in the same round, so rounds are about as many as the largest segment is deep."""
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.diff(group[order], prepend=-1) != 0) if len(order) else np.zeros(0, np.int64)
    size = np.diff(start, append=len(order))
    at = np.zeros(len(start), np.int64)
    while (open_ := (size > 1) & (at < depth)).any():
        start, size, at = start[open_], size[open_], at[open_]
        first = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(size)), size)
        place = np.arange(size.sum()) + (start - first)[segment]
        rows = order[place]
        value = words[rows, at[segment]]
        pivot = np.sort([value[first], value[first + size // 2], value[first + size - 1]], axis=0)[1][segment]
        part = 3 * segment + (value >= pivot) + (value > pivot)
        order[place] = rows[np.argsort(part, kind="stable")]
        counts = np.bincount(part, minlength=3 * len(size)).reshape(-1, 3)
        start = (start[:, None] + np.cumsum(counts, axis=1) - counts).ravel()
        size, at = counts.ravel(), (at[:, None] + np.array([0, 1, 0])).ravel()
    return order


def deep_shallow(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``text`` (bytes, all of one width) within each group, and the prefix each shares with the row before
    it: -1 where a group begins."""
    n, width = text.shape
    words = np.ascontiguousarray(text).view(">u8").astype(np.uint64)
    shallow = SHALLOW // 8 * 2
    order = multikey_quicksort(group, words, min(shallow, words.shape[1]))
    same_group = np.zeros(n, bool)
    same_group[1:] = group[order[1:]] == group[order[:-1]]
    tied = same_group.copy()
    head = words[order][:, :shallow]
    tied[1:] &= (head[1:] == head[:-1]).all(axis=1)
    starts = np.flatnonzero(~tied)
    ends = np.append(starts[1:], n)
    shared = np.zeros(n, np.int64)
    for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        rows = order[lo:hi]
        by, common = blind_trie([text[r].tobytes() for r in rows.tolist()])
        order[lo:hi] = rows[by]
        shared[lo + 1 : hi] = common[1:]
    apart = text[order[starts[1:]]] != text[order[starts[1:] - 1]]
    shared[starts[1:]] = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    shared[~same_group] = -1
    return order, shared


def padded(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)


def united(rows: pa.Table) -> pa.Table:
    """One row for each anchor: a run of windows that crosses a multiple of ``SPAN`` comes in two, of which each knows its own side of the text best."""
    rows = rows.append_column("before", pc.binary_length(rows.column("left"))).append_column("behind", pc.binary_length(rows.column("right")))
    how = [("hash", "first"), ("least", "min"), ("most", "max"), ("before", "max"), ("behind", "max")]
    one = rows.group_by(["class", "place"], use_threads=False).aggregate(how)
    place = {k: i for i, k in enumerate(zip(one.column("class").to_pylist(), one.column("place").to_pylist()))}
    at = np.array([place[k] for k in zip(rows.column("class").to_pylist(), rows.column("place").to_pylist())], np.int64)
    for side, size in (("left", "before"), ("right", "behind")):
        longest = np.empty(one.num_rows, np.int64)
        by = np.argsort(rows.column(size).to_numpy(), kind="stable")
        longest[at[by]] = by
        one = one.append_column(f"{side}_first", rows.column(side).combine_chunks().take(pa.array(longest)))
    return one.rename_columns({"least_min": "least_first", "most_max": "most_first"})


def equal_windows(rows: pa.Table) -> pa.Table:
    """Runs of window starts (class, start, end of the last window) whose window is found again among the rows."""
    rows = united(rows)
    names, places = rows.column("class").to_numpy(), rows.column("place").to_numpy()
    least, most = rows.column("least_first").to_numpy(), rows.column("most_first").to_numpy()
    _, group = np.unique(rows.column("hash_first").to_numpy(), return_inverse=True)
    n = len(names)
    right = padded([x[GRAM:] for x in rows.column("right_first").to_pylist()], 176)
    left = padded([x[::-1] for x in rows.column("left_first").to_pylist()], 176)
    # The anchor string itself is compared too: its hash alone would not do.
    gram = padded([x[:GRAM] for x in rows.column("right_first").to_pylist()], GRAM)
    _, group = np.unique(np.column_stack([group.astype(">u8").view(np.uint8).reshape(n, 8), gram]).view(f"V{8 + GRAM}").ravel(), return_inverse=True)
    sides = [deep_shallow(group, side) for side in (right, left)]
    found = np.zeros((n, LENGTH - GRAM + 1), bool)
    ranks = np.zeros((2, n), np.int64)
    for s in range(LENGTH - GRAM + 1):
        for side, (order, shared) in enumerate(sides):
            ranks[side, order] = np.cumsum(shared < (LENGTH - GRAM - s, s)[side])
        here = np.flatnonzero((least <= s) & (s <= most))
        key = ranks[0, here] * (n + 1) + ranks[1, here]
        order = np.argsort(key, kind="stable")
        again = np.diff(key[order]) == 0
        twice = np.zeros(len(here), bool)
        twice[order[1:]] |= again
        twice[order[:-1]] |= again
        found[here, s] = twice
    # From the largest s, which begins furthest to the left, runs of window starts.
    edge = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return pa.table({"class": names[row], "start": places[row] - high + 1, "end": places[row] - low + LENGTH})


def equal_hashes(rows: pa.Table) -> pa.Table:
    """The same for rows of window hashes."""
    rows = rows.group_by(["class", "start"], use_threads=False).aggregate([("hash", "min")])
    h, name, start = (rows.column(c).to_numpy() for c in ("hash_min", "class", "start"))
    order = np.argsort(h, kind="stable")
    again = np.diff(h[order]) == 0
    twice = np.zeros(len(h), bool)
    twice[order[1:]] |= again
    twice[order[:-1]] |= again
    return pa.table({"class": name[twice], "start": start[twice], "end": start[twice] + LENGTH})


def matches(blocks: DataFrame) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(b).read_all() for b in t.column("block").to_pylist()]
        rows = pa.concat_tables(parts)
        found = equal_hashes(rows) if t.column("kind")[0].as_py() else equal_windows(rows)
        if not found.num_rows:
            return pa.table({"class": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
        # One row for each class: its spans as pairs of 64-bit numbers.
        found = found.sort_by([("class", "ascending"), ("start", "ascending")])
        name = found.column("class").to_numpy()
        pairs = np.column_stack([found.column("start").to_numpy(), found.column("end").to_numpy()]).astype("<i8")
        at = np.flatnonzero(np.diff(name, prepend=name[0] - 1))
        ends = np.append(at[1:], len(name))
        return pa.table({"class": name[at], "spans": pa.array([pairs[lo:hi].tobytes() for lo, hi in zip(at.tolist(), ends.tolist())], pa.binary())})

    return blocks.groupBy("kind", "bucket").applyInArrow(run, "class long, spans binary")


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint, not touching spans, in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.column_stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]])


def without(rows: DataFrame) -> DataFrame:
    """n_removed, n_spans and kept_sha256 by class; rows has class, packed and a list of spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, parts in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
                data = unpack(packed)
                gone = merged(np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2))
                edges = np.zeros(len(data) + 1, np.int8)
                edges[gone[:, 0]] += 1
                edges[gone[:, 1]] -= 1
                kept = data[np.cumsum(edges[:-1]) == 0]
                out.append((len(data) - len(kept), len(gone), hashlib.sha256(kept.tobytes()).hexdigest()))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("class"), *columns], ["class", "_removed", "_spans", "_sha256"])

    return rows.mapInArrow(run, "class long, _removed long, _spans long, _sha256 string")


def remove_repeats(docs: DataFrame, hot: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs (doc_id, text)``."""
    rows = saved(per_row(docs))
    found = anchor_rows(docs)
    spot = F.xxhash64("class", "place")
    repeated = found.groupBy("hash").agg(F.min(spot).alias("_a"), F.max(spot).alias("_b"), F.count("*").alias("_n")).where("_a <> _b")
    # A table of its own, so that the join has a shuffle on either side and a hot hash can be split.
    repeated = saved(repeated.select("hash", "_n"))
    places = found.join(repeated, "hash").select("class", F.struct("place", (F.col("_n") > hot).alias("hot")).alias("_place"))
    places = saved(places.groupBy("class").agg(F.collect_set("_place").alias("places")))
    counts = places.select(F.explode("places").alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("p.hot").cast("long")).alias("hot")).first()
    buckets, hot_buckets = 1 + counts["n"] // BUCKET, 1 + (counts["hot"] or 0) * LENGTH // (20 * BUCKET)
    texts = class_texts(docs)
    spans = saved(matches(bundles(texts.join(places, "class").select("class", "packed", "places"), buckets, hot_buckets)))
    by_class = spans.groupBy("class").agg(F.collect_list("spans").alias("spans"))
    cut = saved(without(texts.join(by_class, "class").select("class", "packed", "spans")))
    copies = rows.groupBy("class").agg(F.count("*").alias("_copies")).where("_copies > 1")
    joined = rows.join(cut, "class", "left").join(copies, "class", "left")
    all_gone = F.col("_copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha256", "sha256")).alias("kept_sha256"),
    )
