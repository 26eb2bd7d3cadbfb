"""A file corpus as a table, hidden files included.

Spark's own file sources leave out names that begin with a dot, which is where secrets live.
This Python data source lists every regular file below its roots, never follows symbolic links
and prunes skipped directories before descending. The driver only opens enough top directories to
give every task a share; each task walks and reads its own subtrees. For large corpora ``walk`` lists as jobs instead. Paths are
opened by the operating system, so every executor must mount the roots.

A file of more than ``maxBytes`` comes as several rows, cut behind the last line end of each part (``part_no`` from 0). What
can't be listed or read, a missing root included, comes as a row with ``error`` and no content. ``contents=false`` lists only.

    spark.dataSource.register(CorpusSource)
    spark.read.format("corpus").option("roots", "/data/a,/data/b").load()
"""

from __future__ import annotations

import datetime as dt
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from exposure.schema import CORPUS_PARTS

# What a batch of rows holds, about; one part may be larger.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1_000


@dataclass
class Share(InputPartition):
    """Directories to walk in full, and files listed already."""

    directories: list
    files: list
    after: float | None = None
    upto: float | None = None


@dataclass(frozen=True)
class ListingOptions:
    roots: tuple
    skip: frozenset
    shares: int
    max_bytes: int
    contents: bool

    @classmethod
    def of(cls, options) -> ListingOptions:
        def names(key: str) -> list[str]:
            return [x.strip() for x in options.get(key, "").split(",") if x.strip()]

        return cls(
            tuple(os.path.abspath(r) for r in names("roots") or names("path")),
            frozenset(names("skipDirs")),
            int(options.get("shares", "64")),
            max(1, int(options.get("maxBytes", str(1 << 30)))),
            options.get("contents", "true").lower() != "false",
        )


def _entries(directory: str, skip: frozenset) -> tuple[list, list]:
    """Subdirectories and regular files of a directory; one that can't be listed stands among the files, to fail again there."""
    dirs, files = [], []
    try:
        with os.scandir(directory) as it:
            for e in it:
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if e.name not in skip:
                        dirs.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    files.append(e.path)
    except OSError:
        return [], [directory]
    return dirs, files


def _shares(opts: ListingOptions, after=None, upto=None) -> list[Share]:
    """Open directories breadth first until there is one per share, then deal them out."""
    roots = [r for r in opts.roots if os.path.basename(r) not in opts.skip]
    frontier = [r for r in roots if os.path.isdir(r)]
    # A root that is missing, or no folder, fails again in its task and is a row with an error there.
    listed: list = [r for r in roots if not os.path.isdir(r)]
    while frontier and len(frontier) < opts.shares:
        opened = [_entries(d, opts.skip) for d in frontier]
        for _, files in opened:
            listed.extend(files)
        frontier = [d for dirs, _ in opened for d in dirs]
    n = max(1, min(opts.shares, len(frontier) + len(listed)))
    return [Share(frontier[i::n], listed[i::n], after, upto) for i in range(n)]


def _walk(share: Share, skip: frozenset) -> Iterator[str]:
    yield from share.files
    pending = list(share.directories)
    while pending:
        dirs, files = _entries(pending.pop(), skip)
        pending.extend(dirs)
        yield from files


def _rows(share: Share, opts: ListingOptions):
    for path in _walk(share, opts.skip):
        try:
            st = os.lstat(path)
            if share.after is not None and st.st_mtime <= share.after:
                continue
            if share.upto is not None and st.st_mtime > share.upto:
                continue
            if stat.S_ISDIR(st.st_mode):
                os.scandir(path).close()
                raise OSError("its entries could not be read")
            if path in opts.roots:
                raise NotADirectoryError("a root that is no folder")
            head = path, dt.datetime.fromtimestamp(st.st_mtime, dt.timezone.utc), st.st_size
            if not opts.contents:
                yield *head, None, 0, None
                continue
            for part_no, content in enumerate(_parts(path, opts.max_bytes)):
                yield *head, content, part_no, None
        except OSError as e:
            yield path, None, None, None, 0, f"{type(e).__name__}: {e.strerror or e}"


def _batches(share: Share, opts: ListingOptions) -> Iterator[pa.RecordBatch]:
    """The rows in Arrow batches that end once they hold ``BATCH_BYTES`` of content or ``BATCH_ROWS`` rows. Rows given one by one are
    gathered by their number alone, so ten thousand parts would be in memory at once."""
    rows, held = [], 0
    for row in _rows(share, opts):
        rows.append(row)
        held += len(row[3] or b"")
        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.binary(), pa.int32(), pa.string()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, ["path", "modified", "size", "content", "part_no", "error"])


def _parts(path: str, most: int) -> Iterator[bytes]:
    """The content in parts of at most ``most`` bytes, each but the last cut behind a line end where it has one."""
    with open(path, "rb") as f:
        rest = b""
        while True:
            part = rest + f.read(most - len(rest))
            more = f.read(1)
            if not more:
                yield part
                return
            end = part.rfind(b"\n") + 1 or len(part)
            yield part[:end]
            rest = part[end:] + more
            if len(rest) > most:
                yield rest[:most]
                rest = rest[most:]


class CorpusReader(DataSourceReader):
    def __init__(self, options):
        self.opts = ListingOptions.of(options)

    def partitions(self):
        return _shares(self.opts)

    def read(self, partition):
        yield from _batches(partition, self.opts)


class CorpusStreamReader(DataSourceStreamReader):
    """New and changed files: each batch reads what was modified since the last one."""

    def __init__(self, options):
        self.opts = ListingOptions.of(options)
        self.settle = float(options.get("settleSeconds", "2"))

    def initialOffset(self):
        return {"mtime": 0.0}

    def latestOffset(self):
        return {"mtime": dt.datetime.now().timestamp() - self.settle}

    def partitions(self, start, end):
        return _shares(self.opts, start["mtime"], end["mtime"])

    def read(self, partition):
        yield from _batches(partition, self.opts)


class CorpusSource(DataSource):
    @classmethod
    def name(cls):
        return "corpus"

    def schema(self):
        return CORPUS_PARTS

    def reader(self, schema):
        return CorpusReader(self.options)

    def streamReader(self, schema):
        return CorpusStreamReader(self.options)
