"""A file corpus of any size: listed level by level as jobs, read in parts that no other part is needed for.

``listing`` walks breadth first. The folders of a level are rows; a job deals them to tasks, which open them and write what is in them;
the folders among that are the next level. The driver opens no folder and keeps no path, only how many folders are next. The
listing is a stored table of paths, sizes and times: filters on them and the choice of columns reach its scan, and what is
asked of paths alone never opens a file.

``contents`` reads the files of a (filtered) listing. A file of more than ``max_bytes`` is several parts, each of them a row that any
task can read on its own: the lines that begin within its range of bytes, the last one to its end. So a huge file is read by
many tasks, a flat folder of many files is dealt by bytes, and no line is cut. Only a file that begins like JSON stays in one piece, up to
``WHOLE_JSON`` bytes, since no part of it means anything; beyond that size a JSON text is not parsed as one value anyway.

Symbolic links are not followed. A root that is missing, a folder that can't be opened and a file that can't be read are rows with ``error``.
Paths are opened by the operating system, so every executor must mount the roots.

    files = listing(spark, ["/data/a", "/data/b"], skip_dirs=["node_modules"])
    texts = contents(files.filter("size < 1000000 AND path LIKE '%.env'"))
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.shared import folder as shared_folder

LEVEL = "path string, modified timestamp, size long, is_dir boolean, error string"
LISTING = "path string, modified timestamp, size long, error string"
FOLDERS_PER_TASK, ROWS = 64, 4096
TASK_BYTES, BATCH_BYTES = 128 << 20, 16 << 20
FILES_PER_TASK = 20_000
# A text beyond this is not parsed as one JSON value.
WHOLE_JSON = 128 << 20
# The longest row that fits in an Arrow array of binaries beside a batch of others.
LONGEST = (1 << 31) - (1 << 20)

_TIME = pa.timestamp("us", tz="UTC")


def _message(e: OSError) -> str:
    return f"{type(e).__name__}: {e.strerror or e}"


def opened(folder: str, skip: frozenset) -> Iterator[tuple]:
    """path, modified (microseconds), size, is_dir and error of what is in a folder, or one row with the error of the folder."""
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    if e.is_symlink():
                        continue
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in skip:
                            yield e.path, None, None, True, None
                    elif e.is_file(follow_symlinks=False):
                        st = e.stat(follow_symlinks=False)
                        yield e.path, st.st_mtime_ns // 1000, st.st_size, False, None
                except OSError as error:
                    yield e.path, None, None, False, _message(error)
    except OSError as error:
        yield folder, None, None, False, _message(error)


def listing(spark: SparkSession, roots: Iterable[str], skip_dirs: Iterable[str] = (), folder: str | None = None) -> DataFrame:
    """``path, modified, size, error`` of every regular file below the roots, as a table stored in ``folder``.

    Folders of a skipped name are not opened, roots included."""
    skip = frozenset(skip_dirs)
    tops = list(dict.fromkeys(os.path.abspath(r) for r in roots))
    nested = any(a != b and b.startswith(a.rstrip("/") + "/") for a in tops for b in tops)
    tops = [r for r in tops if os.path.basename(r) not in skip]
    store = folder or shared_folder(spark, "listing-")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for directory in batch.column(0).to_pylist():
                for row in opened(directory, skip):
                    held.append(row)
                    if len(held) >= ROWS:
                        yield table(held)
                        held = []
        yield table(held)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), _TIME, pa.int64(), pa.bool_(), pa.string())
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "modified", "size", "is_dir", "error"])

    frontier, waiting, levels = spark.createDataFrame([(r,) for r in tops], "path string"), len(tops), []
    while waiting or not levels:
        levels.append(f"{store}/level={len(levels):05d}")
        tasks = max(1, -(-waiting // FOLDERS_PER_TASK))
        frontier.repartition(tasks).mapInArrow(run, LEVEL).write.mode("overwrite").parquet(levels[-1])
        frontier = spark.read.schema(LEVEL).parquet(levels[-1]).filter("is_dir").select("path")
        waiting = frontier.count()
    found = spark.read.schema(LEVEL).parquet(*levels).filter("NOT is_dir").select("path", "modified", "size", "error")
    return found.dropDuplicates(["path"]) if nested else found


def _begins_like_json(f) -> bool:
    while block := f.read(4096):
        block = block.lstrip(b" \t\r\n")
        if block:
            return block[:1] in (b"{", b"[", b'"')
    return False


def read_part(path: str, part_no: int, size: int, max_bytes: int) -> bytes | None:
    """The lines that begin within a part's range of bytes; None where none does."""
    with open(path, "rb") as f:
        if size <= max_bytes:
            return f.read()
        if size <= WHOLE_JSON and _begins_like_json(f):
            f.seek(0)
            return f.read() if part_no == 0 else None
        start, end = part_no * max_bytes, min((part_no + 1) * max_bytes, size)
        if part_no:
            f.seek(start - 1)
            while (rest := f.readline(1 << 20)) and not rest.endswith(b"\n"):
                pass
            if f.tell() >= end:
                return None
        else:
            f.seek(0)
        out = [f.read(end - f.tell())]
        length = len(out[0])
        while out[-1] and not out[-1].endswith(b"\n"):
            out.append(f.readline(1 << 20))
            length += len(out[-1])
            if length > LONGEST:
                raise OSError(f"a line of more than {LONGEST} bytes")
        return b"".join(out)


def contents(files: DataFrame, max_bytes: int = 1 << 30, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The columns of ``files`` (``path, size, error`` and others) with ``part_no, content, whole`` and ``error``, a row for each part.

    ``whole`` tells whether the row is all of its file. Parts are dealt out so that a task reads about ``task_bytes``. Errors of the listing stay
    rows with an error."""
    max_bytes = max(1, min(max_bytes, LONGEST // 2))
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    tasks = max(1, -(-total["bytes"] // task_bytes), -(-total["n"] // FILES_PER_TASK))
    last = F.greatest(F.ceil(F.coalesce("size", F.lit(0)) / max_bytes).cast("int") - 1, F.lit(0))
    kept = [c for c in files.columns if c != "error"]
    parts = files.select(*kept, "error", F.explode(F.sequence(F.lit(0), last)).alias("part_no"))
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept) + ", part_no int, content binary, whole boolean, error string"

    def read(path: str, part_no: int, size: int | None, error: str | None) -> tuple | None:
        if error is not None:
            return None, True, error
        try:
            content = read_part(path, part_no, size or 0, max_bytes)
        except OSError as e:
            return None, True, _message(e)
        if content is None:
            return None
        return content, (size or 0) <= max_bytes or part_no == 0 and len(content) >= size, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "part_no", "size", "error")]
            rows, found, size = [], [], 0

            def table() -> pa.RecordBatch:
                picked = batch.select([*kept, "part_no"]).take(pa.array(rows, pa.int64()))
                content, whole, error = (pa.array(x, k) for x, k in zip(zip(*found), (pa.binary(), pa.bool_(), pa.string())))
                return pa.RecordBatch.from_arrays([*picked.columns, content, whole, error], [*kept, "part_no", "content", "whole", "error"])

            for i, args in enumerate(zip(*columns)):
                got = read(*args)
                if got is None:
                    continue
                rows.append(i)
                found.append(got)
                size += len(got[0] or b"")
                if size >= BATCH_BYTES:
                    yield table()
                    rows, found, size = [], [], 0
            if rows:
                yield table()

    return parts.repartition(tasks).mapInArrow(run, schema)
