"""Residue and history jobs on what is new: checkpointed streams over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from exposure.params import Gate, PathPolicy
from exposure.plans.residue_scan import scan
from exposure.sources.sinks import write_version


def start_residue(
    corpus: DataFrame, registry: DataFrame, policy: PathPolicy, out: str, checkpoint: str,
    home: str = "", gate: Gate = Gate(), trigger: dict | None = None, rules: DataFrame | None = None,
) -> StreamingQuery:
    """Scan each new batch of files of a corpus stream; the findings of a batch are a version below ``out``.

    ``rules`` are the ignore rules of the surfaces (``policy.ignore_rules``), as in the batch scan. A batch that is replayed after a failure replaces its own version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_version(scan(batch, registry, policy, rules, home, gate), out, f"{batch_id:09d}")

    return (
        corpus.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_scrub(
    files: DataFrame, registry: DataFrame, regfp: str, out: str, checkpoint: str,
    mode: str = "delete", gate: Gate = Gate(), trigger: dict | None = None,
) -> StreamingQuery:
    """Scrub each new batch of history files ``file_id, content``; receipts decide which of them
    need work."""
    from pyspark.sql import functions as F

    from exposure.operators.history import scrub_files

    def write(batch: DataFrame, batch_id: int) -> None:
        done = scrub_files(batch, registry, F.lit(regfp), mode, gate=gate)
        write_version(done, out, f"{batch_id:09d}")

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
