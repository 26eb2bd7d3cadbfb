"""One status row over the registry, the last rescan, the residue summary and the monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overall(**sections: DataFrame) -> DataFrame:
    """``section, body``: the first row of each section as JSON, one row per section."""
    out: DataFrame | None = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("body"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("at least one section is needed")
    return out


def run_metrics(df: DataFrame, run_id: str, stage: str, duration_ms: int) -> DataFrame:
    """Stamp metrics rows with the run they belong to."""
    return df.withColumns(
        {
            "run_id": F.lit(run_id),
            "stage": F.coalesce(F.col("stage"), F.lit(stage)),
            "duration_ms": F.lit(duration_ms).cast("long"),
            "ts": F.current_timestamp(),
        }
    )
