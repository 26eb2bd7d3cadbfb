"""Scrubbing command history: line tables, and whole files with receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions import receipts as R
from exposure.functions.extract import candidate_hashes, candidates
from exposure.functions.text import let, sha256_hex
from exposure.operators.known import known_candidates, known_hashes_by_id, replace_all
from exposure.params import PLACEHOLDER, RECEIPT_TAG, SCRUB_MARKER, Gate, effective_mode


def scrub_line(line: Column, known: Column, mode: str, placeholder: str, gate: Gate, longest_first: bool) -> Column:
    """``struct<final,action,secrets>`` of one line, given the hashes known to occur in it."""

    def outcome(values: Column) -> Column:
        n = F.size(values)
        if effective_mode(mode) == "delete":
            changed, action = F.lit(""), "deleted"
        else:
            command = replace_all(R.line_command(line), values, placeholder, longest_first)
            changed, action = F.concat(R.line_prefix(line), command), "redacted"
        return F.struct(
            F.when(n == 0, line).otherwise(changed).alias("final"),
            F.when(n == 0, "kept").otherwise(action).alias("action"),
            n.alias("secrets"),
        )

    return let(known_candidates(R.scan_part(line), known, gate), outcome)


def scrub_lines(
    lines: DataFrame,
    registry: DataFrame,
    mode: str = "delete",
    placeholder: str = PLACEHOLDER,
    gate: Gate = Gate(),
    longest_first: bool = False,
) -> DataFrame:
    """``file_id, line_no, final, action, secrets`` of a line table ``file_id, line_no, line``.

    Lines are independent, so nothing is grouped by file.
    """
    ids = ["file_id", "line_no"]
    hashes = lines.select(*ids, candidate_hashes(R.scan_part(F.col("line")), gate).alias("_hashes"))
    found = known_hashes_by_id(hashes, ids, "_hashes", registry)
    joined = lines.select(*ids, "line").join(found, ids, "left")
    scrubbed = scrub_line(F.col("line"), F.col("known_hashes"), mode, placeholder, gate, longest_first)
    kept = F.struct(F.col("line").alias("final"), F.lit("kept").alias("action"), F.lit(0).alias("secrets"))
    result = F.when(F.col("known_hashes").isNotNull(), scrubbed).otherwise(kept)
    return joined.select(*ids, result.alias("_r")).select(*ids, "_r.final", "_r.action", "_r.secrets")


def kept_lines(scrubbed: DataFrame) -> DataFrame:
    """The lines that remain: not deleted, and not redacted to nothing."""
    gone = (F.col("action") == "deleted") | ((F.col("action") == "redacted") & (F.col("final") == ""))
    return scrubbed.filter(~gone)


def totals(scrubbed: DataFrame) -> DataFrame:
    """Deleted, redacted and secrets per file, and overall (``file_id`` NULL) with changed files."""
    per_file = scrubbed.groupBy("file_id").agg(
        F.count_if(F.col("action") == "deleted").alias("deleted"),
        F.count_if(F.col("action") == "redacted").alias("redacted"),
        F.sum("secrets").alias("secrets"),
    )
    changed = F.when(F.col("deleted") + F.col("redacted") > 0, 1).otherwise(0)
    return per_file.rollup("file_id").agg(
        F.sum("deleted").alias("deleted"),
        F.sum("redacted").alias("redacted"),
        F.sum("secrets").alias("secrets"),
        F.sum(changed).alias("changed_files"),
    )


def lines_of(files: DataFrame) -> DataFrame:
    """Line table of a file table ``file_id, content``."""
    return files.select("file_id", F.posexplode(R.split_lines(F.col("content"))).alias("line_no", "line"))


def plan_files(
    files: DataFrame, regfp: Column, full: bool = False, tag: str = RECEIPT_TAG, marker: str = SCRUB_MARKER
) -> DataFrame:
    """What is to be done with each history file: ``file_id, content, lines, receipt, marker_at,
    work, start``.

    A file is one row, so its receipts, marker and fingerprint are found inside the row.
    """
    lines = files.select(
        "file_id", "content", R.split_lines(F.col("content")).alias("lines"), regfp.alias("current_regfp")
    )
    facts = lines.select(
        "*",
        R.latest_receipt(F.col("lines"), tag).alias("receipt"),
        R.last_marker(F.col("lines"), marker).alias("marker_at"),
    )
    near = facts.withColumn("near", R.near_receipt(F.col("lines"), F.col("marker_at"), tag))
    work = F.lit(True) if full else R.needs_work(F.col("lines"), F.col("receipt"), F.col("current_regfp"), tag)
    start = R.first_line_to_scrub(F.col("lines"), F.col("marker_at"), F.col("near"), full, tag)
    return near.withColumn("work", work).withColumn("start", start)


def suffix_hashes(lines: Column, start: Column, gate: Gate) -> Column:
    """Hashes of everything the lines from ``start`` on may hold.

    The commands are searched as one text, which finds at least what a line-by-line search does;
    only lines that may be JSON are also searched on their own.
    """
    commands = F.transform(F.slice(lines, start + 1, F.size(lines)), R.scan_part)

    def search(cmds: Column) -> Column:
        structured = F.filter(cmds, lambda c: c.rlike(r"^[ \t\r]*+[{\[\"]"))
        own = F.flatten(F.transform(structured, lambda c: candidates(c, gate)))
        return F.transform(
            F.array_union(candidates(F.array_join(cmds, "\n"), gate), own), sha256_hex
        )

    return let(commands, search)


def scrub_files(
    files: DataFrame,
    registry: DataFrame,
    regfp: Column,
    mode: str = "delete",
    placeholder: str = PLACEHOLDER,
    full: bool = False,
    gate: Gate = Gate(),
    tag: str = RECEIPT_TAG,
    marker: str = SCRUB_MARKER,
    longest_first: bool = False,
    strip_before_fingerprint: bool = False,
) -> DataFrame:
    """Scrub history files ``file_id, content``.

    Gives per file the new ``content`` (kept lines and one new receipt; unchanged for skipped
    files), counts, skip reason, receipt facts and up to three example lines that were redacted.
    """
    plan = plan_files(files, regfp, full, tag, marker)
    todo = F.when(F.col("work"), suffix_hashes(F.col("lines"), F.col("start"), gate))
    found = known_hashes_by_id(plan.select("file_id", todo.alias("_hashes")), ["file_id"], "_hashes", registry)
    joined = plan.join(found, "file_id", "left")

    nothing = F.array().cast("array<struct<final:string,action:string,secrets:int>>")

    def apply(suffix: Column) -> Column:
        """Only lines that contain one of the file's known values are searched on their own."""
        known = F.col("known_hashes")
        values = known_candidates(F.array_join(F.transform(suffix, R.scan_part), "\n"), known, gate)

        def each(vals: Column) -> Column:
            def one(line: Column) -> Column:
                kept = F.struct(line.alias("final"), F.lit("kept").alias("action"), F.lit(0).alias("secrets"))
                suspect = F.exists(vals, lambda v: F.contains(line, v)) | line.rlike(r"[{\[\"]")
                scrubbed = scrub_line(line, known, mode, placeholder, gate, longest_first)
                return F.when(suspect, scrubbed).otherwise(kept)

            return F.transform(suffix, one)

        return let(values, each)

    suffix = F.slice(F.col("lines"), F.col("start") + 1, F.size("lines"))
    applied = joined.withColumn(
        "_applied", F.when(F.col("known_hashes").isNotNull(), apply(suffix)).otherwise(nothing)
    )
    changed = F.size("_applied") > 0
    stays = F.filter(
        F.col("_applied"),
        lambda r: ~((r.action == "deleted") | ((r.action == "redacted") & (r.final == ""))),
    )
    kept = F.when(
        changed, F.concat(F.slice("lines", 1, F.col("start")), F.transform(stays, lambda r: r.final))
    ).otherwise(F.col("lines"))
    out = applied.withColumn("kept", kept)

    counted = F.col("kept")
    if strip_before_fingerprint:
        counted = R.strip_receipts(counted, tag)
    print_ = R.fingerprint(counted)
    receipt_line = let(
        print_, lambda fp: R.format_receipt(fp.line_count, fp.tail_hash, F.col("current_regfp"), tag)
    )

    def tally(action: str) -> Column:
        return F.size(F.filter("_applied", lambda r: r.action == action))

    positions = F.sequence(F.lit(1), F.least(F.size("lines"), F.size("kept")))
    examples = F.filter(
        F.transform(
            positions,
            lambda i: F.when(
                F.element_at("kept", i).contains(placeholder)
                & (F.element_at("kept", i) != F.element_at("lines", i)),
                F.element_at("kept", i),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return out.select(
        "file_id",
        F.when(F.col("work"), F.array_join(F.concat("kept", F.array(receipt_line)), "\n"))
        .otherwise(F.col("content"))
        .alias("content"),
        F.size("lines").alias("original_lines"),
        F.when(F.col("work"), F.size("lines") - F.col("start")).otherwise(0).alias("processed_lines"),
        tally("deleted").alias("deleted"),
        tally("redacted").alias("redacted"),
        F.aggregate("_applied", F.lit(0), lambda acc, r: acc + r.secrets).alias("secrets"),
        (~F.col("work")).alias("skipped"),
        F.when(~F.col("work"), "receipt+regfp").alias("skipped_reason"),
        F.col("receipt").isNotNull().alias("had_receipt"),
        F.coalesce(F.col("receipt.regfp") == F.col("current_regfp"), F.lit(False)).alias("regfp_match"),
        F.when(changed, F.slice(examples, 1, 3)).otherwise(F.array().cast("array<string>")).alias("examples"),
    )


def receipts_table(files: DataFrame, tag: str = RECEIPT_TAG) -> DataFrame:
    """``file_id, line_no, version, line_count, tail_hash, regfp`` of every receipt."""
    found = lines_of(files).filter(F.contains("line", F.lit(tag)))
    parsed = found.select("file_id", "line_no", R.parse_receipt(F.col("line"), tag).alias("r"))
    return parsed.filter(F.col("r").isNotNull()).select("file_id", "line_no", "r.*")
