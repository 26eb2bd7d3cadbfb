"""Column helpers on the lines of a history file (``array<string>``) and its receipts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.functions.text import ASCII_SPACE, let, sha256_hex, trim_space
from exposure.params import RECEIPT_TAG, SCRUB_MARKER

TAIL_LINES = 64
NEAR_LINES = 3
SHRINK_SLACK = 5

_STAMP = rf"^:[{ASCII_SPACE}]*\d+:\d+;"


def split_lines(content: Column) -> Column:
    """Lines of a text, with the empty one after a final newline."""
    return F.split(content, "\n")


def line_prefix(line: Column) -> Column:
    """The time stamp of an extended history line, or ``''``."""
    return F.regexp_extract(line, _STAMP, 0)


def line_command(line: Column) -> Column:
    return F.regexp_replace(line, _STAMP, "")


def scan_part(line: Column) -> Column:
    """What is searched for secrets: the command, or the line itself where that is empty."""
    return let(line_command(line), lambda cmd: F.when(cmd == "", line).otherwise(cmd))


def receipt_pattern(tag: str = RECEIPT_TAG) -> str:
    return rf"^#[{ASCII_SPACE}]*{re.escape(tag)}:v(\d+):lines=(\d+):tail=([0-9a-f]+)(?::regfp=([0-9a-f]+))?"


def format_receipt(lines: Column, tail: Column, regfp: Column, tag: str = RECEIPT_TAG) -> Column:
    return F.format_string(f"# {tag}:v2:lines=%d:tail=%s:regfp=%s", lines, tail, regfp)


def parse_receipt(line: Column, tag: str = RECEIPT_TAG) -> Column:
    """``struct<version,line_count,tail_hash,regfp>``, NULL where the line is no receipt."""
    pattern = receipt_pattern(tag)

    def part(text: Column, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    return let(
        trim_space(line),
        lambda t: F.when(
            t.rlike(pattern),
            F.struct(
                part(t, 1).cast("long").alias("version"),
                part(t, 2).cast("long").alias("line_count"),
                part(t, 3).alias("tail_hash"),
                part(t, 4).alias("regfp"),
            ),
        ),
    )


def is_receipt(line: Column, tag: str = RECEIPT_TAG) -> Column:
    return F.contains(line, F.lit(tag)) & trim_space(line).rlike(receipt_pattern(tag))


def latest_receipt(lines: Column, tag: str = RECEIPT_TAG) -> Column:
    """The last receipt of a file."""
    return let(
        F.filter(lines, lambda x: is_receipt(x, tag)),
        lambda found: F.when(F.size(found) > 0, parse_receipt(F.element_at(found, -1), tag)),
    )


def last_marker(lines: Column, marker: str = SCRUB_MARKER) -> Column:
    """Zero-based index of the last line that ran the scrub itself, or -1."""

    def at(line: Column, i: Column) -> Column:
        ran = F.contains(line, F.lit(marker)) & F.contains(line_command(line), F.lit(marker))
        return F.when(ran, i).otherwise(-1)

    return F.coalesce(F.array_max(F.transform(lines, at)), F.lit(-1))


def near_receipt(lines: Column, marker_at: Column, tag: str = RECEIPT_TAG) -> Column:
    """The first receipt within three lines after the marker."""
    window = F.slice(lines, F.greatest(marker_at, F.lit(0)) + 2, NEAR_LINES)
    return F.when(
        marker_at >= 0,
        let(
            F.filter(window, lambda x: is_receipt(x, tag)),
            lambda found: F.when(F.size(found) > 0, parse_receipt(found[0], tag)),
        ),
    )


def strip_receipts(lines: Column, tag: str = RECEIPT_TAG) -> Column:
    head = f"# {tag}:"
    return F.filter(lines, lambda x: ~(F.contains(x, F.lit(head)) & trim_space(x).startswith(head)))


def fingerprint(lines: Column) -> Column:
    """``struct<line_count,tail_hash>``: line count and a short hash of the last 64 lines."""
    start = F.greatest(F.size(lines) - TAIL_LINES, F.lit(0)) + 1
    tail = F.array_join(F.slice(lines, start, TAIL_LINES), "\n")
    return F.struct(
        F.size(lines).cast("long").alias("line_count"),
        F.left(sha256_hex(tail), F.lit(16)).alias("tail_hash"),
    )


def looks_rewritten(lines: Column, receipt: Column, tag: str = RECEIPT_TAG) -> Column:
    """No receipt, clearly fewer lines than it says, or another tail."""
    return let(
        fingerprint(strip_receipts(lines, tag)),
        lambda now: receipt.isNull()
        | (now.line_count < receipt.line_count - SHRINK_SLACK)
        | (now.tail_hash != receipt.tail_hash),
    )


def needs_work(lines: Column, receipt: Column, regfp: Column, tag: str = RECEIPT_TAG) -> Column:
    """No receipt, a receipt for another registry, or a rewritten file."""
    return F.coalesce(
        receipt.isNull()
        | (receipt.regfp == "")
        | (receipt.regfp != regfp)
        | looks_rewritten(lines, receipt, tag),
        F.lit(True),
    )


def first_line_to_scrub(lines: Column, marker_at: Column, near: Column, full: bool, tag: str = RECEIPT_TAG) -> Column:
    """Zero-based start of the lines to scrub; everything above it is left as it is."""
    if full:
        return F.lit(0)
    rewritten = near.isNotNull() & looks_rewritten(lines, near, tag)
    return F.when((marker_at < 0) | rewritten, 0).otherwise(marker_at + 1)
