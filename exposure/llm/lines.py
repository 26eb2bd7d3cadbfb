"""Quality rules on lines that many documents of a host share (native columns only).

A line is normalised (lower case, runs of white space as one blank, trimmed) and hashed with its host to 64 bits. The
distinct document texts that hold it are counted per host; copies of one text count once. A line is *common* when
more than ``min_documents`` texts of the host and more than ``share`` of all its texts hold it. Common lines are
removed everywhere but in the row of smallest ``doc_id`` (per host and line), so one holder stays whole. A document
is *depleted*, and rejected, when more than ``depleted`` of its words are in removed lines.

Nulls: a null text has no words and fails the base rule; a null source is a host of its own; a null doc_id is kept and
sorts first. Rows that repeat as a whole get equal verdicts. Lines without a word are never counted or removed.
Counting is a partial aggregation per (host, line, text) and per (host, line), so a line in every document costs a row
per task; the join back to the lines is left to the adaptive skew split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _covered(starts: Column) -> Column:
    """Words under windows of three that begin at the sorted positions."""
    steps = F.transform(
        F.sequence(F.lit(2), F.size(starts)),
        lambda k: F.least(F.lit(3), F.element_at(starts, k) - F.element_at(starts, k - 1)),
    )
    return F.when(F.size(starts) < 2, F.size(starts) * 3).otherwise(F.aggregate(steps, F.lit(3), lambda a, b: a + b))


def _repeat_starts(marked: Column) -> Column:
    """Positions whose window hash has an equal neighbour; marked: sorted (h, i)."""

    def position(s: Column, k: Column) -> Column:
        before = (k > 0) & (F.get(marked, k - 1)["h"] == s["h"])
        after = F.get(marked, k + 1)["h"] == s["h"]
        return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), s["i"])

    return F.sort_array(F.array_compact(F.transform(marked, position)))


def repeat_words(tokens: Column) -> Column:
    """Words in windows of three words found twice or more in the text, first ones included."""

    def counted(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, among))

    def among(h: Column) -> Column:
        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(let(marked, _repeat_starts), _covered)
        )

    return let(tokens, counted)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    solid = F.filter(F.split(t, "\n"), lambda x: F.length(_without(x, BLANK_CHARS)) > 0)
    counts = let(
        words(t),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        docs.withColumns(
            {
                "_counts": counts,
                "word_chars": F.length(_without(t, BLANK_CHARS)).cast("long"),
                "n_symbols": (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long"),
                "n_dup_lines": let(solid, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            }
        )
        .withColumns({k: F.col("_counts")[k] for k in ("n_words", "n_repeat_words")})
        .withColumn("base_failed", failed)
        .drop("_counts")
    )


def _row_key(text: str, host: str) -> Column:
    return F.xxhash64("doc_id", host, text)


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text, in order."""
    flat = F.lower(F.regexp_replace(text, r"[\x20\x09\x0B\x0C\x0D]+", " "))
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))  # F.trim itself would take the index for its characters


def line_table(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """A row for each different line with a word in a row: ``_row``, ``_text``, doc_id, ``_line`` (host and line), ``_n`` (its words, all repeats)."""
    lines = F.explode(F.filter(normal_lines(F.col(text)), lambda x: x != ""))
    spread = docs.where(F.col(text).isNotNull()).select(
        _row_key(text, host).alias("_row"), F.xxhash64(text).alias("_text"), "doc_id", F.col(host).alias("_host"), lines.alias("_l")
    )
    return spread.select(
        "_row",
        "_text",
        "doc_id",
        F.xxhash64("_host").alias("_host"),
        F.xxhash64(F.xxhash64("_host"), F.col("_l")).alias("_line"),
        (F.length("_l") - F.length(F.translate("_l", " ", "")) + 1).cast("long").alias("_n"),
    )


def common_lines(lines: DataFrame, min_documents: int, share: float) -> DataFrame:
    """``_line``, texts that hold it, and ``_first``: the smallest doc_id among its holders."""
    hosts = lines.groupBy("_host", "_text").agg(F.lit(1).alias("_")).groupBy("_host").agg(F.count("*").alias("_texts"))
    held = lines.groupBy("_host", "_line", "_text").agg(F.min("doc_id").alias("_first"))
    counted = held.groupBy("_host", "_line").agg(F.count("*").alias("_held"), F.min("_first").alias("_first"))
    over = counted.where(F.col("_held") > min_documents).join(hosts, "_host")
    return over.where(F.col("_held") > share * F.col("_texts")).select("_line", "_held", "_first")


def removed_lines(docs: DataFrame, min_documents: int = 10, share: float = 0.01, text: str = "text", host: str = "source") -> DataFrame:
    """The common lines that rows lose: ``_row``, ``_line``, ``_n``. A row that repeats n times has each line n times."""
    lines = line_table(docs, text, host)
    common = common_lines(lines, min_documents, share)
    hit = lines.join(common, "_line").where(~F.col("doc_id").eqNullSafe(F.col("_first")))
    return hit.select("_row", "_line", "_n")


def line_quality(
    docs: DataFrame, min_documents: int = 10, share: float = 0.01, depleted: float = 0.8, text: str = "text", host: str = "source"
) -> DataFrame:
    """doc_id, the base counts, n_removed_words and kept, one row for each row of the input."""
    docs = docs.select("doc_id", text, host)
    base = base_counts(docs.withColumns({"_row": _row_key(text, host), "_one": F.lit(1)}), text).drop(text)
    lost = removed_lines(docs, min_documents, share, text, host).groupBy("_row").agg(F.sum("_n").alias("_lost"))
    copies = (
        docs.where(F.col(text).isNotNull()).groupBy(_row_key(text, host).alias("_row")).agg(F.count("*").alias("_copies"))
    )
    lost = lost.join(copies, "_row").select("_row", (F.col("_lost") / F.col("_copies")).cast("long").alias("n_removed_words"))
    joined = base.join(lost, "_row", "left").fillna(0, ["n_removed_words"])
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("n_removed_words") <= depleted * F.col("n_words"))).alias("kept"),
        "n_removed_words",
    )


def clean_documents(
    docs: DataFrame, min_documents: int = 10, share: float = 0.01, depleted: float = 0.8, text: str = "text", host: str = "source"
) -> DataFrame:
    """The kept rows, with their common lines taken out of the text; other columns as they are.

    Only rows that lose lines meet their lines in a join; the others pass by."""
    packed = docs.select(F.struct(*docs.columns).alias("_all"), "doc_id", text, host, _row_key(text, host).alias("_row"))
    marked = base_counts(packed, text).where(~F.col("base_failed"))
    lost = removed_lines(docs, min_documents, share, text, host).groupBy("_row").agg(F.collect_set("_line").alias("_gone"))
    joined = marked.select("_all", text, host, "n_words", "_row").join(lost, "_row", "left")
    pairs = F.arrays_zip(F.split(F.col(text), "\n").alias("raw"), normal_lines(F.col(text)).alias("flat"))
    line = lambda p: F.xxhash64(F.xxhash64(F.col(host)), p["flat"])
    stays = F.filter(pairs, lambda p: (p["flat"] == "") | ~F.array_contains("_gone", line(p)))
    left = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stays, lambda p: p["raw"]), "\n"))
    cleaned = joined.withColumn("_left", left)
    words_left = F.when(F.col("_gone").isNull(), F.col("n_words")).otherwise(F.size(words(F.col("_left"))))
    kept = cleaned.where(F.col("n_words") - words_left <= depleted * F.col("n_words"))
    return kept.select(*[F.col("_left").alias(c) if c == text else F.col("_all")[c].alias(c) for c in docs.columns])
