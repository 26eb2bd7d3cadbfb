"""Residue detection on files (``path, modified, size, content``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions.extract import candidate_hashes, high_entropy_hashes, high_entropy_hits
from exposure.functions.globs import any_of, suspicious_format
from exposure.functions.names import basename, masked_location, opaque_id
from exposure.functions.text import entropy, let, may_pass, parse_json
from exposure.operators.joins import join_by_hash, keep_where
from exposure.operators.known import count_known
from exposure.params import GENERIC_MIN_HITS, Gate

# Leading bytes (hex) of files that are not text.
BINARY_MAGIC = ("00", "89504E47", "FFD8", "504B", "53514C697465")
HEADER_BYTES = 16
MAX_HEADER_NULS = 2

# Names of the formats.
FORMAT_VAULT_JSON = "bitwarden_json"
FORMAT_VAULT_CSV = "bitwarden_csv"
FORMAT_DASHLANE = "dashlane"
FORMAT_1PIF = "onepassword_1pif"
FORMAT_GENERIC = "generic_high_entropy"
FORMAT_NAME = "suspicious_filename"


def is_text_file(size: Column, content: Column, max_bytes: int | None = None) -> Column:
    """Not empty, and a header (the first bytes there are) that does not look binary.

    ``max_bytes`` leaves out larger files; it is off by default. ``oversized`` counts what it leaves out.
    """
    header = F.hex(F.substring(content, 1, HEADER_BYTES))
    nuls = F.size(F.filter(F.regexp_extract_all(header, F.lit(".."), F.lit(0)), lambda b: b == "00"))
    magic = any_of(header.startswith(m) for m in BINARY_MAGIC)
    sized = size >= 1 if max_bytes is None else size.between(1, max_bytes)
    return sized & ~magic & (nuls <= MAX_HEADER_NULS)


def oversized(files: DataFrame, max_bytes: int) -> DataFrame:
    """``error``: one row for each file that a size limit leaves out."""
    return files.filter(F.col("size") > max_bytes).select(
        F.concat(F.lit("file too large: "), opaque_id(F.col("path"))).alias("error")
    )


# --- JSON access --------------------------------------------------------------------------------


def json_text(v: Column, path: str) -> Column:
    """The string at a path of a variant; NULL where it is missing or not a string."""
    return let(
        F.try_variant_get(v, path, "variant"),
        lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")),
    )


def json_items(v: Column, path: str = "$") -> Column:
    """The elements of an array of a variant, empty where there is none."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _scored(value: Column) -> Column:
    passes = (F.octet_length(value) >= 8) & may_pass(value, Gate(8, 4.0)) & (entropy(value) >= 4.0)
    return F.when(passes, 1).otherwise(0)


def _item_hits(item: Column) -> Column:
    login = [_scored(json_text(item, f"$.login.{k}")) for k in ("password", "totp", "username")]
    fields = F.aggregate(
        json_items(item, "$.fields"), F.lit(0), lambda acc, f: acc + _scored(json_text(f, "$.value"))
    )
    notes = F.coalesce(
        let(json_text(item, "$.notes"), lambda n: F.when(n.isNotNull(), high_entropy_hits(n, 16, 4.0))), F.lit(0)
    )
    return login[0] + login[1] + login[2] + fields + notes


def vault_json(content: Column) -> Column:
    """``struct<hits,is_export>``: entropy hits of a vault export in JSON."""

    def detect(v: Column) -> Column:
        encrypted = F.coalesce(
            (F.schema_of_variant(F.try_variant_get(v, "$.encrypted", "variant")) == "BOOLEAN")
            & F.try_variant_get(v, "$.encrypted", "boolean"),
            F.lit(False),
        )
        shaped = (
            F.try_variant_get(v, "$.folders", "variant").isNotNull()
            | F.try_variant_get(v, "$.collections", "variant").isNotNull()
        )
        return let(
            json_items(v, "$.items"),
            lambda items: F.when(encrypted, _hits(F.lit(0), F.lit(False)))
            .when(F.size(items) == 0, _hits(F.lit(0), shaped))
            .otherwise(_hits(F.aggregate(items, F.lit(0), lambda a, i: a + _item_hits(i)), F.lit(True))),
        )

    looks = content.rlike(r"^[ \t\r\n]*+\{")
    parsed = F.when(looks, parse_json(content))
    return let(parsed, lambda v: F.when(v.isNotNull(), detect(v)).otherwise(_hits(F.lit(0), F.lit(False))))


def _hits(hits: Column, is_export: Column) -> Column:
    return F.struct(hits.cast("int").alias("hits"), is_export.alias("is_export"))


def _score(content: Column) -> Column:
    return high_entropy_hits(content, 12, 4.0)


def vault_csv(content: Column, hits: Column | None = None) -> Column:
    lower = F.lower(content)
    shaped = F.contains(lower, F.lit("password")) & F.contains(lower, F.lit("login"))
    h = _score(content) if hits is None else hits
    return F.when(shaped, _hits(h, (h > 0) | F.contains(lower, F.lit("bitwarden")))).otherwise(
        _hits(F.lit(0), F.lit(False))
    )


def dashlane(content: Column, hits: Column | None = None) -> Column:
    lower = F.lower(content)
    named = F.contains(lower, F.lit("dashlane"))
    quoted = F.contains(lower, F.lit('"username"')) & F.contains(lower, F.lit('"password"'))
    h = _score(content) if hits is None else hits
    return F.when(named | quoted, _hits(h, (h > 0) | named)).otherwise(_hits(F.lit(0), F.lit(False)))


def onepassword(content: Column, hits: Column | None = None) -> Column:
    shaped = (
        F.contains(content, F.lit(".1pif"))
        | F.contains(F.lower(content), F.lit("onepassword"))
        | F.contains(content, F.lit('"password"'))
    )
    h = _score(content) if hits is None else hits
    return F.when(shaped, _hits(h, h > 0)).otherwise(_hits(F.lit(0), F.lit(False)))


# --- scoring ------------------------------------------------------------------------------------


def detect_format(content: Column, name: Column) -> Column:
    """``struct<format,hits>``; the format is NULL for a file of no interest."""
    lower = F.lower(name)
    hinted = suspicious_format(name)

    def found(d: Column) -> Column:
        return d.is_export | (d.hits > 0)

    def result(fmt, hits: Column) -> Column:
        fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
        return F.struct(fmt.cast("string").alias("format"), hits.cast("int").alias("hits"))

    def choose(score: Column) -> Column:
        generic = result(F.when(score >= GENERIC_MIN_HITS, FORMAT_GENERIC).otherwise(hinted), score)

        def or_else(fmt: str, detected: Column, other: Column) -> Column:
            return let(detected, lambda d: F.when(found(d), result(fmt, d.hits)).otherwise(other))

        by_csv = or_else(
            FORMAT_VAULT_CSV, vault_csv(content, score),
            or_else(FORMAT_DASHLANE, dashlane(content, score), generic),
        )
        return (
            F.when(lower.endswith(".json"), or_else(FORMAT_VAULT_JSON, vault_json(content), generic))
            .when(lower.endswith(".csv"), by_csv)
            .when(lower.endswith(".1pif"), or_else(FORMAT_1PIF, onepassword(content, score), generic))
            .otherwise(generic)
        )

    return let(_score(content), choose)


def confidence(fmt: Column, hits: Column, known: Column) -> Column:
    specific = ~fmt.isin(FORMAT_GENERIC, FORMAT_NAME)
    return (
        F.when((hits == 0) & (known == 0), "low").when((known > 0) | specific, "high").otherwise("medium")
    )


def findings(
    files: DataFrame,
    registry: DataFrame,
    home: str = "",
    gate: Gate = Gate(),
    id_cols: tuple[str, ...] = ("path",),
    known_always: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """Score examined files: ``location, basename, last_mod, format, confidence, known_matches,
    entropy_hits, size`` plus the id columns.

    One pass over the contents: format, hits and candidate hashes are taken from each file, then
    only narrow rows are shuffled. ``known_always`` also reports files without any format when
    they hold a known secret; by default these are dropped before the lookup.
    """
    name = basename(F.col("path"))
    text = F.col("content").cast("string")
    gated = files.filter(is_text_file(F.col("size"), F.col("content").cast("binary"), max_bytes))
    detected = gated.select(
        *id_cols,
        *[c for c in ("path", "modified", "size") if c not in id_cols],
        text.alias("_text"),
        detect_format(text, name).alias("_d"),
    )
    wanted = F.lit(True) if known_always else F.col("_d.format").isNotNull()
    scored = keep_where(
        detected.select(
            *[c for c in detected.columns if c not in ("_text", "_d")],
            F.col("_d.format").alias("format"),
            F.col("_d.hits").alias("entropy_hits"),
            F.when(wanted, candidate_hashes("_text", gate)).alias("_hashes"),
        ),
        F.col("_hashes").isNotNull(),
    )
    counted = count_known(scored, list(id_cols), "_hashes", registry)
    if known_always:
        counted = counted.filter(F.col("format").isNotNull() | (F.col("known") > 0)).withColumn(
            "format", F.coalesce("format", F.lit(FORMAT_GENERIC))
        )
    path = F.col("path")
    return counted.select(
        *id_cols,
        masked_location(path, home).alias("location"),
        basename(path).alias("basename"),
        F.date_trunc("second", "modified").alias("last_mod"),
        "format",
        confidence(F.col("format"), F.col("entropy_hits"), F.col("known")).alias("confidence"),
        F.col("known").cast("int").alias("known_matches"),
        "entropy_hits",
        "size",
    )


# --- files in parts -----------------------------------------------------------------------------

# What the formats of text exports are told by, as it is or with all letters in lower case. No mark goes over a line end.
_MARKS = (
    ("password", True), ("login", True), ("bitwarden", True), ("dashlane", True), ('"username"', True), ('"password"', True),
    ("onepassword", True), (".1pif", False), ('"password"', False),
)


def _mark_bits(text: Column) -> Column:
    """One bit for each mark that the text holds."""
    held = [F.when(F.contains(F.lower(text) if low else text, F.lit(m)), 1 << i).otherwise(0) for i, (m, low) in enumerate(_MARKS)]
    total = held[0]
    for h in held[1:]:
        total = total + h
    return total


def format_by_marks(name: Column, hits: Column, marks: Column) -> Column:
    """The format of a file that is no JSON, from its name, its distinct hits and its marks; NULL for one of no interest."""

    def has(mark: str, low: bool = True) -> Column:
        return marks.bitwiseAND(F.lit(1 << _MARKS.index((mark, low)))) != 0

    lower, some = F.lower(name), hits > 0
    generic = F.when(hits >= GENERIC_MIN_HITS, FORMAT_GENERIC).otherwise(suspicious_format(name))
    vault = has("password") & has("login") & (some | has("bitwarden"))
    dash = has("dashlane") | (has('"username"') & has('"password"') & some)
    one = (has(".1pif", False) | has("onepassword") | has('"password"', False)) & some
    return (
        F.when(lower.endswith(".csv") & vault, FORMAT_VAULT_CSV)
        .when(lower.endswith(".csv") & dash, FORMAT_DASHLANE)
        .when(lower.endswith(".1pif") & one, FORMAT_1PIF)
        .otherwise(generic)
    )


def findings_of_parts(
    parts: DataFrame,
    registry: DataFrame,
    home: str = "",
    gate: Gate = Gate(),
    id_cols: tuple[str, ...] = ("path",),
    known_always: bool = False,
) -> DataFrame:
    """As ``findings``, for files that may come in parts (``part_no, whole, error`` beside ``path, modified, size, content``).

    A file has one finding, whatever number of parts: its binary gate is that of its first part, its hits and known values are the distinct
    ones of all parts, and its format is decided on what all parts hold together. One pass over the contents; hashes and narrow rows are
    united. What could not be read is a row with ``error`` and no format.
    """
    name, path = basename(F.col("path")), F.col("path")
    content = F.col("content").cast("binary")
    text = F.col("content").cast("string")
    first = F.when(F.col("part_no") == 0, is_text_file(F.col("size"), content))
    looked = F.col("whole") & first
    rest = [c for c in ("path", "modified", "size") if c not in id_cols]
    detected = parts.select(
        *id_cols, *rest, "error", "part_no", "whole", first.alias("_text_file"), text.alias("_text"), F.when(looked, detect_format(text, name)).alias("_d"),
    )
    wanted = F.lit(True) if known_always else F.col("_d.format").isNotNull()

    def tagged(kind: str, hashes: Column) -> Column:
        return F.transform(hashes, lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("hash")))

    cut = ~F.col("whole") & F.col("error").isNull()
    hashes = (
        F.when(F.col("whole") & F.col("_text_file") & wanted, tagged("known", candidate_hashes("_text", gate)))
        .when(cut, F.concat(tagged("known", candidate_hashes("_text", gate, False)), tagged("hit", high_entropy_hashes("_text", 12, 4.0))))
        .when(F.col("error").isNotNull(), F.array().cast("array<struct<kind:string,hash:string>>"))
    )
    scored = keep_where(
        detected.select(
            *id_cols, *rest, "error", "_text_file", "whole", F.col("_d.format").alias("_format"), F.col("_d.hits").alias("_hits"),
            F.when(cut, _mark_bits(F.col("_text"))).otherwise(0).alias("_marks"), hashes.alias("_hashes"),
        ),
        F.col("_hashes").isNotNull(),
    )
    file = [*id_cols, *rest]
    facts = {"error": F.min, "_text_file": F.bool_or, "whole": F.bool_and, "_format": F.max, "_hits": F.max, "_marks": F.bit_or}
    rows = scored.select(*file, *facts, F.explode_outer("_hashes").alias("_h")).select(*file, *facts, "_h.kind", "_h.hash")
    looked_up = rows.withColumn("_key", F.when(F.col("kind") == "known", F.col("hash")))
    flagged = join_by_hash(looked_up, registry.select("hash", F.lit(1).alias("_known")).withColumnRenamed("hash", "_key"), [*id_cols, "hash"], key="_key")
    # Parts may share values: each counts once in a file.
    once = flagged.groupBy(*file, "kind", "hash").agg(*[f(c).alias(c) for c, f in facts.items()], F.max("_known").alias("_known"))
    united = once.groupBy(*file).agg(
        *[f(c).alias(c) for c, f in facts.items()], F.count("_known").alias("known"), F.count_if(F.col("kind") == "hit").alias("_found")
    )
    hits = F.when(F.col("whole"), F.col("_hits")).otherwise(F.col("_found").cast("int"))
    named = F.when(F.col("whole"), F.col("_format")).otherwise(format_by_marks(basename(path), F.col("_found"), F.col("_marks")))
    counted = united.withColumns({"entropy_hits": hits, "format": named})
    if known_always:
        known_too = F.when((F.col("known") > 0) & F.col("error").isNull(), FORMAT_GENERIC)
        counted = counted.withColumn("format", F.coalesce("format", known_too))
    counted = counted.filter(F.col("error").isNotNull() | (F.col("_text_file") & F.col("format").isNotNull()))
    return counted.select(
        *id_cols,
        masked_location(path, home).alias("location"),
        basename(path).alias("basename"),
        F.date_trunc("second", "modified").alias("last_mod"),
        "format",
        F.when(F.col("error").isNull(), confidence(F.col("format"), F.col("entropy_hits"), F.col("known"))).alias("confidence"),
        F.when(F.col("error").isNull(), F.col("known").cast("int")).alias("known_matches"),
        "entropy_hits",
        "size",
        "error",
    )


def summary(found: DataFrame, order_by: list[str], sample: int = 3) -> DataFrame:
    """One row: number of findings and the first few locations in scan order."""
    first = found.orderBy(*order_by).limit(sample)
    ordered = F.array_sort(F.collect_list(F.struct(*order_by, "location")))
    count = found.agg(F.count(F.lit(1)).alias("findings")).withColumn("sample", F.lit(None).cast("array<string>"))
    named = first.agg(F.transform(ordered, lambda s: s.location).alias("sample"))
    both = count.unionByName(named.withColumn("findings", F.lit(None).cast("long")))
    return both.agg(F.max("findings").alias("findings"), F.first("sample", True).alias("sample"))
