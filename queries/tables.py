"""Input frames of the registered queries, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.functions.extract import candidate_hashes
from exposure.functions.names import opaque_id
from exposure.operators.joins import spread
from exposure.params import Gate
from exposure.shared import folder

# The secrets in the given texts are 40 hex digits, which carry at most 4 bits per character.
LOW = Gate(min_len=32, min_entropy=3.0)

# File endings and directories given to documents, by position.
ENDINGS = (
    ".txt", ".json", ".csv", ".1pif", "_password.txt", "_export.csv", "_creds.json", ".env", "_backup.md",
)
FOLDERS = ("app", "node_modules", "docs", "build", "notes", "Library", "logs")
HISTORY_FILES = (
    ".bash_history", ".zsh_history.1", "notes.txt", ".bash_history.old", "my_history.bak", ".zhistory.2.gz",
    "fish_history", "history.txt", "x.zsh_history.7", ".bash_historyA.1x",
)
FIRST_DAY = 1_704_067_200  # 2024-01-01T00:00:00Z


def prepare(spark: SparkSession) -> None:
    """Session settings the jobs count on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def computed(df: DataFrame, *columns) -> DataFrame:
    """``df.select(*columns)`` with each column computed once, like columns of a stored table;
    filters further up would otherwise repeat their expressions."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def pick(values, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def document_dir() -> F.Column:
    return F.concat(F.lit("/home/u/"), "lang", F.lit("/"), "source", F.lit("/"), pick(FOLDERS, F.col("doc_id")))


def document_path() -> F.Column:
    return F.concat(
        document_dir(), F.lit("/f"), F.col("doc_id").cast("string"), pick(ENDINGS, F.floor(F.col("doc_id") / 3))
    )


def document_paths(spark: SparkSession, d: str) -> DataFrame:
    return computed(table(spark, d, "documents"), F.col("doc_id"), document_path().alias("path"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """``tab, id, text`` of documents and pages."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, d, "pages").select(
        F.lit("pages").alias("tab"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    return docs.unionByName(pages)


def document_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Contributions of documents: ``hash, project_id, seen_at``, a project being a directory."""
    return (
        table(spark, d, "documents")
        .select(
            opaque_id(F.concat(F.lit("/home/u/"), "lang", F.lit("/"), "source")).alias("project_id"),
            F.timestamp_seconds(F.lit(FIRST_DAY) + F.col("doc_id")).alias("seen_at"),
            F.explode_outer(candidate_hashes("text", LOW)).alias("hash"),
        )
        .filter(F.col("hash").isNotNull())
        .select("hash", "project_id", "seen_at")
    )


def page_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Contributions of pages; a project is the host."""
    return (
        table(spark, d, "pages")
        .select(
            opaque_id(F.regexp_extract("url", "^https?://([^/]*)", 1)).alias("project_id"),
            F.timestamp_seconds(F.lit(FIRST_DAY) + F.col("page_id")).alias("seen_at"),
            F.explode_outer(candidate_hashes("html", LOW)).alias("hash"),
        )
        .filter(F.col("hash").isNotNull())
        .select("hash", "project_id", "seen_at")
    )


def project_meta(spark: SparkSession, d: str) -> DataFrame:
    """Display names of document projects; Spanish ones are left out on purpose."""
    directory = F.concat(F.lit("/home/u/"), "lang", F.lit("/"), "source")
    from exposure.functions.names import display_name

    return (
        table(spark, d, "documents")
        .filter(F.col("lang") != "es")
        .select(opaque_id(directory).alias("project_id"), display_name(directory).alias("display_name"))
        .distinct()
    )


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers dealt over all cores, to have texts made of them that take long to read."""
    return spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


def customer_json() -> F.Column:
    """A JSON text of customer columns with nested keys, an array and an assignment."""
    code = F.md5("c_name")
    return F.concat(
        F.lit('{"name":"'), "c_name", F.lit('","login":{"my_Password":"'), "c_mktsegment", F.lit("-"),
        F.col("c_custkey").cast("string"), F.lit('","hint":"'), code, F.upper(code),
        F.lit('"},"tags":["'), code, "c_mktsegment", F.lit('",7,null],"env":"KEY='), F.upper(code), "c_mktsegment",
        F.lit('"}'),
    )


def customer_listing() -> F.Column:
    """A vault listing of customer columns."""
    return F.concat(
        F.lit('[{"login":{"password":"pw-'), "c_name", F.lit('","username":"u"}},{"notes":"'), "c_mktsegment",
        F.lit('"},{"notes":"12345678"},{"fields":[{"value":"'), F.md5("c_name"),
        F.lit('"},{"value":""},{"value":5}]},null,{"password":"top-'), F.col("c_nationkey").cast("string"),
        F.lit('"}]'),
    )


def customer_export() -> F.Column:
    """A vault export of customer columns; some encrypted, some empty."""
    code = F.concat(F.md5("c_name"), F.upper(F.md5("c_name")))
    items = F.when(F.col("c_nationkey") % 5 == 0, F.lit("[]")).otherwise(
        F.concat(
            F.lit('[null,"x",{"login":{"password":"'), code, F.lit('","totp":"short","username":"'), "c_name",
            F.lit('"},"notes":"see '), code, F.lit(' and more","fields":[{"value":"'), "c_mktsegment", code,
            F.lit('"},{"value":7}]}]'),
        )
    )
    encrypted = F.when(F.col("c_nationkey") % 7 == 0, "true").otherwise("false")
    shape = F.when(F.col("c_nationkey") % 2 == 0, F.lit(',"folders":[]')).otherwise("")
    return F.concat(F.lit('{"encrypted":'), encrypted, shape, F.lit(',"items":'), items, F.lit("}"))


def document_content(path: F.Column | None = None) -> F.Column:
    """What the file of a document holds: a vault export for ``.json``, otherwise the text under
    a head line that fits its ending."""
    path = document_path() if path is None else path
    quoted = F.replace(F.replace("text", F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    code = F.concat(F.md5("source"), F.upper(F.md5("source")))
    return (
        F.when(
            path.endswith(".json"),
            F.concat(
                F.lit('{"encrypted":false,"items":[{"login":{"password":"'), code, F.lit('"},"notes":"'), quoted,
                F.lit('"}]}'),
            ),
        )
        .when(path.endswith("_export.csv"), F.concat(F.lit('"username","password"\n'), "text"))
        .when(path.endswith(".csv"), F.concat(F.lit("name,login,password\na,b,"), code, F.lit("\n"), "text"))
        .when(path.endswith(".1pif"), F.concat(F.lit('"password" '), code, F.lit("\n"), "text"))
        .otherwise(F.col("text"))
    )


def document_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: ``doc_id, path, modified, size, content``."""
    content = document_content()
    return computed(
        table(spark, d, "documents"),
        F.col("doc_id"),
        document_path().alias("path"),
        F.timestamp_seconds(F.lit(FIRST_DAY) + F.col("doc_id")).alias("modified"),
        F.octet_length(content).cast("long").alias("size"),
        content.alias("content"),
    )


def document_corpus(spark: SparkSession, d: str) -> DataFrame:
    """As ``document_files`` without sizes. Contents are made of the rows that are left after filters on paths, and texts are not read where paths are all that is asked for."""
    path = F.inline(F.array(F.struct(document_path().alias("path"))))
    return table(spark, d, "documents").select("*", path).select(
        "doc_id", "path", F.timestamp_seconds(F.lit(FIRST_DAY) + F.col("doc_id")).alias("modified"), document_content(F.col("path")).alias("content")
    )


def captures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        F.col("page_id").alias("capture_id"), (F.col("page_id") % 3 != 0).alias("ok"), F.col("html").alias("output")
    )


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as history lines with a time stamp on every second line."""
    lines = table(spark, d, "documents").select(
        F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw")
    )
    stamp = F.concat(F.lit(": "), (F.lit(FIRST_DAY) + F.col("line_no")).cast("string"), F.lit(":0;"))
    return lines.select(
        "file_id", "line_no", F.when(F.col("line_no") % 2 == 1, F.concat(stamp, "raw")).otherwise(F.col("raw")).alias("line")
    )


def conversation_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("file_id"),
        F.col("turn").cast("int").alias("line_no"),
        F.concat(F.lit(": "), F.col("turn").cast("string"), F.lit(":0;"), "text").alias("line"),
    )


REGFP = "0123456789abcdef"
TAG = "exposure-scrub-receipt"


def history_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as history files with markers and receipts of several kinds.

    By ``doc_id``: no receipt; a fitting one; one for another registry; one with another tail; a
    first-version one; a marker with a fitting receipt and lines after it; a marker with a stale
    receipt.
    """
    lines = F.split("text", "\n")
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 63, F.lit(1)), 64), "\n")
    short = F.left(F.sha2(tail, 256), F.lit(16))
    count = F.size(lines).cast("string")

    def receipt(version: str, n, t, fp: str) -> F.Column:
        end = F.lit(f":regfp={fp}") if fp else F.lit("")
        return F.concat(F.lit(f"\n# {TAG}:{version}:lines="), n, F.lit(":tail="), t, end)

    marker = F.lit("\n: 1704067200:0;tool scrub-history --full")
    more = F.concat(F.lit('\nexport K="'), F.sha2("source", 256), F.lit('"'))
    kinds = F.array(
        F.lit(""),
        receipt("v2", count, short, REGFP),
        receipt("v2", count, short, "fedcba9876543210"),
        receipt("v2", count, F.lit("00000000000000aa"), REGFP),
        receipt("v1", count, short, ""),
        F.concat(marker, receipt("v2", count, short, REGFP), more),
        F.concat(marker, receipt("v2", F.lit("100000"), short, REGFP), more),
        F.concat(marker, F.lit("\nls"), more),
    )
    kind = F.element_at(kinds, (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("file_id"), F.concat("text", kind).alias("content")
    )


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Events as the clock of surfaces (``user_id``); what a surface shows is a document.

    The document shown changes with the event value, so equal content in a row occurs too.
    """
    events = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("surface_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor("value").cast("long").alias("doc_id"),
    )
    docs = table(spark, d, "documents").select("doc_id", "text")
    return events.join(docs, "doc_id", "left").select(
        "surface_id", "ts", F.coalesce("text", F.lit("")).alias("content")
    )


def named_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """As ``snapshots``, with the id of the content instead of it: ``surface_id, ts, content_id``."""
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("surface_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor("value").cast("long").alias("content_id"),
    )


def contents(spark: SparkSession, d: str) -> DataFrame:
    """What the surfaces of ``named_snapshots`` show: ``content_id, content``."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("content_id"), F.col("text").alias("content"))


def stored(df: DataFrame, prefix: str) -> DataFrame:
    """The rows written once and read back, for a query that needs them several times."""
    path = folder(df.sparkSession, prefix)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, prefix: str) -> str:
    """A new folder in the shared checkpoint directory of the session."""
    return folder(spark, prefix)
