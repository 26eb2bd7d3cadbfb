"""Language identification by compression.

Texts are read in lower case with everything but letters as blanks. For each language a raw-content zstandard dictionary is made of learning texts; a text is encoded with each and the
smallest result names the language. Ties go to the language with more learning rows, then by name. The posterior of the code lengths (a
byte is eight bits) is the score. A text is *rejected*, its language still being the best guess, where the runner-up is less than
``margin_bytes`` or ``margin_share`` larger.

The fit takes a bounded sample: per language about ``sample_rows`` learning rows in hash order, of each a stretch of at most ``sample_chars`` characters at a hashed place,
up to ``dictionary_bytes``; equal rows are taken once. Languages are a closed set of labels, whose dictionaries together go to every task.
Prediction reads whole texts and nothing but them.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows of null lang are never learned from; a null doc_id
counts as the text "". Without any learning row every text is ``und``. Rows that repeat get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm.blocks import stretch, utf8

LEVEL = 3
LETTER = re.compile(r"[^\W\d_]")
OTHERS = re.compile(r"[\W\d_]+")
OUT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def letters(text: str) -> bytes:
    return OTHERS.sub(" ", text.lower()).encode()


def remainder(by: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by


def dictionaries(
    docs: DataFrame, learn: Column, sample_rows: int = 400, sample_chars: int = 2000, dictionary_bytes: int = 1 << 17
) -> list[tuple[str, bytes]]:
    """Language and dictionary content, most frequent language first."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    spot = F.xxhash64(F.lit("sample"), "doc_id", "text")
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 2.0**64 * min(1.0, sample_rows / n))])
    picked = rows.where(spot.cast("double") + 2.0**63 < share[F.col("lang")])
    sample = picked.select("lang", spot.alias("_at"), stretch(F.col("text"), sample_chars).alias("text")).dropDuplicates(["_at"]).collect()
    content: dict[str, bytes] = dict.fromkeys(counts, b"")
    for r in sorted(sample, key=lambda r: (r["_at"], r["text"]), reverse=True):
        content[r["lang"]] = (content[r["lang"]] + b" " + letters(r["text"]))[-dictionary_bytes:]
    return [(lang, content[lang]) for lang in sorted(counts, key=lambda x: (-counts[x], x))]


def predict(docs: DataFrame, known: list[tuple[str, bytes]], held_out: Column, margin_bytes: int = 2, margin_share: float = 0.005) -> DataFrame:
    names = [lang for lang, _ in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coders = []
        for _, content in known:
            raw = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False))
        for batch in batches:
            data, at = utf8(batch.column(1))
            data, at, out = data.tobytes(), at.tolist(), []
            for lo, hi in zip(at[:-1], at[1:]):
                text = data[lo:hi].decode("utf-8", "replace")
                if not coders or not LETTER.search(text):
                    out.append(("und", 0.0, True))
                    continue
                text = letters(text)
                sizes = np.array([len(c.compress(text)) for c in coders])
                best = int(sizes.argmin())
                over = sizes - sizes[best]
                rest = np.delete(over, best).min() if len(sizes) > 1 else len(text)
                out.append((names[best], float(1 / np.exp2(-8.0 * np.minimum(over, 100)).sum()), bool(rest < max(margin_bytes, margin_share * sizes[best]))))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out")).mapInArrow(run, OUT)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32 remainder by 3 isn't 1, and predict all rows of ``docs (doc_id, text, lang)``."""
    held_out = remainder(3) == 1
    return predict(docs, dictionaries(docs, ~held_out), held_out)
