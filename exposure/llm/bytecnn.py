"""Quality score by a convolutional network over bytes, in numpy.

Each byte is one of 512 symbols: its value, and whether the four bytes from it on also begin at most ``LAGS`` bytes before.
``FILTERS`` learned filters of ``WIDTH`` symbols are laid over every second byte of the text, and over its last ``WIDTH`` bytes. Their responses are max-pooled over chunks of ``2 * HALF``
bytes that overlap by half and cover the whole text; mean and maximum of the chunk vectors are combined by a logistic unit.
A filter is a table of weights by place and symbol, so a response is a sum of look-ups and the gradient touches only the
pooled windows.

The fit takes a bounded sample: about ``sample_rows`` labelled rows in hash order, of each a stretch of at most ``sample_chars`` characters at a hashed place; it runs on the
driver. Scoring reads whole texts and nothing but them; it works in pieces of ``PIECE`` bytes.

Nulls: a null text is empty; an empty text is padded to one window and scored; rows of null label aren't learned from; of several labels of a doc_id each different one
counts, of several texts the least. Without labels of both kinds every score is the share of label 1 (0.5 without any). Rows that repeat get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm.blocks import stretch, utf8

WIDTH, STRIDE, FILTERS, HALF, LAGS = 8, 2, 16, 256, 24
PIECE = 1 << 16
OUT = "doc_id long, held_out boolean, score double, predicted int"
Model = dict[str, np.ndarray]


def symbols(data: np.ndarray) -> np.ndarray:
    """Symbol of each byte, for a text padded with zeros to at least one window."""
    n = max(len(data), WIDTH)
    padded = np.zeros(n + 3, np.uint8)
    padded[: len(data)] = data
    four = np.zeros(n, np.uint32)
    for k in range(4):
        four |= padded[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    again = np.zeros(n, bool)
    for lag in range(1, LAGS + 1):
        again[lag:] |= four[lag:] == four[:-lag]
    again[len(data) :] = False
    return padded[:n].astype(np.int16) + np.int16(256) * again


def halves(s: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each half chunk, and the window that gave it."""
    last = len(s) - WIDTH
    even, windows = last // STRIDE + 1, -(-last // STRIDE) + 1
    out = np.zeros((windows, FILTERS), np.float32)
    for j in range(WIDTH):
        out[:even] += model["filters"][j].take(s[j : j + STRIDE * (even - 1) + 1 : STRIDE], axis=0)
        out[even:] += model["filters"][j][s[last + j]]
    step = HALF // STRIDE
    best = np.maximum.reduceat(out, np.arange(0, windows, step), axis=0)
    return best, out


def chunks(half: np.ndarray) -> np.ndarray:
    return half if len(half) == 1 else np.maximum(half[:-1], half[1:])


def pooled(data: np.ndarray, model: Model) -> np.ndarray:
    """Mean and maximum over the chunks of a whole text."""
    parts = []
    for lo in range(0, max(len(data), 1), PIECE):
        before = min(lo, LAGS + STRIDE)
        s = symbols(data[lo - before : lo + PIECE + WIDTH - STRIDE + 3])
        tail = len(s) if lo + PIECE >= len(data) else before + PIECE + WIDTH - STRIDE
        # The windows of the piece before end WIDTH - STRIDE bytes behind its end.
        if tail - before > WIDTH - STRIDE or not parts:
            parts.append(halves(s[before:tail] if tail - before >= WIDTH else s[-WIDTH:], model)[0])
    c = np.maximum(chunks(np.concatenate(parts)) + model["offset"], 0)
    return np.concatenate([c.mean(axis=0), c.max(axis=0)])


def probability(vector: np.ndarray, model: Model) -> float:
    return float(1 / (1 + np.exp(-np.clip(vector @ model["weights"] + model["bias"][0], -30, 30))))


def fit(texts: list[bytes], labels: list[int], rounds: int = 10, rate: float = 0.05, seed: int = 3) -> Model:
    """Stochastic gradients with per-parameter steps; classes weigh the same."""
    rng = np.random.default_rng(seed)
    model = {
        "filters": rng.normal(0, 0.1, (WIDTH, 512, FILTERS)).astype(np.float32),
        "offset": np.zeros(FILTERS, np.float32),
        "weights": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "bias": np.zeros(1, np.float32),
    }
    ones = sum(labels)
    if not 0 < ones < len(labels):
        share = (ones / len(labels)) if labels else 0.5
        model["weights"][:] = 0
        model["bias"][:] = np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30)
        return model
    seen = {k: np.full(v.shape, 1e-2, np.float32) for k, v in model.items()}
    read = [symbols(np.frombuffer(t, np.uint8)) for t in texts]
    heft = np.array([0.5 * len(labels) / (ones if y else len(labels) - ones) for y in labels])
    step = HALF // STRIDE

    def move(name: str, at, slope: np.ndarray) -> None:
        seen[name][at] += slope**2
        model[name][at] -= rate * slope / np.sqrt(seen[name][at])

    for _ in range(rounds):
        for d in rng.permutation(len(read)):
            s = read[d]
            half, out = halves(s, model)
            c = chunks(half) + model["offset"]
            on = np.maximum(c, 0)
            top = on.argmax(axis=0)
            vector = np.concatenate([on.mean(axis=0), on.max(axis=0)])
            error = np.float32((probability(vector, model) - labels[d]) * heft[d])
            back = np.tile(error * model["weights"][:FILTERS] / len(on), (len(on), 1))
            back[top, np.arange(FILTERS)] += error * model["weights"][FILTERS:]
            back *= c > 0
            move("weights", slice(None), error * vector + 1e-4 * model["weights"])
            move("bias", slice(None), np.full(1, error, np.float32))
            move("offset", slice(None), back.sum(axis=0))
            for k in np.flatnonzero(np.abs(back).sum(axis=1) > 1e-6).tolist():
                window = np.minimum((out[k * step : (k + 2) * step].argmax(axis=0) + k * step) * STRIDE, len(s) - WIDTH)
                for j in range(WIDTH):
                    move("filters", (j, s[window + j], np.arange(FILTERS)), back[k])
    return model


def sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str, sample_rows: int, sample_chars: int) -> tuple[list[bytes], list[int]]:
    rows = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where(learn & F.col("_label").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.distinct()
    spot = F.xxhash64(F.lit("sample"), "doc_id").cast("double") + 2.0**63
    kinds = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if not kinds:
        return [], []
    # As many of each label, where there are.
    share = F.create_map(*[F.lit(x) for k, n in kinds.items() for x in (k, 2.0**64 * min(1.0, sample_rows / len(kinds) / n))])
    picked = rows.where(spot < share[F.col("_label")])
    texts = docs.select(F.col("doc_id"), stretch(F.coalesce("text", F.lit("")), sample_chars).alias("text"))
    # The sample has about sample_rows rows of twelve bytes, whatever the size of the tables.
    found = texts.join(F.broadcast(picked), "doc_id").groupBy(spot.alias("at"), "_label").agg(F.min("text").alias("text")).collect()
    found = sorted(found, key=lambda r: (r["at"], r["text"], r["_label"]))
    return [r["text"].encode() for r in found], [int(r["_label"] == 1) for r in found]


def score(docs: DataFrame, model: Model, held_out: Column, threshold: float = 0.3) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            scores = np.array([probability(pooled(data[lo:hi], model), model) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())])
            arrays = [batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out")).mapInArrow(run, OUT)


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_chars: int = 3000) -> DataFrame:
    """Learn labels.quality from rows whose crc32 remainder by 5 isn't 0, and score all rows of ``docs (doc_id, text)``."""
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    texts, marks = sample(docs, labels, remainder != 0, "quality", sample_rows, sample_chars)
    return score(docs, fit(texts, marks), remainder == 0)
