"""Personal data by rules and a skip-chain conditional random field.

Rules find e-mail addresses, IP addresses, card and phone numbers. The field runs over the tokens of a text that hold a digit
or an @ (also one spelled ``[at]``): neighbours are linked in a chain, and all mentions of similar content share a hub, however far apart they are: two
mentions with a hub are as two with a skip edge. Similar are equal tokens in lower case; addresses whose @ and dots are spelled in brackets;
four numbers of an IP address that dots or hyphens part; and numbers, whole or in groups that blanks, dots, brackets and hyphens part, that agree in
their last ``LAST`` digits (those of ``LEAST`` digits and more; leading zeros don't count). Shorter numbers are no content. Loopy message passing until messages settle then makes labels
agree across the text, and tokens labelled with a marginal of at least ``certain`` that no rule found are added. Rule spans always stay.

The rules are a noisy witness of the labels: they report a label that isn't there with probability ``FALSE`` and overlook a mention with
probability ``ESCAPE``. So nothing that spells a rule out is a feature: token scores are learned from coarse form and neighbours, for labels that the rules gave, and
are at most ``OWN`` either way, less than an overlooked mention needs; it takes a hub with a mention that a rule found. What the overlooked mentions of a content have of
their own counts as one observation, however many they are, as a rule overlooks all that are written alike. Chain and skip potentials are penalties on different labels, from
smoothed counts of label pairs; of a content that a rule found somewhere, mentions that it overlooked are of unknown label and not counted. So that mentions of a content differ
is next to never counted, and the skip penalty is mostly its prior.

The sample is bounded: about ``sample_rows`` texts with a digit or @, of each a stretch of at most ``sample_chars`` at a hashed place. Tagging reads whole texts.

Nulls: a null text is empty; texts without a digit or @ have no spans. Rows that repeat get equal results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.blocks import stretch

KINDS = ("email", "ip", "card", "phone")
SPACE = 1 << 14
LABELS = 1 + len(KINDS)
ROUNDS, SETTLED = 200, 1e-3
FALSE, ESCAPE, OWN, CHAIN, SKIP = 1e-6, 0.1, 2.0, 1.0, 10.0
LEAST, LAST = 7, 9
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
Span = tuple[int, int, int]

DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S*(?:[0-9@]|[\[(]at[\])])\S*")
SIGN, DOT = re.compile(r"[\[(](?:at|@)[\])]"), re.compile(r"[\[(](?:dot|\.)[\])]")
QUAD = re.compile(r"[0-9]{1,3}(?:[.-][0-9]{1,3}){3}")
NUMBER = re.compile(r"[0-9().+-]+")
BETWEEN = re.compile(r"[ ().+-]{1,4}")
EDGES = "\"'()[]{}<>,.;:!?|*#$%&"
ADDRESS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
RULES = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: int, text: str) -> bool:
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    if kind == 2:
        digits = digits_of(text)
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 9 <= len(digits_of(text)) <= 15


def worth_reading(text: str) -> bool:
    return "@" in text or DIGIT.search(text) is not None


def emails(text: str) -> Iterator[re.Match]:
    """The matches of the first rule. One needs an @, so the search starts at the run of address letters before each."""
    at = 0
    while (sign := text.find("@", at)) >= 0:
        first = sign
        while first > at and text[first - 1] in ADDRESS:
            first -= 1
        found = RULES[0].match(text, first) if first < sign else None
        if found:
            yield found
        at = found.end() if found else sign + 1


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), by kind and start."""
    found = [(0, m.start(), m.end()) for m in emails(text)]
    for kind in (1, 2, 3):
        if kind != 3 or "+" in text:
            found += [(kind, m.start(), m.end()) for m in RULES[kind].finditer(text) if valid(kind, m[0])]
    return found


def tokens(text: str) -> list[tuple[int, int]]:
    out = []
    for m in TOKEN.finditer(text):
        lo = m.start() + len(m[0]) - len(m[0].lstrip(EDGES))
        hi = m.start() + len(m[0].rstrip(EDGES))
        if lo < hi:
            out.append((lo, hi))
    return out


def form(token: str) -> str:
    """What a token is made of, too coarse to tell whether a rule holds."""
    digits = len(digits_of(token))
    return f"{'@' in plainly(token)}{min(digits, 4)}{any(c.isalpha() for c in token)}"


def plainly(token: str) -> str:
    """In lower case, with @ and dots that are spelled in brackets as such."""
    return DOT.sub(".", SIGN.sub("@", token.lower()))


def features(text: str, lo: int, hi: int) -> list[int]:
    before, after = text[max(0, lo - 24) : lo].split()[-1:] or [""], text[hi : hi + 24].split()[:1] or [""]
    named = [
        "s" + form(text[lo:hi]),
        "b" + (form(before[0]) if DIGIT.search(before[0]) else before[0].lower()[-8:]),
        "f" + (form(after[0]) if DIGIT.search(after[0]) else "a"),
    ]
    return [zlib.crc32(x.encode()) % SPACE for x in named]


def content(token: str) -> str | None:
    """What mentions of one thing have in common; none for short numbers."""
    said, digits = plainly(token), digits_of(token).lstrip("0")
    quad = said.replace("-", ".")
    if QUAD.fullmatch(said) and valid(1, quad):
        return quad
    if NUMBER.fullmatch(token):
        return digits[-LAST:] if len(digits) >= LEAST else None
    return said


def mentions(text: str, spots: list[tuple[int, int]]) -> list[list[list[int]]]:
    """For each content that is found again its mentions, each the list of its tokens."""
    held: dict[str, list[list[int]]] = {}
    run: list[list[int]] = []
    plain = False
    for i, (lo, hi) in enumerate(spots):
        token = text[lo:hi]
        said = content(token)
        before, plain = plain, NUMBER.fullmatch(token) is not None and "." not in (said or "")
        if plain and before and token[0] != "+" and BETWEEN.fullmatch(text, spots[i - 1][1], lo):
            run[-1].append(i)
        else:
            run.append([i])
        if said is not None:
            held.setdefault(said, []).append([i])
    for part in run:
        digits = digits_of(text[spots[part[0]][0] : spots[part[-1]][1]]).lstrip("0") if len(part) > 1 else ""
        if LEAST <= len(digits) <= 19:
            held.setdefault(digits[-LAST:], []).append(part)
    return [sorted(m) for m in held.values() if len(m) > 1]


def links(text: str, spots: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[list[list[int]]]]:
    """Chain edges, and mentions that share a hub."""
    chain = [(i, i + 1) for i in range(len(spots) - 1) if text[spots[i][1] : spots[i + 1][0]] in (" ", "-", ") ", ", ", ". ")]
    return chain, mentions(text, spots)


def half(pair: np.ndarray) -> np.ndarray:
    """The potential of a mention and its hub: two of them, summed over the hub, are that of two mentions."""
    value, vector = np.linalg.eigh(np.exp((pair + pair.T) / 2))
    root = (vector * np.sqrt(np.maximum(value, 0))) @ vector.T
    return np.log(np.maximum(root, 1e-7 * root.max()))


def labelled(spots: list[tuple[int, int]], spans: list[Span]) -> np.ndarray:
    """The label of each token: the first kind with a span that overlaps it."""
    out = np.zeros(len(spots), int)
    starts = np.array([lo for lo, _ in spots])
    ends = np.array([hi for _, hi in spots])
    for kind, lo, hi in reversed(spans):
        out[np.searchsorted(ends, lo, "right") : np.searchsorted(starts, hi, "left")] = kind + 1
    return out


def fit(texts: list[str], rounds: int = 5, seed: int = 5) -> dict[str, np.ndarray]:
    rows, marks = [], []
    # Before anything is seen, mentions of one content are held to agree.
    pairs = {"chain": np.ones((LABELS, LABELS)), "skip": 1e-4 + 2 * np.eye(LABELS)}
    for text in texts:
        spots = tokens(text)
        y = labelled(spots, base_spans(text))
        rows += [features(text, lo, hi) for lo, hi in spots]
        marks += y.tolist()
        chain, groups = links(text, spots)
        skip = []
        for group in groups:
            known = [m for m in group if y[m[0]]] or group
            skip += [(m[0], n[0]) for m, n in zip(known, known[1:])]
        for name, edges in zip(pairs, (chain, skip)):
            for i, j in edges:
                pairs[name][y[i], y[j]] += 1
                pairs[name][y[j], y[i]] += 1
    weights = np.zeros((SPACE, LABELS))
    seen = np.full((SPACE, LABELS), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            at = rows[k]
            p = np.exp(weights[at].sum(axis=0))
            slope = p / p.sum()
            slope[marks[k]] -= 1
            seen[at] += slope**2
            weights[at] -= 0.2 * slope / np.sqrt(seen[at])
    return {"token": weights, "chain": penalty(pairs["chain"], CHAIN), "skip": penalty(pairs["skip"], SKIP)}


def penalty(counts: np.ndarray, most: float) -> np.ndarray:
    """How much rarer a pair of different labels is than pairs of either; equal labels are free, so that none is favoured by itself."""
    own = np.log(np.diag(counts))
    return np.clip(np.log(counts) - (own[:, None] + own) / 2, -most, 0)


def witnessed(found: np.ndarray) -> np.ndarray:
    """Log-likelihood of what the rules say of each token (0: nothing), by its label."""
    out = np.log(np.full((LABELS, LABELS), FALSE) + np.eye(LABELS))
    out[0] = np.log(ESCAPE)
    out[0, 0] = 0
    return out[found]


def own_scores(text: str, spots: list[tuple[int, int]], found: np.ndarray, groups: list[list[list[int]]], model: dict[str, np.ndarray]) -> np.ndarray:
    learned = np.array([model["token"][features(text, lo, hi)].sum(axis=0) for lo, hi in spots])
    alike = np.ones(len(spots))
    for group in groups:
        missed = [i for mention in group if not found[mention].any() for i in mention]
        alike[missed] = np.maximum(alike[missed], len(missed))
    return (np.clip(learned - learned[:, :1], -OWN, OWN) + witnessed(found)) / alike[:, None]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(text: str, spots: list[tuple[int, int]], found: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Label probabilities of the tokens after loopy message passing; ``found`` are the labels of the rules."""
    chain, groups = links(text, spots)
    own = own_scores(text, spots, found, groups, model)
    skip = [(i, len(spots) + hub) for hub, group in enumerate(groups) for mention in group for i in mention]
    ends = np.array(chain + skip, int).reshape(-1, 2)
    own = np.concatenate([own, np.zeros((len(groups), LABELS))])
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    pair = np.concatenate([np.repeat(p[None], len(e), axis=0) for p, e in ((model["chain"], chain), (half(model["skip"]), skip))])
    pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.roll(np.arange(2 * len(ends)), len(ends))
    sent = np.zeros((2 * len(ends), LABELS))
    belief = own.copy()
    for _ in range(ROUNDS if len(ends) else 0):
        new = log_sum((belief[source] - sent[back])[:, :, None] + pair, 1)
        step = new - log_sum(new, 1)[:, None] - sent
        sent = sent + 0.5 * step
        belief = own.copy()
        np.add.at(belief, target, sent)
        if np.abs(step).max() < SETTLED:
            break
    return np.exp(belief - log_sum(belief, 1)[:, None])[: len(spots)]


def added_spans(text: str, base: list[Span], model: dict[str, np.ndarray], certain: float = 0.95) -> list[Span]:
    spots = tokens(text)
    found = labelled(spots, base)
    free = found == 0
    # Without a mention that a rule found, what a token has of its own can't be certain.
    if free.all() or not free.any():
        return []
    likely = marginals(text, spots, found, model)
    out: list[Span] = []
    for k in np.flatnonzero(free & (likely[:, 1:].max(axis=1) >= certain)).tolist():
        kind, (lo, hi) = int(likely[k].argmax()) - 1, spots[k]
        if out and kind > 1 and out[-1][0] == kind and BETWEEN.fullmatch(text, out[-1][2], lo):
            out[-1] = (kind, out[-1][1], hi)
        else:
            out.append((kind, lo, hi))
    return out


def find(text: str, model: dict[str, np.ndarray]) -> tuple[list[Span], list[Span]]:
    """Rule spans and added spans of a text."""
    if not worth_reading(text):
        return [], []
    base = base_spans(text)
    return base, added_spans(text, base, model)


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{lo}:{hi}" for kind, lo, hi in sorted(spans))


def learned(docs: DataFrame, sample_rows: int = 1500, sample_chars: int = 20000) -> dict[str, np.ndarray]:
    """The potentials, from about ``sample_rows`` texts in hash order."""
    worth = docs.where(F.col("text").rlike("[0-9@]"))
    count = worth.count()
    spot = F.xxhash64(F.lit("sample"), "text")
    picked = worth.where(spot.cast("double") + 2.0**63 < 2.0**64 * min(1.0, sample_rows / max(count, 1)))
    # Copies of a text are taken once, so a large group of copies adds one row.
    rows = picked.select(spot.alias("at"), stretch(F.col("text"), sample_chars).alias("text")).dropDuplicates(["at"]).collect()
    return fit([r["text"] for r in sorted(rows, key=lambda r: (r["at"], r["text"]))])


def tag(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Counts and digest of the rule spans, and all spans, of each row of ``docs (doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, added = find(text or "", model)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(spell(base).encode()).hexdigest(), spell(base + added), len(added)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by the name of its kind; of overlapping spans the first one names them all."""
    parts, at = [], 0
    for kind, lo, hi in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if lo >= at:
            parts += [text[at:lo], f"<{KINDS[kind].upper()}>"]
        at = max(at, hi)
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """The rows with the personal data of ``text`` masked; null texts stay null."""
    model = learned(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None or not worth_reading(t) else masked(t, sum(find(t, model), [])) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
