"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, width: int = 3) -> set:
    w = words(ascii_lower(text or ""))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near_components(rows: list[tuple[int, str | None]], percent: int = 85, width: int = 3) -> list[int]:
    """The component of each row: smallest id reachable over links."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in where[x] if j < i}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(rows))]


def repeated_bytes(texts: list[str | None], length: int = 200) -> list[tuple[int, int, bytes]]:
    """Removed bytes, maximal removed runs and what is kept, for each text."""
    data = [(t or "").encode() for t in texts]
    count: dict = {}
    for d in data:
        for i in range(len(d) - length + 1):
            count[d[i : i + length]] = count.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def cleaned(rows: list[dict], least: int = 10, share: float = 0.01, depleted: float = 0.8) -> dict[int, str]:
    """Texts, by id, of the documents that the line rules keep."""
    flat = lambda x: re.sub(r"[\x20\x09\x0B\x0C\x0D]+", " ", x.lower()).strip(" ")
    held, texts, first = {}, {}, {}
    for r in rows:
        texts.setdefault(r["source"], set()).add(r["text"])
        for x in {flat(x) for x in r["text"].split("\n")} - {""}:
            k = (r["source"], x)
            held.setdefault(k, set()).add(r["text"])
            first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    out = {}
    for r in rows:
        w = words(r["text"])
        threes = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {t for t in threes if threes.count(t) > 1} if len(set(threes)) < len(threes) else set()
        covered = {i + k for i, t in enumerate(threes) if t in often for k in range(3)}
        if len(w) < 50 or 100 * len(covered) > 50 * len(w):
            continue

        def gone(x: str) -> bool:
            k = (r["source"], flat(x))
            n = len(held.get(k, ()))
            return n > least and n > share * len(texts[r["source"]]) and first[k] != r["doc_id"]

        left = "\n".join(x for x in r["text"].split("\n") if not gone(x))
        if len(w) - len(words(left)) <= depleted * len(w):
            out[r["doc_id"]] = left
    return out


def poisson(u: float, rate: float) -> int:
    p = total = math.exp(-rate)
    k = 0
    while u >= total:
        k += 1
        p *= rate / k
        total += p
    return k
