"""Near duplicates where one bucket holds very many components."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

from exposure.llm import hyperminhash  # noqa: E402


def crowded(components, shared, own, change=0.5, seed=6):
    """Pairs of near copies, all around one long passage that puts them into common buckets."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(shared))
    rows = []
    for c in range(components):
        words = [f"c{c}x{i}" for i in range(own)]
        rows.append((len(rows), passage + " " + " ".join(words)))
        if rng.random() < change:
            words[rng.randrange(own)] = "other"
        else:
            words[-1] = f"{c}"
        rows.append((len(rows), passage + " " + " ".join(words)))
    rng.shuffle(rows)
    return rows


def found(spark, rows):
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    return [by[d] for d, _ in rows]


@pytest.mark.parametrize("shared, own", [(60, 20), (30, 30), (90, 14)])
def test_a_bucket_of_many_components(spark, monkeypatch, shared, own):
    monkeypatch.setattr(hyperminhash, "BLOCK", 16)
    rows = crowded(150, shared, own)
    assert found(spark, rows) == brute.near_components(rows)


def test_five_thousand_members_in_2500_components(spark, monkeypatch):
    """Rows that are dealt stay in proportion to the members."""
    rows = crowded(2500, 60, 20)
    dealt = []
    real = hyperminhash._by_rare_shingles

    def counted(crowd, sets, percent):
        out = hyperminhash.saved(real(crowd, sets, percent))
        dealt.append((crowd.count(), out.selectExpr("coalesce(sum(blocks), 0)").first()[0]))
        return out

    monkeypatch.setattr(hyperminhash, "_by_rare_shingles", counted)
    # Copies differ in one of 80 words, strangers in 20 of them.
    assert found(spark, rows) == [d - d % 2 for d, _ in rows]
    ((members, copies),) = dealt
    assert members > 2000 and copies < 20 * members


def test_prefixes_meet_every_linked_pair():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        for _ in range(3000):
            n = int(rng.integers(1, 80))
            m = int(rng.integers(n, n * 100 // percent + 1))
            least = -(-percent * (n + m) // (100 + percent))
            if least > n:
                continue
            k = int(rng.integers(least, n + 1))
            order = rng.permutation(n + m - k)
            both, x, y = order[:k], order[k:n], order[n : n + m - k]
            small, large = np.sort(np.concatenate([both, x])), np.sort(np.concatenate([both, y]))
            assert 100 * k >= percent * (n + m - k)
            first, _ = hyperminhash.prefix_lengths(n, percent)
            _, second = hyperminhash.prefix_lengths(m, percent)
            assert len(np.intersect1d(small[:first], large[:second]))
