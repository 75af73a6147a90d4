"""Lists of one token that very many documents hold."""

import random

import numpy as np
import pytest

from wattspan.llm import jaccard_join


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * len(sets[a] | sets[b]):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: find(i) for i in root}


@pytest.mark.parametrize("gather", [True, False])
def test_blocks_of_one_token(spark, monkeypatch, gather):
    """A passage of six words in all documents, and groups of near copies beside it."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 3)
    rng = random.Random(3)
    shared = "all rights are reserved by nobody"
    rows = []
    for i in range(160):
        if i % 4 == 0:
            text = f"{shared} {rng.randrange(5)}"  # sets of the shared shingles and one or two others
        else:
            own = [f"w{i // 8}x{k}" for k in range(30)]
            own[rng.randrange(30)] = f"edit{i}"
            text = f"{shared} {' '.join(own)}"
        rows.append((i * 7 % 163, text))
    rows += [(500, None), (501, ""), (502, shared), (503, "few words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df, gather_first=gather).collect()}
    want = plain_components(rows)
    assert got == want
    assert 5 < len(set(want.values())) < len(rows) - 10


def test_pairs_between_sides_only():
    tokens, docs_ = np.full(40, 9, np.uint32), np.arange(40)
    n = shared = np.full(40, 100)
    side = docs_ % 2
    pairs = jaccard_join._pairs_of_bucket(tokens, docs_, docs_, n, shared, 75, side=side)
    assert len(pairs) == 400 and all(a % 2 != b % 2 for a, b in pairs.tolist())


def test_prefixes_of_pairs_that_reach_the_threshold_meet():
    rng = np.random.default_rng(2)
    left, right, reach = [], [], []
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.where(rng.random(len(a)) < rng.choice([0.02, 0.1, 0.4]), rng.integers(0, 2**63, len(a)).astype(np.uint64), a))
        both = len(np.intersect1d(a, b))
        left.append(a)
        right.append(b)
        reach.append(100 * both >= 75 * (len(a) + len(b) - both))
    met = jaccard_join._prefixes_meet([left, right], ((np.zeros(0, np.int64), np.zeros(0, np.int32)), 7), 75)
    assert all(met[np.array(reach)]) and not all(met)
    other = [np.array([1], np.uint64), np.array([2], np.uint64)]
    assert jaccard_join._prefixes_meet([other, other[::-1]], ((np.zeros(0, np.int64), np.zeros(0, np.int32)), 7), 75).tolist() == [False, False]
