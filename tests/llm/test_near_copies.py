"""The pipeline's near-dedup stage against all pairs, on planted near copies."""

import random

import numpy as np
import pytest

import corpus_pipeline
from relgrove.llm import bitslice, near_copies


def planted(seed=3):
    """Unrelated texts, each with copies at a similarity from 0.75 to 0.97 by changed words; also short ones and a chain."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for changes in (1, 2, 3, 4, 5, 6, 7) * 4:
        base = [word() for _ in range(260)]
        copy = list(base)
        for at in rng.sample(range(5, 250), changes):
            copy[at] = word()
        texts += [" ".join(base), " ".join(copy)]
    chain = [word() for _ in range(200)]
    for step in range(6):
        texts.append(" ".join(chain[step * 12 : step * 12 + 128]))
    rng.shuffle(texts)
    return texts


def brute_kept(texts):
    sets = [near_copies.shingles(t) for t in texts]
    label = list(range(len(texts)))
    near = [(a, b) for b in range(len(texts)) for a in range(b) if near_copies.jaccard(sets[a], sets[b]) >= 0.8]
    for _ in texts:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    return [k for k in range(len(texts)) if label[k] == k], near, sets


@pytest.mark.parametrize("chunk", [2, 1024])
def test_near_copies_against_all_pairs(spark, chunk):
    texts = planted()
    want, near, sets = brute_kept(texts)
    similar = [near_copies.jaccard(sets[a], sets[b]) for a, b in near]
    assert sum(0.8 <= s < 0.9 for s in similar) > 8 and sum(0.9 <= s <= 0.97 for s in similar) >= 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).checkpoint()
    got = near_copies.deduplicate(docs, chunk=chunk)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want
    if chunk == 1024:
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == want


def test_members_that_the_least_of_a_bucket_does_not_link(spark):
    """With one band of one min-hash buckets are mixed, so links must come from pairs beside the star."""
    rng = random.Random(5)
    shared = [f"s{k}" for k in range(200)]
    own = [[f"o{g}_{rng.randrange(10**6)}" for _ in range(120)] for g in range(3)]
    texts = [" ".join(shared + own[k % 3] + [f"x{k}"] * 3) for k in range(12)]
    want, _, _ = brute_kept(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").checkpoint()
    assert want == [0, 1, 2] and sorted(r["doc_id"] for r in near_copies.deduplicate(docs, bands=60, rows=1, radius=64).collect()) == want


def test_near_copies_empty(spark):
    assert near_copies.deduplicate(spark.createDataFrame([], "doc_id long, text string").checkpoint()).count() == 0


@pytest.mark.parametrize("n, radius", [(1, 9), (70, 100), (300, 76), (257, 0), (200, 256)])
def test_wide_neighbours(n, radius):
    rng = np.random.default_rng(n)
    word = lambda *shape: rng.integers(0, 1 << 64, shape, dtype=np.uint64)
    fps = word(8, 4)[rng.integers(0, 8, n)] ^ (word(n, 4) & word(n, 4) & word(n, 4))
    ends = np.minimum(n, np.arange(n) + rng.integers(1, n + 1, n))
    got = [(int(a), int(b)) for i, j in bitslice.wide_neighbours(fps, ends, radius) for a, b in zip(i, j, strict=True)]
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    assert sorted(got) == [(a, b) for a in range(n) for b in range(a + 1, int(ends[a])) if apart[a, b] <= radius]


def test_candidates_come_from_compared_bit_planes(spark, monkeypatch):
    """The stage takes its pairs from SimHash fingerprints, compared as bit planes; without hits there are no links."""
    rounds = []
    compare = bitslice.wide_neighbours
    monkeypatch.setattr(bitslice, "wide_neighbours", lambda *args: (rounds.append(h) or h for h in compare(*args)))
    hashes = [np.unique(np.random.default_rng(7).integers(0, 1 << 64, 100, dtype=np.uint64))]
    hashes += [hashes[0][:90], np.arange(1, 80, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)]
    fps, sizes = np.stack([near_copies.fingerprint(h) for h in hashes]), np.array([len(h) for h in hashes])
    order = np.argsort(sizes)
    u, v, member, _ = near_copies.candidates(np.zeros(3, np.int64), order, sizes[order], fps[order], 0.8, near_copies.RADIUS)
    assert (u.tolist(), v.tolist(), len(member), len(rounds)) == ([0], [1], 0, 1)


def test_tables_of_bits_hold_near_copies():
    """Of pairs of fingerprints at a similarity of 0.8, hardly any shares no key."""
    rng = np.random.default_rng(11)
    for rows in (1, 5, 8):
        differ = rng.random((20_000, near_copies.BITS)) < 0.1515
        at = near_copies.positions(near_copies.bands_for(rows), rows)
        assert at.shape == (near_copies.bands_for(rows), rows)
        missed = np.ones(len(differ), bool)
        for table in at:
            missed &= differ[:, table].any(axis=1)
        assert missed.sum() <= 1, rows


@pytest.mark.parametrize("tables", [{}, {"bands": 45, "rows": 6}])
def test_repeats_do_not_part_near_copies(spark, tables):
    """Similarity is one of sets: a passage that only one of two near copies repeats many times does not count again."""
    texts = []
    for g in range(4):
        rng = random.Random(g)
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(300)]
        texts += [" ".join(base + ["ab", "cd", "ef", "gh", f"own{k}"] * (400 * k + 2)) for k in range(3)]
    want, near, _ = brute_kept(texts)
    assert want == [0, 3, 6, 9] and len(near) >= 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").checkpoint()
    assert sorted(r["doc_id"] for r in near_copies.deduplicate(docs, **tables).collect()) == want
