"""The fingerprints and pivot distance tables of the pipeline's near-dedup."""

import random

import corpus_pipeline
import numpy as np
from textloom.llm import near_copies as nc

from tests.conftest import TINY


def bits_apart(a, b) -> int:
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def test_fingerprint_is_the_majority_of_each_bit():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5, 254, 255, 256, 700):
        s = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        words = []
        for h in s.tolist():
            for k in range(4):  # splitmix64 of the hash and a seed
                x = (h + k * 0x9E3779B97F4A7C15) % 2**64
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                words.append(x ^ x >> 31)
        want = {(k, bit) for k in range(4) for bit in range(64) if 2 * sum(x >> bit & 1 for x in words[k::4]) > n}
        got = np.unpackbits(nc.fingerprint(s).view(np.uint8)).reshape(4, 8, 8)  # word, byte, bit
        assert {(int(k), 8 * int(byte) + int(bit)) for k, byte, bit in np.argwhere(got)} == want


def test_radius_holds_the_limit_and_discards_the_rest():
    """Sets of similarity 0.8 exactly, 4 of 5 shingles to 400 of 500, and as many unrelated ones."""
    rng = np.random.default_rng(9)
    near, far = [], []
    for n in [4, 8, 40, 400] * 500:
        x = np.unique(rng.integers(0, 1 << 63, n + n // 4, np.uint64))
        own = nc.fingerprint(x)
        near.append(bits_apart(own, nc.fingerprint(x[rng.permutation(len(x))[:n]])))
        far.append(bits_apart(own, nc.fingerprint(rng.integers(0, 1 << 63, n, np.uint64))))
    assert max(near) <= nc.RADIUS and sum(d <= nc.RADIUS for d in far) < 20


def test_tables_lose_no_pair():
    """A cloud of fingerprints around some centres against XOR of all pairs."""
    rng = np.random.default_rng(2)
    for n, radius in [(2, 96), (3, 96), (150, 96), (150, 20), (150, -1)]:
        fps = rng.integers(0, 1 << 63, (3, 4), np.uint64)[rng.integers(0, 3, n)]
        for row in fps:
            for bit in rng.integers(0, 256, rng.integers(0, 90)).tolist():
                row[bit // 64] ^= np.uint64(1 << bit % 64)
        labels = rng.integers(0, 40, n)
        got = [*zip(*(x.tolist() for x in nc.near_pairs(fps, labels, radius)))]
        assert sorted(got) == [(a, b) for a in range(n) for b in range(a + 1, n) if labels[a] != labels[b] and bits_apart(fps[a], fps[b]) <= radius]


def test_groups_keep_only_what_is_near_another_label(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 62, 4)
    fps = {1: centre, 2: centre ^ 0xFF, 3: rng.integers(0, 1 << 62, 4), 4: centre ^ 0xFFFF, 5: ~centre}
    table = spark.createDataFrame([(n, [int(v) for v in x]) for n, x in fps.items()], "node long, fp array<long>")
    groups = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3), (7, 5, 5), (8, 1, 1), (8, 4, 1), (9, 3, 3), (9, 5, 5)], "gid long, node long, label long")
    assert sorted((r.gid, r.node, r.label, r.fp) for r in nc._near(groups, table).collect()) == [(7, n, n, [int(v) for v in fps[n]]) for n in (1, 2)]


def test_stage_joins_only_within_the_radius(spark, monkeypatch):
    """The stage's links are decided on fingerprints: at no radius only equal sets are copies."""
    rng = random.Random(1)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(base[:100] + ["new"] + base[100:])), (4, " ".join(base[:-3])), (5, "another text of six words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def kept():
        return sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, TINY).collect())

    assert kept() == [1, 5]
    monkeypatch.setattr(nc, "RADIUS", -1, raising=False)
    assert kept() == [1, 3, 4, 5]
