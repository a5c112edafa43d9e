"""The pipeline's near-dedup against brute force: 5-word shingles, Jaccard similarity 0.8 or more."""

import random

import corpus_pipeline
import numpy as np
from textloom.llm import near_copies as nc
from textloom.llm.common import table

from tests.conftest import SMALL, TINY


def brute_kept(rows: dict[int, str]) -> set[int]:
    ids, sets = sorted(rows), {}
    for i in ids:
        w = rows[i].encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = {i: lo if g == hi else g for i, g in group.items()}
    return {i for i, g in group.items() if i == g}


def near_copies(rng) -> dict[int, str]:
    """Texts of 3 to 900 words, each with copies in which words are changed, left out or put in; a chain of copies; one common line."""
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    line, out = " ".join(rng.choices(words, k=25)), {}
    for n in [3, 5, 6, 9, 14, 30, 60, 120, 300, 900] * 4:
        base = rng.choices(words, k=n)
        for copy in range(6):
            t = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                k = rng.randrange(len(t))
                rng.choice([lambda: t.insert(k, "new"), lambda: t.pop(k), lambda: t.__setitem__(k, "other")])()
            out[len(out)] = " ".join(t) + (" " + line if n > 9 and copy % 2 else "")
    t = rng.choices(words, k=200)
    for k in range(30):  # each near the next, the ends far apart
        out[len(out)] = " ".join(t)
        t = [*t[5:], *rng.choices(words, k=5)]
    order = rng.sample(range(len(out)), len(out))
    return {order[k]: t for k, t in out.items()}


def test_keep_first_against_all_pairs(spark):
    rows = near_copies(random.Random(6)) | {5000: "", 5001: "  \n", 5002: "Two  WORDS", 5003: "two words"}
    got = nc.keep_first(spark.createDataFrame([*rows.items()], "doc_id long, text string").repartition(5)).collect()
    assert sorted(r.doc_id for r in got) == sorted(brute_kept(rows))


def test_stage_on_the_tables(spark):
    for sf in (TINY, SMALL):
        docs = table(spark, sf, "documents")
        got = corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()
        assert sorted(r.doc_id for r in got) == sorted(brute_kept({r.doc_id: r.text for r in docs.collect()}))


def test_bands_meet_at_the_limit():
    """Sets of similarity 0.8 exactly, 9 to 900 shingles: every pair has a band in common."""
    rng = np.random.default_rng(8)
    for n in [4, 8, 40, 400] * 500:
        x = np.unique(rng.integers(0, 1 << 63, n + n // 4, np.uint64))
        assert (nc.band_keys(x) == nc.band_keys(x[rng.permutation(len(x))[:n]])).any()


def test_rows_without_an_id_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f"), (2, "x y z"), (2, "other words"), (2, "x  y z"), (7, None), (8, None), (None, "only here"), (None, "only here"), (9, "nine"), (9, "nine")]
    frame = spark.createDataFrame([(*r, r[0], "k", 1.5) for r in rows], "doc_id long, text string, key long, row string, label double")
    got = nc.keep_first(frame).collect()
    assert frame.columns == nc.keep_first(frame.limit(0)).columns
    assert sorted((r.doc_id or 0, (r.text or "").split()) for r in got) == [(0, ["only", "here"]), (1, "A b c d e f".split()), (2, ["other", "words"]), (2, ["x", "y", "z"]), (7, []), (9, ["nine"])]


def test_large_buckets_are_settled_exactly(spark, monkeypatch):
    """Families of near copies, of copies of copies and of texts that are half alike, in buckets far above the bound."""
    monkeypatch.setattr(nc, "LARGE", 12)
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows, shared = {}, rng.choices(words, k=300)
    for family in range(4):
        base = shared + rng.choices(words, k=60)
        for copy in range(45):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = "changed"
            if copy % 15 == 7:
                t += rng.choices(words, k=rng.randint(60, 140))
            rows[len(rows)] = " ".join(t)
    for _ in range(40):
        rows[len(rows)] = " ".join(shared + rng.choices(words, k=rng.randint(90, 160)))
    got = nc.keep_first(spark.createDataFrame([*rows.items()], "doc_id long, text string").repartition(5)).collect()
    assert sorted(r.doc_id for r in got) == sorted(brute_kept(rows))
