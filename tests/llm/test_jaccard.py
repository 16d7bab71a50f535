import random
from itertools import combinations

import numpy as np
import pytest

from lenswright.llm import jaccard, neardup

from . import cases
from .test_neardup import brute, chains, shingles


def plain(rows):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in rows)


def mixed():
    """Odd rows, dense groups, chains, shared passages, copies, and pairs on both sides of the threshold at many sizes."""
    rng = random.Random(8)
    rows = cases.documents() + chains()
    for k, n in enumerate((6, 7, 9, 14, 24, 40, 90, 300, 1000)):
        w = cases.words(rng, n, 10**6).split()
        rows += [(4000 + 10 * k, " ".join(w), "en", "s", 1), (4001 + 10 * k, " ".join(w + ["tail"] * max(1, (n - 4) // 5)), "en", "s", 1)]
        rows += [(4002 + 10 * k, " ".join(w[: n - (n - 4) // 5]), "en", "s", 1), (4003 + 10 * k, " ".join(w[: n - (n - 4) // 5 - 1]), "en", "s", 1)]
    return rows


@pytest.mark.parametrize("percent", [80, 90, 60])
def test_like_all_pairs(spark, percent):
    rows = mixed()
    got = jaccard.similar(cases.clashing(cases.frame(spark, rows)), percent).collect()
    assert plain(got) == sorted(map(str, brute(rows, percent)))


def test_small_tiles_and_no_broadcasts_lose_no_link(spark, monkeypatch):
    """Lists cut by bands and parts, common hashes last, no hubs on most lists."""
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "FEW", 1)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "MOST_BITS", 128)
    rows = mixed()
    assert plain(jaccard.similar(cases.frame(spark, rows), 80).collect()) == sorted(map(str, brute(rows, 80)))


@pytest.mark.parametrize("block", [4, 1024])
def test_all_links_of_the_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = mixed()
    members, links = jaccard.join(cases.frame(spark, rows), 80)
    sets = {shingles(t) for _, t, *_ in rows} - {frozenset()}
    want = sum(100 * len(a & b) >= 80 * len(a | b) for a, b in combinations(sets, 2))
    got = links.collect()
    assert len(got) == len({(r.a, r.b) for r in got}) == want > 200
    assert len({r.num for r in members.collect() if r.num is not None}) == len(sets)


def test_empty_and_single(spark):
    assert jaccard.similar(cases.frame(spark, []), 80).collect() == []
    got = jaccard.similar(cases.frame(spark, [(1, "a b c d e f", "", "", 1), (2, None, "", "", 1), (3, " ", "", "", 1)])).collect()
    assert plain(got) == ["(1, 2, 1)", "(2, 0, 2)", "(3, 0, 3)"]


def test_bits_bound_the_overlap():
    rng = np.random.default_rng(2)
    for n in (1, 3, 30, 33, 200, 5000, 20_000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.0, 0.5, 0.8, 0.9, 1.0):
            b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(0, 1 << 63, max(1, n // 3)).astype(np.uint64)]))
            x, y = jaccard.bitmap(a), jaccard.bitmap(b)
            words = min(len(x), len(y))
            differ = int(np.bitwise_count(jaccard.fold(x, words) ^ jaccard.fold(y, words)).sum())
            o = len(np.intersect1d(a, b))
            assert jaccard.overlap(a, b) == o and differ <= len(a) + len(b) - 2 * o
            assert jaccard.possible(np.array(differ), np.array(len(a) + len(b)), 80) or 100 * o < 80 * (len(a) + len(b) - o)


def test_posted_hashes_meet():
    """Linked sets have as many posted hashes in common as company is asked for."""
    rng = random.Random(3)
    for _ in range(2000):
        n = rng.randrange(1, 120)
        a = set(rng.sample(range(10**6), n))
        b = set(list(a)[: rng.randrange(1, n + 1)]) | set(rng.sample(range(10**6), rng.randrange(0, n // 5 + 2)))
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        posted = [set(sorted(s)[: len(s) - jaccard.needed(len(s), 80) + 1 + len(s) // jaccard.SLACK]) for s in (a, b)]
        assert all(len(posted[0] & posted[1]) >= 1 + jaccard.needed(len(s), 80) // jaccard.SLACK for s in (a, b))


def test_same_as_the_signature_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert plain(jaccard.similar(docs, 80).collect()) == plain(neardup.near_duplicates(docs, 80).collect())
