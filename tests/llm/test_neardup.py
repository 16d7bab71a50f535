import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from lenswright.llm import neardup

from . import cases


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent):
    """(doc_id, size, component) of every row, by comparing all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return [(rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows))]


def chains(n=70, seed=5):
    """A dense group of edited copies at all distances, chains of copies of copies, and shared passages."""
    rng = random.Random(seed)
    base = cases.words(rng, 150, 5000).split()
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w), "en", "s", 1))
    w = cases.words(rng, 100, 5000).split()
    for k in range(12):
        w[(k * 8) % 100] = f"step{k}"
        rows.append((2000 + k, " ".join(w), "en", "s", 1))
    passage = cases.words(rng, 50, 5000)
    rows += [(3000 + k, cases.words(rng, 60, 5000) + " " + passage, "en", "s", 1) for k in range(30)]
    return rows


@pytest.mark.parametrize("percent", [85, 80])
def test_like_all_pairs(spark, percent):
    rows = cases.documents() + chains()
    got = neardup.near_duplicates(cases.clashing(cases.frame(spark, rows)), percent).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(str, brute(rows, percent)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    """With one round of hubs and blocks of a few nodes the rest is still found."""
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = chains()
    got = neardup.near_duplicates(cases.frame(spark, rows), 85).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(str, brute(rows, 85)))


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    rows = cases.documents()
    got = neardup.near_duplicates(cases.frame(spark, rows), 80).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(str, brute(rows, 80)))


def test_one_of_each_group_stays(spark):
    rows = [r for r in cases.documents() if not (r[1] or "").startswith("same id")] + chains(20)
    docs = cases.clashing(cases.frame(spark, rows))
    kept = neardup.deduplicate(docs, 80)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    found = brute(rows, 80)
    groups = defaultdict(set)
    for (i, t, *_), (_, n, c) in zip(rows, found):
        groups[(c, "") if n else (c, "empty", i, t)].add((i, t))
    for (i, t, *_), (_, n, _) in zip(rows, found):
        if not n:
            assert got[(i, t)] >= 1
    for key, members in groups.items():
        if len(key) == 2 and key[0] is not None:
            assert sum(got[m] for m in members) == len({m for m in members if m in got}) == 1
            assert next(m for m in members if m in got)[0] == key[0]


def test_empty_table(spark):
    assert neardup.near_duplicates(cases.frame(spark, []), 85).collect() == []
    assert neardup.deduplicate(cases.frame(spark, []), 85).collect() == []
    assert {r.component_id for r in neardup.near_duplicates(cases.frame(spark, [(1, "a b c d e f", "", "", 1), (2, None, "", "", 1)]), 85).collect()} == {1, 2}


def test_matches_needed_keeps_the_promise():
    from math import comb

    for k, share in ((32, 0.85), (128, 0.85), (128, 0.8)):
        t = neardup.matches_needed(k, share)
        miss = sum(comb(k, i) * share**i * (1 - share) ** (k - i) for i in range(t))
        assert miss <= 1e-6 < miss + comb(k, t) * share**t * (1 - share) ** (k - t)


def test_pages_of_one_template(spark):
    """Unlinked rows that share most of their words meet in long lists; none is lost, none is linked, and lists are cut into blocks."""
    rng = random.Random(3)
    template = cases.words(rng, 500, 5000)
    rows = [(k, template + " " + cases.words(rng, 150, 10**6), "en", "s", 1) for k in range(1500)]
    rows += [(5000 + k, rows[k][1] + " more", "en", "s", 1) for k in range(40)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(cases.frame(spark, rows), 85).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, *_ in rows}
