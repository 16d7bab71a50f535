import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from lenswright.llm import runs

from . import cases


def brute(w, min_length=6, min_exponent=4):
    """(start, length, period) of every run, period by period; the least of several periods counts."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((i, size, q) for (i, size), q in out.items() if size >= max(min_length, min_exponent * q)), key=lambda r: (r[0], r[2]))


def strings(seed, n):
    """Random, periodic and broken strings, and Fibonacci ones, that share much."""
    rng = random.Random(seed)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 90:
        fib.append(fib[-1] + fib[-2])
    for _ in range(n):
        kind = rng.randrange(4)
        w = [rng.randrange(rng.choice((1, 2, 3, 5))) for _ in range(rng.randrange(60))]
        if kind == 1 and w:
            w = (w[: rng.randrange(1, 12)] * 20)[: rng.randrange(1, 100)]
        if kind == 2 and w:
            w = (w[: rng.randrange(1, 8)] * 12)[: rng.randrange(1, 70)]
            w[rng.randrange(len(w))] = 9
        if kind == 3:
            w = list(rng.choice(fib)) + w[:3]
        yield w


@pytest.mark.parametrize(("min_length", "min_exponent"), [(6, 4), (2, 2), (5, 3)])
def test_like_all_periods(min_length, min_exponent, monkeypatch):
    found = 0
    for together in (40, 1 << 16):
        monkeypatch.setattr(runs, "TOGETHER", together)
        docs = list(strings(together, 400))
        got = runs.runs_of_documents([np.array(w, np.int64) for w in docs], min_length, min_exponent)
        for w, g in zip(docs, got, strict=True):
            assert [tuple(r) for r in g.tolist()] == brute(w, min_length, min_exponent)
            found += len(g)
    assert found > 300


def test_vocabulary_is_whole():
    """The marks in the tree are the squares with primitive halves, each once."""
    for w in strings(3, 300):
        if len(w) < 3:
            continue
        s = np.array([*w, 99])
        names = runs._names(s)
        order = np.argsort(names[-1])
        extensions = runs._Extensions(names)
        start, half = runs._covering(runs._blocks(order, extensions), extensions)
        tree = runs._Tree(s, order, names[-1], extensions)
        marks = runs._vocabulary(tree, names[-1], start, half)
        got = [tuple(s[tree.order[tree.low[v]] :][:length].tolist()) for v, length in marks]
        want = {tuple(w[i : i + 2 * k]) for i in range(len(w)) for k in range(1, len(w)) if len(w[i : i + 2 * k]) == 2 * k and w[i : i + k] == w[i + k : i + 2 * k] and not any(k % p == 0 and w[i : i + p] * (k // p) == w[i : i + k] for p in range(1, k))}
        assert len(got) == len(set(got)) and set(got) == want


def test_long_strings_take_linear_time():
    import time

    for w in (np.zeros(100_000, np.int64), np.arange(100_000) % 9973, np.arange(100_000)):
        begin = time.time()
        got = runs.runs_of_documents([w])[0]
        assert time.time() - begin < 20
        assert len(got) == (len(set(w.tolist())) < 50_000)


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    sha = lambda b: sha256(b).hexdigest()
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def odd():
    rng = random.Random(4)
    rows = [r for r in cases.documents() if r[1] is None or len(r[1]) < 20_000]
    rows += [(k, " \n".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 3))) for _ in range(80)), "en", "s", 1) for k in range(400, 460)]
    rows += [(k, "x y z " * 30 + "tail " * 9 + "x y z " * 5, "en", "s", 1) for k in range(500, 530)]
    return rows + [(600, "A a " * 12, "en", "s", 1), (600, "A a " * 12, "en", "s", 1), (601, "a b " * 8 + " " * 3, "en", "s", 1), (602, "same " * 6, "en", "s", 1), (603, "same " * 5, "en", "s", 1)]


def test_digest_of_odd_rows(spark):
    rows = odd()
    got = runs.digest(cases.clashing(cases.frame(spark, rows)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(expected(i, t)) for i, t, *_ in rows)


def test_query_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r) for r in runs.digest(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    few = [i for i, t in texts.items() if len(t or "") < 6000]
    assert len(got) == len(texts) and len(few) > 50
    assert all(got[i] == expected(i, texts[i]) for i in few)
    assert any(got[i][1] for i in few)


def test_plain_rows_and_empty_table(spark):
    rows = runs.find_runs(cases.frame(spark, [(1, "a b " * 4 + "c", "en", "s", 1), (2, None, "en", "s", 1)])).collect()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows] == [(9, [(0, 8, 2)], "a b c"), (0, [], "")]
    assert runs.digest(cases.frame(spark, [])).collect() == []
