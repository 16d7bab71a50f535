import binascii
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lenswright.llm import lm

from . import cases

END = b"\n"


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def held_out(i):
    return binascii.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def brute(rows):
    counts, pairs = Counter(), Counter()
    for i, t, *_ in rows:
        if not held_out(i):
            counts.update(tokens(t))
            pairs.update(zip([END, *tokens(t)], tokens(t)))
    n, v, after = sum(counts.values()), len(counts), Counter(c for c, _ in pairs)
    base = lambda w: (counts[w] + 0.1) / (n + 0.1 * (v + 1))

    def p(c, w):
        return base(w) if not counts[c] else max(pairs[c, w] - 0.75, 0) / counts[c] + 0.75 * after[c] / counts[c] * base(w)

    for i, t, *_ in rows:
        w = tokens(t)
        yield i, held_out(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10(base(x)) for x in w), sum(math.log10(p(c, x)) for c, x in zip([END, *w], w))


def _same(got, rows):
    key = lambda r: (str(r[0]), r[2], round(r[5], 5))
    for g, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows), key=key), strict=True):
        assert g[:5] == b[:5]
        assert g[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert abs(g[6] - b[6]) <= 0.02 * g[2] + 1e-9  # half a quantisation step a token


def test_like_brute_force(spark):
    rows = cases.documents()
    _same(lm.learn_and_score(cases.clashing(cases.frame(spark, rows))).collect(), rows)


def test_frequent_words_cut_into_shards(spark, monkeypatch):
    """Shards of a few tokens: contexts over several shards, and words over several shards of words."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 150)
    monkeypatch.setattr(lm, "SHARD_WORDS", 50)
    rows = cases.documents()
    _same(lm.learn_and_score(cases.frame(spark, rows)).collect(), rows)


def test_empty_tables(spark):
    assert lm.learn_and_score(cases.frame(spark, [])).collect() == []
    held = next(k for k in range(100) if held_out(k))
    r = lm.learn_and_score(cases.frame(spark, [(held, "a b", "", "", 3)])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def _hash(word):
    return lm.END if word == END else int(lm.token_hashes(word)[0])


def _conditional(model, context, word):
    """P(word | context) of the model's two levels."""
    both = np.array(sorted({_hash(context), _hash(word)}))
    ids, counts = model.words.find(both)
    at = lambda x: int(np.searchsorted(both, _hash(x)))
    c, w, n = ids[at(context)], ids[at(word)], counts[at(context)]
    share = model.discount * model.pairs.successors(np.array([c]))[0] / n
    found = model.pairs.discounted(np.array([c]), np.array([w]))[0] if w >= 0 else 0.0
    return found + share * model.base(counts)[at(word)]


def test_probabilities_sum_to_one(spark):
    docs = [(1, "a b a c a b", "", "", 1), (2, "b c", "", "", 1)]
    model = lm.opened(lm.train(cases.frame(spark, docs)))
    for context in (b"a", b"b", b"c", END):
        total = sum(_conditional(model, context, w) for w in (b"a", b"b", b"c", END, b"never seen".replace(b" ", b"")))
        assert total == pytest.approx(1.0, abs=0.05)  # but for the quantised levels


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**45), max_size=300), st.integers(0, 2**20))
def test_elias_fano(values, extra):
    v = np.array(sorted(set(values)), np.uint64)
    code = lm.EliasFano.build(v, int(v[-1]) + 1 + extra if len(v) else 1 + extra)
    assert (code.access(np.arange(len(v))) == v).all()
    probes = np.array(sorted({*values, *(x + 1 for x in values[:-1] if x + 1 < (int(v[-1]) if len(v) else 0))}), np.uint64)
    where = {int(x): k for k, x in enumerate(v)}
    assert code.find(probes).tolist() == [where.get(int(x), -1) for x in probes]


def test_elias_fano_repeats():
    v = np.sort(np.random.default_rng(1).integers(0, 40, 500)).astype(np.uint64)
    assert (lm.EliasFano.build(v, 41).access(np.arange(500)) == v).all()
