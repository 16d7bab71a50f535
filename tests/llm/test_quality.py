import binascii
import random

import numpy as np
import pytest

from lenswright.llm import quality

from . import cases


def _labelled(spark, n=400):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        text = cases.words(rng, 40) if good else " ".join(w + rng.choice(("###", "$$$", "%%%")) for w in cases.words(rng, 40).split())
        docs.append((k, text, "en", "s", len(text)))
        labels.append((k, int(good), 0))
    return cases.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = _labelled(spark)
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == 400
    for k, r in rows.items():
        assert r.held_out == (binascii.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r.predicted == int(k % 3 > 0) for k, r in rows.items() if r.held_out]
    assert len(held) > 50 and np.mean(held) > 0.97


def test_held_out_labels_are_never_learnt_from(spark):
    docs, labels = _labelled(spark)
    lie = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality", "toxic")
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs, lie).collect()}
    assert a == b


def test_odd_rows(spark):
    docs, labels = cases.clashing(cases.frame(spark, cases.documents())), _labelled(spark)[1]
    out = quality.classify(docs, labels)
    assert out.columns == [c for c in docs.columns if c not in ("score", "predicted", "held_out")] + ["held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(cases.documents())
    empty = {r.score for r in rows if not r.text}
    assert len(empty) == 1
    repeated = [r.score for r in rows if r.doc_id == 7 and not r.text.startswith("same")]
    assert len(repeated) == 2 and len(set(repeated)) == 1


def test_no_labels_and_no_rows(spark):
    docs, labels = _labelled(spark, 10)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_tables_add_up(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y, n_pairs=4)
    assert any({a, b} == {0, 1} for a, b, _ in model.pairs)
    assert np.mean((model.scores(x) > 0.5) == (y == 1)) > 0.9
    by_hand = model.base + sum(t[np.searchsorted(e, x[5, k], side="right")] for k, (e, t) in enumerate(zip(model.edges, model.tables)))
    by_hand += sum(t[np.searchsorted(model.pair_edges[a], x[5, a], side="right"), np.searchsorted(model.pair_edges[b], x[5, b], side="right")] for a, b, t in model.pairs)
    assert model.logits(x[5:6])[0] == pytest.approx(by_hand)
