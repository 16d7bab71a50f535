import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from lenswright.llm import fingerprints

from . import cases


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _rows():
    seen, out = set(), []
    for r in cases.documents():
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def test_edited_texts_and_likeness(spark):
    rows = sorted(_rows(), key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprints.edited_digest(cases.clashing(cases.frame(spark, rows))).collect()}
    assert len(got) == len(rows)
    errors = []
    for k, (i, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[i].near_edited - jaccard(t, edited), got[i].near_next - jaccard(t, after)]
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if not t.split():
            assert got[i].fingerprint == ""
        else:
            assert re.fullmatch("[0-9a-f]{256}", got[i].fingerprint)
    assert np.sqrt(np.mean(np.square(errors))) < 0.05


def test_likeness_is_unbiased(spark):
    words = [f"w{k}" for k in range(400)]
    pairs = []
    for seed in range(40):
        own = [f"{w}s{seed}" for w in words]
        pairs.append((" ".join(own), " ".join(own[:200] + [w + "x" for w in own[200:]])))
    df = spark.createDataFrame(pairs, "a string, b string").select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("l"))
    errors = [r.l - jaccard(a, b) for r, (a, b) in zip(df.collect(), pairs)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_equal_texts_and_repeated_rows(spark):
    rows = cases.documents()
    got = fingerprints.edited_digest(cases.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for (i, t), f in zip(sorted(((i, t or "") for i, t, *_ in rows), key=str), sorted(got, key=lambda r: str((r.doc_id, "")))):
        by.setdefault(t, set())
    texts = {(r[0], len(r[1] or "")): (r[1] or "") for r in rows}
    for r in got:
        by.setdefault(texts[(r.doc_id, r.n_chars)], set()).add(r.fingerprint)
    assert all(len(v) <= 1 for v in by.values())


def test_few_rows(spark):
    assert fingerprints.edited_digest(cases.frame(spark, [])).collect() == []
    one = fingerprints.edited_digest(cases.frame(spark, [(1, "abcdef", "", "", 6)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


def test_no_python_on_the_main_path(spark):
    plan = fingerprints.edited_digest(cases.frame(spark, _rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
