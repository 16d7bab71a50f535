"""The pipeline's stages on the smallest tables, each against brute force on what it was given."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lenswright.llm import quality, tokens

from ..conftest import DATA
from . import cases
from .test_decontaminate import brute as contaminated
from .test_neardup import brute as components
from .test_pii import brute as personal


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage, written and read again as the driver does it."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, DATA).write.parquet(f"file://{folder}/{k}")
        docs = spark.read.parquet(f"file://{folder}/{k}")
        out[name] = (before, docs.collect(), docs.columns)
    return out


def _same(rows, expected):
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, map(tuple, expected)))


def test_names_and_columns(stages):
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_what_the_model_predicts(spark, stages):
    before, after, _ = stages["quality"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{DATA}/documents.parquet"), labels)
    scores = model.scores(np.array([quality.text_features((r.text or "").encode()) for r in before]))
    _same(after, [r for r, s in zip(before, scores) if s >= 0.7])
    good = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in after}
    assert np.mean([(r.doc_id in kept) == (good[r.doc_id] == 1) for r in before if r.doc_id in good]) > 0.95


def test_one_near_duplicate_stays(stages):
    before, after, _ = stages["near_duplicates"]
    found = components([tuple(r) for r in before], 80)
    _same(after, [r for r, (i, n, c) in zip(before, found) if i == c])


def test_benchmark_goes(spark, stages):
    before, after, _ = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    flags = [s.endswith("True)") for s in contaminated([tuple(r) for r in before], items)]
    _same(after, [r for r, bad in zip(before, flags) if not bad])


def test_personal_data_is_replaced(stages):
    before, after, _ = stages["pii"]
    new = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        text = new[r.doc_id].text
        assert new[r.doc_id].n_chars == len(text)
        assert all(r.text[s:e] not in text for _, s, e in personal(r.text))
        if not re.search("[0-9@]", r.text):
            assert text == r.text


def test_packing_holds_all_tokens(stages):
    before, after, _ = stages["packing"]
    library, by = Tokenizer.from_file(tokens.default_path()), defaultdict(list)
    ids = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in before}
    for r in after:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in after) == sum(map(len, ids.values()))
    for b in by.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096


def test_run_is_the_stages_in_a_row(spark, stages):
    last = stages["packing"][1]
    got = corpus_pipeline.run(spark, DATA).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, last))


def _odd(spark):
    """Nulls, repeated rows and ids, very long texts, and extra columns under all kinds of names."""
    return cases.clashing(cases.frame(spark, cases.documents())).withColumn("a.b", F.lit("kept")).withColumn("x`y", F.lit(3))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, name):
    docs = _odd(spark)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, DATA)
    assert out.schema.names == docs.schema.names and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    rows = out.collect()
    assert all((r["score"], r["_bad1"], r["_pii_key"], r["a.b"], r["x`y"]) == ("x", "x", "x", "kept", 3) for r in rows)
    given = Counter((r.doc_id, r.text, r.n_chars) for r in docs.collect())
    got = Counter((r.doc_id, r.text, r.n_chars) for r in rows)
    if name == "pii":
        assert Counter({k: n for k, n in given.items() if not re.search("[0-9@]", k[1] or "")}) == Counter({k: n for k, n in got.items() if not re.search("[0-9@]", k[1] or "")})
        assert sum(got.values()) == sum(given.values())
    elif name == "near_duplicates":
        kept = [(i, t) for (i, t, _), n in got.items() for _ in range(n)]
        found = components([(i, t) for (i, t, _), n in given.items() for _ in range(n)], 80)
        assert len([1 for i, t in kept if (t or "").split()]) == len({c for i, n, c in found if n and c is not None}) + 2  # and the one without an id, and the other text of id 7
        assert got <= given
    elif name == "decontamination":
        assert got == given
    else:
        assert got <= given


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, cases.frame(spark, []), DATA).collect() == []


def test_packing_of_odd_rows(spark):
    rows = dict(corpus_pipeline.STAGES)["packing"](spark, _odd(spark), DATA).collect()
    assert sum(r.piece == 0 for r in rows) == len(cases.documents())
