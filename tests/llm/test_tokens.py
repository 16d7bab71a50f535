import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lenswright.llm import packing, tokenids, tokens

from . import cases

PATH = tokens.default_path()
TEXTS = ["", " ", "it's don't 'S 'll", "a<|endoftext|>b <|startoftext|>", "É ß ñ 漢字 🎉 x y z İ ΣΑΣ.", "1,234.5 ½ x²y³ ª µ × ÷", "A  B\tC\r\nD", "z" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_library(library, text):
    assert tokens.encoder(PATH).ids(text).tolist() == _ids(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("'’.,!? \n\t<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_like_the_library_on_any_text(text):
    assert tokens.encoder(PATH).ids(text).tolist() == _ids(Tokenizer_once(), text)


def Tokenizer_once(held=[]):  # noqa: B006
    if not held:
        held.append(Tokenizer.from_file(PATH))
    return held[0]


def test_lengths_are_optimal_and_limited():
    counts = np.zeros(300, np.int64)
    counts[:200] = np.random.default_rng(0).integers(1, 10_000, 200)
    free, short = tokenids.code_lengths(counts, 30), tokenids.code_lengths(counts, 8)
    assert short.max() <= 8 and (free[200:] == 0).all()
    for lengths in (free, short):
        assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() == 1
    entropy = -(counts[:200] / counts.sum() * np.log2(counts[:200] / counts.sum())).sum()
    assert entropy <= (free * counts).sum() / counts.sum() <= entropy + 1
    fibonacci = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55], np.int64)
    assert tokenids.code_lengths(fibonacci, 30).max() == 9 and tokenids.code_lengths(fibonacci, 4).max() == 4
    assert tokenids.code_lengths(np.array([0, 5]), 4).tolist() == [0, 1] and tokenids.code_lengths(np.zeros(3, np.int64), 4).tolist() == [0, 0, 0]


def test_canonical_codes_are_prefix_free_and_in_order():
    lengths = np.array([2, 0, 3, 3, 2, 2], np.uint8)
    assert [format(int(c), f"0{n}b") for c, n in zip(tokenids.canonical(lengths), lengths) if n] == ["00", "110", "111", "01", "10"]


@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_blocks_decode_from_their_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(999, rng.geometric(0.05, n)).astype(np.uint16)
    lengths = tokenids.code_lengths(np.bincount(ids, minlength=1000), 12)
    data, points = tokenids.pack(ids, lengths, tokenids.canonical(lengths))
    assert len(points) == -(-n // tokenids.EVERY)
    assert (tokenids.Decoder(lengths).block(data, points, n) == ids).all()


def test_round_trip(spark, library, monkeypatch):
    rows = cases.documents()
    docs = cases.clashing(cases.frame(spark, rows))
    got = tokenids.decode(spark, tokenids.encode(docs, PATH)).orderBy("start").collect()
    order = sorted(((i is not None, i or 0, np.array(_ids(library, t), "<u2").tobytes()) for i, t, *_ in rows), key=lambda x: x[:2])
    assert [r.doc_id for r in got] == [i if known else None for known, i, _ in order]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(_ids(library, t)) for _, t, *_ in rows)


def test_empty_table(spark):
    none = cases.frame(spark, [])
    assert tokenids.round_trip_digest(none, PATH).collect() == []
    assert packing.pack(none, PATH).collect() == []


def _best_fit(lengths, capacity):
    """One by one: the tightest open bin."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_runs_are_best_fit_decreasing(lengths, capacity):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = sorted(packing.place(counts, capacity))
    bins = defaultdict(list)
    for k, (n, first, start, per, offset) in enumerate(runs):
        last = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else counts[n]
        for o in range(last - first):
            bins[start + o // per].append((offset + o % per * n, n))
    assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
    assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == _best_fit(lengths, capacity)


def test_packing_whole_documents(spark, library):
    rows = cases.documents()
    got = packing.pack(cases.clashing(cases.frame(spark, rows)), PATH, capacity=512, with_ids=True).collect()
    texts = sorted(tuple(_ids(library, t)) for _, t, *_ in rows)
    assert sum(r.length for r in got) == sum(map(len, texts))
    pieces = sorted((i or -1, k, len(ids[k * 512 : k * 512 + 512])) for i, t, *_ in rows for ids in [_ids(library, t)] for k in range(-(-len(ids) // 512)))
    assert sorted((r.doc_id or -1, r.piece, r.length) for r in got) == pieces
    by = defaultdict(list)
    for r in got:
        assert r.start == r.piece * 512 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        by[r.sequence_id].append((r.offset, r.length))
    for b in by.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 512
    assert len(by) == len(_best_fit([r.length for r in got], 512))
