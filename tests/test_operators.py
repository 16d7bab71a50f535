import hashlib
import json
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lenswright.functions import numeric, paths
from lenswright.operators import audit, claims, components, damage, eda, metrics, neardup, scoring, splits
from lenswright.plans import catalogue

from .conftest import DATA


def _scores(spark, rows):
    return spark.createDataFrame(rows, "label int, prob double")


@pytest.mark.parametrize(("counts", "expected"), [((943, 7, 13, 37), (0.98, 0.8409090909090909, 0.74, 0.7872340425531915)), ((944, 1, 13, 29), (None, 0.9666666666666667, 0.6904761904761905, 0.8055555555555556)), ((939, 6, 9, 33), (None, 0.8461538461538461, 0.7857142857142857, 0.8148148148148148)), ((0, 0, 0, 0), (0, 0, 0, 0))])
def test_published_identities(spark, counts, expected):
    r = metrics.with_rates(spark.createDataFrame([counts], "tn long, fp long, fn long, tp long")).first()
    for got, want in zip((r.accuracy, r.precision, r.recall, r.f1), expected, strict=True):
        assert want is None or got == pytest.approx(want, abs=1e-15)


def test_areas(spark):
    s = _scores(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    assert metrics.average_precision(s).first()[0] == pytest.approx(0.8333333333)
    assert metrics.roc_auc(s).first()[0] == pytest.approx(0.75)
    one = metrics.metric_bundle(_scores(spark, [(0, 0.2), (0, 0.9)])).first()
    assert (one.roc_auc, one.average_precision, one.fp) == (0.0, 0.0, 1)
    assert metrics.metric_bundle(_scores(spark, [])).first().accuracy == 0


def test_areas_like_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.randrange(12) / 12) for _ in range(200)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(_scores(spark, rows)).first()[0] == pytest.approx(auc)


def test_ties_rank_the_lowest_threshold_first(spark):
    top = metrics.ranked_thresholds(metrics.threshold_sweep(_scores(spark, [(1, 0.9), (0, 0.1)])), 3).orderBy("rank").collect()
    assert [r.threshold for r in top] == sorted(r.threshold for r in top) and top[0].f1 == 1


def test_the_grid(spark):
    grid = spark.range(1).select(numeric.threshold_grid()).first()[0]
    assert grid == np.arange(0.05, 0.96, 0.01).tolist()


def test_rounding(spark):
    rng = random.Random(1)
    xs = [2.675, 1.005, 0.125, -0.125, 1e6 + 0.005, *(rng.uniform(-1000, 1000) for _ in range(500)), *(rng.randrange(10**6) / 1000 for _ in range(500))]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(numeric.python_round(F.col("x")), numeric.python_int(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(round(x, 2), int(round(x))) for x in xs]
    assert spark.range(1).select(numeric.percentage(F.lit(1), F.lit(3)), numeric.percentage(F.lit(1), F.lit(0))).first() == (33.33, 0.0)


def test_paths(spark):
    rows = spark.createDataFrame([("/A/./b/../c//d.Tar.GZ",), ("/x/.hidden",), ("/x/plain",)], "p string")
    p = F.col("p")
    got = rows.select(paths.canonical(p), paths.filename(p), paths.stem(p), paths.suffix(p)).collect()
    assert [tuple(r) for r in got] == [("/a/c/d.tar.gz", "d.tar.gz", "d.tar", ".gz"), ("/x/.hidden", ".hidden", ".hidden", ""), ("/x/plain", "plain", "plain", "")]


def test_steps_back_fold_at_any_depth(spark):
    deep = [f"/r{'/A' * n}{'/..' * n}/x" for n in (1, 8, 9, 40)]
    other = {"/a/..": "", "/../a": "/../a", "../a/../b": "../b", "./../a": "./../a", "/a/../../b": "/../b", "/a/b/.././../C": "/c", "/a..b/..c/d": "/a..b/..c/d", None: None}
    rows = spark.createDataFrame([(p,) for p in [*deep, *other]], "p string")
    assert [r[0] for r in rows.select(paths.canonical(F.col("p"))).collect()] == ["/r/x"] * 4 + list(other.values())


@pytest.mark.parametrize("k", [2, 4, 6])
def test_banded_join_is_exact(spark, k):
    rng = random.Random(k)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(120)]
    hashes += [h ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(8))) for h in hashes[:80]] + hashes[:5]
    items = spark.createDataFrame(list(enumerate(hashes)), "doc_id long, hash long")
    got = {(r.id_a, r.id_b, r.distance) for r in neardup.hamming_pairs(items, k).collect()}
    near = {(a, b, d) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if (d := ((hashes[a] ^ hashes[b]) & (2**64 - 1)).bit_count()) <= k}
    assert got == near
    groups = {r.doc_id: r.group_id for r in neardup.groups(items, k).collect()}
    root = list(range(len(hashes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in near:
        root[max(find(a), find(b))] = min(find(a), find(b))
    heads = sorted({find(x) for x in range(len(hashes))})
    assert groups == {x: heads.index(find(x)) for x in range(len(hashes))}


def test_every_pair_of_splits_is_audited(spark):
    splits = ("train", "train", "validation", "validation", "test", "test")
    hashes = (0, 1 << 20, 0b11, 1 << 40, 1 << 40, -1)
    items = spark.createDataFrame([(k, h, s) for k, (h, s) in enumerate(zip(hashes, splits, strict=True))], "doc_id long, hash long, split string")
    want = set()
    for a, b in audit.PAIRS:
        for x in (k for k in range(6) if splits[k] == a):
            d, y = min((((hashes[x] ^ hashes[y]) & (2**64 - 1)).bit_count(), y) for y in range(6) if splits[y] == b)
            if d <= 6:
                want.add((a, b, x, y, d))
    assert {w[:2] for w in want} == set(audit.PAIRS)
    assert {tuple(r) for r in neardup.nearest_across_splits(items, 6).collect()} == want


@pytest.mark.parametrize("k", [0, 1, 2, 5, 6])
def test_nearest_in_dense_places(spark, k):
    """A crowd around one hash, near and far strangers, ties, repeated rows and rows without a hash."""
    rng = random.Random(k)
    crowd = [sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(150)]
    far = [rng.getrandbits(64) for _ in range(20)]
    near_far = [x ^ sum(1 << b for b in rng.sample(range(64), 5)) for x in far]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    left = [*crowd[:80], *far, crowd[0], None]
    right = [*crowd[80:], *near_far, crowd[80], None]
    frame = lambda hashes, first: spark.createDataFrame([(first + i, h if h is None else signed(h)) for i, h in enumerate(hashes)], "doc_id long, hash long")
    want = set()
    for i, x in enumerate(left):
        d, y = min(((x ^ y).bit_count(), 1000 + j) for j, y in enumerate(right) if y is not None) if x is not None else (99, 0)
        if d <= k:
            want.add((i, y, d))
    assert {tuple(r) for r in neardup.nearest(frame(left, 0), frame(right, 1000), k).collect()} == want
    assert neardup.nearest(frame([], 0), frame(right, 1000), k).collect() == []
    assert neardup.nearest(frame(left, 0), frame([], 1000), k).collect() == []


def test_the_radius_grows_to_its_end():
    assert [neardup.radii(k) for k in (0, 1, 2, 3, 4, 6, 8)] == [[0], [0, 1], [0, 1, 2], [0, 1, 2, 3], [0, 1, 2, 4], [0, 1, 2, 4, 6], [0, 1, 2, 4, 8]]


def test_near_copies_of_the_validation_split_are_reported(spark):
    got = {(r.split_a, r.split_b) for r in catalogue.queries()["near_duplicate_audit"](spark, DATA).collect()}
    assert {("train", "validation"), ("validation", "test")} <= got


def test_the_embedding_classifier_learns_from_all_rows(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = {r.vec_id: r.prob for r in scoring.embedding_classifier(e, e).collect()}
    got = {r.vec_id: r.prob for r in catalogue.queries()["embedding_classifier_scores"](spark, DATA).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_similarity_hashes_like_bit_sums(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(n)) for n in (1, 2, 3, 17, 90, 4000)] + ["", " ", None]
    got = {r.doc_id: r.hash for r in neardup.simhash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {}
    for i, t in enumerate(texts):
        if words := {w for w in (t or "").split(" ") if w}:
            hashes = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words]
            want[i] = sum(1 << k for k in range(60) if sum(2 * (h >> k & 1) - 1 for h in hashes) > 0)
    assert got == want


def test_duplicates_are_rows_and_nulls_have_none(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("c", "y"), ("d", None), ("e", None)], "path string, content string")
    got = eda.duplicate_groups(df, F.col("content"))
    assert sorted(map(tuple, got.collect())) == [("x", 3, "a"), ("x", 3, "b"), ("x", 3, "b")]
    assert eda.duplicate_groups(df.limit(0), F.col("content")).count() == 0


def test_transitive_groups_and_nulls(spark):
    items = spark.createDataFrame([(1, 0), (2, 0xF), (3, 0xFF), (4, None)], "doc_id long, hash long")
    assert {r.doc_id: r.group_id for r in neardup.groups(items, 4).collect()} == {1: 0, 2: 0, 3: 0}
    with pytest.raises(Exception, match="no hash"):
        neardup.groups(items, 4, on_null="raise").collect()


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


BOX = "claim_id long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double, w int, h int"


def _python_box(c, x1, y1, x2, y2, w, h):
    area = max(0, x2 - x1) * max(0, y2 - y1) / (w * h) * 100
    s = area / 2 * 25 if area <= 2 else 25 + (area - 2) / 6 * 25 if area <= 8 else 50 + (area - 8) / 12 * 30 if area <= 20 else 80 + min(area - 20, 20) / 20 * 10
    s = min(max(s * 0.9 + c * 10, 0), 100)
    return round(s, 2), "Low" if s < 25 else "Moderate" if s < 50 else "High" if s < 75 else "Severe"


def test_severity_knots(spark):
    rows = [(k, 0, 1.0, 0.0, 0.0, a, 1.0, 100, 1) for k, a in enumerate((2.0, 8.0, 20.0, 40.0, 90.0))]
    got = damage.scored_boxes(spark.createDataFrame(rows, BOX)).orderBy("claim_id").collect()
    assert [r.severity_score for r in got] == [32.5, 55.0, 82.0, 91.0, 91.0]


def test_boxes_like_python_and_pixels(spark):
    rng = random.Random(4)
    rows = []
    for claim in range(60):
        for _ in range(rng.randrange(1, 7)):
            x, y = rng.uniform(-20, 60), rng.uniform(-20, 40)
            rows.append((claim, 0, rng.random(), x, y, x + rng.uniform(-5, 40), y + rng.choice((0.4, 0.5, 9.5, 30.0)), 64, 48))
    scored = damage.scored_boxes(spark.createDataFrame(rows, BOX))
    got = scored.collect()
    assert sorted((r.claim_id, r.severity_score, r.severity) for r in got) == sorted((r[0], *_python_box(*r[2:])) for r in rows)
    masks, scores = defaultdict(lambda: np.zeros((48, 64), bool)), defaultdict(list)
    for r in got:
        masks[r.claim_id][max(0, min(round(r.y1), 47)) : max(0, min(round(r.y2), 48)), max(0, min(round(r.x1), 63)) : max(0, min(round(r.x2), 64))] = True
        scores[r.claim_id].append(r.severity_score)
    for r in damage.coverage(scored).collect():
        assert r.covered_pixels == masks[r.claim_id].sum() and r.damage_coverage_percentage == round(float(masks[r.claim_id].sum() / (64 * 48) * 100), 2)
    claims_table = spark.createDataFrame([(k,) for k in range(62)], "claim_id long")
    for r in damage.overall(scored, claims_table).collect():
        s = scores.get(r.claim_id)
        if s:
            assert r.overall_severity_score == round(min(max(s) + min((len(s) - 1) * 3, 15), 100), 2) and r.damage_count == len(s)
        else:
            assert (r.damage_detected, r.damage_count, r.overall_severity, r.overall_severity_score) == (False, 0, damage.NO_DAMAGE, 0.0)


def test_suppression(spark):
    rng = random.Random(5)
    rows = []
    for claim in range(20):
        for _ in range(rng.randrange(12)):
            x, y = rng.uniform(0, 30), rng.uniform(0, 30)
            rows.append((claim, rng.randrange(2), round(rng.uniform(0.1, 1), 6), x, y, x + 20, y + 20, 64, 48))

    def overlap(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        both = max(0, w) * max(0, h)
        return both / (800 - both)

    kept = []
    for r in sorted(rows, key=lambda r: -r[2]):
        if r[2] >= 0.25 and all(k[:2] != r[:2] or overlap(k, r) <= 0.45 for k in kept):
            kept.append(r)
    assert sorted(map(tuple, damage.suppress(spark.createDataFrame(rows, BOX)).collect())) == sorted(kept)


def test_splits_cover_everything_and_share_nothing(spark):
    rows = spark.createDataFrame([(k, k % 37, int(k % 5 == 0)) for k in range(300)], "doc_id long, group_id long, label int")
    for out in (splits.development_split(rows, "group_id"), splits.three_way_split(rows, "group_id")):
        assert out.count() == 300
        assert audit.isolated(out, "group_id").first().isolated
        assert set(r.split for r in out.select("split").distinct().collect()) == {"train", "validation", "test"}
    dev = {r.split: r.n for r in splits.development_split(rows, "group_id").groupBy("split").agg(F.countDistinct("group_id").alias("n")).collect()}
    assert dev == {"test": 6, "validation": 6, "train": 25}
    strat = splits.stratified(rows, "doc_id", "label", 0.2).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in strat} == {(0, "train"): 192, (0, "validation"): 48, (1, "train"): 48, (1, "validation"): 12}
    with pytest.raises(Exception, match="several splits"):
        audit.isolated(rows.withColumn("split", F.when(F.col("doc_id") < 100, "train").otherwise("test")), "group_id").collect()


def test_required_columns_and_verdict(spark):
    with pytest.raises(ValueError, match="label"):
        audit.require_columns(spark.createDataFrame([("a",)], "path string"))
    cases = {(1, 0, 0, 0, 0): "LEAKAGE", (0, 1, 0, 0, 0): "LEAKAGE", (0, 0, 1, 0, 0): "SUSPICIOUS", (0, 0, 0, 1, 0): "SUSPICIOUS", (0, 0, 0, 0, 2): "SUSPICIOUS", (0, 0, 0, 0, 0): "PASS"}
    for counts, want in cases.items():
        assert spark.range(1).select(audit.verdict(*map(F.lit, counts))).first()[0] == want


def test_leakage_in_one_pass(spark):
    def row(samples):
        df = spark.createDataFrame(samples, "path string, split string, content string")
        p = F.col("path")
        return audit.leakage(df, paths.canonical(p), F.col("content"), paths.filename(p), paths.parent(p)).first()

    r = row([("/a/x.jpg", "train", "1"), ("/a/x.jpg", "train", "1"), ("/b/x.jpg", "test", "2"), ("/b/y.jpg", "test", "1"), ("/c/z.jpg", "validation", "9")])
    assert r.asDict() == {"shared_paths": 0, "shared_hashes": 1, "shared_filenames": 1, "shared_directories": 0, "internal_duplicates": 1, "verdict": "LEAKAGE"}
    assert row([("/a/x.jpg", "train", "1"), ("/b/y.jpg", "test", "2")]).verdict == "PASS"
    assert row([]).asDict() == {"shared_paths": 0, "shared_hashes": 0, "shared_filenames": 0, "shared_directories": 0, "internal_duplicates": 0, "verdict": "PASS"}


def test_predict_from_images_to_claims(spark):
    def detect(frames):
        import pandas as pd

        for f in frames:
            rows = [(c, 1 + k // 2, 0.9 - k / 10, 5.0, 5.0, 25.0 + k, 25.0, 64, 48) for c, n in zip(f["claim_id"], f["image"], strict=True) for k in range(n)]
            yield pd.DataFrame(rows, columns=["claim_id", "class_id", "conf", "x1", "y1", "x2", "y2", "w", "h"])

    images = spark.createDataFrame([(1, 0), (2, 1), (3, 4)], "claim_id long, image int")
    got = {r.claim_id: r for r in damage.predict(images, detect, spark.createDataFrame([(1, "dent")], "class_id int, name string")).collect()}
    assert (got[1].damage_detected, got[1].damage_count, got[1].damage_coverage_percentage, got[1].detections, got[1].overall_severity) == (False, 0, 0.0, [], damage.NO_DAMAGE)
    assert got[2].damage_count == 1 and got[2].damage_coverage_percentage == round(400 / (64 * 48) * 100, 2)
    assert sorted(d.damage_type for d in got[3].detections) == ["class_2", "dent"]
    assert damage.predict(images.limit(0), detect, spark.createDataFrame([(1, "dent")], "class_id int, name string")).count() == 0


def test_systematic_sample(spark):
    rows = spark.createDataFrame([(k,) for k in range(103)], "doc_id long")
    assert sorted(r.doc_id for r in eda.systematic_sample(rows, 10, "doc_id").collect()) == list(range(103))[::10][:10]
    assert sorted(r.doc_id for r in eda.systematic_sample(rows.limit(3), 10, "doc_id").collect()) == [0, 1, 2]


def test_reports_need_both_results(spark):
    fraud = spark.createDataFrame([(1, 0.9, 1, 0.9), (2, 0.1, 0, 0.9)], "claim_key long, prob double, prediction int, confidence double")
    dmg = spark.createDataFrame([(1, True, 1, 2.0, "Low", 3.0, [])], "claim_key long, damage_detected boolean, damage_count long, damage_coverage_percentage double, overall_severity string, overall_severity_score double, detections array<struct<damage_type: string>>")
    r = claims.report(fraud, dmg).collect()
    assert len(r) == 1 and r[0].fraud_label == "Fraud" and "90.0% probability" in r[0].summary
    assert json.loads(claims.report(fraud, dmg).toJSON().first())["damage_result"]["damage_count"] == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 60), st.floats(0, 60), st.floats(0.1, 20), st.floats(0.1, 20)), max_size=12))
def test_greedy_keeps_no_overlapping_pair(boxes):
    x1, y1, w, h = (np.array([b[k] for b in boxes]) for k in range(4)) if boxes else (np.zeros(0),) * 4
    kept = damage._greedy(x1, y1, x1 + w, y1 + h, 0.45)
    for a in kept:
        for b in kept:
            if a < b:
                both = max(0, min(x1[a] + w[a], x1[b] + w[b]) - max(x1[a], x1[b])) * max(0, min(y1[a] + h[a], y1[b] + h[b]) - max(y1[a], y1[b]))
                assert both <= 0.45 * (w[a] * h[a] + w[b] * h[b] - both) + 1e-9
