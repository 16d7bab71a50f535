import random
import zlib
from hashlib import sha256

import pytest

from lenswright.llm import merkle

from . import cases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, low=False):
    i, text, lang, source, n = row
    fields = (i, source, lang, n, text.translate(LOW) if low and text is not None else text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    root = top[-1][0]
    out = []
    for k, s in enumerate(order):
        for at, r in enumerate(sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            hit = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 == 0
            folded, proof = leaf(r, hit), ""
            for levels, i in ((trees[s], at), (top, k)):
                for nodes in levels[:-1]:
                    left, right = "".join(nodes[i - i % 16 : i]), "".join(nodes[i + 1 : i - i % 16 + 16])
                    proof += left + right
                    folded, i = h(left, folded, right), i // 16
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(proof), folded, folded == root))
    return out


def rows_of(seed, sizes):
    rng = random.Random(seed)
    out, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += rng.randrange(1, 4)
            out.append((i, rng.choice(("Text", "lower", None, "")) and f"{rng.choice('Ab')} {i}", rng.choice(("en", None)), source, rng.choice((None, i))))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17}, {"hot": 700, "b": 1, None: 16, "é": 257, "Z": 33, "": 2}, {f"s{k}": 1 + k % 3 for k in range(300)}, {"a": 1, "b": 1}])
def test_like_whole_trees(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    rows = rows_of(1, sizes)
    got = merkle.tampering(cases.frame(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_tasks_of_their_own(spark, monkeypatch):
    """Ranges and what they need meet where small shuffle partitions aren't put together."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = rows_of(3, {"hot": 400, "b": 20})
        assert sorted(map(str, map(tuple, merkle.tampering(cases.frame(spark, rows)).collect()))) == sorted(map(str, brute(rows)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark, monkeypatch):
    """Nulls, repeated rows over more than one range, repeated ids, clashing names; joins without broadcasts."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 40)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = cases.documents() + [(7, "Again", None, "src0", None)] * 120 + [(None, None, None, None, None)] * 3
    got = merkle.tampering(cases.clashing(cases.frame(spark, rows)).withColumnsRenamed({"node": "tree", "key": "part", "hash": "index", "spots": "tie"})).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    assert merkle.tampering(cases.frame(spark, [])).collect() == []


def test_reduction_in_small_steps(spark, monkeypatch):
    """Forests added two by two give the same root, and hold no more than two rims."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 20)
    rows = rows_of(2, {"hot": 900, "b": 50, "c": 1})
    docs = cases.frame(spark, rows)
    placed, trees = merkle._placed(docs.select("doc_id", "source", merkle.leaf(merkle.F.col("text")).alias("leaf"), merkle.F.lit(None).cast("string").alias("changed")))
    forests = merkle._forests(placed, trees)
    assert max(r["count"] for r in forests.groupBy("part").count().collect()) <= 2 * 15 * 4
    for fan in (2, 3, 64):
        left, _ = merkle.tree_reduce(forests, trees, fan)
        assert [bytes(r.digest).decode() for r in left.collect()] == [brute(rows)[0][3]]


def test_sum_is_associative_and_commutative():
    rng = random.Random(5)
    leaves = [(0, 300, 0, k, h(str(k)).encode()) for k in range(300)]
    for _ in range(20):
        rng.shuffle(leaves)
        cut = sorted(rng.sample(range(300), 3))
        parts = []
        for a, b in zip([0, *cut], [*cut, 300]):
            f = merkle.Forest(1)
            for x in leaves[a:b]:
                f.add(*x)
            parts.append(f)
        while len(parts) > 1:
            x, y = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            total = merkle.Forest(1)
            for node in [*x.nodes(), *y.nodes()]:
                total.add(*node)
            parts.append(total)
        assert [n[-1].decode() for n in parts[0].nodes()] == [tree([h(str(k)) for k in range(300)])[-1][0]]


def test_manifest_without_changes_is_verified(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r.verified for r in merkle.manifest(docs).select("verified").collect()} == {True}
