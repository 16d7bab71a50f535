"""Documents that every operator must cope with."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'abcdefgh'[rng.randrange(8)]}" for _ in range(n))


def documents(seed=1):
    """Nulls, empty and very long texts, repeated rows and ids, odd characters, near copies."""
    rng = random.Random(seed)
    rows = [(k, words(rng, rng.choice((3, 20, 60, 200)))) for k in range(40)]
    base = words(rng, 120)
    rows += [(100 + k, " ".join(base.split()[:k] + [f"edit{k}"] + base.split()[k + 1 :])) for k in range(12)]
    rows += [(200, base), (201, base), (202, base.upper()), (203, base + " ")]
    rows += [(300, None), (301, ""), (302, "   \n\t "), (None, "an id is missing here and so it goes on"), (None, None), (303, "É ß ñ 漢字 🎉   x y İ"), (304, "one two"), (305, "z" * 5000), (306, words(rng, 4000))]
    rows += [(7, rows[7][1]), (7, "same id but another text altogether")]  # a repeated row, a repeated id
    return [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """Extra columns under names that operators use themselves."""
    from pyspark.sql import functions as F

    extra = ["score", "predicted", "held_out", "k1", "k2", "node", "sig", "key", "spots", "words", "n_words", "hash", "bucket", "length", "piece", "_d1", "_bad1", "_pii_key", "body", "label", "comp"]
    return df.withColumns({c: F.lit("x") for c in extra})
