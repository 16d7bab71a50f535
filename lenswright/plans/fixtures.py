"""Derived tables over the driver's tables that the registered queries run on, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import confusion, predicted, with_rates
from ..operators.neardup import groups, simhash
from .workspace import by_merge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, content: Column | None = None) -> DataFrame:
    """Labelled files in three splits: doc_id, path, label, split, text.

    ``content`` of the text in its place keeps whole texts out of the join.
    """
    text = F.col("text") if content is None else content.alias("text")
    d, i = table(spark, sf_dir, "documents").select("doc_id", text).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id"), F.col("doc_id")
    path = F.concat(F.lit("/data/batch_"), (i % 16).cast("string"), F.lit("/DOC_"), (i % 312).cast("string"), F.lit(".txt"))
    split = F.when(i % 20 < 14, "train").when(i % 20 < 17, "validation").otherwise("test")
    return d.select("doc_id", path.alias("path"), F.col("toxic").alias("label"), split.alias("split"), "text")


SAMPLES = """samples AS (SELECT d.doc_id, concat('/data/batch_', CAST(d.doc_id % 16 AS VARCHAR), '/DOC_', CAST(d.doc_id % 312 AS VARCHAR), '.txt') AS path, l.toxic AS label,
  CASE WHEN d.doc_id % 20 < 14 THEN 'train' WHEN d.doc_id % 20 < 17 THEN 'validation' ELSE 'test' END AS split, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's probabilities: doc_id, label, prob."""
    i = F.col("doc_id")
    prob = F.lit(0.6) * (((i * 7919) % 1000).cast("double") / F.lit(1000.0)) + F.lit(0.35) * F.col("toxic").cast("double")
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"), prob.alias("prob"))


SCORES = """scores AS (SELECT doc_id, toxic AS label, CAST(0.6 AS DOUBLE) * (CAST((doc_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)) + CAST(0.35 AS DOUBLE) * CAST(toxic AS DOUBLE) AS prob FROM labels)"""


def tied_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, in steps of a twentieth, so that many rows tie."""
    return scores(spark, sf_dir).withColumn("prob", F.floor(F.col("prob") * F.lit(20.0)).cast("double") / F.lit(20.0))


TIED = SCORES + ", tied AS (SELECT doc_id, label, CAST(floor(prob * CAST(20 AS DOUBLE)) AS DOUBLE) / CAST(20 AS DOUBLE) AS prob FROM scores)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected boxes on 640 x 480 images, one claim an order."""
    x = ((F.col("l_partkey") * 37) % 600).cast("double") + F.col("l_discount")
    y = ((F.col("l_suppkey") * 53) % 440).cast("double") + F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("class_id"), (F.lit(0.25) + F.col("l_discount") * F.lit(7.0)).alias("conf"), x.alias("x1"), y.alias("y1"),
        (x + F.col("l_quantity") * F.lit(8.0)).alias("x2"), (y + F.col("l_quantity") * F.lit(6.0)).alias("y2"), F.lit(640).alias("w"), F.lit(480).alias("h"),
    )


_X, _Y = "CAST((l_partkey * 37) % 600 AS DOUBLE) + l_discount", "CAST((l_suppkey * 53) % 440 AS DOUBLE) + l_tax"
BOXES = f"""boxes AS (SELECT l_orderkey AS claim_id, l_linenumber AS class_id, CAST(0.25 AS DOUBLE) + l_discount * CAST(7 AS DOUBLE) AS conf, {_X} AS x1, {_Y} AS y1,
  {_X} + l_quantity * CAST(8 AS DOUBLE) AS x2, {_Y} + l_quantity * CAST(6 AS DOUBLE) AS y2, 640 AS w, 480 AS h FROM lineitem)"""
SCORED = (
    BOXES
    + """, area AS (SELECT *, CAST(greatest(0, x2 - x1) AS DOUBLE) * CAST(greatest(0, y2 - y1) AS DOUBLE) / CAST(w * h AS DOUBLE) * CAST(100 AS DOUBLE) AS a FROM boxes),
raw AS (SELECT *, least(greatest((CASE WHEN a <= 2 THEN a / CAST(2 AS DOUBLE) * CAST(25 AS DOUBLE) WHEN a <= 8 THEN CAST(25 AS DOUBLE) + (a - CAST(2 AS DOUBLE)) / CAST(6 AS DOUBLE) * CAST(25 AS DOUBLE)
  WHEN a <= 20 THEN CAST(50 AS DOUBLE) + (a - CAST(8 AS DOUBLE)) / CAST(12 AS DOUBLE) * CAST(30 AS DOUBLE) ELSE CAST(80 AS DOUBLE) + least(a - CAST(20 AS DOUBLE), CAST(20 AS DOUBLE)) / CAST(20 AS DOUBLE) * CAST(10 AS DOUBLE) END)
  * CAST(0.9 AS DOUBLE) + conf * CAST(10 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(100 AS DOUBLE)) AS s FROM area),
det AS (SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY x1, y1, x2, y2, conf, class_id) AS INT) AS box_no, class_id, CAST(printf('%.4f', conf) AS DOUBLE) AS confidence,
  CAST(printf('%.2f', x1) AS DOUBLE) AS x1, CAST(printf('%.2f', y1) AS DOUBLE) AS y1, CAST(printf('%.2f', x2) AS DOUBLE) AS x2, CAST(printf('%.2f', y2) AS DOUBLE) AS y2, CAST(printf('%.2f', a) AS DOUBLE) AS area_percentage,
  CASE WHEN s < 25 THEN 'Low' WHEN s < 50 THEN 'Moderate' WHEN s < 75 THEN 'High' ELSE 'Severe' END AS severity, CAST(printf('%.2f', s) AS DOUBLE) AS severity_score, w, h FROM raw)"""
)
_TOTAL = "least(max(severity_score) + least((count(*) - 1) * 3, 15), CAST(100 AS DOUBLE))"
OVERALL = (
    SCORED
    + f""", tot AS (SELECT claim_id, count(*) AS damage_count, {_TOTAL} AS t FROM det GROUP BY claim_id),
overall AS (SELECT c.claim_id, t.claim_id IS NOT NULL AS damage_detected, coalesce(damage_count, 0) AS damage_count, CASE WHEN t IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(printf('%.2f', t) AS DOUBLE) END AS overall_severity_score,
  CASE WHEN t IS NULL THEN 'No Damage Detected' WHEN t < 25 THEN 'Low' WHEN t < 50 THEN 'Moderate' WHEN t < 75 THEN 'High' ELSE 'Severe' END AS overall_severity
  FROM (SELECT DISTINCT o_orderkey AS claim_id FROM orders UNION SELECT claim_id FROM tot) c LEFT JOIN tot t ON t.claim_id = c.claim_id)"""
)
COVERAGE = (
    SCORED
    + """, v AS (SELECT claim_id, least(greatest(CAST(round_even(x1, 0) AS INT), 0), w - 1) AS x1, least(greatest(CAST(round_even(y1, 0) AS INT), 0), h - 1) AS y1,
  least(greatest(CAST(round_even(x2, 0) AS INT), 0), w) AS x2, least(greatest(CAST(round_even(y2, 0) AS INT), 0), h) AS y2 FROM det),
vv AS (SELECT * FROM v WHERE x2 > x1 AND y2 > y1), ed AS (SELECT claim_id, x1 AS x FROM vv UNION SELECT claim_id, x2 FROM vv),
sl AS (SELECT claim_id, x AS xa, lead(x) OVER (PARTITION BY claim_id ORDER BY x) AS xb FROM ed),
ac AS (SELECT sl.claim_id, xa, xb, y1, y2 FROM sl JOIN vv ON vv.claim_id = sl.claim_id AND vv.x1 <= xa AND vv.x2 >= xb WHERE xb IS NOT NULL),
m AS (SELECT *, max(y2) OVER (PARTITION BY claim_id, xa ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM ac),
px AS (SELECT claim_id, CAST(sum((xb - xa) * greatest(0, y2 - greatest(y1, coalesce(pm, y1)))) AS BIGINT) AS n FROM m GROUP BY 1),
coverage AS (SELECT d.claim_id, coalesce(max(n), 0) AS covered_pixels, CAST(printf('%.2f', CAST(coalesce(max(n), 0) AS DOUBLE) / CAST(640 * 480 AS DOUBLE) * CAST(100 AS DOUBLE)) AS DOUBLE) AS damage_coverage_percentage
  FROM det d LEFT JOIN px ON px.claim_id = d.claim_id GROUP BY d.claim_id)"""
)


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


SIMHASH = """h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) AS x FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> ''),
hashes AS (SELECT doc_id, CAST(sum(CASE WHEN s > 0 THEN CAST(1 AS BIGINT) << k ELSE 0 END) AS BIGINT) AS hash FROM (SELECT doc_id, k, sum(2 * ((x >> k) & 1) - 1) AS s FROM h, (SELECT CAST(unnest(range(60)) AS INT) AS k) GROUP BY 1, 2) GROUP BY 1),
pairs AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS distance FROM hashes a JOIN hashes b ON a.doc_id < b.doc_id AND bit_count(xor(a.hash, b.hash)) <= 4)"""


def split_of(i: Column) -> Column:
    return F.when(i % 20 < 14, "train").when(i % 20 < 17, "validation").otherwise("test")


def grouped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its near-duplicate group, with a split and a label (0 where none is known)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    found = groups(hashes(spark, sf_dir), 4)
    return found.join(by_merge(labels), "doc_id", "left").select("doc_id", "group_id", F.coalesce("label", F.lit(0)).alias("label"), split_of(F.col("doc_id")).alias("split"))


GROUPED = (
    SIMHASH
    + """, e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach(a, b) AS (SELECT doc_id, doc_id FROM hashes UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1),
grouped AS (SELECT comp.doc_id, dense_rank() OVER (ORDER BY c) - 1 AS group_id, coalesce(l.toxic, 0) AS label, CASE WHEN comp.doc_id % 20 < 14 THEN 'train' WHEN comp.doc_id % 20 < 17 THEN 'validation' ELSE 'test' END AS split
  FROM comp LEFT JOIN labels l ON l.doc_id = comp.doc_id)"""
)


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with sizes; every 29th can't be read and has none."""
    i = F.col("doc_id")
    seen = lambda c: F.when(i % 29 != 0, c.cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", split_of(i).alias("split"), seen(320 + (i * 37) % 5 * 160).alias("width"), seen(240 + (i * 53) % 4 * 120).alias("height"))


SIZED = """sized AS (SELECT doc_id, CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN doc_id % 29 <> 0 THEN CAST(320 + (doc_id * 37) % 5 * 160 AS INT) END AS width, CASE WHEN doc_id % 29 <> 0 THEN CAST(240 + (doc_id * 53) % 4 * 120 AS INT) END AS height FROM documents)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's epochs with their f1."""
    by = tied_scores(spark, sf_dir).withColumn("epoch", F.col("doc_id") % 15)
    return with_rates(by.groupBy("epoch").agg(*confusion(F.col("label"), predicted(F.col("prob"), 0.45)))).select("epoch", "f1")


HISTORY = TIED + """, history AS (SELECT doc_id % 15 AS epoch, coalesce(CAST(2 * sum(CASE WHEN label = 1 AND prob >= 0.45 THEN 1 ELSE 0 END) AS DOUBLE)
  / nullif(CAST(2 * sum(CASE WHEN label = 1 AND prob >= 0.45 THEN 1 ELSE 0 END) + sum(CASE WHEN label = 0 AND prob >= 0.45 THEN 1 ELSE 0 END) + sum(CASE WHEN label = 1 AND prob < 0.45 THEN 1 ELSE 0 END) AS DOUBLE), 0), 0) AS f1 FROM tied GROUP BY 1)"""


def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding drawn as a grey image of 8 x 8: vec_id, split, image (as the image source has it)."""
    schema = "vec_id long, split string, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
    rows = table(spark, sf_dir, "embeddings").select("vec_id", split_of(F.col("vec_id")).alias("split"), "embedding")

    def drawn(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            images = []
            for i, x in zip(f["vec_id"], f["embedding"], strict=True):
                x = np.asarray(x, float)
                grey = np.rint(255 * (x - x.min()) / max(float(np.ptp(x)), 1e-9)).astype(np.uint8)
                images.append({"origin": f"vec-{i}", "height": 8, "width": 8, "nChannels": 1, "mode": 0, "data": grey.tobytes()})
            yield pd.DataFrame({"vec_id": f["vec_id"], "split": f["split"], "image": images})

    return rows.mapInPandas(drawn, schema)
