"""The registered queries of the core library and their DuckDB oracles, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, paths
from ..operators import audit, claims, damage, datasets, eda, images, metrics, neardup, pictures, scoring, splits, training
from ..sources import file_sink, files, positions, probe, sinks
from . import fixtures as fx
from .workspace import by_merge, materialise, numbered, work_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _register(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Sums of floats depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- metrics ---------------------------------------------------------------

_RATES = """coalesce(CAST(tp + tn AS DOUBLE) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0) AS accuracy, coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall, coalesce(CAST(2 * tp AS DOUBLE) / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1"""
_COUNTS = "CAST(sum(CASE WHEN label = 0 AND prob < {t} THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN label = 0 AND prob >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN label = 1 AND prob < {t} THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN label = 1 AND prob >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS tp"
_CONF = f"{fx.SCORES}, conf AS (SELECT {_COUNTS.format(t='0.5')} FROM scores)"
_GRID = "grid AS (SELECT CAST(0.05 AS DOUBLE) + CAST(i AS DOUBLE) * CAST(0.010000000000000002 AS DOUBLE) AS threshold FROM range(91) r(i))"
_SWEEP = f"{fx.SCORES}, {_GRID}, counts AS (SELECT threshold, {_COUNTS.format(t='threshold')} FROM scores, grid GROUP BY 1), sweep AS (SELECT threshold, {_RATES}, tn, fp, fn, tp FROM counts)"
_ORDER = "f1 DESC, recall DESC, precision DESC, threshold"


@_register(f"WITH {_SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_sweep(fx.scores(spark, sf_dir))


@_register(f"WITH {_SWEEP} SELECT * FROM sweep ORDER BY {_ORDER} LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranked_thresholds(threshold_sweep(spark, sf_dir), 1).drop("rank")


@_register(f"WITH {_SWEEP} SELECT *, CAST(row_number() OVER (ORDER BY {_ORDER}) AS INT) AS rank FROM sweep ORDER BY {_ORDER} LIMIT 10")
def top10_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranked_thresholds(threshold_sweep(spark, sf_dir), 10)


@_register(f"WITH {_CONF} SELECT * FROM conf")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(fx.scores(spark, sf_dir))


@_register(f"WITH {_CONF} SELECT {_RATES} FROM conf")
def prf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_rates(metrics.confusion_matrix(fx.scores(spark, sf_dir))).select("accuracy", "precision", "recall", "f1")


@_register(f"""WITH {_CONF}, c AS (SELECT 'Non-Fraud' AS class, tn AS hit, fn AS wrong, fp AS lost FROM conf UNION ALL SELECT 'Fraud', tp, fp, fn FROM conf),
r AS (SELECT class, coalesce(CAST(hit AS DOUBLE) / nullif(CAST(hit + wrong AS DOUBLE), 0), 0) AS precision, coalesce(CAST(hit AS DOUBLE) / nullif(CAST(hit + lost AS DOUBLE), 0), 0) AS recall,
  coalesce(CAST(2 * hit AS DOUBLE) / nullif(CAST(2 * hit + wrong + lost AS DOUBLE), 0), 0) AS f1, hit + lost AS support FROM c),
a AS (SELECT * FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r)
SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM a""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification_report(fx.scores(spark, sf_dir))


_ROC = """(SELECT round(sum(CASE WHEN p.prob > n.prob THEN CAST(1 AS DOUBLE) WHEN p.prob = n.prob THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / count(*), 9) FROM tied p, tied n WHERE p.label = 1 AND n.label = 0)"""
_AP = """(SELECT round(sum(CAST(pos AS DOUBLE) / npos * (CAST(cp AS DOUBLE) / cn)), 9) FROM (SELECT pos, sum(pos) OVER () AS npos, sum(pos) OVER (ORDER BY prob DESC) AS cp, sum(n) OVER (ORDER BY prob DESC) AS cn
  FROM (SELECT prob, sum(label) AS pos, count(*) AS n FROM tied GROUP BY 1)))"""


@_register(f"WITH {fx.TIED} SELECT {_ROC} AS roc_auc")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_auc(fx.tied_scores(spark, sf_dir)), "roc_auc")


@_register(f"WITH {fx.TIED} SELECT {_AP} AS average_precision")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.average_precision(fx.tied_scores(spark, sf_dir)), "average_precision")


@_register(f"WITH {fx.TIED}, conf AS (SELECT {_COUNTS.format(t='0.5')} FROM tied) SELECT tn, fp, fn, tp, {_RATES}, {_ROC} AS roc_auc, {_AP} AS average_precision FROM conf")
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.metric_bundle(fx.tied_scores(spark, sf_dir)), "roc_auc", "average_precision")


_PRED = f"{fx.SCORES}, pred AS (SELECT *, CAST(prob >= 0.30 AS INT) AS prediction FROM scores), predictions AS (SELECT *, label = prediction AS correct, CASE WHEN label = prediction THEN 'correct' WHEN label = 1 THEN 'missed_fraud' ELSE 'false_alarm' END AS error_type, CASE WHEN prediction = 1 THEN prob ELSE CAST(1 AS DOUBLE) - prob END AS confidence FROM pred)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.predictions(fx.scores(spark, sf_dir), claims.THRESHOLD)


@_register(f"WITH {_PRED} SELECT * FROM predictions")
def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir)


@_register(f"""WITH {_PRED} SELECT count(*) AS total, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE NOT correct) AS incorrect, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS caught_fraud,
count(*) FILTER (WHERE label = 1 AND prediction = 0) AS missed_fraud, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS false_alarms, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS passed FROM predictions""")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_summary(_predictions(spark, sf_dir))


@_register(f"WITH {fx.SCORES} SELECT doc_id, prob FROM scores WHERE label = 1 AND prob < CAST(0.6 AS DOUBLE) ORDER BY prob, doc_id LIMIT 13")
def top_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a threshold that misses some positives of the fixture."""
    missed = metrics.predictions(fx.scores(spark, sf_dir), 0.6).where("label = 1 and prediction = 0")
    return missed.orderBy("prob", "doc_id").limit(13).select("doc_id", "prob")


@_register(f"WITH {_PRED} SELECT doc_id, prob FROM predictions WHERE label = 0 AND prediction = 1 ORDER BY prob DESC, doc_id LIMIT 10")
def top_false_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).where("label = 0 and prediction = 1").orderBy(F.desc("prob"), "doc_id").limit(10).select("doc_id", "prob")


@_register(f"""WITH {fx.SCORES} SELECT label, count(*) AS n, round(avg(prob), 9) AS mean, round(stddev_samp(prob), 9) AS std, min(prob) AS lowest, round(quantile_cont(prob, 0.25), 9) AS q25, round(quantile_cont(prob, 0.5), 9) AS q50,
round(quantile_cont(prob, 0.75), 9) AS q75, max(prob) AS highest FROM scores GROUP BY label""")
def prob_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.describe(fx.scores(spark, sf_dir)), "mean", "std", "q25", "q50", "q75")


@_register(f"WITH {fx.SCORES} SELECT round(avg(-(label * ln(greatest(prob, CAST(1e-12 AS DOUBLE))) + (1 - label) * ln(greatest(1 - prob, CAST(1e-12 AS DOUBLE))))), 9) AS mean_loss FROM scores")
def bce_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.mean_loss(fx.scores(spark, sf_dir)), "mean_loss")


@_register(f"WITH {fx.HISTORY} SELECT * FROM history ORDER BY f1 DESC, epoch LIMIT 1")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_epoch(fx.history(spark, sf_dir))


@_register(f"WITH {fx.HISTORY}, b AS (SELECT epoch, f1, coalesce(max(f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS previous_best FROM history) SELECT *, f1 > previous_best AS improved FROM b")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.running_best(fx.history(spark, sf_dir))


@_register(f"WITH {fx.SCORES} SELECT doc_id, round(1 / (1 + exp(-(8 * prob - 4))), 9) AS sigmoid, round(exp(8 * prob - 4) / (exp(-prob) + exp(8 * prob - 4)), 9) AS softmax FROM scores")
def probability_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(8.0) * F.col("prob") - F.lit(4.0)
    return fx.scores(spark, sf_dir).select("doc_id", F.round(numeric.sigmoid(z), 9).alias("sigmoid"), F.round(numeric.softmax_second(-F.col("prob"), z), 9).alias("softmax"))


# -- profiles --------------------------------------------------------------


@_register(f"""WITH {fx.SAMPLES}, grid AS (SELECT s.split, CAST(c.label AS INT) AS label FROM (SELECT unnest(['train', 'validation', 'test']) AS split) s, (SELECT unnest([0, 1]) AS label) c)
SELECT g.split, g.label, CASE WHEN g.label = 0 THEN 'Non-Fraud' ELSE 'Fraud' END AS class_name, count(s.doc_id) AS n FROM grid g LEFT JOIN samples s ON s.split = g.split AND s.label = g.label GROUP BY 1, 2""")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.class_distribution(fx.samples(spark, sf_dir), ["train", "validation", "test"], [0, 1])


@_register(f"""WITH {fx.SAMPLES}, s AS (SELECT coalesce(split, 'overall') AS split, coalesce(CAST(label AS VARCHAR), 'all') AS class, count(*) AS n FROM samples GROUP BY GROUPING SETS ((split, label), (label), (split), ()))
SELECT split, class, n, CAST(printf('%.2f', n * CAST(100 AS DOUBLE) / max(CASE WHEN class = 'all' THEN n END) OVER (PARTITION BY split)) AS DOUBLE) AS percent FROM s""")
def class_totals_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.class_totals(fx.samples(spark, sf_dir))


@_register(f"WITH {fx.SAMPLES}, c AS (SELECT label, count(*) AS n FROM samples GROUP BY 1) SELECT label, n, CAST(CAST(CAST(sum(n) OVER () AS DOUBLE) / CAST(count(*) OVER () * n AS DOUBLE) AS FLOAT) AS DOUBLE) AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.class_weights(fx.samples(spark, sf_dir))


@_register(f"WITH {fx.SAMPLES}, c AS (SELECT split, label, count(*) AS n FROM samples GROUP BY 1, 2) SELECT split, label, n, CAST(100 AS DOUBLE) * n / CAST(sum(n) OVER (PARTITION BY split) AS DOUBLE) AS share FROM c")
def label_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.label_share(fx.samples(spark, sf_dir))


@_register("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.value_counts(fx.table(spark, sf_dir, "documents"), "source")


@_register(f"WITH {fx.SAMPLES} SELECT md5(text) AS hash, count(*) OVER (PARTITION BY md5(text)) AS n, path FROM samples WHERE text IS NOT NULL QUALIFY n > 1")
def exact_dup_groups_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.duplicate_groups(fx.samples(spark, sf_dir, F.md5(F.col("text").cast("binary"))), F.col("text"))


@_register(f"WITH {fx.SIZED} SELECT count(*) AS images, (SELECT count(*) FROM (SELECT DISTINCT width, height FROM sized WHERE width IS NOT NULL)) AS distinct_sizes, min(width) AS min_width, max(width) AS max_width, min(height) AS min_height, max(height) AS max_height FROM sized WHERE width IS NOT NULL")
def dimension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.dimension_stats(fx.sized(spark, sf_dir).where("width is not null"))


@_register(f"WITH {fx.SIZED} SELECT width, height, count(*) AS n, min(doc_id) AS first_seen FROM sized WHERE width IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, first_seen LIMIT 10")
def top_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.top_dimensions(fx.sized(spark, sf_dir).where("width is not null"))


@_register("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, greatest((SELECT count(*) FROM labels) // 16, 1) AS step FROM labels)
SELECT doc_id, pos // step AS sample_no, (pos // step) % 4 AS "column", pos // step // 4 AS "row" FROM p WHERE pos % step = 0 AND pos < step * 16""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.grid_cells(eda.systematic_sample(fx.table(spark, sf_dir, "labels").select("doc_id"), 16, "doc_id"), 4)


@_register(f"""WITH {fx.SIZED}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS k FROM sized)
SELECT split, count(*) AS checked, count(width) AS readable, min(width) AS min_width, max(width) AS max_width, min(height) AS min_height, max(height) AS max_height FROM r WHERE k <= 100 GROUP BY 1""")
def head_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.head_sanity(fx.sized(spark, sf_dir))


@_register(f"""WITH {fx.SAMPLES} SELECT doc_id, lower(path) AS canonical, lower(split_part(path, '/', -1)) AS filename, regexp_replace(lower(split_part(path, '/', -1)), '\\.[^.]*$', '') AS stem,
lower(regexp_replace(path, '/[^/]*$', '')) AS parent, '.txt' AS suffix, substr(path, 7) AS relative, split_part(path, '/', -2) AS folder, printf('group_%04d.jpg', doc_id) AS output_name FROM samples""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    messy = F.regexp_replace(p, "^/data/", "/data/./other/../")
    return fx.samples(spark, sf_dir).select(
        "doc_id", paths.canonical(messy).alias("canonical"), paths.filename(p).alias("filename"), paths.stem(p).alias("stem"), paths.parent(p).alias("parent"), paths.suffix(p).alias("suffix"), paths.relative(p, "/data").alias("relative"),
        paths.part(p, 2).alias("folder"), paths.numbered("group_%04d.jpg", F.col("doc_id")).alias("output_name"),
    )


# -- audits ----------------------------------------------------------------

_PAIRS = "pr AS (SELECT * FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) v(split_a, split_b))"


def _overlap_sql(key: str, n: int) -> str:
    return f"""WITH {fx.SAMPLES}, {_PAIRS}, k AS (SELECT DISTINCT {key} AS key, split FROM samples), s AS (SELECT split_a, split_b, a.key, row_number() OVER (PARTITION BY split_a, split_b ORDER BY a.key) AS r
  FROM pr JOIN k a ON a.split = split_a JOIN k b ON b.split = split_b AND a.key = b.key)
SELECT pr.split_a, pr.split_b, count(s.key) AS shared, coalesce(string_agg(s.key, '|' ORDER BY s.key) FILTER (WHERE r <= {n}), '') AS examples FROM pr LEFT JOIN s ON s.split_a = pr.split_a AND s.split_b = pr.split_b GROUP BY 1, 2"""


@_register(_overlap_sql("lower(path)", 5))
def path_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overlap(fx.samples(spark, sf_dir), paths.canonical(F.col("path")), 5)


@_register(_overlap_sql("lower(split_part(path, '/', -1))", 10))
def filename_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overlap(fx.samples(spark, sf_dir), paths.filename(F.col("path")), 10)


@_register(f"""WITH {fx.SAMPLES}, {_PAIRS}, hs AS (SELECT sha256(text) AS hash, split, count(*) AS n, array_to_string(list_sort(list_distinct(list(path)))[1:2], '|') AS paths FROM samples GROUP BY 1, 2)
SELECT split_a, split_b, a.hash, a.n AS files_a, b.n AS files_b, a.paths AS paths_a, b.paths AS paths_b FROM pr JOIN hs a ON a.split = split_a JOIN hs b ON b.split = split_b AND b.hash = a.hash""")
def sha256_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.hash_overlap(fx.samples(spark, sf_dir, F.sha2("text", 256)), F.col("text"))


@_register(f"WITH {fx.SAMPLES} SELECT lower(regexp_replace(path, '/[^/]*$', '')) AS directory, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM samples GROUP BY 1 HAVING count(DISTINCT split) > 1")
def directory_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.directory_overlap(fx.samples(spark, sf_dir), paths.parent(F.col("path")))


@_register(f"WITH {fx.SAMPLES} SELECT split, count(*) - count(DISTINCT lower(path)) AS duplicate_paths, count(*) - count(DISTINCT lower(split_part(path, '/', -1))) AS duplicate_filenames FROM samples GROUP BY 1")
def internal_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.internal_duplicates(fx.samples(spark, sf_dir), paths.canonical(F.col("path")), paths.filename(F.col("path")))


@_register("SELECT column_name AS missing FROM (VALUES ('label'), ('path'), ('doc_id')) v(column_name) WHERE column_name NOT IN ('doc_id', 'text', 'lang', 'source', 'n_chars')")
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = audit.missing_columns(fx.table(spark, sf_dir, "documents"), ("path", "label", "doc_id"))
    return spark.createDataFrame([(c,) for c in gone], "missing string")


def _multi(key: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {key} FROM samples GROUP BY 1 HAVING count(DISTINCT split) > 1))"


@_register(f"""WITH {fx.SAMPLES}, v AS (SELECT {_multi("lower(path)")} AS shared_paths, {_multi("sha256(text)")} AS shared_hashes, {_multi("lower(split_part(path, '/', -1))")} AS shared_filenames, {_multi("lower(regexp_replace(path, '/[^/]*$', ''))")} AS shared_directories,
  (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT split, lower(path) FROM samples)) FROM samples) AS internal_duplicates)
SELECT *, CASE WHEN shared_paths > 0 OR shared_hashes > 0 THEN 'LEAKAGE' WHEN shared_filenames > 0 OR internal_duplicates > 0 OR shared_directories > 0 THEN 'SUSPICIOUS' ELSE 'PASS' END AS verdict FROM v""")
def leakage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    s = fx.samples(spark, sf_dir, F.sha2("text", 256))
    return audit.leakage(s, paths.canonical(p), F.col("text"), paths.filename(p), paths.parent(p))


@_register("SELECT doc_id, concat('/docs/', CAST(doc_id AS VARCHAR)) AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("path")
    return audit.missing(fx.table(spark, sf_dir, "documents").select("doc_id", path), fx.table(spark, sf_dir, "labels").select(path), "path").select("doc_id", "path")


_RANK = "CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END"


def _parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    s = fx.samples(spark, sf_dir).select("doc_id", "path", "label", "split")
    return {n: s.where(F.col("split") == n).drop("split") for n in ("train", "validation", "test")}


@_register(f"WITH {fx.SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {_RANK}, doc_id) AS k FROM samples) SELECT path, doc_id, label, split AS old_split FROM r WHERE k = 1")
def union_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.dedup_first(list(_parts(spark, sf_dir).items()))


@_register(f"WITH {fx.SAMPLES} SELECT doc_id, path, label, split FROM samples")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.tagged_union(_parts(spark, sf_dir))


@_register(f"""WITH {fx.SAMPLES}, d AS (SELECT DISTINCT lower(regexp_replace(path, '/[^/]*$', '')) AS dir, split FROM samples)
SELECT 'intersect' AS operation, dir FROM (SELECT dir FROM d WHERE split = 'train' INTERSECT SELECT dir FROM d WHERE split = 'test') UNION ALL
SELECT 'except', dir FROM (SELECT dir FROM d WHERE split = 'train' EXCEPT SELECT dir FROM d WHERE split = 'test') UNION ALL SELECT 'union', dir FROM (SELECT dir FROM d WHERE split = 'train' UNION SELECT dir FROM d WHERE split = 'test')""")
def directory_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.samples(spark, sf_dir)
    a, b = (s.where(F.col("split") == n).select(paths.parent(F.col("path")).alias("dir")) for n in ("train", "test"))
    parts = {"intersect": a.intersect(b), "except": a.subtract(b), "union": a.union(b).distinct()}
    return files.tagged_union(parts, "operation")


# -- near duplicates -------------------------------------------------------


@_register(f"WITH {fx.SIMHASH} SELECT * FROM hashes")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.hashes(spark, sf_dir)


@_register(f"WITH {fx.SIMHASH} SELECT * FROM pairs")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.hamming_pairs(materialise(fx.hashes(spark, sf_dir), "hashes"), 4)


_NEAR = fx.SIMHASH + """, near AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS distance, row_number() OVER (PARTITION BY a.doc_id ORDER BY bit_count(xor(a.hash, b.hash)), b.doc_id) AS r
  FROM hashes a JOIN hashes b ON a.doc_id % 20 < 14 AND b.doc_id % 20 >= 17)"""


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    h = materialise(fx.hashes(spark, sf_dir), "hashes")
    return neardup.nearest(h.where("doc_id % 20 < 14"), h.where("doc_id % 20 >= 17"), k)


@_register(f"WITH {_NEAR} SELECT left_id, right_id, distance FROM near WHERE r = 1 AND distance <= 6")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 6)


@_register(f"WITH {_NEAR} SELECT left_id, right_id, distance FROM near WHERE r = 1 AND distance <= 2 ORDER BY distance, left_id LIMIT 50")
def strongest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.strongest(_nearest(spark, sf_dir, 2), 2, 50)


@_register(f"""WITH {fx.SIMHASH}, {_PAIRS}, part AS (SELECT doc_id, hash, CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'validation' ELSE 'test' END AS split FROM hashes),
near AS (SELECT split_a, split_b, a.doc_id AS left_id, b.doc_id AS right_id, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS distance, row_number() OVER (PARTITION BY split_a, split_b, a.doc_id ORDER BY bit_count(xor(a.hash, b.hash)), b.doc_id) AS r
  FROM pr JOIN part a ON a.split = split_a JOIN part b ON b.split = split_b) SELECT split_a, split_b, left_id, right_id, distance FROM near WHERE r = 1 AND distance <= 6""")
def near_duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nearest_neighbour`` between every pair of splits; that query itself is train against test."""
    h = fx.hashes(spark, sf_dir).withColumn("split", fx.split_of(F.col("doc_id")))
    return neardup.nearest_across_splits(materialise(h, "hashes"), 6)


@_register(f"WITH RECURSIVE {fx.GROUPED} SELECT doc_id, group_id FROM grouped")
def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.grouped_documents(spark, sf_dir).select("doc_id", "group_id")


@_register(f"WITH RECURSIVE {fx.GROUPED}, s AS (SELECT group_id, count(*) AS n FROM grouped GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS images_in_duplicates, max(n) AS largest FROM s")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group_stats(fx.grouped_documents(spark, sf_dir))


_INFO = fx.GROUPED + """, g AS (SELECT group_id, count(*) AS images, CAST(sum(label) AS BIGINT) AS fraud, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS labels,
  count(DISTINCT label) > 1 AS mixed_label, count(DISTINCT split) > 1 AS cross_split, min(doc_id) AS least_id, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c FROM grouped GROUP BY 1 HAVING count(*) > 1),
info AS (SELECT group_id, images, fraud, splits, labels, mixed_label, cross_split, CAST(CASE WHEN mixed_label THEN 0 WHEN a AND c THEN 1 WHEN a AND b THEN 2 WHEN b AND c THEN 3 ELSE 4 END AS INT) AS priority, least_id, a AND b AS train_validation, a AND c AS train_test, b AND c AS validation_test FROM g)"""


@_register(f"WITH RECURSIVE {_INFO} SELECT * FROM info")
def group_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group_info(fx.grouped_documents(spark, sf_dir))


@_register(f"WITH RECURSIVE {_INFO} SELECT group_id, images, fraud, splits FROM info WHERE cross_split")
def cross_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_info(spark, sf_dir).where("cross_split").select("group_id", "images", "fraud", "splits")


@_register(f"WITH RECURSIVE {_INFO} SELECT CAST(row_number() OVER (ORDER BY priority, images DESC, least_id) AS INT) AS group_number, group_id, images, priority FROM info ORDER BY priority, images DESC, least_id LIMIT 50")
def group_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.priority_sample(group_info(spark, sf_dir)).select("group_number", "group_id", "images", "priority")


@_register(f"WITH RECURSIVE {_INFO} SELECT count(*) AS groups, count(*) FILTER (WHERE cross_split) AS cross_split, count(*) FILTER (WHERE mixed_label) AS mixed_label, count(*) FILTER (WHERE train_validation) AS train_validation, count(*) FILTER (WHERE train_test) AS train_test, count(*) FILTER (WHERE validation_test) AS validation_test FROM info")
def contamination_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ("cross_split", "mixed_label", "train_validation", "train_test", "validation_test")
    return group_info(spark, sf_dir).agg(F.count("*").alias("groups"), *(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in flags))


# -- splits ----------------------------------------------------------------


@_register(f"""WITH {fx.SAMPLES}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42', CAST(doc_id AS VARCHAR))), doc_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM samples)
SELECT doc_id, label, CASE WHEN k <= floor(n * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) THEN 'validation' ELSE 'train' END AS split FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(fx.samples(spark, sf_dir).select("doc_id", "label"), "doc_id", "label", 0.2)


def _group_sql(test: str, validation: str) -> str:
    return f"""WITH RECURSIVE {fx.GROUPED}, k AS (SELECT group_id, row_number() OVER (ORDER BY md5(concat('42', CAST(group_id AS VARCHAR))), group_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM grouped)),
c AS (SELECT group_id, r, {test} AS t, {validation} AS v FROM k), sp AS (SELECT g.doc_id, g.group_id, g.label, CASE WHEN r < t THEN 'test' WHEN r < t + v THEN 'validation' ELSE 'train' END AS split FROM grouped g JOIN c ON c.group_id = g.group_id)"""


_DEV = _group_sql("CAST(ceil(CAST(0.15 AS DOUBLE) * n) AS BIGINT)", "CAST(ceil(CAST(0.15 AS DOUBLE) / (1 - CAST(0.15 AS DOUBLE)) * (n - CAST(ceil(CAST(0.15 AS DOUBLE) * n) AS BIGINT))) AS BIGINT)")
_REST = "CAST(ceil((1 - CAST(0.7 AS DOUBLE)) * n - CAST(1e-9 AS DOUBLE)) AS BIGINT)"
_THREE = _group_sql(f"CAST(ceil({_REST} / CAST(2 AS DOUBLE)) AS BIGINT)", f"{_REST} - CAST(ceil({_REST} / CAST(2 AS DOUBLE)) AS BIGINT)")


def _development(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.development_split(materialise(fx.grouped_documents(spark, sf_dir).drop("split"), "grouped"), "group_id")


@_register(f"{_DEV} SELECT * FROM sp")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _development(spark, sf_dir).select("doc_id", "group_id", "label", "split")


@_register(f"{_THREE} SELECT * FROM sp")
def group_split_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.three_way_split(materialise(fx.grouped_documents(spark, sf_dir).drop("split"), "grouped"), "group_id").select("doc_id", "group_id", "label", "split")


_SUMMARY = "count(*) AS images, count(*) FILTER (WHERE label = 1) AS fraud, count(*) FILTER (WHERE label <> 1) AS non_fraud, CAST(100 AS DOUBLE) * count(*) FILTER (WHERE label = 1) / count(*) AS fraud_percent, count(DISTINCT group_id) AS groups FROM sp"


@_register(f"{_DEV} SELECT split, {_SUMMARY} GROUP BY 1 UNION ALL SELECT 'overall', {_SUMMARY}")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.summary(_development(spark, sf_dir), "group_id")


@_register(f"{_DEV} SELECT CAST(0 AS BIGINT) AS shared_keys, count(DISTINCT group_id) AS keys, true AS isolated FROM sp")
def group_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.isolated(_development(spark, sf_dir), "group_id")


@_register(f"WITH {fx.SAMPLES}, k AS (SELECT path, count(DISTINCT split) AS n FROM samples GROUP BY 1) SELECT count(*) FILTER (WHERE n > 1) AS shared_keys, count(*) AS keys, count(*) FILTER (WHERE n > 1) = 0 AS isolated FROM k")
def path_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.isolated(fx.samples(spark, sf_dir), "path", raise_on_overlap=False)


# -- damage and claims -----------------------------------------------------


@_register(f"WITH {fx.SCORED} SELECT * FROM det")
def box_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage.scored_boxes(fx.boxes(spark, sf_dir))


@_register(f"WITH {fx.SCORED} SELECT severity, count(*) AS n FROM det GROUP BY 1")
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage.scored_boxes(fx.boxes(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("n"))


def _claims(spark: SparkSession, sf_dir: str, detections: DataFrame) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id")).unionByName(detections.select("claim_id"))


@_register(f"WITH {fx.OVERALL} SELECT * FROM overall")
def damage_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = damage.scored_boxes(fx.boxes(spark, sf_dir))
    return damage.overall(d, _claims(spark, sf_dir, d))


@_register(f"WITH {fx.COVERAGE} SELECT * FROM coverage")
def damage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage.coverage(damage.scored_boxes(fx.boxes(spark, sf_dir)))


# The names of a detector's classes in this fixture; others get a made-up name.
_NAMES = [(1, "dent"), (2, "scratch"), (3, "crack"), (4, "glass shatter"), (5, "lamp broken"), (6, "tire flat")]
_NAME_SQL = "CASE class_id " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in _NAMES) + " ELSE concat('class_', CAST(class_id AS VARCHAR)) END"


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage.named(damage.scored_boxes(fx.boxes(spark, sf_dir)), spark.createDataFrame(_NAMES, "class_id int, name string"))


@_register(f"WITH {fx.SCORED} SELECT claim_id, box_no - 1 AS position, {_NAME_SQL} AS damage_type, confidence, x1, area_percentage, severity, severity_score FROM det")
def detections_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = damage.nested(_detections(spark, sf_dir)).select("claim_id", F.posexplode("detections").alias("position", "d"))
    return flat.select("claim_id", "position", "d.damage_type", "d.confidence", F.col("d.bounding_box")[0].alias("x1"), "d.area_percentage", "d.severity", "d.severity_score")


_BOTH = "greatest(0, least(o.x2, b.x2) - greatest(o.x1, b.x1)) * greatest(0, least(o.y2, b.y2) - greatest(o.y1, b.y1))"
_AREA = "greatest(0, {0}.x2 - {0}.x1) * greatest(0, {0}.y2 - {0}.y1)"


@_register(
    f"""WITH RECURSIVE {fx.BOXES}, c AS (SELECT * REPLACE (CAST(class_id % 3 AS INT) AS class_id) FROM boxes WHERE conf >= 0.25),
b AS (SELECT *, row_number() OVER (PARTITION BY claim_id, class_id ORDER BY conf DESC, x1, y1, x2, y2) AS place FROM c),
walk(claim_id, class_id, place, kept) AS (SELECT claim_id, class_id, place, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': conf}}] FROM b WHERE place = 1 UNION ALL
  SELECT b.claim_id, b.class_id, b.place, CASE WHEN len(list_filter(kept, lambda o: {_BOTH} > CAST(0.45 AS DOUBLE) * ({_AREA.format('o')} + {_AREA.format('b')} - {_BOTH}))) > 0 THEN kept
    ELSE list_append(kept, {{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'conf': b.conf}}) END FROM walk w JOIN b ON b.claim_id = w.claim_id AND b.class_id = w.class_id AND b.place = w.place + 1),
ends AS (SELECT claim_id, class_id, unnest(arg_max(kept, place)) AS k FROM walk GROUP BY 1, 2)
SELECT claim_id, class_id, k.conf, k.x1, k.y1, k.x2, k.y2, 640 AS w, 480 AS h FROM ends"""
)
def detector_filter_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage.suppress(fx.boxes(spark, sf_dir).withColumn("class_id", (F.col("class_id") % 3).cast("int")))


_SUMMARY_SQL = "CASE WHEN prediction = 1 THEN concat('{}', printf('%.1f', prob * CAST(100 AS DOUBLE)), '%{}') ELSE concat('{}', printf('%.1f', (1 - prob) * CAST(100 AS DOUBLE)), '%{}') END".format(*(t.replace("'", "''") for t in (*claims.FRAUD_SUMMARY, *claims.CLEAR_SUMMARY)))
_HEX = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_IDS = f"concat('CLM-2024-', lpad(CAST({_HEX.format('CAST(claim_key AS VARCHAR)')} % 100000 AS VARCHAR), 5, '0')) AS claim_id, concat('PRC-', lpad(CAST({_HEX.format(chr(39).join(('concat(', 'p', ', CAST(claim_key AS VARCHAR))')))} % 10000 AS VARCHAR), 4, '0')) AS processing_id"


def _fraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select(F.col("doc_id").alias("claim_key"), "prob", "prediction", "confidence")


@_register(f"WITH {_PRED} SELECT doc_id AS claim_key, {_SUMMARY_SQL} AS summary FROM predictions")
def claim_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fraud(spark, sf_dir).select("claim_key", claims.summary_text(F.col("prediction"), F.col("prob")).alias("summary"))


@_register(f"WITH k AS (SELECT doc_id AS claim_key FROM labels) SELECT claim_key, {_IDS} FROM k")
def claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return fx.table(spark, sf_dir, "labels").select(k.alias("claim_key"), claims.claim_id(k, 2024).alias("claim_id"), claims.processing_id(k).alias("processing_id"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = materialise(_detections(spark, sf_dir), "detections")
    parts = damage.overall(d).join(damage.coverage(d), "claim_id").join(damage.nested(d), "claim_id")
    return claims.report(_fraud(spark, sf_dir), parts.withColumnRenamed("claim_id", "claim_key"))


@_register(
    f"WITH {fx.OVERALL}, {fx.COVERAGE[len(fx.SCORED) + 2 :]}, {_PRED}, j AS (SELECT p.doc_id AS claim_key, p.prob, p.prediction, p.confidence, o.*, c.damage_coverage_percentage FROM predictions p JOIN overall o ON o.claim_id = p.doc_id JOIN coverage c ON c.claim_id = p.doc_id) "
    f"SELECT j.claim_key, {_IDS.replace('claim_key', 'j.claim_key')}, CASE WHEN prediction = 1 THEN 'Fraud' ELSE 'Non-Fraud' END AS fraud_label, prob * 100 AS fraud_probability, confidence * 100 AS model_confidence, {_SUMMARY_SQL} AS summary, damage_detected, damage_count, damage_coverage_percentage, overall_severity, overall_severity_score, damage_count AS detections FROM j"
)
def claim_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir)
    flat = [f"damage_result.{c}" for c in ("damage_detected", "damage_count", "damage_coverage_percentage", "overall_severity", "overall_severity_score")]
    return r.select("claim_key", "claim_id", "processing_id", "fraud_label", "fraud_probability", "model_confidence", "summary", *flat, F.size("damage_result.detections").cast("long").alias("detections"))


@_register(
    f"WITH {fx.SCORED}, {_PRED} SELECT p.doc_id AS claim_key, CASE WHEN prediction = 1 THEN 'Fraud' ELSE 'Non-Fraud' END AS fraud_label, box_no - 1 AS position, {_NAME_SQL} AS damage_type, det.confidence, x1, y1, x2, y2, area_percentage, severity, severity_score FROM predictions p JOIN det ON det.claim_id = p.doc_id"
)
def claim_report_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections inside each nested report, read back as rows."""
    r = _reports(spark, sf_dir).select("claim_key", "fraud_label", F.posexplode("damage_result.detections").alias("position", "d"))
    box = [F.col("d.bounding_box")[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))]
    return r.select("claim_key", "fraud_label", "position", "d.damage_type", "d.confidence", *box, "d.area_percentage", "d.severity", "d.severity_score")


# -- files, models ---------------------------------------------------------


@_register(f"WITH {fx.SAMPLES} SELECT path, CAST(label AS INT) AS label, split FROM samples")
def csv_split_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "splits")
    sinks.write_splits(fx.samples(spark, sf_dir).select("path", "label", "split"), folder)
    return files.tagged_union({s: files.load_split(spark, f"{folder}/{s}", s).drop("split") for s in ("train", "validation", "test")})


@_register(f"WITH {_SWEEP} SELECT threshold AS optimal_threshold, f1 AS validation_f1 FROM sweep ORDER BY {_ORDER} LIMIT 1")
def threshold_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = metrics.ranked_thresholds(threshold_sweep(spark, sf_dir), 10)
    one = F.struct("rank", "threshold", "f1", "recall", "precision")
    row = top.agg(F.min_by("threshold", "rank").alias("optimal_threshold"), F.min_by(one, "rank").alias("best_validation_result"), F.sort_array(F.collect_list(one)).alias("top_10"))
    path = work_path(spark, "threshold.json")
    sinks.write_report(row, path)
    read = files.json_settings(spark, path, "optimal_threshold double, best_validation_result struct<f1: double>")
    return read.select("optimal_threshold", F.col("best_validation_result.f1").alias("validation_f1"))


@_register(f"WITH {_PRED} SELECT error_type, count(*) AS n FROM predictions GROUP BY 1")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "predictions")
    sinks.write_predictions(_predictions(spark, sf_dir), folder)
    read = spark.read.schema("doc_id long, label int, prob double, prediction int, correct boolean, confidence double, error_type string").option("header", "true").csv(folder)
    return read.groupBy("error_type").agg(F.count("*").alias("n"))


@_register(
    f"""WITH {fx.SAMPLES}, {fx.SIZED}, g AS (SELECT s.*, z.width, z.height FROM samples s JOIN sized z ON z.doc_id = s.doc_id),
c AS (SELECT coalesce(split, 'overall') AS split, coalesce(CAST(label AS VARCHAR), 'all') AS class, count(*) AS n FROM g GROUP BY GROUPING SETS ((split, label), (label), (split), ())),
p AS (SELECT split, class, n, CAST(printf('%.2f', n * CAST(100 AS DOUBLE) / max(CASE WHEN class = 'all' THEN n END) OVER (PARTITION BY split)) AS DOUBLE) AS percent FROM c),
z AS (SELECT count(*) AS images, min(width) AS min_width, max(width) AS max_width, min(height) AS min_height, max(height) AS max_height FROM g),
q AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT width, height FROM g WHERE width IS NOT NULL)) AS distinct_sizes),
d AS (SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_images FROM (SELECT count(*) AS n FROM g GROUP BY md5(text) HAVING count(*) > 1))
SELECT * FROM p, z, q, d"""
)
def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report, its classes read back as rows."""
    s = fx.samples(spark, sf_dir).join(fx.sized(spark, sf_dir).drop("split"), "doc_id")
    r = eda.report(s, F.md5(F.col("text").cast("binary")))
    sizes = r.select(F.explode("classes").alias("c"), "dimensions", "duplicates")
    return sizes.select("c.*", "dimensions.*", F.col("duplicates.groups").alias("duplicate_groups"), F.col("duplicates.images").alias("duplicate_images"))


_FLAG = "(SELECT count(*) FILTER (WHERE n > 1) = 0 FROM (SELECT {0}, count(DISTINCT split) AS n FROM sp GROUP BY 1))"


@_register(
    f"""{_DEV}, r AS (SELECT split, {_SUMMARY} GROUP BY 1 UNION ALL SELECT 'overall', {_SUMMARY})
SELECT split, images, fraud, non_fraud, CAST(42 AS BIGINT) AS seed, true AS test_locked, {_FLAG.format("group_id")} AS group_isolation_verified, {_FLAG.format("doc_id")} AS path_isolation_verified FROM r"""
)
def split_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report, written as JSON and its splits read back as rows; the flags are what the checks found."""
    dev = materialise(_development(spark, sf_dir), "development")
    flags = [audit.isolated(dev, key, raise_on_overlap=False) for key in ("group_id", "doc_id")]
    path = work_path(spark, "audit.json")
    sinks.write_report(sinks.audit_row(splits.summary(dev, "group_id"), *flags), path)
    named = ("seed", "test_locked", "group_isolation_verified", "path_isolation_verified")
    read = files.json_settings(spark, path, "splits array<struct<split: string, images: long, fraud: long, non_fraud: long>>, seed long, test_locked boolean, group_isolation_verified boolean, path_isolation_verified boolean")
    return read.select(F.explode("splits").alias("s"), *named).select("s.*", *named)


@_register(
    f"""WITH RECURSIVE {_INFO}, first AS (SELECT *, CAST(row_number() OVER (ORDER BY priority, images DESC, least_id) AS INT) AS group_number FROM info ORDER BY priority, images DESC, least_id LIMIT 50)
SELECT group_number, group_id, priority, images, fraud, splits, labels, cross_split, (SELECT count(*) FROM first) AS all_groups, (SELECT CAST(sum(images) AS BIGINT) FROM first) AS all_images,
  (SELECT count(*) FROM first WHERE cross_split) AS all_cross_split, (SELECT count(*) FROM first f WHERE f.priority = first.priority) AS of_priority FROM first"""
)
def visual_audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first groups as a numbered CSV beside its JSON report, both read back."""
    folder = work_path(spark, "visual-audit")
    sinks.write_group_audit(materialise(neardup.priority_sample(group_info(spark, sf_dir)), "first-groups"), folder)
    schema = "group_number int, group_id long, priority int, images long, fraud long, splits string, labels string, mixed_label boolean, cross_split boolean, train_test boolean, train_validation boolean, validation_test boolean"
    rows = files.csv_split(spark, f"{folder}/groups", schema)
    report = files.json_settings(spark, f"{folder}/report", "total struct<groups: long, images: long>, flags struct<cross_split: long>, priorities array<struct<priority: int, groups: long>>")
    of = F.element_at(F.filter("priorities", lambda x: x["priority"] == F.col("priority")), 1)["groups"]
    both = rows.crossJoin(F.broadcast(report))  # a report is one row
    return both.select("group_number", "group_id", "priority", "images", "fraud", "splits", "labels", "cross_split", F.col("total.groups").alias("all_groups"), F.col("total.images").alias("all_images"), F.col("flags.cross_split").alias("all_cross_split"), of.alias("of_priority"))


@_register(None)
def embedding_classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on every labelled row; all rows are scored, none is held out."""
    e = fx.table(spark, sf_dir, "embeddings")
    return scoring.embedding_classifier(e.where("label IS NOT NULL"), e).select("vec_id", "label", F.round("prob", 6).alias("prob"))


# -- datasets, images, training --------------------------------------------


@_register(f"WITH {fx.SAMPLES} SELECT split, count(*) AS files, count(DISTINCT sha256(text)) AS unique_hashes FROM samples GROUP BY 1")
def unique_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.unique_hashes(fx.samples(spark, sf_dir, F.sha2("text", 256)), F.col("text"))


@_register(f"WITH {fx.SAMPLES} SELECT doc_id, path, label, split FROM samples ORDER BY doc_id LIMIT 20")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.first_samples(fx.samples(spark, sf_dir)).select("doc_id", "path", "label", "split")


@_register(
    f"""WITH RECURSIVE {_INFO}, first AS (SELECT group_id, CAST(row_number() OVER (ORDER BY priority, images DESC, least_id) AS INT) AS group_number FROM info ORDER BY priority, images DESC, least_id LIMIT 50),
m AS (SELECT group_number, CAST(row_number() OVER (PARTITION BY g.group_id ORDER BY doc_id) AS INT) AS place, doc_id, split, label FROM grouped g JOIN first ON first.group_id = g.group_id)
SELECT * FROM m WHERE place <= 8"""
)
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = materialise(fx.grouped_documents(spark, sf_dir), "grouped")
    return neardup.priority_members(neardup.group_info(grouped), grouped)


@_register(
    f"""WITH {fx.SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS pos FROM samples)
SELECT split, CAST(floor(pos / 32) AS BIGINT) AS batch, count(*) AS n, count(*) FILTER (WHERE label = 1) AS fraud, count(*) FILTER (WHERE label = 0) AS non_fraud FROM r GROUP BY 1, 2"""
)
def batch_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, out = fx.samples(spark, sf_dir).select("doc_id", "label", "split"), None
    for split in datasets.SPLITS:
        one = datasets.batch_summary(datasets.batches(s.where(F.col("split") == split), order="doc_id")).select(F.lit(split).alias("split"), "batch", "n", "fraud", "non_fraud")
        out = one if out is None else out.unionByName(one)
    return out


@_register(f"WITH {fx.SAMPLES} SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS fraud FROM samples GROUP BY 1")
def split_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, out = datasets.create_datasets(fx.samples(spark, sf_dir)), None
    for split, rows in found.items():
        one = rows.agg(F.lit(split).alias("split"), F.count("*").alias("n"), F.sum("label").alias("fraud"))
        out = one if out is None else out.unionByName(one)
    return out


@_register(f"WITH {_CONF}, rates AS (SELECT {_RATES}, tn, fp, fn, tp FROM conf) SELECT round(f1, 9) AS f1, round(accuracy, 9) AS accuracy, tn, fp, fn, tp, CAST(0.5 AS DOUBLE) AS threshold FROM rates")
def test_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test metrics report, written and read back."""
    path = work_path(spark, "test-metrics.json")
    sinks.write_report(metrics.metric_bundle(fx.scores(spark, sf_dir), 0.5).withColumn("threshold", F.lit(0.5)), path)
    read = files.json_settings(spark, path, "f1 double, accuracy double, tn long, fp long, fn long, tp long, threshold double")
    return _rounded(read.select("f1", "accuracy", "tn", "fp", "fn", "tp", "threshold"), "f1", "accuracy")


@_register(None)
def phash_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of drawn images by perceptual hash, end to end."""
    hashed = images.with_phash(fx.embedding_images(spark, sf_dir)).select("vec_id", "split", "hash")
    return neardup.groups(hashed, 4, "vec_id")


@_register(None)
def head_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs of a two-stage run on embeddings: one label against the rest."""
    e = fx.table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select("vec_id", "embedding", (F.col("label") == 1).cast("int").alias("label"))
    e = materialise(e.withColumn("split", fx.split_of(F.col("vec_id"))), "embedded")
    _, history = training.fit_two_stages(spark, e.where("split = 'train'"), e.where("split = 'validation'"), 64, work_path(spark, "run"), stages=((3, 0.1, False), (2, 0.01, True)))
    columns = ("epoch", "rate", "train_loss", "accuracy", "f1", "roc_auc")
    return spark.createDataFrame([tuple(float(h[c]) if c != "epoch" else h[c] for c in columns) for h in history], "epoch long, rate double, train_loss double, accuracy double, f1 double, roc_auc double")


# -- files, positions, models ----------------------------------------------


def _png_of(rows: DataFrame) -> DataFrame:
    """vec_id and content: each drawn image as a PNG file's bytes."""
    return pictures.annotated(rows.withColumn("boxes", F.lit(None).cast("array<struct<x1: double, y1: double, x2: double, y2: double>>")), F.col("vec_id")).select(F.col("name").cast("long").alias("vec_id"), "content")


_FILE_NAME = "concat('/v', CAST(vec_id AS VARCHAR), CASE WHEN vec_id % 11 = 0 THEN '.jpg' ELSE '.png' END)"
_GOOD = "vec_id % 7 <> 0 AND vec_id % 5 <> 0"


def _picture_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of picture files, some of them empty, cut in half or under a wrong suffix."""
    i, body = F.col("vec_id"), F.col("content")
    damaged = F.when(i % 7 == 0, F.lit(b"")).when(i % 5 == 0, F.substring(body, F.lit(1), (F.octet_length(body) / 2).cast("int"))).otherwise(body)
    split = fx.split_of(i)
    name = F.concat(split, F.lit("/v"), i.cast("string"), F.when(i % 11 == 0, ".jpg").otherwise(".png"))
    folder = work_path(spark, "pictures")
    file_sink.write_files(_png_of(fx.embedding_images(spark, sf_dir)).select(name.alias("name"), damaged.alias("content")), folder)
    return folder


@_register(
    f"""SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE 'PNG' END AS format, CASE WHEN {_GOOD} THEN 8 END AS width, CASE WHEN {_GOOD} THEN 8 END AS height, CASE WHEN {_GOOD} THEN 'RGB' END AS mode,
  CASE WHEN vec_id % 7 = 0 THEN 'empty' WHEN vec_id % 5 = 0 THEN 'truncated' END AS problem, {_GOOD} AS valid, vec_id % 7 <> 0 AND vec_id % 11 = 0 AS renamed FROM embeddings"""
)
def picture_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written by the sink, then probed where they lie, by range reads."""
    found = probe.probed_paths(file_sink.written_files(spark, _picture_files(spark, sf_dir)))
    vec_id = F.regexp_extract("path", r"/v([0-9]+)\.[a-z]+$", 1).cast("long")
    return found.select(vec_id.alias("vec_id"), "format", "width", "height", "mode", "problem", "valid", "renamed")


@_register(
    f"""WITH f AS (SELECT vec_id, CASE WHEN vec_id % 20 < 14 THEN 'train' WHEN vec_id % 20 < 17 THEN 'validation' ELSE 'test' END AS split, {_GOOD} AS ok, {_FILE_NAME} AS name FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY name) AS k FROM f) SELECT split, coalesce(string_agg(DISTINCT CASE WHEN ok THEN 'RGB' END, ','), '') AS modes FROM r WHERE k <= 100 GROUP BY 1"""
)
def mode_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes over the first 100 files of each split, by name."""
    folder = _picture_files(spark, sf_dir)
    found = probe.probed(file_sink.read_files(spark, folder).select(F.col("name").alias("path"), "content"))
    name = F.regexp_extract("path", "(/v[^/]*)$", 1)
    return eda.mode_sanity(found.select(name.alias("path"), F.substring_index("path", "/", 1).alias("split"), "mode"))


@_register(
    """WITH f AS (SELECT CASE WHEN vec_id % 20 < 14 THEN 'train' WHEN vec_id % 20 < 17 THEN 'validation' ELSE 'test' END AS split, vec_id FROM embeddings),
r AS (SELECT split, (row_number() OVER (PARTITION BY split ORDER BY vec_id) - 1) // 48 AS sheet FROM f), s AS (SELECT split, sheet, count(*) AS n FROM r GROUP BY 1, 2)
SELECT concat('sheets/', split, '-', lpad(CAST(sheet AS VARCHAR), 4, '0'), '.png') AS name, CAST(4 + 8 * 20 AS INT) AS width, CAST(4 + ceil(n / 8.0) * 20 AS INT) AS height, true AS valid, true AS intact FROM s"""
)
def sheet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact sheets of 8 x 6 drawn images a split, drawn in tasks, written, read back and probed."""
    drawn, out = materialise(fx.embedding_images(spark, sf_dir), "drawn"), None
    for split in datasets.SPLITS:
        at = numbered(drawn.where(F.col("split") == split).select("vec_id", "split"), [F.col("vec_id")], "at")
        out = at if out is None else out.unionByName(at)
    placed = pictures.numbered_sheets(drawn.join(out.drop("split"), "vec_id"), F.concat(F.lit("sheets/"), "split"), F.col("at"), 48)
    folder = work_path(spark, "sheets")
    file_sink.write_files(pictures.contact_sheets(placed, 8, 6, 16, 16, 4), folder)
    read = materialise(file_sink.read_files(spark, folder), "sheets-read")
    sizes = probe.probed(read.select(F.col("name").alias("path"), "content")).withColumnRenamed("path", "name")
    return read.select("name", "intact").join(sizes, "name").select("name", "width", "height", "valid", "intact")


@_register(
    """WITH c AS (SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 0 ELSE 2 END AS files FROM embeddings)
SELECT vec_id AS claim_id, files > 0 AS original, files > 0 AS annotated, files > 0 AS differ FROM c"""
)
def evidence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original and annotated picture of each claim, in its folder; every 13th image can't be decoded and has none."""
    drawn = fx.embedding_images(spark, sf_dir).withColumnRenamed("vec_id", "claim_id")
    broken = F.when(F.col("claim_id") % 13 != 0, F.col("image"))
    box = F.array(F.struct(*(F.lit(float(v)).alias(n) for n, v in (("x1", 1), ("y1", 1), ("x2", 7), ("y2", 6)))))
    claims_ = materialise(drawn.withColumns({"image": broken, "boxes": box}), "claims")
    folder = work_path(spark, "evidence")
    file_sink.write_files(pictures.evidence(claims_), folder)
    written = materialise(file_sink.read_files(spark, folder), "evidence-read")
    paths = pictures.evidence_paths(claims_, written)
    sha = written.groupBy(F.regexp_replace("name", "/[^/]*$", "").cast("long").alias("claim_id")).agg((F.count_distinct("sha256") == 2).alias("differ"))
    return paths.join(by_merge(sha), "claim_id", "left").select("claim_id", F.col("original").isNotNull().alias("original"), F.col("annotated").isNotNull().alias("annotated"), F.coalesce("differ", F.lit(False)).alias("differ"))


def _walked(n: str, seed: int) -> str:
    """SQL of a seeded permutation: from places (place, n) to positions, a round a step, until inside."""
    keys = positions.Permutation(1, seed).keys
    key = "CASE r % 6 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(keys)) + " END"
    half = "CASE WHEN r % 2 = 1 THEN a ELSE b END"
    first = f"((xor({half}, {key}) * {positions.FIRST}) & {positions.MASK})"
    second = f"((xor({first}, {first} >> 15) * {positions.SECOND}) & {positions.MASK})"
    h = f"xor({second}, {second} >> 13)"
    return f"""shape AS (SELECT n, bits, bits // 2 AS high, bits - bits // 2 AS low FROM (SELECT n, greatest(2, CAST(length(ltrim(bin(n - 1), '0')) AS BIGINT)) AS bits FROM (SELECT count(*) AS n FROM {n}))),
walk(place, r, a, b) AS (SELECT i, CAST(0 AS BIGINT), i >> low, i & ((CAST(1 AS BIGINT) << low) - 1) FROM shape, range(CAST((SELECT n FROM shape) AS BIGINT)) t(i)
  UNION ALL SELECT place, r + 1, CASE WHEN r % 2 = 0 THEN xor(a, {h} & ((CAST(1 AS BIGINT) << high) - 1)) ELSE a END, CASE WHEN r % 2 = 1 THEN xor(b, {h} & ((CAST(1 AS BIGINT) << low) - 1)) ELSE b END
  FROM walk, shape WHERE r = 0 OR r % 6 <> 0 OR (a << low | b) >= n),
shuffled AS (SELECT place, arg_max(a << low | b, r) AS position FROM walk, shape GROUP BY place)"""


@_register(f"""WITH RECURSIVE {fx.SAMPLES}, train AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM samples WHERE split = 'train'), {_walked("train", 7)}
SELECT doc_id, s.place // 32 AS batch, CAST(s.place % 32 AS INT) AS place FROM train JOIN shuffled s ON s.position = train.position""")
def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches of the training split in a seeded order, from a store by position."""
    train = fx.samples(spark, sf_dir, F.sha2("text", 256)).where("split = 'train'").select("doc_id", "label")
    stored = positions.RowStore.write(train, work_path(spark, "store"), [F.col("doc_id")], per_range=1000)
    return stored.batched(32, 7).select("doc_id", "batch", "place")


@_register(f"""WITH {_NEAR} SELECT left_id, l.toxic AS left_label, right_id, r2.toxic AS right_label, distance FROM near LEFT JOIN labels l ON l.doc_id = left_id LEFT JOIN labels r2 ON r2.doc_id = right_id WHERE r = 1 AND distance <= 6""")
def labelled_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest pairs with both sides' labels."""
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return neardup.labelled_pairs(_nearest(spark, sf_dir, 6), labels)


@_register("SELECT vec_id, true AS same FROM embeddings WHERE label IS NOT NULL")
def checkpoint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from a saved checkpoint, opened as a model file by the workers, against those of the run that saved it."""
    e = fx.table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select("vec_id", "embedding", (F.col("label") == 1).cast("int").alias("label"))
    e, run = materialise(e, "embedded"), work_path(spark, "run")
    head, _ = training.fit_two_stages(spark, e, e, 64, run, stages=((1, 0.1, False),), size=256)
    model = training.publish_checkpoint(spark, f"{run}/checkpoint", f"{run}/models")
    scored = scoring.score_with_file(model, training.scorer, e.select("vec_id", "embedding"), ["vec_id"]).withColumnRenamed("prob", "again")
    return training.predict(e, head).join(scored, "vec_id").select("vec_id", (F.abs(F.col("prob") - F.col("again")) < 1e-12).alias("same"))
