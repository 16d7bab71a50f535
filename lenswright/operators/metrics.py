"""Exact classification metrics from a table of labels and probabilities.

A row without a label or without a probability, such as one that a model failed
on, counts nowhere: all metrics are those of the other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ratio, threshold_grid
from ..plans.workspace import before_each, materialise, ranges_of


def predicted(prob: Column, threshold: float | Column = 0.5) -> Column:
    return (prob >= threshold).cast("int")


def decision_confidence(prob: Column, prediction: Column) -> Column:
    """How sure the decision is: the probability of what was predicted."""
    return F.when(prediction == 1, prob).otherwise(1.0 - prob)


def error_type(label: Column, prediction: Column) -> Column:
    return F.when(label == prediction, "correct").when(label == 1, "missed_fraud").otherwise("false_alarm")


def confusion(label: Column, prediction: Column) -> list[Column]:
    """tn, fp, fn and tp as aggregates: always all four, whatever classes occur."""
    one = lambda a, b: F.coalesce(F.sum(((label == a) & (prediction == b)).cast("long")), F.lit(0)).cast("long")
    return [one(0, 0).alias("tn"), one(0, 1).alias("fp"), one(1, 0).alias("fn"), one(1, 1).alias("tp")]


def with_rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 from tn, fp, fn and tp; a quotient by zero is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    df = df.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return df.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def scored(scores: DataFrame) -> DataFrame:
    """The rows that metrics are of."""
    return scores.where(F.col("label").isNotNull() & F.col("prob").isNotNull())


def confusion_matrix(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored(scores).agg(*confusion(F.col("label"), predicted(F.col("prob"), threshold)))


def threshold_sweep(scores: DataFrame) -> DataFrame:
    """All metrics at every grid threshold, in one pass.

    A score counts for the thresholds up to it, so rows are counted by how many
    thresholds they reach and cumulated over at most 92 such counts: neither
    rows nor work multiply with the grid.
    """
    reached = F.size(F.filter(threshold_grid(), lambda t: F.col("prob") >= t))
    counts = scored(scores).select(reached.alias("reached"), "label").groupBy("reached").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg"))
    grid = scores.sparkSession.range(1).select(F.posexplode(threshold_grid()).alias("i", "threshold"))
    at = grid.crossJoin(F.broadcast(counts)).groupBy("i", "threshold").agg(
        *(F.coalesce(F.sum(F.when((F.col("reached") > F.col("i")) == up, F.col(c))), F.lit(0)).cast("long").alias(n) for n, c, up in (("tn", "neg", False), ("fp", "neg", True), ("fn", "pos", False), ("tp", "pos", True)))
    )
    return with_rates(at).select("threshold", "accuracy", "precision", "recall", "f1", "tn", "fp", "fn", "tp")


def ranked_thresholds(sweep: DataFrame, n: int) -> DataFrame:
    """The ``n`` best by f1, recall, precision; the lowest threshold wins ties."""
    best = sweep.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "threshold").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "threshold")))


def _by_score(scores: DataFrame) -> DataFrame:
    """Positives and rows by distinct score."""
    return scored(scores).groupBy("prob").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.count("*").alias("n"))


def _cumulated(scores: DataFrame) -> DataFrame:
    """By distinct score: positives and rows of higher scores, and of all.

    Scores are cumulated by ranges of like numbers of distinct scores: within a
    range by a window, across ranges from a table of one row a range, so no
    task sees all distinct scores, however they crowd.
    """
    by = ranges_of(materialise(_by_score(scores), "scores"), [F.desc("prob")], "range")
    w = Window.partitionBy("range").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = by.withColumns({"pos_in": F.sum("pos").over(w), "n_in": F.sum("n").over(w)})
    sums = before_each(by.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("n").alias("m")), "range", ["p", "m"])
    return inside.join(F.broadcast(sums), "range").select("prob", "pos", "n", (F.col("before_p") + F.col("pos_in")).alias("cum_pos"), (F.col("before_m") + F.col("n_in")).alias("cum_n"), F.col("all_p").alias("npos"), F.col("all_m").alias("total"))


def average_precision(scores: DataFrame) -> DataFrame:
    """The sum of precision times step of recall over distinct scores; null without positives."""
    return _average_precision(_cumulated(scores))


def _average_precision(cumulated: DataFrame) -> DataFrame:
    step = F.col("pos") / F.col("npos") * (F.col("cum_pos") / F.col("cum_n"))
    return cumulated.where("npos > 0").agg(F.sum(step).alias("average_precision"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """The chance that a positive scores above a negative, ties counting half; null without both classes."""
    return _roc_auc(_cumulated(scores))


def _roc_auc(cumulated: DataFrame) -> DataFrame:
    neg = F.col("n") - F.col("pos")
    above = F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0  # positives above each negative of this score
    total = F.sum(neg * above) / F.first(F.col("npos").cast("double") * (F.col("total") - F.col("npos")))
    return cumulated.where("npos > 0 and npos < total").agg(total.alias("roc_auc"))


def metric_bundle(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rates, confusion counts, roc_auc and average_precision in one row; an undefined area is 0."""
    rates = with_rates(confusion_matrix(scores, threshold))
    cumulated = _cumulated(scores)  # dealt out and written once for both areas
    areas = _roc_auc(cumulated).crossJoin(_average_precision(cumulated))
    return rates.crossJoin(areas).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("roc_auc", "average_precision")})


def classification_report(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, f1 and support by class, their means and support-weighted means, to 4 digits."""
    p = predicted(F.col("prob"), threshold)
    one = scored(scores).agg(*confusion(F.col("label"), p))
    rows = F.array(
        *(
            F.struct(F.lit(name).alias("class"), ratio(F.col(hit), F.col(hit) + F.col(wrong)).alias("precision"), ratio(F.col(hit), F.col(hit) + F.col(lost)).alias("recall"), ratio(2 * F.col(hit), 2 * F.col(hit) + F.col(wrong) + F.col(lost)).alias("f1"), (F.col(hit) + F.col(lost)).alias("support"))
            for name, hit, wrong, lost in (("Non-Fraud", "tn", "fn", "fp"), ("Fraud", "tp", "fp", "fn"))
        )
    )
    classes = one.select(F.explode(rows).alias("r")).select("r.*")
    n = F.sum("support").cast("double")
    means = [("macro avg", lambda c: F.avg(c)), ("weighted avg", lambda c: ratio(F.sum(F.col(c) * F.col("support")), n))]
    for name, mean in means:
        classes = classes.unionByName(classes.where(F.col("class").isin("Non-Fraud", "Fraud")).agg(F.lit(name).alias("class"), *(mean(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").cast("long").alias("support")))
    return classes.select("class", *(F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")), "support")


def predictions(scores: DataFrame, threshold: float) -> DataFrame:
    """A row per score: prediction, whether it is right, and the kind of error."""
    out = scored(scores).withColumn("prediction", predicted(F.col("prob"), threshold))
    return out.withColumns({"correct": F.col("label") == F.col("prediction"), "error_type": error_type(F.col("label"), F.col("prediction")), "confidence": decision_confidence(F.col("prob"), F.col("prediction"))})


def error_summary(predicted_rows: DataFrame) -> DataFrame:
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    label, p = F.col("label"), F.col("prediction")
    return predicted_rows.agg(
        F.count("*").alias("total"), count(F.col("correct")).alias("correct"), count(~F.col("correct")).alias("incorrect"),
        count((label == 1) & (p == 1)).alias("caught_fraud"), count((label == 1) & (p == 0)).alias("missed_fraud"), count((label == 0) & (p == 1)).alias("false_alarms"), count((label == 0) & (p == 0)).alias("passed"),
    )


#: Intervals into which a step of a selection cuts what is left, and groups whose selections the driver keeps between steps.
CUTS, GROUPS = 4096, 10_000


def _selected(values: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """``wanted`` (_by, _name, _k, _lo, _hi) with ``_value``: the k-th, from 0, of a group's values (_by, _v) between lo and hi.

    Each step counts the values of the interval that holds the k-th in ``CUTS`` parts
    and goes on in the part where it lies, between the least and the greatest value
    of that part; so a few counting passes settle any number of rows, and a
    value that many rows share is settled at once.
    """

    def held(df: DataFrame) -> DataFrame:
        """A few rows a group: kept as they are for few groups, else as a written table."""
        return df.sparkSession.createDataFrame(df.toArrow()) if few else materialise(df, "wanted")

    done, wanted = None, held(wanted)
    while True:
        settled = wanted.where("_lo = _hi").select("_by", "_name", F.col("_lo").alias("_value"))
        done = settled if done is None else done.unionByName(settled)
        wanted = wanted.where("_lo < _hi")
        if wanted.isEmpty():
            return done
        spans = wanted.select(F.col("_by").alias("_b"), "_lo", "_hi").distinct()
        inside = values.join(F.broadcast(spans) if few else spans, F.col("_by").eqNullSafe(F.col("_b")) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))  # a value's part never falls as the value grows
        part = F.when(F.isnan(share) | (F.col("_v") == F.col("_hi")), F.lit(CUTS)).otherwise(F.floor(share * CUTS))
        parts = inside.groupBy("_b", "_lo", "_hi", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.sum("_n").over(Window.partitionBy("_b", "_lo", "_hi").orderBy("_part"))  # at most CUTS + 1 rows
        parts = parts.withColumn("_before", upto - F.col("_n")).withColumnsRenamed({"_lo": "_l", "_hi": "_h"})
        here = F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_lo") == F.col("_l")) & (F.col("_hi") == F.col("_h")) & (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_n"))
        found = wanted.join(parts, here)
        wanted = held(found.select("_by", "_name", (F.col("_k") - F.col("_before")).alias("_k"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi")))


def describe(scores: DataFrame, by: str = "label", value: str = "prob") -> DataFrame:
    """count, mean, sample deviation, extremes and linearly interpolated quartiles by group.

    Quartiles are selected by counting, so no group has to be sorted or to fit a task.
    """
    out = scores.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    out = materialise(out, "described")
    spots = {n: F.lit(q) * (F.col("n") - 1) for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))}
    ends = F.array(*(F.struct(F.lit(f"{n}_{s}").alias("_name"), f(p).cast("long").alias("_k")) for n, p in spots.items() for s, f in (("lo", F.floor), ("hi", F.ceil))))
    bounds = [F.col("lowest").cast("double").alias("_lo"), F.col("highest").cast("double").alias("_hi")]
    wanted = out.where("n > 0").select(F.col(by).alias("_by"), F.explode(ends).alias("_e"), *bounds).select("_by", "_e.*", "_lo", "_hi")
    values = scores.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v"))
    at = _selected(values, wanted, out.count() <= GROUPS).groupBy("_by").agg(*(F.max(F.when(F.col("_name") == f"{n}_{s}", F.col("_value"))).alias(f"{n}_{s}") for n in spots for s in ("lo", "hi")))
    joined = out.join(at, F.col(by).eqNullSafe(F.col("_by")), "left")
    between = {n: F.when(F.col(f"{n}_lo") == F.col(f"{n}_hi"), F.col(f"{n}_lo")).otherwise((F.ceil(p) - p) * F.col(f"{n}_lo") + (p - F.floor(p)) * F.col(f"{n}_hi")) for n, p in spots.items()}
    return joined.withColumns(between).select(by, "n", "mean", "std", "lowest", "q25", "q50", "q75", "highest")


def mean_loss(scores: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Mean binary cross-entropy; log arguments are kept at least at ``floor``."""
    p = F.col("prob")
    loss = -(F.col("label") * F.ln(F.greatest(p, F.lit(floor))) + (1 - F.col("label")) * F.ln(F.greatest(1.0 - p, F.lit(floor))))
    return scored(scores).agg(F.avg(loss).alias("mean_loss"))


def best_epoch(history: DataFrame) -> DataFrame:
    """The earliest epoch of the highest f1."""
    return history.orderBy(F.desc("f1"), "epoch").limit(1)


def running_best(history: DataFrame) -> DataFrame:
    """Whether each epoch beats all before it (a run's history is short; before the first stands -1)."""
    before = F.max("f1").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("previous_best", F.coalesce(before, F.lit(-1.0))).withColumn("improved", F.col("f1") > F.col("previous_best"))
