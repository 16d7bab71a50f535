"""How many workers share a batch."""

import pytest
from pyspark.sql import functions as F

from lenswright.operators import training


@pytest.mark.parametrize(("size", "slots", "workers"), [(32, 12, 4), (32, 2, 2), (4, 12, 1), (256, 12, 12)])
def test_no_more_workers_than_have_rows(spark, tmp_path, monkeypatch, size, slots, workers):
    rows = spark.range(8).select((F.col("id") % 2).cast("int").alias("label"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    store = training.training_rows(rows, folder=f"file://{tmp_path}/rows")

    class Seen(Exception):
        pass

    def seen(df, name):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(training, "_slots", lambda spark: slots)
    monkeypatch.setattr(training, "materialise", seen)
    with pytest.raises(Seen, match=rf"RepartitionByExpression \[.*\], {workers}\b"):
        training.train_one_epoch(store, training.Head.new(2), 0.1, True, size)
