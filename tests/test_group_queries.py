"""The queries on duplicate groups merge groups with labels and splits, however small Spark takes either side to be."""

import pytest
from pyspark.sql import functions as F

from lenswright.operators import components, neardup, splits
from lenswright.plans import catalogue, fixtures, workspace

#: Broadcasts of bounded tables: numbering has a row a range and a row a block of ranges; group_members the first 50 groups, visual_audit_files a report's row.
BOUNDED = {"contamination_counts": 0, "cross_split_groups": 0, "dup_components": 0, "group_members": 1, "group_priority": 0, "group_split": 2, "group_split_three_way": 2, "group_stats": 0, "split_audit_report": 2, "visual_audit_files": 1}


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """60 documents, each third equal to the one before, and labels of most; and their groups as a written table."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, f"text of number {k - (k % 3 == 1)} has words {k // 3} of its own {k // 3 * 7}") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.range(55).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    found = workspace.materialise(neardup.groups(fixtures.hashes(spark, folder), 4), "found")
    return folder, found


@pytest.mark.parametrize("name", sorted(BOUNDED))
def test_nothing_that_grows_is_broadcast(spark, tables, monkeypatch, name):
    folder, found = tables
    seen = []
    monkeypatch.setattr(fixtures, "groups", lambda items, k: found)
    for module in (catalogue, components, neardup, splits):
        if hasattr(module, "materialise"):
            monkeypatch.setattr(module, "materialise", lambda df, n: (seen.append(broadcasts(df)), workspace.materialise(df, n))[1])
    out = catalogue.queries()[name](spark, folder)
    assert max([*seen, broadcasts(out)]) <= BOUNDED[name] and (not seen or min(seen) == 0)
    assert out.count() > 0
