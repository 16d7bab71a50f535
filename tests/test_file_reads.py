"""Written files are read by tasks that open what the manifests name."""

from pyspark.sql import functions as F

from lenswright.sources import file_sink


def test_files_are_not_listed_by_the_driver(spark, tmp_path, monkeypatch):
    """No scan of binary files, hence no list of them; odd names, empty, lost and changed files, and several chunks a batch."""
    folder = f"file://{tmp_path}/out"
    monkeypatch.setattr(file_sink, "CHUNK", 50)
    names = [f"d{k}/a b%20#{k}?.bin" for k in range(40)]
    rows = [(n, bytes([k]) * (k % 4 * 20)) for k, n in enumerate(names)]
    file_sink.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(3), folder)
    listed = {r.name: r.path.removeprefix("file://") for r in file_sink.written_files(spark, folder).collect()}
    open(listed[names[5]], "wb").write(b"changed")
    for k in (4, 7):  # an empty one, and one with a content
        __import__("os").remove(listed[names[k]])
    read = file_sink.read_files(spark, folder)
    assert "binaryFile" not in read._jdf.queryExecution().executedPlan().toString()
    got = {r.name: r for r in read.collect()}
    assert set(got) == set(names)
    for k, (n, body) in enumerate(rows):
        assert got[n].content == (None if k in (4, 7) else b"changed" if k == 5 else body)
        assert got[n].intact == (k not in (4, 5, 7))
    assert read.where(F.col("content").isNull()).count() == 2
