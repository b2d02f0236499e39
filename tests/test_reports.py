"""The sink of reports: names, order, modes, failing and repeated attempts."""

import random

import pytest
from pyspark.sql import functions as F

from crestline.sources import reports as R

NAMES = ["plain", "a/b", "..", ".", "", None, "ñ+% \n", "%null", "x" * 400, "y" * 400]


def frame(spark, rows):
    rows = list(rows)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "series_id string, rank int, line string").repartition(5)


def text(*lines):
    return "\n".join([R.TITLE, "", *lines]) + "\n"


@pytest.mark.parametrize("uri", ["", "file://"])
def test_names_and_order(spark, tmp_path, uri):
    rows = [(s, i, f"clip {i} {s}"[:50].replace("\n", " ")) for s in NAMES for i in range(1, 13)] + [("none", 1, None)]
    path = f"{uri}{tmp_path}/out"
    R.write_reports(frame(spark, rows), path)
    got = {r.series_id: r.text for r in R.read_reports(spark, path).collect()}
    want = {R.folder_of(s) if s and len(s) > 200 else s: text(*(x for a, _, x in rows if a == s and x)) for s in [*NAMES, "none"]}
    assert got == want and len(want) == len(NAMES) + 1
    assert not [f for f in tmp_path.rglob("*") if "_staging" in f.name]


def test_modes(spark, tmp_path):
    path = str(tmp_path)
    (tmp_path / "kept").mkdir()
    R.write_reports(frame(spark, [("a", 1, "old"), ("b", 1, "old")]), path)
    R.write_reports(frame(spark, [("a", 1, "new")]), path)
    assert {r.series_id: r.text for r in R.read_reports(spark, path).collect()} == {"a": text("new"), "b": text("old")}
    R.write_reports(frame(spark, [("c", 1, "new")]), path, mode="overwrite")
    assert sorted(x.name for x in tmp_path.iterdir()) == ["c", "kept"]
    R.write_reports(frame(spark, []), path)
    assert [r.series_id for r in R.read_reports(spark, path).collect()] == ["c"]


def test_a_failing_task_leaves_no_report(spark, tmp_path):
    path = str(tmp_path)
    R.write_reports(frame(spark, [("a", 1, "old")]), path)
    whole = frame(spark, [(s, i, f"{i}") for s in "abcdef" for i in range(5)]).repartition(3, "series_id").sortWithinPartitions("series_id", "rank")
    bad = whole.withColumn("line", F.expr("if(series_id = 'e' AND rank = 4, CAST(raise_error('broken') AS string), line)"))
    with pytest.raises(Exception, match="broken"):  # in a task that has written others before
        bad.write.format("report_files").mode("append").save(path)
    assert {r.series_id: r.text for r in R.read_reports(spark, path).collect()} == {"a": text("old")}
    assert [x.name for x in tmp_path.iterdir()] == ["a"]


def test_a_repeated_attempt_leaves_one(tmp_path, monkeypatch):
    """Two attempts of a task have written; the one that counts is published, the other goes."""
    writer, out = R._Writer({"path": str(tmp_path)}, False), []
    for attempt in (7, 8):
        monkeypatch.setattr(R.TaskContext, "get", classmethod(lambda cls, n=attempt: type("C", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: n})()))
        out.append(writer.write(iter([{"series_id": "a", "line": f"of {attempt}"}])))
    writer.commit([out[1], None])
    assert (tmp_path / "a" / R.FILE).read_text() == text("of 8") and len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize("seen", [0, 1, 2])
def test_an_attempt_that_outlives_its_job_leaves_nothing(tmp_path, monkeypatch, seen):
    """A job is aborted while a task is still at its rows."""
    monkeypatch.setattr(R.TaskContext, "get", classmethod(lambda cls: type("C", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 7})()))
    writer = R._Writer({"path": str(tmp_path)}, False)

    def rows():
        for i, series in enumerate("abc"):
            if i == seen:
                writer.abort([])
            yield {"series_id": series, "line": "x"}

    with pytest.raises(OSError):
        writer.write(rows())
    assert list(tmp_path.iterdir()) == []


def test_scattered_rows_are_refused(spark, tmp_path):
    spark.dataSource.register(R.ReportFiles)
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "series_id string, line string")
    for parts in (1, 3):
        with pytest.raises(Exception, match="together|several tasks"):
            rows.repartition(parts, "line").coalesce(parts).sortWithinPartitions("line").write.format("report_files").mode("append").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []
