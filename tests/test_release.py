"""Releases with failures in the middle, and attempts over restarts."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.sources import release
from granary.streaming import attempts


def test_a_failing_task_leaves_the_old_release(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    assert release.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        release.open_table(spark, root, "a")
    first = release.publish({"a": spark.range(5), "b": spark.range(3).withColumn("x", F.lit(None).cast("string"))}, root, "1.0")
    assert release.current(spark, root) == first and release.open_table(spark, root, "a", verify=True).count() == 5
    bad = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken row")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(PySparkException):
        release.publish({"a": spark.range(9), "z": bad}, root, "2.0")
    folder = release.Folder(spark, root)
    assert folder.names("releases") == [first] and release.open_table(spark, root, "a").count() == 5
    second = release.publish({"a": spark.range(9)}, root, "2.0")
    assert release.current(spark, root) == second and release.open_table(spark, root, "a").count() == 9
    assert [(r["table"], r["rows"]) for r in release.receipts(spark, root, first)] == [("a", 5), ("b", 3)]


def test_a_table_that_changes_while_it_is_staged_is_not_released(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    moving = spark.range(100).select(F.udf(lambda i: os.urandom(8).hex())("id").alias("u"))
    with pytest.raises(ValueError, match="staged"):
        release.publish({"a": moving}, root, "1")
    assert release.current(spark, root) is None and release.Folder(spark, root).names("releases") == []


def test_failures_between_ready_and_the_pointer(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/out"
    first = release.publish({"a": spark.range(1)}, root, "1")
    plain = release.Folder.write

    def write(self, name, text):
        if name == "CURRENT":
            raise OSError("lost")
        plain(self, name, text)

    monkeypatch.setattr(release.Folder, "write", write)
    with pytest.raises(OSError, match="lost"):
        release.publish({"a": spark.range(2)}, root, "2")
    monkeypatch.undo()
    assert release.current(spark, root) == first
    folder = release.Folder(spark, root)
    folder.store.rename(folder.path("CURRENT"), folder.path("CURRENT.before"))  # as if it ended between two renames
    assert release.current(spark, root) == first
    gone = release.prune(spark, root)
    assert len(gone) == 1 and gone[0]["bytes"] > 0 and len(folder.names("releases")) == 2
    release.prune(spark, root, apply=True)
    assert folder.names("releases") == [first] and "deleted" in folder.read("PRUNED")


def test_a_changed_receipt_or_table_is_found(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    name = release.publish({"a": spark.range(4)}, root, "1")
    spark.range(5).write.mode("overwrite").parquet(f"{root}/releases/{name}/a")
    with pytest.raises(ValueError, match="not what was released"):
        release.open_table(spark, root, "a", verify=True)
    release.Folder(spark, root).write(f"releases/{name}/READY", "x")
    with pytest.raises(ValueError, match="not ready"):
        release.current(spark, root)


def test_a_key_that_always_fails_is_tried_three_times_over_restarts(spark, tmp_path):
    events, decisions, checkpoint = (f"{tmp_path}/{x}" for x in ("events", "decisions", "checkpoint"))
    tried = []

    def work(rows):
        found = sorted((r.key, r.attempt) for r in rows.collect())
        tried.extend(found)
        out = [(k, a, k == "good" or k == "flaky" and a == 2) for k, a in found]
        return spark.createDataFrame(out, "key string, attempt int, passed boolean")

    keys = spark.createDataFrame([("good",), ("bad",), ("flaky",)], "name string")
    attempts.announce(keys, "name", events)
    for _ in range(6):  # each call starts the query anew from its checkpoint
        attempts.one_pass(spark, events, decisions, checkpoint, work)
        attempts.announce(keys, "name", events)
    assert sorted(tried) == [("bad", 1), ("bad", 2), ("bad", 3), ("flaky", 1), ("flaky", 2), ("good", 1)]
    assert {r.key: (r.attempt, r.action) for r in attempts.ends(spark, decisions).collect()} == {"good": (1, "passed"), "bad": (3, "given_up"), "flaky": (2, "passed")}


def test_work_that_dies_is_done_again_and_counts_once(spark, tmp_path):
    events, decisions, checkpoint = (f"{tmp_path}/{x}" for x in ("events", "decisions", "checkpoint"))
    tried, dies = [], [True]

    def work(rows):
        found = [(r.key, r.attempt) for r in rows.collect()]
        tried.extend(found)
        if dies and dies.pop():
            raise RuntimeError("worker lost")
        return spark.createDataFrame([(k, a, False) for k, a in found], "key string, attempt int, passed boolean")

    attempts.announce(spark.createDataFrame([("k",)], "name string"), "name", events)
    with pytest.raises(Exception, match="worker lost"):
        attempts.one_pass(spark, events, decisions, checkpoint, work)
    ends = attempts.converge(spark, events, decisions, checkpoint, work).collect()
    assert tried == [("k", 1), ("k", 1), ("k", 2), ("k", 3)] and [(r.attempt, r.action) for r in ends] == [(3, "given_up")]
