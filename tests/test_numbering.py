"""Dense numbers against a sort on one machine."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.operators import numbering, shards


def test_numbers_in_order_with_far_keys_strings_and_nulls(spark):
    rows = [(None, "x"), (None, "y"), (-(2**62), "a"), (2**62, "b"), *((i * 37 % 101, f"s{i}") for i in range(101))]
    df = spark.createDataFrame(rows, "range long, step string")
    got = numbering.numbered(df, ["range", "step"], "at", range_rows=10).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["range"], r["step"]) for r in sorted(got, key=lambda r: r["at"])] == want
    assert sorted(r["at"] for r in got) == list(range(len(rows)))


def test_one_far_key_leaves_no_large_range(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 0, F.lit(2**61)).otherwise(F.col("id")).alias("k")).selectExpr("k", "concat('key', k) AS s")
    for key in ("k", "s"):
        before = numbering.numbered
        seen = {}

        def keep(df, label):
            seen["df"] = df
            return written(df, label)

        written, numbering.written = numbering.written, keep
        try:
            before(df, [key], "at", range_rows=1000)
        finally:
            numbering.written = written
        sizes = [r["n"] for r in seen["df"].groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 2 * 1000


def test_copies_are_numbered_on_and_expanded(spark, monkeypatch):
    monkeypatch.setattr(numbering, "CHUNK", 10)
    df = spark.createDataFrame([("a", 3), ("b", 1), ("c", 47)], "k string, n long")
    got = numbering.expanded(numbering.numbered(df, ["k"], "at", "n"), "at", "n").orderBy("at").collect()
    assert [(r["k"], r["at"]) for r in got] == [(k, i) for i, k in enumerate("aaa" + "b" + "c" * 47)]
    assert numbering.numbered(df.limit(0), ["k"], "at").collect() == []


def test_exactly_one_row_has_a_task_index(spark):
    tasks = shards.task_index(spark.createDataFrame([("b",), ("a",), ("c",)], "k string"), "k")
    assert [tuple(r) for r in shards.at_task_index(tasks, 2).collect()] == [("b", 2)]
    for index, rows in ((4, tasks), (1, tasks.unionAll(tasks))):
        with pytest.raises(PySparkException, match="rows with task_index"):
            shards.at_task_index(rows, index).collect()
