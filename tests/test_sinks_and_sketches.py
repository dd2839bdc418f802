"""Chunk files with gapless ids, and checks of sketches."""

import hashlib
import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.operators import similarity
from granary.sources import fasta_sink, streamed


def test_chunk_files_have_gapless_ids_in_order(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(f"r{r}", k, "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 300)))) for r in range(9) for k in range(20)]
    path = str(tmp_path / "out")
    listed = fasta_sink.write_chunks(spark.createDataFrame(rows, "record string, chunk int, s string").repartition(5), path, ["record", "chunk"], "s").collect()
    want = {i: s for i, (_, _, s) in enumerate(sorted(rows), 1)}
    assert {(r.id, r.record, r.chunk, r.length) for r in listed} == {(i, a, b, len(s)) for i, (a, b, s) in enumerate(sorted(rows), 1)}
    told = json.loads((tmp_path / "out" / "_CHUNKS").read_text())
    assert told["chunks"] == len(rows) and sorted(os.listdir(path)) == sorted(["_CHUNKS", *(f["file"] for f in told["files"])])
    assert all(hashlib.sha256((tmp_path / "out" / f["file"]).read_bytes()).hexdigest() == f["sha256"] for f in told["files"])
    assert {int(r.name): r.symbols for r in streamed.sequence_chunks(spark, path).collect()} == want


def test_a_failing_task_leaves_no_files(spark, tmp_path):
    df = spark.range(1, 40).select("id", F.when(F.col("id") == 30, F.raise_error(F.lit("broken"))).otherwise(F.lit("ACGT")).alias("symbols"))
    spark.dataSource.register(fasta_sink.SequenceFiles)
    path = str(tmp_path / "out")
    with pytest.raises(PySparkException):
        df.repartitionByRange(4, "id").sortWithinPartitions("id").write.format("sequence_files").mode("append").save(path)
    assert not os.path.exists(path) or not [f for f in os.listdir(path) if not f.endswith(".tmp")]
    gap = spark.createDataFrame([(1, "A"), (3, "C")], "id long, symbols string").coalesce(1)
    with pytest.raises(PySparkException, match="follow"):
        gap.write.format("sequence_files").mode("append").save(path)
    with pytest.raises(PySparkException, match="more than 3"):
        fasta_sink.write_chunks(spark.createDataFrame([(1, "ACGT")], "k int, s string"), path, ["k"], "s", most=3)


def test_kept_chunks(spark):
    df = spark.createDataFrame([(1, "ACGT"), (2, "ACNN"), (3, "ANNN"), (4, "AC"), (5, None)], "k int, s string")
    assert sorted(r.k for r in fasta_sink.kept_chunks(df, "s", 3, 0.5).collect()) == [1, 2]


def test_sketch_violations(spark):
    top = (1 << 60) // 1000
    rows = [("fine", [1, 5, top - 1]), ("none", []), ("null", None), ("order", [5, 1]), ("again", [5, 5]), ("large", [top]), ("minus", [-1]), ("two", [1]), ("two", [2])]
    df = spark.createDataFrame(rows, "k string, h array<bigint>")
    sizes = spark.createDataFrame([("fine", 3), ("none", 1), ("gone", 2), ("two", 1)], "k string, hash_count int")
    got = {(r.k, r.rule) for r in similarity.sketch_violations(df, "k", "h", 1000, sizes).collect()}
    assert got == {("null", "null"), ("order", "unsorted"), ("again", "unsorted"), ("large", "out_of_range"), ("minus", "out_of_range"), ("two", "repeated_key"), ("none", "other_size"), ("gone", "missing")}
