import zlib
from collections import Counter

from granary.llm import sharding
from granary.operators import numbering


def jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


ROWS = [(i, f"text {i}") for i in range(300)] + [(-1, "é"), (-(2**63), "x"), (2**63 - 1, None), (None, "null key"), (None, "null key"), (5, "text 5"), (5, "text 5"), (5, "other"), (7, ""), (8, "z" * 100_000)]


def test_slots_sizes_and_growth(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, shard string")
    for per_range in (50_000, 3):
        got = sharding.shard_slots(df, "doc_id", "text", 6, per_range).collect()
        assert len(got) == len(ROWS)
        want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", jump(-1 if k is None else k, 6), jump(-1 if k is None else k, 7)) for k, t in ROWS)
        assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
        for s in range(6):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
        assert all(r.grown_shard in (r.shard, 6) for r in got)


def test_many_shards_and_string_keys(spark):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(200)], "doc_id int, name string")
    got = sharding.with_shard(df, "doc_id", 1000).collect()
    assert all(r.shard == jump(r.doc_id, 1000) for r in got)
    named = sharding.with_shard(df, "name", 10).collect()
    assert {r.shard for r in named} <= set(range(10)) and len({r.shard for r in named}) == 10
    assert sharding.shard_slots(df.limit(0).withColumnRenamed("name", "text"), "doc_id", "text", 4).count() == 0
    assert sharding.shard_slots(df, "name", "name", 4).count() == 200


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = sharding.shard_slots(df, "doc_id", "text", 40)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_a_row_repeated_often_and_string_keys_far_apart(spark, monkeypatch):
    monkeypatch.setattr(numbering, "CHUNK", 50)
    rows = [("same", "t")] * 400 + [(f"k{i}", "t") for i in range(100)] + [(None, "t")] * 120 + [("\U0010ffff" * 9, "far")]
    got = sharding.shard_slots(spark.createDataFrame(rows, "key string, text string"), "key", "text", 3, 20).collect()
    assert len(got) == len(rows)
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
