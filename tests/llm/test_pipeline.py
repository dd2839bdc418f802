from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from granary.operators.lineage import written


def test_stages_by_name_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "near_duplicates", "benchmark_decontamination", "mixing_to_weights", "sharding"]
    assert pipeline.ORACLE_SQL is None


def test_each_stage_takes_effect_and_keeps_clean_documents(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen, before = {}, docs.collect()
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, sf), name)
        rows = out.collect()
        if name == "sharding":
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in before)
            break
        assert out.columns == docs.columns
        ids = {r.doc_id for r in rows}
        assert ids < {r.doc_id for r in before}
        seen[name] = [r for r in before if r.doc_id not in ids]
        docs, before = out, rows
    clean = lambda rows: [r for r in rows if labels.get(r.doc_id) == (1, 0)]
    assert len(clean(seen["quality_classifier"])) <= 0.02 * sum(v == (1, 0) for v in labels.values())
    assert not clean(seen["mixing_to_weights"]) or len(clean(seen["mixing_to_weights"])) <= 3
    assert not any(labels.get(r.doc_id, (1, 0))[1] == 1 and labels[r.doc_id][0] == 1 for r in before)
    texts = Counter(r.text for r in before)
    assert max(texts.values()) == 1
    assert not any(b in r.text for r in before for b in bench)


def test_edges(spark, tmp_path):
    rows = [(1, "the cat sat on the mat today", "en", "s", 28), (1, "the cat sat on the mat today", "en", "s", 28), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "other words entirely here now", "en", "s", 29), (4, "long " * 20_000, "en", "s", 100_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data, kind in (("documents", rows, schema), ("labels", [(1, 1, 0), (None, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, "a b c d e f g")], "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() <= len(rows)
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


#: Names that operators use inside; documents may have columns of these names and of any type.
CLASHING = ["selected", "gumbel_key", "log_weight", "mix_rate", "mix_tokens", "mix_posterior", "hits", "__hits", "__text", "row", "row_1", "node", "key", "root", "component", "good_id", "a.b"]


def test_extra_columns_come_through_each_stage(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING}).withColumn("nested", F.struct(F.col("doc_id").alias("x y")))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, more, sf)
        assert out.dtypes == more.dtypes
        rows = out.collect()
        plain = sorted(r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect())
        assert sorted(r.doc_id for r in rows) == plain and len(plain) > 500
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING) and all(r["nested"][0] == r.doc_id for r in rows)


def test_stage_decides_per_row(spark):
    """One row of each component stays, whatever ids its rows share with others or lack."""
    one, two, three = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(1, one), (2, one + " end"), (2, two), (3, two + " end"), (None, three), (None, three + " end"), (None, one), (4, None), (None, ""), (5, "alone"), (5, "alone")]
    df = spark.createDataFrame([(k, t, "en", f"s{i}", len(t or "")) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_duplicates(spark, df, "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(k), str(t)) for k, t in [(1, one), (2, two), (None, three), (4, None), (5, "alone")])
    assert all(rows[int(r.source[1:])] == (r.doc_id, r.text) for r in kept)
