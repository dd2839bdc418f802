"""Predicates, sinks and stream helpers that no registered query covers."""

from pyspark.sql import functions as F

from granary.functions import keys, text
from granary.operators import gates, intervals
from granary.sources import delimited, sinks, tree
from granary.streaming import incremental


def test_roles_and_members(spark):
    df = spark.createDataFrame([("a/b.gene_models_main.gff3.gz",), ("x/GCF_1_genomic.gff.gz",), ("x/iprscan.gff3",), ("x/ncRNA.gff",), ("x/y.gff",)], "p string")
    got = [tuple(r[0]) for r in df.select(keys.annotation_role(F.col("p"), keys.PRIMARY_ROLES, keys.SECONDARY_ROLES)).collect()]
    assert got == [("gene_models_main", True), ("ncbi_genomic", True), ("functional_iprscan", False), ("noncoding", False), ("other_annotation", False)]
    df = spark.createDataFrame([("p.faa.gz",), ("a.GFF3.gz",), ("g.fna",), ("t.xlsx",), ("readme",)], "p string")
    assert [r[0] for r in df.select(keys.member_type(F.col("p"))).collect()] == ["protein_fasta", "annotation", "fasta", "table", "other"]
    df = spark.createDataFrame([("file", "fasta", "a/Genome/x.fa"), ("file", "fasta", "a/genomes/x.fa"), ("symlink", "fasta", "genome/x.fa")], "k string, t string, p string")
    assert [r[0] for r in df.select(keys.is_genome_fasta(F.col("k"), F.col("t"), F.col("p"))).collect()] == [True, False, False]
    df = spark.createDataFrame([(["a", "b"], " x "), ([], "."), (None, None)], "l array<string>, p string")
    assert [tuple(r) for r in df.select(keys.joined(F.col("l")), keys.present(F.col("p"))).collect()] == [("a;b", True), (".", False), (".", False)]


def test_evidence_predicates(spark):
    df = spark.createDataFrame([("", "a T2T assembly", True), ("Chr", "", True), (" ", "scaffolds", False), (None, None, False)], "prefix string, words string, want boolean")
    assert all(r[0] == r[1] for r in df.select(gates.chromosome_evidence(F.col("prefix"), [F.col("words")]), "want").collect())
    df = spark.createDataFrame([(" Public ", "OPEN", True), ("public", "restricted", False), ("private", "open", False)], "a string, l string, want boolean")
    assert all(r[0] == r[1] for r in df.select(gates.license_allows(F.col("a"), F.col("l")), "want").collect())
    df = spark.createDataFrame([("Glycine max", "glycine-max", None, True), ("Glycine max", "G. max", ["g max"], True), ("Glycine max", "soja", ["x"], False)], "e string, o string, a array<string>, want boolean")
    assert all(r[0] == r[1] for r in df.select(keys.taxon_matches(F.col("e"), F.col("o"), F.col("a")), "want").collect())
    df = spark.createDataFrame([(True, True, "src", None, True), (True, True, ".", "None", False), (True, False, "src", "doi", False), (True, True, "", "doi", True)], "m boolean, c boolean, s string, p string, want boolean")
    assert all(r[0] == r[1] for r in df.select(gates.provenance(F.col("m"), F.col("c"), [F.col("s")], [F.col("p")]), "want").collect())
    df = spark.createDataFrame([(90.0, 90.0, True), (89.9, 99.0, False)], "a double, b double, want boolean")
    assert all(r[0] == r[1] for r in df.select(gates.both_at_least(F.col("a"), F.col("b"), 90.0, 90.0), "want").collect())
    df = spark.createDataFrame([("The <b>Title</b>", "the title", True), ("", "", False), ("a", "b", False)], "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(text.same_title(F.col("a"), F.col("b")), "want").collect())


def test_addresses(spark):
    r = spark.range(1).select(text.readme_url("https://x.org/", F.lit("Glycine"), F.lit("max"), F.lit("Wm82.gnm4")), text.bibliographic_url("https://y.org/works", F.lit("soy genome"), "2026-01-01", 5)).first()
    assert r[0] == "https://x.org/Glycine/max/genomes/Wm82.gnm4/README.Wm82.gnm4.yml"
    assert r[1].startswith("https://y.org/works?query.bibliographic=soy+genome&filter=from-pub-date") and "rows=5" in r[1]


def test_sinks_and_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (2, None, 1), (3, "c", 0)], "id int, t string, shard int")
    sinks.write_tsv(df, str(tmp_path / "tsv"))
    back = delimited.read_tsv(spark, str(tmp_path / "tsv"), "id int, t string, shard int")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_shards(df, str(tmp_path / "shards"), "shard")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "shards")).filter("shard = 0").collect()) == [1, 3]
    assert tree.scan_store(spark, str(tmp_path / "shards")).count() >= 2
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"id": 1,\n "n": {"x": 2}}')
    (tmp_path / "j" / "b.json").write_text("{broken")
    rows = delimited.read_json(spark, str(tmp_path / "j"), "id long, n struct<x:long>", strict=False).collect()
    assert sorted((r.id is None, r["_corrupt_record"] is None) for r in rows) == [(False, True), (True, False)]


def test_windowed_counts_and_half_open(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:04:00", "a"), ("2024-01-01 00:06:00", "a")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in incremental.windowed_counts(df, "ts", ["k"], "5 minutes", "1 minute").collect()) == [1, 2]
    a, b = spark.range(1).select(*delimited.half_open(F.lit(20), F.lit(11))).first()
    assert (a, b) == (10, 20)
    bare = spark.createDataFrame([(1, 0, 10), (1, 4, 6), (1, 12, 13)], "k int, start long, end long")
    assert [(r.start, r.previous_end) for r in intervals.overlap_violations(bare, ["k"]).collect()] == [(4, 10)]
