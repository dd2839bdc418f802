"""File readers, sinks and the incremental loop on small files."""

import gzip
import hashlib
import os
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.operators import profile
from granary.sources import archive, delimited, fasta, gff, sinks, tree
from granary.streaming import incremental


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 description\nACGTN\nacgt\n>chr2\nGGrr-X\n")
    records = fasta.read_fasta(spark, str(tmp_path / "a.fa"))
    assert sorted((r.name, r.sequence) for r in records.collect()) == [("chr1", "ACGTNacgt"), ("chr2", "GGrr-X")]
    p = profile.sequence_profile(records, ["path"]).first()
    assert (p.sequence_count, p.total_symbols, p.acgt_count, p.n_count, p.iupac_ambiguous_count, p.invalid_symbol_count) == (2, 15, 10, 1, 2, 2)
    assert (p.lowercase_count, p.gc_count, p.min_sequence_length, p.max_sequence_length, p.n50) == (6, 6, 6, 9, 9)
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(b">other\nACGTNACGT\n>x\nGGRR-X\n"))
    (tmp_path / "bad.fa").write_text("ACGT\n>late\nAC\n")
    files = {os.path.basename(r.path): r for r in fasta.file_profile(spark, str(tmp_path)).collect()}
    assert files["a.fa"].canonical_sha256 == files["b.fa.gz"].canonical_sha256 and files["b.fa.gz"].compression == "gzip"
    assert files["bad.fa"].error and files["bad.fa"].canonical_sha256 is None
    again = fasta.read_fasta(spark, str(tmp_path / "b.fa.gz"))
    assert sorted(len(r.sequence) for r in again.collect()) == [6, 9]
    ids = fasta.record_digests(records.union(again).withColumn("k", F.lit(1)), ["k"]).first()
    assert ids.record_count == 4 and ids.total_symbols == 30


def test_gff(spark, tmp_path):
    (tmp_path / "x.gff3").write_text(
        "##gff-version 3\nchr1\ts\tgene\t1\t100\t.\t+\t.\tID=g1;Name=a=b\nchr1\ts\tmRNA\t1\t90\t.\t+\t.\tID=t1;ID=t2\nchr2\ts\tgene\t5\t20\t.\t-\t0\tID=g1\n"
        "broken line\nchr1\ts\tCDS\t0\t-1\t.\tX\t9\tx\nchr1\ts\texon\tten\t20\t.\t.\t.\tParent=t1\n##FASTA\n>chr1\nACGT\n"
    )
    features = gff.read_gff(spark, str(tmp_path / "x.gff3"))
    p = profile.feature_profile(features, ["path"]).first()
    assert (p.feature_count, p.gene_count, p.transcript_count, p.cds_count, p.exon_count, p.malformed_line_count) == (5, 2, 1, 1, 1, 1)
    assert (p.invalid_coordinate_count, p.invalid_strand_count, p.invalid_phase_count) == (2, 1, 1)
    assert (p.unique_gene_id_count, p.duplicate_gene_id_count, p.unique_transcript_id_count, p.format, p.gff_version) == (1, 1, 1, "GFF3", "3")
    assert {r.seqid: r.max_end for r in profile.max_end(features, ["path"]).collect()} == {"chr1": 100, "chr2": 20}
    names = features.filter("type = 'gene' and seqid = 'chr1'").select(F.col("attributes")["Name"]).first()[0]
    assert names == "a=b" and features.filter("type = 'mRNA'").select(F.col("attributes")["ID"]).first()[0] == "t2"
    with pytest.raises(PySparkException):
        gff.strict_features(features).collect()
    (tmp_path / "y.gtf").write_text('chr1\ts\tgene\t1\t9\t.\t+\t.\tgene_id "G"; name "n";\nchr1\ts\ttranscript\t1\t9\t.\t+\t.\tgene_id "G"; transcript_id "T";\n')
    q = profile.feature_profile(gff.read_gff(spark, str(tmp_path / "y.gtf")), ["path"]).first()
    assert (q.format, q.unique_gene_id_count, q.unique_transcript_id_count) == ("GTF", 1, 1)


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("data/genome.fa", ">a\nACGT\n")
        z.writestr("data/p.faa.gz", gzip.compress(b">p\nMK\n"))
        z.writestr("../unsafe.txt", "x")
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    members = archive.read_zip_members(spark, str(tmp_path))
    rows = {r.member_name: r for r in members.filter("member_name is not null").collect()}
    assert {n: r.member_type for n, r in rows.items()} == {"data/genome.fa": "fasta", "data/p.faa.gz": "protein_fasta", "../unsafe.txt": "other"}
    assert not rows["../unsafe.txt"].safe_path and all(r.crc_verified for r in rows.values())
    sums = {os.path.basename(r.path): r for r in archive.archive_summary(members).collect()}
    assert (sums["z.zip"].file_member_count, sums["z.zip"].unsafe_member_count, sums["z.zip"].crc_verified_count, sums["z.zip"].duplicate_member_name_count) == (3, 1, 3, 0)
    assert sums["bad.zip"].crc_failure_count == 1
    lines = archive.read_member_text(spark, str(tmp_path / "z.zip"), r"\.faa").collect()
    assert [r.value for r in lines] == [">p", "MK"]


def test_delimited(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\tn\na\t1\nb\t\n")
    rows = delimited.read_tsv(spark, str(tmp_path / "t.tsv"), "id string, n long").collect()
    assert [(r.id, r.n) for r in rows] == [("a", 1), ("b", None)]
    (tmp_path / "bad.tsv").write_text("id\tother\na\tx\n")
    with pytest.raises(Exception, match="(?i)header"):
        delimited.read_tsv(spark, str(tmp_path / "bad.tsv"), "id string, n long").collect()
    lines = spark.createDataFrame([(1, "# Name: x: y"), (1, "#none"), (1, "chr1\tassembled-molecule\tna\tCM1")], "k int, value string")
    assert [(r.field, r.value) for r in delimited.report_fields(lines, ["k"]).collect()] == [("Name", "x: y")]
    assert delimited.report_table(lines, ["k"], ["name", "role", "a", "b"]).first().b == "CM1"
    hits = spark.createDataFrame([("q", 99.0, 60, 1, 60), ("q", 99.0, 40, 61, 100), ("q", 50.0, 500, 1, 500), ("r", 96.0, 30, 9, 38)], "query_id string, percent_identity double, alignment_length long, query_start long, query_end long")
    got = delimited.vector_hits(hits, [(50, 90.0), (30, 95.0)]).collect()
    assert [(r.query_id, r.hits, r.longest, r.bases) for r in got] == [("q", 2, 60, 100), ("r", 1, 30, 30)]
    calls = spark.createDataFrame([(1, "bacteria", "n/a"), (2, "organelle", "plastid"), (3, "eukarya", None)], "chunk_id int, first string, second string")
    chunks = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "a", 5)], "chunk_id int, record string, length long")
    assert {r["class"]: r.bases for r in delimited.chunk_classes(calls, chunks, ["record"]).collect()} == {"bacteria": 10, "plastid": 20, "eukarya": 5}
    item = '{"DOI":"10.1/X","title":[" T "],"author":[{"family":"A","given":"B"},{"given":"C"}],"published":{"date-parts":[[2020,1]]}}'
    r = delimited.bibliography(spark.createDataFrame([(item,)], "item string"), F.lit("q")).first()
    assert (r.doi, r.title, r.authors, r.year, r.journal) == ("10.1/x", "T", "A, B; C", 2020, "")


def test_tree_and_sinks(spark, tmp_path):
    root = tmp_path / "root"
    (root / "genome").mkdir(parents=True)
    (root / "genome" / "a.fa").write_text(">a\nA\n")
    os.symlink("/etc/hosts", root / "abs")
    os.symlink("genome/a.fa", root / "rel.fa")
    rows = {r.relative_path: r for r in tree.scan_tree(spark, str(root)).collect()}
    digest = hashlib.sha256(b"/etc/hosts").hexdigest()
    assert rows["abs"].link_target == f"<absolute:path-sha256:{digest}>" and rows["rel.fa"].link_target == "genome/a.fa"
    assert rows["genome/a.fa"].file_type == "fasta" and rows["genome/a.fa"].size_bytes == 5 and set(rows) == {"abs", "rel.fa", "genome/a.fa"}
    summary = sinks.write_with_summary(spark.range(5), str(tmp_path / "out"), "1.0").first()
    assert summary["rows"] == 5 and len(summary["digest"]) == 64
    with pytest.raises(PySparkException):
        sinks.write_with_summary(spark.range(5), str(tmp_path / "out"), "1.0")


def test_incremental(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.range(10).coalesce(1).write.parquet(src)
    work = lambda df: df.withColumn("x", F.col("id") * 2)
    run = lambda: incremental.run_available(spark, src, "id long", out, ck, ["id"], work)
    run()
    spark.range(5, 15).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(15))
