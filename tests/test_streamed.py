"""Streamed sources: any cut of steps and chunks gives the same records, digests and lines."""

import gzip
import hashlib
import os
import random
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.functions.sequences import normalised
from granary.operators import kmers, profile, similarity
from granary.sources import archive, fasta, gff, streamed


def records(seed=1):
    rng = random.Random(seed)
    return [(f"r{i} some text", "".join(rng.choice("ACGTacgtN") for _ in range(rng.choice([0, 1, 59, 60, 61, 500])))) for i in range(12)]


def text_of(rows, width=60):
    return "".join(f">{h}\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)) for h, s in rows)


def canonical(rows):
    return hashlib.sha256(b"".join(b"\0" + s.upper().encode() for _, s in rows)).hexdigest()


@pytest.mark.parametrize("chunk", [1, 7, 60, 10_000])
def test_chunks_put_together_are_the_records(spark, tmp_path, chunk):
    rows = records()
    text = text_of(rows).encode()
    half = len(text) // 2
    (tmp_path / "plain.fa").write_bytes(b"\n \n" + text.replace(b"\n", b"\r\n"))
    (tmp_path / "two.fa.gz").write_bytes(gzip.compress(text[:half]) + gzip.compress(text[half:]) + b"\0" * 9)
    got = streamed.sequence_chunks(spark, str(tmp_path), chunk).collect()
    for path in {r.path for r in got}:
        whole: dict = {}
        for r in sorted((r for r in got if r.path == path), key=lambda r: (r.record, r.chunk)):
            assert r.start == len(whole.get((r.record, r.header), "")) and len(r.symbols) <= chunk and r.name == r.header.split()[0]
            whole[r.record, r.header] = whole.get((r.record, r.header), "") + r.symbols
        assert [(h, s) for (_, h), s in sorted(whole.items())] == rows
    told = {os.path.basename(r.path): r for r in fasta.file_profile(spark, str(tmp_path)).collect()}
    for name, r in told.items():
        content = (tmp_path / name).read_bytes()
        assert (r.size_bytes, r.file_sha256, r.canonical_sha256, r.error) == (len(content), hashlib.sha256(content).hexdigest(), canonical(rows), None)
    assert {n: r.compression for n, r in told.items()} == {"plain.fa": "none", "two.fa.gz": "gzip"}


def test_small_steps_do_not_show(tmp_path, monkeypatch):
    rows = records(2)
    for name, data in (("a.fa", text_of(rows).encode()), ("b.fa.gz", gzip.compress(text_of(rows).encode()))):
        (tmp_path / name).write_bytes(data)
        for step in (1, 2, 13, 64):
            monkeypatch.setattr(streamed, "STEP", step)
            found = [r for b in streamed.sequence_rows(str(tmp_path / name), 100) for r in b.to_pylist()]
            assert found[-1]["canonical_sha256"] == canonical(rows) and found[-1]["file_sha256"] == hashlib.sha256(data).hexdigest()


def test_bad_files_are_told_and_raise(spark, tmp_path):
    whole = gzip.compress(text_of(records()).encode())
    (tmp_path / "cut.fa.gz").write_bytes(whole[:-20])
    (tmp_path / "bare.fa").write_text("ACGT\n>a\nAC\n")
    (tmp_path / "empty.fa").write_text("")
    told = {os.path.basename(r.path): r for r in fasta.file_profile(spark, str(tmp_path)).collect()}
    assert all(r.error and r.canonical_sha256 is None for r in told.values()) and len(told) == 3
    assert told["cut.fa.gz"].file_sha256 == hashlib.sha256(whole[:-20]).hexdigest()
    assert told["bare.fa"].error == "sequence before first header"
    for name in told:
        with pytest.raises(PySparkException):
            streamed.sequence_chunks(spark, str(tmp_path / name)).collect()


def test_memory_of_a_task_is_bounded(tmp_path):
    """A record of 200 MB in 3 MB of gzip, in a process of its own."""
    import subprocess
    import sys

    with gzip.open(tmp_path / "large.fa.gz", "wb", compresslevel=1) as f:
        f.write(b">one\n")
        for _ in range(200):
            f.write((b"ACGTTGCA" * 8 + b"\n") * ((1 << 20) // 65))
    code = (
        "import resource, sys; from granary.sources import streamed\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        f"n = sum(len(s or '') for b in streamed.sequence_rows({str(tmp_path / 'large.fa.gz')!r}, 1_000_000) for s in b.column('symbols').to_pylist())\n"
        "print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    symbols, grown = map(int, out.stdout.split())
    assert symbols == 200 * ((1 << 20) // 65) * 64 and grown < 120


def test_feature_lines_end_at_embedded_sequence(spark, tmp_path):
    body = "##gff-version 3\nchr1\ts\tgene\t1\t9\t.\t+\t.\tID=g\n\n##FASTA\n>chr1\nchr1\tx\n"
    (tmp_path / "a.gff3").write_text(body)
    with gzip.open(tmp_path / "b.gff3.gz", "wt") as f:
        f.write(body)
    rows = gff.read_gff(spark, str(tmp_path)).filter("kind = 'feature'").collect()
    assert len(rows) == 2 and {r.line_number for r in rows} == {1}
    lines = spark.createDataFrame([("k", i, v) for i, v in enumerate(body.split("\n"))], "path string, line_number long, value string")
    assert gff.parse(lines, ["path"], "line_number").filter("kind = 'feature'").count() == 1


def test_archives_are_read_as_streams(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "one\ntwo\r\nthree")
        z.writestr("b.txt.gz", gzip.compress("vier\nfünf\n".encode()))
        z.writestr("c.bin", os.urandom(3 << 20))
    data = bytearray((tmp_path / "z.zip").read_bytes())
    data[len(data) // 2] ^= 1  # in the middle of c.bin
    (tmp_path / "y.zip").write_bytes(data)
    rows = archive.read_zip_members(spark, str(tmp_path)).collect()
    assert {(os.path.basename(r.path), r.member_name): r.crc_verified for r in rows} == {(z, m): (z, m) != ("y.zip", "c.bin") for z in ("z.zip", "y.zip") for m in ("a.txt", "b.txt.gz", "c.bin")}
    got = archive.read_member_text(spark, str(tmp_path / "z.zip"), r"\.txt").collect()
    assert [(r.member_name, r.line_number, r.value) for r in got] == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("a.txt", 3, "three"), ("b.txt.gz", 1, "vier"), ("b.txt.gz", 2, "fünf")]


def test_paths_with_a_scheme(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nACGT\n")
    assert streamed.sequence_chunks(spark, f"file://{tmp_path}").first().symbols == "ACGT"
    assert streamed.sequence_chunks(spark, f"file:{tmp_path}/a.fa").count() == 1


@pytest.mark.parametrize("chunk", [1, 3, 4, 50, 10_000])
def test_sketches_do_not_depend_on_chunks(spark, tmp_path, chunk):
    rows = records(4)
    (tmp_path / "a.fa").write_text(text_of(rows))
    chunks = streamed.sequence_chunks(spark, str(tmp_path), chunk)
    got = kmers.chunk_sketches(chunks, ["path"], ["path", "record"], "chunk", "symbols", 11, 3).first().hashes
    whole = spark.createDataFrame([("k", s) for _, s in rows], "path string, s string")
    assert got == similarity.sequence_sketches(whole, "path", "s", 11, 3).first().hashes and len(got) > 50
    assert chunks.select(F.sum(F.length(normalised(F.col("symbols"))))).first()[0] == sum(len(s) for _, s in rows)


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_profile_of_chunks_is_that_of_records(spark, tmp_path, chunk):
    (tmp_path / "a.fa").write_text(text_of(records(6)) + ">r1 again\nRYKx\n")
    got = profile.chunk_profile(streamed.sequence_chunks(spark, str(tmp_path), chunk), ["path"], long=300).first()
    want = profile.sequence_profile(fasta.read_fasta(spark, str(tmp_path)), ["path"]).first()
    for c in want.asDict():
        if c != "path":
            assert got[c] == want[c], c
    whole = [s for _, s in records(6)] + ["RYKx"]
    assert got.large_sequence_fraction == pytest.approx(sum(len(s) for s in whole if len(s) >= 300) / sum(map(len, whole)))
    assert got.n_fraction == pytest.approx(sum(s.upper().count("N") for s in whole) / sum(map(len, whole))) and not got.n_fraction_passes
