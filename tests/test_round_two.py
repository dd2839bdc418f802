"""Known answers and brute force for sampling, similarity search, sources and text."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import keys, text
from granary.operators import lineage, sampling, similarity
from granary.sources import fasta


def test_windows_equal_numpy_choice(spark):
    """Each draw is what a generator's weighted choice gives over sources, then over rooms of intervals."""
    sources = [{"name": "a", "weight": 2.0, "intervals": [(0, 10), (100, 30), (7, 2)]}, {"name": "b", "weight": 0.0, "intervals": [(50, 8)]}, {"name": "c", "weight": 9.0, "intervals": [(5, 4)]}]
    steps = spark.createDataFrame([(i, i % 3) for i in range(20)], "step long, rank long")
    got = {(r.step, r.rank, r.row): (r.source, r.start, r.reverse) for r in sampling.sample_windows(steps, sources, 5, 9, 8).collect()}
    assert len(got) == 160
    usable = {"a": [(0, 10), (100, 30)], "b": [(50, 8)]}
    for step in range(20):
        digest = hashlib.sha256(f"9\0{step}\0{step % 3}".encode()).digest()
        rng = np.random.default_rng(int.from_bytes(digest[:8], "little"))
        for row in range(8):
            name = "ab"[rng.choice(2, p=[2 / 3, 1 / 3])]
            room = np.array([n - 4 for _, n in usable[name]], float)
            low, n = usable[name][rng.choice(len(room), p=room / room.sum())]
            assert got[step, step % 3, row] == (name, rng.integers(low, low + n - 4), bool(rng.integers(0, 2)))
    with pytest.raises(ValueError):
        sampling.sample_windows(steps, sources, 50, 9, 8)


@pytest.mark.parametrize("mean", [1.0, 3.0, 20.0])
def test_spans_cover_an_exact_share_without_overlap(mean):
    rng = np.random.default_rng(4)
    hits = np.zeros(100)
    for n in [0, 1, 2, 7, 100, 100, 100, 5000] * 20:
        start, length = sampling.span_starts(n, 0.15, mean, rng)
        at = np.concatenate([np.arange(a, a + k) for a, k in zip(start, length)] + [np.zeros(0, int)]).astype(int)
        assert len(at) == len(set(at.tolist())) == -(-n * 15 // 100) and (not len(at) or 0 <= at.min() <= at.max() < n)
        if n == 100:
            hits += np.bincount(at, minlength=100)
    assert hits.min() > 0 or mean == 20.0


def test_span_mask_on_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, [2, 3, 4, 5] * 50), (1, [2, 3, 4, 5] * 50), (2, []), (3, None)], "k int, ids array<int>")
    rows = sampling.span_mask(df, ["k"], "ids", 1).collect()
    one, again = (r for r in rows if r.k == 1)
    assert one == again and sum(x != -100 for x in one.labels) == 30
    kinds = [m == 1 for m, x in zip(one.masked, one.labels) if x != -100]
    assert 15 <= sum(kinds) <= 30 and all(m == x for m, x, c in zip(one.ids, one.masked, one.labels) if c == -100)
    assert [list(r.masked) for r in rows if r.k in (2, 3)] == [[], []]


@pytest.mark.parametrize(("elements", "at_once"), [(2_000_000, 4_000_000), (30, 40)])
def test_best_jaccard_against_brute_force(spark, monkeypatch, elements, at_once):
    monkeypatch.setattr(similarity, "QUERY_ELEMENTS", elements)
    monkeypatch.setattr(similarity, "AT_ONCE", at_once)
    rng = random.Random(2)
    rows = [(i, [7, *rng.sample(range(8, 60), rng.randrange(12))]) for i in range(60)] + [(60, []), (61, [1000]), (62, rng.sample(range(8, 60), 9)), (None, [1000])]
    rows.append((63, rows[62][1]))
    df = spark.createDataFrame(rows, "id long, items array<long>")
    got = {r.id: r.max_jaccard for r in similarity.best_jaccard(df, df.filter("id % 2 = 0 or id > 59"), "id", "items").collect()}
    score = lambda x, y: len(set(x) & set(y)) / max(1, len(set(x) | set(y)))
    assert got == pytest.approx({i: max(score(x, y) for j, y in rows if j != i) for i, x in rows if i is not None and (i % 2 == 0 or i > 59)})
    assert similarity.best_jaccard(df, df.limit(0), "id", "items").count() == 0


def test_blocks_are_compared_with_what_queries_have(spark, monkeypatch):
    """several blocks read sets once, and only elements that a query may have; sizes stay those of whole sets."""
    monkeypatch.setattr(similarity, "QUERY_ELEMENTS", 300)
    kept, own = {}, similarity.written
    monkeypatch.setattr(similarity, "written", lambda x, label: kept.setdefault(label, own(x, label)) if label == "met" else own(x, label))
    rng = random.Random(4)
    rows = [(i, [rng.getrandbits(63) for _ in range(100)]) for i in range(200)]
    rows += [(1000 + i, rows[i][1][: 50 + i] + [rng.getrandbits(63) for _ in range(40)]) for i in range(0, 40, 2)]
    df = spark.createDataFrame(rows, "id long, items array<long>")
    got = {r.id: r.max_jaccard for r in similarity.best_jaccard(df, df.filter("id < 20"), "id", "items").collect()}
    sets = dict(rows)
    score = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert got == pytest.approx({i: max(score(sets[i], y) for j, y in rows if j != i) for i in range(20)})
    met = kept["met"].collect()
    asked = {x for i in range(20) for x in sets[i]}
    assert all(r.n == len(sets[r.k]) and set(sets[r.k]) & asked <= set(r.x) <= set(sets[r.k]) for r in met)
    assert sum(len(r.x) for r in met) < 0.5 * sum(len(x) for x in sets.values())


def test_fasta_without_a_header_is_an_error(spark, tmp_path):
    (tmp_path / "bad.fa").write_text("ACGTACGT\nACGT\n>r1\nAC\n")
    with pytest.raises(ValueError, match="bad.fa"):
        fasta.read_fasta(spark, str(tmp_path / "bad.fa"))
    (tmp_path / "good.fa").write_text("\n>r1\tfirst one\nAC\nGT\n>r2 second\n>r3\nA\n")
    got = {r.name: (r.header, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "good.fa")).collect()}
    assert got == {"r1": ("r1\tfirst one", "ACGT"), "r2": ("r2 second", ""), "r3": ("r3", "A")}


def test_text_and_path_functions(spark):
    page = spark.createDataFrame([("<meta name='t' content=' a \n  b '>",)], "h string")
    assert page.select(text.meta_content(F.col("h"), "t")).first()[0] == "a b"
    paths = ["x/GFF/Soy.gene.gff3.gz", "gff/a.gene_models.gff.gz", "x/gffs/a.gene.gff3.gz", "x/gff/iprscan.gff", "a/GCF_1_genomic.gff.gz"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(keys.annotation_role(F.col("p"), keys.PRIMARY_ROLES, keys.SECONDARY_ROLES).alias("r")).collect()
    assert [tuple(r.r) for r in got] == [("soyomics_gene", True), ("soyomics_gene", True), ("other_annotation", False), ("functional_iprscan", False), ("ncbi_genomic", True)]
    numbers = spark.createDataFrame([(" 7 ",), ("",), (None,)], "v string").select(keys.nullable_int(F.col("v"))).collect()
    assert [r[0] for r in numbers] == [7, None, None]
    with pytest.raises(Exception):
        spark.createDataFrame([(".",)], "v string").select(keys.nullable_int(F.col("v"))).collect()
    dois = [("doi:10.1/A", "10.1/a"), (" DOI: http://dx.doi.org/10.2/b ", "10.2/b"), ("https://doi.org/10.3/c", "10.3/c"), (None, ""), ("10.4/d", "10.4/d")]
    assert [r[0] for r in spark.createDataFrame(dois, "v string, w string").select(text.doi(F.col("v"))).collect()] == [w for _, w in dois]


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master, applicationId = "local-cluster[1,1,1024]", "x"

    class Session:
        sparkContext = Context()
        conf = {"spark.other": ""}

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())


def test_audit_tables(spark):
    from granary.plans import audits

    registry = spark.createDataFrame([(i,) for i in range(6)], "id int")
    results = spark.createDataFrame([(0, "aa" * 32, 5), (1, "aa" * 32, 5), (2, "bb" * 32, 7)], "id int, digest string, n long")
    audited = audits.sequence_audit(registry, results, spark.createDataFrame([(3,)], "id int"), "id", "digest")
    assert audits.audit_summary(audited, "digest", ["n"]).first().asDict() == {
        "candidate_count": 6, "pass_count": 3, "fail_count": 1, "missing_count": 2, "total_n": 17, "unique_count": 2, "duplicate_group_count": 1, "duplicate_member_count": 2, "unique_n": 12,
    }
    with pytest.raises(Exception, match="both"):
        audits.sequence_audit(registry, results, results.select("id"), "id", "digest").collect()
    counts = spark.createDataFrame([(1, 'b"', 2), (1, "a", 1), (1, "a", 4)], "k int, f string, n int")
    assert audits.map_text(counts, ["k"], "f", "n").first()[1:] == ('{"a":5,"b\\"":2}', 7)
    taxa = spark.createDataFrame([("x", "G", "G max"), ("x", "G", "G max var"), ("y", "G", "G a"), ("y", "H", "H a"), ("z", "G", "G a")], "g string, genus string, s string")
    assert {r.g: r.compatible for r in audits.compatible_taxa(taxa, "g", "genus", "s").collect()} == {"x": True, "y": False, "z": True}
    lists = spark.createDataFrame([(1, "a; b;"), (2, "."), (3, None), (4, "b")], "k int, l string")
    assert sorted(map(tuple, audits.by_list(lists, "k", "l").collect())) == [("a", 1), ("b", 1), ("b", 4)]
    one, two = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", "m")], "id string, member string")
    with pytest.raises(Exception, match="not unique"):
        audits.annotation_catalog(one, two, "id", {}).collect()
    whole = spark.createDataFrame([(1,), (2,)], "k int")
    assert [r.rule for r in audits.subset_violations(whole, whole, "k").collect()] == ["not proper"]
    assert audits.subset_violations(whole.limit(1), whole, "k").count() == 0
    order = spark.createDataFrame([("b", None, None), ("a", 2001, None), ("a", 2000, "x")], "t string, y int, d string").orderBy(*audits.literature_order("t", "y", "d")).collect()
    assert [(r.t, r.y) for r in order] == [("b", None), ("a", 2000), ("a", 2001)]


def test_sketches_of_records_with_long_chunks(spark):
    text = "".join(random.Random(1).choice("ACGTN" if i % 9 == 0 else "ACGT") for i in range(300))
    turn = str.maketrans("ACGT", "TGCA")
    want = {min(x, x[::-1].translate(turn)) for s in (text, "acgtacca") for x in (s.upper()[i : i + 5] for i in range(len(s) - 4)) if "N" not in x}
    df = spark.createDataFrame([(text,), ("acgtacca",), ("AC",), (None,)], "s string")
    for chunk in (7, 1 << 20):
        got = [x for r in df.select(similarity.canonical_kmers(F.col("s"), 5, chunk)).collect() for x in r[0] or []]
        assert set(got) == want


def test_files(spark, tmp_path):
    from granary.sources import delimited, sinks, tree

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s.json").write_text('{"x": 1}')
    assert delimited.single_json(spark, str(tmp_path), "s.json").first().x == 1
    (tmp_path / "s.json").write_text('{"x": 2}')
    with pytest.raises(ValueError, match="more than one"):
        delimited.single_json(spark, str(tmp_path), "s.json")
    assert tree.confined(str(tmp_path), "a/s.json").endswith("a/s.json")
    (tmp_path / "out").symlink_to("/")
    for bad in ("/etc", "../x", "out/etc"):
        with pytest.raises(ValueError):
            tree.confined(str(tmp_path), bad)
    assert len(tree.implementation_digest(tree, sinks)) == 64 and tree.implementation_digest(tree) != tree.implementation_digest(sinks)
    sinks.write_tsv(spark.range(50).selectExpr("50 - id as n"), f"{tmp_path}/t", ["n"])
    rows = [int(x) for f in sorted((tmp_path / "t").glob("part-*")) for x in f.read_text().split("\n")[1:] if x]
    assert rows == list(range(1, 51))
