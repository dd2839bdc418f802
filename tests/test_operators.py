"""Operators against small known answers and brute force."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.functions import keys, sequences, text
from granary.operators import audit, gates, intervals, profile, resolve, sampling, shards
from granary.operators.components import connected_components


def spans(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def frame(spark, pairs, key=1):
    return spark.createDataFrame([(key, a, b) for a, b in pairs], "k int, start long, end long")


def test_interval_goldens(spark):
    assert spans(intervals.merge_inclusive(frame(spark, [(10, 20), (15, 30), (40, 40)]), ["k"])) == [(10, 30), (40, 40)]
    assert intervals.merged_bases(frame(spark, [(10, 20), (30, 15), (40, 40)]), ["k"]).first()["bases"] == 22
    assert spans(intervals.merge_half_open(frame(spark, [(10, 20), (15, 30), (30, 35), (40, 41), (50, 50)]), ["k"])) == [(10, 35), (40, 41)]
    left = intervals.subtract(frame(spark, [(0, 100), (200, 260)]), frame(spark, [(20, 30), (25, 50), (230, 300)]), ["k"])
    assert spans(left) == [(0, 20), (50, 100), (200, 230)]
    assert intervals.capacity(frame(spark, [(0, 262144), (0, 524287), (0, 524288)]), ["k"], [262144]).first()["windows"] == 4
    with pytest.raises(PySparkException):
        intervals.merge_half_open(frame(spark, [(5, 1)]), ["k"]).collect()


def test_subtract_and_containment_against_brute_force(spark):
    rng = random.Random(3)
    rows, masks, inner = [], [], []
    for k in range(40):
        for out, n in ((rows, 5), (masks, 4), (inner, 5)):
            for _ in range(rng.randrange(n)):
                a = rng.randrange(40)
                out.append((k, a, a + rng.randrange(12)))
    make = lambda r: spark.createDataFrame(r, "k int, start long, end long")
    got = {}
    for r in intervals.subtract(make(rows), make(masks), ["k"]).collect():
        got.setdefault(r["k"], set()).update(range(r["start"], r["end"]))
    for k in range(40):
        cover = {x for q, a, b in rows if q == k for x in range(a, b)} - {x for q, a, b in masks if q == k for x in range(a, b)}
        assert got.get(k, set()) == cover
    for r in intervals.contained(make(inner), make(rows), ["k"]).collect():
        cover = {(a, b) for a, b in spans(intervals_of(rows, r["k"]))}
        assert r["inside"] == any(a <= r["start"] and r["end"] <= b for a, b in cover)


class intervals_of:
    """Merged half-open intervals of one key, in plain Python."""

    def __init__(self, rows, key):
        points = sorted((a, b) for k, a, b in rows if k == key and b > a)
        self.out = []
        for a, b in points:
            if self.out and a <= self.out[-1][1]:
                self.out[-1][1] = max(b, self.out[-1][1])
            else:
                self.out.append([a, b])

    def collect(self):
        return [{"start": a, "end": b} for a, b in self.out]


def test_localise_and_callable_runs(spark):
    contigs = spark.createDataFrame([(1, 0, 1000, 120), (1, 1, 1120, 50)], "k int, record_index int, offset long, length long")
    runs = spark.createDataFrame([(1, 0, 1020, 100)], "k int, record_index int, start long, length long")
    assert spans(intervals.localise(runs, contigs, ["k"])) == [(20, 120)]
    bad = spark.createDataFrame([(1, 1, 1100, 60)], "k int, record_index int, start long, length long")
    with pytest.raises(PySparkException):
        intervals.localise(bad, contigs, ["k"]).collect()
    df = spark.createDataFrame([("chr1", 0, "ACGTNNACGT"), ("chr2", 10, "TTryACGT"), ("none", 18, "NN"), ("null", 0, None)], "k string, at long, s string")
    got = sorted((r.k, r.start, r.end) for r in intervals.callable_runs(df, ["k"], "s", offset=F.col("at")).collect())
    assert got == [("chr1", 0, 4), ("chr1", 6, 10), ("chr2", 10, 12), ("chr2", 14, 18)]
    text_ = spark.createDataFrame([("ACGTACGT" + "N" * 8 + "ACGTACGT",)], "t string")
    assert [(r.chunk_start, r.chunk_end) for r in intervals.chunks(text_, "t", 8, 4, "ACGT", 0.5).collect()] == [(0, 8), (16, 24)]


def test_keys(spark):
    paths = ["a/b.fa.gz", "x.GFF3", "v.vcf.bgz", "b.bed", "sum.md5", "t.tar.gz", "t.7z", "readme", "genome.gtf.zst"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(keys.file_type(F.col("p"))).collect()] == ["fasta", "annotation", "variant", "interval", "checksum", "archive", "archive", "other", "annotation"]
    names = {"ok/a.txt": True, "/abs": False, "a/../b": False, "C:/x": False, "": False, ".": False, "..\\x": False, "C:x": True}
    df = spark.createDataFrame([(p,) for p in names], "p string")
    assert {r[0]: r[1] for r in df.select("p", keys.safe_path(F.col("p"))).collect()} == names
    df = spark.createDataFrame([("Wm82.gnm4.abc", "Zh13_T2T-2", "x.v3", " Glycine  max L. ", "TRUE", "", "12")], "a string, b string, c string, d string, e string, f string, g string")
    r = df.select(keys.assembly_stem(F.col("a")), keys.material_key(F.col("b"), True), keys.material_key(F.col("c"), True), keys.binomial(F.col("d")), keys.text_bool(F.col("e")), keys.nullable_int(F.col("f")), keys.nullable_int(F.col("g"))).first()
    assert tuple(r) == ("Wm82.gnm4", "zh13", "x", "Glycine max", True, None, 12)
    layouts = [("family/alpha", 5, 2, 3, 4), ("family/beta", 4, 2, None, 3), ("gamma", 1, None, None, 1)]
    df = spark.createDataFrame([("family/alpha/Glycine/max_x/asm/f.fa",), ("family/beta/Vigna_radiata/asm2/f.fa",), ("gamma/one/f.fa",), ("other/f",)], "p string")
    got = [tuple(r[0]) for r in df.select(keys.path_fields(F.col("p"), layouts)).collect()]
    assert got == [("family_alpha", "Glycine", "Glycine max x", "asm"), ("family_beta", "Vigna", "Vigna radiata", "asm2"), ("gamma", "", "", "one"), ("other", "", "", "")]


def test_text(spark):
    df = spark.createDataFrame([("DOI: https://dx.doi.org/10.1/AB ", "<i>The</i>&nbsp;Straße Ⅷ"), (None, None)], "d string, t string")
    rows = df.select(text.doi(F.col("d")), text.title("t")).collect()
    assert tuple(rows[0]) == ("10.1/ab", "the strasse viii") and tuple(rows[1]) == ("", None)
    page = spark.createDataFrame([('<meta name="citation_title" content="A b"><meta content="2020" name="year">',)], "h string")
    assert tuple(page.select(text.meta_content(F.col("h"), "citation_title"), text.meta_content(F.col("h"), "year"), text.meta_content(F.col("h"), "no")).first()) == ("A b", "2020", "")
    j = spark.createDataFrame([("Nature", ""), ("Nature Genetics", ""), ("Scientific Data", ""), ("Communications Law", "Springer"), ("Naturae", "")], "j string, p string")
    assert [r[0] for r in j.select(text.in_portfolio(F.col("j"), F.col("p"))).collect()] == [True, True, True, True, False]


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTNRYx",), ("",), (None,)], "s string")
    r = df.select(sequences.reverse_complement(F.col("s")), sequences.tokens(F.col("s")), sequences.symbol_count(F.col("s"), "ACGT")).collect()
    assert r[0][0] == "XRYNACGT" and r[0][1] == [2, 3, 4, 5, 6, 7, 8, 6] and r[0][2] == 4
    assert r[1][1] == [] and r[2][0] is None
    ids = df.limit(1).select(sequences.reverse_complement_tokens(sequences.tokens(F.lit("ACGTNRY")))).first()[0]
    assert ids == [7, 8, 6, 2, 3, 4, 5]
    both = spark.createDataFrame([("ACGTTGCAAGTC" * 9, "GACTTGCAACGT" * 9)], "a string, b string")
    a, b = both.select(sequences.orientation_digest(F.col("a")), sequences.orientation_digest(F.col("b"))).first()
    assert a == b
    packed = spark.createDataFrame([("ACGTNNACG",)], "s string").select(sequences.pack("s").alias("p"))
    assert bytes(packed.first()["p"]) == bytes([0b00011011, 0b00000001, 0b10000000])
    assert packed.select(sequences.unpack("p", F.lit(2), F.lit(6))).first()[0] == "GTAAAC"


def test_gates(spark):
    rows = [("a", True, "o1", "s", "m", 5), ("b", True, "o1", "s", "m", 4), ("c", True, "o2", "s", "m", 4), ("d", False, "o3", "s", "m", 9), ("e", None, "o4", "s", "n", 9)]
    df = spark.createDataFrame(rows, "id string, ok boolean, o string, species string, material string, tier int")
    got = {r.id: r.status for r in gates.select_unique(df, "id", "ok", "o", ["species", "material"], [F.desc("tier"), F.desc("id")]).collect()}
    assert got == {"a": "SELECTED", "b": "REJECTED_ORIENTATION_ALTERNATIVE", "c": "REJECTED_MATERIAL_ALTERNATIVE", "d": "REJECTED_HARD_GATE", "e": "REJECTED_HARD_GATE"}
    cases = [("Complete Genome", True, 0, 0.0), ("Chromosome", True, 0, 0.0), ("Chromosome", False, 0, 0.0), ("", True, 0, 0.0), ("", False, 10_000_000, 0.8), ("", False, 10_000_000, 0.79)]
    df = spark.createDataFrame(cases, "l string, t boolean, n long, f double")
    got = [tuple(r[0]) for r in df.select(gates.assembly_tier(F.col("l"), F.col("t"), F.col("n"), F.col("f"))).collect()]
    assert got == [("complete_genome", 4, False), ("chromosome_official_t2t", 5, False), ("chromosome_official", 3, False), ("t2t_label", 5, True), ("structural_proxy", 2, True), ("insufficient", 0, True)]
    df = spark.createDataFrame([("chr1", 10, "", ".", True), ("chr_mt.1", 10, "", "", False), ("mitochondrion", 10, "", "", False), ("c", 1, "", "", False), ("c", 1, "assembled-molecule", "Chromosome", True), ("c", 99, "unplaced", "", False)], "n string, l long, r string, o string, want boolean")
    assert all(r[0] == r[1] for r in df.select(gates.primary_nuclear(F.col("n"), F.col("l"), F.col("r"), F.col("o"), 5), "want").collect())
    df = spark.createDataFrame([("true", "PASS", "3", None, True), ("True", "PASS", "3", "0", True), ("true", "PASS", "0", "0", False), ("true", "PASS", "x", "0", False), ("true", "FAIL", "3", "0", False), ("true", "PASS", "3", "1", False)], "p string, s string, g string, z string, want boolean")
    assert all(r[0] == r[1] for r in df.select(gates.strict_annotation(F.col("p"), F.col("s"), F.col("g"), [F.col("z")]), "want").collect())


def test_audit(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    got = {r.id: r.status for r in audit.audit_status(ids(1, 2, 3, 4), ids(1, 2, 2), ids(2, 3), "id").collect()}
    assert got == {1: "PASS", 2: "PASS", 3: "FAIL", 4: "MISSING"}
    with pytest.raises(PySparkException):
        audit.audit_status(ids(1, 2), ids(1), ids(1), "id", exclusive=True).collect()
    with pytest.raises(PySparkException):
        audit.strict_join(ids(1, 2), ids(1), "id").collect()
    assert audit.duplicates(ids(1, 1, 2), ["id"]).count() == 1
    with pytest.raises(ValueError):
        audit.require_empty(audit.duplicates(ids(1, 1), ["id"]), "ids")
    a, b = audit.content_digest(ids(1, 2, 3)).first(), audit.content_digest(ids(3, 1, 2)).first()
    assert a == b and a["digest"] != audit.content_digest(ids(3, 1, 1)).first()["digest"]
    df = spark.createDataFrame([(1, "x", True), (2, "x", True), (3, "y", True), (4, "x", False), (5, None, None)], "id int, d string, ok boolean")
    one = {r.id: (r.exact_group, r.exact_group_size) for r in audit.exact_groups(df, "d", "exact_", False, F.col("ok")).collect()}
    assert one == {1: ("exact_x", 2), 2: ("exact_x", 2), 3: ("", 1), 4: ("", 0), 5: ("", 0)}
    two = {r.id: (r.exact_group, r.exact_group_size) for r in audit.exact_groups(df, "d", "exact-", True, F.col("ok")).collect()}
    assert two[3] == ("exact-y", 1) and two[4] == ("", 0)


def test_resolve(spark):
    rows = [(1, "k1", "p1", "A"), (2, "k1", "p1", ""), (3, "k2", "p2", None), (4, "k3", "p2", "B"), (5, "k3", "p2", "C"), (6, "k9", "p1", "")]
    df = spark.createDataFrame(rows, "id int, k string, p string, v string")
    got = {r.id: (r.v, r.value_source) for r in resolve.staged_imputation(df, "v", [("key", F.col("k"), None, False), ("prefix", F.col("p"), None, False)]).collect()}
    assert got == {1: ("A", "given"), 2: ("A", "key"), 3: (None, "unresolved"), 4: ("B", "given"), 5: ("C", "given"), 6: ("A", "prefix")}
    alias = spark.createDataFrame([("s", "c", "a1"), ("s", "c", "a2")], "scope string, canonical string, alias string")
    df = spark.createDataFrame([("s", "a1"), ("s", "c"), ("s", "z"), ("t", "a1")], "scope string, m string")
    assert sorted((r.scope, r.m) for r in resolve.canonical_alias(df, alias, "scope", "m").collect()) == [("s", "c"), ("s", "c"), ("s", "z"), ("t", "a1")]
    clash = alias.union(spark.createDataFrame([("s", "d", "a1")], alias.schema))
    with pytest.raises(PySparkException):
        resolve.canonical_alias(df, clash, "scope", "m").collect()
    left = spark.createDataFrame([(1, "x", "f"), (2, "q", "f"), (3, "q", "g"), (4, None, None)], "id int, k string, f string")
    right = spark.createDataFrame([("x", "f", 9), ("x", "f", 8), ("y", "f", 7)], "k2 string, f2 string, rid int")
    paired = resolve.fallback_pairing(left, right, ("k", "k2"), ("f", "f2"), "rid", preview=2).collect()
    assert {r.id: (r.pair_level, r.pair_key, r.paired_count, r.paired_ids) for r in paired} == {1: (1, "x", 2, [8, 9]), 2: (2, "f", 3, [7, 8]), 3: (None, None, 0, []), 4: (None, None, 0, [])}
    members = resolve.pair_members(right, "k2", "f2", "rid").filter("pair_level = 2 AND pair_key = 'f'")
    assert sorted(r.rid for r in members.collect()) == [7, 8, 9]
    lit = spark.createDataFrame([(1, "d", "ab", ["q1"]), (2, "d", "cd", ["q2"]), (3, "d", "abc", ["q1"]), (4, "e", None, ["q3"])], "ord int, doi string, t string, q array<string>")
    merged = {r.merge_key: (r.t, r.q) for r in resolve.longest_fields(lit, F.col("doi"), "ord", ["t"], ["q"]).collect()}
    assert merged == {"d": ("abc", ["q1", "q2"]), "e": (None, ["q3"])}


def test_profiles(spark):
    df = spark.createDataFrame([("a", 9), ("a", 6), ("b", 0), ("c", None), ("d", 5), ("d", 5), ("d", 4)], "k string, n int")
    assert {r.k: r.n50 for r in profile.n50(df, ["k"], "n").collect()} == {"a": 9, "b": 0, "c": 0, "d": 5}
    contigs = spark.createDataFrame([(1, "chr1", 100), (2, "chr1", 100)], "k int, seqid string, length long")
    feats = spark.createDataFrame([(1, "chr1", 1, 100, "gene"), (1, "chr1", 5, 50, "exon"), (2, "chr1", 1, 101, "gene"), (2, "chr9", 1, 5, "gene")], "k int, seqid string, start long, end long, type string")
    got = {r.k: (r.status, r.unknown_seqid_count, r.out_of_bounds_feature_count, r.unknown_preview) for r in profile.closure(feats, contigs, ["k"]).collect()}
    assert got == {1: ("PASS", 0, 0, []), 2: ("FAIL", 1, 1, ["chr9"])}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(2000, 2000 + i) for i in range(200)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_end_when_edges_are_stars(spark, monkeypatch):
    from granary.operators import components

    tables, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, label: tables.append(write(df, label)) or tables[-1])
    stars = [(1, 5), (5, 1), (7, 1), (2, 9), (9, 8)]
    got = components.connected_components(spark.createDataFrame(stars, "a long, b long"), "a", "b").collect()
    assert {(r.node, r.component) for r in got} == {(1, 1), (5, 1), (7, 1), (2, 2), (9, 2), (8, 2)} and len(got) == 6
    assert len(tables) == 2  # the edges and one round; none that changes nothing
    kept = lambda edges: components._settled(spark.createDataFrame(edges, "u long, v long"))
    assert kept([]) and kept([(5, 1), (7, 1), (9, 2)])
    assert not kept([(5, 1), (5, 2)]) and not kept([(5, 2), (2, 1)])


def test_component_rounds_join_by_shuffles_of_their_own(spark):
    from granary.operators import components

    edges = spark.createDataFrame([(5, 1), (7, 1)], "u long, v long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = edges.join(components._least(edges), "u")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 3


def test_sampling(spark):
    items = spark.createDataFrame([(i, w) for i, w in enumerate([5, 0, 1, 10, 3, 7, 2])], "id int, w int")
    draws = spark.range(500).select("id", (F.col("id") / 500).alias("u")).withColumnRenamed("id", "d")
    got = sampling.weighted_draws(items, draws, "id", "w").groupBy("id").count().collect()
    counts = {r["id"]: r["count"] for r in got}
    assert sum(counts.values()) == 500 and 1 not in counts
    assert all(abs(counts[i] - 500 * w / 28) <= 1.01 for i, w in {0: 5, 2: 1, 3: 10, 4: 3, 5: 7, 6: 2}.items())
    ids = spark.createDataFrame([(1, [2, 3, 4, 5] * 64), (2, [2])], "k int, ids array<int>")
    rows = {r.k: r for r in sampling.span_mask(ids, ["k"], "ids", 1).collect()}
    chosen = [x != -100 for x in rows[1].labels]
    assert sum(chosen) == 39 and sum(x != -100 for x in rows[2].labels) == 1
    assert all(c or a == b for c, a, b in zip(chosen, rows[1].masked, [2, 3, 4, 5] * 64))
    assert rows[1].masked == {r.k: r for r in sampling.span_mask(ids, ["k"], "ids", 1).collect()}[1].masked
    steps = spark.createDataFrame([(0, 0), (1, 0)], "step long, rank long")
    sources = [{"name": "a", "weight": 1.0, "intervals": [(0, 10), (100, 3)]}, {"name": "b", "weight": 0.0, "intervals": [(50, 8)]}]
    rows = sampling.sample_windows(steps, sources, 5, 9, 8).collect()
    assert len(rows) == 16 and all((r.source == "a" and 0 <= r.start <= 5) or (r.source == "b" and 50 <= r.start <= 53) for r in rows)


def test_shards(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([9, 8, 7, 6, 5])], "id int, size long")
    loads = shards.lpt_shards(df, "id", "size", 2).groupBy("shard").agg(F.sum("size").alias("s")).orderBy("shard").collect()
    assert [r.s for r in loads] == [20, 15]
    numbered = shards.task_index(spark.range(0, 1000, 7), "id").orderBy("id").collect()
    assert [r.task_index for r in numbered] == list(range(1, len(numbered) + 1))
    batch = shards.tiered_batch(df, F.when(F.col("size") > 7, 2).otherwise(5), [F.desc("size")], {2: 1, 5: 9}).collect()
    assert [(r.id, r.tier) for r in batch] == [(0, 2)]
    left = shards.capped_retries(df.select("id"), spark.createDataFrame([(1,), (1,), (1,), (2,)], "id int"), "id").collect()
    assert sorted(r.id for r in left) == [0, 2, 3, 4]


def test_merges_sort_once_and_group_nothing(spark):
    """A task that merges holds one sort, no maps of islands."""
    rows = [(k, (k * 37 + i * 53) % 400, (k * 37 + i * 53) % 400 + i % 9) for k in range(4) for i in range(60)]
    df = spark.createDataFrame([*rows, (9, None, None), (9, None, None), (9, 7, None)], "k int, start long, end long")
    for merge, gap in ((intervals.merge_half_open, 0), (intervals.merge_inclusive, 1)):
        got = merge(df, ["k"])
        plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
        want = [(9, None, None), (9, None, None), (9, 7, 7)] if gap else []
        for k in range(4):
            last = None
            for s, e in sorted((s, e) for r, s, e in rows if r == k and (gap or e > s)):
                if last and s <= last[2] + gap:
                    last[2] = max(last[2], e)
                else:
                    want.append(last := [k, s, e])
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want)))
