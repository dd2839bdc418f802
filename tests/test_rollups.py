"""Roll-ups, release contracts and the flagship release on small tables."""

import pytest

from granary.plans import curation, rollups


def test_record_quality_and_masks(spark):
    records = spark.createDataFrame([("a", 1, 900, True), ("a", 2, 100, False), ("b", 1, 500, True), ("b", 2, 500, False)], "candidate_id string, record_id int, length long, is_primary boolean")
    classes = spark.createDataFrame([("a", 1, "eukarya", 890), ("a", 1, "bacteria", 4), ("a", 2, "bacteria", 100), ("b", 1, "unknown", 300)], "candidate_id string, record_id int, class string, bases long")
    vector = spark.createDataFrame([("b", 1, 50)], "candidate_id string, record_id int, bases long")
    got = {r.candidate_id: r for r in rollups.record_quality(records, classes, vector).collect()}
    assert got["a"].status == "PASS" and got["a"].primary_prokaryotic_bases == 4 and got["a"].nuclear_fraction == 0.9
    assert got["b"].reasons == ["LOW_NUCLEAR", "LOW_EVALUATED", "VECTOR"] and got["b"].vector_fraction == 0.1
    chunks = spark.createDataFrame([("a", 1, 0, 100, "bacteria"), ("a", 1, 100, 200, "eukarya"), ("a", 1, 300, 400, "unknown")], "candidate_id string, record_id int, start long, end long, class string")
    hits = spark.createDataFrame([("a", 1, 101, 150), ("a", 1, 260, 251)], "candidate_id string, record_id int, start long, end long")
    spans = sorted((r.start, r.end, r.sources) for r in rollups.masks(chunks, hits).collect())
    assert spans == [(0, 150, ["chunk:bacteria", "vector"]), (250, 260, ["vector"])]


def test_completeness_and_merged_modes(spark):
    mode = "struct<complete:double,single:double,duplicated:double,fragmented:double,missing:double>"
    rows = [("a", 1.25, "", (95.0, 90.0, 5.0, 1.0, 4.0), (90.0, 80.0, 10.0, 5.0, 5.0)), ("b", 2.0, "", (95.0, 90.0, 5.0, 1.0, 4.0), (89.9, 80.0, 9.9, 5.0, 5.1)), ("c", 2.0, "boom", None, None), ("d", 2.0, "", (95.0, None, 5.0, 1.0, 4.0), (99.0, 80.0, 9.9, 5.0, 5.1))]
    results = spark.createDataFrame(rows, f"candidate_id string, elapsed_seconds double, error string, annotation {mode}, genome {mode}")
    tasks = spark.createDataFrame([(x,) for x in "abcde"], "candidate_id string")
    assert {r.candidate_id: r.status for r in rollups.completeness(tasks, results).collect()} == {"a": "PASS", "b": "FAIL", "c": "ERROR", "d": "ERROR", "e": "MISSING"}
    combined = results.filter("candidate_id = 'a'")
    left, right = results.filter("candidate_id in ('a', 'b')").drop("genome"), results.filter("candidate_id = 'b'").drop("annotation")
    got = {r.candidate_id: r.elapsed_seconds for r in rollups.merged_modes(combined, [left, right], ("annotation", "genome")).collect()}
    assert got == {"a": 1.25, "b": 4.0}


def test_release_and_its_contract(spark):
    sources = spark.createDataFrame([("a", "G", "G one", "n1"), ("b", "G", "G two", "n2"), ("c", "H", "H x", "n3")], "candidate_id string, genus string, species string, near_group string")
    spans = spark.createDataFrame([("a", 0, 100), ("b", 0, 50), ("b", 60, 80), ("c", 0, 10)], "candidate_id string, start long, end long")
    masks = spark.createDataFrame([("a", 20, 30)], "candidate_id string, start long, end long")
    got = {r.candidate_id: r for r in curation.release(sources, spans, masks, [10, 25], ["H"]).collect()}
    assert got["a"].bases == 90 and got["a"].capacity == {10: 9, 25: 2} and got["b"].capacity == {10: 7, 25: 2}
    assert got["c"].split == "cold_genus_holdout" and got["c"].sampling_weight == 0
    assert got["a"].sampling_weight + got["b"].sampling_weight == pytest.approx(1)
    assert got["a"].sampling_weight == pytest.approx(90**0.3 / (90**0.3 + 70**0.3))
    leaky = sources.withColumn("near_group", sources.candidate_id.substr(2, 1))
    with pytest.raises(ValueError):
        curation.release(leaky, spans, masks, [10], ["H"])

    released = spark.createDataFrame([("a", "n1", "p"), ("b", "n1", "q"), ("d", "n9", "p")], "candidate_id string, near_group string, split string")
    cut = spark.createDataFrame([("a", 0, 0, 10), ("a", 0, 5, 20), ("b", 0, 90, 120), ("z", 0, 3, 3)], "candidate_id string, record_index int, start long, end long")
    able = spark.createDataFrame([("a", 0, 0, 50), ("b", 0, 0, 100)], "candidate_id string, record_index int, start long, end long")
    told = spark.createDataFrame([("a", 10, 2), ("b", 10, 3), ("z", 10, 0)], "candidate_id string, context int, windows long")
    bad = {(r.candidate_id, r.rule) for r in rollups.release_violations(released, cut, able, told, [10]).collect()}
    assert bad == {
        ("a", "overlapping intervals"), ("b", "outside callable intervals"), ("z", "outside callable intervals"), ("z", "bad coordinates"), ("z", "interval without source"),
        ("d", "no interval"), ("a", "group in two splits"), ("b", "group in two splits"),
    }
    stores = spark.createDataFrame([("a", 5), ("x", 7)], "candidate_id string, bytes long")
    assert [r.bytes for r in rollups.unreferenced(stores, released).collect()] == [7]


def test_archive_candidates(spark):
    members = spark.createDataFrame([("p", "g.fa", "fasta", True, True, False), ("p", "../h.fa", "fasta", False, True, False), ("p", "t.tsv", "table", True, True, False)], "path string, member_name string, member_type string, safe_path boolean, crc_verified boolean, encrypted boolean")
    archives, listed = (spark.createDataFrame([("p", 9)], "path string, size_bytes long") for _ in range(2))
    rows = rollups.archive_candidates(members, archives, listed, "fasta").collect()
    assert [r.member_name for r in rows] == ["g.fa"] and len(rows[0].candidate_id) == 16
    with pytest.raises(Exception, match="size differs"):
        rollups.archive_candidates(members, archives, spark.createDataFrame([("p", 8)], "path string, size_bytes long"), "fasta").collect()
