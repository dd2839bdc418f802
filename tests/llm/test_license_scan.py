"""License scan against every rule at every word, and its defined results."""

import random
import re

import pytest

from granary.llm import license_scan
from granary.llm.license_rules import SURE, rules

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc", "cc by cc": "twice"}
KNOWN = [*license_scan.base_rules(PHRASES), *rules()]
COMPILED = [re.compile(f"({r.pattern}) ") for r in KNOWN]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
    joined, at, found = " ".join(words) + " ", 0, []
    for k, w in enumerate(words):
        for r, rule in enumerate(KNOWN):
            if m := COMPILED[r].match(joined, at):
                found.append((k, k + m[1].count(" ") + 1, rule.priority, r, rule.label, rule.base))
        at += len(w) + 1

    def gone(d):
        return any(
            (e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[:2] != d[:2] or e[2] < d[2] or e[3] < d[3])) or (e[0] < d[1] and e[1] > d[0] and e[2] < d[2])
            for e in found
        )

    base, stay = [d for d in found if d[5]], [d for d in found if d[5] or not gone(d)]
    names = lambda ds: ",".join(sorted({d[4] for d in ds}))
    first, last = (f((d[0] for d in base), default=None) for f in (min, max))
    return (len(words), len(base), first, last, names(base), names(stay), SURE.get(min((d[2] for d in stay), default=None), 0.0), len(stay))


def some_texts():
    rnd = random.Random(7)
    spoken = sorted({w for r in rules() for w in re.findall("[a-z0-9]+", r.pattern)} | {"license", "licence", "licensed"})
    plain = [re.sub(r"\(\?:[^()]*\)\??|\?", "", r.pattern.replace("[cs]", "s")) for r in rules()]
    texts = [" ".join(rnd.choice([rnd.choice(spoken), rnd.choice(plain), rnd.choice(["Öl", "of", "MIT License,"])]) for _ in range(rnd.choice([3, 40, 150]))) for _ in range(25)]
    return [
        *texts, None, "", "...", "mit einer Lizenz", "Released UNDER the\nMIT-License.", "Licensed under the Apache License, Version 2.0.", "cc by cc by cc by-nc", "élicense under",
        "SPDX-License-Identifier: GPL-3.0-or-later", "word " * 300 + "under the MIT license " * 90, "licensed under CC BY-NC 4.0. " * 3, "the unlicense \x01 license $1 \\x02",
    ]


def test_equals_every_rule_at_every_word(spark):
    texts = some_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(4)
    got = {r["k"]: tuple(r)[1:] for r in license_scan.labelled(df, "text", PHRASES, ("k",)).collect()}
    for k, text in enumerate(texts):
        assert got[k] == brute(text), text


def test_matches_hold_their_gate_and_head_and_are_short():
    for text in some_texts():
        joined = " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))) + " "
        for rule, pattern in zip(KNOWN, COMPILED, strict=True):
            for m in re.finditer(f"(?:^|(?<= ))(?={pattern.pattern})", joined):
                found = m[1].split(" ")
                assert rule.head in found and set(rule.gates) & set(found) and len(found) <= license_scan.REACH


def test_priority_and_containment(spark):
    df = spark.createDataFrame([("licensed under the GNU General Public License, version 3", 1), ("CC BY-NC-SA 4.0", 2), ("the MIT license", 3), ("SPDX-License-Identifier: MIT license", 4)], "text string, n_words int")
    rows = license_scan.labelled(df.withColumnRenamed("n_words", "k"), "text", PHRASES, ("k",)).collect()
    assert {r["k"]: (r["labels"], r["score"]) for r in rows} == {1: ("gpl-3", 0.95), 2: ("cc-by-nc,cc-by-nc-sa", 0.8), 3: ("mit", 0.8), 4: ("mit", 1.0)}


def test_clashing_names_repeats_and_empty_table(spark):
    df = spark.createDataFrame([("MIT license", "a"), ("MIT license", "a"), (None, None)], "text string, detections string")
    out = license_scan.scan(df, "text", PHRASES)
    assert out.columns == ["text", "n_words", "detections"]
    assert sorted(len(r["detections"]) for r in out.collect())[0] == 0 and out.count() == 3
    assert license_scan.labelled(df.limit(0), "text", PHRASES, ()).count() == 0


@pytest.mark.parametrize("tile", [1, 7, 1000])
def test_tiles_do_not_show(spark, tile):
    text = "under the mit license " * 20 + "x " * 50 + "redistribution and use in source and binary forms with or without modification are permitted " * 3
    df = spark.createDataFrame([(text,)], "text string")
    one, other = (license_scan.scan(df, "text", PHRASES, tile=t).first()["detections"] for t in (license_scan.TILE, tile))
    assert one == other and len(one) > 40


def test_runs_without_python(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = license_scan.labelled(df, "text", PHRASES, ("doc_id",))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
