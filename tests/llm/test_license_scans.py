"""op10: base places against plain Python; signatures, priority and intervals against all pairs of them."""

import math
import random
import re

from pyspark.sql import functions as F

from terralog.llm import license_scans
from terralog.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, norm string, found int"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
    places, labels = [], set()
    for phrase, label in license_scans.BASE.items():
        want = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base(df):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in df.collect()}


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    return license_scans.scanned(docs)


def test_base_places(spark):
    rng = random.Random(3)
    pool = ["cc", "by", "CC", "general", "Public", "license", "all", "RIGHTS", "reserved", "x", "é", "-", "K", "cc-by"]
    texts = [None, "", " ", "---", "cc by", "cc by cc by", "ccby", "écc by", "cc by", "CC-BY", "0cc by 1"]
    texts += [rng.choice([" ", "-", "\n"]).join(rng.choices(pool, k=rng.randrange(1, 60))) for _ in range(200)]
    assert base(scan(spark, texts)) == {i: plain(t) for i, t in enumerate(texts)}


def test_driver_documents(spark):
    docs = table(spark, SF, "documents")
    assert base(license_scans.scanned(docs)) == {r.doc_id: plain(r.text) for r in docs.collect()}


def test_signatures_and_priority(spark):
    cases = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Creative Commons Attribution-ShareAlike 3.0 Unported": "cc-by-sa-3.0",
        "cc by": "cc-by",
        "under the GNU General Public License, version 3.": "gpl,gpl-3",
        "GNU Lesser General Public License v2.1 or later": "gpl,lgpl-2.1-or-later",
        "GPL-3.0-or-later": "gpl-3-or-later",
        "the Apache License, Version 2.0": "apache-2.0",
        "MIT License. All rights reserved.": "mit,reserved",
        "Mozilla Public License": "mpl",
        "3-clause BSD license": "bsd-3-clause",
        "Apache and rights and license, reserved": "",
        "no such thing here": "",
    }
    rows = {r.doc_id: r for r in scan(spark, list(cases)).collect()}
    assert {t: rows[i].labels for i, t in enumerate(cases)} == cases
    for r in rows.values():
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_gate_holds_a_stem_of_every_signature(spark):
    """No signature can match a text that the gate turns away."""
    for label, keyword, signature, weight in license_scans.rules():
        assert any(stem in keyword or stem in signature for stem in license_scans.GATE), (label, keyword)
        assert 0 < weight < 1
    assert not any(" " in stem for stem in license_scans.GATE)
    assert all(any(stem in phrase for stem in license_scans.GATE) for phrase in license_scans.BASE)
    assert len(license_scans.rules()) > 200


def test_long_text_empty_table_and_repeats(spark):
    long = "cc by and all rights reserved; " * 20_000
    r = scan(spark, [long, long, None]).collect()
    assert [x.n_base for x in r] == [40_000, 40_000, 0] and r[0].labels == "cc-by,reserved"
    assert scan(spark, ["x"]).filter("doc_id < 0").collect() == []


def test_native(spark):
    plan = license_scans.scanned(table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def variants(signature):
    """Texts of every choice that a signature leaves; repeats none, once and twice."""

    def of(parsed):
        made = [""]
        for op, value in parsed:
            name = str(op)
            if name == "LITERAL":
                ways = [chr(value)]
            elif name == "IN":
                ways = [chr(v) if str(o) == "LITERAL" else {"CATEGORY_DIGIT": "7", "CATEGORY_NOT_SPACE": "x"}[str(v)] for o, v in value]
            elif name == "BRANCH":
                ways = [w for branch in value[1] for w in of(branch)]
            elif name == "SUBPATTERN":
                ways = of(value[3])
            else:
                low, high, body = value
                assert name == "MAX_REPEAT", name
                once = of(body)
                ways = [w * n for n in range(low, min(int(high), low + 2) + 1) for w in once]
            made = [a + w for a in made for w in ways]
        return made

    return sorted(set(of(re._parser.parse(signature))))


def test_keywords_stand_in_every_variant():
    for label, keyword, signature, _ in license_scans.rules():
        for text in variants(signature):
            assert re.fullmatch(signature, text) and keyword in f" {text} ", (label, keyword, text)
            assert any(stem in text for stem in license_scans.GATE), (label, text)


def test_labels_without_the_prefilter_are_the_same(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["All rights are reserved.", "All rights hereby reserved", "not without prior written permission", "Open-RAIL-M"]
    texts += ["without written permission", "Unauthorised copying is prohibited"]
    for _, _, signature, _ in license_scans.rules():
        every = variants(signature)
        texts += [f"x {t.replace(' ', rng.choice([' ', '-']))}." for t in rng.sample(every, min(4, len(every)))]
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in scan(spark, texts).collect()}
    bare = tuple((label, " ", signature, weight) for label, _, signature, weight in license_scans.rules())
    monkeypatch.setattr(license_scans, "rules", lambda: bare)
    monkeypatch.setattr(license_scans, "GATE", ("",))
    assert {r.doc_id: (r.labels, round(r.score, 9)) for r in scan(spark, texts).collect()} == got
    assert all(labels for labels, _ in got.values())
    assert [got[i][0] for i in range(4)] == ["reserved", "reserved", "proprietary", "openrail"]


def brute(text):
    """Labels and chance of error: every interval against every other."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
    norm = f" {' '.join(words)} "
    rules = license_scans.rules()
    found = [
        (k, m.start(), m.end()) for k, (_, _, x, _) in enumerate(rules) for m in re.finditer(f"(?<= )(?:{x})(?= )", norm)
    ]
    stay = {k for k, s, e in found if not any(j < k and a <= s and e <= b for j, a, b in found)}
    labels = {rules[k][0] for k in stay} | set(filter(None, plain(text)[4].split(",")))
    score = 1 - math.prod(1 - rules[k][3] for k in sorted(stay)) if stay else 0.0
    return ",".join(sorted(labels)), score


def mixed_texts(n, seed):
    """Variants of signatures side by side, sharing words, within one another and cut short."""
    rng = random.Random(seed)
    every = [variants(signature) for _, _, signature, _ in license_scans.rules()]
    pool = [t for ways in every for t in rng.sample(ways, min(3, len(ways)))]
    texts = []
    for _ in range(n):
        words = []
        for part in rng.choices(pool, k=rng.randrange(1, 6)):
            part = part.split()
            shared = next((k for k in range(len(part), 0, -1) if words[-k:] == part[:k]), 0)
            words += part[shared:] if rng.random() < 0.8 else part[: rng.randrange(len(part) + 1)]
            words += rng.choice([[], [], ["x"], ["license"], ["the", "gpl"]])
        texts.append(" ".join(words))
    return texts


def test_intervals_against_all_pairs(spark):
    cases = {
        "released into the public domain dedication and license": "pddl,public-domain",
        "without prior written permission is hereby granted free of charge to any person obtaining a copy": "mit,proprietary",
        "cc by nc 4 0 and cc by": "cc-by,cc-by-nc-4.0",
        "gpl 3 or later": "gpl-3-or-later",
    }
    texts = [*cases, None, "", *mixed_texts(400, 11)]
    rows = {r.doc_id: (r.labels, r.score) for r in scan(spark, texts).collect()}
    assert [rows[i][0] for i in range(len(cases))] == list(cases.values())
    assert rows == {i: brute(t) for i, t in enumerate(texts)}


def test_places_over_many_runs(spark, monkeypatch):
    """Sums made in several runs are those made in one."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["gpl", "gpl 3", "x", "mit license", "cc by 4 0", "released into the public domain"], k=200)) for _ in range(20)]
    whole = scan(spark, texts).collect()
    monkeypatch.setattr(license_scans, "RUN", 3)
    assert scan(spark, texts).collect() == whole
    assert {r.doc_id: (r.labels, r.score) for r in whole} == {i: brute(t) for i, t in enumerate(texts)}
    numbers = spark.range(1).select(license_scans.running(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda x: x.cast("long"))).alias("s"))
    assert numbers.first().s == [k * (k + 1) // 2 for k in range(1, 51)]
