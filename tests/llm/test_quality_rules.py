"""op7: the base counts against plain Python, and what the votes decide."""

import math
import random
import re

import pytest

from terralog.llm import quality_rules
from terralog.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, votes string, m int"
PROSE = "The quick brown fox jumps over a lazy dog near the river bank today."


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(inside), failed,
    )


def got(df):
    return {r.doc_id: tuple(r[c] for c in (*quality_rules.BASE, "base_failed")) for r in df.collect()}


def odd_texts():
    rng = random.Random(7)
    return [
        None, "", " \t\n", "one", "a b c d e", "a b c d e f", "a a a a a a a", "é😀 " * 30, "x y z" * 4,
        "a b c d e a b c d e", "a b c d e a b c d f", "line\nline\n \nline", "#|<> &%" * 5, PROSE, PROSE + "\n" + PROSE,
        *(" ".join(rng.choices("ab", k=rng.randrange(40))) for _ in range(60)),
        *("\n".join(" ".join(rng.choices("abcde", k=4)) for _ in range(9)) for _ in range(20)),
    ]


def test_base_counts(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    assert got(quality_rules.judged(docs)) == {i: plain(t) for i, t in enumerate(texts)}


@pytest.mark.filterwarnings("ignore")
def test_driver_documents(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got(quality_rules.judged(docs)) == {i: plain(t) for i, t in texts.items()}


def test_votes_decide(spark):
    prose = [f"{PROSE} Item {i} was seen there by someone else, and nobody minded it much." for i in range(40)]
    symbols = [" ".join(f"word{i}{j}### &&&" for j in range(40)) for i in range(6)]
    shouts = [" ".join(f"LOUD{chr(65 + j)}{chr(65 + i)}!!" for j in range(26)) for i in range(6)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(prose + symbols + shouts)], SCHEMA)
    rows = quality_rules.judged(docs).collect()
    assert {r.doc_id for r in rows if r.kept} == set(range(40))
    assert not any(r.base_failed for r in rows) and all(0 <= r.p_good <= 1 for r in rows)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.filter("doc_id < 40").collect())


@pytest.fixture(scope="module")
def voted(spark):
    """The stored measures and votes of the driver's documents, and their model."""
    df = quality_rules.stored(quality_rules.measured(table(spark, "/root/testdata/sf0.01", "documents"), "doc_id", "text"), "measures")
    return df, quality_rules.learned(df)


def plain_fit(patterns, rounds):
    """The estimation written out over lists of votes and their counts."""
    rules = len(patterns[0][0])
    of = {True: [dict(zip((-1, 0, 1), quality_rules.OF_GOOD)) for _ in range(rules)],
          False: [dict(zip((-1, 0, 1), quality_rules.OF_BAD)) for _ in range(rules)]}
    share, low, high = quality_rules.SHARE, {-1: -3.0, 0: -0.5, 1: 0.1}, {-1: -0.1, 0: 0.5, 1: 3.0}

    def said(k, v):
        return min(high[v], max(low[v], math.log(of[True][k][v] / of[False][k][v])))

    every = sum(n for _, n in patterns)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-math.log(share / (1 - share)) - sum(said(k, v) for k, v in enumerate(vs)))) for vs, _ in patterns]
        mass = {True: [n * x for (_, n), x in zip(patterns, p)], False: [n * (1 - x) for (_, n), x in zip(patterns, p)]}
        share = min(0.98, max(0.5, sum(mass[True]) / every))
        of = {
            side: [
                {
                    v: (sum(m for (vs, _), m in zip(patterns, mass[side]) if vs[k] == v) + 0.02 * every * start)
                    / (sum(mass[side]) + 0.02 * every)
                    for v, start in zip((-1, 0, 1), quality_rules.OF_GOOD if side else quality_rules.OF_BAD)
                }
                for k in range(rules)
            ]
            for side in (True, False)
        }
    return math.log(share / (1 - share)), [[said(k, v) for v in (-1, 0, 1)] for k in range(rules)]


def test_estimation_equals_plain(spark, voted):
    rows = voted[0].groupBy("votes").count().collect()
    prior, rules = plain_fit([(r["votes"], r["count"]) for r in rows], quality_rules.ROUNDS)
    assert voted[1][0] == pytest.approx(prior, abs=1e-9)
    assert [x for w in voted[1][1] for x in w] == pytest.approx([x for w in rules for x in w], abs=1e-9)


def keeps(votes, model):
    return model[0] + sum(w[v + 1] for v, w in zip(votes, model[1], strict=True)) >= 0


def test_no_rule_decides_alone(spark, voted):
    rows = [(tuple(r["votes"]), r["count"]) for r in voted[0].groupBy("votes").count().collect()]
    every = sum(n for _, n in rows)
    for k, name in enumerate(quality_rules.RULES):
        fewer = [((*v[:k], *v[k + 1 :]), n) for v, n in rows]
        model = plain_fit(fewer, quality_rules.ROUNDS)
        changed = sum(n for (v, n), (w, _) in zip(rows, fewer) if keeps(v, voted[1]) != keeps(w, model))
        assert changed < 0.05 * every, name


def test_minorities_are_outvoted_both_ways(spark, voted):
    rules = len(quality_rules.RULES)
    for k in range(rules):
        for one in (-1, 1):  # one rule against all others, whichever it is
            against = [one if i == k else -one for i in range(rules)]
            row = spark.createDataFrame([(20, 0, against)], "n_words long, n_repeat_words long, votes array<int>")
            assert quality_rules.decided(row, voted[1]).first().kept == (one < 0)
    rows = quality_rules.decided(*voted).filter("not base_failed").collect()
    assert any(r.kept and r.votes.count(-1) for r in rows)
    assert any(not r.kept and r.votes.count(1) for r in rows)


def test_agrees_with_labels(spark, voted):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    wrong = quality_rules.decided(*voted).join(labels, "doc_id").filter("not base_failed and kept <> (quality = 1)")
    assert wrong.count() == 0


def test_one_fault_alone_does_not_reject(spark):
    """All-must-pass filtering would; here one vote is weighed against the others."""
    stutter = f"{PROSE} {PROSE.replace('.', ';')} And so it was, as they all said to us later on that day, in the end."
    prose = [(i, f"{PROSE} Item {chr(97 + i)} was seen there, and nobody minded it much.", "x", 1) for i in range(26)]
    row = quality_rules.judged(spark.createDataFrame([*prose, (99, stutter, "x", 1)], SCHEMA)).filter("doc_id = 99").first()
    assert -1 in row.votes and (row.kept or row.base_failed) and row.p_good >= 0.5


def test_very_long_text(spark):
    long = " ".join(f"{PROSE} Then number {i} came by and went on." for i in range(20_000))
    docs = spark.createDataFrame([(i, f"{PROSE} {i}", "x", 1) for i in range(9)] + [(9, long, "x", 1)], SCHEMA)
    assert got(quality_rules.judged(docs))[9] == plain(long)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judged(empty).collect() == [] and quality_rules.keep(empty).collect() == []
    twice = spark.createDataFrame([(1, PROSE, "x", 1)] * 3 + [(None, PROSE, None, None)], SCHEMA)
    assert quality_rules.judged(twice).count() == 4 and quality_rules.keep(twice).count() == 4


def test_native(spark):
    plan = quality_rules.judged(table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
