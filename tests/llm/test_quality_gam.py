"""op1: held-out accuracy, the additive form, the learning rules, odd rows."""

import numpy as np

from terralog.llm import quality_gam
from terralog.llm.common import table

DOCS, LABELS = "doc_id long, text string, key string, y int", "doc_id long, quality int, toxic int, key int"
SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_on_driver_tables(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality_gam.learned(docs, labels)
    rows = quality_gam.scored(docs, model).join(labels, "doc_id").filter("held_out").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert len(bad) > 20
    assert np.mean([r.predicted == 1 for r in good]) > 0.98 and np.mean([r.predicted == 0 for r in bad]) > 0.95
    ranked = np.mean([[g.score > b.score for b in bad] for g in good])
    assert ranked > 0.99
    for r in rows:
        assert r.held_out == quality_gam.is_held_out(r.doc_id) and r.predicted == int(r.score >= 0.3)


def test_held_out_labels_are_never_learned(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1), "k", 1) for i in range(300)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0, 1) for i in range(300)], LABELS)
    x, y = quality_gam.training_rows(docs, labels, "quality")
    used = [i for i in range(300) if not quality_gam.is_held_out(i)]
    assert len(y) == len(used) and x.tolist() == [quality_gam.features(f"text {i} " * (i % 7 + 1)) for i in used]
    assert y.tolist() == [i % 2 for i in used]
    assert len(quality_gam.training_rows(docs, labels, "quality", most=50)[1]) == 50


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)  # nothing but an interaction
    model = quality_gam.fitted(x, y)
    assert np.mean((quality_gam.scores(model, x) > 0.5) == y) > 0.95 and model.pairs[0] == (0, 1)
    bins = quality_gam.binned(x[:1], model.edges)[0]
    by_hand = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
    rough = quality_gam.coarse(bins)
    by_hand += sum(t[rough[a], rough[b]] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
    assert np.isclose(quality_gam.logit_sum(model, x[:1])[0], by_hand)


def test_trees_are_shallow():
    step = quality_gam.tree(np.array([5.0, 5, -3, -3, 9, 9]), np.ones(6))
    assert len(set(step)) == quality_gam.LEAVES
    gain, table_ = quality_gam.quarters(np.outer([1, 1, -1], [1, -1, -1.0]), np.ones((3, 3)))
    assert gain > 0 and len(set(table_.ravel())) <= 4


def test_odd_rows(spark):
    rows = [(1, None, "k", 1), (1, "", "k", None), (None, "some words", None, None), (2, "w " * 50_000, "k", 1), (2, "w", "k", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1, 0, 1), (2, None, 0, 1), (None, 1, 0, 1)], LABELS)
    for use in (labels, labels.filter("doc_id < 0")):
        got = quality_gam.scored(docs, quality_gam.learned(docs, use)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    none = docs.filter("doc_id > 9")
    assert quality_gam.scored(none, quality_gam.learned(none, labels)).collect() == []
