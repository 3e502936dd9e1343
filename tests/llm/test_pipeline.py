"""The pipeline's stages, each against a plain version of what it must do to its input."""

import pytest
from test_decontamination import plain as contaminated
from test_ngram_join import plain as components
from test_quality_rules import plain as base_counts
from test_secret_scans import odd_texts

import corpus_pipeline
from terralog.llm import piece_tokens, quality_rules, secret_scans
from terralog.llm.common import stored, table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_driver_documents(spark):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    docs = table(spark, SF, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_join", "decontamination", "secret_scans", "piece_tokens"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = stored(stage(spark, docs, SF), name)
        rows = {r.doc_id: r for r in after.collect()}
        assert len(rows) == after.count()
        if name != "piece_tokens":
            assert after.columns == COLUMNS and after.dtypes == docs.dtypes
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.judged(docs).collect() if r.kept}
            assert set(rows) == kept and not any(base_counts(before[i].text)[-1] for i in kept)
        elif name == "ngram_join":
            pairs = components([(i, r.text) for i, r in before.items()])
            assert set(rows) == {i for i, n, c in pairs if i == c}
        elif name == "decontamination":
            assert set(rows) == {i for i, r in before.items() if not contaminated(r.text, items)[-1]}
        elif name == "secret_scans":
            assert set(rows) == set(before)
            for i, r in rows.items():
                found = secret_scans.spans(before[i].text)[1]
                assert r.text == secret_scans.masked(before[i].text, found) and r.n_chars == len(r.text)
        else:
            library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=piece_tokens.default_path())
            assert {i: r.ids for i, r in rows.items()} == {
                i: library.encode(r.text, add_bos=True, add_eos=True) for i, r in before.items()
            }
        if name in ("quality_rules", "ngram_join", "decontamination"):
            assert all(rows[i] == before[i] for i in rows)
        docs = after
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(docs.collect())


def test_odd_rows(spark, tmp_path):
    """Nulls everywhere, repeated rows, further columns; and no rows at all."""
    texts = [t for t in odd_texts()[:40]] + ["One plain sentence, of more than ten words, that nobody could mind at all."] * 3
    rows = [(k if k % 5 else None, t, None, "s", len(t) if t else None, "more", k) for k, t in enumerate(texts)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, row int"
    items = spark.createDataFrame([(1, "some other words that are found in no document of this small test at all", 2)], "item_id long, text string, key int")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    for part in (docs, docs.filter("doc_id < 0")):
        for _, stage in corpus_pipeline.STAGES:
            part = stored(stage(spark, part, str(tmp_path)), "odd")
        assert part.count() == (1 if part.limit(1).count() else 0)
