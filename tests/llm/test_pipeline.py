"""The pipeline against a brute-force version of each stage."""

import pytest

import corpus_pipeline as cp
from crossweave.llm import tokens, toxicity
from tests.llm.test_near_texts import brute_kept
from tests.llm.test_texts import brute_decontaminate

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    grammar = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id: r.text for r in docs.collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns
        if k == 0:
            want = {d: t for d, t in want.items() if grammar.score(t.encode()) < toxicity.THRESHOLD}
        elif k == 1:
            last = {t: d for d, t in sorted(want.items())}
            want = {d: t for d, t in want.items() if last[t] == d}
        elif k == 2:
            ids = list(want)
            want = {d: want[d] for d in brute_kept(ids, [want[d] for d in ids])}
        got = {r.doc_id: r.text for r in docs.collect()}
        if k < 3:
            assert got == want, name
        else:
            hit = {r[0] for r in brute_decontaminate(want.items(), items) if r[5]}
            assert hit and {d: t for d, t in got.items() if d not in hit} == {d: t for d, t in want.items() if d not in hit}
            assert not any(r[5] for r in brute_decontaminate(got.items(), items))
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.doc_id in hit)
            want = got
    pieces = cp.packing(spark, docs, SF).collect()
    tokenizer = tokens.word_ids(tokens.default_path()).tokenizer
    for d, t in want.items():
        assert sum(p.n_tokens for p in pieces if p.doc_id == d) == len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert {p.doc_id for p in pieces} == set(want)


def test_run_returns_the_last_stage(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_length"]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_stand_empty_tables(spark, name):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(cp.STAGES)[name](spark, none, SF).count() == 0
