"""Faults that only larger tables show, on small ones that show them too."""

import os
import re

from pyspark.sql import functions as F

from crossweave.operators import lengths, scorer
from crossweave.plans import catalog, pipeline
from crossweave.streaming import resume

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_authors_by_sequence_with_large_ids(spark, tmp_path):
    pids = [271_181, 271_182, 1_199_999, 7_199_999, 2_147_483_647, 5, 1_000_005]
    rows = [(o, 1, p, 7, "O") for o, p in enumerate(pids)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = ", ".join(f"A{p}" for p in sorted(pids, key=lambda p: p * 7919 % 1000))
    assert [tuple(r) for r in catalog.QUERIES["authors_by_sequence"](spark, str(tmp_path)).collect()] == [("7", want)]


def halves(pieces):
    """Each piece in two, as a library would give it."""
    return [[p[: len(p) // 2], p[len(p) // 2 :]] if len(p) > 1 else [p] for p in pieces]


def test_pieces_stay_with_their_text(spark):
    """No piece is shuffled or joined; texts of one key are added up, in a batch of several or of one row."""
    texts = ["one two, 333", "", None, "two two\n", "x", "one"]
    df = spark.createDataFrame([(i % 4, i, t) for i, t in enumerate(texts)], "k int, id int, text string").repartition(1)
    cut = {i: [t for p in halves(["one", " two", ",", " 333"] if i == 0 else ["two", " two", "\n"] if i == 3 else [t] if t else []) for t in p] for i, t in enumerate(texts)}
    for rows in ("1", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            long = lengths.token_lengths(df, ["k"], cutter=halves, library=True)
            assert {r.k: r.n_tokens for r in long.collect()} == {k: sum(len(cut[i]) for i in cut if i % 4 == k) for k in range(4)}
            for n in (0, 3, 99):
                first = lengths.first_tokens(df, ["id"], n, cutter=halves, library=True)
                assert {r.id: (r.text, r.n_tokens) for r in first.collect()} == {i: ("".join(t[:n]), len(t[:n])) for i, t in cut.items()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for plan in map(plan_of, (long, first, lengths.token_lengths(df, ["k"]), lengths.first_tokens(df, ["id"], 3))):
        assert "Join" not in plan
        assert "Generate" not in plan


def test_queries_on_lengths_shuffle_no_pieces(spark):
    """As registered: of a text, its key and a number are shuffled once, and nothing of it where each row has its own first tokens."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    cut = {r.doc_id: [t for p in re.findall(lengths.PIECES, r.text or "") for t in re.findall("(?s).{1,4}", p)] for r in docs}
    long, first = (catalog.QUERIES[n](spark, SF) for n in ("token_lengths", "truncated_texts"))
    assert [plan_of(df).count("Exchange") for df in (long, first)] == [1, 0]
    assert {r.doc_id: r.n_tokens for r in long.collect()} == {i: len(t) for i, t in cut.items()}
    assert {r.doc_id: (r.text, r.n_tokens) for r in first.collect()} == {i: ("".join(t[:33]), len(t[:33])) for i, t in cut.items()}


def test_a_part_is_worked_off_by_many_tasks(spark, tmp_path):
    """Progress of few parts, and then many requests: a part's rows are in a file for each core, and each request is there once."""
    rows = spark.range(2000).select(F.col("id").cast("string").alias("request_id"), F.concat(F.lit("Targets: "), F.col("id").cast("string")).alias("prompt"))
    at, tasks = str(tmp_path / "done"), []
    resume.save(scorer.call(rows.limit(500)), at, 3)

    def score(df):
        tasks.append(df.rdd.getNumPartitions())
        return scorer.call(df)

    done = resume.run_pending(rows, at, score)
    assert len(tasks) == 3
    assert min(tasks) == spark.sparkContext.defaultParallelism
    assert [len([f for f in os.listdir(f"{at}/of=3/part={k}") if f.endswith(".parquet")]) >= 2 * min(tasks) for k in range(3)] == [True] * 3
    assert sorted(r.request_id for r in done.collect()) == sorted(map(str, range(2000)))


def test_replies_need_no_join_to_their_requests(spark):
    """Each request is made and scored once; a pair without an aid2 gets its second scores too."""
    rows = [("a-0", "n", "a", "b", 0, ["p", "q"], 0.5, "Targets: 0: x; 1: y"), ("c-0", None, "c", None, 0, ["r"], 0.5, "Targets: 0: z")]
    todo = spark.createDataFrame(rows, "request_id string, name string, aid1 string, aid2 string, batch_id int, pids array<string>, author_sim double, prompt string")
    out = pipeline.distill(todo, second=scorer.stub_batches)
    plan = plan_of(out)
    assert "Join" not in plan
    assert plan.count("MapInArrow") == 2
    old = {"p": scorer._fixed("0: x"), "q": scorer._fixed("1: y"), "r": scorer._fixed("0: z")}
    new = {p: scorer._fixed(f"{k}: {p} | {old[p]:.2f}") for k, p in ((0, "p"), (1, "q"), (0, "r"))}
    assert {r.pid: (r.name, r.aid2, r.old_pred, r.new_pred) for r in out.collect()} == {p: ("unknown" if p == "r" else "n", None if p == "r" else "b", old[p], new[p]) for p in old}
