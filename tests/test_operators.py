"""Hand-computed cases of the operators, and properties."""

import json
import random

import pytest
from pyspark.sql import functions as F

from crossweave.config import EngineConfig
from crossweave.functions import replies, text
from crossweave.operators import batching, labels, metrics, objective, profiles, refine, render, scorer
from crossweave.plans import pipeline
from crossweave.sources import readers, sinks
from crossweave.streaming import resume


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def order(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.batch_id, {})[r.pos] = int(r.pid)
    return [[b[i] for i in range(len(b))] for _, b in sorted(out.items())]


def test_keys_and_confidence(spark):
    df = spark.createDataFrame([("ab-1-2", "a", None, 0.9), ("p7", "a", "b", None)], "pid string, aid1 string, aid2 string, pred double")
    assert [tuple(r) for r in df.select(profiles.paper_id(), profiles.pair_key(), F.round(profiles.confidence(), 6)).collect()] == [("ab", "a-None", 0.4), ("p7", "a-b", 0.0)]


def test_overlap_and_fallback(spark):
    a = spark.createDataFrame([("x", p) for p in "abc"], "aid string, pid string")
    b = spark.createDataFrame([("x", p) for p in "bcde"], "aid string, pid string")
    r = profiles.overlap(a, b).first()
    assert (r.low, round(r.high, 6)) == (0.5, 0.666667)
    raw = spark.createDataFrame([("a1", 1), ("a1", 2), ("a2", 3)], "aid string, pid int")
    assert sorted(map(tuple, profiles.with_fallback(raw.filter("pid = 1"), raw).collect())) == [("a1", 1), ("a2", 3)]
    with pytest.raises(Exception, match="unknown paper"):
        profiles.assert_known(a, b).collect()


@pytest.mark.parametrize(("n", "turns", "want"), [(7, 3, [[0, 6, 5], [1, 4], [2, 3]]), (5, 5, [[0, 4, 1, 3, 2]])])
def test_snake(spark, n, turns, want):
    df = spark.createDataFrame([("a", str(i), 1 - i / 100, i) for i in range(n)], "aid string, pid string, pred double, ord int")
    assert order(batching.snake(df, ["aid"], turns)) == want


def test_snake_is_a_permutation(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(str(n), str(i), rnd.random(), i) for n in range(1, 60) for i in range(n)], "aid string, pid string, pred double, ord int")
    for turns in (1, 2, 4, 10):
        got = batching.snake(df, ["aid"], turns).groupBy("aid", "batch_id").agg(F.array_sort(F.collect_list("pos")).alias("p"), F.count("*").alias("n")).collect()
        assert all(r.p == list(range(r.n)) and r.n <= turns for r in got) and sum(r.n for r in got) == df.count()


def test_budget_batches_dedupe(spark):
    df = spark.createDataFrame([("a", i, n, p) for i, (n, p) in enumerate(zip((3, 4, 5), ("p1", "p2", "p1"), strict=True))], "aid string, ord int, length int, pid string")
    kept = lambda b: batching.within_budget(df, ["aid"], "length", F.lit(b), [F.col("ord")]).count()
    assert [kept(6), kept(0), kept(100)] == [2, 0, 3]
    assert [r.pid for r in batching.dedupe_first(df, ["aid", "pid"]).orderBy("ord").collect()] == ["p1", "p2"]
    seven = spark.range(7).select(F.lit("a").alias("aid"), F.col("id").alias("ord"))
    assert sorted(r["count"] for r in batching.fixed(seven, ["aid"], 3, [F.col("ord")]).groupBy("batch_id").count().collect()) == [1, 3, 3]
    assert [[one(spark, batching.turns_at(F.lit(e), 10, s)) for e in range(4)] for s in ("exponential", "linear")] == [[1, 4, 10, 10], [1, 2, 3, 4]]
    with pytest.raises(ValueError, match="strategy"):
        batching.build_turns(df, ["aid"], 3, "other", "1", True)


def test_caps(spark):
    items = F.sequence(F.lit(0), F.lit(11))
    assert one(spark, text.head_tail(items)) == [*range(8), 10, 11]
    assert one(spark, text.head_tail(F.slice(items, 1, 10))) == list(range(10))
    assert one(spark, text.canonical(F.array(F.lit("b"), F.lit("a")))) == "a-b"


def test_labels(spark):
    df = spark.createDataFrame([(0.95, 1), (0.9, 1), (0.89, 1), (0.1, 0)], "soft_label double, label int")
    assert [r.label for r in labels.threshold(df).collect()] == [1, 1, 0, 0]
    up = lambda p, q: labels.upsample(spark.createDataFrame([(1,)] * p + [(0,)] * q, "label int")).groupBy("label").count().collect()
    assert sorted(map(tuple, up(5, 2))) == [(0, 4), (1, 5)] and sorted(map(tuple, up(1, 2))) == [(0, 2), (1, 1)] and sorted(map(tuple, up(2, 0))) == [(1, 2)]


def test_minmax(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", 6.0), ("b", 3.0), ("b", 3.0)], "k string, v double")
    assert [r.scaled for r in metrics.minmax(df, "v", ["k"]).orderBy("k", "v").collect()] == [0, 0.5, 1, 0.5, 0.5]


def brute(labels_, preds):
    y, s = [1 - x for x in labels_], [1 - p for p in preds]
    pairs = [(a, b) for a, ya in zip(s, y, strict=True) for b, yb in zip(s, y, strict=True) if ya and not yb]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    ap, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        got = [yy for ss, yy in zip(s, y, strict=True) if ss >= t]
        ap += (sum(got) / sum(y) - before) * sum(got) / len(got)
        before = sum(got) / sum(y)
    return auc, ap


def test_author_metrics(spark):
    rnd, cases = random.Random(6), {"a": ([1, 1, 0], [0.9, 0.4, 0.6]), "b": ([1, 0], [0.5, 0.5]), "all": ([1, 1, 1], [0.1, 0.2, 0.3]), "few": ([1, 0, 0], [0.5, 0.1, 0.2])}
    for k in range(20):
        n = rnd.randint(4, 40)
        cases[f"r{k}"] = ([1] * (n - 2) + [0, 0], [rnd.randint(0, 9) / 10 for _ in range(n)])
    df = spark.createDataFrame([(k, x, p) for k, (ls, ps) in cases.items() for x, p in zip(ls, ps, strict=True)], "aid1 string, label int, pred double")
    got = {r.aid: (r.auc, r.ap) for r in metrics.author_metrics(df).collect()}
    assert set(got) == set(cases) - {"all", "few"} and got["a"] == pytest.approx((0.5, 0.5))
    for k, v in got.items():
        assert v == pytest.approx(brute(*cases[k]))
    r = metrics.macro(metrics.author_metrics(df.filter("aid1 in ('a', 'b')"))).first()
    assert (r.MAP, r.AUC, r.AUC_MAP, r.n_authors) == pytest.approx((0.5, 0.5, 1.0, 2))
    assert metrics.macro(metrics.author_metrics(df.limit(0))).first().MAP is None


def test_objective(spark):
    v = lambda *x: [F.lit(float(i)) for i in x]
    p, o, s = v(0.9, 0.8, 0.9)
    assert one(spark, objective.soft_logic(p, o, s)) == pytest.approx(-0.2)
    p, o, s = v(0.4, 0.3, 0.2)
    assert one(spark, objective.soft_logic(p, o, s)) == pytest.approx(-0.1)
    assert one(spark, objective.p_yes(*v(0, 0))) == 0.5
    df = spark.createDataFrame([(0.5, 1, None, None)], "p double, label int, p_out double, sim double")
    r = objective.loss(df, "psl").first()
    assert r.loss == r.ce and r.psl is None


@pytest.mark.parametrize(("content", "want"), [
    ('{"0":0.2}', {"0": "0.2"}), ('Result: {"0":0.2} done', {"0": "0.2"}), ('```json\n{"0":0.2}\n```', {"0": "0.2"}), ('{\n "0": 0.2,\n "1": 1\n}', {"0": "0.2", "1": "1"}),
    ("{'0':0.2}", {"0": "0.2"}), ('{"0":0.2,}', {"0": "0.2"}), ('{"0":0.1} {"1":0.2}', {"1": "0.2"}), ("no json", {}), ('<think>{"9":1}</think>{"0":1}', {"0": "1"}), (None, {}), ("", {})])
def test_replies(spark, content, want):
    assert one(spark, replies.scores(F.lit(content).cast("string"))) == want


def test_scores_of_replies(spark):
    m = replies.scores(F.lit('{"10": 3, "2": 2, "0": "1"}'))
    assert one(spark, replies.in_order(m)) == [1, 2, 3]
    assert one(spark, replies.for_items(F.array(F.lit(0.1), F.lit(0.2)), F.lit(3))) == [0.5] * 3
    df = spark.createDataFrame([(0, 0.4), (1, 0.6)], "pos int, old_pred double").withColumn("new_pred", refine.merged(replies.scores(F.lit('{"0":0.9, "1": "x"}')), F.col("pos"), F.col("old_pred")))
    assert [r.new_pred for r in df.orderBy("pos").collect()] == [0.9, 0.6]
    r = refine.change_stats(df).first()
    assert (r.mean_change, r.max_change) == pytest.approx((0.25, 0.5))
    assert one(spark, replies.any_json(F.lit("[1, 2]"))) == "[1, 2]" and one(spark, replies.any_json(F.lit("x"))) is None


def test_render_sorts_authors_and_caps(spark):
    authors = [(f"n{i}", "w " * 12 + str(i % 2), None, None, 20 - i) for i in range(12)]
    df = spark.createDataFrame([("p", "T", authors, None, None, None), ("q", None, None, "V", 1999, ["k"])], "pid string, title string, authors array<struct<name:string,org:string,OriginalAuthor:string,OriginalAffiliation:string,AuthorSequenceNumber:int>>, venue string, year int, keywords array<string>")
    got = {r.pid: r.text for r in render.rendered(df).collect()}
    assert "Authors: n11, n10, n9, n8, n7, n6, n5, n4, n1, n0\n" in got["p"] and "Organizations: " + " ".join(["w"] * 10) + "\n" in got["p"]
    assert got["q"] == "Title: None\nAuthors: \nOrganizations: \nVenue: V\nYear: 1999\nKeywords: k\n"
    assert "Year: 1999Keywords" in render.rendered(df.filter("pid = 'q'"), style=render.Style("distill")).first().text


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("json")
    flat = {"a1": ["p1", "p2-0", "p3"], "a2": ["p3"]}
    put = lambda n, x: (d / n).write_text(json.dumps(x)) and str(d / n)
    papers = {p: {"title": f"T{p}", "authors": [{"name": "N", "org": "O"}], "year": 2000} for p in ("p1", "p2", "p3", "p4")}
    triples = [{"name": "x", "aid1": 1, "aid2": "b1", "pid": p, "label": i % 2, "similarity": 0.5, "soft_label": 0.95} for i, p in enumerate(["p1", "p4", "p1", "p2-0"])]
    return {"flat": put("flat.json", flat), "named": put("named.json", {"x": {"1": ["p3"], "b1": ["p1", "p4"]}}), "papers": put("papers.json", papers), "triples": put("t.json", triples), "prior": put("s.json", [{"pid": "p1", "pred": 0.1}, {"pid": "p1", "pred": 0.7}])}


def test_readers(spark, files):
    assert [tuple(r)[3:] for r in readers.profiles(spark, files["flat"], "in").filter("aid = 'a1'").orderBy("ord").collect()] == [("a1", 0, "p1"), ("a1", 1, "p2-0"), ("a1", 2, "p3")]
    assert {(r.name, r.aid, r.pid) for r in readers.profiles(spark, files["named"], "out").collect()} == {("x", "1", "p3"), ("x", "b1", "p1"), ("x", "b1", "p4")}
    assert readers.papers(spark, files["papers"]).count() == 4
    t = readers.triples_for(spark, "test", {"test": files["triples"]})
    assert [(r.ord, r.aid1, r.pid) for r in t.orderBy("ord").collect()] == [(0, "1", "p1"), (1, "1", "p4"), (2, "1", "p1"), (3, "1", "p2-0")]
    assert [tuple(r) for r in readers.prior_scores(spark, files["prior"]).collect()] == [("p1", 0.7)]


def test_sinks(spark, tmp_path):
    df, at = spark.range(2), str(tmp_path / "v")
    assert [sinks.dump_version(df, at), sinks.dump_version(df, at)] == [0, 1] and sinks.versions(spark, at) == [0, 1]
    sinks.log_metrics(df, f"{at}-log", "eval")
    sinks.log_metrics(df, f"{at}-log", "test")
    assert spark.read.json(f"{at}-log").count() == 2
    sinks.remove(spark, at)
    assert sinks.versions(spark, at) == []


def flaky(prompt, system):
    import zlib

    if zlib.crc32(prompt.encode()) % 3 == 0:
        raise RuntimeError("no answer")
    return f"<think>hm</think>{scorer.stub(prompt)}"


def second(prompt, system):
    return '{"batch_0": {"0": 0.25}}'


def test_distillation(spark, files):
    triples, papers = readers.triples(spark, files["triples"]), readers.papers(spark, files["papers"])
    profile = readers.profiles(spark, files["named"], "in")
    todo = pipeline.requests(triples, profile.filter("aid = '1'"), profile.filter("aid = 'b1'"), papers)
    r = todo.first()
    assert todo.count() == 1 and sorted(r.pids) == ["p1", "p2-0", "p4"] and r.author_sim == 0.5 and "External profile: Title: Tp" in r.prompt
    rows = pipeline.distill(todo, second=second).collect()
    assert len(rows) == 3 and sum(x.new_pred == 0.25 for x in rows) >= 1 and all(x.new_pred == x.old_pred for x in rows if x.new_pred != 0.25)
    soft = labels.soft_labels(triples, pipeline.distill(todo, second=second))
    assert soft.count() == 4
    done = scorer.call(todo.select("request_id", "prompt").union(spark.range(30).select(F.col("id").cast("string"), F.col("id").cast("string"))), flaky)
    assert done.count() == 31
    empty, full = scorer.unfinished(done)
    assert empty.count() and full.count() and full.first().reasoning == "hm"


def test_examples_and_evaluation(spark, files):
    triples = readers.triples(spark, files["triples"])
    train = pipeline.examples(triples, config=EngineConfig(num_turn=2))
    assert train.count() == 4 and {r.label for r in train.collect()} == {1}
    test = pipeline.examples(triples, readers.prior_scores(spark, files["prior"]), "test", EngineConfig(batching="confidence", num_turn=3))
    assert {r.pred for r in test.collect()} == {0.7, 0.5} and test.select("batch_id").distinct().count() == 2
    assert pipeline.evaluate(test).first().n_authors == 1


def test_resume_goes_on_where_it_was(spark, tmp_path):
    todo = spark.range(40).select(F.col("id").cast("string").alias("request_id"), F.concat(F.lit("Targets: "), F.col("id").cast("string")).alias("prompt"))
    at, calls = str(tmp_path / "done"), []

    def score(df):
        calls.append(df.count())
        if len(calls) == 3:
            raise RuntimeError("lost")
        return scorer.call(df)

    with pytest.raises(RuntimeError):
        resume.run_pending(todo, at, score, every=10)
    part = resume.completed(spark, at).count()
    assert 0 < part < 40
    done = resume.run_pending(todo, at, score, every=10)
    assert done.count() == 40 == done.select("request_id").distinct().count() and sum(calls) - calls[2] == 40
    whole = {r.request_id: r.content for r in scorer.call(todo).collect()}
    assert whole == {r.request_id: r.content for r in done.collect()}


def test_stream_scores_new_files_once(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    todo = spark.range(10).select(F.col("id").cast("string").alias("request_id"), F.lit("Targets: a; b").alias("prompt"))
    for _ in range(2):
        todo.write.mode("append").parquet(src)
        resume.stream_pending(spark, src, "request_id string, prompt string", out, check, scorer.call)
        assert resume.completed(spark, out).count() == 10


def test_json_lines_are_read_as_rows(spark, tmp_path):
    at = tmp_path / "name_aid_to_pids_in.jsonl"
    at.write_text("\n".join(json.dumps(x) for x in ({"b": {"1": ["p", "q"]}}, {"a": {"2": ["r"]}})))
    rows = readers.named_profiles(spark, str(at), lines=True).collect()
    assert sorted((r.name, r.source, r.aid, r.ord, r.pid) for r in rows) == [("a", "in", "2", 0, "r"), ("b", "in", "1", 0, "p"), ("b", "in", "1", 1, "q")]
    for path in ("pids.json", "name_aid_to_pids_in_and_name_aid_to_pids_out"):
        with pytest.raises(ValueError):
            readers.source_of(path)


def test_last_name_in_the_file_wins(spark):
    texts = spark.createDataFrame([('{"z": {"1": ["p"], "2": ["q"]}, "a": {"1": ["r"]}}',)], "value string")
    rows = profiles.flatten_names(readers.parse_named(texts, "in")).collect()
    assert sorted((r.name, r.aid, r.pid) for r in rows) == [("a", "1", "r"), ("z", "2", "q")]


def test_places_go_on_from_part_to_part(spark):
    part = lambda p: spark.createDataFrame([(1, p, 0), (2, p, 1)], "aid1 int, pid string, ord long")
    both = readers.union_triples(part("x"), part("y"))
    assert [r.pid for r in batching.dedupe_first(both, ["aid1"]).collect()] == ["x", "x"]


def test_targets_of_profiles_that_are_not_there(spark):
    lists = spark.createDataFrame([("n", "1", 0, "p")], "name string, aid string, ord int, pid string")
    wanted = spark.createDataFrame([("n", "1"), ("n", "1")], "name string, aid string")
    assert [tuple(r) for r in profiles.targets_of(wanted, lists).collect()] == [("n", "1", 0, "p")]
    with pytest.raises(Exception, match="unknown profile 2"):
        profiles.targets_of(spark.createDataFrame([("n", "2")], "name string, aid string"), lists).collect()


def test_names_of_outputs():
    assert sinks.save_name("a/b/triples.v1.json") == "triples" and sinks.save_name("/x/plain") == "plain"
