"""Orders of the whole set, progress by parts, token lengths, vectors, stopping, the chat client: hand-computed cases and plain versions."""

import hashlib
import http.server
import json
import math
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from crossweave.operators import lengths, metrics, ordering, scorer, vectors
from crossweave.plans import pipeline
from crossweave.sources import readers, sinks
from crossweave.streaming import resume


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_are_those_of_a_whole_sort(spark):
    rng = random.Random(1)
    rows = [(str(i), rng.randint(0, 3)) for i in range(3000)] + [("same", k) for k in range(5)]
    df = spark.createDataFrame(rows, "pid string, tie int").repartition(5)
    got = ordering.shuffled(df, "7", ["pid"], ["tie"])
    want = sorted(rows, key=lambda r: (hashlib.md5(f"7-{r[0]}".encode()).hexdigest(), r[1]))
    assert [(r.pid, r.tie) for r in got.orderBy("position").collect()] == want
    assert [r.position for r in got.orderBy("position").collect()] == list(range(len(rows)))
    under = [x.split("Exchange", 1)[1].split("\n")[0] for x in plan_of(got).split("Window [")[1:]]
    assert under
    assert not [x for x in under if "SinglePartition" in x]  # no window gathers all rows in one task
    assert ordering.shuffled(df.filter("false"), "7", ["pid"], ["tie"]).collect() == []


def test_positions_within_groups(spark):
    rows = [(g, str(i)) for g in range(3) for i in range(50 * g + 1)]
    df = spark.createDataFrame(rows, "epoch int, pid string").repartition(3)
    got = ordering.positions(df, ordering.key_of(F.lit(4) + F.col("epoch"), "pid"), ["pid"], within=["epoch"]).collect()
    for g in range(3):
        mine = sorted(((hashlib.md5(f"{4 + g}-{p}".encode()).hexdigest(), p) for e, p in rows if e == g))
        assert [(r.position, r.pid) for r in sorted(got, key=lambda r: r.position) if r.epoch == g] == [(i, p) for i, (_, p) in enumerate(mine)]


def test_steps_are_capped_by_epoch(spark):
    df = spark.createDataFrame([(e, f"b{i}") for e in range(2) for i in range(20)], "epoch int, b string")
    got = ordering.steps(df, 42, ["b"], 4, 3).collect()
    assert sorted((r.epoch, r.step) for r in got) == [(e, s) for e in range(2) for s in range(3) for _ in range(4)]
    assert {r.b for r in got if r.epoch == 0} != {r.b for r in got if r.epoch == 1}
    assert ordering.steps(df, 42, ["b"], 4).count() == 40


def test_copies_stand_among_the_others(spark):
    """Every copy is dealt with its profile, not in a batch of copies alone."""
    rows = [("a", f"p{i}", i, 1, 0.95) for i in range(12)] + [("a", f"n{i}", 20 + i, 0, 0.1) for i in range(4)]
    t = spark.createDataFrame(rows, "aid1 string, pid string, ord long, label int, soft_label double")
    got = pipeline.examples(t).collect()
    assert len(got) == 24
    by = {}
    for r in got:
        by.setdefault(r.batch_id, set()).add(r.label)
    assert all(v == {0, 1} for v in by.values())
    assert len(by) == 3


def requests(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("request_id"), F.concat(F.lit("Targets: "), F.col("id").cast("string")).alias("prompt"))


def test_a_part_reads_its_own_rows(spark, tmp_path):
    at, seen = str(tmp_path / "done"), []

    def score(df):
        files = df.inputFiles()
        seen.append((df.count(), {p.split("part=")[1].split("/")[0] for p in files}))
        if len(seen) == 3:
            raise RuntimeError("lost")
        return scorer.call(df)

    todo = requests(spark, 60)
    with pytest.raises(RuntimeError):
        resume.run_pending(todo, at, score, every=10)
    assert resume.parts_of(spark, at) == 6
    saved = resume.completed(spark, at).count()
    assert 0 < saved == seen[0][0] + seen[1][0] < 60
    done = resume.run_pending(todo, at, score, every=1000)  # the parts stay as they are
    assert resume.parts_of(spark, at) == 6
    assert done.count() == 60 == done.select("request_id").distinct().count()
    assert sum(n for n, _ in seen) - seen[2][0] == 60
    assert all(len(parts) == 1 for _, parts in seen)
    assert [p for _, p in seen[:2]] == [{"0"}, {"1"}]
    before = len(seen)
    assert resume.run_pending(todo, at, score).count() == 60
    assert len(seen) == before  # nothing is left to do


def test_new_requests_and_saved_replies(spark, tmp_path):
    at = str(tmp_path / "done")
    resume.save(scorer.call(requests(spark, 10)).withColumn("content", F.lit("kept")), at, 4)
    with pytest.raises(ValueError, match="parts"):
        resume.save(scorer.call(requests(spark, 10)), at, 5)
    done = {r.request_id: r.content for r in resume.run_pending(requests(spark, 25), at, scorer.call).collect()}
    assert len(done) == 25
    assert sum(v == "kept" for v in done.values()) == 10
    assert resume.run_pending(requests(spark, 0), str(tmp_path / "none"), scorer.call).count() == 0


def test_the_last_of_several_replies(spark):
    todo = spark.createDataFrame([("a", "b", ["p", "q"]), ("a", "b", ["r"])], "aid1 string, aid2 string, pids array<string>")
    done = spark.createDataFrame([("a", "b", ["q", "p"], "late", 2), ("a", "b", ["p", "q"], "early", 1)], "aid1 string, aid2 string, pids array<string>, content string, ord int")
    assert [r.content for r in scorer.with_replies(todo, done, order="ord").orderBy(F.size("pids")).collect()] == [None, "late"]


def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.json"))


def library(pieces):
    """Tokens of a byte-level tokenizer, as text, for ASCII pieces."""
    return [[t.replace("Ġ", " ").replace("Ċ", "\n") for t in e.tokens] for e in bpe().encode_batch(pieces, add_special_tokens=False)]


BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def test_lengths_are_those_of_the_whole_text(spark):
    texts = ["The quick brown foxes, undoubtedly; jumped over 12345 lazy dogs!", "", None, "a  b\n\n c", "unbelievable " * 50, "it's they'll"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    t = bpe()
    want = {i: len(t.encode(x or "").ids) for i, x in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in lengths.token_lengths(df, ["doc_id"], cutter=library, library=True, pattern=BYTE_LEVEL).collect()} == want
    for n in (0, 1, 7, 1000):
        got = {r.doc_id: (r.text, r.n_tokens) for r in lengths.first_tokens(df, ["doc_id"], n, cutter=library, library=True, pattern=BYTE_LEVEL).collect()}
        assert got == {i: (t.decode(t.encode(x or "").ids[:n]), min(n, want[i])) for i, x in enumerate(texts)}


def test_a_piece_of_all_texts_is_dealt_to_many_keys(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("the the the").alias("text"))
    assert {r.n_tokens for r in lengths.token_lengths(df, ["doc_id"]).collect()} == {3}
    parts = df.select(lengths._part(["doc_id"], 32).alias("p")).distinct().count()
    assert parts == 32


def test_vectors(spark):
    df = spark.createDataFrame([(0, "x", [1.0, 2.0]), (1, "x", [3.0, 6.0]), (2, "y", [0.0, 1.0])], "id int, k string, embedding array<float>")
    head = spark.createDataFrame([(1, [0.0, 1.0]), (0, [1.0, 0.0])], "row int, embedding array<float>")
    assert [(r.no, r.yes) for r in vectors.projected(df, head, ["no", "yes"]).orderBy("id").collect()] == [(1.0, 2.0), (3.0, 6.0), (0.0, 1.0)]
    means = vectors.mean_vectors(df, ["k"])
    assert {r.k: r.embedding for r in means.collect()} == {"x": [2.0, 4.0], "y": [0.0, 1.0]}
    assert "collect_list" not in plan_of(means)
    assert "partial_avg" in plan_of(means)
    new = vectors.with_new_rows(df, spark.createDataFrame([(9, "new")], "id int, k string")).filter("id = 9").first()
    assert [round(x, 6) for x in new.embedding] == [round(4 / 3, 6), 3.0]


def test_scores_at_label_places(spark):
    df = spark.createDataFrame([([7, 1, 7, 7], [0.0, 1.0, 2.0, 3.0], [0.0, 2.0, 2.0, 9.0]), ([1, 2], [0.0, 0.0], [1.0, 1.0])], "ids array<int>, no array<double>, yes array<double>")
    got = [[(s.place, s.p and round(s.p, 6)) for s in r.s] for r in df.select(vectors.label_scores(F.col("ids"), F.col("no"), F.col("yes"), 7).alias("s")).collect()]
    assert got == [[(0, None), (2, round(1 / (1 + math.exp(-1)), 6)), (3, 0.5)], []]
    wide = spark.createDataFrame([([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]],)], "l array<array<double>>")
    assert wide.select(vectors.id_logits(F.col("l"), 2)).first()[0] == [3.0, 6.0]


@pytest.mark.parametrize(("values", "best", "stop"), [([1, 2, 2, 1, 2, 9], 1, 4), ([3, 2, 1], 0, None), ([1, 2, 3, 4], 3, None), ([1, None, 1, 1, 1], 0, 4), ([5], 0, None)])
def test_stopping(spark, values, best, stop):
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, step int, metric int")
    rows = metrics.stopping(log, ["run"], "step", "metric").orderBy("step").collect()
    assert [r.step for r in rows if r.is_best] == [best]
    assert [r.step for r in rows if r.stopped] == ([] if stop is None else [stop])
    assert rows[-1].step == (len(values) - 1 if stop is None else stop)


def test_names_and_sources_of_paths(spark):
    paths = ["a/name_aid_to_pids_in.json", "/x/name_aid_to_pids_out.v1.json/"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [tuple(r) for r in df.select(readers.sources_of(F.col("p")), sinks.save_names(F.col("p"))).collect()] == [(readers.source_of(p), sinks.save_name(p)) for p in paths]
    with pytest.raises(Exception, match="no source named"):
        spark.range(1).select(readers.sources_of(F.lit("pids.json"))).collect()


class Service(http.server.BaseHTTPRequestHandler):
    asked: list[dict] = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append({"path": self.path, "key": self.headers["Authorization"], **body})
        prompt = body["messages"][-1]["content"]
        if prompt == "fail":
            self.send_error(500)
            return
        data = json.dumps({"choices": [{"message": {"content": '{"0": 0.5}', "reasoning_content": "hm" if prompt == "think" else None}}]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


def test_chat_client(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = scorer.ChatClient(f"http://127.0.0.1:{server.server_port}/v1/", "judge-1")
        df = spark.createDataFrame([("1", "think"), ("2", "plain"), ("3", "fail")], "request_id string, prompt string").coalesce(1)
        got = {r.request_id: (r.content, r.reasoning, r.attempts) for r in scorer.call(df, client, "sys").collect()}
    finally:
        server.shutdown()
    assert got == {"1": ('{"0": 0.5}', "hm", 1), "2": ('{"0": 0.5}', "", 1), "3": ("", "", 3)}
    asked = next(x for x in Service.asked if x["messages"][-1]["content"] == "plain")
    sent = json.loads(spark.range(1).select(scorer.payload("judge-1", F.lit("plain"), "sys")).first()[0])
    assert {k: asked[k] for k in sent} == sent
    assert asked["path"] == "/v1/chat/completions"
    assert sum(x["messages"][-1]["content"] == "fail" for x in Service.asked) == 3
