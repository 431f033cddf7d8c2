"""The lifecycles: cleaning of profiles, label distillation, preparation of examples, evaluation with a second pass by confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.config import EngineConfig
from crossweave.functions import replies
from crossweave.operators import batching, labels, metrics, objective, ordering, profiles, refine, render, scorer
from crossweave.sources import sinks


def requests(triples: DataFrame, inner: DataFrame, outer: DataFrame, papers: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Prompts for batches of targets of a pair: sampled profiles of both sources, targets dealt at random.

    Papers are rendered once each; profiles are sampled before the join to their text.
    """
    text = render.rendered(papers)
    first = batching.dedupe_first(triples.withColumn("sim", profiles.similarity()), ["aid1", "aid2", "pid"])
    dealt = batching.random_turns(first, ["aid1", "aid2"], config.distill_sample, config.seed)
    targets = dealt.withColumn("paper", profiles.paper_id()).join(text.withColumnRenamed("pid", "paper"), "paper")
    grouped = targets.groupBy("aid1", "aid2", "batch_id").agg(F.first("name").alias("name"), F.max("sim").alias("author_sim"), F.array_sort(F.collect_list(F.struct("pos", "pid", "text"))).alias("t"))

    def side(assignments: DataFrame, aid: str, out: str) -> DataFrame:
        some = profiles.sample(assignments, config.distill_sample, config.seed).withColumn("paper", profiles.paper_id())
        rows = some.join(text.withColumnRenamed("pid", "paper"), "paper").groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("p"))
        return rows.select(F.col("aid").alias(aid), F.col("p.text").alias(out))

    both = grouped.join(side(inner, "aid1", "inner"), "aid1", "left").join(side(outer, "aid2", "outer"), "aid2", "left")
    none = F.array().cast("array<string>")
    prompt = render.prompt_two_sources(F.coalesce("name", F.lit("unknown")), F.coalesce("inner", none), F.coalesce("outer", none), F.col("author_sim"), F.col("t.text"))
    key = F.concat_ws("-", "aid1", "aid2", "batch_id")
    return both.select(key.alias("request_id"), "name", "aid1", "aid2", "batch_id", F.col("t.pid").alias("pids"), "author_sim", prompt.alias("prompt"))


def distill(requests: DataFrame, score: scorer.Scorer = scorer.stub, second: scorer.Scorer | None = None) -> DataFrame:
    """Replies as scores, batches of a pair refined together: rows name, aid1, aid2, pid, batch_idx, old_pred, new_pred."""
    done = scorer.call(requests, score, keep=["aid1", "aid2", "name", "batch_id", "pids"])
    values = replies.for_items(replies.in_order(replies.scores(F.col("content"))), F.size("pids"))
    grouped = refine.group_batches(done.select("aid1", "aid2", "name", F.col("batch_id").alias("ord"), "pids", values.alias("preds")))
    if second is None:
        return refine.flatten_batches(grouped).withColumn("new_pred", F.col("old_pred")).drop("pos")
    items = F.transform("batches", lambda b: F.struct(b["batch_idx"].alias("batch_idx"), F.transform(F.arrays_zip(b["pids"].alias("text"), b["preds"].alias("score")), lambda x: F.struct(x["text"].alias("text"), x["score"].alias("score"))).alias("items")))
    again = grouped.withColumns({"request_id": F.concat_ws("-", "aid1", "aid2"), "prompt": render.prompt_batches(items)})
    said = scorer.call(again, second, keep=grouped.columns).withColumn("said", replies.scores(F.col("content"), replies.NESTED))
    mine = F.coalesce(F.try_element_at("said", F.concat(F.lit("batch_"), F.col("batch_idx").cast("string"))), F.from_json(F.lit("{}"), replies.SCORES))
    return refine.flatten_batches(said, {"mine": mine}).withColumn("new_pred", refine.merged(F.col("mine"), F.col("pos"), F.col("old_pred"))).drop("mine", "pos")


def clean_requests(triples: DataFrame, aid: str, assignments: DataFrame, papers: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Prompts for batches of a profile's own papers: the profiles that triples name (aid: aid1 or aid2), if they are large enough; papers that are known."""
    mine = profiles.min_profile(profiles.targets_of(triples.select("name", F.col(aid).alias("aid")), assignments), config.min_profile)
    text = render.rendered(papers)
    rows = mine.withColumn("paper", profiles.paper_id()).join(text.withColumnRenamed("pid", "paper"), "paper")
    batches = batching.random_turns(rows, ["aid"], config.clean_batch, config.seed).groupBy("aid", "batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "pid", "text"))).alias("t"))
    some = profiles.sample(rows, config.clean_sample, config.seed).groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("p"))
    prompt = render.prompt_clean(F.col("p.text"), F.col("t.text"))
    return batches.join(some, "aid").select(F.concat_ws("-", "aid", "batch_id").alias("request_id"), "aid", "batch_id", F.col("t.pid").alias("pids"), prompt.alias("prompt"))


def clean(requests: DataFrame, assignments: DataFrame, score: scorer.Scorer = scorer.stub_lines) -> DataFrame:
    """The first step as a whole: replies to `clean_requests` as votes, and the assignments that the votes leave. Papers without a vote stay."""
    done = scorer.call(requests, score, keep=["aid", "pids"])
    values = replies.for_items(replies.in_order(replies.scores(F.col("content"))), F.size("pids"))
    votes = done.select("aid", F.explode(F.arrays_zip(F.col("pids").alias("pid"), values.alias("score"))).alias("v")).select("aid", "v.pid", "v.score")
    return labels.clean_profiles(assignments, votes)


def examples(triples: DataFrame, prior: DataFrame | None = None, mode: str = "train", config: EngineConfig = EngineConfig(), num_turn: int | None = None) -> DataFrame:
    """Targets in batches: labels by threshold and upsampled (train), dealt by confidence where scores are there (test)."""
    rows = triples
    if mode == "train":
        rows = labels.threshold(rows, config.label_threshold)
        rows = labels.upsample(rows) if config.upsample else rows
    keys = ["aid1", *(["aid2"] if "aid2" in triples.columns else [])]
    item = ["pid", *(["copy"] if "copy" in rows.columns else [])]  # copies are dealt among the other targets of their profile
    scored = prior is not None and mode == "test"
    rows = profiles.prior(rows, prior) if scored else rows
    turns = num_turn or config.num_turn
    if turns == 1:  # no batches to deal: the whole set is shuffled
        placed = ordering.shuffled(rows, config.seed, [*keys, *item], [*keys, *item, "ord"], "batch_id")
        return placed.withColumn("pos", F.lit(0))
    return batching.build_turns(rows, keys, turns, config.batching, config.seed, scored, item)


def evaluate(predictions: DataFrame) -> DataFrame:
    return metrics.macro(metrics.author_metrics(predictions))


def evaluation(logits: DataFrame, prefix: str, log: str, dumps: str, buffers: str | None = None) -> DataFrame:
    """An evaluation as a whole: scores from logits (no, yes) of triples, the predictions dumped as the next version, the metrics logged, unless they are of the
    evaluations during training, and returned with their prefix and the version's number. buffers: where the logits themselves are kept, by prefix."""
    if buffers:
        sinks.dump_buffers(logits, buffers, prefix)
        logits = logits.sparkSession.read.schema(logits.schema).parquet(f"{buffers}/prefix={prefix}")
    scored = logits.withColumn("pred", objective.p_yes(F.col("no"), F.col("yes"))).drop("no", "yes")
    version = sinks.dump_version(scored, dumps)
    kept = scored.sparkSession.read.schema(scored.schema).parquet(f"{dumps}/version={version}")
    right = metrics.accuracy(kept).select(F.struct("accuracy", "n")).scalar()
    row = evaluate(kept).select("*", right["accuracy"].alias("accuracy"), right["n"].alias("n"), F.lit(version).alias("version"))
    sinks.log_metrics(row, log, prefix)
    return row.select(F.lit(prefix).alias("prefix"), "*")


def budgeted(profile: DataFrame, used: DataFrame, keys: list[str], most: int, reserve: int = 500, length: str = "length") -> DataFrame:
    """Profile items while the model's context has room beside what is used; used: keys and used."""
    rows = profile.join(used, keys)
    return batching.within_budget(rows, keys, length, F.lit(most - reserve) - F.col("used"), [F.col("ord")])

