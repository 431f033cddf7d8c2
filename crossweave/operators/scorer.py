"""The scorer boundary: requests out, replies back, in tasks that retry and call in parallel.

A scorer is any picklable callable (prompt, system) -> text. It runs on the executors; a few calls of a task are under way at once. Replies keep the
request's id, so that their order doesn't matter. Failed calls are tried again, and end as empty replies with the number of tries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crossweave import schema
from crossweave.functions import replies

Scorer = Callable[[str, str], str]


def _fixed(text: str) -> float:
    """A score of two decimals, from the first byte of a text's MD5."""
    import hashlib

    return hashlib.md5(text.encode(), usedforsecurity=False).digest()[0] % 101 / 100


def stub(prompt: str, system: str = "") -> str:
    """A fixed reply for each prompt: a score for each target, from its checksum."""
    import json

    targets = prompt.rpartition("Targets:")[2].strip().split("; ")
    return json.dumps({str(i): _fixed(t) for i, t in enumerate(targets)})


def stub_batches(prompt: str, system: str = "") -> str:
    """The same for the batches of a pair: a score for each line of each batch."""
    import json

    out: dict[str, dict[str, float]] = {}
    for line in prompt.split("\n"):
        if line.startswith("Batch "):
            now = out.setdefault("batch_" + line.split()[1].rstrip(","), {})
        elif line.partition(": ")[0].isdigit():
            now[line.partition(": ")[0]] = _fixed(line)
    return json.dumps(out)


def stub_lines(prompt: str, system: str = "") -> str:
    """The same for the lines that follow "Targets:"."""
    import json

    lines = prompt.rpartition("Targets:\n")[2].split("\n")
    return json.dumps({line.partition(": ")[0]: _fixed(line) for line in lines if line.partition(": ")[0].isdigit()})


def call(requests: DataFrame, scorer: Scorer = stub, system: str = "", attempts: int = 3, at_once: int = 8, tasks: int | None = None, valid: Callable[[str], bool] = bool, keep: list[str] | None = None) -> DataFrame:
    """request_id, content, reasoning, attempts for requests (request_id, prompt). tasks: how many call at once, for a service that bears so many. keep: columns of the requests that go
    along, so that a reply needs no join to its request, and no request is made a second time for that."""
    more = keep or []

    def ask(prompt: str) -> tuple[str, int]:
        for k in range(1, attempts + 1):
            try:
                if valid(content := scorer(prompt, system)):
                    return content, k
            except Exception:  # noqa: BLE001  a reply that fails is tried again, then empty
                continue
        return "", attempts

    def ask_some(prompts: list[str]) -> list[tuple[str, int]]:
        return [ask(p) for p in prompts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                prompts = batch.column("prompt").to_pylist()
                few = max(1, min(16, len(prompts) // (8 * at_once)))  # a thread takes a few of many prompts at a time
                got = [x for some in pool.map(ask_some, [prompts[i : i + few] for i in range(0, len(prompts), few)]) for x in some]
                columns = [batch.column("request_id"), pa.array([c for c, _ in got], pa.string()), pa.array([k for _, k in got], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *[batch.column(k) for k in more]], ["request_id", "content", "attempts", *more])

    kept = [requests.schema[k] for k in more]
    out = requests.select("request_id", F.coalesce("prompt", F.lit("")).alias("prompt"), *more)
    out = (out.repartition(tasks) if tasks else out).mapInArrow(run, StructType([*StructType.fromDDL("request_id string, content string, attempts int"), *kept]))
    return out.select("request_id", replies.answer(F.col("content")).alias("content"), replies.reasoning(F.col("content")).alias("reasoning"), "attempts", *more).to(StructType([*StructType.fromDDL(schema.REPLIES), *kept]))


Positions = Callable[[str, list[str]], list[tuple[float, float]]]


def stub_positions(context: str, targets: list[str]) -> list[tuple[float, float]]:
    """Fixed logits (no, yes) for each target of a context."""
    return [(_fixed(context), _fixed(t)) for t in targets]


def call_positions(requests: DataFrame, scorer: Positions = stub_positions) -> DataFrame:
    """request_id, pos, no, yes: a pair of logits for each target of requests (request_id, context, targets), scored in one context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("no", pa.float64()), ("yes", pa.float64())]))
        for batch in batches:
            got = [scorer(c, t) for c, t in zip(batch.column("context").to_pylist(), batch.column("targets").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("request_id"), pa.array([[{"no": a, "yes": b} for a, b in g] for g in got], kind)], ["request_id", "logits"])

    out = requests.select("request_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))
    out = out.mapInArrow(run, "request_id string, logits array<struct<no:double,yes:double>>")
    return out.select("request_id", F.posexplode("logits").alias("pos", "l")).select("request_id", "pos", "l.no", "l.yes")


def unfinished(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies that are empty, and the others."""
    return done.filter("content = ''"), done.filter("content <> ''")


def with_replies(requests: DataFrame, done: DataFrame, key: str = "pids", order: str | None = None) -> DataFrame:
    """Every request, with the reply for its pair and set of ids where there is one; the last of several. order: the column that tells which is last; by default the largest content is taken."""
    from crossweave.functions.text import canonical

    a = requests.withColumn("_key", canonical(F.col(key)))
    last = F.max_by("content", order) if order else F.max("content")
    b = done.withColumn("_key", canonical(F.col(key))).groupBy("aid1", "aid2", "_key").agg(last.alias("content"))
    return a.join(b, ["aid1", "aid2", "_key"], "left").drop("_key")


def payload(model: str, prompt: Column, system: str = "", temperature: float = 0.0) -> Column:
    """What is sent to a chat service for a prompt, as JSON."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = [said("system", F.lit(system))] if system else []
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(*messages, said("user", prompt)).alias("messages"), F.lit(temperature).alias("temperature")))


@dataclass(frozen=True)
class ChatClient:
    """A scorer that asks a service over HTTP, by the chat-completions form that many services understand. The key is read on the executor, from a variable of its environment."""

    url: str
    model: str
    key_variable: str = "CHAT_API_KEY"
    temperature: float = 0.0
    timeout: float = 600.0

    def __call__(self, prompt: str, system: str = "") -> str:
        import json
        import os
        import urllib.request

        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
        body = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature}).encode()
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        with urllib.request.urlopen(urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", body, headers), timeout=self.timeout) as reply:
            message = json.load(reply)["choices"][0]["message"]
        thought = message.get("reasoning_content")
        return f"<think>{thought}</think>{message['content']}" if thought else message["content"]


def sometimes(prompt: str, system: str = "") -> str:
    """`stub`, but for some prompts, by their checksum, there is no reply, and for some an empty one."""
    kind = round(_fixed(prompt) * 100) % 3
    if kind == 0:
        raise TimeoutError("no reply")
    return "" if kind == 1 else stub(prompt, system)
