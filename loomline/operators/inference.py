"""Requests to language models and their responses; the model itself is a pluggable function of a batch of prompts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.predicates import numbered
from loomline.session import reread
from loomline.streaming.increments import read_new_files, run_available

Responder = Callable[[list[str]], list[str]]
#: What a request body of the provider's batch format calls its version.
BEDROCK_VERSION = "bedrock-2023-05-31"
FORMATS = ("openai", "bedrock", "gemini")


def request_lines(prompts: DataFrame, kind: str, model: str, system: str, schema: dict | None = None) -> DataFrame:
    """(id, line): a provider's batch request of each (id, content) row as JSON text."""
    task, content = F.concat(F.lit("task_"), F.col("id").cast("string")), F.col("content")
    message = lambda role, said: F.struct(F.lit(role).alias("role"), said.alias("content"))
    messages = F.array(message("system", F.lit(system)), message("user", content)).alias("messages")
    extra = [F.from_json(F.lit(json.dumps(schema)), F.schema_of_json(json.dumps(schema))).alias("response_format")] if schema else []
    body = F.struct(F.lit(model).alias("model"), messages, *extra).alias("body")
    if kind == "openai":
        line = F.struct(task.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/chat/completions").alias("url"), body)
    elif kind == "gemini":
        line = F.struct(task.alias("custom_id"), body)
    elif kind == "bedrock":
        given = F.struct(F.lit(BEDROCK_VERSION).alias("anthropic_version"), F.lit(system).alias("system"), F.array(message("user", content)).alias("messages"), F.lit(1024).alias("max_tokens"))
        line = F.struct(task.alias("recordId"), given.alias("modelInput"))
    else:
        raise ValueError(f"unknown format {kind}")
    return prompts.select("id", F.to_json(line).alias("line"))


def envelope(custom_id: Column, status: Column, model: Column, content: Column, usage: Column | None = None) -> Column:
    """The common response line."""
    choice = F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))
    body = [model.alias("model"), F.array(choice).alias("choices"), *([usage.alias("usage")] if usage is not None else [])]
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.struct(status.alias("status_code"), F.struct(*body).alias("body")).alias("response")))


BEDROCK_OUTPUT = "recordId string, modelOutput struct<id string, type string, model string, content array<struct<text string>>, stop_reason string, usage struct<input_tokens long, output_tokens long>>"


def from_bedrock(lines: DataFrame, line: str = "value") -> DataFrame:
    """Response lines of the provider's batch format as common ones; null where they cannot be read."""
    got = F.from_json(F.col(line), BEDROCK_OUTPUT)
    out = got["modelOutput"]
    made = envelope(got["recordId"], F.lit(200), out["model"], F.try_element_at(out["content"]["text"], F.lit(1)), out["usage"])
    return lines.select(F.when(out.isNotNull(), made).alias("value"))


def parse_list(answer: Column | str, schema: str) -> Column:
    """A JSON list of objects in a model's answer, fences removed; null where it is anything else."""
    from loomline.functions.text import strip_fences

    return F.from_json(strip_fences(answer), f"array<struct<{schema}>>")


def infer(prompts: DataFrame, responder: Responder, size: int = 20, retries: int = 2, epochs: int = 1) -> DataFrame:
    """(id, epoch, status, answer, batch): batches of ``size`` prompts in the order of their ids, each epoch on its own.

    A batch whose responder fails or returns another number of answers is tried again; then its rows have status 400.
    """
    placed = numbered(prompts.select("id", "content"), [F.col("id")], "at").withColumn("batch", F.floor(F.col("at") / size))
    return _asked(placed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))), responder, retries)


def _asked(dealt: DataFrame, responder: Responder, retries: int) -> DataFrame:
    """Answers to prompts (id, content, at, batch, epoch), a batch at a time."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("at")
        answers = None
        for _ in range(1 + retries):
            try:
                answers = responder(batch["content"].tolist())
            except Exception:  # the provider's own errors are of any kind; the row's status tells of them
                answers = None
            if answers is not None and len(answers) == len(batch):
                break
            answers = None
        return pd.DataFrame({"id": batch["id"], "epoch": batch["epoch"], "status": 400 if answers is None else 200, "answer": answers if answers is not None else [None] * len(batch), "batch": batch["batch"]})

    # a group is one batch of at most ``size`` rows
    return dealt.groupBy("epoch", "batch").applyInPandas(run, f"id {dict(dealt.dtypes)['id']}, epoch int, status int, answer string, batch long")


def batch_text(rows: DataFrame, size: int, mark: str = "\n") -> DataFrame:
    """(batch, content): the contents of ``size`` rows (id, content) at a time, in the order of their ids, joined."""
    placed = numbered(rows.select("id", "content"), [F.col("id")], "at").withColumn("batch", F.floor(F.col("at") / size))
    ordered = F.array_sort(F.collect_list(F.struct("at", "content")))
    return placed.groupBy("batch").agg(F.array_join(ordered["content"], mark).alias("content"))


def remaining(prompts: DataFrame, done: DataFrame) -> DataFrame:
    """Prompts without an answer yet."""
    return prompts.join(done.filter("status = 200"), "id", "left_anti")


def is_finished(source: DataFrame, done: DataFrame, share: float = 0.9) -> bool:
    """Whether that share of the rows is done."""
    total = source.count()
    return total == 0 or done.count() >= share * total


def fake_responder(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model."""
    import hashlib

    return [json.dumps({"answer": "ABCD"[hashlib.md5(p.encode()).digest()[0] % 4]}) for p in prompts]


#: Services whose responders have to be registered before they can be used; calling them needs a network.
SERVICES = ("groq", "azure", "aws", "gemini", "deepseek")
RESPONDERS: dict[str, Responder] = {"fake": fake_responder}


def register(name: str, made: Responder) -> None:
    RESPONDERS[name] = made


def responder(name: str) -> Responder:
    if name not in RESPONDERS:
        raise ValueError(f"no responder {name}" + (": the service is known, but nothing is registered for it" if name in SERVICES else ""))
    return RESPONDERS[name]


class _Stopped(RuntimeError):
    """Too many batches in a row have failed."""


def infer_resumable(spark: SparkSession, prompts: DataFrame, responder: Responder, folder: str, size: int = 25, retries: int = 5, flush: int = 10, stop_after: int = 3) -> bool:
    """Answer prompts (id, content) into ``folder``, ``flush`` batches at a time; whether all are answered.

    Prompts are numbered and filed once, ``flush`` batches a file (a wave); later calls file only ids that are new. The files are
    a stream that is read a wave at a time, and its checkpoint is what has been done: a run goes on with the wave in which the last
    one ended, reads no other, and asks only what that wave has no answer to. After ``stop_after`` batches in a row that failed
    the run stops, and the wave is taken up again by the next; prompts of single failed batches are filed behind all others, for the
    next run. Answers lie in a folder a wave, which is added to before the wave counts as done."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    filed, schema, known = f"{folder}/_prompts", "id string, content string, at long, batch long", "id string, epoch int, status int, answer string"
    there = lambda p: system.exists(path(p)) and any(not s.getPath().getName().startswith(("_", ".")) for s in system.listStatus(path(p)))
    waves = [int(s.getPath().getName().split("=")[1]) for s in system.listStatus(path(filed)) if s.getPath().getName().startswith("wave=")] if system.exists(path(filed)) else []

    def file(rows: DataFrame, first: int) -> None:
        placed = numbered(rows.select("id", "content"), [F.col("id")], "at").withColumn("batch", F.floor(F.col("at") / size))
        placed.withColumn("wave", F.lit(first).cast("long") + F.floor(F.col("batch") / flush)).repartition("wave").write.mode("append").partitionBy("wave").parquet(filed)

    new = prompts.select(F.col("id").cast("string").alias("id"), "content")
    if waves:
        new = new.join(spark.read.parquet(filed).select("id").distinct(), "id", "left_anti")
    file(new, max(waves, default=-1) + 1)
    if not there(filed):
        return True
    failed = 0

    def answer(wave: DataFrame, number: int) -> None:
        nonlocal failed
        place = f"{folder}/wave={number:09d}"
        if there(place):
            wave = wave.join(spark.read.schema(known).json(place).select("id"), "id", "left_anti")
        answers = reread(spark, _asked(wave.withColumn("epoch", F.lit(1)), responder, retries), "answers")
        answers.filter("status = 200").select("id", "epoch", "status", "answer").write.mode("append").json(place)
        # a wave has ``flush`` batches, which is what the driver looks at
        for row in answers.groupBy("batch").agg(F.min("status").alias("status")).orderBy("batch").collect():
            failed = failed + 1 if row.status != 200 else 0
            if failed >= stop_after:
                raise _Stopped(f"{failed} batches in a row have failed")
        again = wave.join(answers.filter("status <> 200").select("id"), "id", "left_semi")
        if again.limit(1).count():
            top = max(int(s.getPath().getName().split("=")[1]) for s in system.listStatus(path(filed)) if s.getPath().getName().startswith("wave="))
            file(again, top + 1)

    try:
        run_available(read_new_files(spark, filed, schema, files=1), f"{folder}/_offsets", answer)
    except StreamingQueryException as error:
        if _Stopped.__name__ not in str(error):
            raise
        return False
    answered = spark.read.schema(known).json(folder).filter("status = 200").select("id").distinct() if there(folder) else spark.createDataFrame([], "id string")
    return not spark.read.parquet(filed).select("id").join(answered, "id", "left_anti").limit(1).count()


def write_epochs(answers: DataFrame, folder: str) -> None:
    """A folder of JSON lines for each epoch."""
    answers.write.mode("overwrite").partitionBy("epoch").json(folder)


def forced_choices(prompts: DataFrame, think: Responder, choose: Responder, samples: int = 1, *, guide: str) -> DataFrame:
    """(id, answer0, thought0, answer1, ...): each prompt is thought about ``samples`` times, and each thought, with the guide
    behind it, is completed by a choice."""
    names = [f"{what}{k}" for k in range(samples) for what in ("answer", "thought")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {"id": frame["id"]}
            content = frame["content"].tolist()
            for k in range(samples):
                thoughts = [t + guide for t in think(content)]
                out[f"answer{k}"] = [a.strip() for a in choose([f"{c}\n{t}" for c, t in zip(content, thoughts, strict=True)])]
                out[f"thought{k}"] = thoughts
            yield pd.DataFrame(out)

    kind = dict(prompts.dtypes)["id"]
    return prompts.select("id", "content").mapInPandas(run, ", ".join([f"id {kind}", *(f"{n} string" for n in names)]))


class BatchProvider(Protocol):
    """A service that answers files of request lines in its own time."""

    def upload(self, path: str) -> str: ...
    def create(self, uploaded: str) -> str: ...
    def status(self, job: str) -> str: ...
    def download(self, job: str) -> list[str]: ...


#: How a job may end.
ENDED = ("completed", "failed", "expired", "cancelled")


def run_batch_job(requests: DataFrame, provider: BatchProvider, folder: str, wait: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Save request lines (line), upload them, create a job, ask until it has ended, and give its response lines as
    ``value``. A job that has not been completed is an error."""
    spark = requests.sparkSession
    requests.select("line").write.mode("overwrite").text(folder)
    job = provider.create(provider.upload(folder))
    while (status := provider.status(job)) not in ENDED:
        sleep(wait)
    if status != "completed":
        raise RuntimeError(f"job {job} {status}")
    return spark.createDataFrame([(x,) for x in provider.download(job)], "value string")


class LocalProvider:
    """A stand-in for a service: answers a folder's requests with a responder when its status has been asked for ``delay``
    times."""

    def __init__(self, spark: SparkSession, made: Responder, delay: int = 1):
        self.spark, self.made, self.delay, self.jobs = spark, made, delay, {}

    def upload(self, path: str) -> str:
        return path

    def create(self, uploaded: str) -> str:
        self.jobs[uploaded] = self.delay
        return uploaded

    def status(self, job: str) -> str:
        self.jobs[job] -= 1
        return "in_progress" if self.jobs[job] >= 0 else "completed"

    def download(self, job: str) -> list[str]:
        # a test's worth of requests
        lines = [json.loads(r.value) for r in self.spark.read.text(job).collect()]
        answers = self.made([x["body"]["messages"][-1]["content"] for x in lines])
        return [json.dumps({"custom_id": x["custom_id"], "response": {"status_code": 200, "body": {"model": x["body"]["model"], "choices": [{"message": {"content": a}}]}}}) for x, a in zip(lines, answers, strict=True)]
