"""Calls to a model with a recorded outcome for each prompt.

`answered` sends distinct prompts from Arrow batches, several at once in a task, each
with a time limit and retries, and writes a row for each: what came
back or what went wrong, how often it was tried and how long it took. Rows are known
by a hash of prompt and options, so another run over the same table sends only what
has no answer yet. A failure never ends the job.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

OUTCOME = "prompt_hash string, outcome string, answer string, error string, attempts int, elapsed double, options string"


@dataclass(frozen=True)
class ModelServer:
    """A model behind HTTP, and the options that are sent with every prompt."""

    url: str
    model: str
    temperature: float = 0.0
    seed: int = 42
    think: bool | None = None
    timeout: float = 120.0
    #: Options that the server's own defaults decide.
    inherited: tuple[str, ...] = field(default=("top_k", "top_p", "min_p", "repeat_penalty", "num_predict", "num_ctx"))

    def options(self) -> dict[str, float | int]:
        return {"temperature": self.temperature, "seed": self.seed}

    def payload(self, prompt: str) -> dict:
        out = {"model": self.model, "prompt": prompt, "stream": False, "options": self.options()}
        return out if self.think is None else {**out, "think": self.think}

    def provenance(self) -> dict:
        """What was sent explicitly and what was left to the server."""
        return {"model": self.model, "stream": False, "options": self.options(), "think": self.think, "think_source": "unset" if self.think is None else "explicit", "inherited": list(self.inherited), "timeout_seconds": self.timeout}

    def _get(self, path: str) -> dict:
        with urllib.request.urlopen(f"{self.url.rstrip('/')}{path}", timeout=5) as r:
            return json.load(r)

    def identity(self) -> dict[str, str | None]:
        """Version and digest of the running model, if the server tells them;
        what could not be learned is named in `error`."""
        out: dict[str, str | None] = {"version": None, "digest": None}
        errors = []
        try:
            version = self._get("/api/version").get("version")
            out["version"] = version if isinstance(version, str) and version else None
            errors += [] if out["version"] else ["version_missing"]
        except (OSError, ValueError) as e:
            errors.append(f"version_unavailable:{type(e).__name__}")
        try:
            models = self._get("/api/tags").get("models") or []
            out["digest"] = next((m.get("digest") for m in models if self.model in (m.get("name"), m.get("model"))), None)
            errors += [] if out["digest"] else ["digest_missing"]
        except (OSError, ValueError) as e:
            errors.append(f"tags_unavailable:{type(e).__name__}")
        return {**out, "error": ";".join(errors) or None}

    def __call__(self, prompt: str) -> str:
        body = json.dumps(self.payload(prompt)).encode()
        asked = urllib.request.Request(f"{self.url.rstrip('/')}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(asked, timeout=self.timeout) as r:
            answer = json.load(r).get("response")
        if not isinstance(answer, str):
            raise ValueError("the reply has no text in `response`")
        return answer.strip()


def attempt(call: Callable[[str], str], prompt: str, limit: float) -> tuple[str, str | None, str | None]:
    """(outcome, answer, error) of one call; a call beyond its limit is left to itself."""
    got: list[tuple[str, str | None, str | None]] = []

    def work() -> None:
        try:
            got.append(("ok", call(prompt), None))
        except Exception as e:  # whatever a client raises is an outcome
            got.append(("error", None, f"{type(e).__name__}: {e}"))

    t = threading.Thread(target=work, daemon=True)
    t.start()
    t.join(limit)
    return got[0] if got else ("timeout", None, f"no answer within {limit:g} s")


def tried(call: Callable[[str], str], prompt: str, limit: float, retries: int) -> tuple[str, str | None, str | None, int, float]:
    began = time.monotonic()
    for n in range(1, retries + 2):
        out = attempt(call, prompt, limit)
        if out[0] == "ok":
            break
    return (*out, n, time.monotonic() - began)


def outcomes(asked: DataFrame, call: Callable[[str], str], options: str, limit: float = 120.0, retries: int = 1, at_once: int = 4) -> DataFrame:
    """OUTCOME rows of (prompt_hash, prompt); `at_once` calls run in a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                done = list(pool.map(lambda p: tried(call, p, limit, retries), b.column(1).to_pylist()))
                columns = list(zip(*done, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([options] * b.num_rows, pa.string())], names=[c.split()[0] for c in OUTCOME.split(", ")])

    return asked.select("prompt_hash", "prompt").mapInArrow(rows, OUTCOME)


def answered(asked: DataFrame, call: Callable[[str], str], path: str, options: dict | None = None, limit: float = 120.0, retries: int = 1, at_once: int = 4, tasks: int = 8) -> DataFrame:
    """`asked` (prompt, ...) with outcome, raw_answer, error, attempts and elapsed. Rows
    with a null prompt are not sent. `path` keeps the outcomes of all runs."""
    spark, told = asked.sparkSession, json.dumps(options or {}, sort_keys=True)
    asked = asked.withColumn("prompt_hash", F.when(F.col("prompt").isNotNull(), F.sha2(F.concat(F.lit(told + "\n"), F.col("prompt")), 256)))
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    known = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    todo = asked.where("prompt IS NOT NULL").select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"])
    if known:
        todo = todo.join(spark.read.parquet(path).where("outcome = 'ok'").select("prompt_hash"), "prompt_hash", "left_anti")
    # written before it is sent, so that a task that is run again sends its own prompts only
    todo = scratch.written(todo.repartition(tasks, "prompt_hash"), "prompts")
    outcomes(todo, call, told, limit, retries, at_once).withColumn("run", F.lit(uuid.uuid4().hex)).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
    # of several outcomes of a prompt an answer counts, and else the last
    best = F.max_by(F.struct("outcome", F.col("answer").alias("raw_answer"), "error", "attempts", "elapsed"), F.struct(F.col("outcome") == "ok", "at"))
    found = spark.read.parquet(path).groupBy("prompt_hash").agg(best.alias("x")).select("prompt_hash", "x.*")
    return asked.join(found, "prompt_hash", "left")


def outcome_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce("outcome", F.lit("not_sent")).alias("outcome")).agg(F.count(F.lit(1)).alias("prompts"), F.avg("attempts").alias("attempts"))
