"""Calls to a model server: a client protocol, the exchange that ends in checked JSON, and replies kept by request hash."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.replies import parse, response_format
from marginalia.functions.text import CONTEXT_MARKERS, FORMAT_MARKERS
from marginalia.operators.payloads import STAGES
from marginalia.schemas import REPLIES, struct
from marginalia.storage import stored


class ModelError(RuntimeError):
    """The server refused or failed."""


@dataclass
class Reply:
    text: str
    model: str = ""
    usage: dict[str, int] = field(default_factory=dict)
    duration_s: float = 0.0


class ModelClient(Protocol):
    def chat(self, messages: list[dict[str, str]], *, model: str, response_format: dict[str, Any] | None) -> Reply: ...


@dataclass
class Outcome:
    json: str | None
    mode: str
    attempts: int
    model: str
    usage: dict[str, int]
    duration_s: float
    error: str


def exchange(client: ModelClient, schema: str, model: str, system: str, user: str, kind: T.StructType | None = None) -> Outcome:
    """Asks for JSON of a reply schema: by schema, then as a JSON object, then as text. An invalid reply gets one turn that
    states what is wrong. A message that doesn't fit, or a failure that is not about the format, ends it. kind: the schema's
    type, which only the driver can make from its name."""
    kind = kind or struct(REPLIES[schema])
    talk = [{"role": "system", "content": system}, {"role": "user", "content": user}]
    out = Outcome(None, "failed", 0, model, {}, 0.0, "no valid JSON produced")

    def ask(messages: list[dict[str, str]], wanted: dict[str, Any] | None) -> tuple[str | None, str, Reply]:
        reply = client.chat(messages, model=model, response_format=wanted)
        out.model, out.duration_s = reply.model or out.model, out.duration_s + reply.duration_s
        for k, n in reply.usage.items():
            out.usage[k] = out.usage.get(k, 0) + n
        return *parse(reply.text, kind), reply

    for mode, wanted in (("json_schema", response_format(schema, kind)), ("json_object", {"type": "json_object"}), ("text", None)):
        out.attempts += 1
        try:
            found, wrong, reply = ask(talk, wanted)
        except ModelError as e:
            out.error, low = str(e), str(e).lower()
            if any(m in low for m in CONTEXT_MARKERS):
                out.mode = "context_exceeded"
                return out
            if not any(m in low for m in FORMAT_MARKERS):
                return out
            continue
        if found is None:
            out.attempts += 1
            again = [*talk, {"role": "assistant", "content": reply.text[:6000]}, {"role": "user", "content": f"Your previous reply was not valid against the required schema: {wrong}\n\nReturn the corrected JSON object only. No prose, no code fences, no explanation. Every required field must be present."}]
            mode, out.error = f"{mode}+repair", wrong
            try:
                found, _, _ = ask(again, wanted)
            except ModelError:
                found = None
        if found is not None:
            out.json, out.mode, out.error = found, mode, ""
            return out
    return out


def text_exchange(client: ModelClient, model: str, system: str, user: str) -> tuple[str, Outcome]:
    """One turn whose reply is text, not JSON."""
    reply = client.chat([{"role": "system", "content": system}, {"role": "user", "content": user}], model=model, response_format=None)
    return reply.text, Outcome(None, "text", 1, reply.model or model, dict(reply.usage), reply.duration_s, "" if reply.text.strip() else "empty response")


RESULT = "request_hash string, stage string, label string, json string, text string, model string, mode string, ok boolean, attempts int, duration_s double, usage map<string,bigint>, error string"


def run(requests: DataFrame, make_client: Callable[[], ModelClient], model: str | dict[str, str], system: str = "", prompts: dict[str, str] | None = None) -> DataFrame:
    """Every request's outcome, as a reply and a call record in one row. model: one for all calls, or by pass with a 'default';
    prompts: texts by name. A call never raises: its error is in its row. Store the result before using it, as a task that is run
    again asks again."""

    kinds = {k: struct(v) for k, v in REPLIES.items()}
    models = {"default": model} if isinstance(model, str) else model

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                pass_, prompt, more, schema = STAGES[r.stage]
                own, text = models.get(pass_) or models["default"], None
                user = f"{(prompts or {}).get(prompt, '')}{more}\n\n=== INPUT ===\n{r.payload}"
                began = time.time()
                try:
                    if schema is None:
                        text, o = text_exchange(client, own, system, user)
                    else:
                        o = exchange(client, schema, own, system, user, kinds[schema])
                except Exception as e:  # noqa: BLE001  a client may raise anything; one call must not end the others
                    o = Outcome(None, "failed", 1, own, {}, time.time() - began, f"{type(e).__name__}: {e}")
                rows.append((r.request_hash, r.stage, r.label, o.json, text, o.model, o.mode, o.json is not None or bool((text or "").strip()), o.attempts, o.duration_s, o.usage, o.error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return requests.select("request_hash", "stage", "label", "payload").mapInPandas(calls, RESULT)


def answered(requests: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a kept reply(request_hash, json), and those still to be asked."""
    kept = replies.dropDuplicates(["request_hash"])
    return requests.join(kept, "request_hash"), requests.join(kept, "request_hash", "left_anti")


class Replies:
    """Replies kept in a folder that the driver and all executors share, by request hash.

    Requests are asked in waves, each added to the folder when it is done: a run that was ended asks only what is still open when
    it is run again, and what failed. Requests with one hash are asked once."""

    def __init__(self, spark: SparkSession, path: str, ask: Callable[[DataFrame], DataFrame], wave: int = 2_000):
        self.spark, self.path, self.put, self.wave = spark, path, ask, wave
        spark.createDataFrame([], RESULT).write.mode("append").parquet(path)

    def kept(self) -> DataFrame:
        """Of each hash the reply that came out well, if one did."""
        rows = self.spark.read.schema(RESULT).parquet(self.path)
        best = rows.groupBy("request_hash").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "request_hash"]), F.struct("ok", "attempts")).alias("r"))
        return best.select("request_hash", "r.*")

    def ask(self, requests: DataFrame) -> DataFrame:
        """requests with the columns of their replies."""
        requests = stored(requests, "requests")
        open_ = requests.dropDuplicates(["request_hash"]).join(self.kept().where("ok").select("request_hash"), "request_hash", "left_anti")
        open_ = stored(open_, "open")
        waves = max(1, -(-open_.count() // self.wave))
        if waves == 1:
            self.put(open_).write.mode("append").parquet(self.path)
        else:
            # each wave reads its own requests, not all, and is dealt over all cores
            dealt = stored(open_.withColumn("_wave", F.pmod(F.xxhash64("request_hash"), F.lit(waves))), "waves", by="_wave")
            cores = self.spark.sparkContext.defaultParallelism
            for w in range(waves):
                own = dealt.where(F.col("_wave") == w).drop("_wave").repartition(cores)
                self.put(own).write.mode("append").parquet(self.path)
        return stored(requests.join(self.kept().drop("stage", "label"), "request_hash"), "replies")


def usage_of_runs(calls: DataFrame) -> DataFrame:
    """(run_id, total_usage, calls, duration_s, errors): tokens summed by key."""
    keys = calls.select("run_id", F.explode("usage").alias("k", "n")).groupBy("run_id", "k").agg(F.sum("n").alias("n"))
    maps = keys.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("total_usage"))
    plain = calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("duration_s").alias("duration_s"), F.count_if(~F.col("ok")).alias("errors"))
    return plain.join(maps, "run_id", "left")


def pick_model(models: DataFrame, wanted: str | None = None) -> DataFrame:
    """The wanted id, or the first of models(ord, id, type) that is no embedding or reranking model."""
    if wanted:
        return models.sparkSession.createDataFrame([(wanted,)], "id string")
    plain = models.where(~F.coalesce("type", F.lit("")).isin("embedding", "embeddings") & ~F.lower("id").rlike("embed|rerank"))
    return plain.agg(F.min_by("id", "ord").alias("id")).where("id is not null")


def model_endpoints(endpoints: DataFrame) -> DataFrame:
    """(model, quantization, providers) of endpoints(model, quantization, provider): the distinct quantisations in order, joined
    by bars, null if there are none, and the distinct providers in order."""
    some = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    names = endpoints.groupBy("model").agg(some("quantization").alias("q"), some("provider").alias("providers"))
    return names.select("model", F.when(F.size("q") > 0, F.array_join("q", "|")).alias("quantization"), "providers")
