"""Progress of jobs as an append-only log: offsets, replay, the latest state, and the log as a stream."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from marginalia.schemas import JOB_EVENTS, RUNS

KEPT = 50


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a stream of files."""
    return spark.readStream.schema(JOB_EVENTS).json(path)


def since(events: DataFrame, offset: int) -> DataFrame:
    """Events of each job from an offset on, in order."""
    return events.where(F.col("offset") >= offset)


def state(events: DataFrame) -> DataFrame:
    """(job_id, status, event_count, finished): works on a table and on a stream, whose state is one row for each job."""
    last = F.max_by("status", "offset")
    return events.groupBy("job_id").agg(last.alias("status"), F.count(F.lit(1)).alias("event_count")).withColumn("finished", F.col("status").isin("done", "failed"))


def addressable(events: DataFrame, kept: int = KEPT) -> DataFrame:
    """(job_id): the jobs that began last, which a registry of `kept` jobs still knows."""
    began = events.groupBy("job_id").agg(F.min(F.struct("ts", "job_id")).alias("m"))
    return began.orderBy(F.desc("m")).limit(kept).select("job_id")


def numbered(events: DataFrame) -> DataFrame:
    """events(job_id, ts, status, message) with offset: the place in the job, from 0."""
    return events.withColumn("offset", F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "message")).cast("bigint") - 1)


def follow(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The state of jobs kept up to date in a folder of Parquet files, until the source is read: of each batch the jobs that it
    changed, as a folder of its own, so that a batch that is played again takes its own place. latest() reads them."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number:09d}")

    return state(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """(job_id, status, event_count, finished): of each job the last state that follow() wrote."""
    rows = spark.read.parquet(target)
    names = [c for c in rows.columns if c not in ("job_id", "batch")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("job_id", "s.*")


#: Which status may follow which; a job begins queued. Messages leave the status as it is.
STEPS = {"": ("queued",), "queued": ("queued", "running"), "running": ("running", "done", "failed"), "done": (), "failed": ()}
REGISTRY = "registry string, job_id string, offset bigint, status string, event_count bigint, outcome string, error string"


class Registry(StatefulProcessor):
    """Jobs of one registry: where each is, how many events it has had, and which are still known.

    An event goes in if it is the job's next one and its status may follow; outcome tells: accepted, repeated (an event that was
    seen before, as when a source is replayed), rejected, evicted (the job that gave way to a new one, the oldest first, beyond
    `kept`), expired (a running job without an event for idle_s, which has failed). State holds `kept` jobs, whatever came."""

    def __init__(self, kept: int = KEPT, idle_s: int = 3600):
        self.kept, self.idle_s = kept, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id string", "place bigint, status string, event_count bigint, seen_ms bigint")
        self.next = handle.getValueState("next", "place bigint")

    def handleInputRows(self, key, rows, timerValues):
        known = {k[0]: list(v) for k, v in self.jobs.iterator()}
        before = {k: list(v) for k, v in known.items()}
        place = self.next.get()[0] if self.next.exists() else 0
        out = []
        events = pd.concat(list(rows)).sort_values(["ts", "job_id", "offset"])
        for r in events.itertuples(index=False):
            _, status, count, _ = known.get(r.job_id, [0, "", 0, 0])
            if r.offset < count:
                out.append((key[0], r.job_id, r.offset, status, count, "repeated", ""))
                continue
            if r.offset > count or r.status not in STEPS[status]:
                out.append((key[0], r.job_id, r.offset, status, count, "rejected", f"{r.status} can't follow {status or 'nothing'} at {r.offset}"))
                continue
            if r.job_id not in known:
                known[r.job_id] = [place, "", 0, 0]
                place += 1
            known[r.job_id][1:] = [r.status, count + 1, int(r.ts.timestamp() * 1000)]
            out.append((key[0], r.job_id, r.offset, r.status, count + 1, "accepted", ""))
            while len(known) > self.kept:
                oldest = min(known, key=lambda k: known[k][0])
                _, status, count, _ = known.pop(oldest)
                out.append((key[0], oldest, count, status, count, "evicted", ""))
        self._keep(before, known, place)
        if self.idle_s:
            waits = [v[3] for v in known.values() if v[1] == "running"]
            if waits:
                self.handle.registerTimer(min(waits) + self.idle_s * 1000)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REGISTRY.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = {k[0]: list(v) for k, v in self.jobs.iterator()}
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for job, (place, status, count, seen) in known.items():
            if status == "running" and seen + self.idle_s * 1000 <= now:
                self.jobs.updateValue((job,), (place, "failed", count + 1, seen))
                out.append((key[0], job, count, "failed", count + 1, "expired", f"no event for {self.idle_s} s"))
        later = [seen for _, status, _, seen in known.values() if status == "running" and seen + self.idle_s * 1000 > now]
        if later:
            self.handle.registerTimer(min(later) + self.idle_s * 1000)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REGISTRY.split(", ")])

    def _keep(self, before: dict, known: dict, place: int) -> None:
        for job in before.keys() - known.keys():
            self.jobs.removeKey((job,))
        for job, value in known.items():
            if before.get(job) != value:
                self.jobs.updateValue((job,), tuple(value))
        self.next.update((place,))

    def close(self) -> None:
        pass


def registered(events: DataFrame, kept: int = KEPT, idle_s: int = 3600, delay: str = "0 seconds") -> DataFrame:
    """What becomes of each event of a stream(registry, job_id, offset, status, message, ts), as REGISTRY. Registries are independent
    of each other and are dealt over tasks. Events later than delay are not seen at all. It needs RocksDB as state store: spark.sql.streaming.stateStore.providerClass."""
    own = events.withWatermark("ts", delay)
    return own.groupBy("registry").transformWithStateInPandas(statefulProcessor=Registry(kept, idle_s), outputStructType=REGISTRY, outputMode="Update", timeMode="EventTime")


# Progress as a source -------------------------------------------------------------------------------------------------------

PROGRESS = "job_id string, offset bigint, status string, message string, ts timestamp"


class ProgressSource(DataSource):
    """format("job_progress"): the events of one job (option job) in a log of JSON lines (option path), in order of offset. A stream
    of it goes on from any offset (option from, 0 by default), and reads at most `most` events a batch (1,000)."""

    @classmethod
    def name(cls) -> str:
        return "job_progress"

    def schema(self) -> str:
        return PROGRESS

    def reader(self, schema):
        return ProgressReader(self.options)

    def simpleStreamReader(self, schema):
        return ProgressStream(self.options)


def _events(options: dict[str, str]) -> list[tuple]:
    """The job's events, each offset once, as the files of the folder have them."""
    found = {}
    for path in sorted(Path(options["path"]).glob("*.json")):
        for line in path.read_text().splitlines():
            row = json.loads(line) if line.strip() else {}
            if row.get("job_id") == options["job"]:
                found.setdefault(int(row["offset"]), (row["job_id"], int(row["offset"]), row["status"], row["message"], datetime.fromisoformat(row["ts"])))
    return [found[k] for k in sorted(found)]


class ProgressReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def read(self, partition):
        yield from (e for e in _events(self.options) if e[1] >= int(self.options.get("from", 0)))


class ProgressStream(SimpleDataSourceStreamReader):
    """Offsets are those of the job's events: a batch that is played again gives the same events."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"offset": int(self.options.get("from", 0))}

    def read(self, start: dict):
        rows = [e for e in _events(self.options) if e[1] >= start["offset"]][: int(self.options.get("most", 1000))]
        return iter(rows), {"offset": rows[-1][1] + 1 if rows else start["offset"]}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(e for e in _events(self.options) if start["offset"] <= e[1] < end["offset"])


def progress(spark: SparkSession, path: str, job: str, start: int = 0) -> DataFrame:
    """The events of a job as a stream that begins at an offset."""
    spark.dataSource.register(ProgressSource)
    return spark.readStream.format("job_progress").option("path", path).option("job", job).option("from", str(start)).load()


def finished(events: DataFrame) -> DataFrame:
    """(job_id): jobs of a table of events whose last one ends them; a reader that has met that one needs no more."""
    return state(events).where("finished").select("job_id")


def append_run_log(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Finished runs from files of JSON, added to the log as they come. Each batch has a folder of its own, so that one that is
    played again takes its own place."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{target}/batch={number:09d}")

    return spark.readStream.schema(RUNS).json(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frames(events: DataFrame) -> DataFrame:
    """Events as server-sent text frames."""
    return events.select("job_id", "offset", F.concat(F.lit("event: progress\ndata: "), "message", F.lit("\n\n")).alias("frame"))
