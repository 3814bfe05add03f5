"""Structured Streaming forms of the ledger metrics and of the task feed.

Late data: event time with watermarks where metrics are windowed; revisions, not times, decide in the task feed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bitloom.operators.memory import upsert_memory
from bitloom.sources import published

#: Buckets of keyed state; a stream keeps the number that it began with.
KEY_BUCKETS = 1_024


def live_request_metrics(ledger: DataFrame, delay: str = "1 minute", width: str = "1 minute") -> DataFrame:
    """Request counts, failures (without cancelled ones), tokens and cache hits by window, provider and model. ledger: ts, event, provider, model, succeeded, cancelled, latency_ms, input, output, hit, miss; if there, retry and repair (booleans of starts)."""
    flag = lambda c: F.count_if((F.col("event") == "request_started") & F.col(c)) if c in ledger.columns else F.lit(0).cast("long")
    done, used = F.col("event") == "request_finished", F.col("event") == "usage"
    return (
        ledger.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "provider", "model")
        .agg(
            F.count_if(F.col("event") == "request_started").alias("attempts"),
            F.count_if(done & F.col("succeeded")).alias("succeeded"),
            F.count_if(done & ~F.col("succeeded") & ~F.coalesce("cancelled", F.lit(False))).alias("failed"),
            F.count_if(done & F.coalesce("cancelled", F.lit(False))).alias("cancelled"),
            flag("retry").alias("retries"),
            flag("repair").alias("repairs"),
            F.avg(F.when(done, F.col("latency_ms"))).alias("average_latency_ms"),
            F.percentile_approx(F.when(done, F.col("latency_ms")), 0.95, 10_000).alias("p95_latency_ms"),
            F.sum(F.when(used, F.col("input"))).alias("input"),
            F.sum(F.when(used, F.col("output"))).alias("output"),
            F.sum(F.when(used, F.col("hit"))).alias("hits"),
            F.sum(F.when(used, F.col("miss"))).alias("misses"),
        )
    )


def dedupe_calls(ledger: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each kind of event once per call, as far apart as the delay."""
    return ledger.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["call_id", "event"])


def join_calls_stream(started: DataFrame, finished: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Starts with their finish, if it comes within the interval; a call without one comes out, unfinished, once it cannot come any more."""
    a = started.select("call_id", F.col("ts").alias("started_at")).withWatermark("started_at", within)
    b = finished.select(F.col("call_id").alias("f_call_id"), F.col("ts").alias("finished_at"), "succeeded").withWatermark("finished_at", within)
    return a.join(b, F.expr(f"call_id = f_call_id AND finished_at >= started_at AND finished_at <= started_at + INTERVAL {within}"), "leftOuter").drop("f_call_id")


def sliding_rate(ledger: DataFrame, seconds: int = 10, step: str = "1 second", amount: str | None = None, delay: str = "30 seconds") -> DataFrame:
    """Requests, or a column's sum, per second over sliding windows."""
    total = F.count("*") if amount is None else F.sum(amount)
    return ledger.withWatermark("ts", delay).groupBy(F.window("ts", f"{seconds} seconds", step)).agg((total / F.lit(float(seconds))).alias("rate"))


def throughput_stream(ledger: DataFrame, seconds: int = 30, step: str = "1 second", delay: str = "30 seconds") -> DataFrame:
    """Output tokens per second and paragraphs per minute over sliding windows; tokens are null where a usage event of the window is incomplete or there is none. ledger: ts, output, complete (null for rows without usage), paragraphs."""
    per = F.lit(float(seconds))
    whole = F.coalesce(F.bool_and("complete"), F.lit(False))
    return ledger.withWatermark("ts", delay).groupBy(F.window("ts", f"{seconds} seconds", step)).agg(F.when(whole, F.sum("output") / per).alias("output_per_second"), (F.sum("paragraphs") * 60.0 / per).alias("paragraphs_per_minute"))


def bucket_stream(calls: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Requests and tokens by tumbling buckets; empty ones are filled in where the table is read (see bucket_ledger)."""
    return calls.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


def session_stream(events: DataFrame, gap: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Per task the stretches of activity between idle gaps."""
    return events.withWatermark("ts", delay).groupBy("task_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))


def _stateful(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str = "update", time_mode: str = "None") -> DataFrame:
    """Keyed state with types of its own, timers and lifetimes. It needs the RocksDB store, which the session is set to where it has Spark's default.

    With time_mode "ProcessingTime" Spark always asks for another batch, as time may have passed, so a query with the trigger
    availableNow never ends; start those with a trigger of fixed intervals and stop them.
    """
    conf, name = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in conf.get(name):
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, time_mode)


def _bucket(*keys: str) -> Column:
    """Which of KEY_BUCKETS a key falls in. Where there are many keys with few rows each, a bucket is the key of the state, and its own keys are entries of a map: a call of a Python processor costs as much as some thousand rows."""
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int").alias("bucket")


def _millis(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


class _UsageDelta(StatefulProcessor):
    """The totals of a bucket's calls, each in an entry of its own."""

    def __init__(self, idle: int | None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getMapState("totals", "call_id string", "total long", self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        most: dict[str | None, int] = {}
        for r in rows:
            for call, output in zip(r["call_id"].tolist(), r["output"].tolist(), strict=True):
                call = call if isinstance(call, str) else None
                most[call] = max(most.get(call, 0), output)
        out = []
        for call, largest in most.items():
            kept = self.totals.getValue((call,))
            total = kept[0] if kept else 0
            new = max(total, largest)
            if self.idle or not kept or new > total:  # an entry's time runs anew with each event
                self.totals.updateValue((call,), (new,))
            out.append((call, new, new - total))
        yield pd.DataFrame(out, columns=["call_id", "total", "delta"])

    def close(self) -> None:
        pass


def usage_delta_stream(events: DataFrame, idle: str | None = "1 hour") -> DataFrame:
    """(call_id, total, delta): of cumulative usage events (call_id, seq, output) what each call adds over all before, repeats, stale and unknown values nothing. A call's state goes after it has been idle for so long (start it with a trigger of fixed intervals then); None keeps it."""
    known = events.select(_bucket("call_id"), "call_id", F.coalesce("output", F.lit(0)).cast("long").alias("output"))  # no nulls, which pandas would round numbers for
    return _stateful(known, ["bucket"], _UsageDelta(idle and _millis(idle)), "call_id string, total long, delta long", time_mode="ProcessingTime" if idle else "None")


class _TaskFeed(StatefulProcessor):
    """One server's tasks: each task's newest event, by instance and revision, and the server's newest instance."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.instance = handle.getValueState("instance", "generation long")
        self.tasks = handle.getMapState("tasks", "task_id string", "generation long, revision long, status string, attempt int, deleted boolean")

    @staticmethod
    def newer(now: tuple | None, event: tuple) -> tuple | None:
        """The task after an event: older instances and revisions do not count, nor, within an instance, lower attempts of a task that is there."""
        if now is None or event[0] > now[0]:
            return event
        if event[0] < now[0] or event[1] <= now[1] or (not event[4] and not now[4] and event[3] < now[3]):
            return now
        return event

    @staticmethod
    def shown(task: tuple | None, instance: int) -> tuple | None:
        """What the table holds: tasks of an instance that is gone are deleted."""
        gone = task is not None and (task[4] or task[0] < instance)
        return (task[0], task[1], None, task[3], True) if gone else task

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.instance.get()[0] if self.instance.exists() else -1
        events = pd.concat(list(rows)).sort_values(["generation", "revision"], kind="stable")
        instance = max(was, int(events["generation"].max()))
        before, now = {}, {}
        if instance > was:  # a new instance retires all that is there
            self.instance.update((instance,))
            before = {k[0]: tuple(v) for k, v in self.tasks.iterator()} if was >= 0 else {}
            now = dict(before)
        for r in events.itertuples(index=False):
            task = r.task_id
            if task not in now:
                before[task] = now[task] = tuple(self.tasks.getValue((task,))) if self.tasks.containsKey((task,)) else None
            deleted = r.type == "deleted"
            now[task] = self.newer(now[task], (int(r.generation), int(r.revision), None if deleted else r.status, int(r.attempt), deleted))
        out = []
        for task, state in now.items():
            if state != before.get(task):
                self.tasks.updateValue((task,), state)
            if self.shown(state, instance) != self.shown(before.get(task), was):
                out.append((key[0], task, *self.shown(state, instance)))
        if out:
            yield pd.DataFrame(out, columns=["server", "task_id", "generation", "revision", "status", "attempt", "deleted"])

    def close(self) -> None:
        pass


def snapshot_upsert(feed: DataFrame) -> DataFrame:
    """(server, task_id, generation, revision, status, attempt, deleted): the task table's changes from a feed of task and deleted events.

    feed: server, generation (rising with each server instance, from 0), revision, task_id, type, status, attempt. An event does not
    count if its revision is no newer than the task's or its tombstone's, or its attempt is lower than the task's in the same
    instance. A newer instance starts revisions anew and retires all of its server's tasks, those that never send again too:
    they are told as deleted, as are tasks that a late event of a gone instance tells of for the first time. What the table ends with
    does not depend on how events fall into micro-batches. A server is one key; its tasks are a map in the state store.
    """
    events = feed.select("server", "generation", "revision", "task_id", "type", "status", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    return _stateful(events, ["server"], _TaskFeed(), "server string, task_id string, generation long, revision long, status string, attempt int, deleted boolean")


class _Progress(StatefulProcessor):
    def __init__(self, stall: int) -> None:
        self.stall = stall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "seq long, percent double, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, before, done = self.state.get() if self.state.exists() else (-1, -1.0, False)
        percent = max(before, 0.0)
        seen = seq
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if r.seq > seq and not done:
                seq, done = int(r.seq), bool(r.terminal)
                percent = 100.0 if done else max(percent, min(99.0, float(r.percent)))
        if seq == seen:
            return
        self.state.update((seq, percent, done))
        if percent > before or done:  # the clock starts anew with each advance and stops at the end
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if not done:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stall)
        yield pd.DataFrame({"task_id": [key[0]], "seq": [seq], "percent": [percent], "stalled": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, percent, _ = self.state.get()
        yield pd.DataFrame({"task_id": [key[0]], "seq": [seq], "percent": [percent], "stalled": [True]})

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, stall: str = "30 seconds") -> DataFrame:
    """(task_id, seq, percent, stalled): progress that only rises in seq; 99 at most until the task ends, which nothing undoes; told as stalled once after so long without an advance, by a timer. events: task_id, seq, percent, terminal; nulls in the last two are 0 and false.

    Timers run in processing time: start it with a trigger of fixed intervals; with availableNow it would never end.
    """
    made = events.select("task_id", "seq", F.coalesce("percent", F.lit(0.0)).alias("percent"), F.coalesce("terminal", F.lit(False)).alias("terminal"))
    return _stateful(made, ["task_id"], _Progress(_millis(stall)), "task_id string, seq long, percent double, stalled boolean", time_mode="ProcessingTime")


class _EarlyCancel(StatefulProcessor):
    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "now string", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = now = self.state.get()[0] if self.state.exists() else ""
        out = []
        for kind in pd.concat(list(rows)).sort_values("seq")["type"]:
            if kind == "cancel":
                out += ["cancelled"] if now == "running" else []
                now = "cancelled"
            elif now == "cancelled":
                out.append("suppressed")
            elif now != "running":
                out.append("running")
                now = "running"
        if now != before:  # repeats do not prolong
            self.state.update((now,))
        if out:
            yield pd.DataFrame({"request_id": [key[0]] * len(out), "outcome": out})

    def close(self) -> None:
        pass


def early_cancel(events: DataFrame, keep: str = "60 seconds") -> DataFrame:
    """(request_id, outcome): a cancel that comes before its request, by up to so long, suppresses it; what is known of a request is forgotten so long after it last changed. events: request_id, type (request or cancel), seq."""
    return _stateful(events.select("request_id", "type", "seq"), ["request_id"], _EarlyCancel(_millis(keep)), "request_id string, outcome string", "append", "ProcessingTime")


PARAGRAPH = "doc_id long, paragraph_id string, status string, reason string"


class _Paragraphs(StatefulProcessor):
    """The paragraphs of a bucket's documents, a document in ``parts`` entries, so that a batch reads and writes only those it tells of."""

    def __init__(self, parts: int) -> None:
        self.parts = parts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.documents = handle.getMapState("documents", "doc_id string, part int", "paragraph_id array<string>, status array<string>, reason array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        told: dict[str | None, list[tuple]] = {}
        for doc, paragraph, kind, reason in zip(*(events[c].tolist() for c in ("doc_id", "paragraph_id", "type", "reason")), strict=True):
            told.setdefault(doc, []).append((paragraph if isinstance(paragraph, str) else None, kind, reason))
        out = []
        for doc, steps in told.items():
            before: dict[int, dict[str, tuple]] = {}
            now: dict[int, dict[str, tuple]] = {}

            def part(n: int, doc: str | None = doc, before: dict = before, now: dict = now) -> dict[str, tuple]:
                if n not in now:
                    kept = self.documents.getValue((doc, n))
                    before[n] = {p: tuple(v) for p, *v in zip(*kept, strict=True)} if kept else {}
                    now[n] = dict(before[n])
                return now[n]

            for paragraph, kind, reason in steps:
                if paragraph is not None:
                    known = part(zlib.crc32(paragraph.encode()) % self.parts)
                    known[paragraph] = next_state(known.get(paragraph, (None, None)), kind, reason)
                    continue
                for n in range(self.parts):
                    known = part(n)
                    for p, v in known.items():
                        known[p] = next_state(v, kind, reason)
            for n, known in now.items():
                changed = [(None if doc is None else int(doc), p, *v) for p, v in known.items() if before[n].get(p) != v]
                if changed:
                    self.documents.updateValue((doc, n), (list(known), *map(list, zip(*known.values(), strict=True))))
                    out += changed
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "paragraph_id", "status", "reason"], dtype=object)  # as objects, ids beside a null stay exact

    def close(self) -> None:
        pass


def _paragraph_states(events: DataFrame, keys: list[str], parts: int) -> DataFrame:
    # no nulls in numbers, which pandas would round the others for: documents as text, events without seq last as ever
    made = events.select(_bucket(*keys), F.col("doc_id").cast("string").alias("doc_id"), "paragraph_id", F.coalesce("seq", F.lit(2**63 - 1)).alias("seq"), "type", "reason")
    return _stateful(made, ["bucket"], _Paragraphs(parts), PARAGRAPH)


def checkpoint_state(events: DataFrame) -> DataFrame:
    """The paragraphs that each batch has changed (PARAGRAPH): success is not undone by pending, the end of a run turns pending into failed, a failed review demotes success.

    events: doc_id, paragraph_id, seq, type (pending, succeeded, failed, skipped, finish, review_failed), reason. Keys are spread
    by paragraph: here each has its own finish event, and documents of any size spread.
    """
    return _paragraph_states(events.where("paragraph_id is not null"), ["doc_id", "paragraph_id"], 1)


def checkpoint_documents(events: DataFrame, parts: int = 1) -> DataFrame:
    """As checkpoint_state, with the end of a run sent once per document: an event without paragraph_id holds for all of its document's paragraphs that are known by then. Keys are spread by document.

    A document's paragraphs are one entry of the state, or ``parts`` of them, by paragraph: more for documents of very many paragraphs,
    as an entry is read and written whole, where an event without paragraph_id reads all entries of its document.
    """
    return _paragraph_states(events, ["doc_id"], parts)


def next_state(now: tuple, kind: str, reason: str | None) -> tuple:
    """A paragraph's (status, reason) after an event."""
    status = now[0]
    if kind == "finish":
        return ("failed", "paragraph_not_completed") if status == "pending" else now
    if kind == "review_failed":
        return ("failed", reason or "quality_review_failed") if status == "succeeded" else now
    if kind == "pending" and status in ("succeeded", "skipped"):
        return now
    return (kind, reason if isinstance(reason, str) else None)


MEMORY_PARTS = 64


def read_memory(spark: SparkSession, table: str) -> DataFrame | None:
    """The memory table that sync_memory_stream keeps; None before the first batch that changes anything."""
    return published.read(spark, table)


def sync_memory_stream(batches: DataFrame, table: str, checkpoint: str, done: Callable[[int], None] | None = None):
    """Start a query that upserts confirmed paragraphs into a Parquet table of parts by document.

    A batch reads and writes only the parts that its documents belong to and then publishes them (see sources.published), so that readers see all of a
    batch or nothing of it. One that is run again before it was published writes its folder again, one that was published is
    passed over. A batch that changes nothing, as with sources that have been synced before, writes nothing. Parts that are replaced are removed
    one batch later, so files do not grow with the number of batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        origin = f"{checkpoint}#{batch_id}"
        if not published.was_published(spark, table, origin):
            part = F.pmod(F.xxhash64("doc_fingerprint"), F.lit(MEMORY_PARTS)).cast("string")
            rows = batch.persist()
            touched = [r[0] for r in rows.select(part.alias("part")).distinct().collect()]  # MEMORY_PARTS at most
            before = published.read(spark, table, touched)
            after = upsert_memory(before, rows).persist()
            content = [c for c in after.columns if c not in ("seq", "updated_seq")]
            if before is None or not after.select(content).exceptAll(before.select(content)).isEmpty():
                version = published.next_version(spark, table)
                made = published.write(after.withColumn("__part", part), table, version, "__part")
                published.publish(spark, table, version, {**published.manifest(spark, table)[0], **made}, origin=origin)
            after.unpersist()
            rows.unpersist()
        if done:
            done(batch_id)

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
