"""Streams replayed from files, in order and shuffled, against what a batch would give."""

import json
import os
import random
import tempfile
import time

from pyspark.sql import functions as F

from bitloom.operators import memory
from bitloom.streaming import streams as S


def replay(spark, rows, schema, make, parts=3, mode="update"):
    """The stream's results over all batches, and the number of the batch each comes from."""
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    for k in range(parts):
        with open(f"{folder}/{k}.json", "w") as f:
            f.write("\n".join(json.dumps(r) for r in rows[k::parts]))
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/*.json")
    out = []
    query = make(frame).writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend((i, r) for r in b.collect())).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return out


FEED = "server string, generation long, revision long, task_id string, type string, status string, attempt int"


def test_task_feed_is_the_same_in_any_order(spark):
    events = [(1, 1, "t", "task", "queued", 1), (1, 2, "t", "task", "running", 1), (1, 3, "t", "deleted", None, 1), (1, 4, "u", "task", "done", 2), (1, 5, "u", "task", "running", 1), (2, 1, "t", "task", "queued", 1), (1, 9, "t", "task", "late", 5), (2, 2, "v", "task", "queued", 1)]
    names = ["generation", "revision", "task_id", "type", "status", "attempt"]
    for seed in range(3):
        shuffled = [dict(zip(names, e, strict=True), server="s") for e in events]
        random.Random(seed).shuffle(shuffled)
        last = {r["task_id"]: (r["generation"], r["status"], r["deleted"]) for _, r in replay(spark, shuffled, FEED, S.snapshot_upsert)}
        assert last["t"] == (2, "queued", False) and last["v"] == (2, "queued", False) and last["u"] == (1, None, True)


def test_a_new_instance_retires_all_tasks_of_its_server(spark):
    names = ["server", "generation", "revision", "task_id", "type", "status", "attempt"]
    feed = [("s", 1, 7, "a", "task", "running", 1), ("r", 1, 2, "a", "task", "running", None), ("s", 1, 8, "b", "deleted", None, None), ("s", 1, 9, "c", "task", "running", 1), ("s", 2, 1, "z", "task", "queued", 1), ("s", 1, 99, "c", "task", "late", 9)]
    got = replay(spark, [dict(zip(names, e, strict=True)) for e in feed], FEED, S.snapshot_upsert, parts=6)
    last = {(r["server"], r["task_id"]): (r["generation"], r["status"], r["deleted"]) for _, r in got}
    assert last == {("s", "a"): (1, None, True), ("r", "a"): (1, "running", False), ("s", "b"): (1, None, True), ("s", "c"): (1, None, True), ("s", "z"): (2, "queued", False)}
    assert [r["task_id"] for i, r in got if i == 4 and r["deleted"]] == ["a", "c"]  # told with the new instance's first event


def test_usage_deltas_add_up(spark):
    rows = [{"call_id": c, "seq": i, "output": v} for c, values in (("a", (100, 200, 200, 50, 300)), ("b", (5, 4))) for i, v in enumerate(values)]
    got = replay(spark, rows, "call_id string, seq long, output long", lambda f: S.usage_delta_stream(f, None))
    for call, total in (("a", 300), ("b", 5)):
        assert sum(r["delta"] for _, r in got if r["call_id"] == call) == total == max(r["total"] for _, r in got if r["call_id"] == call)


def test_wide_usage_beside_unknown_is_exact(spark):
    rows = [{"call_id": "a", "seq": 1, "output": 2**60 + 1}, {"call_id": "a", "seq": 2, "output": None}, {"call_id": "b", "seq": 3, "output": None}]
    got = replay(spark, rows, "call_id string, seq long, output long", lambda f: S.usage_delta_stream(f, None), parts=1)
    assert sorted(tuple(r) for _, r in got) == [("a", 2**60 + 1, 2**60 + 1), ("b", 0, 0)]


def keyed_by_bucket(spark, schema, make):
    frame = make(spark.readStream.schema(schema).json(tempfile.mkdtemp(prefix="spark-stream-")))
    return "UDF(bucket#" in frame._jdf.queryExecution().analyzed().toString()


def test_many_calls_share_keys_of_the_state(spark):
    schema = "call_id string, seq long, output long"
    assert keyed_by_bucket(spark, schema, lambda f: S.usage_delta_stream(f, None))  # a call of the processor for each call_id took milliseconds
    name = lambda i: None if i == 7 else "" if i == 8 else f"c{i}"
    rows = [{"call_id": name(i), "seq": n, "output": 2**60 + n * i if i % 5 else None} for n in (1, 2, 0) for i in range(2000)]
    deltas, totals = {}, {}
    for _, r in replay(spark, rows, schema, lambda f: S.usage_delta_stream(f, None)):
        deltas[r["call_id"]] = deltas.get(r["call_id"], 0) + r["delta"]
        totals[r["call_id"]] = max(totals.get(r["call_id"], 0), r["total"])
    assert deltas == totals == {name(i): 2**60 + 2 * i if i % 5 else 0 for i in range(2000)}


class Live:
    """A stream that files are added to while it runs, with a trigger of short intervals."""

    def __init__(self, spark, schema, make, mode="update"):
        self.folder, self.out = tempfile.mkdtemp(prefix="spark-live-"), []
        frame = spark.readStream.schema(schema).json(f"{self.folder}/*.json")
        sink = make(frame).writeStream.outputMode(mode).foreachBatch(lambda b, i: self.out.extend(b.collect()))
        self.query = sink.option("checkpointLocation", f"{self.folder}/log").trigger(processingTime="200 milliseconds").start()
        self.files = 0

    def send(self, *rows):
        with open(f"{self.folder}/.{self.files}", "w") as f:
            f.write("\n".join(json.dumps(r) for r in rows))
        os.rename(f"{self.folder}/.{self.files}", f"{self.folder}/{self.files}.json")
        self.files += 1

    def wait(self, n, seconds=60):
        end = time.time() + seconds
        while len(self.out) < n and time.time() < end:
            time.sleep(0.1)
        assert len(self.out) >= n, (self.out, self.query.exception())
        return [tuple(r) for r in self.out]


def test_idle_calls_are_forgotten_each_on_its_own(spark):
    live = Live(spark, "call_id string, seq long, output long", lambda f: S.usage_delta_stream(f, "24 seconds"))
    try:
        row = lambda c, v: {"call_id": c, "seq": 1, "output": v}
        live.send(row("first", 1))
        live.wait(1)  # the first batch is slow, and time runs from a batch's start
        live.send(row("a", 5), row("b", 5))
        assert sorted(live.wait(3)[1:]) == [("a", 5, 5), ("b", 5, 5)]
        time.sleep(12)
        live.send(row("b", 4))
        assert live.wait(4)[3] == ("b", 5, 0)
        time.sleep(14)
        live.send(row("a", 3), row("b", 6))
        assert sorted(live.wait(6)[4:]) == [("a", 3, 3), ("b", 6, 1)]
    finally:
        live.query.stop()


def test_progress_rises_ends_and_stalls(spark):
    live = Live(spark, "task_id string, seq long, percent double, terminal boolean", lambda f: S.progress_stream(f, "3 seconds"))
    try:
        row = lambda t, seq, p, end=False: {"task_id": t, "seq": seq, "percent": p, "terminal": end}
        live.send(row("a", 1, 10.0), row("a", 3, 120.0), row("a", 2, 5.0), row("b", 1, 50.0), row("b", 2, None, True))
        assert sorted(live.wait(2)) == [("a", 3, 99.0, False), ("b", 2, 100.0, False)]
        assert live.wait(3)[2] == ("a", 3, 99.0, True)  # the timer; none for what has ended
        live.send(row("a", 3, 1.0), row("b", 9, 1.0), row("a", 4, None, True))
        assert live.wait(4)[3:] == [("a", 4, 100.0, False)]
        time.sleep(4)
        assert len(live.out) == 4
    finally:
        live.query.stop()


def test_early_cancels_are_forgotten_in_time(spark):
    live = Live(spark, "request_id string, type string, seq long", lambda f: S.early_cancel(f, "25 seconds"), "append")
    try:
        live.send(*({"request_id": r, "type": k, "seq": i} for i, (r, k) in enumerate([("a", "cancel"), ("b", "request"), ("c", "cancel"), ("b", "cancel"), ("d", "cancel"), ("d", "request")])))
        assert sorted(live.wait(3)) == [("b", "cancelled"), ("b", "running"), ("d", "suppressed")]
        live.send({"request_id": "a", "type": "request", "seq": 9})
        assert live.wait(4)[3] == ("a", "suppressed")
        time.sleep(26)
        live.send({"request_id": "c", "type": "request", "seq": 10})
        assert live.wait(5)[4] == ("c", "running")  # its cancel is too long ago
    finally:
        live.query.stop()


def test_paragraph_states_over_batches(spark):
    kinds = [("p", "pending"), ("q", "pending"), ("p", "succeeded"), ("r", "skipped"), ("p", "pending"), (None, "finish"), ("r", "pending"), ("p", "review_failed"), ("z", "failed")]
    rows = [{"doc_id": 2**60 + 1, "paragraph_id": p, "seq": i, "type": k, "reason": "why" if k == "failed" else None} for i, (p, k) in enumerate(kinds)]
    schema = "doc_id long, paragraph_id string, seq long, type string, reason string"
    want = {"p": ("failed", "quality_review_failed"), "q": ("failed", "paragraph_not_completed"), "r": ("skipped", None), "z": ("failed", "why")}
    ordered = [rows[k::9][0] for k in range(9)]
    for parts in (1, 9):
        got = replay(spark, ordered, schema, S.checkpoint_documents, parts=parts)
        assert {r["paragraph_id"]: (r["status"], r["reason"]) for _, r in got} == want and {r["doc_id"] for _, r in got} == {2**60 + 1}
    own = replay(spark, [r for r in ordered if r["paragraph_id"]], schema, S.checkpoint_state, parts=4)
    last = {r["paragraph_id"]: (r["status"], r["reason"]) for _, r in own}
    assert last["q"] == ("pending", None) and last["p"] == want["p"] and last["z"] == want["z"]


def test_many_documents_share_keys_of_the_state(spark):
    schema = "doc_id long, paragraph_id string, seq long, type string, reason string"
    for make in (S.checkpoint_documents, S.checkpoint_state):
        assert keyed_by_bucket(spark, schema, make)  # a call of the processor for each document took milliseconds
    event = lambda i, p, n, kind: {"doc_id": None if i == 0 else 2**60 + i, "paragraph_id": p, "seq": n, "type": kind, "reason": "why" if kind == "failed" else None}
    first = [event(i, p, 2**60 + n, kind) for i in range(700) for n, (p, kind) in enumerate([("p", "pending"), ("q", "pending"), ("q", "succeeded"), ("r", "failed")])]
    then = [event(i, *e) for i in range(700) if i % 2 for e in ((None, 2**60 + 8, "finish"), ("q", None, "skipped"), ("q", 2**60 + 9, "review_failed"))]
    rows = [r for pair in zip(first, then + [then[0]] * (len(first) - len(then)), strict=True) for r in pair]  # the two halves as two batches; a finish that comes again changes nothing
    ended = {"p": ("failed", "paragraph_not_completed"), "q": ("skipped", None), "r": ("failed", "why")}
    going = {"p": ("pending", None), "q": ("succeeded", None), "r": ("failed", "why")}
    want = {(None if i == 0 else 2**60 + i, p, *v) for i in range(700) for p, v in (ended if i % 2 else going).items()}
    for parts in (1, 5):
        last = {}
        for _, r in replay(spark, rows, schema, lambda f, parts=parts: S.checkpoint_documents(f, parts), parts=2):
            last[r["doc_id"], r["paragraph_id"]] = (r["status"], r["reason"])
        assert {(*k, *v) for k, v in last.items()} == want


def test_calls_join_their_finish_or_come_out_unfinished(spark):
    t = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}"
    rows = [{"call_id": c, "ts": t(s), "event": e, "succeeded": True if e == "f" else None} for c, s, e in [("a", 0, "s"), ("b", 1, "s"), ("a", 9, "f"), ("x", 3000, "s"), ("x", 3001, "f"), ("y", 3500, "s"), ("y", 3501, "f")]]
    both = lambda f: S.join_calls_stream(f.where("event = 's'"), f.where("event = 'f'"), "2 minutes")
    got = replay(spark, rows, "call_id string, ts timestamp, event string, succeeded boolean", both, parts=7, mode="append")
    assert {r["call_id"]: r["succeeded"] for _, r in got} == {"a": True, "b": None, "x": True, "y": True}


def test_rates_over_sliding_windows(spark):
    rows = [{"ts": f"2024-01-01T00:00:{i:02d}", "output": 30 if i < 9 else None, "complete": i != 5, "paragraphs": 1} for i in range(10)]
    schema = "ts timestamp, output long, complete boolean, paragraphs long"
    last = {}
    for _, r in replay(spark, rows, schema, lambda f: S.sliding_rate(f, 10, "5 seconds", "output"), parts=1):
        last[r["window"]["start"].second] = r["rate"]
    assert last[0] == 27.0 and last[5] == 12.0
    last = {r["window"]["start"].second: (r["output_per_second"], r["paragraphs_per_minute"]) for _, r in replay(spark, rows, schema, lambda f: S.throughput_stream(f, 4, "2 seconds"), parts=1)}
    assert last[0] == (30.0, 60.0) and last[4] == (None, 60.0) and last[6] == (22.5, 60.0)


def test_checkpoint_states():
    def walk(*kinds):
        now = (None, None)
        for k in kinds:
            now = S.next_state(now, k, None)
        return now

    assert walk("pending", "succeeded", "pending") == ("succeeded", None) and walk("pending", "finish") == ("failed", "paragraph_not_completed")
    assert walk("skipped", "pending") == ("skipped", None) and walk("pending", "succeeded", "review_failed") == ("failed", "quality_review_failed") and walk("pending", "failed", "pending") == ("pending", None)


def test_windowed_metrics_equal_the_batch(spark):
    rows = [{"ts": f"2024-01-01T00:0{i % 4}:{i % 60:02d}", "event": "request_finished", "provider": "p", "model": "m", "succeeded": i % 3 > 0, "cancelled": i % 6 == 0, "latency_ms": float(i), "input": None, "output": None, "hit": None, "miss": None} for i in range(40)]
    schema = "ts timestamp, event string, provider string, model string, succeeded boolean, cancelled boolean, latency_ms double, input long, output long, hit long, miss long"
    got = replay(spark, rows, schema, lambda f: S.live_request_metrics(f, "1 hour"), parts=2)
    last = {}
    for i, r in got:
        last[r["window"]["start"]] = (r["succeeded"], r["failed"], r["cancelled"])
    assert sum(v[0] for v in last.values()) == 26 and sum(v[1] for v in last.values()) == 7 and sum(v[2] for v in last.values()) == 7


def test_memory_sync_is_idempotent(spark):
    folder = tempfile.mkdtemp(prefix="spark-memory-")
    schema = "doc_fingerprint string, target_lang string, page int, paragraph_id string, source string, translation string, reading string, status string, quality string, seq long"
    base = {"doc_fingerprint": "d", "target_lang": "fr", "page": 1, "reading": None, "status": "succeeded", "quality": None}
    rows = [{**base, "paragraph_id": f"p{i % 3}", "source": f"source {i % 3}", "translation": f"t{i}", "seq": i} for i in range(6)]
    for k in range(2):
        with open(f"{folder}/{k}.json", "w") as f:
            f.write("\n".join(json.dumps(r) for r in rows[k * 3 : k * 3 + 3]))
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/*.json")
    S.sync_memory_stream(frame, f"{folder}/table", f"{folder}/log").awaitTermination()
    table = spark.read.parquet(f"{folder}/table/generation=1")
    assert sorted((r["paragraph_id"], r["translation"]) for r in table.collect()) == [("p0", "t3"), ("p1", "t4"), ("p2", "t5")]
    again = memory.upsert_memory(table, spark.read.schema(schema).json(f"{folder}/1.json"))
    assert again.count() == 3 and again.agg(F.max("translation")).first()[0] == "t5"
