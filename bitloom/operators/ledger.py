"""Request and progress ledgers to metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import numbers as N

# Relative weights of a job's stages.
STAGE_WEIGHTS = {"parse": 14.12, "scan check": 2.45, "layout": 14.03, "paragraphs": 6.26, "formulas": 1.66, "terms": 30.0, "translate": 46.96, "typeset": 4.71, "fonts": 0.61, "write": 1.96, "subset": 0.92, "save": 6.34}


def normalize_usage(df: DataFrame, payload: str = "usage") -> DataFrame:
    """df with input, output, cached, reasoning, usage_availability from a JSON column in either of two spellings."""
    get = lambda *paths: F.coalesce(*(N.nonneg_or_null(F.get_json_object(payload, f"$.{p}").cast("double")) for p in paths))
    out = df.withColumns(
        {
            "input": get("input_tokens", "prompt_tokens"),
            "output": get("output_tokens", "completion_tokens"),
            "cached": get("input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens", "cache_read_input_tokens"),
            "reasoning": get("output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens"),
        }
    )
    both, any_ = F.col("input").isNotNull() & F.col("output").isNotNull(), F.col("input").isNotNull() | F.col("output").isNotNull()
    return out.withColumn("usage_availability", F.when(both, "complete").when(any_, "partial").otherwise("unavailable"))


def pair_calls(ledger: DataFrame) -> DataFrame:
    """One row per call of ledger (event, call_id, ts and others), whatever is repeated: first start, first finish, first usage, and whether all three are there."""
    at = lambda event, what: F.min(F.when(F.col("event") == event, F.col(what)))
    calls = ledger.where("call_id is not null").groupBy("call_id").agg(at("request_started", "ts").alias("started"), at("request_finished", "ts").alias("finished"), at("usage", "ts").alias("usage_at"))
    return calls.withColumn("complete", F.col("started").isNotNull() & F.col("finished").isNotNull() & F.col("usage_at").isNotNull())


def call_integrity(ledger: DataFrame) -> DataFrame:
    """One row: calls, and how many lack a start, a finish or a usage event; whether the three sets agree."""
    calls = pair_calls(ledger)
    lacks = lambda c: F.count_if(F.col(c).isNull())
    out = calls.agg(F.count("*").alias("calls"), lacks("started").alias("without_start"), lacks("finished").alias("without_finish"), lacks("usage_at").alias("without_usage"))
    return out.withColumn("consistent", F.col("without_start") + F.col("without_finish") + F.col("without_usage") == 0)


def _count_map(key: Column) -> Column:
    """A count map by key, from rows that are already grouped by it."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(key.isNotNull(), F.struct(key.alias("k"), F.col("n").alias("v"))))))


def request_stats(calls: DataFrame, *keys: str) -> DataFrame:
    """Per keys: attempts, succeeded, failed (not cancelled), cancelled, active, retries, repairs, average and p95 latency, visible characters.

    calls: finished, succeeded, cancelled, retry, repair (booleans), latency_ms, visible_chars.
    """
    done = F.coalesce("finished", F.lit(False))
    ok, stopped = F.coalesce("succeeded", F.lit(False)), F.coalesce("cancelled", F.lit(False))
    return calls.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        F.count_if(done & ok).alias("succeeded"),
        F.count_if(done & ~ok & ~stopped).alias("failed"),
        F.count_if(done & stopped).alias("cancelled"),
        F.count_if(~done).alias("active"),
        F.count_if(F.col("retry")).alias("retries"),
        F.count_if(F.col("repair")).alias("repairs"),
        F.round(F.avg(F.when(done, F.col("latency_ms"))), 1).alias("average_latency_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN finished THEN latency_ms END)").alias("p95_latency_ms"),
        F.sum("visible_chars").alias("visible_chars"),
    )


def count_maps(calls: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per keys a map of counts for each of the columns. Counted first, so that a map is gathered from a group's few values only."""
    out = None
    for c in columns:
        one = calls.groupBy(*keys, F.col(c).cast("string").alias("k")).agg(F.count("*").alias("n")).groupBy(*keys).agg(_count_map(F.col("k")).alias(c))
        out = one if out is None else out.join(one, keys)
    return out


def token_totals(usage: DataFrame, *keys: str) -> DataFrame:
    """Per keys: sums of known input, output, reasoning, their total, and availability. usage: prompt, completion, hit, miss, reasoning, complete."""
    parts = N.clamp_token_parts(*(F.col(c) for c in ("prompt", "completion", "hit", "miss", "reasoning")))
    rows = usage.select(*keys, *(v.alias(k) for k, v in parts.items()), "complete")
    total = F.when(F.count("input") + F.count("output") > 0, F.coalesce(F.sum("input"), F.lit(0)) + F.coalesce(F.sum("output"), F.lit(0)))
    return rows.groupBy(*keys).agg(
        F.sum("input").alias("input"), F.sum("output").alias("output"), total.alias("total"), F.sum("reasoning").alias("reasoning"),
        N.availability(F.col("input"), F.col("output"), complete=F.col("complete")).alias("availability"),
        N.availability(F.col("reasoning"), complete=F.col("complete")).alias("reasoning_availability"),
    )


def cache_rates(df: DataFrame, *keys: str, hit: str = "hit", miss: str = "miss") -> DataFrame:
    """Per keys: hits, misses and the hit rate to four digits, null without lookups."""
    sums = df.groupBy(*keys).agg(F.sum(hit).alias("hits"), F.sum(miss).alias("misses"))
    return sums.withColumn("hit_rate", N.rate(F.col("hits"), F.col("hits") + F.col("misses")))


def account_usage(accounts: DataFrame, calls: DataFrame) -> DataFrame:
    """Per account: calls, tokens (0 without calls, null where a call's are unknown), complete and unknown calls, succeeded, cancelled, first seen."""
    tokens = lambda c: F.when(F.count("call_id") == 0, F.lit(0).cast("long")).when(F.count(c) == F.count("call_id"), F.sum(c))
    return (
        accounts.select("account")
        .distinct()
        .join(calls, "account", "left")
        .groupBy("account")
        .agg(
            F.count("call_id").alias("calls"), tokens("input").alias("input"), tokens("output").alias("output"),
            F.count_if(F.col("complete")).alias("complete_calls"), F.count_if(F.col("call_id").isNotNull() & ~F.coalesce("complete", F.lit(False))).alias("unknown_calls"),
            F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "cancelled").alias("cancelled"), F.min("started").alias("first_seen"),
        )
    )


def merge_metrics(baseline: DataFrame, current: DataFrame, keys: list[str], samples: int = 200) -> DataFrame:
    """A frozen baseline and a cumulative snapshot added up: counters (unknown and known is known), count maps, samples (the last ones). Rates and p95 come from the current side, p95 only if the baseline has no calls of its own."""
    b, c = baseline.alias("b"), current.alias("c")
    rows = b.join(c, keys, "full")
    added = lambda n: F.when(F.col(f"b.{n}").isNull() & F.col(f"c.{n}").isNull(), F.lit(None)).otherwise(F.coalesce(f"b.{n}", F.lit(0)) + F.coalesce(f"c.{n}", F.lit(0))).alias(n)
    none = F.array().cast("array<double>")
    joined = F.concat(F.coalesce("b.samples", none), F.coalesce("c.samples", none))
    p95 = F.when(F.coalesce("b.attempts", F.lit(0)) == 0, F.col("c.p95")).alias("p95")
    return rows.select(*keys, *(added(n) for n in ("attempts", "succeeded", "failed", "input", "output")), N.add_counts(F.col("b.errors"), F.col("c.errors")).alias("errors"), F.slice(joined, F.greatest(F.size(joined) - samples + 1, F.lit(1)), samples).alias("samples"), p95, F.col("c.rate").alias("rate"), F.col("c.active").alias("active"))


def cost_per_1000_chars(cost: DataFrame, chars: DataFrame, *keys: str) -> DataFrame:
    """Per keys: known cost over source characters, times 1000, and how many calls' cost is unknown. cost: cost; chars: chars."""
    a = cost.groupBy(*keys).agg(F.sum("cost").alias("cost"), F.count_if(F.col("cost").isNull()).alias("unknown_calls"))
    b = chars.groupBy(*keys).agg(F.sum("chars").alias("chars"))
    return a.join(b, list(keys)).withColumn("cost_per_1000", F.try_divide(F.col("cost") * 1000, F.col("chars")))


def usage_by_stage(usage: DataFrame) -> DataFrame:
    """Calls, complete calls and token totals by stage."""
    return token_totals(usage, "stage").join(usage.groupBy("stage").agg(F.count("*").alias("calls"), F.count_if(F.col("complete")).alias("complete_calls")), "stage")


def connection_summary(trace: DataFrame) -> DataFrame:
    """Per run: requests, connects, connect and TLS seconds (null if any is unknown), failures. trace: run_id, http_status, stages (array of struct name, seconds)."""
    rows = trace.select("run_id", "request_id", "http_status", F.explode_outer("stages").alias("s"))
    sec = lambda n: F.when(F.count_if(F.col("s.name") == n) == F.count(F.when(F.col("s.name") == n, F.col("s.seconds"))), F.sum(F.when(F.col("s.name") == n, F.col("s.seconds"))))
    return rows.groupBy("run_id").agg(
        F.count_distinct("request_id").alias("requests"), F.count_if(F.col("s.name") == "connect").alias("connects"), sec("connect").alias("connect_seconds"), sec("tls").alias("tls_seconds"),
        F.count_distinct(F.when(F.col("http_status") >= 400, F.col("request_id"))).alias("http_failures"),
    )


def rolling_rates(events: DataFrame, keys: list[str], ts: str = "ts", seconds: int = 10, amount: str | None = None) -> DataFrame:
    """events with rate: rows, or a column's sum, per second over the last so many seconds, the row's own instant in it."""
    at = F.unix_timestamp(ts)
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-seconds, 0)
    return events.withColumn("rate", (F.count("*").over(w) if amount is None else F.sum(amount).over(w)) / F.lit(float(seconds)))


def usage_deltas(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """events with total (the largest value up to the row) and delta to the row before; repeats and stale values give 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("total", upto).withColumn("delta", upto - F.coalesce(before, F.lit(0)))


def live_rates(events: DataFrame, keys: list[str]) -> DataFrame:
    """events (seconds, started, paragraphs, output, complete) with requests_per_second, paragraphs_per_minute and output_per_second, as of each row.

    Starts of the last 10 seconds over 10. Paragraphs of the last 30 seconds over the time since the first event, 1 second at least
    and 30 at most; null without any. Tokens of the last 30 seconds (output: what the row adds, null if nothing) over the time since the first of
    them, 30 at most; null before a second has passed and while any usage so far is incomplete (complete: null for rows without usage).
    """
    every = Window.partitionBy(*keys).orderBy("seconds")
    recent = lambda n: every.rangeBetween(-n, 0)
    upto = every.rangeBetween(Window.unboundedPreceding, 0)
    elapsed = F.col("seconds") - F.min("seconds").over(upto)
    minute = F.sum("paragraphs").over(recent(30)) * 60.0 / F.least(F.greatest(elapsed.cast("double"), F.lit(1.0)), F.lit(30.0))
    since = (F.col("seconds") - F.min(F.when(F.col("output").isNotNull(), F.col("seconds"))).over(upto)).cast("double")
    whole = F.coalesce(F.min("complete").over(upto), F.lit(False))
    tokens = F.coalesce(F.sum("output").over(recent(29)), F.lit(0)) / F.least(since, F.lit(30.0))  # what is 30 seconds old is out
    return events.withColumns(
        {
            "requests_per_second": F.round(F.sum(F.col("started").cast("int")).over(recent(10)) / 10.0, 2),
            "paragraphs_per_minute": F.round(minute, 1),
            "output_per_second": F.when(whole & (since >= 1), F.round(tokens, 1)),
        }
    )


def stage_durations(events: DataFrame, keys: list[str], finishing: tuple[str, ...] = ()) -> DataFrame:
    """Per keys and stage the sum of end minus the latest start before it that has no end yet. events: stage, type (start, update or end), seconds, seq.

    In ``finishing`` stages an update whose current reaches its total ends the stage as well (events then have current and total).
    """
    w = Window.partitionBy(*keys, "stage").orderBy("seq")
    ended = F.col("type") == "end"
    if finishing:
        ended = ended | (F.col("stage").isin(*finishing) & (F.col("type") == "update") & F.coalesce(F.col("current") >= F.col("total"), F.lit(False)))
    rows = events.withColumn("__ended", ended).withColumn("__run", F.coalesce(F.sum(F.col("__ended").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.last(F.when(F.col("type") == "start", F.col("seconds")), ignorenulls=True).over(Window.partitionBy(*keys, "stage", "__run").orderBy("seq"))
    ends = rows.withColumn("__begun", start).where("__ended and __begun is not null")
    return ends.groupBy(*keys, "stage").agg(F.sum(F.col("seconds") - F.col("__begun")).alias("seconds"), F.count("*").alias("spans"))


def eta(progress: DataFrame, keys: list[str], window: int = 30, least_seconds: int = 15, least_percent: float = 2.0) -> DataFrame:
    """progress (seconds, percent) with eta_seconds: linear from the samples of the last ``window`` seconds. Null before 15 s or 2 %, and where nothing advanced."""
    w = Window.partitionBy(*keys).orderBy("seconds").rangeBetween(-window, 0)
    start = F.min("seconds").over(Window.partitionBy(*keys))
    d_percent, d_seconds = F.col("percent") - F.first("percent").over(w), F.col("seconds") - F.first("seconds").over(w)
    ok = (F.col("seconds") - start >= least_seconds) & (F.col("percent") >= least_percent) & (d_percent > 0) & (d_seconds > 0)
    return progress.withColumn("eta_seconds", F.when(ok, (100.0 - F.col("percent")) * d_seconds / F.when(d_percent > 0, d_percent)))


def weighted_progress(stages: DataFrame, keys: list[str], weights: dict[str, float] | None = None, part: str | None = None, parts: int = 1) -> DataFrame:
    """Per keys the overall percent from stages (stage, current, total), weights made to add up to 100; unknown stages weigh nothing. With a column that tells ``parts`` parts, all parts share equally, and those without rows have not begun."""
    weights = STAGE_WEIGHTS if weights is None else weights
    total = sum(weights.values())
    weight = F.coalesce(F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, 100.0 * v / total)))[F.col("stage")], F.lit(0.0))
    share = F.coalesce(F.least(F.greatest(F.try_divide(F.col("current").cast("double"), F.col("total")), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    best = stages.groupBy(*keys, *([part] if part else []), "stage").agg(F.max(share).alias("share"))
    return best.groupBy(*keys).agg(F.least(F.lit(100.0), F.sum(weight * F.col("share")) / F.lit(parts)).alias("percent"))


def trim_budget(df: DataFrame, keys: list[str], priority: str, seq: str, size: str, max_bytes: int, max_rows: int) -> DataFrame:
    """df with kept: highest priority, then newest, while the sizes and the rows add up to no more than the budget."""
    w = Window.partitionBy(*keys).orderBy(F.desc(priority), F.desc(seq)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("kept", (F.sum(size).over(w) <= max_bytes) & (F.count("*").over(w) <= max_rows))


def trim_evidence(records: DataFrame, keys: list[str], max_bytes: int, max_rows: int, executions: int = 32) -> tuple[DataFrame, DataFrame]:
    """(kept, omitted) of records (execution_id, kind, priority, seq, size): per keys the newest executions with what is theirs, and of that, after all execution rows, the highest priority, then the newest, within bytes and rows. omitted: by keys how many executions, requests and paragraphs are left out.

    Ranks come from windows over the few execution rows and from running sums; nothing is gathered.
    """
    runs = records.where("kind = 'execution'")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))
    live = runs.withColumn("__n", nth).where(F.col("__n") <= executions).select(*keys, "execution_id")
    own = records.join(live, [*keys, "execution_id"], "left_semi")
    w = Window.partitionBy(*keys).orderBy((F.col("kind") != "execution"), F.desc("priority"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = own.withColumn("__kept", (F.col("kind") == "execution") | ((F.sum("size").over(w) <= max_bytes) & (F.count("*").over(w) <= max_rows)))
    gone = ranked.where(~F.col("__kept")).groupBy(*keys).agg(F.count_if(F.col("kind") == "request").alias("omitted_requests"), F.count_if(F.col("kind") != "request").alias("omitted_paragraphs"))
    old = runs.groupBy(*keys).agg(F.greatest(F.count("*") - executions, F.lit(0)).alias("omitted_executions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    omitted = old.join(gone, keys, "full").select(*keys, zero("omitted_executions"), zero("omitted_requests"), zero("omitted_paragraphs"))
    return ranked.where("__kept").drop("__kept"), omitted


def iso_to_ts(col: Column) -> Column:
    """An ISO 8601 string as a timestamp; null for anything else."""
    return F.try_to_timestamp(col)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def keyset_page(df: DataFrame, limit: int, after: tuple | None = None, at: str = "created", key: str = "id") -> DataFrame:
    """The newest rows strictly below a cursor, one more than the limit, which tells that there are more."""
    rows = df if after is None else df.where(F.struct(at, key) < F.struct(F.lit(after[0]).cast(df.schema[at].dataType), F.lit(after[1]).cast(df.schema[key].dataType)))
    return rows.orderBy(F.desc(at), F.desc(key)).limit(limit + 1)


def bucket_ledger(calls: DataFrame, ts: str = "ts", width: str = "5 minutes", seconds: int = 300, amount: str = "tokens") -> DataFrame:
    """(bucket_start, requests, amount): by tumbling buckets, empty ones between the first and the last as zeros."""
    by = calls.groupBy(F.window(ts, width)["start"].alias("bucket_start")).agg(F.count("*").alias("requests"), F.sum(amount).alias(amount))
    ends = by.agg(F.min("bucket_start").alias("a"), F.max("bucket_start").alias("b"))
    every = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.make_dt_interval(secs=F.lit(seconds)))).alias("bucket_start"))
    return every.join(by, "bucket_start", "left").select("bucket_start", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce(amount, F.lit(0)).alias(amount))


def session_activity(events: DataFrame, keys: list[str], ts: str = "ts", gap: str = "30 seconds") -> DataFrame:
    """Per keys the stretches of activity that no gap interrupts, with their first and last event and number of events."""
    s = events.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("first_event"), F.max(ts).alias("last_event"))
    return s.drop("w")


def phase_seconds(created: Column, started: Column, finished: Column) -> tuple[Column, Column, Column]:
    """(queue, execution, total) seconds between timestamps; null where an end is unknown."""
    sec = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)
    return sec(created, started), sec(started, finished), sec(created, finished)
