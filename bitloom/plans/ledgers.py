"""Queries on events, orders, line items and customers as request and progress ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import numbers as N
from bitloom.functions import text as T
from bitloom.operators import evidence as V
from bitloom.operators import ledger as L


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def _event_ledger(spark, d) -> DataFrame:
    """Orders as started calls, line items as finished calls and usage: each with the events that the rows stand for."""
    start = table(spark, d, "orders").where("o_orderkey % 11 <> 0").select(F.lit("request_started").alias("event"), F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").alias("ts"))
    items = table(spark, d, "lineitem")
    finish = items.select(F.lit("request_finished").alias("event"), F.col("l_orderkey").alias("call_id"), F.col("l_shipdate").alias("ts"))
    usage = items.where("l_quantity > 5").select(F.lit("usage").alias("event"), F.col("l_orderkey").alias("call_id"), F.col("l_shipdate").alias("ts"))
    return start.unionByName(finish).unionByName(usage)


_EVENTS_SQL = """led AS (
  SELECT 'request_started' AS event, o_orderkey AS call_id, o_orderdate AS ts FROM orders WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT 'request_finished', l_orderkey, l_shipdate FROM lineitem UNION ALL SELECT 'usage', l_orderkey, l_shipdate FROM lineitem WHERE l_quantity > 5),
calls AS (SELECT call_id, min(ts) FILTER (WHERE event = 'request_started') AS started, min(ts) FILTER (WHERE event = 'request_finished') AS finished, min(ts) FILTER (WHERE event = 'usage') AS usage_at FROM led GROUP BY call_id)"""


def call_pairs(spark, d):
    return L.pair_calls(_event_ledger(spark, d))


CALL_PAIRS_SQL = f"WITH {_EVENTS_SQL} SELECT *, started IS NOT NULL AND finished IS NOT NULL AND usage_at IS NOT NULL AS complete FROM calls"


def call_integrity(spark, d):
    return L.call_integrity(_event_ledger(spark, d))


CALL_INTEGRITY_SQL = f"""
WITH {_EVENTS_SQL}, n AS (SELECT count(*) AS calls, count(*) FILTER (WHERE started IS NULL) AS without_start, count(*) FILTER (WHERE finished IS NULL) AS without_finish, count(*) FILTER (WHERE usage_at IS NULL) AS without_usage FROM calls)
SELECT *, without_start + without_finish + without_usage = 0 AS consistent FROM n
"""


def _calls(spark, d) -> DataFrame:
    """Events as calls: errors fail, sign-ups are cancelled, views of high codes are still active."""
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        "event_id", "ts", "user_id", "event_type", (~((kind == "view") & (_code() > 95))).alias("finished"), (~kind.isin("error", "signup")).alias("succeeded"), (kind == "signup").alias("cancelled"),
        (_code() % 10 == 0).alias("retry"), (_code() % 25 == 0).alias("repair"), F.col("value").alias("latency_ms"), F.when(kind == "click", _code()).alias("visible_chars"), (_code() % 5).alias("code"),
    )


def request_stats(spark, d):
    return L.request_stats(_calls(spark, d), "code")


def request_stats_by_kind(spark, d):
    return L.request_stats(_calls(spark, d), "event_type")


def _stats_sql(key: str) -> str:
    return f"""
WITH c AS (
  SELECT event_type, k % 5 AS code, NOT (event_type = 'view' AND k > 95) AS finished, event_type NOT IN ('error', 'signup') AS ok, event_type = 'signup' AS stopped, k, value, CASE WHEN event_type = 'click' THEN k END AS v
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))
SELECT {key}, count(*) AS attempts, count(*) FILTER (WHERE finished AND ok) AS succeeded, count(*) FILTER (WHERE finished AND NOT ok AND NOT stopped) AS failed, count(*) FILTER (WHERE finished AND stopped) AS cancelled,
  count(*) FILTER (WHERE NOT finished) AS active, count(*) FILTER (WHERE k % 10 = 0) AS retries, count(*) FILTER (WHERE k % 25 = 0) AS repairs, round(avg(value) FILTER (WHERE finished), 1) AS average_latency_ms,
  quantile_disc(value, 0.95) FILTER (WHERE finished) AS p95_latency_ms, sum(v)::BIGINT AS visible_chars
FROM c GROUP BY {key}
"""


def request_count_maps(spark, d):
    maps = L.count_maps(_calls(spark, d), ["code"], ["event_type", "cancelled"])
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return maps.select("code", flat("event_type").alias("event_types"), flat("cancelled").alias("cancelled"))


COUNT_MAPS_SQL = """
WITH c AS (SELECT json_extract_string(props, '$.k')::INT % 5 AS code, event_type, (event_type = 'signup')::VARCHAR AS cancelled FROM events),
a AS (SELECT code, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS event_types FROM (SELECT code, event_type, count(*) AS n FROM c GROUP BY ALL) GROUP BY code),
b AS (SELECT code, string_agg(cancelled || '=' || n, ',' ORDER BY cancelled) AS cancelled FROM (SELECT code, cancelled, count(*) AS n FROM c GROUP BY ALL) GROUP BY code)
SELECT * FROM a JOIN b USING (code)
"""


def _usage(spark, d) -> DataFrame:
    """Line items as usage: quantities as tokens, some of them unknown."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_returnflag", "l_suppkey", "l_orderkey", (F.col("l_partkey") % 4).alias("stage"), F.when(n != 3, q * 10).alias("prompt"), F.when(n != 5, q * 3).alias("completion"), F.when(n % 2 == 0, F.col("l_partkey") % 600).alias("hit"),
        F.when(n % 4 == 1, F.col("l_partkey") % 300).alias("miss"), F.when(F.col("l_returnflag") != "R", q * 4).alias("reasoning"), (n < 6).alias("complete"),
    )


def token_totals(spark, d):
    return L.token_totals(_usage(spark, d), "l_returnflag")


def token_totals_by_order(spark, d):
    return L.token_totals(_usage(spark, d), "l_orderkey")


def usage_by_stage(spark, d):
    return L.usage_by_stage(_usage(spark, d))


def _tokens_sql(key: str, more: str = "") -> str:
    return f"""
WITH u AS (SELECT *, l_partkey % 4 AS stage, CASE WHEN l_linenumber <> 3 THEN l_quantity * 10 END::BIGINT AS i, CASE WHEN l_linenumber <> 5 THEN l_quantity * 3 END::BIGINT AS o, CASE WHEN l_returnflag <> 'R' THEN l_quantity * 4 END::BIGINT AS r0, l_linenumber < 6 AS c FROM lineitem),
v AS (SELECT *, CASE WHEN r0 IS NOT NULL AND o IS NOT NULL THEN least(r0, o) ELSE r0 END AS r FROM u)
SELECT {key}, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output, CASE WHEN count(i) + count(o) > 0 THEN (coalesce(sum(i), 0) + coalesce(sum(o), 0))::BIGINT END AS total, sum(r)::BIGINT AS reasoning,
  CASE WHEN count(i) + count(o) = 0 THEN 'unavailable' WHEN bool_and(c) AND count(i) = count(*) AND count(o) = count(*) THEN 'complete' ELSE 'partial' END AS availability,
  CASE WHEN count(r) = 0 THEN 'unavailable' WHEN bool_and(c) AND count(r) = count(*) THEN 'complete' ELSE 'partial' END AS reasoning_availability {more}
FROM v GROUP BY {key}
"""


def strict_sums(spark, d):
    rows = _usage(spark, d)
    return rows.groupBy("l_orderkey").agg(N.strict_sum(F.col("prompt")).alias("strict"), F.sum("prompt").alias("known"))


STRICT_SQL = "WITH u AS (SELECT l_orderkey, CASE WHEN l_linenumber <> 3 THEN l_quantity * 10 END AS p FROM lineitem) SELECT l_orderkey, CASE WHEN count(p) = count(*) THEN sum(p) END AS strict, sum(p) AS known FROM u GROUP BY 1"


def cache_rates(spark, d):
    parts = N.clamp_token_parts(*(F.col(c) for c in ("prompt", "completion", "hit", "miss", "reasoning")))
    rows = _usage(spark, d).select("l_suppkey", parts["hit"].alias("hit"), parts["miss"].alias("miss"))
    return L.cache_rates(rows.where("hit is not null and miss is not null"), "l_suppkey")


CACHE_RATES_SQL = """
WITH u AS (SELECT l_suppkey, CASE WHEN l_linenumber <> 3 THEN l_quantity * 10 END::BIGINT AS i, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 600 END AS h, CASE WHEN l_linenumber % 4 = 1 THEN l_partkey % 300 END AS m FROM lineitem),
c AS (SELECT l_suppkey, CASE WHEN i IS NOT NULL AND h IS NOT NULL THEN least(h, i) WHEN i IS NOT NULL AND m IS NOT NULL THEN i - least(m, i) ELSE h END AS hit,
  CASE WHEN i IS NOT NULL AND h IS NOT NULL THEN i - least(h, i) WHEN i IS NOT NULL AND m IS NOT NULL THEN least(m, i) ELSE m END AS miss FROM u)
SELECT l_suppkey, sum(hit)::BIGINT AS hits, sum(miss)::BIGINT AS misses, round(sum(hit)::DOUBLE / nullif(sum(hit) + sum(miss), 0), 4) AS hit_rate FROM c WHERE hit IS NOT NULL AND miss IS NOT NULL GROUP BY 1
"""


def account_usage(spark, d):
    calls = table(spark, d, "events").select(
        F.col("user_id").alias("account"), F.col("event_id").alias("call_id"), F.col("ts").alias("started"), F.when(_code() % 9 != 0, _code()).alias("input"), _code().alias("output"), (_code() % 9 != 0).alias("complete"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "cancelled").otherwise("succeeded").alias("status"),
    )
    return L.account_usage(table(spark, d, "customer").select(F.col("c_custkey").alias("account")), calls)


ACCOUNT_USAGE_SQL = """
WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)
SELECT c_custkey AS account, count(event_id) AS calls, CASE WHEN count(event_id) = 0 THEN 0 WHEN count(CASE WHEN k % 9 <> 0 THEN k END) = count(event_id) THEN sum(CASE WHEN k % 9 <> 0 THEN k END) END::BIGINT AS input,
  CASE WHEN count(event_id) = 0 THEN 0 ELSE sum(k) END::BIGINT AS output, count(*) FILTER (WHERE k % 9 <> 0) AS complete_calls, count(*) FILTER (WHERE event_id IS NOT NULL AND k % 9 = 0) AS unknown_calls,
  count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) AS succeeded, count(*) FILTER (WHERE event_type = 'signup') AS cancelled, min(ts) AS first_seen
FROM customer LEFT JOIN e ON user_id = c_custkey GROUP BY 1
"""


def rolling_rates(spark, d):
    return L.rolling_rates(table(spark, d, "events").withColumn("code", _code()), ["user_id"], "ts", 86400, "code").select("event_id", F.round("rate", 8).alias("rate"))


ROLLING_SQL = """
SELECT event_id, round(sum(json_extract_string(props, '$.k')::INT) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT - (CASE WHEN epoch(ts)::BIGINT > epoch(ts) THEN 1 ELSE 0 END) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) / 86400.0::DOUBLE, 8) AS rate FROM events
"""


def usage_deltas(spark, d):
    return L.usage_deltas(table(spark, d, "events").withColumn("code", _code()), ["user_id"], ["ts", "event_id"], "code").select("event_id", "total", "delta")


USAGE_DELTAS_SQL = """
WITH e AS (SELECT event_id, user_id, ts, json_extract_string(props, '$.k')::INT AS k FROM events),
t AS (SELECT event_id, max(k) OVER w AS total, max(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, total, total - coalesce(b, 0) AS delta FROM t
"""


def stage_durations(spark, d):
    """Views start a user's stage and clicks end it."""
    e = table(spark, d, "events").where("event_type in ('view', 'click')")
    rows = e.select("user_id", (_code() % 3).alias("stage"), F.when(F.col("event_type") == "view", "start").otherwise("end").alias("type"), F.unix_timestamp("ts").alias("seconds"), F.col("event_id").alias("seq"))
    return L.stage_durations(rows, ["user_id"])


STAGE_DURATIONS_SQL = """
WITH e AS (SELECT user_id, json_extract_string(props, '$.k')::INT % 3 AS stage, event_type, floor(epoch(ts))::BIGINT AS s, event_id FROM events WHERE event_type IN ('view', 'click')),
t AS (SELECT *, lag(event_type) OVER w AS bt, lag(s) OVER w AS bs FROM e WINDOW w AS (PARTITION BY user_id, stage ORDER BY event_id))
SELECT user_id, stage, sum(s - bs)::BIGINT AS seconds, count(*) AS spans FROM t WHERE event_type = 'click' AND bt = 'view' GROUP BY ALL
"""


def bucket_ledger(spark, d):
    return L.bucket_ledger(table(spark, d, "events").withColumn("tokens", _code()))


BUCKET_SQL = """
WITH b AS (SELECT time_bucket(INTERVAL 5 minutes, ts) AS bucket_start, count(*) AS requests, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS tokens FROM events GROUP BY 1),
every AS (SELECT unnest(generate_series((SELECT min(bucket_start) FROM b), (SELECT max(bucket_start) FROM b), INTERVAL 5 minutes)) AS bucket_start)
SELECT bucket_start, coalesce(requests, 0) AS requests, coalesce(tokens, 0) AS tokens FROM every LEFT JOIN b USING (bucket_start)
"""


def session_activity(spark, d):
    return L.session_activity(table(spark, d, "events"), ["user_id"], "ts", "6 hours")


SESSION_SQL = """
WITH t AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 hours THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM t)
SELECT user_id, count(*) AS events, min(ts) AS first_event, max(ts) AS last_event FROM s GROUP BY user_id, n
"""


def eta(spark, d):
    """A user's events as progress: its share of the user's events so far, in seconds since 2024."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    rows = table(spark, d, "events").withColumn("seconds", F.unix_timestamp("ts") - 1704067200)
    rows = rows.withColumn("percent", F.round(F.row_number().over(w.orderBy("ts", "event_id")) * 100.0 / F.count("*").over(w), 6))
    return L.eta(rows, ["user_id"], 86400, 3600, 2.0).select("event_id", F.round("eta_seconds", 3).alias("eta_seconds"))


ETA_SQL = """
WITH r AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT - 1704067200 AS s, round(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 100.0::DOUBLE / count(*) OVER (PARTITION BY user_id), 6) AS p FROM events),
t AS (SELECT *, s - first_value(s) OVER w AS ds, p - first_value(p) OVER w AS dp, min(s) OVER (PARTITION BY user_id) AS s0 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN s - s0 >= 3600 AND p >= 2 AND dp > 0 AND ds > 0 THEN (100.0::DOUBLE - p) * ds / dp END, 3) AS eta_seconds FROM t
"""


def weighted_progress(spark, d):
    names = list(L.STAGE_WEIGHTS)
    stage = F.element_at(F.array(*(F.lit(n) for n in names)), (_code() % len(names) + 1).cast("int"))
    rows = table(spark, d, "events").select("user_id", stage.alias("stage"), F.col("value").alias("current"), F.lit(100.0).alias("total"))
    return L.weighted_progress(rows, ["user_id"]).select("user_id", F.round("percent", 6).alias("percent"))


_W = list(L.STAGE_WEIGHTS.values())
PROGRESS_SQL = f"""
WITH e AS (SELECT user_id, json_extract_string(props, '$.k')::INT % {len(_W)} AS s, max(least(greatest(value / 100.0, 0), 1)) AS share FROM events GROUP BY ALL)
SELECT user_id, round(least(100, sum(share * {_W!r}[s + 1]::DOUBLE * 100 / {sum(_W)!r}::DOUBLE)), 6) AS percent FROM e GROUP BY 1
"""


def cost(spark, d):
    rates = {"input": F.lit(0.10), "cached": F.when(F.col("l_suppkey") % 5 != 0, F.lit(0.02)), "cache_write": F.lit(0.12), "output": F.lit(0.50)}
    q = F.col("l_quantity")
    usage = {"input": q * 1000, "cached": F.when(F.col("l_linenumber") % 2 == 0, q * 100), "cache_write": F.when(F.col("l_linenumber") == 1, q * 50), "output": q * 300}
    rows = table(spark, d, "lineitem").withColumn("cost", N.estimate_cost(usage, rates, F.col("l_returnflag") != "R"))
    return rows.groupBy("l_suppkey").agg(F.round(F.sum("cost"), 8).alias("known_cost"), F.count_if(F.col("cost").isNull()).alias("unknown"), F.round(N.strict_sum(F.col("cost")), 8).alias("full_cost"))


COST_SQL = """
WITH u AS (SELECT *, l_quantity * 1000 AS i, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 100 ELSE 0 END AS h, CASE WHEN l_linenumber = 1 THEN l_quantity * 50 ELSE 0 END AS w, CASE WHEN l_suppkey % 5 <> 0 THEN 0.02 END AS hr FROM lineitem),
c AS (SELECT l_suppkey, CASE WHEN l_returnflag <> 'R' THEN (i - h - w) * 0.1::DOUBLE / 1e6 + CASE WHEN h = 0 THEN 0 ELSE h * hr::DOUBLE / 1e6 END + w * 0.12::DOUBLE / 1e6 + l_quantity * 300 * 0.5::DOUBLE / 1e6 END AS cost FROM u)
SELECT l_suppkey, round(sum(cost), 8) AS known_cost, count(*) FILTER (WHERE cost IS NULL) AS unknown, round(CASE WHEN count(cost) = count(*) THEN sum(cost) END, 8) AS full_cost FROM c GROUP BY 1
"""


def cost_per_1000_chars(spark, d):
    docs = table(spark, d, "documents")
    cost = docs.select("lang", F.when(F.col("doc_id") % 7 != 0, T.word_count(F.col("text")) * F.lit(0.5) / 1e6).alias("cost"))
    out = L.cost_per_1000_chars(cost, docs.select("lang", F.length("text").alias("chars")), "lang")
    return out.select("lang", F.round("cost", 9).alias("cost"), "unknown_calls", "chars", F.round("cost_per_1000", 9).alias("cost_per_1000"))


COST_CHARS_SQL = r"""
WITH c AS (SELECT lang, CASE WHEN doc_id % 7 <> 0 THEN len(regexp_extract_all(text, '\S+')) * 0.5::DOUBLE / 1e6 END AS cost, length(text) AS n FROM documents)
SELECT lang, round(sum(cost), 9) AS cost, count(*) FILTER (WHERE cost IS NULL) AS unknown_calls, sum(n)::BIGINT AS chars, round(sum(cost) * 1000 / sum(n), 9) AS cost_per_1000 FROM c GROUP BY lang
"""


def keyset_page(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    import datetime

    return L.keyset_page(rows.where("o_orderstatus <> 'P'"), 50, (datetime.datetime(1998, 6, 1), 1000))


KEYSET_SQL = "SELECT o_orderdate AS created, o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' AND (o_orderdate < TIMESTAMP '1998-06-01' OR (o_orderdate = TIMESTAMP '1998-06-01' AND o_orderkey < 1000)) ORDER BY created DESC, id DESC LIMIT 51"


def lru_keep(spark, d):
    from bitloom.operators import memory as M

    rows = table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("kind"), F.col("ts").alias("accessed"))
    return M.lru_keep(rows, 2000, ("purchase",))


LRU_SQL = "SELECT event_id AS key, event_type AS kind, ts AS accessed FROM events WHERE event_type = 'purchase' UNION ALL (SELECT event_id, event_type, ts FROM events WHERE event_type <> 'purchase' ORDER BY ts DESC, event_id LIMIT 2000)"


def trim_budget(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").cast("int").alias("priority"), (_code() * 10).alias("size"))
    return L.trim_budget(rows, ["user_id"], "priority", "event_id", "size", 3000, 6).where("kept").groupBy("user_id").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("event_id").alias("oldest"))


TRIM_SQL = """
WITH e AS (SELECT user_id, event_id, json_extract_string(props, '$.k')::INT * 10 AS size, (event_type = 'error')::INT AS p FROM events),
t AS (SELECT *, sum(size) OVER w AS b, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY p DESC, event_id DESC ROWS UNBOUNDED PRECEDING))
SELECT user_id, count(*) AS rows, sum(size)::BIGINT AS bytes, min(event_id) AS oldest FROM t WHERE b <= 3000 AND n <= 6 GROUP BY 1
"""


# --- evidence


def link_failures(spark, d):
    """Users' errors as failed paragraphs (by code), their other events as requests that name the codes around theirs."""
    e = table(spark, d, "events")
    failed = e.where("event_type = 'error'").select(F.col("user_id").alias("task_id"), F.lit(1).alias("attempt"), (_code() % 20).cast("string").alias("paragraph_ref")).distinct()
    requests = e.where("event_type <> 'error'").select(F.col("user_id").alias("task_id"), F.lit(1).alias("attempt"), F.col("event_id").alias("call_id"), F.col("event_id").alias("seq"), F.array((_code() % 20).cast("string"), ((_code() + 1) % 20).cast("string")).alias("paragraph_refs"), F.lit(False).alias("failed"))
    return V.link_failures(failed, requests, 3).select("task_id", "paragraph_ref", F.array_join("call_ids", ",").alias("call_ids"), "omitted")


LINK_FAILURES_SQL = """
WITH e AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events),
f AS (SELECT DISTINCT user_id, (k % 20)::VARCHAR AS ref FROM e WHERE event_type = 'error'),
r AS (SELECT user_id, event_id, unnest([(k % 20)::VARCHAR, ((k + 1) % 20)::VARCHAR]) AS ref FROM e WHERE event_type <> 'error'),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, ref ORDER BY event_id DESC) AS n, count(*) OVER (PARTITION BY user_id, ref) AS total FROM r)
SELECT user_id AS task_id, ref AS paragraph_ref, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE n <= 3), '') AS call_ids, coalesce(greatest(max(total) - 3, 0), 0) AS omitted
FROM f LEFT JOIN n USING (user_id, ref) GROUP BY ALL
"""


def orphan_references(spark, d):
    """Events whose parent (an earlier number) or user is not in the tables."""
    e = table(spark, d, "events").select(F.col("event_id").alias("call_id"), F.when(F.col("event_type") == "click", F.col("event_id") - _code() * 50).alias("parent_call_id"), F.col("user_id").alias("execution_id"))
    return V.orphan_references(e, table(spark, d, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("execution_id")))


ORPHANS_SQL = """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'click' THEN event_id - json_extract_string(props, '$.k')::INT * 50 END AS parent, user_id FROM events)
SELECT event_id AS call_id, 'parent_missing' AS problem FROM e WHERE parent IS NOT NULL AND parent NOT IN (SELECT event_id FROM events)
UNION ALL SELECT event_id, 'execution_missing' FROM e WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)
"""


def findings(spark, d):
    e = table(spark, d, "events").withColumn("k", _code())
    tasks = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), F.when(F.col("c_custkey") % 9 == 0, "interrupted").otherwise("done").alias("status"), F.when(F.col("c_custkey") % 4 == 0, "partial").when(F.col("c_custkey") % 4 == 1, "unavailable").otherwise("available").alias("evidence"))
    requests = e.select(F.col("user_id").alias("task_id"), F.when(F.col("k") % 2 == 0, 429).otherwise(500).alias("status_code"), (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "view").alias("cache_hit"))
    paragraphs = e.select(F.col("user_id").alias("task_id"), F.when(F.col("k") > 90, "failed").otherwise("succeeded").alias("status"), F.when(F.col("k") > 95, "placeholder_mismatch").alias("validation_code"))
    return V.findings(tasks, requests, paragraphs, 12)


FINDINGS_SQL = """
WITH e AS (SELECT user_id AS task_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events),
f AS (
  SELECT task_id, 'validation_failed' AS code, count(*) AS n FROM e WHERE k > 95 GROUP BY 1 UNION ALL SELECT task_id, 'paragraph_unresolved', count(*) FROM e WHERE k > 90 GROUP BY 1
  UNION ALL SELECT task_id, 'provider_rate_limited', count(*) FROM e WHERE event_type = 'error' AND k % 2 = 0 GROUP BY 1 UNION ALL SELECT task_id, 'provider_failed', count(*) FROM e WHERE event_type = 'error' AND k % 2 = 1 GROUP BY 1
  UNION ALL SELECT task_id, 'cache_reused', count(*) FROM e WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT c_custkey, 'interrupted', 1 FROM customer WHERE c_custkey % 9 = 0
  UNION ALL SELECT c_custkey, 'evidence_incomplete', 1 FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'evidence_unavailable', 1 FROM customer WHERE c_custkey % 4 = 1),
r AS (SELECT *, greatest(12 - coalesce(sum(n) OVER (PARTITION BY task_id ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room FROM f)
SELECT task_id, code, least(n, room)::BIGINT AS count, greatest(n - room, 0)::BIGINT AS omitted FROM r
"""


def redact(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), "value", F.concat(F.lit("org/"), "event_type", F.lit(":v"), _code().cast("string")).alias("model"), F.concat(F.when(_code() % 2 == 0, "t-").otherwise("x "), _code().cast("string")).alias("task"), "props")
    contract = {"event_id": {"kind": "number"}, "kind": {"kind": "enum", "values": ["click", "view"]}, "value": {"kind": "number"}, "model": {"kind": "label"}, "task": {"kind": "id", "pattern": r"^t-\d+$"}}
    return V.redact_fields(rows, contract)


REDACT_SQL = """
WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS kind, value, 'org/' || event_type || ':v' || k AS model, CASE WHEN k::INT % 2 = 0 THEN 't-' || k END AS task,
  (event_type NOT IN ('click', 'view'))::INT + (k::INT % 2 <> 0)::INT AS rejected_values, 1 AS filtered_fields FROM e
"""

QUERIES = {f.__name__: f for f in (call_pairs, call_integrity, request_stats, request_stats_by_kind, request_count_maps, token_totals, token_totals_by_order, usage_by_stage, strict_sums, cache_rates, account_usage, rolling_rates, usage_deltas, stage_durations, bucket_ledger, session_activity, eta, weighted_progress, cost, cost_per_1000_chars, keyset_page, lru_keep, trim_budget, link_failures, orphan_references, findings, redact)}
SQL = {
    "call_pairs": CALL_PAIRS_SQL, "call_integrity": CALL_INTEGRITY_SQL, "request_stats": _stats_sql("code"), "request_stats_by_kind": _stats_sql("event_type"), "request_count_maps": COUNT_MAPS_SQL, "token_totals": _tokens_sql("l_returnflag"), "token_totals_by_order": _tokens_sql("l_orderkey"),
    "usage_by_stage": _tokens_sql("stage", ", count(*) AS calls, count(*) FILTER (WHERE c) AS complete_calls"), "strict_sums": STRICT_SQL, "cache_rates": CACHE_RATES_SQL, "account_usage": ACCOUNT_USAGE_SQL, "rolling_rates": ROLLING_SQL, "usage_deltas": USAGE_DELTAS_SQL, "stage_durations": STAGE_DURATIONS_SQL,
    "bucket_ledger": BUCKET_SQL, "session_activity": SESSION_SQL, "eta": ETA_SQL, "weighted_progress": PROGRESS_SQL, "cost": COST_SQL, "cost_per_1000_chars": COST_CHARS_SQL, "keyset_page": KEYSET_SQL, "lru_keep": LRU_SQL, "trim_budget": TRIM_SQL, "link_failures": LINK_FAILURES_SQL,
    "orphan_references": ORPHANS_SQL, "findings": FINDINGS_SQL, "redact": REDACT_SQL,
}
