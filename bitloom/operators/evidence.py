"""Evidence of what happened in jobs: links between failures and requests, orphans, findings, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import text as T

REFERENCES = 16
FINDINGS = 2000


def redact_fields(df: DataFrame, contract: dict[str, dict]) -> DataFrame:
    """The fields that a contract lists, each value kept only if it is of its kind, with rejected_values and filtered_fields counted.

    contract: field to {"kind": number | flag | enum | label | id, "values": [...], "pattern": "..."}.
    """
    kept, rejected = [], F.lit(0)
    for name, rule in contract.items():
        if name not in df.columns:
            continue
        c, kind = F.col(name), rule["kind"]
        ok = {
            "number": lambda c=c: ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")),
            "flag": lambda c=c: c.cast("boolean").isNotNull(),
            "enum": lambda c=c, rule=rule: c.isin(*rule["values"]),
            "label": lambda c=c: T.safe_label(c),
            "id": lambda c=c, rule=rule: c.rlike(rule["pattern"]),
        }[kind]()
        ok = F.coalesce(ok, F.lit(False))
        kept.append(F.when(ok, c).alias(name))
        rejected = rejected + (c.isNotNull() & ~ok).cast("int")
    return df.select(*kept, rejected.alias("rejected_values"), F.lit(len([c for c in df.columns if c not in contract])).alias("filtered_fields"))


def bounded_list(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = REFERENCES) -> DataFrame:
    """Per keys the last n values in order and how many are left out. Ranks first, so that only n rows of a key are ever gathered."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    ranked = df.withColumn("__n", F.row_number().over(w))
    total = df.groupBy(*keys).agg(F.count("*").alias("__total"))
    row = F.struct(-F.col("__n"), F.col(value).alias("v"))
    some = ranked.where(F.col("__n") <= n).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]).alias("last"))
    return some.join(total, keys).select(*keys, "last", F.greatest(F.col("__total") - n, F.lit(0)).alias("omitted"))


def link_failures(failed: DataFrame, requests: DataFrame, n: int = REFERENCES) -> DataFrame:
    """Failed paragraphs (task_id, attempt, paragraph_ref) with the last calls of their attempt that name them, how many are left out, and whether the failure is only known from requests.

    requests: task_id, attempt, call_id, seq, paragraph_refs (array), failed.
    """
    key = ["task_id", "attempt", "paragraph_ref"]
    edges = requests.select("task_id", "attempt", "call_id", "seq", "failed", F.explode("paragraph_refs").alias("paragraph_ref"))
    calls = bounded_list(edges, key, ["seq", "call_id"], "call_id", n)
    lost = edges.groupBy(*key).agg(F.bool_and("failed").alias("all_failed")).where("all_failed").join(failed, key, "left_anti").select(*key, F.lit(True).alias("synthesized"))
    rows = failed.select(*key, F.lit(False).alias("synthesized")).unionByName(lost)
    none = F.array().cast("array<string>")
    out = rows.join(calls, key, "left")
    return out.select(*key, "synthesized", F.coalesce(F.col("last").cast("array<string>"), none).alias("call_ids"), F.coalesce("omitted", F.lit(0)).alias("omitted"))


def orphan_references(requests: DataFrame, executions: DataFrame) -> DataFrame:
    """(call_id, problem): a parent call or an execution that is not there. requests: call_id, parent_call_id, execution_id."""
    calls = requests.select(F.col("call_id").alias("parent_call_id")).distinct()
    parents = requests.where("parent_call_id is not null").join(calls, "parent_call_id", "left_anti").select("call_id", F.lit("parent_missing").alias("problem"))
    lost = requests.where("execution_id is not null").join(executions.select("execution_id").distinct(), "execution_id", "left_anti").select("call_id", F.lit("execution_missing").alias("problem"))
    return parents.unionByName(lost)


def findings(tasks: DataFrame, requests: DataFrame, paragraphs: DataFrame, cap: int = FINDINGS) -> DataFrame:
    """(task_id, code, count, omitted): what the rules find in each task, at most ``cap`` findings of a task.

    tasks: task_id, status, evidence. requests: task_id, status_code, failed, cache_hit. paragraphs: task_id, status, validation_code.
    """
    rule = lambda df, when, code: df.where(when).groupBy("task_id").agg(F.count("*").alias("count")).withColumn("code", F.lit(code))
    every = [
        rule(paragraphs, "validation_code is not null", "validation_failed"),
        rule(requests, "failed and status_code = 429", "provider_rate_limited"),
        rule(requests, "failed and coalesce(status_code, 0) <> 429", "provider_failed"),
        rule(tasks, "status = 'interrupted'", "interrupted"),
        rule(paragraphs, "status = 'failed'", "paragraph_unresolved"),
        rule(requests, "cache_hit", "cache_reused"),
        rule(tasks, "evidence = 'partial'", "evidence_incomplete"),
        rule(tasks, "evidence = 'unavailable'", "evidence_unavailable"),
    ]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    run = F.sum("count").over(Window.partitionBy("task_id").orderBy("code").rowsBetween(Window.unboundedPreceding, -1))
    left = F.greatest(F.lit(cap) - F.coalesce(run, F.lit(0)), F.lit(0))
    return out.withColumn("__left", left).select("task_id", "code", F.least("count", "__left").alias("count"), F.greatest(F.col("count") - F.col("__left"), F.lit(0)).alias("omitted"))


def evidence_status(evidence: DataFrame, executions: DataFrame) -> DataFrame:
    """Per task: interrupted if any execution was; available, partial, missing or unavailable. evidence: task_id, kind, complete; executions: task_id, state, recorded."""
    e = executions.groupBy("task_id").agg(F.bool_or(F.col("state") == "interrupted").alias("interrupted"), F.bool_or("recorded").alias("recorded"))
    rows = evidence.groupBy("task_id").agg(F.count("*").alias("n"), F.bool_and("complete").alias("all_complete"))
    out = e.join(rows, "task_id", "full")
    status = F.when(~F.coalesce("recorded", F.lit(False)), "unavailable").when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("all_complete") & ~F.coalesce("interrupted", F.lit(False)), "available").otherwise("partial")
    return out.select("task_id", F.coalesce("interrupted", F.lit(False)).alias("interrupted"), status.alias("evidence"))


def text_request_error(df: DataFrame) -> Column:
    """The code of what is wrong with a request row (text, context, source_lang, target_lang, mode, page); null for a valid one."""
    c = F.col
    return (
        F.when(c("text").isNull() | (F.trim("text") == ""), "text_required")
        .when(F.length("text") > 20_000, "text_too_long")
        .when(F.length("context") > 12_000, "context_too_long")
        .when((F.length("source_lang") > 128) | (F.length("target_lang") > 128) | c("target_lang").isNull(), "invalid_language")
        .when(~F.coalesce(c("mode").isin("word", "sentence", "paragraph"), F.lit(False)), "invalid_mode")
        .when(c("page") < 1, "invalid_page")
    )
