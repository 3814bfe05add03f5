"""Steps around a user's model function: batches, validation, repair, term extraction, review."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import text as T
from bitloom.functions.groups import add_by_group
from bitloom.functions.storage import cut
from bitloom.operators.paragraphs import batch_by_budget
from bitloom.operators.terms import match_terms, vote_targets

REVIEW_CAP, REVIEW_BATCH, REQUESTS = 20, 4, 8


def quality_summary(candidates: DataFrame, *keys: str) -> DataFrame:
    """Per keys how many body candidates there are by review status; checked is passed and corrected."""
    one = lambda s: F.count_if(F.col("review") == s)
    return candidates.where(T.is_body(F.col("label"))).groupBy(*keys).agg(
        (F.count("*") - one("not_selected")).alias("selected"), (one("passed") + one("corrected")).alias("checked"), one("passed").alias("passed"), one("corrected").alias("corrected"), one("unchecked").alias("unchecked"), one("failed").alias("failed"), one("not_selected").alias("not_selected")
    )


def inspect_batch(replies: DataFrame, sources: DataFrame, lang: str = "") -> DataFrame:
    """(batch_id, row_id, source, output, code, unassigned): per source row (batch_id, row_id, source) the reply's output or what is wrong.

    replies: batch_id, reply (a JSON array of objects id, output, or one such object). An id is a whole number or its decimal
    digits as text. What names no row of the batch, and what is no object, is not assigned: unassigned says whether a batch has any.
    Codes: paragraph_count_mismatch for a row without a reply (all, if the reply is JSON of another kind), invalid_or_duplicate_paragraph_id
    for one with several, invalid_json for all rows of a reply that is none, else what validate_pair finds. A batch without a reply has invalid_json.
    """
    body = T.clean_json(T.strip_reasoning(F.col("reply")))
    listed = F.from_json(F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body), "array<string>")
    read = replies.select("batch_id", F.try_parse_json(body).isNotNull().alias("json"), listed.alias("items"))
    items = read.select("batch_id", F.explode("items").alias("item"))
    told = F.get_json_object("item", "$.id")
    # a whole number, quoted or not; true, 1.0 and the like are none
    rows = items.select("batch_id", F.when(F.coalesce(F.col("item").startswith("{"), F.lit(False)) & told.rlike("^[0-9]{1,18}$"), told.cast("long")).alias("row_id"), F.get_json_object("item", "$.output").alias("output"))
    known = sources.select("batch_id", F.col("row_id").cast("long").alias("row_id"), F.lit(True).alias("known")).distinct()
    placed = cut(rows.join(known, ["batch_id", "row_id"], "left"))
    odd = placed.groupBy("batch_id").agg(F.bool_or(F.col("known").isNull()).alias("unassigned"))
    one = placed.where("known").groupBy("batch_id", "row_id").agg(F.count("*").alias("n"), F.first("output").alias("output"))
    joined = sources.join(one, ["batch_id", "row_id"], "left").join(read.select("batch_id", "json"), "batch_id", "left").join(odd, "batch_id", "left")
    code = F.when(~F.coalesce("json", F.lit(False)), "invalid_json").when(F.col("n").isNull(), "paragraph_count_mismatch").when(F.col("n") > 1, "invalid_or_duplicate_paragraph_id").otherwise(T.validate_pair(F.col("source"), F.col("output"), lang))
    out = joined.withColumn("code", code)
    return out.select("batch_id", "row_id", "source", F.when(F.col("code").isNull(), T.canonicalize_placeholders(F.col("source"), F.col("output"))).alias("output"), "code", F.coalesce("unassigned", F.lit(False)).alias("unassigned"))


def repair_slots(df: DataFrame, key: str = "row_id", text: str = "source") -> DataFrame:
    """(key, slot, piece, is_token): a text cut at its placeholders; only pieces with a letter are to be translated."""
    token = T.PLACEHOLDER[4:]
    marked = F.split(F.regexp_replace(text, f"(?i)({token})", "\u0001$1\u0001"), "\u0001")
    rows = df.select(key, F.posexplode(F.filter(marked, lambda x: x != "")).alias("slot", "piece"))
    return rows.withColumn("is_token", F.col("piece").rlike(f"(?i)^(?:{token})$") | ~F.col("piece").rlike(r"\p{L}"))


def join_slots(slots: DataFrame, outputs: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, output, code): texts put together again from slots and outputs (key, slot, output), whose slots must be exactly those to be translated."""
    wanted = slots.where("not is_token").select(key, "slot")
    odd = outputs.select(key, "slot").join(wanted, [key, "slot"], "left_anti").select(key).distinct().withColumn("__odd", F.lit(True))
    rows = slots.join(outputs.groupBy(key, "slot").agg(F.min("output").alias("output"), F.count("*").alias("n")), [key, "slot"], "left")
    piece = F.when(F.col("is_token"), F.col("piece")).otherwise(F.col("output"))
    bad = ~F.col("is_token") & (F.coalesce("n", F.lit(0)) != 1)
    by = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", piece.alias("t")))), lambda x: x["t"]), "").alias("text"), F.bool_or(bad).alias("bad"))
    by = by.join(odd, key, "left").withColumn("code", F.when(F.col("bad") | F.col("__odd").isNotNull(), "slot_mismatch"))
    return by.select(key, F.when(F.col("code").isNull(), F.col("text")).alias("output"), "code")


def prompt_column(batches: DataFrame, role: str, keys: list[str], terms: str | None = None, context: str | None = None) -> DataFrame:
    """(keys, prompt): role, context, glossary lines and the rows as JSON, per batch. batches: row_id, source; terms is an array of "a=b"."""
    rows = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "source"))), lambda x: F.struct(x["row_id"].alias("id"), x["source"].alias("input"))))
    parts = [F.lit(role)]
    if context:
        parts.append(F.concat(F.lit("Context: "), F.max(context)))
    if terms:
        parts.append(F.concat(F.lit("Glossary:\n"), F.nullif(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(terms)))), "\n"), F.lit(""))))
    return batches.groupBy(*keys).agg(F.concat_ws("\n\n", *parts, rows).alias("prompt"))


def _called(batches: DataFrame, keys: list[str], order: str, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """batches with output and error: fn over each group's sources in order. A call that fails, or gives another number of outputs, gives null outputs and says why."""

    def call(rows: pd.DataFrame) -> dict:
        rows = rows.sort_values(order)
        error = None
        try:
            got = list(fn(rows["source"].tolist()))
            if len(got) != len(rows):
                got, error = [None] * len(rows), f"{len(got)} outputs for {len(rows)} rows"
        except Exception as e:  # the user's function may fail in any way; its rows then count as not answered
            got, error = [None] * len(rows), f"{type(e).__name__}: {e}"
        return {"output": pd.Series(got, index=rows.index, dtype=object).sort_index().tolist(), "error": [error] * len(rows)}

    return add_by_group(batches, keys, [order, "source"], {"output": "string", "error": "string"}, call)


def _within_budget(batches: DataFrame, spent: DataFrame, requests: int | None) -> DataFrame:
    """batches (doc_id, page, batch and rows) with allowed: whether a document's requests, in the order of its batches and after those spent (doc_id, used), reach that far."""
    if requests is None:
        return batches.withColumn("allowed", F.lit(True))
    each = batches.select("doc_id", "page", "batch").distinct().join(spent, "doc_id", "left")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "batch")) + F.coalesce("used", F.lit(0))
    return batches.join(each.select("doc_id", "page", "batch", (nth <= requests).alias("allowed")), ["doc_id", "page", "batch"])


def translate_batches(
    paragraphs: DataFrame,
    fn: Callable[[list[str]], list[str]],
    cache: DataFrame | None = None,
    lang: str = "",
    max_sum: int = 200,
    max_rows: int = 5,
    attempts: int = 2,
    repair_fn: Callable[[list[str]], list[str]] | None = None,
    requests: int | None = None,
) -> DataFrame:
    """paragraphs (doc_id, page, row_id, source) with output, status (succeeded, failed, skipped), code, from_cache, attempts, committed and error. doc_id and row_id are never null.

    Skipped paragraphs and cached ones are not sent. What is invalid is sent again until its attempts are used up: with repair_fn,
    a paragraph whose placeholders differ first by its pieces between placeholders (repair_slots), which are put together again; else, and
    then, alone. requests bounds a document's calls over all rounds; what it does not reach fails with budget_exhausted.
    committed: a valid result to be kept, of a first batch only if all its rows are valid or have become so. cache: source_hash, output.
    """
    rows = paragraphs.withColumn("reason", T.skip_reason(F.col("source"))).withColumn("source_hash", F.sha2("source", 256)).withColumn("tokens", T.word_count(F.col("source")))
    known = rows.limit(0).select("source_hash", F.lit("").alias("cached")) if cache is None else cache.groupBy("source_hash").agg(F.min("output").alias("cached"))
    rows = cut(rows.join(known, "source_hash", "left"))
    columns = ["doc_id", "page", "row_id", "source", "tokens"]
    open_ = rows.where("reason is null and cached is null").select(*columns, F.lit(None).cast("int").alias("first_batch"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))
    spent = rows.limit(0).select("doc_id", F.lit(0).cast("long").alias("used"))
    done = []
    for attempt in range(attempts):
        size = (max_sum, max_rows) if attempt == 0 else (0, 0)
        batches = _within_budget(batch_by_budget(open_, ["doc_id", "page"], "row_id", "tokens", *size), spent, requests)
        batches = cut(batches.withColumn("first_batch", F.coalesce("first_batch", "batch")).withColumn("apart", F.lit(bool(repair_fn) and attempt == 1) & F.coalesce(F.col("code") == "placeholder_mismatch", F.lit(False))))
        whole = batches.where("allowed and not apart").drop("error")
        sent = _called(whole, ["doc_id", "page", "batch"], "row_id", fn)
        if repair_fn and attempt == 1:
            pieces = batches.where("allowed and apart")
            slots = cut(repair_slots(pieces.select(F.struct("doc_id", "row_id").alias("key"), "source"), "key"))
            asked = slots.where("not is_token").withColumnRenamed("piece", "source")
            answers = cut(_called(asked.select("key.doc_id", "key.row_id", "slot", "source"), ["doc_id", "row_id"], "slot", repair_fn))
            outputs = answers.where("output is not null").select(F.struct("doc_id", "row_id").alias("key"), "slot", "output")
            why = answers.groupBy("doc_id", "row_id").agg(F.max("error").alias("error"))
            mended = join_slots(slots, outputs, "key").select("key.doc_id", "key.row_id", "output")
            sent = sent.unionByName(pieces.drop("error").join(mended, ["doc_id", "row_id"], "left").join(why, ["doc_id", "row_id"], "left"))
        seen = sent.withColumn("code", T.validate_pair(F.col("source"), F.col("output"), lang)).withColumn("attempts", F.col("attempts") + 1)
        seen = cut(seen.unionByName(batches.where("not allowed").withColumns({"code": F.lit("budget_exhausted"), "output": F.lit(None).cast("string")})))
        over = (F.col("code") == "budget_exhausted") if attempt + 1 < attempts else F.lit(True)
        ended = seen.where(F.col("code").isNull() | over)
        done.append(ended.select("doc_id", "row_id", "page", "first_batch", F.when(F.col("code").isNull(), T.canonicalize_placeholders(F.col("source"), F.col("output"))).alias("output"), "code", "error", "attempts"))
        calls = batches.where("allowed").select("doc_id", "page", "batch").distinct().groupBy("doc_id").agg(F.count("*").alias("used"))
        spent = cut(spent.unionByName(calls).groupBy("doc_id").agg(F.sum("used").alias("used")))
        open_ = seen.where(F.col("code").isNotNull() & ~over).select(*columns, "first_batch", "code", "error", "attempts")
    results = done[0]
    for more in done[1:]:
        results = results.unionByName(more)
    complete = F.min(F.col("code").isNull()).over(Window.partitionBy("doc_id", "page", "first_batch"))
    results = results.withColumn("committed", complete & F.col("code").isNull()).drop("page", "first_batch")
    out = rows.join(results.withColumn("sent", F.lit(True)), ["doc_id", "row_id"], "left")
    status = F.when(F.col("reason").isNotNull(), "skipped").when(F.col("cached").isNotNull() | (F.col("sent") & F.col("code").isNull()), "succeeded").otherwise("failed")
    return out.select(
        "doc_id", "page", "row_id", "source", F.coalesce("cached", "output").alias("output"), status.alias("status"), F.coalesce("code", "reason").alias("code"), F.col("cached").isNotNull().alias("from_cache"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("committed", F.lit(False)).alias("committed"), "error"
    )


def term_rows(reply: Column) -> Column:
    """array<struct<src,tgt>> from a reply; empty if any row is bad. Long terms, and short ones that do not change, are left out."""
    body = T.clean_json(reply)
    body = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    rows = F.from_json(body, "array<struct<src:string,tgt:string>>")
    good = F.forall(rows, lambda r: F.coalesce((F.trim(r["src"]) != "") & (F.trim(r["tgt"]) != ""), F.lit(False)))
    kept = F.filter(F.transform(rows, lambda r: F.struct(F.trim(r["src"]).alias("src"), F.trim(r["tgt"]).alias("tgt"))), lambda r: (F.length(r["src"]) < 100) & ~((r["src"] == r["tgt"]) & (F.length(r["src"]) < 3)))
    return F.when(F.coalesce(good, F.lit(False)), kept).otherwise(F.array().cast("array<struct<src:string,tgt:string>>"))


def extract_terms(paragraphs: DataFrame, fn: Callable[[list[str]], str], glossary: DataFrame | None = None, max_sum: int = 600, max_rows: int = 12) -> DataFrame:
    """(source, target, votes): terms that fn finds in batches of paragraphs, voted over all of them; a glossary's own terms are left out."""
    rows = paragraphs.where(T.skip_reason(F.col("source")).isNull()).select("doc_id", "page", "row_id", "source", T.word_count(F.col("source")).alias("tokens"))
    batches = batch_by_budget(rows, ["doc_id", "page"], "row_id", "tokens", max_sum, max_rows)

    def call(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_id")
        try:
            reply = fn(part["source"].tolist())
        except Exception:  # as for translation
            reply = None
        return pd.DataFrame({"seq": [int(part["doc_id"].iloc[0]) * 1_000_000 + int(part["row_id"].iloc[0])], "reply": [reply]})

    replies = batches.groupBy("doc_id", "page", "batch").applyInPandas(call, "seq long, reply string")
    pairs = replies.select("seq", F.explode(term_rows(F.col("reply"))).alias("t")).select(T.squeeze(F.col("t.src")).alias("source"), F.col("t.tgt").alias("target"), "seq")
    if glossary is not None:
        known = glossary.select(T.term_key(F.col("source")).alias("k")).distinct()
        pairs = pairs.join(known, T.term_key(F.col("source")) == F.col("k"), "left_anti")
    return vote_targets(pairs)


def dictionary_entry_valid(entry: Column, most: int = 8, length: int = 500) -> Column:
    """A JSON entry with one to ``most`` senses of bounded text and two examples each at most."""
    senses = F.from_json(entry, "struct<senses:array<struct<chinese:string,english:string,examples:array<struct<source:string,target:string>>>>>")["senses"]
    ok = lambda s: (F.length(F.trim(s["chinese"])).between(1, length)) & (F.length(F.coalesce(s["english"], F.lit(""))) <= length) & (F.coalesce(F.size(s["examples"]), F.lit(0)) <= 2)
    return F.coalesce(F.size(senses).between(1, most) & F.forall(senses, ok), F.lit(False))


def context_meaning_valid(value: Column, fields: tuple[str, ...] = ("meaning", "explanation"), length: int = 2000) -> Column:
    row = F.from_json(value, ", ".join(f"{f} string" for f in fields))
    out = F.lit(True)
    for f in fields:
        out = out & F.coalesce(F.length(F.trim(row[f])).between(1, length), F.lit(False))
    return out


def verdict_rows(reply: Column, n: Column) -> Column:
    """array<struct<id,verdict,output,evidence>> if the reply has each id from 0 to n - 1 once, as a whole number, and known verdicts; else null."""

    @F.pandas_udf("array<struct<id:int,verdict:string,output:string,evidence:string>>")
    def parse(replies: pd.Series, sizes: pd.Series) -> pd.Series:
        def one(text, size):
            try:
                rows = json.loads(text)
            except (TypeError, ValueError):
                return None
            if not isinstance(rows, list) or not all(isinstance(r, dict) and type(r.get("id")) is int and r.get("verdict") in ("passed", "corrected") for r in rows):
                return None
            return rows if sorted(r["id"] for r in rows) == list(range(size)) else None

        return pd.Series([None if (r := one(t, int(k))) is None else [{"id": x["id"], "verdict": x["verdict"], **{k: v if isinstance(v := x.get(k), str) else None for k in ("output", "evidence")}} for x in r] for t, k in zip(replies, sizes, strict=True)], dtype=object)

    return parse(T.clean_json(reply), n)


def review_priority(candidates: DataFrame, terms: DataFrame, key: str = "row_id") -> DataFrame:
    """candidates (row_id, label, source, output, continuation) with priority 0 to 4: continuation, a term whose target the output lacks, 300 words, 8 style tags; only body paragraphs have any."""
    hits = match_terms(candidates, terms, [key], "source", "source").select(key, F.col("target").alias("t"))
    lacks = hits.join(candidates.select(key, "output"), key).where(~F.contains(T.term_key(F.col("output")), T.term_key(F.col("t")))).select(key).distinct().withColumn("__conflict", F.lit(1))
    prose = F.regexp_replace("source", r"(?i)<[^>]*>|\{\s*v\s*\d+\s*\}", " ")
    rows = candidates.join(lacks, key, "left")
    risk = F.coalesce(F.col("continuation"), F.lit(False)).cast("int") + F.coalesce("__conflict", F.lit(0)) + (F.size(T.latin_words(prose)) >= 300).cast("int") + (F.regexp_count("source", F.lit(r"(?i)<\s*style\b")) >= 8).cast("int")
    return rows.withColumn("priority", F.when(T.is_body(F.col("label")), risk).otherwise(0)).drop("__conflict")


def select_for_review(candidates: DataFrame, cap: int = REVIEW_CAP, batch: int = REVIEW_BATCH) -> DataFrame:
    """Body candidates (doc_id, row_id, priority, continuation_group) with selected and review_batch.

    Groups of a document are ranked by their largest priority, then order, and taken while they fit; a group without risk or of
    more than ``batch`` rows is passed over. Selected groups fill batches in that order. A document's candidates of priority 0
    that stand alone never reach the pass.
    """
    rows = candidates.where(T.is_body(F.col("label"))).withColumn("__g", F.coalesce(F.col("continuation_group").cast("long"), -1 - F.col("row_id")))
    w = Window.partitionBy("doc_id", "__g")
    ranked = rows.withColumn("__p", F.max("priority").over(w)).withColumn("__first", F.min("row_id").over(w)).withColumn("__n", F.count("*").over(w))
    able = ranked.where((F.col("__p") > 0) & (F.col("__n") <= batch)).select("doc_id", "__g", "__p", "__first", "__n").distinct()
    # of groups that could be taken, those ranked beyond the cap never are: each before them takes a row at least unless it does not fit
    spec = "doc_id long, __g long, selected boolean, review_batch int"

    def take(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__p", "__first"], ascending=[False, True])
        used, b, held, out = 0, -1, batch, []
        for g, n in zip(part["__g"], part["__n"], strict=True):
            if used + n > cap:
                continue
            used += n
            if held + n > batch:
                b, held = b + 1, 0
            held += n
            out.append((part["doc_id"].iloc[0], g, True, b))
        return pd.DataFrame(out, columns=["doc_id", "__g", "selected", "review_batch"])

    chosen = able.groupBy("doc_id").applyInPandas(take, spec)
    return rows.join(chosen, ["doc_id", "__g"], "left").withColumn("selected", F.coalesce("selected", F.lit(False))).drop("__g")


def review_batches(candidates: DataFrame, fn: Callable[[list[dict]], str], lang: str = "", requests: int = REQUESTS) -> DataFrame:
    """Candidates with review (passed, corrected, failed, unchecked, not_selected), reason and output after a user's reviewer has seen the selected ones.

    A reply must name each row once. A correction must quote, as evidence, words that stand in the source, else the row stays unchecked
    (invalid_review) with the output it had; it must stand up to validation, and so must what passes, else the row fails and loses
    its output. A correction that changes nothing has passed. Batches beyond a document's request budget stay unchecked
    (budget_exhausted), as do those whose call fails (provider_error, with its message).
    """
    rows = cut(select_for_review(candidates))

    def ask(part: pd.DataFrame) -> dict:
        part = part.sort_values("row_id")
        reply = error = None
        try:
            reply = fn([{"id": i, "source": s, "output": o} for i, (s, o) in enumerate(zip(part["source"], part["output"], strict=True))])
        except Exception as e:  # as for translation
            error = f"provider_error: {type(e).__name__}: {e}"
        place = pd.Series(range(len(part)), index=part.index).sort_index()
        return {"place": place.tolist(), "reply": [reply] * len(part), "error": [error] * len(part), "n": [len(part)] * len(part)}

    sent = rows.where(F.col("selected") & (F.col("review_batch") < requests)).select("doc_id", "review_batch", "row_id", "source", "output")
    replies = cut(add_by_group(sent, ["doc_id", "review_batch"], ["row_id", "source", "output"], {"place": "int", "reply": "string", "error": "string", "n": "int"}, ask))
    own = F.filter(verdict_rows(F.col("reply"), F.col("n")), lambda x: x["id"] == F.col("place"))
    verdicts = replies.select("doc_id", "row_id", own.alias("v"), "error").select("doc_id", "row_id", "error", F.get("v", F.lit(0)).alias("x")).select("doc_id", "row_id", "error", F.col("x.verdict").alias("verdict"), F.col("x.output").alias("new_output"), F.col("x.evidence").alias("evidence"), F.lit(True).alias("sent"))
    out = rows.join(verdicts, ["doc_id", "row_id"], "left")
    corrects = F.coalesce(F.col("verdict") == "corrected", F.lit(False))
    quoted = F.coalesce((F.trim("evidence") != "") & F.contains("source", F.col("evidence")), F.lit(False))
    final = F.when(corrects, F.col("new_output")).otherwise(F.col("output"))
    out = out.withColumn("__code", F.when(F.col("verdict").isNotNull(), T.validate_pair(F.col("source"), final, lang)))
    unchecked = F.col("verdict").isNull() | (corrects & ~quoted)
    review = F.when(~F.col("selected"), "not_selected").when(unchecked, "unchecked").when(F.col("__code").isNotNull(), "failed").when(corrects & ~F.col("new_output").eqNullSafe(F.col("output")), "corrected").otherwise("passed")
    reason = F.when(~F.col("selected"), None).when(F.col("sent").isNull(), "budget_exhausted").when(F.col("error").isNotNull(), F.col("error")).when(unchecked | F.col("__code").isNotNull(), "invalid_review")
    new = F.when(review == "failed", F.lit(None)).when(review == "corrected", F.col("new_output")).otherwise(F.col("output"))
    return out.withColumn("review", review).withColumn("reason", reason).withColumn("output", new).drop("__code", "verdict", "new_output", "evidence", "error", "sent")
