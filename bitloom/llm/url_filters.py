"""URL filtering by a temporal list join, with DataFrame functions only.

Dated list entries (add or remove a pattern) become validity intervals. Every capture is held against the entries that
were active when it was fetched: an as-of join as an equi-join on pattern and time bucket, verified by the interval. The
candidates of a URL are its host and the host's parent domains, of as many labels as entries have, and the host with its
first path segments, of as many as entries have: names and paths of any length cost no more than that. A host with a
third of all captures is spread by the time buckets, and the join is one that Spark splits where it is still skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import cut

BUCKET_DAYS = 30


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)", 1)


def _path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def candidates(url: Column, labels: list[int], depths: list[int]) -> Column:
    """The patterns that can match a URL, in lower case: host and parents of so many labels (one label only where the host has no more), and the host with so many path segments."""
    host = F.coalesce(host_of(url), F.lit(""))
    names = F.split(host, r"\.")
    n = F.size(names)
    sizes = lambda values: F.lit(sorted(values)).cast("array<int>")
    fit = F.filter(sizes(labels), lambda k: (k <= n) & ((k > 1) | (n == 1)))
    parents = F.transform(fit, lambda k: F.array_join(F.slice(names, n - k + 1, k), "."))
    parts = F.filter(F.split(F.lower(F.coalesce(_path_of(url), F.lit(""))), "/"), lambda x: x != "")
    deep = F.transform(F.filter(sizes(depths), lambda k: k <= F.size(parts)), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, deep)))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list, pattern, verdict, action, at) to (list, pattern, verdict, valid_from, valid_to), end exclusive, null if still valid.

    An entry holds until the next one for its list and pattern. At one instant "remove" comes after "add", and of two
    adds the one with the greater verdict holds. Patterns are compared in lower case; entries with a null are left out, as they name nothing.
    """
    whole = entries.select("list", F.lower("pattern").alias("pattern"), "verdict", "action", "at").where("list is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    one = whole.groupBy("list", "pattern", "at").agg(F.max(F.struct("action", "verdict")).alias("e"))
    following = F.lead("at").over(Window.partitionBy("list", "pattern").orderBy("at"))
    return one.select("list", "pattern", "e.verdict", "e.action", F.col("at").alias("valid_from"), following.alias("valid_to")).where("action = 'add'").drop("action")


def _bucket(at: Column) -> Column:
    return F.floor(F.unix_timestamp(at) / (BUCKET_DAYS * 86400))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """(page_id, url, fetched_at, host, decision, list, pattern, valid_from, valid_to, matches): one row per row of captures.

    The most specific active pattern decides (the longest; then "allow" before "block"; then the first list by name).
    decision: allow, block, or pass where nothing matches, as for a null or unusable URL and a null time. matches: active
    entries in all. Repeated captures each give a row. Empty captures or entries give no rows or only "pass". Other columns are not read.
    """
    seen = captures.select(captures[id_col].alias("page_id"), captures[url_col].alias("url"), captures[at_col].cast("timestamp").alias("fetched_at"))
    valid = cut(intervals(entries))
    # the shapes of patterns: few different numbers, however long the list is
    depth = F.size(F.split("pattern", "/")) - 1
    shapes = valid.select(F.when(depth == 0, F.size(F.split("pattern", r"\."))).alias("labels"), F.when(depth > 0, depth).alias("depth")).agg(F.collect_set("labels"), F.collect_set("depth")).first()
    # only buckets in which something was fetched: at most as many as the calendar has months, however far an interval or a wrong date reaches
    buckets = sorted(r[0] for r in seen.where("fetched_at is not null").select(_bucket(F.col("fetched_at")).alias("bucket")).distinct().collect())
    inside = F.filter(F.lit(buckets).cast("array<bigint>"), lambda b: (b >= _bucket(F.col("valid_from"))) & (F.col("valid_to").isNull() | (b <= _bucket(F.col("valid_to")))))
    by_bucket = valid.withColumn("bucket", F.explode(inside))
    asked = seen.where("url is not null and fetched_at is not null").distinct().select("*", F.explode(candidates(F.col("url"), *shapes)).alias("pattern"), _bucket(F.col("fetched_at")).alias("bucket"))
    active = asked.join(by_bucket, ["pattern", "bucket"]).where("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)")
    rank = F.struct(F.length("pattern").alias("length"), (F.col("verdict") == "allow").alias("allow"))
    best = active.groupBy("page_id", "url", "fetched_at").agg(
        F.min_by(F.struct("verdict", "list", "pattern", "valid_from", "valid_to"), F.struct(-rank["length"], ~rank["allow"], F.col("list"), F.col("pattern"))).alias("e"),
        F.count("*").alias("matches"),
    )
    best = best.select(F.col("page_id").alias("__id"), F.col("url").alias("__url"), F.col("fetched_at").alias("__at"), "e", "matches")
    joined = seen.join(best, F.col("page_id").eqNullSafe(F.col("__id")) & F.col("url").eqNullSafe(F.col("__url")) & F.col("fetched_at").eqNullSafe(F.col("__at")), "left")
    return joined.select(
        "page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"), F.coalesce("e.verdict", F.lit("pass")).alias("decision"), "e.list", "e.pattern", "e.valid_from", "e.valid_to", F.coalesce("matches", F.lit(0)).cast("long").alias("matches")
    )
