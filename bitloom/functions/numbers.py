"""Column helpers for numbers in which null means unknown, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonneg_or_null(col: Column) -> Column:
    """The whole part of a finite number of 0 or more; else null. Booleans are for the caller's schema to keep out."""
    d = col.cast("double")
    return F.when(~F.isnan(d) & (d >= 0) & (d < F.lit(float("inf"))), d.cast("long"))


def rate(num: Column, den: Column, digits: int = 4) -> Column:
    """num / den, rounded; null where den is 0."""
    return F.round(F.try_divide(num.cast("double"), den), digits)


def reduction_percent(before: Column, after: Column) -> Column:
    return F.try_divide(F.lit(100.0) * (before - after), before)


def strict_sum(col: Column) -> Column:
    """The sum over a group, null where any value is unknown and where there are no rows."""
    return F.when((F.count(col) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), F.sum(col))


def known_sum(col: Column) -> Column:
    """The sum of what is known; null where nothing is."""
    return F.sum(col)


def nearest_rank(name: str, p: float) -> Column:
    """The value at rank ceil(n * p) of a column's sorted known values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {name})")


def availability(*cols: Column, complete: Column | None = None) -> Column:
    """Of a group: unavailable (no value of cols is known), complete (every row has all of them and none is incomplete), else partial."""
    any_known = None
    all_known = F.lit(True) if complete is None else F.bool_and(F.coalesce(complete, F.lit(False)))
    for c in cols:
        n = F.count(c)
        any_known = n > 0 if any_known is None else any_known | (n > 0)
        all_known = all_known & (n == F.count(F.lit(1)))
    return F.when(~any_known, "unavailable").when(all_known, "complete").otherwise("partial")


def vote(value: Column, count: Column, first: Column) -> Column:
    """Of grouped counts: the value that is most frequent, the first seen of several."""
    return F.max_by(value, F.struct(count, -first))


def weighted_score(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Scores from 0 to 4 by dimension to one from 0 to 100; null where one is missing."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + scores[name] * F.lit(weight) / F.lit(4.0)
    return total


def clamp_token_parts(prompt: Column, completion: Column, hit: Column, miss: Column, reasoning: Column) -> dict[str, Column]:
    """Token counts made consistent: hits and misses within the prompt and adding up to it, reasoning within the completion."""
    p, c, h, m, r = map(nonneg_or_null, (prompt, completion, hit, miss, reasoning))
    both = p.isNotNull()
    new_hit = F.when(both & h.isNotNull(), F.least(h, p)).when(both & m.isNotNull(), p - F.least(m, p)).otherwise(h)
    new_miss = F.when(both & h.isNotNull(), p - F.least(h, p)).when(both & m.isNotNull(), F.least(m, p)).otherwise(m)
    return {"input": p, "output": c, "hit": new_hit, "miss": new_miss, "reasoning": F.when(r.isNotNull() & c.isNotNull(), F.least(r, c)).otherwise(r)}


def estimate_cost(usage: dict[str, Column], rates: dict[str, Column], complete: Column) -> Column:
    """Money for a call: rates per million for fresh, cached, cache-written and output tokens. Null where usage is incomplete or a needed rate is unknown."""
    cached, written = F.coalesce(usage["cached"], F.lit(0)), F.coalesce(usage["cache_write"], F.lit(0))
    fresh = usage["input"] - cached - written
    part = lambda n, r: F.when(n == 0, F.lit(0.0)).otherwise(n * r / F.lit(1e6))
    total = part(fresh, rates["input"]) + part(cached, rates["cached"]) + part(written, rates["cache_write"]) + part(usage["output"], rates["output"])
    return F.when(complete & (fresh >= 0), total)


def add_counts(a: Column, b: Column) -> Column:
    """Two count maps added up; entries of 0 or less go."""
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_filter(F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))), lambda k, v: v > 0)


def allowed_counts(counts: Column, keys: list[str], codes: bool = False) -> Column:
    """Entries of a count map whose key is listed, or with codes a status of three digits or "unknown"."""
    ok = lambda k: k.isin(keys) | (F.lit(codes) & k.rlike("^([1-5][0-9]{2}|unknown)$"))
    return F.map_filter(counts, lambda k, v: ok(k) & (v >= 0))


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(values)


def last_n(values: Column, n: int) -> tuple[Column, Column]:
    """The last n of an array, and how many are left out."""
    size = F.size(values)
    return F.slice(values, F.greatest(size - n + 1, F.lit(1)), n), F.greatest(size - n, F.lit(0))
