"""Bilingual memory: keyed upsert, lookups in tiers, caches, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import text as T
from bitloom.functions.storage import cut

#: Pairs of queries and paragraphs up to which a document's are all compared.
DIRECT_PAIRS = 4_096
MEMORY_KEY = ["doc_fingerprint", "target_lang", "page", "paragraph_id", "source_hash"]


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key. Rows are compared as they are pre-aggregated, so a hot key costs no task its rows."""
    row = F.struct(*(F.col(c) for c in df.columns if c not in keys))
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def prepare_memory(batch: DataFrame) -> DataFrame:
    """Confirmed paragraphs of a batch in the memory table's columns.

    batch: doc_fingerprint, target_lang, page, paragraph_id, source, translation, reading, status, quality, seq.
    """
    reading, incomplete = T.reading_text(F.col("reading"), F.col("translation"))
    ok = "status = 'succeeded' and coalesce(quality, '') <> 'failed'"
    out = batch.where(ok).select("doc_fingerprint", T.lang_key(F.col("target_lang")).alias("target_lang"), "page", F.coalesce("paragraph_id", F.lit("")).alias("paragraph_id"), "source", reading.alias("translation"), incomplete.alias("formatting_incomplete"), "seq")
    out = out.withColumn("normalized_source", T.normalize_text(F.col("source"))).withColumn("normalized_translation", T.normalize_text(F.col("translation")))
    return out.where("normalized_source <> '' and normalized_translation <> ''").withColumn("source_hash", F.sha2("normalized_source", 256))


def upsert_memory(target: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The memory table after a batch: of each key the last writing's translation, its normal form and flag, the first one's source and seq. Applying a batch twice changes nothing."""
    new = prepare_memory(batch).withColumn("updated_seq", F.col("seq"))
    rows = new if target is None else target.select(*new.columns).unionByName(new)
    kept = [c for c in rows.columns if c not in (*MEMORY_KEY, "seq", "source")]
    best = rows.groupBy(*MEMORY_KEY).agg(F.max_by(F.struct(*kept), "updated_seq").alias("row"), F.min_by("source", "seq").alias("source"), F.min("seq").alias("seq"))
    return best.select(*MEMORY_KEY, "row.*", "source", "seq").select(*rows.columns)


def lookup_memory(queries: DataFrame, memory: DataFrame, side: str = "source") -> DataFrame:
    """queries (query_id, doc_fingerprint, text, page; lang if there) with the best match: match_type, memory_seq, source, translation, match_page, paragraph_id, match_lang, formatting_incomplete.

    With lang, which may be spelled in any case and with _ or -, only entries in that language match; a null or empty one takes any.
    Tiers: the same text (exact; the query's page first, then the newest), then a paragraph that contains it (contained), of the
    page first and then of any page, the shortest, then the newest. Containment is literal. A tier sees only
    queries that the one before left open.
    """
    column = f"normalized_{side}"
    asked = queries.withColumn("wanted", T.normalize_text(F.col("text"))).where("wanted <> ''")
    lang = F.nullif(T.lang_key(F.col("lang")), F.lit("")) if "lang" in queries.columns else F.lit(None).cast("string")
    asked = cut(asked.select("query_id", "doc_fingerprint", "page", "wanted", lang.alias("wanted_lang")))  # the normal form is worked out once
    told = lambda c, kind: (F.col(c) if c in memory.columns else F.lit(None)).cast(kind)  # noqa: E731  (a table may lack what only the answer shows)
    shown = [told("paragraph_id", "string").alias("paragraph_id"), told("target_lang", "string").alias("match_lang"), told("formatting_incomplete", "boolean").alias("formatting_incomplete")]
    stored = memory.select("doc_fingerprint", F.col("page").alias("match_page"), F.col("seq").alias("memory_seq"), "source", "translation", *shown, F.col(column).alias("stored"))
    stored = cut(stored.join(asked.select("doc_fingerprint").distinct(), "doc_fingerprint", "left_semi"))  # what the memory follows from is worked out once
    row = F.struct("memory_seq", "source", "translation", "match_page", "paragraph_id", "match_lang", "formatting_incomplete")
    own_lang = F.col("wanted_lang").isNull() | (F.col("wanted_lang") == F.col("match_lang"))
    pick = lambda df, kind, order: df.groupBy("query_id").agg(F.max_by(row, F.struct(*order)).alias("m")).select("query_id", F.lit(kind).alias("match_type"), "m.*")
    same_page = F.coalesce((F.col("match_page") == F.col("page")).cast("int"), F.lit(0))
    same_text = (asked["doc_fingerprint"] == stored["doc_fingerprint"]) & (F.sha2("wanted", 256) == F.sha2("stored", 256)) & (F.col("wanted") == F.col("stored"))
    exact = cut(pick(asked.join(stored, same_text).where(own_lang), "exact", [same_page.alias("a"), F.col("memory_seq").alias("b")]))
    left = asked.join(exact, "query_id", "left_anti")
    inside = _holders(left, stored).where(F.contains(F.col("stored"), F.col("wanted")) & own_lang)
    contained = pick(inside, "contained", [same_page.alias("a"), (-F.length("stored")).alias("b"), F.col("memory_seq").alias("c")])
    return queries.join(exact.unionByName(contained), "query_id", "left")


def _holders(asked: DataFrame, own: DataFrame) -> DataFrame:
    """asked with the stored paragraphs of its document that may contain it. Of a document with few, all; of one with over DIRECT_PAIRS pairs of both those with the query's rarest run of three characters there (all of them for a shorter query)."""
    pairs = own.groupBy("doc_fingerprint").agg(F.count("*").alias("s")).join(asked.groupBy("doc_fingerprint").agg(F.count("*").alias("q")), "doc_fingerprint")
    large = cut(pairs.where(F.col("s") * F.col("q") > DIRECT_PAIRS).select("doc_fingerprint"))
    if large.isEmpty():
        return asked.join(own, "doc_fingerprint")
    direct = asked.join(large, "doc_fingerprint", "left_anti").join(own, "doc_fingerprint")
    return direct.unionByName(_by_runs(asked.join(large, "doc_fingerprint", "left_semi"), own.join(large, "doc_fingerprint", "left_semi")).select(*direct.columns))


def _by_runs(asked: DataFrame, own: DataFrame) -> DataFrame:
    runs = lambda c: F.explode(F.array_distinct(T.character_runs(F.col(c), 3))).alias("run")
    long = asked.where("length(wanted) >= 3")
    wanted = long.select("doc_fingerprint", "query_id", runs("wanted"))
    places = own.select("doc_fingerprint", "memory_seq", "match_page", runs("stored")).join(wanted.select("doc_fingerprint", "run").distinct(), ["doc_fingerprint", "run"], "left_semi")
    # a run that the document lacks rules the query out, so it counts as rarest
    often = places.groupBy("doc_fingerprint", "run").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, ["doc_fingerprint", "run"], "left").groupBy("doc_fingerprint", "query_id").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    near = rarest.join(places, ["doc_fingerprint", "run"]).select("query_id", "doc_fingerprint", "memory_seq", "match_page").distinct()
    found = near.join(own, ["doc_fingerprint", "memory_seq", "match_page"]).join(long, ["query_id", "doc_fingerprint"])
    short = asked.where("length(wanted) < 3").join(own, "doc_fingerprint")
    return found.unionByName(short.select(*found.columns))


def lookup_cache(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """requests with cached (null without a hit): exact reuse by a digest of the named columns."""
    key = T.identity_key(**{k: F.col(k).cast("string") for k in keys})
    stored = latest_by_key(cache.withColumn("cache_key", key).select("cache_key", "response", "seq"), ["cache_key"], ["seq"])
    return requests.withColumn("cache_key", key).join(stored.select("cache_key", F.col("response").alias("cached")), "cache_key", "left").drop("cache_key")


def resolve_selection(requests: DataFrame, glossary: DataFrame, cache: DataFrame, memory: DataFrame, max_age: int = 3600) -> DataFrame:
    """requests (request_id, text, cache_key, at, policy, required_terms) with (answer, answered_by): glossary, cache, saved, memory, or generate.

    A cached answer is hot for max_age seconds and "saved" after that; memory counts where the policy allows it and the
    answer has every required term.
    """
    terms = glossary.groupBy(T.term_key(F.col("source")).alias("g_key")).agg(F.min("target").alias("g"))
    cached = cache.groupBy(F.col("cache_key").alias("c_key")).agg(F.max_by("response", "created").alias("c"), F.max("created").alias("c_at"))
    known = memory.groupBy(F.col("normalized_source").alias("m_key")).agg(F.max_by("translation", "seq").alias("m"))
    rows = requests.join(terms, T.term_key(F.col("text")) == F.col("g_key"), "left").join(cached, F.col("cache_key") == F.col("c_key"), "left").join(known, T.normalize_text(F.col("text")) == F.col("m_key"), "left")
    hot = F.when(F.col("at") - F.col("c_at") <= max_age, F.col("c"))
    usable = F.when(F.col("policy").isin("paragraph", "exact") & F.forall(F.coalesce("required_terms", F.array().cast("array<string>")), lambda t: F.contains(F.col("m"), t)), F.col("m"))
    by = F.when(F.col("g").isNotNull(), "glossary").when(hot.isNotNull(), "cache").when(F.col("c").isNotNull(), "saved").when(usable.isNotNull(), "memory").otherwise("generate")
    return rows.select(*requests.columns, F.coalesce("g", hot, "c", usable).alias("answer"), by.alias("answered_by"))


def source_map(pairs: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, source_map_hash): per document its pages' (source, translation) pairs in order, as a map by page. pairs: doc_id, page, seq, source, translation."""
    page = pairs.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source", "translation"))), lambda x: F.struct(x["source"].alias("source"), x["translation"].alias("translation"))).alias("pairs"))
    doc = page.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "pairs")))).alias("paragraphs"))
    return doc.withColumn("source_map_hash", F.sha2(F.to_json("paragraphs"), 256))


def reverse_lookup(selections: DataFrame, pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """selections (selection_id, doc_id, out_page, text) with source, page, candidates, uncertain.

    pages (doc_id, out_page, page): the source page of an output page, negative where it shows the original. pairs (doc_id,
    page, source, translation). The side that the page shows must contain the selection; more than one candidate, or fewer
    than four characters, is uncertain.
    """
    asked = selections.join(pages, ["doc_id", "out_page"]).withColumn("side", F.when(F.col("page") < 0, "source").otherwise("translation")).withColumn("page", F.abs("page"))
    wanted = T.normalize_cjk(F.col("text"))
    shown = T.normalize_cjk(F.when(F.col("side") == "source", F.col("source")).otherwise(F.col("translation")))
    found = asked.withColumn("wanted", wanted).join(pairs, ["doc_id", "page"]).where((F.col("wanted") != "") & F.contains(shown, F.col("wanted")))
    best = found.groupBy("selection_id").agg(F.min(F.struct(F.length("translation").alias("n"), "source", "page")).alias("b"), F.count("*").alias("candidates"))
    out = selections.join(best, "selection_id", "left")
    return out.select(*selections.columns, "b.source", "b.page", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), ((F.coalesce("candidates", F.lit(0)) > 1) | (F.length(T.normalize_cjk(F.col("text"))) < 4)).alias("uncertain"))


def import_new(existing: DataFrame, incoming: DataFrame, identity: str = "identity", key: str = "id", seq: str = "seq") -> DataFrame:
    """incoming with status: added where neither identity nor id is known yet, else conflict.

    Rows are taken in the order of seq (unique), each held against those added before it. Every round adds the rows that
    come first in both their keys and drops what they block, so rounds are as many as the longest chain of collisions.
    """
    fresh = incoming.join(existing.select(identity).distinct(), identity, "left_anti").join(existing.select(key).distinct(), key, "left_anti")
    open_ = cut(fresh.select(identity, key, seq))
    added = open_.limit(0)
    while not open_.isEmpty():
        first = lambda c: F.min(seq).over(Window.partitionBy(c)) == F.col(seq)
        now = cut(open_.withColumn("a", first(identity)).withColumn("b", first(key)).where("a and b").select(identity, key, seq))
        added = added.unionByName(now)
        open_ = cut(open_.join(now.select(identity), identity, "left_anti").join(now.select(key), key, "left_anti"))
    ok = added.select(F.col(seq).alias("__seq"))
    return incoming.join(ok, F.col(seq) == F.col("__seq"), "left").withColumn("status", F.when(F.col("__seq").isNotNull(), "added").otherwise("conflict")).drop("__seq")


def review_selection_merge(candidates: DataFrame, approvals: DataFrame) -> DataFrame:
    """candidates with approved_output: an approval counts only for the same source, output, version, priority and fingerprint."""
    keys = ["source", "output", "version", "priority", "fingerprint"]
    return candidates.join(latest_by_key(approvals.select(*keys, "approved_output", "seq"), keys, ["seq"]).drop("seq"), keys, "left")


def lru_keep(df: DataFrame, n: int = 20_000, exempt: tuple[str, ...] = (), kind: str = "kind", accessed: str = "accessed", key: str = "key") -> DataFrame:
    """The n rows accessed last, and all rows of exempt kinds."""
    free = F.col(kind).isin(*exempt) if exempt else F.lit(False)
    return df.where(free).unionByName(df.where(~free).orderBy(F.desc(accessed), key).limit(n))


def history_prune(df: DataFrame, group: str, at: str, now: float, n: int = 128, ttl: float = 60.0) -> DataFrame:
    """Per group the newest n rows that are no older than ttl seconds."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(at)))
    return df.where(F.lit(now) - F.col(at) <= ttl).withColumn("__n", nth).where(F.col("__n") <= n).drop("__n")


def output_pages(pages: DataFrame, layout: str = "normal", translation_first: bool = False) -> DataFrame:
    """(doc_id, out_page, page) for pages (doc_id, page): the source page that each page of an output shows, from 1. layout "alternating": every page twice, negative where it shows the original."""
    rows = pages.select("doc_id", "page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")).alias("nth"))
    if layout == "normal":
        return rows.select("doc_id", F.col("nth").cast("int").alias("out_page"), "page")
    pair = F.array(F.col("page"), -F.col("page")) if translation_first else F.array(-F.col("page"), F.col("page"))
    return rows.select("doc_id", "nth", F.posexplode(pair).alias("half", "page")).select("doc_id", (F.col("nth") * 2 - 1 + F.col("half")).cast("int").alias("out_page"), "page")


def generation_switch(history: DataFrame, fingerprint: str) -> DataFrame:
    """The rows of one generation; on a table partitioned by fingerprint this reads that partition only."""
    return history.where(F.col("fingerprint") == fingerprint)


def archive_generation(current: DataFrame, history: DataFrame, previous: str, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(current, history) after a switch of generations: the current rows (without fingerprint) replace what the history holds of the previous one, and the rows of ``fingerprint`` are current; none of another generation ever are."""
    kept = history.where(~F.col("fingerprint").eqNullSafe(F.lit(previous)))
    whole = kept.unionByName(current.withColumn("fingerprint", F.lit(previous)))
    return generation_switch(whole, fingerprint).drop("fingerprint"), whole
