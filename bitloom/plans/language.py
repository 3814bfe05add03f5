"""Queries on documents, conversations, pages and parts: terms, memory, paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions import tables
from bitloom.functions import text as T
from bitloom.operators import memory as M
from bitloom.operators import paragraphs as P
from bitloom.operators import terms as W
from bitloom.operators.evaluate import inside_candidates
from bitloom.sources import files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paragraphs(spark, d, *more) -> DataFrame:
    return P.paragraphs_from_text(table(spark, d, "documents").select("doc_id", "text", *more), ["doc_id", *more])


def _words(col) -> F.Column:
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


# --- terms


def _benchmark_terms(spark, d) -> DataFrame:
    """Terms that follow from the benchmark: its items' first words of four letters or more, each with the item's second word."""
    runs = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{IsLatin}\p{N}_]+)"), 1)
    rows = table(spark, d, "benchmark").select("item_id", runs.alias("r")).where("size(r) > 1 and length(r[0]) >= 4")
    return rows.groupBy(F.col("r")[0].alias("source")).agg(F.min_by(F.col("r")[1], "item_id").alias("target"), F.min("item_id").alias("seq"))


def term_hits_by_lang(spark, d):
    paras = _paragraphs(spark, d, "lang").where(T.skip_reason(F.col("text")).isNull())
    hits = W.match_terms(paras, _benchmark_terms(spark, d), ["doc_id", "lang", "para_idx"])
    return hits.groupBy("lang", "source").agg(F.count("*").alias("paragraphs"), F.count_distinct("doc_id").alias("documents"))


#: Unicode's white space, as a run.
_WHITE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
PARAS_SQL = rf"""paras AS (
  SELECT doc_id, lang, source AS doc_source, unnest(range(len(p)))::INT AS para_idx, unnest(p) AS text
  FROM (SELECT doc_id, lang, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^{_WHITE}|{_WHITE}$', '', 'g')), lambda x: x <> '') AS p FROM documents))"""

_MAILBOX = r"[a-zA-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?(?:\.[a-zA-Z0-9-]+)+"
#: Skip reasons as they can arise in the documents (no placeholders, code or bare addresses other than mail and http).
REASON_SQL = rf"""CASE WHEN length(text) < 5 THEN 'short_text' WHEN regexp_matches(trim(text), '^-?\d+(\.\d+)?$') THEN 'numeric_or_formula'
  WHEN regexp_matches(trim(text), '^(?:(?:\[\d+\]|\d+[.)]?)?\s*https?://[^\s<>\{{\}}\[\]]+)(?:\s+(?:(?:\[\d+\]|\d+[.)]?)?\s*https?://[^\s<>\{{\}}\[\]]+))*$') THEN 'url_only'
  WHEN regexp_matches(trim(text), '^{_MAILBOX}(?:(?:\s*[,;]\s*|\s+){_MAILBOX})*$') THEN 'email_only' END"""

TERM_HITS_SQL = f"""
WITH {PARAS_SQL},
first AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{Latin}}\\p{{N}}_]+') AS r FROM benchmark),
terms AS (SELECT r[1] AS source FROM first WHERE len(r) > 1 AND length(r[1]) >= 4 GROUP BY 1),
runs AS (SELECT DISTINCT doc_id, lang, para_idx, unnest(regexp_extract_all(lower(text), '[\\p{{Latin}}\\p{{N}}_]+')) AS source FROM (SELECT *, {REASON_SQL} AS reason FROM paras) WHERE reason IS NULL)
SELECT lang, source, count(*) AS paragraphs, count(DISTINCT doc_id) AS documents FROM runs JOIN terms USING (source) GROUP BY lang, source
"""


def _positions(spark, d, side: int, name: str) -> DataFrame:
    rows = table(spark, d, "documents").where(f"doc_id % 2 = {side}")
    return rows.select(F.floor(F.col("doc_id") / 2).alias("pair"), F.posexplode(_words(F.lower("text"))).alias("pos", name))


def auto_glossary_vote(spark, d):
    pairs = _positions(spark, d, 0, "source").join(_positions(spark, d, 1, "target"), ["pair", "pos"]).withColumn("seq", F.col("pair") * 1_000_000 + F.col("pos"))
    voted = W.vote_targets(pairs).withColumn("origin", F.lit("auto"))
    manual = _benchmark_terms(spark, d).select("source", "target", F.lit(None).cast("long").alias("votes"), F.lit("manual").alias("origin"))
    return W.merge_term_sources(manual, voted).select("source", "target", "votes", "origin")


AUTO_GLOSSARY_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM w),
pairs AS (SELECT a.word AS source, b.word AS target, (a.doc_id // 2) * 1000000 + a.pos AS seq
  FROM t a JOIN t b ON a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1 AND a.pos = b.pos),
counted AS (SELECT source, target, count(*) AS votes, min(seq) AS first FROM pairs GROUP BY ALL),
voted AS (SELECT source, target, votes FROM counted QUALIFY row_number() OVER (PARTITION BY source ORDER BY votes DESC, first) = 1),
first AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{Latin}\p{N}_]+') AS r FROM benchmark),
manual AS (SELECT r[1] AS source, arg_min(r[2], item_id) AS target FROM first WHERE len(r) > 1 AND length(r[1]) >= 4 GROUP BY 1)
SELECT source, target, NULL::BIGINT AS votes, 'manual' AS origin FROM manual
UNION ALL SELECT source, target, votes, 'auto' FROM voted WHERE source NOT IN (SELECT source FROM manual)
"""


def _part_terms(spark, d) -> DataFrame:
    """Part names as terms, their type as target and their size deciding the language."""
    lang = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "zh_CN").otherwise("fr")
    return table(spark, d, "part").select(F.initcap("p_name").alias("source"), F.col("p_type").alias("target"), lang.alias("tgt_lng"), F.col("p_partkey").alias("seq"))


def term_language_override(spark, d):
    return W.terms_for_language(_part_terms(spark, d), "zh-CN").select("source", "target", "tgt_lng")


def term_conflicts(spark, d):
    return W.term_conflicts(_part_terms(spark, d)).select("term_key", "tgt_lng", F.array_join("targets", "|").alias("targets"), F.array_join(F.transform("rows", lambda r: r.cast("string")), "|").alias("rows"))


_PART_TERMS_SQL = "terms AS (SELECT lower(p_name) AS term_key, p_type AS target, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'zh-cn' ELSE 'fr' END AS tgt_lng, p_partkey AS seq, p_name FROM part)"
TERM_LANGUAGE_SQL = f"""
WITH {_PART_TERMS_SQL}, won AS (SELECT * FROM terms WHERE tgt_lng IN ('', 'zh-cn') QUALIFY row_number() OVER (PARTITION BY term_key ORDER BY tgt_lng = '', seq) = 1)
SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS source, target, tgt_lng FROM won
"""
TERM_CONFLICTS_SQL = f"""
WITH {_PART_TERMS_SQL}, one AS (SELECT term_key, tgt_lng, target, min(seq) AS seq FROM terms GROUP BY ALL)
SELECT term_key, tgt_lng, string_agg(target, '|' ORDER BY seq) AS targets, string_agg(seq::VARCHAR, '|' ORDER BY seq) AS rows FROM one GROUP BY ALL HAVING count(*) > 1
"""


def term_source_counts(spark, d):
    terms = table(spark, d, "part").select(F.col("p_name").alias("source"), F.col("p_type").alias("target"), F.col("p_brand").alias("source_id"))
    return W.source_counts(terms).withColumn("source_ids", F.array_join("source_ids", "|"))


TERM_SOURCE_COUNTS_SQL = """
SELECT lower(p_name) AS term_key, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS source_ids, count(*) AS entries, count(DISTINCT p_type) AS targets, count(DISTINCT p_type) > 1 AS conflict
FROM part GROUP BY 1
"""


def pack_status(spark, d):
    version = F.concat(F.lit("1."), F.col("p_size").cast("string"))
    packs = table(spark, d, "part").select(F.col("p_name").alias("id"), version.alias("version"), "p_partkey").distinct()
    found = W.pack_status(packs.select("id", "version").distinct(), packs.where("p_partkey % 7 = 0").select("id", "version"))
    return found.withColumn("versions", F.array_join("versions", "|"))


PACK_STATUS_SQL = """
WITH packs AS (SELECT DISTINCT p_name AS id, '1.' || p_size AS version, p_size FROM part),
listed AS (SELECT id, string_agg(version, '|' ORDER BY p_size DESC) AS versions, arg_max(version, p_size) AS newest FROM packs GROUP BY id),
have AS (SELECT p_name AS id, list('1.' || p_size) AS installed FROM part WHERE p_partkey % 7 = 0 GROUP BY 1)
SELECT id, CASE WHEN list_contains(installed, newest) THEN 'installed' WHEN installed IS NOT NULL THEN 'update_available' ELSE 'not_downloaded' END AS status, versions
FROM listed LEFT JOIN have USING (id)
"""


def dictionary_topk(spark, d):
    words = table(spark, d, "documents").select("lang", F.explode(_words(F.col("text"))).alias("word")).where(F.col("word").rlike("^[A-Za-z]+$"))
    counts = words.groupBy("word").agg(F.count("*").alias("bnc"), (F.count_if(F.col("lang") == "en") * 2).alias("frq")).withColumn("translation", F.lower("word"))
    return W.build_ranked_dictionary(counts, 500)


DICTIONARY_TOPK_SQL = r"""
WITH words AS (SELECT lang, unnest(string_split_regex(text, '\s+')) AS word FROM documents),
counts AS (SELECT word, count(*) AS bnc, 2 * count(*) FILTER (WHERE lang = 'en') AS frq FROM words WHERE regexp_matches(word, '^[A-Za-z]+$') GROUP BY word),
ranked AS (SELECT word, least(bnc, nullif(frq, 0)) AS rank FROM counts),
best AS (SELECT word, rank FROM ranked QUALIFY row_number() OVER (PARTITION BY lower(word) ORDER BY rank, word) = 1)
SELECT word, rank, lower(word) AS translation FROM best ORDER BY rank, word LIMIT 500
"""


def dictionary_lookup(spark, d):
    words = table(spark, d, "documents").select(F.explode(_words(F.lower("text"))).alias("word")).where(F.col("word").rlike("^[a-z]+$")).distinct()
    entries = table(spark, d, "benchmark").select(F.explode(_words(F.lower("text"))).alias("entry_word")).where(F.col("entry_word").rlike("^[a-z]+$")).distinct()
    found = W.lookup_dictionary(words, entries).where("entry_word is not null")
    return found.groupBy("entry_word", "position").agg(F.count("*").alias("words"))


# --- memory


def _memory(spark, d) -> DataFrame:
    """Documents' paragraphs as memory: the source is the paragraph, the translation its reverse."""
    paras = _paragraphs(spark, d)
    return paras.select(
        F.lit("all").alias("doc_fingerprint"), F.lit("fr").alias("target_lang"), (F.col("para_idx") % 10).alias("page"), F.concat_ws("-", "doc_id", "para_idx").alias("paragraph_id"), F.col("text").alias("source"),
        F.reverse("text").alias("translation"), (F.col("doc_id") * 100_000 + F.col("para_idx")).alias("seq"), T.squeeze(F.col("text")).alias("normalized_source"),
    )


def memory_exact(spark, d):
    """Every document's first paragraph, looked up in the memory of the other paragraphs of all documents."""
    first = _paragraphs(spark, d).where("para_idx = 0").select(F.col("doc_id").alias("query_id"), F.sha2(T.squeeze(F.col("text")), 256).alias("h"))
    stored = _memory(spark, d).where("not paragraph_id like '%-0'").select(F.sha2("normalized_source", 256).alias("h"), "seq", "page")
    best = stored.groupBy("h").agg(F.max_by(F.struct("seq", "page"), F.struct((F.col("page") == 0).cast("int"), "seq")).alias("b"))
    return first.join(best, "h").select("query_id", F.col("b.seq").alias("memory_seq"), F.col("b.page").alias("page"))


MEMORY_EXACT_SQL = f"""
WITH {PARAS_SQL}, m AS (SELECT regexp_replace(text, '\\s+', ' ', 'g') AS t, doc_id * 100000 + para_idx AS seq, para_idx % 10 AS page, para_idx FROM paras)
SELECT q.doc_id AS query_id, arg_max(m.seq, (m.page = 0)::INT * 1000000000000 + m.seq) AS memory_seq, arg_max(m.page, (m.page = 0)::INT * 1000000000000 + m.seq) AS page
FROM paras q JOIN m ON m.t = regexp_replace(q.text, '\\s+', ' ', 'g') AND m.para_idx > 0 WHERE q.para_idx = 0 GROUP BY q.doc_id
"""


def memory_contained(spark, d):
    """Benchmark items that stand in a document's text, found by what both share: three words inside the item, or characters where it has under five words, then literally."""
    key = lambda c: T.ngrams(c, 3)
    docs = table(spark, d, "documents").select("doc_id", T.squeeze(F.col("text")).alias("t"))
    grams = docs.select("doc_id", F.explode(F.array_distinct(key(F.split("t", " ")))).alias("k"))
    items = table(spark, d, "benchmark").select("item_id", T.squeeze(F.col("text")).alias("q")).where("q <> ''")
    # the first and the last word may be parts of the document's words
    long = F.size(F.split("q", " ")) >= 5
    near = grams.join(items.where(long).withColumn("k", F.get(key(F.split("q", " ")), 1)), "k").select("doc_id", "item_id", "q").distinct()
    short = items.where(~long)
    if not short.isEmpty():
        side = lambda df, i, t, n: df.select(F.lit(n).alias("side"), F.col(i).alias("id"), F.col(t).alias("t"))
        pairs = inside_candidates(side(short, "item_id", "q", 1), side(docs, "doc_id", "t", 0), True).select(F.col("i1").alias("item_id"), F.col("i2").alias("doc_id"))
        near = near.unionByName(pairs.join(short, "item_id").select("doc_id", "item_id", "q").distinct())
    hit = near.join(docs, "doc_id").where(F.contains("t", F.col("q")))
    return hit.groupBy("item_id").agg(F.count("*").alias("documents"), F.min_by("doc_id", F.struct(F.length("t"), -F.col("doc_id"))).alias("best_doc_id"))


MEMORY_CONTAINED_SQL = r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark)
SELECT item_id, count(*) AS documents, arg_min(doc_id, {'a': length(t), 'b': -doc_id}) AS best_doc_id FROM b JOIN d ON contains(t, q) WHERE q <> '' GROUP BY item_id
"""


def memory_upsert_latest(spark, d):
    rows = table(spark, d, "conversations").withColumn("n", F.length("text"))
    return M.latest_by_key(rows.select("conv_id", "role", "turn", "n"), ["conv_id", "role"], ["turn", "n"])


MEMORY_UPSERT_SQL = "SELECT conv_id, role, turn, length(text) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, length(text) DESC) = 1"


def _confirmed(spark, d) -> DataFrame:
    """Turns of conversations as a batch of paragraphs: the turn's number is the page, its role the language, answers with a mark failed, and every seventh has a reading text."""
    t = table(spark, d, "conversations")
    return t.select(
        F.col("conv_id").cast("string").alias("doc_fingerprint"), F.concat_ws("_", F.lit("zh"), F.upper("role")).alias("target_lang"), (F.col("turn") % 2).cast("int").alias("page"), F.lit("p").alias("paragraph_id"), F.col("text").alias("source"),
        F.concat(F.lit("<style id='1'>"), "text", F.lit("</style> {v1}")).alias("translation"), F.when(F.col("turn") % 7 == 0, F.concat("text", F.lit("."))).alias("reading"), F.when(F.col("text").contains("!"), "failed").otherwise("succeeded").alias("status"), F.lit(None).cast("string").alias("quality"), F.col("turn").cast("long").alias("seq"),
    )


def memory_table(spark, d):
    """The memory after two batches, of even and of odd turns; keys are texts on one of two pages of a conversation."""
    rows = _confirmed(spark, d)
    return M.upsert_memory(M.upsert_memory(None, rows.where("seq % 2 = 0")), rows.where("seq % 2 = 1")).select("doc_fingerprint", "target_lang", "page", "source_hash", "seq", "formatting_incomplete", F.length("translation").alias("chars"), F.sha2("source", 256).alias("source_sha256"))


_CONFIRMED_SQL = r"""paired AS (
  SELECT conv_id::VARCHAR AS doc_fingerprint, 'zh-' || role AS target_lang, (turn % 2)::INT AS page, text, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS n,
    CASE WHEN turn % 7 = 0 THEN text || '.' ELSE text || ' ⟦原排版内容⟧' END AS shown, turn % 7 <> 0 AS incomplete
  FROM conversations WHERE text IS NOT NULL AND strpos(text, '!') = 0)"""
MEMORY_TABLE_SQL = rf"""
WITH {_CONFIRMED_SQL}
SELECT doc_fingerprint, target_lang, page, sha256(n) AS source_hash, min(turn)::BIGINT AS seq, arg_max(incomplete, turn) AS formatting_incomplete, arg_max(length(shown), turn)::INT AS chars, sha256(arg_min(text, turn)) AS source_sha256
FROM paired WHERE n <> '' GROUP BY doc_fingerprint, target_lang, page, n
"""


def memory_lookup(spark, d):
    """Of every turn its first half (and of every third all of it) looked up in its conversation's memory, from page 0."""
    rows = M.upsert_memory(None, _confirmed(spark, d))
    t = table(spark, d, "conversations")
    part = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.substring("text", 1, F.floor(F.length("text") / 2).cast("int")))
    lang = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("ZH_"), F.upper("role")))  # some ask in one language only
    asked = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("conv_id").cast("string").alias("doc_fingerprint"), part.alias("text"), F.lit(0).alias("page"), lang.alias("lang"))
    return M.lookup_memory(asked, rows).select("query_id", "match_type", "memory_seq", "match_page", "match_lang", "formatting_incomplete")


MEMORY_LOOKUP_SQL = rf"""
WITH {_CONFIRMED_SQL},
m AS (SELECT doc_fingerprint, target_lang, page, n, min(turn)::BIGINT AS seq, arg_max(incomplete, turn) AS incomplete FROM paired WHERE n <> '' GROUP BY doc_fingerprint, target_lang, page, n),
q AS (SELECT conv_id * 1000 + turn AS query_id, conv_id::VARCHAR AS doc, CASE WHEN turn % 4 = 1 THEN 'zh-' || lower(role) END AS lang, trim(regexp_replace(CASE WHEN turn % 3 = 0 THEN text ELSE substr(text, 1, length(text) // 2) END, '\s+', ' ', 'g')) AS w FROM conversations),
f AS (SELECT query_id, seq, page, target_lang, incomplete, CASE WHEN n = w THEN 'exact' ELSE 'contained' END AS kind, row_number() OVER (PARTITION BY query_id ORDER BY n = w DESC, page = 0 DESC, CASE WHEN n = w THEN 0 ELSE length(n) END, seq DESC, page) AS k
  FROM q JOIN m ON doc = doc_fingerprint AND contains(n, w) WHERE w <> '' AND (lang IS NULL OR lang = target_lang))
SELECT q.query_id, kind AS match_type, seq AS memory_seq, page AS match_page, target_lang AS match_lang, incomplete AS formatting_incomplete FROM q LEFT JOIN f ON f.query_id = q.query_id AND k = 1
"""


def cache_lookup(spark, d):
    """Line items as requests for a response by part and quantity; the first half of the orders has filled the cache, the last writing of a key wins."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("quantity"), "l_extendedprice")
    half = F.col("l_orderkey") % 2
    cache = items.where(half == 0).select("part", "quantity", F.col("l_extendedprice").alias("response"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    found = M.lookup_cache(items.where(half == 1), cache, ["part", "quantity"])
    return found.select("l_orderkey", "l_linenumber", "cached")


CACHE_LOOKUP_SQL = """
WITH c AS (SELECT l_partkey AS part, l_quantity::INT AS quantity, l_extendedprice AS response FROM lineitem WHERE l_orderkey % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY l_partkey, l_quantity::INT ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1)
SELECT l_orderkey, l_linenumber, response AS cached FROM lineitem LEFT JOIN c ON part = l_partkey AND quantity = l_quantity::INT WHERE l_orderkey % 2 = 1
"""


def reverse_lookup(spark, d):
    """The starts of questions and answers, looked up among the pairs of their page; four pairs of a conversation are a page, which is shown twice, translated and as it was."""
    turns = table(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("nth")).agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("source"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("translation"))
    pairs = turns.where("source is not null and translation is not null").select(F.col("conv_id").alias("doc_id"), "nth", (F.floor(F.col("nth") / 4) + 1).alias("page"), "source", "translation")
    shown = F.explode(F.array(F.struct((F.col("page") * 2).alias("out_page"), "page"), F.struct((F.col("page") * 2 + 1).alias("out_page"), (-F.col("page")).alias("page")))).alias("p")
    pages = pairs.select("doc_id", "page").distinct().select("doc_id", shown).select("doc_id", "p.*")
    side = lambda k, text: F.struct((F.col("doc_id") * 1000 + F.col("nth") * 2 + k).alias("selection_id"), (F.col("page") * 2 + k).alias("out_page"), F.substring(text, 1, 5).alias("text"))
    asked = pairs.select("doc_id", F.explode(F.array(side(0, "translation"), side(1, "source"))).alias("s")).select("doc_id", "s.*")
    return M.reverse_lookup(asked, pages, pairs.select("doc_id", "page", "source", "translation")).select("selection_id", F.length("source").alias("source_chars"), "page", "candidates", "uncertain")


REVERSE_LOOKUP_SQL = r"""
WITH t AS (SELECT conv_id, turn // 2 AS nth, turn // 8 + 1 AS page, max(text) FILTER (WHERE role = 'user') AS source, max(text) FILTER (WHERE role = 'assistant') AS translation FROM conversations GROUP BY ALL),
p AS (SELECT * FROM t WHERE source IS NOT NULL AND translation IS NOT NULL),
asked AS (SELECT conv_id, page, conv_id * 1000 + nth * 2 AS selection_id, 0 AS side, substr(translation, 1, 5) AS text FROM p UNION ALL SELECT conv_id, page, conv_id * 1000 + nth * 2 + 1, 1, substr(source, 1, 5) FROM p),
wanted AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS w FROM asked),
found AS (SELECT selection_id, p.source, p.page, row_number() OVER (PARTITION BY selection_id ORDER BY length(p.translation), p.source, p.page) AS k, count(*) OVER (PARTITION BY selection_id) AS n
  FROM wanted a JOIN p ON p.conv_id = a.conv_id AND p.page = a.page AND w <> '' AND contains(regexp_replace(CASE WHEN side = 0 THEN p.translation ELSE p.source END, '\s+', ' ', 'g'), w))
SELECT a.selection_id, length(f.source) AS source_chars, f.page, coalesce(n, 0)::BIGINT AS candidates, coalesce(n, 0) > 1 OR length(w) < 4 AS uncertain
FROM wanted a LEFT JOIN found f ON f.selection_id = a.selection_id AND k = 1
"""


def import_new(spark, d):
    """Customers of odd keys imported over those of even keys, known by segment and rounded balance, and by a number that some share."""
    rows = table(spark, d, "customer").select("c_custkey", F.concat_ws("|", "c_mktsegment", (F.col("c_acctbal") / 10).cast("int").cast("string")).alias("identity"), (F.col("c_custkey") % 5000).alias("id"), F.col("c_custkey").alias("seq"))
    return M.import_new(rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 2 = 1")).select("c_custkey", "status")


IMPORT_NEW_SQL = """
WITH rows AS (SELECT c_custkey, c_mktsegment || '|' || trunc(c_acctbal / 10)::INT AS identity, c_custkey % 5000 AS id FROM customer),
fresh AS (SELECT * FROM rows WHERE c_custkey % 2 = 1 AND identity NOT IN (SELECT identity FROM rows WHERE c_custkey % 2 = 0) AND id NOT IN (SELECT id FROM rows WHERE c_custkey % 2 = 0)),
added AS (SELECT c_custkey FROM fresh QUALIFY row_number() OVER (PARTITION BY identity ORDER BY c_custkey) = 1)
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM added) THEN 'added' ELSE 'conflict' END AS status FROM rows WHERE c_custkey % 2 = 1
"""


def source_map(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).cast("int").alias("page"), F.col("turn").alias("seq"), F.col("role").alias("source"), F.length("text").cast("string").alias("translation"))
    return M.source_map(turns).select("doc_id", F.size("paragraphs").alias("pages"), "source_map_hash")


SOURCE_MAP_SQL = """
WITH t AS (SELECT conv_id AS doc_id, turn // 2 AS page, '[' || string_agg('{"source":"' || role || '","translation":"' || length(text) || '"}', ',' ORDER BY turn, role, length(text)::VARCHAR) || ']' AS pairs FROM conversations GROUP BY ALL)
SELECT doc_id, count(*)::INT AS pages, sha256('{' || string_agg('"' || page || '":' || pairs, ',' ORDER BY page) || '}') AS source_map_hash FROM t GROUP BY doc_id
"""


# --- paragraphs


def skip_reasons(spark, d):
    rows = _paragraphs(spark, d).withColumn("reason", F.coalesce(T.skip_reason(F.col("text")), F.lit("none"))).withColumn("length", F.coalesce(T.length_class(F.col("text")), F.lit("other")))
    return rows.groupBy("reason", "length").agg(F.count("*").alias("paragraphs"))


LENGTH_SQL = "CASE WHEN w BETWEEN 3 AND 40 THEN 'short' WHEN w BETWEEN 41 AND 180 THEN 'paragraph' WHEN w BETWEEN 181 AND 600 THEN 'long' WHEN w BETWEEN 601 AND 1500 THEN 'extended' END"
SKIP_REASONS_SQL = f"""
WITH {PARAS_SQL}, r AS (SELECT coalesce({REASON_SQL}, 'none') AS reason, len(regexp_extract_all(text, '\\S+')) AS w FROM paras)
SELECT reason, coalesce({LENGTH_SQL}, 'other') AS length, count(*) AS paragraphs FROM r GROUP BY ALL
"""


def latest_title(spark, d):
    rows = P.latest_title(table(spark, d, "conversations").withColumn("start", F.substring("text", 1, 20)), ["conv_id"], "turn", F.col("role") == "user", "start")
    return rows.where("role = 'assistant'").select("conv_id", "turn", "first_title", "latest_title")


LATEST_TITLE_SQL = """
SELECT conv_id, turn, first_title, latest_title FROM (
  SELECT *, first_value(CASE WHEN role = 'user' THEN substr(text, 1, 20) END IGNORE NULLS) OVER w AS first_title, last_value(CASE WHEN role = 'user' THEN substr(text, 1, 20) END IGNORE NULLS) OVER w AS latest_title
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant'
"""


def neighbor_context(spark, d):
    return P.neighbor_context(table(spark, d, "conversations"), ["conv_id"], "turn", n=40).select("conv_id", "turn", "previous_context", "next_context")


NEIGHBOR_CONTEXT_SQL = """
SELECT conv_id, turn, CASE WHEN length(b) > 40 THEN right(b, 40) ELSE b END AS previous_context, substr(a, 1, 40) AS next_context
FROM (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
"""


def _paged(spark, d) -> DataFrame:
    rows = P.part_ids(_paragraphs(spark, d), 20, "para_idx").withColumn("page", F.col("part").cast("int"))
    return rows.withColumn("y2", (F.crc32("text") % 500).cast("double")).withColumn("label", F.when(F.crc32("text") % 5 == 0, "title").otherwise("text"))


def boundary_pairs(spark, d):
    return P.boundary_pairs(_paged(spark, d).select("doc_id", "page", "para_idx", "y2", "label"))


def batches_by_budget(spark, d):
    rows = _paged(spark, d).select("doc_id", "page", "para_idx", T.word_count(F.col("text")).alias("tokens"))
    return P.batch_by_budget(rows, ["doc_id", "page"], "para_idx", "tokens")


def batches_from_sql(spark, d):
    """batches_by_budget as a table function in SQL."""
    tables.register(spark)
    rows = _paged(spark, d).select("doc_id", "page", "para_idx", T.word_count(F.col("text")).alias("tokens"))
    return spark.sql("SELECT * FROM budget_batches(TABLE({rows}) PARTITION BY (doc_id, page) ORDER BY (para_idx), 'tokens', 200, 5)", rows=rows)


BATCHES_SQL = f"""
WITH RECURSIVE {PARAS_SQL},
sized AS (SELECT doc_id, para_idx // 20 AS page, para_idx, len(regexp_extract_all(text, '\\S+'))::INT AS tokens FROM paras),
walk AS (
  SELECT doc_id, page, para_idx, tokens, 0 AS batch, tokens AS total, 1 AS held FROM sized WHERE para_idx % 20 = 0
  UNION ALL
  SELECT s.doc_id, s.page, s.para_idx, s.tokens, w.batch + (w.total > 200 OR w.held > 5)::INT, CASE WHEN w.total > 200 OR w.held > 5 THEN s.tokens ELSE w.total + s.tokens END, CASE WHEN w.total > 200 OR w.held > 5 THEN 1 ELSE w.held + 1 END
  FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.page = w.page AND s.para_idx = w.para_idx + 1)
SELECT doc_id, page::INT AS page, para_idx, tokens, batch FROM walk
"""


def reference_flags(spark, d):
    rows = _paged(spark, d).withColumn("pages", F.max("page").over(Window.partitionBy("doc_id")) + 1)
    text = F.when(F.crc32("text") % 17 == 0, "References").when(F.crc32("text") % 3 == 0, F.concat(F.lit("[1] "), "text")).otherwise(F.col("text"))
    return P.reference_flags(rows.withColumn("text", text)).groupBy("doc_id").agg(F.count_if("is_reference").alias("references"), F.count("*").alias("paragraphs"))


def _fragments(spark, d) -> DataFrame:
    """Every paragraph as two fragments, cut after half of its characters, with a hyphen where that is inside a word; the second stands in the next column."""
    half = F.floor(F.length("text") / 2).cast("int")
    left, right = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    left = F.when(left.rlike("[A-Za-z]$") & right.rlike("^[A-Za-z]"), F.concat(left, F.lit("-"))).otherwise(left)
    rows = _paged(spark, d).select("doc_id", "page", "label", "para_idx", F.posexplode(F.array(left, right)).alias("nth", "text"))
    place = {"para_idx": F.col("para_idx") * 2 + F.col("nth"), "x": F.col("nth") * 100.0, "x2": F.col("nth") * 100.0 + 90, "y2": F.col("nth") * 100.0}
    return rows.withColumns(place).drop("nth")


def continuations(spark, d):
    out = P.continuation_groups(_fragments(spark, d))
    return out.where("continuation_group is not null").select("doc_id", "para_idx", "continues", "continuation_group", F.length("previous_context").alias("before"), F.length("next_context").alias("after"), F.sha2("body_text", 256).alias("body_sha256"))


def sentence_align(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("source"), F.max_by("text", "turn").alias("translation"))
    terms = F.transform(F.array_intersect(_words(F.col("source")), _words(F.col("translation"))), lambda w: F.struct(w.alias("source"), w.alias("target")))
    return P.align_sentences(turns.select(F.col("conv_id").alias("pair_id"), "source", "translation", terms.alias("terms")))


def text_volume(spark, d):
    return P.text_volume(table(spark, d, "documents"), "lang", "source")


TEXT_VOLUME_SQL = r"SELECT lang, source, sum(length(text))::BIGINT AS chars, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS tokens, count(text) AS texts FROM documents GROUP BY ALL"


def safe_csv(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.concat(F.lit("-"), "c_mktsegment")).alias("a"), F.col("c_name").alias("b"))
    return files.safe_csv(rows)


SAFE_CSV_SQL = "SELECT c_custkey, '''' || CASE WHEN c_custkey % 3 = 0 THEN '=' || c_name ELSE '-' || c_mktsegment END AS a, c_name AS b FROM customer"


def attachment_names(spark, d):
    """Titles for orders by a template."""
    values = {"title": F.col("o_orderkey").cast("string"), "type": F.col("o_orderpriority"), "year": F.year("o_orderdate"), "author": F.lit(None).cast("string"), "language": F.lit("en")}
    return table(spark, d, "orders").select("o_orderkey", T.render_template("{title} · {type}  {author} ({year})", values).alias("name"))


ATTACHMENT_SQL = "SELECT o_orderkey, o_orderkey || ' · ' || o_orderpriority || ' (' || year(o_orderdate) || ')' AS name FROM orders"


def text_checks(spark, d):
    """Simple text predicates over the documents' paragraphs, counted by language."""
    c = F.col("text")
    return _paragraphs(spark, d, "lang").groupBy("lang").agg(
        F.count_if(T.punctuation_only(c)).alias("punctuation_only"), F.count_if(T.has_han(c)).alias("han"), F.count_if(T.prose_like(c)).alias("prose_like"), F.count_if(T.safe_label(c)).alias("safe_labels"),
        F.sum(F.size(T.latin_words(c))).alias("latin_words"), F.sum(F.size(T.shingles(c, 5))).alias("shingles"), F.count_if(T.pages_selected(F.col("para_idx") + 1, "1-3,7,9-")).alias("selected"),
    )


TEXT_CHECKS_SQL = rf"""
WITH {PARAS_SQL}, w AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+') AS words, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS tokens FROM paras)
SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '^[\p{{P}}\s]+$')) AS punctuation_only, count(*) FILTER (WHERE regexp_matches(text, '[㐀-鿿]')) AS han,
  count(*) FILTER (WHERE len(list_filter(words, lambda x: lower(x) = x AND length(x) > 2)) >= 3 OR lower(trim(text)) IN ('abstract', 'introduction', 'discussion', 'conclusion', 'conclusions', 'references', 'acknowledgments', 'acknowledgements')) AS prose_like,
  count(*) FILTER (WHERE length(text) <= 200 AND regexp_matches(text, '^[a-zA-Z0-9][a-zA-Z0-9_.-]*(?:[/:][a-zA-Z0-9][a-zA-Z0-9_.-]*)*$') AND NOT regexp_matches(text, '(?i)(?:sk-|Bearer|api[_-]?key|token=)')) AS safe_labels,
  sum(len(words))::BIGINT AS latin_words, sum(len(list_distinct(list_transform(range(1, greatest(len(tokens) - 3, 1)), lambda i: array_to_string(tokens[i:i+4], ' ')))))::BIGINT AS shingles,
  count(*) FILTER (WHERE para_idx + 1 BETWEEN 1 AND 3 OR para_idx + 1 = 7 OR para_idx + 1 >= 9) AS selected
FROM w GROUP BY lang
"""

QUERIES = {f.__name__: f for f in (term_hits_by_lang, auto_glossary_vote, term_language_override, term_conflicts, term_source_counts, pack_status, dictionary_topk, dictionary_lookup, memory_exact, memory_contained, memory_upsert_latest, memory_table, memory_lookup, cache_lookup, reverse_lookup, import_new, source_map, skip_reasons, latest_title, neighbor_context, boundary_pairs, batches_by_budget, batches_from_sql, reference_flags, continuations, sentence_align, text_volume, safe_csv, attachment_names, text_checks)}
SQL = {
    "term_hits_by_lang": TERM_HITS_SQL, "auto_glossary_vote": AUTO_GLOSSARY_SQL, "term_language_override": TERM_LANGUAGE_SQL, "term_conflicts": TERM_CONFLICTS_SQL, "term_source_counts": TERM_SOURCE_COUNTS_SQL, "pack_status": PACK_STATUS_SQL,
    "dictionary_topk": DICTIONARY_TOPK_SQL, "memory_exact": MEMORY_EXACT_SQL, "memory_contained": MEMORY_CONTAINED_SQL, "memory_upsert_latest": MEMORY_UPSERT_SQL, "cache_lookup": CACHE_LOOKUP_SQL, "memory_table": MEMORY_TABLE_SQL, "memory_lookup": MEMORY_LOOKUP_SQL, "source_map": SOURCE_MAP_SQL, "reverse_lookup": REVERSE_LOOKUP_SQL,
    "skip_reasons": SKIP_REASONS_SQL, "latest_title": LATEST_TITLE_SQL, "neighbor_context": NEIGHBOR_CONTEXT_SQL, "batches_by_budget": BATCHES_SQL, "batches_from_sql": BATCHES_SQL, "text_volume": TEXT_VOLUME_SQL, "safe_csv": SAFE_CSV_SQL, "attachment_names": ATTACHMENT_SQL, "text_checks": TEXT_CHECKS_SQL, "import_new": IMPORT_NEW_SQL,
}
