"""One query per operator of this package, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import exact_dedup, media_tiff, merkle, mixing, packing, pii, quality, resample, sharding, simhash, toxicity, url_filters, warc
from bitloom.llm.common import shared_folder

#: The tokenizer's vocabulary file; a name that the tokenizer package resolves.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"), sharding.tree(16), sharding.tree(17))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


#: Names that the query's lists block from the start, as parts of host names.
BAD_NAMES = ("ads-track", "casino-win", "spam-farm")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries that follow from the URLs of pages: fixed names, some domains added, removed and added again, some paths allowed, some pages (named by two segments, in capitals) blocked."""
    url = pages.select(F.regexp_replace(url_filters.host_of(F.col("url")), r"^(www|blog|m)\.", "").alias("host"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*/([a-z]+)/", 1).alias("part")).where("host <> ''").distinct()
    day = lambda salt, n: F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), F.col("host"))), 1, 8), 16, 10).cast("long") % n
    at = lambda days: F.timestamp_seconds(F.lit(1704067200) + days * 86400)
    hosts = url.select("host").distinct().withColumns({"a": day("add", 300), "k": day("keep", 120) + 1, "r": day("rare", 5)})
    entry = lambda rows, name, pattern, verdict, action, when: rows.select(F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), at(when).alias("at"))
    bad = hosts.where(F.col("host").rlike("|".join(BAD_NAMES)))
    some = hosts.where("r = 0")
    out = entry(bad, "abuse", F.col("host"), "block", "add", F.lit(30))
    out = out.unionByName(entry(some, "review", F.col("host"), "block", "add", F.col("a")))
    out = out.unionByName(entry(some, "review", F.col("host"), "block", "remove", F.col("a") + F.col("k")))
    out = out.unionByName(entry(some.where("k % 2 = 0"), "review", F.col("host"), "block", "add", F.col("a") + F.col("k") + 45))
    paths = url.where("part <> ''").withColumns({"a": day("path", 200), "r": day("allow", 7)}).where("r = 0")
    out = out.unionByName(entry(paths, "trusted", F.concat("host", F.lit("/"), "part"), "allow", "add", F.col("a")))
    leaf = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*/[a-z]+/([^/?#]+)", 1)
    deep = pages.select(F.regexp_replace(url_filters.host_of(F.col("url")), r"^(www|blog|m)\.", "").alias("site"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*/([a-z]+)/", 1).alias("part"), leaf.alias("leaf")).where("site <> '' and leaf <> ''").distinct()
    named = deep.select(F.concat_ws("/", F.upper("site"), F.upper("part"), F.upper("leaf")).alias("host")).withColumns({"a": day("deep", 250), "r": day("pick", 9)})
    return out.unionByName(entry(named.where("r = 0"), "single", F.col("host"), "block", "add", F.col("a")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 7919 % 365) * 86400 + F.col("page_id") * 104729 % 86400)
    return url_filters.judge(pages.withColumn("fetched_at", fetched), list_entries(pages))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_tiff.store(_table(spark, sf_dir, "documents"))
    back = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), media_tiff.pages_of("media").alias("pages"))
    payload = F.when(F.size("pages") == 1, F.col("pages")[0]["pixels"]).otherwise(F.aggregate("pages", F.lit(b""), lambda a, p: F.concat(a, p["pixels"])))
    told = F.array_join(F.transform("pages", lambda p: F.concat_ws(",", p["width"].cast("string"), p["height"].cast("string"), p["compression"].cast("string"), p["predictor"].cast("string"), p["parts"].cast("string"), p["feature"])), "|")
    back = back.select("doc_id", "n_bytes", "media_bytes", "media_sha256", payload.alias("payload"), told.alias("feature"))
    size = F.octet_length("payload")
    return back.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring(F.col("payload"), size - 63, F.lit(64))).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def toxic_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    allowed = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    return toxicity.fit(_table(spark, sf_dir, "documents"), labels, allowed=allowed)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_table(spark, sf_dir, "documents"), toxic_model(spark, sf_dir))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    bucket = F.crc32(F.col("doc_id").cast("string")) % 4
    net = quality.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"), allowed=bucket != 2)
    scored = quality.score(docs, net)
    return scored.select("doc_id", (bucket == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(hit, merkle.leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.COLUMNS]))
    proved = merkle.prove(merkle.manifest(docs, carry={"doc_id": F.col("doc_id"), "changed": changed}))
    own = merkle.hex_of(F.col("digest"))
    folded = proved.select("doc_id", own.alias("leaf"), "subroot", "root", merkle.digest(merkle.proof_text(F.col("path"))).alias("proof_sha256"), merkle.fold(F.coalesce("changed", own), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder, "page_id", "html", "url")
    back = warc.resolve(warc.read(spark, folder, payloads=False))
    return back.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _tree_sql(shards: list[sharding.Shard]) -> str:
    """The descent as one SQL expression over a column named key."""
    weight: dict[tuple[int, ...], float] = {}
    for s in shards:
        for path in ((s.region,), (s.region, s.rack), (s.region, s.rack, s.shard)):
            weight[path] = weight.get(path, 0.0) + s.weight

    def pick(above: tuple[int, ...]) -> str:
        under = [p for p in sorted(weight) if len(p) == len(above) + 1 and p[: len(above)] == above]
        if len(under) == 1:
            return pick(under[0]) if len(above) < 2 else str(under[0][-1])
        draws = ", ".join(f"{{'d': -ln((('0x' || substr(md5('{'/'.join(map(str, p))}|' || key), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(16**13)!r}::DOUBLE) / {weight[p]!r}::DOUBLE, 'i': {i if len(above) < 2 else p[-1]}}}" for i, p in enumerate(under))
        chosen = f"(list_sort([{draws}])[1]).i"
        if len(above) == 2:
            return chosen
        return f"CASE {chosen} " + " ".join(f"WHEN {i} THEN {pick(p)}" for i, p in enumerate(under)) + " END"

    return pick(())


OP1_SQL = f"""
WITH crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)),
keyed AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
placed AS (
  SELECT doc_id, key, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
         ({_tree_sql(sharding.tree(16))})::INT AS shard, ({_tree_sql(sharding.tree(17))})::INT AS grown_shard
  FROM keyed, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5('slot|' || key), doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""

OP3_SQL = r"""
WITH seen AS (
  SELECT page_id, url, to_timestamp(1704067200 + (page_id * 7919 % 365) * 86400 + page_id * 104729 % 86400)::TIMESTAMP AS fetched_at,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1) AS host
  FROM pages),
parts AS (
  SELECT DISTINCT regexp_replace(host, '^(www|blog|m)\.', '') AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*/([a-z]+)/', 1) AS part FROM seen WHERE host <> ''),
days AS (
  SELECT host, ('0x' || substr(md5('add|' || host), 1, 8))::BIGINT % 300 AS a, ('0x' || substr(md5('keep|' || host), 1, 8))::BIGINT % 120 + 1 AS k,
         ('0x' || substr(md5('rare|' || host), 1, 8))::BIGINT % 5 AS r
  FROM (SELECT DISTINCT host FROM parts WHERE host <> '')),
named AS (
  SELECT DISTINCT upper(regexp_replace(host, '^(www|blog|m)\.', '') || '/' || regexp_extract(url, '^[A-Za-z]+://[^/?#]*/([a-z]+)/', 1) || '/' || regexp_extract(url, '^[A-Za-z]+://[^/?#]*/[a-z]+/([^/?#]+)', 1)) AS page
  FROM seen WHERE host <> '' AND regexp_matches(url, '^[A-Za-z]+://[^/?#]*/[a-z]+/[^/?#]+')),
entries AS (
  SELECT 'abuse' AS list, host AS pattern, 'block' AS verdict, 'add' AS action, 30 AS day FROM days WHERE regexp_matches(host, 'ads-track|casino-win|spam-farm')
  UNION ALL SELECT 'review', host, 'block', 'add', a FROM days WHERE r = 0
  UNION ALL SELECT 'review', host, 'block', 'remove', a + k FROM days WHERE r = 0
  UNION ALL SELECT 'review', host, 'block', 'add', a + k + 45 FROM days WHERE r = 0 AND k % 2 = 0
  UNION ALL SELECT 'trusted', host || '/' || part, 'allow', 'add', ('0x' || substr(md5('path|' || host), 1, 8))::BIGINT % 200
            FROM parts WHERE host <> '' AND part <> '' AND ('0x' || substr(md5('allow|' || host), 1, 8))::BIGINT % 7 = 0
  UNION ALL SELECT 'single', lower(page), 'block', 'add', ('0x' || substr(md5('deep|' || page), 1, 8))::BIGINT % 250 FROM named WHERE ('0x' || substr(md5('pick|' || page), 1, 8))::BIGINT % 9 = 0),
valid AS (
  SELECT * FROM (
    SELECT list, pattern, verdict, action, to_timestamp(1704067200 + day * 86400)::TIMESTAMP AS valid_from,
           lead(to_timestamp(1704067200 + day * 86400)::TIMESTAMP) OVER (PARTITION BY list, pattern ORDER BY day) AS valid_to
    FROM entries) WHERE action = 'add'),
asked AS (
  SELECT page_id, url, fetched_at, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(segments) + 1), lambda i: host || '/' || array_to_string(segments[1:i], '/'))))) AS pattern
  FROM (SELECT *, list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1)), '/'), lambda x: x <> '') AS segments
        FROM (SELECT DISTINCT * FROM seen) WHERE host <> '')),
best AS (
  SELECT page_id, url, fetched_at, count(*) AS matches,
         min_by({'v': verdict, 'l': list, 'p': pattern, 'f': valid_from, 't': valid_to}, {'a': -length(pattern), 'b': verdict <> 'allow', 'c': list, 'd': pattern}) AS e
  FROM asked JOIN valid USING (pattern) WHERE valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY ALL)
SELECT s.page_id, s.url, s.fetched_at, s.host, coalesce(e.v, 'pass') AS decision, e.l AS list, e.p AS pattern, e.f AS valid_from, e.t AS valid_to,
       coalesce(matches, 0)::BIGINT AS matches
FROM seen s LEFT JOIN best b ON s.page_id IS NOT DISTINCT FROM b.page_id AND s.url IS NOT DISTINCT FROM b.url AND s.fetched_at = b.fetched_at
"""

OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS shuffle_key
  FROM documents),
totals AS (SELECT no_source, source_key, sum(size)::BIGINT AS source_size FROM sized GROUP BY no_source, source_key),
sources AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY no_source, source_key) - 1) % 3 AS weight, (sum(source_size) OVER ())::BIGINT AS budget
  FROM totals),
levels AS (
  SELECT *, (3 * source_size)::DOUBLE / weight AS ratio,
         (budget - 3 * coalesce(sum(source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, no_source, source_key
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, no_source, source_key
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, no_source, source_key LIMIT 1),
aims AS (SELECT l.no_source, l.source_key, l.source_size, l.budget, least(3.0::DOUBLE * l.source_size, c.level * l.weight) AS target FROM levels l, chosen c),
queued AS (
  SELECT s.*, a.source_size, a.budget, a.target,
         sum(s.size) OVER (PARTITION BY s.no_source, s.source_key ORDER BY s.shuffle_key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS reach
  FROM sized s JOIN aims a USING (no_source, source_key)),
turns AS (SELECT *, (source_size * turn + reach)::DOUBLE / nullif(target, 0) AS finish FROM queued, (SELECT unnest([0, 1, 2]) AS turn)),
merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, no_source, source_key, shuffle_key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM turns WHERE size > 0 AND finish IS NOT NULL),
held AS (SELECT doc_id, size, shuffle_key, reach, no_source, source_key, count(*) AS copies FROM merged WHERE upto <= budget GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(h.copies, 0))::BIGINT AS taken
FROM queued q LEFT JOIN held h ON q.no_source = h.no_source AND q.source_key = h.source_key AND q.shuffle_key = h.shuffle_key
 AND q.reach = h.reach AND q.size = h.size AND q.doc_id IS NOT DISTINCT FROM h.doc_id
"""

OP10_SQL = r"""
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM normal
"""


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)),
told AS (
  SELECT row_number() OVER () AS id, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS part,
    coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars, '-') AS size, coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1), '-') AS more, coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail,
    list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
leaves AS (
  SELECT id, doc_id, part, sha256(head || size || tail) AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 THEN sha256(head || more || tail) ELSE sha256(head || size || tail) END AS given
  FROM told, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY part) AS n FROM leaves),
up AS (
  SELECT part, 0 AS level, pos, leaf AS d, n FROM placed
  UNION ALL SELECT part, level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY part, level, pos // 2, n),
parts AS (SELECT part, d AS subroot, row_number() OVER (ORDER BY part) - 1 AS place, count(*) OVER () AS parts FROM up WHERE n = 1),
over AS (
  SELECT 0 AS level, place AS pos, subroot AS d, parts AS n FROM parts
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2 FROM over WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT p.id, u.level, CASE WHEN u.pos < p.pos >> u.level THEN u.d ELSE '' END AS l, CASE WHEN u.pos > p.pos >> u.level THEN u.d ELSE '' END AS r
  FROM placed p JOIN up u ON p.part = u.part AND u.n > 1 AND u.pos // 2 = p.pos >> (u.level + 1)
  UNION ALL
  SELECT p.id, 1000 + o.level, CASE WHEN o.pos < q.place >> o.level THEN o.d ELSE '' END, CASE WHEN o.pos > q.place >> o.level THEN o.d ELSE '' END
  FROM placed p JOIN parts q USING (part) JOIN over o ON o.n > 1 AND o.pos // 2 = q.place >> (o.level + 1)),
joined AS (SELECT id, level, string_agg(l, '') AS l, string_agg(r, '') AS r FROM steps GROUP BY id, level),
paths AS (SELECT id, list({'l': l, 'r': r} ORDER BY level) AS path, string_agg(l || r, '' ORDER BY level) AS proof FROM joined GROUP BY id),
folded AS (
  SELECT p.*, q.subroot, (SELECT d FROM over WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    (list_reduce(list_prepend({'l': given, 'r': ''}, coalesce(path, [])), lambda a, s: {'l': sha256(s.l || a.l || s.r), 'r': ''})).l AS folded_root
  FROM placed p JOIN parts q USING (part) LEFT JOIN paths USING (id))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


OP12_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)),
texts AS (SELECT 0 AS part, doc_id, row_number() OVER () AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), coalesce(text, '') FROM benchmark),
listed AS (SELECT part, doc_id, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS words FROM texts),
each AS (SELECT part, id, unnest(words) AS word FROM listed),
sums AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM each), crc),
counts AS (SELECT bucket, count(*) FILTER (part = 0) AS s, count(*) FILTER (part = 1) AS t FROM each JOIN sums USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts),
weights AS (SELECT id, sum(gain)::BIGINT AS weight FROM each JOIN sums USING (word) JOIN gains USING (bucket) WHERE part = 0 GROUP BY id),
scored AS (
  SELECT doc_id, l.id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM listed l LEFT JOIN weights w ON l.id = w.id WHERE part = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""


OP13_SQL = """
WITH seen AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS id FROM pages),
sums AS (SELECT page_id, html, id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM seen),
ranked AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, id) AS place, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, id) AS best FROM sums)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN best END AS refers_to
FROM ranked
"""


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_pii": op2_pii,
        "op3_url_filters": op3_url_filters,
        "op4_simhash": op4_simhash,
        "op5_mixing": op5_mixing,
        "op6_packing": op6_packing,
        "op7_tiff": op7_tiff,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_merkle": op11_merkle,
        "op12_resampling": op12_resampling,
        "op13_warc": op13_warc,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op3_url_filters": OP3_SQL, "op5_mixing": OP5_SQL, "op10_exact_dedup": OP10_SQL, "op11_merkle": OP11_SQL, "op12_resampling": OP12_SQL, "op13_warc": OP13_SQL}
