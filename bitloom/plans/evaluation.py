"""Queries on documents, labels, benchmark, events and parts as datasets, reviews and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import numbers as N
from bitloom.functions import text as T
from bitloom.functions.storage import cut
from bitloom.operators import evaluate as E

SEED = "61027"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(spark, d) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")


def near_duplicates(spark, d):
    """Pairs of different texts (by class representative) that share 0.8 of the smaller's 5-word shingles or contain one another."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return E.near_duplicates(E.without_copies(docs), shortest=1).select("left_id", "right_id", "shared", F.round("similarity", 6).alias("similarity"), "contains")


def leakage_pairs(spark, d):
    """Documents (by class representative) that overlap benchmark items, with the document's side labelled by source and split by language."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    docs = cut(E.may_overlap(table(spark, d, "documents").select("doc_id", "text"), items))  # all copies of a text or none, so classes are those of the whole table
    own = cut(docs.join(E.text_classes(docs).where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi"))
    return E.near_duplicates(own, other=items, shortest=1).select("left_id", "right_id", "shared", F.round("similarity", 6).alias("similarity"), "contains")


_NORMAL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_GRAMS = "list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' ')))"


def _pairs_sql(right: str, differ: str) -> str:
    """differ: when two rows are a pair, in terms of {0}.id and {1}.id."""
    return rf"""
WITH a AS (SELECT id, t, string_split(t, ' ') AS w FROM (SELECT min(doc_id) AS id, t FROM (SELECT doc_id, {_NORMAL.format("text")} AS t FROM documents) WHERE t <> '' GROUP BY t)),
b AS (SELECT id, t, string_split(t, ' ') AS w FROM ({right}) WHERE t <> ''),
ga AS (SELECT id, unnest({_GRAMS}) AS g FROM a), gb AS (SELECT id, unnest({_GRAMS}) AS g FROM b),
na AS (SELECT id, count(*) AS n FROM ga GROUP BY id), nb AS (SELECT id, count(*) AS n FROM gb GROUP BY id),
s AS (SELECT ga.id AS l, gb.id AS r, count(*) AS shared FROM ga JOIN gb USING (g) WHERE {differ.format("ga", "gb")} GROUP BY ALL),
c AS (SELECT a.id AS l, b.id AS r FROM a, b WHERE ({differ.format("a", "b")}) AND (contains(a.t, b.t) OR contains(b.t, a.t))),
x AS (SELECT coalesce(s.l, c.l) AS l, coalesce(s.r, c.r) AS r, coalesce(shared, 0) AS shared, c.l IS NOT NULL AS inside FROM s FULL JOIN c ON s.l = c.l AND s.r = c.r),
y AS (SELECT x.*, least(coalesce(na.n, 0), coalesce(nb.n, 0)) AS m FROM x LEFT JOIN na ON na.id = l LEFT JOIN nb ON nb.id = r)
SELECT l AS left_id, r AS right_id, shared::INT AS shared, round(CASE WHEN m > 0 THEN shared::DOUBLE / m ELSE 0 END, 6) AS similarity, inside AS contains FROM y WHERE inside OR (m > 0 AND shared::DOUBLE / m >= 0.8)
"""


NEAR_DUPLICATES_SQL = _pairs_sql("SELECT id, t FROM a", "{0}.id < {1}.id")
LEAKAGE_SQL = _pairs_sql("SELECT item_id AS id, " + _NORMAL.format("text") + " AS t FROM benchmark", "true")


def spanning_families(spark, d):
    """Sources whose labelled documents lie in more than one split, a split being a hash of the text's first word."""
    rows = _labelled(spark, d).select(F.col("source").alias("family"), (F.length("text") % 2).cast("string").alias("split"))
    return E.spanning_families(rows)


SPANNING_SQL = "SELECT source AS family, count(DISTINCT length(text) % 2) AS splits, count(*) AS samples FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT length(text) % 2) > 1"


def length_strata(spark, d):
    rows = _labelled(spark, d).withColumn("length", T.length_class(F.col("text"))).withColumn("score", F.col("quality") * 100.0)
    return E.strata_scores(rows, ["lang", "length", "source"]).select("dimension", "value", F.round("score", 6).alias("score"), "count")


LENGTH_STRATA_SQL = r"""
WITH r AS (SELECT lang, source, quality * 100.0 AS score, len(regexp_extract_all(text, '\S+')) AS w FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
s AS (SELECT *, CASE WHEN w BETWEEN 3 AND 40 THEN 'short' WHEN w BETWEEN 41 AND 180 THEN 'paragraph' WHEN w BETWEEN 181 AND 600 THEN 'long' WHEN w BETWEEN 601 AND 1500 THEN 'extended' END AS length FROM r),
u AS (SELECT 'lang' AS dimension, coalesce(lang, 'unknown') AS value, score FROM s UNION ALL SELECT 'length', coalesce(length, 'unknown'), score FROM s UNION ALL SELECT 'source', coalesce(source, 'unknown'), score FROM s)
SELECT dimension, value, round(avg(score)::DOUBLE, 6) AS score, count(*) AS count FROM u GROUP BY ALL
"""


def _results(spark, d) -> DataFrame:
    """Labelled documents as a run's results by source."""
    return _labelled(spark, d).select(
        "source", "lang", F.when(F.col("doc_id") % 10 == 9, "repeat").otherwise("main").alias("phase"), F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"), F.when(F.col("doc_id") % 3 != 0, F.col("quality") * 100.0).alias("score"),
        (F.col("quality") == 0).alias("serious"), (F.col("n_chars") > 200).alias("has_output"), (F.col("n_chars") / 100.0).alias("elapsed_seconds"), (F.col("n_chars") / 1000.0).alias("ttft_seconds"), T.word_count(F.col("text")).alias("input"),
        F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")).alias("output"), F.when(F.col("doc_id") % 6 == 0, "memory").alias("cache_source"), (F.col("doc_id") % 7).alias("group"), F.lit(20).alias("planned"), F.lit(20).alias("executed"),
    )


def run_summary(spark, d):
    out = E.summarize_run(_results(spark, d), "source")
    return out.select(*(F.round(c, 6).alias(c) if dict(out.dtypes)[c] == "double" else F.col(c) for c in out.columns))


RUN_SUMMARY_SQL = r"""
WITH r AS (
  SELECT source, doc_id % 10 <> 9 AS main, toxic = 0 AS ok, CASE WHEN doc_id % 3 <> 0 THEN quality * 100.0::DOUBLE END AS s0, quality = 0 AS serious, n_chars > 200 AS has, n_chars / 100.0::DOUBLE AS el, n_chars / 1000.0::DOUBLE AS tt,
    len(regexp_extract_all(text, '\S+')) AS i, CASE WHEN doc_id % 4 <> 0 THEN n_chars END AS o, CASE WHEN doc_id % 6 = 0 THEN 'memory' END AS cs, doc_id % 7 AS g FROM documents JOIN labels USING (doc_id)),
q AS (SELECT *, CASE WHEN main THEN coalesce(s0, CASE WHEN NOT ok AND NOT has THEN 0 END) END AS s FROM r)
SELECT source, count(*) FILTER (WHERE main) AS main_samples, round(count(*) FILTER (WHERE main AND ok)::DOUBLE / nullif(count(*) FILTER (WHERE main), 0), 6) AS success_rate,
  round(CASE WHEN count(*) = 20 AND count(s) = count(*) FILTER (WHERE main) THEN avg(s) END, 6) AS quality_score, round(avg(s), 6) AS reviewed_subset_score,
  round(CASE WHEN count(*) FILTER (WHERE main AND ok AND s IS NULL) = 0 THEN avg(s) FILTER (WHERE main AND ok) END, 6) AS output_quality_score, count(*) FILTER (WHERE main) - count(s) AS unreviewed,
  round(count(*) FILTER (WHERE main AND serious)::DOUBLE / nullif(count(s) FILTER (WHERE has), 0), 6) AS serious_error_rate, round(quantile_disc(el, 0.5) FILTER (WHERE main AND ok), 6) AS latency_p50, round(quantile_disc(el, 0.95) FILTER (WHERE main AND ok), 6) AS latency_p95,
  round(quantile_disc(tt, 0.5) FILTER (WHERE main AND ok), 6) AS ttft_p50, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output, count(cs) FILTER (WHERE main) AS cache_hits, count(DISTINCT g) FILTER (WHERE main) AS correlation_groups, count(*) = 20 AS complete
FROM q GROUP BY source
"""


def weighted_score(spark, d):
    dims = list(E.WEIGHTS)
    score = N.weighted_score({k: F.col("l_linenumber") * (i + 1) % 5 for i, k in enumerate(dims)}, E.WEIGHTS)
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(score), 6).alias("score"), F.max(score).alias("best"))


WEIGHTED_SQL = """
WITH s AS (SELECT l_suppkey, (l_linenumber % 5) * 10.0::DOUBLE + (l_linenumber * 2 % 5) * 5.0::DOUBLE + (l_linenumber * 3 % 5) * 5.0::DOUBLE + (l_linenumber * 4 % 5) * 2.5::DOUBLE + (l_linenumber * 5 % 5) * 2.5::DOUBLE AS s FROM lineitem)
SELECT l_suppkey, round(avg(s), 6) AS score, max(s) AS best FROM s GROUP BY 1
"""


def _runs(spark, d) -> DataFrame:
    """A user's days as runs: the mean value of the day is the metric."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", F.col("day").cast("string").alias("run_id")).agg(F.round(F.avg("value"), 6).alias("metric"), F.bool_or(F.col("event_type") != "error").alias("complete"), (F.count("*") * 0).cast("string").alias("fingerprint"))


_RUNS_SQL = "runs AS (SELECT user_id, ts::DATE::VARCHAR AS run_id, round(avg(value), 6) AS metric, bool_or(event_type <> 'error') AS complete FROM events GROUP BY ALL)"


def stability(spark, d):
    out = E.stability(_runs(spark, d), ["user_id"], "metric")
    return out.select("user_id", "runs", "low", "high", F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"), "ready", F.round("variation", 9).alias("variation"))


STABILITY_SQL = f"WITH {_RUNS_SQL} SELECT user_id, count(DISTINCT run_id) AS runs, min(metric) AS low, max(metric) AS high, round(avg(metric), 9) AS mean, round(stddev_samp(metric), 9) AS deviation, count(DISTINCT run_id) >= 3 AND bool_and(complete) AS ready, round(stddev_samp(metric) / avg(metric), 9) AS variation FROM runs GROUP BY 1"


def repeat_stability(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("sample_id"), F.when(F.col("event_id") % 3 == 0, "repeat").otherwise("main").alias("phase"), F.col("event_type").alias("output"), F.col("value").alias("elapsed_seconds"))
    return E.repeat_stability(rows)


REPEAT_SQL = "SELECT user_id AS sample_id, count(*) AS runs, count(DISTINCT event_type) AS distinct_outputs, min(value) AS low, max(value) AS high FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_id % 3 = 0) > 0 AND min(value) IS NOT NULL"


def paired_runs(spark, d):
    e = table(spark, d, "events").where("event_type in ('view', 'click')").select("user_id", F.to_date("ts").cast("string").alias("day"), F.when(F.col("event_type") == "view", "before").otherwise("after").alias("variant"), "value")
    out = E.paired_runs(e, ["user_id", "day"], "value")
    return out.select("user_id", "day", F.round("before", 9).alias("before"), F.round("after", 9).alias("after"), F.round("reduction_percent", 9).alias("reduction_percent"))


_PAIRS_SQL = "pairs AS (SELECT user_id, ts::DATE::VARCHAR AS day, avg(value) FILTER (WHERE event_type = 'view') AS b, avg(value) FILTER (WHERE event_type = 'click') AS a FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL HAVING b IS NOT NULL AND a IS NOT NULL)"
PAIRED_RUNS_SQL = f"WITH {_PAIRS_SQL} SELECT user_id, day, round(b, 9) AS before, round(a, 9) AS after, round(100.0 * (b - a) / nullif(b, 0), 9) AS reduction_percent FROM pairs"


def paired_delta(spark, d):
    e = table(spark, d, "events").where("event_type in ('view', 'click')").select("user_id", F.to_date("ts").alias("day"), F.when(F.col("event_type") == "view", "before").otherwise("after").alias("variant"), "value")
    out = E.paired_delta(E.paired_runs(e, ["user_id", "day"], "value"), ["user_id"])
    return out.select("user_id", "pairs", *(F.round(c, 9).alias(c) for c in ("mean_delta", "low_delta", "high_delta")))


PAIRED_DELTA_SQL = f"WITH {_PAIRS_SQL} SELECT user_id, count(*) AS pairs, round(CASE WHEN count(*) >= 3 THEN avg(a - b) END, 9) AS mean_delta, round(CASE WHEN count(*) >= 3 THEN min(a - b) END, 9) AS low_delta, round(CASE WHEN count(*) >= 3 THEN max(a - b) END, 9) AS high_delta FROM pairs GROUP BY 1"


def bootstrap_ci(spark, d):
    rows = _labelled(spark, d).select("source", "lang", (F.col("quality") - F.col("toxic")).cast("double").alias("delta"))
    out = E.cluster_bootstrap(rows, "source", "lang", "delta")
    return out.select(*(F.round(c, 9).alias(c) for c in ("mean_delta", "low", "high")))


BOOTSTRAP_SQL = f"""
WITH sums AS (SELECT lang AS s, source AS c, sum((quality - toxic)::DOUBLE) AS d, count(quality - toxic)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) WHERE quality - toxic IS NOT NULL GROUP BY ALL),
seeds AS (SELECT ('0x' || substr(md5('61027|' || coalesce(s, '') || '|' || coalesce(c, '')), 1, 8))::BIGINT AS seed, d, n FROM sums),
x0 AS (SELECT rep, d, n, (seed + rep::BIGINT * {E.STEP}) & 4294967295 AS x FROM seeds, range(1, 4001) r(rep)),
x1 AS (SELECT rep, d, n, (xor(x, x >> 15) * {E.MIX[0]}) & 4294967295 AS x FROM x0),
x2 AS (SELECT rep, d, n, (xor(x, x >> 15) * {E.MIX[1]}) & 4294967295 AS x FROM x1),
drawn AS (SELECT rep, d, n, len(list_filter({E.draw_limits()}, lambda l: l <= xor(x, x >> 15))) AS w FROM x2),
means AS (SELECT rep, sum(w * d) / nullif(sum(w * n), 0) AS m FROM drawn GROUP BY rep)
SELECT round((SELECT sum(d) / sum(n) FROM sums), 9) AS mean_delta, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM means
"""


def quota_check(spark, d):
    docs = table(spark, d, "documents")
    spec = docs.groupBy("lang").agg(F.countDistinct("source").alias("s")).select("lang", F.explode(F.array(F.lit("src0"), F.lit("src1"), F.lit("none"))).alias("source"), (F.col("s") * 0 + 12).alias("expected"))
    return E.quota_check(docs, spec, ["lang", "source"])


QUOTA_SQL = """
WITH spec AS (SELECT lang, unnest(['src0', 'src1', 'none']) AS source, 12 AS expected FROM (SELECT DISTINCT lang FROM documents)), f AS (SELECT lang, source, count(*) AS found FROM documents GROUP BY ALL)
SELECT lang, source, coalesce(expected, 0)::BIGINT AS expected, coalesce(found, 0) AS found FROM spec FULL JOIN f USING (lang, source) WHERE coalesce(expected, 0) <> coalesce(found, 0)
"""


def coverage(spark, d):
    rows = table(spark, d, "documents").withColumn("length", T.length_class(F.col("text")))
    return E.coverage_report(rows.select("lang", "length"), ["lang", "length"])


COVERAGE_SQL = r"""
WITH w AS (SELECT lang, len(regexp_extract_all(text, '\S+')) AS w FROM documents),
c AS (SELECT lang, CASE WHEN w BETWEEN 3 AND 40 THEN 'short' WHEN w BETWEEN 41 AND 180 THEN 'paragraph' WHEN w BETWEEN 181 AND 600 THEN 'long' WHEN w BETWEEN 601 AND 1500 THEN 'extended' END AS length FROM w)
SELECT lang, length, count(*) AS count, grouping_id(lang, length) AS grouping FROM c GROUP BY GROUPING SETS ((lang), (length), (lang, length), ())
"""


def model_common_papers(spark, d):
    """Suppliers as models and part groups as papers."""
    rows = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("model"), (F.col("l_partkey") % 12).alias("paper")).agg(F.when(F.max("l_linenumber") % 2 == 1, F.max("l_quantity")).alias("quality"), F.when(F.min("l_partkey") % 5 != 0, F.round(F.sum("l_quantity"), 2)).alias("cost"))
    return E.compare_models(rows)


MODELS_SQL = """
WITH r AS (SELECT l_suppkey % 10 AS model, l_partkey % 12 AS paper, CASE WHEN max(l_linenumber) % 2 = 1 THEN max(l_quantity) END AS quality, CASE WHEN min(l_partkey) % 5 <> 0 THEN round(sum(l_quantity), 2) END AS cost FROM lineitem GROUP BY ALL),
common AS (SELECT paper FROM r WHERE quality IS NOT NULL GROUP BY paper HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM r))
SELECT model, avg(quality) FILTER (WHERE paper IN (SELECT paper FROM common)) AS common_quality, count(*) FILTER (WHERE paper IN (SELECT paper FROM common)) AS common_papers, count(DISTINCT paper) AS papers, sum(cost) AS recorded_cost,
  CASE WHEN count(DISTINCT paper) = (SELECT count(DISTINCT paper) FROM r) AND count(cost) = count(*) THEN sum(cost) END AS full_cost
FROM r GROUP BY model
"""


def common_keys(spark, d):
    return E.common_keys(table(spark, d, "lineitem").select((F.col("l_partkey") % 1500).alias("part"), "l_returnflag"), "part", "l_returnflag")


COMMON_SQL = "SELECT l_partkey % 1500 AS part FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)"


def audit_sample(spark, d):
    return E.audit_sample(table(spark, d, "labels"), "doc_id", F.col("toxic") == 1, SEED)


AUDIT_SQL = f"""
SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1 UNION ALL
(SELECT doc_id, quality, toxic FROM labels WHERE toxic IS DISTINCT FROM 1 ORDER BY sha256('{SEED}' || doc_id), doc_id LIMIT (SELECT ceil(count(*) * 0.2)::BIGINT FROM labels WHERE toxic IS DISTINCT FROM 1))
"""


def blind_packet(spark, d):
    return E.blind_packet(table(spark, d, "labels").select("doc_id"), "doc_id", SEED)


BLIND_SQL = f"SELECT doc_id, 'E' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 5, '0') ELSE n::VARCHAR END AS blind_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('{SEED}' || doc_id), doc_id) AS n FROM labels)"


def run_complete(spark, d):
    """Orders as planned jobs and line items' orders as executed ones."""
    planned = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"))
    return E.run_complete(planned, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id")).distinct())


RUN_COMPLETE_SQL = """
WITH p AS (SELECT o_orderkey AS k FROM orders), e AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
n AS (SELECT (SELECT count(*) FROM p) AS planned, (SELECT count(*) FROM e) AS executed, (SELECT count(*) FROM p WHERE k NOT IN (SELECT k FROM e)) AS missing, (SELECT count(*) FROM e WHERE k NOT IN (SELECT k FROM p)) AS unplanned, 0 AS repeated)
SELECT planned, executed, missing, unplanned, repeated::BIGINT AS repeated, missing + unplanned + repeated = 0 AS complete FROM n
"""


def unresolved_dispatch(spark, d):
    intents = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"))
    results = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max("l_returnflag").alias("status"))
    return E.unresolved_dispatch(intents, results)


UNRESOLVED_SQL = "SELECT l_orderkey AS job_id, max(l_returnflag) AS status FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, 'unknown' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"


def unexecuted(spark, d):
    """Customers as jobs, which an order that is through has executed."""
    runs = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("job_id"))
    return E.unexecuted(table(spark, d, "customer").select(F.col("c_custkey").alias("job_id")), runs)


UNEXECUTED_SQL = "SELECT c_custkey AS job_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"


def review_coverage(spark, d):
    results = table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), (F.col("n_chars") > 2000).alias("has_output"))
    return E.review_coverage(results, table(spark, d, "labels").select(F.col("doc_id").alias("job_id")))


REVIEW_COVERAGE_SQL = """
SELECT doc_id AS job_id, 'unreviewed' AS problem FROM documents WHERE n_chars > 2000 AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 2000)
"""


def placeholder_diff(spark, d):
    """Tags that a page's head has more or less often than its body."""
    tags = lambda c: F.regexp_extract_all(c, F.lit(r"<([a-z0-9]+)"), 1)
    pages = table(spark, d, "pages").select("page_id", F.split("html", "<body>", 2).alias("p")).where("size(p) = 2")
    return E.multiset_diff(pages.select("page_id", tags(F.col("p")[0]).alias("t")), pages.select("page_id", tags(F.col("p")[1]).alias("t")), "page_id", "t")


PLACEHOLDER_SQL = """
WITH p AS (SELECT page_id, html[1:strpos(html, '<body>') - 1] AS a, html[strpos(html, '<body>') + 6:] AS b FROM pages WHERE strpos(html, '<body>') > 0),
x AS (SELECT page_id, token, count(*) AS x FROM (SELECT page_id, unnest(regexp_extract_all(a, '<([a-z0-9]+)', 1)) AS token FROM p) GROUP BY ALL), y AS (SELECT page_id, token, count(*) AS y FROM (SELECT page_id, unnest(regexp_extract_all(b, '<([a-z0-9]+)', 1)) AS token FROM p) GROUP BY ALL)
SELECT page_id, token, greatest(coalesce(x, 0) - coalesce(y, 0), 0) AS missing, greatest(coalesce(y, 0) - coalesce(x, 0), 0) AS extra FROM x FULL JOIN y USING (page_id, token) WHERE coalesce(x, 0) <> coalesce(y, 0)
"""


def review_binding(spark, d):
    results = table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.sha2("text", 256).alias("result_sha256"))
    reviews = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("job_id"), F.sha2(F.when(F.col("toxic") == 1, F.lower("text")).otherwise(F.col("text")), 256).alias("result_sha256"), (F.col("quality") * 100.0).alias("score"), (F.col("toxic") == 1).alias("serious"))
    return E.bind_reviews(results, reviews).groupBy("binding").agg(F.count("*").alias("results"))


REVIEW_BINDING_SQL = "SELECT CASE WHEN l.doc_id IS NULL THEN 'none' WHEN toxic = 1 AND lower(text) <> text THEN 'mismatch' ELSE 'ok' END AS binding, count(*) AS results FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1"


def exposure(spark, d):
    """Samples of three parts each, exposed by the parts of returned items."""
    samples = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % 300).alias("paper"), F.array((F.col("o_orderkey") % 5).cast("int"), (F.col("o_orderkey") % 7).cast("int")).alias("pages"))
    exposures = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_linenumber > 5").select((F.col("l_partkey") % 300).alias("paper"), F.col("l_linenumber").cast("int").alias("page"))
    return E.exposure(samples, exposures)


EXPOSURE_SQL = """
WITH e AS (SELECT DISTINCT l_partkey % 300 AS paper, l_linenumber AS page FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 5)
SELECT o_orderkey AS sample_id, true AS by_document, bool_or(page IN (o_orderkey % 5, o_orderkey % 7)) AS by_page FROM orders JOIN e ON paper = o_custkey % 300 GROUP BY o_orderkey
"""


def schedule_jobs(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), (F.col("n_chars") % 5 == 0).alias("repeat"))
    return E.schedule_jobs(rows).select("job_id", "phase", "round")


SCHEDULE_SQL = """
SELECT 'precheck:' || doc_id || ':0' AS job_id, 'precheck' AS phase, 0 AS round FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3) UNION ALL SELECT 'main:' || doc_id || ':0', 'main', 0 FROM documents
UNION ALL SELECT 'repeat:' || doc_id || ':' || r, 'repeat', r FROM documents, (SELECT unnest([1, 2])::INT AS r) WHERE n_chars % 5 = 0
"""


def samples_from_blocks(spark, d):
    """Samples cut out of documents: characters 5 to 40 of the document and 0 to 10 of the next one."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    blocks = docs.select(F.col("doc_id").alias("block"), "text")
    anchor = lambda b, s, e: F.struct(b.alias("block"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(None).cast("string").alias("block_sha256"))
    recipes = docs.select(F.col("doc_id").alias("sample_id"), F.lit(None).cast("string").alias("source_sha256"), F.array(anchor(F.col("doc_id"), 5, 40), anchor(F.col("doc_id") + 1, 0, 10)).alias("anchors"))
    return E.materialize_samples(recipes, blocks).where("problem is null").select("sample_id", "source_text")


SAMPLES_SQL = "SELECT a.doc_id AS sample_id, a.text[6:40] || chr(10) || chr(10) || b.text[1:10] AS source_text FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"


def fingerprint(spark, d):
    return E.dataset_fingerprint(table(spark, d, "documents"), ("text",))


FINGERPRINT_SQL = """
WITH h AS (SELECT sha256(json_object('doc_id', doc_id, 'lang', lang, 'n_chars', n_chars, 'source', source)::VARCHAR) AS h FROM documents),
s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::HUGEINT) AS a, sum(('0x' || substr(h, 16, 15))::HUGEINT) AS b, sum(('0x' || substr(h, 31, 15))::HUGEINT) AS c, sum(('0x' || substr(h, 46, 15))::HUGEINT) AS d FROM h)
SELECT n AS rows, sha256(concat_ws('|', n::VARCHAR, a::HUGEINT::VARCHAR, b::HUGEINT::VARCHAR, c::HUGEINT::VARCHAR, d::HUGEINT::VARCHAR)) AS fingerprint FROM s
"""


def leakage_spans(spark, d):
    """Near duplicates among the benchmark's items, two families by the item's number, whose families differ."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    own = cut(items.join(E.text_classes(items).where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi"))
    samples = items.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("group"), (F.col("doc_id") % 2).alias("split"))
    return E.leakage(E.near_duplicates(own, shortest=1), samples).select("left_id", "right_id", "left_group", "right_group", "left_split", "right_split")


LEAKAGE_SPANS_SQL = f"""
SELECT left_id, right_id, left_id % 3 AS left_group, right_id % 3 AS right_group, left_id % 2 AS left_split, right_id % 2 AS right_split
FROM ({_pairs_sql("SELECT id, t FROM a", "{0}.id < {1}.id").replace("documents", "benchmark").replace("doc_id", "item_id")}) WHERE left_id % 3 <> right_id % 3 OR left_id % 2 <> right_id % 2
"""


def samples_checked(spark, d):
    """Samples cut out of documents with digests of the blocks and the whole: some blocks have changed since, some are gone, some samples are others."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    blocks = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("block"), "text")
    digest = F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)
    cut_out = F.substring("text", 6, 35)
    whole = F.sha2(F.when(F.col("doc_id") % 7 == 0, F.upper(cut_out)).otherwise(cut_out), 256)
    anchor = F.struct(F.col("doc_id").alias("block"), F.lit(5).alias("start"), F.lit(40).alias("end"), digest.alias("block_sha256"))
    return E.materialize_samples(docs.select(F.col("doc_id").alias("sample_id"), whole.alias("source_sha256"), F.array(anchor).alias("anchors")), blocks).select("sample_id", "problem")


SAMPLES_CHECKED_SQL = """
SELECT doc_id AS sample_id, CASE WHEN doc_id % 11 = 0 OR text IS NULL THEN 'incomplete' WHEN doc_id % 5 = 0 THEN 'drifted' WHEN doc_id % 7 = 0 AND upper(text[6:40]) <> text[6:40] THEN 'changed' END AS problem FROM documents
"""


def run_results(spark, d):
    """As run_summary by language, planned and executed being what the source's run has in fact, with one job lost in German."""
    rows = _results(spark, d)
    n = rows.groupBy("lang").agg(F.count("*").alias("n"))
    known = rows.join(n, "lang").withColumn("planned", F.col("n") + (F.col("lang") == "de").cast("int")).withColumn("executed", F.col("n")).withColumn("score", F.coalesce("score", F.lit(50.0)))
    out = E.summarize_run(known, "lang")
    return out.select("lang", "main_samples", F.round("quality_score", 6).alias("quality_score"), F.round("output_quality_score", 6).alias("output_quality_score"), "unreviewed", "complete")


RUN_RESULTS_SQL = """
WITH r AS (SELECT lang, doc_id % 10 <> 9 AS main, toxic = 0 AS ok, coalesce(CASE WHEN doc_id % 3 <> 0 THEN quality * 100.0::DOUBLE END, 50.0) AS s FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) FILTER (WHERE main) AS main_samples, round(CASE WHEN lang <> 'de' THEN avg(s) FILTER (WHERE main) END, 6) AS quality_score, round(avg(s) FILTER (WHERE main AND ok), 6) AS output_quality_score, 0::BIGINT AS unreviewed, lang <> 'de' AS complete
FROM r WHERE lang IS NOT NULL GROUP BY lang
"""


def jobs_left(spark, d):
    """Parts that no returned item has executed."""
    return E.unexecuted(table(spark, d, "part").select(F.col("p_partkey").alias("job_id")), table(spark, d, "lineitem").where("l_returnflag = 'R' and l_linenumber = 7").select(F.col("l_partkey").alias("job_id")))


JOBS_LEFT_SQL = "SELECT p_partkey AS job_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7)"


def blind_keys(spark, d):
    """The private half of the packet of labels: how many rows have a digest each, and how many digests there are."""
    packet = E.blind_packet(table(spark, d, "labels"), "doc_id", SEED)
    return E.blind_key(packet, "doc_id", ["quality", "toxic"]).groupBy("result_sha256").agg(F.count("*").alias("rows"), F.min("blind_id").alias("first"))


BLIND_KEYS_SQL = f"""
SELECT sha256(json_object('quality', quality, 'toxic', toxic)::VARCHAR) AS result_sha256, count(*) AS rows, min(blind_id) AS first
FROM labels JOIN ({BLIND_SQL}) USING (doc_id) GROUP BY 1
"""


def payload_pairs(spark, d):
    """Paired runs of line items by supplier, even orders before and odd ones after, and whether both sent the same quantities as often."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.when(F.col("l_orderkey") % 2 == 0, "before").otherwise("after").alias("variant"), F.col("l_quantity").cast("double").alias("value"), F.col("l_linenumber").cast("string").alias("sent"))
    out = E.paired_runs(rows, ["l_suppkey", "l_returnflag"], "value", payload="sent")
    return out.select("l_suppkey", "l_returnflag", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "same_payloads")


PAYLOAD_PAIRS_SQL = """
WITH r AS (SELECT l_suppkey, l_returnflag, l_orderkey % 2 AS v, avg(l_quantity::DOUBLE) AS value, list_sort(list(l_linenumber)) AS sent FROM lineitem GROUP BY ALL)
SELECT a.l_suppkey, a.l_returnflag, round(a.value, 6) AS before, round(b.value, 6) AS after, a.sent = b.sent AS same_payloads FROM r a JOIN r b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag AND a.v = 0 AND b.v = 1
"""


def repeat_statuses(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("sample_id"), F.when(F.col("event_id") % 3 == 0, "repeat").otherwise("main").alias("phase"), F.col("event_type").alias("output"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("elapsed_seconds"))
    out = E.repeat_stability(rows, status="status")
    return out.select("sample_id", "runs", F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("statuses"))


REPEAT_STATUSES_SQL = """
WITH e AS (SELECT user_id AS sample_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS s, event_id % 3 = 0 AS r FROM events WHERE value IS NOT NULL),
n AS (SELECT sample_id, s, count(*) AS n, bool_or(r) AS r FROM e GROUP BY ALL)
SELECT sample_id, sum(n)::BIGINT AS runs, string_agg(s || '=' || n, ',' ORDER BY s) AS statuses FROM n GROUP BY 1 HAVING bool_or(r)
"""


QUERIES = {f.__name__: f for f in (near_duplicates, leakage_pairs, spanning_families, length_strata, run_summary, weighted_score, stability, repeat_stability, paired_runs, paired_delta, bootstrap_ci, quota_check, coverage, model_common_papers, common_keys, audit_sample, blind_packet, run_complete, unresolved_dispatch, unexecuted, review_coverage, placeholder_diff, review_binding, exposure, schedule_jobs, samples_from_blocks, fingerprint, leakage_spans, samples_checked, run_results, jobs_left, blind_keys, payload_pairs, repeat_statuses)}
SQL = {
    "bootstrap_ci": BOOTSTRAP_SQL,
    "near_duplicates": NEAR_DUPLICATES_SQL, "leakage_pairs": LEAKAGE_SQL, "spanning_families": SPANNING_SQL, "length_strata": LENGTH_STRATA_SQL, "run_summary": RUN_SUMMARY_SQL, "weighted_score": WEIGHTED_SQL, "stability": STABILITY_SQL, "repeat_stability": REPEAT_SQL, "paired_runs": PAIRED_RUNS_SQL,
    "paired_delta": PAIRED_DELTA_SQL, "quota_check": QUOTA_SQL, "coverage": COVERAGE_SQL, "model_common_papers": MODELS_SQL, "common_keys": COMMON_SQL, "audit_sample": AUDIT_SQL, "blind_packet": BLIND_SQL, "run_complete": RUN_COMPLETE_SQL, "unresolved_dispatch": UNRESOLVED_SQL, "unexecuted": UNEXECUTED_SQL,
    "review_coverage": REVIEW_COVERAGE_SQL, "placeholder_diff": PLACEHOLDER_SQL, "review_binding": REVIEW_BINDING_SQL, "exposure": EXPOSURE_SQL, "schedule_jobs": SCHEDULE_SQL, "samples_from_blocks": SAMPLES_SQL,
    "fingerprint": FINGERPRINT_SQL, "leakage_spans": LEAKAGE_SPANS_SQL, "samples_checked": SAMPLES_CHECKED_SQL, "run_results": RUN_RESULTS_SQL, "jobs_left": JOBS_LEFT_SQL, "blind_keys": BLIND_KEYS_SQL, "payload_pairs": PAYLOAD_PAIRS_SQL, "repeat_statuses": REPEAT_STATUSES_SQL,
}
