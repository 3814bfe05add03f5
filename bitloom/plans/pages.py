"""Queries on boxes and characters that follow from line items, orders and documents, and on streams of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import geometry as G
from bitloom.operators import layout as L
from bitloom.streaming import streams as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDERS = 400
LABELS = ("formula", "title", "text", "table", "figure")


def _chars(spark, d) -> DataFrame:
    """Line items as characters of 4 by 6 on pages of 600 by 800. ORDERS orders in a row make a document, so that pages grow in number, not in size."""
    x, y = (F.col("l_partkey") * 7 % 590).cast("double"), (F.col("l_suppkey") * 13 + F.col("l_linenumber") * 101) % 790
    items = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    return items.select(
        F.floor(F.col("l_orderkey") / ORDERS).alias("doc_id"), (F.col("l_orderkey") % 3).cast("int").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("char_idx"), x.alias("x"), y.cast("double").alias("y"), (x + 4).alias("x2"), (y + 6).cast("double").alias("y2"), (F.col("l_linenumber") % 2).cast("long").alias("xobj_id"), F.col("l_linenumber").alias("render_order"),
    )


def _regions(spark, d) -> DataFrame:
    """Every order as a region of up to 60 by 40 in its document."""
    x, y = (F.col("o_orderkey") % 97 * 6).cast("double"), (F.col("o_custkey") % 79 * 10).cast("double")
    o = table(spark, d, "orders")
    label = F.element_at(F.array(*(F.lit(v) for v in LABELS)), (F.col("o_custkey") % 5 + 1).cast("int"))
    return o.select(F.floor(F.col("o_orderkey") / ORDERS).alias("doc_id"), (F.col("o_custkey") % 3).cast("int").alias("page"), F.col("o_orderkey").alias("region_id"), label.alias("class_name"), x.alias("x"), y.alias("y"), (x + 20 + F.col("o_custkey") % 40).alias("x2"), (y + 15 + F.col("o_custkey") % 25).alias("y2"), (F.col("o_custkey") % 2).alias("xobj_id"))


_BOXES_SQL = f"""chars AS (
  SELECT l_orderkey // {ORDERS} AS doc_id, (l_orderkey % 3)::INT AS page, l_orderkey * 10 + l_linenumber AS char_idx, l_linenumber % 2 AS xobj_id, (l_partkey * 7 % 590)::DOUBLE AS x, ((l_suppkey * 13 + l_linenumber * 101) % 790)::DOUBLE AS y,
    (l_partkey * 7 % 590)::DOUBLE + 4 AS x2, ((l_suppkey * 13 + l_linenumber * 101) % 790)::DOUBLE + 6 AS y2, l_linenumber AS render_order FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)),
regions AS (
  SELECT o_orderkey // {ORDERS} AS doc_id, (o_custkey % 3)::INT AS page, o_orderkey AS region_id, (['formula', 'title', 'text', 'table', 'figure'])[o_custkey % 5 + 1] AS class_name, o_custkey % 5 AS pos, (o_orderkey % 97 * 6)::DOUBLE AS x, (o_custkey % 79 * 10)::DOUBLE AS y,
    (o_orderkey % 97 * 6)::DOUBLE + 20 + o_custkey % 40 AS x2, (o_custkey % 79 * 10)::DOUBLE + 15 + o_custkey % 25 AS y2, o_custkey % 2 AS xobj_id FROM orders)"""
_COVER = "greatest(least({a}.x2, {b}.x2) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y, {b}.y), 0)"


def region_assign(spark, d):
    out = L.assign_regions(_chars(spark, d), _regions(spark, d), ["formula", "title", "text"])
    return out.where("region_id is not null").select("char_idx", "region_id", "class_name", F.round("coverage", 8).alias("coverage"))


REGION_SQL = f"""
WITH {_BOXES_SQL}, p AS (SELECT c.char_idx, r.region_id, r.class_name, CASE WHEN pos > 2 THEN 4 ELSE pos + 1 END AS rank, {_COVER.format(a="c", b="r")} / 24.0::DOUBLE AS cov FROM chars c JOIN regions r USING (doc_id, page))
SELECT char_idx, region_id, class_name, round(cov, 8) AS coverage FROM p WHERE cov > 0 QUALIFY row_number() OVER (PARTITION BY char_idx ORDER BY rank, cov DESC, region_id) = 1
"""


def formula_region(spark, d):
    chars = _chars(spark, d)
    chars = chars.withColumns({f"v{c}": F.col(c) + F.when(F.col("char_idx") % 4 == 0, 30.0).otherwise(1.0) for c in ("x", "x2")} | {f"v{c}": F.col(c) for c in ("y", "y2")})
    out = L.formula_region(chars, _regions(spark, d).where("class_name = 'formula'"))
    return out.where("formula_region_id is not null").select("char_idx", "formula_region_id")


FORMULA_REGION_SQL = f"""
WITH {_BOXES_SQL}, u AS (SELECT char_idx, doc_id, page, y, y2, CASE WHEN char_idx % 4 = 0 THEN x ELSE x + 1 END AS x, CASE WHEN char_idx % 4 = 0 THEN x2 ELSE x2 + 1 END AS x2 FROM chars),
p AS (SELECT c.char_idx, r.region_id, {_COVER.format(a="c", b="r")} / 24.0::DOUBLE AS cov FROM u c JOIN regions r USING (doc_id, page) WHERE class_name = 'formula')
SELECT char_idx, region_id AS formula_region_id FROM p WHERE cov > 0.4 QUALIFY row_number() OVER (PARTITION BY char_idx ORDER BY cov DESC, region_id) = 1
"""


def element_assign(spark, d):
    elements = _chars(spark, d).withColumnRenamed("char_idx", "element_id")
    formulas = _regions(spark, d).withColumnRenamed("region_id", "formula_id").drop("class_name")
    out = L.assign_elements(elements, formulas, "element_id").where("formula_id is not null")
    return out.select("element_id", "formula_id", F.round("score", 8).alias("score"))


ELEMENT_SQL = f"""
WITH {_BOXES_SQL},
p AS (SELECT c.char_idx, r.region_id, {_COVER.format(a="c", b="r")} / 24.0::DOUBLE AS cov, greatest(least(c.x2, r.x2 + 2) - greatest(c.x, r.x - 2), 0) * greatest(least(c.y2, r.y2 + 2) - greatest(c.y, r.y - 2), 0) / 24.0::DOUBLE AS wide,
  sqrt(power(greatest(r.x - c.x2, c.x - r.x2, 0), 2) + power(greatest(r.y - c.y2, c.y - r.y2, 0), 2)) AS dist FROM chars c JOIN regions r USING (doc_id, page, xobj_id)),
s AS (SELECT *, CASE WHEN cov >= 0.95 THEN 1.0::DOUBLE WHEN wide >= 0.95 THEN 0.5::DOUBLE + 0.4::DOUBLE * (1 - least(dist, 100) / 100.0::DOUBLE) END AS score FROM p)
SELECT char_idx AS element_id, region_id AS formula_id, round(score, 8) AS score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY char_idx ORDER BY score DESC, region_id) = 1
"""


def overlaps(spark, d):
    return L.overlapping_boxes(_regions(spark, d), "region_id")


OVERLAPS_SQL = f"""
WITH {_BOXES_SQL} SELECT a.doc_id, a.page, a.region_id AS left_key, b.region_id AS right_key FROM regions a JOIN regions b ON a.doc_id = b.doc_id AND a.page = b.page AND a.xobj_id = b.xobj_id AND a.region_id < b.region_id
WHERE {_COVER.format(a="a", b="b")} > 0 AND NOT ((a.y >= b.y AND a.y2 <= b.y2) OR (b.y >= a.y AND b.y2 <= a.y2))
"""


def protected_elements(spark, d):
    paragraphs = _regions(spark, d).where("class_name = 'text'").withColumnRenamed("region_id", "para_idx")
    out = L.protected_elements(_chars(spark, d).withColumnRenamed("char_idx", "curve_id"), _regions(spark, d), paragraphs)
    return out.where("keep or overlaps").select("curve_id", "keep", "overlaps")


PROTECTED_SQL = f"""
WITH {_BOXES_SQL}, p AS (SELECT c.char_idx, class_name, {_COVER.format(a="c", b="r")} / 24.0::DOUBLE AS cov FROM chars c JOIN regions r USING (doc_id, page)),
o AS (SELECT char_idx AS curve_id, coalesce(bool_or(class_name IN ('figure', 'table') AND cov > 0.3), false) AS keep, coalesce(bool_or(class_name = 'text' AND cov > 0.2), false) AS "overlaps" FROM p GROUP BY 1)
SELECT * FROM o WHERE keep OR "overlaps"
"""


def line_metrics(spark, d):
    rows = _chars(spark, d).withColumn("reach", F.col("x") + F.col("y"))
    return L.line_metrics(rows, L.PAGE, "x", "reach")


LINE_METRICS_SQL = f"WITH {_BOXES_SQL} SELECT doc_id, page, quantile_cont(x, 0.5) AS median_x, quantile_cont(x + y, 0.5) AS median_reach FROM chars GROUP BY ALL"


def paragraph_boxes(spark, d):
    return L.paragraph_boxes(_chars(spark, d), ["doc_id", "page", "xobj_id"])


PARAGRAPH_BOXES_SQL = f"WITH {_BOXES_SQL} SELECT doc_id, page, xobj_id, min(x) AS x, min(y) AS y, max(x2) AS x2, max(y2) AS y2, min(render_order) AS render_order FROM chars GROUP BY ALL"


def line_spacing(spark, d):
    rows = _chars(spark, d).withColumnRenamed("char_idx", "line_idx")
    return L.line_spacing(rows, L.PAGE)


LINE_SPACING_SQL = f"""
WITH {_BOXES_SQL}, g AS (SELECT doc_id, page, lag(y) OVER (PARTITION BY doc_id, page ORDER BY char_idx) - y AS d FROM chars)
SELECT doc_id, page, coalesce((list(d ORDER BY d) FILTER (WHERE d > 0))[len(list(d) FILTER (WHERE d > 0)) // 2 + 1], 10) AS spacing FROM g GROUP BY ALL
"""


def doc_flags(spark, d):
    """Documents' lines as paragraphs, those with digits as coded ones and every third page as scanned."""
    from bitloom.operators.paragraphs import paragraphs_from_text

    rows = paragraphs_from_text(table(spark, d, "documents"), ["doc_id"])
    rows = rows.withColumns({"page": F.floor(F.col("para_idx") / 5), "is_cid": F.col("text").rlike("[0-9]"), "text": F.concat(F.when(F.length("text") % 4 == 0, "(cid:12)").otherwise(""), "text")})
    out = L.document_flags(rows.withColumn("page_scanned", F.col("page") % 3 == 0))
    return out.select("doc_id", F.round("cid_char_share", 9).alias("cid_char_share"), F.round("cid_paragraph_share", 9).alias("cid_paragraph_share"), "unreadable", "scanned")


DOC_FLAGS_SQL = r"""
WITH p AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS t FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')), lambda x: x <> '') AS p FROM documents)),
q AS (SELECT doc_id, i // 5 AS page, regexp_matches(t, '[0-9]') AS cid, CASE WHEN length(t) % 4 = 0 THEN 8 ELSE 0 END AS c, length(t) + CASE WHEN length(t) % 4 = 0 THEN 8 ELSE 0 END AS n FROM p),
s AS (SELECT doc_id, sum(c)::DOUBLE / nullif(sum(n), 0) AS a, avg(cid::INT) AS b, count(DISTINCT page) FILTER (WHERE page % 3 = 0)::DOUBLE / count(DISTINCT page) AS sc FROM q GROUP BY 1)
SELECT doc_id, round(a, 9) AS cid_char_share, round(b, 9) AS cid_paragraph_share, a > 0.8 OR b > 0.8 AS unreadable, sc >= 0.8 AS scanned FROM s
"""


def box_functions(spark, d):
    """The scalar box functions on pairs of neighbouring characters of a page, summed up."""
    from pyspark.sql import Window

    box = G.box(*(F.col(c) for c in ("x", "y", "x2", "y2")))
    w = Window.partitionBy(*L.PAGE).orderBy("char_idx")
    rows = _chars(spark, d).withColumn("x2", F.col("x") + 60).withColumn("y2", F.col("y") + 90).withColumn("a", box)
    rows = rows.withColumn("b", F.lag("a").over(w)).where("b is not null")
    a, b = F.col("a"), F.col("b")
    return rows.groupBy("doc_id").agg(
        F.round(F.sum(G.coverage(a, b)), 6).alias("coverage"), F.round(F.sum(G.iou(a, b)), 6).alias("iou"), F.round(F.sum(G.y_coverage(a, b)), 6).alias("y_coverage"), F.round(F.sum(G.box_distance(a, b)), 4).alias("distance"),
        F.round(F.sum(G.y_min_coverage(a, b)), 6).alias("y_min_coverage"), F.round(F.sum(G.y_iou(a, b)), 6).alias("y_iou"), F.count_if(G.x_adjacent(a, b)).alias("x_adjacent"), F.count_if(G.x_contained(a, b)).alias("x_contained"), F.count_if(G.y_intersects(a, b)).alias("y_intersects"), F.count_if(G.is_newline(b, a, b["x2"] - b["x"], 5.0)).alias("newlines"),
    )


BOX_FUNCTIONS_SQL = f"""
WITH {_BOXES_SQL}, n AS (SELECT doc_id, x, y, x + 60 AS x2, y + 90 AS y2, lag(x) OVER w AS bx, lag(y) OVER w AS by_, lag(x) OVER w + 60 AS bx2, lag(y) OVER w + 90 AS by2 FROM chars WINDOW w AS (PARTITION BY doc_id, page ORDER BY char_idx)),
i AS (SELECT *, greatest(least(x2, bx2) - greatest(x, bx), 0) AS ox, greatest(least(y2, by2) - greatest(y, by_), 0) AS oy FROM n WHERE bx IS NOT NULL)
SELECT doc_id, round(sum(ox * oy / 5400.0::DOUBLE), 6) AS coverage, round(sum(ox * oy / (10800.0::DOUBLE - ox * oy)), 6) AS iou, round(sum(oy / 90.0::DOUBLE), 6) AS y_coverage,
  round(sum(sqrt(power(greatest(bx - x2, x - bx2, 0), 2) + power(greatest(by_ - y2, y - by2, 0), 2))), 4) AS distance, count(*) FILTER (WHERE (x <= bx2 AND bx <= x2) OR abs(x2 - bx) <= 2 OR abs(bx2 - x) <= 2) AS x_adjacent,
  count(*) FILTER (WHERE (x >= bx AND x2 <= bx2) OR (bx >= x AND bx2 <= x2)) AS x_contained, count(*) FILTER (WHERE NOT (y2 < by_ - 1 OR by2 < y - 1)) AS y_intersects, round(sum(oy / 90.0::DOUBLE), 6) AS y_min_coverage, round(sum(oy / (180.0::DOUBLE - oy)), 6) AS y_iou, count(*) FILTER (WHERE y2 <= by_ OR x2 < bx - 300) AS newlines
FROM i GROUP BY doc_id
"""


def char_lines(spark, d):
    """Lines of each page by both ways, with how many characters they have."""
    chars = L.split_lines(_chars(spark, d), [*L.PAGE, "xobj_id"]).withColumnRenamed("line_idx", "gap_line")
    rows = L.cluster_lines(chars.drop("xobj_id", "render_order"))
    text = F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "line_pos", "char_idx"))), lambda x: F.concat_ws(":", x["line_idx"].cast("string"), x["char_idx"].cast("string")))
    return rows.groupBy(*L.PAGE).agg(F.count("*").alias("chars"), F.count_distinct("line_idx").alias("lines"), (F.max("gap_line") + 1).alias("gap_lines"), F.sha2(F.array_join(text, ","), 256).alias("order_sha256"))


def located_words(spark, d):
    """Where on its page a turn's third to twelfth word stand; a turn is a page, a word a glyph, eight of them a line."""
    words = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.regexp_extract_all("text", F.lit(r"(\S+)"), 1).alias("w"))
    row, place = F.floor(F.col("glyph_idx") / 8), F.col("glyph_idx") % 8 * 60.0
    glyphs = words.select("doc_id", "page", F.posexplode("w").alias("glyph_idx", "char")).withColumns({"x": place, "y": 800.0 - row * 12, "x2": place + 50, "y2": 810.0 - row * 12})
    needles = words.select((F.col("doc_id") * 1000 + F.col("page")).alias("needle_id"), "doc_id", "page", F.array_join(F.slice("w", 3, 10), " ").alias("text"))
    return L.locate_text(glyphs, needles)


LOCATED_SQL = r"""
WITH w AS (SELECT conv_id * 1000 + turn AS needle_id, regexp_extract_all(text, '\S+') AS w FROM conversations),
g AS (SELECT needle_id, unnest(w) AS c, unnest(range(len(w))) AS i, len(w) AS n FROM w),
ways AS (SELECT g.*, way FROM g, (SELECT unnest([0, 1]) AS way) WHERE way = 0 OR NOT (c IN ('-', chr(173)) AND i % 8 = 7 AND i + 1 < n)),
body AS (SELECT needle_id, way, string_agg(lower(c), '' ORDER BY i) AS body FROM ways GROUP BY ALL),
asked AS (SELECT needle_id, lower(array_to_string(w[3:12], '')) AS wanted FROM w),
hit AS (SELECT needle_id, min(way) AS way FROM body JOIN asked USING (needle_id) WHERE wanted <> '' AND strpos(body, wanted) > 0 AND strpos(substr(body, strpos(body, wanted) + 1), wanted) = 0 GROUP BY 1),
placed AS (SELECT needle_id, way, c, i, sum(length(lower(c))) OVER (PARTITION BY needle_id, way ORDER BY i) AS through FROM ways),
found AS (SELECT p.needle_id, p.i FROM hit h JOIN asked a USING (needle_id) JOIN body b USING (needle_id, way) JOIN placed p USING (needle_id, way)
  WHERE through >= strpos(body, wanted) AND through - length(lower(c)) + 1 < strpos(body, wanted) + length(wanted)),
lines AS (SELECT needle_id, i // 8 AS row, min(i % 8) * 60.0::DOUBLE AS x, max(i % 8) * 60.0::DOUBLE + 50 AS x2 FROM found GROUP BY 1, 2)
SELECT needle_id, (row_number() OVER (PARTITION BY needle_id ORDER BY row) - 1)::INT AS line, x, 800.0::DOUBLE - row * 12 AS y, x2, 810.0::DOUBLE - row * 12 AS y2 FROM lines
"""


# --- streams, run to their end over the tables


def _streamed(spark, d, name: str, make, ordered: str | None = None, mode: str = "update") -> DataFrame:
    """What a stream over a table's files gives, written to the shared folder batch by batch and read as a table."""
    from bitloom.functions.storage import cut

    cut(spark.range(1))  # sees to it that there is a shared folder
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", _batch_files(spark)).parquet(_as_folder(spark, d, name, folder, ordered))
    out = make(rows)
    query = out.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.withColumn("batch_id", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/out/batch={i}")).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def _as_folder(spark, d, name: str, folder: str, ordered: str | None) -> str:
    """The table in three micro-batches' worth of files, so that state has to carry over; with a column, one third after the other in its order."""
    rows, files = table(spark, d, name), _batch_files(spark)
    if ordered is None:
        rows.repartition(3 * files).write.mode("overwrite").parquet(f"{folder}/in")
        return f"{folder}/in"
    at = F.unix_micros(F.col(ordered).cast("timestamp")) if ordered == "ts" else F.col(ordered)
    low, high = rows.select(at.cast("double").alias("at")).approxQuantile("at", [0.33, 0.66], 0.01) or (0.0, 0.0)
    part = (at > low).cast("int") + (at > high).cast("int")
    for k in range(3):  # the source takes files by their time
        rows.where(part == k).repartition(files).write.mode("append").parquet(f"{folder}/in")
    return f"{folder}/in"


def _batch_files(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def stream_task_feed(spark, d):
    """The newest state of each user's task from the events as a feed, whatever their order: later numbers are later revisions, errors delete."""
    code = F.get_json_object("props", "$.k").cast("int")
    feed = lambda e: e.select(F.concat(F.lit("s"), F.floor(F.col("user_id") / 8).cast("string")).alias("server"), F.lit(1).cast("long").alias("generation"), F.col("event_id").alias("revision"), F.col("user_id").cast("string").alias("task_id"), F.when(F.col("event_type") == "error", "deleted").otherwise("task").alias("type"), F.col("event_type").alias("status"), (code * 0).alias("attempt"))
    rows = _streamed(spark, d, "events", lambda e: S.snapshot_upsert(feed(e)))
    best = rows.groupBy("task_id").agg(F.max_by(F.struct("revision", "status", "deleted"), "batch_id").alias("b"))
    return best.select("task_id", "b.revision", "b.status", "b.deleted")


TASK_FEED_SQL = """
SELECT user_id::VARCHAR AS task_id, event_id AS revision, CASE WHEN event_type <> 'error' THEN event_type END AS status, event_type = 'error' AS deleted FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
"""


def stream_usage_totals(spark, d):
    """Each user's largest code so far from cumulative usage events, those of sign-ups unknown; the deltas add up to it."""
    usage = lambda e: e.select(F.col("user_id").cast("string").alias("call_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "signup", F.get_json_object("props", "$.k").cast("long")).alias("output"))
    rows = _streamed(spark, d, "events", lambda e: S.usage_delta_stream(usage(e), None))
    return rows.groupBy("call_id").agg(F.max("total").alias("total"), F.sum("delta").alias("deltas"))


USAGE_TOTALS_SQL = "WITH e AS (SELECT user_id, CASE WHEN event_type <> 'signup' THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events) SELECT user_id::VARCHAR AS call_id, coalesce(max(k), 0) AS total, coalesce(max(k), 0) AS deltas FROM e GROUP BY 1"


def stream_paragraph_states(spark, d):
    """Events as what happens to paragraphs (a code) of documents (a user): the last state of each, a purchase ending the document's run."""
    kind = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "succeeded").when(F.col("event_type") == "error", "review_failed").when(F.col("event_type") == "purchase", "finish").otherwise("skipped")
    code = (F.get_json_object("props", "$.k").cast("int") % 5).cast("string")
    made = lambda e: e.select(F.col("user_id").alias("doc_id"), F.when(kind != "finish", code).alias("paragraph_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.lit(None).cast("string").alias("reason"))
    rows = _streamed(spark, d, "events", lambda e: S.checkpoint_documents(made(e)), ordered="event_id")
    best = rows.groupBy("doc_id", "paragraph_id").agg(F.max_by(F.struct("status", "reason"), "batch_id").alias("b"))
    return best.select("doc_id", "paragraph_id", "b.status", "b.reason")


PARAGRAPH_STATES_SQL = """
WITH RECURSIVE e AS (
  SELECT user_id AS doc_id, json_extract_string(props, '$.k')::INT % 5 AS p, event_id,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'review_failed' WHEN 'purchase' THEN 'finish' ELSE 'skipped' END AS kind FROM events),
first AS (SELECT doc_id, p, min(event_id) AS since FROM e WHERE kind <> 'finish' GROUP BY ALL),
own AS (SELECT f.doc_id, f.p, e.kind, row_number() OVER (PARTITION BY f.doc_id, f.p ORDER BY e.event_id) AS n
  FROM first f JOIN e ON e.doc_id = f.doc_id AND e.event_id >= f.since AND (e.p = f.p OR e.kind = 'finish')),
walk AS (
  SELECT doc_id, p, 1::BIGINT AS n, CASE WHEN kind = 'review_failed' THEN NULL ELSE kind END AS status, NULL::VARCHAR AS reason FROM own WHERE n = 1
  UNION ALL
  SELECT o.doc_id, o.p, o.n,
    CASE WHEN o.kind = 'finish' THEN CASE WHEN status = 'pending' THEN 'failed' ELSE status END WHEN o.kind = 'review_failed' THEN CASE WHEN status = 'succeeded' THEN 'failed' ELSE status END
      WHEN o.kind = 'pending' AND status IN ('succeeded', 'skipped') THEN status ELSE o.kind END,
    CASE WHEN o.kind = 'finish' THEN CASE WHEN status = 'pending' THEN 'paragraph_not_completed' ELSE reason END WHEN o.kind = 'review_failed' THEN CASE WHEN status = 'succeeded' THEN 'quality_review_failed' ELSE reason END
      WHEN o.kind = 'pending' AND status IN ('succeeded', 'skipped') THEN reason END
  FROM walk w JOIN own o ON o.doc_id = w.doc_id AND o.p = w.p AND o.n = w.n + 1)
SELECT doc_id, p::VARCHAR AS paragraph_id, status, reason FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id, p ORDER BY n DESC) = 1
"""


def stream_buckets(spark, d):
    """Requests and codes by five-minute buckets from a stream of events in the order of time."""
    rows = _streamed(spark, d, "events", lambda e: S.bucket_stream(e.withColumns({"ts": F.col("ts").cast("timestamp"), "tokens": F.get_json_object("props", "$.k").cast("long")})), ordered="ts")
    best = rows.groupBy(F.col("window.start").cast("timestamp_ntz").alias("bucket_start")).agg(F.max_by(F.struct("requests", "tokens"), "batch_id").alias("b"))
    return best.select("bucket_start", "b.requests", "b.tokens")


STREAM_BUCKETS_SQL = "SELECT time_bucket(INTERVAL 5 minutes, ts) AS bucket_start, count(*) AS requests, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS tokens FROM events GROUP BY 1"


def stream_calls_once(spark, d):
    """Of repeated events of a call (a user's code) the number that remain, each kind of event once a call, whatever lies between them."""
    made = lambda e: e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("-", "user_id", F.get_json_object("props", "$.k")).alias("call_id"), F.col("event_type").alias("event"))
    rows = _streamed(spark, d, "events", lambda e: S.dedupe_calls(made(e), "10000 days"), mode="append")
    return rows.groupBy("event").agg(F.count("*").alias("calls"))


CALLS_ONCE_SQL = "SELECT event_type AS event, count(*) AS calls FROM (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS k, event_type FROM events) GROUP BY 1"


QUERIES = {f.__name__: f for f in (region_assign, formula_region, element_assign, overlaps, protected_elements, line_metrics, paragraph_boxes, line_spacing, doc_flags, box_functions, char_lines, located_words, stream_task_feed, stream_usage_totals, stream_paragraph_states, stream_buckets, stream_calls_once)}
SQL = {
    "region_assign": REGION_SQL, "formula_region": FORMULA_REGION_SQL, "element_assign": ELEMENT_SQL, "overlaps": OVERLAPS_SQL, "protected_elements": PROTECTED_SQL, "line_metrics": LINE_METRICS_SQL, "paragraph_boxes": PARAGRAPH_BOXES_SQL, "line_spacing": LINE_SPACING_SQL, "doc_flags": DOC_FLAGS_SQL,
    "box_functions": BOX_FUNCTIONS_SQL, "located_words": LOCATED_SQL, "stream_task_feed": TASK_FEED_SQL, "stream_usage_totals": USAGE_TOTALS_SQL,
    "stream_paragraph_states": PARAGRAPH_STATES_SQL, "stream_buckets": STREAM_BUCKETS_SQL, "stream_calls_once": CALLS_ONCE_SQL,
}
