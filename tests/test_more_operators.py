"""More operators on small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from bitloom.functions import geometry as G
from bitloom.functions import numbers as N
from bitloom.functions import text as T
from bitloom.operators import evaluate, evidence, layout, ledger, memory, model_steps, paragraphs


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def frame(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


BOX = "x double, y double, x2 double, y2 double"


# --- text and paragraphs


def test_paragraphs_are_trimmed_of_all_white_space(spark):
    docs = frame(spark, "d int, text string", (1, "a\r\n\t\nb\t\n\xa0　\nc "), (2, None), (3, "x\n\n y\n\n\n\nz"))
    assert rows(paragraphs.paragraphs_from_text(docs, ["d"])) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (3, 0, "x"), (3, 1, "y"), (3, 2, "z")]
    assert rows(paragraphs.paragraphs_from_text(docs.where("d = 3"), ["d"], max_gap=1)) == [(3, 0, "x y"), (3, 1, "z")]


def test_paragraphs_from_items(spark):
    items = frame(spark, "doc_id int, page int, item_idx int, text string, y double, height double", (1, 1, 0, "one", 700.0, 10.0), (1, 1, 1, "two", 688.0, 10.0), (1, 1, 2, "far", 650.0, 10.0), (1, 1, 3, "up", 720.0, 10.0), (1, 1, 4, " ", 709.0, 10.0))
    assert rows(paragraphs.paragraphs_from_items(items)) == [(1, 1, 0, "one two"), (1, 1, 1, "far"), (1, 1, 2, "up")]


def test_export_writes_bounded_folders(spark, tmp_path):
    body = frame(spark, "doc_id long, para_idx int, text string", *((d, i, f"p{d}-{i}") for d in range(40) for i in (1, 0)), (99, 0, " "))
    failed = rows(paragraphs.export_documents(body, f"{tmp_path}/md", "md", buckets=4).where("failure is not null"))
    out = spark.read.parquet(f"{tmp_path}/md")
    assert failed == [(99, "export_needs_ocr")] and out.select("bucket").distinct().count() <= 4
    assert rows(out.where("doc_id = 3"), "value") == [("p3-0\n\np3-1",)]
    paragraphs.export_documents(body, f"{tmp_path}/json", "json")
    assert rows(spark.read.json(f"{tmp_path}/json").where("doc_id = 3"), "parts") == [(["p3-0", "p3-1"],)]


def test_reference_sections(spark):
    def flags(*spec, pages=4):
        data = [(1, page, i, text, label, pages, font, size) for i, (page, text, label, font, size) in enumerate(spec)]
        out = paragraphs.reference_flags(frame(spark, "doc_id long, page int, para_idx int, text string, label string, pages int, font_id string, font_size double", *data))
        return [r["is_reference"] for r in out.orderBy("para_idx").collect()]

    text = lambda page, t, label="text", font="f", size=9.0: (page, t, label, font, size)
    entries = [text(3, "[1] A. B. Title, 2001."), text(3, "[2] C. D. Title, 2002.")]
    assert flags(text(0, "Intro"), text(3, "7 References"), *entries, text(3, "Acknowledgments"), text(3, "[3] later 2003")) == [False, True, True, True, False, False]
    assert flags(text(0, "References"), text(0, "[1] x 2001"), text(0, "[2] y 2002")) == [False] * 3  # the first half, as in a contents page
    assert flags(text(0, "References"), text(0, "[1] x 2001", "reference"), text(0, "[2] y 2002")) == [True] * 3  # a label there speaks for it
    assert flags(text(3, "References"), text(3, "[1] x 2001"), text(3, "Appendix A: proofs"), text(3, "[2] y 2002")) == [False] * 4  # one entry before the section is over
    assert flags(text(3, "References"), *entries, text(3, "Appendix A describes data."), text(3, "Appendix B Proofs"), text(3, "more 2001")) == [True, True, True, True, False, False]
    # an early list after a section has ended needs no other sign
    again = flags(text(2, "References"), *[(2, *e[1:]) for e in entries], text(2, "Funding"), text(0, "References"), text(0, "[1] x 2001"), text(0, "[2] y 2002"), pages=4)
    assert again == [True, True, True, False, True, True, True]
    # lettered headings end it in the heading's own typeface only
    lettered = flags(text(3, "References", "title", "b", 12.0), *entries, text(3, "A Proofs", "caption", "f", 9.0), text(3, "B More", "caption", "b", 12.0), text(3, "rest"))
    assert lettered == [True, True, True, True, False, False]
    assert flags(text(0, "[9] odd 2009", "reference_content"), text(1, "words")) == [True, False]


def test_text_predicates(spark):
    one = frame(spark, "a string", ("x",))
    assert one.select(T.is_text_region(F.lit("caption")), T.is_text_region(F.lit("formula")), T.is_body(F.lit("text"))).first()[:] == (True, False, True)
    missing, hints = T.rule_hints(F.lit("a long source text with words in it"), F.lit("a"), F.array(F.lit("source"), F.lit("a")))
    assert one.select(missing, hints).first()[:] == (["source"], ["no_han", "short_output"])
    text, removed = T.strip_unknown_placeholders(F.lit("a {v1} <style id='1'>b</style> {v9}"), F.array(F.lit("{v1}"), F.lit("</style>")))
    assert one.select(text, removed).first()[:] == ("a {v1} b</style> ", ["<style id='1'>", "{v9}"])
    assert one.select(T.strip_reasoning(F.lit("<think>hm\n</think> yes")), T.language_supported(F.lit("EN_us"), F.lit("zh"), [("en", "zh")])).first()[:] == ("yes", True)
    title, year = T.title_parts(F.lit(" "), F.lit("My  file.pdf"), F.lit("12 May 2021"))
    assert one.select(title, year).first()[:] == ("My file", "2021")
    assert one.select(T.protected_spans(F.lit("see {v1} and <b> [2] http://a.org/x"))).first()[0] == ["{v1}", "<b>", "[2]", "http://a.org/x"]
    with pytest.raises(Exception, match="not finite"):
        one.select(T.finite(F.lit(float("nan")))).collect()


def test_parts_and_volume(spark):
    pages = spark.range(45).selectExpr("1 as doc_id", "cast(id as int) as page")
    assert rows(paragraphs.part_ranges(pages, ["doc_id"])) == [(1, 0, 0, 19), (1, 1, 20, 39), (1, 2, 40, 44)]
    texts = frame(spark, "k int, text string", (1, "a bc"), (1, "d"))
    assert rows(paragraphs.text_volume(texts, "k", tokens=lambda c: F.length(F.regexp_replace(c, " ", "")))) == [(1, 5, 4, 2)]
    statuses = frame(spark, "doc_id int, para_idx int, status string", (1, 0, "succeeded"), (1, 3, "failed"), (1, 2, "failed"), (1, 1, "pending"))
    assert rows(paragraphs.status_summary(statuses)) == [(1, 4, 1, 0, 2, 1, [2, 3])]
    assert rows(paragraphs.unique_terms(frame(spark, "text_id int, sentence_idx int, terms array<string>", (1, 0, ["a", "b", "a"]), (1, 1, ["b", "c"])))) == [(1, "a", 0), (1, "c", 1)]


# --- boxes


def test_intervals(spark):
    box = lambda *v: G.box(*(F.lit(float(x)) for x in v))
    one = spark.range(1)
    a = box(0, 0, 10, 10)
    cases = {"adjacent": [(box(5, 0, 20, 10), True), (box(12, 0, 20, 10), True), (box(12.5, 0, 20, 10), False), (box(-5, 0, -2, 1), True)], "contained": [(box(1, 0, 9, 1), True), (box(-1, 0, 9, 1), False), (box(-1, 0, 11, 1), True)], "y": [(box(0, 11, 1, 12), True), (box(0, 11.5, 1, 12), False)]}
    for name, f in (("adjacent", G.x_adjacent), ("contained", G.x_contained), ("y", G.y_intersects)):
        for b, want in cases[name]:
            assert one.select(f(a, b)).first()[0] is want and one.select(f(b, a)).first()[0] is want
    assert one.select(G.y_iou(a, box(0, 5, 1, 15)), G.y_min_coverage(a, box(0, 5, 1, 7))).first()[:] == (5 / 15, 1.0)


def test_merge_formulas(spark):
    schema = f"doc_id long, page int, para_idx int, part_idx int, line_id int, region_id long, {BOX}"

    def groups(*parts):
        data = [(1, 1, 1, part, line, region, *map(float, box)) for part, line, region, box in parts]
        return [r["group"] for r in layout.merge_formulas(frame(spark, schema, *data)).orderBy("part_idx").collect()]

    assert groups((0, 1, None, (0, 0, 10, 10)), (1, 1, None, (11, 1, 20, 10))) == [0, 0]  # side by side
    assert groups((0, 1, None, (0, 0, 10, 10)), (2, 1, None, (11, 1, 20, 10))) == [0, 1]  # a text between them
    assert groups((0, 1, None, (0, 0, 10, 10)), (1, 2, None, (11, 1, 20, 10))) == [0, 1]  # another line
    assert groups((0, 1, None, (0, 0, 10, 10)), (1, 1, None, (11, 8, 20, 20))) == [0, 1]  # too little common height
    assert groups((0, 1, None, (0, 0, 10, 10)), (1, 1, None, (2, 10.5, 8, 14))) == [0, 0]  # a script above
    assert groups((0, 1, 7, (0, 0, 10, 10)), (4, 1, 7, (90, 0, 99, 10)), (6, 1, 8, (200, 0, 210, 10))) == [0, 0, 1]  # one region, however far
    assert groups((0, 1, None, (0, 0, 10, 10)), (5, 1, None, (1, 1, 3, 3))) == [0, 0]  # one lies in the other
    assert groups((0, 1, 7, (0, 0, 10, 10)), (1, 1, None, (30, 0, 31, 10)), (2, 1, 7, (50, 0, 60, 10)), (3, 1, None, (33, 0, 34, 10))) == [0, 0, 0, 0]  # the merged box takes in what lies within


def test_characters_to_styles(spark):
    chars = frame(spark, "doc_id long, para_idx int, char_idx int, font_id string, font_size double", (1, 0, 0, "a", 9.0), (1, 0, 1, "a", 9.01), (1, 0, 2, "b", 9.0))
    assert rows(layout.base_style(chars)) == [(1, 0, False, True, "a", 9.0)]
    line = [(1, 1, 0, i, c, s, f, 0.0, 0.0, 1.0, 1.0) for i, (c, s, f) in enumerate([("a", 10.0, False), (" ", 10.0, False), ("x", 10.0, True), ("2", 6.0, False), (" ", 10.0, False), ("b", 10.0, False), ("=", 10.0, False)])]
    out = layout.tag_formula_chars(frame(spark, f"doc_id long, page int, line_idx int, char_idx int, char_unicode string, font_size double, formula_font boolean, {BOX}", *line))
    assert [r["is_formula"] for r in out.orderBy("char_idx").collect()] == [False, False, True, True, True, False, True]
    parts = frame(spark, f"p int, part_idx int, is_formula boolean, {BOX}", (1, 0, False, 0.0, 0.0, 10.0, 10.0), (1, 1, True, 12.0, 1.0, 15.0, 9.0))
    assert rows(layout.formula_offsets(parts, ["p"]), "x_offset", "y_offset") == [(2.0, 1.0)]
    fonts = frame(spark, "doc_id long, page int, xobj_id long, font_id string, name string", (1, 1, None, "F1", "CMMI10"), (1, 1, None, "F2", "Times"), (1, 1, 5, "F1", "Times"), (1, 1, 5, "F3", "CMSY"))
    assert rows(layout.formula_fonts(fonts, "^CM"), "xobj_id", "font_id") == [(5, "F3"), (None, "F1")]


def test_lines_and_places(spark):
    chars = [(1, 1, i, c, r, 1, float(x), float(y), x + 5.0, y + 8.0) for i, (c, r, x, y) in enumerate([("a", 1, 0, 100), ("b", 1, 6, 100), ("c", 2, 0, 80), ("•", 2, 0, 60), ("d", 2, 6, 60)])]
    out = layout.group_chars(frame(spark, f"doc_id long, page int, char_idx int, char_unicode string, region_id long, xobj_id long, {BOX}", *chars))
    assert [r["para_idx"] for r in out.orderBy("char_idx").collect()] == [0, 0, 1, 2, 2]
    lines = frame(spark, "doc_id long, page int, para_idx int, line_idx int, text string, x double, x2 double", (1, 1, 0, 0, "full", 0.0, 100.0), (1, 1, 0, 1, "short", 0.0, 50.0), (1, 1, 0, 2, "next", 0.0, 100.0), (1, 1, 0, 3, "• item", 0.0, 100.0))
    assert [r["part"] for r in layout.split_short_lines(lines).orderBy("line_idx").collect()] == [0, 0, 1, 2]
    glyphs = [(1, 1, i, c, float(10 * (i % 4)), 100.0 - 12 * (i // 4), 10.0 * (i % 4) + 9, 108.0 - 12 * (i // 4)) for i, c in enumerate("ab- cdef")]
    found = layout.locate_text(frame(spark, f"doc_id long, page int, glyph_idx int, char string, {BOX}", *glyphs), frame(spark, "needle_id long, doc_id long, page int, text string", (1, 1, 1, "AB"), (2, 1, 1, "b- c"), (3, 1, 1, "zz")))
    assert [(r["needle_id"], r["line"]) for r in found.orderBy("needle_id", "line").collect()] == [(1, 0), (2, 0), (2, 1)]


# --- ledgers and evidence


def test_live_rates(spark):
    events = frame(spark, "k int, seconds double, started boolean, paragraphs int, output long, complete boolean", (1, 0.0, True, None, None, None), (1, 4.0, True, 1, 100, True), (1, 14.0, True, 2, 100, True), (1, 20.0, True, None, None, None), (1, 50.0, False, None, 50, False))
    got = [tuple(r)[6:] for r in ledger.live_rates(events, ["k"]).orderBy("seconds").collect()]
    assert got == [(0.1, None, None), (0.2, 15.0, None), (0.2, 12.9, 20.0), (0.2, 9.0, 12.5), (0.0, None, None)]


def test_stage_ends_and_parts(spark):
    events = frame(spark, "k int, stage string, type string, seconds int, seq int, current int, total int", (1, "a", "start", 0, 1, 0, 9), (1, "a", "start", 5, 2, 0, 9), (1, "a", "update", 7, 3, 9, 9), (1, "a", "end", 9, 4, 9, 9), (1, "f", "start", 0, 5, 0, 2), (1, "f", "update", 3, 6, 2, 2), (1, "f", "end", 8, 7, 2, 2), (1, "b", "end", 1, 8, 0, 0))
    assert rows(ledger.stage_durations(events, ["k"], ("f",))) == [(1, "a", 4, 1), (1, "f", 3, 1)]
    stages = frame(spark, "k int, part int, stage string, current int, total int", (1, 0, "a", 2, 2), (1, 0, "b", 1, 2), (1, 1, "a", 1, 2))
    assert rows(ledger.weighted_progress(stages, ["k"], {"a": 1.0, "b": 3.0}, "part", 2)) == [(1, (25 + 37.5 + 12.5) / 2)]


def test_trim_evidence(spark):
    made = [(1, f"e{i}", "execution", 9, i, 10) for i in range(5)] + [(1, f"e{i % 5}", "request" if i % 2 else "paragraph", i % 3, 10 + i, 10) for i in range(20)]
    kept, omitted = ledger.trim_evidence(frame(spark, "k int, execution_id string, kind string, priority int, seq int, size int", *made), ["k"], 80, 100, executions=3)
    got = rows(kept, "kind", "execution_id", "priority", "seq")
    assert [x[1] for x in got if x[0] == "execution"] == ["e2", "e3", "e4"]
    mine = sorted(((p, s, k) for _, e, k, p, s, _ in made if e in ("e2", "e3", "e4") and k != "execution"), reverse=True)
    assert sorted((p, s) for k, _, p, s in got if k != "execution") == sorted((p, s) for p, s, _ in mine[:5])
    assert rows(omitted) == [(1, 2, sum(k == "request" for *_, k in mine[5:]), sum(k == "paragraph" for *_, k in mine[5:]))]


def test_times_and_connections(spark):
    one = spark.range(1)
    assert one.select(ledger.epoch_ms(ledger.iso_to_ts(F.lit("2024-01-02T03:04:05.678Z"))), ledger.iso_to_ts(F.lit("soon"))).first()[:] == (1704164645678, None)
    ts = [F.to_timestamp(F.lit(f"2024-01-01 00:00:{s}")) for s in ("00", "02.5", "10")]
    assert one.select(*ledger.phase_seconds(*ts)).first()[:] == (2.5, 7.5, 10.0)
    trace = frame(spark, "run_id int, request_id int, http_status int, stages array<struct<name:string,seconds:double>>", (1, 1, 200, [("connect", 0.5), ("tls", None)]), (1, 2, 500, [("connect", 0.25)]), (1, 3, 200, []))
    assert rows(ledger.connection_summary(trace)) == [(1, 3, 2, 0.75, None, 1)]
    request = frame(spark, "text string, context string, source_lang string, target_lang string, mode string, page int", (" ", None, None, "zh", "word", 1), ("x", None, None, None, "word", 1), ("x", None, None, "zh", "all", 1), ("x", None, None, "zh", "word", 0), ("x", None, "en", "zh", "word", None))
    assert [r[0] for r in request.select(evidence.text_request_error(request)).collect()] == ["text_required", "invalid_language", "invalid_mode", "invalid_page", None]
    status = evidence.evidence_status(frame(spark, "task_id int, kind string, complete boolean", (1, "r", True), (2, "r", True), (4, "r", True)), frame(spark, "task_id int, state string, recorded boolean", (1, "done", True), (2, "interrupted", True), (3, "done", True), (4, "done", False)))
    assert rows(status) == [(1, False, "available"), (2, True, "partial"), (3, False, "missing"), (4, False, "unavailable")]


# --- datasets and memory


def test_variants_and_lists(spark):
    samples = frame(spark, "sample_id int, source_text string, split string", (1, "one two two three", "development"), (2, "x", "holdout"))
    variants = "array<struct<id:string,line_break_before:array<string>,added_terms:array<struct<source:string,target:string>>>>"
    cases = frame(spark, f"case_id string, sample_id int, variants {variants}", ("c", 1, [("same", [], []), ("again", [], None), ("broken", ["three"], []), ("twice", ["two"], []), ("terms", [], [("one", "un")]), ("bare", [], [("one", " ")])]))
    got = {r["variant_id"]: (r["text"], r["problem"]) for r in evaluate.expand_variants(samples, cases).collect()}
    assert got["broken"] == ("one two two \nthree", None) and got["terms"] == ("one two two three", None)
    assert {k: v[1] for k, v in got.items() if v[1]} == {"same": "duplicate_variant", "again": "duplicate_variant", "twice": "literal_not_unique", "bare": "term_incomplete"}
    ids = frame(spark, "sample_id int", (1,), (1,), (2,), (7,))
    assert rows(evaluate.id_list_problems(samples, ids, 3)) == [(1, "repeated"), (7, "unknown"), (None, "wrong_size")] and rows(evaluate.id_list_problems(samples, ids.where("sample_id = 2"), 1)) == []
    assert rows(evaluate.page_trial(samples, ids), "sample_id") == [(1,), (2,)] and rows(evaluate.holdout_filter(samples, ids), "sample_id") == [(2,)]
    assert rows(evaluate.union_samples(samples, frame(spark, "sample_id int, more int", (3, 4))), "sample_id", "more") == [(1, None), (2, None), (3, 4)]


def test_blind_packets_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BLIND_ROWS", 500)
    many = spark.range(120_000).withColumnRenamed("id", "job")
    packet = evaluate.blind_packet(many, "job", "s").cache()
    ids = packet.agg(F.count_distinct("blind_id"), F.min(F.length("blind_id")), F.max(F.length("blind_id"))).first()
    assert ids[:] == (120_000, 6, 7) and packet.where("blind_id in ('E00001', 'E120000')").count() == 2
    key = evaluate.blind_key(packet, "job", ["job"])
    assert key.columns == ["blind_id", "job", "result_sha256"] and key.select("result_sha256").distinct().count() == 120_000


def test_short_texts_equal_brute_force(spark):
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 4)))
    texts = sorted({" ".join(word() for _ in range(r.randint(1, 6))) for _ in range(150)})
    data = frame(spark, "side int, id int, t string", *((i % 2, i, t) for i, t in enumerate(texts)))
    for across in (False, True):
        got = {(i, j) for _, i, _, j in rows(evaluate.inside_candidates(data, data, across)) if texts[i] in texts[j]}
        assert got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if a in b and (not across or i % 2 != j % 2)}


def test_generations_pages_and_history(spark):
    current = frame(spark, "key string, text string", ("a", "new"))
    history = frame(spark, "key string, text string, fingerprint string", ("a", "old", "one"), ("b", "old", "one"), ("c", "kept", "two"))
    now, whole = memory.archive_generation(current, history, "one", "two")
    assert rows(now) == [("c", "kept")] and rows(whole) == [("a", "new", "one"), ("c", "kept", "two")]
    back, _ = memory.archive_generation(now, whole, "two", "one")
    assert rows(back) == [("a", "new")]
    pages = frame(spark, "doc_id int, page int", (1, 3), (1, 5))
    assert rows(memory.output_pages(pages)) == [(1, 1, 3), (1, 2, 5)]
    assert rows(memory.output_pages(pages, "alternating")) == [(1, 1, -3), (1, 2, 3), (1, 3, -5), (1, 4, 5)] and rows(memory.output_pages(pages, "alternating", True), "page") == [(-3,), (-5,), (3,), (5,)]
    old = frame(spark, "g int, at double", *((1, float(i)) for i in range(10)))
    assert rows(memory.history_prune(old, "g", "at", 9.0, n=3, ttl=5.0), "at") == [(7.0,), (8.0,), (9.0,)]
    approvals = frame(spark, "source string, output string, version int, priority int, fingerprint string, approved_output string, seq int", ("s", "o", 1, 0, "f", "yes", 1), ("s", "o", 1, 0, "f", "better", 2), ("s", "o", 2, 0, "f", "other", 3))
    got = memory.review_selection_merge(frame(spark, "source string, output string, version int, priority int, fingerprint string", ("s", "o", 1, 0, "f"), ("s", "p", 1, 0, "f")), approvals)
    assert rows(got, "output", "approved_output") == [("o", "better"), ("p", None)]


def test_memory_lookup_equals_brute_force(spark):
    import random

    r = random.Random(11)
    texts = ["".join(r.choice("ab ") for _ in range(r.randint(1, 9))).strip() for _ in range(60)]
    stored = [(f"d{i % 3}", i % 4, i, t, t[::-1], " ".join(t.split())) for i, t in enumerate(texts) if t.strip()]
    table = frame(spark, "doc_fingerprint string, page int, seq int, source string, translation string, normalized_source string", *stored)
    asked = [(i, f"d{i % 3}", "".join(r.choice("ab ") for _ in range(r.randint(1, 5))), i % 4 if i % 5 else None) for i in range(90)]
    got = {x["query_id"]: (x["match_type"], x["memory_seq"]) for x in memory.lookup_memory(frame(spark, "query_id int, doc_fingerprint string, text string, page int", *asked), table).collect()}
    for i, d, t, page in asked:
        w = " ".join(t.split())
        own = [s for s in stored if s[0] == d]
        same = [s for s in own if w and s[5] == w]
        inside = [s for s in own if w and w in s[5]]
        want = (None, None)
        if same:
            want = ("exact", max(same, key=lambda s: (s[1] == page, s[2]))[2])
        elif inside:
            want = ("contained", max(inside, key=lambda s: (s[1] == page, -len(s[5]), s[2]))[2])
        assert got[i] == want, (i, t)


# --- model steps and numbers


def test_model_helpers(spark):
    one = spark.range(1)
    entry = '{"senses":[{"chinese":"词","english":"word","examples":[{"source":"a","target":"b"}]}]}'
    assert one.select(model_steps.dictionary_entry_valid(F.lit(entry)), model_steps.dictionary_entry_valid(F.lit('{"senses":[]}')), model_steps.dictionary_entry_valid(F.lit("no"))).first()[:] == (True, False, False)
    assert one.select(model_steps.context_meaning_valid(F.lit('{"meaning":"m","explanation":"e"}')), model_steps.context_meaning_valid(F.lit('{"meaning":" ","explanation":"e"}'))).first()[:] == (True, False)
    batches = frame(spark, "b int, row_id int, source string, terms array<string>, ctx string", (1, 1, "two", ["x=y"], "title"), (1, 0, "one", ["a=b", "x=y"], "title"))
    assert rows(model_steps.prompt_column(batches, "Role", ["b"], "terms", "ctx")) == [(1, 'Role\n\nContext: title\n\nGlossary:\na=b\nx=y\n\n[{"id":0,"input":"one"},{"id":1,"input":"two"}]')]
    reviewed = frame(spark, "k int, label string, review string", (1, "text", "passed"), (1, "text", "corrected"), (1, "text", "not_selected"), (1, "header", "passed"), (1, "text", "failed"))
    assert rows(model_steps.quality_summary(reviewed, "k")) == [(1, 3, 2, 1, 1, 0, 1, 1)]
    candidates = frame(spark, "row_id long, label string, source string, output string, continuation boolean", (1, "text", "the model is", "le truc", True), (2, "header", "the model", "x", True), (3, "text", "nothing", "rien", False))
    terms = frame(spark, "source string, target string", ("model", "modele"))
    assert rows(model_steps.review_priority(candidates, terms), "row_id", "priority") == [(1, 2), (2, 0), (3, 0)]


def test_number_helpers(spark):
    one = spark.range(1)
    assert one.select(N.add_counts(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(5)))).first()[0] == {"a": 3, "b": 5}
    assert one.select(N.reduction_percent(F.lit(10.0), F.lit(9.0)), N.rate(F.lit(1), F.lit(3)), N.rate(F.lit(1), F.lit(0))).first()[:] == (10.0, 0.3333, None)
