"""Batches around a model function: budgets, repair, commits, evidence; memory by language; replies' ids."""


from bitloom.operators import memory, model_steps, terms

P = "doc_id long, page int, row_id long, source string"
WIDE = 2**60 + 1


def by_row(df, *columns):
    return {r["row_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_slots_are_repaired_before_regeneration(spark):
    df = spark.createDataFrame([(WIDE, 0, 0, "we see {v1} in some plain words"), (WIDE, 0, 1, "nothing special stands in here"), (3, 0, 2, "this fails in every possible way")], P)

    def fn(batch):
        return ["" if "fails" in s else "译" + s.replace("{v1}", "") for s in batch]

    def repair(pieces):
        assert all("{v1}" not in p for p in pieces)
        return ["修" + p for p in pieces]

    got = by_row(model_steps.translate_batches(df, fn, None, "zh", repair_fn=repair), "status", "code", "output", "attempts", "committed", "doc_id")
    assert got[0] == ("succeeded", None, "修we see {v1}修 in some plain words", 2, True, WIDE)
    assert got[1] == ("succeeded", None, "译nothing special stands in here", 1, True, WIDE)
    assert got[2][:2] == ("failed", "empty_translation") and got[2][3:] == (2, False, 3)
    without = by_row(model_steps.translate_batches(df, fn, None, "zh"), "status", "code", "committed")
    assert without[0] == ("failed", "placeholder_mismatch", False) and without[1] == ("succeeded", None, False)  # its batch never became whole


def test_requests_are_bounded_per_document(spark):
    rows = [(d, 0, i, "plain words for one batch " * 10) for d in (1, 2) for i in range(8)]
    df = spark.createDataFrame(rows, P)
    out = model_steps.translate_batches(df, lambda b: ["译" + s for s in b], None, "zh", max_sum=1, requests=3)
    assert {(r["doc_id"], r["status"], r["code"]): r["count"] for r in out.groupBy("doc_id", "status", "code").count().collect()} == {(d, s, c): n for d in (1, 2) for s, c, n in (("succeeded", None, 3), ("failed", "budget_exhausted", 5))}
    tries = by_row(model_steps.translate_batches(df.where("doc_id = 1"), lambda b: [None] * len(b), None, "zh", max_sum=1, requests=10), "code", "attempts")
    assert sorted(v[1] for v in tries.values()) == [1] * 6 + [2] * 2 and {v[0] for v in tries.values()} == {"empty_translation", "budget_exhausted"}


def test_failures_say_why(spark):
    def fn(batch):
        raise ValueError("no such model")

    df = spark.createDataFrame([(1, 0, 0, "some plain prose here")], P)
    assert by_row(model_steps.translate_batches(df, fn), "status", "error")[0] == ("failed", "ValueError: no such model")
    assert by_row(model_steps.translate_batches(df, lambda b: []), "error")[0] == ("0 outputs for 1 rows",)


C = "doc_id long, row_id long, label string, priority int, continuation_group long, source string, output string"


def test_reviews_need_evidence_and_keep_their_budget(spark):
    rows = [(d, i, "text", 2, None, f"source words number {i}", "译文") for d in (WIDE, 7) for i in range(20)]
    df = spark.createDataFrame(rows, C)

    def verdicts(batch):
        told = []
        for r in batch:
            n = int(r["source"].rsplit(" ", 1)[1]) % 4
            told.append(['"passed"', '"corrected", "evidence": "words number", "output": "新译"', '"corrected", "evidence": "not in it", "output": "新"', '"corrected", "evidence": "source", "output": "译文"'][n])
        return "[" + ",".join(f'{{"id": {i}, "verdict": {t}}}' for i, t in enumerate(told)) + "]"

    out = by_row(model_steps.review_batches(df, verdicts, requests=3).where("doc_id <> 7"), "doc_id", "review", "reason", "output")
    want = [("passed", None, "译文"), ("corrected", None, "新译"), ("unchecked", "invalid_review", "译文"), ("passed", None, "译文")]
    assert all(out[i] == (WIDE, *want[i % 4]) for i in range(12)) and all(out[i] == (WIDE, "unchecked", "budget_exhausted", "译文") for i in range(12, 20))

    def broken(batch):
        raise RuntimeError("down")

    assert set(by_row(model_steps.review_batches(df.where("doc_id = 7"), broken), "review", "reason").values()) == {("unchecked", "provider_error: RuntimeError: down")}


def test_replies_name_rows_by_numbers_or_digits(spark):
    sources = spark.createDataFrame([(b, i, f"plain source text {i}") for b in (1, 2, 3, 4, 5, 6) for i in range(2)], "batch_id int, row_id int, source string")
    replies = [
        (1, '[{"id": "0", "output": "甲"}, {"id": 1, "output": "乙"}]'), (2, '[{"id": true, "output": "甲"}, {"id": 1.0, "output": "x"}, 5, {"id": "01", "output": "乙"}, {"id": -1, "output": "z"}]'),
        (3, "not json"), (4, '{"id": 0, "output": "甲"}'), (5, "7"),
    ]
    got = {(r["batch_id"], r["row_id"]): (r["output"], r["code"], r["unassigned"]) for r in model_steps.inspect_batch(spark.createDataFrame(replies, "batch_id int, reply string"), sources, "zh").collect()}
    lacks, bad = (None, "paragraph_count_mismatch"), (None, "invalid_json")
    assert got == {
        (1, 0): ("甲", None, False), (1, 1): ("乙", None, False), (2, 0): (*lacks, True), (2, 1): ("乙", None, True), (3, 0): (*bad, False), (3, 1): (*bad, False),
        (4, 0): ("甲", None, False), (4, 1): (*lacks, False), (5, 0): (*lacks, False), (5, 1): (*lacks, False), (6, 0): (*bad, False), (6, 1): (*bad, False),
    }


MEMORY = "doc_fingerprint string, target_lang string, page int, paragraph_id string, source string, translation string, reading string, status string, quality string, seq long"


def test_memory_keeps_the_first_source_and_knows_languages(spark):
    base = ("d", "zh_CN", 2, "p1", "a  b physical", "甲", None, "succeeded", None, 1)
    first = memory.upsert_memory(None, spark.createDataFrame([base, ("d", "ja", 3, "p2", "a b physical", "乙", None, "succeeded", None, 2)], MEMORY))
    table = memory.upsert_memory(first, spark.createDataFrame([(*base[:4], "a b physical", "丙", *base[6:9], 5)], MEMORY))
    assert {(r["target_lang"], r["source"], r["translation"], r["seq"]) for r in table.collect()} == {("zh-cn", "a  b physical", "丙", 1), ("ja", "a b physical", "乙", 2)}
    asked = [(1, "d", "a b physical", 3, "zh-CN"), (2, "d", "b phys", 2, "JA"), (3, "d", "b phys", 2, None), (4, "d", "b phys", 2, "fr"), (5, "d", "a b physical", 3, ""), (6, "d", "a", 2, "ja")]
    out = memory.lookup_memory(spark.createDataFrame(asked, "query_id int, doc_fingerprint string, text string, page int, lang string"), table)
    got = {r["query_id"]: (r["match_type"], r["match_lang"], r["paragraph_id"], r["formatting_incomplete"]) for r in out.collect()}
    assert got == {1: ("exact", "zh-cn", "p1", False), 2: ("contained", "ja", "p2", False), 3: ("contained", "zh-cn", "p1", False), 4: (None,) * 4, 5: ("exact", "ja", "p2", False), 6: ("contained", "ja", "p2", False)}


def test_terms_meet_texts_alike_with_and_without_broadcast(spark, monkeypatch):
    texts = [(1, None, "The world model and AI-based AI_model for training"), (1, None, "The world model and AI-based AI_model for training"), (None, "x", "用AI训练 模型 world  Model"), (3, "y", None), (4, "z", "")]
    known = [("world model", "a", 1), ("AI", "b", 2), ("模型", "c", 3), ("模", "d", 4), ("AI_model", "e", 5), ("rain", "f", 6), ("for training", "g", 7)]
    frame, words = spark.createDataFrame(texts, "doc int, part string, text string"), spark.createDataFrame(known, "source string, target string, seq int")
    one = sorted(map(tuple, terms.match_terms(frame, words, ["doc", "part"]).collect()), key=repr)
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 2)
    many = sorted(map(tuple, terms.match_terms(frame, words, ["doc", "part"]).collect()), key=repr)
    assert one == many and len([r for r in one if r[0] == 1]) == 8 and {r[2] for r in one if r[0] is None} == {"AI", "模型", "模", "world model"}
