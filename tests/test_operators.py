"""Operators on small cases with known answers."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from bitloom.functions import text as T
from bitloom.operators import evaluate, evidence, layout, ledger, memory, model_steps, paragraphs, terms
from bitloom.plans import language


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_match_terms(spark):
    texts = ["training", "retail", "AI_model", "AI2", "(AI)", "ai-based", "用AI训练", "<style id='1'>AI</style>", "这个模型很好", "deep learning models", "deep  learning.", "α+β", "c++ code", "x\\E y", "x\\Ey"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    spec = spark.createDataFrame([("AI",), ("模型",), ("Deep Learning",), ("α+β",), ("C++",), ("\\E",), ("好",)], "source string")
    got = {}
    for i, s in sorted(rows(terms.match_terms(frame, spec, ["i"]), "i", "source")):
        got.setdefault(s, []).append(i)
    assert got == {"AI": [4, 5, 6, 7], "模型": [8], "Deep Learning": [9, 10], "α+β": [11], "C++": [12], "\\E": [13], "好": [8]}


def test_match_terms_equals_brute_force(spark):
    import regex

    r = random.Random(5)
    word = lambda: "".join(r.choice("ab1_中é-") for _ in range(r.randint(1, 3)))
    texts = [" ".join(word() for _ in range(r.randint(1, 8))) for _ in range(120)]
    spec = sorted({" ".join(word() for _ in range(r.choice((1, 1, 2)))) for _ in range(40)})

    def hit(term, text):
        w = r"[\p{Latin}\p{N}_]"
        a = f"(?<!{w})" if regex.match(w, term[0]) else ""
        b = f"(?!{w})" if regex.match(w, term[-1]) else ""
        return regex.search(a + regex.escape(term) + b, text, regex.I) is not None

    got = rows(terms.match_terms(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), spark.createDataFrame([(s,) for s in spec], "source string"), ["i"]), "i", "source")
    assert got == sorted(((i, s) for i, t in enumerate(texts) for s in spec if hit(s, t)), key=repr)


def test_term_tables(spark):
    t = spark.createDataFrame([("World Model", "世界模型", "", 1), ("world  model", "世界模型", "zh_CN", 2), ("model", "模型", "zh-cn", 3), ("model", "modèle", "fr", 4), ("Model", "其他", "", 5)], "source string, target string, tgt_lng string, seq long")
    assert [r["target"] for r in terms.order_terms(terms.terms_for_language(t, "zh-CN")).collect()] == ["世界模型", "模型"]
    c = spark.createDataFrame([("World  Model", "a", "zh_CN", 1), ("world model", "b", "zh-cn", 2), ("x", "y", "", 3), ("x", "y", "", 4)], t.schema)
    assert rows(terms.term_conflicts(c)) == [("world model", "zh-cn", ["a", "b"], [1, 2])]
    auto = spark.createDataFrame([("world model", "z"), ("training", "w")], "source string, target string")
    assert rows(terms.merge_term_sources(c.limit(1).select("source", "target"), auto), "source") == [("World  Model",), ("training",)]
    votes = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 3), ("a", "x", 4), ("b", "q", 5)], "source string, target string, seq long")
    assert rows(terms.vote_targets(votes)) == [("a", "x", 2), ("b", "q", 1)]


MEMORY = "doc_fingerprint string, target_lang string, page int, paragraph_id string, source string, translation string, reading string, status string, quality string, seq long"


def test_memory_tiers_and_upsert(spark):
    base = ("d", "zh_CN", 2, "p1", "We study efﬁcient phy­sical devices.", "<style id='1'>A</style>B {v1}", None, "succeeded", None, 1)
    batch = spark.createDataFrame([base, (*base[:2], 9, *base[3:9], 2), (*base[:7], "failed", None, 3), (*base[:7], "succeeded", "failed", 4), (*base[:4], " ", *base[5:9], 5)], MEMORY)
    table = memory.upsert_memory(None, batch)
    assert rows(table, "page", "translation", "formatting_incomplete") == [(2, f"AB {T.LAYOUT_MARK}", True), (9, f"AB {T.LAYOUT_MARK}", True)]
    again = memory.upsert_memory(table, spark.createDataFrame([(*base[:6], "甲乙", *base[7:9], 9)], MEMORY))
    assert rows(again, "page", "translation", "formatting_incomplete") == [(2, "甲乙", False), (9, f"AB {T.LAYOUT_MARK}", True)]
    assert rows(memory.upsert_memory(again, spark.createDataFrame([(*base[:6], "甲乙", *base[7:9], 9)], MEMORY))) == rows(again)
    q = spark.createDataFrame([(1, "d", "We study efficient  physical devices.", 9), (2, "d", "physical devices", 2), (3, "e", "physical devices", 2), (4, "d", "%", 2), (5, "d", "We study efficient physical devices.", None), (6, "d", "", 2)], "query_id long, doc_fingerprint string, text string, page int")
    got = {r["query_id"]: (r["match_type"], r["match_page"]) for r in memory.lookup_memory(q, again).collect()}
    assert got == {1: ("exact", 9), 2: ("contained", 2), 3: (None, None), 4: (None, None), 5: ("exact", 9), 6: (None, None)}


def test_import_new_equals_one_pass(spark):
    r = random.Random(6)
    old = [(f"i{r.randint(0, 30)}", r.randint(0, 30)) for _ in range(8)]
    new = [(f"i{r.randint(0, 30)}", r.randint(0, 30), n) for n in range(60)]
    names, ids, want = {i for i, _ in old}, {k for _, k in old}, []
    for i, k, n in new:
        ok = i not in names and k not in ids
        if ok:
            names.add(i)
            ids.add(k)
        want.append((n, "added" if ok else "conflict"))
    got = memory.import_new(spark.createDataFrame(old, "identity string, id long"), spark.createDataFrame(new, "identity string, id long, seq long"))
    assert rows(got, "seq", "status") == sorted(want, key=repr)


def test_resolve_selection(spark):
    q = spark.createDataFrame([(1, "Term", "k0", 100, "paragraph", []), (2, "a", "k1", 100, "none", []), (3, "a", "k1", 9000, "none", []), (4, "mem", "k2", 0, "exact", ["甲"]), (5, "mem", "k2", 0, "exact", ["乙"]), (6, "mem", "k2", 0, "none", [])], "request_id int, text string, cache_key string, at long, policy string, required_terms array<string>")
    got = memory.resolve_selection(q, spark.createDataFrame([("term", "词")], "source string, target string"), spark.createDataFrame([("k1", "r", 50)], "cache_key string, response string, created long"), spark.createDataFrame([("mem", "甲文", 1)], "normalized_source string, translation string, seq long"))
    assert rows(got, "request_id", "answered_by", "answer") == [(1, "glossary", "词"), (2, "cache", "r"), (3, "saved", "r"), (4, "memory", "甲文"), (5, "generate", None), (6, "generate", None)]


def test_reference_flags(spark):
    entry = "[1] A. Author, Title, 2019."
    pages = [
        (0, "Introduction", "title"), (0, "We cite 2019 work.", "text"), (3, "7 References", "paragraph_title"), (3, entry, "text"), (3, entry, "text"), (3, "continued line", "text"), (4, "References", "header"), (4, entry, "text"),
        (4, "Acknowledgments", "text"), (4, "We thank all.", "text"), (4, entry, "text"),
    ]
    df = spark.createDataFrame([(1, p, i, t, lab, 5) for i, (p, t, lab) in enumerate(pages)], "doc_id long, page int, para_idx int, text string, label string, pages int")
    got = [r["is_reference"] for r in paragraphs.reference_flags(df).orderBy("para_idx").collect()]
    assert got == [False, False, True, True, True, True, True, True, False, False, False]
    early = df.withColumn("page", F.lit(0))
    assert not any(r["is_reference"] for r in paragraphs.reference_flags(early).collect())


def test_continuations_and_words(spark):
    schema = "doc_id long, page int, para_idx int, text string, label string, x double, x2 double, y2 double"
    df = spark.createDataFrame([(1, 1, 0, "It ends with the", "text", 0.0, 90.0, 50.0), (1, 1, 1, "12", "page_number", 0.0, 9.0, 9.0), (1, 2, 2, "core idea. Full stop.", "text", 0.0, 90.0, 700.0), (1, 3, 3, "new start here", "text", 0.0, 90.0, 700.0), (1, 3, 4, "Column two", "text", 100.0, 190.0, 700.0)], schema)
    got = [(r["para_idx"], r["continues"], r["continuation_group"]) for r in paragraphs.continuation_groups(df).orderBy("para_idx").collect()]
    assert got == [(0, False, 0), (1, False, None), (2, True, 0), (3, False, None), (4, False, None)]
    words = spark.createDataFrame([(1, 0, "complex scenar-\nios and un-\nknown <a-\nb>", "x"), (1, 1, "scenarios are so­ft", "x")], "doc_id long, para_idx int, text string, label string")
    assert [r["text"] for r in paragraphs.body_words_normalized(words).orderBy("para_idx").collect()] == ["complex scenarios and un-\nknown <a-\nb>", "scenarios are soft"]


def test_batches_and_boundaries(spark):
    df = spark.createDataFrame([(1, 0, i, s) for i, s in enumerate([150, 60, 10, 10, 10, 10, 10, 10, 300])], "doc_id long, page int, i int, size int")
    assert [r["batch"] for r in paragraphs.batch_by_budget(df, ["doc_id", "page"], "i", "size").orderBy("i").collect()] == [0, 0, 1, 1, 1, 1, 1, 1, 2]
    assert df.columns == ["doc_id", "page", "i", "size"]
    b = spark.createDataFrame([(1, 0, 0, 10.0, "text"), (1, 0, 1, 50.0, "text"), (1, 1, 2, 10.0, "text"), (1, 1, 3, 60.0, "text"), (1, 1, 4, 0.0, "title")], "doc_id long, page int, para_idx int, y2 double, label string")
    assert rows(paragraphs.boundary_pairs(b)) == [(1, 1, 2, "page")]


def test_align_sentences(spark):
    s = spark.createDataFrame([(1, "The encoder reads. See Fig. 2 now. It took 3.5 days.", "编码器读取。见图 2。用了 3.5 天。", [("encoder", "编码器")]), (2, "AI is AI. AI.", "人工智能。智能。", [("AI", "智能")]), (3, "A x. B y.", "乙 y。甲 x。", [("x", "x"), ("y", "y")])], "pair_id long, source string, translation string, terms array<struct<source:string,target:string>>")
    got = rows(paragraphs.align_sentences(s))
    assert [g for g in got if g[0] == 1] == [(1, 0, 0), (1, 1, 1), (1, 2, 2)] and not [g for g in got if g[0] == 3]


def test_small_documents_are_looked_up_without_runs(spark, monkeypatch):
    stored = [("d", "fr", 0, f"p{i}", f"words of {i} here", "x", None, "succeeded", None, i) for i in range(6)]
    table = memory.upsert_memory(None, spark.createDataFrame(stored, "doc_fingerprint string, target_lang string, page int, paragraph_id string, source string, translation string, reading string, status string, quality string, seq long"))
    asked = spark.createDataFrame([(1, "d", "of 3", 0), (2, "d", "here", 0), (3, "d", "none", 0), (4, "e", "of", 0), (5, "d", "of 2 here", 0)], "query_id int, doc_fingerprint string, text string, page int")
    told = lambda: rows(memory.lookup_memory(asked, table), "query_id", "match_type", "memory_seq")
    monkeypatch.setattr(memory, "DIRECT_PAIRS", 0)
    by_runs = told()
    monkeypatch.undo()
    monkeypatch.setattr(memory, "_by_runs", None)
    assert told() == by_runs and [r[2] for r in by_runs] == [3, 5, None, None, 2]


def test_small_groups_cost_no_call_each(spark):
    b = spark.createDataFrame([(d, p, p * 2 + k, 30.0 * k, "text") for d in (1, 2, None) for p in (0, 1, 3) for k in (0, 1)], "doc_id long, page int, para_idx int, y2 double, label string")
    pairs, batches = paragraphs.boundary_pairs(b), paragraphs.batch_by_budget(b.withColumn("size", F.lit(150)), ["doc_id", "page"], "para_idx", "size")
    for out in (pairs, batches):
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(pairs, "left_idx", "right_idx", "kind") == sorted([(1, 2, "page"), (6, 7, "column")] * 3)
    assert {r["batch"] for r in batches.collect()} == {0} and batches.count() == 18


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(25)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 30))) for _ in range(60)]
    texts += [t[3:-2] for t in texts[:20] if len(t) > 8] + [t + " extra" for t in texts[20:40]] + ["ab", "b w1"]
    texts = list(dict.fromkeys(t for t in (" ".join(t.lower().split()) for t in texts) if t))

    def grams(t):
        w = t.split(" ")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = []
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            a, b = texts[i], texts[j]
            m = min(len(grams(a)), len(grams(b)))
            if min(len(a), len(b)) >= 3 and (a in b or b in a) or m and len(grams(a) & grams(b)) / m >= 0.8:
                want.append((i, j))
    got = evaluate.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows(got, "left_id", "right_id") == sorted(want, key=repr)


def test_short_texts_are_found_inside_others(spark, tmp_path):
    texts = ["a", "ab", "xaby", "好", "很好 的", "b c", "one two three four five six seven ab"]
    want = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] in texts[j] or texts[j] in texts[i]]
    got = evaluate.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shortest=1)
    assert rows(got, "left_id", "right_id") == sorted(want, key=repr) and (1, 2) in want and (3, 4) in want
    docs = ["the cat sat on mats daily", "bathe cat sat on mat", "x y", None]
    items = ["cat sat on mat", "cat", "y", "e cat sat on mat", "absent", ""]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(i, n) for i, q in enumerate(items) if q and (n := sum(q in (t or "") for t in docs))]
    assert rows(language.memory_contained(spark, str(tmp_path)), "item_id", "documents") == want and len(want) == 4


def test_only_documents_that_may_overlap_the_benchmark_are_folded_and_paired(spark, tmp_path, monkeypatch):
    from bitloom.plans import evaluation

    r = random.Random(11)
    text = lambda n: " ".join(r.choice("abcdefghij") + str(r.randint(0, 400)) for _ in range(n))
    long, six, four, three = text(30), text(6), text(4), text(3)
    apart = [text(40) for _ in range(300)]
    near = [long.upper(), f"x {long} y", long.replace(" ", " \t "), long[2:-2], f"{text(9)} z{six}z {text(9)}", f"{text(9)} z{four}z", f"z{three}z {text(12)}", " ".join(long.split()[4:8])]
    docs = [*apart, *near, None, "", *near]

    def grams(t):
        w = t.split(" ")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    normal = lambda t: " ".join((t or "").lower().split())
    first = {t: i for i, t in reversed([(i, normal(t)) for i, t in enumerate(docs)]) if t}
    seen = []
    classes = evaluate.text_classes
    monkeypatch.setattr(evaluate, "text_classes", lambda df: seen.append(df.count()) or classes(df))
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for n, (items, some) in enumerate([([long, six, four, three, ""], True), ([long, long[3:-3]], True), ([six], True), ([three, "q"], False), ([text(20)], True)]):
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/{n}/benchmark.parquet")
        os.symlink(f"{tmp_path}/documents.parquet", f"{tmp_path}/{n}/documents.parquet")
        want = []
        for t, i in first.items():
            for j, u in enumerate(items):
                m = min(len(grams(t)), len(grams(u)))
                if u and (t in u or u in t or m and len(grams(t) & grams(u)) / m >= 0.8):
                    want.append((i, j))
        assert rows(evaluation.leakage_pairs(spark, f"{tmp_path}/{n}"), "left_id", "right_id") == sorted(want, key=repr)
        assert bool(want) == (n < 4) and (seen[-1] <= 2 * len(near) + 2) == some  # items of one word may be in any text


def test_short_texts_of_common_words_do_not_meet_all_texts_that_have_them(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    short = [f"w{c} the of v" for c in letters] + [f"w{c} the v" for c in letters]
    texts = short + [f"some more x{t}z here" for t in short]
    data = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "side int, id int, t string")
    found = {(r["i1"], r["i2"]) for r in evaluate.inside_candidates(data.where(f"id < {len(short)}"), data).collect()}
    assert {(i, j) for i in range(len(short)) for j in range(len(texts)) if texts[i] in texts[j]} <= found and len(found) < 3 * len(short)


def test_two_words_are_not_met_on_one_of_them(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    short = [f"{c} therefore" for c in letters] + [f"therefore {c}" for c in letters]
    texts = short + [f"more x{t}z therefore here" for t in short]
    data = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "side int, id int, t string")
    found = {(r["i1"], r["i2"]) for r in evaluate.inside_candidates(data.where(f"id < {len(short)}"), data).collect()}
    assert {(i, j) for i in range(len(short)) for j in range(len(texts)) if texts[i] in texts[j]} <= found and len(found) < 5 * len(short)


def test_near_duplicates_by_a_part_of_the_shingles_write_no_texts(spark, monkeypatch):
    r = random.Random(5)
    common = " ".join(f"c{i}" for i in range(60))
    text = lambda n: " ".join(r.choice("abcdefghij") + str(r.randint(0, 400)) for _ in range(n))
    texts = []
    for n in (80, 120, 200, 300, 420, 700):
        words = text(n).split()
        texts.append(" ".join(words))
        for share in (0.02, 0.035, 0.04, 0.045, 0.06):  # about 0.8 of the shingles are left
            texts.append(" ".join("new" + str(r.randint(0, 10**6)) if r.random() < share else w for w in words))
        texts += [f"{text(90)} {' '.join(words)[1:-1]}\u3000\u2009{text(40)}", f"{text(n)} {common} {text(n)}", f"{common} {text(3)}"]
    texts += [text(100) for _ in range(100)]

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets, want = [grams(t) for t in texts], []
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            a, b, shared = " ".join(texts[i].split()), " ".join(texts[j].split()), len(sets[i] & sets[j])
            least = min(len(sets[i]), len(sets[j]))
            if a in b or b in a or shared / least >= 0.8:
                want.append((i, j, shared, shared / least, a in b or b in a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut, written = evaluate.cut, []
    monkeypatch.setattr(evaluate, "cut", lambda df: written.append((df.columns, out := cut(df))) or out)
    for whole in (64, 0):
        monkeypatch.setattr(evaluate, "WHOLE", whole, raising=False)
        monkeypatch.setattr(evaluate, "BLOCK_PAIRS", 3, raising=False)
        got = evaluate.near_duplicates(docs, shortest=1)
        assert rows(got, "left_id", "right_id", "shared", "similarity", "contains") == sorted(want, key=repr) and len(want) > 20
    assert all(out.count() < 5 for columns, out in written if "t" in columns)
    most = max(out.count() for columns, out in written)
    assert most < 0.5 * sum(map(len, sets))


def test_words_of_bytes_are_those_of_the_text(spark):
    from bitloom.functions import runs
    from bitloom.functions import text as T

    marks = "".join(map(chr, [*range(33), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0xE0, 0x1F600]))
    texts = ["", " ", "好 x y", f"a{marks}b", *(f"{c}x{c}{c}é y{c}" for c in marks), "x" * 3000 + " y", " ".join(["long"] * 3000)]
    plain = [r["t"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.squeeze("t").alias("t")).collect()]
    words = runs.Words([t.encode() for t in texts])
    assert np.diff(words.bounds).tolist() == [len(t.split(" ")) if t else 0 for t in plain]
    again = runs.Words([t.encode() for t in plain])
    for k in (1, 3, 5):
        assert (words.runs(k) == again.runs(k)).all() and len(set(words.runs(1).tolist())) == len({w for t in plain for w in t.split(" ") if w})
    keys = spark.createDataFrame([(int(k),) for k in runs.key_of(words.runs(1))], "key long")
    kept = runs.filter_of(keys, 100_000)
    may = runs.Filter(kept.value)
    others = runs.key_of(runs.mix(np.arange(10_000, dtype=np.uint64)))
    assert len(kept.value) == 32 and may(runs.key_of(again.runs(1))).all() and may(others).mean() < 0.05


def test_reviews(spark):
    names = list(evaluate.WEIGHTS)
    error = "array<struct<dimension:string,source_quote:string,target_quote:string,category:string>>"
    packet = spark.createDataFrame([(i, "source text", "target words") for i in range(1, 6)], "item_id int, source string, translation string")
    full = dict.fromkeys(names, 4)
    verdicts = spark.createDataFrame([(1, full, []), (2, {**full, names[0]: 2}, []), (3, {**full, names[0]: 2}, [(names[0], "absent", "", "omission")]), (4, {names[0]: 9}, []), (9, full, []), (5, {**full, names[0]: 3}, [(names[0], "source", "", "omission")])], f"item_id int, scores map<string,int>, errors {error}")
    got = dict(rows(evaluate.validate_reviews(packet, verdicts)))
    assert got == {1: [], 2: ["deduction_without_evidence"], 3: ["source_quote_absent"], 4: ["incomplete_scores"], 5: [], 9: ["unknown_item"]}


def test_bootstrap_covers_the_mean(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(f"c{i % 20}", f"s{i % 2}", r.gauss(1, 1)) for i in range(400)], "c string, s string, d double")
    one = evaluate.cluster_bootstrap(df, "c", "s", "d", reps=300).first()
    assert one["low"] < one["mean_delta"] < one["high"] and one["high"] - one["low"] < 1
    again = evaluate.cluster_bootstrap(df.repartition(3), "c", "s", "d", reps=300).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(again, one, strict=True))


def test_merge_metrics_and_usage(spark):
    schema = "k int, attempts long, succeeded long, failed long, input long, output long, errors map<string,long>, samples array<double>, p95 double, rate double, active long"
    a = spark.createDataFrame([(1, 2, 1, 1, None, 5, {"x": 1}, [1.0], 9.0, 999.0, 4)], schema)
    b = spark.createDataFrame([(1, 3, 3, 0, 7, None, {"x": 2, "y": 1}, [2.0, 3.0], 5.0, 12.3, 1), (2, 1, 1, 0, None, None, {}, [], 4.0, None, 0)], schema)
    got = {r["k"]: r for r in ledger.merge_metrics(a, b, ["k"], samples=2).collect()}
    assert (got[1]["attempts"], got[1]["input"], got[1]["output"], got[1]["errors"], got[1]["samples"], got[1]["p95"], got[1]["rate"]) == (5, 7, 5, {"x": 3, "y": 1}, [2.0, 3.0], None, 12.3)
    assert got[2]["p95"] == 4.0 and got[2]["input"] is None
    u = spark.createDataFrame([('{"prompt_tokens": 5, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 1}}',), ('{"input_tokens": 3}',), ("{}",)], "usage string")
    assert rows(ledger.normalize_usage(u), "input", "output", "cached", "usage_availability") == [(3, None, None, "partial"), (5, 2, 1, "complete"), (None, None, None, "unavailable")]


def test_layout(spark):
    c = "doc_id long, page int, char_idx int, char_unicode string, x double, y double, x2 double, y2 double"
    word = [(1, 0, i, ch, 10.0 * i + (8 if i > 2 else 0), 0.0, 10.0 * i + 9 + (8 if i > 2 else 0), 10.0) for i, ch in enumerate("catdog")]
    df = spark.createDataFrame(word + [(1, 0, 6, "x", 0.0, -30.0, 9.0, -20.0)], c)
    assert layout.text_from_chars(df, ["doc_id", "page"]).first()["text"] == "cat dog x"
    assert [r["line_idx"] for r in layout.split_lines(df, ["doc_id", "page"]).orderBy("char_idx").collect()] == [0] * 6 + [1]
    assert [r["line_idx"] for r in layout.cluster_lines(df).orderBy("char_idx").collect()] == [0] * 6 + [1]
    p = spark.createDataFrame([(1, 0, 0, "left text", 5, 1), (1, 0, 1, " 12 ", 5, 1), (1, 0, 2, "goes on", 5, 1), (1, 0, 3, "13", 5, 1), (1, 0, 4, "other", 6, 1)], "doc_id long, page int, para_idx int, text string, region_id int, xobj_id int")
    assert rows(layout.merge_line_numbers(p), "para_idx", "text") == [(0, "left text goes on"), (3, "13"), (4, "other")]
    o = spark.createDataFrame([(1, 0, 0, 0.0, 50.0, 100.0, 100.0), (1, 0, 1, 0.0, 10.0, 100.0, 60.0)], "doc_id long, page int, para_idx int, x double, y double, x2 double, y2 double")
    assert rows(layout.resolve_overlap(o), "para_idx", "y", "y2") == [(0, 56.0, 100.0), (1, 10.0, 54.0)]
    f = spark.createDataFrame([(1, i, ch) for i, ch in enumerate("f(a,b),c=1")], "g long, char_idx int, char_unicode string")
    assert [r["part"] for r in layout.split_formula(f, ["g"]).orderBy("char_idx").collect()] == [0] * 7 + [1] * 3
    s = spark.createDataFrame([(1, i, ch, st, False) for i, (ch, st) in enumerate(zip("ab c d", "xxxxyy", strict=True))], "g long, char_idx int, char_unicode string, style string, is_formula boolean")
    assert [r["text"].strip() for r in layout.style_runs(s, ["g"]).orderBy("run").collect() if r["text"].strip()] == ["ab c", "d"]


def test_evidence(spark):
    req = spark.createDataFrame([("t", 1, "c1", 1, ["p1", "p2"], True), ("t", 1, "c2", 2, ["p1"], True), ("t", 1, "c3", 3, ["p3"], False)], "task_id string, attempt int, call_id string, seq long, paragraph_refs array<string>, failed boolean")
    failed = spark.createDataFrame([("t", 1, "p1")], "task_id string, attempt int, paragraph_ref string")
    assert rows(evidence.link_failures(failed, req, 1), "paragraph_ref", "synthesized", "call_ids", "omitted") == [("p1", False, ["c2"], 1), ("p2", True, ["c1"], 0)]


P = "doc_id long, page int, row_id long, source string"


def test_translate_batches(spark):
    src = [(1, 0, 0, "some plain prose here"), (1, 0, 1, "again {v1} more plain words"), (1, 0, 2, "12.555"), (1, 0, 3, "this one always fails badly"), (1, 1, 4, "kept in the cache already")]
    df = spark.createDataFrame(src, P)

    def fn(batch):
        return [None if "always" in s else "译" + s.replace("{v1}", "" if len(batch) > 1 else "{ V1 }") for s in batch]

    cache = df.where("row_id = 4").select(F.sha2("source", 256).alias("source_hash"), F.lit("旧").alias("output"))
    got = {r["row_id"]: (r["status"], r["code"], r["output"], r["from_cache"]) for r in model_steps.translate_batches(df, fn, cache, "zh").collect()}
    assert got == {0: ("succeeded", None, "译some plain prose here", False), 1: ("succeeded", None, "译again {v1} more plain words", False), 2: ("skipped", "numeric_or_formula", None, False), 3: ("failed", "empty_translation", None, False), 4: ("succeeded", None, "旧", True)}


def test_extract_terms_and_slots(spark):
    df = spark.createDataFrame([(1, 0, i, f"text number {i} about the model") for i in range(4)], P)
    reply = '```json\n[{"src": "model", "tgt": "模型"}, {"src": "ab", "tgt": "ab"}]\n```'
    assert rows(model_steps.extract_terms(df, lambda b: reply)) == [("model", "模型", 1)]
    assert model_steps.extract_terms(df, lambda b: '[{"src": "a"}]').count() == 0
    one = spark.createDataFrame([(1, "see {v1} and <style id='2'>this</style>, ")], "row_id long, source string")
    slots = model_steps.repair_slots(one)
    todo = [(r["row_id"], r["slot"], r["piece"].upper()) for r in slots.where("not is_token").collect()]
    assert rows(model_steps.join_slots(slots, spark.createDataFrame(todo, "row_id long, slot int, output string"))) == [(1, "SEE {v1} AND <style id='2'>THIS</style>, ", None)]
    assert rows(model_steps.join_slots(slots, spark.createDataFrame(todo[:1], "row_id long, slot int, output string")), "code") == [("slot_mismatch",)]


def test_review_selection(spark):
    c = spark.createDataFrame([(1, i, "text", 1 + i % 2, None, "source words are here", "译文") for i in range(25)] + [(1, 99, "title", 4, None, "t", "t")], "doc_id long, row_id long, label string, priority int, continuation_group long, source string, output string")
    got = model_steps.select_for_review(c)
    assert got.where("selected").count() == 20 and got.count() == 25 and got.agg(F.max("review_batch")).first()[0] == 4
    reviewed = model_steps.review_batches(c, lambda rows_: "[" + ",".join(f'{{"id": {r["id"]}, "verdict": "passed"}}' for r in rows_) + "]")
    assert dict(rows(reviewed.groupBy("review").count())) == {"passed": 20, "not_selected": 5}
    bad = model_steps.review_batches(c, lambda rows_: '[{"id": true, "verdict": "passed"}]')
    assert dict(rows(bad.groupBy("review").count())) == {"unchecked": 20, "not_selected": 5}
    wrong = model_steps.review_batches(c, lambda rows_: "[" + ",".join(f'{{"id": {r["id"]}, "verdict": "corrected", "evidence": "words", "output": "{{v9}}"}}' for r in rows_) + "]")
    assert wrong.where("review = 'failed' and output is null").count() == 20


def test_trim_and_inspect(spark):
    s = spark.createDataFrame([(1, 0, "first plain prose text"), (1, 1, "second plain prose text"), (1, 2, "third")], "batch_id int, row_id int, source string")
    r = spark.createDataFrame([(1, '<think>x</think>```json\n[{"id": 0, "output": "甲"}, {"id": 1, "output": "乙"}, {"id": 1, "output": "丙"}, {"id": 7, "output": "z"}]\n```')], "batch_id int, reply string")
    assert rows(model_steps.inspect_batch(r, s, "zh"), "row_id", "output", "code") == [(0, "甲", None), (1, None, "invalid_or_duplicate_paragraph_id"), (2, None, "paragraph_count_mismatch")]
