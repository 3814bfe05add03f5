"""Lines, table cells and formula tags against plain versions."""

import hashlib
import random
import time

import numpy as np
import pytest

from bitloom.operators import layout, paragraphs
from bitloom.plans import pages

BOX = "x double, y double, x2 double, y2 double"


# --- a plain version: every pair is looked at, and frames are worked out anew from characters


def linked(items, near):
    groups, left = [], list(items)
    while left:
        group, todo = [], [left[0]]
        while todo:
            i = todo.pop()
            if i in left:
                left.remove(i)
                group.append(i)
                todo += [j for j in left if near(i, j)]
        groups.append(sorted(group, key=list(items).index))
    return groups


def frame_of(box, line):
    return [min(box[i][0] for i in line), min(box[i][1] for i in line), max(box[i][2] for i in line), max(box[i][3] for i in line)]


def mean(values, empty):
    values = [v for v in values if v > 0]
    return float(np.mean(values)) if values else empty


def plain_lines(box, vertical):
    out = []
    for flag, m in ((False, 0), (True, 1)):
        s = 1 - m
        bands = []  # the last grown last
        for i in sorted((i for i in range(len(box)) if vertical[i] == flag), key=lambda i: box[i][s]):
            best, share = None, 0.5
            for b in reversed(bands):
                low, high = min(box[k][s] for k in b), max(box[k][s + 2] for k in b)
                if high < box[i][s]:
                    break
                size = box[i][s + 2] - box[i][s]
                if size > 0 and max(0, min(high, box[i][s + 2]) - max(low, box[i][s])) / size > share:
                    best, share = b, max(0, min(high, box[i][s + 2]) - max(low, box[i][s])) / size
            if best is None:
                bands.append([i])
            else:
                bands.remove(best)
                bands.append([*best, i])
        centre = lambda i: ((box[i][0] + box[i][2]) / 2, (box[i][1] + box[i][3]) / 2)
        for band in bands:
            eps = mean([box[i][m + 2] - box[i][m] for i in band], 10) * 3.5
            for line in linked(band, lambda i, j, e=eps: abs(centre(i)[0] - centre(j)[0]) + abs(centre(i)[1] - centre(j)[1]) <= e):
                line = sorted(line, key=lambda i: box[i][m])
                tall = max(box[i][s + 2] - box[i][s] for i in line)
                if tall > 0 and len(line) > 1 and max(box[i][s + 2] for i in line) - min(box[i][s] for i in line) > 1.5 * tall:
                    out += linked(line, lambda i, j, t=tall: abs((box[i][s] + box[i][s + 2]) / 2 - (box[j][s] + box[j][s + 2]) / 2) <= 0.5 * t)
                else:
                    out.append(line)
    out.sort(key=lambda line: (-float(np.mean([(box[i][1] + box[i][3]) / 2 for i in line])), float(np.mean([(box[i][0] + box[i][2]) / 2 for i in line]))))
    area = lambda f: max(f[2] - f[0], 0) * max(f[3] - f[1], 0)
    done, dead = [], [False] * len(out)
    for i in range(len(out)):
        if dead[i]:
            continue
        limit = 1.5 * mean([box[k][3] - box[k][1] for k in out[i]], 0)
        for j in range(i + 1, len(out)):
            if dead[j]:
                continue
            a, b = frame_of(box, out[i]), frame_of(box, out[j])
            if a[1] - b[3] > limit:
                break
            inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            if area(b) > 0 and area(a) >= area(b) and inter / area(b) > 0.6:
                out[i] = out[i] + out[j]
            elif area(a) > 0 and area(b) > area(a) and inter / area(a) > 0.6:
                out[i] = out[j] + out[i]
            else:
                m = 1 if vertical[out[i][0]] else 0
                s = 1 - m
                common, gap = max(0, min(a[s + 2], b[s + 2]) - max(a[s], b[s])), max(a[m], b[m]) - min(a[m + 2], b[m + 2])
                if a[s + 2] <= a[s] or b[s + 2] <= b[s] or common / (a[s + 2] - a[s]) <= 0.7 or common / (b[s + 2] - b[s]) <= 0.7 or gap < 0 or gap >= 1.5 * mean([box[k][m + 2] - box[k][m] for k in out[i] + out[j]], 0):
                    continue
                out[i] = out[i] + out[j]
            dead[j] = True
        m = 1 if vertical[out[i][0]] else 0
        done.append(sorted(out[i], key=lambda k: box[k][m]))
    return done


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 8), (3, 80), (4, 260), (5, 120), (6, 120)])
def test_lines_equal_a_plain_version(seed, n):
    r = random.Random(seed)
    box, vertical = [], []
    for _ in range(n):
        x, y = r.uniform(0, 300), (r.uniform(0, 200) if seed % 2 else r.randint(0, 8) * 20 + r.uniform(0, 3))
        box.append((x, y, x + r.choice([0, 3, 5, 8]), y + r.choice([0, 6, 10, 14])))
        vertical.append(seed > 2 and r.random() < 0.3)
    got = layout.lines_of(np.array(box), np.array(vertical))
    assert [list(map(int, line)) for line in got] == plain_lines(box, vertical)


def test_a_page_of_lone_characters_takes_little_time():
    r = random.Random(8)
    box = np.array([(x, y, x + 4, y + 6) for x, y in ((r.randrange(590), r.randrange(790)) for _ in range(400))], dtype=float)
    flat = np.zeros(len(box), dtype=bool)
    began = time.process_time()
    got = layout.lines_of(box, flat)
    assert time.process_time() - began < 0.08  # numbers one by one: 0.02; an array for each frame: 0.2
    assert [list(map(int, line)) for line in got] == plain_lines(box.tolist(), flat)


def test_lines_of_pages(spark):
    columns = f"doc_id long, page int, char_idx int, owner long, vertical boolean, {BOX}"
    word = [(1, 0, i, 2**60 + i if i % 2 else None, False, 6.0 * i, 0.0, 6.0 * i + 5, 10.0) for i in range(4)]
    made = [*word, (1, 0, 4, None, None, 100.0, 0.0, 105.0, 10.0), (1, 0, 5, None, False, 0.0, -40.0, 5.0, -30.0), (1, 0, 6, 3, False, None, 0.0, 1.0, 1.0), (None, 0, 0, 2**60 + 1, True, 0.0, 0.0, 5.0, 5.0)]
    out = layout.cluster_lines(spark.createDataFrame(made, columns)).orderBy("doc_id", "char_idx").collect()
    assert [(r["line_idx"], r["line_pos"]) for r in out] == [(0, 0), (0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (None, None)]
    assert [r["owner"] for r in out] == [2**60 + 1, None, 2**60 + 1, None, 2**60 + 3, None, None, 3]


def test_char_lines_equal_a_plain_version(spark, data):
    chars = {}
    for r in pages._chars(spark, data).collect():
        chars.setdefault((r["doc_id"], r["page"]), []).append((r["char_idx"], (r["x"], r["y"], r["x2"], r["y2"])))
    got = {(r["doc_id"], r["page"]): (r["chars"], r["lines"], r["order_sha256"]) for r in pages.char_lines(spark, data).collect()}
    assert set(got) == set(chars)
    for key in sorted(chars)[:6]:
        rows = sorted(chars[key])
        lines = plain_lines([b for _, b in rows], [False] * len(rows))
        told = ",".join(f"{n}:{rows[i][0]}" for n, line in enumerate(lines) for i in line)
        assert got[key] == (len(rows), len(lines), hashlib.sha256(told.encode()).hexdigest())


# --- cells


def test_cells_of_tables_gather_their_rows(spark):
    columns = f"doc_id long, page int, char_idx int, char_unicode string, region_id long, class_name string, xobj_id long, vertical boolean, {BOX}"
    two = [(c, 5 if c < "n" else 6) for c in "anbocp"]  # two columns, drawn row by row
    made = [(1, 0, i, c, r, "wired_table_cell", 1, False, 0.0 + 50 * (r == 6), 100.0 - 10 * (i // 2), 5.0 + 50 * (r == 6), 108.0 - 10 * (i // 2)) for i, (c, r) in enumerate(two)]
    made += [(1, 0, 6, "x", 7, "text", 1, False, 0.0, 50.0, 5.0, 58.0), (1, 0, 7, "y", 8, "text", 1, False, 0.0, 40.0, 5.0, 48.0), (1, 0, 8, "z", 7, "text", 1, False, 6.0, 50.0, 11.0, 58.0)]
    made += [(1, 0, 9, "d", 5, "wired_table_cell", 2, False, 0.0, 70.0, 5.0, 78.0), (1, 0, 10, "e", 5, "wired_table_cell", 1, True, 0.0, 60.0, 5.0, 68.0), (1, 1, 11, "f", 5, "wired_table_cell", 1, False, 0.0, 60.0, 5.0, 68.0)]
    out = layout.group_chars(spark.createDataFrame(made, columns)).orderBy("char_idx").collect()
    assert [r["para_idx"] for r in out] == [0, 1, 0, 1, 0, 1, 6, 7, 8, 9, 10, 0]
    plain = layout.group_chars(spark.createDataFrame(made, columns).drop("class_name")).orderBy("char_idx").collect()
    assert [r["para_idx"] for r in plain][:9] == list(range(9))


# --- formula tags


def plain_tags(rows, pattern_start, small=0.79, large=1.1):
    """The walk over one line's (text, size, sure) with a bullet flag that lasts."""
    formula = script = listed = False
    out = []
    for i, (c, size, sure) in enumerate(rows):
        listed = listed or (i == 0 and bool(c) and c[0] in layout.BULLETS)
        space, behind = bool(c) and c.isspace(), i > 0 and bool(rows[i - 1][0]) and rows[i - 1][0].isspace()
        able = not space and not behind and not listed
        if i:
            now = able and size < rows[i - 1][1] * (large if script else small)
        else:
            now = able and len(rows) > 1 and size < rows[1][1] * small
        hit = sure or pattern_start(c) or (formula and c is None) or (formula and c is not None and c.startswith(",")) or now
        formula, script = (formula if c == " " else hit), now
        out.append((formula, script))
    return out


def test_tags_equal_a_plain_walk(spark):
    r = random.Random(3)
    lines = [[(r.choice(["a", "b", " ", ",", "2", "=", "α", "•", None, "\t", "́", "(cid:7)", "é"]), r.choice([10.0, 10.0, 7.0, 7.5, 6.0, 12.0]), r.random() < 0.15) for _ in range(r.randint(1, 14))] for _ in range(150)]
    made = [(1, 0, n, i, c, s, f, 0.0, 0.0, 1.0, 1.0) for n, line in enumerate(lines) for i, (c, s, f) in enumerate(line)]
    frame = spark.createDataFrame(made, f"doc_id long, page int, line_idx int, char_idx int, char_unicode string, font_size double, formula_font boolean, {BOX}")
    got = {(x["line_idx"], x["char_idx"]): (x["is_formula"], x["is_script"]) for x in layout.tag_formula_chars(frame).collect()}
    start = lambda c: bool(c) and (c in "2=α•́" or "(cid:" in c)
    for n, line in enumerate(lines):
        assert [got[n, i] for i in range(len(line))] == plain_tags(line, start), line


def test_tags_by_object_fonts_paragraphs_and_boxes(spark):
    columns = f"doc_id long, page int, para_idx int, line_idx int, char_idx int, char_unicode string, font_size double, xobj_id long, font_id string, formula_region_id long, vertical boolean, in_font boolean, vx double, vy double, vx2 double, vy2 double, {BOX}"
    seen, box = (0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0)
    row = lambda para, line, i, c, size=10.0, obj=None, font="T", region=None, up=False, known=True, v=seen: (1, 0, para, line, i, c, size, obj, font, region, up, known, *v, *box)
    made = [
        row(0, 0, 0, "a"), row(0, 0, 1, "b", font="M"), row(0, 0, 2, "c", obj=5, font="M"), row(0, 0, 3, "d", obj=5, font="N"), row(0, 0, 4, "e", obj=6, font="M"), row(0, 0, 5, "f", region=3), row(0, 0, 6, "g", up=True), row(0, 0, 7, "h", known=False),
        row(0, 0, 8, "i", v=(5.0, 0.0, 6.0, 1.0)), row(0, 0, 9, "j"), row(0, 0, 10, "2", 6.0), row(0, 0, 11, "k", 6.5), row(0, 0, 12, "l", 9.0),
        row(1, 0, 0, "•"), row(1, 0, 1, "x"), row(1, 0, 2, "n", 6.0), row(1, 1, 3, "y"), row(1, 1, 4, "m", 6.0), row(2, 0, 0, "s", 6.0), row(2, 0, 1, "z"), row(2, 0, 2, "t", 6.0),
    ]
    fonts = layout.formula_fonts(spark.createDataFrame([(1, 0, None, "M", "CMMI"), (1, 0, None, "T", "Text"), (1, 0, 5, "M", "Text"), (1, 0, 5, "N", "CMSY")], "doc_id long, page int, xobj_id long, font_id string, name string"), "^CM")
    out = layout.tag_formula_chars(spark.createDataFrame(made, columns), fonts).orderBy("para_idx", "line_idx", "char_idx").collect()
    assert "".join(r["char_unicode"] for r in out if r["is_formula"]) == "bdefghi2k•st"
    assert "".join(r["char_unicode"] for r in out if r["is_script"]) == "2kst"


def test_other_columns_pass_unchanged(spark):
    wide, schema = 2**60 + 1, f"doc_id long, page int, para_idx int, part_idx int, line_id int, region_id long, size int, {BOX}"
    made = [(1, 0, 0, 0, 1, wide, 5, 0.0, 0.0, 10.0, 10.0), (1, 0, 0, 1, 1, None, None, 50.0, 0.0, 60.0, 10.0), (1, 0, 0, 2, 1, wide + 2, 7, 90.0, 0.0, 99.0, 10.0), (1, 0, 0, 3, 1, wide + 4, 1, 200.0, 0.0, 210.0, 10.0), (None, 0, 0, 0, 1, wide, 2, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(made, schema)
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    for out in (paragraphs.batch_by_budget(df, ["doc_id", "page"], "part_idx", "size"), layout.resolve_overlap(df, "part_idx"), layout.merge_formulas(df), layout.cluster_lines(df.withColumnRenamed("part_idx", "char_idx")).withColumnRenamed("char_idx", "part_idx")):
        assert key(out.select("doc_id", "part_idx", "region_id", "size").collect()) == key([(m[0], m[3], m[5], m[6]) for m in made])
    assert [r["group"] for r in layout.merge_formulas(df).where("doc_id = 1").orderBy("part_idx").collect()] == [0, 1, 2, 3]


def test_texts_are_located_once_whatever_asks(spark):
    line = lambda i, c: (i % 4 * 10.0, 100.0 - 12 * (i // 4), i % 4 * 10.0 + 9, 108.0 - 12 * (i // 4))
    glyphs = [(1, 0, i, c, *line(i, c)) for i, c in enumerate(["ﬁ", "B", " ", "-", "c", None, "-", "d", "E", "f", "İ", "x"])] + [(None, 0, 0, "a", *line(0, "a"))]
    needles = [(1, 1, 0, "fib"), (2, 1, 0, "ﬁ b-c"), (3, 1, 0, "bc"), (4, 1, 0, "de f"), (5, 1, 0, ""), (6, 1, 0, None), (7, 1, 0, "-"), (8, 1, 0, "c-d"), (9, 2, 0, "b"), (10, 1, 0, "i̇X"), (11, 1, 0, "bcd")]
    out = layout.locate_text(spark.createDataFrame(glyphs, f"doc_id long, page int, glyph_idx int, char string, {BOX}"), spark.createDataFrame(needles, "needle_id long, doc_id long, page int, text string"))
    got = {}
    for r in out.orderBy("needle_id", "line").collect():
        got.setdefault(r["needle_id"], []).append((r["x"], r["y"], r["x2"], r["y2"]))
    top, middle, low = (0.0, 100.0, 19.0, 108.0), (0.0, 88.0, 9.0, 96.0), (0.0, 76.0, 19.0, 84.0)
    assert got == {2: [(0.0, 100.0, 39.0, 108.0), middle], 3: [(10.0, 100.0, 19.0, 108.0), middle], 4: [(30.0, 88.0, 39.0, 96.0), low], 7: [(20.0, 88.0, 29.0, 96.0)], 8: [(0.0, 88.0, 39.0, 96.0)], 10: [(20.0, 76.0, 39.0, 84.0)]} and top


def test_formula_regions_are_compiled(spark, data):
    plan = pages.formula_region(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(line) for line in plan.splitlines() if "Filter" in line) < 1500  # no comparison of boxes in each filter
