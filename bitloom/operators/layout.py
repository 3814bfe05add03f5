"""Characters, regions and boxes on pages: spatial joins, lines, paragraphs, formulas.

Boxes are columns x, y, x2, y2. A page bounds every group that goes to one task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import geometry as G
from bitloom.functions import text as T
from bitloom.functions.groups import add_by_group, components

PAGE = ["doc_id", "page"]
# Fixed value: the class of regions that are cells of tables with lines.
CELL_CLASS = "wired_table_cell"
CELL = 100.0


def _box(prefix: str = "") -> Column:
    return G.box(*(F.col(f"{prefix}{c}") for c in ("x", "y", "x2", "y2")))


def _gridded(df: DataFrame, by: float = 0.0, cell: float = CELL) -> DataFrame:
    # outer: explode() filters what it takes apart first, for which cells, and all that the box follows from, would be worked out twice
    return df.withColumn("__c", F.explode_outer(G.cells(G.expanded(_box(), by) if by else _box(), cell))).where("__c is not null")


def spatial_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tolerance: float = 0.0, cell: float = CELL, on: list[str] | None = None) -> DataFrame:
    """Pairs on a page whose boxes, the right one larger by the tolerance, touch. Boxes meet in grid cells; of the cells that a pair shares the lowest gives the pair, so none comes twice.

    left's columns keep their names, right's get an r_ in front.
    """
    on = PAGE if on is None else on
    a = _gridded(left, 0.0, cell)
    b = _gridded(right, tolerance, cell)
    b = b.select(*on, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in on), F.col("__c"))
    both = a.join(b, [*on, "__c"])
    wide = G.expanded(_box("r_"), tolerance) if tolerance else _box("r_")
    low = F.struct(F.floor(F.greatest(F.col("x"), wide["x"]) / cell).alias("cx"), F.floor(F.greatest(F.col("y"), wide["y"]) / cell).alias("cy"))
    touch = (F.col("x") <= wide["x2"]) & (wide["x"] <= F.col("x2")) & (F.col("y") <= wide["y2"]) & (wide["y"] <= F.col("y2"))
    return both.where(touch & (F.col("__c.cx") == low["cx"]) & (F.col("__c.cy") == low["cy"])).drop("__c")


def assign_regions(chars: DataFrame, regions: DataFrame, priority: list[str], key: str = "char_idx") -> DataFrame:
    """chars with region_id, class_name and coverage of the best region: first by the priority list, then by how much of the character it covers; null without one."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(p) for p in priority)), F.col("r_class_name")), F.lit(0))
    pairs = spatial_pairs(chars, regions, key, "region_id").withColumn("cov", G.coverage(_box(), _box("r_"))).where("cov > 0")
    order = F.struct(F.when(rank == 0, len(priority) + 1).otherwise(rank).alias("p"), (-F.col("cov")).alias("c"), F.col("r_region_id").alias("i"))
    best = pairs.groupBy(*PAGE, key).agg(F.min_by(F.struct(F.col("r_region_id").alias("region_id"), F.col("r_class_name").alias("class_name"), F.col("cov").alias("coverage")), order).alias("b"))
    return chars.join(best.select(*PAGE, key, "b.*"), [*PAGE, key], "left")


def formula_region(chars: DataFrame, regions: DataFrame, key: str = "char_idx", least: float = 0.4, agree: float = 0.2) -> DataFrame:
    """chars with formula_region_id: the formula region that covers over ``least`` of the visual box (vx, vy, vx2, vy2), or of the box itself where the visual one agrees with it by less than ``agree``."""
    # taken out of an array: filters on it would be pushed below, each with all of the comparison, into a method too long to be compiled
    used = F.array(F.when(G.iou(_box(), _box("v")) < agree, _box()).otherwise(_box("v")))
    rows = chars.select(*PAGE, key, F.inline_outer(used))
    pairs = spatial_pairs(rows, regions.select(*PAGE, "region_id", "x", "y", "x2", "y2"), key, "region_id").withColumn("cov", G.coverage(_box(), _box("r_"))).where(F.col("cov") > least)
    best = pairs.groupBy(*PAGE, key).agg(F.max_by("r_region_id", F.struct("cov", -F.col("r_region_id"))).alias("formula_region_id"))
    return chars.join(best, [*PAGE, key], "left")


def assign_elements(elements: DataFrame, formulas: DataFrame, key: str = "element_id") -> DataFrame:
    """elements with formula_id and score: containment of 0.95 and more scores 1, else a match within 2 scores 0.5 + 0.4 * (1 - distance / 100); one formula each, of the same object (xobj_id)."""
    pairs = spatial_pairs(elements, formulas, key, "formula_id", 2.0, on=[*PAGE, "xobj_id"])
    exact = G.coverage(_box(), _box("r_")) >= 0.95
    near = G.contained(_box(), _box("r_"), 0.95, 2.0)
    score = F.when(exact, 1.0).when(near, 0.5 + 0.4 * (1 - F.least(G.box_distance(_box(), _box("r_")), F.lit(100.0)) / 100.0))
    best = pairs.withColumn("score", score).where("score is not null").groupBy(*PAGE, key).agg(F.max_by(F.struct(F.col("r_formula_id").alias("formula_id"), "score"), F.struct("score", -F.col("r_formula_id"))).alias("b"))
    return elements.join(best.select(*PAGE, key, "b.*"), [*PAGE, key], "left")


def protected_elements(curves: DataFrame, regions: DataFrame, paragraphs: DataFrame, key: str = "curve_id") -> DataFrame:
    """curves with keep (over 0.3 in a figure or table region) and overlaps (over 0.2 in a paragraph)."""
    over = lambda other, other_key, least: spatial_pairs(curves, other, key, other_key).where(G.coverage(_box(), _box("r_")) > least).select(*PAGE, key).distinct()
    figure = regions.where(F.col("class_name").rlike("(?i)figure|table"))
    out = curves.join(over(figure, "region_id", 0.3).withColumn("keep", F.lit(True)), [*PAGE, key], "left").join(over(paragraphs, "para_idx", 0.2).withColumn("overlaps", F.lit(True)), [*PAGE, key], "left")
    return out.withColumn("keep", F.coalesce("keep", F.lit(False))).withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def overlapping_boxes(df: DataFrame, key: str = "para_idx") -> DataFrame:
    """(doc_id, page, left_key, right_key): boxes of a page and object that overlap with area, but for one that lies within the other's height."""
    pairs = spatial_pairs(df, df, key, key, on=[*PAGE, "xobj_id"]).where(F.col(key) < F.col(f"r_{key}")).where(G.intersection(_box(), _box("r_")) > 0)
    inside = ((F.col("y") >= F.col("r_y")) & (F.col("y2") <= F.col("r_y2"))) | ((F.col("r_y") >= F.col("y")) & (F.col("r_y2") <= F.col("y2")))
    return pairs.where(~inside).select(*PAGE, F.col(key).alias("left_key"), F.col(f"r_{key}").alias("right_key"))


def document_flags(paragraphs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, cid_char_share, cid_paragraph_share, unreadable, scanned). paragraphs: text, is_cid, page_scanned."""
    cid = F.length(F.array_join(F.regexp_extract_all("text", F.lit(r"(\(cid:\d+\))"), 1), ""))
    chars = F.try_divide(F.sum(cid).cast("double"), F.sum(F.length("text")))
    share = F.avg(F.col("is_cid").cast("double"))
    scanned = F.try_divide(F.count_distinct(F.when(F.col("page_scanned"), F.col("page"))).cast("double"), F.count_distinct("page")) >= least
    return paragraphs.groupBy("doc_id").agg(chars.alias("cid_char_share"), share.alias("cid_paragraph_share"), F.coalesce((chars > least) | (share > least), F.lit(False)).alias("unreadable"), scanned.alias("scanned"))


def base_style(chars: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Per paragraph the style that its characters share: font and size; what they do not share is the first-seen most frequent value. chars: doc_id, para_idx, char_idx, font_id, font_size."""
    key = ["doc_id", "para_idx"]
    mode = lambda c: chars.groupBy(*key, c).agg(F.count("*").alias("n"), F.min("char_idx").alias("f")).groupBy(*key).agg(F.max_by(c, F.struct("n", -F.col("f"))).alias(c))
    spread = chars.groupBy(*key).agg((F.count_distinct("font_id") == 1).alias("same_font"), (F.max("font_size") - F.min("font_size") <= tolerance).alias("same_size"))
    return spread.join(mode("font_id"), key).join(mode("font_size"), key)


def line_metrics(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Per keys the exact median of each column."""
    return df.groupBy(*keys).agg(*(F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in columns))


def paragraph_boxes(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys the box around all characters and the first render order."""
    return chars.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.min("render_order").alias("render_order"))


def infer_spaces(chars: DataFrame, keys: list[str], order: str = "char_idx", factor: float = 0.45) -> DataFrame:
    """chars with space_before: a new line, or a gap of at least the second smallest of the line's distinct gaps over 1; with a single such gap, over ``factor`` mean widths."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    gap = F.round(F.col("x") - F.lag("x2").over(w), 3)
    rows = chars.withColumn("__gap", gap).withColumn("__new", F.coalesce(G.is_newline(F.lag(_box()).over(w), _box(), F.col("x2") - F.col("x")), F.lit(False)))
    gaps = F.array_sort(F.collect_set(F.when(F.col("__gap") > 1, F.col("__gap"))).over(whole))
    limit = F.when(F.size(gaps) >= 2, gaps[1]).otherwise(F.avg(F.col("x2") - F.col("x")).over(whole) * factor)
    return rows.withColumn("__limit", limit).withColumn("space_before", F.coalesce(F.col("__new") | (F.col("__gap") >= F.col("__limit")), F.lit(False))).drop("__gap", "__new", "__limit")


def text_from_chars(chars: DataFrame, keys: list[str], order: str = "char_idx") -> DataFrame:
    """Per keys the text of its characters with inferred spaces."""
    spaced = infer_spaces(chars, keys, order)
    part = F.struct(order, F.concat(F.when(F.col("space_before"), " ").otherwise(""), F.col("char_unicode")).alias("t"))
    return spaced.groupBy(*keys).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "")).alias("text"))


def line_spacing(lines: DataFrame, keys: list[str], order: str = "line_idx") -> DataFrame:
    """Per keys the upper median of positive distances between neighbouring lines' bottoms; 10 without one."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = lines.withColumn("__d", F.lag("y").over(w) - F.col("y"))
    found = F.array_sort(F.collect_list(F.when(F.col("__d") > 0, F.col("__d"))))
    return d.groupBy(*keys).agg(F.when(F.size(found) > 0, F.element_at(found, F.floor(F.size(found) / 2).cast("int") + 1)).otherwise(10.0).alias("spacing"))


def group_chars(chars: DataFrame, bullets: str = "•◦▪●○■□–*") -> DataFrame:
    """chars with para_idx, per page in reading order: a new paragraph on a change of region (unless at a space) or object and at a bullet after another region's end; characters of under 5 % of the page's median area stay with what is before them.

    chars: doc_id, page, char_idx, char_unicode, region_id, xobj_id, box. With class_name (the region's) there too, paragraphs in cells of
    wired tables that share region, object and direction (vertical, if there) become the first of them, wherever they stand: a
    cell's text may be drawn in turns with its neighbours'. Their numbers leave gaps.
    """
    w = Window.partitionBy(*PAGE).orderBy("char_idx")
    size = (F.col("x2") - F.col("x")) * (F.col("y2") - F.col("y"))
    median = chars.groupBy(*PAGE).agg(F.percentile(size, F.lit(0.5)).alias("__median"))
    rows = chars.join(median, PAGE)
    small = size < F.col("__median") * 0.05
    region = F.when(small | (F.trim("char_unicode") == ""), F.lit(None).cast("long")).otherwise(F.coalesce(F.col("region_id").cast("long"), F.lit(-1).cast("long")))
    rows = rows.withColumn("__r", F.coalesce(F.last(region, ignorenulls=True).over(w), F.lit(-1).cast("long")))
    line_start = F.coalesce(G.is_newline(F.lag(_box()).over(w), _box(), F.col("x2") - F.col("x")), F.lit(True))
    new = (F.lag("__r").over(w) != F.col("__r")) | ~F.lag("xobj_id").over(w).eqNullSafe(F.col("xobj_id")) | (F.lit(bullets).contains(F.col("char_unicode")) & (F.trim("char_unicode") != "") & line_start)
    rows = rows.withColumn("__new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("para_idx", F.sum("__new").over(w) - 1)
    if "class_name" in chars.columns:
        begins = Window.partitionBy(*PAGE, "para_idx").orderBy("char_idx")
        upright = F.coalesce(F.col("vertical"), F.lit(False)) if "vertical" in chars.columns else F.lit(False)
        rows = rows.withColumn("__cell", F.first(F.struct(F.col("class_name").eqNullSafe(CELL_CLASS).alias("is"), "region_id", "xobj_id", upright.alias("upright"))).over(begins))
        cell = Window.partitionBy(*PAGE, "__cell")
        rows = rows.withColumn("para_idx", F.when(F.col("__cell.is"), F.min("para_idx").over(cell)).otherwise(F.col("para_idx"))).drop("__cell")
    return rows.drop("__median", "__r", "__new")


def split_lines(chars: DataFrame, keys: list[str], step: float = 0.25, flat: float = 5.0) -> DataFrame:
    """chars with line_idx from the top: where the characters' vertical extents, on a grid of ``step``, leave a gap, a line ends; a paragraph of under ``flat`` height is one line."""
    low, high = F.floor(F.col("y") / step), F.ceil(F.col("y2") / step)
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(high.desc(), low.desc(), "char_idx")
    floor_so_far = F.min(low).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tall = (F.max("y2").over(whole) - F.min("y").over(whole)) >= flat
    rows = chars.withColumn("__new", (tall & F.coalesce(high < floor_so_far, F.lit(False))).cast("int"))
    return rows.withColumn("line_idx", F.sum("__new").over(w).cast("int")).drop("__new")


# Shares and multiples that decide what is a line.
BAND_SHARE = 0.5  # of a character's size that lies in its band
LINE_REACH = 3.5  # mean sizes between neighbours of a line
TALL, VALLEY = 1.5, 0.5  # largest sizes: of a line that is split, and between the parts
INSIDE_SHARE = 0.6  # of a line's area that lies in a larger one
LEVEL_SHARE = 0.7  # of both lines' sizes that adjacent ones share
GAP_BESIDE, GAP_BELOW = 1.5, 1.5  # mean sizes between adjacent lines, and down to where a line looks for others


#: Points up to which a stretch is gone through without arrays, whose making would take most of the time.
FEW = 64


def _bands(low: list[float], high: list[float]) -> list[list[int]]:
    """Intervals by band, in the order of their starts, the bands as they last grew: each goes to the band that holds the largest share of it, over BAND_SHARE; of equal ones to that which grew last. Bands are looked at from the last grown to the first that ends below."""
    members, ends, grown = [], [], []
    for i in sorted(range(len(low)), key=low.__getitem__):
        best, share, start, size = None, BAND_SHARE, low[i], high[i] - low[i]
        for b in reversed(grown):
            if ends[b] < start:
                break
            # a band starts no later than what comes after it
            part = (min(high[i], ends[b]) - start) / size if size > 0 else 0.0
            if part > share:
                best, share = b, part
        if best is None:
            best = len(ends)
            ends.append(high[i])
            members.append([])
        else:
            if grown[-1] != best:
                grown.remove(best)
            else:
                grown.pop()
            ends[best] = max(ends[best], high[i])
        grown.append(best)
        members[best].append(i)
    return [members[b] for b in grown]


def _within_reach(points: list[tuple], reach: float) -> list[list[int]]:
    """Single linkage: the places of points that steps of ``reach`` or less connect (sums of distances by axis), in order, by the first of each. Points are compared with those behind them by the first axis, as far as that axis allows."""
    n = len(points)
    if n == 1:
        return [[0]]
    if n > FEW:
        label = _linked(np.array(points), reach).tolist()
    else:
        order = sorted(range(n), key=lambda i: points[i][0])
        label = list(range(n))
        for k, i in enumerate(order):
            for j in order[k + 1 :]:
                if points[j][0] - points[i][0] > reach:
                    break
                if label[i] != label[j] and _apart(points[i], points[j]) <= reach:
                    old, now = label[j], label[i]
                    label = [now if x == old else x for x in label]
    parts: dict[int, list[int]] = {}
    for i, x in enumerate(label):
        parts.setdefault(x, []).append(i)
    return list(parts.values())


def _apart(a: tuple, b: tuple) -> float:
    """The distances of two points by axis, added up."""
    first = abs(a[0] - b[0])
    return first + abs(a[1] - b[1]) if len(a) > 1 else first


def _linked(points: np.ndarray, reach: float) -> np.ndarray:
    order = np.argsort(points[:, 0], kind="stable")
    at, links = points[order], []
    for k in range(1, len(at)):
        step = np.abs(at[k:] - at[:-k])
        if (step[:, 0] > reach).all():
            break
        i = np.flatnonzero(step.sum(axis=1) <= reach)
        links.append(np.stack([i, i + k]))
    a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), dtype=np.int64)
    label = np.empty(len(at), dtype=np.int64)
    label[order] = components(len(at), a, b)
    return label


def _mean(values: list[float]) -> float:
    """As numpy adds them up: a few one after the other."""
    if len(values) > 7:
        return float(np.mean(np.array(values)))
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


def _mean_size(sizes: list[float], without: float) -> float:
    sizes = [v for v in sizes if v > 0]
    return _mean(sizes) if sizes else without


def _runs(box: list[list[float]], own: list[int], along: int) -> list[list[int]]:
    """Lines of the boxes (x, y, x2, y2) of one direction: bands across, single linkage in a band, and where a line is much taller than its characters a split at the valleys of its centres."""
    low, high = [box[i][1 - along] for i in own], [box[i][3 - along] for i in own]
    out = []
    for band in _bands(low, high):
        members = [own[k] for k in band]
        reach = _mean_size([box[i][2 + along] - box[i][along] for i in members], 10.0) * LINE_REACH
        for part in _within_reach([((box[i][0] + box[i][2]) / 2, (box[i][1] + box[i][3]) / 2) for i in members], reach):
            line = sorted((members[k] for k in part), key=lambda i: box[i][along])
            if len(line) > 1:
                lows, highs = [box[i][1 - along] for i in line], [box[i][3 - along] for i in line]
                tallest = max(max(h - w for w, h in zip(lows, highs, strict=True)), 0.0)
                if tallest > 0 and max(highs) - min(lows) > tallest * TALL:
                    middle = [((w + h) / 2,) for w, h in zip(lows, highs, strict=True)]
                    out += [[line[k] for k in piece] for piece in _within_reach(middle, tallest * VALLEY)]
                    continue
            out.append(line)
    return out


def _frame(box: list[list[float]], line: list[int]) -> tuple[float, float, float, float]:
    if len(line) == 1:
        return tuple(box[line[0]])
    return min(box[i][0] for i in line), min(box[i][1] for i in line), max(box[i][2] for i in line), max(box[i][3] for i in line)


def _area(f: tuple) -> float:
    return max(f[2] - f[0], 0.0) * max(f[3] - f[1], 0.0)


def _reaches(gap: float, box: list[list[float]], a: list[int], b: list[int], along: int) -> bool:
    """Whether a gap is under GAP_BESIDE mean sizes of the characters of two lines. A mean lies between the least and the largest size, which decide most."""
    sizes = [v for line in (a, b) for i in line if (v := box[i][2 + along] - box[i][along]) > 0]
    return bool(sizes) and gap < max(sizes) * GAP_BESIDE * (1 + 1e-9) and gap < _mean(sizes) * GAP_BESIDE


def lines_of(boxes: np.ndarray, vertical: np.ndarray) -> list[list[int]]:
    """The lines of a page's boxes (x, y, x2, y2), from the top, each as its boxes in reading order.

    A page has about as many lines as characters where they stand alone, and each meets several: all of this is plain numbers, as an
    array of two or four of them takes longer to make than to work on.
    """
    box, flags = boxes.tolist(), [bool(v) for v in vertical.tolist()]
    lines = []
    for flag, along in ((False, 0), (True, 1)):
        own = [i for i, v in enumerate(flags) if v == flag]
        lines += _runs(box, own, along) if own else []
    lines.sort(key=lambda line: (-_mean([(box[i][1] + box[i][3]) / 2 for i in line]), _mean([(box[i][0] + box[i][2]) / 2 for i in line])))
    frames, upright = [_frame(box, line) for line in lines], [flags[line[0]] for line in lines]
    gone, out = [False] * len(lines), []
    for i in range(len(lines)):
        if gone[i]:
            continue
        floor = _mean_size([box[k][3] - box[k][1] for k in lines[i]], 0.0) * GAP_BELOW
        ax, ay, ax2, ay2 = frames[i]
        area = _area(frames[i])
        for j in range(i + 1, len(lines)):
            if gone[j]:
                continue
            bx, by, bx2, by2 = frames[j]
            if ay - by2 > floor:
                break
            wide, tall = min(ax2, bx2) - max(ax, bx), min(ay2, by2) - max(ay, by)
            along = 1 if upright[i] else 0
            leads = True
            other = 0.0
            if wide > 0 and tall > 0:
                other = _area(frames[j])
            smaller = min(area, other)
            if smaller > 0 and wide * tall / smaller > INSIDE_SHARE:  # the smaller frame lies mostly in the other, which leads
                leads = other <= area
            else:  # level and near
                across, high, gap = (wide, (ax2 - ax, bx2 - bx), max(ay, by) - min(ay2, by2)) if along else (tall, (ay2 - ay, by2 - by), max(ax, bx) - min(ax2, bx2))
                if across <= 0 or gap < 0 or min(high) <= 0 or across / max(high) <= LEVEL_SHARE or not _reaches(gap, box, lines[i], lines[j], along):
                    continue
            gone[j] = True
            if leads:
                lines[i] = lines[i] + lines[j]
            else:
                lines[i] = lines[j] + lines[i]
                upright[i] = upright[j]
            frames[i] = ax, ay, ax2, ay2 = min(ax, bx), min(ay, by), max(ax2, bx2), max(ay2, by2)
            area = _area(frames[i])
        along = 1 if upright[i] else 0
        out.append(sorted(lines[i], key=lambda k: box[k][along]) if len(lines[i]) > 1 else lines[i])
    return out


def cluster_lines(chars: DataFrame) -> DataFrame:
    """chars (doc_id, page, char_idx, box; vertical if there) with line_idx, from the top of the page, and line_pos, the place in the line.

    Characters of one direction form bands across it, each band lines by single linkage with a reach of LINE_REACH mean sizes; a line
    over TALL times its largest character is split where centres leave a gap. Lines then become one where the smaller lies
    mostly in the larger, or where two are level and near. A null in vertical is false; characters without a box have no line.
    A page is one task's.
    """
    flag = "vertical" in chars.columns

    def page(rows: pd.DataFrame) -> dict:
        box = rows[["x", "y", "x2", "y2"]].to_numpy(dtype=float, na_value=np.nan)
        sound = np.flatnonzero(~np.isnan(box).any(axis=1))
        order = sound[np.argsort(rows["char_idx"].to_numpy()[sound], kind="stable")]
        upright = rows["vertical"].fillna(False).to_numpy(dtype=bool) if flag else np.zeros(len(rows), dtype=bool)
        line, place = np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows), dtype=np.int32)
        found = lines_of(box[order], upright[order])
        at = order[np.array([k for members in found for k in members], dtype=np.int64)]
        line[at] = [n for n, members in enumerate(found) for _ in members]
        place[at] = [k for members in found for k in range(len(members))]
        none = np.ones(len(rows), dtype=bool)
        none[at] = False
        return {"line_idx": pd.arrays.IntegerArray(line, none), "line_pos": pd.arrays.IntegerArray(place, none.copy())}

    return add_by_group(chars, PAGE, ["char_idx", "x", "y", "x2", "y2", *(["vertical"] if flag else [])], {"line_idx": "int", "line_pos": "int"}, page)


def merge_line_numbers(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, page, para_idx, text): text, then paragraphs of digits only, then text of the same region and object become one text without the digits."""
    digits = F.col("text").rlike(r"^\s*\d+\s*$")
    w = Window.partitionBy(*PAGE).orderBy("para_idx")
    rows = paragraphs.withColumn("__digits", digits).withColumn("__run", F.sum((~digits).cast("int")).over(w))
    between = rows.groupBy(*PAGE, "__run").agg(F.bool_or("__digits").alias("__after"))
    words = rows.where("not __digits").join(between, [*PAGE, "__run"])
    joins = F.coalesce(F.lag("__after").over(w) & F.lag("region_id").over(w).eqNullSafe(F.col("region_id")) & F.lag("xobj_id").over(w).eqNullSafe(F.col("xobj_id")), F.lit(False))
    grouped = words.withColumn("__g", F.sum((~joins).cast("int")).over(w))
    merged = grouped.groupBy(*PAGE, "__g").agg(F.min("para_idx").alias("para_idx"), F.max("__run").alias("__last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    inner = grouped.where("__after").join(grouped.groupBy(*PAGE, "__g").agg(F.max("__run").alias("__last")), [*PAGE, "__g"]).where("__run < __last").select(*PAGE, "__run")
    kept = rows.where("__digits").join(inner, [*PAGE, "__run"], "left_anti")
    return merged.select(*PAGE, "para_idx", "text").unionByName(kept.select(*PAGE, "para_idx", "text"))


def split_short_lines(lines: DataFrame, share: float = 0.8, narrow: bool = True, bullets: str = "•◦▪●○■□") -> DataFrame:
    """lines (doc_id, page, para_idx, line_idx, text, x, x2) with part: a new one after a line with 20 dots or more, after a line narrower than ``share`` of the page's median (if narrow), and before a bullet."""
    median = lines.groupBy(*PAGE).agg(F.percentile(F.col("x2") - F.col("x"), F.lit(0.5)).alias("__m"))
    w = Window.partitionBy(*PAGE, "para_idx").orderBy("line_idx")
    rows = lines.join(median, PAGE)
    before = F.lag(F.struct("text", "x", "x2")).over(w)
    dots = F.length(F.regexp_replace(before["text"], r"[^.]", "")) >= 20
    short = F.lit(narrow) & (before["x2"] - before["x"] < F.col("__m") * share)
    bullet = F.lit(bullets).contains(F.substring(F.ltrim("text"), 1, 1)) & (F.trim("text") != "")
    return rows.withColumn("__n", F.coalesce(before.isNotNull() & (dots | short | bullet), F.lit(False)).cast("int")).withColumn("part", F.sum("__n").over(w).cast("int")).drop("__n", "__m")


def resolve_overlap(df: DataFrame, key: str = "para_idx", rounds: int = 5) -> DataFrame:
    """Boxes of a page that overlap vertically are drawn back to 1 off the overlap's middle, until none do or the rounds are over."""

    def page(rows: pd.DataFrame) -> dict:
        rows = rows.sort_values(key)
        x, y, x2, y2 = (rows[c].to_numpy(dtype=float, copy=True) for c in ("x", "y", "x2", "y2"))
        for _ in range(rounds):
            moved = False
            for i in range(len(rows)):
                for j in range(i + 1, len(rows)):
                    a, b = (i, j) if y2[i] >= y2[j] else (j, i)
                    if min(x2[i], x2[j]) <= max(x[i], x[j]) or y2[b] <= y[a] or y2[b] <= y[b] or (y[a] >= y[b] and y2[a] <= y2[b]) or (y[b] >= y[a] and y2[b] <= y2[a]):
                        continue
                    middle = (y[a] + y2[b]) / 2
                    y[a], y2[b] = middle + 1, middle - 1
                    moved = True
            if not moved:
                break
        back = np.argsort(np.argsort(rows.index))
        return {"y": y[back], "y2": y2[back]}

    return add_by_group(df, PAGE, [key, "x", "y", "x2", "y2"], {"y": "double", "y2": "double"}, page)


def translatable_formula(text: Column, offset: Column) -> Column:
    """A formula of digits, spaces, commas and points only that stands on the line is prose."""
    return text.rlike(r"^[0-9 ,.]+$") & (F.abs(offset) <= 0.1)


def split_formula(chars: DataFrame, keys: list[str], order: str = "char_idx") -> DataFrame:
    """chars with part: a formula is split after commas outside brackets, if it holds anything but digits and separators."""
    w = Window.partitionBy(*keys).orderBy(order)
    c = F.col("char_unicode")
    depth = F.sum(F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = chars.withColumn("__cut", ((c == ",") & (depth == 0)).cast("int")).withColumn("__other", F.bool_or(~c.rlike(r"^[0-9 ,.]$")).over(Window.partitionBy(*keys)))
    before = F.coalesce(F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("part", F.when(F.col("__other"), before).otherwise(0).cast("int")).drop("__cut", "__other")


def formula_fonts(fonts: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, page, xobj_id, font_id): fonts of formulas, by name. An object's own fonts add to and take from the page's. fonts: xobj_id is null for the page's."""
    page = fonts.where("xobj_id is null").select(*PAGE, "font_id", F.col("name").rlike(pattern).alias("page_hit"))
    objects = fonts.where("xobj_id is not null")
    every = objects.select(*PAGE, "xobj_id").distinct().join(page, PAGE)
    own = objects.select(*PAGE, "xobj_id", "font_id", F.col("name").rlike(pattern).alias("own_hit"))
    merged = every.join(own, [*PAGE, "xobj_id", "font_id"], "full").where(F.coalesce("own_hit", "page_hit"))
    return page.where("page_hit").select(*PAGE, F.lit(None).cast("long").alias("xobj_id"), "font_id").unionByName(merged.select(*PAGE, F.col("xobj_id").cast("long").alias("xobj_id"), "font_id"))


def merge_formulas(formulas: DataFrame) -> DataFrame:
    """formulas (doc_id, page, para_idx, part_idx, line_id, region_id, box) with group, from 0 in each paragraph.

    part_idx counts all of a paragraph's parts, texts too, so that formulas with text between are no neighbours. Two formulas
    of a line become one if they have one region, or if over 0.8 of either lies in the other; neighbours also if one's width lies
    within the other's and they share height within 1, or if they touch sideways within 2 and share over half of their common height. The
    earliest pair comes first, and what has become one goes on as one, until no pair is left.
    """

    def covers(a: np.ndarray, b: np.ndarray) -> float:
        shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        return max((shared / area for area in ((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)) if area > 0), default=0.0)

    def side_by_side(a: np.ndarray, b: np.ndarray) -> bool:
        apart_x, apart_y = max(a[0], b[0]) - min(a[2], b[2]), max(a[1], b[1]) - min(a[3], b[3])
        within = (a[0] >= b[0] and a[2] <= b[2]) or (b[0] >= a[0] and b[2] <= a[2])
        both = (a[3] - a[1]) + (b[3] - b[1]) - max(0.0, -apart_y)
        return (within and apart_y <= 1) or (apart_x <= 2 and both > 0 and max(0.0, -apart_y) / both > 0.5)

    def one(rows: pd.DataFrame) -> dict:
        rows = rows.sort_values("part_idx")
        box = rows[["x", "y", "x2", "y2"]].to_numpy(dtype=float)
        place, line = rows["part_idx"].tolist(), rows["line_id"].tolist()
        region = [{r} if pd.notna(r) and r else set() for r in rows["region_id"].tolist()]
        members = [[i] for i in range(len(rows))]

        def joins(i: int, j: int) -> bool:
            if line[i] != line[j]:
                return False
            return len(region[i] | region[j]) == len(region[i]) == len(region[j]) == 1 or covers(box[i], box[j]) > 0.8 or (place[j] == place[i] + 1 and side_by_side(box[i], box[j]))

        live = list(range(len(rows)))
        while pair := next(((i, j) for i, j in combinations(live, 2) if joins(i, j)), None):
            i, j = pair
            box[i] = [*np.minimum(box[i][:2], box[j][:2]), *np.maximum(box[i][2:], box[j][2:])]
            region[i] |= region[j]
            members[i] += members[j]
            live.remove(j)
            for k in live:  # later parts move up
                place[k] -= place[k] > place[j]
        group = np.zeros(len(rows), dtype=np.int64)
        for n, i in enumerate(live):
            group[members[i]] = n
        return {"group": pd.Series(group, index=rows.index).sort_index().to_numpy()}

    return add_by_group(formulas, [*PAGE, "para_idx"], ["part_idx", "line_id", "region_id", "x", "y", "x2", "y2"], {"group": "long"}, one)


# Characters that start a formula (by Unicode category, Greek letters, digits and brackets), those that only go on
# in one, marks that start a list's item, and how much smaller a script is than its neighbour when it starts and while it lasts.
FORMULA_START = r"^[\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}\p{Co}\u0370-\u03ff0-9\[\]•]"
FORMULA_MIDDLE = ","
BULLETS = "■•⚫⬤◆◇○●◦‣⁃▪▫∗†‡¹²³⁴⁵⁶⁷⁸⁹⁰₁₂₃₄₅₆₇₈₉₀ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛʷˣʸᶻ¶※⁑⁂⁕⁎⁜❧☙⁋‖‽·"
SCRIPT_STARTS, SCRIPT_LASTS = 0.79, 1.1


def tag_formula_chars(chars: DataFrame, fonts: DataFrame | None = None, pattern: str | None = None, small: float = SCRIPT_STARTS, large: float = SCRIPT_LASTS) -> DataFrame:
    """chars (doc_id, page, line_idx, char_idx, char_unicode, font_size, box) with is_formula and is_script, per line in order.

    Used where there: para_idx; formula_font, formula_region_id, vertical, vx, vy, vx2, vy2 (what is seen of a character), in_font (false: the
    text fonts lack it), xobj_id and font_id. fonts: what formula_fonts gives; pattern: more characters that start a formula.

    A character is a formula's by its region, font, direction or kind, or if it is drawn beside its box; a comma or a character
    without text only goes on in a formula, and a space is what is before it. A script is much smaller than the character before it (at a
    line's start, than the one after) and lasts while sizes grow by less than ``large``; white space ends it, and from a
    bullet at a line's start on a paragraph has none.
    Whether a state holds is whether the last row that sets it comes after the last one that ends it, so all of it is windows over a line.
    """
    has = lambda *names: set(names) <= set(chars.columns)
    group = [*PAGE, *(["para_idx"] if has("para_idx") else []), "line_idx"]
    line = Window.partitionBy(*group).orderBy("char_idx")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    false = F.lit(False)
    sure = F.coalesce(F.col("formula_font"), false) if has("formula_font") else false
    rows = chars
    if fonts is not None:
        told = fonts.select(*(F.col(c).alias(f"__{c}") for c in (*PAGE, "xobj_id", "font_id")), F.lit(True).alias("__hit")).distinct()
        named = fonts.where("xobj_id is not null").select(*(F.col(c).alias(f"__o_{c}") for c in (*PAGE, "xobj_id"))).distinct().withColumn("__own", F.lit(True))
        rows = rows.join(named, F.col("doc_id").eqNullSafe(F.col("__o_doc_id")) & (F.col("page") == F.col("__o_page")) & (F.col("xobj_id") == F.col("__o_xobj_id")), "left")
        scope = F.when(F.col("__own"), F.col("xobj_id"))  # an object with fonts of its own, else the page
        rows = rows.withColumn("__scope", scope.cast("long"))
        rows = rows.join(told, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("page") == F.col("__page")) & F.col("__scope").eqNullSafe(F.col("__xobj_id")) & (F.col("font_id") == F.col("__font_id")), "left")
        sure = sure | F.coalesce(F.col("__hit"), false)
    c = F.col("char_unicode")
    space, blank = F.coalesce(c == " ", false), F.coalesce(c.rlike(r"^[\s\p{Z}\x1c-\x1f\x85]+$"), false)
    kind = F.coalesce(c.rlike(FORMULA_START) | c.contains("(cid:"), false) | (F.coalesce(c.rlike(f"^(?:{pattern})"), false) if pattern else false)
    sure = sure | kind
    if has("in_font"):
        sure = sure | (F.coalesce(~F.col("in_font"), false) & c.isNotNull())
    if has("formula_region_id"):
        sure = sure | F.coalesce(F.col("formula_region_id") != 0, false)
    if has("vertical"):
        sure = sure | F.coalesce(F.col("vertical"), false)
    if has("vx", "vy", "vx2", "vy2"):
        sure = sure | F.coalesce((F.col("x") > F.col("vx2")) | (F.col("x2") < F.col("vx")) | (F.col("y") > F.col("vy2")) | (F.col("y2") < F.col("vy")), false)
    bullet = F.coalesce(F.lag("char_idx").over(line).isNull() & F.lit(BULLETS).contains(F.substring(c, 1, 1)) & (c != ""), false)
    rows = rows.withColumns({"__sure": sure, "__space": space, "__blank": blank, "__bullet": bullet, "__nth": F.row_number().over(line)})
    paragraph = Window.partitionBy(*group[:-1]).orderBy("line_idx", "char_idx") if has("para_idx") else line
    listed = F.max("__bullet").over(paragraph.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before, after = F.lag("font_size").over(line), F.lead("font_size").over(line)
    able = ~F.col("__blank") & ~listed & ~F.coalesce(F.lag("__blank").over(line), false)
    first = F.col("__nth") == 1
    starts = able & F.coalesce(F.when(first, F.col("font_size") < after * small).otherwise(F.col("font_size") < before * small), false)
    lasts = able & ~first & F.coalesce(F.col("font_size") < before * large, false)
    rows = rows.withColumns({"__starts": starts, "__lasts": lasts | starts})
    last = lambda flag: F.coalesce(F.max(F.when(flag, F.col("__nth"))).over(so_far), F.lit(0))
    rows = rows.withColumn("is_script", last(F.col("__starts")) > last(~F.col("__lasts")))
    # what neither makes a formula nor ends one
    carries = F.col("__space") | F.coalesce(c.startswith(FORMULA_MIDDLE), false) | c.isNull()
    rows = rows.withColumn("__is", ~F.col("__space") & (F.col("__sure") | F.col("is_script"))).withColumn("__ends", ~F.col("__is") & ~carries)
    rows = rows.withColumn("is_formula", last(F.col("__is")) > last(F.col("__ends")))
    return rows.select(*chars.columns, "is_formula", "is_script")


def style_runs(chars: DataFrame, keys: list[str], order: str = "char_idx") -> DataFrame:
    """(keys, run, style, text): characters of one style in a row, broken by formulas (is_formula); a blank run between two of one style joins them. chars: style, char_unicode, is_formula."""
    w = Window.partitionBy(*keys).orderBy(order)
    blank = F.trim("char_unicode") == ""
    own = F.when(~blank | F.col("is_formula"), F.concat_ws("|", F.col("is_formula").cast("string"), F.col("style").cast("string")))
    before, after = F.last(own, ignorenulls=True).over(w), F.first(own, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = chars.withColumn("__s", F.when(own.isNotNull(), own).when(before == after, before).otherwise(F.concat(F.lit("blank|"), F.col("style").cast("string"))))
    rows = rows.withColumn("__n", F.coalesce(F.lag("__s").over(w) != F.col("__s"), F.lit(True)).cast("int")).withColumn("run", F.sum("__n").over(w) - 1)
    return rows.groupBy(*keys, "run").agg(F.min_by("style", order).alias("style"), F.bool_or("is_formula").alias("is_formula"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "char_unicode"))), lambda x: x["char_unicode"]), "").alias("text"))


def formula_offsets(parts: DataFrame, keys: list[str], order: str = "part_idx") -> DataFrame:
    """Formula parts with x_offset and y_offset from the nearest text on their line: left, else right, the one with more vertical overlap of over 0.6. parts: is_formula and box."""
    w = Window.partitionBy(*keys).orderBy(order)
    text = F.when(~F.col("is_formula"), _box())
    left = F.last(text, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(text, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = parts.withColumn("__l", left).withColumn("__r", right).where("is_formula")
    cover = lambda c: F.coalesce(G.y_min_coverage(_box(), F.col(c)), F.lit(0.0))
    use_left, use_right = (cover("__l") > 0.6) & (cover("__l") >= cover("__r")), cover("__r") > 0.6
    x = F.when(use_left, F.col("x") - F.col("__l.x2")).when(use_right, F.col("__r.x") - F.col("x2")).otherwise(0.0)
    y = F.when(use_left, F.col("y") - F.col("__l.y")).when(use_right, F.col("y") - F.col("__r.y")).otherwise(0.0)
    clamp = lambda c: F.when(F.abs(c) < 0.1, 0.0).otherwise(F.least(F.greatest(c, F.lit(-5.0)), F.lit(10.0)))
    return rows.withColumn("x_offset", clamp(x)).withColumn("y_offset", F.when(F.abs(y) < 0.1, 0.0).otherwise(y)).drop("__l", "__r")


def locate_text(glyphs: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle_id, line, x, y, x2, y2): line rectangles of a text that occurs once on its page. glyphs: doc_id, page, glyph_idx, char, box; needles: needle_id (unique), doc_id, page, text.

    Both are compared in lower case without white space; where that gives no single place, hyphens at line ends are left out of the page
    as well. A page is one row, made once with its text in either way; a needle meets that row, and one pass over the page's
    glyphs takes up those at its place. A line ends where the next glyph lies below, above or left of all of it.
    Null and blank glyphs do not count; a null or blank needle is nowhere.
    """
    shown = glyphs.where(F.translate("char", T.WHITE, "") != "").select(*PAGE, "glyph_idx", F.lower("char").alias("folded"), F.col("char").isin("-", "\u00ad").alias("hyphen"), "x", "y", "x2", "y2")
    glyph = F.struct("glyph_idx", "folded", "hyphen", "x", "y", "x2", "y2")
    pages = shown.groupBy(*PAGE).agg(F.sort_array(F.collect_list(glyph)).alias("all"))

    def wraps(g: Column, i: Column) -> Column:
        after = F.get("all", i + 1)
        return g["hyphen"] & F.coalesce((after["y2"] <= g["y"]) | (after["x2"] < g["x"]), F.lit(False))

    text = lambda c: F.array_join(F.transform(c, lambda g: g["folded"]), "")
    pages = pages.withColumn("some", F.filter("all", lambda g, i: ~wraps(g, i)))
    pages = pages.select(*PAGE, "all", "some", text("all").alias("all_text"), F.when(F.size("some") < F.size("all"), text("some")).alias("some_text"))
    asked = needles.select("needle_id", *PAGE, F.translate(F.lower("text"), T.WHITE, "").alias("wanted")).where("wanted <> ''")
    met = asked.join(pages, PAGE)

    def place(body: str) -> Column:
        """Where the needle's only place in a text begins; null without one."""
        at = F.position(F.col("wanted"), F.col(body))
        return F.when((at > 0) & (F.position(F.col("wanted"), F.col(body), at + 1) == 0), at)

    met = met.withColumns({"first": place("all_text"), "second": place("some_text")}).where("first is not null or second is not null")
    met = met.select("needle_id", F.coalesce("first", "second").alias("at"), F.length("wanted").alias("size"), F.when(F.col("first").isNotNull(), F.col("all")).otherwise(F.col("some")).alias("glyphs"))
    box = lambda *c: F.struct(*(v.alias(k) for v, k in zip(c, ("x", "y", "x2", "y2"), strict=True)))

    def grow(lines: Column, g: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        apart = (F.size(lines) == 0) | (g["y2"] <= last["y"]) | (g["y"] >= last["y2"]) | (g["x"] < last["x"])
        wider = box(F.least(last["x"], g["x"]), F.least(last["y"], g["y"]), F.greatest(last["x2"], g["x2"]), F.greatest(last["y2"], g["y2"]))
        return F.when(apart, F.concat(lines, F.array(box(g["x"], g["y"], g["x2"], g["y2"])))).otherwise(F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(wider)))

    def step(a: Column, g: Column) -> Column:
        through = a["through"] + F.length(g["folded"])
        here = (through >= F.col("at")) & (a["through"] + 1 < F.col("at") + F.col("size"))
        return F.struct(through.alias("through"), F.when(here, grow(a["lines"], g)).otherwise(a["lines"]).alias("lines"))

    nothing = F.struct(F.lit(0).alias("through"), F.array().cast("array<struct<x:double,y:double,x2:double,y2:double>>").alias("lines"))
    found = met.select("needle_id", F.aggregate("glyphs", nothing, step, lambda a: a["lines"]).alias("lines"))
    return found.select("needle_id", F.posexplode("lines").alias("line", "b")).select("needle_id", "line", "b.*")
