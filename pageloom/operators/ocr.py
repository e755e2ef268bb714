"""Recognised text blocks of a page: order, confidence, margins, ruled tables."""

from __future__ import annotations

import re
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import CJK_RECOGNISED, rounded, strip
from pageloom.functions.udf import grouped_rows

PAGE = ["doc_id", "page_number"]
LOW = 0.6
_CJK = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U000323af]")
_NUMERALS = re.compile("[一二三四五六七八九十百〇零0-9ＯO]{1,4}")


def blocks_of(results: DataFrame) -> DataFrame:
    """Blocks from raw results (doc_id, page_number, texts, scores, polygons array<array<array<double>>>).

    Blank texts go; the others are numbered. A polygon that is missing or not finite is
    replaced by a unit box at the block's number.
    """
    full = F.filter(F.transform("texts", lambda t, i: F.struct(i.alias("i"), strip(t).alias("text"))), lambda t: t["text"] != "")
    rows = results.select(*PAGE, F.posexplode(full).alias("source_index", "t"), "scores", "polygons").select(*PAGE, "source_index", F.col("t.i").alias("i"), F.col("t.text").alias("text"), "scores", "polygons")
    polygon = F.get("polygons", F.col("i"))
    xs, ys = F.transform(polygon, lambda p: F.get(p, F.lit(0))), F.transform(polygon, lambda p: F.get(p, F.lit(1)))
    fine = F.coalesce((F.size(polygon) > 0) & F.forall(F.concat(xs, ys), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    score, at = F.get("scores", F.col("i")), F.col("source_index").cast("double")
    return rows.select(
        *PAGE, "source_index", "text", F.when(~F.isnan(score) & (F.abs(score) < float("inf")), score).alias("score"),
        F.when(fine, F.array_min(ys)).otherwise(at).alias("top"), F.when(fine, F.array_min(xs)).otherwise(0.0).alias("left"),
        F.when(fine, F.array_max(ys)).otherwise(at + 1).alias("bottom"), F.when(fine, F.array_max(xs)).otherwise(1.0).alias("right"), fine.alias("has_geometry"))


def confidence(blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, mean_confidence (4 digits), low_confidence_count, block_count."""
    return blocks.groupBy(*PAGE).agg(rounded(F.avg("score"), 4).alias("mean_confidence"), F.count_if(F.col("score") < LOW).alias("low_confidence_count"), F.count("*").alias("block_count"))


def horizontal_text(blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, text: blocks from top to bottom, then from left to right."""
    own = F.array_sort(F.collect_list(F.struct("top", "left", "source_index", "text")))
    return blocks.groupBy(*PAGE).agg(F.array_join(F.transform(own, lambda b: b["text"]), "\n").alias("text"))


def vertical_pages(blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, vertical: whether tall ideograph blocks carry the page."""
    return _vertical_sums(blocks)


def _vertical_sums(blocks: DataFrame, *more: Column) -> DataFrame:
    """vertical_pages with more aggregates of each page's blocks."""
    w, h = F.greatest(F.col("right") - F.col("left"), F.lit(1.0)), F.greatest(F.col("bottom") - F.col("top"), F.lit(1.0))
    n = F.regexp_count("text", F.lit(CJK_RECOGNISED))
    own = blocks.withColumn("n", n).withColumn("cjk", F.col("has_geometry") & (F.col("n") >= 2)).withColumn("tall", F.col("cjk") & (h >= F.greatest(w * 2.0, F.lit(24.0)))).withColumn("aspect", h / w)
    sums = own.groupBy(*PAGE).agg(F.count_if("tall").alias("t"), F.coalesce(F.sum(F.when(F.col("cjk"), F.col("n"))), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("tall"), F.col("n"))), F.lit(0)).alias("v"), F.median(F.when(F.col("tall"), F.col("aspect"))).alias("m"), *more)
    return sums.select(*PAGE, F.coalesce((F.col("t") >= 4) & (F.col("v") >= 20) & (F.col("v") >= F.col("all") * 0.55) & (F.col("m") >= 3.0), F.lit(False)).alias("vertical"), *sums.columns[6:])


def columns_from_right(blocks: list[dict]) -> tuple[list[dict], set[int], set[int]]:
    """Blocks by vertical columns from the right; source indices of marginal lines and of page numbers.

    Narrow blocks join the nearest column, whose centre is the mean of its blocks.
    """
    wide = lambda b: max(b["right"] - b["left"], 1.0)
    x = lambda b: (b["left"] + b["right"]) / 2
    tall = [wide(b) for b in blocks if b["has_geometry"] and max(b["bottom"] - b["top"], 1.0) >= wide(b) * 2]
    typical = median(tall) if tall else 32.0
    narrow, reach = max(24.0, typical * 1.8), max(8.0, min(24.0, typical * 0.35))
    columns: list[dict] = []  # own: blocks, xs: their centres, x: the mean
    live: list[tuple[int, dict]] = []  # that take more; a centre further right than reach is out of it for all blocks to come
    for b in sorted(blocks, key=lambda b: (-x(b), b["top"])):
        at, thin = x(b), wide(b) <= narrow
        live = [(k, c) for k, c in live if c["x"] - at <= reach]
        near = [(abs(at - c["x"]), k) for k, c in live if abs(at - c["x"]) <= reach] if thin and b["has_geometry"] else []
        if near:
            c = columns[min(near)[1]]
            c["own"].append(b)
            c["xs"].append(at)
            c["x"] = sum(c["xs"]) / len(c["xs"])
        else:
            columns.append({"own": [b], "xs": [at], "x": at})
            if thin:
                live.append((len(columns) - 1, columns[-1]))
    columns.sort(key=lambda c: -c["x"])
    end = max((b["bottom"] for b in blocks if b["has_geometry"]), default=0.0)
    margins, numbers = set(), set()
    for c in (columns[:1] + columns[-1:]) if len(columns) > 1 else columns:
        for b in (b for b in c["own"] if b["has_geometry"]):
            t = b["text"]
            if b["top"] >= end * 0.67 and (_NUMERALS.fullmatch(t) or len(t) <= 2 and all(map(_CJK.match, t))):
                numbers.add(b["source_index"])
            elif len(t) <= 24 and end * 0.12 <= b["top"] and b["bottom"] <= end * 0.65:
                margins.add(b["source_index"])
    return [b for c in columns for b in sorted(c["own"], key=lambda b: (b["top"], b["left"], b["source_index"]))], margins, numbers


READ = "doc_id long, page_number int, text string, line_count int, vertical boolean, marginal_line_indices array<int>, printed_page_numbers array<string>"


def read_pages(blocks: DataFrame) -> DataFrame:
    """The text of each recognised page in reading order; a page is a row of its blocks, folded where it is vertical."""
    names = ["source_index", "text", "top", "left", "bottom", "right", "has_geometry"]
    pages = _vertical_sums(blocks, F.array_sort(F.collect_list(F.struct(*names))).alias("blocks"))

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("page_number", pa.int32()), ("text", pa.string()), ("line_count", pa.int32()), ("vertical", pa.bool_()), ("marginal_line_indices", pa.list_(pa.int32())), ("printed_page_numbers", pa.list_(pa.string()))])
        out = []
        for doc_id, page_number, vertical, own in grouped_rows(batches):
            lines, margins, printed = [], [], []
            if vertical:
                ordered, marginal, numbers = columns_from_right([dict(zip(names, b, strict=True)) for b in own])
                for b in ordered:
                    if b["source_index"] in numbers:
                        printed.append(b["text"])
                        continue
                    if b["source_index"] in marginal:
                        margins.append(len(lines))
                    lines.append(b["text"])
            else:
                lines = [b[1] for b in sorted(own, key=lambda b: (b[2], b[3], b[0]))]
            out.append({"doc_id": doc_id, "page_number": page_number, "text": "\n".join(lines), "line_count": len(lines), "vertical": vertical, "marginal_line_indices": margins, "printed_page_numbers": printed})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return pages.withColumns({"doc_id": F.col("doc_id").cast("long"), "page_number": F.col("page_number").cast("int")}).mapInArrow(run, READ)


def warnings(pages: DataFrame) -> DataFrame:
    """The pages with warnings from line_count, low_confidence_count, vertical and printed_page_numbers."""
    n = F.col("page_number")
    say = lambda text: F.concat(F.lit("第 "), n, F.lit(text))
    return pages.withColumn("warnings", F.array_compact(F.array(
        F.when(F.col("line_count") == 0, say(" 页 OCR 未识别到文字。")),
        F.when(F.col("low_confidence_count") > 0, F.concat(F.lit("第 "), n, F.lit(" 页有 "), F.col("low_confidence_count"), F.lit(" 个 OCR 文字块置信度低于 0.60。"))),
        F.when(F.col("vertical"), say(" 页检测到竖排文字，已按从右到左的列顺序重排。")),
        F.when(F.size("printed_page_numbers") > 0, say(" 页已将页边页码候选移出正文，原识别值已记录在报告中。")))))


def ruled_tables(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, page_number, text, rows, columns of pages whose grid (rules: doc_id, page_number, xs, ys) is filled well enough.

    A block belongs to the cell that its centre lies strictly inside; the others are
    kept around the table by their height.
    """
    grid = rules.where((F.size("xs") >= 4) & (F.size("ys") >= 4) & (F.size("ys") <= 101) & (F.size("xs") <= 21))
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    at = lambda v, edges: F.try_element_at(F.filter(F.sequence(F.lit(0), F.size(edges) - 2), lambda k: (F.get(edges, k) < v) & (v < F.get(edges, k + 1))), F.lit(1))
    placed = blocks.where("has_geometry").join(grid, PAGE).select(*PAGE, "text", x.alias("x"), y.alias("y"), at(y, F.col("ys")).alias("r"), at(x, F.col("xs")).alias("c"))
    cells = placed.where("r IS NOT NULL AND c IS NOT NULL").groupBy(*PAGE, "r", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda b: b["text"]), " ").alias("cell"))
    filled = cells.groupBy(*PAGE, "r").agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("c", "cell"))).alias("row"))
    good = filled.groupBy(*PAGE).agg(F.count_if(F.col("n") >= 2).alias("rows2"), F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("r", "row"))).alias("cells")).where("rows2 >= 3 AND all >= 9")
    table = good.join(grid, PAGE)
    line = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), F.size("xs") - 2), lambda c: F.coalesce(F.try_element_at(F.try_element_at(F.col("cells"), r), c), F.lit(""))), "\t")
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.size("ys") - 2), line), "\n")
    rest = placed.where("r IS NULL OR c IS NULL").groupBy(*PAGE).agg(F.collect_list(F.struct("y", "x", "text")).alias("rest"))
    own = F.struct(F.array_min("ys").cast("double").alias("y"), F.array_min("xs").cast("double").alias("x"), body.alias("text"))
    all_ = F.array_sort(F.concat(F.coalesce("rest", F.array().cast("array<struct<y:double,x:double,text:string>>")), F.array(own)))
    return table.join(rest, PAGE, "left").select(*PAGE, F.array_join(F.transform(all_, lambda b: b["text"]), "\n").alias("text"), (F.size("ys") - 1).alias("rows"), (F.size("xs") - 1).alias("columns"))


def grid_lines(gray) -> tuple[list[int], list[int]] | None:
    """Positions (ys, xs) of the ruled lines of a grey picture as a matrix, or None where there is no grid."""
    import numpy as np

    def centres(at):
        runs = np.split(at, np.flatnonzero(np.diff(at) > 3) + 1) if len(at) else []
        return [round(float(r.mean())) for r in runs]

    dark = np.asarray(gray) < 110
    height, width = dark.shape
    ys = centres(np.flatnonzero(dark.sum(axis=1) >= width * 0.42))
    if len(ys) < 4 or ys[-1] - ys[0] < height * 0.08:
        return None
    xs = centres(np.flatnonzero(dark[ys[0] : ys[-1] + 1].sum(axis=0) >= (ys[-1] - ys[0]) * 0.65))
    if len(xs) < 4 or xs[-1] - xs[0] < width * 0.35:
        return None
    inked = [[dark[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].any() for x in xs] for y in ys]
    return (ys, xs) if all(sum(row) >= 0.7 * len(xs) for row in inked) else None


