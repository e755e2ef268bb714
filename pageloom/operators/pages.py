"""Pages: classification, route, merge with recognised text, document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.boxes import clipped_area
from pageloom.functions.text import ordered_distinct, rounded, strip, with_quality

KINDS = ("text", "scanned", "mixed", "empty")
# What is said about a page of each kind.
KIND_NOTES = {
    "mixed": "页面同时包含文字层和大面积图片，后续需要检查文字层质量。",
    "scanned": "页面缺少足够文字层，需要离线 OCR。",
    "empty": "页面未检测到文字或图片。",
}


def page_kind(chars: Column, images: Column, coverage: Column, least_chars: int = 20, dominant: float = 0.5) -> Column:
    """Kind of a page; null where a count is negative or the coverage outside 0 to 1."""
    bad = chars.isNull() | images.isNull() | coverage.isNull() | (chars < 0) | (images < 0) | (coverage < 0) | (coverage > 1) | F.isnan(coverage)
    pictured = (images > 0) & (coverage >= dominant)
    return (
        F.when(bad, F.lit(None).cast("string"))
        .when((chars == 0) & (images > 0), "scanned").when(chars == 0, "empty")
        .when(pictured & (chars < least_chars), "scanned").when(pictured, "mixed").otherwise("text")
    )


def kind_error(chars: Column, images: Column, coverage: Column) -> Column:
    return F.when((chars < 0) | (images < 0), "页面文字数和图片数不能为负数。").when((coverage < 0) | (coverage > 1) | F.isnan(coverage), "图片覆盖率必须位于 0 到 1 之间。")


def page_metrics(pages: DataFrame, chars: DataFrame, images: DataFrame) -> DataFrame:
    """pages (doc_id, page_number, width, height) with text_char_count, image_count and image_coverage_ratio."""
    key = ["doc_id", "page_number"]
    text = chars.groupBy(*key).agg(F.sum(F.length(strip(F.col("text")))).alias("n"))
    area = clipped_area(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom"), F.col("width"), F.col("height"))
    pictures = images.join(pages.select(*key, "width", "height"), key).groupBy(*key).agg(F.count("*").alias("image_count"), F.sum(area).alias("area"))
    out = pages.join(text, key, "left").join(pictures, key, "left")
    coverage = F.least(F.lit(1.0), F.coalesce("area", F.lit(0.0)) / (F.col("width") * F.col("height")))
    return out.select(*pages.columns, F.coalesce("n", F.lit(0)).cast("int").alias("text_char_count"), F.coalesce("image_count", F.lit(0)).cast("int").alias("image_count"), coverage.alias("image_coverage_ratio"))


def classify(pages: DataFrame) -> DataFrame:
    """The pages with kind and note; coverage is rounded after the decision."""
    kind = page_kind(F.col("text_char_count"), F.col("image_count"), F.col("image_coverage_ratio"))
    notes = F.create_map(*[F.lit(x) for pair in KIND_NOTES.items() for x in pair])
    out = pages.withColumn("kind", kind)
    return out.withColumn("image_coverage_ratio", rounded(F.col("image_coverage_ratio"), 4)).withColumn("note", F.try_element_at(notes, F.col("kind")))


def document_kinds(pages: DataFrame) -> DataFrame:
    """doc_id, document_kind, page_count and the pages of each kind."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}_pages") for k in KINDS]
    n = F.count_distinct(F.when(F.col("kind") != "empty", F.col("kind")))
    only = F.min(F.when(F.col("kind") != "empty", F.col("kind")))
    return pages.groupBy("doc_id").agg(F.when(n == 0, "empty").when(n == 1, only).otherwise("mixed").alias("document_kind"), F.count("*").alias("page_count"), *kinds)


def route(pages: DataFrame, native: DataFrame) -> DataFrame:
    """pages (with kind) and native text (doc_id, page_number, text) to mode empty, native or ocr, with the text layer's quality."""
    checked = with_quality(native.select("doc_id", "page_number", "text")).select("doc_id", "page_number", F.col("text").alias("native_text"), "score", "acceptable", F.col("warnings").alias("quality_warnings"))
    out = pages.join(checked, ["doc_id", "page_number"], "left")
    mode = F.when(F.col("kind") == "empty", "empty").when((F.col("kind") == "scanned") | ~F.coalesce("acceptable", F.lit(False)), "ocr").otherwise("native")
    return out.withColumn("mode", mode).withColumn("score", F.when(F.col("kind") != "empty", F.col("score")))


def merge(routed: DataFrame, ocr: DataFrame) -> DataFrame:
    """doc_id, page_number, source, text, native_quality_score, ocr_mean_confidence: the text of each page from its route.

    A document with a page that needed recognition and has none fails as a whole:
    error is set on all its pages and their text is empty.
    """
    read = ocr.select("doc_id", "page_number", F.col("text").alias("ocr_text"), F.col("mean_confidence").alias("confidence"), F.lit(True).alias("read"))
    out = routed.join(read, ["doc_id", "page_number"], "left")
    lost = (F.col("mode") == "ocr") & F.col("read").isNull()
    failed = out.groupBy("doc_id").agg(F.min(F.when(lost, F.col("page_number"))).alias("lost"))
    out = out.join(failed, "doc_id")
    text = F.when(F.col("lost").isNotNull() | (F.col("mode") == "empty"), F.lit("")).when(F.col("mode") == "native", F.col("native_text")).otherwise(F.col("ocr_text"))
    error = F.when(F.col("lost").isNotNull(), F.concat(F.lit("第 "), F.col("lost"), F.lit(" 页没有 OCR 结果。")))
    return out.select("doc_id", "page_number", F.col("mode").alias("source"), text.alias("text"), F.col("score").alias("native_quality_score"), F.when(F.col("mode") == "ocr", F.col("confidence")).alias("ocr_mean_confidence"), error.alias("error"))


def documents(pages: DataFrame) -> DataFrame:
    """doc_id, text (pages that are not blank, an empty line between), page lists of each route, warnings in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "source", "text")))
    out = pages.groupBy("doc_id").agg(ordered.alias("p"), F.avg("ocr_mean_confidence").alias("mean_confidence"))
    texts = F.filter(F.transform("p", lambda x: x["text"]), lambda t: t.rlike(r"[^\p{IsWhite_Space}\x1c-\x1f]"))
    body = F.array_join(texts, "\n\n")
    def pages_from(source: str) -> Column:
        return F.transform(F.filter("p", lambda x: x["source"] == source), lambda x: x["page_number"])

    lists = [pages_from(s).alias(f"{s}_page_numbers") for s in ("native", "ocr", "empty")]
    return out.select("doc_id", F.when(body != "", F.concat(body, F.lit("\n"))).otherwise("").alias("text"), *lists, "mean_confidence")


def warnings_of(*lists: Column) -> Column:
    """Bags of messages as one list of first occurrences."""
    return ordered_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
