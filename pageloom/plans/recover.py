"""Text recovery of paginated documents as one plan: classify, lay out, route, recognise, clean up, join.

The relations come from readers and engines (sources.engines) or from tables of the
same columns. Everything is keyed by document and page, so the only large moves are
the joins on that key and one on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import normalize, ordered_distinct
from pageloom.operators import cleanup, layout, ocr, pages

KEY = ["doc_id", "page_number"]
# What is said about routes and requests.
PICTURES_LEFT = " 页的原生文字层质量正常，未对页内图片重复 OCR；图片中额外文字可能未提取。"
COUNTS_DIFFER = "PDF 分类与文字提取得到的页数不一致。"
NO_PAGES = "OCR 至少需要一个页码。"
FROM_ONE = "OCR 页码必须从 1 开始。"
REPEATED = "OCR 页码不能重复。"
ASCENDING = "OCR 页码必须按升序排列。"
OLD_PRINT = "已启用实验性旧印刷体增强（300 DPI 与轻度去噪）；请与默认模式逐页对照，不能仅凭 OCR 置信度判断准确率。"

_NONE = "array<string>"


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def settled(df: DataFrame) -> DataFrame:
    """The rows cut from the plan that made them: checkpointed in the shared folder of spark.checkpoint.dir, or persisted where that is unset."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def native_pages(words: DataFrame, width: float, height: float, tables: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """The text layer of each page in reading order, with its counts.

    raw (doc_id, page_number, text), the reader's own text, stands in where the layout
    gives none; a page that only raw has is kept.
    """
    laid = layout.page_texts(words, width, height, tables)
    laid = laid.withColumn("text", normalize(F.col("text"))).withColumn("table_fallback_count", F.lit(0))
    if raw is None:
        return laid
    plain = raw.select(*KEY, normalize(F.col("text")).alias("plain"))
    both = laid.join(plain, KEY, "full_outer")
    return both.select(
        *KEY, F.when(F.coalesce("text", F.lit("")) == "", F.coalesce("plain", F.lit(""))).otherwise(F.col("text")).alias("text"), F.coalesce("column_count", F.lit(1)).alias("column_count"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("structured_table_count", "complex_table_count", "table_fallback_count")], _list(F.col("warnings")).alias("warnings"))


def count_errors(classified: DataFrame, native: DataFrame) -> DataFrame:
    """doc_id, error of documents whose classified and extracted pages differ in number."""
    a, b = (d.groupBy("doc_id").agg(F.count("*").alias(c)) for d, c in ((classified, "a"), (native, "b")))
    return a.join(b, "doc_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id", F.lit(COUNTS_DIFFER).alias("error"))


def request_error(numbers: Column, page_count: Column | None = None) -> Column:
    """The first rule that a list of requested pages breaks, or null."""
    n = F.size(numbers)
    last = F.element_at(numbers, -1)
    error = F.when(numbers.isNull() | (n == 0), NO_PAGES).when(F.exists(numbers, lambda p: p <= 0), FROM_ONE).when(F.size(F.array_distinct(numbers)) != n, REPEATED).when(F.array_sort(numbers) != numbers, ASCENDING)
    if page_count is not None:
        error = error.when(last > page_count, F.concat(F.lit("PDF 仅有 "), page_count, F.lit(" 页，不存在第 "), last, F.lit(" 页。")))
    return error


def routed(classified: DataFrame, native: DataFrame) -> DataFrame:
    """pages.route with each page's warnings, and the layout's counts."""
    out = pages.route(classified, native)
    n, extra = F.col("page_number"), native.select(*KEY, "column_count", "structured_table_count", "complex_table_count", "table_fallback_count", F.col("warnings").alias("layout_warnings"))
    out = out.join(extra, KEY, "left")
    said = F.transform(_list(F.col("layout_warnings")), lambda w: F.concat(F.lit("第 "), n, F.lit(" 页："), w))
    moved = F.transform(_list(F.col("quality_warnings")), lambda w: F.concat(F.lit("第 "), n, F.lit(" 页："), w, F.lit("已改用离线 OCR。")))
    pictured = (F.col("mode") == "native") & (F.col("kind") == "mixed") & (F.col("image_count") > 0)
    note = F.when(F.col("note").isNotNull(), F.array(F.concat(F.lit("第 "), n, F.lit(" 页："), F.col("note"))))
    own = F.concat(_list(note), said, _list(F.when(pictured, F.array(F.concat(F.lit("第 "), n, F.lit(PICTURES_LEFT))))), _list(F.when((F.col("mode") == "ocr") & (F.col("kind") != "scanned"), moved)))
    return out.withColumn("page_warnings", own)


def requests(routes: DataFrame) -> DataFrame:
    """doc_id, page_number of the pages to recognise."""
    return routes.where(F.col("mode") == "ocr").select(*KEY)


def recognised(blocks: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Pages from recognised blocks: text in order, confidence, margins removed, warnings; models: doc_id, page_number, recognition_model, preprocessing_profile."""
    read = ocr.read_pages(blocks).join(ocr.confidence(blocks), KEY)
    read = ocr.warnings(cleanup.remove_marginals(read))
    if models is not None:
        return read.join(models, KEY, "left")
    return read.withColumns({c: F.lit(None).cast("string") for c in ("recognition_model", "preprocessing_profile")})


def recover(classified: DataFrame, native: DataFrame, read: DataFrame) -> DataFrame:
    """The pages of every document after clean-up, with source, text, quality, counts and warnings.

    classified: pages.classify; native: native_pages; read: recognised. A page that
    should have been recognised and wasn't sets error on all pages of its document.
    Routes, recognised and merged pages are read several times and settled first.
    """
    routes, read = settled(routed(classified, native)), settled(read)
    merged = settled(pages.merge(routes, read))
    cleaned = cleanup.clean_pages(merged.select(*KEY, "source", "text"))
    more = routes.select(*KEY, "kind", "image_count", "column_count", "structured_table_count", "complex_table_count", "table_fallback_count", "page_warnings")
    seen = read.select(*KEY, "printed_page_numbers", "recognition_model", "preprocessing_profile", F.col("warnings").alias("ocr_warnings"))
    out = merged.drop("text").join(cleaned.select(*KEY, "text"), KEY).join(more, KEY).join(seen, KEY, "left")
    native_only = F.col("source") == "native"
    counts = [F.when(native_only, F.col(c)).otherwise(F.lit(default)).alias(c) for c, default in (("column_count", 1), ("structured_table_count", 0), ("complex_table_count", 0), ("table_fallback_count", 0))]
    return out.select(
        *KEY, "source", "text", "kind", "image_count", "native_quality_score", "ocr_mean_confidence", *counts, _list(F.col("printed_page_numbers")).alias("printed_page_numbers"), "recognition_model", "preprocessing_profile",
        F.concat(_list(F.col("page_warnings")), F.when(F.col("source") == "ocr", _list(F.col("ocr_warnings"))).otherwise(F.array().cast(_NONE))).alias("warnings"), "error")


def documents(found: DataFrame, profile: str = "standard") -> DataFrame:
    """One row for each document of recovered pages: text, page lists, sums, warnings in order without repeats, error."""
    found = settled(found)
    text = pages.documents(found)
    kinds = pages.document_kinds(found)
    double = F.array_sort(F.collect_list(F.when(F.col("column_count") == 2, F.col("page_number"))))
    bags = F.array_sort(F.collect_list(F.struct("page_number", "warnings")))
    sums = found.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("structured_table_count", "complex_table_count", "table_fallback_count", "image_count")], double.alias("double_column_page_numbers"), bags.alias("bags"), F.first("error", ignorenulls=True).alias("error"))
    said = F.flatten(F.transform("bags", lambda b: b["warnings"]))
    first = F.array(F.lit(OLD_PRINT)) if profile == "old_print" else F.array().cast(_NONE)
    said = ordered_distinct(F.concat(F.when(F.size("ocr_page_numbers") > 0, first).otherwise(F.array().cast(_NONE)), said))
    return text.join(kinds, "doc_id").join(sums, "doc_id").withColumn("warnings", said).withColumn("ocr_profile", F.lit(profile)).drop("bags")


def details(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, details: what a report says about a recovered document and each of its pages."""
    page = F.struct("page_number", "source", "native_quality_score", "ocr_mean_confidence", "column_count", "structured_table_count", "complex_table_count", "table_fallback_count", "printed_page_numbers", F.col("recognition_model").alias("ocr_recognition_model"), F.col("preprocessing_profile").alias("ocr_preprocessing_profile"), "warnings")
    own = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    fields = [F.col("document_kind").alias("pdf_kind"), "page_count", "text_pages", "scanned_pages", "mixed_pages", F.col("empty_pages").alias("empty_page_count"), "native_page_numbers", "ocr_page_numbers", F.col("empty_page_numbers").alias("skipped_empty_page_numbers"), "double_column_page_numbers", "structured_table_count", "complex_table_count", "table_fallback_count", "ocr_profile", "pages"]
    return docs.join(own, "doc_id").select("doc_id", F.struct(*fields).alias("details"))
