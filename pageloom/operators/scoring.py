"""Character accuracy, acceptance gates and table recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import cjk_count, latin_count, rounded
from pageloom.functions.unicode import differences, scoring_form

GATE = 0.9
VERSION = "pdf-character-accuracy-v1"  # a fixed value: the scoring's name in reports


def page_accuracy(pages: DataFrame, normal: bool = False) -> DataFrame:
    """The pages (..., reference, output) with their characters, distance, accuracy and error; normal: texts are in scoring form."""
    form = (lambda c: F.col(c)) if normal else (lambda c: scoring_form(F.coalesce(F.col(c), F.lit(""))))
    out = pages.withColumn("__r", form("reference")).withColumn("__o", form("output")).withColumn("edit_distance", F.levenshtein("__r", "__o"))
    n = F.length("__r")
    return out.select(
        *pages.columns, n.alias("reference_characters"), F.length("__o").alias("output_characters"), "edit_distance",
        F.when(n > 0, F.greatest(F.lit(0.0), 1 - F.col("edit_distance") / n)).alias("accuracy"),
        F.when(n == 0, "标准答案为空，不能计算准确率。").alias("error"),
    )


def total_accuracy(pages: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy over all characters of each group, and whether it passes the gate."""
    out = pages.groupBy(*by).agg(F.sum("reference_characters").alias("reference_characters"), F.sum("edit_distance").alias("edit_distance"))
    accuracy = F.when(F.col("reference_characters") > 0, F.greatest(F.lit(0.0), 1 - F.col("edit_distance") / F.col("reference_characters")))
    return out.withColumn("accuracy", accuracy).withColumn("passes_gate", F.coalesce(F.col("accuracy") >= GATE, F.lit(False)))


def diagnose(pages: DataFrame) -> DataFrame:
    """The pages with up to 12 differences of each."""
    return pages.withColumn("differences", differences(scoring_form("reference"), scoring_form("output")))


def gate_failures(text: Column) -> Column:
    """Messages of the thresholds that a report row misses. A null threshold is no check.

    Columns: success, error, page_count, pdf_kind, native_pages, ocr_pages, empty_pages,
    structured_table_count, complex_table_count, mean_confidence, warnings; and the
    thresholds expected_page_count, expected_pdf_kind, expected_native_pages,
    expected_ocr_pages, expected_empty_pages, min_output_characters, min_cjk_characters,
    min_latin_characters, min_structured_tables, min_complex_tables,
    min_ocr_mean_confidence, required_warning_contains.
    """
    c = F.col
    shown = lambda x: F.coalesce(c(x).cast("string"), F.lit("None"))

    def below(actual: Column, threshold: str, default: int, message: str) -> Column:
        return F.when(actual < F.coalesce(c(threshold), F.lit(default)), message)

    checks = [F.when(~c("page_count").eqNullSafe(c("expected_page_count")), F.concat(F.lit("页数期望 "), shown("expected_page_count"), F.lit("，实际 "), shown("page_count"), F.lit("。")))]
    checks.append(F.when((c("expected_pdf_kind") != "") & ~c("pdf_kind").eqNullSafe(c("expected_pdf_kind")), F.concat(F.lit("PDF 类型期望 "), c("expected_pdf_kind"), F.lit("，实际 "), shown("pdf_kind"), F.lit("。"))))
    for k in ("native", "ocr", "empty"):
        actual, wanted = F.coalesce(c(f"{k}_pages"), F.lit(0)), f"expected_{k}_pages"
        checks.append(F.when(actual != c(wanted), F.concat(F.lit(f"{wanted} 期望 "), c(wanted), F.lit("，实际 "), actual, F.lit("。"))))
    checks += [
        below(F.length(text), "min_output_characters", 1, "输出可见字符数低于阈值。"),
        below(cjk_count(text), "min_cjk_characters", 0, "输出中日韩统一表意文字数低于阈值。"),
        below(latin_count(text), "min_latin_characters", 0, "输出拉丁字母数低于阈值。"),
        below(F.coalesce(c("structured_table_count"), F.lit(0)), "min_structured_tables", 0, "结构化表格数低于阈值。"),
        below(F.coalesce(c("complex_table_count"), F.lit(0)), "min_complex_tables", 0, "复杂表格数低于阈值。"),
        F.when(F.coalesce(c("mean_confidence"), F.lit(0.0)) < c("min_ocr_mean_confidence"), F.concat(F.lit("OCR 平均置信度低于阈值：期望至少 "), c("min_ocr_mean_confidence"), F.lit("，实际 "), F.format_string("%.4f", F.coalesce(c("mean_confidence"), F.lit(0.0))), F.lit("。"))),
        F.when((c("required_warning_contains") != "") & ~F.exists("warnings", lambda w: w.contains(F.col("required_warning_contains"))), F.concat(F.lit("未生成期望警告："), c("required_warning_contains"), F.lit("。"))),
    ]
    failed = F.array(F.coalesce(c("error"), F.lit("转换失败")))
    return F.when(~F.coalesce(c("success"), F.lit(False)), failed).otherwise(F.array_compact(F.array(*checks)))


def table_recall(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per doc_id: found and all cells, recall, row order and tab rows.

    truth: doc_id, headers, rows; outputs: doc_id, text. Cells are found anywhere in the
    text's compact form; rows are in order by their second cell.
    """
    both = truth.join(outputs, "doc_id").withColumn("__compact", scoring_form("text"))
    cells = both.select("doc_id", "__compact", F.posexplode(F.flatten(F.concat(F.array("headers"), F.col("rows")))).alias("i", "cell"))
    found = cells.withColumn("found", F.contains("__compact", scoring_form("cell"))).groupBy("doc_id").agg(
        F.count_if("found").alias("matched_cells"), F.count("*").alias("total_cells"), F.array_sort(F.collect_list(F.when(~F.col("found"), F.struct("i", "cell")))).alias("missing"))
    rows = both.select("doc_id", "__compact", F.posexplode("rows").alias("i", "row"))
    at = rows.withColumn("at", F.instr(F.col("__compact"), scoring_form(F.get("row", F.lit(1))))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "at"))).alias("p"))
    order = at.select("doc_id", F.forall(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda k: (F.size("p") < 2) | ((F.get("p", k - 1)["at"] > 0) & (F.get("p", k)["at"] > F.get("p", k - 1)["at"]))).alias("row_order_ok"))
    fields = F.transform(F.filter(F.split("text", "\n"), lambda x: x.contains("\t")), lambda x: F.split(x, "\t"))
    tabbed = F.size(F.filter(fields, lambda f: (F.size(f) == F.size("headers")) & (F.size(F.filter(f, lambda x: F.trim(x) != "")) >= 2)))
    tabs = both.select("doc_id", tabbed.alias("tabular_rows"), (tabbed >= F.size("rows") + 1).alias("structure_restored"))
    return found.join(order, "doc_id").join(tabs, "doc_id").select(
        "doc_id", "matched_cells", "total_cells", rounded(F.col("matched_cells") / F.col("total_cells"), 4).alias("cell_recall"),
        F.col("missing.cell").alias("missing_cells"), "row_order_ok", "tabular_rows", "structure_restored")
