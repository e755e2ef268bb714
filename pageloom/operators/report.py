"""Per-file reports, batch summaries and what a user sees of them."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pageloom.functions.udf import arrow_function

# What a conversion may lose, by source and target format.
LOSSES = (
    (None, "txt", "TXT 不保留字体、颜色、精确列表样式、表格边框和图片本体。"),
    ("docx", None, "页眉页脚、批注、修订记录、文本框、宏、SmartArt 和精确分页可能丢失。"),
    ("docx", "markdown", "复杂表格、浮动图片位置和 Word 专有样式可能被简化。"),
    ("markdown", "docx", "部分 Markdown 扩展语法和 HTML/CSS 样式可能被简化。"),
    ("pdf", None, "TXT 无法保留 PDF 的字体、坐标、分页、图片和精确版式。"),
    ("pdf", None, "三栏以上或不规则分栏、公式和脚注的阅读顺序可能被简化。"),
    ("pdf", None, "跨页、嵌套或无明确边界的表格可能降级为普通文本。"),
    ("pdf", None, "OCR 页可能出现漏字、错字、空格变化或段落判断误差。"),
)
SAME_FORMAT = "源格式与目标格式相同，已跳过转换。"


def losses(source: Column, target: Column) -> Column:
    def hit(s: str | None, t: str | None) -> Column:
        return (F.lit(True) if s is None else source == s) & (F.lit(True) if t is None else target == t)

    return F.array_compact(F.array(*[F.when(hit(s, t), F.lit(text)) for s, t, text in LOSSES]))


def finish(jobs: DataFrame) -> DataFrame:
    """Report rows from jobs (source_file, target_file, source_format, target_format, skipped, error, warnings); other columns stay.

    A skipped job has no error but a warning; only a delivered one names its target.
    """
    ok = F.col("error").isNull() & ~F.col("skipped")
    warnings = F.coalesce("warnings", F.array().cast("array<string>"))
    own = ("source_file", "target_file", "source_format", "target_format", "skipped", "error", "warnings")
    return jobs.select(
        *[c for c in jobs.columns if c not in own],
        "source_file", F.when(ok, F.col("target_file")).otherwise("").alias("target_file"), "source_format", "target_format", ok.alias("success"), "skipped",
        F.when(F.col("skipped"), F.concat(warnings, F.array(F.lit(SAME_FORMAT)))).otherwise(warnings).alias("warnings"),
        F.when(ok, losses(F.col("source_format"), F.col("target_format"))).otherwise(F.array().cast("array<string>")).alias("possible_losses"),
        F.when(~F.col("skipped"), F.col("error")).alias("error"))


def batch_summary(reports: DataFrame, by: list[str]) -> DataFrame:
    """total, successful, skipped, failed and warning_total of each batch."""
    return reports.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("success").alias("successful"), F.count_if("skipped").alias("skipped"),
        F.count_if(~F.col("success") & ~F.col("skipped")).alias("failed"), F.sum(F.size("warnings") + F.size("possible_losses")).alias("warning_total"))


def report_json(reports: DataFrame) -> DataFrame:
    return reports.select("source_file", F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"}).alias("json"))


def status(success: Column, skipped: Column) -> Column:
    return F.when(success, "成功").when(skipped, "已跳过").otherwise("失败")


def shown_size(size: Column) -> Column:
    # format_number rounds the exact binary value, ties to even; format_string rounds ties up
    tenths = lambda x: F.call_function("format_number", x, F.lit("0.0"))
    return F.when(size < 1024, F.concat(size, F.lit(" B"))).when(size < 1024 * 1024, F.concat(tenths(size / 1024), F.lit(" KB"))).otherwise(F.concat(tenths(size / 1024 / 1024), F.lit(" MB")))


# Names of formats as they are shown, and the columns of the overview.
FORMATS = {"txt": "TXT", "markdown": "Markdown", "docx": "DOCX", "pdf": "PDF"}
WAITING, SAME = "等待转换", "源格式与目标格式相同"


def overview(reports: DataFrame) -> DataFrame:
    """The twelve columns that a user sees of each report (with stats, detected_encoding and duration_seconds where they are known)."""
    has = set(reports.columns)
    stat = lambda n: F.coalesce(F.col(f"stats.{n}"), F.lit(0)) if "stats" in has and n in reports.schema["stats"].dataType.names else F.lit(0)
    dash = lambda c: F.when(c.isNull() | (c == ""), "—").otherwise(c)
    return reports.select(
        F.col("source_file").alias("源文件"), status(F.col("success"), F.col("skipped")).alias("状态"), dash(F.col("target_file")).alias("输出文件"), dash(F.col("detected_encoding") if "detected_encoding" in has else F.lit(None).cast("string")).alias("编码"),
        stat("headings").alias("标题"), stat("lists").alias("列表"), stat("tables").alias("表格"), stat("code_blocks").alias("代码块"), stat("links").alias("链接"), stat("images").alias("图片"),
        (F.col("duration_seconds") if "duration_seconds" in has else F.lit(None).cast("double")).alias("耗时（秒）"), F.coalesce("error", F.lit("")).alias("错误"))


def preview(files: DataFrame, target: Column) -> DataFrame:
    """What is shown of files (file_name, length, source_format) before they are converted."""
    names = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    source = F.coalesce("source_format", F.lit("unknown"))
    return files.select(F.col("file_name").alias("文件名"), F.coalesce(F.try_element_at(names, source), source).alias("源格式"), shown_size(F.col("length")).alias("大小"), F.when(source == target, SAME).otherwise(WAITING).alias("处理状态"))


@arrow_function("binary")
def _zipped(files, summary):
    import pandas as pd

    def of(rows, text):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                z.writestr(r["name"], r["content"])
            z.writestr("batch_report.json", json.dumps(json.loads(text), ensure_ascii=False, indent=2))
        return buffer.getvalue()

    return pd.Series([of(f, s) for f, s in zip(files, summary, strict=True)])


def archives(outputs: DataFrame, reports: DataFrame, by: str) -> DataFrame:
    """One archive for each batch: outputs/ (batch, name, content), reports/ and batch_report.json."""
    own = reports.withColumn("name", F.regexp_replace("source_file", r"\.[^.]*$", "_report.json"))
    files = outputs.select(by, F.concat(F.lit("outputs/"), "name").alias("name"), "content").unionAll(own.select(by, F.concat(F.lit("reports/"), "name"), F.to_json(F.struct(*[c for c in reports.columns if c != by])).cast("binary")))
    grouped = files.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("name", "content"))).alias("files"))
    rows = F.array_sort(F.collect_list(F.struct("source_file", *[c for c in reports.columns if c not in (by, "source_file")])))
    summary = reports.groupBy(by).agg(F.to_json(F.struct(F.count("*").alias("total"), F.count_if("success").alias("successful"), F.count_if("skipped").alias("skipped"), F.count_if(~F.col("success") & ~F.col("skipped")).alias("failed"), rows.alias("reports"))).alias("summary"))
    return grouped.join(summary, by).select(by, _zipped("files", "summary").alias("archive"))
