"""Conversion of files between TXT, Markdown and DOCX, with a report for each file; one narrow pass and two small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.unicode import decode
from pageloom.model import TARGETS
from pageloom.operators import admission, report, structure
from pageloom.sources import files, writers

STATS = {"headings": "heading", "lists": "list", "tables": "table", "code_blocks": "code"}
# Warnings about containers.
MACROS = "DOCX 包含宏项目；转换不会执行宏，宏内容可能丢失。"
EMBEDDED = "DOCX 包含 OLE 嵌入对象；转换不会执行嵌入对象，相关内容可能丢失。"
LINKED = "DOCX 包含外部链接或资源关系；转换不会主动下载远程内容。"
NO_PDF = "PDF parsing is a plug-in: supply pages, words and ocr_blocks"


def containers(rows: DataFrame) -> DataFrame:
    """doc_id, container_error, container_warnings of DOCX files."""
    entries, broken = files.zip_entries(rows)
    low = F.lower("name")
    notes = F.array_compact(F.array(
        F.when(F.max(low.endswith("/vbaproject.bin") | (low == "vbaproject.bin")), MACROS), F.when(F.max(low.startswith("word/embeddings/")), EMBEDDED), F.when(F.max("external_links"), LINKED)))
    found = entries.groupBy("doc_id").agg(notes.alias("notes"), F.max(F.when(F.col("actual_size") != F.col("file_size"), F.concat(F.lit("DOCX ZIP 条目大小与目录记录不一致："), "name"))).alias("size_error"))
    own = admission.inspect_archives(entries).select("doc_id", F.col("error").alias("rule"))
    return rows.select("doc_id").join(broken.withColumnRenamed("error", "broken"), "doc_id", "left").join(own, "doc_id", "left").join(found, "doc_id", "left").select("doc_id", F.coalesce("rule", "broken", "size_error").alias("container_error"), F.col("notes").alias("container_warnings"))


def counted(blocks: Column, kind: str) -> Column:
    return F.size(F.filter(blocks, lambda b: b["kind"] == kind))


def convert(rows: DataFrame, target: str) -> DataFrame:
    """Report columns, stats and output (binary, null unless delivered) for files (doc_id, file_name, length, content)."""
    named = admission.name_error(F.col("file_name"))
    out = admission.admit(rows, F.lit(target)).withColumn("skipped", F.col("skipped") & named.isNull()).withColumn("error", F.coalesce(named, "error"))
    out = out.withColumn("error", F.when(~F.col("skipped"), F.coalesce("error", F.when(F.col("source_format") == "pdf", NO_PDF))))
    checked = containers(out.where("source_format = 'docx' AND error IS NULL AND NOT skipped").select("doc_id", "content"))
    out = out.join(checked, "doc_id", "left").withColumn("error", F.coalesce("error", "container_error"))
    live = F.col("error").isNull() & ~F.col("skipped")
    text = F.when(live & (F.col("source_format") == "txt"), F.col("content"))
    out = out.withColumn("d", decode(F.coalesce(text, F.lit("-").cast("binary"))))
    out = structure.to_markdown(out.withColumn("text", F.when(text.isNotNull(), F.col("d.text"))))
    body = F.when(F.col("source_format") == "txt", F.col("markdown").cast("binary")).otherwise(F.col("content"))
    out = out.withColumn("p", files.parse(F.when(live, body).otherwise(F.lit("").cast("binary")), F.when(F.col("source_format") == "docx", "docx").otherwise("markdown")))
    error = F.coalesce("error", F.when(text.isNotNull(), F.col("d.error")), F.when(live, F.col("p.error")))
    out = out.withColumn("failure", error)
    blocks: Column = F.col("p.blocks")
    written = {"txt": writers.plain(blocks).cast("binary"), "markdown": structure.tidy_separators(writers.gfm(blocks)).cast("binary"), "docx": writers.docx(blocks)}[target]
    stem = F.regexp_replace(admission.clean_name(F.col("file_name")), r"\.[^.]*$", "")
    jobs = out.select(
        "doc_id", F.col("file_name").alias("source_file"), F.concat(stem, F.lit(TARGETS[target])).alias("target_file"), "source_format", F.lit(target).alias("target_format"), "skipped", F.col("failure").alias("error"),
        F.concat(F.coalesce("container_warnings", F.array().cast("array<string>")), F.when(text.isNotNull(), F.col("warnings")).otherwise(F.array().cast("array<string>"))).alias("warnings"), F.when(text.isNotNull(), F.col("d.encoding")).alias("detected_encoding"),
        F.struct(*[counted(blocks, k).alias(n) for n, k in STATS.items()]).alias("stats"), F.when(F.col("failure").isNull() & ~F.col("skipped"), written).alias("output"))
    return report.finish(jobs)
