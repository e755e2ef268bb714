"""Evaluation: acceptance of a sample set, formal accuracy of pages, comparison of resolutions; each ends in rows and a JSON report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import cjk_count, latin_count
from pageloom.operators import admission, scoring

# What the reports say.
PAGES_DIFFER = "标准答案与输出必须包含相同数量的页面，且至少一页。"
DPI_RANGE = "DPI 必须在 72–400 之间。"
NOTES = ("正式分数使用逐页 Levenshtein；差异样例仅用于诊断，不参与计分。", "参考文本、机器输出和完整结果均位于 Git 忽略目录。")
PPIS = (150, 300)


def run_id(at: Column | None = None, pattern: str = "yyyyMMdd-HHmmss-SSSSSS") -> Column:
    """A name for a run from its time, by default now, in the session's time zone."""
    return F.date_format(F.current_timestamp() if at is None else at, pattern)


def batch_name(at: Column | None = None) -> Column:
    return run_id(at, "yyyyMMdd_HHmmss")


def generated_at(at: Column | None = None) -> Column:
    """The time with its zone's offset, to seconds."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def acceptance(samples: DataFrame, files: DataFrame, reports: DataFrame) -> DataFrame:
    """A record for each sample: id, status, failures, characters, report.

    samples: id, filename, sha256, file_size and the thresholds of scoring.gate_failures;
    files: file_name, content; reports: id, text and the columns of scoring.gate_failures.
    A file that is not the one asked for is not judged further.
    """
    integrity = admission.integrity_errors(samples, files).withColumnRenamed("errors", "integrity")
    shown = F.struct(*[c for c in reports.columns if c not in ("id", "text")])
    judged = samples.join(integrity, "id").join(reports.withColumn("report", shown), "id", "left")
    failures = F.when(F.size("integrity") > 0, F.col("integrity")).otherwise(scoring.gate_failures(F.coalesce("text", F.lit(""))))
    read = F.size("integrity") == 0
    text = F.coalesce("text", F.lit(""))
    return judged.select(
        "id", failures.alias("failures"), F.when(read, F.length(text)).alias("output_characters"), F.when(read, F.struct(cjk_count(text).alias("cjk_characters"), latin_count(text).alias("latin_characters"))).alias("language_metrics"), F.when(read, F.col("report")).alias("report"),
    ).select("id", F.when(F.size("failures") > 0, "failed").otherwise("passed").alias("status"), "failures", "output_characters", "language_metrics", "report")


def acceptance_report(records: DataFrame, run: Column | None = None) -> DataFrame:
    """One row: json (the whole run with its records in order of their ids), exit_code (1 if a sample failed)."""
    failed = F.count_if(F.col("status") == "failed")
    own = F.array_sort(F.collect_list(F.struct(*records.columns)))  # a sample set is listed by hand
    whole = records.agg(F.count("*").alias("sample_count"), F.count_if(F.col("status") == "passed").alias("automated_passed"), failed.alias("automated_failed"), own.alias("records"))
    whole = whole.withColumn("run_id", run_id() if run is None else run)
    body = F.struct(F.lit(1).alias("schema_version"), "run_id", "sample_count", "automated_passed", "automated_failed", "records")
    return whole.select(F.to_json(body).alias("json"), F.when(F.col("automated_failed") > 0, 1).otherwise(0).alias("exit_code"))


def paired(reference: DataFrame, output: DataFrame) -> DataFrame:
    """doc_id, page_number, reference, output by place; error where a document's pages are not as many on both sides."""
    a, b = reference.select("doc_id", "page_number", F.col("text").alias("reference")), output.select("doc_id", "page_number", F.col("text").alias("output"))
    both = a.join(b, ["doc_id", "page_number"], "full_outer")
    lone = both.groupBy("doc_id").agg(F.count_if(F.col("reference").isNull() | F.col("output").isNull()).alias("lone"))
    return both.join(lone, "doc_id").select("doc_id", "page_number", "reference", "output", F.when(F.col("lone") > 0, PAGES_DIFFER).alias("pair_error"))


def formal_score(reference: DataFrame, output: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with accuracy, digests and differences; documents with the total and the gate).

    output: doc_id, page_number, text, recognition_model, preprocessing_profile.
    """
    both = paired(reference, output)
    pages = scoring.diagnose(scoring.page_accuracy(both.where("pair_error IS NULL")))
    stored = lambda c: F.sha2(F.concat(F.regexp_replace(c, r"\s+$", ""), F.lit("\n")).cast("binary"), 256)
    more = output.select("doc_id", "page_number", F.col("recognition_model").alias("ocr_recognition_model"), F.col("preprocessing_profile").alias("ocr_preprocessing_profile"))
    pages = pages.withColumns({"reference_sha256": F.sha2(F.col("reference").cast("binary"), 256), "output_sha256": stored("output")}).join(more, ["doc_id", "page_number"])
    models = pages.groupBy("doc_id").agg(F.array_sort(F.collect_set("ocr_recognition_model")).alias("recognition_models"), F.max("error").alias("error"))
    broken = both.where("pair_error IS NOT NULL").groupBy("doc_id").agg(F.max("pair_error").alias("pair_error"))
    total = scoring.total_accuracy(pages, ["doc_id"]).join(models, "doc_id").join(broken, "doc_id", "full_outer")
    return pages, total.select("doc_id", "reference_characters", "edit_distance", "accuracy", F.coalesce("passes_gate", F.lit(False)).alias("passes_release_gate"), "recognition_models", F.coalesce("pair_error", "error").alias("error"))


def score_report(pages: DataFrame, totals: DataFrame, profile: str = "standard", at: Column | None = None) -> DataFrame:
    """doc_id, json, exit_code (1: not scored, 2: below the gate) of each document."""
    page = F.struct("page_number", "reference_characters", "output_characters", "edit_distance", "accuracy", "reference_sha256", "output_sha256", "ocr_recognition_model", "ocr_preprocessing_profile", F.col("differences").alias("diagnostic_diff_samples"))
    own = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    body = F.struct(
        generated_at(at).alias("evaluated_at"), F.lit(scoring.VERSION).alias("scoring_version"), F.lit(profile).alias("ocr_profile"), "recognition_models", "reference_characters", "edit_distance", "accuracy", "passes_release_gate", "pages", F.array(*map(F.lit, NOTES)).alias("notes"))
    code = F.when(F.col("error").isNotNull(), 1).when(F.col("passes_release_gate"), 0).otherwise(2)
    return totals.join(own, "doc_id", "left").select("doc_id", F.when(F.col("error").isNull(), F.to_json(body)).alias("json"), code.alias("exit_code"))


def resolutions(spark: SparkSession, dpis: list[int] | None = None, ppis=PPIS) -> DataFrame:
    """source_ppi, render_dpi, name: every scan with every resolution asked for, each once."""
    wanted = list(dict.fromkeys(dpis or (150, 200, 300)))
    if any(not 72 <= d <= 400 for d in wanted):
        raise ValueError(DPI_RANGE)
    return spark.createDataFrame([(p, d, f"{p}ppi-{d}dpi") for p in ppis for d in wanted], "source_ppi int, render_dpi int, name string")


def resolution_report(wanted: DataFrame, results: DataFrame, truth: DataFrame) -> DataFrame:
    """The rows of `resolutions` with what results (name, recognition_model, text, line_count, mean_confidence, duration_seconds) say against truth (headers, rows)."""
    own = wanted.join(results, "name")
    each = own.select(F.xxhash64("name").alias("doc_id"), "text")
    facts = scoring.table_recall(own.select(F.xxhash64("name").alias("doc_id")).join(F.broadcast(truth.limit(1))), each)
    return own.withColumn("doc_id", F.xxhash64("name")).join(facts, "doc_id").drop("doc_id", "text")
