"""Quality-set manifests and reference pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.admission import manifest_errors

SAMPLE = "id string, filename string, source_url string, source_page_url string, source_repository string, source_revision string, source_revision_kind string, source_license string, redistribution string, sha256 string, file_size long, language string, categories array<string>, expected_page_count long, acceptance map<string,string>, manual_review map<string,string>"


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The samples of a manifest (ord from 1), and the rows (ord, id, error) that break a rule; ord 0 is the manifest's own."""
    raw = spark.read.schema(f"schema_version int, samples array<struct<{', '.join(x.replace(' ', ':', 1) for x in SAMPLE.split(', '))}>>").json(path, multiLine=True)
    samples = raw.select(F.posexplode("samples").alias("i", "s")).select((F.col("i") + 1).alias("ord"), "s.*")
    whole = raw.select(F.lit(0).alias("ord"), F.lit(None).cast("string").alias("id"), F.when(~F.col("schema_version").eqNullSafe(1), "PDF 样例清单 schema_version 必须为 1。").when(F.coalesce(F.size("samples"), F.lit(0)) == 0, "PDF 样例清单至少需要一个样例。").alias("error"))
    return samples, whole.unionAll(manifest_errors(samples)).where("error IS NOT NULL")


def select_samples(samples: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """The wanted samples in the wanted order, each once, and the ids that no sample has; all without a wish."""
    if not wanted:
        return samples, []
    order = {x: k for k, x in reversed(list(enumerate(wanted)))}
    asked = samples.sparkSession.createDataFrame(list(order.items()), "id string, turn long")
    missing = [r.id for r in asked.join(samples, "id", "left_anti").orderBy("id").collect()]
    return samples.join(F.broadcast(asked), "id").orderBy("turn").drop("turn"), missing


def reference_pages(spark: SparkSession, paths, expected: DataFrame) -> DataFrame:
    """file_name, text and error of text files against expected digests (file_name, sha256, characters)."""
    files = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    both = expected.join(files, "file_name", "left")
    text = F.decode("content", "UTF-8")
    error = F.when(F.col("content").isNull(), "文件不存在。").when(F.sha2("content", 256) != F.lower("sha256"), "SHA-256 不一致。").when(F.length(text) != F.col("characters"), "字符数不一致。")
    return both.select("file_name", text.alias("text"), error.alias("error"))
