"""The tables of the test data as the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 612.0, 792.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each line item."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("page_number"),
        F.when(F.col("l_quantity") < 8, 0).otherwise(F.col("l_quantity")).cast("int").alias("text_char_count"),
        F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("image_count"), (F.round("l_discount", 2) * 10).alias("image_coverage_ratio"))


PAGES_SQL = """pages_ AS (
  SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS page_number,
         CAST(CASE WHEN l_quantity < 8 THEN 0 ELSE l_quantity END AS INTEGER) AS text_char_count, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS image_count, round(l_discount, 2) * 10 AS image_coverage_ratio
  FROM lineitem
), kinds AS (
  SELECT *, CASE WHEN text_char_count = 0 AND image_count > 0 THEN 'scanned' WHEN text_char_count = 0 THEN 'empty'
                 WHEN image_count > 0 AND image_coverage_ratio >= 0.5 AND text_char_count < 20 THEN 'scanned' WHEN image_count > 0 AND image_coverage_ratio >= 0.5 THEN 'mixed' ELSE 'text' END AS kind
  FROM pages_
)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents whose pages have a common head line."""
    text = F.concat(F.lit("Report "), F.col("conv_id") % 7, F.lit("\n"), F.col("text"), F.lit("\np "), F.col("turn"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.when(F.col("role") == "user", "native").otherwise("ocr").alias("source"), text.alias("text"))


TURNS_SQL = """turns AS (
  SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_number, CASE WHEN role = 'user' THEN 'native' ELSE 'ocr' END AS source,
         'Report ' || (conv_id % 7) || chr(10) || text || chr(10) || 'p ' || turn AS text FROM conversations
)"""


#: Lines of a page of words.
LINES = 45


def words(spark: SparkSession, d: str) -> DataFrame:
    """Line items as words of pages with one, two or three columns; a page takes LINES lines, the rest goes on to the next of its kind."""
    w = Window.partitionBy("l_suppkey", "columns").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    # dealt by document, so that what groups by page needs no further exchange
    li = table(spark, d, "lineitem").withColumn("columns", (F.col("l_orderkey") % 3 + 1).cast("int")).repartition("l_suppkey").withColumn("nth", F.row_number().over(w) - 1)
    full = LINES * F.col("columns")
    li = li.withColumn("page_number", (F.floor(F.col("nth") / full) * 3).cast("int") + F.col("columns")).withColumn("word_idx", F.pmod("nth", full))
    line, lane, q = F.floor(F.col("word_idx") / F.col("columns")).cast("int"), F.col("word_idx") % F.col("columns"), F.col("l_quantity") % 10
    one, two = F.col("columns") == 1, F.col("columns") == 2
    return li.select(
        F.col("l_suppkey").alias("doc_id"), "page_number", "columns", "word_idx", line.alias("line_no"), lane.alias("lane"), F.concat("l_returnflag", "l_linestatus", "l_partkey").alias("text"),
        F.when(one, 60.0).when(two, 60.0 + 272 * lane).otherwise(45.0 + 177 * lane).alias("x0"), F.when(one, 500 + q).when(two, 250 + 272 * lane + q).otherwise(200 + 177 * lane + q).alias("x1"),
        (60.0 + 14 * line).alias("top"), (70.0 + 14 * line).alias("bottom"), F.lit(True).alias("upright"), (0.5 + F.round(F.col("l_discount") * 100) / 32).alias("score"))


WORDS_SQL = f"""words AS (
  SELECT l_suppkey AS doc_id, CAST(nth // ({LINES} * columns) * 3 + columns AS INTEGER) AS page_number, columns, CAST(word_idx AS INTEGER) AS word_idx, CAST(word_idx // columns AS INTEGER) AS line_no, CAST(word_idx % columns AS INTEGER) AS lane, l_returnflag || l_linestatus || l_partkey AS text,
         CASE columns WHEN 1 THEN 60.0::DOUBLE WHEN 2 THEN 60.0 + 272 * (word_idx % columns) ELSE 45.0 + 177 * (word_idx % columns) END AS x0,
         CASE columns WHEN 1 THEN 500 + l_quantity % 10 WHEN 2 THEN 250 + 272 * (word_idx % columns) + l_quantity % 10 ELSE 200 + 177 * (word_idx % columns) + l_quantity % 10 END AS x1,
         60.0::DOUBLE + 14 * (word_idx // columns) AS top, 70.0::DOUBLE + 14 * (word_idx // columns) AS bottom, 0.5::DOUBLE + round(l_discount * 100) / 32 AS score
  FROM (SELECT *, nth % ({LINES} * columns) AS word_idx FROM (SELECT *, CAST(l_orderkey % 3 + 1 AS INTEGER) AS columns, row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS nth FROM lineitem))
)"""


def ocr_blocks(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).select("doc_id", "page_number", F.col("word_idx").alias("source_index"), "text", "score", "top", F.col("x0").alias("left"), "bottom", F.col("x1").alias("right"), F.lit(True).alias("has_geometry"))


_LINES = """concat_ws(chr(10), '第' || (k + 1) || '章 ' || n_name, '', r_name || ' overview', '', '1.' || (k % 5 + 1) || ' ' || n_name, '', '一、甲', '二、乙', '', '- ' || n_name, '- ' || r_name, '',
  'name' || chr(9) || 'qty', n_name || chr(9) || k, '', '    code ' || k, '', '（一）' || r_name, '', 'Plain text of ' || n_name || ', continued', 'on a second line.', '', '7. ' || n_name, '')"""


def structured_texts(spark: SparkSession, d: str) -> DataFrame:
    """A text for each nation that uses the line rules."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr("CAST(n_nationkey AS BIGINT) AS doc_id", "n_nationkey AS k", "n_name", "r_name").selectExpr("doc_id", f"{_LINES} AS text")


STRUCTURED_SQL = f"""texts AS (
  SELECT doc_id, {_LINES} AS text FROM (SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
)"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files to convert, in batches by customer."""
    k = F.col("o_orderkey")
    ext = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".docx", ".pdf", ".xyz"))), (k % 5 + 1).cast("int"))
    target = F.element_at(F.array(*map(F.lit, ("txt", "markdown", "docx"))), (k % 3 + 1).cast("int"))
    return table(spark, d, "orders").select(k.alias("doc_id"), F.col("o_custkey").alias("batch"), F.concat(F.lit("order"), k, ext).alias("file_name"), F.floor(F.col("o_totalprice") * 500).alias("length"), target.alias("target_format"))


JOBS_SQL = """jobs AS (
  SELECT o_orderkey AS doc_id, o_custkey AS batch, 'order' || o_orderkey || (['.txt', '.md', '.docx', '.pdf', '.xyz'])[o_orderkey % 5 + 1] AS file_name,
         CAST(floor(o_totalprice * 500) AS BIGINT) AS length, (['txt', 'markdown', 'docx'])[o_orderkey % 3 + 1] AS target_format,
         (['txt', 'markdown', 'docx', 'pdf', NULL])[o_orderkey % 5 + 1] AS source_format, (['.txt', '.md', '.docx', '.pdf', '.xyz'])[o_orderkey % 5 + 1] AS suffix FROM orders
), admitted AS (
  SELECT *, coalesce(source_format = target_format, false) AND length BETWEEN 1 AND 52428800 AS skipped,
         CASE WHEN length <= 0 THEN '文件内容为空。' WHEN length > 52428800 THEN '单个文件不能超过 50 MB。' WHEN source_format IS NULL THEN '不支持的输入格式：' || suffix
              WHEN source_format = target_format THEN '源格式与目标格式相同，无需转换。' WHEN source_format = 'pdf' AND target_format <> 'txt' THEN 'PDF 当前仅支持转换为 TXT。' END AS error FROM jobs
)"""
