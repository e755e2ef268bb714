"""The registered queries of the engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.functions.udf import spread
from pageloom.operators import admission, ast, cleanup, layout, ocr, pages, report, scoring, structure
from pageloom.plans import adapters as A
from pageloom.plans import evaluate, recover

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# DuckDB's class for the same white space.
_WS = r"\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f"
_SCORED = rf"""scored AS (
  SELECT *, CASE WHEN total > 0 THEN replaced / total ELSE 0 END AS r, CASE WHEN total > 0 THEN controls / total ELSE 0 END AS k, CASE WHEN total > 0 THEN private / total ELSE 0 END AS p,
         CASE WHEN length(meaning) > 0 THEN modal / length(meaning) ELSE 0 END AS m, total - replaced - controls - private AS usable
  FROM (SELECT *, length(seen) AS total, length(seen) - length(replace(seen, chr(65533), '')) AS replaced, length(seen) - length(regexp_replace(seen, '\p{{Cc}}', '', 'g')) AS controls,
               length(seen) - length(regexp_replace(seen, '\p{{Co}}', '', 'g')) AS private, coalesce(list_max(map_values(histogram_)), 0) AS modal
        FROM (SELECT *, (SELECT histogram(c) FROM (SELECT unnest(string_split(meaning, '')) AS c) WHERE c <> '') AS histogram_
              FROM (SELECT *, regexp_replace(seen, '[\x{{FFFD}}\p{{Cc}}\p{{Co}}]', '', 'g') AS meaning FROM (SELECT *, regexp_replace(text, '[{_WS}]', '', 'g') AS seen FROM documents))))
), judged AS (
  SELECT *, CAST(printf('%.3f', greatest(0, least(1, 1.0::DOUBLE - CASE WHEN usable < 3 THEN 0.65 ELSE 0 END - CASE WHEN r > 0.01 THEN least(0.6, r * 4) ELSE 0 END - CASE WHEN k > 0.005 THEN least(0.5, k * 6) ELSE 0 END
                  - CASE WHEN p > 0.02 THEN least(0.6, p * 4) ELSE 0 END - CASE WHEN length(meaning) >= 20 AND m > 0.45 THEN 0.55 ELSE 0 END))) AS DOUBLE) AS score,
         NOT (usable < 3 OR r > 0.01 OR k > 0.005 OR p > 0.02 OR (length(meaning) >= 20 AND m > 0.45)) AS clean
  FROM scored
)"""


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[\x{{200B}}\x{{FEFF}}]', '', 'g'), '[\t \x{{A0}}]+', ' ', 'g'), chr(10)),
  lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS text FROM documents""")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


@query("SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[㐀-䶿一-鿿]', '', 'g')) AS INTEGER) AS cjk, CAST(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS INTEGER) AS latin FROM documents")
def script_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", T.cjk_count(F.col("text")).alias("cjk"), T.latin_count(F.col("text")).alias("latin"))


@query(f"WITH {_SCORED} SELECT doc_id, score, clean AND score >= 0.7 AS acceptable, CAST(greatest(0, usable) AS INTEGER) AS usable_char_count, CAST(printf('%.4f', m) AS DOUBLE) AS dominant_char_ratio FROM judged")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return T.with_quality(A.table(spark, d, "documents")).select("doc_id", "score", "acceptable", "usable_char_count", "dominant_char_ratio")


@query(f"WITH {_SCORED} SELECT lang, count(*) AS documents, count(*) FILTER (WHERE clean AND score >= 0.7) AS acceptable, CAST(sum(usable) AS BIGINT) AS usable_chars, round(avg(score), 6) AS mean_score FROM judged GROUP BY lang")
def text_quality_by_lang(spark: SparkSession, d: str) -> DataFrame:
    own = T.with_quality(A.table(spark, d, "documents").select("doc_id", "lang", "text"))
    return own.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if("acceptable").alias("acceptable"), F.sum("usable_char_count").alias("usable_chars"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("SELECT doc_id, CAST(x - 1 AS INTEGER) AS line_no, ls[x] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))")
def line_table(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("""SELECT doc_id, CASE WHEN length(f[1]) <= 120 THEN f[1] END AS first_line, CASE WHEN length(f[-1]) <= 120 THEN f[-1] END AS last_line
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS f FROM documents)""")
def marginal_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = T.lines_of(F.col("text"))
    return A.table(spark, d, "documents").select("doc_id", cleanup.marginal(lines).alias("first_line"), cleanup.marginal(lines, True).alias("last_line"))


_MARGINS = f"""{A.TURNS_SQL}, full_ AS (
  SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS f FROM turns
), n AS (SELECT doc_id, count(*) AS n FROM turns GROUP BY doc_id HAVING count(*) >= 3), m AS (
  SELECT doc_id, 'header' AS place, f[1] AS line FROM full_ WHERE length(f[1]) <= 120 UNION ALL SELECT doc_id, 'footer', f[-1] FROM full_ WHERE length(f[-1]) <= 120
), repeated AS (SELECT doc_id, place, line, count(*) AS pages FROM m JOIN n USING (doc_id) GROUP BY doc_id, place, line, n HAVING count(*) >= greatest(2, ceil(n * 0.5)))"""


@query(f"WITH {_MARGINS} SELECT * FROM repeated")
def repeated_header_lines(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.repeated_margins(A.turns(spark, d))


@query(f"""WITH {A.TURNS_SQL}, n AS (SELECT doc_id, count(*) AS n FROM turns GROUP BY doc_id)
SELECT doc_id, page_number, source, CASE WHEN n >= 3 THEN trim(substr(text, strpos(text, chr(10)) + 1), chr(10) || ' ') ELSE text END AS text FROM turns JOIN n USING (doc_id)""")
def header_footer_removed(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.remove_margins(A.turns(spark, d))


def _prefix_pages(spark: SparkSession, d: str) -> DataFrame:
    lines = lambda a, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("line number "), i + a, F.lit(" of order with words"))), "\n")
    k = F.col("o_orderkey")
    # documents are dealt before their texts are made: their pages meet without an exchange of texts, in partitions of a bounded part of them
    base = spread(A.table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(k.alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page_number"), F.lit("native").alias("source"), (k % 7 + 8).cast("int").alias("n"))
    shared = lines(F.lit(0), F.col("n"))
    return base.select("doc_id", "page_number", "source", F.concat(shared, F.lit("\n"), lines(F.col("page_number") * 100, F.lit(4))).alias("text"))


@query("SELECT o_orderkey AS doc_id, CAST(p AS INTEGER) AS page_number, CAST(o_orderkey % 7 + 8 AS INTEGER) AS longest FROM orders, (SELECT unnest([2, 3]) AS p)")
def adjacent_prefix_length(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.prefix_lengths(_prefix_pages(spark, d))


@query("""SELECT o_orderkey AS doc_id, CAST(p AS INTEGER) AS page_number, CAST(CASE WHEN p = 2 AND n >= 10 THEN n ELSE 0 END AS INTEGER) AS removed
FROM (SELECT o_orderkey, o_orderkey % 7 + 8 AS n FROM orders), (SELECT unnest([1, 2, 3]) AS p)""")
def adjacent_prefix_removed(spark: SparkSession, d: str) -> DataFrame:
    """The second page loses what it shares with the first; the third has then nothing in common with what is left of it."""
    return cleanup.remove_prefixes(_prefix_pages(spark, d)).select("doc_id", "page_number", "removed")


@query()
def fuzzy_marginals(spark: SparkSession, d: str) -> DataFrame:
    own = A.turns(spark, d).select("doc_id", "page_number", F.lit(0).alias("line_index"), F.get(F.split("text", "\n"), F.lit(0)).alias("line"))
    return cleanup.repeated_marginals(own, own.groupBy("doc_id").agg(F.count("*").alias("n")))


@query(f"WITH {A.PAGES_SQL} SELECT doc_id, page_number, kind FROM kinds")
def page_kind(spark: SparkSession, d: str) -> DataFrame:
    return pages.classify(A.pages(spark, d)).select("doc_id", "page_number", "kind")


@query(f"""WITH {A.PAGES_SQL} SELECT doc_id, CASE count(DISTINCT kind) FILTER (WHERE kind <> 'empty') WHEN 0 THEN 'empty' WHEN 1 THEN min(kind) FILTER (WHERE kind <> 'empty') ELSE 'mixed' END AS document_kind, count(*) AS page_count,
  count(*) FILTER (WHERE kind = 'text') AS text_pages, count(*) FILTER (WHERE kind = 'scanned') AS scanned_pages, count(*) FILTER (WHERE kind = 'mixed') AS mixed_pages, count(*) FILTER (WHERE kind = 'empty') AS empty_pages FROM kinds GROUP BY doc_id""")
def document_kind(spark: SparkSession, d: str) -> DataFrame:
    return pages.document_kinds(pages.classify(A.pages(spark, d)))


@query(f"WITH {A.PAGES_SQL} SELECT kind, count(*) AS pages FROM kinds GROUP BY kind")
def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return pages.classify(A.pages(spark, d)).groupBy("kind").agg(F.count("*").alias("pages"))


@query("""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS page_number, count(*) AS images, round(least(1.0, sum(greatest(0, least(612, l_quantity * 20) - least(612, 30)) * greatest(0, least(792, l_quantity * 25) - 40)) / (612.0 * 792.0)), 6) AS coverage
FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def image_coverage(spark: SparkSession, d: str) -> DataFrame:
    # dealt by page once: what groups and joins pages needs no further exchange, in partitions of a bounded part of them
    li = spread(A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_linenumber")
    images = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page_number"), F.lit(30.0).alias("x0"), F.lit(40.0).alias("top"), (F.col("l_quantity") * 20).alias("x1"), (F.col("l_quantity") * 25).alias("bottom"))
    own = images.select("doc_id", "page_number").distinct().withColumn("width", F.lit(A.WIDTH)).withColumn("height", F.lit(A.HEIGHT))
    none = images.select("doc_id", "page_number", F.lit("").alias("text")).limit(0)
    out = pages.page_metrics(own, none, images)
    return out.select("doc_id", "page_number", F.col("image_count").cast("long").alias("images"), F.round("image_coverage_ratio", 6).alias("coverage"))


def _routed(spark: SparkSession, d: str) -> DataFrame:
    own = pages.classify(A.pages(spark, d))
    native = own.select("doc_id", "page_number", F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit("x"), F.lit(30))).otherwise(F.concat(F.lit("native text of page "), "page_number")).alias("text"))
    return pages.route(own, native)


_ROUTE = "CASE WHEN kind = 'empty' THEN 'empty' WHEN kind = 'scanned' OR doc_id % 5 = 0 THEN 'ocr' ELSE 'native' END"


@query(f"WITH {A.PAGES_SQL} SELECT doc_id, page_number, {_ROUTE} AS mode FROM kinds")
def page_route(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("doc_id", "page_number", "mode")


@query(f"""WITH {A.PAGES_SQL}, r AS (SELECT *, {_ROUTE} AS mode FROM kinds), l AS (SELECT DISTINCT doc_id FROM r WHERE mode = 'ocr' AND page_number > 5)
SELECT doc_id, page_number, mode AS source, CASE WHEN doc_id IN (SELECT doc_id FROM l) OR mode = 'empty' THEN '' WHEN mode = 'native' THEN 'native text of page ' || page_number ELSE 'ocr text ' || page_number END AS text FROM r""")
def native_ocr_merge(spark: SparkSession, d: str) -> DataFrame:
    """Recognition has read pages 1 to 5 only: documents that need a later one fail as a whole."""
    read = A.pages(spark, d).where("page_number <= 5").select("doc_id", "page_number", F.concat(F.lit("ocr text "), "page_number").alias("text"), F.lit(0.9).alias("mean_confidence"))
    return pages.merge(_routed(spark, d), read).select("doc_id", "page_number", "source", "text")


@query(f"""WITH {A.TURNS_SQL}, n AS (SELECT doc_id, count(*) AS n FROM turns GROUP BY doc_id),
c AS (SELECT doc_id, page_number, source, CASE WHEN n >= 3 THEN trim(substr(text, strpos(text, chr(10)) + 1), chr(10) || ' ') ELSE text END AS text FROM turns JOIN n USING (doc_id))
SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_number) FILTER (WHERE text <> '') || chr(10), '') AS text, count(*) FILTER (WHERE source = 'native') AS native_pages, count(*) FILTER (WHERE source = 'ocr') AS ocr_pages FROM c GROUP BY doc_id""")
def recovered_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages of conversations, cleaned and joined to documents."""
    own = cleanup.clean_pages(A.turns(spark, d)).withColumn("ocr_mean_confidence", F.lit(None).cast("double"))
    return pages.documents(own).select("doc_id", "text", F.size("native_page_numbers").cast("long").alias("native_pages"), F.size("ocr_page_numbers").cast("long").alias("ocr_pages"))


@query(f"""WITH {A.PAGES_SQL}, p AS (SELECT *, page_number % 3 AS tables, page_number % 2 + 1 AS columns FROM kinds)
SELECT doc_id, count(*) AS page_count, CAST(sum(tables) AS BIGINT) AS structured_table_count, CAST(sum(image_count) AS BIGINT) AS image_count, coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (WHERE columns = 2), '') AS double_column_pages FROM p GROUP BY doc_id""")
def document_sums(spark: SparkSession, d: str) -> DataFrame:
    """Line items as recovered pages, summed by order."""
    n, none = F.col("page_number"), F.lit(None)
    found = pages.classify(A.pages(spark, d)).select(
        "doc_id", "page_number", F.lit("native").alias("source"), F.concat(F.lit("page "), n).alias("text"), "kind", "image_count", none.cast("double").alias("native_quality_score"), none.cast("double").alias("ocr_mean_confidence"),
        (n % 2 + 1).alias("column_count"), (n % 3).alias("structured_table_count"), F.lit(0).alias("complex_table_count"), F.lit(0).alias("table_fallback_count"), F.array().cast("array<string>").alias("warnings"), none.cast("string").alias("error"))
    return recover.documents(found).select("doc_id", "page_count", "structured_table_count", "image_count", F.array_join("double_column_page_numbers", ",").alias("double_column_pages"))


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'OCR 至少需要一个页码。' WHEN 1 THEN 'OCR 页码必须从 1 开始。' WHEN 2 THEN 'OCR 页码不能重复。' WHEN 3 THEN 'OCR 页码必须按升序排列。' WHEN 4 THEN 'PDF 仅有 ' || (o_custkey % 4 + 1) || ' 页，不存在第 9 页。' END AS error FROM orders""")
def page_requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    numbers = F.when(k == 0, F.array().cast("array<int>")).when(k == 1, F.array(F.lit(0), F.lit(1))).when(k == 2, F.array(F.lit(1), F.lit(1))).when(k == 3, F.array(F.lit(2), F.lit(1))).when(k == 4, F.array(F.lit(1), F.lit(9))).otherwise(F.array(F.lit(1)))
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), recover.request_error(numbers, F.col("o_custkey") % 4 + 1).alias("error"))


@query("""WITH r AS (SELECT conv_id AS doc_id, turn + 1 AS page_number FROM conversations), o AS (SELECT * FROM r WHERE NOT (doc_id % 4 = 0 AND page_number = 2)),
j AS (SELECT coalesce(r.doc_id, o.doc_id) AS doc_id, o.doc_id IS NULL AS lone FROM r FULL JOIN o ON r.doc_id = o.doc_id AND r.page_number = o.page_number)
SELECT doc_id, count(*) AS pages, CASE WHEN bool_or(lone) THEN '标准答案与输出必须包含相同数量的页面，且至少一页。' END AS error FROM j GROUP BY doc_id""")
def page_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth conversation has lost its second page in the output."""
    own = A.turns(spark, d).select("doc_id", "page_number", "text")
    out = evaluate.paired(own, own.where(~((F.col("doc_id") % 4 == 0) & (F.col("page_number") == 2))))
    return out.groupBy("doc_id").agg(F.count("*").alias("pages"), F.max("pair_error").alias("error"))


_RULES = rf"""{A.STRUCTURED_SQL}, l AS (
  SELECT doc_id, x - 1 AS line_no, ls[x] AS raw, trim(ls[x], ' ' || chr(9)) AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM texts))
), f AS (
  SELECT *, s = '' AS blank, regexp_matches(s, '^[一二三四五六七八九十百千万]+、\s*.+$') AS enum, contains(raw, chr(9)) AND s <> '' AS tab FROM l
), g AS (
  SELECT *, coalesce(lag(blank) OVER w, true) AS pb, coalesce(lead(blank) OVER w, true) AS nb, coalesce(lag(enum) OVER w, false) OR coalesce(lead(enum) OVER w, false) AS near,
         tab AND (coalesce(lag(tab) OVER w, false) OR coalesce(lead(tab) OVER w, false)) AS tabled FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), rules AS (
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, raw, s, CASE WHEN blank THEN 'blank' WHEN tabled THEN 'tab_table' WHEN starts_with(raw, '    ') OR starts_with(raw, chr(9)) THEN 'code' WHEN regexp_matches(s, '^第[0-9]+章') THEN 'chapter'
    WHEN regexp_matches(s, '^\d+(\.\d+)+[.、]?\s+.+$') THEN 'decimal' WHEN enum AND NOT near THEN 'enumerated' WHEN regexp_matches(s, '^[（(][一二三四五六七八九十百千万\d]+[）)]\s*.+$') THEN 'bracketed'
    WHEN regexp_matches(s, '^\d+[.、]\s*.+$') AND pb AND nb AND length(s) <= 30 AND NOT regexp_matches(s, '[。！？；.!?;]$') THEN 'numbered_title' WHEN regexp_matches(s, '^[-*+]\s+.+$') OR regexp_matches(s, '^\d+[.、]\s*.+$') OR near THEN 'list'
    WHEN pb AND nb AND length(s) BETWEEN 2 AND 24 AND NOT regexp_matches(s, '[。！？；.!?;]$') THEN 'short_title' ELSE 'paragraph' END AS rule FROM g
)"""


@query(f"WITH {_RULES} SELECT doc_id, line_no, rule, CAST(CASE rule WHEN 'chapter' THEN 1 WHEN 'decimal' THEN 3 WHEN 'enumerated' THEN 2 WHEN 'numbered_title' THEN 2 WHEN 'short_title' THEN 2 WHEN 'bracketed' THEN 3 END AS INTEGER) AS level FROM rules")
def txt_line_rules(spark: SparkSession, d: str) -> DataFrame:
    return structure.line_rules(A.structured_texts(spark, d)).select("doc_id", "line_no", "rule", "level")


@query(f"WITH {_RULES}, p AS (SELECT *, sum(CASE WHEN rule <> 'paragraph' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph FROM rules) SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, string_agg(s, ' ' ORDER BY line_no) AS text FROM p WHERE rule = 'paragraph' GROUP BY doc_id, paragraph")
def txt_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return structure.paragraphs(structure.line_rules(A.structured_texts(spark, d)))


@query()
def txt_markdown(spark: SparkSession, d: str) -> DataFrame:
    return structure.to_markdown(A.structured_texts(spark, d)).select("doc_id", "markdown", "warnings")


def _trees(spark: SparkSession, d: str) -> DataFrame:
    node = r'{"t":"%s","c":[{"t":"Str","c":"\"t\":\"Table\""}]}'
    parts = [F.repeat(F.lit("," + node % t), (F.col("p_partkey") % k).cast("int")) for t, k in (("Header", 4), ("BulletList", 3), ("OrderedList", 2), ("Table", 3), ("CodeBlock", 2), ("Link", 5), ("Image", 3))]
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit('{"meta":{"x":{"t":"Link","c":[]}},"blocks":[{"t":"Para","c":[]}'), *parts, F.lit("]}")).alias("tree"))


@query("""SELECT p_partkey AS doc_id, CAST(p_partkey % 4 AS INTEGER) AS headings, CAST(p_partkey % 3 + p_partkey % 2 AS INTEGER) AS lists, CAST(p_partkey % 3 AS INTEGER) AS tables, CAST(p_partkey % 2 AS INTEGER) AS code_blocks,
  CAST(p_partkey % 5 AS INTEGER) AS links, CAST(p_partkey % 3 AS INTEGER) AS images FROM part""")
def ast_stats(spark: SparkSession, d: str) -> DataFrame:
    return ast.stats(_trees(spark, d))


_SOURCES = "(['https://example.com/a.png', 'img/a' || (page_id % 2) || '.png', '../up.png', 'file:///etc/a.png', 'data:image/png;base64,x', 'img/../../out.png'])[page_id % 6 + 1]"


@query(f"""SELECT page_id AS doc_id, s AS source, CASE page_id % 6 WHEN 0 THEN '远程图片未下载，已保留为链接：' || s WHEN 1 THEN CASE WHEN page_id % 2 = 1 THEN '找不到本地图片，已保留引用：' || s END
  WHEN 2 THEN '图片路径超出文档目录，已阻止读取：' || s WHEN 3 THEN '图片路径超出文档目录，已阻止读取：' || s WHEN 5 THEN '图片路径超出文档目录，已阻止读取：' || s END AS warning, page_id % 6 IN (0, 2, 3, 5) OR (page_id % 6 = 1 AND page_id % 2 = 1) AS as_link
FROM (SELECT page_id, {_SOURCES} AS s FROM pages)""")
def image_safety(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "pages")
    source = F.element_at(F.array(F.lit("https://example.com/a.png"), F.concat(F.lit("img/a"), F.col("page_id") % 2, F.lit(".png")), F.lit("../up.png"), F.lit("file:///etc/a.png"), F.lit("data:image/png;base64,x"), F.lit("img/../../out.png")), (F.col("page_id") % 6 + 1).cast("int"))
    assets = p.select(F.col("page_id").alias("doc_id"), F.lit("img/a0.png").alias("path"))
    return ast.image_rules(p.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("ord"), source.alias("source")), assets).select("doc_id", "source", "warning", "as_link")


@query(f"WITH {A.JOBS_SQL} SELECT doc_id, source_format, skipped, error FROM admitted")
def admission_rules(spark: SparkSession, d: str) -> DataFrame:
    return admission.admit(A.jobs(spark, d), F.col("target_format")).select("doc_id", "source_format", "skipped", "error")


@query(f"WITH {A.JOBS_SQL} SELECT error, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM admitted GROUP BY error")
def error_summary(spark: SparkSession, d: str) -> DataFrame:
    return admission.admit(A.jobs(spark, d), F.col("target_format")).groupBy("error").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query(f"WITH {A.JOBS_SQL} SELECT batch, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, CASE WHEN count(*) > 100 THEN '一次最多处理 100 个文件。' WHEN min(length) <= 0 THEN '文件内容为空。' WHEN max(length) > 52428800 THEN '单个文件不能超过 50 MB。' WHEN sum(length) > 209715200 THEN '批次总大小不能超过 200 MB。' END AS error FROM jobs GROUP BY batch")
def batch_limits(spark: SparkSession, d: str) -> DataFrame:
    return admission.batch_error(A.jobs(spark, d), ["batch"])


@query("SELECT p_partkey, name, CASE WHEN k = 1 THEN name ELSE p_name || '_' || k || '.txt' END AS published_name FROM (SELECT p_partkey, p_name, p_name || '.txt' AS name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def collision_names(spark: SparkSession, d: str) -> DataFrame:
    own = A.table(spark, d, "part").select(F.lit("out").alias("dir"), "p_partkey", F.concat("p_name", F.lit(".txt")).alias("name"))
    return admission.free_names(own, directory="dir", name="name", order=["p_partkey"]).select("p_partkey", "name", "published_name")


@query("""WITH e AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, CASE WHEN l_partkey % 97 = 0 THEN '../x' WHEN l_partkey % 89 = 0 THEN 'C:/x' WHEN l_partkey % 83 = 0 THEN '/x' ELSE 'word/p' || (l_partkey % 50) || '.xml' END AS name,
  CAST(l_extendedprice AS BIGINT) AS file_size, CAST(l_quantity AS BIGINT) AS compress_size FROM lineitem),
b AS (SELECT *, CASE WHEN starts_with(name, '/') OR name LIKE 'C:%' THEN 'absolute' WHEN name = '../x' THEN 'steps up' WHEN row_number() OVER (PARTITION BY doc_id, name ORDER BY ord) > 1 THEN 'copy' WHEN file_size / compress_size > 1000 THEN 'member ratio' END AS broken FROM e)
SELECT doc_id, count(*) AS entry_count, CAST(sum(file_size) AS BIGINT) AS total_bytes, coalesce(arg_min(broken, ord) FILTER (WHERE broken IS NOT NULL), CASE WHEN sum(file_size) / sum(compress_size) > 200 THEN 'ratio' ELSE 'members' END) AS error
FROM b GROUP BY doc_id""")
def zip_rules(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    k = F.col("l_partkey")
    name = F.when(k % 97 == 0, "../x").when(k % 89 == 0, "C:/x").when(k % 83 == 0, "/x").otherwise(F.concat(F.lit("word/p"), k % 50, F.lit(".xml")))
    # DuckDB rounds when it casts
    entries = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("ord"), name.alias("name"), F.bround("l_extendedprice").cast("long").alias("file_size"), F.col("l_quantity").cast("long").alias("compress_size"), F.lit(0).alias("flag_bits"), F.lit(0).cast("long").alias("external_attr"), F.lit(False).alias("is_dir"))
    out = admission.inspect_archives(entries)
    e = F.col("error")
    return out.select("doc_id", "entry_count", "total_bytes", F.when(e.contains("绝对路径"), "absolute").when(e.contains("路径穿越"), "steps up").when(e.contains("重复条目"), "copy").when(e.startswith("DOCX 条目压缩比"), "member ratio").when(e.startswith("DOCX 总压缩比"), "ratio").otherwise("members").alias("error"))


@query("SELECT page_id, contains(html, '<table') AS has_table, contains(html, 'mailto:') AS has_mail, contains(html, '<li>') AS has_list FROM pages")
def risk_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = admission.tokens_in(F.col("html").cast("binary"), ("<table", "mailto:", "<li>"))
    return A.table(spark, d, "pages").select("page_id", *[F.array_contains(found, t).alias(n) for t, n in (("<table", "has_table"), ("mailto:", "has_mail"), ("<li>", "has_list"))])


@query("""SELECT doc_id AS ord, CASE WHEN doc_id % 11 = 0 THEN 'id' WHEN doc_id % 7 = 0 THEN 'https' WHEN doc_id % 5 = 0 THEN 'sha' WHEN doc_id % 3 = 0 THEN 'pages' ELSE 'none' END AS error FROM documents""")
def manifest_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rev = F.sha1(k.cast("string").cast("binary"))
    samples = A.table(spark, d, "documents").select(
        k.alias("ord"), F.when(k % 11 == 0, "Bad_Id").otherwise(F.concat(F.lit("sample-"), k)).alias("id"), F.concat(F.lit("f"), k, F.lit(".pdf")).alias("filename"),
        F.concat(F.when(k % 7 == 0, "http").otherwise("https"), F.lit("://example.com/"), rev).alias("source_url"), F.lit("https://example.com/p").alias("source_page_url"), F.lit("repo").alias("source_repository"), rev.alias("source_revision"), F.lit("git-commit").alias("source_revision_kind"),
        F.lit("MIT").alias("source_license"), F.lit("no").alias("redistribution"), F.when(k % 5 == 0, "xyz").otherwise(F.sha2("text", 256)).alias("sha256"), (k * 10 + 1).alias("file_size"), F.lit("en").alias("language"), F.array(F.lit("a")).alias("categories"), F.when(k % 3 == 0, 0).otherwise(2).alias("expected_page_count"))
    e = F.col("error")
    return admission.manifest_errors(samples).select("ord", F.when(e.startswith("PDF 样例 ID"), "id").when(e.contains("HTTPS"), "https").when(e.contains("SHA-256"), "sha").when(e.contains("页数"), "pages").when(e.isNull(), "none").otherwise(e).alias("error"))


@query("""SELECT doc_id, CAST((l.doc_id IS NULL) AS INTEGER) + CASE WHEN l.doc_id IS NULL THEN 0 ELSE CAST(doc_id % 4 <> 1 AS INTEGER) + CAST(length(text) < 200 AS INTEGER) + CAST(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) < 500 AS INTEGER) END AS failures
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def acceptance_gates(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents").join(A.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    null = F.lit(None)
    rows = docs.select(
        "doc_id", "text", F.col("quality").isNotNull().alias("success"), null.cast("string").alias("error"), (F.col("doc_id") % 4).cast("int").alias("page_count"), F.lit("text").alias("pdf_kind"), *[F.lit(0).alias(f"{k}_pages") for k in ("native", "ocr", "empty")],
        F.lit(0).alias("structured_table_count"), F.lit(0).alias("complex_table_count"), null.cast("double").alias("mean_confidence"), F.array().cast("array<string>").alias("warnings"), F.lit(1).alias("expected_page_count"), F.lit("text").alias("expected_pdf_kind"),
        *[null.cast("int").alias(f"expected_{k}_pages") for k in ("native", "ocr", "empty")], F.lit(200).alias("min_output_characters"), null.cast("int").alias("min_cjk_characters"), F.lit(500).alias("min_latin_characters"),
        null.cast("int").alias("min_structured_tables"), null.cast("int").alias("min_complex_tables"), null.cast("double").alias("min_ocr_mean_confidence"), null.cast("string").alias("required_warning_contains"))
    return rows.select("doc_id", F.size(scoring.gate_failures(F.col("text"))).alias("failures"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item with an output of swapped letters."""
    b = A.table(spark, d, "benchmark")
    bare = F.regexp_replace("text", r"\s", "")
    return b.select("item_id", bare.alias("reference"), F.replace(bare, F.lit("th"), F.lit("ht")).alias("output"))


# DuckDB's distance counts bytes, which is the same here: all that changes are letters of one byte.
_ACC = rf"acc AS (SELECT item_id, r, levenshtein(r, replace(r, 'th', 'ht')) AS e FROM (SELECT item_id, regexp_replace(nfc_normalize(text), '[{_WS}]', '', 'g') AS r FROM benchmark))"


@query(f"WITH {_ACC} SELECT item_id, CAST(length(r) AS INTEGER) AS reference_characters, CAST(e AS INTEGER) AS edit_distance, round(greatest(0, 1 - e / length(r)), 9) AS accuracy FROM acc")
def char_accuracy_page(spark: SparkSession, d: str) -> DataFrame:
    return scoring.page_accuracy(_pairs(spark, d)).select("item_id", "reference_characters", "edit_distance", F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {_ACC} SELECT CAST(sum(length(r)) AS BIGINT) AS reference_characters, CAST(sum(e) AS BIGINT) AS edit_distance, round(greatest(0, 1 - sum(e) / sum(length(r))), 9) AS accuracy, greatest(0, 1 - sum(e) / sum(length(r))) >= 0.9 AS passes_gate FROM acc")
def char_accuracy_total(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.total_accuracy(scoring.page_accuracy(_pairs(spark, d)), [])
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query()
def accuracy_differences(spark: SparkSession, d: str) -> DataFrame:
    return scoring.diagnose(_pairs(spark, d)).select("item_id", F.to_json("differences").alias("differences"))


@query("""SELECT n_nationkey AS doc_id, CAST(4 + (n_nationkey % 3 <> 0)::INTEGER AS BIGINT) AS matched_cells, CAST(6 AS BIGINT) AS total_cells, round((4 + (n_nationkey % 3 <> 0)::INTEGER) / 6.0, 4) AS cell_recall, true AS row_order_ok, 3 AS tabular_rows, true AS structure_restored FROM nation""")
def table_recall(spark: SparkSession, d: str) -> DataFrame:
    n, k = A.table(spark, d, "nation"), F.col("n_nationkey")
    truth = n.select(k.alias("doc_id"), F.array(F.lit("Name"), F.lit("Absent")).alias("headers"), F.array(F.array(F.col("n_name"), F.lit("aa1")), F.array(F.when(k % 3 == 0, "missing").otherwise("Qty"), F.lit("bb2"))).alias("rows"))
    output = n.select(k.alias("doc_id"), F.concat(F.lit("Name\tQty\n"), "n_name", F.lit("\taa1\nx\tbb2\n")).alias("text"))
    return scoring.table_recall(truth, output).drop("missing_cells")


_TABLES = "tables_ AS (SELECT DISTINCT doc_id, page_number, 50.0 AS t_x0, 100.0 AS t_top, 300.0 AS t_x1, 200.0 AS t_bottom FROM words)"


@query(f"WITH {A.WORDS_SQL} SELECT doc_id, page_number, word_idx FROM words WHERE NOT ((x0 + x1) / 2 BETWEEN 49 AND 301 AND (top + bottom) / 2 BETWEEN 99 AND 201)")
def words_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    w = A.words(spark, d)
    tables = w.select("doc_id", "page_number").distinct().select("*", F.lit(50.0).alias("x0"), F.lit(100.0).alias("top"), F.lit(300.0).alias("x1"), F.lit(200.0).alias("bottom"))
    return layout.outside_tables(w, tables).select("doc_id", "page_number", "word_idx")


@query("""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_number, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS idx, CAST(l_partkey % 100 AS DOUBLE) AS x0, l_partkey % 100 + l_quantity AS x1, CAST(l_suppkey % 50 AS DOUBLE) AS top, l_suppkey % 50 + 30.0 AS bottom FROM lineitem)
SELECT a.doc_id, a.page_number, CAST(a.idx AS INTEGER) AS a_idx, CAST(b.idx AS INTEGER) AS b_idx, round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.bottom, b.bottom) - greatest(a.top, b.top)) / least((a.x1 - a.x0) * 30, (b.x1 - b.x0) * 30), 9) AS ratio
FROM b a JOIN b USING (doc_id, page_number) WHERE a.idx < b.idx""")
def bbox_overlap(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    x, y = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 50).cast("double")
    b = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), F.row_number().over(w).alias("idx"), x.alias("x0"), (x + F.col("l_quantity")).alias("x1"), y.alias("top"), (y + 30).alias("bottom"))
    return layout.box_overlaps(b, b).withColumn("ratio", F.round("ratio", 9))


@query(f"""WITH {A.WORDS_SQL}, c AS (SELECT doc_id, page_number, step, 612.0::DOUBLE * (0.35::DOUBLE + step * 0.01::DOUBLE) AS mid, text, x0, x1 FROM words, (SELECT unnest(range(31)) AS step) WHERE length(text) >= 2),
s AS (SELECT *, CASE WHEN x1 <= mid - 7.344 THEN 0 WHEN x0 >= mid + 7.344 THEN 1 ELSE 2 END AS side, length(text) AS w FROM c),
a AS (SELECT doc_id, page_number, step, count(*) AS n, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2, coalesce(sum(w) FILTER (WHERE side = 0), 0) AS w0, coalesce(sum(w) FILTER (WHERE side = 1), 0) AS w1, sum(w) AS w,
  median(x1) FILTER (WHERE side = 0) AS e0, median(x0) FILTER (WHERE side = 1) AS e1 FROM s GROUP BY ALL)
SELECT doc_id, page_number, arg_max((e0 + e1) / 2, round((w0 + w1) / w + least((e1 - e0) / 612.0, 0.12) - n2 * 0.005, 9) - step * 1e-12) AS split FROM a
WHERE n >= 6 AND n0 >= 2 AND n1 >= 2 AND least(w0, w1) / greatest(w0, w1) >= 0.2 AND (w0 + w1) / w >= 0.68 AND e1 - e0 >= 12.24 GROUP BY doc_id, page_number""")
def column_split(spark: SparkSession, d: str) -> DataFrame:
    return layout.column_splits(A.words(spark, d), A.WIDTH)


@query(f"""WITH {A.WORDS_SQL}, c AS (SELECT doc_id, page_number, bin, count(*) AS n FROM (SELECT doc_id, page_number, unnest(range(CAST(floor(x0) AS INTEGER), least(612, CAST(ceil(x1) AS INTEGER)))) AS bin FROM words) GROUP BY ALL),
o AS (SELECT p.doc_id, p.page_number, b.bin, b.bin - row_number() OVER (PARTITION BY p.doc_id, p.page_number ORDER BY b.bin) AS i FROM (SELECT DISTINCT doc_id, page_number FROM words) p CROSS JOIN (SELECT unnest(range(122, 490)) AS bin) b LEFT JOIN c ON c.doc_id = p.doc_id AND c.page_number = p.page_number AND c.bin = b.bin WHERE coalesce(n, 0) <= 2)
SELECT doc_id, page_number, CAST(min(bin) AS INTEGER) AS start, CAST(max(bin) + 1 AS INTEGER) AS "end" FROM o GROUP BY doc_id, page_number, i HAVING max(bin) + 1 - min(bin) >= 6""")
def corridor_histogram(spark: SparkSession, d: str) -> DataFrame:
    return layout.corridors(A.words(spark, d), A.WIDTH)


@query(f"WITH {A.WORDS_SQL} SELECT doc_id, page_number, CASE WHEN (x0 + x1) / 2 < 210 THEN 0 WHEN (x0 + x1) / 2 < 388 THEN 1 ELSE 2 END AS lane, count(*) AS words, max(top) - min(top) AS spread FROM words GROUP BY ALL")
def lane_counts(spark: SparkSession, d: str) -> DataFrame:
    w = A.words(spark, d).drop("lane")
    return layout.lane_counts(w, w.select("doc_id", "page_number").distinct().select("*", F.lit(210.0).alias("first"), F.lit(388.0).alias("second")))


@query(f"""WITH {A.WORDS_SQL}, g AS (SELECT *, coalesce(CASE WHEN x0 - lag(x1) OVER w >= 18 THEN 1 ELSE 0 END, 0) AS cut FROM words WINDOW w AS (PARTITION BY doc_id, page_number, line_no ORDER BY x0, word_idx)),
h AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page_number, line_no ORDER BY x0, word_idx) AS fragment FROM g)
SELECT doc_id, page_number, line_no, CAST(fragment AS BIGINT) AS fragment, string_agg(text, ' ' ORDER BY x0, word_idx) AS text, min(x0) AS x0, max(x1) AS x1 FROM h GROUP BY doc_id, page_number, line_no, fragment""")
def gap_fragments(spark: SparkSession, d: str) -> DataFrame:
    return layout.fragments_of_lines(A.words(spark, d), F.lit(A.WIDTH)).select("doc_id", "page_number", "line_no", "fragment", "text", "x0", "x1")


@query(f"WITH {A.WORDS_SQL} SELECT doc_id, page_number, word_idx, line_no FROM words")
def line_cluster_fold(spark: SparkSession, d: str) -> DataFrame:
    return layout.cluster_lines(A.words(spark, d).drop("line_no")).select("doc_id", "page_number", "word_idx", "line_no")


@query(f"WITH {A.WORDS_SQL} SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY round(top, 1), x0, bottom, word_idx) AS text FROM words GROUP BY doc_id, page_number")
def reading_order_text(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(A.words(spark, d).withColumnRenamed("word_idx", "idx"))


@query(f"""WITH {A.WORDS_SQL}, n AS (SELECT doc_id, page_number, count(*) AS n FROM words GROUP BY ALL)
SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY CASE WHEN n >= 6 THEN lane ELSE 0 END, line_no, lane) AS text, CASE WHEN columns = 2 AND n >= 6 THEN 2 ELSE 1 END AS column_count
FROM words JOIN n USING (doc_id, page_number) WHERE columns < 3 GROUP BY doc_id, page_number, columns, n""")
def page_layout(spark: SparkSession, d: str) -> DataFrame:
    """Pages with one and two columns; fewer than 6 words are no columns."""
    return layout.page_texts(A.words(spark, d).where("columns < 3"), A.WIDTH, A.HEIGHT).select("doc_id", "page_number", "text", "column_count")


@query()
def page_layout_three(spark: SparkSession, d: str) -> DataFrame:
    """Pages with three columns below a header."""
    return layout.page_texts(A.words(spark, d).where("columns = 3"), A.WIDTH, A.HEIGHT)


@query(f"WITH {A.WORDS_SQL} SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY top, x0, word_idx) AS text FROM words GROUP BY doc_id, page_number")
def ocr_horizontal_order(spark: SparkSession, d: str) -> DataFrame:
    return ocr.horizontal_text(A.ocr_blocks(spark, d))


@query(f"WITH {A.WORDS_SQL} SELECT doc_id, page_number, CAST(printf('%.4f', avg(score)) AS DOUBLE) AS mean_confidence, count(*) FILTER (WHERE score < 0.6) AS low_confidence_count, count(*) AS block_count FROM words GROUP BY doc_id, page_number")
def ocr_confidence(spark: SparkSession, d: str) -> DataFrame:
    return ocr.confidence(A.ocr_blocks(spark, d))


_DIGITS = "一二三四五六七八九十"


def _vertical(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of each page as vertical columns, those of documents with odd numbers too short to be taken for such."""
    k, tall = F.col("source_index"), F.col("doc_id") % 2 == 0
    text = F.concat(F.lit("天地玄黄"), F.substring(F.lit(_DIGITS), k % 10 + 1, F.lit(1)))
    return A.ocr_blocks(spark, d).select("doc_id", "page_number", "source_index", text.alias("text"), "score", F.lit(100.0).alias("top"), (40.0 + 40 * k).alias("left"), F.when(tall, 220.0).otherwise(120.0).alias("bottom"), (60.0 + 40 * k).alias("right"), "has_geometry")


@query(f"WITH {A.WORDS_SQL} SELECT doc_id, page_number, doc_id % 2 = 0 AND count(*) >= 4 AS vertical FROM words GROUP BY doc_id, page_number")
def vertical_cjk_detect(spark: SparkSession, d: str) -> DataFrame:
    return ocr.vertical_pages(_vertical(spark, d))


@query(f"""WITH {A.WORDS_SQL}, n AS (SELECT doc_id, page_number, doc_id % 2 = 0 AND count(*) >= 4 AS vertical FROM words GROUP BY doc_id, page_number)
SELECT doc_id, page_number, string_agg('天地玄黄' || substr('{_DIGITS}', word_idx % 10 + 1, 1), chr(10) ORDER BY CASE WHEN vertical THEN -word_idx ELSE word_idx END) AS text, CAST(count(*) AS INTEGER) AS line_count, vertical
FROM words JOIN n USING (doc_id, page_number) GROUP BY doc_id, page_number, vertical""")
def ocr_vertical_order(spark: SparkSession, d: str) -> DataFrame:
    return ocr.read_pages(_vertical(spark, d)).select("doc_id", "page_number", "text", "line_count", "vertical")


@query()
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    b = A.ocr_blocks(spark, d)
    rules = b.select("doc_id", "page_number").distinct().select("*", F.array(*[F.lit(x) for x in (40, 230, 410, 580)]).alias("xs"), F.array(*[F.lit(y) for y in range(50, 400, 50)]).alias("ys"))
    return ocr.ruled_tables(b, rules)


def _reports(spark: SparkSession, d: str) -> DataFrame:
    own = admission.admit(A.jobs(spark, d), F.col("target_format"))
    own = own.select("batch", F.col("file_name").alias("source_file"), F.concat(F.lit("out-"), "file_name").alias("target_file"), "source_format", "target_format", "skipped", F.when(~F.col("skipped"), F.col("error")).alias("error"), F.array().cast("array<string>").alias("warnings"))
    return report.finish(own)


_LOSS = "CASE WHEN error IS NULL THEN (target_format = 'txt')::INTEGER + (source_format = 'docx')::INTEGER + (source_format = 'docx' AND target_format = 'markdown')::INTEGER + (source_format = 'markdown' AND target_format = 'docx')::INTEGER + 4 * (source_format = 'pdf')::INTEGER ELSE 0 END"


@query(f"WITH {A.JOBS_SQL} SELECT file_name AS source_file, error IS NULL AS success, CASE WHEN error IS NULL THEN 'out-' || file_name ELSE '' END AS target_file, CAST({_LOSS} AS INTEGER) AS losses FROM admitted")
def report_losses(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("source_file", "success", "target_file", F.size("possible_losses").alias("losses"))


@query(f"WITH {A.JOBS_SQL} SELECT batch, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS successful, count(*) FILTER (WHERE skipped) AS skipped, count(*) FILTER (WHERE error IS NOT NULL AND NOT skipped) AS failed, CAST(sum({_LOSS} + skipped::INTEGER) AS BIGINT) AS warning_total FROM admitted GROUP BY batch")
def batch_report(spark: SparkSession, d: str) -> DataFrame:
    return report.batch_summary(_reports(spark, d), ["batch"])


@query(f"WITH {A.JOBS_SQL} SELECT file_name AS source_file, CASE WHEN error IS NULL THEN '成功' WHEN skipped THEN '已跳过' ELSE '失败' END AS status, CASE WHEN error IS NULL THEN 'out-' || file_name ELSE '—' END AS target_file, CASE WHEN skipped THEN '' ELSE coalesce(error, '') END AS error FROM admitted")
def report_overview(spark: SparkSession, d: str) -> DataFrame:
    out = report.overview(_reports(spark, d))
    return out.select(*(F.col(c).alias(n) for c, n in (("源文件", "source_file"), ("状态", "status"), ("输出文件", "target_file"), ("错误", "error"))))


@query(f"""WITH {A.JOBS_SQL} SELECT file_name, CASE source_format WHEN 'txt' THEN 'TXT' WHEN 'markdown' THEN 'Markdown' WHEN 'docx' THEN 'DOCX' WHEN 'pdf' THEN 'PDF' ELSE 'unknown' END AS format,
  CASE WHEN length < 1024 THEN length || ' B' WHEN length < 1048576 THEN printf('%.1f KB', length / 1024) ELSE printf('%.1f MB', length / 1048576) END AS size, CASE WHEN source_format = target_format THEN '源格式与目标格式相同' ELSE '等待转换' END AS state FROM admitted""")
def upload_preview(spark: SparkSession, d: str) -> DataFrame:
    own = admission.admit(A.jobs(spark, d), F.col("target_format"))
    out = report.preview(own.select("file_name", F.col("length").cast("long").alias("length"), "source_format", "target_format"), F.col("target_format"))
    return out.select(*(F.col(c).alias(n) for c, n in (("文件名", "file_name"), ("源格式", "format"), ("大小", "size"), ("处理状态", "state"))))


@query()
def report_json(spark: SparkSession, d: str) -> DataFrame:
    return report.report_json(_reports(spark, d))


@query(f"""WITH {A.PAGES_SQL} SELECT doc_id % 10 AS batch, kind, count(*) AS pages, CAST(sum(text_char_count) AS BIGINT) AS characters FROM kinds GROUP BY ROLLUP (doc_id % 10, kind)""")
def rollup_batch_kind(spark: SparkSession, d: str) -> DataFrame:
    own = pages.classify(A.pages(spark, d)).withColumn("batch", F.col("doc_id") % 10)
    return own.rollup("batch", "kind").agg(F.count("*").alias("pages"), F.sum("text_char_count").alias("characters"))
