"""Admission rules over files, archives, PDF heads and manifests: every rule is a column, none raises.

A rejected row has error_kind and error; cheap rules stand before those that read content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import SPACE, strip
from pageloom.functions.udf import arrow_function
from pageloom.model import MB, SUFFIXES, TARGETS, BatchLimits, PdfLimits, ZipLimits


def first_of(*rules: tuple[Column, Column | str]) -> Column:
    """The message of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for hit, message in reversed(rules):
        out = F.when(hit, message if isinstance(message, Column) else F.lit(message)).otherwise(out)
    return out


def suffix(name: Column) -> Column:
    """The last suffix in lower case; none for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(name, r"[^.](\.[^./]+)$", 1))


def source_format(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.try_element_at(table, suffix(name))


def format_error(name: Column) -> Column:
    s = suffix(name)
    return F.when(source_format(name).isNull(), F.concat(F.lit("不支持的输入格式："), F.when(s == "", "无扩展名").otherwise(s)))


def clean_name(name: Column) -> Column:
    """The name with unusual characters as underscores, without blanks and dots at its ends."""
    return F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\-. ()一-鿿]", "_"), r"^[ .]+|[ .]+$", "")


def name_error(name: Column) -> Column:
    cleaned = clean_name(name)
    return first_of(
        (name.isNull() | (name == "") | name.contains("\x00"), "文件名为空或包含非法字符。"),
        (name.contains("/") | name.contains("\\") | name.isin(".", ".."), F.concat(F.lit("文件名包含路径成分："), name)),
        (name.startswith("."), "不接受隐藏文件。"),
        ((cleaned == "") | cleaned.startswith("."), "不接受空文件名或隐藏文件。"),
    )


def target_error(source: Column, target: Column) -> Column:
    return first_of(
        (~target.isin(*TARGETS), F.concat(F.lit("不支持的目标格式："), target)),
        (source == target, "源格式与目标格式相同，无需转换。"),
        ((source == "pdf") & (target != "txt"), "PDF 当前仅支持转换为 TXT。"),
    )


def size_error(size: Column, limits: BatchLimits = BatchLimits()) -> Column:
    return first_of((size <= 0, "文件内容为空。"), (size > limits.file_bytes, f"单个文件不能超过 {limits.file_bytes // MB} MB。"))


def admit(files: DataFrame, target: Column, *, name: str = "file_name", size: str = "length", limits: BatchLimits = BatchLimits()) -> DataFrame:
    """The files with source_format, skipped, error_kind and error. A file whose format is the target's is skipped."""
    n, source = F.col(name), source_format(F.col(name))
    skipped = F.coalesce(source == target, F.lit(False))
    error = F.coalesce(size_error(F.col(size), limits), format_error(n), target_error(source, target))
    return files.select("*", source.alias("source_format"), skipped.alias("skipped"), error.alias("found")).select(
        *files.columns, "source_format", (F.col("skipped") & size_error(F.col(size), limits).isNull()).alias("skipped"),
        F.when(F.col("found").isNotNull(), "validation").alias("error_kind"), F.col("found").alias("error"),
    )


def batch_error(files: DataFrame, by: list[str], *, size: str = "length", limits: BatchLimits = BatchLimits()) -> DataFrame:
    """One row for each batch: files, bytes and the rule it breaks, if any."""
    one = size_error(F.col(size), limits)
    out = files.groupBy(*by).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.min(F.when(F.col(size) <= 0, 1)).alias("empty"), F.min(F.when(one.isNotNull(), 1)).alias("bad"), F.min_by(one, F.struct(one.isNull(), F.col(size))).alias("first"))
    error = first_of(
        (F.col("files") > limits.files, f"一次最多处理 {limits.files} 个文件。"),
        (F.col("bad").isNotNull(), F.when(F.col("empty").isNotNull(), "文件内容为空。").otherwise(f"单个文件不能超过 {limits.file_bytes // MB} MB。")),
        (F.col("bytes") > limits.batch_bytes, f"批次总大小不能超过 {limits.batch_bytes // MB} MB。"),
    )
    return out.select(*by, "files", "bytes", error.alias("error"))


def free_names(wanted: DataFrame, *, directory: str, name: str, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """The rows with published_name: a name that is taken gets _2, _3 and so on behind its stem.

    taken (directory, name) are the names that exist; a numbered name counts as taken
    too. Names are dealt in the given order.
    """
    w = Window.partitionBy(directory, name).orderBy(*order)
    turn = F.row_number().over(w)
    if taken is not None:
        # numbers that exist of each stem are left out by their rank
        own = taken.select(F.col(directory), F.col(name).alias("__taken"))
        keyed = own.select(directory, F.regexp_replace("__taken", r"_(\d+)(\.[^.]*)?$", "$2").alias(name), F.coalesce(F.expr(r"try_cast(regexp_extract(__taken, '_(\\d+)(\\.[^.]*)?$', 1) AS INT)"), F.lit(1)).alias("k"))
        exact = own.select(directory, F.col("__taken").alias(name), F.lit(1).alias("k"))
        used = keyed.unionAll(exact).groupBy(directory, name).agg(F.array_sort(F.collect_set("k")).alias("__used"))
        wanted = wanted.join(used, [directory, name], "left")
        # the n-th number from 1 on that is not used
        number = F.aggregate(F.coalesce(F.col("__used"), F.array().cast("array<int>")), turn, lambda acc, u: F.when(u <= acc, acc + 1).otherwise(acc))
    else:
        number = turn
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    out = F.when(number == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), number, ext))
    return wanted.withColumn("published_name", out).drop("__used")


# --- archives -------------------------------------------------------------------------

REQUIRED_MEMBERS = ("[Content_Types].xml", "word/document.xml")


def compression_ratio(size: Column, packed: Column) -> Column:
    return F.when(size <= 0, F.lit(0.0)).when(packed <= 0, F.lit(float("inf"))).otherwise(size / packed)


def member_error(limits: ZipLimits = ZipLimits()) -> Column:
    """The first rule that an entry (name, file_size, compress_size, flag_bits, external_attr, is_dir, copy) breaks."""
    n, ratio = F.col("name"), compression_ratio(F.col("file_size"), F.col("compress_size"))
    kind = F.shiftright(F.col("external_attr"), 16).bitwiseAND(0xF000)
    return first_of(
        ((n == "") | n.contains("\x00"), "DOCX 包含空名称或空字节 ZIP 条目。"),
        (n.contains("\\"), F.concat(F.lit("DOCX ZIP 条目使用了不安全的反斜杠路径："), n)),
        (n.startswith("/") | n.rlike("^[A-Za-z]:"), F.concat(F.lit("DOCX ZIP 条目使用了绝对路径："), n)),
        (F.array_contains(F.split(n, "/"), ".."), F.concat(F.lit("DOCX ZIP 条目包含路径穿越："), n)),
        (kind == 0xA000, F.concat(F.lit("DOCX ZIP 条目是符号链接，已拒绝处理："), n)),
        (F.col("flag_bits").bitwiseAND(1) == 1, F.concat(F.lit("DOCX 包含加密 ZIP 条目，无法安全离线检查："), n)),
        (F.col("copy") > 1, F.concat(F.lit("DOCX ZIP 包含重复条目："), n)),
        (~F.col("is_dir") & (F.col("file_size") > limits.member_bytes), F.concat(F.lit("DOCX 条目解压后过大："), n, F.lit(f"，上限为 {limits.member_bytes // MB} MB。"))),
        (~F.col("is_dir") & (ratio > limits.member_ratio), F.concat(F.lit("DOCX 条目压缩比异常："), n, F.lit("（"), F.when(ratio == float("inf"), "inf").otherwise(F.format_string("%.1f", ratio)), F.lit(f" 倍），上限为 {limits.member_ratio:g} 倍。"))),
    )


def inspect_archives(entries: DataFrame, *, limits: ZipLimits = ZipLimits(), required: tuple[str, ...] = REQUIRED_MEMBERS) -> DataFrame:
    """doc_id, entry_count, total_bytes, error: zip directories (doc_id, ord, name, sizes, flags) against the rules, in order."""
    copies = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("ord"))
    own = entries.withColumn("copy", copies).withColumn("broken", member_error(limits))
    plain = ~F.col("is_dir")
    sums = own.groupBy("doc_id").agg(
        F.count("*").alias("entry_count"),
        F.coalesce(F.sum(F.when(plain, F.col("file_size"))), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.when(plain, F.col("compress_size"))), F.lit(0)).alias("packed"),
        F.min_by("broken", F.when(F.col("broken").isNotNull(), F.col("ord"))).alias("broken"),
        F.collect_set(F.when(F.col("name").isin(*required), F.col("name"))).alias("present"),
    )
    ratio = compression_ratio(F.col("total_bytes"), F.col("packed"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.col("present")))
    error = first_of(
        (F.col("entry_count") > limits.entries, F.concat(F.lit("DOCX ZIP 条目过多："), F.col("entry_count"), F.lit(f"，上限为 {limits.entries}。"))),
        (F.col("broken").isNotNull(), F.col("broken")),
        (F.col("total_bytes") > limits.total_bytes, F.concat(F.lit("DOCX 解压后总体积过大："), F.format_string("%.1f", F.col("total_bytes") / MB), F.lit(f" MB，上限为 {limits.total_bytes // MB} MB。"))),
        (ratio > limits.total_ratio, F.concat(F.lit("DOCX 总压缩比异常："), F.when(ratio == float("inf"), "inf").otherwise(F.format_string("%.1f", ratio)), F.lit(f" 倍，上限为 {limits.total_ratio:g} 倍。"))),
        (F.size(missing) > 0, F.concat(F.lit("DOCX 缺少必要结构文件："), F.array_join(missing, "、"))),
    )
    return sums.select("doc_id", "entry_count", "total_bytes", error.alias("error"))


# --- PDF heads ------------------------------------------------------------------------

# Name tokens of active or external content, and what is said about each.
RISK_TOKENS = (
    ("/JavaScript", "PDF 包含 JavaScript 动作；转换不会执行脚本。"),
    ("/JS", "PDF 包含 JavaScript 动作；转换不会执行脚本。"),
    ("/OpenAction", "PDF 包含打开文件时自动触发的动作；转换不会执行该动作。"),
    ("/AA", "PDF 包含附加动作；转换不会执行该动作。"),
    ("/Launch", "PDF 包含启动外部程序的动作；转换不会执行该动作。"),
    ("/SubmitForm", "PDF 包含表单提交动作；转换不会提交数据或联网。"),
    ("/RichMedia", "PDF 包含富媒体内容；转换只处理静态文字。"),
    ("/XFA", "PDF 包含 XFA 动态表单；动态表单结构可能丢失。"),
    ("/AcroForm", "PDF 包含交互式表单；转换只提取可见文字。"),
    ("/EmbeddedFiles", "PDF 包含嵌入文件；转换不会打开或提取附件。"),
    ("/URI", "PDF 包含外部链接；转换不会主动联网访问。"),
    ("/GoToR", "PDF 包含远程文档跳转；转换不会打开外部文档。"),
)
EXECUTABLE = ("/JavaScript", "/JS", "/OpenAction", "/AA", "/Launch", "/SubmitForm", "/RichMedia", "/XFA")
EXTERNAL = ("/URI", "/GoToR", "/SubmitForm")


def tokens_in(content: Column, tokens=tuple(t for t, _ in RISK_TOKENS)) -> Column:
    """The tokens that the bytes hold, in the tokens' order."""
    return F.array_compact(F.array(*[F.when(F.contains(content, F.lit(t).cast(content_type)), F.lit(t)) for t, content_type in ((t, "binary") for t in tokens)]))


def inspect_pdf_heads(files: DataFrame, *, content: str = "content", limits: PdfLimits = PdfLimits()) -> DataFrame:
    """The files with pdf_version, has_active_content, has_embedded_files, has_external_links, warnings and error."""
    c, size = F.col(content), F.length(content)
    head = F.decode(F.substring(c, 6, 3), "ISO-8859-1")
    found = F.col("__found")
    says = F.create_map(*[F.lit(x) for pair in RISK_TOKENS for x in pair])
    error = first_of(
        (c.isNull() | (size <= 0), "PDF 文件内容为空。"),
        (size > limits.file_bytes, F.concat(F.lit("PDF 文件过大："), F.format_string("%.1f", size / MB), F.lit(f" MB，上限为 {limits.file_bytes / MB:.1f} MB。"))),
        (F.substring(c, 1, 5) != F.lit("%PDF-").cast("binary"), "文件扩展名为 PDF，但文件头不是有效的 %PDF- 标记。"),
        (head.rlike(r"[\x80-\xff]"), "PDF 版本标记不是有效的 ASCII 内容。"),
        (~head.rlike(r"^\d\.\d$"), F.concat(F.lit("PDF 版本标记无效："), F.when(head == "", "空").otherwise(head))),
        (~F.contains(F.substring(c, -4096, 4096), F.lit("%%EOF").cast("binary")), "PDF 缺少文件结束标记 %%EOF，文件可能被截断或损坏。"),
    )
    out = files.withColumn("error", error).withColumn("__found", F.when(F.col("error").isNull(), tokens_in(c)).otherwise(F.array().cast("array<string>")))
    return out.select(
        *files.columns, F.when(F.col("error").isNull(), head).alias("pdf_version"),
        F.arrays_overlap(found, F.array(*map(F.lit, EXECUTABLE))).alias("has_active_content"),
        F.array_contains(found, "/EmbeddedFiles").alias("has_embedded_files"),
        F.arrays_overlap(found, F.array(*map(F.lit, EXTERNAL))).alias("has_external_links"),
        F.array_distinct(F.transform(found, lambda t: F.element_at(says, t))).alias("warnings"), "error",
    )


@arrow_function("long")
def pdf_object_count(content):
    """Different (generation, id) of a PDF's objects, those inside of object streams too; null for what is no PDF."""
    import re
    import zlib

    import pandas as pd

    head, packed = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b"), re.compile(rb"<<([^\0]{0,2000}?/ObjStm[^\0]{0,2000}?)>>\s*stream\r?\n")

    def of(data: bytes | None) -> int | None:
        if not data or not data.startswith(b"%PDF-"):
            return None
        keys = {(int(m[2]), int(m[1])) for m in head.finditer(data)}
        for m in packed.finditer(data):
            n = re.search(rb"/N\s+(\d+)", m[1])
            try:
                body = zlib.decompressobj().decompress(data[m.end() :], 64 << 20) if b"/FlateDecode" in m[1] else data[m.end() :]
                keys |= {(0, int(x)) for x in body.split(None, 2 * int(n[1]))[: 2 * int(n[1]) : 2]} if n else set()
            except (zlib.error, ValueError):
                continue  # what can't be unpacked names no objects
        return len(keys)

    return pd.Series([of(None if c is None else bytes(c)) for c in content], dtype="Int64")


def object_count_error(count: Column, limits: PdfLimits = PdfLimits()) -> Column:
    return F.when(count > limits.objects, F.concat(F.lit("PDF 间接对象过多："), count, F.lit(f"，上限为 {limits.objects}。")))


def output_folder(raw: str) -> str:
    """The absolute path of an output folder, made if it is not there; it must lie below the user's home. A check of the driver's job options."""
    from pathlib import Path

    path, home = Path(raw).expanduser().absolute().resolve(strict=False), Path.home().resolve()
    if home not in path.parents:
        raise ValueError("输出目录必须位于当前用户主目录的子目录中。")
    path.mkdir(parents=True, exist_ok=True)
    return str(path)


def page_size_error(limits: PdfLimits = PdfLimits()) -> Column:
    """Rule of a page (page_number, width, height, user_unit): its size times its unit must be positive, finite and bounded."""
    unit = F.coalesce(F.col("user_unit").cast("double"), F.lit(1.0))
    w, h = F.abs("width") * unit, F.abs("height") * unit
    off = lambda x: x.isNull() | F.isnan(x) | (x == float("inf")) | (x <= 0)
    return first_of(
        (off(unit), "PDF 页面 UserUnit 必须是正的有限数字。"),
        (off(w) | off(h), "PDF 页面尺寸无效。"),
        ((w > limits.side_points) | (h > limits.side_points), F.concat(F.lit("PDF 第 "), F.col("page_number"), F.format_string(" 页尺寸异常：%.1f × %.1f 点，", w, h), F.lit(f"单边上限为 {limits.side_points:g} 点。"))),
    )


def renders(width: Column, height: Column, limits: PdfLimits = PdfLimits()) -> Column:
    """Whether a page's picture stays under the pixel limit; a filter before any rendering."""
    return F.ceil(width * limits.dpi / 72) * F.ceil(height * limits.dpi / 72) <= limits.render_pixels


# --- manifests ------------------------------------------------------------------------

TEXT_FIELDS = ("id", "filename", "source_url", "source_page_url", "source_repository", "source_revision", "source_license", "redistribution", "sha256", "language")
REVISION_KINDS = ("git-commit", "upstream-sha1", "retrieval-date")


def manifest_errors(samples: DataFrame) -> DataFrame:
    """id, error: the first rule of a sample row that is broken; repeated ids and file names count from the second on."""
    c, sid = F.col, F.concat(F.lit("PDF 样例 "), strip(F.col("id")))
    blank = lambda x: c(x).isNull() | ~c(x).rlike(f"[^{SPACE}]")
    nth = lambda x: F.row_number().over(Window.partitionBy(x).orderBy("ord"))
    kind, revision = F.coalesce(c("source_revision_kind"), F.lit("git-commit")), F.lower(strip(c("source_revision")))
    https = lambda x: ~strip(c(x)).rlike(r"^[hH][tT][tT][pP][sS]://[^/?#]+")
    must = lambda x: (blank(x), F.concat(sid, F.lit(f" 的 {x} 必须是非空字符串。")))
    rules = [
        (blank("id"), F.concat(F.lit("PDF 样例 #"), c("ord"), F.lit(" 的 id 必须是非空字符串。"))),
        (~strip(c("id")).rlike("^[a-z0-9]+(-[a-z0-9]+)*$") | (c("__id") > 1), F.concat(F.lit("PDF 样例 ID 无效或重复："), strip(c("id")), F.lit("。"))),
        must("filename"),
        (c("filename").rlike(r"[/\\]") | ~F.lower("filename").endswith(".pdf"), F.concat(sid, F.lit(" 的文件名不安全。"))),
        (c("__file") > 1, F.concat(F.lit("PDF 样例文件名重复："), c("filename"), F.lit("。"))),
        must("source_url"), (https("source_url"), F.concat(sid, F.lit(" 的 source_url 必须使用 HTTPS。"))),
        must("source_page_url"), (https("source_page_url"), F.concat(sid, F.lit(" 的 source_page_url 必须使用 HTTPS。"))),
        must("source_revision"),
        (~kind.isin(*REVISION_KINDS), F.concat(sid, F.lit(" 的版本固定方式无效。"))),
        ((kind == "git-commit") & (~revision.rlike("^[0-9a-f]{40}$") | ~c("source_url").contains(revision)), F.concat(sid, F.lit(" 的固定源码版本无效。"))),
        ((kind == "upstream-sha1") & ~revision.rlike("^[0-9a-f]{40}$"), F.concat(sid, F.lit(" 的上游 SHA-1 无效。"))),
        ((kind == "retrieval-date") & ~revision.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(sid, F.lit(" 的获取日期无效。"))),
        must("sha256"), (~F.lower(strip(c("sha256"))).rlike("^[0-9a-f]{64}$"), F.concat(sid, F.lit(" 的 SHA-256 无效。"))),
        (c("file_size").isNull() | (c("file_size") <= 0), F.concat(sid, F.lit(" 的文件大小无效。"))),
        (c("expected_page_count").isNull() | (c("expected_page_count") <= 0), F.concat(sid, F.lit(" 的页数无效。"))),
        (c("categories").isNull() | (F.size("categories") == 0) | F.exists("categories", lambda x: x.isNull() | (x == "")), F.concat(sid, F.lit(" 的 categories 无效。"))),
    ]
    return samples.withColumn("__id", nth("id")).withColumn("__file", nth("filename")).select("ord", "id", first_of(*rules).alias("error"))


def integrity_errors(samples: DataFrame, files: DataFrame) -> DataFrame:
    """id, errors: each sample's file (file_name, content) against its name, size, head and digest; no file is one error."""
    f = files.select(F.col("file_name").alias("filename"), F.length("content").alias("__size"), F.substring("content", 1, 5).alias("__head"), F.sha2("content", 256).alias("__sha"))
    joined = samples.join(f, "filename", "left")
    wrong = F.array_compact(F.array(
        F.when(F.col("__size") != F.col("file_size"), F.concat(F.lit("文件大小不一致：期望 "), F.col("file_size"), F.lit("，实际 "), F.col("__size"), F.lit("。"))),
        F.when(F.col("__head") != F.lit("%PDF-").cast("binary"), F.lit("文件头不是 PDF。")),
        F.when(F.col("__sha") != F.lower("sha256"), F.concat(F.lit("SHA-256 不一致："), F.col("__sha"), F.lit("。"))),
    ))
    return joined.select("id", F.when(F.col("__sha").isNull(), F.array(F.lit("路径不是普通文件。"))).otherwise(wrong).alias("errors"))
