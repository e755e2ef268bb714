"""Readers: text files, Markdown, DOCX and archives as rows of blocks; failures are columns.

A document in between is an array of blocks (kind, level, text, rows): heading,
paragraph, list, code or table. PDF parsing and recognition are plug-ins that supply the
relations pages, words and ocr_blocks.
"""

from __future__ import annotations

import importlib.util
import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions.unicode import decode
from pageloom.model import BLOCKS, ZipLimits
from pageloom.operators.structure import cells_of
from pageloom.functions.udf import arrow_function

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, paths) -> DataFrame:
    """doc_id, file_name, length, content; a path that does not exist fails the read."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "content")


def texts(rows: DataFrame) -> DataFrame:
    """Files with text, encoding, confidence and error."""
    return rows.withColumn("__d", decode("content")).select(*rows.columns, "__d.*")


def block(kind: str, text: str = "", level: int = 0, rows=None) -> dict:
    return {"kind": kind, "level": level, "text": text, "rows": rows or []}


def markdown_blocks(text: str) -> list[dict]:
    """Headings, fenced code, pipe tables, list items and paragraphs of Markdown."""
    out, lines, i = [], text.replace("\r\n", "\n").split("\n"), 0
    while i < len(lines):
        s = lines[i].strip()
        if s.startswith("```"):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith("```")), len(lines))
            out.append(block("code", "\n".join(lines[i + 1 : end])))
            i = end
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", s):
            out.append(block("heading", m[2], len(m[1])))
        elif "|" in s and i + 1 < len(lines) and "-" in lines[i + 1] and all(re.fullmatch(r":?-{3,}:?", c) for c in cells_of(lines[i + 1])):
            end = i
            while end < len(lines) and "|" in lines[end]:
                end += 1
            out.append(block("table", rows=[[c.replace("\\|", "|") for c in re.split(r"\s*(?<!\\)\|\s*", x.strip().strip("|").strip())] for k, x in enumerate(lines[i:end]) if k != 1]))
            i = end - 1
        elif m := re.match(r"(\s*)(?:[-*+]|\d+[.)])\s+(.*)", lines[i]):
            out.append(block("list", m[2].strip(), len(m[1]) // 2))
        elif s:
            if out and out[-1]["kind"] == "paragraph" and i and lines[i - 1].strip():
                out[-1]["text"] += " " + s
            else:
                out.append(block("paragraph", s))
        i += 1
    return out


def docx_blocks(data: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(p) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in p.iter())

    out = []
    for x in body if body is not None else ():
        if x.tag == f"{_W}tbl":
            out.append(block("table", rows=[[" ".join(text(p) for p in c.iter(f"{_W}p")) for c in r.iter(f"{_W}tc")] for r in x.iter(f"{_W}tr")]))
        elif x.tag == f"{_W}p" and (t := text(x).strip()):
            style = x.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            level = re.fullmatch(r"Heading(\d)", name)
            listed = x.find(f"{_W}pPr/{_W}numPr") is not None or name.startswith("List")
            out.append(block("heading", t, int(level[1])) if level else block("code" if name == "SourceCode" else "list" if listed else "paragraph", t))
    return out


@arrow_function(f"struct<blocks:{BLOCKS},error:string>")
def parse(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """Blocks of Markdown or DOCX bytes; what can't be read is an error."""

    def of(data, k) -> tuple:
        try:
            if data is None:
                return [], "文件内容为空。"
            return (docx_blocks(bytes(data)) if k == "docx" else markdown_blocks(bytes(data).decode("utf-8-sig"))), None
        except (zipfile.BadZipFile, KeyError, ET.ParseError, UnicodeDecodeError, NotImplementedError, RuntimeError) as e:
            return [], f"{type(e).__name__}: {e}"

    return pd.DataFrame([of(c, k) for c, k in zip(content, kind, strict=True)], columns=["blocks", "error"])


ENTRIES = "array<struct<ord:int,name:string,file_size:long,compress_size:long,flag_bits:int,external_attr:long,is_dir:boolean,actual_size:long,external_links:boolean>>"


@arrow_function(f"struct<entries:{ENTRIES},error:string>")
def _directory(content: pd.Series) -> pd.DataFrame:
    limits = ZipLimits()

    def of(data) -> tuple:
        if data is None or not zipfile.is_zipfile(io.BytesIO(bytes(data))):
            return [], "文件扩展名为 DOCX，但内容不是有效的 DOCX ZIP 容器。"
        out, spent = [], 0
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                for k, e in enumerate(z.infolist()):
                    size, links = None, False
                    # members over their declared limits, or encrypted, are not opened
                    if not e.is_dir() and not e.flag_bits & 1 and e.file_size <= limits.member_bytes and spent + e.file_size <= limits.total_bytes:
                        with z.open(e) as f:
                            body = f.read(e.file_size + 1)
                        size, spent = len(body), spent + len(body)
                        links = e.filename.lower().endswith(".rels") and bool(re.search(rb"""targetmode\s*=\s*['"]external['"]""", body, re.I))
                    out.append({"ord": k, "name": e.filename, "file_size": e.file_size, "compress_size": e.compress_size, "flag_bits": e.flag_bits, "external_attr": e.external_attr, "is_dir": e.is_dir(), "actual_size": size, "external_links": links})
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
            return out, f"DOCX ZIP 容器损坏或使用了不支持的压缩方式：{e}"
        return out, None

    return pd.DataFrame([of(c) for c in content], columns=["entries", "error"])


def zip_entries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id and the fields of each archive's entries; doc_id, error of each archive that can't be read)."""
    read = rows.select("doc_id", _directory("content").alias("d"))
    return read.select("doc_id", F.explode("d.entries").alias("e")).select("doc_id", "e.*"), read.where("d.error IS NOT NULL").select("doc_id", "d.error")


@arrow_function("array<struct<rel_path:string,content:binary>>")
def _media(content: pd.Series, folder: pd.Series) -> pd.Series:
    limits = ZipLimits()

    def of(data, name) -> list[dict]:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(data or b""))) as z:
                found = [e for e in z.infolist() if e.filename.startswith("word/media/") and not e.is_dir() and e.file_size <= limits.member_bytes]
                return [{"rel_path": f"{name}/media/{e.filename.rsplit('/', 1)[1]}", "content": z.read(e)} for e in found]
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
            return []

    return pd.Series([of(c, f) for c, f in zip(content, folder, strict=True)])


def media(rows: DataFrame, stem: str = "stem") -> DataFrame:
    """doc_id, rel_path, content of the pictures in DOCX files (doc_id, stem, content), under <stem>_assets, or _assets_2 and so on where stems repeat."""
    nth = F.row_number().over(Window.partitionBy(stem).orderBy("doc_id"))
    folder = F.concat(F.col(stem), F.lit("_assets"), F.when(nth > 1, F.concat(F.lit("_"), nth)).otherwise(""))
    named = rows.select("doc_id", stem).withColumn("folder", folder).select("doc_id", "folder")
    return rows.select("doc_id", "content").join(named, "doc_id").select("doc_id", F.explode(_media("content", "folder")).alias("m")).select("doc_id", "m.*")


def plug_in(module: str, purpose: str):
    """An optional library, or a clear error that says what it is for."""
    if importlib.util.find_spec(module) is None:
        raise RuntimeError(f"{purpose} needs the optional library {module}, which is not installed; supply the relations instead")
    return importlib.import_module(module)
