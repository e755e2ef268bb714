"""Writers: blocks as plain text, Markdown or DOCX; results that never overwrite."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pageloom.functions.udf import arrow_function

# Font and sizes of the written documents.
FONT, SIZE = "PingFang SC", 11


def plain(blocks: Column) -> Column:
    """Plain text: tables with tabs, an empty line between blocks, list items without one."""
    body = F.transform(blocks, lambda b: F.when(b["kind"] == "table", F.array_join(F.transform(b["rows"], lambda r: F.array_join(r, "\t")), "\n")).when(b["kind"] == "list", F.concat(F.lit("- "), b["text"])).otherwise(b["text"]))
    return _spaced(body, blocks)


def gfm(blocks: Column) -> Column:
    def row(r: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))

    def table(b: Column) -> Column:
        rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(b["rows"], F.lit(0)), lambda c: F.lit("---")), " | "), F.lit(" |"))
        rows = F.transform(b["rows"], row)
        return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.size(rows))), "\n")

    body = F.transform(blocks, lambda b: F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"])).when(b["kind"] == "code", F.concat(F.lit("```\n"), b["text"], F.lit("\n```"))).when(b["kind"] == "list", F.concat(F.repeat(F.lit("  "), b["level"]), F.lit("- "), b["text"])).when(b["kind"] == "table", table(b)).otherwise(b["text"]))
    return _spaced(body, blocks)


def _spaced(body: Column, blocks: Column) -> Column:
    listed = lambda k: F.coalesce(F.get(blocks, k)["kind"] == "list", F.lit(False))
    parts = F.transform(body, lambda t, i: F.concat(F.when(i == 0, "").when(listed(i) & listed(i - 1), "\n").otherwise("\n\n"), t))
    return F.concat(F.array_join(parts, ""), F.lit("\n"))


def _docx(blocks) -> bytes:
    def run(text: str) -> str:
        return f'<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'

    def paragraph(text: str, style: str | None) -> str:
        return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + run(text) + "</w:p>"

    body = []
    for b in blocks:
        if b["kind"] == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c or '', None)}</w:tc>" for c in r) + "</w:tr>" for r in b["rows"])
            body.append(f"<w:tbl>{rows}</w:tbl>")
        else:
            style = {"heading": f"Heading{b['level']}", "code": "SourceCode", "list": "ListParagraph"}.get(b["kind"])
            body += [paragraph(t, style) for t in (b["text"] or "").split("\n")]
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    fonts = f'<w:rFonts w:ascii="{FONT}" w:hAnsi="{FONT}" w:eastAsia="{FONT}"/>'
    styles = f'<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:rPr>{fonts}<w:sz w:val="{2 * SIZE}"/></w:rPr></w:style>'
    styles += "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:rPr>{fonts}</w:rPr></w:style>' for k in range(1, 7))
    types = "".join(f'<Override PartName="/word/{p}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{k}+xml"/>' for p, k in (("document", "document.main"), ("styles", "styles")))
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "word/styles.xml": f"{head}<w:styles {ns}>{styles}</w:styles>",
        "word/document.xml": f"{head}<w:document {ns}><w:body>{''.join(body)}</w:body></w:document>",
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buffer.getvalue()


@arrow_function("binary")
def docx(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: _docx(b) if b is not None else None, na_action=None)


def publish(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write a result to a new place; one that exists fails the write and stays as it is."""
    df.write.mode("errorifexists").format(kind).save(path)


def write_files(results: DataFrame, folder: str) -> DataFrame:
    """doc_id, path of each delivered result (target_file, output), written to a folder that all executors see.

    A file that is there already is never overwritten: the new one takes the next free
    number behind its name. A result is complete once it has its name. Rows are written
    when the returned rows are first asked for, which this does.
    """
    import os
    import tempfile

    def put(name: str, data: bytes) -> str:
        stem, suffix = os.path.splitext(os.path.basename(name))
        handle, part = tempfile.mkstemp(dir=folder, prefix=".part-")
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        n = 0
        while True:
            path = os.path.join(folder, f"{stem}_{n}{suffix}" if n else f"{stem}{suffix}")
            try:
                os.link(part, path)
            except FileExistsError:
                n += 1
                continue
            os.unlink(part)
            return path

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "path": [put(n, bytes(d)) for n, d in zip(b.target_file, b.output, strict=True)]})

    ready = results.where("success AND output IS NOT NULL").select("doc_id", "target_file", "output")
    rows = ready.mapInPandas(run, "doc_id long, path string").collect()  # a batch has a bounded number of files
    return results.sparkSession.createDataFrame(rows, "doc_id long, path string")
