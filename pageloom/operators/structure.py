"""Structure of plain text: an ordered table of line rules, and the Markdown it stands for.

`line_rules` classifies lines with windows, for texts without fenced or indented blocks
and pipe tables; `to_markdown` reads whole texts, one row each, where such blocks decide
how far they reach.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import is_blank, strip
from pageloom.functions.udf import arrow_function

# The patterns of structural lines and the ends of sentences.
_NUM = "一二三四五六七八九十百千万"
CHAPTER = rf"^第[零〇{_NUM}两\d]+([章节篇部卷])(?:[：:、.．\s]+)?(.+)?$"
ENUMERATED = rf"^([{_NUM}]+)、\s*(.+)$"
BRACKETED = rf"^[（(]([{_NUM}\d]+)[）)]\s*(.+)$"
DECIMAL = r"^(\d+(?:\.\d+)+)[.、]?\s+(.+)$"
NUMBERED = r"^(\d+)[.、]\s*(.+)$"
BULLET = r"^\s*[-*+]\s+(.+)$"
SENTENCE_END = "。！？；.!?;"
INFERRED = ("通过短行规则推断了 ", " 个标题，请核对标题层级。")


def line_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, raw, rule, level: the first rule of each line, with neighbours from windows."""
    raw = F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n")
    w = Window.partitionBy(id_col).orderBy("line_no")
    u = lambda p: F.lit("(?U)" + p)
    lines = docs.select(id_col, F.posexplode(raw).alias("line_no", "raw")).withColumn("s", strip(F.col("raw")))
    lines = lines.withColumn("blank", is_blank(F.col("raw"))).withColumn("enum", F.regexp_like("s", u(ENUMERATED))).withColumn("tabs", F.when(~F.col("blank") & F.col("raw").contains("\t"), F.size(F.split("raw", "\t"))))
    lines = lines.withColumn("pb", F.coalesce(F.lag("blank").over(w), F.lit(True))).withColumn("nb", F.coalesce(F.lead("blank").over(w), F.lit(True)))
    lines = lines.withColumn("near", F.coalesce(F.lag("enum").over(w), F.lit(False)) | F.coalesce(F.lead("enum").over(w), F.lit(False)))
    # maximal runs of lines with tabs are tables if all have as many cells
    run = F.when(F.col("tabs").isNotNull(), F.col("line_no") - F.count("tabs").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("run", run)
    whole = Window.partitionBy(id_col, "run")
    table = F.col("tabs").isNotNull() & (F.count("tabs").over(whole) >= 2) & (F.min("tabs").over(whole) == F.max("tabs").over(whole)) & (F.col("tabs") >= 2)
    lines = lines.withColumn("table", table)
    s, n = F.col("s"), F.length("s")
    ends = F.substring(s, -1, 1).isin(*SENTENCE_END)
    numbered = F.regexp_like(s, u(NUMBERED))
    alone = F.col("pb") & F.col("nb")
    title = alone & n.between(2, 24) & ~ends & ~s.startswith("http://") & ~s.startswith("https://") & F.regexp_like(s, u(r"\w"))
    rule = (
        F.when(F.col("blank"), "blank").when(F.col("table"), "tab_table").when(F.col("raw").startswith("    ") | F.col("raw").startswith("\t"), "code")
        .when(F.regexp_like(s, u(CHAPTER)), "chapter").when(F.regexp_like(s, u(DECIMAL)), "decimal").when(F.col("enum") & ~F.col("near"), "enumerated")
        .when(F.regexp_like(s, u(BRACKETED)), "bracketed").when(numbered & alone & (n <= 30) & ~ends, "numbered_title")
        .when(F.regexp_like(s, u(BULLET)) | numbered | F.col("near"), "list").when(title, "short_title").otherwise("paragraph"))
    dots = F.length(F.regexp_replace(F.regexp_extract(s, "(?U)" + DECIMAL, 1), "[^.]", ""))
    level = (
        F.when(F.col("rule") == "chapter", F.when(F.regexp_extract(s, "(?U)" + CHAPTER, 1) == "节", 2).otherwise(1))
        .when(F.col("rule") == "decimal", F.least(dots + 2, F.lit(6))).when(F.col("rule").isin("enumerated", "numbered_title", "short_title"), 2).when(F.col("rule") == "bracketed", 3))
    return lines.withColumn("rule", rule).select(id_col, "line_no", "raw", "rule", level.cast("int").alias("level"))


def paragraphs(lines: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, paragraph, text of the paragraph lines of line_rules: runs without a structural or blank line between."""
    w = Window.partitionBy(id_col).orderBy("line_no")
    own = lines.withColumn("paragraph", F.sum(F.when(F.col("rule") != "paragraph", 1).otherwise(0)).over(w)).where("rule = 'paragraph'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", strip(F.col("raw")).alias("s")))), lambda x: x["s"]), "\n")
    return own.groupBy(id_col, "paragraph").agg(joined(text).alias("text"))


def joined(text):
    """Lines of a paragraph as one: no space between ideographs, one elsewhere."""
    return F.regexp_replace(F.regexp_replace(text, "(?<=[一-鿿])\n(?=[一-鿿])", ""), "\n", " ")


# --- whole texts ----------------------------------------------------------------------

_HEADINGS = ((re.compile(CHAPTER), lambda m: 2 if m[1] == "节" else 1), (re.compile(DECIMAL), lambda m: min(m[1].count(".") + 2, 6)))
_ENUMERATED, _BRACKETED, _NUMBERED, _BULLET = map(re.compile, (ENUMERATED, BRACKETED, NUMBERED, BULLET))
_RULE_CELL = re.compile(r":?-{3,}:?$")


def cells_of(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def pipe_row(cells: list[str]) -> str:
    return "| " + " | ".join(cells) + " |"


class Reader:
    """Reads one text's lines into Markdown: block readers first, then line rules, else paragraphs."""

    def __init__(self, text: str):
        self.lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.bare = [x.strip() for x in self.lines]
        self.out: list[str] = []
        self.paragraph: list[str] = []
        self.inferred = 0

    def blank(self, i: int) -> bool:
        return not 0 <= i < len(self.bare) or not self.bare[i]

    def until(self, i: int, test) -> int:
        while i < len(self.lines) and test(i):
            i += 1
        return i

    def close(self) -> None:
        if self.paragraph:
            text = re.sub("(?<=[一-鿿])\n(?=[一-鿿])", "", "\n".join(self.paragraph)).replace("\n", " ")
            self.out += [text, ""]
            self.paragraph = []

    def block(self, i: int) -> tuple[list[str], int] | None:
        """The output and end of a fenced, piped, tabbed or indented block at line i."""
        if self.bare[i].startswith("```"):
            end = self.until(i + 1, lambda k: not self.bare[k].startswith("```"))
            end = min(end + 1, len(self.lines))
            return [self.bare[i], *self.lines[i + 1 : end], ""], end
        if "|" in self.lines[i] and i + 1 < len(self.lines) and "|" in self.lines[i + 1] and all(map(_RULE_CELL.match, cells_of(self.lines[i + 1]))):
            end = self.until(i, lambda k: self.bare[k] and "|" in self.lines[k])
            return [*self.bare[i:end], ""], end
        end = self.until(i, lambda k: self.bare[k] and "\t" in self.lines[k])
        rows = [[c.strip().replace("|", "\\|") for c in x.split("\t")] for x in self.lines[i:end]]
        if len(rows) >= 2 and {len(r) for r in rows} == {len(rows[0])}:
            return [pipe_row(rows[0]), pipe_row(["---"] * len(rows[0])), *map(pipe_row, rows[1:]), ""], end
        if self.lines[i].startswith(("    ", "\t")):
            end = self.until(i, lambda k: not self.bare[k] or self.lines[k].startswith(("    ", "\t")))
            return ["```", *(x[1:] if x.startswith("\t") else x[4:] for x in self.lines[i:end]), "```", ""], end
        return None

    def line(self, i: int) -> list[str] | None:
        """The output of a heading or list line, or None for a paragraph's."""
        s = self.bare[i]
        for pattern, level in _HEADINGS:
            if m := pattern.match(s):
                return ["#" * level(m) + " " + s, ""]
        near = any(0 <= k < len(self.bare) and _ENUMERATED.match(self.bare[k]) for k in (i - 1, i + 1))
        own, numbered, alone = _ENUMERATED.match(s), _NUMBERED.match(s), self.blank(i - 1) and self.blank(i + 1)
        if own and not near:
            return ["## " + s, ""]
        if _BRACKETED.match(s):
            return ["### " + s, ""]
        if numbered and alone and len(s) <= 30 and s[-1] not in SENTENCE_END:
            return ["## " + s, ""]
        if near or numbered or _BULLET.match(s):
            return ["1. " + own[2] if near and own else s, *[""] * self.blank(i + 1)]
        if alone and 2 <= len(s) <= 24 and s[-1] not in SENTENCE_END and not s.startswith(("http://", "https://")) and re.search(r"\w", s):
            self.inferred += 1
            return ["## " + s, ""]
        return None

    def read(self) -> tuple[str, list[str]]:
        i = 0
        while i < len(self.lines):
            if not self.bare[i]:
                self.close()
                i += 1
                continue
            found, end = self.block(i) or (self.line(i), i + 1)
            if found is None:
                self.paragraph.append(self.bare[i])
            else:
                self.close()
                self.out += found
            i = end
        self.close()
        notes = [f"{INFERRED[0]}{self.inferred}{INFERRED[1]}"] if self.inferred else []
        return "\n".join(self.out).strip() + "\n", notes


@arrow_function("struct<markdown:string,warnings:array<string>>")
def _markdown(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([Reader(t or "").read() for t in texts], columns=["markdown", "warnings"])


def to_markdown(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with markdown and warnings; texts stay in their rows, nothing is shuffled."""
    return docs.withColumn("__m", _markdown(text_col)).select(*docs.columns, "__m.markdown", "__m.warnings")


def tidy_separators(markdown):
    """Table separators at their shortest and lines without blanks at their ends; a text ends with one line end."""
    cell = r"[ \t]*:?-{3,}:?[ \t]*"
    lines = F.transform(F.split(markdown, "\n"), lambda x: F.when(
        F.regexp_like(F.trim(x), F.lit(rf"^\|(?:{cell}\|)+$")),
        F.concat(F.lit("| "), F.array_join(F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.regexp_replace(F.trim(c), "-{3,}", "---")), " | "), F.lit(" |"))).otherwise(F.regexp_replace(x, r"\s+$", "")))
    return F.concat(F.regexp_replace(F.array_join(lines, "\n"), r"\s+$", ""), F.lit("\n"))
