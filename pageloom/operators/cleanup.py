"""What repeats across the pages of a document, removed in this order: vertical margins, prefixes, headers and footers.

Documents are the units of parallel work: pages meet by doc_id once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import lines_of, strip
from pageloom.functions.unicode import similarity
from pageloom.functions.udf import arrow_function

MARGIN_CHARS = 120
LEAST_PREFIX, LEAST_REST, LEAST_CHARS, LEAST_PREVIOUS = 10, 3, 200, 10


def marginal(lines: Column, last: bool = False) -> Column:
    """The first or last line that is not blank, stripped; null if there is none or it is long."""
    full = F.filter(F.transform(lines, strip), lambda x: x != "")
    line = F.try_element_at(full, F.lit(-1 if last else 1))
    return F.when(F.length(line) <= MARGIN_CHARS, line)


def repeated_margins(pages: DataFrame) -> DataFrame:
    """doc_id, place (header or footer), line, pages: margins on at least half of the pages, 2 at least, of documents of 3 pages or more."""
    lines = pages.select("doc_id", lines_of(F.col("text")).alias("lines"))
    sized = lines.groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 3")
    found = lines.select("doc_id", F.explode(F.array(F.struct(F.lit("header").alias("place"), marginal(F.col("lines")).alias("line")), F.struct(F.lit("footer").alias("place"), marginal(F.col("lines"), True).alias("line")))).alias("m"))
    counts = found.where("m.line IS NOT NULL").groupBy("doc_id", "m.place", "m.line").agg(F.count("*").alias("pages"))
    return counts.join(sized, "doc_id").where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.5))).select("doc_id", "place", "line", "pages")


def remove_margins(pages: DataFrame) -> DataFrame:
    """The pages without repeated headers and footers; texts of documents without any stay untouched."""
    lists = repeated_margins(pages).groupBy("doc_id").agg(*[F.collect_set(F.when(F.col("place") == p, F.col("line"))).alias(f"__{p}s") for p in ("header", "footer")])
    out = pages.join(lists, "doc_id", "left").withColumn("__lines", lines_of(F.col("text")))

    def blanked(lines: Column, known: str, last: bool) -> Column:
        places = F.filter(F.transform(lines, lambda x, i: F.when(strip(x) != "", i)), lambda i: i.isNotNull())
        at = F.try_element_at(places, F.lit(-1 if last else 1))
        hit = F.array_contains(known, strip(F.get(lines, at)))
        return F.transform(lines, lambda x, i: F.when(hit & (i == at), F.lit("")).otherwise(x))

    out = out.withColumn("__lines", F.when(F.col("__headers").isNotNull(), blanked(F.col("__lines"), "__headers", False)))
    out = out.withColumn("__lines", blanked(F.col("__lines"), "__footers", True))
    text = F.when(F.col("__headers").isNull(), F.col("text")).otherwise(strip(F.array_join("__lines", "\n")))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in pages.columns])


def prefix_lengths(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, longest: lines at the start of a page that stand together in the page before, without the cascade.

    The longest run on a diagonal of equal lines that begins with the page's first line.
    """
    full = F.filter(F.transform(lines_of(F.col("text")), strip), lambda x: x != "")
    before = Window.partitionBy("doc_id").orderBy("page_number")
    both = pages.select("doc_id", "page_number", full.alias("now")).withColumn("was", F.lag("now").over(before)).where("was IS NOT NULL")
    return both.select("doc_id", "page_number", _shared_prefix("was", "now").alias("longest"))


@arrow_function("int")
def _shared_prefix(was, now):
    import pandas as pd

    return pd.Series([_common_prefix(list(x), list(y)) if y is not None else 0 for x, y in zip(was, now, strict=True)], dtype="int32")


def _common_prefix(previous: list[str], current: list[str]) -> int:
    """The longest prefix of current that is a run of previous (failure links of string matching, one pass)."""
    link, best, k = [0] * len(current), 0, 0
    for i in range(1, len(current)):
        while k and current[i] != current[k]:
            k = link[k - 1]
        k += current[i] == current[k]
        link[i] = k
    k = 0
    for line in previous:
        if k == len(current):
            k = link[k - 1]
        while k and line != current[k]:
            k = link[k - 1]
        k += line == current[k]
        best = max(best, k)
    return best


@arrow_function("array<struct<page_number:int,source:string,text:string,removed:int>>")
def _without_prefixes(pages):
    import pandas as pd

    def cleaned(rows):
        out = []
        for row in rows:
            text, removed = row["text"], 0
            lines = [x.strip() for x in (text or "").splitlines() if x.strip()]
            if out and out[-1]["source"] == row["source"] == "native":
                before = [x.strip() for x in (out[-1]["text"] or "").splitlines() if x.strip()]
                n = _common_prefix(before, lines) if len(before) >= LEAST_PREVIOUS and len(lines) >= LEAST_PREFIX + LEAST_REST else 0
                if n >= LEAST_PREFIX and len(lines) - n >= LEAST_REST and sum(map(len, lines[:n])) >= LEAST_CHARS:
                    text, removed = "\n".join(lines[n:]), n
            out.append({"page_number": row["page_number"], "source": row["source"], "text": text, "removed": removed})
        return out

    return pd.Series([cleaned(r) for r in pages])


def remove_prefixes(pages: DataFrame) -> DataFrame:
    """The pages (doc_id, page_number, source, text) with removed: lines cut from the start that end the cleaned page before.

    A page is compared with the page before as that was cleaned, so cuts cascade: a
    fold over a document's pages, of which only native ones that follow each other count.
    """
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "source", "text"))).alias("p"))
    return docs.select("doc_id", F.explode(_without_prefixes("p")).alias("p")).select("doc_id", "p.page_number", "p.source", "p.text", "p.removed")


def repeated_marginals(candidates: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, page_number, line_index of marginal lines (doc_id, page_number, line_index, line) that stand on many pages.

    Lines are alike if enough of their letters and digits match; a line goes if alike
    ones stand on at least half of the pages, and 3 at least. sizes: doc_id, n pages.
    Equal lines are compared once.
    """
    bare = candidates.select("doc_id", "page_number", "line_index", F.regexp_replace("line", r"[^\p{L}\p{N}]", "").alias("s")).where("s <> ''").join(sizes.where("n >= 3"), "doc_id")
    each = bare.groupBy("doc_id", "s").agg(F.collect_set("page_number").alias("pages"))
    a, b = (each.select("doc_id", F.col("s").alias(x), F.col("pages").alias(f"pages_{x}")) for x in "ab")
    pairs = a.join(b, "doc_id").withColumn("least", F.when(F.least(F.length("a"), F.length("b")) >= 8, 0.65).otherwise(0.9))
    # matching characters are at most those of the shorter line
    pairs = pairs.where(2.0 * F.least(F.length("a"), F.length("b")) / (F.length("a") + F.length("b")) >= F.col("least"))
    alike = pairs.where((F.col("a") == F.col("b")) | (similarity("a", "b") >= F.col("least")))
    pages = alike.groupBy("doc_id", "a").agg(F.size(F.array_distinct(F.flatten(F.collect_list("pages_b")))).alias("pages"))
    hit = bare.join(pages.withColumnRenamed("a", "s"), ["doc_id", "s"]).where(F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.5)))
    return hit.select("doc_id", "page_number", "line_index")


def remove_marginals(ocr: DataFrame) -> DataFrame:
    """Recognised pages (doc_id, page_number, text, marginal_line_indices) without marginal lines that repeat."""
    lines = lines_of(F.col("text"))
    candidates = ocr.select("doc_id", "page_number", lines.alias("lines"), F.explode("marginal_line_indices").alias("line_index")).select("doc_id", "page_number", "line_index", F.get("lines", F.col("line_index")).alias("line")).where("line IS NOT NULL")
    gone = repeated_marginals(candidates, ocr.groupBy("doc_id").agg(F.count("*").alias("n"))).groupBy("doc_id", "page_number").agg(F.collect_set("line_index").alias("__gone"))
    out = ocr.join(gone, ["doc_id", "page_number"], "left")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in ocr.columns])


def clean_pages(pages: DataFrame) -> DataFrame:
    """Prefixes, then headers and footers; vertical margins were removed from the recognised pages before."""
    return remove_margins(remove_prefixes(pages).drop("removed"))
