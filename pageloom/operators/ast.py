"""Documents as JSON trees of tagged nodes: counters by tag, and rules for pictures."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.admission import first_of
from pageloom.functions.udf import arrow_function

# The tags that each counter counts.
COUNTERS = {"headings": ("Header",), "lists": ("BulletList", "OrderedList", "DefinitionList"), "tables": ("Table",), "code_blocks": ("CodeBlock",), "links": ("Link",), "images": ("Image",)}


def is_tree(tree: Column) -> Column:
    """Whether the JSON is an object with a list of blocks."""
    return F.coalesce(F.get_json_object(tree, "$.blocks").startswith("["), F.lit(False))


def stats(docs: DataFrame, *, id_col: str = "doc_id", tree_col: str = "tree") -> DataFrame:
    """doc_id and the six counters over the blocks at any depth.

    In valid JSON, an unescaped "t": followed by a quoted tag is a node's own tag:
    inside of strings the quotes are escaped. So tags are counted without a tree walk.
    """
    blocks = F.coalesce(F.get_json_object(tree_col, "$.blocks"), F.lit(""))
    out = docs.select(id_col, blocks.alias("__b"))
    count = lambda tags: F.regexp_count("__b", F.lit(r'(?<!\\)"t"\s*:\s*"(?:' + "|".join(tags) + ')"'))
    return out.select(id_col, *[count(tags).alias(name) for name, tags in COUNTERS.items()])


@arrow_function("array<string>")
def _sources(trees: pd.Series) -> pd.Series:
    def of(tree: str | None) -> list[str]:
        out, rest = [], [json.loads(tree).get("blocks", [])] if tree else []
        while rest:
            node = rest.pop()
            if isinstance(node, dict):
                c = node.get("c")
                if node.get("t") == "Image" and isinstance(c, list) and len(c) >= 3:
                    out.append(c[2][0] if isinstance(c[2], list) and c[2] else "")
                rest += reversed(list(node.values()))
            elif isinstance(node, list):
                rest += reversed(node)
        return out

    return trees.map(of, na_action=None)


def image_sources(docs: DataFrame, *, id_col: str = "doc_id", tree_col: str = "tree") -> DataFrame:
    """doc_id, ord, source of every picture, in the order of the tree."""
    return docs.select(id_col, F.posexplode(_sources(tree_col)).alias("ord", "source"))


def image_rules(images: DataFrame, assets: DataFrame, *, id_col: str = "doc_id", target: str = "docx") -> DataFrame:
    """The pictures (doc_id, ord, source) with warning and as_link: remote, outside and missing ones become links in DOCX.

    assets: doc_id, path of the files that exist below the document's folder.
    """
    s = F.col("source")
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    parts = F.filter(F.split(F.regexp_replace(s, "^\\./", ""), "/"), lambda p: (p != "") & (p != "."))
    # steps up must never be more than the steps down before them
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), F.least(a["least"], a["d"] + F.when(p == "..", -1).otherwise(1)).alias("least")))
    local = (scheme == "") & (s != "")
    outside = local & (s.startswith("/") | (depth["least"] < 0))
    known = assets.select(F.col(id_col), F.col("path").alias("__path"), F.lit(True).alias("__there"))
    out = images.withColumn("__path", F.array_join(parts, "/")).join(known, [id_col, "__path"], "left")
    remote = (scheme != "") & ~scheme.isin("file", "data")
    missing = local & F.col("__there").isNull()
    warning = first_of(
        (remote, F.concat(F.lit("远程图片未下载，已保留为链接："), s)),
        ((scheme == "file") | outside, F.concat(F.lit("图片路径超出文档目录，已阻止读取："), s)),
        (missing, F.concat(F.lit("找不到本地图片，已保留引用："), s)))
    return out.select(*images.columns, warning.alias("warning"), (F.lit(target == "docx") & warning.isNotNull()).alias("as_link"))
