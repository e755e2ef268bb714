"""Column functions over texts; white space is what Python's str.isspace says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.unicode import modal_count, nfc

#: White space as a class of Java's regular expressions.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
#: Where splitlines() ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
# Ideographs, as counted for acceptance, for recognised text and in layout.
CJK_SCORED = r"[㐀-䶿一-鿿]"
CJK_RECOGNISED = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def lines_of(text: Column) -> Column:
    """Lines as splitlines() gives them: no empty one behind a final line end."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def normalize(text: Column) -> Column:
    """Extracted text as NFC, without invisible characters, runs of blanks and of empty lines."""
    out = F.regexp_replace(F.coalesce(composed(text), F.lit("")), "\r\n?", "\n")
    out = F.regexp_replace(out, "[​﻿]", "")
    out = F.regexp_replace(out, "[\t  ]+", " ")
    out = F.array_join(F.transform(F.split(out, "\n"), strip), "\n")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def cjk_count(text: Column, kind: str = CJK_SCORED) -> Column:
    return F.regexp_count(text, F.lit(kind))


def latin_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def ratio(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total).otherwise(F.lit(0.0))


def composed(text: Column) -> Column:
    """The text as NFC. Texts that have only characters below U+0300 are; the others alone go to Python."""
    return F.coalesce(nfc(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def rounded(x: Column, digits: int) -> Column:
    """The nearest number of so many digits to the exact binary value, ties to even."""
    one, half = 10.0**-digits, 0.5 * 10.0**-digits
    up = F.abs(x) >= half if round(half, digits) else F.abs(x) > half  # the half as a binary number may be more than a half
    return F.when(F.abs(x) < one, F.when(up, F.signum(x) * one).otherwise(0.0)).otherwise(F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double"))


def finite(x: Column, default: float = 0.0) -> Column:
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def ordered_distinct(items: Column) -> Column:
    """First occurrences, without empty strings."""
    return F.filter(F.array_distinct(items), lambda x: x != "")


# The messages of the text-layer check.
FEW_CHARS = "文字层中可用字符过少。"
REPLACED = "文字层包含较多 Unicode 替换符，可能已乱码。"
CONTROLS = "文字层包含异常控制字符。"
PRIVATE = "文字层大量使用 Unicode 私用区字符，字体映射可能不完整。"
REPEATED = "文字层出现异常的单字高频重复，字体映射可能损坏。"


def quality(text: Column, least_chars: int = 3) -> dict[str, Column]:
    """The text layer's counts: total, replaced, controls, private, meaningful, modal; a first projection."""
    seen = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]", "")
    return {"seen": seen, "meaning": F.regexp_replace(seen, r"[�\p{Cc}\p{Co}]", "")}


def quality_counts(seen: Column, meaning: Column) -> dict[str, Column]:
    return {
        "total": F.length(seen),
        "replaced": F.regexp_count(seen, F.lit("�")),
        "controls": F.regexp_count(seen, F.lit(r"\p{Cc}")),
        "private": F.regexp_count(seen, F.lit(r"\p{Co}")),
        "meaningful": F.length(meaning),
        "modal": modal_count(meaning),
    }


def quality_score(least_chars: int = 3) -> dict[str, Column]:
    """score, acceptable, ratios and warnings from the columns of quality_counts."""
    c = F.col
    usable = c("total") - c("replaced") - c("controls") - c("private")
    r, k, p, m = (ratio(c(a), c(b)) for a, b in (("replaced", "total"), ("controls", "total"), ("private", "total"), ("modal", "meaningful")))
    rules = (
        (usable < least_chars, FEW_CHARS, F.lit(0.65)),
        (r > 0.01, REPLACED, F.least(F.lit(0.6), r * 4)),
        (k > 0.005, CONTROLS, F.least(F.lit(0.5), k * 6)),
        (p > 0.02, PRIVATE, F.least(F.lit(0.6), p * 4)),
        ((c("meaningful") >= 20) & (m > 0.45), REPEATED, F.lit(0.55)),
    )
    score = F.lit(1.0)
    for hit, _, cost in rules:
        score = score - F.when(hit, cost).otherwise(0.0)
    warnings = F.array_compact(F.array(*[F.when(hit, F.lit(text)) for hit, text, _ in rules]))
    score = rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)
    return {
        "score": score,
        "acceptable": (F.size(warnings) == 0) & (score >= 0.7),
        "usable_char_count": F.greatest(F.lit(0), usable),
        "replacement_ratio": rounded(r, 4),
        "control_ratio": rounded(k, 4),
        "private_use_ratio": rounded(p, 4),
        "dominant_char_ratio": rounded(m, 4),
        "warnings": warnings,
    }


def with_quality(df, text_col: str = "text", least_chars: int = 3):
    """The rows with the columns of quality_score; helper columns go again."""
    names = df.columns
    df = df.select("*", *(v.alias(k) for k, v in quality(F.col(text_col)).items()))
    df = df.select(*names, *(v.alias(k) for k, v in quality_counts(F.col("seen"), F.col("meaning")).items()))
    return df.select(*names, *(v.alias(k) for k, v in quality_score(least_chars).items()))
