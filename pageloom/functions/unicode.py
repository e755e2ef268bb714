"""Arrow functions for what Spark's SQL has no function for."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd

from pageloom.functions.udf import arrow_function


@arrow_function("string")
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@arrow_function("string")
def scoring_form(s: pd.Series) -> pd.Series:
    """NFKC without white space."""
    return s.map(lambda x: "".join(unicodedata.normalize("NFKC", x).split()), na_action="ignore")


@arrow_function("int")
def modal_count(s: pd.Series) -> pd.Series:
    """How often the most frequent character occurs, in one pass; 0 for an empty text."""

    def of(text: str) -> int:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return 0
        top = int(codes.max())
        return int((np.bincount(codes) if top < 1 << 16 else np.unique(codes, return_counts=True)[1]).max())

    return s.map(of, na_action="ignore")


@arrow_function("double")
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching characters, by longest common blocks; null if a side is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


# The kinds of differences.
_KINDS = {"replace": "替换", "delete": "漏字", "insert": "多字"}
DIFFERENCES = "array<struct<kind:string,reference:string,output:string,reference_context:string,output_context:string>>"


@arrow_function(DIFFERENCES)
def differences(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """The first 12 differences of two scoring forms, with 8 characters around."""

    def of(x: str | None, y: str | None) -> list[dict]:
        x, y = x or "", y or ""
        steps = (s for s in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if s[0] in _KINDS)
        return [
            {"kind": _KINDS[tag], "reference": x[a:b], "output": y[c:d], "reference_context": x[max(0, a - 8) : b + 8], "output_context": y[max(0, c - 8) : d + 8]}
            for _, (tag, a, b, c, d) in zip(range(12), steps, strict=False)
        ]

    return pd.Series([of(x, y) for x, y in zip(expected, actual, strict=True)])


DECODED = "struct<text:string,encoding:string,confidence:double,error:string>"
# The messages of the decoder.
EMPTY_TEXT = "文本文件为空。"
UNKNOWN_ENCODING = "无法识别文本编码，请将文件另存为 UTF-8 后重试。"


def decode_bytes(data: bytes) -> dict:
    """UTF-8 (with or without mark), then the best guess, then GB18030."""
    if not data:
        return {"text": None, "encoding": None, "confidence": None, "error": EMPTY_TEXT}
    name = "utf-8-sig" if data[:3] == b"\xef\xbb\xbf" else "utf-8"
    try:
        return {"text": data.decode(name), "encoding": name, "confidence": 1.0, "error": None}
    except UnicodeDecodeError:
        pass
    import charset_normalizer

    guess = charset_normalizer.from_bytes(data).best()
    if guess is not None and guess.encoding and "�" not in str(guess):
        return {"text": str(guess), "encoding": guess.encoding, "confidence": guess.percent_coherence / 100, "error": None}
    try:
        return {"text": data.decode("gb18030"), "encoding": "gb18030", "confidence": 0.5, "error": None}
    except UnicodeDecodeError:
        return {"text": None, "encoding": None, "confidence": None, "error": UNKNOWN_ENCODING}


@arrow_function(DECODED)
def decode(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(bytes(x) if x is not None else b"") for x in content], columns=["text", "encoding", "confidence", "error"])
