"""PDF readers and recognition engines as plug-ins: what they must give, and how their work is dealt out.

An engine is made by a factory once for each task, on the executor, and sees the files
of one partition. What it can't read is a row with an error, not a failed task. The
libraries themselves are optional; any object with the methods below will do.
"""

from __future__ import annotations

import importlib.metadata
import importlib.util
import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.sources.files import plug_in

PROFILES = {"standard": 200, "old_print": 300}  # dots per inch
# What recognition is built from.
VERSIONS = {"paddlepaddle": "3.3.0", "paddleocr": "3.7.0"}
MODELS = ("PP-OCRv5_mobile_det", "PP-OCRv5_mobile_rec", "PP-LCNet_x1_0_doc_ori")
READY = "PaddleOCR PP-OCRv5 与本地模型已就绪。"
NOT_INSTALLED = "未安装已验证的 PaddlePaddle 3.3.0 / PaddleOCR 3.7.0。"

PAGE = "doc_id long, page_number int, width double, height double, text string, text_char_count int, image_count int, image_coverage_ratio double, words array<struct<text:string,x0:double,top:double,x1:double,bottom:double,upright:boolean>>, error string"
RESULT = "doc_id long, page_number int, payload string, recognition_model string, preprocessing_profile string, error string"


class PdfReader(Protocol):
    def pages(self, content: bytes) -> Iterator[dict]:
        """The fields of PAGE of each page, but for doc_id, page_number and error."""


class OcrEngine(Protocol):
    model: str

    def recognise(self, content: bytes, page_number: int, dpi: int, profile: str) -> str:
        """The raw result as JSON: rec_texts, rec_scores, rec_polys, at the top or under res."""


class PdfPlumberReader:
    """Words, text and pictures by the optional library pdfplumber."""

    def __init__(self):
        self.library = plug_in("pdfplumber", "reading PDF pages")

    def pages(self, content: bytes) -> Iterator[dict]:
        import io

        with self.library.open(io.BytesIO(content)) as document:
            for page in document.pages:
                chars = sum(len(c["text"].strip()) for c in page.chars)
                area = sum(max(0.0, min(page.width, i["x1"]) - max(0.0, i["x0"])) * max(0.0, min(page.height, i["bottom"]) - max(0.0, i["top"])) for i in page.images)
                words = [{k: w[k] for k in ("text", "x0", "top", "x1", "bottom")} | {"upright": bool(w.get("upright", True))} for w in page.extract_words(keep_blank_chars=False, extra_attrs=["upright"])]
                yield {"width": float(page.width), "height": float(page.height), "text": page.extract_text() or "", "text_char_count": chars, "image_count": len(page.images), "image_coverage_ratio": min(1.0, area / (page.width * page.height)), "words": words}


def read_pdfs(files: DataFrame, factory: Callable[[], PdfReader] = PdfPlumberReader) -> DataFrame:
    """A row for each page of files (doc_id, content); a file that can't be read has one row with an error and no page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, word = factory(), pa.struct([("text", pa.string()), *((c, pa.float64()) for c in ("x0", "top", "x1", "bottom")), ("upright", pa.bool_())])
        kinds = {"doc_id": pa.int64(), "page_number": pa.int32(), "width": pa.float64(), "height": pa.float64(), "text": pa.string(), "text_char_count": pa.int32(), "image_count": pa.int32(), "image_coverage_ratio": pa.float64(), "words": pa.list_(word), "error": pa.string()}
        for b in batches:
            for doc_id, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [{**p, "doc_id": doc_id, "page_number": n} for n, p in enumerate(reader.pages(content or b""), 1)]
                except Exception as e:  # a file must not end the job, whatever a library raises
                    rows = [{"doc_id": doc_id, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))

    return files.select("doc_id", "content").mapInArrow(run, PAGE)


def words_of(read: DataFrame) -> DataFrame:
    """The words relation of read pages."""
    return read.where("error IS NULL").select("doc_id", "page_number", F.posexplode("words").alias("word_idx", "w")).select("doc_id", "page_number", "word_idx", "w.*")


def recognise(files: DataFrame, requests: DataFrame, factory: Callable[[], OcrEngine], profile: str = "standard") -> DataFrame:
    """Raw results of the requested pages (doc_id, page_number) of files (doc_id, content), a row for each.

    Pages of a long document are dealt to several tasks, as each is a request of its own.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    dpi = PROFILES[profile]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = factory()
        for b in batches:
            rows = []
            for doc_id, page, content in zip(b.doc_id, b.page_number, b.content, strict=True):
                row = {"doc_id": doc_id, "page_number": page, "payload": None, "recognition_model": engine.model, "preprocessing_profile": profile, "error": None}
                try:
                    row["payload"] = engine.recognise(bytes(content), int(page), dpi, profile)
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=list(rows[0]) if rows else [])

    return requests.join(files.select("doc_id", "content"), "doc_id").select("doc_id", "page_number", "content").mapInPandas(run, RESULT)


_PAYLOAD = "rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<double>>>, dt_polys array<array<array<double>>>, doc_preprocessor_res struct<angle:double>"


def results_of(raw: DataFrame) -> DataFrame:
    """doc_id, page_number, texts, scores, polygons, orientation from raw results, whose fields stand under res or at the top."""
    inner, outer = F.from_json("payload", f"res struct<{', '.join(x.replace(' ', ':', 1) for x in _PAYLOAD.split(', '))}>")["res"], F.from_json("payload", _PAYLOAD)
    own = raw.where("error IS NULL").select("doc_id", "page_number", F.coalesce(F.when(inner.isNotNull(), inner), outer).alias("p"))
    polygons = F.when(F.size("p.rec_polys") > 0, F.col("p.rec_polys")).otherwise(F.col("p.dt_polys"))
    return own.select("doc_id", "page_number", F.col("p.rec_texts").alias("texts"), F.coalesce("p.rec_scores", F.array().cast("array<double>")).alias("scores"), F.coalesce(polygons, F.array().cast("array<array<array<double>>>")).alias("polygons"), F.col("p.doc_preprocessor_res.angle").cast("int").alias("orientation_degrees"))


def prepared(gray, profile: str):
    """The picture as it is, or for old print each point as the median of the 3 x 3 points around."""
    import numpy as np

    if profile not in PROFILES:
        raise ValueError(f"不支持的 OCR 预处理模式：{profile}")
    if profile == "standard":
        return gray
    wide = np.pad(np.asarray(gray), 1, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, (3, 3)), axis=(2, 3)).astype(np.asarray(gray).dtype)


def model_root(configured: str | None = None, variable: str = "PAGELOOM_MODELS") -> Path:
    """The folder of the models: the given one, that of the environment, or one in the user's home."""
    raw = (configured or os.environ.get(variable, "")).strip()
    return Path(raw or "~/.local/share/pageloom/models").expanduser().resolve(strict=False)


def environment(root: Path | None = None) -> dict:
    """Whether recognition can run here: ready, versions, missing models, message. Nothing is imported or fetched."""
    root = Path(root) if root else model_root()
    versions = {}
    for name in VERSIONS:
        try:
            versions[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            versions[name] = None
    missing = [m for m in MODELS if not (root / m / "inference.yml").is_file()]
    if None in versions.values():
        message = NOT_INSTALLED
    elif versions != VERSIONS:
        message = f"OCR 依赖版本不匹配：PaddlePaddle {versions['paddlepaddle']} / PaddleOCR {versions['paddleocr']}；需要 3.3.0 / 3.7.0。"
    else:
        message = f"本地模型目录 {root} 不完整，缺少：" + "、".join(missing) if missing else READY
    return {"ready": message == READY, "versions": versions, "missing_models": missing, "model_root": str(root), "message": message}
