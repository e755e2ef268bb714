"""Schemas, limits and fixed texts of the engine."""

from __future__ import annotations

from dataclasses import dataclass

MB = 1024 * 1024

# Input suffixes and target formats.
SUFFIXES = {".txt": "txt", ".md": "markdown", ".markdown": "markdown", ".docx": "docx", ".pdf": "pdf"}
TARGETS = {"txt": ".txt", "markdown": ".md", "docx": ".docx"}


@dataclass(frozen=True)
class BatchLimits:
    file_bytes: int = 50 * MB
    batch_bytes: int = 200 * MB
    files: int = 100


@dataclass(frozen=True)
class ZipLimits:
    entries: int = 5_000
    total_bytes: int = 500 * MB
    member_bytes: int = 100 * MB
    total_ratio: float = 200.0
    member_ratio: float = 1_000.0


@dataclass(frozen=True)
class PdfLimits:
    file_bytes: int = 50 * MB
    pages: int = 1_000
    objects: int = 200_000
    side_points: float = 14_400.0
    render_pixels: int = 30_000_000
    dpi: int = 200


LINES = "doc_id long, line_no int, raw string"
PAGES = "doc_id long, page_number int, text_char_count int, image_count int, image_coverage_ratio double"
PAGE_TEXT = "doc_id long, page_number int, source string, text string"
WORDS = "doc_id long, page_number int, word_idx int, text string, x0 double, top double, x1 double, bottom double, upright boolean"
OCR_BLOCKS = "doc_id long, page_number int, source_index int, text string, score double, top double, left double, bottom double, right double, has_geometry boolean"
BLOCKS = "array<struct<kind:string,level:int,text:string,rows:array<array<string>>>>"
