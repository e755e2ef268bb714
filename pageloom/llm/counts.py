"""Token counts by batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, and a long text is cut at safe boundaries: at a single
space between two other characters, where the model starts a new piece in any case.
The cut is only used with models for which it is safe: no piece holds the space mark
behind another character, and a text starts as a word does.

Null and empty texts have 0 bytes and 0 tokens. Every row of the input gives one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import as_bytes, runs, slices

#: Texts of more characters are cut.
LONG = 32_768
#: Bytes that go to the encoder at once.
BATCH = 1 << 20
MARK = "▁"
_CUT = re.compile(rf"(?<=[^ {MARK}]) (?=[^ {MARK}])")


class Counter:
    made: dict[bytes, Counter] = {}

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()))
        probes = ("ab cd", "x. Yz", "q\nr s")
        self.safe = not any(MARK in p.lstrip(MARK) for p in pieces) and all(
            self.sp.encode(p) == [t for part in p.split(" ") for t in self.sp.encode(part)] for p in probes
        )

    @classmethod
    def of(cls, model: bytes) -> Counter:
        if model not in cls.made:
            cls.made[model] = cls(model)
        return cls.made[model]

    def cut(self, text: str) -> list[str]:
        if len(text) <= LONG or not self.safe:
            return [text]
        out, start = [], 0
        while len(text) - start > LONG and (m := _CUT.search(text, start + LONG)):
            out.append(text[start : m.start()])
            start = m.end()
        return [*out, text[start:]]

    def counts(self, texts: list[str]) -> list[int]:
        parts = [(k, p) for k, t in enumerate(texts) for p in self.cut(t)]
        totals = [0] * len(texts)
        for i, j in runs([len(p.encode("utf-8", "replace")) for _, p in parts], BATCH):
            for (k, _), ids in zip(parts[i:j], self.sp.encode([p for _, p in parts[i:j]], num_threads=1), strict=True):
                totals[k] += len(ids)
        return totals


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id, n_bytes of UTF-8, n_tokens, over_limit (more than `limit` tokens)."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(model)
        for ids, data in slices(batches):
            n = counter.counts([(x or b"").decode("utf-8", "replace") for x in data])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x or b"") for x in data], pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = as_bytes(docs, id_col, text_col).mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
