"""Removal of passages that repeat across documents, on a compacted De Bruijn graph.

Nodes are runs of 12 words, and each window of 13 words is an edge between two of
them. A window is repeated if its words also start in a document with a smaller id;
every word that a repeated window covers is removed.

Most of the graph never repeats and needs no edge of its own:

1. The edges of a document that follow each other and share a minimizer (the least
   hash of their runs of 6 words) compact to one path while the text is read.
2. Only paths whose minimizer stands in two documents go on: equal edges have equal
   minimizers. Paths of one content have no branch between them; a path is repeated as
   a whole if it also stands in a document with a smaller id.
3. A minimizer with paths of different content is a branch. The first document's
   paths there are split to their edges, read from the text at their coordinates, and
   joined edge by edge.
4. The coordinates of repeated paths and edges meet their document again. Each is
   verified there against the words it was made of, and they merge to long spans.

Joins are on 128 bits of content hashes, and their one side has a row for each key, so
a hot passage is split over tasks. Null texts and texts without words have none and
keep none; shorter texts than a window keep all. Rows with a null id keep all their
words. Rows that share an id count as one document: none of them is smaller than the
other, and a span is removed where its words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Scratch, as_bytes, runs, slices
from pageloom.llm.neardup import WordHashes, mixed

WINDOW = 13
#: Words of a minimizer.
SEED = 6

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest text has asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                one = np.ones(1, np.uint64)
                self.up, self.down = (np.cumprod(np.concatenate([one, np.full(n - 1, b, np.uint64)])) for b in (_BASE, _UNBASE))


class Sequence:
    """The words of a text with the content hash of any run of windows."""

    def __init__(self, text: bytes | None, hashes: WordHashes, powers: Powers):
        self.words = text.split() if text else []
        self.n, self.powers = len(self.words), powers
        self.hashes = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, self.n)
        powers.to(self.n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * powers.up[: self.n])])

    def content(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The hash of the words of `n` windows from `start` on."""
        whole = (self.sums[start + n + WINDOW - 1] - self.sums[start]) * self.powers.down[start]
        return mixed(whole + n.astype(np.uint64))

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Minimizer, start and number of windows of each maximal run of windows that share one."""
        n = self.n - WINDOW + 1
        if n < 1:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        seeds = np.zeros(self.n - SEED + 1, np.uint64)
        for k in range(SEED):
            seeds = seeds * np.uint64(0xD6E8FEB86659FD93) + self.hashes[k : self.n - SEED + 1 + k]
        seeds = mixed(seeds)
        least = seeds[:n].copy()
        for k in range(1, WINDOW - SEED + 1):
            np.minimum(least, seeds[k : n + k], out=least)
        start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        return least[start], start, np.diff(np.append(start, n))


PATH = "m long, e long, id long, start int, n int"


def _batch(m, e, ids, start, n) -> pa.RecordBatch:
    columns = [np.concatenate(m).view(np.int64), np.concatenate(e).view(np.int64), np.concatenate(ids), np.concatenate(start).astype(np.int32), np.concatenate(n).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["m", "e", "id", "start", "n"])


def paths_of(texts: DataFrame) -> DataFrame:
    """m (minimizer), e (content), id, start, n of every path of the texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for ids, data in slices(batches, 4 << 20):
            rows = [[] for _ in range(5)]
            for i, text in zip(ids, data, strict=True):
                s = Sequence(text, hashes, powers)
                m, start, n = s.paths()
                for column, x in zip(rows, (m, s.content(start, n), np.full(len(m), i, np.int64), start, n), strict=True):
                    column.append(x)
            yield _batch(*rows)

    return texts.where("id IS NOT NULL").mapInArrow(run, PATH)


def spans_at(column: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """start, n and e of one row's array of structs."""
    x = column[k].values
    return tuple(x.field(c).to_numpy() for c in ("start", "n", "e"))


def edges_of(texts: DataFrame) -> DataFrame:
    """The single windows of some paths: m, e, id, start, 1. texts: id, text, spans of (start, n, e, m)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for whole in batches:
            for i, j in runs(pa.compute.fill_null(pa.compute.binary_length(whole.column(1)), 0).to_pylist(), 4 << 20):
                rows = [[np.empty(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
                for k in range(i, j):
                    s = Sequence(whole.column(1)[k].as_py(), hashes, powers)
                    start, n, e = spans_at(whole.column(2), k)
                    m = whole.column(2)[k].values.field("m").to_numpy()
                    there = start.astype(np.int64) + n + WINDOW - 1 <= s.n
                    start, n, e, m = (x[there] for x in (start.astype(np.int64), n, e, m))
                    same = s.content(start, n.astype(np.int64)).view(np.int64) == e  # else another row with this id has them
                    at = np.concatenate([np.empty(0, np.int64), *(np.arange(a, a + b) for a, b in zip(start[same], n[same], strict=True))])
                    ones = np.ones(len(at), np.int64)
                    for column, x in zip(rows, (np.repeat(m[same], n[same]).view(np.uint64), s.content(at, ones), np.full(len(at), whole.column(0)[k].as_py(), np.int64), at, ones), strict=True):
                        column.append(x)
                yield _batch(*rows)

    return texts.select("id", "text", "spans").mapInArrow(run, PATH)


def without(texts: DataFrame) -> DataFrame:
    """id, n_words, removed (merged spans of words), kept (the other words, joined by spaces)."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for whole in batches:
            for i, j in runs(pa.compute.fill_null(pa.compute.binary_length(whole.column(1)), 0).to_pylist(), 8 << 20):
                counts, removed, kept = [], [], []
                for k in range(i, j):
                    text = whole.column(1)[k].as_py()
                    if not whole.column(2)[k].is_valid:
                        words = text.split() if text else []
                        counts.append(len(words))
                        removed.append([])
                        kept.append(b" ".join(words))
                        continue
                    s = Sequence(text, hashes, powers)
                    start, n, e = spans_at(whole.column(2), k)
                    there = start.astype(np.int64) + n + WINDOW - 1 <= s.n
                    start, n, e = start[there].astype(np.int64), n[there].astype(np.int64), e[there]
                    same = s.content(start, n).view(np.int64) == e
                    cover = np.zeros(s.n + 1, np.int64)
                    np.add.at(cover, start[same], 1)
                    np.add.at(cover, start[same] + n[same] + WINDOW - 1, -1)
                    gone = np.cumsum(cover)[: s.n] > 0
                    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                    counts.append(s.n)
                    removed.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
                    kept.append(b" ".join([w for w, x in zip(s.words, gone.tolist(), strict=True) if not x]))
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], ["id", "n_words", "removed", "kept"])

    return texts.select("id", "text", "spans").mapInArrow(run, "id long, n_words long, removed array<struct<start:int,end:int>>, kept binary")


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, removed (array of word spans), kept (binary: the words that stay, joined by spaces)."""
    scratch = Scratch(docs.sparkSession, "substring")
    texts = as_bytes(docs, id_col, text_col)
    paths = scratch.keep(paths_of(texts), "paths")
    # minimizers in two documents
    shared = scratch.keep(paths.groupBy("m").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("m"), "shared")
    repeated = scratch.keep(paths.join(shared, "m"), "repeated")
    scratch.drop(paths, shared)
    # contents, each with its first document
    contents = scratch.keep(repeated.groupBy("m", "e").agg(F.min("id").alias("first")), "contents")
    whole = repeated.join(contents, ["m", "e"]).where("first < id").select("id", "start", "n", "e")
    # branches: the first document of each content, edge by edge
    branches = scratch.keep(contents.groupBy("m").count().where("count > 1").select("m"), "branches")
    starts = contents.join(branches, "m").select("m", "e", F.col("first").alias("id"))
    at = repeated.join(scratch.keep(starts, "starts"), ["m", "e", "id"]).groupBy("id").agg(F.collect_list(F.struct("start", "n", "e", "m")).alias("spans"))
    edges = scratch.keep(edges_of(texts.join(scratch.keep(at, "at"), "id")).distinct(), "edges")
    least = scratch.keep(edges.groupBy("m", "e").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("m", "e", "first"), "least")
    single = edges.join(least, ["m", "e"]).where("first < id").select("id", "start", "n", "e")
    # back to the documents
    spans = scratch.keep(whole.unionAll(single).groupBy("id").agg(F.collect_list(F.struct("start", "n", "e")).alias("spans")), "spans")
    scratch.drop(repeated, contents, branches, edges, least)
    return without(texts.join(spans, "id", "left")).withColumnRenamed("id", id_col)


def report(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_removed, kept_sha256."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return drop_repeats(docs, id_col=id_col).select(id_col, "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
