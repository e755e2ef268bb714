"""Benchmark decontamination with an FM-index over each shard of the training texts.

A shard is some million words of whole documents. Its index is the Burrows-Wheeler
transform of its word sequence in a wavelet matrix, with sampled suffix positions.
All test phrases search backward at once; their rows are located by stepping to the
nearest sampled position, and the occurrences of a document merge to removal spans.

Words outside the benchmark's vocabulary can't be part of a phrase: a run of them is
one separator in the index, and so is a run of known words that is shorter than the
shortest phrase. No occurrence is lost by that.

An item is a benchmark row; rows with one id count as one item. Null and empty texts,
and those without a word, have no words and no hits; items without words have no
phrase. Null item ids take no part. An empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import as_bytes, fresh, release, runs

#: Words of a phrase; a shorter item is one phrase.
WINDOW = 8
#: Bytes of text that make a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: A benchmark goes to the tasks in blocks of so many bytes of text, one pass over the documents each. The arrays of a
#: block's phrases, made once by the driver, take about ten times as much.
BLOCK_BYTES = 8 << 20
#: Every so many positions of a suffix are kept.
SAMPLE = 8
#: Occurrences that are located at once.
LOCATE = 1 << 21

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and other characters from U+0080 on, with A-Z lower-cased."""
    return text.translate(_LETTERS).split() if text else []


class Phrases:
    """The different windows of a benchmark block as arrays of word numbers, by length, and the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.ids = sorted({str(i) for i, _ in items})
        number = {i: n for n, i in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            words = words_of(text)
            if m := min(window, len(words)):
                seq = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
                parts.setdefault(m, []).append((np.lib.stride_tricks.sliding_window_view(seq, m), number[str(item)]))
        self.shortest = min(parts, default=0)
        #: length of the windows, number of the first one, the windows
        self.groups: list[tuple[int, int, np.ndarray]] = []
        lengths, holders, first = [], [], 0
        for m, own in sorted(parts.items()):
            flat = np.ascontiguousarray(np.concatenate([w for w, _ in own]))
            holder = np.repeat(np.array([i for _, i in own], np.int64), [len(w) for w, _ in own])
            _, at, which = np.unique(flat.view([("", np.int32)] * m).ravel(), return_index=True, return_inverse=True)
            self.groups.append((m, first, flat[at]))
            lengths.append(np.full(len(at), m, np.int64))
            holders.append(np.unique((which.ravel() + first) * len(self.ids) + holder))
            first += len(at)
        held = np.concatenate([np.empty(0, np.int64), *holders])
        self.lengths = np.concatenate([np.empty(0, np.int64), *lengths])
        #: the items of window w are held[starts[w] : starts[w + 1]]
        self.starts = np.searchsorted(held, np.arange(first + 1) * len(self.ids))
        self.held = (held % max(1, len(self.ids))).astype(np.int32)

    def items_of(self, docs: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs of document and item, from pairs of document and window."""
        n = self.starts[windows + 1] - self.starts[windows]
        at = np.arange(n.sum()) + np.repeat(self.starts[windows] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n)
        both = np.unique(np.repeat(docs, n) * max(1, len(self.ids)) + self.held[at])
        return both // max(1, len(self.ids)), both % max(1, len(self.ids))


class WaveletMatrix:
    """Symbols below 2**levels with the count of any symbol before any position."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        start, end = np.zeros_like(end), end.copy()
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = self.ones[k]
            start = np.where(one, self.zeros[k] + ones[start], start - ones[start])
            end = np.where(one, self.zeros[k] + ones[end], end - ones[end])
        return end - start

    def at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.levels):
            ones = self.ones[k]
            one = (ones[i + 1] - ones[i]).astype(bool)
            out = out * 2 + one
            i = np.where(one, self.zeros[k] + ones[i], i - ones[i])
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling; every separator (0) is smaller than the next one and than all words."""
    n, separator = len(symbols), symbols == 0
    first = symbols + separator.sum()
    first[separator] = np.arange(separator.sum())
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], first[order][1:] != first[order][:-1]]))
    h = 1
    while rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        h *= 2
    return order


class FmIndex:
    """Backward search and location over one sequence of symbols in which 0 separates."""

    def __init__(self, symbols: np.ndarray, top: int):
        order = suffix_order(symbols)
        before = symbols[order - 1]
        before[order == 0] = 0
        self.n, self.bwt = len(symbols), WaveletMatrix(before, max(1, int(top).bit_length()))
        counts = np.bincount(symbols, minlength=top + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        # a step never crosses a separator: what follows one is sampled too
        self.sampled = (order % SAMPLE == 0) | (before == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of suffixes that start with each pattern (a row of equal length)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            low[live] = self.first[c] + self.bwt.rank(c, low[live])
            high[live] = self.first[c] + self.bwt.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[at])
        while len(live):
            c = self.bwt.at(at[live])
            at[live] = self.first[c] + self.bwt.rank(c, at[live])
            steps[live] += 1
            live = live[~self.sampled[at[live]]]
        return self.samples[self.sample_rank[at]] + steps


def occurrences(sequence: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window numbers, positions) of all occurrences in a shard's sequence, in which 0 separates."""
    if not phrases.groups or not len(sequence):
        return
    known = np.concatenate([[0], (sequence != 0).view(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return
    sizes = ends - starts + 1  # with the separator behind
    place = np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    symbols = np.append(sequence, 0)[place]
    symbols[np.cumsum(sizes) - 1] = 0
    index = FmIndex(symbols, len(phrases.vocabulary))
    for _, first, windows in phrases.groups:
        low, high = index.search(windows.astype(np.int64))
        hit = np.flatnonzero(high > low)
        which, low, size = hit + first, low[hit], (high - low)[hit]
        total = np.concatenate([[0], np.cumsum(size)])
        for start in range(0, int(total[-1]), LOCATE):
            nth = np.arange(start, min(start + LOCATE, int(total[-1])))
            k = np.searchsorted(total, nth, side="right") - 1
            yield which[k], place[index.locate(low[k] + nth - total[k])]


def search_shard(texts: list[bytes | None], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text: its words, the merged spans [start, end) of its hit words, and the items that occur."""
    get = phrases.vocabulary.get
    parts, sizes = [], []
    for t in texts:
        words = words_of(t)
        sizes.append(len(words))
        parts.append(np.array([get(w, 0) for w in words] + [0], np.int64))
    sequence = np.concatenate(parts)
    doc_start = np.concatenate([[0], np.cumsum([n + 1 for n in sizes])])
    cover, pairs = np.zeros(len(sequence) + 1, np.int32), [np.empty(0, np.int64)]
    for window, position in occurrences(sequence, phrases):
        np.add.at(cover, position, 1)
        np.add.at(cover, position + phrases.lengths[window], -1)
        doc = np.searchsorted(doc_start, position, side="right") - 1
        pairs.append(np.unique(doc * len(phrases.lengths) + window))
    edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).view(np.int8)]))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        d = int(np.searchsorted(doc_start, a, side="right")) - 1
        spans[d].append((a - int(doc_start[d]), b - int(doc_start[d])))
    both = np.unique(np.concatenate(pairs))
    items: list[list[str]] = [[] for _ in texts]
    if len(both):
        for d, i in zip(*(x.tolist() for x in phrases.items_of(both // len(phrases.lengths), both % len(phrases.lengths))), strict=True):
            items[d].append(phrases.ids[i])  # in the order of the ids, which are sorted
    return sizes, spans, items


def byte_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as byte spans of the text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes | None]]]:
    """The benchmark's rows in blocks of bounded size; rows are streamed, one partition at a time."""
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r.i, bytes(r.t) if r.t is not None else None))
        size += len(r.t or b"")
        if size >= most:
            yield block
            block, size = [], 0
    if block or not size:
        yield block


def annotate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, drop_text: bool = False) -> DataFrame:
    """The rows with their number of words, spans (merged, in words) and items, named by names_added, without any shuffle.

    Each block of the benchmark is one narrow pass over the rows, which adds to the
    columns of the pass before; a benchmark under BLOCK_BYTES is one block.
    """
    added = names_added(docs.columns)
    for first, last, block in marked(benchmark_blocks(benchmark, item_col, item_text_col)):
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))  # the phrases of BLOCK_BYTES and one text at most
        names = [c for c in docs.columns if c not in added and not (drop_text and last and c == text_col)]
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=names, at=at, first=first) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                data = whole.column(at).cast(pa.binary())
                for i, j in runs(pa.compute.fill_null(pa.compute.binary_length(data), 0).to_pylist(), SHARD_BYTES):
                    b = whole.slice(i, j - i)
                    n, spans, items = search_shard(data.slice(i, j - i).to_pylist(), shared.value)
                    if not first:
                        before = [b.column(b.schema.get_field_index(c)).to_pylist() for c in added[1:]]
                        spans = [merge_spans(s + [(x["start"], x["end"]) for x in old]) for s, old in zip(spans, before[0], strict=True)]
                        items = [sorted({*x, *old}) for x, old in zip(items, before[1], strict=True)]
                    more = [pa.array(n, pa.int64()), pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], SPANS), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), *more], [*names, *added])
            release()

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
        docs = docs.mapInArrow(run, f"{kinds}{', ' if kinds else ''}`{added[0]}` long, `{added[1]}` array<struct<start:int,end:int>>, `{added[2]}` array<string>")
    return docs


def marked(blocks: Iterator) -> Iterator[tuple[bool, bool, list]]:
    """The blocks, of which two are held at once, with whether each is the first and the last."""
    first, before = True, next(blocks)
    for block in blocks:
        yield first, False, before
        first, before = False, block
    yield first, True, before


def names_added(columns: list[str]) -> tuple[str, str, str]:
    """Names for the number of words, the spans and the items that no column has."""
    return tuple(fresh(c, columns) for c in ("n_words", "spans", "items"))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_words, spans of hit words (array<struct<start, end>>, in words), items array<string>."""
    out = annotate(as_bytes(docs, id_col, text_col), benchmark, drop_text=True, **options)
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what stands between two words of a span goes too."""
    kept, end = [], 0
    for a, b in byte_spans(text, spans):
        kept.append(text[end:a])
        end = b
    return b"".join([*kept, text[end:]])


def excise(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", contaminated: int = 2, **options) -> DataFrame:
    """The documents without the benchmark's passages, all columns kept.

    A document in which at least `contaminated` items occur goes; in others the hit
    spans are cut out of the text. Documents without a hit stay unchanged.
    """
    words, spans_col, items = names_added(docs.columns)
    found = annotate(docs, benchmark, text_col=text_col, **options).where(F.size(items) < contaminated)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            spans = b.column(b.schema.get_field_index(spans_col)).to_pylist()
            if any(spans):
                texts = columns[at].cast(pa.binary()).to_pylist()
                texts = [cut_spans(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(texts, spans, strict=True)]
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)
        release()

    return found.drop(words, items).mapInArrow(run, docs.schema)


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated (at least 2 items)."""
    found = find_benchmark(docs, benchmark, id_col=id_col)
    n = F.size("items").cast("long")
    return found.select(
        id_col, "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"])).alias("n_hit"),
        n.alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"),
    )
