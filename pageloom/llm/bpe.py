"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file alone defines the vocabulary: its merges are derived from the ranks. Each
match of the split pattern is encoded separately, with its bytes mapped to printable
characters, so that every byte string has a spelling. Decoding reverses that table and
joins bytes before it decodes UTF-8, so a character split over tokens comes back whole.

Null and empty texts have no tokens. Rows keep their id, repeated or null ids included;
other columns of the input, whatever their names, take no part.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import as_bytes, release, runs, slices

#: Different pieces whose tokens a worker keeps in mind; then it starts anew.
MEMO = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_letters() -> list[str]:
    """A printable character for every byte: itself where Latin-1 prints it, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """For each longer token, in rank order, the two tokens whose merge makes it."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] >= rank:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encoder and decoder of one rank file, made once for a task: an idle worker keeps nothing of it."""

    made: dict[tuple, Codec] = {}

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]], pattern: str):
        import regex

        self.pattern, self.ranks, self.merges, self.memo = regex.compile(pattern), ranks, merges, {}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.letters, self._model = dict(enumerate(byte_letters())), None

    @classmethod
    def of(cls, tables: Broadcast, pattern: str, key: str) -> Codec:
        if (key, pattern) not in cls.made:
            cls.made[key, pattern] = cls(*tables.value, pattern)
        return cls.made[key, pattern]

    @property
    def model(self):
        if self._model is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer, models, pre_tokenizers

            vocab = {self.spell(t): i for t, i in self.ranks.items()}
            merges = [(self.spell(a), self.spell(b)) for a, b in self.merges]
            self._model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
            self._model.pre_tokenizer = pre_tokenizers.Split("\n", "removed")  # no byte is spelled as a line end
        return self._model

    def spell(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.letters)

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces, many as one text of a line each, and remember their tokens as bytes."""
        texts = ["\n".join([self.spell(p.encode()) for p in pieces[k : k + 256]]) for k in range(0, len(pieces), 256)]
        for k, e in enumerate(self.model.encode_batch(texts, add_special_tokens=False)):
            ids, ends = np.array(e.ids, np.int32).tobytes(), (4 * np.flatnonzero(np.diff(np.array(e.word_ids))) + 4).tolist()
            for piece, a, b in zip(pieces[256 * k :], [0, *ends], [*ends, len(ids)], strict=False):
                self.memo[piece] = ids[a:b]

    def pieces(self, text: str) -> list[str]:
        return [m.group() for m in self.pattern.finditer(text)] if self.pattern.groups else self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces(t) for t in texts]
        new = list(set().union(*split).difference(self.memo)) if split else []
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, list(set().union(*split))
        self.learn(new)
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), np.int32) for p in split]

    def decode(self, ids: list[int]) -> bytes | None:
        parts = list(map(self.bytes_of.get, ids))
        return None if None in parts else b"".join(parts)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's first and last character plus 1; tokens of a split character share it."""
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of each byte
        ends = np.cumsum(np.fromiter((len(self.bytes_of[i]) for i in ids.tolist()), np.int64, len(ids)))
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return at[starts], at[ends - 1] + 1


def tables_of(df: DataFrame, ranks_path: str, merges: bool) -> Broadcast:
    """The ranks and, for encoding, the merges that follow from them, made once by the driver: a few MB."""
    ranks = read_ranks(ranks_path)
    return df.sparkSession.sparkContext.broadcast((ranks, merges_of(ranks) if merges else []))


def lists(parts: list[np.ndarray], kind=None) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32), kind or pa.int32()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """id, ids array<int>; with `offsets` also char_starts, char_ends array<int>."""
    tables = tables_of(docs, ranks_path, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tables, pattern, ranks_path)
        try:
            for ids, data in slices(batches, 2 << 20):
                texts = [(x or b"").decode("utf-8", "replace") for x in data]
                tokens = codec.encode(texts)
                columns = [pa.array(ids, pa.int64()), lists(tokens)]
                if offsets:
                    spans = [codec.spans(t, x) for t, x in zip(texts, tokens, strict=True)]
                    columns += [lists([s[k] for s in spans]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "char_starts", "char_ends"][: len(columns)])
        finally:
            Codec.made.clear()  # the worker lives on for other work: what it has learned goes with the task

    more = ", char_starts array<int>, char_ends array<int>" if offsets else ""
    out = as_bytes(docs, id_col, text_col).mapInArrow(run, f"id long, ids array<int>{more}")
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of `keep`, decoded binary: the bytes of the tokens; a null list gives none.

    A list with a null or an id outside the vocabulary, which has no bytes to stand for, gives null.
    """
    tables = tables_of(tokens, ranks_path, False)
    table = tokens.select(F.col(id_col), F.col(ids_col), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tables, "", ranks_path)
        try:
            for whole in batches:
                sizes = pa.compute.fill_null(pa.compute.list_value_length(whole.column(1)), 0).to_pylist()
                for i, j in runs(sizes, 1 << 20):
                    b = whole.slice(i, j - i)
                    data = [codec.decode(x.values.to_pylist() if x.values.null_count else x.values.to_numpy().tolist()) if x.is_valid else b"" for x in b.column(1)]
                    yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(data, pa.binary())], [id_col, *keep, "decoded"])
        finally:
            Codec.made.clear()
            release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != ids_col or f.name in keep)
    return table.mapInArrow(run, f"{schema}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 of the decimal ids joined by spaces, decoded_sha256 of the decoded bytes."""
    tokens = encode(docs, ranks_path, pattern, id_col=id_col, text_col=text_col)
    digest = F.sha2(F.array_join(F.col("ids"), " ").cast("binary"), 256)
    tokens = tokens.select(id_col, "ids", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"))
    out = decode(tokens, ranks_path, id_col=id_col, keep=("n_tokens", "ids_sha256"))
    return out.select(id_col, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
