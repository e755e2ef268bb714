"""Language identification by nearest centroid.

A text is the unit vector of its TF-IDF weights over hashed byte n-grams of its lower-
cased letters. Each language has several centroids, clustered by cosine from a bounded
sample of labelled rows. The prediction is the language of the nearest centroid; a text
that is further from its centroid than training texts of its language tell is rejected.
As short texts are far from all centroids, that is told from the starts of the training
texts, cut to the next of a few lengths below the text's own.

Null texts and texts without a letter get the language `und` with score 0, and are
rejected. Without any labelled row all texts are `und`. Equal cosines go to the
language that sorts first. Every row gives one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Scratch, as_bytes, release, slices

#: Labelled rows of each language from which the centroids are learned, about; fewer if all languages together would
#: have more than ALL_ROWS, but LEAST_ROWS in any case. A row is at most 6 bytes for each bucket and start.
SAMPLE_ROWS, ALL_ROWS, LEAST_ROWS = 400, 20_000, 20
#: Languages up to which their sizes are broadcast.
MANY = 100_000
CENTROIDS = 4
BUCKETS = 1 << 13
ROUNDS = 12
#: Texts whose vectors a task holds at once.
BATCH = 64
#: A text is rejected under this cosine, and under half of what all but LOW of a language's training texts reach.
LEAST, SLACK, LOW = 0.05, 0.5, 0.01
#: Characters of the starts from which it is learned; shorter texts have LEAST alone.
STARTS = (16, 64, 256)
UNKNOWN = "und"

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ANY_LETTER = re.compile(r"[^\W\d_]")


def counts_of(text: str) -> np.ndarray:
    """How often each bucket's byte pairs and triples occur; white space between words is one space."""
    data = b" ".join([b"", *text.lower().encode("utf-8", "replace").translate(_LETTERS).split(), b""])
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    pairs = codes[:-1] * np.uint32(257) + codes[1:]
    triples = pairs[:-1] * np.uint32(263) + codes[2:] + np.uint32(1 << 20)
    mixed = np.concatenate([pairs, triples]) * np.uint32(2654435761)
    return np.bincount(mixed >> np.uint32(19), minlength=BUCKETS)


def packed(counts: np.ndarray) -> bytes:
    """Buckets that occur and how often: of bounded size for a text of any length."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].astype(np.uint32).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n, out = len(data) // 6, np.zeros(BUCKETS, np.float32)
    out[np.frombuffer(data, np.uint16, n)] = np.frombuffer(data[2 * n :], np.uint32)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def clusters(rows: np.ndarray, k: int) -> np.ndarray:
    """Up to k unit centroids by spherical k-means, from far apart starts."""
    starts = [rows[0]]
    while len(starts) < min(k, len(rows)):
        starts.append(rows[int(np.argmin(np.max(rows @ np.array(starts).T, axis=1)))])
    centroids = np.array(starts)
    for _ in range(ROUNDS):
        nearest = np.argmax(rows @ centroids.T, axis=1)
        centroids = unit(np.array([rows[nearest == c].mean(axis=0) if (nearest == c).any() else centroids[c] for c in range(len(centroids))]))
    return centroids


class Model:
    """Bucket weights, centroids and the least cosines of each language, by length."""

    def __init__(self, rows: list[tuple[str, list[bytes]]]):
        """rows: the language and the packed counts of the whole text and of each start that is shorter."""
        self.languages = sorted({lang for lang, _ in rows})
        if not rows:
            return
        counts = np.array([unpacked(t[0]) for _, t in rows])
        self.idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        vectors, centroids, owner, least = self.vectors(counts), [], [], []
        of = np.array([lang for lang, _ in rows])
        for n, lang in enumerate(self.languages):
            c = clusters(vectors[of == lang], CENTROIDS)
            centroids.append(c)
            owner += [n] * len(c)
            starts = [[unpacked(t[k]) for x, t in rows if x == lang and len(t) > k] for k in range(1, len(STARTS) + 1)]
            least.append([LEAST] + [self.limit(np.array(texts), c) if texts else LEAST for texts in starts])
        self.centroids, self.owner, self.least = np.concatenate(centroids), np.array(owner), np.array(least)

    def limit(self, counts: np.ndarray, centroids: np.ndarray) -> float:
        return max(LEAST, SLACK * float(np.quantile((self.vectors(counts) @ centroids.T).max(axis=1), LOW)))

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) * self.idf)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        cosines = self.vectors(np.array([counts_of(t) for t in texts], np.float32)) @ self.centroids.T
        best = np.argmax(cosines, axis=1)
        score, lang = np.clip(cosines[np.arange(len(texts)), best], 0, 1), self.owner[best]
        lengths = np.searchsorted(STARTS, [len(t) for t in texts], side="right")
        lettered = np.array([bool(_ANY_LETTER.search(t)) for t in texts])
        return (
            [self.languages[n] if ok else UNKNOWN for n, ok in zip(lang, lettered, strict=True)],
            np.where(lettered, score, 0.0).astype(float).tolist(),
            (~lettered | (score < self.least[lang, lengths])).tolist(),
        )


def held_out(id_col: str):
    """Rows that learning leaves out: a fifth by the CRC-32 of the id's decimal text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_ROWS) -> Model:
    """Learn from about `per_language` rows of each language, chosen by the hash of their ids."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    scratch = Scratch(docs.sparkSession, "langid")
    sizes = scratch.keep(known.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n")), "sizes")
    languages = sizes.count()
    if not languages:
        return Model([])
    wanted = min(per_language, max(LEAST_ROWS, ALL_ROWS // languages))
    chosen = known.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("t"), F.col(id_col).alias("i")).where("t IS NOT NULL")
    chosen = chosen.join(F.broadcast(sizes) if languages <= MANY else sizes, F.col("lang") == F.col("l"))
    chosen = chosen.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < F.lit(float(wanted)) / F.col("n") * (1 << 30)).select("lang", "i", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text = b.column(2)[k].as_py().decode("utf-8", "replace")
                if _ANY_LETTER.search(text):
                    parts = [text, *(text[:size] for size in STARTS if len(text) >= size)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1).cast(pa.int64()), pa.array([[packed(counts_of(t)) for t in parts]], pa.list_(pa.binary()))], ["lang", "i", "parts"])

    rows = chosen.mapInArrow(run, "lang string, i long, parts array<binary>").collect()  # about SAMPLE_ROWS of each language
    scratch.drop(sizes)
    rows = sorted((r["lang"], r["i"], [bytes(x) for x in r["parts"]]) for r in rows)
    return Model([(lang, parts) for lang, _, parts in rows])


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score (cosine of the nearest centroid), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS * BUCKETS floats for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in slices(batches, 1 << 20):
            for k in range(0, len(ids), BATCH):
                found = shared.value.predict([(x or b"").decode("utf-8", "replace") for x in data[k : k + BATCH]])
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + BATCH], pa.int64()), *(pa.array(x) for x in found)], ["id", "lang_pred", "score", "rejected"])

    out = as_bytes(docs, id_col, text_col).mapInArrow(run, "id long, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")


def accept(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents whose language is recognised, all columns kept; those rejected go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH):
                b = whole.slice(k, BATCH)
                texts = [(x or b"").decode("utf-8", "replace") for x in b.column(at).cast(pa.binary()).to_pylist()]
                yield b.filter(pa.array([not x for x in shared.value.predict(texts)[2]], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
