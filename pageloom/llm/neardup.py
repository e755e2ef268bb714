"""Near-duplicate documents by a signature-coordinate inverted join.

A document's set are its different word shingles. Its MinHash signature has K values;
two sets of similarity s agree in a coordinate with probability s. Each document is
posted under coordinate-value pairs, and two documents are candidates if at least T of
K coordinates collide:

* prefix: with T matches asked for, one of any K - T + 1 coordinates must match, so
  only the rarest ones of a document are posted. Values that no other document has
  count as the rarest and need no posting; a document with fewer than T shared values
  has no partner at all;
* skip: documents of one list that verified links have already joined are not paired.

* merging: what is left of long lists, such as those of a passage that many documents
  share, is compared block by block, as products of matrices of their full sets.

Candidates are confirmed on their full sets. With K = 32 and T = 13, two sets of
similarity 0.75 are missed as candidates with probability 8e-6, of 0.8 with 2e-7.

Documents with equal sets are one class and take part once, by their smallest id.
Null texts and texts without a word have an empty set and are linked with nothing;
a text with fewer words than a shingle is one shingle. The id identifies a document:
rows that share one share its component, and rows with a null id are linked with
nothing (component_id null, kept). An empty table gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Scratch, as_bytes, slices
from pageloom.llm import components as components_
from pageloom.llm.components import block_pairs, components, linked

WORDS = 5
K, T = 32, 13
#: A link: PART * |union| <= WHOLE * |intersection|.
PART, WHOLE = 75, 100

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.random.RandomState(7)
_XOR = _MIX.randint(0, 1 << 62, K, dtype=np.int64).astype(np.uint64)
_TIMES = (_MIX.randint(0, 1 << 62, K, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, given the words' hashes; of the whole sequence if it is shorter."""
    n = len(words)
    size = min(size, n)
    out = np.full(n - size + 1 if n else 0, n if n < WORDS else 0, np.uint64)
    for k in range(size if n else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k]
    return mixed(out)


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    words = text.translate(_LOWER).split() if text else []
    return np.unique(shingle_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), WORDS))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 8192):
        least = np.minimum(least, ((shingles[k : k + 8192] ^ _XOR[:, None]) * _TIMES[:, None]).min(axis=1))
    return least.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the set), d1, d2 (digest of the set), sig; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for ids, data in slices(batches, 4 << 20):
            n, d, sigs = [], [], []
            for t in data:
                s = shingle_set(t, hashes)
                n.append(len(s))
                d.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) if len(s) else np.zeros(2, np.int64))
                sigs.append(signature(s) if len(s) else np.empty(0, np.int64))
            d = np.array(d).reshape(-1, 2)
            ends = pa.array(np.cumsum([0, *map(len, sigs)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sigs)))], ["id", "n", "d1", "d2", "sig"])

    return as_bytes(docs, id_col, text_col).mapInArrow(run, "id long, n long, d1 long, d2 long, sig array<long>")


def posted(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """key, id, n (members of the key's list): each document under its prefix of coordinate-value pairs, the rarest first.

    Two documents that share T values are found under the rarest of them. If that is in
    a long list, so are the others: of long lists, documents with fewer than T such
    values are left out. A passage that many documents share has few of them.
    """
    values = classes.select("id", F.posexplode("sig").alias("k", "v")).select("id", F.xxhash64("k", "v").alias("key"))
    shared = scratch.keep(values.groupBy("key").count().where("count > 1"), "shared")
    own = values.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("keys")).where(F.size("keys") >= T)
    long = F.size(F.filter("keys", lambda x: x["count"] > components_.LONG))
    own = own.select("id", F.explode(F.slice("keys", 1, F.size("keys") - (T - 1))).alias("x"), (long >= T).alias("deep"))
    own = scratch.keep(own.where((F.col("x.count") <= components_.LONG) | F.col("deep")).select(F.col("x.key").alias("key"), "id"), "prefixes")
    sizes = scratch.keep(own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    return scratch.keep(own.join(sizes, "key"), "postings")


def packed_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, packed: the compressed texts of some documents, one for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for some, data in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([pack(t or b"") for t in data], pa.binary())], ["id", "packed"])

    texts = as_bytes(docs, id_col, text_col).join(ids, "id", "left_semi")
    return texts.mapInArrow(run, "id long, packed binary")


def confirmed(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, x, y), x and y their packed texts, whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, hashes, known = zstandard.ZstdDecompressor().decompress, WordHashes(), OrderedDict()

        def of(data: bytes) -> np.ndarray:
            if data in known:
                known.move_to_end(data)
                return known[data]
            if len(known) > 128:
                known.popitem(last=False)
            known[data] = s = shingle_set(unpack(data), hashes)
            return s

        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = of(x.as_py()), of(y.as_py())
                both = np.intersect1d(s, t, assume_unique=True).size
                keep.append(WHOLE * both >= PART * (len(s) + len(t) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


#: Documents of a block, of which two are compared at once.
BLOCK = 128


def compared(pairs: DataFrame) -> DataFrame:
    """Links (a, b) of two blocks' documents (id, group, packed), one for two groups.

    All similarities of two blocks are one product of matrices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for k in range(b.num_rows):
                a, c = block_links(*(b.column(side)[k].values for side in (0, 1)), hashes)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return pairs.select("docs_x", "docs_y").mapInArrow(run, "a long, b long")


def block_links(x: pa.StructArray, y: pa.StructArray, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of linked documents of two blocks, one pair for two groups."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    (ids, groups), (ids2, groups2) = ([d.field(c).to_numpy() for c in ("id", "group")] for d in (x, y))
    sets, sets2 = ([shingle_set(unpack(t.as_py()), hashes) for t in d.field("packed")] for d in (x, y))
    flat, flat2 = np.concatenate(sets), np.concatenate(sets2)
    sizes, sizes2 = (np.array([len(s) for s in own]) for own in (sets, sets2))
    row, row2 = np.repeat(np.arange(len(sets)), sizes), np.repeat(np.arange(len(sets2)), sizes2)
    common = np.intersect1d(flat, flat2)
    both = np.zeros((len(ids), len(ids2)), np.float32)
    for start in range(0, len(common), 4096):
        some = common[start : start + 4096]
        a, c = np.zeros((len(ids), len(some)), np.float32), np.zeros((len(ids2), len(some)), np.float32)
        for table, values, rows in ((a, flat, row), (c, flat2, row2)):
            at = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[at] == values
            table[rows[hit], at[hit]] = 1
        both += a @ c.T
    link = (WHOLE * both >= PART * (sizes[:, None] + sizes2[None, :] - both)) & (groups[:, None] != groups2[None, :]) & (both > 0)
    i, j = np.nonzero(link)
    _, first = np.unique(np.column_stack([groups[i], groups2[j]]), axis=0, return_index=True)
    return ids[i[first]], ids2[j[first]]


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable), kept (the id is its component's)."""
    scratch = Scratch(docs.sparkSession, "neardup")
    all_rows = scratch.keep(sketches(docs, id_col, text_col), "sketches")
    rows = all_rows.where("n > 0 AND id IS NOT NULL")
    owners = scratch.keep(rows.groupBy("d1", "d2").agg(F.min("id").alias("owner")), "owners")
    classes = scratch.keep(rows.join(owners, (rows.d1 == owners.d1) & (rows.d2 == owners.d2) & (rows.id == owners.owner)).select("id", "n", rows.d1, rows.d2, "sig").dropDuplicates(["id", "d1", "d2"]).drop("d1", "d2"), "classes")
    postings = posted(classes, scratch)
    ids = postings.select("id").distinct()
    known = scratch.keep(classes.join(ids, "id", "left_semi"), "known")
    texts = scratch.keep(packed_texts(docs, ids, id_col, text_col).distinct(), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        for side, other in (("a", "b"), ("b", "a")):
            pairs = pairs.join(known.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
        same = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
        near = (F.least("n_a", "n_b") * WHOLE >= F.greatest("n_a", "n_b") * PART) & (same >= T)
        pairs = pairs.where(near).select("a", "b")
        pairs = pairs.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("y")), "b")
        return confirmed(pairs.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("x")), "a"))

    def compare(members: DataFrame) -> DataFrame:
        return compared(block_pairs(members, texts.join(known.select("id", "n"), "id"), BLOCK, PART / WHOLE, scratch))

    # documents that share an id belong together, too
    same_id = rows.join(owners, ["d1", "d2"]).select(F.col("owner").alias("a"), F.col("id").alias("b")).where("a <> b")
    repeated = rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("b"))
    same_id = same_id.join(repeated, "b", "left_semi").select("a", "b")
    groups = components(linked(postings, verify, compare, scratch).unionAll(same_id), scratch)
    named = scratch.keep(owners.join(groups, owners.owner == groups.id, "left").select("d1", "d2", F.coalesce("component", "owner").alias("component")), "named")
    found = all_rows.where("n > 0 AND id IS NOT NULL").join(named, ["d1", "d2"]).select("id", "n", "component")
    alone = all_rows.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    out = found.unionAll(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the first of their component, all columns kept."""
    out = near_duplicates(docs, id_col=id_col, text_col=text_col)
    return docs.join(out.where(~F.col("kept")).select(id_col).distinct(), id_col, "left_anti")
