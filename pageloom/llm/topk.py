"""Exact top-k by inner product with a pivot table.

Every vector's distances to a set of pivots are computed once. By the triangle
inequality, the largest difference of two vectors' pivot distances is a lower bound of
their distance, and so gives an upper bound of their inner product:
2 q.x = |q|^2 + |x|^2 - d(q, x)^2. A query evaluates candidates in the order of their
bounds and stops, exactly, once the k-th best score is over the next bound.

A query's first bar is its k-th best score among a sample of the rows, which the pivots
come from; its best scores go with it from block to block of a slot. On vectors in
clusters most candidates fall to the bounds. Where all vectors are about equally far
from each other, such as random ones of 64 dimensions, the bounds of any pivots lie
above the best scores, and nearly all candidates are evaluated: the result is as exact.

Vectors are integers: floor(scale * x). Those that are null, or hold a null, NaN or
infinite component, take no part, nor do rows with a null id. Only vectors of one
length are compared; empty vectors score 0 with each other. A query's candidates are
all rows but its own: others that share its id, or its id and vector, are candidates.
Query rows that share an id have a ranking each. Ties go to the smaller id. Scores
beyond 64 bits are held at their ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 64
#: Rows from which the pivots are picked, and that give the first bar.
PIVOT_SAMPLE = 2048
#: Vectors of a block of candidates, and of queries.
BLOCK, QUERY_BLOCK = 4096, 512
#: Candidates that are evaluated at once.
STEP = 256
#: Bytes of the candidates of a slot, as floats, and the most of their blocks; a small table still has SLOTS slots.
SLOT_BYTES, SLOT_BLOCKS, SLOTS = 1 << 26, 16, 12
_BLOCKS = "dim int, width int, ids binary, numbers binary, vectors binary"


def integers(rows: pa.Array, scale: int) -> list[np.ndarray | None]:
    """Each row's floor(scale * x), or None."""
    out = []
    for x in rows.to_pylist():
        v = None if x is None or None in x else np.array(x, np.float64)
        out.append(None if v is None or not np.isfinite(v).all() else np.floor(scale * v))
    return out


def pivots_of(vectors: list[np.ndarray], most: int) -> np.ndarray:
    """Vectors far apart from each other, the first one given."""
    rows = np.array(vectors)
    chosen, near = [0], np.linalg.norm(rows - rows[0], axis=1)
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(rows - rows[chosen[-1]], axis=1))
    return rows[chosen]


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, as int64."""
    most = max(np.abs(queries).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * max(rows.shape[1], 1)
    if most < 1 << 53:
        return (rows @ queries).astype(np.int64)  # floats are exact here
    exact = [sum(int(a) * int(b) for a, b in zip(r, queries, strict=True)) for r in rows]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64)


def ranked(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The order by falling score, then by id."""
    exact = -scores.astype(np.float64) if (np.abs(scores) < 1 << 53).all() else np.array([-int(x) for x in scores], object)
    return np.lexsort((ids, exact))


def first_bars(queries: np.ndarray, sample: np.ndarray, most: int) -> np.ndarray:
    """Each query's most-th best score among the sample, which the whole table's can't be below."""
    if len(sample) < most:
        return np.full(len(queries), -np.inf)
    return np.array([float(np.partition(products(q, sample), len(sample) - most)[len(sample) - most]) for q in queries]) - 0.5


def best_of(q_ids, queries, q_bounds, ids, rows, bounds, most: int, bars) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each query: ids and scores of its best rows of one block, whether they equal the query and its id, and how many were evaluated.

    Rows that can't come up to the query's bar are left out.
    """
    norms = (rows * rows).sum(axis=1)
    for qid, q, qb, bar in zip(q_ids, queries, q_bounds, bars, strict=True):
        apart = np.abs(bounds - qb).max(axis=1, initial=0.0)
        apart *= 1 - 1e-9  # rounding must not raise a lower bound
        limit = (norms + (q * q).sum() - apart * apart) / 2
        limit += 0.5 + np.abs(limit) * 1e-9
        order = np.flatnonzero(limit >= bar)
        order = order[np.argsort(-limit[order], kind="stable")]
        at, got, evaluated = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for start in range(0, len(order), STEP):
            if len(got) == most and limit[order[start]] < got[-1]:
                break
            some = order[start : start + STEP]
            evaluated += len(some)
            at, got = np.concatenate([at, some]), np.concatenate([got, products(q, rows[some])])
            top = ranked(ids[at], got)[:most]
            at, got = at[top], got[top]
        yield ids[at], got, (ids[at] == qid) & (rows[at] == q).all(axis=1), evaluated


def narrow(x: np.ndarray) -> np.ndarray:
    """Integers that are held as floats, in the smallest type that holds them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(rows - p, axis=1) for p in pivots], axis=1) if len(pivots) else np.empty((len(rows), 0))


def top_k(vectors: DataFrame, queries: Column, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id, score: each query row's k highest inner products.

    Candidate blocks are dealt to slots, query blocks to each slot; a task reads a slot's
    candidates and then its queries one block at a time, so neither the driver nor a task
    holds all queries. A slot leaves k rows a query, and the best of them are ranked per query.
    """
    number = F.monotonically_increasing_id()  # of the scan, so that it is the same when a task runs again
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), queries.alias("q"), number.alias("number")).where("id IS NOT NULL AND v IS NOT NULL")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").toArrow()["v"].combine_chunks()
    by_length: dict[int, list[np.ndarray]] = {}
    for v in integers(sample, scale):
        if v is not None:
            by_length.setdefault(len(v), []).append(v)
    known = vectors.sparkSession.sparkContext.broadcast({n: (pivots_of(v, PIVOTS), np.array(v)) for n, v in by_length.items() if n})  # PIVOT_SAMPLE rows at most

    def blocks(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

            def packed(n: int) -> pa.RecordBatch:
                part, held[n] = held[n], []
                x = narrow(np.array([v for *_, v in part]).reshape(len(part), n))
                ids, numbers = (np.array([r[k] for r in part], np.int64).tobytes() for k in (0, 1))
                return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([x.itemsize], pa.int32()), *(pa.array([b], pa.binary()) for b in (ids, numbers, x.tobytes()))], ["dim", "width", "ids", "numbers", "vectors"])

            for b in batches:
                for i, number, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), integers(b.column(1), scale), strict=True):
                    if v is not None:
                        held.setdefault(len(v), []).append((i, number, v))
                        if len(held[len(v)]) == size:
                            yield packed(len(v))
            for n in [n for n in held if held[n]]:
                yield packed(n)

        return run

    totals = rows.agg(F.count("*"), F.count_if("q")).first()
    held = min(SLOT_BLOCKS, max(1, SLOT_BYTES // (8 * BLOCK * max([1, *by_length]))))
    slots = max(1, math.ceil(totals[0] / (held * BLOCK)), min(SLOTS, math.ceil(totals[0] / BLOCK)))
    candidates = rows.select("id", "v", "number").mapInArrow(blocks(BLOCK), _BLOCKS).withColumn("slot", F.pmod(F.xxhash64("ids", "numbers"), F.lit(slots)).cast("int"))
    asked = rows.where("q").select("id", "v", "number").repartition(max(1, math.ceil(totals[1] / QUERY_BLOCK))).mapInArrow(blocks(QUERY_BLOCK), _BLOCKS)
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    both = candidates.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1)))
    both = both.repartition(slots, "slot").sortWithinPartitions("slot", "dim", "asks").select("slot", "dim", "asks", "width", "ids", "numbers", "vectors")
    most = k + 1  # a query's own row among them

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, candidates = None, []  # the slot and length that are read, and its candidate blocks: ids, vectors, bounds
        for b in batches:
            for n in range(b.num_rows):
                slot, dim, asks, width, *raw = (c[n].as_py() for c in b.columns)
                ids, numbers = (np.frombuffer(r, np.int64) for r in raw[:2])
                x = np.frombuffer(raw[2], {2: np.int16, 4: np.int32, 8: np.float64}[width]).astype(np.float64).reshape(len(ids), dim)
                if there != (slot, dim):
                    there, candidates = (slot, dim), []
                pivots, some = known.value.get(dim, (np.empty((0, dim)), np.empty((0, dim))))
                bounds = distances(x, pivots)
                if not asks:
                    candidates.append((ids, x, bounds))
                    continue
                best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(x)
                bars = first_bars(x, some, most)
                for block in candidates:
                    for at, (i, scores, own, _) in enumerate(best_of(ids, x, bounds, *block, most, bars)):
                        i, scores, own = (np.concatenate(c) for c in zip(best[at], (i, scores, own), strict=True))
                        top = ranked(i, scores)[:most]
                        best[at] = i[top], scores[top], own[top]
                        if len(top) == most:
                            bars[at] = max(bars[at], scores[top[-1]])
                sizes = [len(f[0]) for f in best]
                columns = [np.repeat(numbers, sizes), np.repeat(ids, sizes), *(np.concatenate(c) for c in zip(*best, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["number", "query_id", "vec_id", "score", "own"])

    found = both.mapInArrow(search, "number long, query_id long, vec_id long, score long, own boolean")
    own = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    found = found.withColumn("place", F.row_number().over(own)).where(F.col("place") <= most)
    # one row that equals the query, its own, takes no place
    before = F.coalesce(F.max(F.col("own").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("before", before).where("before = 1 OR NOT own")
    return found.select("query_id", (F.col("place") - F.col("before")).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
