"""Document quality by hierarchical empirical Bayes.

A logistic classifier over simple counts of a text gives the evidence of the document
itself. Hosts and the paths below them give the prior: the share of good labels of a
host is shrunk towards the global share, that of a path towards its host's, with
strengths estimated from how much hosts, and paths within hosts, differ. A site with
few labels so has its parent's share. Evidence and prior add as log odds.

A document's own labels have no part in its own prior, which else would tell what it is
to predict.

Labels beyond 0 and 1, and labels of unknown documents, are ignored; several labels of
one document count with their mean for the classifier, and all for the sites. Without labels of both kinds the classifier has no evidence to
give. Null hosts and paths are sites of their own. Null texts and texts without a
word have score 0 and are not kept. Every row gives one row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Scratch, as_bytes, slices

#: Labelled documents from which the classifier is learned, about.
SAMPLE_ROWS = 20_000
#: Bounds of a prior's strength, in labels.
STRENGTH = (2.0, 1000.0)
STEPS = 60
RIDGE = 1e-3

FEATURES = ("words", "word_length", "symbols", "digits", "capitals", "shouts", "distinct", "commonest", "repeats", "line_copies", "short_lines", "bars", "odd_words", "long_words", "stops")
#: Features as they are, their squares, and those of short texts apart.
WIDTH = 3 * len(FEATURES)

_KIND = np.zeros(256, np.int64)
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,!?'\"|"]] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[ord("!")] = 4
_KIND[ord("|")] = 5
_ODD = frozenset(b"#$%&*@^~<>{}[]\\=+_")


def features_of(text: bytes) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6) / max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return [
        min(1.0, np.log1p(len(words)) / 8),
        min(1.0, sizes.sum() / n / 12),
        kinds[1] * 5,
        kinds[2] * 5,
        kinds[3] * 2,
        kinds[4] * 10,
        len(counts) / n,
        (max(counts.values(), default=0) - 1) / n,
        sum(map(bytes.__eq__, words[1:], words)) / n,
        1 - len(set(lines)) / m,
        sum(len(x) < 40 for x in lines) / m,
        kinds[5] * 10,
        sum(1 for w, c in counts.items() if c and not _ODD.isdisjoint(w)) / max(1, len(counts)),
        (sizes > 14).sum() / n,
        text.count(b". ") / n * 4,
    ]


def design(rows: np.ndarray) -> np.ndarray:
    short = rows * (rows[:, :1] < np.log1p(25) / 8)
    return np.concatenate([rows, rows * rows, short], axis=1)


class Classifier:
    """Logistic regression by Newton steps; evidence is its log odds without the base rate's."""

    def __init__(self, rows: np.ndarray, good: np.ndarray):
        self.weights = None
        if not 0 < good.sum() < len(good):
            return
        x = design(rows)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w, ridge = np.zeros(x.shape[1]), RIDGE * len(x) * np.eye(x.shape[1])
        ridge[0, 0] = 0
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (good - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights, self.base = w, np.log(good.sum() / (len(good) - good.sum()))

    def evidence(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(rows):
            return np.zeros(len(rows))
        x = (design(rows) - self.mean) / self.scale
        return np.clip(x @ self.weights[1:] + self.weights[0] - self.base, -30, 30)


def measured(texts: DataFrame) -> DataFrame:
    """id, x: the features of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([features_of(t or b"") for t in data], pa.list_(pa.float64()))], ["id", "x"])

    return texts.mapInArrow(run, "id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE_ROWS) -> Classifier:
    """Learn from about `most` labelled rows, chosen by the hash of their ids."""
    known = labelled(labels, id_col, label_col).select("id", (F.col("k") / F.col("n")).alias("good"))
    share = min(1.0, most / max(1, known.count()))
    some = F.broadcast(known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)))  # about `most` rows, one for each id
    texts = as_bytes(docs, id_col, text_col).where("text IS NOT NULL")
    rows = measured(texts.join(some, "id", "left_semi")).groupBy("id").agg(F.min("x").alias("x")).join(some, "id").toPandas().sort_values("id")
    if rows.empty:
        return Classifier(np.empty((0, len(FEATURES))), np.empty(0))
    return Classifier(np.array(rows["x"].tolist()), rows["good"].to_numpy().astype(float))


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id, n (its labels), k (those that say good); one row for each id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"), F.sum(F.col(label_col).cast("long")).alias("k"))


def log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(rows: DataFrame, parent: str) -> float:
    """The prior strength by the method of moments: how far groups (n, k) stand from their parent's share."""
    d = (F.col("k") / F.col("n") - F.col(parent)) * (F.col("k") / F.col("n") - F.col(parent))
    p = F.col(parent) * (1 - F.col(parent))
    r = rows.where("n > 0").agg(F.sum(F.col("n") * d).alias("between"), F.sum(p).alias("noise"), F.sum(p * F.col("n")).alias("total"), F.sum("n").alias("n")).first()
    if not r["n"]:
        return STRENGTH[1]
    spread = max(0.0, (r["between"] - r["noise"]) / r["n"])
    return float(np.clip(r["total"] / r["n"] / max(spread, 1e-12) - 1, *STRENGTH))


def site_priors(sites: DataFrame, scratch: Scratch) -> tuple[DataFrame, float, float, float]:
    """host, path, path_n, path_k, host_n, host_k of sites (host, path, n, k); the global share and the strengths of hosts and paths."""
    total = sites.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    share = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)
    hosts = scratch.keep(sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("share", F.lit(share)), "hosts")
    a = strength(hosts, "share")
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("k").alias("host_k"), shrunk(F.col("k"), F.col("n"), a, F.lit(share)).alias("host_share"))
    paths = scratch.keep(sites.join(hosts, sites["host"].eqNullSafe(hosts["host"])).drop(hosts["host"]), "paths")
    b = strength(paths, "host_share")
    return paths.select("host", "path", F.col("n").alias("path_n"), F.col("k").alias("path_k"), "host_n", "host_k"), share, a, b


def shrunk(k: Column, n: Column, strength: float, parent: Column) -> Column:
    """The posterior share of k good labels of n, with a prior of the parent's share that counts as `strength` labels."""
    return (k + strength * parent) / (n + strength)


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """id, evidence, host_share, path_share, score (probability of good), kept (score of at least `least`)."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    known = scratch.keep(labelled(labels, id_col, label_col), "labelled")
    places = docs.select(F.col(id_col).cast("long").alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    counts = places.join(known, "id", "left").groupBy("host", "path").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    sites, share, a, b = site_priors(scratch.keep(counts, "counts"), scratch)
    columns = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = part.column(1).to_pylist()
                e = model.evidence(np.array([features_of(t or b"") for t in texts]))
                e = [x if t and t.strip() else None for x, t in zip(e.tolist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(e, pa.float64())], ["id", "host", "path", "evidence"])

    rows = columns.mapInArrow(run, "id long, host string, path string, evidence double")
    out = rows.join(sites, rows["host"].eqNullSafe(sites["host"]) & rows["path"].eqNullSafe(sites["path"]), "left").join(known, "id", "left")
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))  # the document's own labels, left out
    out = out.select("id", "evidence", n.alias("n"), k.alias("k"), "path_n", "path_k", shrunk(F.col("host_k") - k, F.col("host_n") - n, a, F.lit(share)).alias("host_share"))
    out = out.withColumn("path_share", shrunk(F.col("path_k") - F.col("k"), F.col("path_n") - F.col("n"), b, F.col("host_share")))
    odds = F.col("evidence") + log_odds(F.col("path_share"))
    p = F.coalesce(1 / (1 + F.exp(-odds)), F.lit(0.0))
    return scratch.done(out.select(F.col("id").alias(id_col), "evidence", "host_share", "path_share", p.alias("score"), (p >= least).alias("kept")))
