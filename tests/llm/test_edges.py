"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from pageloom.llm import bpe, components, counts, decontam, langid, license, linedup, neardup, quality, substring, topk
from pageloom.llm.common import Scratch

RANKS, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with all that may go wrong; more columns have the names of results and helpers."""
    rng = random.Random(3)
    prose = " ".join(rng.choice("the of and a in to is it on as at by we".split()) + str(rng.randrange(40)) for _ in range(80))
    rows = [
        (1, prose, "en", "s", 1), (2, prose, "en", "s", 1), (2, prose, "en", "s", 1), (3, prose + " tail", None, "s", None), (4, None, "en", None, 0), (5, "", "en", "s", 0), (6, " \n\t ", None, None, 0),
        (None, prose, "en", "s", 1), (7, LONG, "en", "s", 1), (8, "é 中文 🦜 <s> <|endoftext|>", "fr", "t", 1), (9, "12 34 !!", "de", "t", 1), (10, "one two", "de", "t", 1), (11, "one two", "de", "t", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("gone", "items", "spans_", "id", "n", "key", "kept", "group", "__row", "m", "e", "start", "spans", "line", "lid", "host", "path", "score", "license", "x", "n_words"))])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 1, 0), (9, 0, 0), (10, 0, 0), (99, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "word1 word2"), (1, "one two")], "item_id long, text string")


def operators(spark, labels, bench):
    docs_of = lambda f: lambda d: f(d)
    return {
        "quality": docs_of(lambda d: quality.score(d, labels, F.col("source"), F.col("lang"))), "substring": docs_of(substring.report), "langid": docs_of(lambda d: langid.predict(d, langid.fit(d))),
        "bpe": docs_of(lambda d: bpe.round_trip(d, RANKS, P.PATTERN)), "counts": docs_of(lambda d: counts.count_tokens(d, MODEL)), "decontam": docs_of(lambda d: decontam.report(d, bench)),
        "neardup": docs_of(neardup.near_duplicates), "license": docs_of(license.scan),
    }


@pytest.mark.parametrize("name", ["quality", "substring", "langid", "bpe", "counts", "decontam", "neardup", "license"])
def test_one_row_for_each_row(spark, odd, empty, labels, bench, name):
    op = operators(spark, labels, bench)[name]
    assert sorted(r.doc_id or 0 for r in op(odd).collect()) == sorted(r.doc_id or 0 for r in odd.collect())
    assert op(empty).count() == 0


def test_lines(spark, odd, empty):
    out = linedup.line_groups(odd)
    assert {r.doc_id for r in out.where("kept").collect()} == {1, 7, 8, 9, 10}
    assert linedup.line_groups(empty).count() == 0 and linedup.drop_copies(empty).count() == 0
    left = {r.doc_id: r.text for r in linedup.drop_copies(odd).collect()}
    assert set(left) == {None, 1, 4, 5, 6, 7, 8, 9, 10}  # 2, 3 and 11 have lost all they had
    assert left[4] is None and left[5] == "" and left[10] == "one two" and left[None] and linedup.drop_copies(odd).columns == odd.columns


def test_lines_are_cut_where_they_stand(spark):
    rows = [(1, "a\n\nb\nc", 0), (2, "x\nb\n\nA \ny\n", 0), (3, "b\nz", 0), (4, "b\n \nc", 0)]
    left = {r.doc_id: r.text for r in linedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, gone int")).collect()}
    assert left == {1: "a\n\nb\nc", 2: "x\n\ny\n", 3: "z"}


def test_near_duplicates(odd):
    out = {r.doc_id: r for r in neardup.near_duplicates(odd).collect()}
    assert (out[2].component_id, out[3].component_id, out[11].component_id) == (1, 1, 10) and out[4].n_shingles == out[5].n_shingles == out[6].n_shingles == 0
    assert out[None].component_id is None and out[None].kept and out[4].kept and not out[2].kept
    kept = neardup.first_of_each(odd)
    assert {r.doc_id for r in kept.collect()} == {None, 1, 4, 5, 6, 7, 8, 9, 10}


def test_substrings(odd):
    out = {r.doc_id: r for r in substring.report(odd).collect()}
    assert out[1].n_removed == 0 and out[2].n_removed == 80 and out[2].kept_sha256 == hashlib.sha256(b"").hexdigest() and out[3].n_removed == 80 and out[None].n_removed == 0 and out[4].n_words == 0


def test_contamination(odd, bench):
    out = {r.doc_id: r for r in decontam.report(odd, bench).collect()}
    assert (out[10].n_words, out[10].n_hit, out[10].n_items) == (2, 2, 1) and out[7].n_hit == 0 and out[4].n_words == 0
    cut = {r.doc_id: r.text for r in decontam.excise(odd, bench).collect()}
    assert cut[10] == "" and cut[4] is None and cut[8].startswith("é") and decontam.excise(odd, bench.limit(0)).count() == odd.count()


def test_languages(odd):
    out = {r.doc_id: r for r in langid.predict(odd, langid.fit(odd)).collect()}
    assert all(out[k].lang_pred == "und" and out[k].score == 0 and out[k].rejected for k in (4, 5, 6, 9))
    assert langid.predict(odd, langid.Model([])).where("lang_pred <> 'und'").count() == 0
    kept = langid.accept(odd, langid.fit(odd))
    assert kept.columns == odd.columns and 4 not in {r.doc_id for r in kept.collect()} and langid.accept(odd.limit(0), langid.fit(odd.limit(0))).count() == 0


def test_tokens(odd):
    out = {r.doc_id: r for r in counts.count_tokens(odd, MODEL).collect()}
    assert (out[4].n_bytes, out[4].n_tokens) == (0, 0) and out[7].over_limit and not out[8].over_limit
    spans = bpe.encode(odd.where("doc_id = 8"), RANKS, P.PATTERN, offsets=True).first()
    text = "é 中文 🦜 <s> <|endoftext|>"
    assert spans.char_starts[0] == 0 and spans.char_ends[-1] == len(text) and all(a < b for a, b in zip(spans.char_starts, spans.char_ends, strict=True))


def test_ids_without_bytes(spark):
    rows = [(1, [0, 1]), (2, [0, 10_000_000]), (3, None), (4, []), (5, [0, None])]
    out = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), RANKS).collect()}
    assert len(out[1]) == 2 and out[2] is None and bytes(out[3]) == bytes(out[4]) == b"" and out[5] is None


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (100, [0.0, 1.0]), (200, []), (None, [1.0, 1.0]), (7, [1e30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    out = topk.top_k(df, F.pmod("vec_id", F.lit(100)) == 0).collect()
    first = [(r["rank"], r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 0]
    assert first == [(1, 7, (1 << 63) - 1), (2, 1, 1 << 20), (3, 2, 1 << 20), (4, 100, 0)]
    assert not [r for r in out if r.query_id == 200] and topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_repeated_vectors(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.5, 0.0]), (1, [0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted(tuple(r) for r in topk.top_k(df, F.pmod("vec_id", F.lit(100)) == 0).collect())
    one, half, quarter = 1 << 20, 1 << 19, 1 << 18
    a = [(100, 1, 100, one), (100, 2, 100, half), (100, 3, 1, quarter)]
    assert out == sorted([*a, *a, (100, 1, 100, half), (100, 2, 100, half), (100, 3, 1, quarter // 2)])


def test_pipeline_of_odd_and_no_rows(spark, odd, tmp_path):
    import corpus_pipeline

    for name, df in (("odd", odd), ("none", odd.limit(0))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (out.count() > 0) == (name == "odd")


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 60), (70, 70), (60, 55)], "a long, b long")
    out = {r.id: r.component for r in components.components(links, Scratch(spark, "t")).collect()}
    assert out == {**{k: 1 for k in range(1, 41)}, 50: 50, 55: 50, 60: 50}


def test_centres_are_met_once(spark):
    """Members that share 24 lists meet their centres once, and twice the members make twice the rows."""
    for n in (100, 200):
        members = spark.range(n).selectExpr("explode(sequence(0L, 23L)) AS key", "id", "if(id < 10, 0L, id) AS group").unionByName(spark.range(5, 7).selectExpr("99L AS key", "id", "0L AS group"))
        pairs = [tuple(r) for r in components.centre_pairs(members, Scratch(spark, "t")).select("x", "y").collect()]
        centres = {y for _, y in pairs}
        assert len(pairs) == len(set(pairs)) <= components.CENTRES * n and len(centres) == components.CENTRES
        assert set(pairs) == {(x, y) for x in range(n) for y in centres if x != y and max(x, y) >= 10}


def test_blocks_meet_once(spark):
    """Of large groups, small ones and lone members, all pairs of different groups meet, in one pair of blocks."""
    rows = [(key, k, group, 10 + k % 3) for key, groups in ((1, [0] * 40 + [100] * 30 + [200] * 30), (2, [0] * 50 + list(range(300, 320))), (3, list(range(400, 409)) + [500] * 3), (4, [0] * 25 + [100] * 25)) for k, group in enumerate(groups)]
    members = spark.createDataFrame([(a, a * 1000 + b, c) for a, b, c, _ in rows], "key long, id long, group long")
    sets = spark.createDataFrame([(a * 1000 + b, n) for a, b, _, n in rows], "id long, n int")
    pairs = components.block_pairs(members, sets, 8, 0.5, Scratch(spark, "t"))
    met = [(r.key, *sorted((x.id, y.id))) for r in pairs.collect() for x in r.docs_x for y in r.docs_y if x.group != y.group]
    # members of one block meet on both sides of its pair with itself
    assert set(met) == {(a, a * 1000 + b, a * 1000 + d) for a, b, c, _ in rows for e, d, f, _ in rows if a == e and b < d and c != f}
    # both sides are keys of the join, so that a large group's own blocks are not joined to be dropped
    assert "<=>" in pairs._jdf.queryExecution().optimizedPlan().toString()
    blocks = [frozenset((frozenset(x.id for x in r.docs_x), frozenset(y.id for y in r.docs_y))) for r in pairs.collect()]
    assert len(blocks) == len(set(blocks))


def test_licences(spark):
    assert spark.range(1).select(license.one_line(license.canonical_lines(F.lit("a licence licence licence b")))).first()[0] == "a license license license b"
    mit = dict(license.TEXTS)["MIT"]
    rows = [(1, "Copyright (c) 2020 Some One\n\n" + mit.replace(".", " .").upper()), (2, "text\nReleased under the MIT Licence\nmore"), (3, mit[:-20]), (4, None), (5, "")]
    out = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))).collect()}
    assert (out[1].license, out[2].license, out[2].notices, out[3].license, out[4].canonical_sha256) == ("MIT", None, "MIT", None, None)
