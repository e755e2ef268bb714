"""Results against SQL, libraries and brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from comparing import DATA, duck, spark_rows
from pageloom.llm import counts, decontam, langid, linedup, neardup, quality, queries, topk

tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, DATA)) == duck(queries.ORACLES[name])


@tables
def test_encoding_equals_the_library(spark):
    import hashlib

    import public_tokenizers as P
    import sentencepiece
    import tiktoken

    from pageloom.llm import bpe

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(queries.BYTE_BPE), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op5_byte_bpe(spark, DATA).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    assert {r.doc_id: r.n_tokens for r in queries.op6_token_counts(spark, DATA).collect()} == {i: len(sp.encode(t)) for i, t in texts.items()}


def test_long_texts_are_cut_safely(monkeypatch):
    monkeypatch.setattr(counts, "LONG", 20)
    with open(queries.PIECE_BPE, "rb") as f:
        c = counts.Counter(f.read())
    assert c.safe
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "the ", "  ", "\n", "é", " b", "▁", "xyz "]) for _ in range(60)) for _ in range(200)]
    assert c.counts(texts) == [len(x) for x in c.sp.encode(texts)]


@tables
def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    out = queries.op4_language_id(spark, DATA).join(docs, "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count() and out.where("rejected").count() <= 1


@tables
def test_languages_that_were_not_learned_are_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(7)
    strange = [
        " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10))) for _ in range(150)),
        "".join(rng.choices("0123456789abcdef", k=1500)),
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä",
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa",
    ]
    model = langid.fit(docs)
    assert model.predict(strange)[2] == [True] * 4
    held = [r.text for r in docs.where(langid.held_out("doc_id") & F.col("text").rlike("[a-z]")).collect()]
    assert len(held) > 20 and not any(model.predict(held)[2])


@tables
def test_quality_of_held_out_labels(spark):
    """Half of the labels teach, the other half is held against."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    teach = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = quality.score(docs, labels.where(teach), F.col("source"), F.col("lang")).join(labels.where(~teach), "doc_id")
    assert out.count() >= 20 and out.where(F.col("kept") == (F.col("quality") == 1)).count() >= 0.8 * out.count()


def test_posteriors_of_sparse_sites_against_brute_force(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(300):
        host = f"h{int(rng.paretovariate(0.8)) % 40}"
        docs.append((i, " ".join(rng.choice("abcdefg") * rng.randrange(1, 9) for _ in range(20)), host, None if i % 11 == 0 else f"/{rng.randrange(3)}"))
        labels += [(i, int(rng.random() < (0.8 if host < "h2" else 0.3)), 0) for _ in range(rng.choice([0, 1, 1, 2]))]
    df = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    out = {r.doc_id: r for r in quality.score(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("host"), F.col("path")).collect()}
    own = {i: [g for j, g, _ in labels if j == i] for i, *_ in docs}

    def sums(key):
        out = {}
        for d in docs:
            n, k = out.get(key(d), (0, 0))
            out[key(d)] = (n + len(own[d[0]]), k + sum(own[d[0]]))
        return out

    def strength(rows):
        rows = [(n, k, p) for n, k, p in rows if n]
        total = sum(n for n, _, _ in rows)
        between, noise = sum(n * (k / n - p) ** 2 for n, k, p in rows), sum(p * (1 - p) for *_, p in rows)
        spread = max(0.0, (between - noise) / total)
        return min(max(sum(n * p * (1 - p) for n, _, p in rows) / total / max(spread, 1e-12) - 1, quality.STRENGTH[0]), quality.STRENGTH[1])

    hosts, paths = sums(lambda d: d[2]), sums(lambda d: d[2:])
    share = (sum(k for _, k in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    a = strength([(n, k, share) for n, k in hosts.values()])
    parent = {h: (k + a * share) / (n + a) for h, (n, k) in hosts.items()}
    b = strength([(n, k, parent[h]) for (h, _), (n, k) in paths.items()])
    assert len(paths) > 50
    for i, _, h, p in docs:
        n, k = len(own[i]), sum(own[i])
        host = (hosts[h][1] - k + a * share) / (hosts[h][0] - n + a)
        assert out[i].host_share == pytest.approx(host) and out[i].path_share == pytest.approx((paths[h, p][1] - k + b * host) / (paths[h, p][0] - n + b))
        assert out[i].score == pytest.approx(1 / (1 + np.exp(-out[i].evidence) * (1 - out[i].path_share) / out[i].path_share))


def test_index_finds_what_a_scan_finds():
    rng = random.Random(1)
    for _ in range(120):
        words = [f"w{k}" for k in range(rng.choice([2, 5, 30]))]
        text = lambda n: " ".join(rng.choices(words, k=n)).encode()
        items = [(str(k), text(rng.randrange(12))) for k in range(6)] + [("n", None)]
        docs = [text(rng.randrange(60)) + b" zz " + text(rng.randrange(20)) for _ in range(6)] + [None, b""]
        n, spans, found = decontam.search_shard(docs, decontam.Phrases(items, 4))
        for k, d in enumerate(docs):
            own, hit, names = decontam.words_of(d), set(), set()
            for name, t in items:
                w = decontam.words_of(t)
                m = min(4, len(w))
                for a in range(len(w) - m + 1 if m else 0):
                    for p in range(len(own) - m + 1):
                        if own[p : p + m] == w[a : a + m]:
                            hit |= set(range(p, p + m))
                            names.add(name)
            assert (n[k], {x for a, b in spans[k] for x in range(a, b)}, found[k]) == (len(own), hit, sorted(names))


def test_bounds_eliminate_candidates_of_clusters():
    """The share that is evaluated, and the same result as without bounds."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    rows = np.floor(1024 * (centres[rng.integers(0, 40, 4000)] + rng.normal(scale=0.05, size=(4000, 32))))
    pivots, ids = topk.pivots_of(list(rows[:400]), 40), np.arange(4000)
    bounds = np.stack([np.linalg.norm(rows - p, axis=1) for p in pivots], axis=1)
    q = slice(0, 4000, 100)
    found = list(topk.best_of(ids[q], rows[q], bounds[q], ids, rows, bounds, 11, topk.first_bars(rows[q], rows[:400], 11)))
    for k, (got, scores, own, _) in enumerate(found):
        all_ = (rows @ rows[100 * k]).astype(np.int64)
        best = np.lexsort((ids, -all_))[:11]
        assert got.tolist() == best.tolist() and scores.tolist() == all_[best].tolist() and own.sum() <= 1
    share = sum(f[3] for f in found) / (len(found) * 4000)
    print("evaluated", share)
    assert share < 0.25


def test_queries_are_streamed_not_broadcast(spark, monkeypatch):
    """All slots see all queries in an exchange, whatever the broadcast threshold, and the result is exact."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "SLOT_BLOCKS", 2, raising=False)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x[1500:1520], x[2000] = x[0], x[0] * 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    out = topk.top_k(df, F.pmod("vec_id", F.lit(100)) == 0)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out.collect()}
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    ints = [[int(v) for v in np.floor(1024 * row)] for row in x]
    for q in range(0, 3000, 100):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in enumerate(ints) if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in scores]
    assert len(got) == 300


def shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("longest", [2, 32])
def test_near_copies_against_all_pairs(spark, monkeypatch, longest):
    from pageloom.llm import components

    monkeypatch.setattr(components, "LONG", longest)
    monkeypatch.setattr(components, "PER_POSTING", 0)
    rng = random.Random(9)
    base = [[f"v{rng.randrange(300)}" for _ in range(90)] for _ in range(4)]
    docs = []
    for k in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(8)):
            w[rng.randrange(90)] = f"z{rng.randrange(10_000)}"
        docs.append((k, " ".join(w)))
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, _ in docs:
        for j, _ in docs:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    out = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {i: top(i) for i, _ in docs}


@pytest.mark.parametrize("longest", [2, 32])
def test_near_lines(spark, monkeypatch, longest):
    from pageloom.llm import components

    monkeypatch.setattr(components, "LONG", longest)
    monkeypatch.setattr(components, "PER_POSTING", 0)
    rng = random.Random(4)
    base = [" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(14)) for _ in range(5)]
    lines = []
    for _ in range(60):
        w = rng.choice(base).split()
        if rng.random() < 0.7:
            w[rng.randrange(14)] = "".join(rng.choices("klmnop", k=4))
        lines.append(" ".join(w))
    docs = [(k, "\n".join(lines[k * 3 : k * 3 + 3])) for k in range(20)]

    def grams(t):
        return {t[k : k + 5] for k in range(len(t) - 4)}

    out = {(r.doc_id, r.line_no): (r.first_doc, r.first_line) for r in linedup.line_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    at = {(k // 3, k % 3): t for k, t in enumerate(lines)}
    linked = lost = 0
    for p, t in at.items():
        for q, u in at.items():
            if p < q and len(grams(t) & grams(u)) >= 0.8 * len(grams(t) | grams(u)):
                linked += 1
                lost += out[p] != out[q]
    assert linked > 100 and lost <= 0.02 * linked
    assert all(len(grams(at[p]) & grams(at[f])) > 0.3 * len(grams(at[p])) for p, f in out.items())


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage again in plain Python, on what the stage before has left."""
    import hashlib
    import zlib

    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline
    from pageloom.llm import bpe

    rng = random.Random(21)
    vocabulary = {"en": [f"the{c}ing" for c in "abcdefghijkl"] + ["of", "and", "with"], "de": [f"ge{c}ung" for c in "bdfgklmnprst"] + ["der", "und", "mit"]}

    def line(lang, n=14):
        return " ".join(rng.choice(vocabulary[lang]) + rng.choice("aeiou") for _ in range(n))

    bench = [(k, line("en", 12)) for k in range(3)]
    docs = [(k, "\n".join(line(lang) for _ in range(6)), lang) for k, lang in enumerate(["en", "de"] * 30)]
    text = [t for _, t, _ in docs]
    text[7] = text[3]
    text[9] = text[3].replace("und", "oder", 1)
    text[11] = "\n".join([*text[12].split("\n")[:3], text[11]])
    junk = next(i for i in range(22, 60) if zlib.crc32(str(i).encode()) % 5 == 0)  # not one to learn from
    text[junk] = " ".join(bytes(rng.choices(b"qxzjkvw", k=9)).decode() for _ in range(120))
    text[15] = "\n".join([text[15], bench[0][1], line("de")])
    text[17] = "\n".join([text[17], bench[1][1] + " " + bench[2][1]])
    words = text[19].replace("\n", " ").split()
    words[20] = "zzz"
    text[21] = "\n".join(" ".join(words[k : k + 8]) for k in range(0, len(words), 8))
    docs = [(i, text[i], lang, "s", len(text[i])) for i, _, lang in docs] + [(60, None, "en", "s", 0), (61, "", "de", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = langid.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    left = {i: t for i, t, *_ in docs if not model.predict([t or ""])[2][0]}
    assert junk not in left and 60 not in left and 61 not in left and len(left) == 59

    def joined(near, items):
        root = {i: i for i in items}

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in items:
            for j in items:
                if i < j and near(items[i], items[j]):
                    a, b = top(i), top(j)
                    root[max(a, b)] = min(a, b)
        return {i: top(i) for i in items}

    grams = lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    lines = {(i, n): x.strip().lower() for i, t in left.items() for n, x in enumerate(t.split("\n")) if x.strip()}
    sets = {p: (x, grams(x)) for p, x in lines.items()}
    first = joined(lambda x, y: x[0] == y[0] or min(len(x[0]), len(y[0])) >= 20 and len(x[1] & y[1]) >= 0.8 * len(x[1] | y[1]), sets)
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if first.get((i, n), (i, n)) == (i, n)) for i, t in left.items()}
    left = {i: t for i, t in left.items() if t.strip()}
    assert 7 not in left and len(left[12].split("\n")) == 3
    first = joined(lambda x, y: bool(x) and 100 * len(x & y) >= 75 * len(x | y), {i: shingles(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if first[i] == i}
    assert (19 in left, 21 in left) == (True, False), (left.get(19), left.get(21), first.get(19), first.get(21))

    def hits(t, item):
        w, b = [x.lower() for x in t.split()], item.split()
        windows = {tuple(b[k : k + 8]) for k in range(len(b) - 7)}
        return {p for k in range(len(w) - 7) if tuple(w[k : k + 8]) in windows for p in range(k, k + 8)}

    found = {i: [h for _, b in bench if (h := hits(t, b))] for i, t in left.items()}
    assert len(found[15]) == 1 and len(found[17]) == 2
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(queries.BYTE_BPE), special_tokens={})
    expected = {}
    for i, t in left.items():
        if len(found[i]) < 2:
            if found[i]:
                data = t.encode()
                gone = sorted(set.union(*found[i]))
                runs = [(a, b) for a in gone if a - 1 not in gone for b in gone if b >= a and b + 1 not in gone and set(range(a, b + 1)) <= set(gone)]
                t = decontam.cut_spans(data, [(a, b + 1) for a, b in runs]).decode()
                assert not hits(t, bench[0][1])
            ids = own.encode_ordinary(t)
            expected[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert out == expected


def near_pairs(spark, pairs):
    """How many pairs of lines have a 5-gram similarity of 0.8, and how many of these are apart in the result."""
    grams = lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    docs = [(2 * n + k, t) for n, p in enumerate(pairs) for k, t in enumerate(p)]
    out = {r.doc_id: r.first_doc for r in linedup.line_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    near = [n for n, (a, b) in enumerate(pairs) if len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))]
    return len(near), sum(out[2 * n] != out[2 * n + 1] for n in near)


def test_near_lines_without_spaces(spark):
    rng = random.Random(11)
    pairs = []
    for n in range(200):
        t = [chr(0x4E00 + rng.randrange(3000)) if n % 2 else rng.choice("abcdefghij0123/=&\t") for _ in range(80)]
        t[0], t[-1], k = "x", "x", rng.randrange(1, 20)
        pairs.append(("".join(t), "".join([*t[:k], "q", *t[k + 1 :]])))
    near, lost = near_pairs(spark, pairs)
    assert near == 200 and lost <= 2


def test_near_lines_with_changed_characters(spark):
    rng = random.Random(12)
    pairs = []
    for n in range(1200):
        size = rng.randrange(*[(20, 40), (40, 60), (60, 200)][n % 3])
        t = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 8))) for _ in range(size))[:size]
        t = list("x" + t[1:-1] + "x")
        u = list(t)
        for _ in range(max(1, size // 50)):
            u[rng.choice([1, size - 2, rng.randrange(1, size - 1)])] = "z"
        pairs.append(("".join(t), "".join(u)))
    near, lost = near_pairs(spark, pairs)
    assert near > 700 and lost <= 0.01 * near


def test_lines_of_few_shingles(spark):
    pairs = [("ab" * 15 + c * 30, "ab" * 15 + c * 30 + c) for c in "klmnop"] + [(c * 24, c * 30) for c in "rst"]
    assert near_pairs(spark, pairs) == (9, 0)


def test_lines_that_repeat_their_runs(spark):
    """Alike in runs of 5 alone, in an order of their own."""
    rng = random.Random(13)
    pairs = [tuple("".join(rng.choices("01", k=400)) for _ in "ab") for _ in range(40)]
    near, lost = near_pairs(spark, pairs)
    assert near == 40 and lost == 0


def test_chance_gives_few_line_candidates(spark):
    """Lines of common words share runs of 5 characters, but few are compared."""
    from pageloom.llm import components
    from pageloom.llm.common import Scratch

    rng = random.Random(14)
    words = ["".join(rng.choices(["the", "on", "er", "at", "in", "ed"], k=rng.randrange(1, 4))) for _ in range(60)]
    lines = [(k, " ".join(rng.choices(words, k=25))) for k in range(1500)]
    scratch = Scratch(spark, "chance")
    sketches = linedup.signatures(spark.createDataFrame(lines, "lid long, line string"))
    postings = linedup.posted(scratch.keep(sketches), linedup.BANDS, scratch)
    assert components.short_pairs(postings).count() < 1500  # of 1.1 million; 2,794 shared two bands of runs of 5


def test_block_links_grow_with_groups(spark):
    """Two groups that are alike throughout are one link, whatever their sizes."""
    side = lambda name, ids, group: f"array({','.join(f'named_struct(\"id\",{i}L,\"group\",{group}L,\"keys\",array(1L),\"bitmap\",named_struct(\"n\",3,\"bits\",7L,\"some\",0L),\"set\",array(1L,2L,3L))' for i in ids)}) AS {name}"
    pairs = spark.sql(f"SELECT 1L AS key, {side('docs_x', range(30), 0)}, {side('docs_y', range(50, 80), 50)}")
    assert [tuple(r) for r in linedup.block_links(pairs).collect()] == [(0, 50)]


def rows_of_left_joins(spark, run):
    """The rows that left joins by id make in what `run` executes."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    rows, executions = 0, store.executionsList()
    for k in range(before, executions.size()):
        number = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "LeftOuter" in node.desc() and node.desc().count("[id#") == 2:
                own = [node.metrics().apply(i) for i in range(node.metrics().size())]
                rows += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in own if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return rows


def test_labels_are_looked_up_once_for_a_posting(spark):
    """Not for each step of long lists, and in proportion to a group of copies, not to its square."""
    from pageloom.llm import components
    from pageloom.llm.common import Scratch

    made = []
    for size in (150, 300):
        long = spark.range(24).crossJoin(spark.range(size).withColumnRenamed("id", "member")).selectExpr("id AS key", "member AS id", f"{size}L AS n")
        postings = long.unionAll(spark.range(size).selectExpr("100 + id div 2 AS key", "id", "2L AS n"))
        scratch = Scratch(spark, "labels")
        postings, found = scratch.keep(postings), []
        none = lambda members: members.selectExpr("id AS a", "id AS b").limit(0)
        made.append(rows_of_left_joins(spark, lambda: found.extend(components.components(components.linked(postings, lambda pairs: pairs, none, scratch), scratch).collect())))
        assert {tuple(r) for r in found} == {(k, 0) for k in range(size)}
    assert 24 * 300 <= made[1] <= 1.2 * 24 * 300 and made[1] <= 2.2 * made[0]


def test_places_take_every_run(spark):
    """A row for eight places, of lines of any length."""
    rng = random.Random(15)
    lines = [(n, "".join(rng.choices("abcé中🦜", k=n))) for n in range(1, 60)]
    df = spark.createDataFrame(lines, "lid long, line string")
    own = {r.lid: set(r.set) for r in df.where("length(line) >= 5").select("lid", linedup.shingles_of(F.col("line")).alias("set")).collect()}
    for size, ahead in ((linedup.SHINGLE, 0), (linedup.RUN, linedup.RUN - linedup.SHINGLE)):
        found, rows = {}, 0
        for r in linedup.places(df, size, ahead).collect():
            found.setdefault(r.lid, set()).update(r[k] for k in range(2, 2 + linedup.STEP + ahead))
            rows += 1
        assert found == own and rows <= sum((n - size) // 8 + 1 if n >= size else 1 for n, _ in lines)
    least = {r.lid: r.sig for r in linedup.signatures(df).collect()}
    assert set(least) == set(own) and all((sig is None) == (n < linedup.RUN) for n, sig in least.items())


def test_unlike_lines_are_told_apart_without_their_sets(spark):
    """Most lines with a third of their runs in common are not compared; near copies all are."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    pairs = []
    for n in range(400):
        size = (6, 40, 120)[n % 3]
        a = [word() for _ in range(size)]
        few = rng.sample(range(size), max(1, size // 16)) if n < 300 else range(size // 2)
        pairs.append((" ".join(a), " ".join(word() if k in few else w for k, w in enumerate(a))))
    rows = [(2 * n + k, t) for n, p in enumerate(pairs) for k, t in enumerate(p)]
    marks = linedup.marked(spark.createDataFrame(rows, "lid long, line string"))
    x, y = (marks.where(f"lid % 2 = {k}").select(F.expr("lid div 2").alias("n"), F.col("bitmap").alias(c)) for k, c in enumerate("xy"))
    told = {r[0]: r[1] for r in x.join(y, "n").select("n", linedup.may_be_near(lambda c: F.col("x")[c], lambda c: F.col("y")[c])).collect()}
    grams = lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    alike = [len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a, b in pairs]
    assert sum(s >= 0.8 for s in alike) > 150 and all(told[n] for n, s in enumerate(alike) if s >= 0.8)
    far = [told[n] for n, s in enumerate(alike) if n >= 300 and n % 3]
    assert 0.25 < max(alike[300:]) < 0.5 and sum(far) <= 0.2 * len(far)
