r"""Fuzzy line deduplication by MinHash, with DataFrame and SQL functions only.

Lines are compared trimmed and in lower case; lines that are blank then are no copies
of each other, and stay. Equal lines are one class, whatever their length. Lines of 20
characters or more (a parameter; shorter ones are alike by chance) are near copies too,
if the sets of their runs of 5 characters, at all places, have a Jaccard similarity of
at least 0.8.

A class has a signature of 18 MinHash values, each the least hash of its runs of 9
characters, at all places, under an order of its own. Lines in a natural language share
many runs of 5 characters by chance, but few of 9, so that candidates grow far less with
the square of the lines. The values are the points of two planes over the numbers modulo
3, whose 24 straight lines are the bands, 3 values each. Classes that agree in a band are
candidates, and every candidate is confirmed by the exact similarity of the sets of runs
of 5. Components of confirmed links keep their first line, by document id and line number.

In a simulation, 0.2 % of 4,000 pairs of lines with changed characters were no candidates,
7 of the 398 of similarity 0.8 to 0.83. Lines alike in runs of 5 alone, in another order,
may be lost, unless they repeat their runs (a line of zeros and ones has 32 of them):
such lines, those of more than 4096 characters and those of less than 20
have 25 values of the runs of 5 too, on a plane over the numbers modulo 5 with 30 bands,
one of which finds those of similarity 0.8 with probability over 0.985. Of large groups
of copies, what all links between lines of one list join is joined; none is capped.

A document's lines end at "\n"; null texts have none. Rows with a null id keep all
their lines. Rows that share an id are one document: of equal lines in them, the one
with the smaller number is first, and all rows lose the same line numbers. Equal
64-bit hashes of trimmed lines count as equal lines.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import Scratch, fresh
from pageloom.llm.components import block_pairs, components, linked

LEAST_CHARS = 20
SHINGLE = 5
#: Characters of the runs of the first signature, the values of its bands, a prime, and its planes.
RUN, FIRST_PLANE, PLANES = 9, 3, 2
#: Places of a line that one row of its signature takes.
STEP = 8
#: Lines of more runs of 5 are told by an eighth of these to repeat them.
MANY = 200
#: Values of a band of repetitive lines, a prime; there are PLANE * PLANE values and PLANE * (PLANE + 1) bands.
PLANE = 5
#: Bands that are posted in one pass over the signatures, so that the disk holds the shuffle of a part of them.
AT_ONCE = 12
#: Lines of more runs are posted as if they were repetitive.
LONG_LINE = 4096
SIMILAR = 0.8
#: Lines of a block, of which two are compared at once.
BLOCK = 64

_RANDOM = random.Random(17)
#: An order of the hashes is that of their exclusive or with one of these.
ORDERS = [_RANDOM.getrandbits(64) - (1 << 63) for _ in range(PLANE * PLANE)]


def bands(plane: int, start: int = 0) -> list[list[int]]:
    """The values of each band, from `start` on: the straight lines y = m x + b, and those of equal x."""
    return [[start + x * plane + (m * x + b) % plane for x in range(plane)] for m in range(plane) for b in range(plane)] + [[start + x * plane + y for y in range(plane)] for x in range(plane)]


BANDS = [band for k in range(PLANES) for band in bands(FIRST_PLANE, k * FIRST_PLANE**2)]


def compared(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(" \t\r\v\f")))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no, line, and lid (its hash) of the lines that are compared."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    lines = lines.select("id", "line_no", compared(F.col("line")).alias("line")).where("line <> ''")
    return lines.select("id", "line_no", "line", F.xxhash64("line").alias("lid"))


def places(lines: DataFrame, size: int, ahead: int) -> DataFrame:
    """lid, last, x0, x1, ...: a row for each STEP places of lines (lid, line), with the hashes of the runs of SHINGLE characters there and at `ahead` more places.

    A run is cut out of the line's code points of 4 bytes each, which takes the same time
    at every place. The last row of a line reaches back, and takes some places twice, so
    that runs of `size` end in the line; what lies behind `last`, the place of its last
    run, is that one again.
    """
    codes = lines.select("lid", F.encode("line", "UTF-32").alias("codes"))
    codes = codes.select("lid", "codes", ((F.length("codes") / 4).cast("int") - SHINGLE).alias("last")).where("last >= 0")
    end = F.greatest(F.col("last") - (size - SHINGLE), F.lit(0))
    rows = codes.select("lid", "codes", "last", F.explode(F.sequence(F.lit(0), end, F.lit(STEP))).alias("at"))
    rows = rows.select("lid", "codes", "last", F.greatest(F.least("at", F.col("last") - (size - SHINGLE + STEP - 1)), F.lit(0)).alias("at"))
    return rows.select("lid", "last", *[F.xxhash64(F.substring("codes", F.least(F.col("at") + k, F.col("last")) * 4 + 1, F.lit(4 * SHINGLE))).alias(f"x{k}") for k in range(STEP + ahead)])


def signatures(lines: DataFrame) -> DataFrame:
    """lid, sig, n (runs of 5), repeats: the MinHash values of lines (lid, line).

    The hash of a run of 9 is made of those of the runs of 5 that it begins and ends with.
    The values are 32 bits wide. A bitmap of 64 bits of the runs of 5, or of an eighth of
    them if they are many, tells lines that repeat their runs.
    """
    gap = RUN - SHINGLE
    rows = places(lines, RUN, gap)
    turned = lambda x: F.shiftleft(x, 21).bitwiseOR(F.shiftrightunsigned(x, 43))
    runs = [F.col(f"x{k}").bitwiseXOR(turned(f"x{k + gap}")) for k in range(STEP)]
    # a line of fewer runs of 9 than STEP has the first one again
    runs = [F.when(F.col("last") >= k + gap, x).otherwise(runs[0]).alias(f"h{k}") for k, x in enumerate(runs)]
    some = [F.expr(f"if(x{k} & if(last < {MANY}, 0, 448) = 0, shiftleft(1L, cast(shiftright(x{k}, 9) & 63 AS int)), 0L)") for k in range(STEP)]
    rows = rows.select("lid", "last", *runs, reduce(Column.bitwiseOR, some).alias("some"))
    least = rows.groupBy("lid").agg(*least_hashes(PLANES * FIRST_PLANE**2), F.bit_or("some").alias("some"), (F.max("last") + 1).alias("n"))
    full = lambda n: 64 * (1 - F.exp(-n / 64))  # noqa: E731  the bits that n different runs set, on average
    seen = F.col("n") - gap
    short = (F.col("n") <= MANY) & (F.bit_count("some") < 0.85 * full(seen) - 1)
    repeats = short | (F.col("n") > MANY) & (F.bit_count("some") < 0.6 * full(seen / 8)) | (F.col("n") > LONG_LINE) | (F.col("n") < LEAST_CHARS - SHINGLE + 1)
    return least.select("lid", F.when(F.col("n") > gap, values_of(PLANES * FIRST_PLANE**2)).alias("sig"), "n", repeats.alias("repeats"))


def words_of(name: str, n: int = 4) -> list[str]:
    """The columns of a bitmap of n words of 64 bits."""
    return [f"{name}{k or ''}" for k in range(n)]


def marked(texts: DataFrame) -> DataFrame:
    """lid, bitmap (n, bits to bits3, some to some3): 256 bits set by all runs of 5 of lines (lid, line), and 256 by an eighth of these."""
    rows = places(texts, SHINGLE, 0)

    def word(k: int, mask: int) -> Column:
        bits = [F.expr(f"if(x{i} & {mask} = {k << 6}, shiftleft(1L, cast(x{i} & 63 AS int)), 0L)") for i in range(STEP)]
        return F.bit_or(reduce(Column.bitwiseOR, bits))

    words = [word(k, 3 << 6).alias(c) for k, c in enumerate(words_of("bits"))] + [word(k, 7 << 8 | 3 << 6).alias(c) for k, c in enumerate(words_of("some"))]
    return rows.groupBy("lid").agg((F.max("last") + 1).alias("n"), *words).select("lid", F.struct("n", *words_of("bits"), *words_of("some")).alias("bitmap"))


def repeated_signatures(texts: DataFrame) -> DataFrame:
    """lid, sig: the MinHash values of the runs of SHINGLE characters of lines (lid, line)."""
    rows = places(texts, SHINGLE, 0).select("lid", *[F.col(f"x{k}").alias(f"h{k}") for k in range(STEP)])
    return rows.groupBy("lid").agg(*least_hashes(len(ORDERS))).select("lid", values_of(len(ORDERS)).alias("sig"))


def least_hashes(n: int) -> list[Column]:
    """m0, m1, ...: the least of the hashes h0, h1, ... under n orders."""
    return [F.min(F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(x)) for k in range(STEP)])).alias(f"m{i}") for i, x in enumerate(ORDERS[:n])]


def values_of(n: int) -> Column:
    return F.array(*[F.shiftright(f"m{k}", 16).cast("long").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for k in range(n)])


def posted(sketches: DataFrame, of: list[list[int]], scratch: Scratch) -> DataFrame:
    """key, id, n: each line under those of its bands that other lines have, with the number of lines; some bands at a time.

    One sort counts a list and leaves its members in place; a large one spills, as its task holds a few rows only.
    """
    parts = []
    for start in range(0, len(of), AT_ONCE):
        keys = F.array(*[F.xxhash64(F.lit(len(of)), F.lit(start + k), *[F.get("sig", F.lit(i)) for i in band]) for k, band in enumerate(of[start : start + AT_ONCE])])
        values = sketches.where(F.get("sig", F.lit(0)).isNotNull()).select(F.col("lid").alias("id"), F.explode(keys).alias("key"))
        counted = values.select("key", "id", F.count("*").over(Window.partitionBy("key")).alias("n"))
        parts.append(scratch.keep(counted.where("n > 1"), "postings"))
    return reduce(DataFrame.unionAll, parts)


def shingles_of(line: Column) -> Column:
    """Hashes of the different runs of SHINGLE characters; a line has at least that many."""

    def runs(codes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(codes) - 4 * SHINGLE + 1, F.lit(4))
        return F.array_distinct(F.transform(starts, lambda at: F.xxhash64(F.substring(codes, at, F.lit(4 * SHINGLE)))))

    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), runs), F.lit(0))


def near(x: Column, y: Column, least: float = SIMILAR) -> Column:
    """Whether two sets are similar enough."""
    most = F.least(F.size(x), F.size(y)) >= least * F.greatest(F.size(x), F.size(y)) - 1e-9
    return most & (F.size(F.array_intersect(x, y)) * (1 + least) >= least * (F.size(x) + F.size(y)) - 1e-9)


def of_line(p: Column) -> Callable[[str], Column]:
    return lambda c: p["bitmap"][c]


def may_be_near(x: Callable[[str], Column], y: Callable[[str], Column], n: int = 4) -> Column:
    """False for lines (n, and bits and some of n words) that aren't similar, without their sets.

    Of similar sets, at most 0.25 times the smaller one is in one only, and each such run
    changes a bit at most, if no run of both sets it: as many as chance leaves, with five
    standard deviations above. Lines of more than 512 runs are told by an eighth of them,
    those of more than 16,384 are not told.
    """
    bits = lambda by, name: reduce(Column.__add__, [F.bit_count(by(x(c), y(c))) for c in words_of(name, n)])
    apart = F.least(x("n"), y("n")) * (1 / SIMILAR - 1) + 1e-9

    def told(name: str, share: float) -> Column:
        mean = apart * (64 * n - bits(Column.bitwiseAND, name)) * (share / (64 * n))
        return bits(Column.bitwiseXOR, name) <= F.least(apart, mean + 5 * F.sqrt(mean) + 2)

    most = F.greatest(x("n"), y("n"))
    return F.when(most <= 512, told("bits", 1)).when(most <= 16384, told("some", 1 / 8)).otherwise(True)


def similar(a: Column, b: Column) -> Column:
    """Whether two lines are near copies. The sets are bound to a lambda's variable, so that each is made once."""
    sets = F.array(F.struct(shingles_of(a).alias("x"), shingles_of(b).alias("y")))
    return F.exists(sets, lambda s: near(s["x"], s["y"]))


def block_links(pairs: DataFrame) -> DataFrame:
    """Links (a, b) of two blocks' lines (id, group, keys, bitmap, set) in different groups, one for two groups.

    Two lines that share several lists (keys) are compared in the first of these only.
    """

    words = sum(c.startswith("bits") for c in pairs.schema["docs_x"].dataType.elementType["bitmap"].dataType.names)

    def of(p: Column) -> Column:
        hits = F.filter("docs_y", lambda q: (p["group"] != q["group"]) & may_be_near(of_line(p), of_line(q), words) & (F.array_min(F.array_intersect(p["keys"], q["keys"])) == F.col("key")) & near(p["set"], q["set"]))
        return F.transform(hits, lambda q: F.struct(F.least(p["group"], q["group"]).alias("a"), F.greatest(p["group"], q["group"]).alias("b")))

    # a group is named by one of its lines, which stands for all of them
    return pairs.select(F.explode(F.array_distinct(F.flatten(F.transform("docs_x", of)))).alias("l")).select("l.a", "l.b").distinct()


def groups_of(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, least_chars: int, scratch: Scratch) -> DataFrame:
    """lid, first_id, first_line of every class that has copies or near copies. found: id, line_no, lid."""
    sketches = scratch.keep(signatures(lines_of(docs, id_col, text_col).where(F.length("line") >= least_chars)), "sketches")
    postings = posted(sketches, BANDS, scratch)
    repeated = scratch.keep(sketches.where("repeats").select("lid"), "repeated")
    met = postings.select(F.col("id").alias("lid")).unionAll(repeated).distinct()
    known = scratch.keep(met, "known")
    scratch.drop(sketches)
    owner = F.min(F.struct("id", "line_no")).alias("owner")
    classes = scratch.keep(found.groupBy("lid").agg(owner, F.count("*").alias("n")), "classes")
    texts = scratch.keep(class_texts(docs, classes.join(known, "lid"), id_col, text_col), "texts")
    texts = scratch.keep(texts.join(marked(texts), "lid"), "texts")
    if not repeated.isEmpty():
        own = scratch.keep(repeated_signatures(texts.join(repeated, "lid", "left_semi")), "sketches")
        postings = postings.unionAll(posted(own, bands(PLANE), scratch))

    def verify(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("lid").alias(side), F.col("line").alias(f"line_{side}"), F.col("bitmap").alias(f"bitmap_{side}")), side)
        bitmap = lambda side: lambda c: F.col(f"bitmap_{side}")[c]
        return pairs.where(may_be_near(bitmap("a"), bitmap("b")) & similar(F.col("line_a"), F.col("line_b"))).select("a", "b")

    def compare(members: DataFrame) -> DataFrame:
        wanted = members.groupBy(F.col("id").alias("lid")).agg(F.collect_set("key").alias("keys"))
        # half of each hash, to move less: among the runs of two lines of 250 a wrong match has a probability of 1.5e-5
        half = F.array_distinct(F.transform(shingles_of(F.col("line")), lambda x: F.shiftright(x, 32).cast("int")))
        sets = texts.join(wanted, "lid").select(F.col("lid").alias("id"), "keys", "bitmap", half.alias("set"))
        sets = scratch.keep(sets.withColumn("n", F.size("set")), "sets")
        return block_links(block_pairs(members, sets, BLOCK, SIMILAR, scratch))

    groups = components(linked(postings, verify, compare, scratch), scratch)
    groups = groups.select(F.col("id").alias("lid"), "component")
    named = scratch.keep(classes.join(groups, "lid", "left").where("n > 1 OR component IS NOT NULL").select("lid", "owner", F.coalesce("component", "lid").alias("component")), "named")
    firsts = scratch.keep(named.groupBy("component").agg(F.min("owner").alias("first")), "firsts")
    return scratch.keep(named.join(firsts, "component").select("lid", F.col("first.id").alias("first_id"), F.col("first.line_no").alias("first_line")), "groups")


def class_texts(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """lid, line: the compared text of each class (lid, owner), from its first line's document."""
    wanted = classes.select(F.col("owner.id").alias("id"), F.struct(F.col("owner.line_no").alias("line_no"), "lid").alias("w")).groupBy("id").agg(F.collect_list("w").alias("wanted"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id")
    rows = texts.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w")).select(F.col("w.lid").alias("lid"), compared(F.get("lines", F.col("w.line_no"))).alias("line"))
    return rows.where(F.xxhash64("line") == F.col("lid")).dropDuplicates(["lid"])


def line_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """id, line_no (from 0), first_doc, first_line (of the line's component), kept, for every line that is not blank."""
    scratch = Scratch(docs.sparkSession, "linedup")
    found = scratch.keep(lines_of(docs, id_col, text_col).select("id", "line_no", "lid").distinct(), "lines")
    groups = groups_of(found, docs, id_col, text_col, max(least_chars, SHINGLE), scratch)
    out = found.join(groups, "lid", "left")
    first_id, first_line = F.coalesce("first_id", "id"), F.when(F.col("first_id").isNull(), F.col("line_no")).otherwise(F.col("first_line"))
    out = out.select(F.col("id").alias(id_col), "line_no", first_id.alias("first_doc"), first_line.alias("first_line"), ((first_id == F.col("id")) & (first_line == F.col("line_no"))).alias("kept"))
    return scratch.done(out)


def without(text: Column, gone: Column) -> Column:
    """The text without the lines of sorted numbers: the slices between them, each line taken once."""
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.lit(1 << 30)))
    own = F.array(F.struct(F.split(text, "\n").alias("lines"), ends.alias("ends")))  # bound to a lambda's variable, so that it is split once

    def kept(s: Column) -> Column:
        between = lambda k: F.slice(s["lines"], F.get(s["ends"], k) + 2, F.get(s["ends"], k + 1) - F.get(s["ends"], k) - 1)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["ends"]) - 2), between)), "\n")

    return F.get(F.transform(own, kept), F.lit(0))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """The documents without the lines that copy an earlier one, all columns kept.

    A document that loses all its lines goes, as its first lines stand elsewhere; null,
    empty and blank texts stay as they are.
    """
    groups = line_groups(docs, id_col=id_col, text_col=text_col, least_chars=least_chars)
    gone = fresh("gone", docs.columns)
    lost = groups.where(~F.col("kept")).groupBy(id_col).agg(F.array_sort(F.collect_set("line_no")).alias(gone))
    out = docs.join(lost, id_col, "left").withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col(gone))))
    return out.where(F.col(gone).isNull() | F.col(text_col).rlike(r"\S")).select(docs.columns)
