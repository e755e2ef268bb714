"""Connected components and candidate linking with DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Scratch


#: Edges that one task can take in every step.
SMALL = 1 << 18


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component (the smallest id reachable) for the ids of links (a, b); a link to itself is none.

    Alternating large-star and small-star steps, a distributed union-find: every edge
    runs from a child to a smaller parent, until each child has one parent, which is
    no child. A step's minimum is aggregated before it meets the edges again, as a
    written table, so that a join on a hub can be split. At most SMALL edges are one
    partition, whose steps need no exchange.
    """
    a, b = F.col("a"), F.col("b")
    edges = scratch.keep(links.where(a != b).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct(), "edges")
    few = edges.count() <= SMALL
    edges = edges.coalesce(1) if few else edges
    keep = lambda df, name: scratch.keep(df, name).coalesce(1) if few else scratch.keep(df, name)
    while True:
        least = keep(edges.groupBy("child").agg(F.min("parent").alias("least"), F.count("*").alias("n")), "least")
        over = least.select(F.col("child").alias("parent"), F.col("least").alias("higher"))
        most = least.agg(F.max("n")).first()[0]
        if most is None or most == 1 and edges.join(over, "parent", "left_semi").isEmpty():
            return edges.select(F.col("child").alias("id"), F.col("parent").alias("component")).unionAll(edges.select("parent", "parent").distinct())
        large = edges.join(over, "parent", "left").select("child", F.coalesce("higher", "parent").alias("parent")).distinct()
        root = large.groupBy("child").agg(F.min("parent").alias("root"))
        small = large.join(root, "child").where(F.col("parent") != F.col("root")).select(F.col("parent").alias("child"), F.col("root").alias("parent"))
        new = small.unionAll(root.select("child", "root"))
        new = keep((new.coalesce(1) if few else new).distinct(), "edges")
        scratch.drop(edges, least)
        edges = new


#: Members of a long list that all others of it meet first.
CENTRES = 4
#: That is left out if the blocks of long lists have at most so many pairs for each posting.
PER_POSTING = 4
#: A list of more members is long.
LONG = 32


def linked(postings: DataFrame, verify: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """The verified links (a, b) that connect whatever true links among documents of one posting list connect.

    postings: key, id (different rows), n (the list's members). verify: pairs (a, b) to
    those that are links. compare: members of long lists (key, id, group) to the links
    between different groups of a list, without a row for each pair.

    Short lists give all their pairs: first each id's best one, then those of ids that are
    not in one component by now. In a long list every member first meets the list's
    centres, members chosen by hash: a large group of copies so becomes one component
    with a few pairs a member. What is not in one component after that is compared block
    by block: no link is lost.
    """
    long = scratch.keep(postings.where(F.col("n") > LONG), "long")
    total = long.agg(F.count("*").alias("n"), F.sum("n").alias("pairs")).first()
    pairs = scratch.keep(short_pairs(postings), "pairs")
    best = scratch.keep(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "best")
    links = scratch.keep(verify(best), "links")
    near = scratch.keep(least_neighbours(links), "near")
    label = lambda c: near.select(F.col("id").alias(c), F.col("component").alias(f"group_{c}"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
    group_a, group_b = F.coalesce("group_a", "a"), F.coalesce("group_b", "b")
    rest = scratch.keep(rest.where((group_a != group_b) & (group_b != F.col("a")) & (group_a != F.col("b"))).select("a", "b"), "pairs")
    links = links.unionAll(scratch.keep(verify(rest), "links"))
    scratch.drop(pairs, best, rest)
    if not total["n"]:
        return links
    if total["pairs"] > 2 * PER_POSTING * total["n"]:
        near = scratch.keep(least_neighbours(links), "near")
        links = links.unionAll(scratch.keep(verify(scratch.keep(ordered(centre_pairs(long, near, scratch)), "pairs")), "links"))
    groups = scratch.keep(components(links, scratch), "groups")
    members = scratch.keep(open_lists(scratch.keep(labelled(long, groups), "labelled"), scratch), "members")
    found = scratch.keep(compare(members), "links")
    # what is known of the components stands for the links that made them
    return groups.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")).unionAll(found)


def least_neighbours(links: DataFrame) -> DataFrame:
    """id, component: the least id that each larger one is linked with, which is in its component; in one step."""
    return links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))


def short_pairs(postings: DataFrame) -> DataFrame:
    """a, b, n: pairs of members of short lists with the number of these."""
    short = postings.where(F.col("n") <= LONG).select("key", "id")
    x, y = (short.select("key", F.col("id").alias(c)) for c in "ab")
    return x.join(y, "key").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def labelled(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members (key, id) with group: what is known of their component."""
    return members.select("key", "id").join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("group"))


def open_lists(members: DataFrame, scratch: Scratch) -> DataFrame:
    """The members (key, id, group) of lists that have several groups."""
    keys = scratch.keep(members.groupBy("key").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a < b").select("key"), "open")
    return members.join(keys, "key")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def block_pairs(members: DataFrame, sets: DataFrame, size: int, similar: float, scratch: Scratch) -> DataFrame:
    """key, docs_x, docs_y: pairs of blocks of about `size` members (key, id, group) of one list, with the columns of sets (id, n, ...).

    Large groups have blocks of their own, which do not meet each other, nor are they
    joined to be dropped: the join's keys name both sides. Nor do blocks meet of sets
    whose sizes n are too far apart for a similarity of `similar`.
    """
    sizes = scratch.keep(members.groupBy("key", "group").agg(F.count("*").alias("size")), "sizes")
    small = scratch.keep(sizes.where(F.col("size") <= size).groupBy("key").agg(F.sum("size").alias("rest")), "small")
    large = F.col("size") > size
    owner = F.when(large, F.col("group"))
    slot = F.when(large, F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / size))).otherwise(F.pmod(F.xxhash64("group"), F.ceil(F.col("rest") / size)))
    dealt = members.join(sizes, ["key", "group"]).join(small, "key", "left").select("key", "id", "group", owner.alias("owner"), F.xxhash64(owner, slot).alias("block"))
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similar))).cast("int")
    full = dealt.join(sets, "id").withColumn("level", level).groupBy("key", "block", "owner", "level").agg(F.collect_list(F.struct("id", "group", *(c for c in sets.columns if c not in ("id", "n")))).alias("docs"))
    blocks = scratch.keep(full, "blocks")
    # the sides of a list are its large groups, and its small ones together (owner null); the blocks of the smaller of two sides are dealt to the larger
    sides = sizes.where(large).select("key", F.col("group").alias("owner"), "size").unionAll(small.select("key", F.lit(None).cast(members.schema["group"].dataType), "rest"))
    sides = scratch.keep(sides.select("key", F.struct("size", "owner").alias("side")), "sides")
    p, q = (sides.select("key", F.col("side").alias(c)) for c in "pq")
    meet = scratch.keep(p.join(q, "key").where("p < q OR p.owner IS NULL AND q.owner IS NULL").select("key", F.col("p.owner").alias("owner"), F.col("q.owner").alias("other")), "meet")
    x, y = (blocks.select(*(F.col(c).alias(f"{c}_{side}") for c in ("key", "block", "owner", "level", "docs"))) for side in "xy")
    x = meet.join(x, (F.col("key") == F.col("key_x")) & F.col("owner").eqNullSafe(F.col("owner_x"))).select("key", "other", "owner_x", "block_x", "level_x", "docs_x")
    pairs = x.join(y, (F.col("key") == F.col("key_y")) & F.col("other").eqNullSafe(F.col("owner_y")))
    # each two blocks once; sets of one level may lie two apart by rounding only, at a ratio that is too far in any case
    once = "level_x = level_y AND block_x <= block_y OR level_y = level_x + 1"
    return pairs.where(f"owner_x IS NULL AND owner_y IS NULL AND ({once}) OR NOT (owner_x IS NULL AND owner_y IS NULL) AND abs(level_x - level_y) <= 1").select("key", "docs_x", "docs_y")


def centre_pairs(members: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Each member (x) of lists (key, id) with those centres (y) of its lists that are not in its group, once for all lists that they share.

    Members of a large group of copies share most of their lists and so their centres;
    a member's centres are brought together before they become rows. A group (id,
    component) is looked up once for each centre of a list and each member, not for each
    row of a list.
    """
    nearest = F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(CENTRES)]))
    chosen = members.groupBy("key").agg(nearest.alias("ids")).select("key", F.explode("ids").alias("id"))
    centres = labelled(chosen, groups).groupBy("key").agg(F.collect_list(F.struct("id", "group")).alias("centres"))
    met = members.join(scratch.keep(centres, "centres"), "key").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("centres"))).alias("centres"))
    met = met.join(groups, "id", "left")
    others = F.filter("centres", lambda c: c["group"] != F.coalesce("component", "id"))
    return met.select(F.col("id").alias("x"), F.explode(others["id"]).alias("y"))
