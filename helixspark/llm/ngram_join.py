"""N-gram Jaccard join: grouped prefix join over word shingles, with components of near copies.

Documents with one shingle set are one node. A node's prefix are the shingles that come first in a global order, rarest first;
two sets that are similar enough share a shingle of their prefixes. Nodes with identical prefixes and sizes form a group;
groups are paired through their prefixes, filtered by size and place, expanded to members, and members verified on whole sets.

The order needs document frequencies. Those of all shingles would cost a shuffle of the whole text, so the order puts a fixed
share of the shingles (by hash) first, by frequency, and the others after them, by hash. A node whose own share has enough
shingles that no other set has is done: its prefix meets nobody.

Only components are asked for, so no pair within a known component is formed. In a few rounds each bucket's members meet a
few members drawn as hubs; then, in buckets that still hold several components, those outside the largest meet the others: first
each the likeliest one of every other component, then all that are still apart. A pair is formed in the bucket of its first
common shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark.llm._common import drop_shuffles, id_text, release, shingles, stored, table, text_pieces, tidy

CHUNK, BINS, ROUNDS, HUBS = 500_000, 256, 2, 6
#: Edges up to which components are found on the driver, in one pass, instead of by several shuffles a step.
FEW = 50_000
#: First shingles of a prefix that rows carry, to tell a pair's first common one; rows of a crowded bucket that one task meets.
HEADS, PART = 16, 512
#: A bin's count is a short; its largest value stands for any number from there.
FULL = 32767
#: No set has more in common with another than the smaller counts of all bins add up to.
COMMON = f"aggregate(zip_with({{a}}.bins, {{b}}.bins, (x, y) -> if(least(x, y) = {FULL}, 1000000000000, bigint(least(x, y)))), 0L, (s, x) -> s + x)"
#: Bits of a shingle's hash that prefixes hold. Members are verified on all 64.
TOKEN_BITS = 48


def share_of(percent: int) -> int:
    """One shingle in so many comes first in the order: 2.5 times the share of a set that its prefix is."""
    return max(1, int(100 / (2.5 * max(1, 100 - percent))))


def sets(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, s1, s2, first, rest, bins`` of each row: set size and 128-bit key, the prefix's candidates, counts of hashes by bin."""
    every = share_of(percent)
    names = ["doc_id", "n", "s1", "s2", "first", "rest", "bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_pieces(batch.column(1), CHUNK):
                keys, firsts, rests, bins, counts = [], [], [], [], []
                for found in shingles(texts, size):
                    n = len(found)
                    need = n - (percent * n + 99) // 100 + 1
                    token = (found >> np.uint64(64 - TOKEN_BITS)).astype(np.int64)
                    early = found % np.uint64(every) == 0
                    firsts.append(np.unique(token[early]))
                    rests.append(np.unique(token[~early])[: max(0, need - len(firsts[-1]))] if n else token)
                    bins.append(np.minimum(np.bincount((found % np.uint64(BINS * 61) // np.uint64(61)).astype(np.int64), minlength=BINS), FULL).astype(np.int16))
                    keys.append(np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), "<i8"))
                    counts.append(n)
                s = np.array(keys).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(counts, pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(firsts, pa.list_(pa.int64())), pa.array(rests, pa.list_(pa.int64())), pa.array(bins, pa.list_(pa.int16()))], names)

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run, "ngram_join"), "doc_id bigint, n bigint, s1 bigint, s2 bigint, first array<bigint>, rest array<bigint>, bins array<smallint>")


def whole_sets(docs: DataFrame, size: int, id_col: str, text_col: str, nodes: DataFrame) -> DataFrame:
    """``node, n, grams``: the whole sets of some nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_pieces(batch.column(1), CHUNK):
                found = shingles(texts, size)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(list(map(len, found)), pa.int64()), pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "n", "grams"])

    some = id_text(docs, id_col, text_col).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return some.mapInArrow(tidy(run, "ngram_join"), "node bigint, n bigint, grams array<bigint>").where("n > 0")


def components_of_few(edges: pa.Table) -> pa.Table:
    """``node, component`` of each node of a few edges: roots take the smallest root they meet, until all that meet agree."""
    ends = np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    return pa.table({"node": nodes, "component": nodes[root]})


def components(edges: DataFrame, few: int | None = None) -> DataFrame:
    """``node, component`` (its smallest node) of each node of ``a, b`` edges, by alternating large-star and small-star steps.

    Up to ``few`` edges (``FEW``) go to the driver, which finds the same components.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
    before, now = None, sign(edges)
    if now[0] <= (FEW if few is None else few):
        found = components_of_few(edges.select("a", "b").toArrow())
        release(edges)
        return edges.sparkSession.createDataFrame(found, "node bigint, component bigint")
    while now != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = stored(small.where("a <> b").distinct(), "edges")
        release(edges)
        edges = new
        now = sign(edges)
    return edges.union(edges.select("b", "b").distinct()).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def smaller_first(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``a, b, la, lb`` of pairs of groups, turned so that ``a`` has no more members; ``la`` and ``lb`` are their main components.

    A group of many members meets many single nodes. Expanded first, it would make rows of its size for each of them.
    """
    side = lambda x: groups.select(F.col("lead").alias(x), F.col("main").alias(f"l{x}"), F.col("size").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.selectExpr("if(na <= nb, a, b) as a", "if(na <= nb, b, a) as b", "if(na <= nb, la, lb) as la", "if(na <= nb, lb, la) as lb")


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, links`` of each row.

    Words are runs without white space, A-Z as a-z. Sets are linked when 100 * common >= percent * united. ``component_id`` is
    the smallest id reachable by links, ``links`` whether another set is linked. Rows with an empty set have their own id; rows
    with a null id take no part and have none. Rows that repeat an id count as one document, in whose component all its sets are.
    A text of any length counts whole; an empty table gives an empty result.
    """
    every = stored(sets(docs, size, percent, id_col, text_col), "sets")
    taking = every.where("n > 0 and doc_id is not null")
    nodes = stored(taking.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"), F.first("first").alias("first"), F.first("rest").alias("rest"), F.first("bins").alias("bins")), "nodes")
    need = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    keys, wide = stored(every.select("doc_id", "n", "s1", "s2"), "keys"), nodes
    release(every)
    drop_shuffles()

    # Prefixes. Only shingles that several sets have can meet; the others are counted.
    tokens = nodes.select("node", F.explode("first").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    meets = tokens.join(often, "token")
    sized = nodes.select("node", "n", F.size("first").cast("long").alias("early"), need.alias("need"))
    own = Window.partitionBy("node")
    ranked = meets.join(sized, "node").withColumns({"nth": F.row_number().over(own.orderBy("df", "token")), "alone": F.col("early") - F.count("*").over(own)})
    head = ranked.select("node", "n", "token", (F.col("nth") + F.col("alone")).alias("place"), "alone", "need").where("place <= need")
    tail = nodes.where(F.size("rest") > 0).select("node", "n", F.posexplode("rest").alias("k", "token"), F.size("first").cast("long").alias("early"), need.alias("need"))
    # All of a tail's shingles come after its early ones; whether those meet anybody, the head says.
    tail = tail.select("node", "n", "token", (F.col("early") + F.col("k") + 1).alias("place"), F.lit(None).cast("long").alias("alone"), "need")
    heads = stored(head.union(tail), "prefix")
    nodes = stored(wide.select("s1", "s2", "n", "node", F.size("first").cast("long").alias("early"), "bins"), "nodes")
    release(wide)
    sized = nodes.select("node", "n", "early", need.alias("need"))
    shared = heads.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    prefix = stored(heads.join(shared, "token", "left_semi"), "prefix")
    release(heads)
    drop_shuffles()

    # Groups: nodes whose whole prefixes meet somebody and agree, of one size. Others stand alone.
    whole = prefix.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("p"), F.first("need").alias("need"))
    same = whole.where(F.size("p") == F.col("need")).select("node", "n", F.xxhash64("p.token", "n").alias("g1"), F.hash("p.token").alias("g2"))
    leads = same.groupBy("g1", "g2", "n").agg(F.min("node").alias("lead"), F.count("*").alias("k")).where("k > 1")
    grouped = stored(same.join(leads, ["g1", "g2", "n"]).select("node", "lead"), "groups")
    bins = nodes.select("node", "bins")
    led = prefix.join(grouped.where("node <> lead").select("node"), "node", "left_anti").select("token", "node", "n", "place")
    inside = grouped.join(sized, "node").select(F.col("lead").alias("token"), "node", "n", F.lit(0).cast("long").alias("place"))
    # A bucket is a shingle of the leads' prefixes, or a group (place 0) with all its members.
    active = stored(prefix.select("node").distinct(), "active")
    # A lead's bins are the greatest of its members', so that they bound what any member has in common with others.
    outer = grouped.join(bins, "node").select("lead", F.posexplode("bins").alias("bin", "n")).groupBy("lead", "bin").agg(F.max("n").alias("n"))
    outer = outer.groupBy("lead").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("b")).select(F.col("lead").alias("node"), F.col("b.n").alias("outer"))
    led = led.join(bins, "node").join(outer, "node", "left").withColumn("bins", F.coalesce("outer", "bins")).drop("outer")
    led = led.select("node", "token", "n", "place", F.lit(False).alias("kind"), "bins")
    inside = inside.join(bins, "node").select("node", "token", "n", "place", F.lit(True).alias("kind"), "bins")
    buckets = stored(led.union(inside), "buckets")
    grams = stored(whole_sets(docs, size, id_col, text_col, active), "grams")
    release(prefix)
    drop_shuffles()

    def similar(a: str, b: str) -> F.Column:
        """What pairs must fulfil to be worth verifying; it never rules out similar ones (at the first common shingle)."""
        return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {100 + percent} * (1 + least({a}.n - {a}.place, {b}.n - {b}.place)) >= {percent} * ({a}.n + {b}.n) and {100 + percent} * {COMMON.format(a=a, b=b)} >= {percent} * ({a}.n + {b}.n)")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of ``a, b`` whose whole sets are similar enough."""
        left = pairs.join(grams.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga")), "a")
        both = left.join(grams.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb")), "b")
        return both.where(F.lit(100 + percent) * F.size(F.array_intersect("ga", "gb")) >= F.lit(percent) * (F.col("na") + F.col("nb"))).select("a", "b")

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    labels = docs.sparkSession.createDataFrame([], "node bigint, component bigint")

    def joined(pairs: DataFrame) -> None:
        """Link those of ``a, b`` that are similar. Earlier links are not looked at again: only components that meet are joined."""
        nonlocal labels
        new = stored(verified(pairs), "links")
        ends = new.withColumn("node", F.explode(F.array("a", "b")))
        ends = stored(labelled(ends, labels), "ends")
        met = ends.groupBy("a", "b").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select(F.col("l1").alias("a"), F.col("l2").alias("b"))
        if not met.isEmpty():
            found = components(met).select(F.col("node").alias("label"), "component")
            linked = labels.select("node", F.col("component").alias("label")).union(ends.select("node", "label")).distinct()
            old, labels = labels, stored(linked.join(found, "label", "left").select("node", F.coalesce("component", "label").alias("component")), "labels")
            release(old)
        release(new, ends)

    common = F.expr(f"{COMMON.format(a='x', b='y')} / (x.n + y.n)")
    for k in range(ROUNDS):
        rows = labelled(buckets, labels)
        # Each bucket draws a few hubs of its own, and each member keeps the hub that may have most in common with it.
        drawn = F.min_by(F.struct("node", "n", "place", "bins", "label"), F.xxhash64("node", "token", F.lit(k)))
        hubs = rows.groupBy("token", "kind", F.pmod(F.xxhash64("node", F.lit(-1 - k)), F.lit(HUBS)).alias("nth")).agg(drawn.alias("h")).select("token", "kind", "h.*")
        x, y = rows.alias("x"), hubs.alias("y")
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.kind") == F.col("y.kind")) & (F.col("x.label") != F.col("y.label")) & similar("x", "y"))
        joined(met.groupBy(F.col("x.node").alias("a")).agg(F.max_by("y.node", F.struct(common, F.col("y.node"))).alias("b")))
        drop_shuffles()

    # The rest: buckets with several components. A lead stands for its group, whose members may lie in several.
    heads = buckets.where("not kind").groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "token"))), 1, HEADS).alias("h"))
    heads = stored(heads.select("node", F.col("h.token").alias("heads")), "heads")
    spread_over = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def remaining() -> DataFrame:
        """Rows of the buckets where somebody is still apart, with each bucket's largest component; dealt by node, so that no task has a crowded bucket alone."""
        rows = labelled(buckets, labels)
        split = rows.groupBy("token", "kind").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("token", "kind")
        torn = labelled(grouped, labels).groupBy("lead").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select(F.col("lead").alias("node"))
        split = split.union(rows.where("not kind").join(torn, "node", "left_semi").select("token", "kind")).distinct()
        rows = rows.join(split, ["token", "kind"], "left_semi").join(torn.withColumn("torn", F.lit(True)), "node", "left").withColumn("torn", F.coalesce("torn", F.lit(False)))
        most = rows.groupBy("token", "kind", "label").agg(F.count("*").alias("k")).groupBy("token", "kind").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.expr(f"int(1 + sum(k) div {PART})").alias("parts"))
        return stored(rows.join(most, ["token", "kind"]).join(heads, "node", "left").repartition(spread_over, "node"), "rest")

    def meeting(rows: DataFrame, apart: str) -> DataFrame:
        """Pairs ``x, y`` of a bucket that fulfil ``apart``, one of them outside its largest component, each once and worth verifying.

        Where the heads have a common shingle, the first of it is the pair's first of all, and its bucket forms the pair.
        """
        x = rows.where("label <> most or torn").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("x")
        y = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).alias("y")
        bucket = (F.col("x.token") == F.col("y.token")) & (F.col("x.kind") == F.col("y.kind")) & (F.col("x.part") == F.col("y.part"))
        once = F.expr("(not (y.label <> y.most or y.torn) or x.node < y.node) and x.node <> y.node")
        first = F.expr("x.kind or coalesce(get(array_intersect(x.heads, y.heads), 0), x.token) = x.token")
        return x.join(y, bucket & once & F.expr(apart) & first & similar("x", "y"))

    rows = remaining()
    likely = meeting(rows, "x.label <> y.label").groupBy(F.col("x.node").alias("a"), F.col("y.label").alias("label"))
    joined(likely.agg(F.max_by("y.node", F.struct(common, F.col("y.node"))).alias("b")).select("a", "b").distinct())
    release(rows)
    drop_shuffles()
    rows = remaining()
    met = meeting(rows, "x.label <> y.label or x.torn or y.torn")
    met = stored(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.kind").alias("kind")).distinct(), "met")
    # Group pairs are expanded to members. Within a component nothing is sought: a group's members outside its largest one meet
    # all of the other group, those inside only groups whose largest one is another. So the small side is expanded first, and the
    # large one only by the join that filters.
    facts = labelled(sized.select("node", "n").join(bins, "node").join(active, "node", "left_semi"), labels)
    members = facts.join(grouped, "node", "left").withColumn("lead", F.coalesce("lead", "node"))
    main = members.groupBy("lead", "label").agg(F.count("*").alias("k")).groupBy("lead").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("size"))
    main = stored(main, "main")
    members = stored(members.join(main, "lead").select("lead", (F.col("label") != F.col("main")).alias("apart"), F.struct("node", "n", F.lit(0).cast("long").alias("place"), "bins", "label").alias("m")), "members")
    ends = met.where("not kind").select("a", "b")
    both = lambda df: smaller_first(df, main.select("lead", "main", "size")).where("la <> lb").select("a", "b")

    def expanded(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
        x = pairs.join(first.select(F.col("lead").alias("a"), F.col("m").alias("x")), "a")
        y = second.select(F.col("lead").alias("b"), F.col("m").alias("y"))
        return x.join(y, (x["b"] == y["b"]) & F.expr("x.label <> y.label") & similar("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    turned = ends.select(F.col("b").alias("a"), F.col("a").alias("b"))
    outside, inside = members.where("apart"), members.where("not apart")
    spread = expanded(ends, outside, members).union(expanded(turned, outside, inside)).union(expanded(both(ends), inside, inside))
    alone = met.where("kind").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    joined(alone.union(spread).distinct())
    release(rows, heads, buckets, grams, met, main, members, active, grouped)

    known = nodes.select("s1", "s2", "n", "node").join(labels, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("links"))
    out = keys.join(known, ["s1", "s2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce(F.col("links") & F.col("doc_id").isNotNull(), F.lit(False)).alias("links"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op2_ngram_join": op2_ngram_join}
SQL: dict[str, str] = {}
