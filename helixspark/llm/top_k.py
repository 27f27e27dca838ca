"""Exact top-k search by inner product with M-trees: paged metric nodes, covering radii, parent distances, best-first search."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark.llm._common import stored, table

#: Vectors of one tree, entries of an inner page and of a leaf, queries that one task takes to a tree. Inner products that may
#: exceed EXACT are summed as Python integers.
TREE, PAGE, LEAF, BLOCK, EXACT = 8192, 64, 256, 4096, 2.0**62


class Tree:
    """Pages of an M-tree over unit-free vectors; page 0 is the root.

    Inner products become distances by one more component, sqrt(bound - |x|^2), that gives all vectors one length; a query
    has 0 there: the nearer, the larger the product. An inner entry holds a routing vector, its covering radius, its distance
    to the page's own routing vector (the parent) and its child page; a leaf entry a vector, its id and parent distance.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: float, page: int = PAGE, leaf: int = LEAF):
        self.pages: list[dict] = []
        self.page, self.leaf = page, leaf
        x = vectors.astype(np.float64)
        x = np.column_stack([x, np.sqrt(np.maximum(bound - (x * x).sum(1), 0))])
        self._build(ids, vectors, x, np.zeros(x.shape[1]), np.random.default_rng(len(ids)))

    def _build(self, ids, vectors, x, parent, rng) -> int:
        number = len(self.pages)
        self.pages.append({})
        if len(ids) <= self.leaf:
            self.pages[number] = {"ids": ids, "vectors": vectors, "apart": np.sqrt(((x - parent) ** 2).sum(1))}
            return number
        centres = x[rng.choice(len(x), min(self.page, -(-len(x) * 2 // self.leaf)), replace=False)]
        for _ in range(2):  # to the nearest centre, then the member nearest to the mean
            group = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
            kept = [np.flatnonzero(group == g) for g in range(len(centres)) if (group == g).any()]
            centres = np.stack([x[m[((x[m] - x[m].mean(0)) ** 2).sum(1).argmin()]] for m in kept])
        group = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        kept = [m for g in range(len(centres)) if len(m := np.flatnonzero(group == g))]
        if len(kept) == 1:  # nothing parts them: cut in the order given
            kept = np.array_split(np.arange(len(x)), min(self.page, -(-len(x) // self.leaf)))
        routes = np.stack([x[m[((x[m] - x[m].mean(0)) ** 2).sum(1).argmin()]] for m in kept])
        children = [self._build(ids[m], vectors[m], x[m], r, rng) for m, r in zip(kept, routes, strict=True)]
        radii = np.array([np.sqrt(((x[m] - r) ** 2).sum(1)).max() for m, r in zip(kept, routes, strict=True)])
        self.pages[number] = {"routes": routes, "radii": radii, "children": children, "apart": np.sqrt(((routes - parent) ** 2).sum(1))}
        return number


def search(pages: list[dict], query: np.ndarray, own: int, k: int, bound: float) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, -id) of a tree for a query, and how many distances were computed.

    Pages are visited by the least distance that they may hold; |d(q, parent) - d(parent, entry)| rules entries out before
    their own distance is computed. Bounds give way by a rounding margin, so that equal scores are always compared exactly.
    """
    q = np.append(query.astype(np.float64), 0.0)
    length = float(query @ query) + bound
    slack = 1e-7 * (1 + np.sqrt(length))
    best: list[tuple[int, int]] = []
    reach, computed, n = np.inf, 0, 0
    heap = [(0.0, 0, 0, float(np.sqrt((q * q).sum())))]
    while heap:
        least, _, number, to_parent = heapq.heappop(heap)
        if least > reach + slack:
            break
        page = pages[number]
        gap = np.abs(to_parent - page["apart"])
        if "children" in page:
            near = np.flatnonzero(gap - page["radii"] <= reach + slack)
            to = np.sqrt(((page["routes"][near] - q) ** 2).sum(1))
            computed += len(near)
            floor = np.maximum(to - page["radii"][near], 0)
            for i, d, f in zip(near.tolist(), to.tolist(), floor.tolist(), strict=True):
                if f <= reach + slack:
                    n += 1
                    heapq.heappush(heap, (f, n, page["children"][i], d))
            continue
        near = np.flatnonzero((gap <= reach + slack) & (page["ids"] != own))
        computed += len(near)
        scores = page["vectors"][near] @ query
        for pair in zip(scores.tolist(), (-page["ids"][near]).tolist(), strict=True):
            if len(best) < k:
                heapq.heappush(best, pair)
            elif pair > best[0]:
                heapq.heapreplace(best, pair)
        if len(best) == k:
            reach = np.sqrt(max(length - 2 * best[0][0], 0))
    return best, computed


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` with integer components floor(256 * x); rows with a null id or vector, or a null or non-finite component, go."""
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(finite).select("vec_id", F.transform("v", lambda x: F.floor(F.lit(256.0) * x)).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tree: int = TREE) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products, ties to the smaller id.

    A row with the query's own id is no candidate; vectors of another length are none either. Repeated rows count once. With
    fewer than k candidates all are given; empty tables give none. Components of any size count exactly; only a score that no
    long can hold is an error. A row whose id stands for several vectors is a candidate, and a query, with each of them: its best
    score counts.

    Equal vectors are collapsed to their k + 1 smallest ids, so a common vector costs no more than others. The table is dealt
    by a hash of the vector to trees of bounded size, and blocks of queries meet each tree in a task of their own.
    """
    spark = vectors.sparkSession
    ids = usable(vectors, id_col, vector_col).distinct()
    ranked = ids.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    entries = stored(ranked, "vectors")
    asked = stored(usable(queries, id_col, vector_col).distinct(), "queries")
    norm = F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x)
    widest = lambda df: df.agg(F.count("*").alias("n"), F.max(norm).alias("bound")).first()
    have, want = widest(entries), widest(asked)
    bound = float(have.bound or 0)
    large = max(bound, float(want.bound or 0)) >= EXACT
    trees, blocks = max(1, -(-have.n // tree)), max(1, -(-want.n // BLOCK))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = Tree(pdf.vec_id.to_numpy(), np.stack(pdf.v.to_numpy()).reshape(len(pdf), -1).astype(np.int64), bound)
        return pd.DataFrame({"tree": pdf.tree.iloc[0], "width": pdf.width.iloc[0], "page": range(len(made.pages)), "body": [pickle.dumps(p, 5) for p in made.pages]})

    pages = entries.select("vec_id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("v"), F.lit(trees)).cast("int").alias("tree")).groupBy("width", "tree").applyInPandas(build, "tree int, width int, page int, body binary")
    pages = stored(pages, "pages")

    def look(p: pd.DataFrame, q: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        out = []
        if len(p):
            made = [pickle.loads(x) for x in p.sort_values("page").body]
            for own, v in zip(q.vec_id.tolist(), q.v, strict=True):
                out += [(own, -i, s) for s, i in search(made, np.asarray(v, np.int64).reshape(-1).astype(object if large else np.int64), own, k, bound)[0]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    left = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("width", "tree", "block")
    right = asked.select("vec_id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).groupBy("width", "tree", "block")
    found = left.cogroup(right).applyInPandas(look, "query_id bigint, vec_id bigint, score bigint")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES = {"op3_top_k": op3_top_k}
SQL = {
    "op3_top_k": """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as c from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.c, c.c), lambda z: z[1] * z[2]))::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 5
"""
}
