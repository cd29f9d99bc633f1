"""The k most similar vectors of every vector, by a forest of random-projection trees.

Vectors of one model are comparable only with each other. Equal vectors are one candidate that stands for its smallest
ids, so a copy in a third of all rows costs no more than one vector. Every vector is indexed in its leaf of every tree.
A query searches all trees through one priority queue ordered by the margin to the splitting planes: the queue is kept
as a beam per level, which gives the same leaves as popping one node at a time, since a node's cost always is the cost
of one of its leaves. The candidates of the visited leaves are reranked by exact cosine similarity.

The trees grow in tiers. The top of a model's trees is fitted on a bounded sample; leaves that then hold too many vectors
are grown further, each on a bounded sample of its own vectors, until none does, so the comparisons per vector don't grow
with the number of vectors. Planes are far smaller than what they part (two bytes a vector), so they travel to the
vectors, in blocks, and a vector keeps one short list of visited leaves. The leaves are reranked in rounds, so that not
all vectors lie in seven shuffled copies at once. What planes can't part is compared in blocks, so no task gets an
unbounded group.

Null, all-zero and non-finite vectors, and those whose length isn't the usual one of their model, take no part;
repeated ids count once (the first by a hash of the vector); equal similarities (to 9 decimals) go to the smaller id. Extra
columns are ignored; an empty table gives no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.runtime import cut, discard, small_or_plain, sweep

#: Vectors of a model, or of a leaf that grows further, to which planes are fitted.
SAMPLE = 16_384
TREES, VISITED, LEAF, SAMPLE_LEAF = 4, 7, 640, 8
#: Leaves of more own vectors than this grow further, in at most so many tiers (of eleven levels each at this sample).
GROWS, TIERS = 8 * LEAF, 6
#: Vectors that meet planes at once, and bytes of planes sent to all tasks at once.
ROUTED, SENT_PLANES = 2048, 64 << 20
#: Random directions tried per node, the points of a node they are tried on, and how central the plane must be.
DIRECTIONS, TRIED, CENTRE = 24, 1500, (0.35, 0.65)
#: Rows of a leaf per block.
BLOCK = 4096
#: Bytes of vectors shuffled in a round of reranking, and most rounds (each reads all vectors once).
ROUND, ROUNDS = 2 << 30, 16


class Tree:
    """A complete binary tree of splitting planes in heap order.

    Of several random projections of a node, the one with the emptiest stretch near its middle is taken, and the plane is
    laid there: few vectors are then parted from their neighbours.
    """

    def __init__(self, points: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        self.normals = np.zeros((2**depth - 1, points.shape[1]), dtype=np.float32)
        self.offsets = np.zeros(2**depth - 1, dtype=np.float32)
        groups = [np.arange(len(points))]
        for level in range(depth):
            after = []
            for k, rows in enumerate(groups):
                normal, offset = self._plane(points[rows], rng)
                self.normals[2**level - 1 + k], self.offsets[2**level - 1 + k] = normal, offset
                side = points[rows] @ normal
                after += [rows[side < offset], rows[side >= offset]]
            groups = after

    @staticmethod
    def _plane(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        dim = points.shape[1]
        if len(points) < 4:
            v = rng.standard_normal(dim)
            return v / np.linalg.norm(v), 0.0
        tried = points if len(points) <= TRIED else points[rng.choice(len(points), TRIED, replace=False)]
        ends = rng.integers(0, len(tried), (DIRECTIONS, 2))
        directions = tried[ends[:, 0]] - tried[ends[:, 1]]
        same = np.abs(directions).max(axis=1) < 1e-6
        directions[same] = rng.standard_normal((int(same.sum()), dim))
        directions = directions / np.linalg.norm(directions, axis=1, keepdims=True)
        along = np.sort(tried @ directions.T, axis=0)
        low = int(len(tried) * CENTRE[0])
        high = max(int(len(tried) * CENTRE[1]), low + 2)
        width = min(max(1, len(tried) // 25), high - low - 1)
        gaps = along[low + width : high] - along[low : high - width]
        i, d = np.unravel_index(np.argmax(gaps), gaps.shape)
        return directions[d], float(along[low + i, d] + along[low + i + width, d]) / 2


def depth_of(n: int, sample: int, leaf: int) -> int:
    """Levels that part n vectors into leaves, as far as a sample can say."""
    depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
    return min(depth, int(math.log2(max(1, sample / SAMPLE_LEAF))))


def fit_forest(points: np.ndarray, n: int, seed: int = 17) -> list[Tree]:
    """Trees for n vectors, fitted on a sample of them."""
    return [Tree(points, depth_of(n, len(points), LEAF), np.random.default_rng(seed + t)) for t in range(TREES)]


def visited_leaves(forest: list[Tree], x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tree, leaf, cost) per vector: the best leaves over all trees by one queue, the own ones first at no cost; ``start``: cost so far."""
    depth, n = forest[0].depth, len(x)
    normals = np.stack([t.normals for t in forest])
    offsets = np.stack([t.offsets for t in forest])
    tree = np.tile(np.arange(len(forest)), (n, 1))
    node = np.zeros((n, len(forest)), dtype=np.int64)
    cost = np.zeros((n, len(forest)), dtype=np.float32) + (0 if start is None else start[:, None])
    for level in range(depth):
        at = 2**level - 1 + node
        margin = np.einsum("nvd,nd->nv", normals[tree, at], x, optimize=True) - offsets[tree, at]
        right = margin >= 0
        near, far = node * 2 + right, node * 2 + ~right
        node = np.concatenate([near, far], axis=1)
        tree = np.concatenate([tree, tree], axis=1)
        cost = np.concatenate([cost, np.maximum(cost, np.maximum(np.abs(margin), np.float32(1e-12)))], axis=1)
        if node.shape[1] > VISITED:
            keep = np.argsort(cost, axis=1, kind="stable")[:, :VISITED]
            node, tree, cost = (np.take_along_axis(a, keep, axis=1) for a in (node, tree, cost))
    return tree, node, cost


def grown_visits(x: np.ndarray, tree: np.ndarray, path: np.ndarray, cost: np.ndarray, node: np.ndarray, planes: Planes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tree, path, cost) per vector after the visited nodes have grown; ``node``: their numbers in ``planes``, -1 for those that stay.

    One queue as before: a node's cost is that of its best leaf, so the best nodes and leaves can be kept after each level.
    """
    inside = np.zeros(node.shape, dtype=np.int64)
    for level in range(int(planes.depths.max(initial=0))):
        rows, cols = np.nonzero((node >= 0) & (planes.depths[node] > level))
        at = planes.starts[node[rows, cols]] + 2**level - 1 + inside[rows, cols]
        margin = np.einsum("nd,nd->n", planes.normals[at], x[rows]) - planes.offsets[at]
        right = margin >= 0
        off_path, off_inside, off_cost = path.copy(), inside.copy(), np.full(cost.shape, np.inf, dtype=np.float32)
        off_path[rows, cols], off_inside[rows, cols] = path[rows, cols] * 2 + ~right, inside[rows, cols] * 2 + ~right
        off_cost[rows, cols] = np.maximum(cost[rows, cols], np.maximum(np.abs(margin), np.float32(1e-12)))
        path[rows, cols], inside[rows, cols] = path[rows, cols] * 2 + right, inside[rows, cols] * 2 + right
        cost = np.concatenate([cost, off_cost], axis=1)
        keep = np.argsort(cost, axis=1, kind="stable")[:, :VISITED]
        both = [np.concatenate(p, axis=1) for p in ((tree, tree), (path, off_path), (inside, off_inside), (node, node))]
        tree, path, inside, node, cost = (np.take_along_axis(v, keep, axis=1) for v in (*both, cost))
    return tree, path, cost


class Planes:
    """The planes of many nodes of one model, one after the other, and the numbers of their nodes."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.assign(key=rows["path"] * TREES + rows["tree"]).sort_values("key")
        self.keys, self.depths = rows["key"].to_numpy(), rows["depth"].to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(2**self.depths - 1)[:-1]]).astype(np.int64)
        self.offsets = np.frombuffer(b"".join(rows["offsets"]), dtype=np.float32)
        self.normals = np.frombuffer(b"".join(rows["normals"]), dtype=np.float32).reshape(len(self.offsets), -1)

    def numbers(self, tree: np.ndarray, path: np.ndarray) -> np.ndarray:
        """The number of each visited node here, -1 where it isn't."""
        keys = path * TREES + tree
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, model, v, h1, h2``: the unit vectors (32-bit numbers as bytes) of the usual length of their model.

    ``h1`` and ``h2`` are 128 bits of hash by which equal vectors of a model are grouped.
    """
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding_model").isNotNull()).select("vec_id", F.col("embedding_model").alias("model"), F.col("embedding").cast("array<float>").alias("e"))
    sizes = rows.groupBy("model", F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.groupBy("model").agg(F.max_by("d", F.struct("n", "d")).alias("d"))
    right = rows.join(small_or_plain(usual), "model").where(F.size("e") == F.col("d")).drop("d")

    def normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, g in pdf.groupby("model"):
                x = np.stack([np.asarray(e, dtype=np.float64) for e in g["e"]])
                n = np.linalg.norm(x, axis=1)
                good = np.isfinite(n) & (n > 0)
                unit = (x[good] / n[good][:, None]).astype(np.float32) + np.float32(0.0)
                yield pd.DataFrame({"vec_id": g["vec_id"].to_numpy()[good], "model": g["model"].to_numpy()[good], "v": [r.tobytes() for r in unit]})

    unit = right.mapInPandas(normalised, "vec_id long, model string, v binary")
    return unit.withColumn("h1", F.xxhash64("model", "v")).withColumn("h2", F.xxhash64(F.lit(1), "v", "model"))


def _stacked(v: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v), dtype=np.float32).reshape(len(v), -1)


def _sampled(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """About ``SAMPLE`` rows of each key by a hash of their id, all where there are fewer: no group is ranked."""
    spread = 1 << 40
    return rows.where(F.pmod(F.xxhash64("id", *keys), F.lit(spread)) < F.lit(float(spread) * SAMPLE) / F.col(number))


_PLACED = "model string, id long, v binary, trees array<int>, paths array<long>, costs array<float>"


def _placed_rows(model: str, g: pd.DataFrame, tree: np.ndarray, path: np.ndarray, cost: np.ndarray) -> pd.DataFrame:
    order = np.argsort(cost, axis=1, kind="stable")
    tree, path, cost = (np.take_along_axis(a, order, axis=1) for a in (tree, path, cost))
    return pd.DataFrame({"model": model, "id": g["id"].to_numpy(), "v": g["v"].to_numpy(), "trees": list(tree.astype(np.int32)), "paths": list(path), "costs": list(cost)})


def _planted(distinct: DataFrame) -> DataFrame:
    """``model, id, v, trees, paths, costs``: the leaves that each vector visits in the top of its model's trees, the best first."""
    spark = distinct.sparkSession
    rows = distinct.select("model", F.col("rep").alias("id"), "v")
    counts = {r["model"]: r for r in rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("v")).alias("size")).collect()}
    blocks: list[list[str]] = [[]]
    held = 0
    for m in sorted(counts):
        size = TREES * counts[m]["size"] << depth_of(counts[m]["n"], SAMPLE, LEAF)
        if blocks[-1] and held + size > SENT_PLANES:
            blocks.append([])
            held = 0
        blocks[-1].append(m)
        held += size
    placed, routed = [], ROUTED
    for models in blocks:
        mine = rows.where(F.col("model").isin(models))
        numbers = F.create_map(*[F.lit(x) for m in models for x in (m, counts[m]["n"])]) if models else None
        sample = _sampled(mine.withColumn("n", numbers[F.col("model")]), ["model"], "n").toPandas().sort_values("id") if models else pd.DataFrame({"model": []})
        forests = spark.sparkContext.broadcast({m: fit_forest(_stacked(g["v"]).astype(np.float64), counts[m]["n"]) for m, g in sample.groupby("model")})

        def place(batches: Iterator[pd.DataFrame], forests=forests) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), routed):
                    for model, g in pdf.iloc[start : start + routed].groupby("model"):
                        if model in forests.value:
                            forest = forests.value[model]
                            tree, leaf, cost = visited_leaves(forest, _stacked(g["v"]))
                            yield _placed_rows(model, g, tree, leaf + 2 ** forest[0].depth, cost)

        placed.append(mine.mapInPandas(place, _PLACED))
    return reduce(DataFrame.unionByName, placed)


_NODE = ["model", "tree", "path"]


def _each(placed: DataFrame) -> DataFrame:
    """``model, tree, path, cost, id, v``: a row for each visited leaf."""
    return placed.select("model", "id", "v", F.explode(F.arrays_zip("trees", "paths", "costs")).alias("b")).select("model", F.col("b.trees").alias("tree"), F.col("b.paths").alias("path"), F.col("b.costs").alias("cost"), "id", "v")


def _fitted(placed: DataFrame, growing: DataFrame) -> DataFrame:
    """``model, tree, path, depth, normals, offsets``: the planes of the leaves that grow, tree by tree."""
    leaf = LEAF

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = _stacked(pdf.sort_values("id")["v"]).astype(np.float64)
        model, tree, path = key
        grown = Tree(points, max(1, depth_of(int(pdf["n_own"].iloc[0]), len(points), leaf)), np.random.default_rng([tree, path % 2**31]))
        return pd.DataFrame({"model": [model], "tree": [tree], "path": [path], "depth": [grown.depth], "normals": [grown.normals.tobytes()], "offsets": [grown.offsets.tobytes()]})

    planes = []
    for tree in range(TREES):
        own = _each(placed).where((F.col("cost") == 0) & (F.col("tree") == tree)).join(small_or_plain(growing.where(F.col("tree") == tree)), _NODE)
        planes.append(cut(_sampled(own, _NODE, "n_own").groupBy(*_NODE).applyInPandas(fit, "model string, tree int, path long, depth int, normals binary, offsets binary")))
        sweep(placed.sparkSession)
    return reduce(DataFrame.unionByName, planes)


def _grown(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """The visits after the leaves with too many own vectors have grown a tier further; the planes go to the vectors."""
    spark, routed = placed.sparkSession, ROUTED
    planes = _fitted(placed, sizes.where(F.col("n_own") > GROWS).select(*_NODE, "n_own"))
    held = planes.agg(F.sum(F.length("normals") + F.length("offsets"))).first()[0] or 0
    blocks = max(1, math.ceil(held / SENT_PLANES))
    for block in range(blocks):
        # A new leaf isn't among those that grow in this tier, so no later block grows it again.
        rows = planes.where(F.pmod(F.xxhash64(*_NODE), F.lit(blocks)) == block).toPandas()
        sent = spark.sparkContext.broadcast({m: Planes(g) for m, g in rows.groupby("model")})

        def route(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), routed):
                    for model, g in pdf.iloc[start : start + routed].groupby("model"):
                        if model in sent.value:
                            known = sent.value[model]
                            tree, path, cost = (np.stack(g[c].to_numpy()) for c in ("trees", "paths", "costs"))
                            tree, path, cost = grown_visits(_stacked(g["v"]), tree, path, cost, known.numbers(tree, path), known)
                            yield _placed_rows(model, g, tree, path, cost)
                        else:
                            yield g

        placed = placed.mapInPandas(route, _PLACED)
    return placed


def _sizes(placed: DataFrame) -> DataFrame:
    return _each(placed.withColumn("v", F.lit(None))).groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cost") == 0).alias("n_own"))


def _visits(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row per vector with the leaves that it visits; the sizes of the leaves)."""
    placed = cut(_planted(distinct))
    sizes = cut(_sizes(placed))
    for _ in range(TIERS):
        if sizes.where(F.col("n_own") > GROWS).isEmpty():
            break
        before, placed = placed, cut(_grown(placed, sizes))
        sizes = cut(_sizes(placed))
        discard(before)
        sweep(placed.sparkSession)
    return placed, sizes


def visits(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``model, tree, path, cost, id, v``: the leaves that each vector visits, at no cost its own; the sizes of the leaves)."""
    placed, sizes = _visits(distinct)
    return _each(placed), sizes


def candidates(placed: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """``rep, near``: per distinct vector its k best candidates as (1 - similarity, rep), reranked exactly, in rounds over the leaves."""
    spark = placed.sparkSession
    moved = placed.agg(F.sum(F.size("trees") * (F.length("v") + 64))).first()[0] or 0
    rounds = min(ROUNDS, max(1, math.ceil(moved / ROUND)))
    best = None
    for at in range(rounds):
        mine = lambda df: df.where(F.pmod(F.xxhash64(*_NODE), F.lit(rounds)) == at) if rounds > 1 else df
        found = _reranked(mine(_each(placed)), mine(sizes), k)
        every = best.unionByName(found) if best is not None else found
        merged = every.groupBy("rep").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
        if rounds == 1:
            return merged
        before, best = best, cut(merged)
        if before is not None:
            discard(before)
        del found, every, merged
        sweep(spark)
    return best


def _reranked(placed: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """``rep, near``: the best candidates of each vector in each of the leaves (and blocks of them) that it visits."""
    # Leaves beyond a block (those that planes can't part) are compared block by block.
    sizes = sizes.select(*_NODE, F.ceil(F.col("n") / BLOCK).cast("int").alias("q_blocks"), F.ceil(F.greatest("n_own", F.lit(1)) / BLOCK).cast("int").alias("c_blocks"))
    sized = placed.withColumn("own", F.col("cost") == 0).join(small_or_plain(sizes), _NODE)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    single = (F.col("q_blocks") == 1) & (F.col("c_blocks") == 1)
    queries = sized.withColumn("qb", mine("q_blocks")).withColumn("cb", F.explode(every("c_blocks"))).withColumn("asks", F.lit(True)).withColumn("held", F.col("own") & single)
    held = sized.where(F.col("own") & ~single).withColumn("cb", mine("c_blocks")).withColumn("qb", F.explode(every("q_blocks"))).withColumn("asks", F.lit(False)).withColumn("held", F.lit(True))
    columns = [*_NODE, "qb", "cb", "asks", "held", "id", "v"]

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = np.frombuffer(b"".join(pdf["v"]), dtype=np.float32).reshape(len(pdf), -1)
        ids = pdf["id"].to_numpy()
        asks, kept = np.flatnonzero(pdf["asks"].to_numpy()), np.flatnonzero(pdf["held"].to_numpy())
        out = []
        for start in range(0, len(asks) if len(kept) else 0, 1024):
            rows = asks[start : start + 1024]
            sim = x[rows] @ x[kept].T
            sim[ids[rows][:, None] == ids[kept][None, :]] = -2.0
            take = min(k, sim.shape[1])
            top = np.argpartition(-sim, take - 1, axis=1)[:, :take]
            exact = np.einsum("nd,nkd->nk", x[rows].astype(np.float64), x[kept][top].astype(np.float64))
            other = ids[kept][top]
            own = other == ids[rows][:, None]
            out.append(pd.DataFrame({"rep": ids[rows], "near": [[(f, c) for f, c, o in zip(*r) if not o] for r in zip(np.round(1 - exact, 9).tolist(), other.tolist(), own.tolist())]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "near": []})

    return queries.select(columns).unionByName(held.select(columns)).groupBy(*_NODE, "qb", "cb").applyInPandas(rerank, "rep long, near array<struct<far:double,rep:long>>")


def nearest(vectors: DataFrame, k: int = 5) -> DataFrame:
    """``vec_id, neighbour, sim, rank``: the k most similar others of every usable vector."""
    unit = usable(vectors)
    # Ids are compared by the hashes of their vectors; the vectors themselves are sent once.
    rows = cut(unit.groupBy("vec_id").agg(F.min(F.struct("model", "h1", "h2")).alias("r")).select("vec_id", "r.h1", "r.h2"))
    # Copies: the smallest id stands for all; k + 1 ids are enough for anyone's neighbours.
    by_copy = Window.partitionBy("h1", "h2").orderBy("vec_id")
    members = rows.withColumn("copy", F.row_number().over(by_copy)).where(F.col("copy") <= k + 1)
    groups = members.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    each = unit.groupBy("h1", "h2").agg(F.first("model").alias("model"), F.first("v").alias("v"))
    distinct = cut(groups.join(each, ["h1", "h2"]))
    # The vectors go on with their leaves; of the groups only the ids stay.
    kept = cut(distinct.select("h1", "h2", "rep", "ids"))
    placed, sizes = _visits(distinct)
    discard(distinct)
    del groups, members, each, distinct
    sweep(vectors.sparkSession)
    found = candidates(placed, sizes, k)
    reps = kept.select("rep", "ids")
    # What a distinct vector has around it: its own copies first, then the copies of its neighbours.
    listed = found.select("rep", F.explode("near").alias("s")).select("rep", F.col("s.far").alias("far"), F.col("s.rep").alias("c"))
    around = listed.join(reps.withColumnRenamed("rep", "c"), "c").select("rep", F.transform("ids", lambda i: F.struct(F.col("far").alias("far"), i.alias("id"))).alias("near"))
    own = reps.where(F.size("ids") > 1).select("rep", F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("far"), i.alias("id"))).alias("near"))
    lists = around.unionByName(own).groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    # Every copy gets its distinct vector's list without itself.
    owners = rows.select("vec_id", "h1", "h2").join(kept.select("h1", "h2", "rep"), ["h1", "h2"]).select("vec_id", "rep")
    mine = owners.join(lists, "rep").select("vec_id", F.slice(F.filter("near", lambda s: s["id"] != F.col("vec_id")), 1, k).alias("near"))
    return mine.select("vec_id", F.posexplode("near").alias("at", "s")).select("vec_id", F.col("s.id").alias("neighbour"), (1 - F.col("s.far")).alias("sim"), (F.col("at") + 1).alias("rank"))


def neighbour_pairs(vectors: DataFrame, k: int = 5) -> DataFrame:
    """``vec_lo, vec_hi``: each unordered pair of which one is among the k nearest of the other."""
    near = nearest(vectors, k)
    return near.select(F.least("vec_id", "neighbour").alias("vec_lo"), F.greatest("vec_id", "neighbour").alias("vec_hi")).distinct()


def neighbour_chunks(vectors: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """The neighbour lists joined to the chunk ids of both ends; null where a chunk is missing."""
    ids = chunks.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("chunk_id").alias("chunk_id"))
    near = nearest(vectors, k)
    one = near.join(ids, "vec_id", "left")
    return one.join(ids.select(F.col("vec_id").alias("neighbour"), F.col("chunk_id").alias("neighbour_chunk_id")), "neighbour", "left").select("vec_id", "chunk_id", "neighbour", "neighbour_chunk_id", F.round("sim", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))
