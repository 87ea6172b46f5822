"""Nearest neighbours by largest inner product: a forest of random-projection trees, then exact scores.

The trees are fitted on a bounded sample; every vector is put into its leaf of every tree. A query walks all trees through
one shared priority queue, nearest side of a cut first, until the leaves it has opened hold enough vectors; then all
vectors of those leaves are scored exactly, in blocks of a leaf's vectors times the queries that opened it. How many are
enough is measured: 64 queries are answered exactly over all rows, and the queue is made as long as their true neighbours
ask for at a recall of 0.95. Clustered data need few leaves; directions drawn at random need most of them.

Inner products become distances by one more component that brings all vectors to the largest norm, so the trees need no
unit vectors. Equal vectors are one node with its ``k + 1`` smallest ids: no further one can be among the ``k`` nearest,
so a vector that a third of all rows share is one entry of one leaf. Leaves and their visitors are dealt out in blocks of
bounded size, so no task gets more than a block times a chunk of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.session import materialize

TREES, LEAF, SEED = 4, 1_000, 11
#: the recall the queue's length is chosen for, and the number of queries it is measured on
TARGET, PROBES = 0.95, 64
#: the trees are fitted on about so many vectors at most, chosen by a hash; leaves hold at least eight of them
SAMPLE = 40_000
#: vectors and queries that one group of the exact pass holds on average at most
BLOCK, CHUNK = 4_000, 2_000


class Forest(NamedTuple):
    """Balanced trees as arrays: node ``i`` has the children ``2i + 1`` and ``2i + 2``; the last level are the leaves."""

    top: float  # the largest norm
    turns: np.ndarray  # trees x nodes x (width + 1)
    cuts: np.ndarray  # trees x nodes

    @property
    def inner(self) -> int:
        return self.cuts.shape[1]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with the component that brings them to the largest norm."""
        return np.hstack([x, np.sqrt(np.maximum(self.top**2 - (x * x).sum(1, keepdims=True), 0))])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree: rows x trees."""
        z, out = self.lifted(x), np.zeros((len(x), len(self.cuts)), np.int32)
        for tree, (turns, cuts) in enumerate(zip(self.turns, self.cuts)):
            at = np.zeros(len(x), np.int64)
            while self.inner and at[0] < self.inner:
                right = np.einsum("ij,ij->i", z, turns[at]) > cuts[at]
                at = 2 * at + 1 + right
            out[:, tree] = at - self.inner
        return out

    def visits(self, query: np.ndarray, sizes: np.ndarray, search: int) -> list[tuple[int, int]]:
        """``(tree, leaf)`` in the order of the shared queue until ``search`` vectors are in reach. ``sizes``: trees x leaves."""
        norm = np.linalg.norm(query)
        q = np.append(query * (self.top / norm), 0.0)
        margins = self.turns @ q - self.cuts
        queue = [(-np.inf, tree, 0) for tree in range(len(self.cuts))]
        out, reach = [], 0
        while queue and reach < search:
            bound, tree, node = heapq.heappop(queue)
            if node >= self.inner:
                leaf = node - self.inner
                if sizes[tree, leaf]:
                    out.append((tree, leaf))
                    reach += sizes[tree, leaf]
                continue
            gap = margins[tree, node]
            heapq.heappush(queue, (max(bound, -gap), tree, 2 * node + 2))
            heapq.heappush(queue, (max(bound, gap), tree, 2 * node + 1))
        return out


def plant(sample: np.ndarray, top: float, rows: int, trees: int = TREES, leaf: int = LEAF) -> Forest:
    """Trees whose leaves hold about ``leaf`` of ``rows`` vectors; every cut halves the sample at a random direction."""
    depth = max(0, min(round(np.log2(max(1, rows) / leaf)), int(np.log2(max(1, len(sample) / 8)))))
    random, inner = np.random.default_rng(SEED), 2**depth - 1
    width = sample.shape[1] + 1
    forest = Forest(top, random.normal(size=(trees, inner, width)), np.zeros((trees, inner)))
    z = forest.lifted(sample)
    for tree in range(trees):
        members = {0: np.arange(len(z))}
        for node in range(inner):
            own = members.pop(node)
            forest.turns[tree, node] /= np.linalg.norm(forest.turns[tree, node])
            along = z[own] @ forest.turns[tree, node]
            forest.cuts[tree, node] = np.median(along) if len(own) else 0.0
            right = along > forest.cuts[tree, node]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return forest


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, v array<double>`` of rows with an id whose vector has only finite components, not all 0, once each."""
    v = F.col(vector_column).cast("array<double>")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine).distinct()


def _reach(queries: DataFrame, placed: DataFrame, forest: Forest, counts: np.ndarray, k: int, target: float) -> int:
    """How many vectors a queue must reach to find the share ``target`` of the true neighbours of a few queries."""
    probes = [(r["vec_id"], np.array(r["v"])) for r in queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).collect()]
    if not probes:
        return 0
    asked = np.stack([v for _, v in probes])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                scores = asked @ np.stack(frame["v"]).T
                for p, row in enumerate(scores):
                    top = np.argsort(-row)[: k + 1]
                    yield pd.DataFrame({"probe": p, "node": frame["ids"].iloc[top].map(lambda i: i[0]), "score": row[top]})

    first = placed.where("tree = 0").mapInPandas(near, "probe int, node long, score double")
    by_score = Window.partitionBy("probe").orderBy(F.desc("score"), "node")
    nearest = first.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1).select("probe", "node", "place")
    leaves = placed.select(F.col("ids")[0].alias("node"), "tree", "leaf").join(F.broadcast(nearest), "node").collect()
    orders = [dict(zip(o, np.cumsum([counts[x] for x in o]))) for o in (forest.visits(v, counts, np.inf) for _, v in probes)]
    needed: dict[tuple[int, int], int] = {}
    for r in leaves:
        key, at = (r["probe"], r["node"]), orders[r["probe"]][(r["tree"], r["leaf"])]
        if r["node"] != probes[r["probe"]][0]:
            needed[key] = min(at, needed.get(key, at))
    return int(np.quantile(list(needed.values()), target, method="higher")) if needed else 1


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", target: float = TARGET) -> DataFrame:
    """The ``k`` nearest of each row whose id is divisible by ``every``: ``query_id, rank, vec_id, score``.

    Candidates are all rows but those of the query's own id; all come back if they are fewer than ``k``. Vectors that are
    null, empty, zero or not finite, and rows without id, take no part; so do vectors of another length than the most
    frequent one. Repeated rows count once. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors, id_column, vector_column)
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    if sizes is None:
        return empty
    width = sizes["width"]
    rows = rows.where(F.size("v") == width)
    # equal vectors become one node with their k + 1 smallest ids; the limit works before the shuffle already
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    grouped = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(grouped.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    total = nodes.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).first()
    share = min(1.0, SAMPLE / total["n"])
    chosen = nodes.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).select("v").collect()
    sample = np.array([r["v"] for r in chosen]) if chosen else np.zeros((1, width))
    forest = plant(sample, total["top"], total["n"])

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                leaves = forest.leaves(np.stack(frame["v"]))
                trees = leaves.shape[1]
                each = frame.loc[frame.index.repeat(trees)]
                yield each[["ids", "v"]].assign(tree=np.tile(np.arange(trees, dtype=np.int32), len(frame)), leaf=leaves.ravel())

    placed = materialize(nodes.select("ids", "v").mapInPandas(index, "ids array<long>, v array<double>, tree int, leaf int"), "leaves")
    counts = np.zeros((TREES, forest.inner + 1), np.int64)  # bounded by the sample, as the forest is
    for r in placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["tree"], r["leaf"]] = r["n"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for query_id, v in zip(frame["vec_id"], frame["v"]):
                found = np.array(forest.visits(np.asarray(v), counts, reach), np.int32)
                yield pd.DataFrame({"query_id": query_id, "tree": found[:, 0], "leaf": found[:, 1], "q": [v] * len(found)})

    queries = rows.where(F.col("vec_id") % every == 0)
    reach = _reach(queries, placed, forest, counts, k, target)
    asked = queries.repartition(spark.sparkContext.defaultParallelism * 2)
    visits = materialize(asked.mapInPandas(walk, "query_id long, tree int, leaf int, q array<double>"), "visits")
    callers = visits.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("calls"))
    # a few thousand leaves at most: how many blocks and chunks each is dealt to
    shape = [(r["tree"], r["leaf"], int(-(-counts[r["tree"], r["leaf"]] // BLOCK)), int(-(-r["calls"] // CHUNK))) for r in callers.collect()]
    if not shape:
        return empty
    deal = F.broadcast(spark.createDataFrame(shape, "tree int, leaf int, blocks int, chunks int"))
    left = placed.join(deal, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("ids"), "blocks").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = visits.join(deal, ["tree", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["tree", "leaf", "block", "chunk"]

    def exact(vectors_: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors_) or not len(queries):
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
        x, q, ids = np.stack(vectors_["v"]), np.stack(queries["q"]), list(vectors_["ids"])
        out = []
        for at in range(0, len(q), 256):
            s = q[at : at + 256] @ x.T
            for row, query_id in zip(s, queries["query_id"].iloc[at : at + 256]):
                # all that reach the (k + 1)-th best score, so ties are never cut
                near = np.flatnonzero(row >= np.partition(row, -(k + 1))[-(k + 1)]) if len(row) > k + 1 else np.arange(len(row))
                found = sorted((-row[n], i) for n in near for i in ids[n] if i != query_id)[:k]
                out.append((query_id, [i for _, i in found], [-s_ for s_, _ in found]))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    blocks = left.select(*key, "ids", "v").groupBy(*key).cogroup(right.select(*key, "query_id", "q").groupBy(*key)).applyInPandas(exact, "query_id long, ids array<long>, scores array<double>")

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        """Merges the few lists of one query."""
        scores: dict[int, float] = {}
        for ids, own in zip(frame["ids"], frame["scores"]):
            for i, s in zip(ids, own):
                scores[i] = max(s, scores.get(i, -np.inf))
        found = sorted((-s, i) for i, s in scores.items())[:k]
        return pd.DataFrame({"query_id": frame["query_id"].iloc[0], "rank": np.arange(1, len(found) + 1, dtype=np.int32), "vec_id": [i for _, i in found], "score": [-s for s, _ in found]})

    return blocks.groupBy("query_id").applyInPandas(best, "query_id long, rank int, vec_id long, score double")
