"""Exact top-k by inner product: a ball tree per shard of vectors, searched by branch and bound.

Vectors are dealt by hash into groups of GROUP rows at most, and each group's into
shards of SHARD rows. A shard is split into balls (centre, radius) by the direction of its largest
spread. A query's product with any vector of a ball is at most
centre . query + radius * |query|; balls whose bound is below the query's current
k-th score are left out with all that is in them, the others are taken in the
order of their bounds. The k-th scores are shared: from ball to ball, from shard
to shard of a group, and at the start by a first look at SEEDS vectors, which are
the only vectors that come to the driver.

A group's task first gets its vectors and builds their trees, once, and then the
queries, which are sent to every group, batch by batch; it holds its trees and one
batch. It returns its k best per query, and a grouped top-k merges them. Scores are
whole numbers: components are floor(256 * x).

Defined cases: a score that a long can't hold raises ArithmeticError; NULL vectors and vectors with NULL or non-finite components take
no part; rows with NULL ids neither; vectors of other lengths count as filled up
with zeros; equal scores are ranked by id; ids are keys (a repeated row is a
candidate each time, though never of a query with its own id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
SHARD = 8192
LEAF = 256
#: Rows of a group at most; fewer where that keeps more tasks busy, but not under LEAST_GROUP.
GROUP = 131_072
LEAST_GROUP = 2048
SEEDS = 4096
#: Scores a task holds at a time for a ball: queries times rows.
_CELLS = 4_000_000
#: Below every score; its negative is a long, too.
LOWEST = -(2**63 - 1)


def scaled(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): the usable vectors as lists of whole numbers."""
    x = F.col(column)
    usable = x.isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.where(usable).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE)).alias("v"))


def _matrix(lists, width: int | None = None) -> np.ndarray:
    """A list column as a matrix of longs, short rows filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), width or 0)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _products(queries: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact whole products, but for those of a row with itself (``own``); in doubles if no sum can leave the range in which they are exact."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * max(1, rows.shape[1])
    if most < 2**52:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    if most >= 2**63:
        about = np.where(own, 0.0, queries.astype(float) @ rows.astype(float).T)
        if np.abs(about).max(initial=0) >= 2.0**63 * (1 - 1e-9):
            raise ArithmeticError("an inner product doesn't fit a long")
    return queries @ rows.T  # sums modulo 2**64, right where the sum fits


class BallTree:
    """Balls over a shard; leaves are runs of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order, self.nodes = np.arange(len(ids)), []  # (start, end, centre, radius, left, right)
        points = rows.astype(float)

        def build(start: int, end: int) -> int:
            own = points[order[start:end]]
            centre = own.mean(axis=0)
            far = np.sqrt(((own - centre) ** 2).sum(axis=1))
            node = len(self.nodes)
            self.nodes.append(None)
            left = right = -1
            if end - start > leaf:
                a = own[far.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                middle = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(own @ (b - a), middle)]
                left, right = build(start, start + middle), build(start + middle, end)
            self.nodes[node] = (start, end, centre, float(far.max()), left, right)
            return node

        build(0, len(ids))
        self.ids, self.rows = ids[order], rows[order]
        self.centres = np.array([n[2] for n in self.nodes])
        self.radii = np.array([n[3] for n in self.nodes])


class Search:
    """The best k rows so far of a block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.queries, self.floor, self.k = ids, queries, floor.copy(), k
        self.norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        self.scores = np.full((len(ids), k), LOWEST)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.visited = self.possible = 0

    def visit(self, tree: BallTree) -> None:
        """Down the tree level by level with the queries that each ball may still serve, then leaf by leaf, best bound first."""
        if tree.rows.shape[1] != self.queries.shape[1]:
            raise ValueError("the tree and the queries have unlike dimensions")
        slack = 1e-9 * (self.norms * (tree.radii.max() + np.sqrt((tree.centres**2).sum(axis=1)).max()) + 1)
        alive = [(0, np.arange(len(self.ids)))]
        leaves, bounds, whose = [], [], []
        while alive:
            below = []
            for node, queries in alive:
                bound = self.queries[queries] @ tree.centres[node] + tree.radii[node] * self.norms[queries] + slack[queries]
                open_ = bound >= self.floor[queries]
                if not open_.any():
                    continue
                if tree.nodes[node][4] < 0:
                    leaves.append(node)
                    bounds.append(bound[open_])
                    whose.append(queries[open_])
                else:
                    below += [(child, queries[open_]) for child in tree.nodes[node][4:]]
            alive = below
        self.possible += len(self.ids) * sum(n[4] < 0 for n in tree.nodes)
        for at in sorted(range(len(leaves)), key=lambda i: -float(bounds[i].max())):
            start, end = tree.nodes[leaves[at]][:2]
            queries = whose[at][bounds[at] >= self.floor[whose[at]]]  # the k-th scores have risen since
            self.visited += len(queries)
            step = max(1, _CELLS // (end - start))
            for i in range(0, len(queries), step):
                self._offer(queries[i : i + step], tree.ids[start:end], tree.rows[start:end])

    def _offer(self, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        own = ids[None, :] == self.ids[queries][:, None]
        scores = _products(self.queries[queries], rows, own)
        good = (scores >= self.floor[queries][:, None]) & ~own
        q, r = np.nonzero(good)
        if not len(q):
            return
        touched, place = np.unique(q, return_inverse=True)
        owners = queries[touched]
        k = self.k
        who = np.concatenate([np.repeat(np.arange(len(touched)), k), place])
        score = np.concatenate([self.scores[owners].ravel(), scores[q, r]])
        name = np.concatenate([self.found[owners].ravel(), ids[r]])
        order = np.lexsort((name, -score, who))
        first = np.searchsorted(who[order], np.arange(len(touched)))
        best = order[first[:, None] + np.arange(k)]
        self.scores[owners], self.found[owners] = score[best], name[best]
        full = self.found[owners, -1] != np.iinfo(np.int64).max
        self.floor[owners[full]] = np.maximum(self.floor[owners[full]], self.scores[owners[full], -1])


class Group:
    """The trees of a group's vectors, built shard by shard as they come."""

    def __init__(self, width: int):
        self.width, self.trees, self.waiting, self.n = width, [], [], 0

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.waiting.append((ids, _widened(rows, self.width)))
        self.n += len(ids)
        if self.n >= SHARD:
            self.build()

    def build(self) -> None:
        if self.n:
            ids, rows = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.trees += [BallTree(ids[i : i + SHARD], rows[i : i + SHARD]) for i in range(0, self.n, SHARD)]
            self.waiting, self.n = [], 0

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> Search:
        """The trees with the highest bounds come first."""
        self.build()
        search = Search(ids, _widened(queries, self.width), floor, k)
        bound = lambda t: float((search.queries @ t.centres[0] + t.radii[0] * search.norms).max())
        for tree in sorted(self.trees, key=bound, reverse=True):
            search.visit(tree)
        return search


def first_look(queries: DataFrame, seeds: list, width: int, k: int) -> DataFrame:
    """(id, v, floor): the k-th best score of each query among the seeds, which its k-th best of all can't be below."""
    names = np.array([r["id"] for r in seeds], np.int64)
    rows = _matrix(pa.array([r["v"] for r in seeds], pa.list_(pa.int64())), width)
    sent = queries.sparkSession.sparkContext.broadcast((names, rows))

    def run(batches):
        group = Group(width)
        group.add(*sent.value)
        for batch in batches:
            floor = np.full(batch.num_rows, LOWEST)
            search = group.search(batch.column("id").to_numpy(), _matrix(batch.column("v"), width), floor, k)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(search.floor)], ["id", "v", "floor"])

    return queries.mapInArrow(run, "id long, v array<long>, floor long")


def _by_group(batches) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Runs of rows with one group and kind."""
    for batch in batches:
        codes = batch.column("group").to_numpy() * 2 + batch.column("kind").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield int(codes[a]) // 2, int(codes[a]) % 2, batch.slice(a, b - a)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, most: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors (id, v) for each row of queries, its own id left out."""
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    seeds = vectors.orderBy(F.xxhash64("id"), "id").limit(SEEDS).collect()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-n // most), min(tasks, -(-n // LEAST_GROUP)))
    looked = first_look(queries, seeds, width, k) if seeds else queries.withColumn("floor", F.lit(LOWEST))
    own = vectors.select(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), "id", "v", F.lit(LOWEST).alias("floor"))
    asked = looked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), "id", "v", "floor")

    def run(batches):
        now, group = None, None
        for number, kind, rows in _by_group(batches):
            if number != now:
                now, group = number, Group(width)
            ids, v = rows.column("id").to_numpy(), _matrix(rows.column("v"), width)
            if not kind:
                group.add(ids, v)
                continue
            search = group.search(ids, v, rows.column("floor").to_numpy(), k)
            q, j = np.nonzero(search.found != np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(search.found[q, j]), pa.array(search.scores[q, j])], ["query_id", "vec_id", "score"])

    dealt = own.union(asked).repartition(groups, "group").sortWithinPartitions("group", "kind")
    out = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_vectors(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k best for the rows whose vec_id is divisible by ``every``, against all rows."""
    vectors = scaled(embeddings)
    return nearest(vectors, vectors.where(F.col("id") % every == 0), k)
