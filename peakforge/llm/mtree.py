"""Exact search for the largest inner products with a forest of M-trees.

Inner products become distances: with M the largest norm, a vector x gets one more coordinate sqrt(M^2 - |x|^2) and a query gets 0
there, so the squared distance is |q|^2 + M^2 - 2 q.x and nearest is largest. Rows are laid out by nearest pivot and distance to it
in ranges of equal size, so that many copies of a vector are split over trees like any others. Each tree is a row: pages of entries, groups of
pages and a root, each with a routing entry, a covering radius and the distance to its parent's routing entry.

A query goes through a tree best-first: it opens its node with the smallest possible distance until that exceeds its k-th best. Before
a distance is computed, the stored distance to the parent gives a bound by the triangle inequality, and the computation is left out
where that suffices. Queries open their nodes in step, so that those at one node share a matrix product. Bounds keep a
slack above rounding, and scores are whole numbers, computed exactly: results are exact, ties included.

Queries are read in blocks of about BLOCK_BYTES, by hash of the row, each broadcast and held against all trees; a task carries the k best of
each query from tree to tree and returns only those. In high dimensions without clusters few pages are left out, and the work is that of
comparing every query with every row, as exact search then has to.

Left out: null and empty vectors, vectors with broken entries, of another length than most have, or with entries so large (d x^2 of 2^63 or
more) that a score would not fit a long. A repeated row is a row of its own, as query and as candidate; a null id is no query and comes
after all ids among equal scores. Fewer candidates than k: all. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakforge.llm.store import drop, new_path, written
from peakforge.llm.whitening import main_length, whole_vectors

SCALE, PIVOTS, TREE, PAGE, GROUP = 1024, 256, 4096, 64, 16
BLOCK_BYTES = 16 << 20
#: In place of a null id, so that it is the last of equal scores.
LAST = (1 << 63) - 1

_TREE = (
    "uids array<long>, ids array<long>, x binary, entry_dist array<double>, page_at array<int>, page_router array<int>, page_radius array<double>, page_dist array<double>, "
    "group_at array<int>, group_router array<int>, group_radius array<double>, group_dist array<double>, root_router int, root_radius double"
)
_FOUND = "query_uid long, query_id long, uid long, vec_id long, score long"


def _lifted(x: np.ndarray, top: int) -> np.ndarray:
    """Rows with the coordinate that gives all of them the norm sqrt(top)."""
    f = x.astype(float)
    return np.column_stack([f, np.sqrt(np.maximum(top - np.square(f).sum(axis=1), 0))])


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to one row or to rows of b."""
    return np.sqrt(np.maximum(np.square(a).sum(axis=-1)[..., None] + np.square(b).sum(axis=-1) - 2 * a @ b.T, 0))


def _tree(uids: np.ndarray, ids: np.ndarray, x: np.ndarray, top: int) -> dict:
    """One tree over rows in memory, TREE of them at most."""
    a = _lifted(x, top)
    seeds = a[:: PAGE]
    near = _far(a, seeds)
    order = np.lexsort((near.min(axis=1), near.argmin(axis=1)))
    uids, ids, x, a = uids[order], ids[order], x[order], a[order]
    n = len(a)

    def covered(bounds: np.ndarray) -> tuple[list, list, np.ndarray]:
        """Of each stretch of entries: the one nearest to its mean, the radius around it, all distances to it."""
        routers, radii, dist = [], [], np.zeros(n)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            r = lo + int(np.square(a[lo:hi] - a[lo:hi].mean(axis=0)).sum(axis=1).argmin())
            dist[lo:hi] = np.sqrt(np.square(a[lo:hi] - a[r]).sum(axis=1))
            routers.append(r)
            radii.append(float(dist[lo:hi].max()))
        return routers, radii, dist

    page_at = np.append(np.arange(0, n, PAGE), n)
    group_at = np.append(np.arange(0, len(page_at) - 1, GROUP), len(page_at) - 1)
    page_router, page_radius, entry_dist = covered(page_at)
    group_router, group_radius, to_group = covered(page_at[group_at])
    (root,), (radius,), to_root = covered(np.array([0, n]))
    return {
        "uids": uids, "ids": ids, "x": x.astype("<i8").tobytes(), "entry_dist": entry_dist, "page_at": page_at.astype(np.int32), "page_router": np.array(page_router, np.int32), "page_radius": page_radius,
        "page_dist": to_group[page_router], "group_at": group_at.astype(np.int32), "group_router": np.array(group_router, np.int32), "group_radius": group_radius, "group_dist": to_root[group_router],
        "root_router": root, "root_radius": radius,
    }


class _Search:
    """The k best of a block of queries, over one tree after another."""

    def __init__(self, uids: np.ndarray, x: np.ndarray, k: int, top: int, pivots: tuple[np.ndarray, np.ndarray]) -> None:
        self.uids, self.k, self.top = uids, k, top
        self.exact = float if top < 1 << 53 else np.int64  # a sum of products is at most top in size
        self.x = x.astype(self.exact)
        self.norm = np.square(x.astype(float)).sum(axis=1)
        self.slack = 1e-6 * (1 + top**0.5)
        self.computed = 0
        self.best = tuple(np.zeros(0, np.int64) for _ in range(4))  # query, score, id, uid; in order
        self.least = np.full(len(uids), np.iinfo(np.int64).min)
        scores = (self.x @ pivots[1].astype(self.exact).T).astype(np.int64)
        scores[uids[:, None] == pivots[0]] = self.least[0] if len(uids) else 0
        if scores.shape[1] >= k:
            self.least = np.sort(scores, axis=1)[:, -k]
        self._bound()

    def _bound(self) -> None:
        known = self.least > np.iinfo(np.int64).min
        self.bound = np.where(known, np.sqrt(np.maximum(self.norm + self.top - 2.0 * self.least, 0)), np.inf) + self.slack

    def _scores(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        self.computed += len(rows) * len(x)
        return self.x[rows] @ x.T

    def _to(self, rows: np.ndarray, router: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm[rows] + self.top - 2.0 * self._scores(rows, router[None])[:, 0], 0))

    def _take(self, new: list[tuple]) -> None:
        """Merge what a round has found: k for each query, by score, then id."""
        q, s, i, u = (np.concatenate(c) for c in zip(self.best, *new, strict=True))
        order = np.lexsort((u, i, -s, q))
        q = q[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        order = order[rank < self.k]
        kth = rank == self.k - 1
        self.best = (q[rank < self.k], s[order], i[order], u[order])
        full = q[kth]
        self.least[full] = np.maximum(self.least[full], self.best[1][np.flatnonzero(rank[rank < self.k] == self.k - 1)])
        self._bound()

    def add(self, t: dict) -> None:
        uids, ids, dist = (np.asarray(t[c]) for c in ("uids", "ids", "entry_dist"))
        x = np.frombuffer(t["x"], "<i8").reshape(len(uids), -1).astype(self.exact)
        page_at, page_router, page_radius, page_dist = (np.asarray(t[c]) for c in ("page_at", "page_router", "page_radius", "page_dist"))
        group_at, group_router, group_radius, group_dist = (np.asarray(t[c]) for c in ("group_at", "group_router", "group_radius", "group_dist"))
        groups, pages = len(group_router), len(page_router)
        every = np.arange(len(self.uids))
        low = np.full((len(every), groups + pages), np.inf)  # least distance to what lies below a node that can be opened
        at = np.zeros((len(every), groups + pages))  # distance to its routing entry

        def reach(rows: np.ndarray, parent: np.ndarray, node: int, router: int, radius: float, to_parent: float) -> None:
            rows = rows[np.abs(parent - to_parent) - radius <= self.bound[rows]]
            if len(rows):
                at[rows, node] = self._to(rows, x[router])
                low[rows, node] = np.maximum(at[rows, node] - radius, 0)

        from_root = self._to(every, x[t["root_router"]])
        alive = every[from_root - t["root_radius"] <= self.bound]
        for g in range(groups):
            reach(alive, from_root[alive], g, group_router[g], group_radius[g], group_dist[g])
        while len(alive):
            node = low[alive].argmin(axis=1)
            going = np.isfinite(low[alive, node]) & (low[alive, node] <= self.bound[alive])
            alive, node = alive[going], node[going]
            new = []
            for v in np.unique(node):
                rows = alive[node == v]
                low[rows, v] = np.inf
                if v < groups:
                    for p in range(group_at[v], group_at[v + 1]):
                        reach(rows, at[rows, v], groups + p, page_router[p], page_radius[p], page_dist[p])
                    continue
                lo, hi = page_at[v - groups : v - groups + 2]
                near = np.abs(at[rows, v][:, None] - dist[lo:hi]) <= self.bound[rows, None]
                some = lo + np.flatnonzero(near.any(axis=0))
                if len(some):
                    scores = self._scores(rows, x[some])
                    i, j = np.nonzero((scores >= self.least[rows, None]) & (self.uids[rows, None] != uids[some]))
                    new.append((rows[i], scores[i, j].astype(np.int64), ids[some[j]], uids[some[j]]))
            if new:
                self._take(new)


def build_forest(rows: DataFrame, d: int, top: int, pivots: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Trees over (uid, vec_id, x): a table with a row per tree."""
    spark = rows.sparkSession
    lifted = _lifted(pivots[1], top)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                far = _far(_lifted(np.stack(b["x"].to_numpy()).astype(np.int64), top), lifted)
                yield b.assign(pivot=far.argmin(axis=1), far=far.min(axis=1))

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def made(b: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([_tree(b["uid"].to_numpy(), b["vec_id"].to_numpy(), np.stack(b["x"].to_numpy()).astype(np.int64), top)])

        for b in batches:
            held.append(b)
            size += len(b)
            if size >= TREE:
                whole = pd.concat(held, ignore_index=True)
                full = size // TREE * TREE
                for i in range(0, full, TREE):
                    yield made(whole[i : i + TREE])
                held, size = [whole[full:]], size - full
        if size:
            yield made(pd.concat(held, ignore_index=True))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() * d * 8 // (64 << 20) + 1)
    order = ["pivot", "far", "uid"]
    laid = rows.mapInPandas(placed, "uid long, vec_id long, x array<long>, pivot int, far double").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(laid.drop("pivot", "far").mapInPandas(trees, _TREE), "trees", hashes=True)


def top_products(df: DataFrame, queries: str, k: int = 10, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the condition `queries` on vec_id selects, the k other rows of largest product."""
    spark = df.sparkSession
    rows = whole_vectors(df, vector, SCALE)
    d = main_length(rows)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = int((((1 << 63) - 1) // d) ** 0.5)
    rows = rows.where((F.size("x") == d) & F.forall("x", lambda c: F.abs(c) <= most))
    rows = written(rows.select(F.monotonically_increasing_id().alias("uid"), F.coalesce("vec_id", F.lit(LAST)).alias("vec_id"), "x"), "vectors", hashes=True)
    top = rows.agg(F.max(F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c * c))).first()[0]
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = rows.orderBy(F.xxhash64("uid"), "uid").limit(PIVOTS).collect()
    pivots = np.array([r.uid for r in chosen]), np.array([r.x for r in chosen], np.int64)
    forest = build_forest(rows, d, top, pivots)

    asked = written(rows.where(f"vec_id <> {LAST} and ({queries})"), "queries", hashes=True)
    blocks = asked.count() * d * 8 // BLOCK_BYTES + 1
    folder = new_path(spark, "found")
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == i).collect()  # about BLOCK_BYTES
        block = spark.sparkContext.broadcast((np.array([r.uid for r in part], np.int64), np.array([r.vec_id for r in part], np.int64), np.array([r.x for r in part], np.int64).reshape(len(part), d)))

        def search(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            uids, ids, x = block.value
            s = _Search(uids, x, k, top, pivots)
            for b in batches:
                for t in b.to_dict("records"):
                    s.add(t)
            q, score, vec, uid = s.best
            yield pd.DataFrame({"query_uid": uids[q], "query_id": ids[q], "uid": uid, "vec_id": vec, "score": score})

        forest.mapInPandas(search, _FOUND).write.mode("append").parquet(folder)
        block.unpersist()
    for t in (rows, forest, asked):
        drop(t)
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid"))
    found = spark.read.schema(_FOUND).parquet(folder).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.when(F.col("vec_id") != LAST, F.col("vec_id")).alias("vec_id"), "score")
