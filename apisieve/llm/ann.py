"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first with as many leaf visits as calibration asks for."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read

#: Vectors that the tree is fitted on at most, and queries that calibrate the number of leaf visits.
SAMPLE, CALIBRATION = 20_000, 96
BRANCH, LEAF_ROWS, MAX_LEAVES = 8, 400, 1024
#: Rows of a leaf that one task searches; a larger leaf is dealt over several.
BLOCK_ROWS = 4096
#: Leaves that a query visits before it has a bound on its k-th score, and how many times as many it has visited before each next bound.
FIRST_VISITS, WIDEN, RECALL = 4, 4, 0.96


class KMeansTree:
    """Nodes in arrays: a centroid each, children of inner nodes, numbers of leaves."""

    def __init__(self, centroids: np.ndarray, children: list[list[int]], leaf: np.ndarray):
        self.centroids, self.children, self.leaf = centroids, children, leaf
        self.n_leaves = int(leaf.max()) + 1

    @classmethod
    def fit(cls, x: np.ndarray, leaf_rows: int, seed: int = 11) -> KMeansTree:
        rng = np.random.default_rng(seed)
        centroids, children, leaf, todo, leaves = [x.mean(0)], [[]], [-1], [(0, np.arange(len(x)))], 0
        while todo:
            node, rows = todo.pop()
            parts = cls._split(x[rows], rng) if len(rows) > leaf_rows else []
            if len(parts) < 2:
                leaf[node], leaves = leaves, leaves + 1
                continue
            for centre, mine in parts:
                children[node].append(len(centroids))
                todo.append((len(centroids), rows[mine]))
                centroids.append(centre)
                children.append([])
                leaf.append(-1)
        return cls(np.array(centroids), children, np.array(leaf))

    @staticmethod
    def _split(x: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        different = np.unique(x, axis=0)
        if len(different) < 2:
            return []
        centres = different[rng.choice(len(different), min(BRANCH, len(different)), replace=False)]
        for _ in range(8):
            near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
            centres = np.array([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(len(centres))])
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        return [(centres[j], np.flatnonzero(near == j)) for j in range(len(centres)) if (near == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into, by the nearest centroid level by level."""
        out, todo = np.empty(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centroids[kids]
            near = (x[rows] @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
            todo += [(k, rows[near == j]) for j, k in enumerate(kids) if (near == j).any()]
        return out

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """Leaves in the order of a best-bin-first descent: the open node with the largest inner product comes next."""
        heap, found = [(0.0, 0)], []
        while heap and len(found) < visits:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not kids:
                found.append(int(self.leaf[node]))
                continue
            for s, k in zip(self.centroids[kids] @ q, kids, strict=True):
                heapq.heappush(heap, (-float(s), k))
        return found


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id and the vector as doubles, for vectors that are not null, not zero and all finite."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    out = vectors.where(ok).select("vec_id", v.alias("v")).where(fine)
    return out if dim is None else out.where(F.size("v") == dim)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class _Block:
    """Rows searched together; equal vectors are scored once, so ties are exact and a crowd of copies costs one product."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order] + 0.0)  # no negative zeros
        rows = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        _, first, group = np.unique(rows, return_index=True, return_inverse=True)
        self.x = x[first]
        # ids by group, ascending in each, and where each group's begin
        self.ids = ids[np.argsort(group, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(first)))])

    def top(self, qids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query its k best of this block's rows but itself, if not under its bound: queries' ids, rows' ids, scores."""
        scores, n = q @ self.x.T, len(self.x)
        least = bounds if n <= k + 1 else np.maximum(bounds, np.partition(scores, n - k - 1, axis=1)[:, n - k - 1])
        at, group = np.nonzero(scores >= least[:, None] - 1e-9)
        exact = (self.x[group] * q[at]).sum(1)
        size = np.minimum(self.starts[group + 1] - self.starts[group], k + 1)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at, exact, ids = np.repeat(at, size), np.repeat(exact, size), self.ids[np.repeat(self.starts[group], size) + place]
        fine = (ids != qids[at]) & (exact >= bounds[at])
        at, exact, ids = at[fine], exact[fine], ids[fine]
        order = np.lexsort((ids, -exact, at))
        at, exact, ids = at[order], exact[order], ids[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < k
        return qids[at[best]], ids[best], exact[best]


def _top(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = RECALL) -> DataFrame:
    """The k vectors of largest inner product for each query row, among all other rows: query_id, rank, vec_id, score.

    1. The tree is fitted on at most SAMPLE vectors, whichever hash first. 2. Every row goes to its leaf, and the index is
    partitioned by leaf and block once. 3. For CALIBRATION other vectors, which the tree has not seen (in a table of
    fewer than twice as many, it has), the true neighbours among all rows are found block by block, and visits
    are widened until their leaves hold `recall` of them. 4. Each query visits FIRST_VISITS leaves,
    which bounds its k-th score; then WIDEN times as many in all, and so on up to the calibrated number, where
    each round passes on only rows that are not under the bound so far. Queries travel to leaves in packs;
    leaves of more than BLOCK_ROWS rows are dealt over several tasks.

    Vectors that are null, zero, not finite or of another length than the sample's commonest take no part.
    Ties go to the smaller vec_id. Fewer than k other rows: all of them, if visited. Rows that repeat a vec_id
    count as one another's own. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    sample = usable(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION + SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    lengths = np.array([len(v) for v in sample.column("v").to_pylist()])
    dim = int(np.bincount(lengths).argmax())
    sample = sample.filter(pa.array(lengths == dim))
    ids, x = sample.column("vec_id").to_numpy(), _matrix(sample.column("v"))
    asked, fitted = x[:CALIBRATION], x[CALIBRATION:] if len(x) >= 2 * CALIBRATION else x
    rows = usable(vectors, dim)
    n = rows.count()
    leaves = min(MAX_LEAVES, max(1, n // LEAF_ROWS), max(1, len(fitted) // 16))
    tree = spark.sparkContext.broadcast(KMeansTree.fit(fitted, max(1, 2 * len(fitted) // leaves)))

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.value.assign(_matrix(b.column(1)))), b.column(0), b.column(1)], names=["leaf", "vec_id", "v"])

    index = materialize(rows.mapInArrow(place, "leaf long, vec_id long, v array<double>"), "leaves")
    counts = {r.leaf: r.n for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # MAX_LEAVES rows at most
    blocks = np.array([-(-counts.get(i, 0) // BLOCK_ROWS) for i in range(tree.value.n_leaves)], np.int64)
    visits = _calibrate(index, tree.value, ids[:CALIBRATION], asked, k, recall)

    sizes = spark.createDataFrame([(i, int(max(1, b))) for i, b in enumerate(blocks)], "leaf long, blocks int")  # MAX_LEAVES rows at most
    members = index.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).drop("blocks")
    # kept in its partitions for all rounds; what a lost executor held is made anew from the written index
    members = members.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "leaf", "block").persist(StorageLevel.DISK_ONLY)

    def route(first: int, last: int):
        def pack(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                qids, bounds, q = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
                at: dict[int, list[int]] = {}
                for i in range(len(q)):
                    for leaf in tree.value.best_bins(q[i], last)[first:]:
                        at.setdefault(leaf, []).append(i)
                out = [(leaf, block, qids[i].tobytes(), bounds[i].tobytes(), q[i].tobytes()) for leaf, i in at.items() for block in range(blocks[leaf])]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["leaf", "block", "qids", "bounds", "q"])

        return pack

    def meet(mine: pa.Table, packs: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if mine.num_rows and packs.num_rows:
            block = _Block(mine.column("vec_id").to_numpy(), _matrix(mine.column("v")))
            for qids, bounds, q in zip(*(packs.column(c).to_pylist() for c in ("qids", "bounds", "q")), strict=True):
                qids = np.frombuffer(qids, np.int64)
                for i in range(0, len(qids), 512):  # scores of so many queries at a time
                    some = slice(i, i + 512)
                    found.append(block.top(qids[some], np.frombuffer(q, np.float64).reshape(len(qids), -1)[some], np.frombuffer(bounds, np.float64)[some], k))
        return pa.table([pa.array(np.concatenate([f[j] for f in found])) for j in range(3)], names=["query_id", "vec_id", "score"])

    def visit(queries: DataFrame, first: int, last: int) -> DataFrame:
        packs = queries.mapInArrow(route(first, last), "leaf long, block int, qids binary, bounds binary, q binary")
        return members.groupBy("leaf", "block").cogroup(packs.groupBy("leaf", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")

    queries = index.where(is_query(F.col("vec_id"))).select("vec_id", "v")
    asking, best, done = queries.select("vec_id", F.lit(float("-inf")).alias("bound"), "v"), None, 0
    while True:
        reach = min(visits, max(FIRST_VISITS, done * WIDEN))
        found = visit(asking, done, reach)
        best, done = found if best is None else best.unionByName(found), reach
        if done >= visits:
            out = materialize(_top(best, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found")
            members.unpersist()
            return out
        best = materialize(_top(best, k).drop("rank"), "nearest")
        bound = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("b"))
        bounded = queries.join(bound, F.col("vec_id") == F.col("query_id"), "left")
        asking = materialize(bounded.select("vec_id", F.coalesce("b", F.lit(float("-inf"))).alias("bound"), "v"), "queries")


def _calibrate(index: DataFrame, tree: KMeansTree, ids: np.ndarray, q: np.ndarray, k: int, recall: float) -> int:
    """The least number of leaf visits whose leaves hold `recall` of the queries' true neighbours; every row is compared with these few queries."""

    def nearest(batches):
        for b in batches:
            if b.num_rows:
                found = _Block(b.column(1).to_numpy(), _matrix(b.column(2)))
                leaf = dict(zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True))
                asking, near, score = found.top(ids, q, np.full(len(q), -np.inf), k)
                yield pa.RecordBatch.from_arrays([pa.array(asking), pa.array(near), pa.array(score), pa.array([leaf[m] for m in near.tolist()], pa.int64())], names=["query_id", "vec_id", "score", "leaf"])

    true = _top(index.mapInArrow(nearest, "query_id long, vec_id long, score double, leaf long"), k).select("query_id", "leaf").collect()
    order = {int(i): {leaf: r for r, leaf in enumerate(tree.best_bins(v, tree.n_leaves))} for i, v in zip(ids, q, strict=True)}
    ranks = np.sort([order[r.query_id][r.leaf] for r in true])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def op1_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose vec_id is divisible by 20."""
    return search(read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
