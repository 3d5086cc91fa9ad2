"""Operator 5: nearest neighbours by a hierarchical k-means tree with best-bin-first search."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import arrow_map, hash_sample, materialize, ship

#: Rows and queries of one block: what a task compares at once. Neighbouring leaves share a block, a leaf of more rows has several.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 1024


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """k-means with k-means++ seeding; returns centres and each row's centre. Fewer distinct rows give fewer centres."""
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and d.max() > 0:
        centres.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        own = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c, nearest(x, c)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)


@dataclass
class Tree:
    """Inner nodes hold their children's centres; a leaf is a number."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)  # >= 0: node, < 0: leaf -1 - n
    leaves: int = 0

    @classmethod
    def fit(cls, sample: np.ndarray, leaf_rows: float, branching: int = 8, seed: int = 5) -> Tree:
        """Split until a node has about ``leaf_rows`` sample rows or all of its rows are equal."""
        tree, rng = cls(), np.random.default_rng(seed)

        def grow(x: np.ndarray) -> int:
            parts = None
            if len(x) > leaf_rows and len(x) > 1:
                c, own = lloyd(x, int(min(branching, max(2, -(-len(x) // leaf_rows)))), rng)
                parts = [np.flatnonzero(own == k) for k in range(len(c))]
                keep = [k for k, p in enumerate(parts) if len(p)]
                if len(keep) > 1:
                    node = len(tree.centres)
                    tree.centres.append(c[keep])
                    tree.children.append([])
                    tree.children[node] = [grow(x[parts[k]]) for k in keep]
                    return node
            tree.leaves += 1
            return -tree.leaves

        root = grow(sample)
        if root < 0:
            tree.centres, tree.children = [np.zeros((1, sample.shape[1]))], [[-1]]
        return tree

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            own = nearest(x[rows], self.centres[node])
            for k, child in enumerate(self.children[node]):
                hit = rows[own == k]
                if len(hit):
                    if child < 0:
                        out[hit] = -1 - child
                    else:
                        todo.append((child, hit))
        return out

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves, best bin first: a priority queue holds every branch not taken, by its centre's distance."""
        queue, found, tick = [(0.0, 0, 0)], [], 1
        while queue and len(found) < leaves:
            _, _, node = heapq.heappop(queue)
            while node >= 0:
                d = ((self.centres[node] - q) ** 2).sum(1)
                best = int(d.argmin())
                for k, child in enumerate(self.children[node]):
                    if k != best:
                        heapq.heappush(queue, (float(d[k]), tick, child))
                        tick += 1
                node = self.children[node][best]
            found.append(-1 - node)
        return found


def _top(ids: np.ndarray, d: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distances, ties to the smaller id, each id once and ``own`` never."""
    if own is not None:
        keep = ids != own
        ids, d = ids[keep], d[keep]
    if len(d) > 4 * k:
        cut = np.partition(d, k - 1)[k - 1]
        near = d <= cut
        if len(np.unique(ids[near])) >= k:
            ids, d = ids[near], d[near]
    order = np.lexsort((ids, d))
    ids, d = ids[order], d[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], d[first]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((m - q) ** 2).sum(1))


def search(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", is_query=None, k: int = 10,
    sample_rows: int = 16_384,
    leaf_rows: int = 256, recall: float = 0.96, calibration_queries: int = 96, branching: int = 8,
) -> DataFrame:
    """The ``k`` nearest other rows of each query row: (query_id, rank, vec_id, score), score being the Euclidean distance in double precision.

    The tree is fitted on a sample of at most ``sample_rows`` rows (by a hash of the id), so what is broadcast is bounded; every row
    is indexed. Leaves hold about ``leaf_rows`` rows, or more once the sample is outgrown. The number of leaves a query visits
    is calibrated: for ``calibration_queries`` rows the true neighbours are found by brute force, and the visits widen
    until a share of ``recall`` of them is covered.

    Index rows and visiting queries meet in blocks of neighbouring leaves, of about ``BLOCK_ROWS`` rows and ``BLOCK_QUERIES`` queries; a larger leaf has
    several blocks, so a vector that a third of all rows share spreads over many tasks. Each block returns a query's ``k`` best among its visited leaves; they are merged per query.

    Defined cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component take
    no part; a null id takes no part; rows that share an id are one candidate, at its smallest distance; fewer candidates
    give fewer rows; ties go to the smaller id; other columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    is_query = F.col(f"`{id_col}`") % 100 == 0 if is_query is None else is_query
    v = F.col(f"`{vector_col}`")
    fine = F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.where(fine & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint")
        .alias("id"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    length = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    rows, total = rows.where(F.size("v") == length.n), length.c
    sample = hash_sample(rows.select("id", "v"), sample_rows, total, "id").toArrow()
    x = _matrix(sample["v"])
    tree = Tree.fit(x, max(1.0, leaf_rows * len(x) / total), branching)
    shared = spark.sparkContext.broadcast(tree)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("leaf", pa.array(shared.value.assign(_matrix(batch.column("v")))))

    index = materialize(arrow_map(rows, place, "id bigint, v array<double>, q boolean, leaf bigint"), "tree-index")

    # calibration: true neighbours of a few rows, each partition's best first
    few = slice(0, min(calibration_queries, len(x)))
    cq, cid = spark.sparkContext.broadcast(x[few]), sample["id"].to_numpy()[few]

    def truth(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, ids, leaf = _matrix(batch.column("v")), batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
        out = []
        for n, q in enumerate(cq.value):
            d = distances(m, q)
            best = np.lexsort((ids, d))[: 2 * k]
            out.extend((n, int(ids[b]), float(d[b]), int(leaf[b])) for b in best if ids[b] != cid[n])
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True),
                (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)] if out
                else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())],
                names=["n", "id", "d", "leaf"])

    ranked = arrow_map(index, truth, "n bigint, id bigint, d double, leaf bigint").withColumn("r",
        F.row_number().over(Window.partitionBy("n").orderBy("d", "id")))
    needed = []
    orders: dict[int, dict[int, int]] = {}
    for r in ranked.where(F.col("r") <= k).collect():  # at most calibration_queries * k rows
        order = orders.setdefault(r.n, {leaf: at for at, leaf in enumerate(tree.visit(x[r.n], tree.leaves))})
        needed.append(order[r.leaf] + 1)
    visits = int(np.quantile(needed, recall, method="higher")) if needed else 1

    # rows of each leaf: at most one row a leaf reaches the driver, and the sample bounds the leaves
    sizes = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        sizes[r.leaf] = r.n
    group, members_of, filled = np.zeros(tree.leaves, np.int64), [0], 0
    for leaf, n in enumerate(sizes.tolist()):
        if filled and filled + n > BLOCK_ROWS:
            members_of.append(0)
            filled = 0
        group[leaf] = len(members_of) - 1
        members_of[-1] += n
        filled += n
    grouping = spark.sparkContext.broadcast(group)

    def plan(batch: pa.RecordBatch) -> pa.RecordBatch:
        t, of = shared.value, grouping.value
        ids, vectors_, groups, leaves = batch.column("id").to_pylist(), batch.column("v"), [], []
        row = []
        for k, q in enumerate(_matrix(vectors_)):
            seen = np.array(t.visit(q, visits))
            for g in np.unique(of[seen]).tolist():
                row.append(k)
                groups.append(g)
                leaves.append(seen[of[seen] == g])
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[k] for k in row], pa.int64()), vectors_.take(pa.array(row, pa.int32())),
                pa.array(groups, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], names=["id", "v", "g", "leaves"])

    visiting = materialize(arrow_map(index.where("q"), plan,
        "id bigint, v array<double>, g bigint, leaves array<bigint>"), "tree-visits")
    asked = {r.g: r.n for r in visiting.groupBy("g").agg(F.count("*").alias("n")).collect()}  # at most a row a leaf
    table = [(leaf, int(g), max(1, -(-members_of[g] // BLOCK_ROWS)),
        max(1, -(-asked[g] // BLOCK_QUERIES))) for leaf, g in enumerate(group.tolist()) if g in asked]
    blocks = spark.createDataFrame(table,
        "leaf bigint, g bigint, rb int, qb int") if table else spark.createDataFrame([],
        "leaf bigint, g bigint, rb int, qb int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.col(n)).cast("int")
    left = visiting.join(F.broadcast(blocks.drop("leaf").distinct()), "g").withColumn("b", mine("qb")).withColumn("a",
        spread("rb"))
    right = index.join(F.broadcast(blocks), "leaf").withColumn("a", mine("rb")).withColumn("b", spread("qb"))
    keys = ["g", "a", "b"]

    def compare(queries: pa.Table, members: pa.Table) -> pa.Table:
        out_q, out_i, out_d = [], [], []
        if queries.num_rows and members.num_rows:
            m, ids, leaf = _matrix(members["v"]), members["id"].to_numpy(), members["leaf"].to_numpy()
            for own, q, seen in zip(queries["id"].to_pylist(), _matrix(queries["v"]), queries["leaves"].to_pylist(),
                strict=True):
                near = np.flatnonzero(np.isin(leaf, seen))
                i, d = _top(ids[near], distances(m[near], q), k, own)
                out_q.append(np.full(len(i), own))
                out_i.append(i)
                out_d.append(d)
        flat = lambda parts, t: pa.array(np.concatenate(parts) if parts else np.empty(0), t)
        return pa.table({"query_id": flat(out_q, pa.int64()), "vec_id": flat(out_i, pa.int64()),
            "score": flat(out_d, pa.float64())})

    ship(spark)
    found = left.select(*keys, "id", "v",
        "leaves").groupBy(*keys).cogroup(right.select(*keys, "id", "v", "leaf").groupBy(*keys)).applyInArrow(compare,
        "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
