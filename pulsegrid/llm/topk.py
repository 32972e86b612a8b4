"""Exact top-k search by inner product: ball-tree branch and bound per shard.

Vectors are dealt to shards of bounded size: each goes to the nearest of a few sampled vectors, and groups above the size of
a shard are split by a hash.  Each shard's ball tree is built once and kept in the shared folder with its root ball.

For a query the root balls give an upper bound q.c + |q| r (c: centre, r: radius) on what a shard may hold.  A first wave
sends each query to its most promising shard; the kth scores found there are shared: the following waves, each of four
times as many shards, send a query only to the shards whose bound reaches its current kth score.  In a shard a query visits
the nodes in the order of their bounds until none reaches the kth score.  Ties at the kth score are never pruned; they go
to the smaller id.  Beyond ``ROOTS`` shards the root balls are taken in groups of so many, one after the other.

Cases: vectors that are null, or hold a null or a non-finite component, take no part, nor do rows without an id.  Rows that
share an id are candidates and queries each for itself; a row is never its own result, but may be that of its copies.
Vectors are compared with those of their own length only; empty ones score 0.  Queries with fewer than k candidates
return all.  An empty table gives no rows.  Scores are exact as long as they fit a long.  Columns beyond those named are
ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut_lineage

#: Vectors per shard, queries per block, vectors that shards are grouped around, root balls that a task holds at most.
SHARD, BLOCK, PIVOTS, ROOTS = 16_384, 4_096, 1_024, 20_000
LEAF = 128


class BallTree:
    """Balls over integer vectors, halved along the direction from a far point to the one farthest from it."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray):
        order, nodes, self.kids = np.arange(len(points)), [(0, len(points))], []
        centres, radii = [], []
        for lo, hi in nodes:  # grows while it is read
            own = points[order[lo:hi]].astype(np.float64)
            centre = own.mean(axis=0)
            apart = own - centre
            far = np.einsum("ij,ij->i", apart, apart)
            centres.append(centre)
            radii.append(float(np.sqrt(far.max())))
            if hi - lo <= LEAF or far.max() == 0:
                self.kids.append(None)
                continue
            one = own[far.argmax()]
            gap = own - one
            axis = own[np.einsum("ij,ij->i", gap, gap).argmax()] - one
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own @ axis, mid)]
            self.kids.append((len(nodes), len(nodes) + 1))
            nodes += [(lo, lo + mid), (lo + mid, hi)]
        self.nodes, self.rows, self.ids, self.points = nodes, rows[order], ids[order], points[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        # Products of doubles are exact as long as sums stay below 2**53.
        self.widest = float(np.abs(points).max(initial=0))

    def search(self, query: np.ndarray, own_row: int, k: int, floor: float) -> list[tuple[int, int, int]]:
        """The k best (score, -id, -row) but the query's own row, among scores of at least ``floor``."""
        q = query.astype(np.float64)
        exact = self.widest * float(np.abs(q).max(initial=0)) * len(q) < 2**53
        points = self.points_double if exact else self.points
        scale = 1e-9 * (self.widest + 1) * (float(np.abs(q).sum()) + 1)  # rounding of the bounds
        bounds = self.centres @ q + np.sqrt(q @ q) * self.radii + scale
        best: list[tuple[int, int, int]] = []  # a heap whose first is the kth
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            if (kids := self.kids[node]) is not None:
                for kid in kids:
                    if bounds[kid] >= floor:
                        heapq.heappush(heap, (-bounds[kid], kid))
                continue
            lo, hi = self.nodes[node]
            scores = points[lo:hi] @ (q if exact else query)
            for i in np.flatnonzero(scores >= floor):
                entry = int(scores[i]), -int(self.ids[lo + i]), -int(self.rows[lo + i])
                if entry[2] == -own_row:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best

    @property
    def points_double(self) -> np.ndarray:
        if not hasattr(self, "_double"):
            self._double = self.points.astype(np.float64)
        return self._double


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), len(flat) // max(len(values), 1))


def _nearest(pivots: dict[int, np.ndarray]):
    """row, id, dim, vec -> the same with cell, the number of the nearest pivot of that length."""

    def run(batches):
        for batch in batches:
            dims, vecs = batch.column("dim").to_numpy(), batch.column("vec")
            cells = np.zeros(len(dims), np.int32)
            for dim in set(dims.tolist()) & set(pivots):
                at = np.flatnonzero(dims == dim)
                p = pivots[dim]
                for part in np.array_split(at, len(at) // 2048 + 1):
                    points = _matrix(vecs.take(pa.array(part))).astype(np.float64)
                    cells[part] = ((p * p).sum(axis=1) - 2 * points @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    return run


def _built(key: tuple, rows: pa.Table) -> pa.Table:
    dim, shard = (x.as_py() for x in key)
    vecs = _matrix(rows.column("vec"))
    tree = BallTree(rows.column("row").to_numpy(), rows.column("id").to_numpy(), vecs)
    tree.points = tree.points.astype(np.min_scalar_type(-int(tree.widest) - 1)) if tree.widest < 2**31 else tree.points
    made = [dim], [shard], [pickle.dumps(vars(tree))], [tree.centres[0].tolist()], [float(tree.radii[0])]
    return pa.table([pa.array(c, t) for c, t in zip(made, (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.float64()), strict=True)], ["dim", "shard", "tree", "centre", "radius"])


def _sent(roots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: int, upto: int):
    """row, dim, q, floor -> row, dim, q, floor, shard: the shards at these places of a query's order by bound that may reach its floor."""

    def run(batches):
        for batch in batches:
            queries, shards = [], []
            floors = batch.column("floor").to_numpy(zero_copy_only=False)
            for i, (dim, q) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("q"), strict=True)):
                if dim not in roots:
                    continue
                numbers, centres, radii = roots[dim]
                q = np.array(q.as_py(), np.float64)
                bounds = centres @ q + np.sqrt(q @ q) * radii
                bounds += 1e-9 * (np.abs(bounds) + 1)
                places = np.argsort(-bounds, kind="stable")[first:upto]
                if not np.isnan(floors[i]):
                    places = places[bounds[places] >= floors[i]]
                queries += [i] * len(places)
                shards += numbers[places].tolist()
            out = batch.take(pa.array(queries, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(shards, pa.int64())], [*out.schema.names, "shard"])

    return run


def _searched(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: the shard's tree.  right: block rows row, q, floor."""
        out: list[list[int]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            tree = BallTree.__new__(BallTree)
            vars(tree).update(pickle.loads(left.column("tree")[0].as_py()))
            floors = right.column("floor").to_pylist()
            for row, query, floor in zip(right.column("row").to_pylist(), _matrix(right.column("q")), floors, strict=True):
                for score, minus, found in tree.search(query, row, k, -np.inf if floor is None else floor):
                    for column, value in zip(out, (row, -found, -minus, score), strict=True):
                        column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["row", "found", "id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id", "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shard_trees(points: DataFrame, shard: int = SHARD, pivots: int = PIVOTS) -> DataFrame:
    """points: row, id, dim, vec.  Returns dim, shard, tree (pickled), centre, radius: a row per shard."""
    n = points.count()
    most = max(1, min(pivots, -(-n // shard)))
    part = F.pmod(F.xxhash64(F.lit("pivot"), "row"), F.lit(1_000_000)) < int(4e6 * most / max(n, 1)) + 1
    sampled: dict[int, list] = {}
    for r in points.where(part).select("dim", "vec").limit(most).collect():  # most: a bound; any choice is right
        sampled.setdefault(r["dim"], []).append(r["vec"])
    near = {dim: np.array(v, np.float64).reshape(len(v), dim) for dim, v in sampled.items()}
    cells = cut_lineage(points.select("row", "id", "dim", "vec").mapInArrow(_nearest(near), "row long, id long, dim int, vec array<long>, cell int"))
    sizes = cells.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).alias("parts"))
    number = F.xxhash64("cell", F.pmod(F.xxhash64("row"), F.col("parts")))
    dealt = cells.join(sizes, ["dim", "cell"]).select("dim", number.alias("shard"), "row", "id", "vec")
    return dealt.groupBy("dim", "shard").applyInArrow(_built, "dim int, shard long, tree binary, centre array<double>, radius double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard: int = SHARD, block: int = BLOCK, roots: int = ROOTS) -> DataFrame:
    """vectors: id, vec (array<long>).  is_query: which rows are queries.  Returns query_id, rank (int, from 1), id, score."""
    usable = vectors.where("id IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL)")
    points = cut_lineage(usable.select(F.monotonically_increasing_id().alias("row"), "id", "vec", F.size("vec").alias("dim"), is_query.alias("asked")))
    asked = points.where("asked").select("row", F.col("id").alias("query_id"), F.col("vec").alias("q"), "dim")
    trees = cut_lineage(shard_trees(points, shard))
    n_blocks = max(1, -(-asked.count() // block))
    in_block = F.pmod(F.xxhash64(F.lit(1), F.col("row")), F.lit(n_blocks)).cast("int")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    held = trees.select("dim", "shard", "tree", blocks.alias("block")).groupBy("dim", "shard", "block")
    best = None
    groups = -(-trees.count() // roots)
    balls = trees.select("dim", "shard", "centre", "radius").withColumn("group", F.pmod(F.xxhash64("dim", "shard"), F.lit(max(groups, 1))))
    for group in range(groups):
        here: dict[int, list] = {}
        for r in balls.where(F.col("group") == group).orderBy("dim", "shard").collect():  # about ``roots`` rows
            here.setdefault(r["dim"], []).append((r["shard"], r["centre"], r["radius"]))
        balls_of = {d: (np.array([x[0] for x in v], np.int64), np.array([x[1] for x in v], np.float64).reshape(len(v), d), np.array([x[2] for x in v])) for d, v in here.items()}
        first, size, most = 0, 1, max((len(v[0]) for v in balls_of.values()), default=0)
        while first < most:
            floors = asked.withColumn("floor", F.lit(None).cast("double"))
            if best is not None:
                reached = best.where(F.col("rank") == k).select(F.col("row").alias("of"), F.col("score").cast("double").alias("floor"))
                floors = asked.join(reached, F.col("row") == F.col("of"), "left")
            sent = floors.select("row", "dim", "q", "floor").mapInArrow(_sent(balls_of, first, first + size), "row long, dim int, q array<long>, floor double, shard long")
            found = held.cogroup(sent.withColumn("block", in_block).groupBy("dim", "shard", "block")).applyInArrow(_searched(k), "row long, found long, id long, score long")
            best = cut_lineage(_best(found if best is None else found.unionByName(best.drop("rank")), k))
            first, size = first + size, size * 4
    if best is None:
        return asked.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).limit(0)
    return best.join(asked.select("row", "query_id"), "row").select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
