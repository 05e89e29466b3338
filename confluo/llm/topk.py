"""Exact top-k search by inner product: a ball tree per shard, branch and bound, shared kth scores.

Vectors are dealt to cells, each to the nearest of at most CENTRES vectors, and large cells to several shards. The
centres are chosen far from each other among DRAWN times as many vectors, drawn by a hash of the id. A task searches one block of queries in one shard: it builds a ball tree over the shard, bounds a node's
scores by query . centre + |query| * radius, and visits leaves in descending order of that bound until it falls below
the query's current kth score. Each query is searched first in a shard of the cell whose bound is highest; the kth score
found there is the floor it carries to all others. Cells are balls too, so a query goes only to those whose bound
reaches its floor, and a shard only to blocks with such a query; what is ruled out is never shuffled. Vectors spread
evenly rule out little; then every query meets every shard, as an exact answer needs.

Scores are integers: components are floor(scale * x), and products are summed exactly.

Defined cases: rows whose vector is null or holds a null or non-finite component, and rows without an id, take no
part; vectors of another length than the query's are no candidates of it; of several query rows of one id that of the
smallest vector asks; a query never finds rows of its own id; repeated candidate rows are found once each; ties go to
the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty table; other columns, whatever
their names, are not carried. Sums beyond 64 bits are not defined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confluo.llm.common import stored

LEAF = 32
CENTRES, DRAWN = 256, 8
Cells = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by dimension: cell numbers, centres, radii


def _integers(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * values.astype(np.float64)).astype("<i8")


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """values cut at offsets, as one binary each."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((8 * offsets).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which centre is nearest to each row, and a bound of how far it is."""
    best = (x @ (-2 * centres.T) + (centres**2).sum(axis=1)).argmin(axis=1)
    away = np.sqrt(((x - centres[best]) ** 2).sum(axis=1))
    return best, away * (1 + 1e-9) + 1e-9


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the farthest from those before it; fewer, if no others differ."""
    chosen, away = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def dealt(vectors: DataFrame, cells: Cells, scale: float) -> DataFrame:
    """(id, v) -> (id, dim, vec, cell, away) of rows that take part: integers as little-endian 64-bit numbers, the cell
    (-1 where no centre has the length) and the distance from its centre."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0] : offsets[-1]]  # nulls are NaN
            offsets = offsets - offsets[0]
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = (bad[offsets[1:]] == bad[offsets[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            whole = _integers(np.where(np.isfinite(values), values, 0.0), scale)
            dims, cell, away = np.diff(offsets), np.full(len(good), -1), np.zeros(len(good))
            for dim, (numbers, centres, _) in cells.items():
                own = np.flatnonzero(good & (dims == dim))
                if len(own):
                    x = whole[(offsets[own][:, None] + np.arange(dim)).ravel()].reshape(len(own), dim).astype(np.float64)
                    best, away[own] = _nearest(x, centres)
                    cell[own] = numbers[best]
            columns = [batch.column(0), pa.array(dims.astype(np.int32)), _binary(whole, offsets), pa.array(cell.astype(np.int32)), pa.array(away)]
            yield pa.record_batch([c.filter(pa.array(good)) for c in columns], names=["id", "dim", "vec", "cell", "away"])

    return vectors.mapInArrow(run, "id long, dim int, vec binary, cell int, away double")


def reached(queries: DataFrame, cells: Cells, first: bool) -> DataFrame:
    """queries (query_id, dim, vec, floor, ...) with cell: only the one of the highest bound, or every one whose bound
    reaches the floor."""
    names = [*queries.columns, "cell"]
    at = {c: i for i, c in enumerate(queries.columns)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, floor = batch.column(at["dim"]).to_numpy(), batch.column(at["floor"]).to_numpy()
            rows, found = [], []
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                if dim not in cells:
                    rows.append(own)
                    found.append(np.full(len(own), -1))
                    continue
                numbers, centres, radii = cells[dim]
                q = _matrix(batch.column(at["vec"]).take(pa.array(own)), dim).astype(np.float64)
                near, norms = q @ centres.T, np.sqrt((q**2).sum(axis=1))[:, None]
                bound = near + norms * radii + 1e-9 * (1 + np.abs(near) + norms * (radii + np.sqrt((centres**2).sum(axis=1))))
                who, which = (np.arange(len(own)), bound.argmax(axis=1)) if first else np.nonzero(bound >= floor[own][:, None])
                rows.append(own[who])
                found.append(numbers[which])
            index = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.record_batch([*[c.take(index) for c in batch.columns], pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32))], names=names)

    return queries.mapInArrow(run, queries.withColumn("cell", F.lit(0)).schema)


class BallTree:
    """Leaves of at most LEAF rows under balls with centre and radius, in the arrays of a binary tree."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.centre, self.radius, self.children, self.span = [], [], [], []
        self._grow(0, len(x))
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _grow(self, a: int, b: int) -> int:
        rows = self.x[self.order[a:b]]
        node = len(self.centre)
        middle = rows.mean(axis=0)
        away = ((rows - middle) ** 2).sum(axis=1)
        self.centre.append(middle)
        self.radius.append(float(np.sqrt(away.max())))
        self.children.append((-1, -1))
        self.span.append((a, b))
        if b - a > LEAF and away.max() > 0:
            # split at the median of the projection on the line through the two far ends
            one = rows[away.argmax()]
            other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            along = rows @ (other - one)
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(along, half)]
            self.children[node] = (self._grow(a, a + half), self._grow(a + half, b))
        elif b - a > LEAF:  # equal vectors
            half = (b - a) // 2
            self.children[node] = (self._grow(a, a + half), self._grow(a + half, b))
        return node

    def bounds(self, queries: np.ndarray, norms: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query with what lies below its node."""
        centre = self.centre[nodes]
        near = np.einsum("qd,qd->q", queries, centre)
        slack = 1e-9 * (1 + np.abs(near) + norms * (self.radius[nodes] + np.sqrt((centre**2).sum(axis=1))))
        return near + norms * self.radius[nodes] + slack


def search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of x, score) of each query's k best rows that reach its floor."""
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, x.shape[1]) < 2.0**53
    tree = BallTree(x.astype(np.float64))
    points = tree.x if exact else x
    q = queries.astype(np.float64)
    norms = np.sqrt((q**2).sum(axis=1))
    low = np.iinfo(np.int64).min
    best = np.full((len(q), k), low, np.int64)
    rows = np.full((len(q), k), -1, np.int64)
    rank_id = np.append(ids, np.iinfo(np.int64).max)  # row -1 is the last of any tie
    kth = np.maximum(best[:, -1], floor)
    leaf_of = [i for i, c in enumerate(tree.children) if c[0] < 0]
    members = np.full((len(tree.children), LEAF), -1, np.int64)
    for i in leaf_of:
        a, b = tree.span[i]
        members[i, : b - a] = tree.order[a:b]
    children = np.array(tree.children)

    def visit(who: np.ndarray, leaves: np.ndarray) -> None:
        """Score the rows of one leaf for each of some queries."""
        at = members[leaves]
        score = np.einsum("qld,qd->ql", points[at], (q if exact else queries)[who]).astype(np.int64)
        barred = (at < 0) | (ids[at] == query_ids[who][:, None]) | (score < floor[who][:, None])
        score[barred] = low
        at = np.where(barred, -1, at)
        all_scores, all_rows = np.hstack([best[who], score]), np.hstack([rows[who], at])
        order = np.lexsort((rank_id[all_rows], -all_scores.astype(np.float64) if exact else ~all_scores), axis=1)[:, :k]
        best[who], rows[who] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_rows, order, 1)
        kth[who] = np.maximum(best[who, -1], floor[who])

    # dive to the most promising leaf for a first kth score
    node = np.zeros(len(q), np.int64)
    while (inner := np.flatnonzero(children[node, 0] >= 0)).size:
        pair = children[node[inner]]
        left = tree.bounds(q[inner], norms[inner], pair[:, 0]) >= tree.bounds(q[inner], norms[inner], pair[:, 1])
        node[inner] = np.where(left, pair[:, 0], pair[:, 1])
    visit(np.arange(len(q)), node)
    first = node
    # then branch: open every node whose bound reaches the kth score, level by level, down to leaves
    who, at = np.arange(len(q)), np.zeros(len(q), np.int64)
    pairs, tops = [], []
    while len(who):
        top = tree.bounds(q[who], norms[who], at)
        keep = top >= kth[who]
        who, at, top = who[keep], at[keep], top[keep]
        is_leaf = children[at, 0] < 0
        fresh = is_leaf & (at != first[who])
        pairs.append(np.stack([who[fresh], at[fresh]]))
        tops.append(top[fresh])
        who, at = np.repeat(who[~is_leaf], 2), children[at[~is_leaf]].reshape(-1)
    who, at = np.concatenate(pairs, axis=1)
    top = np.concatenate(tops)
    # and bound: leaves in descending order of bound, one a query and round, while they reach the kth score
    order = np.lexsort((-top, who))
    who, at, top = who[order], at[order], top[order]
    turn = np.arange(len(who)) - np.searchsorted(who, who)
    for r in range(int(turn.max()) + 1 if len(turn) else 0):
        now = np.flatnonzero((turn == r) & (top >= kth[who]))
        if not len(now):
            break  # bounds only fall from here on
        for a in range(0, len(now), 1024):
            visit(who[now[a : a + 1024]], at[now[a : a + 1024]])
    found = np.nonzero(rows >= 0)
    return found[0], rows[found], best[found]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def _search_groups(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """data (dim, cell, part, id, vec), queries (dim, cell, part, block, query_id, vec, floor) -> best rows of each block
    in each shard that it asks."""
    names = ["query_id", "vec_id", "score"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        dim = asked.column("dim")[0].as_py()
        ids, query_ids = rows.column("id").to_numpy(), asked.column("query_id").to_numpy()
        who, at, score = search(_matrix(rows.column("vec"), dim), ids, _matrix(asked.column("vec"), dim), query_ids, k, asked.column("floor").to_numpy())
        return pa.table([query_ids[who], ids[at], score], schema=schema)

    shard = ["dim", "cell", "part"]
    key = [*shard, "block"]
    wanted = stored(queries.select(*key).distinct(), "topk-wanted")
    candidates = data.join(wanted, shard).select(*key, "id", "vec")
    return candidates.groupBy(*key).cogroup(queries.select(*key, "query_id", "vec", "floor").groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0,
    shards: int = 64, least_rows: int = 1024, most_bytes: int = 32 << 20, block_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each row for which is_query, a condition on id, holds."""
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    counts = raw.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    rows = max(least_rows, min(-(-counts["n"] // shards), most_bytes // (8 * max(1, counts["dim"] or 1))))
    n_centres = max(1, min(CENTRES, counts["n"] // rows))
    drawn = raw.where("id IS NOT NULL AND size(v) > 0").orderBy(F.xxhash64("id", F.lit(3)), "id", "v").limit(DRAWN * n_centres).collect()
    usable = [r["v"] for r in drawn if None not in r["v"] and np.isfinite(r["v"]).all()]
    cells: Cells = {}
    for dim in sorted({len(v) for v in usable}):
        own = [v for v in usable if len(v) == dim]
        centres = _far_apart(_integers(np.array(own), scale).astype(np.float64), max(1, n_centres * len(own) // len(usable)))
        cells[dim] = np.arange(len(centres)), centres, np.zeros(0)
    data = stored(dealt(raw, cells, scale), "topk-vectors")
    sizes = data.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"), F.max("away").alias("radius"))
    sizes = stored(sizes, "topk-cells")
    # at most CENTRES rows; a cell that nobody is nearest to is not asked
    known = {(r["dim"], r["cell"]): r["radius"] for r in sizes.where("cell >= 0").collect()}
    for dim, (numbers, centres, _) in cells.items():
        used = np.array([n for n in numbers.tolist() if (dim, n) in known], np.int64)
        cells[dim] = used, centres[used], np.array([known[dim, n] for n in used.tolist()])
    parts = sizes.select("dim", "cell", "parts")
    data = data.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    low = F.lit(-(1 << 63))
    asked = data.where(is_query).groupBy(F.col("id").alias("query_id")).agg(F.min(F.struct("dim", "vec")).alias("v")).select("query_id", "v.*")
    # cells fill blocks in turn, so that about block_rows queries share a copy of a shard, and in a large cell only its own
    asked = reached(asked.withColumn("floor", low), cells, True).join(parts, ["dim", "cell"])
    crowd = asked.groupBy("dim", "cell").agg(F.count("*").alias("crowd"))  # one row a cell
    crowd = crowd.withColumn("before", F.sum("crowd").over(Window.orderBy("dim", "cell")) - F.col("crowd"))
    block = F.floor(F.col("before") / block_rows) + F.pmod(F.xxhash64("query_id", F.lit(5)), F.ceil(F.col("crowd") / block_rows))
    asked = asked.join(crowd, ["dim", "cell"]).withColumn("block", block).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts", "crowd", "before")
    asked = stored(asked, "topk-queries")
    home = stored(_search_groups(data, asked, k), "topk-home")
    floors = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(low).alias("floor"))
    away = asked.withColumnsRenamed({"cell": "home", "part": "seat"}).drop("floor").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", low))
    away = reached(away, cells, False).join(parts, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    away = stored(away.where("cell <> home OR part <> seat").drop("home", "seat", "parts"), "topk-away")
    found = home.union(_search_groups(data, away, k))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
