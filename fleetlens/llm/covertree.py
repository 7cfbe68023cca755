"""Operator 7, exact top-k search by dual cover trees.

The data are cut into cells by the top nodes of a cover tree: a tree over a
bounded sample gives the cells' centres, every vector joins its nearest
centre, and a cell's covering radius is the largest distance in it. Cells of
more than ``CELL`` vectors are dealt into parts of that size.

Two passes follow. In the first, each query meets one part of the cell whose
centre it scores highest with, for a first k-th score. With centre c and
radius r no inner product of a query q with the cell exceeds ``q.c + |q| r``;
in the second pass a query goes to the cells whose bound reaches its k-th
score, and to no others. The data are shuffled once; a part's task holds its
vectors and a cover tree over them and streams the queries that come to it
in blocks, so the number of queries bounds nothing.

In a task a block of queries has a cover tree of its own and both trees are
walked together, level by level: a pair of nodes with centres q and p and
radii s and r is dropped when ``q.p + |q| r + |p| s + r s`` is below the worst
k-th score of the query node's group. The leaf pairs that remain are scored,
best bound first. A node's points lie within its covering radius; its
children's centres are more than half of it apart and cover half of it each.
A node that has more than ``FAN`` children by that rule gives the rest to
the nearest of them, and their radii are measured, so the bounds hold.

Vectors become integers floor(``scale`` * x) and scores integer inner
products, exact while they stay below 2**53 (else an error is raised).

Edge cases: null vectors, null keys and vectors holding null or non-finite
components take no part; vectors of different lengths are not compared;
equal scores go to the smaller key; a query never meets rows of its own key;
repeated rows of one key count once; fewer than k candidates: all of them;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize, spread

LEAF, QUERY_LEAF = 32, 4
FAN = 64
CELL = 4096  # vectors of a part
QUERY_BLOCK = 1024
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 32 << 20  # what the centres are chosen from
MAX_CELLS = 1024
NONE = -np.inf


class CoverTree:
    """Nodes in arrays, breadth first: centre (a point), radius, its points ``order[lo:hi]``, its children's numbers."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.square = np.einsum("ij,ij->i", x, x)
        order = np.arange(len(x))
        centre, radius, lo, hi, child = [0], [float(self._distance(order, 0).max(initial=0))], [0], [len(x)], []
        n = 0
        while n < len(centre):
            child.append((len(centre), len(centre)))
            a, b = lo[n], hi[n]
            if b - a > leaf and radius[n] > 0:
                points = order[a:b]
                centres, whose, far = self._split(points, centre[n], radius[n])
                by = np.argsort(whose, kind="stable")
                order[a:b], far, whose = points[by], far[by], whose[by]
                cuts = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1], True])
                child[n] = len(centre), len(centre) + len(cuts) - 1
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    centre.append(int(centres[whose[i]]))
                    radius.append(float(far[i:j].max()))
                    lo.append(a + i)
                    hi.append(a + j)
            n += 1
        self.order, self.lo, self.hi = order, np.array(lo), np.array(hi)
        self.centre, self.r = np.array(centre), np.array(radius)
        self.first, self.last = (np.array(c) for c in zip(*child))
        self.c, self.norm = x[self.centre], np.sqrt(self.square[self.centre])
        self.is_leaf = self.first == self.last

    def _distance(self, points: np.ndarray, centre: int) -> np.ndarray:
        d = self.square[points] + self.square[centre] - 2 * (self.x[points] @ self.x[centre])
        return np.sqrt(np.maximum(d, 0))

    def _split(self, points: np.ndarray, centre: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centres, each point's centre, its distance): centres more than half the radius apart, the farthest point next."""
        near = self._distance(points, centre)
        whose = np.zeros(len(points), np.int64)
        centres = [centre]
        while len(centres) < FAN and near.max() > radius / 2:
            far = int(near.argmax())
            d = self._distance(points, int(points[far]))
            closer = d < near
            whose[closer], near[closer] = len(centres), d[closer]
            centres.append(int(points[far]))
        return np.array(centres), whose, near


def bounds(a: CoverTree, m: np.ndarray, b: CoverTree, n: np.ndarray) -> np.ndarray:
    """The most that any inner product between nodes m of a and n of b can be."""
    top = np.einsum("ij,ij->i", a.c[m], b.c[n]) + a.norm[m] * b.r[n] + b.norm[n] * a.r[m] + a.r[m] * b.r[n]
    return top + 1e-9 * (1 + np.abs(top))  # rounding of the radii


def dual_search(a: CoverTree, q_ids: np.ndarray, floor: np.ndarray, b: CoverTree, p_ids: np.ndarray, k: int
                ) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, pairs scored): each query's best k points among those that reach its ``floor``; -inf marks an empty
    place."""
    best = np.full((len(q_ids), k), NONE)
    ids = np.full((len(q_ids), k), np.iinfo(np.int64).max)

    def worst() -> np.ndarray:
        """The least k-th score that a query of each node still needs."""
        need = np.maximum(best[:, -1], floor)[a.order]
        out = np.empty(len(a.lo))
        leaves = np.flatnonzero(a.is_leaf)
        leaves = leaves[np.argsort(a.lo[leaves])]  # they cut the order into pieces
        out[leaves] = np.minimum.reduceat(need, a.lo[leaves])
        for i in np.flatnonzero(~a.is_leaf)[::-1]:  # children come after their parents
            out[i] = out[a.first[i]:a.last[i]].min()
        return out

    m, n = np.zeros(1, np.int64), np.zeros(1, np.int64)
    need = worst()
    ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(m):
        nxt = []
        for lo in range(0, len(m), 1 << 14):
            i, j = m[lo:lo + (1 << 14)], n[lo:lo + (1 << 14)]
            top = bounds(a, i, b, j)
            keep = top >= need[i]
            i, j, top = i[keep], j[keep], top[keep]
            both = a.is_leaf[i] & b.is_leaf[j]
            ready.append((i[both], j[both], top[both]))
            i, j = i[~both], j[~both]
            left = b.is_leaf[j] | (~a.is_leaf[i] & (a.r[i] > b.r[j]))
            for tree, split, stay, of_a in ((a, i[left], j[left], True), (b, j[~left], i[~left], False)):
                count = tree.last[split] - tree.first[split]
                kids = np.repeat(tree.first[split] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                other = np.repeat(stay, count)
                nxt.append((kids, other) if of_a else (other, kids))
        m, n = (np.concatenate(c) for c in zip(*nxt))
    m, n, top = (np.concatenate(c) for c in zip(*ready))
    by = np.lexsort((-top, m))
    m, n, top = m[by], n[by], top[by]
    scored = 0
    edges = np.flatnonzero(np.r_[True, m[1:] != m[:-1], True]) if len(m) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        group = a.order[a.lo[m[lo]]:a.hi[m[lo]]]
        step = 2
        while lo < hi:
            some = n[lo:min(hi, lo + step)]
            if top[lo] < np.maximum(best[group, -1], floor[group]).min():
                break
            points = np.concatenate([b.order[b.lo[x]:b.hi[x]] for x in some.tolist()])
            s = a.x[group] @ b.x[points].T
            scored += s.size
            s[q_ids[group][:, None] == p_ids[points][None, :]] = NONE
            s[s < floor[group][:, None]] = NONE
            if (s > NONE).any():
                every = np.concatenate([best[group], s], axis=1)
                names = np.concatenate([ids[group], np.broadcast_to(p_ids[points], s.shape)], axis=1)
                order = np.lexsort((names, -every), axis=1)[:, :k]
                best[group], ids[group] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
            lo, step = lo + step, min(2 * step, 64)
    return best, ids, scored


def cell_centres(x: np.ndarray, wanted: int) -> np.ndarray:
    """Centres of the top nodes of a cover tree over ``x``: the widest node is opened until there are enough."""
    tree = CoverTree(x)
    front = [0]
    while len(front) < wanted:
        inner = [i for i in front if not tree.is_leaf[i]]
        if not inner:
            break
        widest = max(inner, key=lambda i: tree.r[i])
        front.remove(widest)
        front += range(tree.first[widest], tree.last[widest])
    return np.unique(tree.c[front], axis=0)


def _rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = pa.compute.list_value_length(batch.column(column)).to_numpy()
    for n in np.unique(sizes).tolist():
        yield n, batch.filter(pa.array(sizes == n))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)
    near = d.argmin(axis=1)
    return near, np.sqrt(d[np.arange(len(x)), near])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
          scale: int = 256, cell: int = CELL, scored=None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row where ``is_query`` holds.

    ``scored``: an accumulator that takes the number of pairs whose score was computed.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(vector), lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double"))
    fine = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e.cast("double"))
                    & (F.abs(e.cast("double")) < float("inf")))
    rows = (vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
            .select(F.col(key).cast("long").alias("_id"), x.alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q")))
    total, most, longest = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("_v", lambda e: F.abs(e)))),
                                    F.max(F.size("_v"))).first()
    if total and most * most * longest >= 2.0 ** 53:
        raise OverflowError("inner products reach 2**53: use a smaller scale")
    # a sample of bounded size, the same every time
    take = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * (longest or 1))))
    sample = rows.orderBy(F.xxhash64("_id", F.lit(7)), "_id").select("_v").limit(take).collect()
    lengths: dict[int, list] = {}
    for r in sample:
        lengths.setdefault(len(r["_v"]), []).append(r["_v"])
    wanted = max(1, min(MAX_CELLS, -(-(total or 0) // cell)))
    model = spark.sparkContext.broadcast({n: cell_centres(np.array(v), -(-wanted * len(v) // len(sample))) for n, v in lengths.items()})

    def centres_of(n: int) -> np.ndarray:
        return model.value.get(n, np.zeros((1, n)))  # a length that the sample lacks is one cell round the origin

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, part in _by_length(b, 1) if b.num_rows else ():
                v = _rows(part.column(1))
                near, far = _nearest(v, centres_of(n))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(near), n, np.int32)),
                                                  pa.array(near.astype(np.int32)), pa.array(far)], names=[*b.schema.names, "_n", "_c", "_far"])

    placed = materialize(rows.mapInArrow(assign, "_id long, _v array<double>, _q boolean, _n int, _c int, _far double"), "vectors")
    sizes = materialize(placed.groupBy("_n", "_c").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("_r"))
                        .select("_n", "_c", "_r", F.ceil(F.col("n") / F.lit(cell)).cast("int").alias("_parts")), "cells")
    known = sizes.where(F.col("_n").isin(list(lengths))).collect() if lengths else []  # at most MAX_CELLS or so
    radius = spark.sparkContext.broadcast({n: {r["_c"]: r["_r"] for r in known if r["_n"] == n} for n in lengths})

    def cells_of(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centres and radii of the cells that hold vectors; an unknown length's cell has no bound."""
        c = radius.value.get(n)
        if c is None:
            return np.zeros(1, np.int64), np.zeros((1, n)), np.full(1, np.inf)
        use = np.array(sorted(c))
        return use, centres_of(n)[use], np.array([c[i] for i in use.tolist()])

    def visits(every: bool):
        """A query's first cell, or all whose bound reaches its k-th score."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n, part in _by_length(b, 1) if b.num_rows else ():
                    v = _rows(part.column(1))
                    use, centres, r = cells_of(n)
                    inner = v @ centres.T
                    if every:
                        norm = np.sqrt((v * v).sum(axis=1))
                        with np.errstate(invalid="ignore"):
                            top = np.nan_to_num(inner + norm[:, None] * r, nan=np.inf)
                        at, to = np.nonzero(top + 1e-9 * (1 + np.abs(top)) >= part.column(2).to_numpy()[:, None])
                    else:
                        at, to = np.arange(len(v)), inner.argmax(axis=1)
                    for lo in range(0, len(at), 4096):
                        row = pa.array(at[lo:lo + 4096])
                        cols = [c.take(row) for c in part.columns]
                        yield pa.RecordBatch.from_arrays(
                            [*cols, pa.array(np.full(len(row), n, np.int32)), pa.array(use[to[lo:lo + 4096]].astype(np.int32))],
                            names=["_id", "_v", "_floor", "_n", "_c"])
        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by part, each part's data before its queries."""
        now = tree = p_ids = None
        data: list[tuple[np.ndarray, np.ndarray]] = []
        asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def unique(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
            if len(np.unique(ids)) == len(ids):
                return np.arange(len(ids))
            return np.array(sorted({(i, y.tobytes()): j for j, (i, y) in enumerate(zip(ids.tolist(), v))}.values()))

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal tree, p_ids
            if asked and data and tree is None:
                ids, v = (np.concatenate(c) for c in zip(*data))
                use = unique(ids, v)
                tree, p_ids = CoverTree(v[use]), ids[use]
                data.clear()
            if asked and tree is not None:
                ids, v, floor = (np.concatenate(c) for c in zip(*asked))
                use = unique(ids, v)
                ids, v, floor = ids[use], v[use], floor[use]
                best, names, n = dual_search(CoverTree(v, QUERY_LEAF), ids, floor, tree, p_ids, k)
                if scored is not None:
                    scored.add(n)
                there = best > NONE
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids, k)[there.ravel()]), pa.array(names[there]), pa.array(best[there].astype(np.int64))],
                    names=["query_id", "vec_id", "score"])
            asked.clear()

        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)  # length, cell, part, side
            cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1), True])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = b.slice(lo, hi - lo)
                if tuple(place[lo, :3]) != now:
                    yield from answer()
                    now, tree, p_ids = tuple(place[lo, :3]), None, None
                    data.clear()
                ids, v = part.column(4).to_numpy(), _rows(part.column(5))
                if place[lo, 3] == 0:
                    data.append((ids, v))
                else:
                    asked.append((ids, v, part.column(6).to_numpy()))
                    if sum(len(x[0]) for x in asked) >= QUERY_BLOCK:
                        yield from answer()
        yield from answer()

    part = F.pmod(F.xxhash64("_id", F.lit(3)), F.col("_parts")).cast("int")
    data = placed.join(sizes, ["_n", "_c"]).select("_n", "_c", part.alias("_p"), F.lit(0).alias("_side"), "_id", "_v", F.lit(0.0).alias("_floor"))

    def meet(queries: DataFrame) -> DataFrame:
        both = data.unionByName(queries.select("_n", "_c", "_p", F.lit(1).alias("_side"), "_id", "_v", "_floor"))
        return (spread(both, "_n", "_c", "_p").sortWithinPartitions("_n", "_c", "_p", "_side")
                .mapInArrow(search, "query_id long, vec_id long, score long"))

    asked = placed.where("_q").select("_id", "_v", F.lit(float("-inf")).alias("_floor"))
    to_cell = "_id long, _v array<double>, _floor double, _n int, _c int"
    # a part that no query comes to is not searched, but its data pass by
    first = asked.mapInArrow(visits(False), to_cell).join(sizes, ["_n", "_c"]).withColumn("_p", part)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = meet(first).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    floors = materialize(found.select(F.col("query_id").alias("_id"), F.col("score").cast("double").alias("_kth")), "kth-scores")
    again = (asked.drop("_floor").join(floors, "_id", "left")
             .select("_id", "_v", F.coalesce("_kth", F.lit(float("-inf"))).alias("_floor")))
    second = (again.mapInArrow(visits(True), to_cell).join(sizes, ["_n", "_c"])
              .withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))))
    return (meet(second).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
