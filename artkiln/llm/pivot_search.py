"""Exact search of the largest inner products with a pivot table.

Distances to many pivots are computed once for every vector. For a query q
and a candidate x, the largest |d(q, p) - d(x, p)| over the pivots is a lower
bound of d(q, x), and with the norms it becomes an upper bound of the inner
product: q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2. Candidates are evaluated in
the order of their bounds until no bound left can reach the k-th score, so
the result is exact, ties included.

Queries and candidates are packed into blocks that meet on a grid: a block of
queries goes to every group of candidate blocks and the other way round, and
each cell of the grid is a task of bounded size. A cell gives k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import staged

#: Vectors from which pivots are chosen, and pivots for each dimension; the origin is one more.
SAMPLE, PIVOTS = 2048, 32
#: Queries and candidates of a block, and candidate blocks of a group.
QUERY_BLOCK, BLOCK, GROUP = 2048, 1024, 8
#: Vectors with a whole component of this size or more are wide: kept as doubles, never pivots, and met apart from the others.
LARGEST = 1 << 24


def whole_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id and v, the floor of scale times each component as a double, which holds it exactly; vectors with null or non-finite components, before or after scaling, are left out."""
    v = F.col(vector)
    scaled = lambda x: F.lit(scale) * x.cast("double")
    whole = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < float("inf")))
    return vectors.filter(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next pivot is the one farthest from those before it."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def pivot_table(vectors: DataFrame, sample: int = SAMPLE, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots of each dimension found in a bounded sample of the vectors that are not wide, the origin among them."""
    rows = vectors.filter(F.forall("v", lambda x: F.abs(x) < LARGEST)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    by: dict[int, list] = {}
    for (v,) in rows:
        by.setdefault(len(v), []).append(v)
    return {d: np.concatenate([np.zeros((1, d)), choose_pivots(np.array(x, float), count)]) for d, x in by.items()}


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def blocks(vectors: DataFrame, pivots: dict[int, np.ndarray], rows: int) -> DataFrame:
    """block (dim, wide, ids, values, distances, number): up to `rows` vectors of one dimension, all wide or none, with their pivot distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], tuple[list, list]] = {}
        made = 0

        def closed(dim: int, wide: bool) -> pa.RecordBatch:
            nonlocal made
            ids, values = held.pop((dim, wide))
            x = np.array(values, float if wide else np.int32).reshape(-1, dim)
            table = _distances(x.astype(float), pivots.get(dim, np.zeros((1, dim))))
            made += 1
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "wide": pa.array([wide]), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "v": pa.array([x.tobytes()], pa.binary()),
                                               "distances": pa.array([table.tobytes()], pa.binary()), "number": pa.array([made], pa.int32())})

        for batch in batches:
            for vec_id, v in zip(batch["vec_id"].to_pylist(), batch["v"]):
                value = v.values.to_numpy(zero_copy_only=False)
                kind = len(value), bool(np.abs(value).max() >= LARGEST)
                ids, values = held.setdefault(kind, ([], []))
                ids.append(vec_id)
                values.append(value)
                if len(ids) == rows:
                    yield closed(*kind)
        for kind in list(held):
            yield closed(*kind)

    return vectors.mapInArrow(run, "dim int, wide boolean, ids binary, v binary, distances binary, number int")


def _unpacked(table: pa.Table) -> Iterator[tuple[tuple[int, bool], np.ndarray, np.ndarray, np.ndarray]]:
    for row in table.to_pylist():
        ids = np.frombuffer(row["ids"], np.int64)
        yield (row["dim"], row["wide"]), ids, np.frombuffer(row["v"], float if row["wide"] else np.int32).reshape(len(ids), -1), np.frombuffer(row["distances"], float).reshape(len(ids), -1)


def search(q_ids: np.ndarray, q: np.ndarray, dq: np.ndarray, ids: np.ndarray, x: np.ndarray, dx: np.ndarray, k: int, step: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, candidate ids, scores) of the k best candidates of each query; ties to the smaller id.

    Scores are exact: doubles below 2**53, longs where the product fits one,
    else Python integers, for which every candidate is evaluated.
    """
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if most >= 1 << 63:
        whole = [[int(c) for c in v] for v in x]
        for query, vector in zip(q_ids, q):
            v = [int(c) for c in vector]
            scored = sorted((-sum(a * b for a, b in zip(v, w)), int(i)) for i, w in zip(ids, whole) if i != query)[:k]
            yield np.full(len(scored), query), np.array([i for _, i in scored], np.int64), np.array([-s for s, _ in scored], object)
        return
    exact = float if most < 1 << 53 else np.int64
    order = np.argsort(ids, kind="stable")
    ids, x, dx = ids[order], x[order], np.ascontiguousarray(dx[order].T)
    qv, xv = q.astype(exact), x.astype(exact)
    qq, xx = dq[:, 0] ** 2, dx[0] ** 2  # pivot 0 is the origin
    for at in range(0, len(q), step):
        some = slice(at, at + step)
        low = np.zeros((len(q_ids[some]), len(ids)))
        gap = np.empty_like(low)
        for p in range(dx.shape[0]):
            np.subtract(dq[some, p, None], dx[p], out=gap)
            np.abs(gap, out=gap)
            np.maximum(low, gap, out=low)
        both = qq[some, None] + xx
        bound = (both - low * low) / 2 + 1e-9 * both + 1e-6
        for i, row in enumerate(bound):
            query, vector = q_ids[at + i], qv[at + i]
            row[np.searchsorted(ids, query) : np.searchsorted(ids, query, side="right")] = -np.inf
            best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            left = np.flatnonzero(row > -np.inf)
            width = 256
            while len(left):
                if len(left) > width:  # the next candidates in bound order, all ties of the last one with them
                    edge = np.partition(row[left], len(left) - width)[len(left) - width]
                    now, left = left[row[left] >= edge], left[row[left] < edge]
                else:
                    now, left = left, left[:0]
                score = (xv[now] @ vector).astype(np.int64)
                best_ids, best = np.concatenate([best_ids, ids[now]]), np.concatenate([best, score])
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
                if len(best) == k:
                    left = left[row[left] >= best[-1]]
                width *= 2
            yield np.full(len(best), query), best_ids, best


def sort_key(score: int) -> bytes:
    """Bytes that order as the whole numbers do."""
    size = (abs(score).bit_length() + 7) // 8
    body = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + body if score >= 0 else b"\x00" + bytes(255 - b for b in body)


def top_k(vectors: DataFrame, queries: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query row with the rows of another id.

    Vectors meet those of their own length only. Rows that repeat an id are
    candidates each; as a query such an id counts once, with its least vector.
    No queries or no candidates give no rows. Ranks are exact for all finite
    vectors; a score that no long holds is null.
    """
    clean = staged(whole_vectors(vectors, key, vector, scale), "vectors")
    pivots = pivot_table(clean)
    asked = whole_vectors(vectors.filter(queries), key, vector, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    theirs, ours = staged(blocks(clean, pivots, BLOCK), "candidate-blocks"), staged(blocks(asked, pivots, QUERY_BLOCK), "query-blocks")
    lanes, groups = max(1, ours.count()), max(1, -(-theirs.count() // GROUP))
    spread = lambda df, n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = ours.withColumn("lane", spread(ours, lanes)).withColumn("group", each(groups))
    right = theirs.withColumn("group", spread(theirs, groups)).withColumn("lane", each(lanes))

    def meet(left_: pa.Table, right_: pa.Table) -> pa.Table:
        out = []
        found = list(_unpacked(right_))
        for kind, q_ids, q, dq in _unpacked(left_):
            for other in {n for n, *_ in found if n[0] == kind[0]}:
                ids, x, dx = (np.concatenate(c) for c in zip(*[(i, x, d) for n, i, x, d in found if n == other]))
                out += search(q_ids, q, dq, ids, x, dx, k)
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        scores = [int(v) for v in cols[2]]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array([v if -(1 << 63) <= v < 1 << 63 else None for v in scores], pa.int64()),
                         "place": pa.array([sort_key(v) for v in scores], pa.binary())})

    met = left.groupBy("lane", "group").cogroup(right.groupBy("lane", "group")).applyInArrow(meet, "query_id long, vec_id long, score long, place binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
