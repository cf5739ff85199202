"""Approximate nearest neighbours by collision counting.

Vectors are projected on single random lines and each line's values kept
sorted. Around a query's own value on every line a window grows step by step
(virtual rehashing: no table is built anew). A vector that lies in the windows
of enough lines is verified by its exact inner product. A query stops when a
vector as near as its k-th best would very likely have been counted by now.

The largest inner product is the nearest after each block's vectors are scaled
by the longest of the block and given one more coordinate that makes them all
equally long. Queries and vectors meet in blocks of bounded size.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch, fields, shared_dir, stored

LINES, SEED = 64, 11
#: Share of the lines on which a vector must collide, and the windows' growth.
SHARE, FIRST, GROWTH = 0.5, 0.45, 1.15
#: Standard deviations of the collision count by which the k-th best must clear the share.
MARGIN = 1.0
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 4_096


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over their largest component, and the lengths of these: nothing overflows, and the longest doesn't vanish."""
    scaled = vectors / np.abs(vectors).max()
    return scaled, np.sqrt((scaled * scaled).sum(-1))


class CollisionIndex:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, lines: int = LINES, seed: int = SEED):
        self.vectors = vectors
        scaled, norms = _unit(vectors)
        unit, norms = scaled / norms.max(), norms / norms.max()
        last = np.sqrt(np.maximum(0.0, 1.0 - norms**2))
        self.lines = np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1, lines))
        values = unit @ self.lines[:-1] + last[:, None] * self.lines[-1]
        order = np.argsort(values, 0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        #: All lines' sorted values in one rising array: line i lies around i times ``apart``.
        self.apart = 4.0 * float(np.abs(values).max(initial=1.0)) + 4.0
        self.shift = np.arange(lines) * self.apart
        self.values = (np.take_along_axis(values, order, 0) + self.shift).T.ravel()
        self.coarse = unit.astype(np.float32)
        share = min(0.98, SHARE + MARGIN * np.sqrt(SHARE * (1 - SHARE) / lines))
        self.reach = _normal_quantile((1 + share) / 2)

    def nearest(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and inner products of the nearest found and all that tie with the last of them."""
        lines, n = self.order.shape
        scaled, size = _unit(query)
        unit = scaled / size
        at = np.clip(unit @ self.lines[:-1], -self.apart / 4, self.apart / 4) + self.shift
        coarse, slack = unit.astype(np.float32), 1e-5
        counts, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        if own is not None:
            open_[own] = False
        flat, ends = self.order.ravel(), np.arange(lines) * n
        low = high = np.searchsorted(self.values, at)
        found, rough = [], []
        half, wanted, least = FIRST, ceil(SHARE * lines), -np.inf
        while True:
            a = np.maximum(np.searchsorted(self.values, at - half), ends)
            b = np.minimum(np.searchsorted(self.values, at + half), ends + n)
            parts = [flat[i:j] for i, j in zip((*a, *high), (*low, *b)) if i < j]
            low, high = a, b
            if parts:
                counts += np.bincount(np.concatenate(parts), minlength=n)
            new = np.flatnonzero((counts >= wanted) & open_)
            if len(new):
                open_[new] = False
                near = self.coarse[new] @ coarse
                keep = near >= least - slack
                found.append(new[keep])
                rough.append(near[keep])
                every = np.concatenate(rough)
                if len(every) >= k:
                    least = np.partition(every, -k)[-k]
            # distance of unit vectors whose inner product is the k-th best
            if least > -np.inf and half >= self.reach * np.sqrt(max(0.0, 2.0 - 2.0 * float(least))):
                break
            if (low == ends).all() and (high == ends + n).all():
                break
            half *= GROWTH
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        found = np.concatenate(found)[np.concatenate(rough) >= least - slack]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (self.vectors[found] * query).sum(1)
        if len(scores) > k:
            rank = np.where(np.isnan(scores), np.inf, scores)
            keep = rank >= np.partition(rank, -k)[-k]
            found, scores = found[keep], scores[keep]
        return found, scores


_OUT, _OUT_ARROW = fields("query_uid:long query_id:long vec_id:long score:double")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _searched(k: int):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        rows = []
        if len(vectors) and len(queries):
            uids, ids = vectors["uid"].to_numpy(), vectors["id"].to_pylist()
            place = {int(u): i for i, u in enumerate(uids)}
            index = CollisionIndex(_matrix(vectors["vector"]))
            for uid, qid, q in zip(queries["uid"].to_pylist(), queries["id"].to_pylist(), _matrix(queries["vector"])):
                found, scores = index.nearest(q, k, place.get(uid))
                best = sorted(zip(scores.tolist(), (ids[i] for i in found)), key=lambda x: (x[0] == x[0], -x[0] if x[0] == x[0] else 0.0, x[1] is None, x[1] or 0))[:k]
                rows += [(uid, qid, v, s) for s, v in best]
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.Table.from_batches([batch(_OUT_ARROW, *map(list, columns))])

    return search


def nearest_neighbours(vectors: DataFrame, queries, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of the rows where ``queries`` (a condition on ``vectors``) holds.

    Vectors that are null, zero, or hold a null or a non-finite component take
    no part; those of different lengths have no inner product and are never
    neighbours. A row is never its own neighbour; other rows with equal vectors
    or equal ids are. Nearest first, ties to the smaller id, null ids last.
    Fewer than ``k`` candidates give fewer rows; none, none. Vectors of any
    size can be searched; an inner product beyond the range of a double is
    infinite or not a number, and ranks before or after all others as such.
    """
    spark = vectors.sparkSession
    x = F.col(f"`{vector}`")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.where(usable).select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{vec_id}`").cast("long").alias("id"), x.cast("array<double>").alias("vector"), queries.alias("asks"))
    rows = stored(rows.withColumn("length", F.size("vector")), shared_dir(spark), "vectors")
    # one row for each length that occurs
    count = lambda rows_, size: F.greatest(F.lit(1), F.ceil(F.count(rows_) / size)).cast("int")
    blocks = rows.groupBy("length").agg(count("uid", vector_block).alias("v_blocks"), count(F.when(F.col("asks"), 1), query_block).alias("q_blocks"))
    rows = rows.join(blocks, "length")

    def block(name: str):
        return F.pmod(F.xxhash64("uid"), F.col(name)).cast("int")

    def every(name: str):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    grid = ["length", "vb", "qb"]
    there = rows.select("length", "uid", "id", "vector", block("v_blocks").alias("vb"), every("q_blocks").alias("qb"))
    asked = rows.where("asks").select("length", "uid", "id", "vector", block("q_blocks").alias("qb"), every("v_blocks").alias("vb")).toDF("length", "uid", "id", "vector", "qb", "vb")
    parts = there.groupBy(*grid).cogroup(asked.groupBy(*grid)).applyInArrow(_searched(k), _OUT)
    nearest = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = parts.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
