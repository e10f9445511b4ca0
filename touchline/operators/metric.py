"""Exact search among vectors by Euclidean distance: pivots, balls about them, and the triangle inequality.

Every vector belongs to its nearest pivot. A ball (a pivot's vectors) is dealt into packs of about PACK vectors, so that no
task holds a ball however many vectors crowd there; equal vectors must be merged before (`distinct_vectors`). A query with a
bound goes to the balls that can hold something within the bound, by the ball's radius and by the plane half-way between two
pivots. It meets a ball pack by pack: packs and queries are cogrouped in blocks of bounded size on both sides, and a block is
one product of matrices. What is sent to all tasks are pivots and radii, PIVOTS at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: Most pivots; vectors of a pack and queries of a block, about.
PIVOTS, PACK, ASKED = 1024, 2048, 1024
#: By how much a computed distance may be off, of the largest distance that plays a part.
SLACK = 1e-7


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long arrays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, by one product."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def distinct_vectors(rows: DataFrame, keys: list[str], vector: str = "v", most: int | None = None) -> DataFrame:
    """(id, v, n, keys): each distinct vector, its rows, and its keys (structs) in order, the most smallest of them where that is
    given. Ids ascend with the smallest key. Vectors that are null or hold null are left out."""
    known = rows.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull())).select(F.col(vector).alias("v"), F.struct(*keys).alias("key"))
    if most is None:
        own = known.groupBy("v").agg(F.count("*").alias("n"), F.min("key").alias("first"))
        return own.orderBy("first").select(F.monotonically_increasing_id().alias("id"), "v", "n", "first")
    counted = known.groupBy("v", "key").agg(F.count("*").alias("same"))
    # map-side, each group is cut to its smallest keys before it is sent: a hash deals a crowded vector's keys to many parts first
    some = lambda: F.slice(F.array_sort(F.collect_list(F.struct("key", "same"))), 1, most)
    parts = counted.groupBy("v", F.pmod(F.xxhash64("key"), F.lit(256)).alias("part")).agg(some().alias("keys"), F.sum("same").alias("n"))
    own = parts.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("keys"))), 1, most).alias("keys"), F.sum("n").alias("n"))
    return own.orderBy(F.col("keys")[0]).select(F.monotonically_increasing_id().alias("id"), "v", "n", "keys")


class Balls:
    """The library: vectors (id, v) with any further columns, dealt to balls and packs. store: writes a table and reads it again."""

    def __init__(self, library: DataFrame, store: Callable[[DataFrame], DataFrame], pack: int = PACK, asked: int = ASKED, pivots: int | None = None):
        self.store, self.asked = store, asked
        n = library.count()
        few = min(PIVOTS, max(1, -(-n // pack))) if pivots is None else pivots
        chosen = library.orderBy(F.xxhash64("id"), "id").limit(few).select("v").toArrow()
        self.pivots = matrix(chosen.column("v")) if chosen.num_rows else np.zeros((0, 0))
        self.apart = np.sqrt(squared(self.pivots, self.pivots))
        own = self._nearest(library)
        sums = {r.ball: r for r in own.groupBy("ball").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
        self.radius = np.array([sums[j].radius if j in sums else -1.0 for j in range(len(self.pivots))])
        self.packs = {j: -(-r.n // pack) for j, r in sums.items()}
        self.sizes, self.size = {j: r.n for j, r in sums.items()}, n
        self.members = store(own.withColumn("pack", F.pmod(F.xxhash64("id", F.lit(1)), self._by_ball(self.packs)).cast("int")))

    def _by_ball(self, numbers: dict[int, int]):
        """A number of each ball as an expression; ball is a column."""
        return F.get(F.array(*(F.lit(int(numbers.get(j, 1))) for j in range(max(1, len(self.pivots))))), F.col("ball"))

    def _nearest(self, rows: DataFrame) -> DataFrame:
        pivots, names = self.pivots, rows.columns

        def run(batches):
            for batch in batches:
                d = np.sqrt(squared(matrix(batch.column("v")), pivots)) if batch.num_rows else np.zeros((0, 1))
                ball = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball, pa.int32()), pa.array(d[np.arange(len(d)), ball])], [*names, "ball", "far"])

        return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", ball int, far double")

    def route(self, queries: DataFrame, own: bool | None, group: dict[int, int] | None = None) -> DataFrame:
        """The queries (id, v, bound, ...) once for each ball that they have to meet. own: only their own ball, only others, or (None)
        both. group: by ball, the one group of all its members; queries of that group (column) leave the ball out."""
        pivots, radius, apart, names = self.pivots, self.radius, self.apart, queries.columns
        whole = None if group is None else np.array([group.get(j, -1) for j in range(len(pivots))])

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = np.sqrt(squared(matrix(batch.column("v")), pivots))
                ball = d.argmin(axis=1)
                mine = np.arange(len(pivots))[None, :] == ball[:, None]
                if own:
                    wanted = mine
                else:
                    bound = batch.column("bound").to_numpy(zero_copy_only=False)[:, None]
                    near = d[np.arange(len(d)), ball][:, None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(apart[ball] > 0, (d * d - near * near) / (2 * apart[ball]), -np.inf)
                    least = np.where(radius[None, :] < 0, np.inf, np.maximum(d - radius[None, :], plane))
                    wanted = least <= bound + SLACK * (1 + d)
                    wanted = wanted & ~mine if own is False else wanted | mine
                if whole is not None:
                    wanted &= whole[None, :] != batch.column("group").to_numpy(zero_copy_only=False)[:, None]
                row, to = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(to, pa.int32())], [*names, "ball"])

        return queries.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema) + ", ball int")

    def meet(self, routed: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: pa.Schema, members: DataFrame | None = None) -> tuple[DataFrame, int]:
        """function of each block of members of a ball and queries routed to it, and the number of pairs that meet. members: with further columns."""
        routed, members = self.store(routed), self.members if members is None else members
        counts = {r.ball: r.n for r in routed.groupBy("ball").agg(F.count("*").alias("n")).collect()}
        parts = {j: -(-n // self.asked) for j, n in counts.items()}
        pairs = sum(n * self.sizes.get(j, 0) for j, n in counts.items())
        asked = routed.withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), self._by_ball(parts)).cast("int")).withColumn("pack", F.explode(F.sequence(F.lit(0), self._by_ball(self.packs) - 1)))
        held = members.filter(F.col("ball").isin(list(counts))).withColumn("part", F.explode(F.sequence(F.lit(0), self._by_ball(parts) - 1)))

        def run(library: pa.Table, queries: pa.Table) -> pa.Table:
            return function(library, queries) if library.num_rows and queries.num_rows else schema.empty_table()

        block = ["ball", "pack", "part"]
        return held.groupBy(*block).cogroup(asked.groupBy(*block)).applyInArrow(run, from_arrow_schema(schema)), pairs


NEIGHBOURS = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("far", pa.float64())])


def nearest_in_block(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(id, other, far): for each query of a block the k nearest of its members, ties to the smaller id."""

    def run(library: pa.Table, queries: pa.Table) -> pa.Table:
        a, b = matrix(queries.column("v")), matrix(library.column("v"))
        ids, mine = library.column("id").to_numpy(), queries.column("id").to_numpy()
        rough, few = squared(a, b), min(k, len(b))
        kth = np.partition(rough, few - 1, axis=1)[:, few - 1]
        i, j = np.nonzero(rough <= (kth + SLACK * ((a * a).sum(axis=1) + (b * b).sum(axis=1).max()))[:, None])
        exact = np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1))
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pa.table([mine[i[best]], ids[j[best]], exact[best]], schema=NEIGHBOURS)

    return run


def k_nearest(queries: DataFrame, balls: Balls, k: int) -> tuple[DataFrame, float]:
    """(id, other, far): for each query (id, v) its k nearest members, itself included where it is one, ties to the smaller id; and the
    share of all distances that was computed. Two passes, however many queries: own balls, then what the k-th distance leaves."""
    best, total = nearest_in_block(k), queries.count() * balls.size
    if not total:
        return queries.sparkSession.createDataFrame([], "id long, other long, far double"), 0.0

    def top(found: DataFrame) -> DataFrame:
        return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "other"))), 1, k).alias("best"))

    def rows(tops: DataFrame) -> DataFrame:
        return tops.select("id", F.inline("best").alias("far", "other")).select("id", "other", "far")

    found, met = balls.meet(balls.route(queries.select("id", "v"), True), best, NEIGHBOURS)
    first = balls.store(top(found))
    bound = F.when(F.size("best") == k, F.element_at("best", -1)["far"]).otherwise(float("inf")).alias("bound")
    others, more = balls.meet(balls.route(queries.select("id", "v").join(first.select("id", bound), "id"), False), best, NEIGHBOURS)
    return balls.store(rows(top(rows(first).union(others)))), (met + more) / total
