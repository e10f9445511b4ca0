"""Density clusters of a whole corpus: single links of mutual reachability, condensed to the most persistent clusters.

The same clusters as `similarity.density_labels` finds in a square of distances, without a square. Equal vectors are merged
and counted. Core distances come from exact neighbours (`metric.k_nearest`). The tree of least links grows in rounds: each
component finds its least link to another one, by weight and then ids, so that components at least halve. Links among
neighbours are tried first; whatever isn't among a vector's neighbours is at least its core distance away, so only vectors
whose core distance is below their component's best link are searched for, in balls that hold anything of another component
within that link (`metric.Balls.route`). Components are relabelled by pointer jumping: on the driver up to FEW_GROUPS, by a join a step beyond.

The tree, a row for each distinct vector, is then condensed in order of weight from its leaves on: a component needs its
size, the sum of densities at which its members fall out, and the best of its parts. The driver does this over batches of
links with a few numbers a vector (LINK_ROWS links at a time); vectors and distances stay on the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import metric
from touchline.operators.retrieval import store

LEAST = 5
#: Links that the driver reads at a time.
LINK_ROWS = 500_000
#: Groups whose chains the driver follows; more are joined.
FEW_GROUPS = 200_000
LINKS = pa.schema([("group", pa.int64()), ("w", pa.float64()), ("a", pa.int64()), ("b", pa.int64()), ("to", pa.int64())])


def cores(near: DataFrame, vectors: DataFrame, samples: int) -> DataFrame:
    """(id, core): the distance of the samples-th row from each vector, its own rows included."""
    counted = near.join(vectors.select(F.col("id").alias("other"), "n"), "other").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("far", "other", "n"))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("core"))
    found = F.aggregate("s", start, lambda t, x: F.struct((t["n"] + x["n"]).alias("n"), F.coalesce(t["core"], F.when(t["n"] + x["n"] >= samples, x["far"])).alias("core")), lambda t: t["core"])
    return counted.select("id", found.alias("core"))


def _least_links(library: pa.Table, queries: pa.Table) -> pa.Table:
    """The least link of a block from each group of queries to a member of another group."""
    a, b = metric.matrix(queries.column("v")), metric.matrix(library.column("v"))
    column = lambda t, c: t.column(c).to_numpy()
    group, other, bound = column(queries, "group"), column(library, "group"), column(queries, "bound")
    core_a, core_b, ids_a, ids_b = column(queries, "core"), column(library, "core"), column(queries, "id"), column(library, "id")
    rough = np.where(group[:, None] == other[None, :], np.inf, np.maximum(metric.squared(a, b), np.maximum(core_a[:, None], core_b[None, :]) ** 2))
    slack = metric.SLACK * ((a * a).sum(axis=1) + (b * b).sum(axis=1).max())
    i, j = np.nonzero((rough <= (rough.min(axis=1) + slack)[:, None]) & np.isfinite(rough))
    w = np.maximum(np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1)), np.maximum(core_a[i], core_b[j]))
    low, high = np.minimum(ids_a[i], ids_b[j]), np.maximum(ids_a[i], ids_b[j])
    order = np.lexsort((high, low, w, group[i]))
    first = order[np.unique(group[i][order], return_index=True)[1]]
    first = first[w[first] <= bound[i[first]]]
    return pa.table([group[i[first]], w[first], low[first], high[first], other[j[first]]], schema=LINKS)


def least_tree(vectors: DataFrame, samples: int, watch: Callable[[int, int, float], None] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(a, b, w) links of a least spanning tree of mutual reachability over vectors (id, v, n), and (id, core).

    samples: rows in a core, at most those there are. watch: is told of each round, its groups and the share of all pairs that met.
    """
    balls = metric.Balls(vectors.select("id", "v"), store, **options)
    near, _ = metric.k_nearest(vectors, balls, samples)
    core = store(cores(near, vectors, samples))
    held = core.select(F.col("id").alias("other"), F.col("core").alias("core_b"))
    close = store(near.filter("id <> other").join(core, "id").join(held, "other").select("id", "other", F.greatest("far", "core", "core_b").alias("w")))
    groups, links, n, k = core.select("id", F.col("id").alias("group")), [], balls.size, 0
    while True:
        groups = store(groups)
        sides = close.join(groups, "id").join(groups.select(F.col("id").alias("other"), F.col("group").alias("to")), "other").filter("group <> to")
        link = F.struct("w", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "to")
        both = sides.select("group", link.alias("link")).union(sides.select(F.col("to"), F.struct("w", F.least("id", "other"), F.greatest("id", "other"), "group")))
        tried = store(both.groupBy("group").agg(F.min("link").alias("link")))
        placed = vectors.select("id", "v").join(core, "id").join(groups, "id")
        asked = placed.join(tried.select("group", F.col("link.w").alias("bound")), "group", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).filter(F.col("core") < F.col("bound"))
        members = store(balls.members.join(core, "id").join(groups, "id"))
        alone = {r.ball: r.low for r in members.groupBy("ball").agg(F.min("group").alias("low"), F.max("group").alias("high")).collect() if r.low == r.high}
        found, met = balls.meet(balls.route(asked.select("id", "v", "core", "group", "bound"), None, alone), _least_links, LINKS, members)
        every = found.select("group", F.struct("w", "a", "b", "to").alias("link")).union(tried)
        best = store(every.groupBy("group").agg(F.min("link").alias("link")))
        if watch:
            watch(k, groups.select("group").distinct().count(), met / max(1, n * n))
        if best.isEmpty():
            break
        links.append(best.select("link.a", "link.b", "link.w").distinct())
        groups, k = groups.join(_roots(best.select("group", F.col("link.to").alias("up"))), "group", "left").select("id", F.coalesce("root", "group").alias("group")), k + 1
    tree = links[0] if links else vectors.sparkSession.createDataFrame([], "a long, b long, w double")
    for more in links[1:]:
        tree = tree.union(more)
    return store(tree), core


def _roots(up: DataFrame) -> DataFrame:
    """(group, root) of groups that point at each other in chains, each of which ends in two that point at one another.

    Up to FEW_GROUPS are followed on the driver; more by joins that double what a step spans.
    """
    if up.count() <= FEW_GROUPS:
        known = up.toArrow()
        group, to = known.column("group").to_numpy(), known.column("up").to_numpy()
        order = np.argsort(group)
        group, to = group[order], np.searchsorted(group[order], to[order])
        back = to[to] == np.arange(len(to))
        to = np.where(back & (np.arange(len(to)) < to), np.arange(len(to)), to)
        while (to[to] != to).any():
            to = to[to]
        return up.sparkSession.createDataFrame(pa.table({"group": group, "root": group[to]}))
    back = up.select(F.col("group").alias("up"), F.col("up").alias("back"))
    now = store(up.join(back, "up").select("group", F.when((F.col("back") == F.col("group")) & (F.col("group") < F.col("up")), F.col("group")).otherwise(F.col("up")).alias("root")))
    while True:
        onward = now.select(F.col("group").alias("root"), F.col("root").alias("next"))
        jumped = store(now.join(onward, "root").select("group", "root", "next"))
        now = jumped.select("group", F.col("next").alias("root"))
        if jumped.filter("root <> next").isEmpty():
            return now


class _Condensed:
    """Clusters of components that grow link by link; places are those of a sorted array of vectors."""

    def __init__(self, size: int, least: int):
        self.least, self.above = least, np.arange(size)
        self.rows, self.sums = np.ones(size, dtype=np.int64), np.zeros(size)
        self.own, self.deepest = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.small: dict[int, list[int]] = {}  # places of components below least, but for single ones
        self.gain, self.best, self.parts, self.root = [], [], [], []

    def _find(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = self.above[self.above[x]]
            x = self.above[x]
        return x

    def _places(self, root: int) -> list[int]:
        return self.small.pop(root, [root])

    def _open(self, root: int, places: list[int], parts: list[int], density: float) -> None:
        self.own[root], self.sums[root] = len(self.gain), density * self.rows[root]
        self.deepest[places] = len(self.gain)
        self.gain.append(0.0), self.best.append(0.0), self.parts.append(parts)

    def _close(self, root: int, density: float) -> int:
        c = self.own[root]
        self.gain[c] = 0.0 if np.isinf(density) else self.sums[root] - self.rows[root] * density
        self.best[c] = max(self.gain[c], sum(self.best[p] for p in self.parts[c]))
        return int(c)

    def link(self, a: int, b: int, w: float) -> None:
        density, a, b = (1 / w if w > 0 else np.inf), self._find(a), self._find(b)
        if self.rows[a] < self.rows[b]:
            a, b = b, a
        old = [self._close(x, density) for x in (a, b)] if self.own[a] >= 0 and self.own[b] >= 0 else None
        left = [] if old else self._places(b) if self.own[a] >= 0 else self._places(a) + self._places(b)
        self.above[b] = a
        self.rows[a] += self.rows[b]
        if old:
            self._open(a, [], old, density)
        elif self.own[a] >= 0:
            self.deepest[left] = self.own[a]
            self.sums[a] += density * self.rows[b]
        else:
            self._grown(a, left, density)

    def copies(self, a: int, more: int, w: float) -> None:
        """More rows of a vector, which link to it at its core distance."""
        density, a = (1 / w if w > 0 else np.inf), self._find(a)
        self.rows[a] += more
        if self.own[a] >= 0:
            self.sums[a] += density * more
        else:
            self._grown(a, self._places(a), density)

    def _grown(self, a: int, places: list[int], density: float) -> None:
        if self.rows[a] >= self.least:
            self._open(a, places, [], density)
        elif len(places) > 1:
            self.small[a] = places

    def labels(self) -> np.ndarray:
        """Of each place, -1 for noise; clusters are numbered by their first place. The root cluster is never chosen."""
        size = len(self.gain)
        chosen, up = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        for c, parts in enumerate(self.parts):
            up[parts] = c
        for c in range(size - 1, -1, -1):
            if up[c] >= 0 and chosen[up[c]] >= 0:
                chosen[c] = chosen[up[c]]
            elif up[c] >= 0 and not (self.parts[c] and sum(self.best[p] for p in self.parts[c]) > self.gain[c]):
                chosen[c] = c
        found = np.append(chosen, -1)[self.deepest]
        _, first, back = np.unique(found, return_index=True, return_inverse=True)
        order = np.full(len(first), -1, dtype=np.int64)
        real = np.flatnonzero(found[first] >= 0)
        order[real[np.argsort(first[real])]] = np.arange(len(real))
        return order[back]


def _batches(links: DataFrame) -> Iterator[pa.Table]:
    """The links in order of weight, so many at a time, sorted once on the tasks."""
    ordered = links.orderBy("w", "a", "b").select("w", "a", "b", "more", F.monotonically_increasing_id().alias("place"))
    held = store(ordered)
    low, n = -1, held.count()
    for _ in range(-(-n // LINK_ROWS)):
        some = held.filter(F.col("place") > low).orderBy("place").limit(LINK_ROWS).toArrow()
        low = some.column("place")[-1].as_py()
        yield some


def cluster_corpus(rows: DataFrame, keys: list[str], vector: str = "v", least: int = LEAST, samples: int | None = None, watch=None, **options) -> DataFrame:
    """keys and cluster (-1: noise) of each row with a vector: density clusters of all rows together, by Euclidean distance.

    least: rows of a cluster at least; samples: rows in a core (least where not given). options: of metric.Balls. Fewer rows than samples
    are noise, as is everything where no level splits in two; rows with equal vectors share a cluster.
    """
    least = max(2, least)
    samples = least if samples is None else samples
    vectors = store(metric.distinct_vectors(rows, keys, vector))
    total = vectors.agg(F.sum("n")).first()[0] or 0
    joined = rows.select(*keys, F.col(vector).alias("v")).join(vectors.select("id", "v"), "v")
    if total < max(2, samples):
        return joined.select(*keys, F.lit(-1).alias("cluster"))
    tree, core = least_tree(vectors, samples, watch, **options)
    again = vectors.filter("n > 1").join(core, "id").select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("core").alias("w"), (F.col("n") - 1).alias("more"))
    ids = np.sort(vectors.select("id").toArrow().column("id").to_numpy())
    state = _Condensed(len(ids), least)
    for some in _batches(tree.select("a", "b", "w", F.lit(0).cast("long").alias("more")).union(again)):
        a, b = (np.searchsorted(ids, some.column(c).to_numpy()).tolist() for c in "ab")
        for x, y, w, more in zip(a, b, some.column("w").to_pylist(), some.column("more").to_pylist(), strict=True):
            state.copies(x, more, w) if more else state.link(x, y, w)
    labels = rows.sparkSession.createDataFrame(pa.table({"id": ids, "cluster": pa.array(state.labels(), pa.int32())}))
    return joined.join(labels, "id").select(*keys, "cluster")
