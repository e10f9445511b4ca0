"""Distances between a match's episodes, density clusters of them, and how stable these are.

Clusters need all distances within their group. A group is one match (some hundred episodes): pairs are joined within it,
their distances computed as rows, and only its square of numbers goes to one task. Corpora are clustered by
`retrieval.cluster`, which needs no pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAMMA, LEAST_GAMMA, LEAST_CLUSTER = 1.0, 1e-6, 5
BOOTSTRAPS, SHARE, STABLE, SEED = 20, 0.8, 0.75, 42


def soft_dtw(a: np.ndarray, b: np.ndarray, gamma: float = GAMMA) -> float:
    """Soft dynamic time warping of two sequences (time, numbers): squared Euclidean cost, log-sum-exp minimum; may be negative.

    Cells of one anti-diagonal need only the two before it, so each is one array operation.
    """
    if a.ndim != 2 or b.ndim != 2 or a.shape[1] != b.shape[1]:
        raise ValueError("two sequences of equally many numbers are needed")
    if gamma < LEAST_GAMMA:
        raise ValueError("gamma must be positive")
    cost = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0.0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        ways = np.stack((total[i - 1, j - 1], total[i - 1, j], total[i, j - 1]))
        least = ways.min(axis=0)
        total[i, j] = cost[i - 1, j - 1] + least - gamma * np.log(np.exp((least - ways) / gamma).sum(axis=0))
    return float(total[n, m])


def sequences(role_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per episode path: an array over snapshots of the x and y of all roles in the alphabet's order, 0 for a missing role."""
    own = Window.partitionBy(*keys)
    each = role_rows.withColumn("roles_", F.array_sort(F.collect_set("role").over(own)))
    frames = each.groupBy(*keys, "frame_id", "roles_").agg(F.map_from_entries(F.collect_list(F.struct("role", F.array("x", "y")))).alias("at"))
    flat = F.flatten(F.transform("roles_", lambda r: F.coalesce(F.col("at")[r], F.array(F.lit(0.0), F.lit(0.0)))))
    placed = frames.select(*keys, F.struct("frame_id", flat.alias("v")).alias("s"))
    return placed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("path"))


def episode_pairs(vectors: DataFrame, paths: DataFrame, group: list[str], keys: list[str], gamma: float = GAMMA) -> DataFrame:
    """Per pair of a group's episodes (a before b): group, a, b (structs of keys), far (Euclidean, of vectors' v) and path_far (soft-DTW).

    An episode without a path is further from all others than any pair of the group by 1; a group with no paths at all has 2.
    """

    @F.pandas_udf("double")
    def warped(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else soft_dtw(np.stack(p).astype(float), np.stack(q).astype(float), gamma) for p, q in zip(x, y, strict=True)], dtype="float64")

    rows = vectors.join(paths, keys, "left").select(*group, F.struct(*keys).alias("id"), "v", "path")
    left, right = (rows.select(*group, *[F.col(c).alias(f"{c}_{s}") for c in ("id", "v", "path")]) for s in "ab")
    pairs = left.join(right, group).filter("id_a < id_b")
    straight = F.sqrt(F.aggregate(F.zip_with("v_a", "v_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d))
    found = pairs.select(*group, F.col("id_a").alias("a"), F.col("id_b").alias("b"), straight.alias("far"), warped("path_a", "path_b").alias("path_far"))
    # the whole square holds its diagonal of zeros, which bounds the greatest distance from below
    most = F.greatest(F.coalesce(F.max("path_far").over(Window.partitionBy(*group)), F.lit(0.0)), F.lit(0.0))
    return found.withColumn("path_far", F.coalesce("path_far", most + 1))


def fused(pairs: DataFrame, group: list[str], feature_weight: float = 1.0, path_weight: float = 1.0) -> DataFrame:
    """Adds distance: both distances, each over its group's greatest (1 where that isn't positive), weighted and summed."""
    own = Window.partitionBy(*group)
    scaled = lambda c: F.col(c) / F.when(F.max(c).over(own) > 0, F.max(c).over(own)).otherwise(1.0)
    return pairs.withColumn("distance", feature_weight * scaled("far") + path_weight * scaled("path_far"))


def density_labels(distance: np.ndarray, least: int = LEAST_CLUSTER, samples: int | None = None) -> np.ndarray:
    """Labels of a square of distances, -1 for noise: single links of mutual reachability, condensed to clusters of at least least, the most persistent of which are chosen.

    Core distances count a point as its own first neighbour. The root is never chosen. Equal distances link in the order of rows.
    """
    n, least = len(distance), max(2, least)
    samples = least if samples is None else samples
    if n < 2 or n < samples:
        return np.full(n, -1)
    core = np.sort(distance, axis=1)[:, samples - 1]
    reach = np.maximum(distance, np.maximum(core[:, None], core[None, :]))
    # the tree of least links, grown from the first row
    best, source, inside = np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=bool)
    at, links = 0, []
    for _ in range(n - 1):
        inside[at] = True
        nearer = ~inside & (reach[at] < best)
        best[nearer], source[nearer] = reach[at][nearer], at
        at = int(np.where(inside, np.inf, best).argmin())
        links.append((best[at], source[at], at))
    links.sort(key=lambda e: e[0])
    # merges: node n + k joins two nodes at a distance
    parent, sides, size, height = list(range(n)), {}, [1] * n, [0.0] * n

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, u, v in links:
        a, b, new = root(u), root(v), len(parent)
        parent.append(new)
        parent[a] = parent[b] = new
        sides[new] = (a, b)
        size.append(size[a] + size[b])
        height.append(d)

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            todo.extend(sides[x]) if x >= n else out.append(x)
        return out

    density = lambda d: 1 / d if d > 0 else np.inf
    # condensed clusters: (first density, stability, parts); a side below least falls out of its cluster
    members, stability, parts, up = [], [], [], []

    def open_cluster(node: int, above: int) -> int:
        members.append(leaves(node)), stability.append(0.0), parts.append([]), up.append(above)
        return len(members) - 1

    todo = [(len(parent) - 1, open_cluster(len(parent) - 1, -1), 0.0)]
    while todo:
        node, cluster, birth = todo.pop()
        gain = lambda d, k, birth=birth: 0.0 if np.isinf(birth) else (density(d) - birth) * k
        while node >= n:
            a, b = sides[node]
            big = [x for x in (a, b) if size[x] >= least]
            if len(big) == 2:
                stability[cluster] += gain(height[node], size[node])
                for x in (a, b):
                    part = open_cluster(x, cluster)
                    parts[cluster].append(part)
                    todo.append((x, part, density(height[node])))
                break
            stability[cluster] += gain(height[node], size[node] - sum(size[x] for x in big))
            if not big:
                break
            node = big[0]
    chosen = set()
    for c in range(len(members) - 1, 0, -1):
        below = sum(stability[p] for p in parts[c])
        if parts[c] and below > stability[c]:
            stability[c] = below
        else:
            chosen.add(c)
    labels, k = np.full(n, -1), 0
    for c in sorted(chosen):
        above = up[c]
        while above > 0 and above not in chosen:
            above = up[above]
        if above <= 0:
            labels[members[c]], k = k, k + 1
    return labels


def _square(part: pd.DataFrame) -> tuple[list, np.ndarray]:
    """A group's episodes in the order of their keys, and their distances."""
    a, b = ([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in part[c]] for c in ("a", "b"))
    ids = sorted(set(a) | set(b))
    place = {x: i for i, x in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    i, j = [place[x] for x in a], [place[x] for x in b]
    out[i, j] = out[j, i] = part["distance"]
    return ids, out


def density_clusters(pairs: DataFrame, group: list[str], keys: list[str], least: int = LEAST_CLUSTER, samples: int | None = None) -> DataFrame:
    """Per episode of a group with at least two: keys and cluster (-1: noise)."""
    schema = pairs.select(*group, F.col("a").alias("id_")).select("id_.*").schema

    def label(part: pd.DataFrame) -> pd.DataFrame:
        ids, square = _square(part)
        return pd.DataFrame([(*x, int(c)) for x, c in zip(ids, density_labels(square, least, samples), strict=True)], columns=[*keys, "cluster"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return pairs.select(*group, "a", "b", "distance").groupBy(*group).applyInPandas(label, f"{kinds}, cluster int")


def stability(pairs: DataFrame, group: list[str], least: int = LEAST_CLUSTER, samples: int | None = None, times: int = BOOTSTRAPS, share: float = SHARE, threshold: float = STABLE, seed: int = SEED) -> DataFrame:
    """Per group and cluster: n members, jaccard (mean over subsamples of the best overlap with a cluster found in the subsample) and whether it is stable."""
    if times <= 0 or not 0 < share <= 1:
        raise ValueError("times must be positive and share in (0, 1]")
    kinds = ", ".join(f"{c} {dict(pairs.dtypes)[c]}" for c in group)

    def test(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, square = _square(part)
        labels, rng, n = density_labels(square, least, samples), np.random.default_rng(seed), len(square)
        own = {int(c): set(np.flatnonzero(labels == c).tolist()) for c in np.unique(labels) if c >= 0}
        scores: dict[int, list[float]] = {c: [] for c in own}
        for _ in range(times if own else 0):
            some = np.sort(rng.choice(n, size=max(2, round(n * share)), replace=False))
            found = density_labels(square[np.ix_(some, some)], least, samples)
            others = [set(some[found == c].tolist()) for c in np.unique(found) if c >= 0]
            for c, mine in own.items():
                left = mine & set(some.tolist())
                scores[c].append(max((len(left & o) / len(left | o) for o in others), default=0.0) if left else 0.0)
        return pd.DataFrame([(*key, c, len(own[c]), float(np.mean(s)), bool(np.mean(s) >= threshold)) for c, s in scores.items()], columns=[*group, "cluster", "n", "jaccard", "stable"])

    return pairs.select(*group, "a", "b", "distance").groupBy(*group).applyInPandas(test, f"{kinds}, cluster int, n int, jaccard double, stable boolean")
