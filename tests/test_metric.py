"""Exact neighbours by pivots, and density clusters of a corpus, against plain searches."""

import numpy as np
import pytest

from touchline.operators import corpus_clusters, metric, retrieval, similarity


def frame(spark, points, keys="k long"):
    return spark.createDataFrame([(*(k if isinstance(k, tuple) else (k,)), None if v is None else [float(x) for x in v]) for k, v in points], f"{keys}, v array<double>").repartition(4)


def plain(points, queries, k):
    out = []
    for q, v in queries:
        far = sorted((float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), j) for j, x in points if j != q)
        out += [(q, j, round(d, 9), i) for i, (d, j) in enumerate(far[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"pack": 16, "pivots": 9, "block": 5}, {"pack": 7, "pivots": 1, "block": 3}])
def test_neighbours_with_many_balls_and_blocks(spark, options):
    rng = np.random.default_rng(4)
    places = np.concatenate([rng.normal(c, 0.5, (60, 2)) for c in ((0, 0), (9, 9), (-9, 4), (30, -5))]).round(2)
    points = [(i, v.tolist()) for i, v in enumerate(places)] + [(1000 + i, places[5].tolist()) for i in range(40)]  # a crowded vector
    told = []
    library = frame(spark, points)
    got = retrieval.nearest(library.filter("k % 3 = 0"), library, "k", 4, watch=told.append, **options).collect()
    assert sorted((r.query, r.k, round(r.distance, 9), r["rank"]) for r in got) == plain(points, [p for p in points if p[0] % 3 == 0], 4)
    assert told[0] < 0.6 if options.get("pivots") == 9 else told[0] <= 1


def test_neighbours_by_several_keys_and_odd_rows(spark):
    points = [(("a", 1), (0, 0)), (("a", 2), (1, 0)), (("b", 1), (0, 2)), (("b", 2), None), (("b", 3), (0, 0))]
    library = frame(spark, points, "m string, e int")
    got = {}
    for r in sorted(retrieval.nearest(library, library, ["m", "e"], 2).collect(), key=lambda r: r["rank"]):
        got.setdefault(tuple(r.query), []).append((tuple(r.key), r.distance))
    assert got["a", 1] == [(("b", 3), 0.0), (("a", 2), 1.0)] and got["b", 1] == [(("a", 1), 2.0), (("b", 3), 2.0)] and ("b", 2) not in got
    assert retrieval.nearest(library, library.limit(0), ["m", "e"], 2).count() == 0
    one = library.filter("e = 2 and m = 'a'")
    assert retrieval.nearest(one, one, ["m", "e"], 2).count() == 0


# -- clusters ----------------------------------------------------------------------------------------------------------


def square(points):
    return np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))


def partition(labels):
    groups = {}
    for i, c in labels.items():
        groups.setdefault(c, set()).add(i)
    return groups.pop(-1, set()), sorted(map(sorted, groups.values()))


def places(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.3, 40), ((6, 0), 0.6, 50), ((6, 5), 0.2, 30), ((-7, 4), 1.0, 30))]
    return np.concatenate([*parts, rng.uniform(-15, 15, (25, 2))])


@pytest.mark.parametrize("options", [{}, {"pack": 20, "pivots": 12, "asked": 10}])
def test_corpus_clusters_equal_those_of_a_square(spark, options, monkeypatch):
    if options:
        monkeypatch.setattr(corpus_clusters, "FEW_GROUPS", 3)
        monkeypatch.setattr(corpus_clusters, "LINK_ROWS", 40)
    points, told = places(6), []
    want = partition(dict(enumerate(similarity.density_labels(square(points)).tolist())))
    assert len(want[1]) >= 3 and want[0]
    rows = frame(spark, list(enumerate(points.tolist())))
    got = corpus_clusters.cluster_corpus(rows, ["k"], watch=lambda *x: told.append(x), **options)
    assert partition({r.k: r.cluster for r in got.collect()}) == want
    counts = [groups for _, groups, _ in told]
    assert counts[0] == len(points) and counts[-1] == 1 and all(b <= a / 2 for a, b in zip(counts, counts[1:], strict=False))
    if options:
        assert sum(share for _, _, share in told) < 1


def test_least_tree_has_the_least_weight(spark):
    points = places(8)[:120]
    far = square(points)
    core = np.sort(far, axis=1)[:, 4]
    reach = np.maximum(far, np.maximum(core[:, None], core[None]))
    best, inside, total = reach[0].copy(), {0}, 0.0
    while len(inside) < len(points):
        j = min((i for i in range(len(points)) if i not in inside), key=lambda i: best[i])
        total, best = total + best[j], np.minimum(best, reach[j])
        inside.add(j)
    vectors = retrieval.store(metric.distinct_vectors(frame(spark, list(enumerate(points.tolist()))), ["k"]))
    tree, found = corpus_clusters.least_tree(vectors, 5, pack=16, pivots=8, asked=9)
    links = tree.collect()
    assert len(links) == len(points) - 1 and sum(r.w for r in links) == pytest.approx(total)
    assert sorted(r.core for r in found.collect()) == pytest.approx(sorted(core))


def test_clusters_across_matches_with_copies_and_odd_rows(spark):
    points = places(9)
    rows = [(("m%d" % (i % 3), i), p.tolist()) for i, p in enumerate(points)] + [(("c", i), points[3].tolist()) for i in range(30)] + [(("n", 0), None)]
    every = np.concatenate([points, np.repeat(points[3:4], 30, axis=0)])
    want = partition({k: int(c) for (k, v), c in zip(rows, similarity.density_labels(square(every)).tolist(), strict=False) if v is not None})
    got = {(r.m, r.e): r.cluster for r in corpus_clusters.cluster_corpus(frame(spark, rows, "m string, e int"), ["m", "e"]).collect()}
    assert partition(got) == want and ("n", 0) not in got
    few = frame(spark, rows[:3], "m string, e int")
    assert {r.cluster for r in corpus_clusters.cluster_corpus(few, ["m", "e"]).collect()} == {-1}
    assert corpus_clusters.cluster_corpus(few.limit(0), ["m", "e"]).count() == 0
    same = frame(spark, [((i,), (1.0, 2.0)) for i in range(20)])
    assert {r.cluster for r in corpus_clusters.cluster_corpus(same, ["k"]).collect()} == {-1}  # the root is never chosen
