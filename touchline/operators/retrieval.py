"""Nearest neighbours of scaled vectors, predictions from them, and recommendations."""

from __future__ import annotations

import heapq
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators import metric


def scaler(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a constant column is divided by 1."""
    got = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (got[f"m_{c}"] or 0.0, got[f"s_{c}"] or 1.0) for c in columns}


def scaled(rows: DataFrame, columns: list[str], key: list[str], by: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    by = scaler(rows, columns) if by is None else by
    return rows.select(*key, F.array(*[(F.col(c) - by[c][0]) / by[c][1] for c in columns]).alias("v"))


def store(df: DataFrame) -> DataFrame:
    """Writes a table where spark.checkpoint.dir says and reads it again; a local session without that setting (tests) gets a folder of its own."""
    spark = df.sparkSession
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    folder = f"{where.rstrip('/')}/table-{uuid.uuid4()}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _met(some: pa.Table, library: DataFrame, key: str, k: int, vector: str) -> DataFrame:
    """(query, key, distance, rank): the k nearest of the library for each query of one block, which is sent to the tasks."""
    kind = library.schema[key].dataType.simpleString()
    shared = library.sparkSession.sparkContext.broadcast((some.column(0).to_pylist(), np.array(some.column(1).to_pylist(), dtype=float)))

    def run(batches):
        keys, vectors = shared.value
        best: list[list] = [[] for _ in keys]
        for batch in batches:
            own = batch.column(0).to_pylist()
            if not own:
                continue
            x = np.array(batch.column(1).to_pylist(), dtype=float)
            for i, (me, v) in enumerate(zip(keys, vectors, strict=True)):
                d = np.sqrt(((x - v) ** 2).sum(axis=1))
                for j in np.lexsort((own, d))[: k + 1]:
                    if own[j] != me:
                        best[i].append((float(d[j]), own[j]))
                best[i] = heapq.nsmallest(k, best[i])
        rows = [(me, other, d) for me, found in zip(keys, best, strict=True) for d, other in found]
        names = ["query", key, "distance"]
        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True))) if rows else pa.RecordBatch.from_pydict({n: [] for n in names})

    w = Window.partitionBy("query").orderBy("distance", key)
    part = library.select(key, vector).mapInArrow(run, f"query {kind}, {key} {kind}, distance double")
    return part.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def nearest(queries: DataFrame, library: DataFrame, key: str | list[str], k: int, vector: str = "v", block: int = 1024, watch=None, **balls) -> DataFrame:
    """(query, key, distance, rank from 0): the k nearest library rows of each query by Euclidean distance, itself (the row with its key)
    left out; ties to the smaller key. With several keys, query and key are structs of them.

    Up to block queries (by one key) are sent to the tasks, and each task keeps its own k best for each of them: one pass over the library
    where it lies. More are met in two passes, however many they are (`metric.k_nearest`): equal vectors are merged, with their k + 1
    smallest keys, and searched for once in balls about pivots. watch: is told the share of distances that was computed; balls: options
    of metric.Balls.
    """
    keys = [key] if isinstance(key, str) else list(key)
    some = queries.select(*keys, vector).limit(block + 1).toArrow() if len(keys) == 1 else None
    if some is not None and some.num_rows <= block:
        if watch:
            watch(1.0)
        return _met(some, library, keys[0], k, vector)
    own = store(metric.distinct_vectors(library, keys, vector, k + 1))
    asked = store(metric.distinct_vectors(queries, keys, vector))
    found, share = metric.k_nearest(asked, metric.Balls(own.select("id", "v"), store, asked=block, **balls), k + 1)
    if watch:
        watch(share)
    # a row of the library that is among the k nearest is a copy of one of the k + 1 nearest vectors
    known = own.select(F.col("id").alias("other"), F.explode("keys").alias("e")).select("other", F.explode(F.array_repeat("e.key", F.least("e.same", F.lit(k)).cast("int"))).alias("key"))
    rows = queries.select(F.struct(*keys).alias("query"), F.col(vector).alias("v")).distinct().join(asked.select("id", "v"), "v").select("id", "query")
    met = rows.join(found, "id").join(known, "other").filter("query <> key")
    w = Window.partitionBy("query").orderBy("far", "key")
    best = met.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)
    if len(keys) == 1:
        return best.select(F.col("query")[keys[0]].alias("query"), F.col("key")[keys[0]].alias(keys[0]), F.col("far").alias("distance"), "rank")
    return best.select("query", "key", F.col("far").alias("distance"), "rank")


def predict(neighbours: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Per query: mean of the neighbours' three outcome flags, and the largest distance."""
    flags = ("reached_final_third", "ended_in_box", "shot_like")
    return neighbours.join(outcomes, key).groupBy("query").agg(*[F.avg(F.col(c).cast("double")).alias(f"p_{c}") for c in flags], F.max("distance").alias("max_distance"))


def outcome_value():
    """1 for a shot, 0.6 for the box, 0.3 for the last third, else 0.05; and a hundredth per second."""
    return F.when(F.col("shot_like"), 1.0).when(F.col("ended_in_box"), 0.6).when(F.col("reached_final_third"), 0.3).otherwise(0.05) + 0.01 * F.col("duration_s")


def cluster(vectors: DataFrame, k: int = 12, seed: int = 42, starts: int = 10):
    """k-means labels of column v (an array), the best of several seeds by cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("features", array_to_vector("v")).persist()  # read by every start; a lost part is computed again
    fits = [KMeans(k=k, seed=seed + i).fit(rows) for i in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).drop("features").withColumnRenamed("prediction", "cluster")


def members(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of clusters without noise, in a table laid out by cluster: cluster, keys. A cluster has as many rows as members, so none is gathered."""
    return labelled.filter("cluster >= 0").select("cluster", *keys).repartition("cluster", *keys).sortWithinPartitions("cluster", *keys)


def cluster_of(episodes: DataFrame, labelled: DataFrame, keys: list[str]) -> DataFrame:
    """The episodes with their cluster; null for noise and for episodes that no clustering has seen."""
    return episodes.join(labelled.filter("cluster >= 0").select(*keys, "cluster"), keys, "left")


def cluster_profiles(labelled: DataFrame) -> DataFrame:
    """Per cluster: n, its most common phase (ties to the first in the alphabet), shares that reach the last third and that shoot, text."""
    rows = labelled.groupBy("cluster").agg(F.count("*").alias("n"), F.mode("phase", True).alias("phase"), F.avg(F.col("reached_final_third").cast("double")).alias("pct_third"), F.avg(F.col("shot_like").cast("double")).alias("pct_shot"))
    return rows.withColumn("label", F.format_string("%s, %d episodes, %.0f%% final third, %.0f%% shots", "phase", "n", F.col("pct_third") * 100, F.col("pct_shot") * 100))


def _matching(labelled: DataFrame, pairs: DataFrame | None, keys: list[str], **formations: str | None) -> DataFrame:
    """The rows whose episode has the given formations (a side without one is free)."""
    wanted = {f"{side}_formation": f for side, f in formations.items() if f is not None}
    if not wanted:
        return labelled
    kept = pairs
    for column, formation in wanted.items():
        kept = kept.filter(F.col(column) == formation)
    return labelled.join(kept.select(*keys), keys, "left_semi")


def recommend(labelled: DataFrame, pairs: DataFrame | None = None, defender: str | None = None, attacker: str | None = None, keys: tuple[str, ...] = ("match_id", "period", "episode_id"), least: int = 3, top: int = 5) -> DataFrame:
    """Clusters that worked best, against a defender's formation (and for an attacker's) where these are named: rank from 0, cluster,
    n, n_cluster (its episodes before the filter), value, pct_shot, pct_box, phase (the most common, ties to the first in the
    alphabet) and examples (the three of most value, ties to the smaller key). Clusters with fewer than least episodes left go.

    labelled: keys, cluster, phase and the outcome's columns; pairs: keys, attacker_formation, defender_formation.
    """
    ids = F.struct(*keys)
    best = Window.partitionBy("cluster").orderBy(F.desc("value_"), *keys)
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n_cluster"))
    left = _matching(labelled, pairs, list(keys), defender=defender, attacker=attacker).withColumn("value_", outcome_value())
    placed = left.withColumn("place_", F.row_number().over(best))
    sums = placed.groupBy("cluster").agg(
        F.count("*").alias("n"), F.round(F.avg("value_"), 3).alias("value"), F.round(F.avg(F.col("shot_like").cast("double")), 3).alias("pct_shot"), F.round(F.avg(F.col("ended_in_box").cast("double")), 3).alias("pct_box"),
        F.mode("phase", True).alias("phase"), F.array_sort(F.collect_list(F.when(F.col("place_") <= 3, F.struct("place_", ids.alias("id"))))).alias("examples"), F.avg("value_").alias("exact_"),
    ).filter(F.col("n") >= least)
    rank = F.row_number().over(Window.orderBy(F.desc("exact_"), "cluster")) - 1  # a row per cluster
    out = sums.join(sizes, "cluster").withColumn("rank", rank).filter(F.col("rank") < top)
    return out.select("rank", "cluster", "n", "n_cluster", "value", "pct_shot", "pct_box", "phase", F.transform("examples", lambda e: e["id"]).alias("examples"))


def recommend_defence(outcomes: DataFrame, pairs: DataFrame, attacker: str, keys: tuple[str, ...] = ("match_id", "period", "episode_id"), least: int = 3, top: int = 3) -> DataFrame:
    """Defender's formations by mean outcome value against an attacker's formation, the least first: rank from 0, defender_formation, n, value, pct_shot, pct_box."""
    met = outcomes.join(pairs.filter((F.col("attacker_formation") == attacker) & F.col("defender_formation").isNotNull()).select(*keys, "defender_formation"), list(keys))
    sums = met.groupBy("defender_formation").agg(
        F.count("*").alias("n"), F.round(F.avg(outcome_value()), 3).alias("value"), F.round(F.avg(F.col("shot_like").cast("double")), 3).alias("pct_shot"), F.round(F.avg(F.col("ended_in_box").cast("double")), 3).alias("pct_box")
    ).filter(F.col("n") >= least)
    return sums.withColumn("rank", F.row_number().over(Window.orderBy("value", "defender_formation")) - 1).filter(F.col("rank") < top)


def cross_source_rate(neighbours: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Per query: share of its neighbours from another source. sources: key, source."""
    own = sources.select(F.col(key).alias("query"), F.col("source").alias("own_"))
    return neighbours.join(sources.select(key, "source"), key).join(own, "query").groupBy("query").agg(F.avg((F.col("source") != F.col("own_")).cast("double")).alias("cross_source"))


def source_mix(labelled: DataFrame) -> DataFrame:
    """Episodes per cluster and source."""
    return labelled.groupBy("cluster", "source").agg(F.count("*").alias("n"))


def jaccard(a, b):
    """Overlap of two arrays as sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))
