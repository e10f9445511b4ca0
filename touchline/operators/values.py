"""Action values: expected threat on a grid, and the labels and features of action-probability models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry as G
from touchline.functions.sequence import ordered

ROWS, COLS, MAX_SWEEPS, TOLERANCE = 12, 16, 100, 1e-6
# One-hot columns of the action model, and how many actions ahead it looks.
ACTIONS = ("pass", "dribble", "shot", "cross", "take_on", "interception", "clearance", "tackle", "block", "keeper_action", "foul", "receival")
BODIES = ("right_foot", "left_foot", "head", "other")
LOOK_AHEAD = 10


def cell_of(x: Column, y: Column, rows: int = ROWS, cols: int = COLS) -> tuple[Column, Column]:
    return G.cell(y, G.WIDTH, rows), G.cell(x, G.LENGTH, cols)


def _moves() -> Column:
    return F.col("action_type").isin("pass", "dribble") & (F.col("result") == "success") & F.col("end_x").isNotNull() & F.col("end_y").isNotNull()


def xt_counts(events: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """Per start cell: shots, goals, moves."""
    r, c = cell_of(F.col("start_x"), F.col("start_y"), rows, cols)
    shot = F.col("action_type") == "shot"
    return events.filter("start_x is not null and start_y is not null").groupBy(r.alias("r"), c.alias("c")).agg(
        F.count_if(shot).alias("shots"), F.count_if(shot & (F.col("result") == "success")).alias("goals"), F.count_if(_moves()).alias("moves")
    )


def xt_transitions(events: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """Per pair of cells: successful passes and dribbles from one to the other."""
    r, c = cell_of(F.col("start_x"), F.col("start_y"), rows, cols)
    r2, c2 = cell_of(F.col("end_x"), F.col("end_y"), rows, cols)
    return events.filter(F.col("start_x").isNotNull() & F.col("start_y").isNotNull() & _moves()).groupBy(r.alias("r"), c.alias("c"), r2.alias("r2"), c2.alias("c2")).agg(F.count("*").alias("n"))


def fit_xt(events: DataFrame, rows: int = ROWS, cols: int = COLS, max_sweeps: int = MAX_SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """The grid (r, c, xt, shoot_prob, goal_prob, move_prob) with a row per cell.

    The counts are aggregated on the cluster; the fixed point of at most rows * cols unknowns is found on the driver.
    """
    spark = events.sparkSession
    n = rows * cols
    shots, goals, moves, steps = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, n))
    for x in xt_counts(events, rows, cols).collect():
        i = x["r"] * cols + x["c"]
        shots[i], goals[i], moves[i] = x["shots"], x["goals"], x["moves"]
    for x in xt_transitions(events, rows, cols).collect():
        steps[x["r"] * cols + x["c"], x["r2"] * cols + x["c2"]] = x["n"]
    share = lambda a, b: np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b > 0)
    shoot, score, move = share(shots, shots + moves), share(goals, shots), share(moves, shots + moves)
    flow = share(steps, np.repeat(moves[:, None], n, axis=1))
    value = np.zeros(n)
    for _ in range(max_sweeps):
        new = shoot * score + move * (flow @ value)
        gap, value = np.abs(new - value).max(), new
        if gap < tolerance:
            break
    data = [(i // cols, i % cols, float(value[i]), float(shoot[i]), float(score[i]), float(move[i])) for i in range(n)]
    return spark.createDataFrame(data, "r int, c int, xt double, shoot_prob double, goal_prob double, move_prob double")


def apply_xt(events: DataFrame, grid: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """Adds xt (of the start cell) and xt_delta (end less start, of successful passes and dribbles only, else null)."""
    r, c = cell_of(F.col("start_x"), F.col("start_y"), rows, cols)
    r2, c2 = cell_of(F.col("end_x"), F.col("end_y"), rows, cols)
    start = F.broadcast(grid.select(F.col("r").alias("r_"), F.col("c").alias("c_"), F.col("xt")))  # rows * cols rows
    end = F.broadcast(grid.select(F.col("r").alias("r2_"), F.col("c").alias("c2_"), F.col("xt").alias("end_xt")))
    both = events.withColumns({"r_": r, "c_": c, "r2_": r2, "c2_": c2}).join(start, ["r_", "c_"], "left").join(end, ["r2_", "c2_"], "left")
    return both.withColumn("xt_delta", F.when(_moves(), F.col("end_xt") - F.col("xt"))).drop("r_", "c_", "r2_", "c2_", "end_xt")


def vaep_labels(events: DataFrame, ahead: int = LOOK_AHEAD) -> DataFrame:
    """Adds scores and concedes: whether the action's team, or the other, scores in it or the ahead actions after it."""
    w = Window.partitionBy("match_id").orderBy("seq").rowsBetween(Window.currentRow, ahead)
    goal = (F.col("action_type") == "shot") & (F.col("result") == "success")
    goals = F.collect_list(F.when(goal, F.col("team_id"))).over(w)
    return events.withColumn("goals_", goals).withColumns({"scores": F.array_contains("goals_", F.col("team_id")), "concedes": F.exists("goals_", lambda t: t != F.col("team_id"))}).drop("goals_")


def vaep_features(events: DataFrame) -> DataFrame:
    """The 25 columns of the action model in their fixed order, by match_id and seq. Missing and non-finite numbers count as 0."""
    number = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double")).otherwise(0.0)
    sx, sy, ex, ey = (number(c) for c in ("start_x", "start_y", "end_x", "end_y"))
    half = G.GOAL_WIDTH / 2
    away = lambda x, y: (F.lit(G.LENGTH) - x, F.lit(G.GOAL_Y) - y)
    (dx, dy), (dx2, dy2) = away(sx, sy), away(ex, ey)
    angle = F.atan2(G.GOAL_WIDTH * F.greatest(dx, F.lit(1e-6)), dx * dx + dy * dy - half * half)
    columns = {
        "start_x_oriented": sx, "start_y": sy, "end_x_oriented": ex, "end_y": ey, "distance_to_goal_start": F.sqrt(dx * dx + dy * dy), "distance_to_goal_end": F.sqrt(dx2 * dx2 + dy2 * dy2),
        "angle_to_goal_start": angle, "period": number("period"), "time_since_period_start": F.greatest(number("time_seconds"), F.lit(0.0)),
    }
    columns |= {f"action_{a}": (F.coalesce("action_type", F.lit("")) == a).cast("double") for a in ACTIONS}
    columns |= {f"body_{b}": (F.coalesce("bodypart", F.lit("")) == b).cast("double") if "bodypart" in events.columns else F.lit(0.0) for b in BODIES}
    return events.select("match_id", "seq", *[c.alias(k) for k, c in columns.items()])


def fit_vaep(events: DataFrame, seed: int = 0):
    """Two gradient-boosted classifiers (scores, concedes) on the features, as pipeline models; a label with one class gives its constant."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = vaep_features(events).join(vaep_labels(events).select("match_id", "seq", F.col("scores").cast("double").alias("scores_"), F.col("concedes").cast("double").alias("concedes_")), ["match_id", "seq"])
    inputs = [c for c in rows.columns if c not in ("match_id", "seq", "scores_", "concedes_")]
    out = {}
    for label in ("scores", "concedes"):
        low, high = rows.agg(F.min(f"{label}_"), F.max(f"{label}_")).first()
        if low is None:
            raise ValueError("no events")
        gbt = GBTClassifier(labelCol=f"{label}_", featuresCol="features_", maxIter=50, maxDepth=3, stepSize=0.1, seed=seed)
        out[label] = float(low) if low == high else Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features_"), gbt]).fit(rows)
    return out


def score_vaep(events: DataFrame, models: dict) -> DataFrame:
    """match_id, seq, p_score_before, p_score_after, p_concede_before, p_concede_after, vaep_value: the action as it stands (before), and
    with the ball where it ends (after: start moved to the end); the gain in scoring less the gain in conceding."""
    from pyspark.ml.functions import vector_to_array

    after = events.withColumns({"start_x": F.col("end_x"), "start_y": F.col("end_y")})
    names = {"scores": "p_score", "concedes": "p_concede"}

    def rated(rows: DataFrame, tag: str) -> DataFrame:
        out = vaep_features(rows)
        for label, model in models.items():
            name = f"{names[label]}_{tag}"
            out = out.withColumn(name, F.lit(model)) if isinstance(model, float) else model.transform(out).withColumn(name, vector_to_array("probability")[1]).drop("features_", "rawPrediction", "probability", "prediction")
        return out.select("match_id", "seq", *[f"{names[label]}_{tag}" for label in models])

    both = rated(events, "before").join(rated(after, "after"), ["match_id", "seq"])
    gain = lambda name: F.col(f"{name}_after") - F.col(f"{name}_before")
    return both.withColumn("vaep_value", gain("p_score") - gain("p_concede"))


def value_change(events: DataFrame) -> DataFrame:
    """Actions in order with the score so far: goals_home and goals_away before each action of a match."""
    w = ordered(["match_id"], ["seq"]).rowsBetween(Window.unboundedPreceding, -1)
    goal = (F.col("action_type") == "shot") & (F.col("result") == "success") & (F.col("period") != 5)
    side = lambda t: F.coalesce(F.sum((goal & (F.col("team_id") == t)).cast("long")).over(w), F.lit(0))
    return events.select("match_id", "seq", "team_id", side("home").alias("goals_home"), side("away").alias("goals_away"))
