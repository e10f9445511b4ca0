"""Formation templates, role assignment, and what is read off them. Assignments are exact and run over a batch of frames at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions import geometry as G
from touchline.operators.tracking import FRAME, MATCH, places, snapshots

# Slots (role, x, y) of each formation, attacking right.
TEMPLATES = {
    "4-3-3": (("LB", 40, 14), ("LCB", 40, 28), ("RCB", 40, 40), ("RB", 40, 54), ("LCM", 60, 22), ("DM", 55, 34), ("RCM", 60, 46), ("LW", 80, 12), ("ST", 85, 34), ("RW", 80, 56)),
    "4-4-2": (("LB", 40, 12), ("LCB", 40, 28), ("RCB", 40, 40), ("RB", 40, 56), ("LM", 65, 10), ("LCM", 60, 28), ("RCM", 60, 40), ("RM", 65, 58), ("LF", 85, 26), ("RF", 85, 42)),
    "4-2-3-1": (("LB", 40, 12), ("LCB", 40, 28), ("RCB", 40, 40), ("RB", 40, 56), ("LDM", 58, 28), ("RDM", 58, 40), ("LAM", 78, 14), ("CAM", 76, 34), ("RAM", 78, 54), ("ST", 88, 34)),
}
LEAST_FIELD, SLOTS, LEAST_FRAMES = 9, 10, 25
SHAPE = ("length", "width", "hull_area", "def_line", "off_line", "vertical_compactness")


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, players, slots) costs to each player's slot and the least total, with no slot used twice.

    Dynamic programming over the sets of slots that the first players take; each step is one array operation a slot over
    all frames and sets.
    """
    frames, players, slots = cost.shape
    if players > slots:
        raise ValueError("more players than slots")
    sets = np.arange(1 << slots)
    size = np.array([bin(s).count("1") for s in sets])
    best = np.full((frames, 1 << slots), np.inf)
    best[:, 0] = 0
    took = np.zeros((players, frames, 1 << slots), dtype=np.int8)
    for p in range(players):
        new = np.full_like(best, np.inf)
        for j in range(slots):
            old = sets[(size == p) & (sets >> j & 1 == 0)]
            into = old | 1 << j
            total = best[:, old] + cost[:, p, j, None]
            less = total < new[:, into]
            new[:, into] = np.where(less, total, new[:, into])
            took[p][:, into] = np.where(less, j, took[p][:, into])
        best = new
    at, rows = best.argmin(axis=1), np.arange(frames)
    least, out = best[rows, at], np.zeros((frames, players), dtype=np.int64)
    for p in range(players - 1, -1, -1):
        out[:, p] = took[p, rows, at]
        at = at ^ (1 << out[:, p])
    return out, least


def _costs(xs: np.ndarray, ys: np.ndarray, template: str) -> np.ndarray:
    slots = np.array([s[1:] for s in TEMPLATES[template]], dtype=float)
    return (xs[:, :, None] - slots[:, 0]) ** 2 + (ys[:, :, None] - slots[:, 1]) ** 2


@F.pandas_udf(T.StructType().add("formation", "string").add("cost", "double"))
def best_template(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    """The template with the least total cost for a team's outfield players, attacking right (two arrays a row); null unless there are 9 or 10 of them."""
    names = list(TEMPLATES)
    out = pd.DataFrame({"formation": [None] * len(xs), "cost": pd.array([None] * len(xs), dtype="Float64")})
    many = np.array([-1 if x is None else len(x) for x in xs])
    for n in (LEAST_FIELD, SLOTS):
        rows = np.flatnonzero(many == n)
        if len(rows):
            a, b = np.stack(xs.iloc[rows].to_list()).astype(float), np.stack(ys.iloc[rows].to_list()).astype(float)
            costs = np.stack([assign(_costs(a, b, t))[1] for t in names])
            out.loc[rows, "formation"] = [names[k] for k in costs.argmin(axis=0)]
            out.loc[rows, "cost"] = costs.min(axis=0)
    return out


@F.pandas_udf(T.StructType().add("slot", T.ArrayType(T.IntegerType())).add("displacement", T.ArrayType(T.DoubleType())))
def slots_of(xs: pd.Series, ys: pd.Series, template: pd.Series) -> pd.DataFrame:
    """Each of ten outfield players' slot and distance from it; any other number of players is an error."""
    slot, far = [None] * len(xs), [None] * len(xs)
    if (bad := [len(x) for x in xs if len(x) != SLOTS]):
        raise ValueError(f"roles are for exactly {SLOTS} players, not {bad[0]}")
    for name in template.unique():
        rows = np.flatnonzero(template == name)
        cost = _costs(np.stack(xs.iloc[rows].to_list()).astype(float), np.stack(ys.iloc[rows].to_list()).astype(float), name)
        found, _ = assign(cost)
        apart = np.sqrt(np.take_along_axis(cost, found[:, :, None], axis=2)[:, :, 0])
        for i, r in enumerate(rows):
            slot[r], far[r] = found[i].tolist(), apart[i].tolist()
    return pd.DataFrame({"slot": slot, "displacement": far})


def _seen(players, team, right):
    """A team's players as structs (x, id, y) as it attacks to the right, each place of a player once."""
    return F.transform(F.filter(places(players), lambda p: p["team_id"] == team), lambda p: F.struct(F.when(right, p["x"]).otherwise(G.LENGTH - p["x"]).alias("x"), p["player_id"].alias("id"), F.when(right, p["y"]).otherwise(G.WIDTH - p["y"]).alias("y")))


def formations(frame_rows: DataFrame, teams: tuple[str, ...] = ("home", "away")) -> DataFrame:
    """Per frame and team: formation and cost without the deepest visible player; null where fewer than 9 or more than 10 are left."""
    rows = frame_rows.withColumn("team_id", F.explode(F.array(*[F.lit(t) for t in teams])))
    field = rows.withColumn("own_", F.array_sort(_seen(F.col("players"), F.col("team_id"), F.col("team_id") == teams[0])))
    field = field.withColumn("own_", F.slice("own_", 2, 100))
    axis = lambda c: F.transform("own_", lambda p: p[c])
    return field.withColumn("fit_", best_template(axis("x"), axis("y"))).select(*FRAME, "team_id", "fit_.formation", "fit_.cost")


def formation_pairs(episode_rows: DataFrame, frame_rows: DataFrame, representative: str = "median", teams: tuple[str, ...] = ("home", "away")) -> DataFrame:
    """Per episode: representative_frame (start, end or the middle one), attacker and defender, and their formations and costs; null where none fits."""
    at = {"start": F.col("start_frame"), "end": F.col("end_frame")}.get(representative, F.floor((F.col("start_frame") + F.col("end_frame")) / 2))
    chosen = episode_rows.select(*MATCH, "episode_id", at.alias("frame_id"), F.col("possession_team").alias("attacker_team_id"), F.when(F.col("possession_team") == teams[0], teams[1]).otherwise(teams[0]).alias("defender_team_id"))
    met = chosen.join(frame_rows.select(*FRAME, "players"), FRAME, "left")
    fits = formations(met.filter("players is not null").select(*FRAME, "players").distinct(), teams)
    for side in ("attacker", "defender"):
        own = fits.select(*FRAME, F.col("team_id").alias(f"{side}_team_id"), F.col("formation").alias(f"{side}_formation"), F.col("cost").alias(f"{side}_formation_cost"))
        met = met.join(own, [*FRAME, f"{side}_team_id"], "left")
    return met.select(*MATCH, "episode_id", F.col("frame_id").alias("representative_frame"), *[f"{s}_{c}" for s in ("attacker", "defender") for c in ("team_id", "formation", "formation_cost")])


def role_trajectory(in_episode: DataFrame, template: str = "4-3-3", hz: float = 2.0) -> DataFrame:
    """Per snapshot of an episode and possessing team's player: role, x, y, slot and displacement, attacking right.

    The goalkeeper is the player with the lowest mean x of the episode; only snapshots with ten others count.
    """
    key = [*MATCH, "episode_id"]
    own = _seen(F.col("players"), F.col("team"), F.col("to_right"))
    everyone = in_episode.select(*key, F.inline(own)).groupBy(*key, "id").agg(F.avg("x").alias("m")).groupBy(*key).agg(F.min_by("id", F.struct("m", "id")).alias("keeper_"))
    rows = snapshots(in_episode, hz).join(everyone, key).withColumn("own_", F.filter(F.array_sort(_seen(F.col("players"), F.col("team"), F.col("to_right"))), lambda p: p["id"] != F.col("keeper_")))
    axis = lambda c: F.transform("own_", lambda p: p[c])
    fitted = rows.filter(F.size("own_") == SLOTS).withColumn("fit_", slots_of(axis("x"), axis("y"), F.lit(template)))
    each = fitted.select(*key, "frame_id", F.col("team").alias("team_id"), F.inline(F.arrays_zip("own_", F.col("fit_.slot").alias("slot"), F.col("fit_.displacement").alias("displacement"))))
    part = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in TEMPLATES[template]]), F.col("slot") + 1)
    return each.select(*key, "frame_id", "team_id", F.col("own_.id").alias("player_id"), part(0).alias("role"), F.col("own_.x").alias("x"), F.col("own_.y").alias("y"), part(1).cast("double").alias("slot_x"), part(2).cast("double").alias("slot_y"), "displacement")


def tracking_profile(shape_rows: DataFrame, classified: DataFrame, least: int = LEAST_FRAMES) -> DataFrame:
    """Means of the shape numbers per match, team and phase, over phases with at least so many frames."""
    met = shape_rows.join(classified.select(*FRAME, "phase"), FRAME)
    return met.groupBy("match_id", "team_id", "phase").agg(*[F.avg(c).alias(f"{c}_mean") for c in SHAPE], F.count("*").alias("n_frames")).filter(F.col("n_frames") >= least)
