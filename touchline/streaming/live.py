"""Episodes, threat and predictions of matches in progress.

Input is a stream of frames (tracking.frames' columns). What depends on one frame alone (the nearest team, each team's shape,
the threat) is computed as columns, in parallel; only these numbers go to the step that keeps state, one key per match and
period. It gives an `event` row per frame, and one per episode that ends. Predictions look up a library of known episodes
without state, and are joined to realised outcomes where these have come.

A period's frames must come in order over micro-batches; within one they are sorted, and frames not later than the last one
seen are left out. Episodes have the numbers and bounds that `tracking.episodes` gives them, but for the one still in play.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.functions import geometry as G
from touchline.operators import surfaces, tracking

# Frames between two looks at the threat and between two predictions, neighbours, distances of low and medium trust.
THREAT_EVERY, PREDICT_EVERY, NEIGHBOURS, LOW_TRUST_M, MEDIUM_SHARE = 5, 12, 3, 5.0, 0.6
MOST_LIBRARY_BYTES = 256 << 20
FLAGS = ("reached_final_third", "ended_in_box", "shot_like")
EVENTS = (
    "match_id string, period int, kind string, frame_id long, time_s double, possession_team string, episode_id int, phase string, duration_s double, threat double, threat_age_frames int, "
    "features array<double>, start_frame long, end_frame long, end_reason string, reached_final_third boolean, ended_in_box boolean, shot_like boolean"
)
STATE = {"frame": None, "held": None, "candidate": None, "streak": 0, "flip": None, "unseen": 0, "episode": None, "next": 0}


def prepared(frame_rows: DataFrame, teams: tuple[str, str] = ("home", "away"), rows: int = 40, cols: int = 60, every: int = THREAT_EVERY, also: tuple[str, ...] = ()) -> DataFrame:
    """Per frame: nearest team, ball, and per team n, mean, least and greatest x, length, width, deviation of x and (each every-th frame) threat. also: columns to keep."""
    out = tracking.possession(frame_rows)
    for k, team in enumerate(teams):
        own = F.filter("players", lambda p: p["team_id"] == team)  # noqa: B023
        x, y = F.transform(own, lambda p: p["x"]), F.transform(own, lambda p: p["y"])
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        mean = total(x) / F.size(x)
        deviation = F.when(F.size(x) >= 2, F.sqrt((total(F.transform(x, lambda v: v * v)) - F.size(x) * mean * mean) / (F.size(x) - 1)))
        spread = lambda a: F.when(F.size(a) >= 2, F.array_max(a) - F.array_min(a))
        shape = F.array(F.size(x).cast("double"), F.when(F.size(x) > 0, mean), F.array_min(x), F.array_max(x), spread(x), spread(y), deviation)
        peak = surfaces.with_peak(out.withColumn("team", F.lit(team)), rows, cols, F.col("frame_id") % every == 0)
        out = peak.withColumn(f"shape_{k}", shape).withColumnRenamed("obso_max", f"threat_{k}").drop("team", "obso_argmax_x", "obso_argmax_y")
    return out.select(*tracking.FRAME, "time_seconds", "raw_team", F.col("ball.x").alias("bx"), F.col("ball.y").alias("by"), F.hypot("ball.vx", "ball.vy").alias("bv"), "shape_0", "shape_1", "threat_0", "threat_1", *also)


def features(samples: list[list], phase: str | None) -> list[float]:
    """The 24 numbers of tracking.embeddings for the samples of an episode so far: time, oriented ball x, ball y, speed, and seven of the teams' shapes."""
    a = np.array(samples, dtype=float)
    t, x, y, v = a[:, 0], a[:, 1], a[:, 2], a[:, 3]
    seen = np.flatnonzero(~np.isnan(x))
    mean = lambda c: float(np.nanmean(c)) if (~np.isnan(c)).any() else 0.0
    first = lambda c: float(c[seen[0]]) if len(seen) else 0.0
    last = lambda c: float(c[seen[-1]]) if len(seen) else 0.0
    far = float(np.nanmax(x)) if len(seen) else 0.0
    slope = float(np.polyfit(t[seen], x[seen], 1)[0]) if len(seen) > 1 and t[seen].max() > t[seen].min() else 0.0
    shapes = [mean(a[:, c]) for c in range(4, 10)]
    out = [float(t.max() - t.min()), first(x), first(y), last(x), last(y), far, far - first(x), mean(v), float(np.nanmax(v)) if (~np.isnan(v)).any() else 0.0, slope, *shapes, mean(a[:, 10]) - shapes[2]]
    return out + [float(phase == p) for p in tracking.PHASES]


def _sample(r, team: str, teams: tuple[str, str], start: float) -> list:
    """A frame as the possessing team sees it, attacking to the right."""
    right, own, other = team == teams[0], *((r.shape_0, r.shape_1) if team == teams[0] else (r.shape_1, r.shape_0))
    flip = lambda v: v if right or v is None else G.LENGTH - v
    ball = lambda v: None if pd.isna(v) else float(v)
    return [round(r.time_seconds - start, 3), flip(ball(r.bx)), ball(r.by), ball(r.bv), flip(own[1]), flip(other[2] if right else other[3]), own[4], own[5], own[0], other[0], other[6]]


def _step(s: dict, r, teams: tuple[str, str], hold: int, dead: int, hz: float) -> tuple[dict | None, str | None]:
    """Moves the state on by a frame; gives the episode that it ends, if any, and the frame's phase."""
    ended, unseen = None, pd.isna(r.bx)
    raw = None if pd.isna(r.raw_team) else r.raw_team
    s["streak"] = s["streak"] + 1 if raw == s["candidate"] else 1
    s["candidate"] = raw
    if raw is not None and s["streak"] >= hold and raw != s["held"]:
        s["held"], s["flip"] = raw, r.time_seconds
    s["unseen"] = s["unseen"] + 1 if unseen else 0
    e = s["episode"]
    if e and s["unseen"] >= dead:
        ended = e | {"end_reason": "out_of_play", "end": e["seen_end"], "end_time": e["seen_time"]}
        e = None
    elif e and s["held"] != e["team"]:
        ended = e | {"end_reason": "possession_change"}
        e = None
    if e is None and s["held"] is not None and s["unseen"] < dead:
        e = {"id": s["next"], "team": s["held"], "start": r.frame_id, "start_time": r.time_seconds, "third": False, "last": None, "samples": [], "threat": 0.0, "threat_frame": None, "predicted": None, "seen_end": r.frame_id, "seen_time": r.time_seconds}
        s["next"] += 1
    if e:
        e["end"], e["end_time"] = r.frame_id, r.time_seconds
        if not unseen:
            x = r.bx if e["team"] == teams[0] else G.LENGTH - r.bx
            e |= {"seen_end": r.frame_id, "seen_time": r.time_seconds, "third": e["third"] or bool(x > G.FINAL_THIRD_X), "last": [float(x), float(r.by), None if pd.isna(r.bv) else float(r.bv)]}
        if not e["samples"] or r.time_seconds - e["start_time"] >= e["samples"][-1][0] + 1 / hz - 1e-9:
            e["samples"].append(_sample(r, e["team"], teams, e["start_time"]))
        threat = r.threat_0 if e["team"] == teams[0] else r.threat_1
        if not pd.isna(threat):
            e["threat"], e["threat_frame"] = float(threat), r.frame_id
    s["episode"], s["frame"] = e, r.frame_id
    return ended, _phase(s, r, teams)


def _phase(s: dict, r, teams: tuple[str, str]) -> str:
    """The label that tracking.classify gives the frame."""
    if s["held"] is None:
        return "set_piece"
    if s["flip"] is not None and r.time_seconds - s["flip"] <= tracking.TRANSITION_S:
        return "att_transition"
    if pd.isna(r.bx):
        return "progression"
    low, high = tracking.THIRDS
    own, far = (r.bx < low, r.bx > high) if s["held"] == teams[0] else (r.bx > high, r.bx < low)
    return "build_up" if own else "finishing" if far else "progression"


def engine(frame_rows: DataFrame, teams: tuple[str, str] = ("home", "away"), predict_every: int = PREDICT_EVERY, hold: int = tracking.STICKY_FRAMES, dead: int = tracking.DEAD_FRAMES, hz: float = tracking.SNAPSHOT_HZ) -> DataFrame:
    """The stream of events: kind `frame` (state after each frame; features where a prediction is due) and `episode` (one that ended, with its outcome).

    State per match and period: runs of the nearest team and of unseen balls, and the sums and half-second samples of the one
    episode in play. An empty micro-batch gives nothing.
    """

    def play(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else dict(STATE)
        out = []
        for r in pd.concat(list(parts)).sort_values("frame_id").itertuples(index=False):
            if s["frame"] is not None and r.frame_id <= s["frame"]:
                continue
            ended, phase = _step(s, r, teams, hold, dead, hz)
            if ended:
                x, y, v = ended["last"] or (float("nan"),) * 3
                box = bool(x >= G.BOX_X and G.BOX_Y[0] <= y <= G.BOX_Y[1])
                out.append((*key, "episode", r.frame_id, r.time_seconds, ended["team"], ended["id"], None, round(ended["end_time"] - ended["start_time"], 3), None, None, None, ended["start"], ended["end"], ended["end_reason"], ended["third"], box, box and v is not None and v >= tracking.SHOT_SPEED))
            e, due = s["episode"], None
            if e and (e["predicted"] is None or r.frame_id - e["predicted"] >= predict_every):
                e["predicted"], due = r.frame_id, features(e["samples"], phase)
            age = None if not e or e["threat_frame"] is None else r.frame_id - e["threat_frame"]
            out.append((*key, "frame", r.frame_id, r.time_seconds, s["held"], e["id"] if e else -1, phase, round(r.time_seconds - e["start_time"], 3) if e else 0.0, e["threat"] if e else 0.0, age, due, e["start"] if e else None, None, None, None, None, None))
        state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"threat_age_frames": "Int32", "start_frame": "Int64", "end_frame": "Int64"})

    rows = prepared(frame_rows, teams)
    return rows.groupBy("match_id", "period").applyInPandasWithState(play, EVENTS, "state string", "append", GroupStateTimeout.NoTimeout)


def known_library(library: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, scaled vectors, mean, scale and flags of a library of episodes, in order of key, up to MOST_LIBRARY_BYTES."""
    n = library.count()
    if n * (8 * len(columns) + 64) > MOST_LIBRARY_BYTES:
        raise ValueError("the library passes MOST_LIBRARY_BYTES: meet it with retrieval.nearest")
    known = library.orderBy("key").toPandas()
    v = known[columns].to_numpy(dtype=float)
    mean, scale = (v.mean(axis=0), np.where(v.std(axis=0) > 0, v.std(axis=0), 1.0)) if n > 1 else (np.zeros(len(columns)), np.ones(len(columns)))
    return known["key"].to_numpy(), (v - mean) / scale, mean, scale, known[list(FLAGS)].to_numpy(dtype=float)


def predictions(events: DataFrame, library: DataFrame, columns: list[str], k: int = NEIGHBOURS, low: float = LOW_TRUST_M) -> DataFrame:
    """Per due frame: mean flags and ids of the k nearest known episodes, the largest distance, and how far to trust it (high, medium, low).

    library: key, the 24 numbers named in columns (tracking.embeddings) and the outcome's flags. It is measured, and sent to
    tasks only up to MOST_LIBRARY_BYTES; beyond that use retrieval.nearest on the due rows of a batch.
    """
    held = events.sparkSession.sparkContext.broadcast(known_library(library, columns))

    @F.pandas_udf(f"neighbours array<{dict(library.dtypes)['key']}>, p_reached_final_third double, p_ended_in_box double, p_shot_like double, max_distance double")
    def look_up(vectors: pd.Series) -> pd.DataFrame:
        keys, vectors_, mean_, scale_, flags = held.value
        out = []
        for x in vectors:
            far = np.sqrt((((np.asarray(x, dtype=float) - mean_) / scale_ - vectors_) ** 2).sum(axis=1))
            near = np.lexsort((np.arange(len(far)), far))[:k]
            out.append((keys[near].tolist(), *(flags[near].mean(axis=0) if len(near) else (0.0, 0.0, 0.0)), float(far[near].max()) if len(near) else 0.0))
        return pd.DataFrame(out, columns=["neighbours", *[f"p_{f}" for f in FLAGS], "max_distance"])

    due = events.filter("kind = 'frame' and features is not null").withColumn("found", look_up("features"))
    trust = F.when(F.col("max_distance") > low, "low").when(F.col("max_distance") > low * MEDIUM_SHARE, "medium").otherwise("high")
    return due.select("match_id", "period", "episode_id", "frame_id", "time_s", "found.*").withColumn("confidence", trust)


def calibration(predicted: DataFrame, events: DataFrame) -> DataFrame:
    """Every prediction with its episode's realised flags, null while it is in play. Both are tables that the streams have written."""
    ends = events.filter("kind = 'episode'").select("match_id", "period", "episode_id", *[F.col(f).alias(f"realised_{f}") for f in FLAGS])
    return predicted.join(ends, ["match_id", "period", "episode_id"], "left")
