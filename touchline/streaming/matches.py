"""Matches in progress with typed state: episodes, open predictions, running means of players, and timers.

The engine of `live` on Spark's arbitrary state operator. What depends on one frame alone is computed as columns before
(`live.prepared`); a match and period keeps

- a value: the runs of the nearest team and of unseen balls, and the numbers of the episode in play;
- a list: the episode's half-second samples, appended to, not rewritten;
- a map: predictions that are open, which the episode's end resolves against what came of it;
- a map: sums of each attacker's places over the episode, for counterfactual frames;
- a timer in event time: a match that falls silent for so long is closed when the watermark passes, and its state goes.

Frames behind the watermark are left out by Spark, which counts them in the query's progress (numRowsDroppedByWatermark);
frames that aren't later than the last one of their match are left out here, counted, and reported in rows of kind `late`.

State stores must be RocksDB's: set STORE for the session before the query starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from touchline.functions import geometry as G
from touchline.operators import credit, tracking
from touchline.streaming import live

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
# The threat from which players are credited, and frames between two such looks.
ATTRIBUTE_FROM, ATTRIBUTE_EVERY = 0.05, 5
#: Seconds of silence after which a match is closed.
ABANDON_S = 600
_P = [f"p_{f}" for f in live.FLAGS]
_REALISED = [f"realised_{f}" for f in live.FLAGS]
_PLAYER = "struct<team_id: string, player_id: string, x: double, y: double, vx: double, vy: double>"
ROWS = (
    live.EVENTS
    + ", ball struct<x: double, y: double>, players array<"
    + _PLAYER
    + ">, means map<string, struct<x: double, y: double>>, neighbours array<string>, "
    + ", ".join(f"{p} double" for p in _P)
    + ", max_distance double, confidence string, "
    + ", ".join(f"{r} boolean" for r in _REALISED)
    + ", n_late long"
)
_COLUMNS = [c.split()[0] for c in live.EVENTS.split(", ")] + ["ball", "players", "means", "neighbours", *_P, "max_distance", "confidence", *_REALISED, "n_late"]
_RUN = ("frame long", "held string", "candidate string", "streak int", "flip double", "unseen int", "next int")
_EPISODE = ("id int", "team string", "start long", "start_time double", "third boolean", "last_x double", "last_y double", "last_v double", "threat double", "threat_frame long", "predicted long")
_EPISODE += ("seen_end long", "seen_time double", "end long", "end_time double")
_MORE = ("late long", "last_ms long", "attributed long", "sampled int")
_SAMPLE = ", ".join(f"s{i} double" for i in range(11))
_name = lambda c: c.split()[0]


def _number(v):
    return None if v is None or pd.isna(v) else float(v)


class _Match(StatefulProcessor):
    """State and rows of one match and period. known: (keys, scaled vectors, mean, scale, flags) of the library of episodes, or None."""

    def __init__(self, teams: tuple[str, str], hold: int, dead: int, hz: float, predict_every: int, attribute_from: float, attribute_every: int, abandon_s: float, low: float, k: int, known):
        self.teams, self.hold, self.dead, self.hz, self.predict_every = teams, hold, dead, hz, predict_every
        self.attribute_from, self.attribute_every, self.abandon_ms, self.low, self.k, self.known = attribute_from, attribute_every, int(abandon_s * 1000), low, k, known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", ", ".join((*_RUN, *(f"e_{c}" for c in _EPISODE), *_MORE)))
        self.samples = handle.getListState("samples", _SAMPLE)
        self.open = handle.getMapState("open", "frame long", "time_s double, " + ", ".join(f"{p} double" for p in _P) + ", max_distance double, confidence string")
        self.sums = handle.getMapState("sums", "player_id string", "x double, y double, n long")

    # -- state as live's step has it

    def _read(self) -> tuple[dict, dict]:
        if not self.now.exists():
            return dict(live.STATE), {"late": 0, "last_ms": None, "attributed": None, "sampled": 0, "sums": {}}
        values = list(self.now.get())
        s = dict(zip(map(_name, _RUN), values, strict=False))
        e = dict(zip(map(_name, _EPISODE), values[len(_RUN) :], strict=False))
        more = dict(zip(map(_name, _MORE), values[len(_RUN) + len(_EPISODE) :], strict=True))
        s["episode"] = None
        if e["id"] is not None:
            last = [e.pop(f"last_{c}") for c in "xyv"]
            s["episode"] = e | {"last": None if last[0] is None else last, "samples": [list(x) for x in self.samples.get()]}
        more["sums"] = {k[0]: list(v) for k, v in self.sums.iterator()}
        return s, more

    def _write(self, s: dict, more: dict, replaced: bool) -> None:
        e, last = s["episode"], (None, None, None)
        if e:
            last = e["last"] or last
        flat = [] if not e else [{**e, "last_x": last[0], "last_y": last[1], "last_v": last[2]}[_name(c)] for c in _EPISODE]
        if replaced or not e:
            self.samples.clear()
            self.sums.clear()
        if e:
            new = e["samples"][0 if replaced else more["sampled"] :]
            if new:
                self.samples.appendList([tuple(_number(v) for v in x) for x in new])
            more["sampled"] = len(e["samples"])
            for player, value in more["sums"].items():
                self.sums.updateValue((player,), tuple(value))
        else:
            more["sampled"] = 0
        plain = lambda v: v.item() if isinstance(v, np.generic) else v
        self.now.update(tuple(plain(v) for v in (*(s[_name(c)] for c in _RUN), *(flat or [None] * len(_EPISODE)), *(more[_name(c)] for c in _MORE))))

    # -- rows

    def _row(self, key: tuple, kind: str, **values) -> tuple:
        filled = dict.fromkeys(_COLUMNS) | {"match_id": key[0], "period": key[1], "kind": kind} | values
        return tuple(filled[c] for c in _COLUMNS)

    def _closed(self, key: tuple, e: dict, frame: int, time_s: float) -> list[tuple]:
        """The episode's row and those of its open predictions, which leave the state."""
        x, y, v = e["last"] or (float("nan"),) * 3
        box = bool(x >= G.BOX_X and G.BOX_Y[0] <= y <= G.BOX_Y[1])
        flags = (bool(e["third"]), box, bool(box and v is not None and v >= tracking.SHOT_SPEED))
        shared = {"episode_id": e["id"], "possession_team": e["team"]}
        out = [self._row(key, "episode", frame_id=frame, time_s=time_s, duration_s=round(e["end_time"] - e["start_time"], 3), start_frame=e["start"], end_frame=e["end"], end_reason=e["end_reason"], **shared, **dict(zip(live.FLAGS, flags, strict=True)))]
        for (at,), (t, *p, far, trust) in sorted(self.open.iterator()):
            out.append(self._row(key, "resolved", frame_id=at, time_s=t, max_distance=far, confidence=trust, **shared, **dict(zip(_P, p, strict=True)), **dict(zip(_REALISED, flags, strict=True))))
        self.open.clear()
        return out

    def _predict(self, key: tuple, e: dict, r, vector: list[float]) -> tuple:
        keys, vectors, mean, scale, flags = self.known
        far = np.sqrt((((np.asarray(vector) - mean) / scale - vectors) ** 2).sum(axis=1))
        near = np.lexsort((np.arange(len(far)), far))[: self.k]
        p = [float(v) for v in flags[near].mean(axis=0)] if len(near) else [0.0] * 3
        most = float(far[near].max()) if len(near) else 0.0
        trust = "low" if most > self.low else "medium" if most > self.low * live.MEDIUM_SHARE else "high"
        self.open.updateValue((int(r.frame_id),), (float(r.time_seconds), *p, most, trust))
        return self._row(key, "prediction", frame_id=r.frame_id, time_s=r.time_seconds, episode_id=e["id"], possession_team=e["team"], neighbours=[str(x) for x in keys[near]], max_distance=most, confidence=trust, **dict(zip(_P, p, strict=True)))

    def _counterfactual(self, key: tuple, e: dict, r, sums: dict) -> tuple:
        means = {player: {"x": x / n, "y": y / n} for player, (x, y, n) in sums.items()}
        ball = None if pd.isna(r.bx) else {"x": float(r.bx), "y": float(r.by)}
        players = [{c: p[c] for c in ("team_id", "player_id", "x", "y", "vx", "vy")} for p in r.players]
        return self._row(key, "attribution", frame_id=r.frame_id, time_s=r.time_seconds, episode_id=e["id"], possession_team=e["team"], threat=e["threat"], ball=ball, players=players, means=means)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        s, more = self._read()
        started, out, late = s["episode"]["id"] if s["episode"] else None, [], 0
        for r in pd.concat(list(rows)).sort_values("frame_id").itertuples(index=False):
            if s["frame"] is not None and r.frame_id <= s["frame"]:
                late += 1
                continue
            before = s["episode"]["id"] if s["episode"] else None
            ended, phase = live._step(s, r, self.teams, self.hold, self.dead, self.hz)
            if ended:
                out += self._closed(key, ended, r.frame_id, r.time_seconds)
            e, due = s["episode"], None
            if e is None or e["id"] != before:
                more["sums"] = {}
            if e:
                for p in r.players:
                    if p["team_id"] == e["team"]:
                        x, y, n = more["sums"].get(p["player_id"], (0.0, 0.0, 0))
                        more["sums"][p["player_id"]] = [x + p["x"], y + p["y"], n + 1]
                if e["predicted"] is None or r.frame_id - e["predicted"] >= self.predict_every:
                    e["predicted"], due = r.frame_id, live.features(e["samples"], phase)
                    if self.known is not None:
                        out.append(self._predict(key, e, r, due))
                seen = e["threat_frame"] == r.frame_id and e["threat"] >= self.attribute_from
                if seen and (more["attributed"] is None or r.frame_id - more["attributed"] >= self.attribute_every):
                    more["attributed"] = r.frame_id
                    out.append(self._counterfactual(key, e, r, more["sums"]))
            age = None if not e or e["threat_frame"] is None else r.frame_id - e["threat_frame"]
            running = {"episode_id": -1, "duration_s": 0.0, "threat": 0.0} if not e else {"episode_id": e["id"], "duration_s": round(r.time_seconds - e["start_time"], 3), "threat": e["threat"], "start_frame": e["start"]}
            out.append(self._row(key, "frame", frame_id=r.frame_id, time_s=r.time_seconds, possession_team=s["held"], phase=phase, threat_age_frames=age, features=due, **running))
            more["last_ms"] = max(more["last_ms"] or 0, int(r.at.timestamp() * 1000))
        if late:
            more["late"] += late
            out.append(self._row(key, "late", frame_id=s["frame"], n_late=late))
        self._write(s, more, started is None or s["episode"] is None or s["episode"]["id"] != started)
        if more["last_ms"] is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(more["last_ms"] + self.abandon_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, _ = self._read()
        e, out = s["episode"], []
        if e:
            out = self._closed(key, e | {"end_reason": "match_end"}, e["end"], e["end_time"])
        for state in (self.now, self.samples, self.open, self.sums):
            state.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
    return out.astype({"period": "Int32", "frame_id": "Int64", "episode_id": "Int32", "threat_age_frames": "Int32", "start_frame": "Int64", "end_frame": "Int64", "n_late": "Int64"} | {c: "Float64" for c in ("time_s", "duration_s", "threat", *_P, "max_distance")})


def engine(
    frame_rows: DataFrame, library: DataFrame | None = None, columns: list[str] | None = None, at: str = "at", delay: str = "10 seconds", teams: tuple[str, str] = ("home", "away"), predict_every: int = live.PREDICT_EVERY,
    hold: int = tracking.STICKY_FRAMES, dead: int = tracking.DEAD_FRAMES, hz: float = tracking.SNAPSHOT_HZ, attribute_from: float = ATTRIBUTE_FROM, attribute_every: int = ATTRIBUTE_EVERY, abandon_s: float = ABANDON_S,
    low: float = live.LOW_TRUST_M, k: int = live.NEIGHBOURS,
) -> DataFrame:
    """A stream of rows of kind frame and episode (as live.engine), prediction, resolved (a prediction with what came of it), attribution
    (a frame to credit: see attributions) and late (frames left out, n_late).

    frame_rows: a stream of tracking.frames' columns and at, the time of a frame. library, columns: as for live.predictions.
    """
    if "RocksDB" not in (frame_rows.sparkSession.conf.get(STORE[0], None) or ""):
        raise ValueError(f"set {STORE[0]} to {STORE[1]}")
    known = None if library is None else live.known_library(library, columns)
    rows = live.prepared(frame_rows, teams, also=("players", at)).withColumnRenamed(at, "at").withWatermark("at", delay)
    match = _Match(teams, hold, dead, hz, predict_every, attribute_from, attribute_every, abandon_s, low, k, known)
    return rows.groupBy("match_id", "period").transformWithStateInPandas(match, ROWS, "Append", "EventTime")


def attributions(rows: DataFrame, cells: tuple[int, int] = (40, 60)) -> DataFrame:
    """Credit of each attacker at the frames to credit, by their means up to there: credit.leave_one_out's columns. Works on tables and streams' batches."""
    at = rows.filter("kind = 'attribution'").select("match_id", "period", "episode_id", F.col("frame_id").alias("peak_frame"), F.col("possession_team").alias("team"), "ball", "players", "means")
    return credit.stand_still(at, *cells)


def calibration(rows: DataFrame) -> DataFrame:
    """Predictions that came to an end, with what was predicted and what came."""
    return rows.filter("kind = 'resolved'").select("match_id", "period", "episode_id", "frame_id", "time_s", *_P, "max_distance", "confidence", *_REALISED)
