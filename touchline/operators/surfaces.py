"""Pitch control and off-ball scoring surfaces over a grid of cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import geometry as G


def grid(spark: SparkSession, rows: int = 68, cols: int = 104) -> DataFrame:
    """Cell centres: r, c, x, y. rows * cols rows, so it may be broadcast."""
    i = F.col("id")
    cells = spark.range(rows * cols).select(F.floor(i / cols).cast("int").alias("r"), F.pmod(i, F.lit(cols)).cast("int").alias("c"))
    return cells.select("r", "c", ((F.col("c") + 0.5) * (G.LENGTH / cols)).alias("x"), ((F.col("r") + 0.5) * (G.WIDTH / rows)).alias("y"))


def surfaces(frame_rows: DataFrame, rows: int = 68, cols: int = 104, attacker: str = "team") -> DataFrame:
    """Per frame and cell: control (of the team named in column attacker), arrival, goal, obso.

    Frames hold their players as an array, so a cell's arrival times are minima over that array: the grid is attached to
    each frame by a broadcast, and nothing is shuffled. The goal is at x = 105 for both teams.
    """
    spark = frame_rows.sparkSession
    cells = F.broadcast(grid(spark, rows, cols).select("r", "c", F.col("x").alias("cx"), F.col("y").alias("cy")))
    soonest = lambda own: F.array_min(F.transform(F.filter("players", lambda p: (p["team_id"] == F.col(attacker)) == F.lit(own)), lambda p: G.time_to_intercept(F.col("cx"), F.col("cy"), p["x"], p["y"], p["vx"], p["vy"])))
    met = frame_rows.join(cells).withColumns({"attack_s": soonest(True), "defend_s": soonest(False)})
    scored = met.withColumns({"control": G.control_probability(F.col("attack_s"), F.col("defend_s")), "arrival": G.ball_arrival(F.col("cx"), F.col("cy"), F.col("ball.x"), F.col("ball.y")), "goal": G.goal_probability(F.col("cx"), F.col("cy"))})
    return scored.withColumn("obso", F.col("control") * F.col("arrival") * F.col("goal")).drop("attack_s", "defend_s")


def goal_grid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Goal probability of points, as the column expression gives it."""
    dx, low, high = G.LENGTH - x, G.GOAL_Y - G.GOAL_WIDTH / 2 - y, G.GOAL_Y + G.GOAL_WIDTH / 2 - y
    cosine = (dx * dx + low * high) / (np.sqrt(dx * dx + low * low) * np.sqrt(dx * dx + high * high) + 1e-9)
    a, b, c = G.GOAL_MODEL
    return np.where(x > G.LENGTH, 0.0, 1 / (1 + np.exp(-(a + b * np.hypot(dx, y - G.GOAL_Y) + c * np.arccos(np.clip(cosine, -1, 1))))))


#: Numbers of a batch's tensor of frames, players and cells at a time: 32 MB.
TENSOR = 4_000_000


def _padded(x: pd.Series, y: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """[frame, player, axis] and how many of a frame's players are real."""
    counts = np.array([len(p) for p in x])
    out = np.full((len(x), max(1, int(counts.max(initial=0))), 2), np.inf)
    real = np.arange(out.shape[1])[None, :] < counts[:, None]
    for k, side in enumerate((x, y)):
        out[..., k][real] = np.concatenate([np.asarray(p, dtype=float) for p in side]) if counts.sum() else []
    return out, counts


def surface_values(attackers: tuple[np.ndarray, np.ndarray], defenders: tuple[np.ndarray, np.ndarray], ball: np.ndarray, x: np.ndarray, y: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Off-ball values [frame, cell] of a batch of frames at once. Sides are padded (see _padded); padding stands infinitely far away."""

    def soonest(side: np.ndarray) -> np.ndarray:
        far = np.full((len(side), len(x)), np.inf)
        for k in range(side.shape[1]):  # a player's place in every frame, at most a team's
            np.minimum(far, (x - side[:, k, :1]) ** 2 + (y - side[:, k, 1:]) ** 2, out=far)
        return np.sqrt(far) / G.MAX_SPEED

    (a, n), (d, m) = attackers, defenders
    with np.errstate(invalid="ignore"):
        z = (soonest(d) - soonest(a)) / G.CONTROL_SIGMA_S
    lone = 30.0 * ((n > 0).astype(float) - (m > 0))
    z = np.where(((n > 0) & (m > 0))[:, None], np.clip(z, -30, 30), lone[:, None])
    arrival = np.exp(-((x - ball[:, :1]) ** 2 + (y - ball[:, 1:]) ** 2) / (2 * G.BALL_SIGMA_M**2))
    return goal / (1 + np.exp(-z)) * np.where(np.isnan(arrival), 1.0, arrival)


def best_cell(rows: int, cols: int):
    """Vectorised function of a row's attackers and defenders (arrays of x and y, moved on by the reaction time) and ball:
    the greatest off-ball value over the grid and the centre of its first cell in row order. Frames are padded to one tensor."""

    @F.pandas_udf("obso_max double, obso_argmax_x double, obso_argmax_y double")
    def best(ax: pd.Series, ay: pd.Series, dx: pd.Series, dy: pd.Series, bx: pd.Series, by: pd.Series) -> pd.DataFrame:
        x, y = np.tile((np.arange(cols) + 0.5) * (G.LENGTH / cols), rows), np.repeat((np.arange(rows) + 0.5) * (G.WIDTH / rows), cols)
        goal, out = goal_grid(x, y), np.full((len(ax), 3), np.nan)
        asked, step = np.flatnonzero(ax.notna().to_numpy()), max(1, TENSOR // len(x))
        for i in range(0, len(asked), step):
            some = asked[i : i + step]
            ball = np.column_stack([bx.iloc[some].to_numpy(dtype=float), by.iloc[some].to_numpy(dtype=float)])
            value = surface_values(_padded(ax.iloc[some], ay.iloc[some]), _padded(dx.iloc[some], dy.iloc[some]), ball, x, y, goal)
            k = value.argmax(axis=1)
            out[some] = np.column_stack([value[np.arange(len(some)), k], x[k], y[k]])
        return pd.DataFrame(out, columns=["obso_max", "obso_argmax_x", "obso_argmax_y"])

    return best


def with_peak(frame_rows: DataFrame, rows: int = 40, cols: int = 60, where=None, to_right=None) -> DataFrame:
    """Frames (ball, players, team: the attackers') with obso_max, obso_argmax_x and obso_argmax_y; null where the condition where
    doesn't hold. One pass of Arrow batches: nothing is exchanged. Frames with teams, an array, instead of team: each of these teams
    attacks, and whoever isn't of one of them defends against that one.

    Without to_right all teams attack the goal at x = 105. With it (a condition of each frame: its attackers play to the right), the
    others attack the goal at x = 0; places in the result are the frame's own.
    """
    one = lambda p, own: (p["team_id"] == F.col("team")) == F.lit(own)
    some = lambda p, own: F.array_contains("teams", p["team_id"]) if own else F.size(F.array_remove("teams", p["team_id"])) > 0
    plays = some if "teams" in frame_rows.columns else one
    side = lambda own: F.filter("players", lambda p: plays(p, own) & (p["x"] + p["y"] + p["vx"] + p["vy"]).isNotNull())
    wanted = F.lit(True) if where is None else where
    turned = lambda x: x if to_right is None else F.when(to_right, x).otherwise(G.LENGTH - x)
    ahead = lambda own, c, v: F.when(wanted, F.transform(side(own), lambda p: turned(p[c] + p[v] * G.REACTION_S) if c == "x" else p[c] + p[v] * G.REACTION_S))
    found = best_cell(rows, cols)(ahead(True, "x", "vx"), ahead(True, "y", "vy"), ahead(False, "x", "vx"), ahead(False, "y", "vy"), turned(F.col("ball.x")), F.col("ball.y"))
    best = frame_rows.withColumn("best_", found)
    return best.select(*frame_rows.columns, "best_.obso_max", turned(F.col("best_.obso_argmax_x")).alias("obso_argmax_x"), "best_.obso_argmax_y")


def trajectory(snapshot_rows: DataFrame, rows: int = 40, cols: int = 60) -> DataFrame:
    """Per snapshot of an episode: obso_max and the centre of its first cell in row order."""
    keys = ["match_id", "period", "episode_id", "frame_id"]
    return with_peak(snapshot_rows.select(*keys, "ball", "players", "team"), rows, cols).drop("ball", "players", "team")


def with_ball_peak(snapshot_rows: DataFrame, rows: int = 40, cols: int = 60) -> DataFrame:
    """Snapshots by ball (tracking.run_frames) to one row per episode and frame: players, balls (team and ball of each row), obso_max,
    obso_argmax_x and obso_argmax_y: the greatest value over the surfaces of all the frame's different balls, at its first cell.

    For a ball whose rows are of several teams each of these attacks. A ball whose rows have no team is nobody's to score with: its
    surface has the least control there is.
    """
    keys = ["match_id", "period", "episode_id", "frame_id"]
    frame = snapshot_rows.groupBy(*keys).agg(F.first("players", True).alias("players"), F.collect_list(F.struct("team", F.struct("ball.x", "ball.y").alias("ball"))).alias("balls"))
    each = frame.withColumn("ball", F.explode(F.array_distinct(F.transform("balls", lambda b: b["ball"]))))
    own = F.filter("balls", lambda b: b["ball"].eqNullSafe(F.col("ball")) & b["team"].isNotNull())
    valued = with_peak(each.withColumn("teams", F.array_distinct(F.transform(own, lambda b: b["team"]))), rows, cols)
    least = 2 / (1 + np.exp(30.0))  # with nobody on either side with_peak takes a control of one half
    value = F.when(F.size("teams") > 0, F.col("obso_max")).otherwise(F.col("obso_max") * least)
    top = F.max(F.struct(value.alias("v"), (-F.col("obso_argmax_y")).alias("y"), (-F.col("obso_argmax_x")).alias("x")))
    found = valued.groupBy(*keys).agg(F.first("players").alias("players"), F.first("balls").alias("balls"), top.alias("top"))
    return found.select(*keys, "players", "balls", F.col("top.v").alias("obso_max"), (-F.col("top.x")).alias("obso_argmax_x"), (-F.col("top.y")).alias("obso_argmax_y"))


def ball_trajectory(snapshot_rows: DataFrame, rows: int = 40, cols: int = 60) -> DataFrame:
    """As trajectory, for snapshots of run_frames by ball, all of whose balls compete."""
    return with_ball_peak(snapshot_rows, rows, cols).drop("players", "balls")


def decisive(trajectory_rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Per episode: peak and the first frame that reaches share of it, with its value; null where the peak isn't positive."""
    keys = ["match_id", "period", "episode_id"]
    near = trajectory_rows.withColumn("peak_obso", F.max("obso_max").over(Window.partitionBy(*keys)))
    first = F.min(F.when((F.col("peak_obso") > 0) & (F.col("obso_max") >= share * F.col("peak_obso")), F.struct("frame_id", "obso_max")))
    return near.groupBy(*keys, "peak_obso").agg(first.alias("at")).select(*keys, "peak_obso", F.col("at.frame_id").alias("decisive_frame"), F.col("at.obso_max").alias("decisive_obso"))


def player_obso(frame_rows: DataFrame, rows: int = 40, cols: int = 60) -> DataFrame:
    """The off-ball value of the cell each attacker stands in, with its rank from 1 (highest first), ties to the smaller id.

    Only the attackers' own cells are computed, each cell of a player once. A frame may have several rows, of different balls or teams;
    all are ranked together.
    """
    keys = ["match_id", "period", "frame_id"]
    dx, dy = G.LENGTH / cols, G.WIDTH / rows
    index = lambda v, d, n: F.least(F.greatest(F.ceil((v - d / 2) / d) - 1, F.lit(0)), F.lit(n - 1))
    stand = lambda p: F.struct(p["player_id"].alias("player_id"), ((index(p["x"], dx, cols) + 0.5) * dx).alias("cx"), ((index(p["y"], dy, rows) + 0.5) * dy).alias("cy"))
    mine = F.array_distinct(F.transform(F.filter("players", lambda p: p["team_id"] == F.col("team")), stand))
    at = frame_rows.select(*keys, "ball", "players", "team", F.inline(mine))
    soonest = lambda own: F.array_min(F.transform(F.filter("players", lambda p: (p["team_id"] == F.col("team")) == F.lit(own)), lambda p: G.time_to_intercept(F.col("cx"), F.col("cy"), p["x"], p["y"], p["vx"], p["vy"])))
    value = G.control_probability(soonest(True), soonest(False)) * G.ball_arrival(F.col("cx"), F.col("cy"), F.col("ball.x"), F.col("ball.y")) * G.goal_probability(F.col("cx"), F.col("cy"))
    by_value = Window.partitionBy(*keys).orderBy(F.desc("obso"), "player_id")  # at most a team's players
    return at.select(*keys, "player_id", value.alias("obso")).withColumn("rank", F.row_number().over(by_value))


def different_balls(snapshot_rows: DataFrame) -> DataFrame:
    """Snapshots by ball (tracking.run_frames) to a row for each different ball and team of a frame, with the frame's players."""
    keys = ["match_id", "period", "frame_id"]
    balls = F.collect_set(F.struct("team", F.struct("ball.x", "ball.y").alias("ball")))
    return snapshot_rows.groupBy(*keys).agg(F.first("players", True).alias("players"), balls.alias("balls")).select(*keys, "players", F.inline("balls"))


#: Moments of a box that are kept: all of an order (of both axes together) below this. A box is one standard deviation of the kernel wide,
#: and then the moments left out change a density by less than 1e-15 of the kernel's top. Parts that a group's boxes are dealt to.
ORDER, PARTS = 26, 16
#: Boxes whose moments a task holds before it reports, and places handled at a time.
HELD, RUN = 4096, 4096
_POWERS = np.array([(i, k - i) for k in range(ORDER) for i in range(k + 1)])


def _box_moments(keys: list[str]):
    """Sums over the places of a box of u ** i * v ** j, u and v from the box's middle, in units of the kernel's deviation along its axes."""

    def run(parts):
        held: dict[tuple, np.ndarray] = {}

        def report() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=[*keys, "bi", "bj"])
            out["moments"] = list(held.values())
            held.clear()
            return out

        for batch in parts:
            for at in range(0, len(batch), RUN):
                some = batch.iloc[at : at + RUN]
                p, q = some["p"].to_numpy(), some["q"].to_numpy()
                some = some[keys].assign(bi=np.floor(p).astype(np.int64), bj=np.floor(q).astype(np.int64))
                number = some.groupby([*keys, "bi", "bj"], sort=False).ngroup().to_numpy()
                order = np.argsort(number, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
                u, v = ((x - np.floor(x) - 0.5)[order, None] ** np.arange(ORDER) for x in (p, q))
                sums = np.add.reduceat(u[:, _POWERS[:, 0]] * v[:, _POWERS[:, 1]], first)
                for box, moments in zip(some.iloc[order[first]].itertuples(index=False, name=None), sums, strict=True):
                    held[box] = held[box] + moments if box in held else moments
                if len(held) >= HELD:
                    yield report()
        if held:
            yield report()

    return run


def _hermite(x: np.ndarray) -> np.ndarray:
    """exp(-x * x / 2) times the Hermite polynomial of order k over k!, for k below ORDER, first axis: what u ** k is worth at a distance of x."""
    out = np.empty((ORDER, *x.shape))
    out[0] = np.exp(-0.5 * x * x)
    out[1] = x * out[0]
    for k in range(1, ORDER - 1):
        out[k + 1] = (x * out[k] - out[k - 1]) / (k + 1)
    return out


def _box_sums(keys: list[str], rows: int, cols: int):
    """The kernel's sums of a group's part of boxes at all points of the pitch, as one array a part."""
    x, y = np.arange(cols) * (G.LENGTH / (cols - 1)), np.arange(rows) * (G.WIDTH / (rows - 1))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[0]
        q = (y - one["my"]) / one["sy"]
        p = (x[None, :] - one["mx"] - one["slope"] * (y - one["my"])[:, None]) / one["sx"]
        total = np.zeros((rows, cols))
        for (bi, bj), same in part.groupby(["bi", "bj"], sort=True):
            moments = np.zeros((ORDER, ORDER))
            moments[_POWERS[:, 0], _POWERS[:, 1]] = np.sum(np.stack(same["moments"].to_list()), axis=0)
            along = moments @ _hermite(q - bj - 0.5)  # [i, row]: the second axis is summed once a row
            total += np.einsum("irc,ir->rc", _hermite(p - bi - 0.5), along)
        return pd.DataFrame([[*(one[k] for k in keys), total.ravel()]], columns=[*keys, "sums"])

    return run


def density(points: DataFrame, keys: list[str], rows: int = 69, cols: int = 106, least: int = 5, share: float = 0.0) -> DataFrame:
    """Gaussian kernel density of each group's places x, y over points evenly laid on the pitch, its edges included: keys, r, c, n (the
    group's places), density (per square metre).

    The kernel has the group's sample covariance, narrowed by n ** (-1/6) (Scott's rule for two dimensions). Groups with fewer than
    least places, or with all places on one line, have no density, and so no rows; nor have rows with a null key or place. Values
    below share of the group's largest are left out.

    Along the kernel's own axes (x less what y explains of it, and y) it is round and a product, so a place's share at a point is a
    series in the place's powers about the middle of its box. Places are added up to moments of boxes in one pass, map-side; points
    then meet boxes, of which a group has some n ** (1/3), not places.
    """
    own = points.select(*keys, G.clean(F.col("x")).alias("x"), G.clean(F.col("y")).alias("y")).dropna()
    spread = own.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"))
    spread = spread.withColumn("det", F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy")).filter((F.col("n") >= least) & (F.col("det") > 1e-12 * F.col("vx") * F.col("vy")))
    narrow = F.pow(F.col("n").cast("double"), F.lit(-1 / 6))
    spread = spread.select(*keys, "n", "mx", "my", (F.col("vxy") / F.col("vy")).alias("slope"), (F.sqrt(F.col("det") / F.col("vy")) * narrow).alias("sx"), (F.sqrt("vy") * narrow).alias("sy"))
    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keys)
    away = F.col("y") - F.col("my")
    placed = own.join(spread, keys).select(*keys, ((F.col("x") - F.col("mx") - F.col("slope") * away) / F.col("sx")).alias("p"), (away / F.col("sy")).alias("q"))
    boxes = placed.mapInPandas(_box_moments(keys), f"{kinds}, bi long, bj long, moments array<double>")
    parts = boxes.join(spread, keys).withColumn("part", F.pmod(F.xxhash64("bi", "bj"), F.lit(PARTS)))
    sums = parts.groupBy(*keys, "part").applyInPandas(_box_sums(keys, rows, cols), f"{kinds}, sums array<double>")
    merged = sums.groupBy(*keys).agg(F.reduce(F.collect_list("sums"), F.array_repeat(F.lit(0.0), rows * cols), lambda a, b: F.zip_with(a, b, lambda u, v: u + v)).alias("sums"))
    found = merged.join(spread, keys).select(*keys, "n", "sx", "sy", F.array_max("sums").alias("top"), F.posexplode("sums").alias("cell", "sum"))
    if share > 0:
        found = found.filter(F.col("sum") >= share * F.col("top"))
    return found.select(*keys, F.floor(F.col("cell") / cols).cast("int").alias("r"), F.pmod("cell", F.lit(cols)).cast("int").alias("c"), "n", (F.greatest("sum", F.lit(0.0)) / (2 * np.pi * F.col("n") * F.col("sx") * F.col("sy"))).alias("density"))


def attack_ends(outcome_rows: DataFrame, right: str = "home") -> DataFrame:
    """The outcomes with x, y: where the ball was at the episode's end, turned so that every attack goes to x = 105. Ends off the pitch go.

    outcome_rows: tracking.outcomes with possession_team.
    """
    turn = F.col("possession_team") != right
    x, y = F.when(turn, G.LENGTH - F.col("end_ball_x")).otherwise(F.col("end_ball_x")), F.when(turn, G.WIDTH - F.col("end_ball_y")).otherwise(F.col("end_ball_y"))
    return outcome_rows.withColumns({"x": x, "y": y}).filter(F.col("x").between(0, G.LENGTH) & F.col("y").between(0, G.WIDTH))
