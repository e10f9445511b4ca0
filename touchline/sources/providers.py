"""Provider documents to canonical tables: event JSON, unit-square tracking, JSON-lines tracking, annotated clips."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import geometry as G
from touchline.operators.tracking import velocities

_NAMED = "struct<id:long,name:string>"
EVENTS_JSON = (
    f"id string, type {_NAMED}, team {_NAMED}, player {_NAMED}, location array<double>, period int, minute int, second int, "
    f"pass struct<end_location:array<double>,body_part:{_NAMED},outcome:{_NAMED}>, carry struct<end_location:array<double>>, "
    f"shot struct<end_location:array<double>,body_part:{_NAMED},outcome:{_NAMED}>, dribble struct<outcome:{_NAMED}>, foul_committed struct<card:{_NAMED}>"
)
MATCHES_JSON = "match_id long, match_date string, home_team struct<home_team_id:long,home_team_name:string>, away_team struct<away_team_id:long,away_team_name:string>, competition struct<competition_id:long,competition_name:string>, season struct<season_id:long,season_name:string>"
LINEUPS_JSON = "team_id long, team_name string, lineup array<struct<player_id:long,player_name:string,player_nickname:string>>"
COMPETITIONS_JSON = "competition_id long, season_id long, competition_name string, season_name string"
ROSTER_JSON = "home_team struct<id:long>, away_team struct<id:long>, players array<struct<id:long,team_id:long>>"
FRAMES_JSON = "frame long, timestamp string, period int, ball_data struct<x:double,y:double,is_detected:boolean>, player_data array<struct<player_id:long,x:double,y:double,is_detected:boolean>>"
CLIP_JSON = "info struct<frame_rate:double>, images array<struct<image_id:string>>, annotations array<struct<image_id:string,category_id:int,track_id:string,bbox_pitch:struct<x_bottom_middle:double,y_bottom_middle:double>,attributes:struct<team:string>>>"

# Provider event types and their actions, outcomes of passes and shots, the pitch of event coordinates.
ACTION_OF = {
    "Pass": "pass", "Shot": "shot", "Carry": "dribble", "Clearance": "clearance", "Ball Receipt*": "receival", "Foul Committed": "foul", "Dribble": "take_on",
    "Interception": "interception", "Block": "block", "Goal Keeper": "keeper_action", "Duel": "tackle",
}
PASS_RESULT = {"Incomplete": "fail", "Out": "fail", "Pass Offside": "offside", "Injury Clearance": "fail", "Unknown": "fail"}
EVENT_PITCH = (120.0, 80.0)
# Categories of annotations (players, goalkeepers, ball) and how far from the middle of the pitch they may lie.
PEOPLE, BALL, FAR = (1, 2), 4, (67.5, 49.0)


def read_json(spark: SparkSession, path: str | list[str], schema: str, lines: bool = False) -> DataFrame:
    """Provider files with a declared schema and file, the name of each row's file without its ending."""
    rows = spark.read.schema(schema).json(path, multiLine=not lines)
    return rows.withColumn("file", F.regexp_replace(F.col("_metadata.file_name"), r"\.[A-Za-z.]+$", ""))


def match_key(provider: str, native: Column) -> Column:
    return F.concat(F.lit(f"{provider}:"), native.cast("string"))


def home_teams(matches: DataFrame) -> DataFrame:
    """(match_id, home_team_id) by match key."""
    return matches.select(match_key("statsbomb", F.col("match_id")).alias("match_id"), F.col("home_team.home_team_id").cast("string").alias("home_team_id"))


def player_names(lineups: DataFrame) -> DataFrame:
    """(player_id, name): the nickname, else the name, else the id."""
    p = lineups.select(F.explode("lineup").alias("p")).select("p.*")
    text = lambda c: F.when(F.trim(c) != "", F.col(c))
    return p.select(F.col("player_id").cast("string").alias("player_id"), F.coalesce(text("player_nickname"), text("player_name"), F.col("player_id").cast("string")).alias("name"))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def actions(raw: DataFrame, homes: DataFrame, home_right_first: bool = True) -> DataFrame:
    """Raw events with match_id to actions. homes: (match_id, home_team_id); a match without one is an error.

    Types that have no action are dropped. Points become metres; the away team's are mirrored, then all by period.
    """
    rows = raw.withColumn("action_type", _looked_up(ACTION_OF, F.col("type.name"))).filter("action_type is not null").join(F.broadcast(homes), "match_id", "left")  # a row a match
    rows = rows.withColumn("home_team_id", F.when(F.col("home_team_id").isNull(), F.raise_error(F.concat(F.lit("no home team for "), "match_id")).cast("string")).otherwise(F.col("home_team_id")))
    kind = F.col("action_type")
    is_ = lambda a: kind == a
    point = lambda c: F.when(F.size(c) >= 2, F.col(c))
    end = F.when(is_("pass"), point("pass.end_location")).when(is_("shot"), point("shot.end_location")).when(is_("dribble"), point("carry.end_location")).otherwise(point("location"))
    period = F.coalesce("period", F.lit(1))
    home = F.coalesce(F.col("team.id").cast("string"), F.lit("")) == F.col("home_team_id")

    def metres(p: Column) -> tuple[Column, Column]:
        x, y = G.rescale(p[0], p[1], *EVENT_PITCH, "top_left")
        x, y = F.when(home, x).otherwise(G.LENGTH - x), F.when(home, y).otherwise(G.WIDTH - y)
        return G.normalise(x, y, period, F.lit(home_right_first))

    (sx, sy), (ex, ey) = metres(point("location")), metres(end)
    outcome = F.when(is_("pass"), F.col("pass.outcome.name")).when(is_("shot"), F.col("shot.outcome.name")).when(is_("take_on"), F.col("dribble.outcome.name")).otherwise(F.col("foul_committed.card.name"))
    result = (
        F.when(is_("pass"), F.coalesce(_looked_up(PASS_RESULT, outcome), F.lit("success")))
        .when(is_("shot"), F.when(outcome == "Goal", "success").otherwise("fail"))
        .when(is_("dribble") & F.col("carry").isNotNull(), "success")
        .when(is_("take_on"), F.when(outcome == "Complete", "success").otherwise("fail"))
        .when(is_("foul"), F.when(F.contains(outcome, F.lit("Yellow")), "yellow_card").when(F.contains(outcome, F.lit("Red")), "red_card").otherwise("fail"))
    )
    body = F.when(is_("pass"), F.col("pass.body_part.name")).when(is_("shot"), F.col("shot.body_part.name"))
    return rows.select(
        "match_id", period.alias("period"), (F.coalesce("minute", F.lit(0)) * 60 + F.coalesce("second", F.lit(0))).cast("double").alias("time_seconds"), F.coalesce(F.col("team.id").cast("string"), F.lit("")).alias("team_id"),
        F.col("player.id").cast("string").alias("player_id"), sx.alias("start_x"), sy.alias("start_y"), ex.alias("end_x"), ey.alias("end_y"), kind.alias("action_type"), result.alias("result"),
        F.when(body != "", F.replace(F.lower(body), F.lit(" "), F.lit("_"))).alias("bodypart"), F.coalesce("id", F.lit("")).alias("raw_event_id"),
    )


_LONG = ("match_id", "period", "frame_id", "time_seconds", "player_id", "team_id", "x", "y", "is_ball", "visible")


def unit_to_long(wide: DataFrame, players: dict[str, str], every: int = 1) -> DataFrame:
    """Unit-square tracking (match_id, period, frame_id, time_seconds, <player>_x, <player>_y, ball_x, ball_y; y downwards) to long rows with velocities.

    players: player to team. every: each so manieth frame of the file. Entities without coordinates have no row.
    """
    one = lambda who, name, t: F.struct(F.lit(name).cast("string").alias("player_id"), F.lit(t).cast("string").alias("team_id"), (G.clean(F.col(f"{who}_x").cast("double")) * G.LENGTH).alias("x"), ((1 - G.clean(F.col(f"{who}_y").cast("double"))) * G.WIDTH).alias("y"), F.lit(name is None).alias("is_ball"))
    rows = wide.filter(F.pmod("frame_id", F.lit(every)) == 0).select("match_id", F.col("period").cast("int").alias("period"), F.col("frame_id").cast("long").alias("frame_id"), F.col("time_seconds").cast("double").alias("time_seconds"), F.inline(F.array(one("ball", None, None), *[one(p, p, t) for p, t in players.items()])))
    return velocities(rows.filter("x is not null and y is not null").withColumn("visible", F.lit(True)).select(*_LONG))


def seconds(text: Column) -> Column:
    """H:M:S.s or M:S.s in seconds; null for anything else."""
    p = F.split(text, ":")
    part = lambda i, t: F.get(p, F.lit(i)).try_cast(t)
    return F.when(F.size(p) == 3, part(0, "int") * 3600 + part(1, "int") * 60 + part(2, "double")).when(F.size(p) == 2, part(0, "int") * 60 + part(1, "double"))


def roster(match: DataFrame) -> DataFrame:
    """(match_id, player_id, team_id) of a match document with match_id: home or away; other teams' players are left out."""
    p = match.select("match_id", F.col("home_team.id").alias("h"), F.col("away_team.id").alias("a"), F.inline("players"))
    return p.select("match_id", F.col("id").alias("player_id"), F.when(F.col("team_id") == F.col("h"), "home").when(F.col("team_id") == F.col("a"), "away").alias("team_id")).filter("player_id is not null and team_id is not null")


def lines_to_long(frames: DataFrame, rosters: DataFrame) -> DataFrame:
    """Frames (match_id and FRAMES_JSON's columns) to long rows with velocities; the ball has a row in each frame, unknown players none.

    Frames without a period or a readable time are dropped. rosters: a row a player of a match.
    """
    timed = frames.withColumn("time_seconds", seconds(F.col("timestamp"))).filter("period is not null and time_seconds is not null").withColumnRenamed("frame", "frame_id")
    keys = ["match_id", "period", "frame_id", "time_seconds"]
    half = (G.LENGTH / 2, G.WIDTH / 2)
    ball = timed.select(*keys, F.lit(None).cast("string").alias("player_id"), F.lit(None).cast("string").alias("team_id"), (F.col("ball_data.x") + half[0]).alias("x"), (F.col("ball_data.y") + half[1]).alias("y"), F.lit(True).alias("is_ball"), (F.coalesce("ball_data.is_detected", F.lit(False)) & F.col("ball_data.x").isNotNull()).alias("visible"))
    people = timed.select(*keys, F.inline("player_data")).filter("player_id is not null and x is not null and y is not null").join(rosters, ["match_id", "player_id"])
    people = people.select(*keys, F.col("player_id").cast("string").alias("player_id"), "team_id", (F.col("x") + half[0]).alias("x"), (F.col("y") + half[1]).alias("y"), F.lit(False).alias("is_ball"), F.coalesce("is_detected", F.lit(True)).alias("visible"))
    return velocities(ball.unionByName(people))


def read_clips(spark: SparkSession, path: str, inner: str = "Labels-GameState.json") -> DataFrame:
    """(match_id, CLIP_JSON's columns) of the clips in zip archives: one task an archive, one document a row."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(f"/{inner}")):
                        yield pd.DataFrame({"clip": [name.split("/")[-2]], "text": [z.read(name).decode()]})

    texts = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "clip string, text string")
    return texts.select(match_key("soccernet", F.col("clip")).alias("match_id"), F.from_json("text", CLIP_JSON).alias("c")).select("match_id", "c.*")


def clips_to_long(clips: DataFrame, home_side: str = "left") -> DataFrame:
    """Annotated clips (match_id and CLIP_JSON's columns) to long rows with velocities.

    A frame's number is its image's place in the clip, from 1. Referees, players without a side and points beyond FAR are dropped.
    """
    images = clips.select("match_id", F.posexplode("images").alias("at", "i")).select("match_id", F.col("i.image_id").alias("image_id"), (F.col("at") + 1).cast("long").alias("frame_id"))
    marks = clips.select("match_id", F.coalesce("info.frame_rate", F.lit(25.0)).alias("rate"), F.explode("annotations").alias("a")).select("match_id", "rate", "a.*", F.col("a.bbox_pitch.x_bottom_middle").alias("bx"), F.col("a.bbox_pitch.y_bottom_middle").alias("b_y"))
    is_ball = F.col("category_id") == BALL
    team = F.when(F.col("attributes.team").isin("left", "right"), F.when(F.col("attributes.team") == home_side, "home").otherwise("away"))
    good = marks.filter(F.col("category_id").isin(*PEOPLE, BALL) & F.col("bx").between(-FAR[0], FAR[0]) & F.col("b_y").between(-FAR[1], FAR[1]) & (is_ball | team.isNotNull()))
    rows = good.join(images, ["match_id", "image_id"]).select(
        "match_id", F.lit(1).alias("period"), "frame_id", ((F.col("frame_id") - 1) / F.col("rate")).alias("time_seconds"), F.when(~is_ball, F.concat(F.lit("track-"), "track_id")).alias("player_id"), F.when(~is_ball, team).alias("team_id"),
        (F.col("bx") + G.LENGTH / 2).alias("x"), (F.col("b_y") + G.WIDTH / 2).alias("y"), is_ball.alias("is_ball"), F.lit(True).alias("visible"),
    )
    return velocities(rows)


def source_of(match_id: Column) -> Column:
    """The provider that a match key names."""
    return F.when(match_id.startswith("metrica:"), "Metrica").when(match_id.startswith("skillcorner:"), "SkillCorner").when(match_id.startswith("soccernet:"), "SoccerNet").otherwise("unknown")
