"""Pitch geometry and scoring models as column expressions. Metres, origin at the bottom left, 105 x 68."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch, goal and box, and the models' coefficients.
LENGTH, WIDTH = 105.0, 68.0
GOAL_Y, GOAL_WIDTH = 34.0, 7.32
GOAL_MODEL = (1.2, -0.12, 1.5)
FINAL_THIRD_X, BOX_X, BOX_Y = 70.0, 88.5, (13.84, 54.16)
REACTION_S, MAX_SPEED, CONTROL_SIGMA_S, BALL_SIGMA_M = 0.7, 5.0, 0.45, 20.0


def clean(x: Column) -> Column:
    """Null for NaN: this library stores missing numbers as nulls only."""
    return F.when(~F.isnan(x), x)


def rescale(x: Column, y: Column, length: float, width: float, origin: str = "bottom_left") -> tuple[Column, Column]:
    """Provider coordinates to metres. origin: bottom_left, top_left (y downwards) or center (fractions about the middle)."""
    u, v = x / length, y / width
    if origin == "top_left":
        v = 1 - v
    elif origin == "center":
        u, v = u + 0.5, v + 0.5
    elif origin != "bottom_left":
        raise ValueError(f"unknown origin {origin}")
    return u * LENGTH, v * WIDTH


def flip(x: Column, y: Column) -> tuple[Column, Column]:
    """The other attacking direction: both axes mirrored."""
    return LENGTH - x, WIDTH - y


def in_bounds(x: Column, y: Column) -> Column:
    return x.between(0, LENGTH) & y.between(0, WIDTH)


def home_attacks_right(period: Column, home_right_first: Column) -> Column:
    """Teams change ends each period; a period below 1 is an error."""
    return F.when(period < 1, F.raise_error(F.lit("period must be at least 1")).cast("boolean")).otherwise(F.when(F.pmod(period, F.lit(2)) == 1, home_right_first).otherwise(~home_right_first))


def normalise(x: Column, y: Column, period: Column, home_right_first: Column) -> tuple[Column, Column]:
    """Coordinates with the home team attacking to the right."""
    right = home_attacks_right(period, home_right_first)
    return F.when(right, x).otherwise(LENGTH - x), F.when(right, y).otherwise(WIDTH - y)


def oriented_x(x: Column, to_right: Column) -> Column:
    """x as the possessing team sees it; y stays as it is."""
    return F.when(to_right, x).otherwise(LENGTH - x)


def cell(x: Column, size: float, cells: int) -> Column:
    """Index of the grid cell along one axis, held inside the grid."""
    return F.least(F.greatest((x / size * cells).cast("int"), F.lit(0)), F.lit(cells - 1))


def distance(x: Column, y: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2))


def shot_angle(x: Column, y: Column) -> Column:
    """Angle between the lines to both posts."""
    dx, low, high = LENGTH - x, GOAL_Y - GOAL_WIDTH / 2 - y, GOAL_Y + GOAL_WIDTH / 2 - y
    cosine = (dx * dx + low * high) / (F.sqrt(dx * dx + low * low) * F.sqrt(dx * dx + high * high) + 1e-9)
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def goal_probability(x: Column, y: Column) -> Column:
    """Logistic in distance and angle; nothing from behind the goal line."""
    a, b, c = GOAL_MODEL
    logit = a + b * distance(x, y, F.lit(LENGTH), F.lit(GOAL_Y)) + c * shot_angle(x, y)
    return F.when(x > LENGTH, 0.0).otherwise(1 / (1 + F.exp(-logit)))


def ball_arrival(x: Column, y: Column, ball_x: Column, ball_y: Column, sigma: float = BALL_SIGMA_M) -> Column:
    """Gaussian in the distance from the ball, not normalised; 1 where there is no ball."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    d2 = (x - ball_x) * (x - ball_x) + (y - ball_y) * (y - ball_y)
    return F.coalesce(F.exp(-d2 / (2 * sigma * sigma)), F.lit(1.0))


def time_to_intercept(x: Column, y: Column, px: Column, py: Column, vx: Column, vy: Column) -> Column:
    """Reaction along the current velocity, then a straight run at top speed."""
    return REACTION_S + distance(x, y, px + vx * REACTION_S, py + vy * REACTION_S) / MAX_SPEED


def control_probability(attack_s: Column, defend_s: Column) -> Column:
    """Logistic of the difference of arrival times; a missing side never arrives, two missing sides are even."""
    z = F.least(F.greatest((defend_s - attack_s) / CONTROL_SIGMA_S, F.lit(-30.0)), F.lit(30.0))
    z = F.when(attack_s.isNull() & defend_s.isNull(), 0.0).when(attack_s.isNull(), -30.0).when(defend_s.isNull(), 30.0).otherwise(z)
    return 1 / (1 + F.exp(-z))
