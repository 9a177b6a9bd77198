"""Court geometry as column expressions, in feet; the offence attacks the left basket."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dimensions of the court.
LENGTH, WIDTH = 94.0, 50.0
HOOP_X, HOOP_Y = 5.25, 25.0
THREE_RADIUS, CORNER_OFFSET, CORNER_LENGTH = 23.75, 22.0, 14.0
LANE_LENGTH, LANE_WIDTH = 19.0, 16.0
FRONT_CONE_DEGREES, NO_FRONT = 45.0, 30.0


def distance(ax: Column, ay: Column, bx, by) -> Column:
    return F.hypot(ax - bx, ay - by)


def to_left(x: Column, y: Column, attacks_left: Column) -> tuple[Column, Column]:
    """Turns positions by 180 degrees where the offence attacks the right basket."""
    return F.when(attacks_left, x).otherwise(LENGTH - x), F.when(attacks_left, y).otherwise(WIDTH - y)


def is_three(x: Column, y: Column) -> Column:
    side = F.abs(y - HOOP_Y)
    return ((x <= CORNER_LENGTH) & (side >= CORNER_OFFSET)) | (distance(x, y, HOOP_X, HOOP_Y) >= THREE_RADIUS)


def zone(dist: Column, three: Column, y: Column) -> Column:
    return (
        F.when(three & (F.abs(y - HOOP_Y) >= 21.0), "corner3").when(three, "above3").when(dist < 4, "rim").when(dist < 14, "paint").otherwise("mid")
    )


def in_paint(x: Column, y: Column) -> Column:
    return (x >= 0) & (x <= LANE_LENGTH) & (F.abs(y - HOOP_Y) <= LANE_WIDTH / 2)


def in_cone(hx: Column, hy: Column, dx: Column, dy: Column, half_angle_degrees: float) -> Column:
    """Whether d is in the cone from h to the hoop, and no farther from h than the hoop is; null positions are outside."""
    reach, dist = distance(hx, hy, HOOP_X, HOOP_Y), distance(dx, dy, hx, hy)
    along = (dx - hx) * (HOOP_X - hx) + (dy - hy) * (HOOP_Y - hy)
    inside = (dist > 0) & (dist <= reach) & (along >= F.lit(math.cos(math.radians(half_angle_degrees))) * dist * reach)
    return F.coalesce(inside, F.lit(False))


def same_side(ay: Column, by: Column) -> Column:
    """Whether two positions are on the same side of the long axis (strong side)."""
    return F.signum(ay - HOOP_Y) == F.signum(by - HOOP_Y)


def shot_angle(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(F.abs(y - HOOP_Y), F.greatest(x - HOOP_X, F.lit(1e-3))))


def expected_position(ox: Column, oy: Column, bx: Column, by: Column, weights: Column) -> tuple[Column, Column]:
    """Weighted mean of attacker, ball and hoop; weights: a struct (o, b, h)."""
    return (
        weights["o"] * ox + weights["b"] * bx + weights["h"] * HOOP_X,
        weights["o"] * oy + weights["b"] * by + weights["h"] * HOOP_Y,
    )


def side_weights(strong: Column, strong_weights: tuple[float, float, float], weak_weights: tuple[float, float, float]) -> Column:
    as_struct = lambda w: F.struct(*[F.lit(v).alias(n) for n, v in zip("obh", w, strict=True)])
    return F.when(strong, as_struct(strong_weights)).otherwise(as_struct(weak_weights))
