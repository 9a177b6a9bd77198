"""Help, closeouts, phases and contexts of defenders whose men are known.

Rows are one per possession, step and defender slot, with the defender's and the
attackers' positions (`def_x`, `def_y`, `off`), the handler's slot (null or below
0: nobody) and the man's slot (`man`; anything outside 0-4: nobody). What spans
steps is a window over one possession and slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions import court
from tracklane.operators.matchup import HZ, at
from tracklane.operators.screens import phase

KEY = ["possession", "slot"]


@dataclass(frozen=True)
class HelpLimits:
    """Feet from the rim of the handler, feet from the man, speed in feet a second, posterior, steps."""

    zone: float = 20.0
    leave: float = 6.0
    speed: float = 3.0
    posterior: float = 0.5
    steps: int = 2


def placed(rows: DataFrame) -> DataFrame:
    """Adds to_man, to_handler, handler_rim (feet) and on_ball: a defender's state at a step."""
    (mx, my), (hx, hy) = at(F.col("man")), at(F.col("handler"))
    dx, dy = F.col("def_x"), F.col("def_y")
    feet = {"to_man": court.distance(dx, dy, mx, my), "to_handler": court.distance(dx, dy, hx, hy), "handler_rim": court.distance(hx, hy, court.HOOP_X, court.HOOP_Y)}
    return rows.withColumns(feet | {"on_ball": F.col("man") == F.col("handler")})


def approach(rows: DataFrame) -> DataFrame:
    """placed, and closing: the backward difference of to_handler, in feet a second."""
    return placed(rows).withColumn("closing", (F.lag("to_handler").over(Window.partitionBy(*KEY).orderBy("step")) - F.col("to_handler")) * HZ)


def _runs(rows: DataFrame, holds: Column, least: int, **values: Column) -> DataFrame:
    """One row per run of consecutive steps on which `holds`, of least steps: start, length and aggregates."""
    held = rows.where(F.coalesce(holds, F.lit(False)))
    island = F.col("step") - F.row_number().over(Window.partitionBy(*KEY).orderBy("step"))
    out = held.withColumn("island", island).groupBy(*KEY, "island")
    return out.agg(F.min("step").alias("start_step"), F.count(F.lit(1)).alias("length"), *[v.alias(k) for k, v in values.items()]).where(F.col("length") >= least).drop("island")


def geometric_help(rows: DataFrame, limits: HelpLimits = HelpLimits()) -> DataFrame:
    """Help seen from positions: a defender with a man other than the handler, the handler near the rim, away from the man, closing on the handler.

    Per run: man and handler at its start, the farthest from the man and the nearest to the handler.
    """
    man = F.col("man").between(0, 4) & (F.col("man") != F.col("handler"))
    holds = man & (F.col("handler_rim") <= limits.zone) & (F.col("to_man") >= limits.leave) & (F.col("closing") >= limits.speed)
    first = lambda c: F.min_by(c, "step")
    return _runs(approach(rows), holds, limits.steps, man=first("man"), handler=first("handler"), max_from_man=F.max("to_man"), min_to_handler=F.min("to_handler"))


def model_help(rows: DataFrame, limits: HelpLimits = HelpLimits()) -> DataFrame:
    """Help seen by the matchup model: `p_help` at or above the posterior while closing on the handler."""
    holds = (F.col("p_help") >= limits.posterior) & (F.col("closing") > 0)
    return _runs(approach(rows), holds, limits.steps, handler=F.min_by("handler", "step"))


def closeouts(rows: DataFrame, passes: DataFrame, far: float = 8.0, near: float = 4.0, speed: float = 8.0, window: int = 5) -> DataFrame:
    """The defender who closes out on the receiver of each completed pass.

    passes: possession, pass_id, receiver (slot), catch (step). The defender is
    the nearest whose man the receiver is at the catch, else the nearest of all
    (the smaller slot of ties); he must be farther than `far` then, within
    `near` at some step of the window, and fast enough up to the first of these.
    """
    rx, ry = at(F.col("receiver"))
    gap = court.distance(F.col("def_x"), F.col("def_y"), rx, ry)
    met = rows.join(passes.where("pass_id IS NOT NULL"), "possession").where(F.col("step").between(F.col("catch"), F.col("catch") + window)).withColumn("gap", gap)
    other = (F.col("man") != F.col("receiver")).cast("int")
    at_catch = F.col("step") == F.col("catch")
    who = F.min(F.when(at_catch, F.struct(F.coalesce(other, F.lit(1)).alias("other"), F.round("gap", 9).alias("near"), "slot"))).over(Window.partitionBy("possession", "pass_id"))
    own = met.select("possession", "pass_id", "slot", "step", "catch", "gap", who.alias("w")).where(F.col("slot") == F.col("w.slot")).withColumn("matched", F.col("w.other") == 0)
    first = F.min(F.when(F.col("gap") <= near, F.struct(F.col("step").alias("step"), F.col("gap").alias("gap"))))
    found = own.groupBy("possession", "pass_id", "slot", "matched").agg(F.max(F.when(at_catch, F.col("gap"))).alias("at_catch"), F.min("catch").alias("catch"), first.alias("hit")).where((F.col("at_catch") > far) & F.col("hit").isNotNull())
    steps = F.col("hit.step") - F.col("catch")
    rate = (F.col("at_catch") - F.col("hit.gap")) * HZ / F.greatest(steps, F.lit(1))
    return found.select("possession", "pass_id", "slot", "matched", steps.alias("steps"), "at_catch", F.col("hit.gap").alias("closed"), rate.alias("speed")).where(F.col("speed") >= speed)


@dataclass(frozen=True)
class PhaseWindows:
    """Milliseconds before and after a screen's contact, and of recovery after help or a closeout; half angle of the sightline cone."""

    before: int = 500
    after: int = 1_000
    recovery: int = 2_000
    cone_degrees: float = 20.0


# The two variants of the phases.
VARIANTS = {"A": PhaseWindows(), "B": PhaseWindows(before=1_000, after=2_000, recovery=3_000, cone_degrees=30.0)}

PHASES = ("help", "closeout", "recovery", "screen", "pre_screen", "other")


def marked(possessions: DataFrame, helps: DataFrame, closing: DataFrame, contacts: DataFrame) -> DataFrame:
    """Adds the lists of a possession's help, closeouts and contacts (null: none), for phase_at.

    Meant for rows of whole possessions: they meet before possessions grow to
    steps, so a step is neither sorted nor moved.
    """

    def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.na.drop(subset=list(columns)).groupBy("possession").agg(F.collect_list(F.struct(*columns)).alias(name))

    # all meet by possession alone, so rows that are dealt by it stay where they are
    out = possessions.join(listed(helps, "__h", *KEY[1:], "t_start", "t_end"), "possession", "left").join(listed(closing, "__c", *KEY[1:], "t_start", "t_end"), "possession", "left")
    return out.join(listed(contacts, "__s", "t_contact"), "possession", "left")


def phase_at(t: Column, slot: Column, windows: PhaseWindows) -> Column:
    """The phase (one of PHASES; the first that holds) of a step and slot of a marked possession."""
    inside = lambda c: F.exists(c, lambda x: (x["slot"] == slot) & (x["t_start"] <= t) & (t <= x["t_end"]))
    after = lambda c: F.coalesce(F.exists(c, lambda x: (x["slot"] == slot) & (x["t_end"] < t) & (t <= x["t_end"] + windows.recovery)), F.lit(False))
    screen = F.exists("__s", lambda x: (x["t_contact"] - windows.before <= t) & (t <= x["t_contact"] + windows.after))
    before = t < F.array_min("__s")["t_contact"] - windows.before
    return phase(inside("__h"), inside("__c"), after("__h") | after("__c"), screen, before)


def phases(steps: DataFrame, helps: DataFrame, closing: DataFrame, contacts: DataFrame, windows: PhaseWindows = VARIANTS["A"]) -> DataFrame:
    """Adds `phase` to steps (possession, slot, t, ..).

    helps and closing: possession, slot, t_start, t_end; contacts: possession,
    t_contact of its screens, which concern all five defenders. Intervals hold
    their ends. Recovery is the time after the end of a defender's help or
    closeout; a screen lasts from `before` its contact to `after` it; what comes
    earlier than the first screen is pre_screen. Null times are no intervals. A
    possession has a few of each. Where steps are made of possessions, marked
    and phase_at do without sorting steps.
    """
    return marked(steps, helps, closing, contacts).withColumn("phase", phase_at(F.col("t"), F.col("slot"), windows)).drop("__h", "__c", "__s")


def phase_shares(steps: DataFrame, by: list[str]) -> DataFrame:
    """Per key: steps, and the share of each phase and its difference from the share over all keys' steps."""
    counts = [F.count_if(F.col("phase") == p).alias(p) for p in PHASES]
    each = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts)
    league = each.agg(F.struct(*[(F.sum(p) / F.sum("n")).alias(p) for p in PHASES])).scalar()  # a subquery: who takes no difference does not pay for it
    shares = [(F.col(p) / F.col("n")).alias(p) for p in PHASES]
    return each.select(*by, "n", *shares, *[(F.col(p) / F.col("n") - league[p]).alias(f"{p}_diff") for p in PHASES])


def step_context(t: Column, release: Column, contacts: Column, start: Column, around: int = 1_000, early: int = 2_000) -> Column:
    """release within `around` before a release, else screen within `around` after a contact (an array), else early after the start, else other."""
    near_release = F.coalesce((t <= release) & (t >= release - around), F.lit(False))
    near_screen = F.coalesce(F.exists(contacts, lambda c: (t >= c) & (t <= c + around)), F.lit(False))
    return F.when(near_release, "release").when(near_screen, "screen").when(t < start + early, "early").otherwise("other")


def corner_help(frames: DataFrame, drive: float = 12.0, left: float = 6.0) -> DataFrame:
    """Per run of steps with the ball within `drive` feet of the rim and an attacker in a corner: whether the corner's defender helped.

    The corner's defender is the nearest to the corner attacker at the run's
    start; he helped if he was `left` feet or more from him at any of its
    steps. One row per run and corner attacker.
    """
    near = F.coalesce(court.distance(F.col("ball_x"), F.col("ball_y"), court.HOOP_X, court.HOOP_Y) <= drive, F.lit(False))
    order = Window.partitionBy("possession").orderBy("step")
    held = frames.where(near).withColumn("run", F.col("step") - F.row_number().over(order))
    started = held.withColumn("start", F.min("step").over(Window.partitionBy("possession", "run")))
    x, y = F.col("o.x"), F.col("o.y")
    each = started.select("possession", "run", "start", "step", "def", F.posexplode("off").alias("corner", "o"))
    corner = court.zone(court.distance(x, y, court.HOOP_X, court.HOOP_Y), court.is_three(x, y), y) == "corner3"
    gaps = each.withColumn("gaps", F.transform("def", lambda d: court.distance(d["x"], d["y"], x, y)))
    key = ["possession", "run", "corner"]
    nearest = F.array_min(F.transform("gaps", lambda g, j: F.struct(F.round(g, 9).alias("g"), j.alias("slot"))))
    who = F.max(F.when((F.col("step") == F.col("start")) & corner, nearest["slot"])).over(Window.partitionBy(*key))
    own = gaps.withColumn("slot", who).where("slot IS NOT NULL").withColumn("gap", F.get("gaps", F.col("slot")))
    return own.groupBy(*key, "slot").agg(F.min("step").alias("start_step"), F.count(F.lit(1)).alias("length"), F.max("gap").alias("max_gap")).withColumn("helped", F.col("max_gap") >= left).drop("run")
