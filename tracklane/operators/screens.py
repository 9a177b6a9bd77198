"""Screens, switches and phases: event tables joined in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.operators.interval import first_after_anchor_excluding, point_in_interval
from tracklane.operators.islands import running_id

#: Phases by priority, highest first.
PHASES = ("help", "closeout", "recovery", "screen", "pre_screen", "other")


def group_screens(screens: DataFrame, by: list[str], t: str, tie: str, gap: int) -> DataFrame:
    """Adds screen_group per key: a new one where more than gap passed since the screen before."""
    w = Window.partitionBy(*by).orderBy(t, tie)
    return running_id(screens.withColumn("__apart", F.col(t) - F.lag(t).over(w) > gap), by, [t, tie], F.col("__apart"), "screen_group").drop("__apart")


def classify_switches(switches: DataFrame, screens: DataFrame, by: list[str], window: int) -> DataFrame:
    """Adds event_class and screen_id to reassignments.

    switches: by, switch_id, def_id, from_id, to_id, t; screens: by, screen_id,
    screen_order, screened_def, screener_def, user_id, screener_id, t_contact.
    A screen takes, on each side, the first matching switch (by switch_id)
    within the window. With both sides they are a screen_switch, else the one
    is one_sided; later screens in screen_order override earlier ones of the
    same class, and one_sided never overrides screen_switch. All others are
    rotation.
    """
    cell = F.floor(F.col("t") / window)
    s = switches.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    pairs = s.join(screens.withColumn("cell", F.floor(F.col("t_contact") / window)), [*by, "cell"]).where(F.abs(F.col("t") - F.col("t_contact")) <= window)
    side_a = (F.col("def_id") == F.col("screened_def")) & (F.col("from_id") == F.col("user_id")) & (F.col("to_id") == F.col("screener_id"))
    side_b = (F.col("def_id") == F.col("screener_def")) & (F.col("from_id") == F.col("screener_id")) & (F.col("to_id") == F.col("user_id"))
    per_screen = pairs.groupBy(*by, "screen_id", "screen_order").agg(F.min(F.when(side_a, F.col("switch_id"))).alias("a"), F.min(F.when(side_b, F.col("switch_id"))).alias("b")).where("a is not null or b is not null")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    hits = F.when(both, F.array("a", "b")).otherwise(F.array(F.coalesce("a", "b")))
    claims = per_screen.select(*by, F.explode(hits).alias("switch_id"), F.struct(both.cast("int").alias("whole"), "screen_order", "screen_id").alias("claim"))
    best = claims.groupBy(*by, "switch_id").agg(F.max("claim").alias("best"))
    label = F.when(F.col("best").isNull(), "rotation").when(F.col("best.whole") == 1, "screen_switch").otherwise("one_sided")
    return switches.join(best, [*by, "switch_id"], "left").withColumn("event_class", label).withColumn("screen_id", F.col("best.screen_id")).drop("best")


def screen_responses(screens: DataFrame, possessions: DataFrame, helps: DataFrame, lead: int, horizon: int, cell: int) -> DataFrame:
    """One row per screen group: its possession, whether it was switched, and the first help by a third defender.

    screens: game, screen_group, screen_id, t_contact, screened_def, screener_def,
    switched; possessions: game, possession, t_start, t_end; helps: possession,
    help_id, def_id, t. A screen belongs to the possession that holds its contact,
    else to one that starts within lead of it; screens of none go. A group has the
    possession and the two defenders of its first screen (by contact, then id) and
    is switched if one of its screens was. Help counts from the first contact to
    horizon after it, by neither of the two; ties go to the smaller help_id.
    """
    contacts = screens.select("game", F.col("screen_id").alias("point_id"), F.col("t_contact").alias("t"), "screen_group", "screened_def", "screener_def", "switched")
    spans = possessions.select("game", F.col("possession").alias("interval_id"), "t_start", "t_end")
    placed = point_in_interval(contacts, spans, ["game"], lead, cell, prefer_inside=True).where("interval_id IS NOT NULL")
    first = F.min(F.struct("t", "point_id", "interval_id", "screened_def", "screener_def")).alias("f")
    groups = placed.groupBy("game", "screen_group").agg(first, F.max(F.coalesce("switched", F.lit(False))).alias("switched"), F.count(F.lit(1)).alias("n_screens"))
    own = groups.select("game", "screen_group", F.col("f.interval_id").alias("possession"), F.col("f.t").alias("t_contact"), F.col("f.screened_def").alias("screened_def"), F.col("f.screener_def").alias("screener_def"), "switched", "n_screens")
    anchors = own.select(F.struct("game", "screen_group").alias("anchor_id"), F.col("possession").alias("key"), F.col("t_contact").alias("t_ms"), F.array("screened_def", "screener_def").alias("without"))
    answers = helps.select(F.col("help_id").alias("response_id"), F.col("possession").alias("key"), F.col("t").alias("t_ms"), F.col("def_id").alias("actor"))
    helped = first_after_anchor_excluding(anchors, answers, horizon).select("anchor_id.game", "anchor_id.screen_group", F.col("delay_ms").alias("help_delay_ms"), F.col("actor").alias("helper"))
    return own.join(helped, ["game", "screen_group"]).withColumn("helped", F.col("helper").isNotNull())


def phase(in_help: Column, in_closeout: Column, recovering: Column, in_screen: Column, before_screen: Column) -> Column:
    flags = (in_help, in_closeout, recovering, in_screen, before_screen)
    out = F.when(F.coalesce(flags[0], F.lit(False)), PHASES[0])
    for flag, name in zip(flags[1:], PHASES[1:-1], strict=True):
        out = out.when(F.coalesce(flag, F.lit(False)), name)
    return out.otherwise(PHASES[-1])
