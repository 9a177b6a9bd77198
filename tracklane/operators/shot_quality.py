"""Shot-quality model: ridge logistic regression on shot features with a shrunken shooter skill.

The prior is two aggregates and a join, the design a list of column
expressions, the fit Newton steps over aggregates; parameters are JSON.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.functions.scalars import clip
from tracklane.operators.regression import newton_logistic

# Zones in design order, feature groups of each model, limits of the prior.
ZONES = ("rim", "paint", "mid", "corner3", "above3")
MODELS = {
    "M0_zone": ("zone",),
    "M1_geometry_defense": ("zone", "geom", "defense"),
    "M2_plus_dribble": ("zone", "geom", "defense", "dribble"),
    "M3_plus_shooter": ("zone", "geom", "defense", "dribble", "shooter"),
}
LEAST_ATTEMPTS, LEAST_SHOOTERS, STRENGTH_RANGE, DEFAULT_STRENGTH, LEAST_VARIANCE, LOGIT_CLIP, FAR_FT = 20, 10, (5.0, 2000.0), 200.0, 1e-5, 1e-4, 30.0


def logit(p: Column) -> Column:
    q = clip(p, LOGIT_CLIP, 1 - LOGIT_CLIP)
    return F.ln(q / (1 - q))


def shooter_prior(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(zone, p, strength) and (shooter_id, zone, n, m): league rates, prior strengths by moments, and counts."""
    counts = train.groupBy("shooter_id", "zone").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("made").cast("int")).alias("m"))
    rates = counts.groupBy("zone").agg((F.sum("m") / F.sum("n")).alias("p"))
    enough = counts.where(F.col("n") >= LEAST_ATTEMPTS).join(rates, "zone")
    moments = enough.groupBy("zone").agg(F.var_pop(F.col("m") / F.col("n")).alias("seen"), F.avg(F.col("p") * (1 - F.col("p")) / F.col("n")).alias("noise"), F.count(F.lit(1)).alias("k"))
    spread = F.greatest(F.col("seen") - F.col("noise"), F.lit(LEAST_VARIANCE))
    strength = F.when(F.col("k") >= LEAST_SHOOTERS, clip(F.col("p") * (1 - F.col("p")) / spread - 1, *STRENGTH_RANGE)).otherwise(DEFAULT_STRENGTH)
    return rates.join(moments, "zone", "left").select("zone", "p", strength.alias("strength")), counts


def with_skill(shots: DataFrame, zones: DataFrame, counts: DataFrame, leave_one_out: bool) -> DataFrame:
    """Adds `skill`: logit of the shooter's shrunken rate less that of the zone; without the shot's own outcome if leave_one_out."""
    own = F.lit(1 if leave_one_out else 0)
    n = F.greatest(F.coalesce("__n", F.lit(0)) - own, F.lit(0))
    m = F.when(F.coalesce("__n", F.lit(0)) > 0, F.col("__m") - own * F.col("made").cast("int")).otherwise(0)
    joined = shots.join(F.broadcast(zones.toDF("zone", "__p", "__s")), "zone", "left")  # five zones
    joined = joined.join(counts.toDF("shooter_id", "zone", "__n", "__m"), ["shooter_id", "zone"], "left")
    skill = logit((m + F.col("__s") * F.col("__p")) / (n + F.col("__s"))) - logit(F.col("__p"))
    return joined.withColumn("skill", skill).drop("__p", "__s", "__n", "__m")


def design(groups: tuple[str, ...]) -> dict[str, Column]:
    """Named feature columns. Missing defender distances count as far, missing dribbles have a flag of their own."""
    z, one = F.col("zone"), lambda c: F.coalesce(c, F.lit(False)).cast("double")
    out: dict[str, Column] = {}
    if "zone" in groups:
        out |= {f"zone_{name}": one(z == name) for name in ZONES[1:]}
    if "geom" in groups:
        d = F.col("dist_ft")
        out |= {"dist": d, "dist2": d * d / 100, "angle": F.col("angle_deg") / 90}
    if "defense" in groups:
        near = lambda c: F.ln(F.coalesce(F.col(c), F.lit(FAR_FT)) + 0.5)
        out |= {"log_def1": near("def1_ft"), "log_def_front": near("def_front_ft"), "log_def1_x_three": near("def1_ft") * one(F.col("is_three")), "log_def1_x_rim": near("def1_ft") * one(z == "rim")}
    if "dribble" in groups:
        n = F.col("n_dribbles")
        out |= {"drib_unknown": n.isNull().cast("double"), "drib_1": one(n == 1), "drib_2_4": one(n.between(2, 4)), "drib_5plus": one(n >= 5), "catch_shoot": one(F.col("catch_and_shoot")), "transition": one(F.col("is_transition"))}
    if "shooter" in groups:
        out["shooter_skill"] = F.col("skill")
    return out


@dataclass
class ShotModel:
    groups: tuple[str, ...]
    coefficients: dict[str, float]
    zones: list[tuple[str, float, float]]
    counts: DataFrame | None = None

    def with_inputs(self, shots: DataFrame, leave_one_out: bool = False) -> DataFrame:
        """shots with the shooter's skill, if the model uses it."""
        if "shooter" in self.groups:
            zones = shots.sparkSession.createDataFrame(self.zones, "zone string, p double, strength double")
            shots = with_skill(shots, zones, self.counts if self.counts is not None else shots.select("shooter_id", "zone", F.lit(0).alias("n"), F.lit(0).alias("m")).limit(0), leave_one_out)
        return shots

    def eta(self) -> Column:
        """The linear predictor, over rows that with_inputs gives."""
        out = F.lit(self.coefficients["intercept"])
        for name, column in design(self.groups).items():
            out = out + self.coefficients[name] * column
        return out

    def predict(self, shots: DataFrame, leave_one_out: bool = False) -> DataFrame:
        """shots with `xfg`; null where a feature is null."""
        return self.with_inputs(shots, leave_one_out).withColumn("xfg", 1 / (1 + F.exp(-self.eta())))

    def to_json(self) -> str:
        return json.dumps({"groups": self.groups, "coefficients": self.coefficients, "zones": self.zones}, indent=2)

    @classmethod
    def from_json(cls, text: str, counts: DataFrame | None = None) -> ShotModel:
        d = json.loads(text)
        return cls(tuple(d["groups"]), d["coefficients"], [tuple(z) for z in d["zones"]], counts)


def trusted(shots: DataFrame) -> DataFrame:
    """Shots whose release is seen in the ball's flight, and whose location is known."""
    return shots.where(F.col("release_method").isin("rim", "apex") & F.col("dist_ft").isNotNull())


def fit(train: DataFrame, model: str = "M3_plus_shooter", c: float = 1.0) -> ShotModel:
    groups, zones, counts = MODELS[model], [], None
    if "shooter" in groups:
        table, counts = shooter_prior(train)
        zones = [(r["zone"], r["p"], r["strength"]) for r in table.collect()]  # five zones
        train = with_skill(train, table, counts, leave_one_out=True)
    found = newton_logistic(train, F.col("made").cast("int"), design(groups), c)
    return ShotModel(groups, dict(zip(found.names, map(float, found.beta), strict=True)), zones, counts)


def points_difference(shots: DataFrame, model: ShotModel, scenarios: dict[str, dict[str, Column]]) -> DataFrame:
    """Expected points of each shot, and by how much they exceed those of each scenario, which replaces defence features."""
    value = F.when(F.col("is_three"), 3).otherwise(2)
    out = model.predict(shots).withColumnRenamed("xfg", "xfg_real")
    for name, columns in scenarios.items():
        out = model.predict(out.withColumns({f"__{k}": F.col(k) for k in columns}).withColumns(columns)).withColumn(f"dep_{name}", (F.col("xfg_real") - F.col("xfg")) * value)
        out = out.withColumns({k: F.col(f"__{k}") for k in columns}).drop("xfg", *[f"__{k}" for k in columns])
    return out
