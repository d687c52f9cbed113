"""Controls, features and costs of one slot as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper and lower bounds of the continuous controls (fixed values).
BOUNDS = {
    "eta_haps": (0.0, 1.0), "eta_communication": (0.0, 1.0), "eta_near": (0.0, 0.5), "eta_jamming": (0.0, 1.0),
    "heading": (-pi, pi), "speed": (0.0, 1.0), "eta_cpu": (0.0, 1.0),
}


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clip_action(actions: DataFrame, pairs: int, ris_enabled: bool = False) -> DataFrame:
    """Every control within its bounds; a pair out of range becomes -1, and a ris_code, if
    there is one, 0 unless these are enabled (FE12)."""
    pair = F.when(F.col("pair").between(0, pairs), F.col("pair")).otherwise(-1)
    ris = {"ris_code": F.lit(0).cast(actions.schema["ris_code"].dataType)} if "ris_code" in actions.columns and not ris_enabled else {}
    return actions.withColumns({"pair": pair} | ris | {c: clip(F.col(c), *b) for c, b in BOUNDS.items()})


def decode_action(raw: DataFrame) -> DataFrame:
    """Unconstrained controls mapped into their bounds (FE11)."""
    out = {c: sigmoid(F.col(c)) for c in BOUNDS if c not in ("eta_near", "heading")}
    return raw.withColumns(out | {"eta_near": 0.5 * sigmoid(F.col("eta_near")), "heading": pi * F.tanh("heading")})


def repair_distance(before: str, after: str, pairs: int) -> Column:
    """Mean absolute difference of two action structs, each control scaled to one (FE13)."""
    scale = {"pair": 1 / max(pairs, 1), "eta_near": 2.0, "heading": 1 / pi}
    parts = [F.abs(F.col(f"{before}.{c}") - F.col(f"{after}.{c}")) * scale.get(c, 1.0) for c in ("pair", *BOUNDS)]
    return sum(parts[1:], parts[0]) / len(parts)


def queue_features(queues: Column, reference: float, cap: float) -> Column:
    """An array of queue lengths on a logarithmic scale from 0 to 1 (FE6)."""
    return F.transform(queues, lambda q: clip(F.log1p(clip(q, 0.0, cap)) / F.log1p(F.lit(reference)), 0.0, 1.0))


def db_to_linear(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10)


def linear_to_db(x: Column) -> Column:
    """A ratio in dB; one that is not positive is an error (FE14)."""
    return 10 * F.log10(F.when(x > 0, x).otherwise(F.raise_error(F.lit("a linear power ratio must be positive"))))


def thermal_noise_watts(bandwidth: Column, density_dbm: float = -174.0, figure_db: float = 0.0) -> Column:
    return db_to_linear(density_dbm - 30 + linear_to_db(bandwidth) + figure_db)


def processing_delay(cycles: Column, frequency: Column, slot_s: float) -> Column:
    """Whole slots that a job takes, at least one (TS8)."""
    return F.greatest(F.lit(1), F.ceil(cycles / (frequency * slot_s))).cast("long")


def slot_energy(communication: Column, sensing: Column, slot_s: float, capacitance: float, cycles: Column, frequency: Column) -> Column:
    return slot_s * (communication + sensing) + capacitance * cycles * frequency * frequency


def stage_cost(parts: dict[str, tuple[float, float]]) -> Column:
    """Weighted sum of columns over their references, given as {column: (weight,
    reference)}; a negative value is an error (TS9)."""
    def part(c: str, weight: float, reference: float) -> Column:
        return weight * F.when(F.col(c) < 0, F.raise_error(F.lit(f"{c} must not be negative"))).otherwise(F.col(c)) / reference

    terms = [part(c, *x) for c, x in parts.items()]
    return sum(terms[1:], terms[0])


#: The violations that a total sums up (fixed values).
VIOLATIONS = ("reliability_violation", "secrecy_violation", "sensing_violation", "uncertainty_violation", "power_violation", "mobility_violation")


def mean_positive(increments: str) -> Column:
    """Mean of the positive values of an array, 0 where there is none (TS10)."""
    positive = F.filter(increments, lambda x: x > 0)
    return F.when(F.size(positive) > 0, F.aggregate(positive, F.lit(0.0), lambda s, x: s + x) / F.size(positive)).otherwise(0.0)


def mean_age(ages: str) -> Column:
    """Mean over the users of an array of ages, one of the parts of stage_cost() (TS9)."""
    return F.aggregate(ages, F.lit(0.0), lambda s, x: s + x) / F.size(ages)


def violation_total(columns: list[str] | tuple[str, ...] = VIOLATIONS) -> Column:
    """Sum of the positive parts (TS10)."""
    terms = [F.greatest(F.col(c), F.lit(0.0)) for c in columns]
    return sum(terms[1:], terms[0])


def non_finite(columns: list[str], bounds: dict[str, tuple[float, float]] | None = None) -> Column:
    """True where any column is null, NaN or infinite, or lies beyond its bounds (TS14)."""
    beyond = [(F.col(c) < low) | (F.col(c) > high) for c, (low, high) in (bounds or {}).items()]
    bad = beyond + [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in columns]
    out = bad[0]
    for b in bad[1:]:
        out = out | b
    return out


def complete_action(actions: DataFrame, power: float, low_hz: float, high_hz: float) -> DataFrame:
    """Powers and CPU frequency of an action; pair 0 only senses (LK6)."""
    total = F.col("eta_haps") * power
    d = actions.withColumn("communication_power", F.when(F.col("pair") == 0, 0.0).otherwise(F.col("eta_communication") * total))
    d = d.withColumns({"sensing_power": total - F.col("communication_power"), "near_power": F.col("eta_near") * F.col("communication_power")})
    return d.withColumns({"far_power": F.col("communication_power") - F.col("near_power"), "cpu_hz": low_hz + F.col("eta_cpu") * (high_hz - low_hz)})
