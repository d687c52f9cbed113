"""Link budgets as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIGHT = 299792458.0


def path_loss_db(distance: str, frequency: float, extra_db: float = 0.0) -> Column:
    """Free-space loss in dB (LK1)."""
    return 20 * F.log10(4 * pi * frequency * F.col(distance) / LIGHT) + extra_db


def noma_kpis(links: DataFrame, bandwidth: float = 1.0, threshold: float = 0.2, residual: float = 0.0) -> DataFrame:
    """Rates of a near and a far user that share power, the far one decoded first; the
    far rate takes the worse of both receivers, and of the far signal the share ``residual``
    still disturbs the near user (LK3). Each user has a disturbance of its own
    (near_disturbance, far_disturbance; one column, disturbance, where these are absent);
    a negative power, gain or disturbance is an error."""
    if bandwidth <= 0 or not 0 <= residual <= 1:
        raise ValueError("invalid bandwidth or residual")
    near, far = ("near_disturbance", "far_disturbance") if "near_disturbance" in links.columns else ("disturbance", "disturbance")
    whole = " and ".join(f"{c} >= 0" for c in ("near_power", "far_power", "near_gain", "far_gain", near, far))
    power = F.when(~F.expr(whole), F.raise_error(F.lit("powers, gains and disturbances must not be negative"))).otherwise(F.col("near_power"))
    d = links.withColumn("near_power", power).withColumns({
        "far_sinr": F.expr(f"far_power * far_gain / (near_power * far_gain + {far})"), "far_at_near_sinr": F.expr(f"far_power * near_gain / (near_power * near_gain + {near})"),
        "near_sinr": F.expr(f"near_power * near_gain / ({residual}D * far_power * near_gain + {near})"),
    })
    return d.withColumns({
        "far_rate": bandwidth * F.log2(1 + F.least("far_sinr", "far_at_near_sinr")), "near_rate": bandwidth * F.log2(1 + F.col("near_sinr")),
        "sic_margin": F.col("far_at_near_sinr") - threshold,
    })


def packet_completed(rate: str, duration: float, bits: float) -> Column:
    """Whether a rate carries a packet within its duration (LK3)."""
    return duration * F.col(rate) >= bits


def near_power_cap(threshold: float, power: str = "near_power + far_power", near_disturbance: str = "near_disturbance") -> Column:
    """The largest near power that leaves the far signal decodable at the near user (LK3);
    minus infinity without a gain."""
    cap = F.expr(f"(({power}) * near_gain - {threshold}D * {near_disturbance}) / (near_gain * {1 + threshold}D)")
    return F.when(F.col("near_gain") == 0, float("-inf")).otherwise(cap)


def beam_gain(h_re: Column, h_im: Column, w_re: Column, w_im: Column) -> Column:
    """Squared magnitude of the inner product of two complex arrays (LK2)."""
    def total(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    re, im = total(h_re, w_re) + total(h_im, w_im), total(h_re, w_im) - total(h_im, w_re)
    return re * re + im * im


def secrecy_kpis(links: DataFrame, residual: float, target_rate: float, duration: float, bits: float, bandwidth: float = 1.0) -> DataFrame:
    """What an eavesdropper that decodes the far user first can learn, and the rates that
    stay secret (LK4). Needs near_rate and far_rate of noma_kpis and target_gain."""
    d = links.withColumns({
        "target_far_rate": bandwidth * F.log2(1 + F.expr("far_power * target_gain / (near_power * target_gain + disturbance)")),
        "target_near_rate": bandwidth * F.log2(1 + F.expr(f"near_power * target_gain / ({residual}D * far_power * target_gain + disturbance)")),
    })
    for user in ("far", "near"):
        secret = F.greatest(F.lit(0.0), F.col(f"{user}_rate") - F.col(f"target_{user}_rate"))
        d = d.withColumns({f"{user}_secrecy": secret, f"{user}_intercepted": F.col(f"target_{user}_rate") * duration >= bits})
        d = d.withColumn(f"{user}_outage", F.col(f"{user}_secrecy") < target_rate)
    return d


def sensing_kpis(links: DataFrame, threshold: float, floor: float, scales: dict[str, float]) -> DataFrame:
    """Detection and the variance of each measurement from a column sinr (LK5)."""
    quality = F.greatest(F.col("sinr"), F.lit(floor))
    return links.withColumns({"detected": F.col("sinr") >= threshold} | {f"{k}_variance": v / quality for k, v in scales.items()})
