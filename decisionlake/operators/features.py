"""State features: payloads, hashes, names for positions, and metrics over arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of an observation, and the names of positions in its arrays.
OBSERVATION = ("pair_tokens", "pair_mask", "global_features", "virtual_queues", "previous_action")
PAIR_TOKEN = {
    0: "near_aoi_fraction", 1: "far_aoi_fraction", 2: "near_aoli_fraction", 3: "far_aoli_fraction", 4: "near_channel_gain_fraction", 5: "far_channel_gain_fraction",
    6: "near_csi_uncertainty_fraction", 7: "far_csi_uncertainty_fraction", 10: "near_packet_fraction", 11: "far_packet_fraction", 12: "previous_sic_margin_tanh", 13: "waiting_time_fraction",
}
GLOBAL = ("aosi_fraction", "target_position_x_normalized", "target_position_y_normalized", "target_velocity_x_normalized", "target_velocity_y_normalized")
CHOLESKY = ("L00", "L10", "L11", "L20", "L21", "L22", "L30", "L31", "L32", "L33")
PREVIOUS = {
    0: "scheduled_pair_fraction", 2: "eta_haps", 3: "eta_communication", 4: "eta_near_fraction_of_maximum", 5: "eta_jamming", 6: "previous_heading_fraction_of_pi", 7: "aav_speed_fraction", 8: "eta_cpu",
}
QUEUES = ("aoli_deficit", "delivery_deficit", "secrecy_outage_deficit")


def causal_payload(states: DataFrame, observation: str = "observation") -> DataFrame:
    """states with ``causal``, exactly the five fields with numbers to 6 digits; a field
    that is null is an error (FE1)."""
    def six(c: Column) -> Column:
        return F.transform(c, lambda x: F.bround(x.cast("double"), 6))

    o = F.col(observation)
    missing = F.lit(False)
    for f in OBSERVATION:
        missing = missing | o[f].isNull()
    tokens = F.transform(o["pair_tokens"], six)
    fields = {"pair_tokens": tokens, "pair_mask": F.transform(o["pair_mask"], lambda x: x.cast("int"))} | {f: six(o[f]) for f in OBSERVATION[2:]}
    packed = F.struct(*(fields[f].alias(f) for f in OBSERVATION))
    return states.withColumn("causal", F.when(missing, F.raise_error(F.lit("observation is missing keys"))).otherwise(packed))


def causal_json(causal: str = "causal") -> Column:
    """Canonical JSON of a causal payload."""
    return F.to_json(F.struct(*(F.col(f"{causal}.{f}").alias(f) for f in sorted(OBSERVATION))))


def state_hash(causal: str = "causal") -> Column:
    """SHA-256 of the payload's canonical JSON (FE2)."""
    return F.sha2(causal_json(causal), 256)


def serialize_observation(causal: str = "causal", header: str = "CAUSAL_STATE_V1", marker: str = "<ACTION>") -> Column:
    """Header, canonical JSON and action marker, a line each (FE15)."""
    return F.concat(F.lit(header + "\n"), causal_json(causal), F.lit("\n" + marker))


def name_features(states: DataFrame, pairs: int, causal: str = "causal") -> DataFrame:
    """states with ``named``: every position of the payload under its name (FE3). Arrays
    of other lengths than 14 a pair, 25, 9 and 6 * pairs + 2 are an error."""
    c, users = F.col(causal), 2 * pairs
    tokens, queues, whole, last = c["pair_tokens"], c["virtual_queues"], c["global_features"], c["previous_action"]
    good = F.forall(tokens, lambda t: F.size(t) == 14) & (F.size(whole) == 25) & (F.size(last) == 9) & (F.size(queues) == 3 * users + 2) & (F.size(tokens) == pairs)
    named_pairs = F.transform(tokens, lambda t, i: F.struct((i + 1).alias("pair_id"), (F.get(c["pair_mask"], i) != 0).alias("active"), *(t[k].alias(n) for k, n in PAIR_TOKEN.items())))

    def deficits(user: Column) -> Column:
        return F.struct(*(F.get(queues, user + k * users).alias(n) for k, n in enumerate(QUEUES)))

    by_pair = F.transform(F.sequence(F.lit(0), F.lit(pairs - 1)), lambda i: F.struct((i + 1).alias("pair_id"), deficits(2 * i).alias("near"), deficits(2 * i + 1).alias("far")))
    cholesky = F.struct(*(whole[5 + k].alias(n) for k, n in enumerate(CHOLESKY)))
    named = F.struct(
        named_pairs.alias("pairs"), F.struct(*(whole[k].alias(n) for k, n in enumerate(GLOBAL)), cholesky.alias("target_covariance_cholesky_lower_normalized")).alias("global"),
        F.struct(by_pair.alias("per_pair"), queues[3 * users].alias("sensing_outage_deficit"), queues[3 * users + 1].alias("tracking_uncertainty_deficit")).alias("virtual_queues"),
        F.struct(*(last[k].alias(n) for k, n in PREVIOUS.items())).alias("previous_action"),
    )
    return states.withColumn("named", F.when(good, named).otherwise(F.raise_error(F.lit("an array does not have the length of its contract"))))


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def state_metrics(aoi: str, aoli: str, queues: str, covariance: str, re: str, im: str) -> list[Column]:
    """Ages, queues, covariance trace and power of each channel of a state (FE4)."""
    a, b, q, p = F.flatten(aoi), F.flatten(aoli), F.col(queues), F.col(covariance)
    power = F.zip_with(re, im, lambda x, y: _total(F.zip_with(x, y, lambda u, v: u * u + v * v)))
    return [
        (_total(a) / F.size(a)).alias("mean_aoi"), F.array_max(a).alias("max_aoi"), (_total(b) / F.size(b)).alias("mean_aoli"), F.array_min(b).alias("min_aoli"), _total(q).alias("queue_l1"),
        F.sqrt(_total(F.transform(q, lambda x: x * x))).alias("queue_l2"), F.array_max(q).alias("queue_max"), _total(F.transform(p, lambda r, i: F.get(r, i))).alias("tracking_covariance_trace"), power.alias("estimated_channel_power"),
    ]


def tracking_errors(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position_squared_error, nees) of mean, truth (arrays) and covariance (array of
    rows): the error weighed by the pseudo-inverse, a batch of matrices at a time (FE5)."""
    kinds = {f.name: f.dataType.simpleString() for f in states.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            e = np.array(batch.column("mean").to_pylist(), dtype=np.float64).reshape(n, -1) - np.array(batch.column("truth").to_pylist(), dtype=np.float64).reshape(n, -1)
            p = np.array(batch.column("covariance").to_pylist(), dtype=np.float64).reshape(n, e.shape[1], e.shape[1])
            nees = np.einsum("ni,nij,nj->n", e, np.linalg.pinv(p), e) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array((e[:, :2] ** 2).sum(axis=1)), pa.array(nees)], [*keys, "position_squared_error", "nees"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", position_squared_error double, nees double"
    return states.select(*keys, "mean", "truth", "covariance").mapInArrow(run, schema)


def constraint_increments(log: DataFrame, aoli_min: float, aoli_cap: float, delivery_min: float, secrecy: float, sensing: float, trace_max: float) -> DataFrame:
    """log (aoli, delivered, secrecy_outage: an entry a user; scheduled_pair from 1, or 0;
    detected; covariance_trace) with ``increments``, one for each virtual queue (TS5): the
    secrecy outage counts for the scheduled pair's two users only."""
    age = F.transform("aoli", lambda x: (F.lit(aoli_min) - x) / aoli_cap)
    delivery = F.transform("delivered", lambda x: F.lit(delivery_min) - x.cast("double"))
    outage = F.transform("secrecy_outage", lambda x, i: F.when(F.floor(i / 2) + 1 == F.col("scheduled_pair"), x.cast("double") - secrecy).otherwise(0.0))
    rest = F.array((~F.col("detected")).cast("double") - sensing, F.col("covariance_trace") / trace_max - 1.0)
    return log.withColumn("increments", F.concat(age, delivery, outage, rest))
