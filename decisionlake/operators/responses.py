"""Requests to a model and what it answers: keys, cache, parsing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from decisionlake.functions.jsontext import is_object


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def cache_key(model: Column, revision: Column, prompt_hash: Column, sampling: dict[str, Column], seed: Column) -> Column:
    """SHA-256 of the compact JSON of a request with sorted keys (TR2)."""
    inner = F.struct(*[c.alias(k) for k, c in sorted(sampling.items())])
    whole = F.struct(model.alias("model_id"), revision.alias("model_revision"), prompt_hash.alias("prompt_hash"), inner.alias("sampling"), seed.alias("seed"))
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


#: What a hit takes from the cache, as far as the cache has it.
CACHED = ("text", "reasoning_text", "prompt_tokens", "completion_tokens")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with what the cache has where the key is known: text, reasoning and token
    counts, nulls too; such take no time, no retry and have no error (TR3)."""
    taken = [c for c in CACHED if c in cache.columns]
    known = cache.select("cache_key", F.struct(*taken).alias("_hit"))
    d = requests.join(known, "cache_key", "left")
    hit = F.col("_hit").isNotNull()
    kept = {c: F.when(hit, F.col(f"_hit.{c}")).otherwise(F.col(c)) if c in requests.columns else F.col(f"_hit.{c}") for c in taken}
    plain = {"latency_s": F.lit(0.0), "retries": F.lit(0), "status": F.lit("ok"), "error": F.lit(None)}
    kept |= {c: F.when(hit, v).otherwise(F.col(c)) for c, v in plain.items() if c in requests.columns}
    return d.withColumns(kept | {"cached": hit}).drop("_hit")


def split_reasoning(text: Column) -> tuple[Column, Column]:
    """(answer, reasoning): what stands before a closing tag is reasoning; without the
    tag there is none (TR7)."""
    at = F.instr(text, "</think>")
    answer = F.when(at > 0, F.substring(text, at + len("</think>"), F.length(text))).otherwise(text)
    before = F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"\A<think>", "")
    return strip(answer), F.when(at > 0, strip(before))


@F.pandas_udf(StringType())
def _first_object(text: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def one(t: str | None) -> str | None:
        at = -1 if t is None else t.find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(t, at)
                return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                at = t.find("{", at + 1)
        return None

    return text.map(one)


#: What a VARIANT may write in another way than the decoder: exponents, trailing zeros,
#: more digits than a double has, small numbers, escapes, characters beyond 16 bits.
_OTHERWISE = r"[0-9][eE]|[.][0-9]*0(?![0-9])|[0-9][0-9.]{15,}|[.]0000|-0(?![.0-9])|\\|[\x{10000}-\x{10FFFF}]"


def first_object(text: Column) -> Column:
    """The first JSON object of a text with its keys sorted and no blanks, else null (TR8):
    from the first brace that begins one to its end, whatever follows. Where that is all
    from the first brace to the last, as in answers with words around one object,
    expressions tell it; only other texts with a brace go to a decoder, row by row."""
    near = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    told = F.to_json(F.try_parse_json(near))
    plain = is_object(near) & ~near.rlike(_OTHERWISE) & told.isNotNull()
    return F.when(plain, told).otherwise(_first_object(F.when(~plain & F.contains(text, F.lit("{")), text)))


def extract_json_object(text: Column) -> Column:
    """As first_object, after one outer code fence is taken off."""
    t = strip(text)
    inner = F.regexp_extract(t, r"(?s)\A```[^\n]*\n(.*)```", 1)
    return first_object(F.when(t.rlike(r"(?s)\A```[^\n]*\n.*```"), strip(inner)).otherwise(t))


def unique_candidates(candidates: DataFrame) -> DataFrame:
    """Distinct actions a state, numbers rounded to 8 digits (TR13, TR14)."""
    key = F.struct("pair", *[F.bround(c, 8).alias(c) for c in ("eta_sensing", "eta_communication", "eta_near", "eta_cpu")])
    return candidates.groupBy("state_id").agg(F.count_distinct(key).alias("unique_candidates"))


def expand_templates(templates: DataFrame, cpu: list[float]) -> DataFrame:
    """Each template at each CPU fraction (TR18)."""
    d = templates.withColumn("eta_cpu", F.explode(F.array(*map(F.lit, cpu))))
    return d.withColumns({"eta_near": F.least("recommended_near", "max_near"), "candidate_source": F.lit("safe_template")})


def normalization_notes(requests: DataFrame) -> DataFrame:
    """How often each note occurs (TR21)."""
    return requests.select(F.explode("response_normalization_notes").alias("note")).groupBy("note").agg(F.count("*").alias("n"))
