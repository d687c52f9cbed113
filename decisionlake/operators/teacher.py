"""From raw answers of a model to pools of candidates: normalising, checking, routing,
templates. Candidates travel as JSON texts until they are known to be well-formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: The controls of an action that are continuous, the bounds of what a
#: candidate may say beside its template, and how far numbers may lie apart.
CONTINUOUS = ("eta_haps", "eta_communication", "eta_near", "eta_jamming", "aav_heading_rad", "aav_speed_fraction", "eta_cpu")
OPTIONAL = {
    "pair": (0, None), "ris_code": (0, None), "eta_haps": (0.0, 1.0), "eta_communication": (0.0, 1.0), "eta_jamming": (0.0, 1.0),
    "aav_heading_rad": (-3.141592653589793, 3.141592653589793), "aav_speed_fraction": (0.0, 1.0),
}
CLOSE, NEAREST_WATTS = 1.5e-6, 8.0
_FIELDS = ("template_id", "eta_near", "eta_cpu", "reason_codes", "confidence", *OPTIONAL)


def canonical(c: Column, kind: DataType) -> Column:
    """A value with the fields of all its structs sorted by name."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[canonical(c[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: canonical(x, kind.elementType))
    return c


def canonical_json(df: DataFrame, column: str) -> Column:
    """Compact JSON of a struct column, keys sorted at every level (TR1)."""
    return F.to_json(canonical(F.col(column), df.schema[column].dataType), {"ignoreNullFields": "false"})


def render_prompts(states: DataFrame, packet: str, instructions: str) -> DataFrame:
    """states with ``prompt``, the instructions and the packet's canonical JSON, and its
    SHA-256 (TR6): equal packets give equal prompts."""
    d = states.withColumn("prompt", F.concat(F.lit(instructions + "\n"), canonical_json(states, packet)))
    return d.withColumn("prompt_hash", F.sha2("prompt", 256))


#: SQL of a number in a text, and of a whole one.
_NUMBER, _WHOLE = r"^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$", r"^\\s*[+-]?[0-9]+([.]0*)?\\s*$"


#: Number fields of a candidate, and those of them that have no fraction.
_NUMBERS, _CODES = ("eta_near", "eta_cpu", "confidence", *OPTIONAL), ("pair", "ris_code")


def _number(kind: str, said: str, whole: bool = False) -> str:
    """SQL: a JSON value, told by its kind and its text, as a number; null where it is of no
    type that stands for one: numbers, true and false, and numbers in texts."""
    text = f"case when {said} rlike '{_WHOLE if whole else _NUMBER}' then try_cast(trim({said}) as double) end"
    return f"case when {kind} = 'BOOLEAN' then if({said} = 'true', 1D, 0D) when {kind} = 'STRING' then {text} when {kind} in ('BIGINT', 'DOUBLE', 'FLOAT') or {kind} like 'DECIMAL%' then try_cast({said} as double) end"


def _whole(x: str) -> str:
    return f"case when {x} = floor({x}) and abs({x}) < 9e15D then cast({x} as bigint) end"


def normalized(payload: str = "payload") -> Column:
    """The candidates of a payload (JSON text) as an array of structs, with what was
    repaired (TR9): a template named as actual takes the template's place, a single
    reason becomes a list, an override of reasons drops out; ``keys`` are the keys left
    (null where a candidate is no object). Each field is of its own type or null, and
    ``mistyped`` names those that are there with a value of another type: a template is a
    text, reasons are a list of texts, numbers are what _number() takes (a code has no
    fraction), and null only stands for an optional control."""
    # step by step, each field once: a VARIANT; kinds and texts of its fields; their values; what is wrong
    fields = ("template_id", "template_id_actual", "reason_codes", *_NUMBERS)
    variants = f"transform(from_json({payload}, 'candidates array<string>').candidates, c -> named_struct('v', try_parse_json(c), 'k', json_object_keys(c)))"
    read = ", ".join(f"'{k}', named_struct('kind', coalesce(schema_of_variant(try_variant_get(x.v, '$.{k}', 'variant')), ''), 'said', try_variant_get(x.v, '$.{k}', 'string'))" for k in fields)
    kinds = f"transform({variants}, x -> named_struct('k', x.k, 'reasons', try_variant_get(x.v, '$.reason_codes', 'array<variant>'), {read}))"
    has = "array_contains(x.k, '{}')"
    one = "if(x.{0}.kind = 'STRING', x.{0}.said, cast(null as string))"
    template = f"if({has.format('template_id_actual')}, {one.format('template_id_actual')}, {one.format('template_id')})"
    texts = "if(forall(x.reasons, e -> coalesce(schema_of_variant(e), '') = 'STRING'), transform(x.reasons, e -> cast(e as string)), cast(null as array<string>))"
    reasons = f"case when x.reason_codes.kind = 'STRING' then array(x.reason_codes.said) when {has.format('reason_codes')} then {texts} else cast(array() as array<string>) end"
    numbers = ", ".join(f"'{k}', {_number(f'x.{k}.kind', f'x.{k}.said', k in _CODES)}" for k in _NUMBERS)
    values = f"transform({kinds}, x -> named_struct('x', x, 'template_id', {template}, 'template_id_raw', {one.format('template_id')}, 'reason_codes', {reasons}, {numbers}))"
    numbers = ", ".join(f"'{k}', {_whole(f'y.{k}') if k in _CODES else f'y.{k}'}" for k in _NUMBERS)
    codes = f"transform({values}, y -> named_struct('x', y.x, 'template_id', y.template_id, 'template_id_raw', y.template_id_raw, 'reason_codes', y.reason_codes, {numbers}))"
    has = "array_contains(y.x.k, '{}')"
    actual, said = has.format("template_id_actual"), has.format("template_id")
    notes = (
        f"case when {actual} and not {said} then concat('candidate[', i, '].template_id_actual->template_id')"
        f" when {actual} and y.x.template_id <=> y.x.template_id_actual then concat('candidate[', i, '].template_id_actual_duplicate_removed')"
        f" when {actual} then concat('candidate[', i, '].template_id_conflict_prefer_actual') end",
        "case when y.x.reason_codes.kind = 'STRING' then concat('candidate[', i, '].reason_codes_string_to_array') end",
        f"case when {has.format('reason_codes_override')} then concat('candidate[', i, '].reason_codes_override_removed') end",
    )
    keys = f"array_union(array_except(y.x.k, array('template_id_actual', 'reason_codes_override')), if({actual}, array('template_id'), array()))"
    mistyped = [f"case when ({actual} or {said}) and y.template_id is null then 'template_id' end", "case when y.reason_codes is null then 'reason_codes' end"]
    mistyped += [f"case when {has.format(k)} and y.{k} is null" + (f" and y.x.{k}.kind <> 'VOID'" if k in OPTIONAL else "") + f" then '{k}' end" for k in _NUMBERS]
    return F.expr(
        f"transform({codes}, (y, i) -> named_struct('candidate_index', i, 'template_id', y.template_id, 'template_id_raw', y.template_id_raw, 'reason_codes', y.reason_codes, {', '.join(f"'{k}', y.{k}" for k in _NUMBERS)},"
        f" 'keys', {keys}, 'notes', array_compact(array({', '.join(notes)})), 'mistyped', array_compact(array({', '.join(mistyped)}))))"
    )


def validated(responses: DataFrame, expected: str = "expected_candidates") -> DataFrame:
    """responses (state_id, payload, ``expected``) with ``candidates``, ``notes``, ``valid``
    and ``error``, the first thing that is wrong (TR10): fields that are not known or of
    another type, values beyond their bounds, another schema, state or number of candidates."""
    allowed = "array(" + ", ".join(f"'{k}'" for k in _FIELDS) + ")"
    bounds = [f"(x.{k} is null or x.{k} >= {low}" + (f" and x.{k} <= {high})" if high is not None else ")") for k, (low, high) in OPTIONAL.items()]
    wrong = {
        "a candidate is no object": "exists(candidates, x -> x.keys is null)",
        "a candidate has unknown fields": f"exists(candidates, x -> size(array_except(x.keys, {allowed})) > 0)",
        "a template_id has no valid length": "exists(candidates, x -> not coalesce(length(x.template_id) between 1 and 64, false))",
        "eta_near lies beyond its bounds": "exists(candidates, x -> not coalesce(x.eta_near between 0 and 0.5D, false))",
        "eta_cpu lies beyond its bounds": "exists(candidates, x -> not coalesce(x.eta_cpu between 0 and 1, false))",
        "reason_codes are not a list of three at most": "exists(candidates, x -> x.reason_codes is null or size(x.reason_codes) > 3)",
        "confidence lies beyond its bounds": "exists(candidates, x -> array_contains(x.keys, 'confidence') and not coalesce(x.confidence between 0 and 1, false))",
        "another control lies beyond its bounds": f"exists(candidates, x -> not ({' and '.join(bounds)}))",
    }
    type_error = "case when exists(candidates, x -> size(x.mistyped) > 0) then concat(get(flatten(transform(candidates, x -> x.mistyped)), 0), ' is of another type') end"
    top = "try_parse_json(payload)"
    kind = "coalesce(schema_of_variant(try_variant_get(top, '$.{0}', 'variant')), '')"
    version, state = _number(kind.format("schema_version"), "try_variant_get(top, '$.schema_version', 'string')", True), f"if({kind.format('state_id')} = 'STRING', try_variant_get(top, '$.state_id', 'string'), null)"
    checks = [
        "case when payload is null or json_object_keys(payload) is null then 'response contains no valid JSON object' end",
        "case when size(array_except(json_object_keys(payload), array('schema_version', 'state_id', 'candidates'))) > 0 then 'the response has unknown fields' end",
        "case when candidates is null then 'candidates are no list' end",
        *(f"case when {test} then '{text}' end" for text, test in list(wrong.items())[:2]), type_error,
        *(f"case when {test} then '{text}' end" for text, test in list(wrong.items())[2:]),
        f"case when not coalesce({version} = 1, false) then 'unsupported teacher response schema' end",
        f"case when not coalesce({state} = state_id, false) then 'teacher response state_id does not match the request' end",
        f"case when size(candidates) <> {expected} then concat('expected ', {expected}, ' candidates, received ', size(candidates)) end",
    ]
    d = responses.select("*", F.expr(top).alias("top"), F.explode(F.array(normalized())).alias("candidates"))  # generated, so that a filter does not work it out again
    d = d.withColumn("error", F.expr(f"coalesce({', '.join(checks)})")).drop("top")
    d = d.withColumn("notes", F.expr("coalesce(flatten(transform(candidates, x -> x.notes)), array())"))
    return d.withColumn("valid", F.col("error").isNull())


def route(checked: DataFrame, status: str = "call_status", call_error: str | None = None, max_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests, selections) of checked responses (TR11). ``status`` is what the call itself
    came to (null: ok). A call that failed keeps its status and its own error, whatever
    its payload; an ok call with a response that is not valid is a parse_error. Every
    request has its counts (0 where it is rejected) and whether its completion_tokens
    reached ``max_tokens``; for each rejected one there is a selection of none."""
    call = F.coalesce(F.col(status), F.lit("ok"))
    good = F.col("valid") & (call == "ok")
    key = "struct(x.template_id, bround(x.eta_near, 8), bround(x.eta_cpu, 8))"
    failed = F.coalesce(F.col(call_error), F.lit("unknown teacher failure")) if call_error else F.lit("unknown teacher failure")
    requests = checked.withColumn("error", F.when(call != "ok", failed).otherwise(F.col("error"))).withColumns({
        "status": F.when(call != "ok", call).when(F.col("valid"), "ok").otherwise("parse_error"), "parse_valid": good, "schema_valid": good,
        "candidates_returned": F.when(good, F.size("candidates")).otherwise(0),
        "unique_candidates": F.when(good, F.expr(f"size(array_distinct(transform(candidates, x -> {key})))")).otherwise(0),
        "truncated": F.coalesce(F.col("completion_tokens") >= max_tokens, F.lit(False)) if max_tokens is not None else F.lit(False),
    })
    counts = ("candidate_pool_count", "teacher_candidate_count", "verified_candidate_count", "external_baseline_rollout_count", "verification_rollouts", "adaptive_rounds")
    amounts = ("score_margin", "standardized_margin", "margin_confidence_lower", "margin_confidence_upper", "selection_probability", "safe_template_coverage_rate")
    rejected = requests.where("not schema_valid").select(
        "state_id", F.lit(-1).alias("selected_candidate_index"), F.lit("none").alias("selected_candidate_source"), F.lit("unresolved").alias("decision_status"), F.lit(True).alias("selection_uncertain"),
        F.lit("rejected").alias("acceptance_status"), F.col("error").alias("rejection_reason"), *(F.lit(0).alias(c) for c in counts), *(F.lit(0.0).alias(c) for c in amounts),
        F.array().cast("array<int>").alias("equivalent_candidate_indices"),
    )
    return requests, rejected


def explode_candidates(checked: DataFrame) -> DataFrame:
    """A row a candidate of the valid responses, confidence 0.5 where none is said (TR12)."""
    d = checked.where("valid").select("state_id", F.explode("candidates").alias("c"))
    return d.select("state_id", "c.candidate_index", "c.template_id", "c.template_id_raw", "c.reason_codes", "c.eta_near", "c.eta_cpu", F.coalesce("c.confidence", F.lit(0.5)).alias("confidence"))


def action_key(pair: str = "pair", ris: str = "ris_code", controls: tuple[str, ...] = CONTINUOUS, zero: bool = False) -> Column:
    """The identity of an action: its two codes and seven controls to 8 digits (TR13); with
    ``zero`` -0.0 is 0.0, as it is for joins and groups, but not in arrays."""
    return F.struct(F.col(pair).cast("long").alias("pair"), F.col(ris).cast("long").alias("ris_code"), *[(F.bround(F.col(c).cast("double"), 8) + F.lit(0.0) if zero else F.bround(F.col(c).cast("double"), 8)).alias(f"x{i}") for i, c in enumerate(controls)])


def unique_ratio(candidates: DataFrame) -> DataFrame:
    """Candidates of a state and distinct actions among them (TR14)."""
    return candidates.groupBy("state_id").agg(F.count("*").alias("candidates"), F.count_distinct(action_key()).alias("unique_candidates"))


def _bare(text: str) -> str:
    """SQL: a text without white space of any kind at its ends."""
    return f"regexp_replace({text}, '(?U)^\\\\s+|\\\\s+\\\\z', '')"


def _plain(text: str) -> str:
    return f"replace(replace(lower({_bare(text)}), '-', '_'), ' ', '_')"


def _beside(templates: DataFrame) -> DataFrame:
    """Rows of templates for a join by state. They are as many as the states, times the
    templates of each, which the planner's guess from the file's size does not see: never broadcast."""
    return templates.hint("merge")


def resolve_template(candidates: DataFrame, templates: DataFrame) -> DataFrame:
    """candidates with ``resolved`` and ``template_resolution`` (TR15): the template of the
    state that is named, by its own name, by the raw one, by a reason, as the longest
    prefix of the raw name or of a reason, by its numbers, or as the nearest in watts of
    the same pair. A state's few templates come as one array."""
    shape = r"^p([0-9]+)_sense([0-9]+(?:[.][0-9]+)?)w$"
    item = F.struct("template_id", "pair", "eta_haps", "eta_communication")
    offered = templates.groupBy("state_id").agg(F.sort_array(F.collect_list(item)).alias("_t"))
    d = candidates.join(_beside(offered), "state_id", "left").withColumns({
        "_t": F.coalesce("_t", F.array().cast(offered.schema["_t"].dataType)), "_n": F.expr(_bare("coalesce(template_id, '')")),
        "_r": F.expr(_bare("case when coalesce(template_id_raw, '') = '' then coalesce(template_id, '') else template_id_raw end")),
    })
    longest = "array_max(transform(filter(_t, t -> startswith({}, concat(" + _plain("t.template_id") + ", '_'))), t -> struct(length(t.template_id) as n, t.template_id as id))).id"
    watts = f"cast(regexp_extract({{}}, '{shape}', 2) as double)"
    pair = f"cast(regexp_extract({{}}, '{shape}', 1) as int)"
    raw, own = _plain("_r"), _plain("t.template_id")
    nearest = (
        f"case when {raw} rlike '{shape}' then array_min(transform(filter(_t, t -> t.pair = {pair.format(raw)} and {own} rlike '{shape}'),"
        f" t -> struct(abs({watts.format(own)} - {watts.format(raw)}) as d, t.template_id as id))) end"
    )
    same = f"filter(_t, t -> t.pair = pair and abs(t.eta_haps - eta_haps) <= {CLOSE}D and abs(t.eta_communication - eta_communication) <= {CLOSE}D)"
    ways = [
        ("case when array_contains(_t.template_id, _n) then _n end", "case when coalesce(template_id_raw, '') = '' or template_id_raw = _n then 'exact' else 'normalized_template_id' end"),
        ("case when array_contains(_t.template_id, _r) then _r end", "'exact'"),
        ("get(filter(reason_codes, r -> array_contains(_t.template_id, r)), 0)", "'reason_code_alias'"),
        (longest.format(raw), "'template_id_suffix_alias'"),
        (f"get(array_compact(transform(reason_codes, r -> {longest.format(_plain('r'))})), 0)", "'reason_code_suffix_alias'"),
        (f"case when size({same}) = 1 then get({same}, 0).template_id end", "'numeric_action_alias'"),
        (f"case when ({nearest}).d <= {NEAREST_WATTS}D then ({nearest}).id end", "'nearest_available_template'"),
    ]
    found = ", ".join(f"case when ({way}) is not null then named_struct('id', {way}, 'how', {how}) end" for way, how in ways)
    d = d.withColumn("_f", F.expr(f"coalesce({found})"))
    return d.select(*candidates.columns, F.col("_f.id").alias("resolved"), F.coalesce("_f.how", F.lit("unresolved")).alias("template_resolution"))


def project(resolved: DataFrame, templates: DataFrame) -> DataFrame:
    """Resolved candidates with their template's controls (TR17): the near share is the
    template's own where the pair is 0, else at most its maximum; the processor share
    stays. ``request_valid`` is false for all candidates of a state with one unresolved."""
    t = templates.select("state_id", F.col("template_id").alias("resolved"), F.struct("pair", "eta_haps", "eta_communication", "default_near", "maximum_near").alias("_t"))
    d = resolved.join(_beside(t), ["state_id", "resolved"], "left")
    near = F.when(F.col("_t.pair") == 0, F.col("_t.default_near")).otherwise(F.least("eta_near", "_t.maximum_near"))
    return d.withColumns({
        "request_valid": ~F.bool_or(F.col("resolved").isNull()).over(Window.partitionBy("state_id")), "eta_near": near, "pair": F.col("_t.pair"), "eta_haps": F.col("_t.eta_haps"),
        "eta_communication": F.col("_t.eta_communication"), **{c: F.lit(0.0) for c in ("eta_jamming", "aav_heading_rad", "aav_speed_fraction")}, "ris_code": F.lit(0),
    }).drop("_t")


def build_pool(teacher: DataFrame, bank: DataFrame, greedy: DataFrame) -> DataFrame:
    """All candidates of a state under one numbering (TR19): the teacher's as they are,
    of the bank those whose action was not met before, the greedy one always. Each frame
    has state_id, candidate_index and the controls of an action."""
    keep = ["state_id", "candidate_index", "pair", "ris_code", *CONTINUOUS]
    parts = zip((teacher, bank, greedy), ("teacher", "safe_template", "greedy_baseline"))
    rows = [d.select(*keep).withColumns({"candidate_source": F.lit(name), "_o": F.lit(o)}) for o, (d, name) in enumerate(parts)]
    d = rows[0].unionByName(rows[1]).unionByName(rows[2]).repartition("state_id").withColumn("_k", action_key())  # one exchange for all that follows, or none
    d = d.selectExpr("*", "row_number() over (partition by state_id, _k order by _o, candidate_index) as _rn").where("_o <> 1 or _rn = 1")
    d = d.drop("_rn").selectExpr("*", "row_number() over (partition by state_id order by _o, candidate_index) - 1 as _i")
    return d.drop("candidate_index", "_o", "_k").withColumnRenamed("_i", "candidate_index")


def pool_summary(pool: DataFrame, bank: DataFrame) -> DataFrame:
    """A state's pool: its size, its sources and the share of the bank's actions in it
    (TR19), told from the sets of both; a state's actions are few."""
    key = action_key(zero=True)
    want = bank.groupBy("state_id").agg(F.collect_set(key).alias("_want"))
    each = pool.groupBy("state_id").agg(
        F.count("*").alias("candidate_pool_count"), *(F.count_if(F.col("candidate_source") == s).alias(s) for s in ("teacher", "safe_template", "greedy_baseline")),
        F.max(F.when(F.col("candidate_source") == "greedy_baseline", F.col("candidate_index"))).alias("greedy_candidate_index"), F.collect_set(key).alias("_have"),
    )
    share = "size(array_intersect(_want, _have)) / size(_want)"
    return each.join(want.hint("merge"), "state_id", "left").withColumn("coverage", F.coalesce(F.expr(share), F.lit(0.0))).drop("_want", "_have")


def template_compliance(candidates: DataFrame, templates: DataFrame) -> DataFrame:
    """candidates with ``template_compliant`` (TR20): null for baselines, false where the
    template is not known, else whether all controls are the template's."""
    t = templates.select("state_id", "template_id", F.struct("pair", "eta_haps", "eta_communication", "default_near", "maximum_near").alias("_t"))
    d = candidates.join(_beside(t), ["state_id", "template_id"], "left")
    same = (
        f"pair = _t.pair and abs(eta_haps - _t.eta_haps) <= {CLOSE}D and abs(eta_communication - _t.eta_communication) <= {CLOSE}D and eta_near <= _t.maximum_near + {CLOSE}D"
        f" and ris_code = 0 and abs(eta_jamming) <= {CLOSE}D and abs(aav_heading_rad) <= {CLOSE}D and abs(aav_speed_fraction) <= {CLOSE}D"
        f" and (_t.pair <> 0 or abs(eta_near - _t.default_near) <= {CLOSE}D)"
    )
    return d.withColumn("template_compliant", F.expr(f"case when candidate_source in ('greedy_baseline', 'random_baseline') then null else coalesce({same}, false) end")).drop("_t")


def note_rate(requests: DataFrame, notes: str) -> DataFrame:
    """Share of requests with a note (TR21)."""
    return requests.agg(F.round(F.avg((F.size(notes) > 0).cast("double")), 8).alias("note_rate"))
