"""Exact quantiles without holding a group's values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlake.sources.tables import shared_folder

#: Values of a group that a task may hold; beyond that a quantile's bracket is narrowed
#: by counts until so many lie inside. Steps of the sketch that narrows it (its own error is
#: an eighth of a step), and groups whose brackets are broadcast.
HELD, STEPS, FEW = 1_000_000, 256, 10_000


@dataclass(frozen=True)
class Exact:
    """The quantile p of a SQL expression, as percentile() gives it, under a name; digits
    to round it to, and what stands for it in a group without values."""

    name: str
    value: str
    p: float
    digits: int | None = None
    default: float | None = None

    def finish(self, c: Column) -> Column:
        c = c if self.default is None else F.coalesce(c, F.lit(self.default))
        return (c if self.digits is None else F.round(c, self.digits)).alias(self.name)


def _written(df: DataFrame, tag: str) -> DataFrame:
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _join(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with what their group has (a row a group; null is a group like others)."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))  # one row
    right = groups.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(c for c in groups.columns if c not in by))
    right = F.broadcast(right) if groups.count() <= FEW else right
    on = F.lit(True)
    for c in by:
        on = on & rows[c].eqNullSafe(right[f"_by_{c}"])
    return rows.join(right, on).drop(*(f"_by_{c}" for c in by))


def aggregate(df: DataFrame, by: list[str], *columns: Column | Exact) -> DataFrame:
    """df.groupBy(by).agg(columns), where the columns that are Exact hold at most HELD
    values of a group in a task, however large it is.

    A large group's quantile lies in a bracket, at first from its least to its largest value.
    A pass counts the values below, at and inside each bracket, and sketches those inside;
    the next bracket is the part of the sketch around the quantile's rank, a fiftieth
    of it or less. Ties end at a bracket's edge, whose rows are only counted. Once HELD values
    or fewer are inside, these are sorted. Every count is exact, so the result is, whatever
    the sketch's error; a rank that lay outside its bracket would be an error."""
    exact = [c for c in columns if isinstance(c, Exact)]
    plain = [c for c in columns if not isinstance(c, Exact)]
    values = {v: f"_x{i}" for i, v in enumerate(dict.fromkeys(c.value for c in exact))}
    slim = df.select(*by, *(F.expr(v).cast("double").alias(x) for v, x in values.items()))
    most = slim.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most <= HELD:
        return df.groupBy(*by).agg(*(c.finish(F.percentile(F.expr(c.value), c.p)) if isinstance(c, Exact) else c for c in columns))
    found = quantiles(_written(slim, "values"), by, [(values[c.value], c.p) for c in exact])
    done = df.groupBy(*by).agg(F.count("*").alias("_rows"), *plain)
    names = [c for c in done.columns if c not in [*by, "_rows"]]
    out = _join(done, found, by)
    order = iter(names)
    return out.select(*by, *(c.finish(F.col(f"_q{exact.index(c)}")) if isinstance(c, Exact) else F.col(f"`{next(order)}`") for c in columns))


def quantiles(rows: DataFrame, by: list[str], wanted: list[tuple[str, float]]) -> DataFrame:
    """The quantiles _q0, _q1, ... of double columns, (column, p) each, by group."""
    each = range(len(wanted))
    base = rows.groupBy(*by).agg(*(f(x).alias(f"{n}{i}") for i, (x, _) in enumerate(wanted) for n, f in (("_n", F.count), ("_lo", F.min), ("_hi", F.max))))
    ranks = [F.expr(f"case when _n{i} > 0 then (_n{i} - 1) * {p}D end").alias(f"_pos{i}") for i, (_, p) in enumerate(wanted)]
    now = _written(base.select(*by, *(f"{n}{i}" for i in each for n in ("_lo", "_hi")), *ranks), "brackets")
    inside = [f"{x} > _lo{i} and {x} < _hi{i}" for i, (x, _) in enumerate(wanted)]
    keep = [f"{n}{i}" for i in each for n in ("_lo", "_hi", "_pos")]
    grid = [k / STEPS for k in range(STEPS + 1)]

    def first(c: str) -> Column:
        return F.first(c).alias(c)  # equal in all rows of a group

    for _ in range(20):
        told = _join(rows, now, by).groupBy(*by).agg(*map(first, keep), *(
            c for i, (x, _) in enumerate(wanted) for c in (
                F.count_if(F.expr(f"{x} < _lo{i}")).alias(f"_below{i}"), F.count_if(F.expr(f"{x} = _lo{i}")).alias(f"_at{i}"), F.count_if(F.expr(inside[i])).alias(f"_in{i}"),
                F.count_if(F.expr(f"{x} <= _hi{i}")).alias(f"_upto{i}"), F.percentile_approx(F.expr(f"case when {inside[i]} then {x} end"), grid, 8 * STEPS).alias(f"_grid{i}"),
            )))
        told = _written(told, "brackets")
        if told.agg(F.max(F.greatest(*(F.col(f"_in{i}") for i in each), F.lit(0)))).first()[0] <= HELD:
            break

        def edge(i: int, end: str) -> Column:
            rank = f"(floor(_pos{i}) - _below{i} - _at{i}{' + 1' if end == '_hi' else ''}) / _in{i} * {STEPS}"
            at = f"floor({rank}) - 2" if end == "_lo" else f"ceil({rank}) + 2"
            beyond = f"{at} < 0" if end == "_lo" else f"{at} > {STEPS}"
            return F.expr(f"case when _in{i} <= {HELD} or {beyond} then {end}{i} else get(_grid{i}, cast(greatest(0, least({STEPS}, {at})) as int)) end").alias(f"{end}{i}")

        now = _written(told.select(*by, *(edge(i, end) for i in each for end in ("_lo", "_hi")), *(f"_pos{i}" for i in each)), "brackets")
    else:
        raise RuntimeError("the brackets did not close")
    counts = [f"{n}{i}" for i in each for n in ("_below", "_at", "_in", "_upto")]
    last = _join(rows, told.select(*by, *keep, *counts), by).groupBy(*by).agg(
        *map(first, [*keep, *counts]), *(F.sort_array(F.collect_list(F.expr(f"case when {inside[i]} then {x} end"))).alias(f"_list{i}") for i, (x, _) in enumerate(wanted)),
    )

    def at(i: int, rank: str) -> str:
        k = f"cast({rank}(_pos{i}) as bigint)"
        return (
            f"case when {k} < _below{i} or {k} >= _upto{i} then raise_error('a rank lies outside its bracket') when {k} < _below{i} + _at{i} then _lo{i}"
            f" when {k} < _below{i} + _at{i} + _in{i} then get(_list{i}, cast({k} - _below{i} - _at{i} as int)) else _hi{i} end"
        )

    last = last.select(*by, *(f"_pos{i}" for i in each), *(F.expr(at(i, f)).cast("double").alias(f"_{f}{i}") for i in each for f in ("floor", "ceil")))
    value = "case when _floor{0} = _ceil{0} then _floor{0} else (ceil(_pos{0}) - _pos{0}) * _floor{0} + (_pos{0} - floor(_pos{0})) * _ceil{0} end as _q{0}"
    return last.selectExpr(*by, *(value.format(i) for i in each))
