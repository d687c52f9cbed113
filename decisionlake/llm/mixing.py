"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.llm.common import attach, materialize, ranked, table

#: Least sizes of the bands that are rounded one after another: what a band cannot
#: settle, at most one of its documents a source, is passed on to smaller ones.
BANDS = (4096, 1024, 256, 64, 16, 1)
#: Members of a node of the reduction tree.
FAN = 512
#: Parts of a word that mass is counted in, so that moving it is exact.
_UNIT = 1 << 20
_MASK = (1 << 64) - 1


def _draw(state: int) -> float:
    """A number in [0, 1) from 64 bits (the finalizer of splitmix64)."""
    z = (state ^ (state >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB & _MASK
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def pivot(cap: list[int], mass: list[int], seed: list[int]) -> tuple[list[int], int | None]:
    """(masses, who stays fractional or None): from the first on, two fractional members
    meet, and mass moves from one to the other, either way with the chance that keeps
    each one's expectation, until one holds nothing or all it can; the other goes on.
    The sum stays the same to the unit."""
    mass, left = list(mass), None
    for b in range(len(mass)):
        if not 0 < mass[b] < cap[b]:
            continue
        if left is None:
            left = b
            continue
        a = left
        to_a, to_b = min(cap[a] - mass[a], mass[b]), min(mass[a], cap[b] - mass[b])
        move = to_a if _draw((seed[a] * 0x9E3779B97F4A7C15 + seed[b]) & _MASK) * (to_a + to_b) < to_b else -to_b
        mass[a] += move
        mass[b] -= move
        left = a if 0 < mass[a] < cap[a] else b if 0 < mass[b] < cap[b] else None
    return mass, left


def _settle(rows: DataFrame) -> DataFrame:
    """rows (_s, _node, _at, size, _mass, _seed) with the mass after pivot() over each
    node's members by _at: FAN at most, so a group is small."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_at")
        cap = [s * _UNIT for s in group["size"].to_pylist()]
        mass, _ = pivot(cap, group["_mass"].to_pylist(), group["_seed"].to_pylist())
        return group.set_column(group.schema.get_field_index("_mass"), "_mass", pa.array(mass, pa.int64()))

    return rows.groupBy("_s", "_node").applyInArrow(run, rows.schema)


def round_band(rows: DataFrame, most: int, tag: str) -> DataFrame:
    """rows (_s, _rank from 0, size, _mass, _seed) of one band with masses all nothing or
    whole. Nodes of FAN neighbours settle first; what stays fractional, one of a node, are
    the members of the next level's nodes, up to one node a source (``most``: rows of the
    largest source), whose last member is drawn by itself."""
    levels, now = [], rows.withColumns({"_node": F.expr(f"_rank div {FAN}"), "_at": F.col("_rank")})
    while True:
        now, most = _settle(now.select("_s", "_node", "_at", "size", "_mass", "_seed")), -(-most // FAN)
        levels.append(now)
        if most <= 1:
            break
        now = levels[-1] = materialize(now, tag)
        now = now.where(f"_mass > 0 and _mass < size * {_UNIT}L").select("_s", F.expr(f"_node div {FAN}").alias("_node"), F.col("_node").alias("_at"), "size", "_mass", F.xxhash64("_seed", F.lit("up")).alias("_seed"))
    u = "shiftrightunsigned(xxhash64(_seed, 'last'), 11) / 9007199254740992D"
    done = levels.pop().withColumn("_mass", F.expr(f"case when _mass > 0 and _mass < size * {_UNIT}L then case when {u} * size * {_UNIT}L < _mass then size * {_UNIT}L else 0L end else _mass end"))
    while levels:
        below = levels.pop()
        open_ = done.select("_s", F.col("_at").alias("_node"), F.col("_mass").alias("_up"))
        whole = below.where(f"_mass = 0 or _mass = size * {_UNIT}L")
        rest = below.where(f"_mass > 0 and _mass < size * {_UNIT}L").join(open_, ["_s", "_node"])
        done = whole.unionByName(rest.withColumn("_mass", F.col("_up")).drop("_up"))
    return done.select("_s", F.col("_at").alias("_rank"), F.expr(f"_mass = size * {_UNIT}L").alias("_more"), "size")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sources (_source, source_size) with ``_s``, their place by code point, and ``target``:
    ``share`` of all sizes by the weights in turn, none above ``most`` times its size; the
    excess goes to the others by weight until none is above. Equal to min(most * size,
    weight * level) at one level, which rises a round as sources reach their bound; a
    round brings three numbers to the driver."""
    d = ranked(sources, [], ["_source"], "sources").withColumnRenamed("_rank", "_s")
    d = materialize(d.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_s") % len(weights) + 1).cast("int"))), "sources")
    total = share * (d.agg(F.sum("source_size")).first()[0] or 0)
    level, known = 0.0, -1
    while True:
        above = F.lit(known >= 0) & (F.col("_w") * level > most * F.col("source_size"))
        count, held, free = d.agg(F.count_if(above), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("_w")))).first()
        if count == known or not free:
            break
        known, level = count, (total - most * (held or 0)) / free
    return d.withColumn("target", F.least(most * F.col("source_size"), F.col("_w") * level))


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """How often a mix takes each document: the columns ``keep`` of docs, source, size (words
    `[^\\x20\\x09-\\x0D]+`), source_size, target, copies (long) and taken = copies * size.

    Each document of a source has the same expected copies target / source_size: so many
    whole ones, and a fraction that is rounded. Words move between fractions so that the
    source's sum stays; bands of sizes are rounded from the longest documents down, each
    making good what the one before missed, so that a source misses its target by half
    a document of its last band or so, if it has short documents enough. No document exceeds ``most`` times its
    size, as long as that is a whole number.

    Null texts have size 0 and are never taken; a null source is one, the last. Repeated
    rows are documents of their own, told apart only by their place: together they get the
    same counts each time. Results depend on (doc_id, size, source) and the seed alone.
    An empty table gives none. Columns in ``keep`` must not be named as the results.
    """
    aside = {c: f"_keep{i}" for i, c in enumerate(keep)}
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    d = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in aside.items()), "source", size.alias("size"), F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias("_seed"))
    # null last
    d = materialize(d.withColumn("_source", F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))), "sizes")
    source = targets(d.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, share, most)
    source = materialize(source.withColumn("_r", F.expr("case when source_size > 0 then target / source_size else 0D end")), "targets")
    band = F.coalesce(*(F.when(F.col("size") >= low, i) for i, low in enumerate(BANDS)), F.lit(len(BANDS)))
    d = attach(d, source.select("_source", "_s"), ["_source"]).drop("_source").withColumn("_band", band)
    d = materialize(ranked(d, ["_s", "_band"], ["_seed", "size"], "members"), "members")
    sizes = materialize(d.groupBy("_s", "_band").agg(F.count("*").alias("_n"), F.sum("size").alias("_words")), "bands")
    largest = dict(sizes.groupBy("_band").agg(F.max("_n")).collect())  # a row a band
    carry, rounded = source.select("_s", F.lit(0.0).alias("_carry"), "_r"), []
    for i in range(len(BANDS)):
        if i not in largest:
            continue
        each = sizes.where(F.col("_band") == i)
        plan = carry.join(each.drop("_band"), "_s", "left").selectExpr("_s", "_r", "_n", "coalesce(_words, 0) as _words", "_carry + (_r - floor(_r)) * coalesce(_words, 0) as _want")
        plan = materialize(plan, "plan")
        p = plan.where("_words > 0").selectExpr("_s", "least(1D, greatest(0D, _want / _words)) as _p")
        rows = attach(d.where(F.col("_band") == i).select("_s", "_rank", "size", "_seed"), p, ["_s"])
        done = round_band(rows.selectExpr("_s", "_rank", "size", f"cast(round(_p * size * {_UNIT}) as bigint) as _mass", "_seed"), largest[i], f"band{i}")
        done = materialize(done.withColumn("_band", F.lit(i)), f"band{i}")
        took = done.where("_more").groupBy("_s").agg(F.sum("size").alias("_took"))
        carry = plan.join(took, "_s", "left").selectExpr("_s", "_want - coalesce(_took, 0) as _carry", "_r")
        rounded.append(done.where("_more").select("_s", "_band", "_rank", "_more"))
    more = d.where("false").select("_s", "_band", "_rank", F.lit(True).alias("_more"))
    for other in rounded:
        more = more.unionByName(other)
    d = attach(d.join(more, ["_s", "_band", "_rank"], "left"), source.select("_s", "source_size", "target", "_r"), ["_s"])
    d = d.withColumn("copies", F.expr("case when size = 0 then 0L else cast(floor(_r) as bigint) + cast(coalesce(_more, false) as bigint) end"))
    return d.select(*(F.col(a).alias(c) for c, a in aside.items()), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() takes it."""
    d = materialize(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix")
    times = mix(d, ("_mix_row",), **settings).where("copies > 0").select("_mix_row", F.expr("explode(sequence(1L, copies))").alias("_mix_copy"))
    return d.join(times, "_mix_row").select(*(F.col(f"`{c}`") for c in docs.columns))


def op11_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mix of their sources."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
