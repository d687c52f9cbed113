"""Quality rules: base rules and robust multivariate outliers by minimum covariance
determinant, in Spark expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from decisionlake.llm.common import materialize, table

#: Share of a group's rows that the determinant is minimised over, concentration steps
#: at most, the fall of the log determinant that they go on for, rows a group needs for an
#: estimate of its own, and squared distance beyond which a row is rejected.
SHARE, STEPS, SETTLED, GROUP, CUTOFF = 0.75, 8, 1e-2, 10, 50.0
#: Rows that the language's scales count in a group's shape (the regularised form of
#: the estimate): small groups lean on them, in large ones they vanish.
WEIGHT = 20
#: Added to the variances: most documents have no symbol and no repeated window at
#: all, so that the inner rows alone would have no spread there.
RIDGE = (0.05, 0.02, 0.09, 0.0025)
#: Variance of the normal distribution over its inner 75 % in four dimensions:
#: 0.75 / P(chi2_6 <= quantile_0.75(chi2_4)).
CONSISTENT = 1.4866
#: Rows of a table of groups that is broadcast (under 20 MB), and the salts of a hot
#: group's rows where the table is larger.
SMALL, SALTS = 100_000, 64
DIMS = 4
_X = [f"_x{i}" for i in range(DIMS)]
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
#: Steps of the logarithm of the squared distance that rows are counted by.
_FINE = 16
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with the columns of BASE and the statistic vector ``_x0``.. (columns named
    alike must not exist). Words are runs without [\\x20\\x09-\\x0D]; null texts have
    none. Repeated five-word windows are found by 64-bit hashes of the windows.

    The vector: log number of words, log mean word length, log of one plus symbols per
    hundred characters, share of repeated words; null where base_failed.
    """
    text = F.coalesce("text", F.lit(""))
    white = " \t\n\x0b\x0c\r"
    d = docs.withColumns({
        "_w": F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"),
        "_l": F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, white, "") != ""),
        "word_chars": F.length(F.translate(text, white, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
    })
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_g": F.expr("transform(slice(_w, 1, greatest(size(_w) - 4, 0)), (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2), get(_w, i + 3), get(_w, i + 4)))"),
    }).drop("_w", "_l")
    d = d.withColumn("_s", F.expr("case when size(array_distinct(_g)) < size(_g) then sort_array(transform(_g, (g, i) -> struct(g as g, i as i))) end")).drop("_g")
    d = d.withColumn("_p", F.expr(
        """sort_array(transform(filter(
            transform(_s, (x, k) -> struct(x.i as i, coalesce(get(_s, k - 1).g = x.g, false) or coalesce(get(_s, k + 1).g = x.g, false) as twice)),
            y -> y.twice), y -> y.i))"""
    )).drop("_s")
    d = d.withColumn("n_repeat_words", F.expr(
        "coalesce(aggregate(transform(_p, (p, k) -> case when k = 0 then 5 else least(5, p - get(_p, k - 1)) end), 0L, (a, x) -> a + x), 0L)"
    )).drop("_p")
    d = d.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    x = ("ln(n_words)", "ln(word_chars / n_words)", "ln(1 + 100 * n_symbols / word_chars)", "n_repeat_words / n_words")
    return d.withColumns({c: F.expr(f"case when not base_failed then {e} end") for c, e in zip(_X, x)})


def _distance(shape: str = "") -> str:
    """Squared Mahalanobis distance as SQL: rows of the inverse Cholesky factor."""
    rows = (" + ".join(f"_k{i}{j} * (_x{j} - _m{j})" for j in range(i + 1)) for i in range(DIMS))
    return " + ".join(f"pow({r}, 2)" for r in rows)


def _whitened(moments: DataFrame, scale: float) -> DataFrame:
    """moments (_n, sums, the language's variances ``_t``) with means ``_m``, the inverse
    Cholesky factor ``_k`` of the covariance, column by column, and its log determinant.
    One selection, whose columns are made of those before."""

    def covariance(i: int, j: int) -> str:
        if i != j:
            return f"_n * {scale} * (_e{i}{j} - _m{i} * _m{j}) / (_n + {WEIGHT})"
        return f"(_n * {scale} * greatest(0, _e{i}{i} - _m{i} * _m{i}) + {WEIGHT} * _t{i}) / (_n + {WEIGHT}) + {RIDGE[i]}"

    p = [f"_s{i} / _n as _m{i}" for i in range(DIMS)] + [f"_q{i}{j} / _n as _e{i}{j}" for i, j in _PAIRS] + [f"{covariance(i, j)} as _c{i}{j}" for i, j in _PAIRS]
    for j in range(DIMS):
        p.append(f"sqrt(greatest({RIDGE[j]} / 10, _c{j}{j}" + "".join(f" - pow(_l{j}{k}, 2)" for k in range(j)) + f")) as _l{j}{j}")
        for i in range(j + 1, DIMS):
            p.append(f"(_c{i}{j}" + "".join(f" - _l{i}{k} * _l{j}{k}" for k in range(j)) + f") / _l{j}{j} as _l{i}{j}")
    for j in range(DIMS):
        p.append(f"1 / _l{j}{j} as _k{j}{j}")
        for i in range(j + 1, DIMS):
            p.append("-(" + " + ".join(f"_l{i}{k} * _k{k}{j}" for k in range(j, i)) + f") / _l{i}{i} as _k{i}{j}")
    p.append("2 * (" + " + ".join(f"ln(_l{j}{j})" for j in range(DIMS)) + ") as _logdet")
    return moments.selectExpr("*", *p).select(*moments.columns, *_MODEL, "_logdet")


def _sums() -> list:
    return [F.count("*").alias("_n"), *(F.sum(x).alias(f"_s{i}") for i, x in enumerate(_X)), *(F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"_q{i}{j}") for i, j in _PAIRS)]


_MODEL = [*(f"_m{i}" for i in range(DIMS)), *(f"_k{i}{j}" for i, j in _PAIRS)]
_TARGET = [f"_t{i}" for i in range(DIMS)]
_TOTALS = ["_n", *(f"_s{i}" for i in range(DIMS)), *(f"_q{i}{j}" for i, j in _PAIRS)]


def _counted(df: DataFrame, tag: str, rows: Column | None = None) -> tuple[DataFrame, int]:
    """df written and read back, and its number of rows (of those where ``rows`` holds), counted
    while it is written."""
    seen = Observation()
    df = materialize(df.observe(seen, F.count(F.lit(1) if rows is None else F.when(rows, 1)).alias("n")), tag)
    return df, seen.get["n"]


def groups(narrow: DataFrame) -> tuple[DataFrame, int]:
    """(_lang, _source) to the group its rows are judged in: its own where it has
    GROUP rows, else the language's small sources together; where those have too few,
    the largest own group of the language. A language without GROUP rows has no group:
    its rows are not judged by those of other languages, and stay undecided. With their number."""
    sizes = narrow.groupBy("_lang", "_source").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_own", F.col("_n") >= GROUP)
    rest = sizes.groupBy("_lang").agg(
        F.sum(F.when(~F.col("_own"), F.col("_n"))).alias("_rest"),
        F.max(F.when(F.col("_own"), F.struct("_n", "_source"))).getField("_source").alias("_largest"),
    )
    return _counted(
        sizes.join(rest, "_lang", "left").select(
            "_lang", "_source", "_own", "_rest", "_largest",
            F.when(F.col("_own"), F.concat_ws("\x00", "_lang", "_source"))
            .when(F.col("_rest") >= GROUP, F.concat("_lang", F.lit("\x00")))
            .otherwise(F.concat_ws("\x00", "_lang", "_largest")).alias("_group"),
        ).where("_own or _rest >= %d or _largest is not null" % GROUP).select("_lang", "_source", "_group"),
        "groups",
    )


def attach(rows: DataFrame, small: DataFrame, n: int, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with ``small`` (few rows a key), which has at most n rows: up to SMALL
    rows it is broadcast; beyond that each of its rows is repeated a salt, so that the
    rows of a hot key meet it in SALTS tasks and sums over them are combined first."""
    if n <= SMALL:
        return rows.join(F.broadcast(small), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    each = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, [*keys, "_salt"], how).drop("_salt")


def _quartiles() -> list:
    return [F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"_p{i}") for i, x in enumerate(_X)]


#: The variance of a normal distribution with the quartiles of _quartiles().
_SPREAD = "pow((_p{0}[2] - _p{0}[0]) / 1.349, 2)"


def starts(narrow: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Of each _group the three estimates that concentration starts from (_start): the plain
    one, medians with the group's own quartile scales, and medians with the language's; with the
    language's variances ``_t``; and the number of rows. There are at most n languages."""
    scales = narrow.groupBy("_lang").agg(*_quartiles()).selectExpr("_lang", *(f"{_SPREAD.format(i)} as _t{i}" for i in range(DIMS)))
    totals = narrow.groupBy("_group", "_lang").agg(*_sums(), *_quartiles()).join(F.broadcast(scales) if n <= SMALL else scales, "_lang")
    own = [f"(_n * {_SPREAD.format(i)} + {WEIGHT} * _t{i}) / (_n + {WEIGHT})" for i in range(DIMS)]
    models = [", ".join(["0 as _start", *_MODEL, "_logdet"])]
    for start, variance in ((1, own), (2, _TARGET)):
        k = [f"1 / sqrt({variance[i]} + {RIDGE[i]}) as _k{i}{j}" if i == j else f"0.0D as _k{i}{j}" for i, j in _PAIRS]
        models.append(", ".join([f"{start} as _start", *(f"_p{i}[1] as _m{i}" for i in range(DIMS)), *k, "cast(null as double) as _logdet"]))
    return _counted(_whitened(totals, 1.0).selectExpr("_group", *_TARGET, "inline(array({}))".format(", ".join(f"struct({m})" for m in models))), "mcd")


def estimates(narrow: DataFrame, n: int) -> DataFrame:
    """Minimum-covariance-determinant location and shape of each _group of narrow
    (_group, _lang, _x0..), of which there are at most n, the shape regularised by the
    language's variances.

    From each of the starts, concentration steps: a step counts a group's rows by their
    squared distance on a logarithmic scale, with the sums a covariance needs, keeps the
    nearest rows up to SHARE (to the end of a step of the scale), and estimates from them
    again, until no start's log determinant falls below its least so far by SETTLED (as the
    inner share ends at a step of the scale, it may go round instead of settling) or STEPS are
    done. Of all that a group's starts and steps came to, the least determinant is taken. A step
    is one aggregation; a group of any size is summed by all tasks, and its steps of the scale
    are bounded in number.

    The driver keeps the plans of all that ran. So a step carries what the next one needs (the
    language's variances, the least determinant) through its sums and joins only once."""
    now, models = starts(narrow, n)
    now = now.withColumn("_least", F.col("_logdet"))
    carried = [F.first(c).alias(c) for c in (*_TARGET, "_least")]
    results = []
    for _ in range(STEPS):
        near = attach(narrow, now.select("_group", "_start", *_MODEL, *_TARGET, F.least("_least", "_logdet").alias("_least")), models, ["_group"])
        near = near.withColumn("_at", F.expr(f"cast(floor({_FINE} * ln(1e-6 + {_distance()})) as int)"))
        near = near.groupBy("_group", "_start", "_at").agg(*_sums(), *carried)
        rows = "over (partition by _group, _start order by _at rows between unbounded preceding and {})".format
        near = near.selectExpr(
            "*", f"sum(_n) {rows('unbounded following')} as _all", f"coalesce(sum(_n) {rows('1 preceding')}, 0) as _before",
        ).where(f"_before < {SHARE} * _all")
        inner = near.groupBy("_group", "_start").agg(*(F.sum(c).alias(c) for c in _TOTALS), *carried)
        now, fell = _counted(_whitened(inner, 1.0), "mcd", F.expr(f"_least is null or _logdet <= _least - {SETTLED}"))
        results.append(now)
        if not fell:
            break
    best = reduce(DataFrame.unionByName, results).groupBy("_group").agg(F.min_by(F.struct(*_TOTALS, *_TARGET), F.struct("_logdet", "_start")).alias("_best")).select("_group", "_best.*")
    return _whitened(best, CONSISTENT).select("_group", *_MODEL)


def _judged(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` of docs, those of BASE, and kept: false where base_failed,
    else whether the squared distance from the group's estimate is at most CUTOFF, or
    the language has too few rows for an estimate (distance null).

    docs has text, lang and source; null languages and sources are groups like others.
    The columns of docs are set aside under names of their own (second result) while
    this runs, so that none clashes with ours. Repeated rows count and come out each; an empty table gives
    none. The wide table is written once with its statistics; the estimates read only
    the vectors. What joins it is a row a group, broadcast or salted as attach() says.
    """
    aside = {c: f"_keep{i}" for i, c in enumerate(keep)}
    d = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in aside.items()), F.col("text"), F.coalesce("lang", F.lit("\x01")).alias("_lang"), F.coalesce("source", F.lit("\x01")).alias("_source"))
    d = materialize(with_statistics(d).drop("text"), "stats")
    good = d.where("not base_failed").select("_lang", "_source", *_X)
    where, n = groups(good)
    model = estimates(materialize(attach(good, where, n, ["_lang", "_source"]).select("_group", "_lang", *_X), "vectors"), n)
    rules = materialize(attach(where, model, n, ["_group"]).drop("_group"), "rules")
    scored = attach(d, rules, n, ["_lang", "_source"], "left").withColumn("_d2", F.expr(_distance()))
    verdict = F.expr(f"not base_failed and coalesce(_d2, 0) <= {CUTOFF}").alias("kept")
    return scored.select(*aside.values(), *BASE, verdict, F.col("_d2").alias("distance")), aside


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """As _judged() says; ``keep`` must not name one of our columns."""
    scored, aside = _judged(docs, keep)
    return scored.select(*(F.col(a).alias(c) for c, a in aside.items()), *BASE, "kept", "distance")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, in their own columns."""
    scored, aside = _judged(docs, docs.columns)
    return scored.where("kept").select(*(F.col(a).alias(c) for c, a in aside.items()))


def op1_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return judged(table(spark, sf_dir, "documents"), ["doc_id"])
