"""Merkle manifest of a dataset: nodes labelled by the intervals of leaf ranks they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.llm.common import attach, materialize, ranked, table

#: Leaves below a node that one group hashes at a time; a band is as many levels.
BUCKET = 256


def leaf_hash(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of columns one after another: '-' if null, else the number
    of UTF-8 bytes, ':', and the value as text."""
    said = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said)), 256)


def _levels(fan: int) -> int:
    """Levels of a band: as many as BUCKET leaves have, one at least."""
    levels = 1
    while fan ** (levels + 1) <= BUCKET:
        levels += 1
    return levels


def grow(leaves: DataFrame, fan: int, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of each band, roots) of the trees over leaves (_g, _rank, _hash), gapless from
    0 in each tree _g. A node: _g, _level, _lo, _hi (the leaf ranks it covers), _hash, and
    _height, _n of its tree. A parent's hash is that of its children's, left to right; a
    run of one has a parent too, up to the level where one node is left. A band is
    hashed by groups of at most BUCKET (or ``fan``) neighbours, each a level at a time."""
    size = materialize(leaves.groupBy("_g").agg(F.count("*").alias("_n")), tag)
    powers = [fan**i for i in range(1, 63) if fan**i < 1 << 62]
    size = size.withColumn("_height", F.expr(f"size(filter(array({', '.join(f'{p}L' for p in [1, *powers])}), p -> p < _n))"))
    most, step, low = size.agg(F.max("_height")).first()[0] or 0, _levels(fan), 0
    now = attach(leaves.select("_g", F.col("_rank").alias("_at"), "_hash"), materialize(size, tag), ["_g"])
    bands = []
    while True:
        each = now.groupBy("_g", "_n", "_height", F.expr(f"_at div {fan**step}").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_at", "_hash"))).alias("_l"))
        each = each.withColumn("_l0", F.expr("transform(_l, x -> x._hash)")).drop("_l")
        for i in range(step):
            each = each.withColumn(f"_l{i + 1}", F.expr(f"transform(sequence(0, (size(_l{i}) - 1) div {fan}), i -> sha2(array_join(slice(_l{i}, i * {fan} + 1, {fan}), ''), 256))"))
        made = ", ".join(f"transform(_l{i}, (x, k) -> named_struct('_level', {low + i}, '_at', _b * {fan ** (step - i)}L + k, '_hash', x))" for i in range(step + 1))
        node = each.select("_g", "_n", "_height", F.expr(f"inline(flatten(array({made})))")).where("_level <= _height")
        span = f"cast(pow({fan}, _level) as bigint)"
        node = materialize(node.selectExpr("*", f"_at * {span} as _lo", f"least(_n, (_at + 1) * {span}) - 1 as _hi"), tag)
        bands.append(node.where(F.col("_level") < low + step))
        low += step
        if low > most:
            break
        now = node.where(F.col("_level") == low).select("_g", "_n", "_height", "_at", "_hash")
    top = bands[0]
    for band in bands[1:]:
        top = top.unionByName(band)
    return bands, top.where("_level = _height").select("_g", F.col("_hash").alias("_root"))


def siblings(band: DataFrame, low: int, step: int, fan: int) -> DataFrame:
    """(_g, _at, _path) of the nodes at level ``low`` of a band: for each level up to the
    band's end or the root, what stands before and after the node's ancestor there within
    its parent (hashes one after another).

    Ancestors and siblings come from one join: nodes of a level lie in buckets by their
    parent's interval, and a node meets those whose parent's interval contains its own;
    those whose own interval does not are siblings, to the left or to the right."""
    base = band.where(F.col("_level") == low).select("_g", "_at", "_height", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
    rise = base.where(F.col("_height") > low).withColumn("_level", F.expr(f"explode(sequence({low}, least({low + step}, _height) - 1))"))
    span = f"cast(pow({fan}, _level + 1) as bigint)"
    up = rise.withColumn("_bucket", F.expr(f"_from div {span}"))
    node = band.where("_level < _height").selectExpr("_g", "_level", f"_lo div {span} as _bucket", "_lo", "_hi", "_hash", f"_lo div {span} * {span} as _plo", f"least(_n, (_lo div {span} + 1) * {span}) - 1 as _phi")
    met = up.join(node, ["_g", "_level", "_bucket"]).where("_plo <= _from and _to <= _phi")
    outside = "not (_lo <= _from and _to <= _hi)"
    path = met.groupBy("_g", "_at").agg(F.sort_array(F.collect_list(F.expr(f"case when {outside} then struct(_level, _lo, _hash, _lo < _from as _left) end"))).alias("_s"), F.max("_level").alias("_last"))
    part = "array_join(transform(filter(_s, x -> x._level = l and {}x._left), x -> x._hash), '')"
    return path.selectExpr("_g", "_at", f"transform(sequence({low}, _last), l -> named_struct('before', {part.format('')}, 'after', {part.format('not ')})) as _path")


def paths(leaves: DataFrame, fan: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """((_g, _rank, _path) of all leaves that have siblings or parents, (_g, _root)). The
    paths of a band's lowest nodes are joined to those of the band below, a row for
    BUCKET, so that what is shared by many leaves is worked out once."""
    bands, roots = grow(leaves, fan, tag)
    step = _levels(fan)
    above = None
    for i, band in reversed(list(enumerate(bands))):
        mine = siblings(band, i * step, step, fan)
        if above is not None:
            high = above.select("_g", F.col("_at").alias("_up"), F.col("_path").alias("_high"))
            mine = mine.withColumn("_up", F.expr(f"_at div {fan**step}")).join(high, ["_g", "_up"], "left")
            mine = mine.select("_g", "_at", F.expr("concat(_path, coalesce(_high, array()))").alias("_path"))
        above = materialize(mine, tag) if i else mine
    return above.withColumnRenamed("_at", "_rank"), roots


def fold(leaf: str, path: str) -> str:
    """SQL: the root that a leaf and its path lead to."""
    return f"aggregate({path}, {leaf}, (h, p) -> sha2(concat(p.before, h, p.after), 256))"


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), fan: int = 2, tampered: Column | None = None) -> DataFrame:
    """The Merkle tree of documents as a row a document: doc_id, lang, rank (of its leaf
    within its lang), leaf, subroot (of its lang), root, path (array of before, after: the
    siblings' hashes from the leaf to the root), folded_root, verified.

    Leaves of a lang ascend by doc_id, null first; rows with one doc_id by their leaf.
    ``fan`` consecutive nodes have one parent; a lone leaf is its lang's subroot, a lone
    subroot the root. Langs ascend by their bytes, null first. ``tampered`` is another leaf
    hash to be folded instead (null: the own leaf): a changed document does not verify.
    Repeated rows are leaves of their own. An empty table gives no row.

    A document's text is read once; what is shuffled are hashes of 64 characters: two a
    leaf to build, eight a leaf for the siblings below a node of BUCKET leaves, whose own
    path is one row."""
    d = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("_g"), "lang",
        leaf_hash([F.col(c) for c in fields]).alias("leaf"), (tampered if tampered is not None else F.lit(None).cast("string")).alias("_tampered"),
    )
    d = ranked(materialize(d, "leaves"), ["_g"], ["doc_id", "leaf"], "leaves")
    d = materialize(d, "leaves")
    path, subroots = paths(d.select("_g", "_rank", F.col("leaf").alias("_hash")), fan, "tree")
    subroots = materialize(subroots.withColumnRenamed("_root", "subroot"), "subroots")
    top = materialize(ranked(subroots, [], ["_g"], "top"), "top")
    high, root = paths(top.select(F.lit("").alias("_g"), "_rank", F.col("subroot").alias("_hash")), fan, "top")
    root = next(iter(root.select("_root").take(1)), [None])[0]
    langs = top.join(high.select("_rank", F.col("_path").alias("_high")), "_rank", "left").select("_g", "subroot", F.lit(root).alias("root"), "_high")
    d = attach(d.join(path, ["_g", "_rank"], "left"), materialize(langs, "langs"), ["_g"])
    d = d.withColumn("path", F.expr("concat(coalesce(_path, array()), coalesce(_high, array()))"))
    d = d.withColumn("folded_root", F.expr(fold("coalesce(_tampered, leaf)", "path")))
    return d.select("doc_id", "lang", F.col("_rank").alias("rank"), "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_interval_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, a seventh of them tampered with."""
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.expr("crc32(cast(doc_id as string)) % 7 = 0 and n_chars is not null"), leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars").cast("decimal(20,0)") + 1, F.col("text")]))
    d = manifest(docs, tampered=changed)
    proof = F.sha2(F.expr("array_join(transform(path, p -> concat(p.before, p.after)), '')"), 256)
    return d.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")
