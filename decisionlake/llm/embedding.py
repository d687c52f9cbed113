"""Embedding near-duplicates by spherical-cap filters from structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.llm.common import components, in_units, materialize, roots, runs, table

#: Cosine of a link; code words of each half; how many standard deviations of a random
#: direction a filter lies from a vector at least; filters of a table a vector has at
#: least; tables, each with a rotation and codes of its own.
COSINE, WORDS, CAP, LEAST, TABLES = 0.93, 256, 3.2, 32, 2
#: Shorter vectors are filled with zeros to this length, which keeps their cosines: in
#: few dimensions the filters nearest to a vector are so near that no other shares them.
SHORTEST = 64
#: Vectors of a unit of comparison.
CHUNK = 1024


class Filters:
    """Filter directions (u, w) / sqrt 2 of one dimension: all words^2 products of two
    random codes, over the halves of a randomly rotated vector, in each of the tables."""

    def __init__(self, dim: int, words: int = WORDS, cap: float = CAP, least: int = LEAST, tables: int = TABLES, seed: int = 7) -> None:
        random = np.random.default_rng([seed, dim])
        size = max(dim + dim % 2, SHORTEST)
        self.dim, self.words, self.least = dim, words, least
        self.tables = []
        for _ in range(tables):
            turn = np.linalg.qr(random.standard_normal((size, size)))[0][:dim]
            code = random.standard_normal((2, words, size // 2))
            self.tables.append((turn, code / np.linalg.norm(code, axis=2, keepdims=True)))
        self.bar = cap * np.sqrt(2.0 / size)  # on the sum of both halves' products

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """The filters a unit vector exceeds, at least ``least`` a table, in order of number."""
        lists = [self._decode(unit @ turn, code) for turn, code in self.tables]
        return np.concatenate([x + k * self.words**2 for k, x in enumerate(lists)]).astype(np.int32)

    def _decode(self, turned: np.ndarray, code: np.ndarray) -> np.ndarray:
        """List decoding of one table: both halves' products sorted; for each word of the
        first half, the words of the second that lift the sum over the bar are a prefix."""
        half = code.shape[2]
        a, b = code[0] @ turned[:half], code[1] @ turned[half:]
        order = np.argsort(-b, kind="stable")
        falling = -b[order]
        n = np.searchsorted(falling, a - self.bar, side="right")
        if n.sum() < self.least:
            best = np.add.outer(a, b).ravel()
            return np.sort(np.argpartition(-best, self.least)[: self.least])
        first = np.repeat(np.arange(self.words), n)
        second = order[np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)]
        return np.sort(first * self.words + second)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors. They are scaled by a power of two first, which changes no
    digit, so that squares of very large or small components stay within range."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(classes: DataFrame) -> DataFrame:
    """A row for each vector and filter of it, with what a comparison needs; vectors as
    they came, which for single precision are half the bytes of their unit vectors."""
    kind = _kind(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Filters] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rep, group, n = (part.column(i).to_numpy() for i in range(3))
                raw = [np.asarray(v, dtype=kind) for v in part.column(4).to_pylist()]
                vectors = [_units(v[None])[0] for v in raw]
                for dim in {len(v) for v in vectors} - made.keys():
                    made[dim] = Filters(dim)
                lists = [made[len(v)].decode(v) for v in vectors]
                size = np.array([len(x) for x in lists])
                cols = [np.repeat(rep, size), np.repeat(group, size), np.repeat([len(v) for v in vectors], size), np.concatenate([*lists, np.zeros(0, np.int32)])]
                names = ["rep", "group", "dim", "filter"]
                cols = [pa.array(c, pa.int64()) for c in cols]
                who = pa.array(np.repeat(np.arange(len(lists)), size))
                cols += [
                    pa.array(np.repeat(n, size), pa.int64()), part.column(3).take(who),
                    pa.array([v.tobytes() for v in raw], pa.binary()).take(who), pa.array([x.tobytes() for x in lists], pa.binary()).take(who),
                ]
                yield pa.RecordBatch.from_arrays(cols, [*names, "n", "label", "vector", "filters"])

    schema = "rep long, group long, dim long, filter long, n long, label string, vector binary, filters binary"
    label = F.col("label").cast("string")
    return classes.select("rep", F.xxhash64(label), "n", label, "embedding").mapInArrow(run, schema)


def _kind(classes: DataFrame) -> str:
    return "<f4" if classes.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def _compare(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Links of each unit: for each vector the weight of those linked with it, and
    edges that keep the unit's components together. A pair counts in the first filter
    that its vectors share, so once in all."""
    out: list[tuple] = []
    for unit in runs(batches, ["group", "dim", "filter", "_i", "_j"]):
        if unit.num_rows < 2:
            continue
        rep, n, at = (unit.column(c).to_numpy() for c in ("rep", "n", "_at"))
        x = np.frombuffer(b"".join(unit.column("vector").to_pylist()), dtype=kind).reshape(len(rep), -1)
        x = _units(x)
        label = pa.chunked_array(unit.column("label")).combine_chunks().dictionary_encode().indices.to_numpy()
        i, j = unit.column("_i")[0].as_py(), unit.column("_j")[0].as_py()
        left, right = (np.arange(len(rep)), np.arange(len(rep))) if i == j else (np.flatnonzero(at == i), np.flatnonzero(at == j))
        near = x[left] @ x[right].T >= COSINE
        near &= label[left][:, None] == label[right][None, :]  # labels of one hash
        if i == j:
            near &= rep[left][:, None] < rep[right][None, :]
        if not near.any():
            continue
        filters = [np.frombuffer(f, dtype=np.int32) for f in unit.column("filters").to_pylist()]
        this = unit.column("filter")[0].as_py()
        busy = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        left, right, near = left[busy[0]], right[busy[1]], near[np.ix_(*busy)]
        before = [f[f < this] for f in filters]
        flat = np.concatenate([before[k] for k in (*left, *right)])
        if len(flat):
            names, code = np.unique(flat, return_inverse=True)
            has = np.zeros((len(left) + len(right), len(names)), dtype=np.float32)
            has[np.repeat(np.arange(len(has)), [len(before[k]) for k in (*left, *right)]), code] = 1
            near &= has[: len(left)] @ has[len(left) :].T < 0.5
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        weight = np.bincount(a, weights=n[b], minlength=len(rep)) + np.bincount(b, weights=n[a], minlength=len(rep))
        root = roots(len(rep), a, b)
        for k in np.flatnonzero(weight):
            out.append((int(rep[k]), int(rep[root[k]]) if root[k] != k else None, int(weight[k])))
        if len(out) > 10_000:
            yield _links(out)
            out = []
    if out:
        yield _links(out)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b", "w"])


def near_duplicates(rows: DataFrame) -> DataFrame:
    """Links of (vec_id, embedding, label) and what they join.

    Two vectors link when their labels are equal and not null and their cosine, in
    double precision, is COSINE or more. Null, empty and zero vectors and those with a
    null or non-finite component link with nothing, nor do vectors of different
    lengths. Pairs are found by filters they share. On random pairs of cosine exactly
    COSINE one table shared none in 13 of 48,000 (64 dimensions; 6 of 48,000 in 384);
    TABLES independent ones miss by the product, about 7e-8. None found is below COSINE. Equal vectors of a label are one
    class, compared once and counted by its size. Labels may be of any type; they are
    compared as strings. LEAST only adds filters where few are exceeded. Repeated rows count as other
    vectors; rows of one vec_id are one node. n_links, component_id (smallest vec_id
    reached), kept. An empty table gives none.
    """
    fine = F.expr(
        "label is not null and coalesce(size(embedding), 0) > 0 and vec_id is not null"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    )
    d = rows.select("vec_id", "embedding", "label", F.coalesce(fine, F.lit(False)).alias("fine"))
    d = d.withColumns({"h": F.xxhash64("embedding"), "g": F.xxhash64(F.lit(1), "embedding")})
    classes = materialize(
        d.where("fine").groupBy("label", "h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")),
        "vectors",
    )
    members = d.where("fine").select("vec_id", "label", "h", "g").join(classes.select("label", "h", "g", "rep", "n"), ["label", "h", "g"]).select("vec_id", "rep", "n")
    members = members.unionByName(d.where("not fine").select("vec_id", F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("n")))
    keys, kind = ["group", "dim", "filter"], _kind(classes)
    units = in_units(_decoded(classes), keys, "rep", CHUNK, "filters")
    found = materialize(units.mapInArrow(lambda batches: _compare(batches, kind), "a long, b long, w long"), "links")
    joined = components(found.select("a", "b"), "vectors-cc")
    weight = found.groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    nodes = weight.join(joined.withColumnRenamed("node", "rep"), "rep", "full")
    out = members.join(materialize(nodes, "nodes"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select(
        "vec_id", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
