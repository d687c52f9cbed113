"""N-gram Jaccard join: MinHash compared step by step, pairs dropped once it is
improbable that they reach the threshold, the rest verified exactly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.llm.common import components, in_units, likely, materialize, release, roots, runs, small, table, texts
from decisionlake.llm.segments import gather

#: Words of a shingle; similarity as a fraction; bands and MinHash values of a band; MinHash
#: values compared at a time; the posterior probability below which a pair is dropped.
WORDS, OVER, UNDER = 5, 4, 5
BANDS, ROWS, STEP, TOLERANCE = 40, 5, 20, 1e-6
#: Documents of a unit of comparison.
CHUNK = 4096

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RANDOM.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_M = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of WORDS words (ASCII white space
    separates words); a shorter text with a word is one shingle, others have none."""
    data = np.frombuffer(b" ".join(text.encode("utf-8", "surrogatepass").split()), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    space = data == 32
    starts = np.concatenate([[0], np.flatnonzero(space) + 1])
    place = np.arange(len(data)) - np.repeat(starts, np.diff([*starts, len(data)]))
    powers = np.ones(int(place.max()) + 1, dtype=np.uint64)
    powers[1:] = np.uint64(_M)
    value = _BYTE[data] * np.multiply.accumulate(powers)[place]
    value[space] = 0
    word = _mix(np.add.reduceat(value, starts))
    n = len(word)
    if n < WORDS:
        out = np.array([n], dtype=np.uint64)
        for j in range(n):
            out = out * np.uint64(_M) + word[j : j + 1]
        return _mix(out)
    out = np.zeros(n - WORDS + 1, dtype=np.uint64)
    for j in range(WORDS):
        out = out * np.uint64(_M) + word[j : j + len(out)]
    return np.unique(_mix(out))


def signature(sh: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set of shingles."""
    best = np.full(len(_A), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(sh), 1024):
        part = (_A[:, None] * sh[None, at : at + 1024] + _B[:, None]) >> np.uint64(32)
        np.minimum(best, part.min(axis=1).astype(np.uint32), out=best)
    return best


def bands(sig: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = _mix(out * np.uint64(_M) + sig.reshape(BANDS, ROWS)[:, r])
    return out


def needed(values: int) -> list[tuple[int, int]]:
    """(MinHash values compared, fewest matches that keep a pair): with a uniform prior
    the similarity after m of k matches follows Beta(m + 1, k - m + 1), which is over t
    with the probability that of k + 1 draws at t at most m succeed."""
    t, out = OVER / UNDER, []
    for k in range(STEP, values + 1, STEP):
        total, m = 0.0, -1
        while total < TOLERANCE:
            m += 1
            total += math.comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        out.append((k, m))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in small(batches):
        rows = []
        for text in texts(batch):
            sh = shingles(text)
            digest = hashlib.md5(sh.tobytes()).digest()
            h, g = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
            rows.append((len(sh), h, g, bands(signature(sh)).astype(np.int64) if len(sh) else np.zeros(0, np.int64)))
        n, h, g, b = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(b, pa.list_(pa.int64()))],
            ["doc_id", "said", "size", "h", "g", "bands"],
        )


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    told: set[int] = set()  # of rows that are equal the first of a task goes on
    for batch in small(batches):
        new = []
        for k, rep in enumerate(batch.column(0).to_pylist()):
            if rep not in told:
                told.add(rep)
                new.append(k)
        if not new:
            continue
        batch = batch.take(pa.array(new))
        sets = [shingles(t) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["rep", "component", "n", "signature", "shingles"],
        )


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their component's pivot (signature and set) to rows told apart from it:
    the set's symmetric difference with the pivot's and the exclusive or of the
    signatures. Two rows differ in as many elements as their differences do, and agree
    in a MinHash value where these agree; near copies of the pivot are told in few bytes."""
    for batch in batches:
        size, signature, apart = [], [], []
        for sig, own, pivot_sig, pivot in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6))):
            size.append(len(own) // 8)
            signature.append((np.frombuffer(sig, dtype=np.uint32) ^ np.frombuffer(pivot_sig, dtype=np.uint32)).tobytes())
            apart.append(np.setxor1d(np.frombuffer(own, dtype=np.uint64), np.frombuffer(pivot, dtype=np.uint64), assume_unique=True).tobytes())
        cols = [*(batch.column(i) for i in range(3)), pa.array(size, pa.int64()), pa.array(signature, pa.binary()), pa.array(apart, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["rep", "component", "n", "size", "signature", "apart"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each unit: for each class the weight of the classes linked with it, and
    edges that keep the unit's components together."""
    steps = needed(BANDS * ROWS)
    out: list[tuple] = []
    for unit in runs(batches, ["component", "_i", "_j"]):
        rep = unit.column("rep").to_numpy()
        rep, only = np.unique(rep, return_index=True)  # a repeated row is one document
        if len(rep) < 2:
            continue
        unit = unit.take(pa.array(only))
        weight_of, at, size = (unit.column(c).to_numpy() for c in ("n", "_at", "size"))
        sig = np.frombuffer(b"".join(unit.column("signature").to_pylist()), dtype=np.uint32).reshape(len(rep), -1)
        apart = [np.frombuffer(s, dtype=np.uint64) for s in unit.column("apart").to_pylist()]
        far = np.array([len(s) for s in apart])
        begin = np.cumsum(far) - far
        names, code = np.unique(np.concatenate(apart), return_inverse=True)
        code = code.astype(np.int32)
        mark = np.zeros(len(names) + 1, dtype=bool)
        i, j = unit.column("_i")[0].as_py(), unit.column("_j")[0].as_py()
        weight, pairs = np.zeros(len(rep), dtype=np.int64), []
        order = np.argsort(size, kind="stable")  # so that the sizes in reach are a slice
        other = order if i == j else order[at[order] == j]
        sizes = size[other]
        for k, x in enumerate(order):
            if i == j:
                low, high = k + 1, np.searchsorted(sizes, UNDER * size[x] // OVER, side="right")
            elif at[x] == i:
                low, high = np.searchsorted(sizes, [-(-OVER * size[x] // UNDER), UNDER * size[x] // OVER + 1])
            else:
                continue
            near = other[low:high]  # no other sizes can reach the threshold
            match = np.zeros(len(near), dtype=np.int64)
            for k, least in steps:
                if not len(near):
                    break
                match += (sig[near, k - STEP : k] == sig[x, k - STEP : k]).sum(axis=1)
                near, match = near[match >= least], match[match >= least]
            if not len(near):
                continue
            own = code[begin[x] : begin[x] + far[x]]
            mark[own] = True
            told = np.append(0, np.cumsum(mark[gather(code, begin, far, near)]))
            mark[own] = False
            end = np.cumsum(far[near])
            differ = far[x] + far[near] - 2 * (told[end] - told[end - far[near]])
            both = size[near] + size[x]
            near = near[(OVER + UNDER) * (both - differ) >= 2 * OVER * both]
            weight[x] += weight_of[near].sum()
            weight[near] += weight_of[x]
            if len(near):
                pairs.append((x, near))
        if not pairs:
            continue
        root = roots(len(rep), np.concatenate([np.full(len(y), x) for x, y in pairs]), np.concatenate([y for _, y in pairs]))
        out += [(int(rep[k]), int(rep[root[k]]) if root[k] != k else None, int(weight[k])) for k in np.flatnonzero(weight)]
        if len(out) > 10_000:
            yield _links(out)
            out = []
    if out:
        yield _links(out)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b", "w"])


def _verdicts(docs: DataFrame) -> DataFrame:
    """As near_duplicates() says, with ``said``, the hash of the row's text."""
    signed = docs.select("doc_id", F.xxhash64("text").alias("said"), "text")
    signed = signed.mapInArrow(_sign, "doc_id long, said long, size long, h long, g long, bands array<long>")
    signed = materialize(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    some = signed.where("size > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "said")).alias("first")
    classes = some.groupBy("h", "g").agg(first, F.count("*").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    band = classes.select("rep", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("rep").alias("b"), F.count("*").alias("k")).where("k > 1").select("band", "b")
    together = components(band.join(shared, "band").where("rep <> b").select(F.col("rep").alias("a"), "b"), "bands-cc")
    candidates = together.join(classes.select(F.col("rep").alias("node"), "n", F.col("first.doc_id").alias("_id"), F.col("first.said").alias("_said")), "node")
    candidates = materialize(candidates, "candidates")
    sets = materialize(
        likely(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("said"), "text"), F.xxhash64("doc_id", "said"), candidates, F.xxhash64("_id", "_said"))
        .where("_likely")
        .join(candidates, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("said") == F.col("_said")))
        .select(F.col("node").alias("rep"), "component", "n", "text")
        .mapInArrow(_shingled, "rep long, component long, n long, signature binary, shingles binary"),
        "sets",
    )
    pivot = sets.where("rep = component").select("component", F.col("signature").alias("_sig"), F.col("shingles").alias("_set")).dropDuplicates(["component"])
    pivot = materialize(pivot, "pivots")  # so that the join below is one that Spark can split where a component is hot
    apart = sets.join(pivot, "component").select("rep", "component", "n", "signature", "shingles", "_sig", "_set")
    apart = materialize(apart.mapInArrow(_apart, "rep long, component long, n long, size long, signature binary, apart binary"), "apart")
    found = materialize(in_units(apart, ["component"], "rep", CHUNK, "units").mapInArrow(_compare, "a long, b long, w long"), "links")
    weight = found.groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    joined = materialize(components(found.select("a", "b"), "links-cc"), "linked")
    least = joined.join(classes.select(F.col("rep").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    joined = joined.join(least, "component").select(F.col("node").alias("rep"), "least")
    nodes = materialize(weight.join(joined, "rep", "full"), "nodes")
    of = classes.select("h", "g", "rep", "n", "first").join(nodes, "rep", "left").select("h", "g", "n", "w", F.coalesce("least", "first").alias("least"))
    member = some.select("doc_id", "said", "row", "h", "g").join(of, ["h", "g"]).select(
        "doc_id", "said", F.col("least.doc_id").alias("class_id"), (F.col("n") - 1 + F.coalesce("w", F.lit(0))).cast("long").alias("n_links"),
        (F.col("row") == F.col("least.row")).alias("kept"),
    )
    alone = signed.where("size = 0").select("doc_id", "said", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return member.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Links of (doc_id, text): documents whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more.

    Documents with equal sets are one class; classes that share a band of MinHash
    values are candidates, and so are all classes these connect. Within such a
    component two classes are compared a few MinHash values at a time, dropped when the
    posterior probability of 0.8 falls below TOLERANCE, and else verified on their whole
    sets, which are told by their difference from one of the component. A large component
    is compared in units of two chunks; no pair becomes a row.
    A link is lost with a probability of about 1e-6. Null texts and texts without a
    word link with nothing; shorter texts than five words link when their words are
    equal. Rows without a doc_id and rows that repeat one are documents of their own,
    compared like others. One row a row: doc_id, class_id (smallest doc_id of the
    component, null where none has one), n_links (documents linked directly), kept (one
    row a component, of the doc_id that is class_id). An empty table gives none.
    """
    return _verdicts(docs).select("doc_id", "class_id", "n_links", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, in their own columns, but for all of a component but one row, of
    its smallest doc_id. Rows that agree in doc_id and text are told apart by no name:
    where one of several stays, it is the least by a hash of all columns."""
    keys = _verdicts(docs).groupBy("doc_id", "said").agg(F.count("*").alias("_n"), F.sum(F.col("kept").cast("long")).alias("_k"))
    keys = materialize(keys.where("_k < _n").select(F.col("doc_id").alias("_id"), F.col("said").alias("_said"), (F.col("_k") > 0).alias("_one")), "gone")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_r"), docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(docs["text"]).alias("_text"))
    rows = likely(rows, F.xxhash64("_doc", "_text"), keys, F.xxhash64("_id", "_said"))
    stay = rows.where("not _likely").select("_r.*")
    rows = rows.where("_likely")
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_said"))
    other = rows.join(keys, same, "left_anti").select("_r.*")
    one = rows.join(keys.where("_one"), same).withColumn("_h", F.xxhash64("_r"))
    one = one.groupBy("_id", "_said").agg(F.min_by("_r", "_h").alias("_r")).select("_r.*")
    return stay.unionByName(other).unionByName(one)


def op3_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
