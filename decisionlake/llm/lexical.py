"""Ranked lexical search: term-at-a-time with a limit on accumulators, rarest terms first."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from decisionlake.llm.common import materialize, small, table

#: Bytes of query terms that are searched for in one run over the documents (a task
#: holds them), entries of an index that a task works on at a time, and parts that an
#: item's results are merged in before the last merge.
BLOCK, ENTRIES, PARTS = 8 << 20, 2 << 20, 64
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms as they are, A-Z lowered, all others as blanks.
_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def query_terms(items: DataFrame) -> DataFrame:
    """items (item_id, text) as distinct (item_id, term)."""
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


def _terms_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """(terms one after another, the row of each) of a batch's texts."""
    said = pc.fill_null(batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()), "")
    begin = np.frombuffer(said.buffers()[1], np.int64)[said.offset : said.offset + len(said) + 1]
    data = said.buffers()[2].to_pybytes()[begin[0] : begin[-1]] if said.buffers()[2] else b""
    plain = pa.LargeStringArray.from_buffers(len(said), pa.py_buffer((begin - begin[0]).tobytes()), pa.py_buffer(data.translate(_BYTES)))
    cut = pc.split_pattern(plain, " ")
    flat, row = cut.flatten(), pc.list_parent_indices(cut)
    full = pc.not_equal(flat, "")
    return flat.filter(full), row.filter(full).to_numpy().astype(np.int64)


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms array, tfs array) of the documents with at least one term: n
    counts all, the arrays hold the given terms (their places in the list) alone."""
    known = pa.array(terms, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            flat, row = _terms_of(batch)
            n = np.bincount(row, minlength=batch.num_rows)
            at = pc.index_in(flat, value_set=known)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            key, tf = np.unique(row[hit] * len(terms) + at.drop_null().to_numpy(), return_counts=True)
            rows = np.flatnonzero(n)
            begin = np.append(np.searchsorted(key, rows * len(terms)), len(key)).astype(np.int32)
            arrays = (pa.ListArray.from_arrays(pa.array(begin), pa.array(x)) for x in ((key % max(1, len(terms))).astype(np.int32), tf.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(n[rows], pa.int64()), *arrays], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<long>")


def accumulate(postings: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int) -> np.ndarray:
    """Scores of n_docs documents by term-at-a-time over one item's postings (documents,
    contributions), rarest term first. ``floor`` is a score that k documents elsewhere
    reach. While a document without an accumulator could still reach the kth best partial
    score, or the floor, terms make new ones; once the bounds of the terms left together
    stay below, they only add to those that there are. Every document that belongs to the
    best k has its exact score; one without an accumulator has -1."""
    score = np.full(n_docs, -1, dtype=np.int64)
    bound = [int(c.max()) if len(c) else 0 for _, c in postings]
    left, held, creating = sum(bound), 0, True
    for (at, add), top in zip(postings, bound):
        if creating and left < floor:
            creating = False
        live = score[at] >= 0
        if creating:
            new = at[~live]
            score[new] = 0
            held += len(new)
            score[at] += add
        else:
            score[at[live]] += add[live]
        left -= top
        if creating and held >= k:
            partial = score[score >= 0]
            creating = left >= max(floor, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
    return score


def _search(batches: Iterator[pa.RecordBatch], queries: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The k best documents of each query among a task's vectors: slices of ENTRIES, each
    an index by term; the kth score so far is the next slice's floor."""
    best: list[list[tuple]] = [[] for _ in queries]

    def slices() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(), dtype=np.int64) // ENTRIES
            cut = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(step)]
            yield from (batch.slice(a, b - a) for a, b in zip(cut, cut[1:]) if b > a)

    for batch in slices():
        ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        doc = pc.list_parent_indices(batch.column(2)).to_numpy().astype(np.int64)
        term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        m = 100 - 50 + (50 * n * n_docs) // n_terms
        add = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        by = np.argsort(term, kind="stable")
        term, doc, add = term[by], doc[by], add[by]
        begin = np.searchsorted(term, np.arange(len(weight) + 1))
        for q, terms in enumerate(queries):
            lists = [(doc[begin[t] : begin[t + 1]], add[begin[t] : begin[t + 1]]) for t in terms]
            floor = best[q][-1][0] if len(best[q]) == k else 0
            score = accumulate(lists, len(ids), k, floor)
            at = np.flatnonzero((score > 0) & (score >= floor))
            if len(at) > k:
                at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
            if len(at):
                found = [(int(score[i]), ids[i]) for i in at.tolist()]
                best[q] = sorted(best[q] + found, key=lambda x: (-x[0], x[1] is not None, x[1] if x[1] is not None else 0))[:k]
    out = [(q, doc, score) for q, found in enumerate(best) for score, doc in found]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], kind), pa.array([x[2] for x in out], pa.int64())], ["_item", "doc_id", "score"])


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows a key, the highest scores first, equal ones by doc_id (null first)."""
    return rows.selectExpr("*", f"row_number() over (partition by {', '.join(by)} order by score desc, doc_id) as rank").where(F.col("rank") <= k)


def _searcher(queries: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int, kind: DataType):
    """_search() as Spark calls it, doc_id of any sortable type."""
    arrow = to_arrow_type(kind)
    return lambda batches: _search(batches, queries, weight, n_docs, n_terms, k, arrow)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k highest-scoring documents (doc_id, text) of each item (item_id, text): item_id,
    rank from 1, doc_id, score (long), by the integer weights that the module's tests spell
    out; documents with score 0 are left out, equal scores go by doc_id, null first.

    Terms are runs of digits, letters and non-ASCII characters, A-Z lowered, of whole texts.
    Rows with one item_id are one item with all their terms; null is an item_id like others; items or
    documents without a term give nothing. Repeated documents count and are ranked each.

    Items come in blocks of about BLOCK bytes of terms; a block is a run over all documents,
    whose vectors of the block's terms are written once. Their counts give the weights; then
    each task searches its own documents, rarest term first, and hands on k rows an item,
    so that nothing but the best is shuffled."""
    terms = materialize(query_terms(items), "terms")
    said = materialize(terms.groupBy("item_id").agg(F.sum(F.octet_length("term") + 8).alias("_size")), "items")
    size = said.agg(F.sum("_size")).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    kind = docs.schema["doc_id"].dataType
    out = None
    for block in range(blocks):
        mine = terms.where(part == block).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
        mine = materialize(mine.repartition(1).withColumn("_item", F.monotonically_increasing_id().cast("int")), "block")
        asked = mine.select("_item", "terms").orderBy("_item").toArrow()
        words = sorted({t for ts in asked["terms"].to_pylist() for t in ts})
        place = {t: i for i, t in enumerate(words)}
        vector = materialize(vectors(docs, words), "vectors")
        n_docs, n_terms = vector.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(words), dtype=np.int64)
        for t, c in vector.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block at most
            df[t] = c
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        queries = [np.array(sorted((place[t] for t in ts), key=lambda i: (df[i], i)), dtype=np.int64) for ts in asked["terms"].to_pylist()]
        found = vector.mapInArrow(_searcher(queries, weight, n_docs, n_terms or 1, k, kind), f"_item int, doc_id {kind.simpleString()}, score long")
        found = _best(found.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), ["_item", "_part"], k).drop("rank", "_part")
        found = _best(found, ["_item"], k).join(mine.select("_item", "item_id"), "_item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def op12_accumulator_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
