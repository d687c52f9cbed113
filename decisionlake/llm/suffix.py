"""Removal of repeated passages: Burrows-Wheeler transforms of shards, merged by
iterative interleave refinement.

Only places that can repeat are sorted. Every run of 100 bytes holds an anchor, the
least of its 32-byte strings by a hash; the runs of one anchor are a cell. Equal runs
have equal anchors at equal places, so cells whose anchor string occurs once hold
nothing that repeats, cells that are equal as a whole (by 128 bits of their bytes) repeat
as a whole, and what is left, different cells around an equal anchor, goes through the transforms. Where very many
differ around one anchor, their runs are told apart by digests, over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.llm.common import attach, materialize, release, small, table, texts

#: Bytes of a passage, of an anchor, and of a symbol of the transforms.
LENGTH, ANCHOR, SYMBOL = 100, 32, 10
#: Bytes hashed at a time; bytes of cells merged at a time (more for one large anchor).
BUFFER, BATCH = 1 << 20, 1 << 19
SHARDS = 4
#: Cells around one anchor that go through the transforms at most; runs around hotter
#: anchors held at a time.
HOT, RUNS = 4096, 1 << 17

_RANDOM = np.random.default_rng(19940510)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P, _Q = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_DONE = 1 << 62


def _power(n: int, base: int = _P) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cells(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first run, number of runs, anchor hash, two hashes of all its bytes) of each cell of
    texts joined in ``data``, of these sizes; no run crosses a text. The two hashes are
    polynomials of bases and byte values of their own, 128 bits together: cells that
    agree in both are taken as equal."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 3
    h, size = _BYTE[data], 1
    while size < ANCHOR:
        h = h[:-size] * _power(size) + h[size:]
        size *= 2
    g = h[:-size] * _power(size) + h[size:]  # of 64 bytes
    anchor = _mix(h)
    low = ((anchor >> np.uint64(24)) << np.uint64(24)) | np.arange(len(anchor), dtype=np.uint64)
    width, size = LENGTH - ANCHOR + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)[: len(at)]
    fits = np.arange(len(at)) + LENGTH <= ends
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | ~fits[:-1]
    first = np.flatnonzero(new & fits)
    runs = np.append(new[1:] | ~fits[1:], True)
    last = np.flatnonzero(runs & fits)
    h, size = _OTHER[data], 1
    while size < 64:
        h = h[:-size] * _power(size, _Q) + h[size:]
        size *= 2
    wholes = []
    for hashed, base in ((g, _P), (h, _Q)):
        whole = np.zeros(len(first), dtype=np.uint64)
        for place in (first, first + 36, last, last + 36):  # 64 bytes each: all of a cell
            whole = _mix(whole * _power(1, base) + hashed[place])
        wholes.append(_mix(whole + (last - first).astype(np.uint64) * _power(3, base) + (at[first] - first).astype(np.uint64)))
    return first, last - first + 1, anchor[at[first]], *wholes


def _pack(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (start << 7) | n


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, whole, more, doc, sub, place) of cells. Of equal cells in a buffer the first goes
    on; the others are marked as done, so that a cell that very many documents share
    comes to the shuffle once a buffer."""

    def emit(docs: list[tuple[int, int]], parts: list[bytes], starts: list[int]) -> pa.RecordBatch:
        data, sizes = np.frombuffer(b"".join(parts), dtype=np.uint8), np.array([len(p) for p in parts])
        first, n, key, whole, more = cells(data, sizes)
        of = np.searchsorted(np.cumsum(sizes), first, side="right")
        start = first - (np.cumsum(sizes) - sizes)[of] + np.array(starts, dtype=np.int64)[of]
        doc, sub = np.array(docs, dtype=np.int64)[of].T
        place = _pack(start, n)
        order = np.lexsort((place, sub, doc, more, whole))
        doc, sub, place, key, whole, more = doc[order], sub[order], place[order], key[order].copy(), whole[order], more[order]
        later = np.zeros(len(doc), dtype=bool)
        later[1:] = (whole[1:] == whole[:-1]) & (more[1:] == more[:-1])
        head = np.maximum.accumulate(np.where(later, 0, np.arange(len(doc))))
        later &= (doc != doc[head]) | (sub != sub[head]) | (place != place[head])
        key[later] = _mix(key[later] + doc[later].astype(np.uint64) * _power(2) + sub[later].astype(np.uint64) * _power(3) + place[later].astype(np.uint64))
        place = np.where(later, place | _DONE, place)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(x.view(np.int64)) for x in (key, whole, more)), pa.array(doc), pa.array(sub), pa.array(place)], ["key", "whole", "more", "doc", "sub", "place"]
        )

    release()
    for batch in small(batches):
        docs, parts, starts, held = [], [], [], 0
        for doc, sub, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch)):
            data = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(len(data) - LENGTH + 1, 0), BUFFER):
                part = data[at : at + BUFFER + LENGTH - 1]
                docs.append((doc, sub))
                parts.append(part)
                starts.append(at)
                held += len(part)
                if held >= BUFFER:
                    yield emit(docs, parts, starts)
                    docs, parts, starts, held = [], [], [], 0
        if parts:
            yield emit(docs, parts, starts)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From cells sorted by key, whole, more, doc, sub, place: equal cells but the first (all
    true), and the first of each of several different cells around one anchor. Of an
    anchor's cells before a batch only the last first one is held."""
    held = np.zeros((6, 0), dtype=np.int64)  # the first of the equal cells that a batch ends in
    alone, several = True, False  # whether it is still to be told; whether its key has another
    for batch in batches:
        if not batch.num_rows:
            continue
        begin = held.shape[1]
        rows = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(6)])], axis=1)
        key, whole, more, doc, sub, place = rows
        done = place >= _DONE
        new_key = np.ones(len(key), dtype=bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= (whole[1:] != whole[:-1]) | (more[1:] != more[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        later = (doc != doc[head]) | (sub != sub[head]) | (place != place[head])
        group = np.cumsum(new_key) - 1
        count = np.bincount(group, weights=new & ~done)
        if begin and several:
            count[0] += 1
        out = later | done | (new & (count[group] > 1))
        if begin:
            out[0] = alone and not done[0] and count[0] > 1
        at = head[-1]
        alone, several = count[-1] == 1, count[-1] > 1
        held = rows[:, at : at + 1].copy()
        every, place = later | done, place & (_DONE - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(every[out]), pa.array(key[out]), pa.array(doc[out]), pa.array(sub[out]), pa.array((place >> 7)[out]), pa.array((place & 127)[out])],
            ["all", "key", "doc", "sub", "start", "n"],
        )


def _spans(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(doc, sub, start, n) of consecutive runs (doc, sub, start)."""
    out: list[tuple[int, int, int, int]] = []
    for doc, sub, start in sorted(set(runs)):
        if out and out[-1][:2] == (doc, sub) and out[-1][2] + out[-1][3] == start:
            out[-1] = (*out[-1][:3], out[-1][3] + 1)
        else:
            out.append((doc, sub, start, 1))
    return out


class _Earliest:
    """The earliest run (doc, sub, start) of each digest, and those that are later."""

    def __init__(self) -> None:
        self.first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        self.later: list[tuple[int, int, int]] = []

    def add(self, digest: tuple[int, bytes], run: tuple[int, int, int]) -> None:
        before = self.first.setdefault(digest, run)
        if before != run:
            self.later.append(max(before, run))
            self.first[digest] = min(before, run)


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the cells that a document lists. Cells around a hot anchor become a
    row a run (n = 0), keyed by a 128-bit BLAKE2b digest of its bytes; of equal runs in a
    buffer the first goes on, the others are told as spans (n = -runs) under keys of
    their own, so that a very common run comes to the shuffle once a buffer."""
    unpack = zstandard.ZstdDecompressor()
    told: set[tuple[int, int]] = set()  # a row that is repeated lists its cells once

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["key", "doc", "sub", "start", "n", "bytes"])

    def runs_of(hot: _Earliest) -> pa.RecordBatch:
        rows = [(key, *run, 0, rest) for (key, rest), run in hot.first.items()]
        return emit(rows + [(hash(span), *span[:3], -span[3], b"") for span in _spans(hot.later)])

    hot = _Earliest()
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for doc, sub, packed, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (doc, sub) in told:
                continue
            told.add((doc, sub))
            data = unpack.decompress(packed)
            for c in wanted:
                start, n = c["start"], c["n"]
                if not c["hot"]:
                    rows.append((c["key"], doc, sub, start, n, data[start : start + n + LENGTH - 1]))
                    held += n + LENGTH
                    continue
                for at in range(start, start + n):
                    digest = hashlib.blake2b(data[at : at + LENGTH], digest_size=16).digest()
                    hot.add((int.from_bytes(digest[:8], "little", signed=True), digest[8:]), (doc, sub, at))
                if len(hot.first) + len(hot.later) >= RUNS:
                    yield runs_of(hot)
                    hot = _Earliest()
            if held >= 16 * BATCH:
                yield emit(rows)
                rows, held = [], 0
        yield emit(rows)
    yield runs_of(hot)


def _sorted_key(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of pairs of ranks, and the order of the pairs."""
    pair = major * np.int64(1 << 31) + minor
    order = np.argsort(pair, kind="stable")
    ranked = pair[order]
    new = np.zeros(len(pair), dtype=np.int64)
    new[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty_like(new)
    rank[order] = np.cumsum(new)
    return rank, order


class Shard:
    """Burrows-Wheeler transform of a collection of cells over symbols of SYMBOL bytes.

    A node is a place in a cell, 0 to its length; one with SYMBOL bytes ahead begins
    with a symbol and is followed by the node SYMBOL bytes on; the others are terminals,
    which all differ. ``order`` lists the nodes sorted by what follows, terminals first;
    ``before`` the symbol that precedes each node in that order, -1 where there is none.
    """

    def __init__(self, symbol: np.ndarray, sizes: np.ndarray, begin: int) -> None:
        # symbol: by node, -1 for terminals; begin: number of the first node overall
        nodes = len(symbol)
        place = np.arange(nodes) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        terminal = symbol < 0
        self.terminals = int(terminal.sum())
        rank = np.empty(nodes, dtype=np.int64)
        rank[terminal] = np.arange(self.terminals)
        rank[~terminal] = self.terminals + symbol[~terminal]

        def then(rank: np.ndarray, other: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
            after = np.zeros(nodes, dtype=np.int64)
            far = np.arange(nodes) + gap
            inside = (far < nodes) & ~terminal
            inside[inside] &= place[far[inside]] > place[inside]
            after[inside] = other[far[inside]] + 1
            return _sorted_key(rank, after)

        one, _ = _sorted_key(rank, np.zeros(nodes, dtype=np.int64))
        two, _ = then(one, one, SYMBOL)
        four, _ = then(two, two, 2 * SYMBOL)
        eight, _ = then(four, four, 4 * SYMBOL)
        _, self.order = then(eight, two, 8 * SYMBOL)
        inside = place[self.order] >= SYMBOL
        self.before = np.where(inside, symbol[np.maximum(self.order - SYMBOL, 0)], -1)
        self.order = self.order + begin


def merge(shards: list[Shard], rounds: int = LENGTH // SYMBOL) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms by iterative interleave refinement (Holt and McMillan).

    The interleave says for each place of the merged order which shard its node is
    from; the nodes of a shard keep their order. After round k the interleave is right
    for the first k symbols: the merged preceding symbols are sorted stably, and each
    entry carries its shard along. Places that agree in k symbols are a block; the
    common prefix of two neighbours ends where they fall into different blocks.
    Returns the nodes in merged order and the block of each after the last round.
    """
    ends = [len(s.order) for s in shards]
    terminals = np.repeat(np.arange(len(shards)), [s.terminals for s in shards])
    z = np.concatenate([terminals, np.repeat(np.arange(len(shards)), [n - s.terminals for n, s in zip(ends, shards)])]).astype(np.uint8)
    block = np.zeros(len(z), dtype=np.int64)  # all agree in no symbol
    before = np.concatenate([s.before for s in shards])
    count = len(terminals)
    merged = np.empty(len(z), dtype=np.int64)
    for _ in range(rounds):
        merged[np.argsort(z, kind="stable")] = before
        live = np.flatnonzero(merged >= 0)
        key = np.sort((merged[live] << 32) | live)  # stable: the place breaks ties
        came, symbol = key & 0xFFFFFFFF, key >> 32
        z = np.concatenate([terminals.astype(np.uint8), z[came]])
        new = np.ones(len(came), dtype=bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (block[came[1:]] != block[came[:-1]])
        block = np.concatenate([np.arange(count), count - 1 + np.cumsum(new)])
    nodes = np.empty(len(z), dtype=np.int64)
    nodes[np.argsort(z, kind="stable")] = np.concatenate([s.order for s in shards])
    return nodes, block


def repeated(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, n: np.ndarray, data: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(doc, sub, from, to) of runs of LENGTH bytes in cells that also start earlier in another."""
    order = np.lexsort((start, sub, doc))
    order = order[np.append(True, (np.diff(doc[order]) != 0) | (np.diff(sub[order]) != 0) | (np.diff(start[order]) != 0))]  # repeated rows
    deal = np.concatenate([order[k::SHARDS] for k in range(SHARDS)])
    rank = np.concatenate([np.arange(len(order))[k::SHARDS] for k in range(SHARDS)])
    size = np.array([len(data[k]) for k in deal])
    joined = b"".join([data[k] + b"\0" for k in deal]) + bytes(SYMBOL)
    flat = np.frombuffer(joined, dtype=np.uint8)
    nodes = size + 1
    total = int(nodes.sum())
    place = np.arange(total) - np.repeat(np.cumsum(nodes) - nodes, nodes)
    alive = place + SYMBOL <= np.repeat(size, nodes)
    word = np.zeros(total, dtype=np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | flat[k : k + total]
    tail = (flat[8 : 8 + total].astype(np.int64) << 8) | flat[9 : 9 + total]
    symbol = np.full(total, -1, dtype=np.int64)
    eight = np.unique(word[alive], return_inverse=True)[1]
    symbol[alive] = np.unique(eight * 65536 + tail[alive], return_inverse=True)[1]
    shards, at, first = [], 0, 0
    for k in range(SHARDS):
        m = len(order[k::SHARDS])
        span = int(nodes[at : at + m].sum())
        if m:
            shards.append(Shard(symbol[first : first + span], nodes[at : at + m], first))
        at, first = at + m, first + span
    merged, block = merge(shards)
    cell = np.repeat(np.arange(len(deal)), nodes)
    ok = place[merged] < n[deal][cell[merged]]  # a whole run lies ahead
    merged, block = merged[ok], block[ok]
    if not len(merged):
        return []
    early = (rank[cell[merged]] << 7) | place[merged]
    head = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    least = np.repeat(np.minimum.reduceat(early, head), np.diff(np.append(head, len(block))))
    again = np.sort(early[early > least])
    if not len(again):
        return []
    cut = np.flatnonzero(np.append(True, np.diff(again) != 1))
    last = np.append(cut[1:], len(again)) - 1
    which = order[again[cut] >> 7]
    begin, end = start[which] + (again[cut] & 127), start[which] + (again[last] & 127) + LENGTH
    return list(zip(doc[which].tolist(), sub[which].tolist(), begin.tolist(), end.tolist()))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs of cells sorted by key; a batch holds whole keys."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        n = rows.column("n").to_numpy()
        some = rows.filter(pa.array(n > 0))
        got = repeated(*(some.column(c).to_numpy() for c in ("doc", "sub", "start", "n")), some.column("bytes").to_pylist()) if len(some) else []
        some, hot = rows.filter(pa.array(n == 0)), _Earliest()
        for key, doc, sub, start, rest in zip(*(some.column(c).to_pylist() for c in ("key", "doc", "sub", "start", "bytes"))):
            hot.add((key, rest), (doc, sub, start))
        some = rows.filter(pa.array(n < 0))
        spans = _spans(hot.later) + [(doc, sub, start, -m) for doc, sub, start, m in zip(*(some.column(c).to_pylist() for c in ("doc", "sub", "start", "n")))]
        got += [(doc, sub, start, start + m + LENGTH - 1) for doc, sub, start, m in spans]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*got) if got else [()] * 4)], ["doc", "sub", "from", "to"])

    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        key = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
        width = np.append(0, np.cumsum(np.maximum(batch.column("n").to_numpy(), 0) + LENGTH))
        begin = 0
        for a in cut[:-1]:
            if size + width[a] - width[begin] >= BATCH and key[a] != (key[a - 1] if a else last):
                held.append(batch.slice(begin, a - begin))
                yield work(held)
                held, size, begin = [], 0, a
        if len(key):
            held.append(batch.slice(begin))
            size += int(width[-1] - width[begin])
            last = key[-1]
    if held:
        yield work(held)


def _key(docs: DataFrame) -> list:
    """(doc, sub), by which rows are told apart and ordered: doc_id, nulls first, and
    among rows of one doc_id a hash of the text."""
    return [
        F.coalesce(docs["doc_id"], F.lit(-(2**63))).cast("long").alias("doc"),
        F.xxhash64(docs["doc_id"].isNull(), F.coalesce(docs["text"], F.lit(""))).alias("sub"),
    ]


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, sub, packed): texts compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in small(batches):
            data = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(data, pa.binary())], ["doc_id", "doc", "sub", "packed"])

    return docs.select(docs["doc_id"].cast("long"), *_key(docs), "text").mapInArrow(run, "doc_id long, doc long, sub long, packed binary")


def _around(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The cells to compare with their bytes, and the runs around hot anchors."""
    several = found.where("not `all`")
    hot = materialize(several.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select("key", F.lit(True).alias("hot")), "hot")
    cell = F.struct("key", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = attach(several, hot, ["key"], "left").groupBy("doc", "sub").agg(F.collect_list(cell).alias("wanted"))
    around = _packed(docs).join(wanted, ["doc", "sub"]).select("doc", "sub", "packed", "wanted")
    return around.mapInArrow(_bytes_of, "key long, doc long, sub long, start long, n long, bytes binary")


def _found(docs: DataFrame) -> DataFrame:
    """Cells that repeat as a whole (all), or whose anchor has different cells."""
    cell = docs.select(*_key(docs), "text").mapInArrow(_cells, "key long, whole long, more long, doc long, sub long, place long")
    cell = cell.repartition("key").sortWithinPartitions("key", "whole", "more", "doc", "sub", "place")
    return materialize(cell.mapInArrow(_shared, "all boolean, key long, doc long, sub long, start long, n long"), "cells")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc, sub, passages: array of from, to) of the documents that repeat one: byte ranges
    covered by strings of LENGTH bytes that also start earlier. They may overlap."""
    found = _found(docs)
    around = _around(docs, found).repartition("key").sortWithinPartitions("key")
    part = around.mapInArrow(_merged, "doc long, sub long, from long, to long")
    whole = found.where("`all`").select("doc", "sub", F.col("start").alias("from"), (F.col("start") + F.col("n") + (LENGTH - 1)).alias("to"))
    both = part.unionByName(whole)
    return materialize(both.groupBy("doc", "sub").agg(F.collect_list(F.struct("from", "to")).alias("passages")), "passages")


def cut(data: bytes, passages: list[dict] | None) -> tuple[bytes, int]:
    """data without the passages, and how many maximal runs were removed."""
    out, at, spans, end = [], 0, 0, -1
    for p in sorted((p["from"], p["to"]) for p in passages or ()):
        if p[0] > end:
            spans += 1
        if p[0] > at:
            out.append(data[at : p[0]])
        at = max(at, p[1])
        end = max(end, p[1])
    out.append(data[at:])
    return b"".join(out), spans


def dedup(docs: DataFrame) -> DataFrame:
    """Repeated passages of (doc_id, text), removed: doc_id, n_bytes, n_removed,
    n_spans, kept_sha256.

    Texts are UTF-8 bytes, null texts empty; a passage never crosses documents. Earlier
    is a smaller doc_id (null first), the same and a smaller hash of the text, or the
    same and an earlier start. Rows of one doc_id, or without one, are documents of
    their own where their texts differ; those that agree in both are one document told
    twice: they take nothing from each other, and each gives a row. An empty table
    gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, passages in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
                data = unpack.decompress(packed)
                kept, spans = cut(data, passages)
                rows.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()]))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    joined = _packed(docs).join(repeated_passages(docs), ["doc", "sub"], "left").select("doc_id", "packed", "passages")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_documents(docs: DataFrame) -> DataFrame:
    """The documents, in their own columns, with repeated passages cut from their
    texts; n_chars follows where there is such a column. A character that a passage's
    end splits goes with it. Null texts stay null."""
    passages = repeated_passages(docs).toDF("_doc", "_sub", "_passages")
    names = docs.columns
    doc, sub = _key(docs)
    joined = docs.join(passages, (doc == F.col("_doc")) & (sub == F.col("_sub")), "left").select(*(docs[c] for c in names), "_passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            said = batch.column(names.index("text")).to_pylist()
            for k, passages in enumerate(batch.column(len(names)).to_pylist()):
                if passages and said[k]:
                    said[k] = cut(said[k].encode("utf-8", "surrogatepass"), passages)[0].decode("utf-8", "ignore")
            cols = [batch.column(i) for i in range(len(names))]
            cols[names.index("text")] = pa.array(said, cols[names.index("text")].type)
            if "n_chars" in names:
                old = cols[names.index("n_chars")]
                cols[names.index("n_chars")] = pa.array([len(t) if t is not None else o for t, o in zip(said, old.to_pylist())]).cast(old.type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, docs.schema)


def op10_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return dedup(table(spark, sf_dir, "documents"))
