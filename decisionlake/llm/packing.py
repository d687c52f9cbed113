"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from decisionlake.llm.common import release, small, table
from decisionlake.llm.segments import assemble

#: Tokens of a window, the id that closes a document, the longest piece that enters
#: the differencing, and how many pieces are differenced together.
WINDOW, CLOSING, PIECE, BLOCK = 2048, 1, 512, 2048
#: Bytes of text whose words are told apart together: the more, the fewer are encoded twice.
_BYTES = 12 << 20


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window 0..k-1 of each size by multiway differencing.

    Each size starts as a partial partition of k windows, one of them filled. The two
    partitions of widest spread merge, fullest window onto emptiest, until one is
    left. Only the windows in use are kept; the rest of a partition is empty.
    """
    n = len(sizes)
    # a window of a partition is a node: a size, or two nodes put together; -1 is empty
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    nodes = n
    heap = [(-int(s), i, np.array([s], dtype=np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)  # sums fall from left to right
        _, _, b, y = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            sums, sets = np.concatenate([a, b]), np.concatenate([x, y])
        else:
            sums, sets, other = np.zeros(k, dtype=np.int64), np.full(k, -1), np.full(k, -1)
            sums[: len(a)], sets[: len(a)] = a, x
            sums[k - len(b) :] += b[::-1]
            other[k - len(b) :] = y[::-1]
            both = np.flatnonzero((sets >= 0) & (other >= 0))
            left.append(sets[both])
            right.append(other[both])
            sets = np.maximum(sets, other)
            sets[both] = np.arange(nodes, nodes + len(both))
            nodes += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, sets = sums[order], sets[order]
        low = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (low - int(sums[0]), tick, sums, sets))
        tick += 1
    out = np.full(nodes, -1, dtype=np.int64)
    if heap:
        out[heap[0][3]] = np.arange(len(heap[0][3]))
    if left:
        for node, p, q in zip(range(nodes - 1, n - 1, -1), np.concatenate(left)[::-1].tolist(), np.concatenate(right)[::-1].tolist()):
            out[p] = out[q] = out[node]
    return out[:n]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The least number of windows, from the sum upwards, whose differencing fits."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, k)
        over = int(np.bincount(at, weights=sizes, minlength=k).max(initial=0)) - capacity
        if over <= 0:
            return at
        k += 1


class Tokenizer:
    """Ids of texts by the tokenizers library, each distinct word of a slice once."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        starts = [i for t, i in self.library.get_vocab().items() if t.startswith("Ġ")]
        self.spaced = np.zeros(self.library.get_vocab_size() + 1, dtype=bool)
        self.spaced[starts] = True

    def raw(self, strings: list[str]) -> list[np.ndarray]:
        """Ids of each string by itself."""
        out: list[np.ndarray] = []
        for at in range(0, len(strings), 2000):
            out += [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(strings[at : at + 2000], add_special_tokens=False)]
        return out

    def spelled(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + s for each run s of letters, and how many each has: many thousand
        in one string, told apart by the ids that begin with a space."""
        ids, size = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(stems), 20_000):
            part = stems[at : at + 20_000]
            got = np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(self.spaced[got])
            if len(cut) != len(part):
                raise ValueError("tokens do not follow the spaces")
            ids.append(got)
            size.append(np.diff(cut, append=len(got)))
        return np.concatenate(ids), np.concatenate(size)

    def spell(self, stems: list[str], strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, size = self.spelled(stems)
        alone = self.raw(strings)
        return np.concatenate([ids, *alone]), np.concatenate([size, [len(x) for x in alone]]).astype(np.int64)

    def encode(self, said: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the closing id, one after another, and their numbers."""
        return assemble(said, self.spell, [CLOSING])


_WORKER: dict[str, Tokenizer] = {}

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, capacity: int = WINDOW, piece: int = PIECE, block: int = BLOCK, most: int = _BYTES) -> DataFrame:
    """Pack (doc_id, text) into sequences of at most ``capacity`` ids; one row a piece.

    A document is its ids and a closing id; the file's special tokens are such in a
    text too, as the library reads it; null texts are empty and give the closing
    id alone. Whole windows are cut from a document's front and are sequences by
    themselves; the rest is cut to pieces of at most ``piece`` ids, which are packed
    together in blocks of ``block`` pieces by differencing, the window count rising
    until all fit. A task tells the words of about ``most`` bytes of text apart at a time:
    more take more memory and less time. A block lies within one task, so nothing is shuffled, memory is
    bounded by a block, and a lost task is packed again from the same rows alike;
    a task's last block is smaller. sequence_id holds task, block and window. Repeated
    rows are packed each; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        if path not in _WORKER:
            _WORKER[path] = Tokenizer(path)
        tokenizer = _WORKER[path]
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        serial = 0
        rest: list[pa.RecordBatch] = []
        waiting = 0

        def emit(rows: pa.RecordBatch, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(base + sequence), pa.array(offset)], _NAMES)

        def packed(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal serial
            size = rows.column("length").to_numpy()
            at = windows(size, capacity)
            order = np.argsort(at, kind="stable")
            before = np.cumsum(size[order]) - size[order]
            new = np.append(True, at[order][1:] != at[order][:-1])
            offset = np.empty(len(size), dtype=np.int64)
            offset[order] = before - np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), len(size))))
            serial += int(at.max()) + 1
            return emit(rows, serial - int(at.max()) - 1 + at, offset)

        for part in small(batches, most=most):
            ids, n = tokenizer.encode(part.column(1))
            # whole windows from the front of a document, then pieces
            whole = n // capacity
            count = whole + -(-(n - whole * capacity) // piece)
            of = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            start = np.where(k < whole[of], k * capacity, whole[of] * capacity + (k - whole[of]) * piece)
            length = np.where(k < whole[of], capacity, np.minimum(piece, n[of] - start))
            at = 4 * ((np.cumsum(n) - n)[of] + start)
            said = memoryview(ids.tobytes())
            crc = [zlib.crc32(said[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            cols = [part.column(0).cast(pa.int64()).take(pa.array(of)), *(pa.array(c, pa.int64()) for c in (start, length, crc, n[of]))]
            rows = pa.RecordBatch.from_arrays(cols, _NAMES[:5])
            full = rows.filter(pa.array(length == capacity))
            yield emit(full, serial + np.arange(len(full)), np.zeros(len(full), dtype=np.int64))
            serial += len(full)
            rest.append(rows.filter(pa.array(length < capacity)))
            waiting += len(rest[-1])
            if waiting >= block:
                held = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                for a in range(0, waiting - block + 1, block):
                    yield packed(held.slice(a, block))
                rest, waiting = [held.slice(waiting - waiting % block)], waiting % block
        if waiting:
            yield packed(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op2_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
