"""Byte-level BPE by DuckDB recursive queries, one small database per Spark task."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.llm.common import release, small, table
from decisionlake.llm.segments import assemble, gather

#: Token-position rows (g = word * 2^16 + position) join the merge table; each round
#: contracts every live word's leftmost pair of minimum rank; a word without a pair
#: in the table drops out. Its last round holds its tokens, in order of position.
_CONTRACT = """
WITH RECURSIVE t(it, g, id) AS (
  SELECT 0, w * 65536 + pos, id FROM init
  UNION ALL
  SELECT it + 1, CASE WHEN g > b.p THEN g - 1 ELSE g END, CASE WHEN g = b.p THEN b.m ELSE id END
  FROM t JOIN (
    SELECT w, w * 65536 + k % 65536 AS p, k // 65536 AS m FROM (
      SELECT x.g // 65536 AS w, min(m.m * 65536 + x.g % 65536) AS k
      FROM t x JOIN t y ON y.g = x.g + 1 JOIN merges m ON m.k = x.id * 65536 + y.id GROUP BY 1)) b
  ON t.g // 65536 = b.w WHERE g <> b.p + 1)
SELECT t.g // 65536 AS w, id
FROM t JOIN (SELECT g // 65536 AS w, max(it) AS last FROM t GROUP BY 1) f ON f.w = t.g // 65536 AND it = f.last
ORDER BY g
"""
#: Ordered aggregation: the bytes (a character for a byte) of each run of ids by position.
_DECODE = "SELECT run, string_agg(said, '' ORDER BY pos) AS said FROM coded JOIN vocab USING (id) GROUP BY run ORDER BY run"
#: Bytes of the longest word that the recursive query contracts: all rounds of a word
#: stay until its end, so rows grow with the square of its length. Longer words are
#: contracted by the same rule on a heap.
LONGEST = 256
#: Rows that the rounds of a query's words come to at most, and ids decoded at a time.
_ROWS, _IDS = 2 << 20, 1 << 18
#: Bytes of text whose words are told apart together.
_BYTES = 8 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """Encoder and decoder over a rank file; holds the merge table in DuckDB."""

    def __init__(self, path: str, pattern: str, memory: str = "192MB") -> None:
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        # queries are bounded by rows, so that none spills; without a folder none could
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        pair: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pair[a * 65536 + b] = rank
        self._load("merges", k=list(pair), m=list(pair.values()))
        self._load("vocab", id=list(self.ranks.values()), said=[t.decode("latin-1") for t in self.ranks])
        self.bytes_id = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)

    def _load(self, name: str, **cols: list) -> None:
        self.con.register("incoming", pa.table(cols))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, begin, size): token ids of each word (none empty) by the recursive query:
        words of similar length together, as many as keep the rows of all rounds below _ROWS."""
        length = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(length, kind="stable")
        rows = np.cumsum(length[order] ** 2)
        begin, size = np.zeros((2, len(words)), dtype=np.int64)
        pool, at, done = [np.zeros(0, np.int64)], 0, 0
        while at < len(order):
            end = max(at + 1, int(np.searchsorted(rows, (rows[at - 1] if at else 0) + _ROWS)))
            here = order[at:end]
            flat = np.frombuffer(b"".join([words[i] for i in here.tolist()]), dtype=np.uint8)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(length[here]) - length[here], length[here])
            self.con.register("init", pa.table({"w": np.repeat(np.arange(len(here)), length[here]), "pos": pos, "id": self.bytes_id[flat]}))
            got = self.con.execute(_CONTRACT).fetchnumpy()
            self.con.unregister("init")
            size[here] = np.bincount(got["w"], minlength=len(here))
            begin[here] = done + np.cumsum(size[here]) - size[here]
            pool.append(got["id"])
            at, done = end, done + len(got["id"])
        return np.concatenate(pool), begin, size

    def _long(self, word: bytes) -> np.ndarray:
        """A word of any length: the leftmost pair of minimum rank, one at a time, on a heap."""
        ids = [self.ranks[bytes([b])] for b in word]
        part: list[bytes | None] = [bytes([b]) for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, 2) for i in range(len(ids) - 1) if (r := self.ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, size = heapq.heappop(heap)
            j = after[i] if part[i] is not None else len(ids)
            if j >= len(ids) or len(part[i]) + len(part[j]) != size or self.ranks.get(part[i] + part[j]) != rank:
                continue
            part[i], part[j], ids[i] = part[i] + part[j], None, rank
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (r := self.ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
        return np.array([k for k, p in zip(ids, part) if p is not None], dtype=np.int64)

    def spell(self, stems: list[str], strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one after another, and their numbers: of each stem after a space, which is
        a word, and of each string, cut to words by the pattern; each distinct word once.
        A word that is a token is that token."""
        cut = [self.pattern.findall(s) for s in strings]
        code = {" " + s: i for i, s in enumerate(stems)}
        of = np.array([*range(len(stems)), *(code.setdefault(w, len(code)) for ws in cut for w in ws)], dtype=np.int64)
        raw = [w.encode("utf-8", "surrogatepass") for w in code]
        known = np.array([self.ranks.get(w, -1) for w in raw], dtype=np.int64)
        length = np.array([len(w) for w in raw], dtype=np.int64)
        ask, long = np.flatnonzero((known < 0) & (length <= LONGEST)), np.flatnonzero((known < 0) & (length > LONGEST))
        pool, begin, size = known, np.arange(len(known)), np.ones(len(known), dtype=np.int64)
        more, first, size[ask] = self.contract([raw[i] for i in ask.tolist()])
        begin[ask] = len(pool) + first
        alone = [self._long(raw[i]) for i in long.tolist()]
        size[long] = [len(x) for x in alone]
        begin[long] = len(pool) + len(more) + np.cumsum(size[long]) - size[long]
        words = np.array([1] * len(stems) + [len(ws) for ws in cut], dtype=np.int64)
        each = np.append(0, np.cumsum(size[of]))
        end = np.cumsum(words)
        return gather(np.concatenate([pool, more, *alone]), begin, size, of), each[end] - each[end - words]

    def encode(self, said: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and their numbers."""
        return assemble(said, self.spell, [])

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The bytes of each sequence of ids (given one after another, with their numbers);
        a long sequence is decoded in runs."""
        of = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        new = np.append(True, (of[1:] != of[:-1]) | (pos[1:] % _IDS == 0)) if len(ids) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        said: list[bytes] = []
        at = 0
        while at < len(head):
            end = max(at + 1, int(np.searchsorted(head, head[at] + _IDS, side="right")) - 1)
            here = slice(int(head[at]), int(head[end]) if end < len(head) else len(ids))
            self.con.register("coded", pa.table({"run": run[here], "pos": pos[here], "id": ids[here]}))
            got = self.con.execute(_DECODE).fetchnumpy()
            self.con.unregister("coded")
            if len(got["run"]) != end - at:
                raise ValueError("an id is not in the vocabulary")
            said += [x.encode("latin-1") for x in got["said"]]
            at = end
        out = [b""] * len(size)
        for i, x in zip(of[head].tolist(), said):
            out[i] = out[i] + x if out[i] else x
        return out


_WORKER: dict[tuple[str, str], Bpe] = {}


def worker(path: str, pattern: str) -> Bpe:
    """One encoder for each Python worker, kept between its tasks: of a fixed size."""
    if (path, pattern) not in _WORKER:
        _WORKER[path, pattern] = Bpe(path, pattern)
    return _WORKER[path, pattern]


def _encoded(batches: Iterable[pa.RecordBatch], bpe: Bpe) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, ids)."""
    for part in small(batches, most=_BYTES):
        ids, n = bpe.encode(part.column(1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists], ["doc_id", "ids"])


def _decoded(batches: Iterable[pa.RecordBatch], bpe: Bpe) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) to (doc_id, ids, decoded)."""
    for batch in batches:
        ids = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
        said = bpe.decode(ids.flatten().to_numpy(), pc.list_value_length(ids).to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.binary())], ["doc_id", "ids", "decoded"])


def _run(rows: DataFrame, path: str, pattern: str, steps: list[Callable], schema: str) -> DataFrame:
    """rows through the steps, one after another, in one Python worker a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bpe = worker(path, pattern)
        for step in steps:
            batches = step(batches, bpe)
        yield from batches

    return rows.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) to (doc_id, ids: array of int), row by row, without a shuffle.

    Each distinct word of a slice of rows is contracted once by the recursive query
    (words over LONGEST bytes on a heap by the same rule); words known as whole tokens are
    taken as such, as the tiktoken library does. Null texts are empty: no ids. Repeated
    rows each give a row; an empty table none.
    """
    return _run(docs.select("doc_id", "text"), path, pattern, [_encoded], "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) with ``decoded``, the bytes of the ids by ordered aggregation over
    their positions. Null ids are empty; an id that is not in the vocabulary is an error."""
    return _run(coded.select("doc_id", "ids"), path, pattern, [_decoded], "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode_documents() and decode_documents() one after the other, in the same task."""
    return _run(docs.select("doc_id", "text"), path, pattern, [_encoded, _decoded], "doc_id long, ids array<int>, decoded binary")


def op7_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the multilingual ranks and back."""
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return round_trip(table(spark, sf_dir, "documents"), *how).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
