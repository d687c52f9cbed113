"""State that ends: completed states, keys once for good, the bucketed table, sessions, ages."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from decisionlake.operators import shards
from decisionlake.sources.store import BucketTable
from decisionlake.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def files(spark, path, parts, schema):
    """A file a part, read in that order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        newest = max((f for f in path.glob("*.parquet")), key=lambda f: f.stat().st_mtime_ns)
        newest.rename(path / f"{i:04d}.parquet")
    import os

    for i, f in enumerate(sorted(path.glob("*.parquet"))):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))


def hour(h):
    return T0 + dt.timedelta(hours=h)


def test_complete_states_come_once_and_their_state_goes(spark, tmp_path):
    parents, children = "k long, ts timestamp, want long", "k long, ts timestamp, c long"
    a, b = tmp_path / "p", tmp_path / "c"
    files(spark, a, [[(i, hour(10 * i), 2) for i in range(j, j + 5)] for j in (0, 5)], parents)
    # 0 never ends, 3 has one child twice, children of 9 come in two files
    rows = [(i, hour(10 * i + 1), c) for i in range(1, 10) for c in (0, 1) if (i, c) != (3, 1)] + [(3, hour(31), 0), (2, hour(22), 1)]
    rows.sort(key=lambda r: r[1])
    files(spark, b, [rows[:8], rows[8:-1], rows[-1:] + [(50, hour(900), 0)]], children)

    def run(log, progress=None):
        p, c = (streams.stream_table(spark, str(x), StructType.fromDDL(s), files=1) for x, s in ((a, parents), (b, children)))
        out = streams.complete_states(p, c, "k", "want", "c", hold="5 hours", late="20 hours")
        return sorted((r.k, r.want, r.found) for r in streams.drain(out, ["k"], "t", "append", log, progress).collect())

    progress = []
    log = str(tmp_path / "log")
    want = [(k, 2, 2) for k in (1, 2, 4, 5, 6, 7, 8, 9)]
    assert run(log, progress) == want
    state = [p.stateOperators[0] for p in progress if p.stateOperators]
    assert max(o.numRowsTotal for o in state) > state[-1].numRowsTotal
    assert sum(o.numRowsRemoved for o in state) > 0
    # started again from the checkpoint, with nothing new and with a late repeat
    files_before = len(list(b.glob("*.parquet")))
    assert run(log) == want
    spark.createDataFrame([(1, hour(11), 0), (1, hour(11), 1)], children).coalesce(1).write.mode("append").parquet(str(b))
    assert len(list(b.glob("*.parquet"))) > files_before
    assert run(log) == want and spark.read.parquet(f"{log}-out").count() == len(want)


def test_keys_come_once_for_good(spark, tmp_path):
    schema = "k string, n long, ts timestamp"
    events = tmp_path / "e"
    files(spark, events, [[("a", 2, hour(0)), ("a", 1, hour(0)), (None, 5, hour(0))], [("b", 3, hour(1)), ("a", 4, hour(1))], [("a", 9, hour(5000)), (None, 6, hour(5000)), ("c", 7, hour(5000))]], schema)
    seen = BucketTable(spark, str(tmp_path / "seen"), ["k"], StructType.fromDDL("k string, first_batch long"), 4).create()
    stream = streams.stream_table(spark, str(events), StructType.fromDDL(schema), files=1)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    streams.once(stream, seen, ["n"], out, log)
    read = lambda at=out: sorted(((r.k, r.n, r._batch) for r in spark.read.schema(stream.schema.add("_batch", "long")).parquet(at).collect()), key=repr)
    want = sorted([("a", 1, 0), (None, 5, 0), ("b", 3, 1), ("c", 7, 2)], key=repr)
    assert read() == want
    version = seen.version()
    streams.once(stream, seen, ["n"], out, log)  # nothing new
    # the commits are lost, so that every batch runs again with its own number
    streams.once(stream, seen, ["n"], str(tmp_path / "again"), str(tmp_path / "log-again"))
    assert read(str(tmp_path / "again")) == want and seen.version() == version


def test_table_in_buckets_rewrites_what_is_touched(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), ["k"], StructType.fromDDL("k long, v string"), 8).create()
    assert t.read().count() == 0
    last = lambda old, new: old.join(new, "k", "left_anti").unionByName(new)
    t.replace(spark.createDataFrame([(i, "old") for i in range(100)], t.schema), last)
    before = t.folders(1)
    one = spark.createDataFrame([(7, "new")], t.schema)
    where = t.touched(one)
    t.replace(one, last, batch=5)
    after = t.folders(2)
    assert [b for b in before if before[b] != after[b]] == where and len(where) == 1
    assert {r.k: r.v for r in t.read().collect()} == {i: "new" if i == 7 else "old" for i in range(100)}
    assert {r.v for r in t.read(version=1).collect()} == {"old"}
    assert {f.split("_bucket=")[1][0] for f in t.read(where).inputFiles()} == {str(where[0])}
    assert t.replace(one.withColumn("v", F.lit("again")), last, batch=5) == 2 and t.version() == (2, 5)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        t._publish([], 2, 6)


def test_cache_in_buckets(spark, tmp_path):
    cache = shards.response_cache(spark, str(tmp_path / "cache"), 4).create()
    key = lambda c: c * 64
    new = lambda rows: spark.createDataFrame(rows, "cache_key string, text string, reasoning_text string, prompt_tokens long, completion_tokens long, at long")
    shards.put(cache, new([(key("a"), "one", "why", 3, 4, 1), (key("a"), "two", None, 5, None, 2), (key("b"), "b", None, 1, 1, 1)]), "at")
    shards.put(cache, new([(key("a"), "three", None, 7, 8, 0)]), "at")
    requests = spark.createDataFrame([("r1", key("a"), 1.5, "mine", 9), ("r2", key("c"), 2.5, "mine", 9), ("r3", None, 1.0, None, None)], "id string, cache_key string, latency_s double, text string, completion_tokens long")
    got = {r.id: r for r in shards.look_up(requests, cache).collect()}
    assert (got["r1"].text, got["r1"].prompt_tokens, got["r1"].completion_tokens, got["r1"].cached, got["r1"].latency_s) == ("three", 7, 8, True, 0.0)
    assert (got["r2"].text, got["r2"].completion_tokens, got["r2"].cached, got["r2"].latency_s) == ("mine", 9, False, 2.5)
    assert got["r3"].cached is False
    with pytest.raises(Exception, match="64 lower-case"):
        shards.put(cache, new([("short", "x", None, 1, 1, 1)]), "at")


def test_last_sessions_come_at_the_end(spark, tmp_path):
    schema = "k long, ts timestamp, tokens long, seconds double, bad boolean"
    rows = [(1, hour(0), 10, 2.0, False), (1, hour(1), 20, 1.0, True), (1, hour(9), 5, 0.0, False), (2, hour(9), 7, 3.5, False), (None, hour(9), 1, 1.0, True)]
    files(spark, tmp_path / "s", [rows], schema)
    stream = streams.with_end(streams.stream_table(spark, str(tmp_path / "s"), StructType.fromDDL(schema), files=None))
    out = streams.drain(streams.sessions(stream, "k", "2 hours", "1 hour", "tokens", "seconds", "bad"), ["start", "end", "k"], "t", "append").collect()
    got = sorted(((r.k, r.requests, r.tokens, r.tokens_per_second, r.errors) for r in out), key=repr)
    assert got == sorted([(1, 2, 30, 10.0, 1), (1, 1, 5, 0.0, 0), (2, 1, 7, 2.0, 0), (None, 1, 1, 1.0, 1)], key=repr)


def test_ages_of_idle_entities_start_anew(spark, tmp_path):
    schema = "e string, slot long, event boolean, increment double, ts timestamp"
    parts = [[("a", i, i == 2, 1.0, hour(i)) for i in range(1, 5)], [("b", 1, False, 2.0, hour(100))], [("b", 2, False, 0.5, hour(101))], [("a", 9, False, 0.25, hour(102)), ("b", 1, True, 9.0, hour(102)), ("b", 3, False, -9.0, hour(102)), ("b", 3, False, 5.0, hour(102))]]
    files(spark, tmp_path / "s", parts, schema)
    stream = streams.stream_table(spark, str(tmp_path / "s"), StructType.fromDDL(schema), files=1)
    progress = []
    got = {(r.e, r.slot): (r.age, r.queue) for r in streams.drain(streams.ages(stream, "e", 6, 3.0, 2, idle="10 hours"), ["e", "slot"], "t", "append", progress=progress).collect()}
    assert got == {("a", 1): (3, 1.0), ("a", 2): (1, 2.0), ("a", 3): (2, 3.0), ("a", 4): (3, 3.0), ("b", 1): (3, 2.0), ("b", 2): (4, 2.5), ("b", 3): (5, 0.0), ("a", 9): (3, 0.25)}
    assert max(o.numRowsTotal for p in progress for o in p.stateOperators) <= 2


def test_queue_walk_step_by_step():
    r = np.random.default_rng(3)
    g, q, want = r.normal(0, 2, 1000), 1.5, []
    for x in g:
        q = min(4.0, max(0.0, q + x))
        want.append(q)
    assert streams.queue_walk(g, 1.5, 4.0) == pytest.approx(np.array(want))
    assert len(streams.queue_walk(g[:0], 1.5, 4.0)) == 0
