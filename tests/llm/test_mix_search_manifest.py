"""Mixing, lexical search and the manifest against brute force on small tables: nulls,
empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from decisionlake.llm import lexical, manifest, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _seed string, rank string, size string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, n, "clash", "clash", "clash") for i, t, lang, source, n in rows], DOCS)


# mixing


def mix_rows():
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 400)), "en", f"s{i % 5}", 1) for i in range(300)]
    rows += [(7, "same row here", "en", "s1", 1)] * 3 + [(8, None, "en", "s1", 1), (None, "no id", "en", None, 1), (9, " \t\n", "en", "empty", 1), (10, "x " * 9000, "en", "", 1)]
    return rows


def expected_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free, target, left = set(order), {}, 1.5 * sum(sizes.values())
    while free:
        whole = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / whole > 2 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / whole for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def test_mix_targets_and_totals(spark):
    rows = mix_rows()
    got = mixing.mix(make(spark, rows)).collect()
    size = {s: 0 for *_, s, _ in rows}
    for _, t, _, s, _ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = expected_targets(size), collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and r.copies in (0, 1, 2)
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= (18000 if s == "" else 60), s


def test_mix_does_not_depend_on_partitions_and_repeats_rows(spark):
    d = make(spark, mix_rows())
    one, many = (sorted(map(tuple, mixing.mix(x).collect()), key=repr) for x in (d.coalesce(1), d.repartition(7)))
    assert one == many
    copies = collections.Counter(r.doc_id for r in mixing.mix(d).collect() for _ in range(r.copies))
    out = mixing.mixed(d)
    assert out.columns == d.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == copies
    assert mixing.mix(d.where("false")).count() == 0


def test_mix_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 4)
    monkeypatch.setattr(mixing, "BANDS", (50, 1))
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), "en", f"s{i % 3}", 1) for i in range(240)]
    for r in mixing.mix(make(spark, rows)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 50


def test_pivot_keeps_the_sum_and_each_expectation():
    cap, mass, runs = [10, 30, 7, 50], [4, 9, 5, 20], 4000
    total = [0.0] * 4
    for k in range(runs):
        out, left = mixing.pivot(cap, mass, [k * 7919 + i * 104729 for i in range(4)])
        assert sum(out) == sum(mass)
        assert [i for i in range(4) if 0 < out[i] < cap[i]] == ([] if left is None else [left])
        total = [a + b for a, b in zip(total, out)]
    for t, m, c in zip(total, mass, cap):
        assert t / runs == pytest.approx(m, abs=0.03 * c)


# lexical search


def brute_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = lambda t: term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    said = [(i, collections.Counter(cut(t))) for i, t in docs]
    said = [(i, c) for i, c in said if c]
    n_docs, n_terms = len(said), sum(sum(c.values()) for _, c in said)
    df = collections.Counter(t for _, c in said for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(cut(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in said:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((score, i))
        scored.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
        out += [(item, rank + 1, i, score) for rank, (score, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def search_docs():
    docs = [(i, " ".join(f"W{(i * 31 + j * j) % (7 + j)}" for j in range(3 + i % 40))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, "ÜBER über Straße 日本 x-y_z"), (None, "w1 w2 w3"), (503, "w1 " * 50000), (504, "w1 w2"), (504, "w1 w2"), (505, "\x00w1\x7fw2 ")]
    items = [(1, "w1 w2 w3 w4 w5 w6 w7 W8 w9"), (2, None), (3, ""), (4, "Über STRASSE straße 日本"), (5, "nowhere"), (6, "w0"), (7, "w1"), (7, "w2"), (7, "w1"), (None, "w3 w30")]
    return docs, items


@pytest.mark.parametrize("k,entries,block", [(3, 64, 8 << 20), (50, 2 << 20, 40)])
def test_search_equals_brute_force(spark, monkeypatch, k, entries, block):
    monkeypatch.setattr(lexical, "ENTRIES", entries)
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = search_docs()
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, score string, n int").repartition(3)
    q = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, terms string")
    got = sorted((tuple(r) for r in lexical.search(d, q, k).collect()), key=repr)
    assert got == brute_search(docs, items, k)
    assert lexical.search(d.where("false"), q, k).count() == 0
    assert lexical.search(d, q.where("false"), k).count() == 0


def test_accumulators_stop_and_the_best_stay_exact():
    import numpy as np

    rare, common = (np.array([3, 5]), np.array([900, 800])), (np.arange(100), np.full(100, 10))
    score = lexical.accumulate([rare, common], 100, 2, 0)
    assert score[3] == 910 and score[5] == 810 and (np.delete(score, [3, 5]) == -1).all()
    assert (lexical.accumulate([rare, common], 100, 3, 0)[0]) == 10
    assert lexical.accumulate([common], 100, 2, 11)[0] == -1


# manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_tree(leaves, fan):
    """(root, for each leaf the siblings level by level as (before, after))."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + fan] for i in range(0, len(level), fan)]
        for leaf, i in enumerate(at):
            run = runs[i // fan]
            paths[leaf].append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
        at, level = [i // fan for i in at], [sha("".join(run)) for run in runs]
    return level[0], paths


def brute_manifest(rows, fan):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    langs = collections.defaultdict(list)
    for i, t, lang, source, n in rows:
        langs[lang].append((i is not None, i or 0, sha("".join(map(part, (i, source, lang, n, t)))), i, sha("".join(map(part, (i, source, lang, None if n is None else n + 1, t))))))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: brute_tree([leaf[2] for leaf in sorted(langs[x])], fan) for x in order}
    root, tops = brute_tree([trees[x][0] for x in order], fan)
    out = []
    for x, top in zip(order, tops):
        for (*_, leaf, i, other), path in zip(sorted(langs[x]), trees[x][1]):
            path = path + top
            fold = other if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else leaf
            for before, after in path:
                fold = sha(before + fold + after)
            out.append((i, leaf, trees[x][0], root, sha("".join(a + b for a, b in path)), fold, fold == root))
    return sorted(out, key=repr)


def manifest_rows():
    rows = [(i, f"text {i}", ("en", "de", None, "é")[min(i % 7, 3)], "s", i) for i in range(90)]
    return rows + [(3, "text 3", None, "s", 3)] * 2 + [(None, "no id", "en", None, None), (1000, None, "lone", "s", None), (1001, "x" * 100000, "en", "ü", 2**63 - 1), (1002, "", "", "", 0)]


@pytest.mark.parametrize("fan,bucket", [(2, 4), (3, 9), (2, 256)])
def test_manifest_equals_brute_force(spark, monkeypatch, fan, bucket):
    from pyspark.sql import functions as F

    monkeypatch.setattr(manifest, "BUCKET", bucket)
    d = make(spark, manifest_rows()).repartition(5)
    changed = F.when(F.expr("crc32(cast(doc_id as string)) % 7 = 0 and n_chars is not null"), manifest.leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars").cast("decimal(20,0)") + 1, F.col("text")]))
    proof = F.sha2(F.expr("array_join(transform(path, p -> concat(p.before, p.after)), '')"), 256).alias("proof")
    got = manifest.manifest(d, fan=fan, tampered=changed).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(manifest_rows(), fan)


def test_manifest_of_nothing_and_of_one(spark):
    d = make(spark, [(5, "only", "en", "s", 1)])
    assert manifest.manifest(d.where("false")).count() == 0
    r = manifest.manifest(d).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.path == [] and r.verified
