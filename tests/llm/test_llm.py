"""Operators against brute force on small tables: nulls, empty and long texts, ties,
repeated rows, empty tables, clashing column names."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from decisionlake.llm import bpe, chat, common, embedding, jaccard, language, license, packing, quality, sharding, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _w string, kept string"


def make(spark, said, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), "clash", "clash") for i, t in enumerate(said)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def said():
    base = words(300, 1)
    near = base.split()
    near[150] = "changed"
    return [
        None, "", "   \n\t ", "one two", "one two", base, base, " ".join(near), words(5000, 2), "x" * 5000, words(40, 3) + " " + base[:400], "a" * 300, "ü日本 語  é\n\nb  c",
        "the same line here\nthe same line here\nother", "Under the MIT License; Apache License, Version 2.0. CC-BY-NC", "SPDX-License-Identifier: (MIT OR GPL-2.0) AND BSD-3-Clause",
    ]


def by(rows, key="doc_id"):
    return {r[key]: r for r in rows}


def test_quality_base(spark, said):
    got = by(quality.judged(make(spark, said), ["doc_id"]).collect())
    for i, t in enumerate(said):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(twice))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r.base_failed == (len(w) < 10 or 100 * len(twice) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_outliers(spark):
    said = [words(100 + i, i) for i in range(300)] + ["&&& ### " * 3 + words(60, 999).replace(" ", " $%& ")]
    got = by(quality.judged(make(spark, said), ["doc_id"]).collect())
    assert [i for i, r in got.items() if not r.kept] == [300]
    assert quality.keep_quality(make(spark, said)).columns == make(spark, []).columns
    assert quality.judged(make(spark, []), ["doc_id"]).count() == 0


def test_packing(spark, said):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    said = said + ["start <|endoftext|> end", "x<|endoftext|>y it's 12\n\nNew  two ", " lead", words(20_000, 77)]
    docs = make(spark, said).union(make(spark, said[:4]).selectExpr("doc_id + 100", *DOCS_COLUMNS[1:]))
    rows = packing.pack(docs, path, block=8).collect()
    again = [1000 + i for i, t in enumerate(said)]  # repeated rows are packed each
    twice = make(spark, said).selectExpr("doc_id + 1000 AS doc_id", "text").coalesce(1)
    double = collections.Counter((r.doc_id, r.start) for r in packing.pack(twice.union(twice), path).collect())
    assert set(double.values()) == {2} and {d for d, _ in double} == set(again)
    assert library.encode("start <|endoftext|> end", add_special_tokens=False).ids == [9688, 220, 50256, 886]
    parts, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, t in enumerate(said):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(parts[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(make(spark, []), path).count() == 0


DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_w", "kept"]


def test_window_count_rises():
    sizes = np.array([5, 5, 5, 5, 5, 5])  # three windows of capacity 10 would do by the sum, and do
    assert np.bincount(packing.windows(sizes, 10), weights=sizes).max() == 10
    sizes = np.array([6, 6, 6])  # the sum asks for two windows; no two fit together
    assert sorted(np.bincount(packing.windows(sizes, 10))) == [1, 1, 1]


def test_differencing_balances():
    sizes = np.random.default_rng(0).integers(1, 513, 2000)
    at = packing.windows(sizes, 2048)
    load = np.bincount(at, weights=sizes)
    assert load.max() <= 2048 and 1 - sizes.sum() / (2048 * len(load)) < 0.02


def test_jaccard(spark, said):
    got = by(jaccard.near_duplicates(make(spark, said)).collect())
    sets = {}
    for i, t in enumerate(said):
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    for i, x in sets.items():
        near = [j for j, y in sets.items() if j != i and x and y and len(x & y) / len(x | y) >= 0.8]
        assert got[i].n_links == len(near)
        assert got[i].class_id == min([i, *near])
    kept = jaccard.keep_one(make(spark, said))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    assert jaccard.near_duplicates(make(spark, [])).count() == 0


def test_jaccard_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    base = words(200, 5).split()
    said = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(30)]
    got = jaccard.near_duplicates(make(spark, said)).collect()
    assert {r.n_links for r in got} == {29} and {r.class_id for r in got} == {0}


def test_jaccard_of_null_and_repeated_ids(spark):
    base, other, own = words(200, 31), words(200, 32), words(200, 33)
    near = base.split()
    near[100] = "changed"
    said = [(None, base), (None, base), (None, " ".join(near)), (5, base), (3, " ".join(near)), (3, " ".join(near)), (None, other), (None, other), (8, own), (8, words(90, 34)), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(said)], "doc_id long, text string, source string")
    got = collections.Counter((r.doc_id, r.class_id, r.n_links, r.kept) for r in jaccard.near_duplicates(docs).collect())
    assert got == {(None, 3, 5, False): 3, (5, 3, 5, False): 1, (3, 3, 5, True): 1, (3, 3, 5, False): 1, (None, None, 1, True): 1, (None, None, 1, False): 1, (8, 8, 0, True): 2, (None, None, 0, True): 2}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == {(3, " ".join(near)): 1, (None, other): 1, (8, own): 1, (8, words(90, 34)): 1, (None, None): 1, (None, ""): 1}


def test_license(spark, said):
    got = by(license.scan_licenses(make(spark, said)).collect())
    assert (got[14].n_base, got[14].first_word, got[14].last_word, got[14].base_labels) == (3, 0, 9, "apache-2,cc-by-nc,mit")
    assert got[15].labels == "bsd,gpl,mit" and got[15].n_base == 0
    assert got[0].n_words == 0 and got[0].first_word is None and got[0].labels == ""
    assert license.postfix("MIT or Apache-2.0 and GPL-2.0 with Classpath-exception-2.0") == ["MIT", "Apache-2.0", "GPL-2.0", "Classpath-exception-2.0", "with", "and", "or"]
    assert license.postfix("(MIT OR ISC) AND BSD see file") == ["MIT", "ISC", "or", "BSD", "and"]
    assert license.postfix("MIT OR (") == ["MIT"] and license.postfix("MIT OR (GPL AND (") == ["MIT", "GPL", "or"]
    assert license.postfix("MIT/Apache-2.0") == ["MIT", "Apache-2.0", "or"] and license.postfix("see the file") == []
    assert license.evaluate(license.postfix("GPL-3.0 OR MIT"))[0] == 1.0 and license.evaluate([]) is None
    for said, want in {
        "WTFPL OR MIT": (1.0, {"mit"}), "curl AND GPL-2.0": (0.4, {"gpl"}), "MIT AND JSON AND GPL-3.0-only": (0.4, {"mit", "gpl"}), "MIT AND (Foo OR GPL-3.0)": (0.5, {"mit", "gpl"}), "(Foo) AND MIT": (0.5, {"mit"}),
        "((Foo)) OR (Bar AND MIT) see file": (0.5, {"mit"}), "MIT OR Foo of any kind": (1.0, {"mit"}),
    }.items():
        assert license.evaluate(license.postfix(said)) == want, said
    assert license.postfix("(c) by us") == [] and license.postfix("none") == []
    docs = make(spark, said)
    assert license.scan_licenses(docs.union(docs)).count() == 2 * len(said) and license.scan_licenses(make(spark, [])).count() == 0


def test_license_of_long_expressions():
    found = license._automata()
    ids = [f"Own-{i}" for i in range(1000)]
    for last, score in (("GPL-2.0", 0.4), ("all-rights-reserved", 0.0)):
        got = license.scan("SPDX-License-Identifier: " + " AND ".join(["MIT", *ids, last]) + "\nprose", found)
        assert set(got[5].split(",")) == {"mit", license.family(last)} and got[6] == score
    got = license.scan("SPDX-License-Identifier: MIT and more prose SPDX-License-Identifier: GPL-2.0", found)
    assert got[5] == "gpl,mit" and got[6] == 0.4
    assert license.scan("SPDX-License-Identifier: see the file", found)[5:] == ("", 0.0)
    assert license.scan("x" * 3_000_000 + " CC BY-NC", found)[:4] == (4, 1, 1, 1)


def test_license_against_brute_force():
    found, r = license._automata(), random.Random(4)
    known = {"MIT": "mit", "GPL-2.0-only": "gpl", "Apache-2.0": "apache-2", "BSD-3-Clause": "bsd", "CC-BY-NC-4.0": "cc-by-nc", "LGPL-2.1+": "lgpl"}

    def expression(depth):  # (said, grant, labels), evaluated while it is made
        if depth == 0 or r.random() < 0.3:
            name = r.choice(list(known))
            grant = license.GRANT[known[name]]
            return (name, grant, {known[name]}) if r.random() < 0.8 else (f"{name} WITH Some-exception", min(1.0, grant + 0.1), {known[name]})
        (a, x, p), (b, y, q) = expression(depth - 1), expression(depth - 1)
        op = r.choice(["AND", "or"])
        return f"({a}) {op} ({b})", min(x, y) if op == "AND" else max(x, y), p | q

    vocabulary = [w for p in {**license.BASE, **license.MORE} for w in p.split()] + ["x", "É", "-", "2.0", "\n"]
    for k in range(300):
        text = r.choice([" ", "  ", "-"]).join(r.choice(list(license.BASE) if r.random() < 0.2 else vocabulary) for _ in range(40)).title()
        said, grant, labels = expression(3)
        if k % 3:
            text += f"\nSPDX-License-Identifier: {said}\n tail"
        got = license.scan(text, found)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, license.BASE[p]) for p in license.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        more = {label for p, label in license.MORE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
        grants = [license.GRANT[x] for _, x in places] + [license.GRANT[x] for x in more] + [grant] * (k % 3 > 0)
        want = more | {x for _, x in places} | (labels if k % 3 else set())
        assert got[:2] == (len(w), len(places)) and (got[2], got[3]) == (min(places)[0] if places else None, max(places)[0] if places else None)
        assert got[4] == ",".join(sorted({x for _, x in places})) and got[5] == ",".join(sorted(want)) and got[6] == min(grants, default=0.0)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "</s>[INST] <\\s>"), (1, 2, "assistant", None), (1, 3, "assistant", "a<t>b"), (2, 0, None, "x"), (2, 0, None, "x"), (3, None, "a<r>b", "")]
    out = chat.parse_conversations(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    for r in out:
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [tuple(t) for t in r.turns] == want
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert len(spans) == sum(w[0] == "assistant" for w in want)
    long = [(9, i, "user" if i % 3 else "assistant", f"turn {i} <s>") for i in range(3000)]
    again = chat.format_conversations(spark.createDataFrame([(*x, "extra") for x in long], "conv_id long, turn long, role string, text string, formatted string"))
    r = chat.parse_conversations(again).withColumn("under", chat.under_mask("formatted", "loss_spans")).first()
    assert [tuple(t) for t in r.turns] == [x[2:] for x in long] and r.under == "".join(x[3] for x in long if x[2] == "assistant")
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_embedding(spark):
    random_ = np.random.default_rng(3)
    base = random_.standard_normal((40, 16))
    x = np.concatenate([base, base + 0.1 * random_.standard_normal(base.shape), base[:5]])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, x[0].tolist(), None), (1004, [1.0, None], 1)]
    got = by(embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect(), "vec_id")
    y = np.array([np.float32(r[1]) for r in rows[: len(x)]], dtype=np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.93) & (np.arange(len(y))[:, None] % 2 == np.arange(len(y))[None, :] % 2)
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= near.sum() and found >= 0.95 * near.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1005))


def test_embedding_of_very_large_and_small_components(spark):
    base = np.random.default_rng(5).standard_normal((3, 16))
    rows = [(10 * k + j, (v * scale).tolist(), "a") for k, v in enumerate(base) for j, scale in enumerate((1.0, 1e200, 3e-200))]
    rows.append((99, (base[0] * 1e200 + base[1] * 1e199).tolist(), "a"))  # cosine 0.99 with 0 to 2
    got = by(embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect(), "vec_id")
    unit = [np.asarray(v) / np.abs(v).max() for _, v, _ in rows]
    near = [[i for i, x in enumerate(unit) if i != j and x @ y >= 0.93 * np.sqrt((x @ x) * (y @ y))] for j, y in enumerate(unit)]
    assert [got[r[0]].n_links for r in rows] == [len(n) for n in near] == [3, 3, 3, 2, 2, 2, 2, 2, 2, 3]
    assert got[99].component_id == 0 and got[12].component_id == 10


def test_embedding_labels_repeats_and_no_rows(spark):
    x = np.random.default_rng(5).standard_normal((3, 8)).tolist()
    rows = [(1, x[0], "red", "e"), (2, x[0], "red", "e"), (2, x[0], "red", "e"), (3, x[0], "1.5", "e"), (4, x[1], "1.5", "e"), (5, x[0], None, "e")]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, n_links string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
    halves = spark.createDataFrame([(1, x[0], 1.5), (2, x[0], 1.25)], "vec_id long, embedding array<float>, label double")
    assert [r.n_links for r in embedding.near_duplicates(halves).collect()] == [0, 0]
    assert embedding.near_duplicates(halves.limit(0)).count() == 0


@pytest.mark.parametrize("dim, cosine", [(4, 0.93), (16, 0.93), (64, 0.93), (64, 0.94), (384, 0.93)])
def test_filters_share_at_the_threshold(dim, cosine):
    random_ = np.random.default_rng(dim)
    filters = embedding.Filters(dim)
    for _ in range(2000):
        x, z = random_.standard_normal((2, dim))
        x /= np.linalg.norm(x)
        z -= z @ x * x
        y = cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)
        assert len(np.intersect1d(filters.decode(x), filters.decode(y)))


def test_embedding_of_few_dimensions(spark):
    turn = np.arccos(0.935)
    rows = [(2 * k + j, [float((k + 1) * np.cos(k + j * turn)), float((k + 1) * np.sin(k + j * turn)), 0.0], k) for k in range(50) for j in (0, 1)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert [r.n_links for r in got] == [1] * 100


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, said, encoding):
    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    r = random.Random(6)
    long = ["".join(r.choices("abcdefgh", k=k)) for k in (255, 256, 257, 900)] + ["".join(r.choices("日本語éя", k=400)), "a <|endoftext|> b it's", "x  y\n\n z "]
    said = said + long
    docs = make(spark, said)
    got = by(bpe.round_trip(docs, *how).collect())
    assert got == by(bpe.decode_documents(bpe.encode_documents(docs, *how), *how).collect())
    for i, t in enumerate(said):
        assert got[i].ids == encoding.encode_ordinary(t or ""), i
        assert got[i].decoded == (t or "").encode()
    assert len(bpe.encode_documents(docs.union(docs), *how).collect()) == 2 * len(said)
    assert bpe.decode_documents(bpe.encode_documents(make(spark, []), *how), *how).count() == 0
    swapped = bpe.decode_documents(spark.createDataFrame([(1, got[5].ids[:3]), (2, None), (3, [])], "doc_id long, ids array<int>"), *how)
    assert by(swapped.collect())[1].decoded == encoding.decode_bytes(got[5].ids[:3])  # what is decoded are the ids


def test_bpe_of_long_words(encoding):
    r = random.Random(8)
    said = ["".join(r.choices("abcdefghijklmnop", k=1000)) for _ in range(2000)]
    coder = bpe.Bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids, n = coder.encode(pa.array(said))
    assert np.split(ids, np.cumsum(n)[:-1])[7].tolist() == encoding.encode_ordinary(said[7])
    assert coder.decode(ids, n) == [t.encode() for t in said]


def test_sharding(spark):
    docs = make(spark, [words(3, i) for i in range(500)] + [None, ""])
    got = sharding.shard_documents(docs, 8, rows_per_run=10).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert 20 < sum(r.grown_shard == 8 for r in got) < 100
    assert by(got)[500].size == 1 and by(got)[500].text_crc32 == 0

    def jump(key, shards):  # one row at a time
        k, b, j = xxhash.xxh64_intdigest(b"jump", xxhash.xxh64_intdigest(str(key).encode(), 42)), 0, 0
        while j < shards:
            k = xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42)
            b, j = j, int((j + 1) / (((k >> 33) + 1) / 2**31))
        return b

    assert all((r.shard, r.grown_shard) == (jump(r.doc_id, 8), jump(r.doc_id, 9)) for r in got)
    twice = sharding.shard_documents(docs.union(docs), 8, rows_per_run=10).collect()
    assert len({(r.shard, r.slot) for r in twice}) == len(twice) == 2 * len(got)
    assert sharding.shard_documents(docs.limit(0), 8).count() == 0


def test_language(spark):
    a, b = "the and of to in is that it was for", "der die und in den von zu das mit sich"
    said = [" ".join(random.Random(i).choices((a if i % 2 else b).split(), k=12)) for i in range(120)] + [None, "123 456", ""]
    got = by(language.identify(make(spark, said, {i: "en" if i % 2 else "de" for i in range(120)})).collect())
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(120))
    assert sum(got[i].lang_pred == ("en" if i % 2 else "de") for i in held) >= 0.95 * len(held)
    assert [got[i].lang_pred for i in (120, 121, 122)] == ["und"] * 3
    assert [language.has_letter(t) for t in ("½", "12 ²", "Ⅷ", "", "_", "é", "ª", "語", "1a")] == [False] * 5 + [True] * 4
    assert language.identify(make(spark, [])).count() == 0
    docs = make(spark, said, {i: "en" if i % 2 else "de" for i in range(120)})
    kept = language.keep_language(docs.union(docs))  # repeated rows stay alike
    assert kept.columns == docs.columns
    kept = collections.Counter(r.doc_id for r in kept.collect())
    assert set(kept.values()) == {2} and len(kept) >= 110 and not {120, 121, 122} & set(kept)


def test_language_bounds(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    docs = make(spark, [words(20, i) for i in range(40)], {i: f"l{i % 4}" for i in range(40)})
    with pytest.raises(ValueError, match="languages"):
        language.identify(docs)
    same = docs.selectExpr("0L AS doc_id", "text", "'en' AS lang", "source", "n_chars", "_w", "kept").where("text is not null")
    model = language.train(same.union(same), sample=5)
    assert model.labels == ["en"]


def test_suffix(spark, said, monkeypatch):
    monkeypatch.setattr(suffix, "BUFFER", 700)
    extra = [words(60, 9) + said[5][200:900] + words(30, 10), said[5][100:420] + said[8][500:800], (words(30, 11) + " ") * 4]
    texts = said + extra
    got = by(suffix.dedup(make(spark, texts)).collect())
    seen = set()
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        kept = bytes(x for x, g in zip(data, gone) if not g)
        want = (len(data), len(data) - len(kept), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i
    assert suffix.dedup(make(spark, [])).count() == 0
    assert suffix.cut_documents(make(spark, texts)).columns == DOCS_COLUMNS


def test_suffix_around_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 8)
    line = "licensed to all who read this line, by the house"
    said = [words(25, 1000 + k) + " " + line + " " + words(25, 2000 + k // 3) + ("" if k % 4 else line * 4) for k in range(60)] + [words(25, 1003) + " " + line, None]
    docs = make(spark, said)
    around = suffix._around(docs, suffix._found(docs)).collect()
    assert max(collections.Counter(r.key for r in around if r.n > 0).values(), default=0) <= 8 and any(r.n == 0 for r in around)
    got, seen = by(suffix.dedup(docs).collect()), set()
    for i, t in enumerate(said):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        assert got[i].kept_sha256 == hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest(), i


def test_shared_over_batches():
    random_ = np.random.default_rng(2)
    rows = np.stack([np.sort(random_.integers(0, 12, 300)), random_.integers(0, 3, 300), random_.integers(0, 2, 300), random_.integers(0, 6, 300), np.zeros(300, np.int64), random_.integers(0, 3, 300) << 7 | 1])
    rows = rows[:, np.lexsort(rows[::-1])]
    names = ["key", "whole", "more", "doc", "sub", "place"]
    cut = lambda size: (pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in rows], names) for k in range(0, 300, size))
    told = [sorted(tuple(r.values()) for b in suffix._shared(cut(size)) for r in b.to_pylist()) for size in (300, 1, 7)]
    assert told[0] == told[1] == told[2] and 0 < len(told[0]) <= 300


def test_suffix_of_null_and_repeated_ids(spark):
    shared = words(60, 21)
    head = words(50, 22)
    said = [(None, head + " " + shared), (None, head[:200] + words(70, 23)), (7, words(30, 24) + " " + shared), (7, words(90, 25)), (7, words(90, 25)), (None, words(80, 26)), (-(2**63) + 1, words(80, 27))]
    docs = spark.createDataFrame(said, "doc_id long, text string")
    rows = suffix.dedup(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in said)
    whole = collections.Counter(hashlib.sha256(t.encode()).hexdigest() for _, t in said)
    got = collections.Counter(r.kept_sha256 for r in rows)
    assert all(got[hashlib.sha256(said[k][1].encode()).hexdigest()] == whole[hashlib.sha256(said[k][1].encode()).hexdigest()] for k in (3, 4, 5, 6))
    assert sum(r.n_removed > 0 for r in rows) == 2  # one of the nulls loses the head, 7 the shared end
    cut = collections.Counter(r.text for r in suffix.cut_documents(docs).collect())
    assert sum(cut.values()) == 7 and sum(shared in t for t in cut) == 1 and sum(head[:200] in t for t in cut) == 1


def test_quality_judges_no_row_by_another_language(spark):
    rows = [(i, words(60 + i % 40, i), "de", f"s{i % 3}") for i in range(90)]
    rows += [(100 + i, " ".join("字" * 20 + str((i + 1) * j) for j in range(30)), "zh", "s0") for i in range(15)]
    rows += [(200 + i, words(60 + i % 40, i), "en", "big") for i in range(150)] + [(400 + i, words(60, i), "en", "few") for i in range(5)]
    rows += [(500, "&&& ### " * 3 + words(60, 999).replace(" ", " $%& "), "en", "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = by(quality.judged(docs, ["doc_id"]).collect())
    assert [i for i, r in got.items() if not r.kept] == [500]
    assert all(r.distance is not None for r in got.values())
    few = spark.createDataFrame([(i, words(60, i), "zz", "s") for i in range(quality.GROUP - 1)] + [(100 + i, words(60, i), "yy", None) for i in range(40)], "doc_id long, text string, lang string, source string")
    assert all((r.distance is None) == (r.doc_id < 100) and r.kept for r in quality.judged(few, ["doc_id"]).collect())


def test_quality_of_small_groups_against_all_subsets(spark):
    """Each (language, source) of a dozen rows: the least determinant over all inner
    subsets, found by trying them, gives the same verdicts and the same distances."""
    from itertools import combinations

    rows = []
    for g in range(4):
        for i in range(12):
            text = words(60 + (i * 7 + g) % 50, 100 * g + i)
            rows.append((20 * g + i, text if i else "&&& ### " * 4 + text.replace(" ", " $%& "), "xy"[g % 2], f"s{g}"))
    rows += [(900, "too short", "x", "s0"), (901, rows[5][1], None, None), (5, *rows[5][1:])]  # a row that repeats counts
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.judged(docs, ["doc_id"]).collect()
    assert len(got) == len(rows)
    got = by(got)

    def vector(text):
        w = text.split()
        symbols, chars = len(re.findall(r"[#*$%&|<>]", text)), sum(map(len, w))
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        return [np.log(len(w)), np.log(chars / len(w)), np.log(1 + 100 * symbols / chars), len(twice) / len(w)]

    good = {(k, r[0]): vector(r[1]) for k, r in enumerate(rows) if not got[r[0]].base_failed and r[2]}
    for lang, source in {(r[2], r[3]) for r in rows if r[2]}:
        keys = [k for k in good if rows[k[0]][2:] == (lang, source)]
        x = np.array([good[k] for k in keys])
        q = np.array([[sorted(c)[int(np.ceil(p * len(c))) - 1] for p in (0.25, 0.75)] for c in np.array([v for k, v in good.items() if rows[k[0]][2] == lang]).T])
        target = ((q[:, 1] - q[:, 0]) / 1.349) ** 2

        def shape(y, scale):
            c = scale * np.cov(y.T, bias=True)
            return (len(y) * c + quality.WEIGHT * np.diag(target)) / (len(y) + quality.WEIGHT) + np.diag(quality.RIDGE)

        inner = min(combinations(range(len(x)), int(np.ceil(quality.SHARE * len(x)))), key=lambda c: np.linalg.slogdet(shape(x[list(c)], 1.0))[1])
        y = x[list(inner)]
        k = np.linalg.inv(shape(y, quality.CONSISTENT))
        far = np.einsum("ij,jk,ik->i", x - y.mean(0), k, x - y.mean(0))
        for (_, i), d in zip(keys, far):
            assert got[i].kept == (d <= quality.CUTOFF) and abs(got[i].distance - d) <= 0.25 * max(d, 4), (i, d, got[i].distance)
    assert sorted(i for i, r in got.items() if not r.kept) == [0, 20, 40, 60, 900]


def test_quality_alike_with_salted_groups(spark, monkeypatch):
    from decisionlake.llm import quality

    docs = spark.createDataFrame(
        [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(20 + i % 30)) + " #" * (i % 3), "xy"[i % 2], "hot" if i % 3 else f"s{i % 5}") for i in range(600)],
        "doc_id long, text string, lang string, source string",
    )
    wide = {r.doc_id: r for r in quality.judged(docs, ["doc_id"]).collect()}
    monkeypatch.setattr(quality, "SMALL", 0)
    salted = {r.doc_id: r for r in quality.judged(docs, ["doc_id"]).collect()}
    assert wide.keys() == salted.keys() and len(wide) == 600
    for k, r in wide.items():
        assert r.kept == salted[k].kept and abs((r.distance or 0) - (salted[k].distance or 0)) < 1e-6 * max(1, r.distance or 0)


def test_quality_asks_few_jobs_of_the_driver(spark):
    """The driver keeps the plan of each job, and a thread for each broadcast."""

    def jobs_so_far():
        spark.sparkContext.setJobGroup(group := f"jobs-{random.random()}", "")
        try:
            spark.range(1).count()
            return max(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    docs = spark.createDataFrame([(i, words(40 + i % 50, i), "xyz"[i % 3], f"s{i % 4}") for i in range(480)], "doc_id long, text string, lang string, source string")
    before = jobs_so_far()
    assert all(r.distance is not None for r in quality.judged(docs, ["doc_id"]).collect())
    assert jobs_so_far() - before <= 25 + 6 * quality.STEPS


def jobs_of(spark, work):
    """What work() gives, and the number of Spark's jobs that it asked for."""

    def last():
        spark.sparkContext.setJobGroup(group := f"jobs-{random.random()}", "")
        try:
            spark.range(1).count()
            return max(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    before = last()
    out = work()
    return out, last() - before


def test_components_of_stars_ask_few_jobs_of_the_driver(spark):
    rows = [(10 * k + i, 10 * k) for k in range(20) for i in range(1, 6)] + [(7, None), (None, 7), (8, 8)]
    got, jobs = jobs_of(spark, lambda: common.components(spark.createDataFrame(rows, "a long, b long")))
    assert sorted(map(tuple, got.collect())) == [(10 * k + i, 10 * k) for k in range(20) for i in range(6)]
    assert jobs <= 12


def test_components_of_chains_rings_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 130)]
    r = random.Random(4)
    drawn = [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(110)]
    edges = chain + [(1, 2), (2, 3), (3, 1)] + [(50, 60), (50, 40), (70, 60)] + drawn
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    alone = {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    assert sorted(map(tuple, got)) == sorted((x, c) for x, c in root.items() if x not in alone)
    assert common.components(spark.createDataFrame([(5, 5)], "a long, b long")).count() == 0


def test_quality_ends_when_no_determinant_falls_and_takes_the_least(spark, monkeypatch):
    """Steps may go round: what counts is the least determinant of all steps."""
    r = random.Random(5)
    rows = [(f"g{k}", "en", *(r.gauss(0, 1) * (8 if i % 9 == 0 else 1) for _ in range(4))) for k in range(12) for i in range(60)]
    docs = spark.createDataFrame(rows, "_group string, _lang string, _x0 double, _x1 double, _x2 double, _x3 double")
    seen, counted = [], quality._counted

    def noted(df, tag, rows=None):
        d, n = counted(df, tag, rows)
        seen.append({(x._group, x._start): x for x in d.collect()})
        return d, n

    monkeypatch.setattr(quality, "_counted", noted)
    got = {x._group: x for x in quality.estimates(docs, 12).collect()}
    steps = seen[1:]  # the first are the starts
    assert len(steps) < quality.STEPS
    for k in range(1, len(steps)):
        falls = [key for key, x in steps[k].items() if x._logdet <= min(s[key]._logdet for s in steps[:k]) - quality.SETTLED]
        assert bool(falls) == (k + 1 < len(steps))
    for g, x in got.items():
        least = min((s[g, start] for s in steps for start in range(3)), key=lambda y: y._logdet)
        assert abs(x._m0 - least._m0) < 1e-9 and abs(x._m3 - least._m3) < 1e-9
