"""The corpus pipeline over planted rows: nulls, repeats, an extra column, an empty table."""

import collections
import random
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, sounds, n=70):
    r = random.Random(seed)
    return " ".join("".join(r.choice(sounds) for _ in range(r.randrange(2, 5))) for _ in range(n))


def planted():
    sounds = {"en": ["th", "er", "ing", "wh", "sh", "ou", "an"], "fr": ["eau", "que", "oi", "é", "les", "ai", "un"]}
    rows = [(100 * k + i, prose(1000 * k + i, s), lang, f"src{i % 2}") for k, (lang, s) in enumerate(sounds.items()) for i in range(60)]
    first = rows[3][1]
    passage = prose(7777, sounds["en"], 60)
    rows += [(1000, first, "en", "src1"), (1001, first, None, None), (1002, None, "en", "src0"), (1003, "", "fr", "src1"), (1004, "too short", "en", "src0"), (1005, "the same five words here " * 20, "en", "src0"), (1006, "12345 67890 !!", "en", "src0")]
    rows += [(2000 + i, prose(500 + i, sounds["en"], 20) + " " + passage, "en", "src0") for i in range(2)]
    rows += [(3, first, "en", "src1")]  # a repeated row
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]


def stages(spark, docs, folder):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, out[-1], folder)
        d.write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_stages_take_effect_and_pieces_cover_the_texts(spark, tmp_path):
    rows = planted()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as kept")
    out = stages(spark, docs, str(tmp_path))
    for d in out[1:-1]:
        assert d.columns == docs.columns
    ids = [sorted((r.doc_id for r in d.select("doc_id").collect()), key=str) for d in out]
    assert not {1002, 1003, 1006} & set(ids[1])  # no letters, no language
    assert {1004, 1005} <= set(ids[1]) and not {1004, 1005} & set(ids[2])
    clean = [r[0] for r in rows[:120]]
    assert len(set(clean) & set(ids[2])) >= 0.8 * len(clean)
    copies = [i for i in ids[2] if i in (3, 1000, 1001)]
    assert len(copies) >= 3 and len([i for i in ids[3] if i in (3, 1000, 1001)]) == 1
    assert ids[4] == ids[3]
    texts = {r.doc_id: r.text or "" for r in out[4].collect()}
    if {2000, 2001} <= set(ids[4]):
        passage = planted()[-2][1].split(" ", 20)[20]
        assert passage in texts[2000] and passage not in texts[2001]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in out[5].collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        want = t.encode(text, add_special_tokens=False).ids + [1]
        got = sorted(pieces[i], key=lambda r: r.start)
        assert sum(r.length for r in got) == len(want) == got[0].doc_tokens
        for r in got:
            part = want[r.start : r.start + r.length]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_nothing_gives_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
