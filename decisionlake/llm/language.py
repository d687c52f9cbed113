"""Language identification: multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader with elastic net, then tempered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlake.llm.common import release, small, table, texts

#: Buckets of hashed n-grams, and their lengths.
BUCKETS, NGRAMS = 1 << 15, (1, 2, 3)
#: Labelled rows the classifier is fitted on at most, over all languages, and the
#: share of them kept for the temperature.
SAMPLE, CALIBRATION = 4000, 0.2
#: Languages that the weights are made for; more are an error.
LANGUAGES = 1000
#: Follow-the-regularised-leader: rate, smoothing, L1, L2, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 2e-4, 1e-4, 3
#: A document scored below this is rejected by keep_language().
MIN_SCORE = 0.5

_SLICE = 1 << 20


def has_letter(text: str) -> bool:
    """Whether a text has a character of the Unicode category L; other numerals have none."""
    return any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's n-grams over lower-cased code points."""
    total = None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(code), _SLICE):  # slices overlap, so that no n-gram is lost
        part = code[at : at + _SLICE + NGRAMS[-1] - 1]
        key = np.zeros(len(part), dtype=np.uint32)
        parts = []
        for n in range(1, NGRAMS[-1] + 1):
            m = min(len(part) - n + 1, _SLICE)
            if m <= 0:
                break
            key = key[:m] * np.uint32(0x01000193) + part[n - 1 : n - 1 + m] + np.uint32(n)
            if n in NGRAMS:
                parts.append(((key * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32))
            if at + _SLICE >= len(code):
                continue
        got = np.bincount(np.concatenate(parts), minlength=BUCKETS)
        total = got if total is None else total + got
    if total is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    at = np.flatnonzero(total)
    return at, total[at].astype(np.float64)


@dataclass(frozen=True)
class Model:
    """labels: sorted classes; idf: by bucket; weights: bucket by class; bias; temperature."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts(text)
        x = (1.0 + np.log(n)) * self.idf[at]
        return at, x / max(float(np.sqrt(x @ x)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not has_letter(text):
            return "und", 0.0
        at, x = self.vector(text)
        p = _softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learned(doc_id: Column, lang: Column) -> Column:
    """Whether a row may be learned from: it has a language and is not held out."""
    return lang.isNotNull() & ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all rows (text) each bucket occurs, and the number of rows;
    one vector a task, summed by Spark: the driver gets a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total, n = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for batch in small(batches):
            for text in texts(batch):
                total[counts(text)[0]] += 1
                n += 1
        total[BUCKETS] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    got = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    df[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return df[:BUCKETS], int(df[BUCKETS])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on (doc_id, text, lang). Document frequencies cover every row that may be
    learned from; the classifier is fitted on at most about ``sample`` of them, an
    equal number a language, those of the smallest hash of doc_id and text, and on twice as
    many at most where rows repeat each other. Without a row to learn from the model has no
    language and predicts ``und``; more than LANGUAGES languages are an error."""
    rows = docs.select("doc_id", "text", "lang").where(learned(F.col("doc_id"), F.col("lang")))
    sizes = {lang: n for lang, n in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    labels = sorted(sizes)
    df, n = document_frequencies(rows)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    empty = Model(labels, idf, np.zeros((BUCKETS, len(labels))), np.zeros(len(labels)), 1.0)
    if not labels:
        return empty
    share = F.create_map(*[F.lit(v) for lang in labels for v in (lang, min(1.0, sample / len(labels) / sizes[lang]))])
    place = (F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("sample")).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    picked = rows.select(place.alias("place"), "lang", "text").where(F.col("place") < share[F.col("lang")])
    picked = picked.orderBy(F.col("place") / share[F.col("lang")], "lang").limit(2 * sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [empty.vector(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([a.astype("<u2").tobytes() for a, _ in made], pa.binary()),
                    pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary()),
                ],
                ["place", "lang", "at", "x"],
            )

    got = picked.mapInArrow(run, "place double, lang string, at binary, x binary").toArrow().to_pylist()
    code = {lang: i for i, lang in enumerate(labels)}
    got = sorted(got, key=lambda r: (r["place"], r["lang"], bytes(r["at"])))
    data = [(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["x"], "<f4"), code[r["lang"]]) for r in got]
    kept = int(len(data) * CALIBRATION)
    model = fit(labels, idf, data[kept:] or data, data[:kept])
    del got, data
    release()
    return model


def fit(labels: list[str], idf: np.ndarray, data: list, calibration: list) -> Model:
    """Per-coordinate follow-the-regularised-leader over the rows in order, PASSES
    times; the bias is a coordinate that is not penalised."""
    k = len(labels)
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    bz, bn = np.zeros(k), np.zeros(k)

    def closed(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(PASSES):
        for at, x, y in data:
            zs, ns = z[at], n[at]
            w = closed(zs, ns)
            b = -bz * ALPHA / (BETA + np.sqrt(bn))
            p = _softmax(x @ w + b)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            g2 = g * g
            z[at] = zs + g - (np.sqrt(ns + g2) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g2
            bz += p - (np.sqrt(bn + p * p) - np.sqrt(bn)) / ALPHA * b
            bn += p * p
    weights, bias = closed(z, n), -bz * ALPHA / (BETA + np.sqrt(bn))
    temperature = 1.0
    if calibration:
        logits = np.array([x @ weights[at] + bias for at, x, _ in calibration])
        target = np.array([y for *_, y in calibration])

        def loss(t: float) -> float:
            return -float(np.log(np.maximum(_softmax(logits / t)[np.arange(len(target)), target], 1e-12)).mean())

        grid = np.exp(np.linspace(np.log(0.05), np.log(20.0), 121))
        temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return Model(labels, idf, weights, bias, temperature)


def predict(rows: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """rows with a text column, plus lang_pred and score; ``names`` are kept as they are."""
    schema = rows.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of a fixed size: BUCKETS by classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared.value
        for batch in small(batches, "_text"):
            got = [model.predict(t) for t in batch.column(len(names)).to_pylist()]
            pred, score = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                [*names, "lang_pred", "score"],
            )

    return rows.select(*names, F.col("text").alias("_text")).mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Language of each document (doc_id, text, lang).

    Learned only from text and non-null lang of rows that are not held out
    (crc32(doc_id) mod 4 is not 2; a null doc_id counts as empty). Predicted from the
    whole text alone. ``und`` with score 0 for null texts and texts without a letter.
    Repeated rows each give a row; an empty table none.
    """
    model = train(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])


def keep_language(docs: DataFrame) -> DataFrame:
    """The documents, in their own columns, whose language is known: not ``und`` and
    scored MIN_SCORE or more."""
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared.value
        for batch in small(batches):
            got = [model.predict(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array([p != "und" and s >= MIN_SCORE for p, s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify(table(spark, sf_dir, "documents"))
