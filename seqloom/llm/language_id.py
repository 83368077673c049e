"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, what is no letter counts as a blank, and the n-grams of 1 to 3
characters are hashed into `buckets` features. Document frequencies are counted over all
training documents. The weights are learned on the driver by follow-the-regularised-leader
with an elastic net, from at most `sample_rows` labelled rows (the bound of the sample, spread
evenly over the languages by a hash), and a temperature fitted on a part of that sample which
the weights haven't seen calibrates the probabilities. Every text is scored whole.

Nulls: a null text, or one without a letter, is `und` with score 0; rows with a null lang
teach nothing; a null doc_id counts as an empty string for the split. Without training rows
every text is `und`. Repeated rows count each, and an empty table gives none. Texts of any length are
read whole. Other columns play no part, whatever their names; accepted() carries them along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, NGRAMS, SAMPLE_ROWS, UNKNOWN = 1 << 15, 3, 4000, "und"
_LETTER = re.compile("[A-Za-z]")
#: Odd multipliers that mix the characters of an n-gram.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or any(map(str.isalpha, set(text))))


def counts(text: str, buckets: int = BUCKETS, ngrams: int = NGRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of a text, buckets ascending."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(cp < 128, _ASCII[np.minimum(cp, 127)], cp).astype(np.uint64)
    shift, mixed, found = np.uint64(64 - buckets.bit_length() + 1), np.zeros(len(cp), np.uint64), []
    for n in range(1, ngrams + 1):
        if len(cp) < n:
            break
        # the n-gram that starts at i: what the shorter one had, and one more character
        mixed = (mixed[: len(cp) - n + 1] + cp[n - 1 :] + np.uint64(n)) * np.uint64(_MIX[(n - 1) % len(_MIX)])
        mixed ^= mixed >> np.uint64(29)
        found.append((mixed * np.uint64(_MIX[0])) >> shift)
    all_counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=buckets)
    at = np.flatnonzero(all_counts)
    return at, all_counts[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (buckets + 1, languages); the last row is the bias
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts(text, len(self.idf))
        x = (1 + np.log(n)) * self.idf[at]
        return np.append(at, len(self.idf)), np.append(x / max(1e-12, np.sqrt(x @ x)), 1.0)

    def logits(self, text: str) -> np.ndarray:
        at, x = self.vector(text)
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4, seed: int = 7) -> np.ndarray:
    """Weights (features, classes) by FTRL-proximal; the last feature, the bias, has no penalty."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))
    rng = np.random.default_rng(seed)

    def weights(at) -> np.ndarray:
        own = z[at]
        w = -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(own) <= l1, 0.0, w)

    def bias() -> np.ndarray:
        return -z[-1] / ((beta + np.sqrt(n[-1])) / alpha)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            w[-1] = bias()
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    out = weights(slice(None))
    out[-1] = bias()
    return out


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()

    a, b, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def frequencies(rows: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Document frequency of each bucket over all rows(text), and their number."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(buckets + 1, np.int64)
        for batch in common.sliced(batches):
            for text in batch.column(0):
                text = text.as_py()
                if has_letter(text):
                    df[counts(text, buckets)[0]] += 1
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "n"])

    total = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(buckets + 1, np.int64)
    for r in total.collect():  # at most buckets + 1 rows
        df[r["bucket"]] = r["n"]
    return df[:-1], int(df[-1])


def sample(rows: DataFrame, most: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """About `most` (lang, text), never over twice that, as evenly over languages as there are rows."""
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return []
    left, share, todo = most, {}, sorted(sizes, key=sizes.get)
    for i, lang in enumerate(todo):
        share[lang] = min(sizes[lang], max(1, left // (len(todo) - i)))
        left -= share[lang]
    cut = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v / sizes[k])])
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    found = rows.filter(at < F.element_at(cut, F.col("lang"))).select("lang", "text").limit(2 * most).collect()
    return sorted((r["lang"], r["text"]) for r in found)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> Model:
    """A model from those docs(doc_id, text, lang) that aren't held out and have a lang."""
    rows = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = [x for x in sample(rows, sample_rows) if has_letter(x[1])]
    if not chosen:
        return Model([], np.zeros(buckets), np.zeros((buckets + 1, 0)))
    df, n = frequencies(rows, buckets)
    langs = sorted({x[0] for x in chosen})
    model = Model(langs, np.log((1 + n) / (1 + df)) + 1, np.zeros((buckets + 1, len(langs))))
    data = [(*model.vector(text), langs.index(lang)) for lang, text in chosen]
    order = np.random.default_rng(11).permutation(len(data))
    apart = set(order[: len(data) // 5].tolist()) if len(data) >= 20 else set()
    model.weights = ftrl([x for i, x in enumerate(data) if i not in apart], buckets + 1, len(langs))
    if apart:
        z = np.array([data[i][1] @ model.weights[data[i][0]] for i in sorted(apart)])
        model.temperature = temperature(z, np.array([data[i][2] for i in sorted(apart)]))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; only text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in common.sliced(batches):
            got = [m.predict(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return predict(docs, train(docs, sample_rows))


def accepted(docs: DataFrame, model: Model, min_score: float = 0.0) -> DataFrame:
    """docs whose language is known and predicted with at least min_score."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in common.sliced(batches):
            got = [m.predict(x.as_py()) for x in batch.column("text")]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, schema)
