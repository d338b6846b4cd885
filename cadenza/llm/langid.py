"""Language identification with sparse multinomial logistic regression.

Features are hashed n-grams of lower-cased characters (ASCII other than letters
reads as a space), weighted by TF-IDF with tf the share among the text's n-grams
of that length.  Document frequencies come from all training rows.  Weights are
learned by follow-the-regularised-leader with elastic-net penalties on at most
``SAMPLE`` training rows, a fifth of which only sets the temperature that makes
the scores honest.  As tf is a share, a text's score is the mean of a table look-up
over its characters: prediction is one narrow pass and needs no sparse vectors.

At scale: two narrow passes over the texts; what is broadcast is the weight table
of ``2**BITS`` buckets by the number of languages, whatever the input.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is
every text where nothing could be learned; null ids count as empty strings for
the fold; a language that the sample misses, as one with fewer than some
1 in ``SAMPLE`` of the training rows may be, is never predicted; very short texts are scored as they are; repeated rows each get a row;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .runtime import arrow_map, batch, ship

BITS, ORDERS, SAMPLE, SCALE = 15, (2, 3), 3000, 50.0
_FOLD = np.array([c if 97 <= c < 123 else 32 for c in range(128)], np.uint32)
_P = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)


def chars(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts end to end, and offsets."""
    parts = [(x or "").lower().encode("utf-32-le", "replace") for x in texts]
    offs = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=offs[1:])
    cp = np.frombuffer(b"".join(parts), np.uint32)
    return np.where(cp < 128, _FOLD[np.minimum(cp, 127)], cp), offs


def buckets(cp: np.ndarray, offs: np.ndarray, n: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram inside a text, and the offsets of the texts among them."""
    size = np.maximum(np.diff(offs) - n + 1, 0)
    at = np.zeros(len(offs), np.int64)
    np.cumsum(size, out=at[1:])
    if not at[-1]:
        return np.zeros(0, np.uint32), at
    h = cp[: len(cp) - n + 1] * _P[0]
    for j in range(1, n):
        h = h + cp[j : len(cp) - n + 1 + j] * _P[j]
    h ^= h >> np.uint32(15)
    h = ((h + np.uint32(n)) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)
    if len(h) != at[-1]:
        first = np.repeat(offs[:-1] - at[:-1], size) + np.arange(at[-1])
        h = h[first]
    return h, at


def _slices(col: pa.Array):
    for t in bk.slices(col, 1 << 18):
        yield t, col.slice(t.lo, len(t)).to_pylist()


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each bucket of each order occurs, and their number; counted on the executors."""

    def run(batches):
        df, total = np.zeros(len(ORDERS) << BITS, np.int64), 0
        for b in batches:
            for t, values in _slices(b.column(0)):
                for lo in range(0, len(values), 32):
                    cp, offs = chars(values[lo : lo + 32])
                    total += len(offs) - 1
                    for i, n in enumerate(ORDERS):
                        h, at = buckets(cp, offs, n)
                        seen = np.zeros((len(offs) - 1, 1 << BITS), bool)
                        seen[np.repeat(np.arange(len(offs) - 1), np.diff(at)), h] = True
                        df[i << BITS : (i + 1) << BITS] += seen.sum(axis=0)
        at = np.flatnonzero(df)
        yield batch(["b", "n"], [np.append(at, -1).astype(np.int32), np.append(df[at], total)])

    ship(texts.sparkSession)
    rows = texts.mapInArrow(run, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n"))
    out, total = np.zeros(len(ORDERS) << BITS, np.int64), 0
    for b, n in rows.collect():  # at most one row a bucket
        if b < 0:
            total = n
        else:
            out[b] = n
    return out, total


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (buckets of all orders, languages), weights times idf
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list) -> np.ndarray:
        cp, offs = chars(texts)
        z = np.tile(self.bias.astype(np.float64), (len(texts), 1))
        for i, n in enumerate(ORDERS):
            h, at = buckets(cp, offs, n)
            size = np.diff(at)
            full = np.flatnonzero(size)
            if len(full):
                z[full] += np.add.reduceat(self.table[(i << BITS) + h.astype(np.int64)], at[full], axis=0, dtype=np.float64) / size[full, None]
        return z

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        names, score = [], np.zeros(len(texts))
        if self.langs and texts:
            z = self.logits(texts) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best, score = p.argmax(axis=1), p.max(axis=1)
        for i, x in enumerate(texts):
            if not self.langs or not x or not any(c.isalpha() for c in x):
                names.append("und")
                score[i] = 0.0
            else:
                names.append(self.langs[best[i]])
        return names, score


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, classes: int, l1: float, l2: float, alpha: float = 0.3, beta: float = 1.0, epochs: int = 3, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size, classes) and biases by per-coordinate FTRL-proximal steps on the softmax loss."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, x = rows[r]
            zi, ni = z[i], n[i]
            w, b = weights(zi, ni, l1), weights(zb, nb, 0.0)
            s = x @ w + b
            g = np.exp(s - s.max())
            g /= g.sum()
            g[y[r]] -= 1
            gi = x[:, None] * g[None, :]
            new = ni + gi * gi
            z[i] = zi + gi - (np.sqrt(new) - np.sqrt(ni)) / alpha * w
            n[i] = new
            nnb = nb + g * g
            zb += g - (np.sqrt(nnb) - np.sqrt(nb)) / alpha * b
            nb = nnb
    return weights(z, n, l1), weights(zb, nb, 0.0)


def calibrate(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search over its logarithm."""

    def loss(t):
        s = z / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def term_frequencies(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, tf, count of buckets of each text) of whole texts."""
    found, tf, size = [], [], np.zeros(len(texts), np.int64)
    for r, x in enumerate(texts):
        cp, offs = chars([x])
        for i, n in enumerate(ORDERS):
            h, _ = buckets(cp, offs, n)
            b, c = np.unique(h.astype(np.int32) + (i << BITS), return_counts=True)
            found.append(b.astype(np.int32))
            tf.append((c / max(len(h), 1)).astype(np.float32))
            size[r] += len(b)
    return np.concatenate([np.zeros(0, np.int32), *found]), np.concatenate([np.zeros(0, np.float32), *tf]), size


def fit(bucket: np.ndarray, tf: np.ndarray, size: np.ndarray, langs: list[str], df: np.ndarray, total: int, l1: float = 0.02, l2: float = 0.1) -> Model:
    """Train on sparse rows laid end to end; every fifth one only calibrates."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((len(ORDERS) << BITS, 0), np.float32), np.zeros(0), 1.0)
    y = np.array([names.index(x) for x in langs])
    idf = np.log((1 + total) / (1 + df)) + 1
    value = tf * idf[bucket] * SCALE
    at = np.concatenate([[0], np.cumsum(size)])
    rows = [(bucket[at[i] : at[i + 1]], value[at[i] : at[i + 1]]) for i in range(len(size))]
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 25 else np.zeros(len(rows), bool)
    w, bias = ftrl([r for r, h in zip(rows, held, strict=True) if not h], y[~held], len(ORDERS) << BITS, len(names), l1, l2)
    model = Model(names, (w * idf[:, None] * SCALE).astype(np.float32), bias, 1.0)
    if held.any():
        z = np.stack([v @ w[b] + bias for (b, v), h in zip(rows, held, strict=True) if h])
        model.temperature = calibrate(z, y[held])
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of the rows that are not held out."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    df, total = document_frequency(rows.select("text"))
    # the sample is chosen by hashes alone, so that no task gathers texts
    keyed = rows.select("lang", "text", F.xxhash64("doc_id", "text", "lang").alias("k"))
    least = keyed.select("k").distinct().orderBy("k").limit(sample)
    chosen = keyed.join(F.broadcast(least), "k", "left_semi").dropDuplicates(["k"]).select("k", "lang", "text")

    def run(b: pa.RecordBatch):
        bucket, tf, size = term_frequencies(b.column(2).to_pylist())
        yield batch(["k", "lang", "bucket", "tf"], [b.column(0), b.column(1), bk.lists(bucket, size), bk.lists(tf, size)])

    got = arrow_map(chosen, run, "k bigint, lang string, bucket array<int>, tf array<float>").toArrow().sort_by("k")
    bucket, tf = (got[c].combine_chunks() for c in ("bucket", "tf"))
    return fit(bucket.flatten().to_numpy(), tf.flatten().to_numpy(), np.diff(bucket.offsets.to_numpy()) if len(bucket) else np.zeros(0, np.int64), got["lang"].to_pylist(), df, total)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch):
        names, scores = [], []
        for _, values in _slices(b.column(2)):
            n, s = shared.value.predict(values)
            names += n
            scores.append(s)
        yield batch(["doc_id", "held_out", "lang_pred", "score"], [b.column(0), b.column(1), pa.array(names, pa.string()), np.concatenate(scores)])

    src = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(src, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op9_ftrl_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
