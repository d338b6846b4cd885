"""Quality classification by ordinal cumulative-link regression.

Grades are ordered (here: toxic, poor, good).  One weight vector over hashed
text features is shared by all grades; ordered thresholds split its score:
P(grade <= k) = sigmoid(threshold_k - w.x).  From them come the expected grade and
the tail probability by which documents are selected.

Features are presence flags: hashed words and word stems, and hashed steps of text statistics
(share of distinct words, of letters, of symbols, ...), which words cannot show.

At scale: training rows are at most ``SAMPLE`` labelled documents, chosen by a hash
of the id, one text each, of which only bucket numbers reach the driver.  Scoring is one narrow
pass; the broadcast weight table has ``2**BITS`` entries whatever the input.

Edge cases: a null or empty text has only its statistics; without two grades
nothing is learned and all rows are kept; several labels of one id count as the
lowest grade; of several texts of one id the one with the least hash teaches;
labels with a null grade or id are ignored; repeated rows are scored one by one; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from . import rules
from .runtime import arrow_map, batch

BITS, SAMPLE, MIN_DOCS = 18, 10_000, 5
#: Longer words also count by so many leading bytes; statistics get so many buckets each, as there are few of them.
STEMS, COPIES = (4, 5), 8
#: A document stays if P(grade >= the highest) is at least this.
KEEP_AT = 0.5


def _ratios(m: np.ndarray) -> np.ndarray:
    d = {c: m[:, i].astype(float) for i, c in enumerate(rules.COUNTS)}
    one = lambda v: np.maximum(v, 1)
    return np.stack([
        d["word_chars"] / one(d["n_words"]) / 20, d["n_symbols"] / one(d["n_words"]), d["n_dup_lines"] / one(d["n_lines"]),
        d["n_repeat_words"] / one(d["n_words"]), d["n_upper"] / one(d["n_letters"]), d["n_digits"] / one(d["word_chars"]),
        d["n_letters"] / one(d["word_chars"]), d["n_stops"] / one(d["n_words"]), d["n_shouts"] / one(d["n_words"]), d["n_distinct_words"] / one(d["n_words"]),
    ], axis=1)


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all texts end to end, without repeats in a text, and how many each has."""
    out, sizes = [], []
    shift = np.uint64(64 - BITS)
    for t in bk.slices(col):
        w = bk.words(t)
        doc = np.repeat(np.arange(len(t)), w.counts)
        pre = bk.byte_prefix(bk.LOWER[t.buf])
        keys = [(doc << BITS) | (w.hash >> shift).astype(np.int64)]
        for n in STEMS:
            longer = np.flatnonzero(w.end - w.start > n)
            h = bk.mix(bk.span_hash(pre, w.start[longer], w.start[longer] + n) + np.uint64(n))
            keys.append((doc[longer] << BITS) | (h >> shift).astype(np.int64))
        step = np.minimum(np.clip(_ratios(rules.measure(t)), 0, 1) * 20, 19).astype(np.uint64)
        for copy in range(COPIES):
            stat = bk.mix(step + (np.arange(step.shape[1], dtype=np.uint64) << np.uint64(8)) + np.uint64((copy + 1) << 20)) >> shift
            keys.append(((np.arange(len(t)) << BITS)[:, None] | stat.astype(np.int64)).ravel())
        key = np.concatenate(keys)
        key = np.unique(key)
        out.append((key & ((1 << BITS) - 1)).astype(np.int32))
        sizes.append(np.bincount(key >> BITS, minlength=len(t)))
    return np.concatenate([np.zeros(0, np.int32), *out]), np.concatenate([np.zeros(0, np.int64), *sizes])


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, bucket: np.ndarray, size: np.ndarray) -> np.ndarray:
        """P(grade > k) for every text and threshold k."""
        score, full = np.zeros(len(size)), np.flatnonzero(size)
        if len(full):  # each text summed by itself: its score must not depend on its neighbours
            score[full] = np.add.reduceat(self.weights[bucket], (np.cumsum(size) - size)[full])
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _minimise(fun, p: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking; fun gives value and gradient."""
    f, g = fun(p)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, back = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            back.append(a)
            q -= a * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(pairs, reversed(back), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step = 1.0
        while (new := fun(p - step * q))[0] > f - 1e-4 * step * (g @ q) and step > 1e-6:
            step /= 2
        s, y = -step * q, new[1] - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        p, done = p + s, abs(f - new[0]) < 1e-7 * max(1.0, abs(f))
        f, g = new
        if done:
            break
    return p


def fit(bucket: np.ndarray, size: np.ndarray, grade: np.ndarray, grades: int, l2: float = 0.0005, steps: int = 80) -> Model:
    """Penalised maximum likelihood; thresholds are a first one plus positive gaps, so that they stay in order."""
    seen = np.bincount(bucket, minlength=1 << BITS) >= MIN_DOCS
    doc = np.repeat(np.arange(len(size)), size)[seen[bucket]]
    ids, col = np.unique(bucket[seen[bucket]], return_inverse=True)
    n, k = len(size), len(ids)
    rows = np.arange(n)
    cum = np.array([(grade <= g).mean() for g in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log(cum / (1 - cum))

    def thresholds(p):
        return p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))])

    def loss(p):
        score = np.bincount(doc, weights=p[col], minlength=n)
        c = np.concatenate([np.zeros((n, 1)), _sigmoid(thresholds(p)[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
        d = c * (1 - c)
        like = np.maximum(c[rows, grade + 1] - c[rows, grade], 1e-12)
        hi, lo = d[rows, grade + 1] / like, d[rows, grade] / like
        g_theta = np.array([(lo[grade == g + 1].sum() - hi[grade == g].sum()) / n for g in range(grades - 1)])
        g_gaps = np.exp(p[k + 1 :]) * np.cumsum(g_theta[::-1])[::-1][1:]
        g = np.concatenate([np.bincount(col, weights=((hi - lo) / n)[doc], minlength=k) + l2 * p[:k], [g_theta.sum()], g_gaps])
        return -np.log(like).mean() + l2 / 2 * (p[:k] @ p[:k]), g

    p = _minimise(loss, np.concatenate([np.zeros(k), start[:1], np.log(np.maximum(np.diff(start), 1e-2))]), steps)
    weights = np.zeros(1 << BITS)
    weights[ids] = p[:k]
    return Model(weights, thresholds(p))


def _src(docs: DataFrame, *more) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *more)


def train(docs: DataFrame, graded: DataFrame, grades: int = 3, sample: int = SAMPLE) -> Model | None:
    """Learn from (doc_id, grade) with grades 0 .. grades - 1."""
    marks = graded.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").cast("int").alias("_grade"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = rules.one_text_each(docs, chosen)

    def run(b: pa.RecordBatch):
        bucket, size = features(b.column(1))
        yield batch(["doc_id", "grade", "bucket"], [b.column(0), b.column(2), bk.lists(bucket, size, pa.int32())])

    rows = rows.select("doc_id", "text", "_grade")

    got = arrow_map(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, bucket array<int>").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    grade = got["grade"].to_numpy()
    if len(np.unique(grade)) < 2:
        return None
    lists_ = got["bucket"].combine_chunks()
    return fit(lists_.flatten().to_numpy(), np.diff(lists_.offsets.to_numpy()), grade, grades)


def score(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, text_hash, expected_grade, p_top (tail probability of the highest grade), kept of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = _src(docs, F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    if model is None:
        return src.select("doc_id", "text_hash", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("p_top"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch):
        tails = shared.value.tails(*features(b.column(1)))
        yield batch(["doc_id", "text_hash", "expected_grade", "p_top", "kept"], [b.column(0), b.column(2), tails.sum(axis=1), np.ascontiguousarray(tails[:, -1]), tails[:, -1] >= keep_at])

    return arrow_map(src, run, f"doc_id {kind}, text_hash bigint, expected_grade double, p_top double, kept boolean")


def select(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows that the model keeps, with all their columns, in one pass and without a shuffle."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch):
        text = b.column(at) if pa.types.is_string(b.column(at).type) or pa.types.is_large_string(b.column(at).type) else b.column(at).cast(pa.string())
        keep = shared.value.tails(*features(text))[:, -1] >= keep_at
        yield b.filter(pa.array(keep))

    return arrow_map(docs, run, docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Ratings of the labels table: 0 toxic, 1 poor, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).when(F.col("quality") > 0, 2).alias("grade"))


def op2_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, grades_of(labels))).select("doc_id", "expected_grade", "p_top", "kept")
