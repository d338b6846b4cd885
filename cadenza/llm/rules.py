"""Quality rules: a decision list learned from labelled statistics.

``text_statistics`` measures every text in one pass.  ``learn`` is sequential
covering in the manner of incremental reduced-error pruning: a rule grows one
threshold at a time by information gain on two thirds of the examples, is pruned
from its end on the other third, and is kept while its precision there is high
enough; the examples it covers leave and the next rule starts.  ``verdict`` turns
the list into one ordered Spark conditional expression.

At scale: one narrow pass over the texts, no shuffle but for the labelled sample
(at most ``SAMPLE`` ids, chosen by a hash of the id, one text each), which alone reaches the
driver, as numbers.

Edge cases: a null or empty text has no words and fails the base rule; without
labels the list is empty and keeps all; conflicting labels of one id count as
bad; of several texts of one id the one with the least hash teaches; null labels and
labels without a document are ignored; rows that repeat an id are judged one by one; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .runtime import arrow_map, batch

SAMPLE = 20_000  # labelled rows at most
SYMBOLS = bk.byte_class(b"#*$%&|<>", False)
_UPPER = bk.byte_class(bytes(range(65, 91)), False)
_DIGIT = bk.byte_class(b"0123456789", False)
_ALPHA = bk.byte_class(bytes([*range(65, 91), *range(97, 123)]), True)
_STOPS = bk.byte_class(b".!?", False)
_SHOUT = bk.byte_class(b"!", False)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_letters", "n_stops", "n_shouts", "n_distinct_words"]
#: What rules may test: counts made comparable between texts of any length.
RATIOS = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "shouts_per_word": "n_shouts / greatest(n_words, 1)",
    "distinct_word_share": "n_distinct_words / greatest(n_words, 1)",
}


def _sums(table: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(table[buf], out=at[1:])
    return np.diff(at[offs])


def _repeats(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags over (document, key): equal to an earlier one; found twice or more."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    later = np.zeros(len(key), bool)
    later[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    any_ = later.copy()
    any_[:-1] |= later[1:]
    a, b = np.empty_like(later), np.empty_like(later)
    a[order], b[order] = later, any_
    return a, b


def measure(t: bk.Texts, window: int = 5) -> np.ndarray:
    """One row of COUNTS for each text."""
    buf, offs = t.buf, t.offs
    if not len(buf):
        return np.zeros((len(t), len(COUNTS)), np.int64)
    inside = bk.NONSPACE[buf]
    w = bk.words(t, lower=False, table=bk.NONSPACE)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(inside & ((buf & 0xC0) != 0x80), out=chars[1:])
    start, end = bk.spans(buf != 10, offs)
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    full = total[end] > total[start]
    start, end = start[full], end[full]
    line_doc = np.searchsorted(offs, start, "right") - 1
    # a document index is right even after empty documents: the last offset not above the start
    later, _ = _repeats(bk.span_hash(bk.byte_prefix(buf), start, end), line_doc)
    first, doc, h = bk.ngrams(w.hash, w.bounds, window)
    _, twice = _repeats(h, doc)
    edge = np.zeros(len(w.hash) + window + 1, np.int64)
    hit = first[twice]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    covered = np.zeros(len(w.hash) + 1, np.int64)
    np.cumsum(np.cumsum(edge)[: len(w.hash)] > 0, out=covered[1:])
    word_doc = np.repeat(np.arange(len(t)), w.counts)
    again, _ = _repeats(w.hash, word_doc)
    count = lambda at: np.bincount(at, minlength=len(t))
    return np.stack([
        w.counts, np.diff(chars[offs]), _sums(SYMBOLS, buf, offs), count(line_doc[later]), np.diff(covered[w.bounds]),
        count(line_doc), _sums(_UPPER, buf, offs), _sums(_DIGIT, buf, offs), np.diff(np.concatenate([[0], np.cumsum(_ALPHA[buf] & ((buf & 0xC0) != 0x80))])[offs]),
        _sums(_STOPS, buf, offs), _sums(_SHOUT, buf, offs), w.counts - count(word_doc[again]),
    ], axis=1)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row."""

    def run(b: pa.RecordBatch):
        m = np.concatenate([measure(t) for t in bk.slices(b.column(1))])
        yield batch(["doc_id", *COUNTS], [b.column(0), *(np.ascontiguousarray(m[:, i]) for i in range(len(COUNTS)))])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return arrow_map(src, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS))


@dataclass(frozen=True)
class Test:
    feature: int
    above: bool
    at: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.at if self.above else x[:, self.feature] <= self.at


def _holds(rule: list[Test], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _best_test(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, Test | None]:
    """The threshold with the largest gain: covered positives times what each gains in bits."""
    base, best = np.log2(y.mean()), (1e-9, None)
    for f, at in enumerate(cuts):
        order = np.argsort(x[:, f], kind="stable")
        v, pos = x[order, f], np.concatenate([[0], np.cumsum(y[order])])
        low = np.searchsorted(v, at, "right")
        for above, n, p in ((False, low, pos[low]), (True, len(v) - low, pos[-1] - pos[low])):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - base), -1.0)
            i = int(np.argmax(gain)) if len(gain) else -1
            if i >= 0 and gain[i] > best[0]:
                best = (float(gain[i]), Test(f, above, float(at[i])))
    return best


def learn(x: np.ndarray, y: np.ndarray, precision: float = 0.95, min_cover: int = 5, max_tests: int = 4, max_rules: int = 20, tries: int = 8, seed: int = 7) -> list[list[Test]]:
    """An ordered list of conjunctions that say bad; y is 1 for bad examples.  A rule that fails is grown again from another split, ``tries`` times in all."""
    rules: list[list[Test]] = []
    failed = 0
    keep = np.arange(len(y))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.005, 0.995, 100))) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    while len(rules) < max_rules and failed < tries and y[keep].sum() >= min_cover:
        shuffled = rng.permutation(keep)
        grow, prune = shuffled[: 2 * len(keep) // 3], shuffled[2 * len(keep) // 3 :]
        rule: list[Test] = []
        inside = grow
        while len(rule) < max_tests and 0 < y[inside].sum() < len(inside):
            _, test = _best_test(x[inside], y[inside], cuts)
            if test is None:
                break
            rule.append(test)
            inside = inside[test.holds(x[inside])]
        worth = []
        for n in range(1, len(rule) + 1):  # pruning: the prefix with the best (p - n) / (p + n) on unseen examples
            c = y[prune][_holds(rule[:n], x[prune])]
            worth.append((2 * c.sum() - len(c)) / max(len(c), 1))
        if not worth:
            failed += 1
            continue
        rule = rule[: int(np.argmax(worth)) + 1]
        seen = y[keep][_holds(rule, x[keep])]
        unseen = y[prune][_holds(rule, x[prune])]
        if len(seen) < min_cover or seen.mean() < precision or (len(unseen) and unseen.mean() < precision):
            failed += 1
            continue
        rules.append(rule)
        keep = keep[~_holds(rule, x[keep])]
    return rules


def one_text_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents of the chosen ids (a bounded table) with its columns; of several texts of one id the one with the least hash, as often as it occurs."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_hash")).join(F.broadcast(chosen), "doc_id")
    least = rows.groupBy("doc_id").agg(F.min("_hash").alias("_hash"))
    return rows.join(F.broadcast(least), ["doc_id", "_hash"])


def examples(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Ratios and bad flags of at most ``sample`` labelled documents."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") <= 0).cast("int").alias("bad"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = text_statistics(one_text_each(docs, chosen)).dropDuplicates(["doc_id"]).join(F.broadcast(chosen), "doc_id").selectExpr(*(f"double({e}) AS {n}" for n, e in RATIOS.items()), "bad")
    got = np.array([tuple(r) for r in rows.collect()], float).reshape(-1, len(RATIOS) + 1)  # at most ``sample`` rows
    got = got[np.lexsort(got.T)]  # the order of rows from executors must not matter
    return got[:, :-1], got[:, -1]


def verdict(rules: list[list[Test]]) -> tuple[Column, Column]:
    """(kept, number of the rule that fired or null) over COUNTS, as ordered conditionals."""
    kept, fired = F.lit(True), F.lit(None).cast("int")
    names = list(RATIOS)
    for i, rule in reversed(list(enumerate(rules))):
        cond = F.lit(True)
        for t in rule:
            x = F.expr(RATIOS[names[t.feature]])
            cond = cond & ((x > t.at) if t.above else (x <= t.at))
        kept, fired = F.when(cond, False).otherwise(kept), F.when(cond, i).otherwise(fired)
    return kept, fired


def describe(rules: list[list[Test]]) -> list[str]:
    names = list(RATIOS)
    return ["bad if " + " and ".join(f"{names[t.feature]} {'>' if t.above else '<='} {t.at:.6g}" for t in rule) for rule in rules]


def apply_rules(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """COUNTS, base_failed, kept and rule of every row."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept, fired = verdict(rules)
    return text_statistics(docs).select("*", failed.alias("base_failed"), (~failed & kept).alias("kept"), fired.alias("rule"))


def op5_decision_list(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return apply_rules(docs, learn(*examples(docs, labels))).select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")
