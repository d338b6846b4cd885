"""Near-duplicate groups by SimHash, with every link within ``LIMIT`` bits found by the generalised pigeonhole principle.

A fingerprint bit is the majority of that bit over the XXH64 of all 4-word shingles.
Two fingerprints that differ in at most tau bits differ, whatever the partition of the
64 bits into m parts with thresholds t_1 .. t_m, in at most t_i bits of some part i, as
long as the (t_i + 1) sum to tau + 1.  So parts may be of unequal strictness, and a part
with t = -1 is not probed at all.

- Parts: bits that go together over all fingerprints share a part, by greedy choice on the
  64 x 64 matrix of their correlations, which keeps the parts independent of each other.
- Thresholds: for each number of parts, dynamic programming gives the allocation of least
  cost: the rows that a threshold's probes need, and the candidates, estimated as the pairs
  that agree in the part, counted over all fingerprints, plus those expected to differ in up to
  t bits.  The number of parts with the least cost is taken.
- Probes: a fingerprint is sent to all keys within half the threshold of its part, so that two
  within t of each other meet in the middle; pairs that meet are verified on all 64 bits.

At scale: equal fingerprints are one row before any search, so copies cost nothing.  A key's
fingerprints meet in one task as a sorted stream of at most ``BUCKET`` rows, which yields a
spanning forest of its verified links, not all pairs.  Larger keys are split by the same principle:
their fingerprints go to five finer keys each, up to ``LEVELS`` times.  What is larger even then is linked
without pairs: each fingerprint is sent to its 2,081 neighbours within 2 bits, and all that meet in one
are within 4 bits of each other, so one link to the least suffices.  Only the matrix and
the counts of the parts reach the driver, whose size does not grow.

Edge cases: texts without words (null, empty, blanks) have fingerprint zero, linked like any
other; texts of fewer than four words have one shingle; very long texts are read in blocks of
shingles; rows that repeat an id are each returned; null ids are returned, and a group's
component_id is its least id that is not null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .ordermin import components
from .runtime import arrow_map, batch, cut, ship, table

GRAM, SEED, BITS, LIMIT = 4, 42, 64, 4
#: Fingerprints that one key may bring together; shingles counted at once; a probe's cost in candidate tests.
BUCKET, BLOCK, PROBE = 1 << 14, 1 << 15, 100
#: How often a key of more fingerprints is split before its fingerprints are linked through common neighbours.
LEVELS = 3
_ONE = np.uint64(1)


def shingle_hashes(t: bk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a slice's texts, and the text of each."""
    w = bk.words(t, table=bk.NONSPACE)
    text, start, end = bk.joined(t, w)
    counts = np.where(w.counts >= GRAM, w.counts - GRAM + 1, np.minimum(w.counts, 1))
    doc = np.repeat(np.arange(len(counts)), counts)
    first = bk.ranges(w.bounds[:-1], counts)
    last = np.minimum(first + GRAM, w.bounds[1:][doc]) - 1
    return bk.xxh64(text, start[first], end[last], SEED), doc


def fingerprints_of(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of each of n texts the bits set in over half of its hashes; doc rises."""
    ones = np.zeros((n, BITS), np.int64)
    for lo in range(0, len(hashes), BLOCK):
        d = doc[lo : lo + BLOCK]
        begin = np.flatnonzero(np.diff(d, prepend=-1))
        bits = np.unpackbits(hashes[lo : lo + BLOCK].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        ones[d[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    most = 2 * ones > np.bincount(doc, minlength=n)[:, None]
    return np.packbits(most, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(b: pa.RecordBatch):
        for t in bk.slices(b.column(1), 4 * bk.SLICE):
            yield batch(["doc_id", "fp"], [b.column(0).slice(t.lo, len(t)), fingerprints_of(*shingle_hashes(t), len(t)).view(np.int64)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, fp bigint")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, in how many both are set: one row a task, summed."""
    ship(fps.sparkSession)

    def run(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            on = ((x[:, None] >> np.arange(BITS, dtype=np.uint64)) & _ONE).astype(np.float64)
            both, n = both + (on.T @ on).astype(np.int64), n + len(x)
        yield batch(["v"], [bk.lists(np.append(both.ravel(), n), np.array([BITS * BITS + 1]), pa.int64())])

    sums = fps.select("fp").mapInArrow(run, "v array<bigint>").select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    got = np.zeros(BITS * BITS + 1, np.int64)
    for r in sums.collect():  # 4,097 rows, whatever the input
        got[r["at"]] = r["x"]
    return int(got[-1]), got[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in parts of (nearly) equal width: each begins with the bit most correlated with the rest and takes the bits most correlated with its own."""
    p = both / max(n, 1)
    freq = np.diag(p)
    spread = np.sqrt(freq * (1 - freq))
    corr = np.abs(p - np.outer(freq, freq)) / np.maximum(np.outer(spread, spread), 1e-12)
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for i in range(parts):
        own = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(own[0])
        while len(own) < (BITS + i) // parts:
            own.append(max(left, key=lambda b: corr[b, own].sum()))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def agreeing_pairs(fps: DataFrame, masks: list[int]) -> list[int]:
    """For each mask the pairs of fingerprints with equal bits under it."""
    held = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks)))
    keys = fps.select("fp", F.explode(held).alias("p")).select("p.i", F.col("fp").bitwiseAND(F.col("p.m")).alias("key"))
    sizes = keys.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    found = {r.i: int(r.pairs) for r in sizes.groupBy("i").agg(F.sum(F.expr("cast(n as decimal(20)) * (n - 1) / 2")).alias("pairs")).collect()}
    return [found.get(i, 0) for i in range(len(masks))]


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def mismatches(freq: np.ndarray) -> np.ndarray:
    """The distribution of the number of unequal bits of two fingerprints, bits taken as independent."""
    out = np.ones(1)
    for p in freq:
        out = np.convolve(out, [p * p + (1 - p) ** 2, 2 * p * (1 - p)])
    return out


def part_costs(n: int, freq: np.ndarray, agreeing: int, limit: int) -> list[float]:
    """The cost of thresholds -1, 0 .. limit of a part: its probes, and the candidates expected."""
    far = mismatches(freq)
    pairs = n * (n - 1) / 2
    costs = [0.0]
    for t in range(limit + 1):
        rows = n * ball(len(freq), (t + 1) // 2)
        costs.append(PROBE * rows + agreeing + pairs * far[1 : t + 1].sum())
    return costs


def allocate(costs: list[list[float]], limit: int) -> tuple[float, list[int]]:
    """The thresholds of least total cost whose (t + 1) sum to limit + 1: dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(own, -1):
                if (at := used + t + 1) <= limit + 1 and (at not in new or cost + c < new[at][0]):
                    new[at] = (cost + c, [*chosen, t])
        best = new
    return best[limit + 1]


def search_plan(fps: DataFrame, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part to probe; whatever it is, no pair is missed."""
    n, both = bit_counts(fps)
    freq = np.diag(both) / max(n, 1)
    options = [correlated_parts(n, both, m) for m in range(2, limit + 2)]
    agreeing = iter(agreeing_pairs(fps, [_mask(p) for parts in options for p in parts]))
    plans = []
    for parts in options:
        cost, chosen = allocate([part_costs(n, freq[p], next(agreeing), limit) for p in parts], limit)
        plans.append((cost, [(p, t) for p, t in zip(parts, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def _flips(bits: list[int], radius: int) -> Iterator[tuple[int, int]]:
    for k in range(radius + 1):
        for chosen in combinations(bits, k):
            yield _mask(list(chosen)), k


def _signatures(plan: list[tuple[list[int], int]]) -> Column:
    """All probes of a fingerprint: part, mask, flipped bits, and whether within the shorter radius, of which one of a pair must be."""
    probes = [(i, _signed(_mask(bits)), _signed(flip), k <= t // 2) for i, (bits, t) in enumerate(plan) for flip, k in _flips(bits, (t + 1) // 2)]
    return F.array(*(F.struct(F.lit(i).alias("part"), F.lit(m).alias("mask"), F.lit(x).alias("flip"), F.lit(near).alias("near")) for i, m, x, near in probes))


def forest(run: np.ndarray, fps: np.ndarray, near: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of links within limit bits that connect what links of each run connect; equal values of run lie together."""
    n = len(run)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.diff(run, prepend=run[:1] - 1))
    after = np.repeat(np.append(begin[1:], n), np.diff(np.append(begin, n))) - np.arange(n) - 1  # members of the run behind each
    root, out = np.arange(n), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    i, k = np.flatnonzero(after >= 1), 1
    while len(i):
        j = i + k
        hit = (near[i] | near[j]) & (np.bitwise_count(fps[i] ^ fps[j]) <= limit) & (root[i] != root[j])
        merged = False
        for x, y in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((x, y))
                merged = True
        while merged:
            up = root[root]
            merged, root = not (up == root).all(), up
        k += 1
        i = i[after[i] >= k]
    got = np.array(out, np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def _bucket_links(rows: DataFrame, limit: int) -> DataFrame:
    """(a, b) links of the keys' members; a key's rows come as one run of a sorted stream."""
    ship(rows.sparkSession)

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            last = int(new[-1]) if len(new) else 0
            held = [c[last:] for c in cols]
            if last:  # else all rows so far are one key's
                yield links([c[:last] for c in cols])
        if held is not None:
            yield links(held)

    def links(cols) -> pa.RecordBatch:
        part, key, fp, near = cols
        new = np.append(True, (np.diff(part) != 0) | (np.diff(key) != 0))[: len(part)]
        bits = fp.view(np.uint64)
        i, j = forest(np.cumsum(new), bits, near.astype(bool), limit)
        return batch(["a", "b"], [fp[i], fp[j]])

    dealt = rows.repartition("part", "key").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _meeting_links(fps: DataFrame) -> DataFrame:
    """(a, b): links of fingerprints that share a point within 2 bits of both, to the least of them."""
    flips = F.array(*(F.lit(_signed(x)) for x, _ in _flips(list(range(BITS)), LIMIT // 2)))
    points = fps.select("fp", F.explode(flips).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("point"))
    least = table(points.groupBy("point").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1").select("point", "least"))
    return points.join(least, "point").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def _even_parts(n: int, both: np.ndarray, level: int) -> list[int]:
    """Masks of ``LIMIT`` + 1 parts among which the bits are dealt by how evenly they are set, so that each part has its share of free ones."""
    p = np.diag(both) / max(n, 1)
    mixed = np.random.default_rng(level).permutation(BITS)
    order = mixed[np.argsort(-np.round(p * (1 - p), 2)[mixed], kind="stable")]
    return [_mask(order[i :: LIMIT + 1].tolist()) for i in range(LIMIT + 1)]


def _split(rows: DataFrame, level: int) -> DataFrame:
    """Rows of large keys under finer keys: two within ``LIMIT`` bits agree in one of ``LIMIT`` + 1 parts, whichever these are."""
    masks = _even_parts(*bit_counts(rows.select("fp").distinct()), level)
    held = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks)))
    own = F.xxhash64("part", "key", "p.i", F.col("fp").bitwiseAND(F.col("p.m")))  # keys that a hash joins cost time, not links
    return rows.select("*", F.explode(held).alias("p")).select(F.col("p.i").alias("part"), own.alias("key"), "fp", "near")


def close_links(fps: DataFrame, plan: list[tuple[list[int], int]] | None = None, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) of distinct fingerprints whose components are those of all pairs within ``LIMIT`` bits."""
    plan = plan or search_plan(fps)
    rows = fps.select("fp", F.explode(_signatures(plan)).alias("s")).select("s.part", F.col("fp").bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.flip")).alias("key"), "fp", "s.near")
    found = []
    for level in range(LEVELS + 1):
        large = cut(rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("part", "key"))
        if large.isEmpty():
            break
        crowded = table(rows.join(large, ["part", "key"], "left_semi"))
        rest = table(rows.join(large, ["part", "key"], "left_anti"))  # else the join stands for the exchange and the sort, and may become a broadcast
        found.append(_bucket_links(rest, LIMIT))
        rows = _split(crowded, level) if level < LEVELS else _meeting_links(table(crowded.select("fp").distinct()))
    else:
        return reduce(DataFrame.union, found, rows)
    return reduce(DataFrame.union, found, _bucket_links(rows, LIMIT))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least id that links lead to, of every row."""
    rows = table(fingerprints(docs))
    base = table(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    joined = components(cut(close_links(base.select("fp"))))
    rooted = base.join(joined, base.fp == joined.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = table(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
    named = table(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_pigeonhole(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
