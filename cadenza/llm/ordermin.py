"""Near-duplicate detection with order MinHash.

A text's k-mers are runs of k words, each labelled with its occurrence number
so that repeats count.  k is 5, or 3 and 2 for short texts (``CLASSES``), of whose longer runs a fifth of edits
would leave too few; lengths at which two texts could fall in different classes belong to both.  One sketch takes the ``ELL`` labelled k-mers with the least
values under a random order and keeps them in text order; it collides for two
texts that share these k-mers in the same order, which follows edit similarity
more closely than a set sketch.  Each of ``BANDS`` bands is one sketch, so two texts
whose k-mers overlap by J (Jaccard) meet in some band with probability
1 - (1 - J**2)**64: above 0.9999 for J = 0.4 (10 edits in a hundred words), 0.98 for
0.25 (16) and 0.94 for 0.21 (19).

Texts with equal words form a class first; only one row of each class goes on, so
copies cost nothing.  In each band bucket every class is linked with the least
class, and each link is verified: the word sequences' edit distance must be at most
``1 - SIMILARITY`` of the longer text.  An alignment on runs of words that each text
has once shows that for most copies, however long; a banded one decides the rest.  Buckets of
three or more whose members are not all connected by that, as when they hold texts
that share just one passage, are mixed.  Their members' sketches of that band grow
to ``DEEP`` k-mers, which tells texts of the same lines in other order apart, and
classes with many large mixed buckets (a sixteenth of all bands, buckets above
``LARGE``) get ``EXTRA`` bands more, as passages that others have too take up that
share of their bands.  The parts are led and verified as before.  Groups are the
components of verified links, found by alternating large-star and small-star steps.

At scale: buckets are only aggregated and joined with their least class; links
grow with the rows, not with the squares of groups; keys that many rows share are
salted or joined from tables that Spark can split; components need a number of
rounds that grows with the logarithm of the longest chain; nothing about all
documents reaches the driver but counts.

Edge cases: a null text is read as empty; texts without words form classes by
equal bytes and have no near copies; texts of fewer than k words have one k-mer; very long texts are read whole; an empty table gives no rows;
rows that repeat an id are grouped by their text and each returned; ties take the
least id, nulls first; other columns are ignored.  n_links counts the links that
were verified, not all that hold.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .runtime import arrow_map, batch, cut, free_name, table

ELL, BANDS, SIMILARITY = 2, 64, 0.8
#: (words in a k-mer, least and most words of the texts, bands): neighbours overlap by what two lengths may differ, 1 / SIMILARITY.
CLASSES = ((5, 120, 1 << 62, BANDS), (3, 20, 150, 48), (2, 1, 25, BANDS))
_FROM = np.cumsum([0, *(c[3] for c in CLASSES)])  # a band's number goes on through the classes
#: Lengths of sketches in mixed buckets; further bands of classes with many mixed buckets above LARGE.  Parts of a hot key.  Cells of a table of equal words.
DEEP, EXTRA, LARGE, SALT, CELLS = (4, 8), 128, 16, 8, 1 << 22
#: Bytes of text sketched at once: every band is some ten numpy calls, so short texts go many together.
SLICE = 1 << 19
_LOW = np.uint64(0xFFFFFFFF)
_ORDERS = np.random.Generator(np.random.PCG64(8)).integers(0, 2**63, BANDS + EXTRA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled_kmers(w: bk.Words, k: int = CLASSES[0][0]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (k-mer, occurrence number) in text order and the offsets of the texts among them."""
    short = (w.counts > 0) & (w.counts < k)
    first, doc, h = bk.ngrams(w.hash, w.bounds, k)
    if short.any():
        d = np.flatnonzero(short)
        one = bk.span_hash(bk.prefix(w.hash), w.bounds[d], w.bounds[d + 1])
        order = np.argsort(np.concatenate([doc, d]), kind="stable")
        doc, h = np.concatenate([doc, d])[order], np.concatenate([h, one])[order]
    at = np.searchsorted(doc, np.arange(len(w.counts) + 1))
    key = h ^ (doc.astype(np.uint64) << np.uint64(40))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    begin = np.flatnonzero(new)
    if len(begin) < len(h):
        nth = np.empty(len(h), np.uint64)
        nth[order] = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
        h = h + nth * np.uint64(0xD6E8FEB86659FD93)
    return h, at


def band_keys(h: np.ndarray, at: np.ndarray, bands: Sequence[int] = range(BANDS), ells: Sequence[int] = (ELL,), kind: int = 0) -> np.ndarray:
    """(texts, bands * ells) keys, apart for each kind; texts without k-mers get zeros."""
    out = np.zeros((len(at) - 1, len(bands) * len(ells)), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    start, top = at[:-1][full], ~np.uint64(0)
    place = np.arange(len(h), dtype=np.uint64)
    for i, band in enumerate(bands):
        x = ((h * _ORDERS[band]) & ~_LOW) | place  # equal values: the first of each text
        picks = []
        for ell in range(1, max(ells) + 1):
            least = np.minimum.reduceat(x, start)
            gone = least == top  # fewer k-mers than ell
            pos = np.where(gone, -1, (least & _LOW).astype(np.int64))
            x[pos[~gone]] = top
            picks.append(pos)
            if ell in ells:
                key = np.full(len(full), kind << 32 | band << 8 | ell, np.uint64)
                for p in np.sort(np.stack(picks), axis=0):
                    key = bk.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.where(p < 0, np.uint64(0), h[p]))
                out[full, i * len(ells) + ells.index(ell)] = key
    return out


def _of(w: bk.Words, d: np.ndarray) -> bk.Words:
    """The words of some of the texts."""
    size = w.counts[d]
    return bk.Words(w.start, w.end, w.hash[bk.ranges(w.bounds[:-1][d], size)], np.append(0, np.cumsum(size)))


def sketches(w: bk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All band keys end to end, how many each text has, and the number of its first band."""
    members = [np.flatnonzero((w.counts >= lo) & (w.counts <= hi)) for _, lo, hi, _ in CLASSES]
    size, first = np.zeros(len(w.counts), np.int64), np.full(len(w.counts), _FROM[-1])
    for c, d in enumerate(members):
        size[d] += CLASSES[c][3]
        first[d] = np.minimum(first[d], _FROM[c])
    at = np.cumsum(size) - size
    keys = np.zeros(int(size.sum()), np.uint64)
    for c, d in enumerate(members):
        k, _, _, bands = CLASSES[c]
        if len(d):
            keys[at[d][:, None] + np.arange(bands)] = band_keys(*labelled_kmers(_of(w, d), k), range(bands), kind=c)
            at[d] += bands
    return keys, size, first


def _shared_words(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the two bags' intersection."""
    (x, n), (y, m) = (np.unique(v, return_counts=True) for v in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _by_table(a: np.ndarray, b: np.ndarray, width: int):
    """slide(i, diag) for diagonals within width: the row of the next unequal pair, from a table of all of them."""
    n, m = len(a), len(b)
    # one row a diagonal; beyond b stands a value that is no word's hash but by a chance of 2**-64
    none = np.uint64(0x6A09E667F3BCC909)
    wide = np.concatenate([np.full(width, none), b, np.full(max(0, n + width - m), none)])
    equal = np.lib.stride_tricks.sliding_window_view(wide, n)[: 2 * width + 1] == a[None, :]
    stop = np.full((2 * width + 1, n + 1), n, np.int32)
    np.copyto(stop[:, :n], np.arange(n, dtype=np.int32)[None, :], where=~equal)
    stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]

    def slide(i: np.ndarray, diag: np.ndarray) -> np.ndarray:
        return stop[diag + width, np.minimum(i, n)].astype(np.int64)

    return slide


def _by_hash(a: np.ndarray, b: np.ndarray):
    """slide(i, diag) for all diagonals: runs of equal words by binary search over prefix hashes."""
    n, m = len(a), len(b)
    pa_, pb = bk.prefix(a), bk.prefix(b)
    powers = bk.powers(max(n, m) + 1)[1]

    def slide(i: np.ndarray, diag: np.ndarray) -> np.ndarray:
        j = i + diag
        lo, hi = np.zeros_like(i), np.minimum(n - i, m - j)
        i0, j0 = np.clip(i, 0, n), np.clip(j, 0, m)
        hi = np.where((i < 0) | (j < 0) | (i > n) | (j > m), 0, hi)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            e1, e2 = np.minimum(i0 + mid, n), np.minimum(j0 + mid, m)
            same = (pa_[e1] - pa_[i0]) * powers[i0] == (pb[e2] - pb[j0]) * powers[j0]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return i + lo

    return slide


def edit_distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edit distance of two word sequences if at most limit, else limit + 1.

    Banded alignment by furthest-reaching points: round e holds, for each diagonal
    of the band -e..e, how far e edits reach; runs of equal words are skipped at
    once.  Too few words in common settle it beforehand.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    if n == m and (a == b).all():
        return 0
    if limit == 0 or max(n, m) - _shared_words(a, b) > limit:
        return limit + 1
    if not n or not m:
        return max(n, m)
    width = min(limit, max(16, 2 * abs(n - m)))
    goal = m - n
    slide = _by_table(a, b, width) if n * (2 * width + 1) <= CELLS else _by_hash(a, b)
    reach = slide(np.zeros(1, np.int64), np.zeros(1, np.int64))
    if goal == 0 and reach[0] == n:
        return 0
    far = np.int64(-(1 << 40))
    for e in range(1, limit + 1):
        if e > width:
            width = min(limit, 4 * width)
            slide = _by_table(a, b, width) if n * (2 * width + 1) <= CELLS else _by_hash(a, b)
        diag = np.arange(-e, e + 1)
        wide = np.full(2 * e + 3, far)
        wide[2 : 2 * e + 1] = reach
        step = np.maximum(np.maximum(wide[1:-1] + 1, wide[2:] + 1), wide[:-2])  # replace, drop from a, insert from b
        step = np.minimum(step, np.minimum(n, m - diag))
        ok = (np.abs(diag - goal) <= limit - e) & (step >= 0) & (step + diag >= 0)
        reach = np.where(ok, slide(np.maximum(step, 0), diag), far)
        if -e <= goal <= e and reach[goal + e] >= n:
            return e
    return limit + 1


def anchored_bound(a: np.ndarray, b: np.ndarray, gram: int = 4) -> int:
    """A cost at which a turns into b, so at least their edit distance: runs of gram words that each has once are matched in order, what lies between is replaced."""
    n, m = len(a), len(b)
    if min(n, m) < gram:
        return max(n, m)
    once = []
    for v in (a, b):
        h, at, times = np.unique(bk.span_hash(bk.prefix(v), np.arange(len(v) - gram + 1), np.arange(gram, len(v) + 1)), return_index=True, return_counts=True)
        once.append((h[times == 1], at[times == 1]))
    _, x, y = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    i, j = once[0][1][x], once[1][1][y]
    order = np.argsort(i)
    i, j = i[order], j[order]
    tails, ends, back = [], [], np.full(len(i), -1)  # the longest rising chain of places in b
    for k, v in enumerate(j.tolist()):
        p = bisect_left(tails, v)
        tails[p : p + 1], ends[p : p + 1] = [v], [k]
        back[k] = ends[p - 1] if p else -1
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(k)
        k = back[k]
    if not chain:
        return max(n, m)
    i, j = np.append(i[chain[::-1]], n), np.append(j[chain[::-1]], m)
    di, dj = np.diff(i), np.diff(j)
    return int(max(i[0], j[0]) + (np.maximum(di, dj) - np.minimum(np.minimum(di, dj), gram)).sum())


def _describe(docs: DataFrame) -> DataFrame:
    """One row a document row: class key, text hash, number of words, band keys."""

    def run(b: pa.RecordBatch):
        for t in bk.slices(b.column(1), SLICE):
            w = bk.words(t)
            pre = bk.prefix(w.hash)
            whole = bk.span_hash(pre, w.bounds[:-1], w.bounds[1:])
            raw = bk.span_hash(bk.byte_prefix(t.buf), t.offs[:-1], t.offs[1:])
            empty = w.counts == 0
            second = bk.span_hash(bk.prefix(bk.mix(w.hash)), w.bounds[:-1], w.bounds[1:])
            keys, size, from_ = sketches(w)
            yield batch(
                ["doc_id", "text_hash", "c1", "c2", "n_words", "first_band", "bands"],
                [b.column(0).slice(t.lo, len(t)), b.column(2).slice(t.lo, len(t)), np.where(empty, raw, whole).view(np.int64), np.where(empty, ~raw, second).view(np.int64), w.counts.astype(np.int64), from_.astype(np.int32), bk.lists(keys.view(np.int64), size, pa.int64())],
            )

    text = F.col("text").cast("string")
    src = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(src, run, f"doc_id {kind}, text_hash bigint, c1 bigint, c2 bigint, n_words bigint, first_band int, bands array<bigint>")


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The given (a, b) links whose texts align."""
    left, right = (texts.select(F.col("c1").alias(n), F.col("text").alias(f"text_{n}"), F.col("n_words").alias(f"n_{n}")) for n in "ab")
    sized = pairs.join(left, "a").join(right, "b").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")).select("a", "b", "text_a", "text_b")

    def near(p, q):
        limit = int((1 - similarity) * max(len(p), len(q)) + 1e-9)
        return anchored_bound(p, q) <= limit or edit_distance_within(p, q, limit) <= limit

    def run(b: pa.RecordBatch):
        good = np.zeros(b.num_rows, bool)
        for lo in range(0, b.num_rows, 32):
            x, y = ([h for t in bk.slices(b.column(i).slice(lo, 32)) for w in [bk.words(t)] for h in np.split(w.hash, w.bounds[1:-1])] for i in (2, 3))
            good[lo : lo + 32] = [near(p, q) for p, q in zip(x, y, strict=True)]
        good = pa.array(good)
        yield batch(["a", "b"], [b.column(0).filter(good), b.column(1).filter(good)])

    return arrow_map(sized, run, "a bigint, b bigint")


def _by_key(rows: DataFrame, other: DataFrame, key: str, spread: str) -> DataFrame:
    """Join with a table of one row a key; rows of one key are dealt to SALT tasks by the spread column."""
    salts = F.explode(F.array(*map(F.lit, range(SALT))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")).join(other.withColumn("salt", salts), [key, "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected links (a, b): the least node of its component."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = None
    while (now := mark(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _by_key(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _by_key(large, low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = cut(small.distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _buckets(keys: DataFrame) -> DataFrame:
    """The keys of buckets with two classes or more, with lead, the least class, and n."""
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("c1").alias("lead")).where("n > 1")
    return cut(keys.join(cut(shared), "key"))


def _labels(links: DataFrame) -> DataFrame:
    """(c1, label) of linked classes: a class of the same component, the least one within a few links."""
    both = links.select(F.col("a").alias("c1"), F.col("b").alias("label")).union(links.select(F.col("b").alias("c1"), F.col("a").alias("label")))
    out = cut(both.groupBy("c1").agg(F.least(F.min("label"), F.col("c1")).alias("label")))
    for _ in range(2):
        up = out.select(F.col("c1").alias("label"), F.col("label").alias("lower"))
        out = cut(_by_key(out, up, "label", "c1").select("c1", F.col("lower").alias("label")))
    return out


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of those buckets of three or more whose members are not known to be connected."""
    named = buckets.where("n > 2").join(labels, "c1", "left").withColumn("label", F.coalesce("label", "c1"))
    open_ = cut(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"))
    return buckets.where("n > 2").join(open_, "key", "left_semi")


def _deeper(texts: DataFrame, mixed: DataFrame) -> DataFrame:
    """(c1, key) rows: longer sketches of the mixed bands of each class, and further bands where many of them are large."""
    spots = mixed.groupBy("c1").agg(F.collect_set("band").alias("spots"), (F.count_if(F.col("n") > LARGE) * 16 >= BANDS).alias("heavy"))

    def run(b: pa.RecordBatch):
        for t in bk.slices(b.column(1), SLICE):
            w = bk.words(t)
            spots = b.column(2).slice(t.lo, len(t))
            doc, band = np.repeat(np.arange(len(t)), np.diff(spots.offsets.to_numpy())), spots.flatten().to_numpy()
            heavy = b.column(3).slice(t.lo, len(t)).to_numpy(zero_copy_only=False).astype(bool)
            who, keys = [], []
            for c, (k, lo, hi, _) in enumerate(CLASSES):
                mine = (band >= _FROM[c]) & (band < _FROM[c + 1])
                more = np.flatnonzero(heavy & (w.counts >= lo) & (w.counts <= hi))
                if not mine.any() and not len(more):
                    continue
                here = np.unique(np.concatenate([doc[mine], more]))  # texts of this class alone are cut to k-mers
                h, at = labelled_kmers(_of(w, here), k)
                asked = [([int(x - _FROM[c])], DEEP, np.sort(doc[mine & (band == x)])) for x in np.unique(band[mine])]
                for bands, ells, d in [*asked, (range(BANDS, BANDS + EXTRA), (ELL, *DEEP), more)]:
                    if len(d):
                        e = np.searchsorted(here, d)
                        size = at[e + 1] - at[e]
                        part = h[bk.ranges(at[e], size)]
                        got = band_keys(part, np.append(0, np.cumsum(size)), bands, ells, c)
                        who.append(np.repeat(d, got.shape[1]))
                        keys.append(got.ravel())
            if who:
                yield batch(["c1", "key"], [b.column(0).take(pa.array(np.concatenate(who) + t.lo)), np.concatenate(keys).view(np.int64)])

    return arrow_map(texts.select("c1", "text").join(spots, "c1"), run, "c1 bigint, key bigint")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c1, text, n_words) of the classes that have candidates, each from its first document."""
    text = F.col("text").cast("string")
    src = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")).where("text IS NOT NULL")
    ids = wanted.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), "c1", "n_words")
    found = src.join(ids, src.doc_id.eqNullSafe(ids.w_id) & (src.text_hash == ids.w_hash)).select("c1", "n_words", "text")
    return table(found.dropDuplicates(["c1"]))  # rows may repeat an id and its text


def _led(buckets: DataFrame) -> DataFrame:
    """The (a, b) of every class and the least one of its bucket."""
    return buckets.where("c1 <> lead").select(F.least("c1", "lead").alias("a"), F.greatest("c1", "lead").alias("b"))


def near_copies(docs: DataFrame, bands: DataFrame, base: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The verified links (a, b) between classes, from their band keys."""
    buckets = _buckets(bands.select("c1", "first_band", F.posexplode("bands").alias("pos", "key")).select("c1", (F.col("pos") + F.col("first_band")).alias("band"), "key"))
    texts = _texts(docs, base.join(buckets.select("c1").distinct(), "c1", "left_semi").select("c1", "low.doc_id", "low.text_hash", "n_words"))
    tried = cut(_led(buckets).distinct())
    links = cut(_verify(tried, texts, similarity))
    labels = _labels(links)
    parts = _buckets(cut(_deeper(texts, _mixed(buckets, labels))))
    label, lead = (labels.select(F.col("c1").alias(n), F.col("label").alias(f"{n}_label")) for n in ("c1", "lead"))
    pairs = parts.where("c1 <> lead").select("c1", "lead").distinct().join(label, "c1", "left").join(lead, "lead", "left")
    pairs = _led(pairs.where("coalesce(c1_label, c1) <> coalesce(lead_label, lead)")).distinct().join(tried, ["a", "b"], "left_anti")
    return links.union(cut(_verify(pairs, texts, similarity)))


def near_duplicate_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row a document row: doc_id, exact_id (least id with equal words), class_id (least id of its near copies), n_links, and text_hash and stays (it is the group's first by id and hash)."""
    rows = table(_describe(docs))
    base = cut(rows.groupBy("c1", "c2", "n_words").agg(F.min(F.struct("doc_id", "text_hash")).alias("low")))
    bands = cut(rows.where("n_words > 0").groupBy("c1").agg(F.first("first_band").alias("first_band"), F.first("bands").alias("bands")))  # equal words, equal bands
    links = near_copies(docs, bands, base, similarity)
    degree = links.select(F.col("a").alias("c1")).union(links.select(F.col("b").alias("c1"))).groupBy("c1").agg(F.count("*").alias("n_links"))
    roots = components(links).withColumnRenamed("node", "c1").join(degree, "c1", "full")
    found = base.join(cut(roots.select("c1", F.coalesce("root", "c1").alias("root"), "n_links")), "c1", "left")
    linked = cut(found.where("root IS NOT NULL"))
    leads = linked.groupBy("root").agg(F.min("low").alias("lead"))
    alone = found.where("root IS NULL").select("c1", "c2", "low", F.lit(0).cast("long").alias("n_links"), F.col("low").alias("lead"))
    named = alone.union(_by_key(linked, leads, "root", "c1").select("c1", "c2", "low", "n_links", "lead"))
    named = cut(named.select("c1", "c2", F.col("low.doc_id").alias("exact_id"), F.col("lead.doc_id").alias("class_id"), "n_links", "lead"))
    stays = F.struct("doc_id", "text_hash").eqNullSafe(F.col("lead"))
    return rows.select("doc_id", "text_hash", "c1", "c2").join(named, ["c1", "c2"]).select("doc_id", "exact_id", "class_id", "n_links", "text_hash", stays.alias("stays"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, the first by id and text hash, with all its columns; of rows that repeat both, one stays."""
    own = free_name(docs, "text_hash")
    kept = cut(near_duplicate_groups(docs, similarity).where("stays").groupBy("doc_id", "text_hash").agg(F.count("*").alias("times")))
    again = not kept.where("times > 1").isEmpty()
    kept = kept.select(F.col("doc_id").alias(f"{own}_id"), F.col("text_hash").alias(f"{own}_kept"))
    keyed = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    out = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[f"{own}_id"]) & (keyed[own] == kept[f"{own}_kept"]), "left_semi")
    return (out.dropDuplicates(["doc_id", own]) if again else out).drop(own)


def op8_order_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
