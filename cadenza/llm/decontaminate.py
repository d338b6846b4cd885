"""Benchmark decontamination by winnowing.

Both sides are cut to words, every run of ``k`` words gets a hash, and of every
``span - k + 1`` consecutive runs the least hash is kept (the last one of equals).
Two texts that share ``span`` words share such a window and so keep the same
run at the same place in it: no shared span of that length can be missed.  The
kept runs are joined, and each hit is extended word by word to both sides.  A
window of ``span`` words that holds the hit ends at most ``span - k`` words away,
so a fingerprint carries just those neighbours and no text moves.

Items shorter than ``span`` words count as one window each; for those of n words
the kept runs are all runs of n words (k = n, one run per window).

At scale: document fingerprints are tested against a bitmap of fixed size that
holds the benchmark's, before they leave the Python worker.  The bitmap has no
growing part; a benchmark that fills it makes the shuffled join larger, never
wrong.  Texts are read once and not shuffled.

Edge cases: a null or empty text has no words and no hit; null item ids hit but
are not listed; rows that repeat id and text get one result each; an empty
benchmark leaves all documents clean; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .runtime import arrow_map, batch, cut, same

SPAN, K = 10, 5
BITMAP_BITS = 26
_HIT = "array<struct<n:int,key:bigint,pos:int,near:array<bigint>>>"
_HIT_TYPE = pa.struct([("n", pa.int32()), ("key", pa.int64()), ("pos", pa.int32()), ("near", pa.list_(pa.int64()))])


def winnow(hashes: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, document, hash) of the kept runs of k words; w = 1 keeps all."""
    first, doc, h = bk.ngrams(hashes, bounds, k)
    if w == 1 or len(h) < w:
        return (first, doc, h) if w == 1 else (first[:0], doc[:0], h[:0])
    last = np.uint64(0xFFFFFFFF)
    packed = (h >> np.uint64(32) << np.uint64(32)) | (last - np.arange(len(h), dtype=np.uint64))
    least = bk.sliding_min(packed, w)[doc[: len(h) - w + 1] == doc[w - 1 :]]
    kept = np.unique((last - (least & last)).astype(np.int64))
    return first[kept], doc[kept], h[kept]


def _near(hashes: np.ndarray, bounds: np.ndarray, first: np.ndarray, doc: np.ndarray, k: int, reach: int, none: int) -> np.ndarray:
    """The hashes of the words from ``reach`` before each run to ``reach`` after it."""
    at = first[:, None] + np.arange(-reach, k + reach)[None, :]
    inside = (at >= bounds[doc][:, None]) & (at < bounds[doc + 1][:, None])
    return np.where(inside, hashes[np.clip(at, 0, max(len(hashes) - 1, 0))], np.uint64(none))


def _fingerprints(col: pa.Array, span: int, k: int, short: list[int], bitmap: np.ndarray | None) -> tuple[list, pa.Array]:
    """Word counts and the list of kept runs of each text; without a bitmap the texts are benchmark items."""
    counts, per_row, parts = [], [], []
    reach = span - k
    for t in bk.slices(col):
        w = bk.words(t)
        counts.append(w.counts)
        found = []
        for n in [*short, span]:
            bounds = w.bounds
            if bitmap is None and n < span:  # an item is of one class only
                keep = np.flatnonzero(w.counts == n)
                first, doc = bounds[:-1][keep], keep
                h = bk.span_hash(bk.prefix(w.hash), first, first + n)
            else:
                first, doc, h = winnow(w.hash, bounds, n if n < span else k, 1 if n < span else span - k + 1)
            if bitmap is not None and len(h):
                bit = h >> np.uint64(64 - BITMAP_BITS)
                hit = (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                first, doc, h = first[hit], doc[hit], h[hit]
            if len(h):
                near = _near(w.hash, bounds, first, doc, k, reach, bitmap is None) if n == span else np.zeros((len(h), 0), np.uint64)
                found.append((doc, np.full(len(h), n, np.int32), h, first - bounds[doc], near))
        size = np.zeros(len(t), np.int64)
        if found:
            doc = np.concatenate([x[0] for x in found])
            order = np.argsort(doc, kind="stable")
            size += np.bincount(doc, minlength=len(t))
            wide = np.concatenate([np.full(len(x[0]), x[4].shape[1]) for x in found])
            flat = [x[4] for x in found]
            near = [flat[i][j] for i in range(len(found)) for j in range(len(flat[i]))]
            near = np.concatenate([near[i] for i in order]) if near else np.zeros(0, np.uint64)
            cols = [pa.array(np.concatenate([x[1] for x in found])[order]), pa.array(np.concatenate([x[2] for x in found])[order].view(np.int64)), pa.array(np.concatenate([x[3] for x in found])[order].astype(np.int32)), bk.lists(near.view(np.int64), wide[order], pa.int64())]
            parts.append(pa.StructArray.from_arrays(cols, fields=list(_HIT_TYPE)))
        per_row.append(size)
    flat = pa.concat_arrays(parts) if parts else pa.array([], _HIT_TYPE)
    offs = np.concatenate([[0], np.cumsum(np.concatenate(per_row))]).astype(np.int32)
    return np.concatenate(counts), pa.ListArray.from_arrays(pa.array(offs), flat)


def _items(bench: DataFrame, span: int, k: int) -> tuple[DataFrame, list[int]]:
    """The benchmark's kept runs, one row each, and which short classes occur."""

    def run(b: pa.RecordBatch):
        n, hits = _fingerprints(b.column(1), span, k, list(range(1, span)), None)
        yield batch(["item", "hits"], [b.column(0), hits])

    src = bench.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    out = cut(arrow_map(src, run, f"item string, hits {_HIT}").select("item", F.inline("hits")))
    short = [r.n for r in out.select("n").distinct().collect() if r.n < span]  # at most span - 1 values
    return out, sorted(short)


def _bitmap(items: DataFrame) -> np.ndarray:
    """2**BITMAP_BITS bits whatever the benchmark's size; words of it are or-ed on the executors."""
    bits = items.select(F.shiftrightunsigned("key", 64 - BITMAP_BITS).alias("bit"))
    words = bits.groupBy(F.expr("bit div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("b"))
    out = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out.view(np.uint8)


def _run_length(k: int, reach: int) -> tuple[Column, Column]:
    """How many neighbours agree to the left and to the right of a hit, nearest first."""
    left = right = F.lit(reach)
    for d in range(reach - 1, -1, -1):
        left = F.when(F.col("near")[reach - 1 - d] != F.col("item_near")[reach - 1 - d], d).otherwise(left)
        right = F.when(F.col("near")[reach + k + d] != F.col("item_near")[reach + k + d], d).otherwise(right)
    return left, right


def find_leaks(docs: DataFrame, bench: DataFrame, span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_words) of every document row, and (doc_id, text_hash, item, start, stop) of its hit runs in words."""
    items, short = _items(bench, span, k)
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(items))

    def run(b: pa.RecordBatch):
        n, hits = _fingerprints(b.column(2), span, k, short, shared.value)
        yield batch(["doc_id", "text_hash", "n_words", "hits"], [b.column(0), b.column(1), n.astype(np.int64), hits])

    text = F.col("text").cast("string")
    src = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    base = cut(arrow_map(src, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, n_words bigint, hits {_HIT}"))
    left, right = _run_length(k, span - k)
    item = items.select("item", "n", "key", F.col("near").alias("item_near"))
    hits = (
        base.where(F.size("hits") > 0).select("doc_id", "text_hash", F.inline("hits")).join(item, ["n", "key"])
        .withColumn("l", F.when(F.col("n") == span, left).otherwise(0)).withColumn("r", F.when(F.col("n") == span, right).otherwise(F.col("n") - k))
        .where((F.col("n") < span) | (F.col("l") + F.col("r") + k >= span))
        .select("doc_id", "text_hash", "item", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + k + F.col("r")).alias("stop"))
        .distinct()
    )
    return base.select("doc_id", "text_hash", "n_words"), hits


def contamination(docs: DataFrame, bench: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, n_hit (words inside a hit), items (sorted ids), n_items."""
    base, hits = find_leaks(docs, bench, span, k)
    step = lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.stop - F.greatest(acc.end, x.start))).alias("n"), F.greatest(acc.end, x.stop).alias("end"))
    found = hits.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs"), F.sort_array(F.collect_set("item")).alias("items"))
    found = found.select("doc_id", "text_hash", F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step).n.cast("long").alias("n_hit"), "items")
    return base.join(found, same(base, found, "doc_id", "text_hash"), "left").select(
        base.doc_id, base.text_hash, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items")
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The documents without any hit, with all their columns."""
    _, hits = find_leaks(docs, bench, span, k)
    bad = hits.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad._bad_id) & (F.xxhash64(docs.text.cast("string")) == bad._bad_hash), "left_anti")


def op1_winnowing_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
       FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(p) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM d, ns, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS r(p)),
h AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(k.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
