"""Exact substring deduplication by external suffix sorting.

Every byte goes that is covered by a string of ``LENGTH`` bytes which also starts
anywhere else.  Suffixes are sorted in shards, by induction with queues on disk
(``induced``), and neighbours that share ``LENGTH`` bytes mark each other.  What
makes shards independent and small:

1. Each window of LENGTH bytes is named after its anchor, the least of its
   ``ANCHOR``-byte hashes (the first of equals).  Equal windows have equal anchors at equal
   offsets, so windows of different anchors never need to meet.  Windows of one
   anchor in a row are one piece.
2. Equal pieces are counted before the shuffle.  A piece that occurs again is
   repeated as a whole; one whose anchor occurs nowhere else is not repeated.
3. Contested pieces, alone among others of their anchor, are split by where
   the anchor lies in the window, which fixes LENGTH - STEP bytes that all windows
   of a part hold.  Parts that agree there with another part, and only they, are
   suffix-sorted, one shard after the other.  Of the fixed bytes a name stands in
   the sorted string, between the few bytes that vary to both sides.

A window's fate is decided by full equality of its bytes in the sort or, for
whole pieces and parts, by 64-bit hashes of bytes and lengths.

At scale: 12 bytes of text give about one row of two hashes; texts are shuffled
twice, joined to their own ranges; thousands of copies arrive once a task.  A
shard's parts, their text, its types, flags and bucket ends are files of the task's
temporary folder; the queues' memory is a parameter.  A shard holds at least all parts
that agree in their fixed bytes, so it may be far larger than memory.

Edge cases: null texts are read as empty; texts shorter than LENGTH lose nothing;
rows that repeat id and text count as copies of each other and get the same
result each; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .induced import MEMORY, Column, on_disk, suffix_order
from .runtime import arrow_map, batch, ship, table

LENGTH, ANCHOR, STEP = 200, 32, 11
SHARD = 1 << 20
_PIECE = "key bigint, piece bigint, lo int, hi int, anchor int"
_FIELDS = ["key", "piece", "lo", "hi", "anchor"]


def pieces(t: bk.Texts, length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """For every piece: its document, anchor hash, content hash, first and last window start, and anchor, all within the slice."""
    n = len(t.buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return {"doc": none, **{f: none for f in _FIELDS}}
    pre = bk.byte_prefix(t.buf)
    i = np.arange(n - anchor + 1)
    h = bk.span_hash(pre, i, i + anchor)
    low = np.uint64(0xFFFFFFFF)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    at = (bk.sliding_min(packed, length - anchor + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(t)), np.diff(t.offs))[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + length <= t.offs[1:][doc])
    at = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    lo, a = start[first], at[first]
    hi = start[np.append(first[1:], len(start)) - 1] if len(start) else lo
    content = bk.mix(bk.span_hash(pre, lo, hi + length) + (a - lo).astype(np.uint64))
    return {"doc": doc[lo], "key": h[a].view(np.int64), "piece": content.view(np.int64), "lo": lo, "hi": hi, "anchor": a}


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _occurrences(src: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(b: pa.RecordBatch):
        for t in bk.slices(b.column(2), 1 << 17):
            p = pieces(t, length, anchor)
            if len(p["doc"]):
                take, base = pa.array(p["doc"] + t.lo), t.offs[p["doc"]]
                yield batch(["doc_id", "text_hash", *_FIELDS], [b.column(0).take(take), b.column(1).take(take), p["key"], p["piece"], *((p[f] - base).astype(np.int32) for f in ("lo", "hi", "anchor"))])

    return arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash bigint, {_PIECE}")


def _parts(src: DataFrame, contested: DataFrame, length: int, step: int) -> DataFrame:
    """Parts of contested pieces with their fixed bytes' hash (fixed), content hash (part), the bytes before and after the fixed ones, and number of copies."""
    joined = src.join(contested, src.doc_id.eqNullSafe(contested.c_id) & (src.text_hash == contested.c_hash)).select("doc_id", "text_hash", "text", "spans")

    def run(b: pa.RecordBatch):
        for t in bk.slices(b.column(2), 1 << 17):
            spans = b.column(3).slice(t.lo, len(t))
            flat = spans.flatten()
            doc = np.repeat(np.arange(len(t)), np.diff(spans.offsets.to_numpy()))
            lo, hi, at, n = (flat.field(i).to_numpy().astype(np.int64) for i in range(4))
            lo, hi, at = lo + t.offs[doc], hi + t.offs[doc], at + t.offs[doc]
            pre, raw = bk.byte_prefix(t.buf), t.buf.tobytes()
            for q in range((length - 1) // step + 1):
                y, x = np.minimum(hi, at - q * step), np.maximum(lo, at - q * step - step + 1)
                ok = np.flatnonzero(x <= y)
                if not len(ok):
                    continue
                d, x, y, a = doc[ok], x[ok], y[ok], at[ok]
                begin = a - q * step
                end = begin - step + 1 + length
                fixed = bk.mix(bk.span_hash(pre, begin, end) + np.uint64(q))
                part = bk.mix(bk.span_hash(pre, x, y + length) + (a - x).astype(np.uint64))
                take = pa.array(d + t.lo)
                left = pa.array([raw[i:j] for i, j in zip(x.tolist(), begin.tolist(), strict=True)], pa.binary())
                right = pa.array([raw[i:j] for i, j in zip(end.tolist(), (y + length).tolist(), strict=True)], pa.binary())
                base = t.offs[d]
                yield batch(
                    ["doc_id", "text_hash", "fixed", "part", "lo", "hi", "n", "left", "right"],
                    [b.column(0).take(take), b.column(1).take(take), fixed.view(np.int64), part.view(np.int64), (x - base).astype(np.int32), (y - base).astype(np.int32), n[ok], left, right],
                )

    kind = src.schema["doc_id"].dataType.simpleString()
    return arrow_map(joined, run, f"doc_id {kind}, text_hash bigint, fixed bigint, part bigint, lo int, hi int, n bigint, left binary, right binary")


class Shard:
    """Parts laid end to end in files; a part is bytes before its fixed ones, their name, bytes after them, and an end mark."""

    def __init__(self, folder: Path):
        self.folder, self.text, self.at, self.windows = folder, open(folder / "text", "wb"), Column(folder), Column(folder)
        self.size = self.names = 0
        self.key = None

    def add(self, left: bytes, fixed: int, right: bytes, windows: int) -> None:
        """Parts that share their fixed bytes must come one after the other."""
        self.names += fixed != self.key
        self.key = fixed
        self.at.append(self.size)
        self.windows.append(windows)
        for raw, end in ((left, self.names + 257), (right, 1)):
            part = np.empty(len(raw) + 1, np.uint32)
            part[:-1] = np.frombuffer(raw, np.uint8)
            part[:-1] += 2
            part[-1] = end
            part.tofile(self.text)
        self.size += len(left) + len(right) + 2

    def repeated(self, step: int, memory: int) -> Iterator[np.ndarray]:
        """For each part the numbers of its windows that occur elsewhere in the shard too, from one suffix order of all.

        A window is the run of ``step`` symbols that begins at its number.
        """
        np.zeros(1, np.uint32).tofile(self.text)
        self.text.close()
        at, windows = self.at.done(), self.windows.done()
        text = np.memmap(self.folder / "text", np.uint32, "r").view(np.ndarray)
        hit = on_disk(self.folder, np.bool_, len(text))
        flag, before = memoryview(hit), -1
        for i, shared in suffix_order(text, self.folder, memory):
            if shared >= step:
                flag[i] = flag[before] = True
            before = i
        for a, n in zip(at, windows, strict=True):
            yield np.flatnonzero(hit[a : a + n])


def repeated_starts(parts: Iterable[tuple[bytes, int, bytes, int]], step: int, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """For each (left, name, right, windows), in order of names, the numbers of its windows that occur elsewhere in the list too."""
    with tempfile.TemporaryDirectory() as d:
        shard = Shard(Path(d))
        for p in parts:
            shard.add(*p)
        yield from shard.repeated(step, memory)


def _sorted_shards(found: DataFrame, step: int, shard: int, memory: int) -> DataFrame:
    """(doc_id, text_hash, lo, hi) ranges of repeated windows among parts that agree in their fixed bytes."""

    def settle(parts: Shard, path: Path):
        with pa.OSFile(str(path)) as f:
            starts = parts.repeated(step, memory)
            for b in pa.ipc.open_stream(f):
                row, first, last = [], [], []
                for k, lo in enumerate(b.column(2).to_pylist()):
                    if len(s := next(starts)):
                        cuts = np.flatnonzero(np.diff(s) > 1)
                        first.append(lo + s[np.append(0, cuts + 1)])
                        last.append(lo + s[np.append(cuts, len(s) - 1)])
                        row += [k] * len(first[-1])
                if row:
                    yield batch(["doc_id", "text_hash", "lo", "hi"], [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), *(np.concatenate(x).astype(np.int32) for x in (first, last))])

    def groups(batches):
        """Slices of the batches, each followed by whether a shard ends there: between groups, once it is large enough."""
        size = key = None
        for b in batches:
            fixed = b.column(2).to_numpy()
            long = np.array([len(x) + len(y) + 2 for x, y in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)])
            lo = 0
            for i in range(b.num_rows):
                if size is not None and size >= shard and fixed[i] != key:
                    yield b.slice(lo, i - lo), True
                    lo, size = i, 0
                size, key = (size or 0) + int(long[i]), fixed[i]
            yield b.slice(lo), False

    def run(batches):
        todo = groups(batches)
        more = True
        while more:
            more = False
            with tempfile.TemporaryDirectory() as d:
                parts, path, out = Shard(Path(d)), Path(d) / "rows", None
                with open(path, "wb") as f:
                    for b, ends in todo:
                        rows = b.select([0, 1, 3])
                        out = out or pa.ipc.new_stream(f, rows.schema)
                        out.write_batch(rows)
                        for fixed, lo, hi, left, right in zip(*(b.column(i).to_pylist() for i in range(2, 7)), strict=True):
                            parts.add(left, fixed, right, hi - lo + 1)
                        if ends:
                            more = True
                            break
                    if out:
                        out.close()
                if out:
                    yield from settle(parts, path)

    ship(found.sparkSession)
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text_hash", "fixed", "lo", "hi", "left", "right").repartition("fixed").sortWithinPartitions("fixed").mapInArrow(run, f"doc_id {kind}, text_hash bigint, lo int, hi int")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, step: int = STEP, shard: int = SHARD, memory: int = MEMORY) -> DataFrame:
    """(doc_id, text_hash, gone): per text that loses any, the ranges of window starts (first, last) that are repeated."""
    src = _source(docs)
    found = _occurrences(src, length, anchor)
    counted = table(found.groupBy("key", "piece").agg(F.count("*").alias("n")))
    anchors = counted.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.min("n").alias("least")).where("all > 1")
    again = counted.join(anchors, "key").select(F.col("key").alias("k"), F.col("piece").alias("p"), "n", (F.expr("kinds > 1 AND least = 1")).alias("contested"))
    found = table(found.join(again, (F.col("key") == F.col("k")) & (F.col("piece") == F.col("p"))).drop("k", "p"))
    # equal pieces: every occurrence is repeated as a whole
    whole = found.where("n > 1").select("doc_id", "text_hash", "lo", "hi")
    # single pieces whose anchor has other pieces, and one of each kind of those others
    spot = F.struct("doc_id", "text_hash", "lo", "hi", "anchor")
    others = found.where("contested AND n > 1").groupBy("key", "piece").agg(F.min(spot).alias("at"), F.first("n").alias("n"))
    contested = found.where("contested AND n = 1").select(spot.alias("at"), "n").union(others.select("at", "n")).select("at.*", "n")
    contested = contested.groupBy(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")).agg(F.collect_list(F.struct("lo", "hi", "anchor", "n")).alias("spans"))
    parts = table(_parts(src, contested, length, step))
    copies = parts.groupBy("fixed", "part").agg(F.sum("n").alias("copies"))
    rated = table(copies)
    equal = parts.where("n = 1").join(rated.where("copies > 1").select("fixed", "part"), ["fixed", "part"], "left_semi").select("doc_id", "text_hash", "lo", "hi")
    meeting = rated.groupBy("fixed").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 AND fewest = 1").select("fixed")
    meet = parts.join(meeting, "fixed", "left_semi").dropDuplicates(["fixed", "part"])
    sorted_ = table(_sorted_shards(meet, step, shard, memory))
    return table(whole.union(equal).union(sorted_).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("gone")))


def _keep(size: int, gone: list, length: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int64)
    for r in gone or ():
        edge[r["lo"]] += 1
        edge[r["hi"] + length] -= 1
    return np.cumsum(edge)[:size] <= 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans of every row."""
    src = _source(docs)
    gone = repeated_ranges(docs, length, **how).select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"), "gone")
    joined = src.join(gone, src.doc_id.eqNullSafe(gone.g_id) & (src.text_hash == gone.g_hash), "left").select("doc_id", "text", "gone")

    def run(b: pa.RecordBatch):
        for t in bk.slices(b.column(1)):
            gone, kept, removed, spans = b.column(2).slice(t.lo, len(t)).to_pylist(), [], [], []
            for d, (lo, hi) in enumerate(zip(t.offs[:-1].tolist(), t.offs[1:].tolist(), strict=True)):
                if not gone[d]:
                    kept.append(t.buf[lo:hi].tobytes())
                    removed.append(0)
                    spans.append(0)
                    continue
                keep = _keep(hi - lo, gone[d], length)
                kept.append(t.buf[lo:hi][keep].tobytes())
                removed.append(int((~keep).sum()))
                spans.append(int((~keep[0]) + (keep[:-1] & ~keep[1:]).sum()))
            yield batch(["doc_id", "kept", "n_bytes", "n_removed", "n_spans"], [b.column(0).slice(t.lo, len(t)), pa.array(kept, pa.binary()), np.diff(t.offs), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())])

    return arrow_map(joined, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     k AS (SELECT rid, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS m FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d)),
     r AS (SELECT rid, i FROM k QUALIFY count(*) OVER (PARTITION BY m) > 1),
     p AS (SELECT rid, i, i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -{LENGTH + 1}) + {LENGTH} AS new FROM r),
     g AS (SELECT rid, i, sum(new::INT) OVER (PARTITION BY rid ORDER BY i) AS run FROM p),
     spans AS (SELECT rid, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY rid, run),
     gaps AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS s, a AS e FROM spans UNION ALL SELECT rid, max(b), 1 << 30 FROM spans GROUP BY rid),
     kept AS (SELECT rid, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS h FROM gaps JOIN d USING (rid) GROUP BY rid),
     gone AS (SELECT rid, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY rid)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN gone USING (rid)
"""


def op7_external_suffix_sort(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
