"""Substring deduplication over sliding sentence spans.

A text is cut to sentences at ``.``, ``!`` or ``?`` before white space and at line
ends; a sentence of over ``LONGEST`` words is cut again every so many words from
its start.  A run is the shortest one of at least two consecutive sentences with
``MIN_WORDS`` words or more that starts, or that ends, at a given sentence.  Every
run is hashed by its words (case and punctuation do not count), the hashes meet
globally, and a sentence goes if a run covers it that is not the first of its
kind; the first is the one with the least (doc_id, text hash, place).  Runs of
both kinds together cover every sentence of any repeated passage of 2 *
MIN_WORDS + 1 words that begins and ends at sentence bounds.

With ``words`` more goes: a passage need not keep to sentence bounds, nor do cuts counted from a sentence's
start fall alike in two copies that begin within it.  So stretches of words are
hashed too: they begin and end at anchors, which are words whose ``GRAM`` words
have the least hash of some window of them, and have MIN_WORDS words or more.
The windows are so short that any 2 * MIN_WORDS + 1 equal words hold a whole
stretch.  Words of a stretch that is not the first of its kind go as well, if
need be from the midst of a sentence.

At scale: hashes are counted before the shuffle, so that a passage in a third of
all documents arrives once a task; only runs that occur again are kept, by a
sort-merge join whose hot keys Spark splits, and the first of each kind is sought
among these.  Runs are written once, as are those that occur again, so that both sides
of each join have an exchange of their own; documents are joined to the list of their own.

Edge cases: null and empty texts have no sentences and stay as they are; texts
without words too; rows that repeat both id and text are one document and get
the same result each; null ids sort first; the order of ids breaks ties; other
columns are ignored, or kept by ``remove_repeats``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .runtime import arrow_map, batch, free_name, table

MIN_WORDS, LONGEST, GRAM = 25, 20, 4
_STRETCH = np.uint64(0xA24BAED4963EE407)  # keeps hashes of stretches apart from those of runs
_END = bk.byte_class(b".!?", False)
_SPACE = bk.byte_class(b" \t\r\n\x0b\x0c", False)


@dataclass
class Sentences:
    words: bk.Words
    first: np.ndarray  # word index, with the number of words at the end
    doc: np.ndarray
    bounds: np.ndarray  # index of each document's first sentence
    start: np.ndarray  # byte at which the sentence begins; it reaches to the next one


def sentences(t: bk.Texts, longest: int = LONGEST) -> Sentences:
    w = bk.words(t)
    n = len(w.start)
    if not n:
        none = np.zeros(0, np.int64)
        return Sentences(w, np.zeros(1, np.int64), none, np.zeros(len(t) + 1, np.int64), none)
    space = np.ones(len(t.buf), bool)
    space[:-1] = _SPACE[t.buf[1:]]
    marks = np.cumsum((_END[t.buf] & space) | (t.buf == 10))
    sid = marks[w.start]
    doc = np.repeat(np.arange(len(t)), w.counts)
    new = np.ones(n, bool)
    new[1:] = (sid[1:] != sid[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    rank = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    first = np.flatnonzero(rank % longest == 0)
    sdoc = doc[first]
    bounds = np.searchsorted(sdoc, np.arange(len(t) + 1))
    start = w.start[first].copy()
    full = bounds[:-1] < bounds[1:]
    start[bounds[:-1][full]] = t.offs[:-1][full]
    return Sentences(w, np.append(first, n), sdoc, bounds, start)


def runs(s: Sentences, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentence after the last, hash) of every run, each once."""
    n = len(s.doc)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    i = np.arange(n)
    e = np.maximum(np.searchsorted(s.first, s.first[:-1] + min_words, "left"), i + 2)
    ok = e <= s.bounds[s.doc + 1]
    j = i + 1
    b = np.minimum(np.searchsorted(s.first, s.first[1:] - min_words, "right") - 1, j - 2)
    fine = (b >= 0) & (b >= s.bounds[s.doc])
    pair = np.unique(np.concatenate([(i[ok] << 32) | e[ok], (b[fine] << 32) | j[fine]]))
    b, e = pair >> 32, pair & 0xFFFFFFFF
    return b, e, bk.span_hash(bk.prefix(s.words.hash), s.first[b], s.first[e])


def anchors(w: bk.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, document) of every run of gram words that has the least hash of a window of such runs."""
    first, doc, h = bk.ngrams(w.hash, w.bounds, gram)
    if len(h) < window:
        return first[:0], doc[:0]
    least = np.where(doc[: len(h) - window + 1] == doc[window - 1 :], bk.sliding_min(h, window), np.uint64(0))
    pad = np.zeros(window - 1, np.uint64)
    top = ~bk.sliding_min(~np.concatenate([pad, least, pad]), window)  # the greatest of the least values of its windows
    at = np.flatnonzero((top == h) & (top > 0))
    return first[at], doc[at]


def stretches(w: bk.Words, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, document, hash): from each anchor to the end of the first one that makes min_words."""
    gram = min(GRAM, min_words)
    at, doc = anchors(w, (min_words + 3) // 2, gram)
    end = np.searchsorted(at, at + min_words - gram)
    ok = end < len(at)
    ok[ok] = doc[end[ok]] == doc[ok]
    lo, hi = at[ok], at[end[ok]] + gram
    return lo, hi, doc[ok], bk.mix(bk.span_hash(bk.prefix(w.hash), lo, hi) ^ _STRETCH)


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def removals(docs: DataFrame, min_words: int = MIN_WORDS, longest: int = LONGEST, words: bool = True) -> DataFrame:
    """(doc_id, text_hash, gone): what goes from each document that loses any, as runs of n sentences or, n below 0, of -n words."""

    def run(b: pa.RecordBatch):
        for t in bk.slices(b.column(2)):
            s = sentences(t, longest)
            lo, hi, h = runs(s, min_words)
            d = s.doc[lo]
            first, end, doc, more = stretches(s.words, min_words) if words else (lo[:0], lo[:0], lo[:0], h[:0])
            if len(h) + len(more):
                take = pa.array(np.concatenate([d, doc]) + t.lo)
                at, n = np.concatenate([lo - s.bounds[d], first - s.words.bounds[doc]]), np.concatenate([hi - lo, first - end])
                yield batch(["doc_id", "text_hash", "run", "lo", "n"], [b.column(0).take(take), b.column(1).take(take), np.concatenate([h, more]).view(np.int64), at.astype(np.int32), n.astype(np.int32)])

    src = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    found = table(arrow_map(src, run, f"doc_id {_id_type(docs)}, text_hash bigint, run bigint, lo int, n int"))
    place = F.struct("doc_id", "text_hash", "lo")
    again = table(found.groupBy("run").agg(F.count("*").alias("times")).where("times > 1").select("run"))
    found = table(found.join(again, "run"))
    first = table(found.groupBy("run").agg(F.min(place).alias("first")))
    later = found.join(first, "run").where(~place.eqNullSafe(F.col("first")))
    return table(later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "n")).alias("gone")))


def _cut(t: bk.Texts, gone: list, longest: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """What stays of each text, its number of sentences, and how many went or lost words."""
    s = sentences(t, longest)
    w = s.words
    edge, word_edge = np.zeros(len(s.doc) + 1, np.int64), np.zeros(len(w.start) + 1, np.int64)
    for d, ranges in enumerate(gone):
        for r in ranges or ():
            e, at = (edge, s.bounds[d] + r["lo"]) if r["n"] > 0 else (word_edge, w.bounds[d] + r["lo"])
            e[at] += 1
            e[at + abs(r["n"])] -= 1
    dead, lost = np.cumsum(edge)[:-1] > 0, np.cumsum(word_edge)[:-1] > 0
    keep = np.ones(len(t.buf), bool)
    stop = np.append(s.start[1:], len(t.buf))
    if len(s.doc):
        last = s.bounds[1:][s.bounds[1:] > s.bounds[:-1]] - 1
        stop[last] = t.offs[1:][s.doc[last]]
    for i in np.flatnonzero(dead):
        keep[s.start[i] : stop[i]] = False
    for i, j in zip(*bk.spans(lost, w.bounds), strict=True):  # up to the next word that stays, or the end of the text
        d = np.searchsorted(w.bounds, i, "right") - 1
        keep[w.start[i] : w.start[j] if j < w.bounds[d + 1] else t.offs[d + 1]] = False
    if len(s.doc):
        dead |= np.logical_or.reduceat(lost, s.first[:-1])
    out = [t.buf[a:b][keep[a:b]].tobytes() for a, b in zip(t.offs[:-1], t.offs[1:], strict=True)]
    removed = np.bincount(s.doc[dead], minlength=len(t)) if len(s.doc) else np.zeros(len(t), np.int64)
    return out, np.diff(s.bounds), removed


def count_names(docs: DataFrame) -> tuple[str, str]:
    """Names of the two added columns: n_sentences and n_removed, with underscores before them where documents have such columns."""
    taken, prefix = {c.lower() for c in docs.columns}, ""
    while {f"{prefix}n_sentences", f"{prefix}n_removed"} & taken:
        prefix += "_"
    return f"{prefix}n_sentences", f"{prefix}n_removed"


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, longest: int = LONGEST, words: bool = True) -> DataFrame:
    """All columns of documents with the shortened text, and n_sentences and n_removed (see count_names).  Without ``words`` only whole sentences go."""
    counts, own = count_names(docs), free_name(docs, "gone")
    gone = removals(docs, min_words, longest, words).select(F.col("doc_id").alias(f"{own}_id"), F.col("text_hash").alias(f"{own}_hash"), F.col("gone").alias(own))
    keyed = docs.withColumn("text", F.col("text").cast("string")).withColumn(f"{own}_text", F.xxhash64("text"))
    joined = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone[f"{own}_id"]) & keyed[f"{own}_text"].eqNullSafe(gone[f"{own}_hash"]), "left").drop(f"{own}_id", f"{own}_hash", f"{own}_text")
    at, names = docs.columns.index("text"), docs.columns

    def run(b: pa.RecordBatch):
        text, gone = b.column(at), b.column(len(names))
        valid = np.asarray(text.is_valid())
        for t in bk.slices(text):
            part = b.slice(t.lo, len(t))
            out, total, removed = _cut(t, gone.slice(t.lo, len(t)).to_pylist(), longest)
            new = pa.array([o if v else None for o, v in zip(out, valid[t.lo : t.hi], strict=True)], pa.binary()).cast(text.type)
            cols = [new if i == at else part.column(i) for i in range(len(names))]
            yield batch([*names, *counts], [*cols, total.astype(np.int64), removed.astype(np.int64)])

    schema = keyed.select(*names).schema.add(counts[0], "long").add(counts[1], "long")
    return arrow_map(joined, run, schema)


def op6_sentence_spans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_sentences", "n_removed", "text")


_WORD, _GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: DuckDB SQL for the rows of op6_sentence_spans without ``words``, with ids that do not repeat.  SQL has no hash that would give the anchors.
ORACLE = rf"""
WITH d AS (SELECT doc_id, text, regexp_extract(text, '^{_GAP}') AS lead, regexp_extract_all(text, '{_WORD}{_GAP}') AS pieces,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS pos FROM d),
m AS (SELECT *, coalesce(sum(regexp_matches(piece, '[.!?][ \t\r\n\x0b\x0c]|\n')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mark FROM p),
n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, mark ORDER BY pos) - 1) % {LONGEST} = 0 AS new FROM m),
o AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sid FROM n),
s AS (SELECT doc_id, sid, min(pos) AS a, max(pos) AS b, string_agg(piece, '' ORDER BY pos) AS piece FROM o GROUP BY doc_id, sid),
r AS (SELECT x.doc_id, x.sid AS i, y.sid AS j, x.a, y.b FROM s AS x ASOF JOIN s AS y ON x.doc_id = y.doc_id AND x.a + {MIN_WORDS - 1} <= y.b
      UNION SELECT y.doc_id, x.sid, y.sid, x.a, y.b FROM s AS y ASOF JOIN s AS x ON x.doc_id = y.doc_id AND y.b - {MIN_WORDS - 1} >= x.a),
g AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY array_to_string(w[a:b], ' ') ORDER BY doc_id, i) AS nth FROM r JOIN d USING (doc_id)),
x AS (SELECT DISTINCT doc_id, unnest(range(i::BIGINT, j::BIGINT + 1)) AS sid FROM g WHERE nth > 1),
k AS (SELECT s.doc_id, count(*) AS n_sentences, count(x.sid) AS n_removed, coalesce(string_agg(CASE WHEN s.sid = 1 THEN lead ELSE '' END || piece, '' ORDER BY s.sid) FILTER (x.sid IS NULL), '') AS kept
      FROM s JOIN d USING (doc_id) LEFT JOIN x ON x.doc_id = s.doc_id AND x.sid = s.sid GROUP BY s.doc_id)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept, text) AS text FROM d LEFT JOIN k USING (doc_id)
"""
