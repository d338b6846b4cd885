"""How far each source's use of words is from every other source's of its language, in exact integer arithmetic.

Terms are runs of letters; a language keeps those in at least ``MIN_DOCS`` of its documents.
A group (language, source) and a language each give every kept term a share p of ``SCALE``,
smoothed by one.  The divergence of group g from h is the sum of f(p_g, p_h) over all
kept terms, f(p, q) = floor((p - q)^2 / q).

An inverted index holds only terms that occur.  A pair starts at V times f of the two shares
of a term that neither has.  Postings then correct it: a term that one of the two has
depends on its count alone, so those corrections are summed over the group's counts of counts; a
term that both have adds what is left of its own f.  Only nonzero corrections are emitted.

At scale: words become (term, count) rows in one pass over the texts, summed before they are
shuffled; a hot source, word or language is spread by (language, source, term).  Postings of a
term meet by a join that Spark can split; a pair has one row a task before the shuffle.  The
result itself has a row for each two sources of a language.  Ranks of terms are cut to the
first ``TOP`` before their shuffle.

Edge cases: null text, language and source are read as ''; groups without terms have rows,
against shares of 1 + floor(SCALE / V); a language without kept terms (V = 0) has pairs of value 0
and no terms; very long texts go in slices; ties rank by the item's UTF-8 bytes; repeated rows are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytekit as bk
from .runtime import arrow_map, batch, table

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
LETTERS = bk.byte_class(b"abcdefghijklmnopqrstuvwxyz", True)
_SLICE = 1 << 20


def term_rows(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, one row a slice of texts; every group has a row with term ''."""

    def run(b: pa.RecordBatch):
        pair = pa.StructArray.from_arrays([b.column(1), b.column(2)], ["lang", "source"])
        names = {}
        group = np.array([names.setdefault((x["lang"], x["source"]), len(names)) for x in pair.to_pylist()])
        langs, sources = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))
        none = np.zeros(len(names), np.int64)
        yield batch(["lang", "source", "term", "n", "docs"], [langs, sources, pa.array([""] * len(names), pa.string()), none, none])
        for t in bk.slices(b.column(0), _SLICE):
            w = bk.words(t, table=LETTERS)
            if not len(w.start):
                continue
            doc = np.repeat(np.arange(len(t), dtype=np.uint64), w.counts)
            _, at, times = np.unique(bk.mix(w.hash + bk.mix(doc)), return_index=True, return_counts=True)
            own = group[t.lo + doc[at].astype(np.int64)]
            _, first, back = np.unique(bk.mix(w.hash[at] + bk.mix(own.astype(np.uint64))), return_index=True, return_inverse=True)
            start, size = w.start[at[first]], (w.end - w.start)[at[first]]
            data = bk.LOWER[t.buf[bk.ranges(start, size)]]
            offs = np.zeros(len(size) + 1, np.int32)
            np.cumsum(size, out=offs[1:])
            terms = pa.StringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(data))
            who = pa.array(own[first])
            n, seen = np.zeros(len(size), np.int64), np.bincount(back, minlength=len(size)).astype(np.int64)
            np.add.at(n, back, times)
            yield batch(["lang", "source", "term", "n", "docs"], [langs.take(who), sources.take(who), terms, n, seen])

    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    return arrow_map(docs.select(text, lang, source), run, "lang string, source string, term string, n bigint, docs bigint")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for any count; null without terms."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10)") * (count + 1).cast("decimal(20)"), F.nullif(total + terms, F.lit(0)).cast("decimal(20)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, n_lang, head) of the terms that enough documents of the language have; head marks one row a term."""
    term = Window.partitionBy("lang", "term")
    seen = rows.where("term <> ''").select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("n_lang"), (F.row_number().over(term.orderBy("source")) == 1).alias("head"))
    return seen.where(F.col("docs") >= min_docs).drop("docs")


def group_totals(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, v, total, lang_total, p0) of every group; p0 is the share of a term it lacks, null where the language keeps none."""
    langs = kept.groupBy("lang").agg(F.count_if("head").alias("v"), F.sum(F.when(F.col("head"), F.col("n_lang"))).alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    all_ = rows.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["v", "total", "lang_total"])
    return all_.withColumn("p0", share(F.lit(0), F.col("total"), F.col("v")))


def pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of every group from every other of its language."""
    c = F.col
    other = groups.select("lang", c("source").alias("item"), c("p0").alias("q0"))
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(c("v") * gap(c("p0"), c("q0")), F.lit(0)).alias("value"))

    def both_ways(a: Column, b: Column) -> Column:
        row = lambda s, i, x: F.struct("lang", s.alias("source"), i.alias("item"), x.alias("value"))
        return F.inline(F.array(row(c("source"), c("item"), a), row(c("item"), c("source"), b)))

    sums = postings.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    one = sums.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(c("terms") * (gap(c("p"), c("q0")) - gap(c("p0"), c("q0")))).alias("a"), F.sum(c("terms") * (gap(c("q0"), c("p")) - gap(c("q0"), c("p0")))).alias("b")
    )
    right = postings.select("lang", "term", c("source").alias("item"), c("p").alias("q"), c("p0").alias("q0"))
    left_over = lambda p, q, p0, q0: gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)
    met = postings.join(right, ["lang", "term"]).where("source < item").select("lang", "source", "item", left_over(c("p"), c("q"), c("p0"), c("q0")).alias("a"), left_over(c("q"), c("p"), c("q0"), c("p0")).alias("b"))
    two = met.where("a <> 0 OR b <> 0").groupBy("lang", "source", "item").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    parts = [base, *(x.select(both_ways(c("a"), c("b"))) for x in (one, two))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language by divergence (part pair), and the terms that the source overuses most (part term)."""
    rows = table(term_rows(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = table(kept_terms(rows, min_docs))
    groups = table(group_totals(rows, kept))
    postings = table(kept.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0", share(F.col("n_lang"), F.col("lang_total"), F.col("v")).alias("q")))
    over = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    pairs = pair_values(groups, postings.drop("q")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(over.withColumn("rank", rank).where(F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The dense sum over all kept terms; sums and products as HUGEINT.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM t GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN t USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + l.v) AS p, 1 + ({SCALE}::HUGEINT * (t.n + 1)) // (l.total + l.v) AS q
  FROM s JOIN t USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= {TOP}
"""
