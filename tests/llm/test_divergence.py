"""Source divergence against the dense sum over all terms."""

import re
from collections import Counter, defaultdict

from cadenza.llm import divergence
from cadenza.llm.queries import QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=3, top=200):
    counts, groups, seen = defaultdict(Counter), set(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        groups.add((lang, source))
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = set()
    for lang in {x for x, _ in groups}:
        own = [s for x, s in groups if x == lang]
        terms = [t for t, n in seen[lang].items() if n >= min_docs]

        def shares(c):
            total = sum(c[t] for t in terms)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(terms)) for t in terms}

        p = {s: shares(counts[lang, s]) for s in own}
        whole = shares(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in terms), o.encode()) for o in own if o != s]
            over = [(-((p[s][t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in terms if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(items, 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ROWS = [
    ("The cat, the CAT and a dog", "en", "a"), ("the dog saw the cat", "en", "b"), ("a cat; the end", "en", "c"), ("the the the", "en", None), ("", "en", "empty"), (None, "en", "empty"),
    ("été Été ÉTÉ", "fr", "x"), ("été là", "fr", "y"), ("été", "fr", "x"), ("solo", "de", "p"), ("duo", "de", "q"), (None, None, None), ("Ünï the", None, "z"), ("don't stop_me 42", "en", "a"),
]


def test_equals_the_dense_sum(spark):
    df = spark.createDataFrame([(*r, 1, "t") for r in ROWS * 2], "text string, lang string, source string, n int, term string").repartition(3)
    assert got(divergence.source_divergence(df)) == plain(ROWS * 2)
    assert got(divergence.source_divergence(df, min_docs=1, top=2)) == plain(ROWS * 2, 1, 2)
    assert got(divergence.source_divergence(df.limit(0))) == set()


def test_slices_and_long_texts(spark, monkeypatch):
    rows = [("word " * 50_000 + "end", "en", "a"), ("word end other " * 3, "en", "b"), ("end other word", "en", "c"), ("x" * 40_000, "en", "c")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got(divergence.source_divergence(df)) == plain(rows)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op12_source_divergence"](spark, sf)) == plain(rows)
