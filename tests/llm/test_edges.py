"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from cadenza.llm import decontaminate, langid, licenses, ordermin, pieces, quality, rules, shards, spans, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed long, key string, gone string, text_hash string, words string, `_gone` string"
LONG = "long words run on and on. " * 20_000


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en" if d else None, None, None, 1, "k", "g", "h", "w", "x") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    same = "one two three four five six seven eight nine ten eleven twelve"
    return table(spark, [(1, None), (2, ""), (None, same), (None, None), (3, same), (3, same), (4, "  \n "), (5, LONG), (6, "é漢字"), (7, same.upper() + "!")]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (None, "é漢字"), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "contamination": lambda s, d, b: decontaminate.contamination(d, b),
    "quality": lambda s, d, b: quality.score(d, quality.train(d, d.selectExpr("doc_id", "doc_id % 3 AS grade"))),
    "licenses": lambda s, d, b: licenses.license_report(d, licenses.template_table(s)),
    "pieces": lambda s, d, b: pieces.encode(d, pieces.load()),
    "rules": lambda s, d, b: rules.apply_rules(d, rules.learn(*rules.examples(d, d.selectExpr("doc_id", "doc_id % 2 AS quality")))),
    "spans": lambda s, d, b: spans.deduplicate(d),
    "suffixes": lambda s, d, b: suffixes.remove_repeats(d),
    "ordermin": lambda s, d, b: ordermin.near_duplicate_groups(d),
    "langid": lambda s, d, b: langid.identify(d, langid.train(d)),
    "shards": lambda s, d, b: shards.shard_rows(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gets_a_result(spark, odd, none, bench, name):
    assert len(OPERATORS[name](spark, odd, bench).collect()) == 10
    assert OPERATORS[name](spark, none, bench).count() == 0


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([(1, "one two three four five six. " * 9, "a", "b"), (2, "one two three four five six. " * 9, "c", "d")], "doc_id long, text string, `__text_hash` string, `__gone` string")
    assert spans.deduplicate(docs).columns[:4] == docs.columns and spans.deduplicate(docs).count() == 2
    kept = ordermin.keep_one(docs)
    assert kept.columns == docs.columns and [r["__text_hash"] for r in kept.collect()] == ["a"]


def test_results_of_odd_rows(spark, odd, bench):
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(odd, bench).collect()}
    assert got[(3, 12)].n_hit == 10 and got[(1, 0)].n_hit == 0 and got[(6, 1)].n_hit == 1 and got[(6, 1)].n_items == 0 and got[(None, 12)]["items"] == ["1"]
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    groups = [(r.doc_id, r.class_id) for r in ordermin.near_duplicate_groups(odd).collect()]
    assert groups.count((3, None)) == 2 and (7, None) in groups  # the null id comes first
    kept = ordermin.keep_one(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.where("text LIKE 'one%' OR text LIKE 'ONE%'").collect()] == [None]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "6", "None", "None"]
    kept_bytes = {r.doc_id: r for r in suffixes.remove_repeats(odd).collect()}
    assert kept_bytes[5].n_removed > 400_000 and kept_bytes[6].n_removed == 0
    assert spans.deduplicate(odd).columns[-2:] == ["_n_sentences", "_n_removed"]


def test_stages_keep_columns_and_take_odd_tables(spark, odd, none, bench, tmp_path):
    d = str(tmp_path)
    bench.write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for docs in (odd, none):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, d)
            assert (out.columns == docs.columns) == (i < 4)
            assert out.count() <= docs.count()
