"""License scan with DataFrame functions only.

A text's shingles are its runs of five words across lines and sentences, so that
neither wrapping nor the text around a notice changes them.  Texts are cut to
windows of ``WINDOW`` words, one every ``STRIDE`` words, templates to such windows at
every word; of each window ``BANDS`` bands keep the least shingle under an order of
their own.  A template is retrieved if a window of a text and one of its own agree in
a band, which windows of Jaccard J do with probability 1 - (1 - J)**BANDS, and equal
ones always.  A text that holds ``CONTAINMENT`` of the shingles of a template of 24
words or more holds 14 of its words in a row, as five shingles go with an edit, and
so a whole window: retrieval loses nothing.  Shorter templates have windows of
one shingle, at every word.  Retrieved templates are verified: the share of their
distinct shingles found anywhere in the text must be CONTAINMENT or more, exact up to
equal 64-bit hashes.  A template of fewer than five words is one shingle of its own
length, and texts are cut to that length too where such templates are given.

At scale: one narrow pass over the texts; a table of ``SLOTS`` flags, whatever the
number of templates, drops shingles and keys that no template has before anything is
joined; templates are broadcast if they take at most ``BROADCAST_BYTES`` (checked),
else joined by a shuffle; only what may match is shuffled.

Edge cases: null and empty texts have no shingles and no license; rows that repeat
id and text each get the same result; null template texts are left out, as are
templates without words; an empty template table matches nothing; first_unit is
the line or sentence in which the first shingle found begins; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import same

LENGTH, CONTAINMENT, BROADCAST_BYTES = 5, 0.8, 8 << 20
WINDOW, STRIDE, SLOTS = 12, 3, 1 << 17
#: One order of shingles a band: by their bits, some of them flipped.
ORDERS = (0x1B873593CC9E2D51, -0x3C6EF372FE94F82B)
BANDS = len(ORDERS)

#: Public license notices; the scan takes any other table of (template, text) as well.
TEMPLATES = [
    ("MIT-notice", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _words(df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., words, units): the words of every text in order, and the line or sentence of each."""
    split = df.select(*keep, F.split(F.lower("text"), r"(?<=[.!?])\s+|\n").alias("lines"))
    plain = F.transform("lines", lambda x: F.filter(F.split(F.regexp_replace(x, "[^a-z0-9\\u0080-\\uffff]+", " "), " "), lambda y: y != ""))
    return split.select(*keep, plain.alias("lines")).select(*keep, F.flatten("lines").alias("words"), F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i, F.size(x)))).alias("units"))


def _hashes(length: int) -> Column:
    """The hashes of all runs of so many words in order; none where the text has fewer."""
    w = F.col("words")
    run = lambda x, i: F.xxhash64(x, *(w[i + k] for k in range(1, length)))
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (length - 1), F.lit(0))), run)


def _window_keys(every: int) -> Column:
    """The least shingle in each band of all windows, one every so many words."""
    span = WINDOW - LENGTH + 1
    least = lambda i: F.array(*(F.array_min(F.transform(F.slice("h", i, span), lambda x, c=c: x.bitwiseXOR(F.lit(c)))) for c in ORDERS))
    starts = F.sequence(F.lit(1), F.size("h") - (span - 1), F.lit(every))
    return F.when(F.size("h") >= span, F.flatten(F.transform(starts, least))).otherwise(F.array().cast("array<bigint>"))


def _flags(values: DataFrame) -> bytearray:
    """One byte for each of SLOTS, 1 where a value falls."""
    out = bytearray(SLOTS)
    for (i,) in values.select(F.pmod(values.columns[0], F.lit(SLOTS)).cast("int")).distinct().collect():  # at most SLOTS rows
        out[i] = 1
    return out


def _flagged(x: Column, flags: bytearray) -> Column:
    return F.substring(F.lit(flags), (F.pmod(x, F.lit(SLOTS)) + 1).cast("int"), F.lit(1)) == F.lit(bytearray(b"\x01"))


def template_table(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(n).alias("template"), F.lit(t).alias("text")) for n, t in TEMPLATES))
    return spark.range(1).select(F.inline(rows))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if all rows take at most BROADCAST_BYTES; else left to a shuffled join."""
    size = df.agg(F.sum(F.octet_length("template") + 32)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def scan(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_hash, template, containment, first_unit) of every license found."""
    cuts = _words(templates.where("template IS NOT NULL AND text IS NOT NULL"), "template").where("size(words) > 0").withColumn("h", _hashes(LENGTH))
    own = F.coalesce(*(F.when(F.size("words") == n, _hashes(n)) for n in range(1, LENGTH)), F.col("h"))
    wanted = cuts.select("template", F.least(F.size("words"), F.lit(LENGTH)).alias("length"), F.explode(own).alias("shingle")).distinct()
    lengths = sorted(r.length for r in wanted.select("length").distinct().collect())
    wanted = wanted.join(wanted.groupBy("template").agg(F.count("*").alias("of")), "template").drop("length")
    keys = cuts.select("template", F.explode(F.when(F.size("words") >= 2 * WINDOW, _window_keys(1)).otherwise(own)).alias("key")).distinct()
    shingle_flags, key_flags = _flags(wanted.select("shingle")), _flags(keys.select("key"))
    text = F.col("text").cast("string")
    src = _words(docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")), "doc_id", "text_hash").withColumn("h", _hashes(LENGTH))
    runs = [F.arrays_zip((F.col("h") if n == LENGTH else _hashes(n)).alias("shingle"), F.slice("units", 1, F.greatest(F.size("units") - (n - 1), F.lit(0))).alias("unit")) for n in lengths]
    runs = F.concat(*runs) if runs else F.array().cast("array<struct<shingle:bigint,unit:int>>")
    # no filters on arrays here: pushed down, they would compute them anew for each element
    src = src.select("doc_id", "text_hash", "h", F.filter(runs, lambda r: _flagged(r["shingle"], shingle_flags)).alias("hits"))
    near = F.concat(F.filter(_window_keys(STRIDE), lambda x: _flagged(x, key_flags)), F.transform("hits", lambda r: r["shingle"]))
    met = src.select("doc_id", "text_hash", "hits", F.explode_outer(F.array_distinct(near)).alias("key")).join(_small(keys), "key")
    met = met.groupBy("doc_id", "text_hash", "template").agg(F.first("hits").alias("hits"))
    hits = met.select("doc_id", "text_hash", "template", F.inline("hits")).join(_small(wanted), ["template", "shingle"])
    each = hits.groupBy("doc_id", "text_hash", "template", "of", "shingle").agg(F.min("unit").alias("unit"))
    return each.groupBy("doc_id", "text_hash", "template", "of").agg((F.count("*") / F.col("of")).alias("containment"), F.min("unit").alias("first_unit")).where(F.col("containment") >= containment).drop("of")


def license_report(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """One row a document row: doc_id, n_licenses, licenses (sorted), best_containment, first_unit."""
    found = scan(docs, templates, containment).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("template")).alias("licenses"), F.max("containment").alias("best_containment"), F.min("first_unit").alias("first_unit"))
    base = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    none: Column = F.array().cast("array<string>")
    return base.join(found, same(base, found, "doc_id", "text_hash"), "left").select(
        base.doc_id, F.coalesce(F.size("licenses"), F.lit(0)).alias("n_licenses"), F.coalesce("licenses", none).alias("licenses"), "best_containment", "first_unit"
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    report = license_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), template_table(spark))
    return report.withColumn("licenses", F.array_join("licenses", ","))


def _sql_grams(src: str) -> str:
    """Runs of LENGTH words of (rid, text), each with the unit in which it begins."""
    after = ", ".join(f"lead(word, {k}) OVER (PARTITION BY rid ORDER BY unit, i) AS w{k}" for k in range(1, LENGTH))
    gram = " || ' ' || ".join(["word", *(f"w{k}" for k in range(1, LENGTH))])
    return rf"""(SELECT rid, unit, {gram} AS gram FROM (SELECT rid, unit, word, {after} FROM (
        SELECT rid, unit, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM (
            SELECT rid, unit, list_filter(string_split(regexp_replace(line, '[^a-z0-9\x{{80}}-\x{{ffff}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM (
                SELECT rid, unnest(range(0, len(lines))) AS unit, unnest(lines) AS line FROM (
                    SELECT rid, string_split(regexp_replace(lower(text), '([.!?])[ \t\n\x0b\x0c\r]+', '\1' || chr(10), 'g'), chr(10)) AS lines FROM {src} WHERE text IS NOT NULL))))) WHERE w{LENGTH - 1} IS NOT NULL)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
     t(rid, text) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(x)})" for n, x in TEMPLATES)}),
     tg AS (SELECT DISTINCT rid AS template, gram FROM {_sql_grams("t")}),
     n AS (SELECT template, count(*) AS n FROM tg GROUP BY template),
     hit AS (SELECT g.rid, tg.template, g.gram, min(g.unit) AS unit FROM {_sql_grams("d")} g JOIN tg ON g.gram = tg.gram GROUP BY g.rid, tg.template, g.gram),
     found AS (SELECT rid, template, count(*) / n.n AS share, min(unit) AS unit FROM hit JOIN n USING (template) GROUP BY rid, template, n.n HAVING count(*) / n.n >= {CONTAINMENT})
SELECT doc_id, count(template)::INTEGER AS n_licenses, coalesce(string_agg(template, ',' ORDER BY template), '') AS licenses, max(share) AS best_containment, min(unit)::INTEGER AS first_unit
FROM d LEFT JOIN found USING (rid) GROUP BY rid, doc_id
"""
