"""Text normalisation as Column functions.

``fold`` (lower case without combining marks) is the one Arrow UDF: Spark has no
canonical decomposition.  Everything else stays in the JVM.  An empty string
counts as missing wherever the library treats it so, hence ``present``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .tables import ARTIST_ALIASES, BRACKET_KEYWORDS, BROAD_GENRES, GENRE_BLACKLIST, GENRE_NAMES, LYRICS_JUNK

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_ENDS = r"^\s+|(?<!\s)\s++\z"  # linear: a run of blanks is entered at its start alone, and never twice
_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """Null for an empty string."""
    return F.nullif(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends (SQL trim takes spaces only)."""
    return F.regexp_replace(_col(c), _ENDS, "")


def _folder():
    # a local function travels to the executors by value, so that they need no copy of this package
    import unicodedata

    def one(s):
        if s is None or s.isascii():
            return s and s.lower()
        return "".join(ch for ch in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(ch) != "Mn")

    def fold_array(values: pa.Array) -> pa.Array:
        # a few texts at a time are Python strings, whatever the batch holds
        parts = (values.slice(i, 64).to_pylist() for i in range(0, max(len(values), 1), 64))
        return pa.concat_arrays([pa.array([one(s) for s in part], values.type) for part in parts])

    return F.arrow_udf(fold_array, "string")


def fold(c: Column | str) -> Column:
    """Lower case without combining marks; ASCII text never leaves the JVM."""
    other = _col(c).rlike(r"[^\x00-\x7F]")
    return F.when(other, _folder()(F.when(other, _col(c)))).otherwise(F.lower(_col(c)))


def _clean(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def normalize_text(c: Column | str) -> Column:
    """Lower case, no marks, words of letters and digits separated by one space; '' for null."""
    return _clean(fold(F.translate(F.coalesce(_col(c), F.lit("")), "$", "s")))


def normalize_ascii(c: Column) -> Column:
    """normalize_text for expressions over fixed or ASCII text: no UDF."""
    return _clean(F.lower(F.translate(F.coalesce(c, F.lit("")), "$", "s")))


def normalize_date(c: Column | str) -> Column:
    """The first yyyy-mm-dd, else the first four digits, else the stripped text; null for '' and null."""
    s = strip(present(c))
    return F.coalesce(F.regexp_substr(s, F.lit(r"\d{4}-\d{2}-\d{2}")), F.regexp_substr(s, F.lit(r"\d{4}")), s)


def title_case(c: Column | str) -> Column:
    """Capital after every non-letter, as in 'Hip-Hop' and "Don'T"."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def _any_of(terms: list[str]) -> str:
    return "|".join("\\Q" + t + "\\E" for t in terms)


def is_number(c: Column) -> Column:
    bare = F.lower(F.translate(c, ",", ""))
    return bare.rlike(_NUMBER) | bare.rlike(r"^[+-]?(inf|infinity|nan)$")


def normalize_genre(c: Column | str) -> Column:
    """A known genre name, the title-cased text, or null for numbers, blacklisted terms and phrases without a broad genre."""
    raw = _col(c)
    s = strip(raw)
    low, title = F.lower(s), title_case(s)
    names = F.create_map(*[F.lit(x) for kv in GENRE_NAMES.items() for x in kv])
    words = F.size(F.filter(F.split(title, r"\s+"), lambda w: w != ""))
    return (
        F.when(raw.isNull() | (raw == ""), raw)
        .when(is_number(s), F.lit(None).cast("string"))
        .when(low.rlike(_any_of([t.lower() for t in GENRE_BLACKLIST])), F.lit(None).cast("string"))
        .when((words >= 2) & ~low.rlike(_any_of(BROAD_GENRES)), F.lit(None).cast("string"))
        .otherwise(F.coalesce(F.try_element_at(names, title), title))
    )


def sanitize_name(c: Column | str) -> Column:
    """Safe as a file name: slashes become '_', other reserved characters go, and so do dots at the end."""
    s = F.translate(present(c), '/\\<>:"|?*', "__")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^ | $", ""), r"\.+$", "")
    return F.coalesce(present(s), F.lit("Unknown"))


def canonical_artist(c: Column | str) -> Column:
    """The stage name for a known alias of the normalised artist, else the stripped text."""
    names = F.create_map(*[F.lit(x) for kv in ARTIST_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, normalize_text(c)), strip(c))


def bracket_groups(c: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(\[.*?\]|\(.*?\))"), F.lit(1))


def bracket_issues(c: Column | str) -> Column:
    """A message for each bracket group that holds a junk keyword, in text order, repeats kept."""
    # groups hold no line breaks and folding makes none; just the groups are folded, however long the text is
    raw = bracket_groups(c)
    pairs = F.arrays_zip(raw.alias("raw"), F.split(fold(F.array_join(raw, "\n")), "\n").alias("low"))
    bad = F.filter(pairs, lambda g: normalize_ascii(g["low"]).rlike(_any_of(BRACKET_KEYWORDS)))
    return F.transform(bad, lambda g: F.concat(F.lit("Corrupt bracket metadata: '"), g["raw"], F.lit("'")))


#: 'Embed' marks at the end, with digits before them on their line; possessive, so that long runs of blanks or digits cost one pass.
_TRAILING_MARKS = r"(?i)(?:(?:(?<!\s)\s++\d*+|(?<![\s\d])\d*+)[^\S\n]*+(?<![\p{L}\p{N}_])embed)++\z"


def clean_lyrics(c: Column | str) -> Column:
    """Lyrics without scraping residue; timestamped lines stay as they are."""
    raw = _col(c)
    junk = "(?i)" + "|".join(f"(?:{p})" for p in LYRICS_JUNK)
    lines = F.transform(F.split(raw, _BREAKS), lambda x: F.when(strip(x) == "", F.lit("")).otherwise(x))
    kept = F.filter(lines, lambda x: strip(x).rlike(r"^(?:\[|<\d{1,2}:\d{2})") | ~strip(x).rlike(junk))
    text = F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")
    return F.when(raw.isNull() | (raw == ""), raw).otherwise(strip(F.regexp_replace(strip(text), _TRAILING_MARKS, "")))


_WORD_TIME = r"<\d{1,2}:\d{2}[.:]\d{2,3}>"


def has_word_times(c: Column | str) -> Column:
    return _col(c).rlike(_WORD_TIME)


def strip_word_times(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), _WORD_TIME, "")


def lyrics_files(c: Column | str) -> list[Column]:
    """Text of the enhanced sidecar (null without word times) and of the plain one."""
    return [F.when(has_word_times(c), _col(c)).alias("enhanced"), strip_word_times(c).alias("plain")]


def sync_headers(text: Column | str, artist: Column | str, title: Column | str) -> Column:
    """Lyrics whose [ar:] and [ti:] lines name the given artist and title; missing ones come first."""
    ar, ti = F.concat(F.lit("[ar:"), artist, F.lit("]")), F.concat(F.lit("[ti:"), title, F.lit("]"))
    lines = F.split(_col(text), "\n")
    new = F.transform(lines, lambda x: F.when(x.startswith("[ar:"), ar).when(x.startswith("[ti:"), ti).otherwise(x))
    no = lambda p: ~F.exists(lines, lambda x: x.startswith(p))
    head = F.concat(F.when(no("[ar:"), F.concat(ar, F.lit("\n"))).otherwise(""), F.when(no("[ti:"), F.concat(ti, F.lit("\n"))).otherwise(""))
    return F.concat(head, F.array_join(new, "\n"))


def artwork_url(results: Column | str, size: int = 1400) -> Column:
    """The first result's artwork in another size."""
    url = F.try_element_at(_col(results), F.lit(1)).getField("artworkUrl100")
    return F.replace(url, F.lit("100x100bb"), F.lit(f"{size}x{size}bb"))


def top_tags(names: Column | str, n: int = 5) -> Column:
    """The first n non-empty tag names, title-cased."""
    return F.slice(F.transform(F.filter(_col(names), lambda x: x.isNotNull() & (x != "")), title_case), 1, n)


def string_names(variants: Column | str) -> Column:
    """Tag names of an array<variant> of objects; names that are not strings are left out."""
    named = F.transform(_col(variants), lambda v: F.when(F.schema_of_variant(F.try_variant_get(v, "$.name", "variant")) == "STRING", F.try_variant_get(v, "$.name", "string")))
    return F.filter(named, lambda x: x.isNotNull() & (x != ""))


def lookup_key(provider: str, *parts: Column | str) -> Column:
    """Provider and normalised parts joined by ':'."""
    return F.concat_ws(":", F.lit(provider), *map(normalize_text, parts))


def query_string(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *(present(strip(p)) for p in parts))


def track_file_name(number: Column | str, artist: Column | str, title: Column | str) -> Column:
    """'NN - artist - title' with number 1 where it is missing or 0."""
    n = F.coalesce(F.nullif(_col(number).cast("int"), F.lit(0)), F.lit(1))
    return strip(F.regexp_replace(F.format_string("%02d - %s - %s", n, sanitize_name(artist), sanitize_name(title)), r"\s+", " "))


def story(c: Column | str) -> Column:
    """Null for an empty text, '?' or a placeholder."""
    s = strip(c)
    return F.when((s != "") & (s != "?") & ~F.lower(s).contains("lyrics for this song"), s)


def track_number(c: Column | str) -> Column:
    return strip(F.split_part(_col(c), F.lit("/"), F.lit(1))).try_cast("int")


def decimal_number(c: Column | str) -> Column:
    return F.when(strip(c).rlike(_NUMBER), strip(c).try_cast("double"))


def bpm_rounded(c: Column | str) -> Column:
    return F.bround(_col(c), 1)


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, part * 100.0 / total).otherwise(F.lit(0.0))


def number_after(text: Column | str, pattern: str) -> Column:
    """The number that the pattern's group catches in a tool's output, null where it is absent."""
    return F.nullif(F.regexp_extract(_col(text), pattern, 1), F.lit("")).try_cast("double")


def rms_amplitude(text: Column | str) -> Column:
    """The RMS amplitude a spectral tool prints; 0 where it prints none, as for silence."""
    return F.when(_col(text).isNotNull(), F.coalesce(number_after(text, r"RMS\s+amplitude:\s+([\d.]+)"), F.lit(0.0)))


def printed_bpm(text: Column | str) -> Column:
    """The tempo a tool prints, rounded to one decimal; null where it is absent or not above 0."""
    n = number_after(text, r"([\d.]+)\s*BPM")
    return F.when(n > 0, bpm_rounded(n))


def path_parts(path: Column | str) -> Column:
    """Sorts paths by component, as file trees are listed: 'a/b' before 'a-b'."""
    return F.split(_col(path), "/")


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def parent(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def with_suffix(path: Column | str, suffix: str) -> Column:
    return F.concat(F.regexp_replace(_col(path), r"(?<=[^/])\.[^./]+$", ""), F.lit(suffix))


def register(spark: SparkSession) -> None:
    """The functions for SQL callers: one Arrow UDF, the rest inlined expressions."""
    spark.udf.register("fold_text", _folder())
    for name, body in {
        "normalize_text": "trim(regexp_replace(fold_text(translate(coalesce(x, ''), '$', 's')), '[^\\\\p{L}\\\\p{N}]+', ' '))",
        "normalize_date": "coalesce(regexp_substr(nullif(x, ''), '\\\\d{4}-\\\\d{2}-\\\\d{2}'), regexp_substr(nullif(x, ''), '\\\\d{4}'), regexp_replace(nullif(x, ''), '^\\\\s+|\\\\s+$', ''))",
        "sanitize_name": "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(translate(x, '/\\\\<>:\"|?*', '__'), '\\\\s+', ' '), '^ | $', ''), '[.]+$', ''), ''), 'Unknown')",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
