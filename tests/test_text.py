import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cadenza.functions import tables as K
from cadenza.functions import text as T


def column(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn("x").alias("y")).orderBy("i").collect()]


def spec_normalize(s):
    s = (s or "").replace("$", "s").lower()
    s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    return " ".join("".join(c if c.isalnum() else " " for c in s).split())


def test_normalize_text(spark):
    rng = random.Random(1)
    odd = ["".join(rng.choice("aÀ é$_-!ß½øȘ\t\n'漢") for _ in range(12)) for _ in range(300)]
    values = ["$tring!", "Mötley Crüe", "A$AP Rocky!", "Beyoncé - Nöél", "", None, *odd]
    got = column(spark, T.normalize_text, values)
    assert got[:6] == ["string", "motley crue", "asap rocky", "beyonce noel", "", ""]
    assert got == [spec_normalize(v) for v in values]


def test_sanitize_name(spark):
    values = ["AC/DC", "Artist: Album?", "Track 01.flac.", "Artist / Title <HQ>:", "", None, "...", "A . ", "a\\b|*"]
    assert column(spark, T.sanitize_name, values) == ["AC_DC", "Artist Album", "Track 01.flac", "Artist _ Title HQ", "Unknown", "Unknown", "Unknown", "A ", "a_b"]


def test_normalize_date(spark):
    assert column(spark, T.normalize_date, ["2020-01-02T00", "c. 1999", " soon ", "", None, "12345"]) == ["2020-01-02", "1999", "soon", None, None, "1234"]


def test_normalize_genre(spark):
    cases = {
        "hip-hop": "Hip-Hop/Rap", "rap": "Hip-Hop/Rap", "Rnb": "R&B", "R&B": "R&B/Soul", "Top 40 Pop": None, "1,234": None, "90d": "90D", "NaN": None, "Western": None,
        "Drum And Bass": None, "acid jazz": "Acid Jazz", "blue thing": None, "polka": "Polka", "": "", None: None, "indie rock": "Indie", "Hot-100": "Hot-100",
    }
    assert column(spark, T.normalize_genre, list(cases)) == list(cases.values())


def test_title_case_follows_letters(spark):
    values = ["hip-hop", "don't", "éa ßa", "90d", "A1b"]
    assert column(spark, T.title_case, values[:2] + values[3:]) == [v.title() for v in values[:2] + values[3:]]


def test_artist_aliases(spark):
    assert column(spark, T.canonical_artist, ["mgl", "killa fonic", "nane", " Someone ", "Ștefan Mihalache", "M.G.L"]) == ["M.G.L.", "Killa Fonic", "Nane", "Someone", "Connect-R", "M.G.L"]


def test_brackets(spark):
    got = column(spark, T.bracket_issues, ["Song [Official Video]", "Song (Remix)", "a (Trip) [HQ] (hd)", "(Vidéo)", None])
    msg = "Corrupt bracket metadata: '{}'".format
    assert got == [[msg("[Official Video]")], [], [msg("(Trip)"), msg("[HQ]"), msg("(hd)")], [msg("(Vidéo)")], []]


def spec_lyrics(text):
    """The same in two passes over the whole text."""
    if not text:
        return text
    timed = re.compile(r"\s*(\[|<\d\d?:\d\d)")
    lines = ["" if x.isspace() else x for x in text.split("\n")]
    body = "\n".join(x for x in lines if timed.match(x) or not any(re.match(p, x.strip(), re.I) for p in K.LYRICS_JUNK))
    body = re.sub("\n\n+", "\n\n", body).strip()
    while m := re.search(r"(\d*[ \t]+|^|(?<=[\W_]))embed$", body, re.I):
        if body[: m.end() - 5][-1:] == "_":
            break
        body = body[: m.start()].strip()
    return body


def test_clean_lyrics(spark):
    rng = random.Random(4)
    bits = ["12 Contributors", "[00:12.00] line", "words here", "", "  ", "Read More", "See X LiveGet tickets", "https://x.y/z", "www.a", "Synced by me", "3Embed", "end 14 Embed", "embed", "word14Embed", "line 7", "Producer: a", "[Verse 1]", "<00:01> a"]
    values = [None, "", *("\n".join(rng.choice(bits) for _ in range(rng.randrange(1, 8))) for _ in range(600))]
    assert column(spark, T.clean_lyrics, values) == [spec_lyrics(v) for v in values]


def test_word_times_and_headers(spark):
    assert column(spark, T.strip_word_times, ["<00:12.34>a <1:02:333>b"]) == ["a b"]
    df = spark.createDataFrame([("[ar:x]\n[00:01.00] a",), ("plain",)], "t string")
    got = [r.y for r in df.select(T.sync_headers("t", F.lit("A"), F.lit("B")).alias("y")).collect()]
    assert got == ["[ti:B]\n[ar:A]\n[00:01.00] a", "[ar:A]\n[ti:B]\nplain"]


def test_names_numbers_paths(spark):
    df = spark.createDataFrame([(None, "A/B", "T:"), (0, "x", "y"), (7, None, " z  z ")], "n int, a string, t string")
    assert [r.y for r in df.select(T.track_file_name("n", "a", "t").alias("y")).collect()] == ["01 - A_B - T", "01 - x - y", "07 - Unknown - z z"]
    assert column(spark, T.track_number, ["3/12", " 4", "x", None, ""]) == [3, 4, None, None, None]
    assert column(spark, lambda c: T.with_suffix(c, ".lrc"), ["a/b.c.mp3", "a.b/c", "/x/.hid"]) == ["a/b.c.lrc", "a.b/c.lrc", "/x/.hid.lrc"]
    assert column(spark, T.extension, ["/a/b.FLAC", "/a/b", "/a.x/b"]) == [".flac", "", ""]


def test_json_names_keep_only_strings(spark):
    df = spark.createDataFrame([('[{"name":"pop"},{"name":5},{},3,{"name":""}]',)], "x string")
    assert df.select(T.string_names(F.parse_json("x").cast("array<variant>")).alias("y")).first().y == ["pop"]
    df = spark.createDataFrame([(["pop", "rnb", "", None, "a", "b", "c", "d"],)], "x array<string>")
    assert df.select(T.top_tags("x").alias("y")).first().y == ["Pop", "Rnb", "A", "B", "C"]


def test_artwork_and_story(spark):
    df = spark.sql("SELECT array(named_struct('artworkUrl100', 'http://a/100x100bb.jpg')) AS r")
    assert df.select(T.artwork_url("r").alias("y")).first().y == "http://a/1400x1400bb.jpg"
    assert column(spark, T.story, ["?", "", " fine ", "Lyrics for this song are"]) == [None, None, "fine", None]


@pytest.mark.parametrize("name", ["normalize_text", "normalize_date", "sanitize_name"])
def test_sql_functions(spark, name):
    T.register(spark)
    values = ["Mötley  Crüe", "2020-01-02", "AC/DC: x.", "", None]
    want = column(spark, getattr(T, name), values)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    assert [r.y for r in df.selectExpr("i", f"{name}(x) AS y").orderBy("i").collect()] == want


def test_long_runs_of_blanks_and_digits_cost_one_pass(spark):
    for filler in (" " * 100_000, "\n" * 100_000, "7" * 100_000):
        text = f"la{filler}la\n3 Embed\n Embed "
        got = spark.createDataFrame([(text,)], "t string").select(T.clean_lyrics("t").alias("c"), T.strip("t").alias("s")).first()
        assert got.c == ("la\n\nla" if filler[0] == "\n" else f"la{filler}la") and got.s == text.strip()


def test_only_bracket_groups_are_folded(spark, monkeypatch):
    """The words between brackets do not go to Python; groups equal those of the folded text."""
    texts = ["Ünder [ÓFFICIAL vidéo] é (ΑΣ hd)\n(no\nhq) [riṕ]́ é", "plain [Official Vidéo] (live)", "é" * 50, "", None, "[(320)   hq] (é FLAC)"]
    seen = []
    plain = T.fold
    monkeypatch.setattr(T, "fold", lambda c: seen.append(c) or plain(c))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [x.split("'", 1)[1][:-1] for x in r.b] for r in df.select("i", T.bracket_issues("t").alias("b")).collect()}
    assert got == {0: ["[ÓFFICIAL vidéo]", "(ΑΣ hd)", "[riṕ]"], 1: ["[Official Vidéo]"], 2: [], 3: [], 4: [], 5: ["(320)", "(é FLAC)"]}
    (asked,) = seen
    assert {r.i: r.x for r in df.select("i", asked.alias("x")).collect()}[2] == ""
