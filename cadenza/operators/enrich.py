"""Metadata enrichment: look-ups in snapshot tables, joined by keys, then one precedence expression a field.

Every lookup is reduced to one row a key before it is joined, so that a track stays
one row and repeated requests cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CadenzaError
from ..functions import text as T
from ..staging import cut
from .albums import album_covers, gain_modes


def keyed(tracks: DataFrame) -> DataFrame:
    """Add artist_key, title_key and album_key, after mapping artist aliases."""
    named = tracks.withColumn("artist", T.canonical_artist("artist"))
    return named.withColumns({f"{c}_key": T.normalize_text(c) for c in ("artist", "title", "album")})


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_rows(found: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """What a search gives at most: the first rows of each key."""
    w = Window.partitionBy(*keys).orderBy("pos", "id")
    return found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit).drop("_rank")


#: Length of the pieces by which titles are found.
GRAM = 3


def release_candidates(wanted: DataFrame, titled: DataFrame) -> DataFrame:
    """Pairs of wanted (artist_key, album_key) and titled (artist_key, _title, ...) that may hold the album in the title: all that do, and few others.

    Titles are found by their pieces of ``GRAM`` characters; an album asks for the piece of its own that the fewest
    of its artist's titles have.  An album shorter than that is a piece itself.  Pieces are made twice, to count
    titles and to find them, and are not kept.
    """
    parts = lambda c, size: F.when(F.length(c) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substring(F.col(c), i, F.lit(size)))))
    own = F.when(F.length("album_key") >= GRAM, parts("album_key", GRAM)).otherwise(F.array("album_key"))
    grams = wanted.where(F.length("album_key") > 0).select("artist_key", "album_key", F.explode(own).alias("_gram"))
    asked = grams.select("artist_key", "_gram").distinct()
    every = F.flatten(F.array_compact(F.array(*(parts("_title", n) for n in range(1, GRAM + 1)))))
    counts = titled.select("artist_key", F.explode(every).alias("_gram")).join(asked, ["artist_key", "_gram"], "left_semi").groupBy("artist_key", "_gram").agg(F.count("*").alias("_n"))
    rarest = grams.join(counts, ["artist_key", "_gram"], "left").groupBy("artist_key", "album_key").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_least"))
    probes = cut(rarest.where("_least.n > 0").select("artist_key", "album_key", F.col("_least.gram").alias("_gram")))
    return titled.select("*", F.explode(every).alias("_gram")).join(probes, ["artist_key", "_gram"]).drop("_gram")


def match_release(tracks: DataFrame, releases: DataFrame, fallback: DataFrame | None = None, indexed: bool = False) -> DataFrame:
    """(artist_key, album_key, release_id, release_date): of an artist's releases the first whose title equals or contains the album; else the fallback search's first row.

    An empty album or 'unknown album' matches nothing.  A service gives at most ``RELEASE_LIMIT`` releases an artist, each
    of which is held against the artist's albums; for tables without such a limit, ``indexed`` finds them by pieces of titles.
    """
    wanted = tracks.select("artist_key", "album_key").distinct().where("album_key NOT IN ('', 'unknown album', 'unknown')")
    first = F.min(F.struct("pos", "release_id", "release_date")).alias("_first")
    titled = releases.select("artist_key", "pos", F.col("id").alias("release_id"), F.col("date").alias("release_date"), T.normalize_text("title").alias("_title"))
    titled = titled.groupBy("artist_key", "_title").agg(first).select("artist_key", "_title", "_first.*")  # of equal titles none but the first can be chosen
    pairs = release_candidates(cut(wanted), cut(titled)) if indexed else wanted.join(titled, "artist_key")
    hits = pairs.where(F.col("_title").contains(F.col("album_key")))
    found = hits.groupBy("artist_key", "album_key").agg(first).select("artist_key", "album_key", "_first.release_id", "_first.release_date")
    if fallback is None:
        return found
    other = first_per_key(fallback, ["artist_key", "album_key"], ["pos", "id"]).select("artist_key", "album_key", F.col("id").alias("_id"), F.col("date").alias("_date"))
    both = wanted.join(found, ["artist_key", "album_key"], "left").join(other, ["artist_key", "album_key"], "left")
    took = F.col("release_id").isNotNull()
    return both.select("artist_key", "album_key", F.coalesce("release_id", "_id").alias("release_id"), F.when(took, F.col("release_date")).otherwise(F.col("_date")).alias("release_date")).where("release_id IS NOT NULL")


def match_recording(recordings: DataFrame) -> DataFrame:
    """(artist_key, title_key, text_mbid): the first recording with an id."""
    return first_per_key(recordings.where("id IS NOT NULL AND id <> ''"), ["artist_key", "title_key"], ["pos", "id"]).select("artist_key", "title_key", F.col("id").alias("text_mbid"))


def first_accepted(results: Column | str, threshold: float = 0.8) -> Column:
    """The first result, in list order, whose score reaches the threshold; not the best one."""
    return F.try_element_at(F.filter(results, lambda r: r["score"] >= threshold), F.lit(1))["recording_id"]


def tag_names(tracks: DataFrame, tags: DataFrame) -> DataFrame:
    """Tracks with ``tag_list``: top tags by mbid, or by artist and title where those are empty."""
    by_id = tags.where("mbid IS NOT NULL AND mbid <> ''").groupBy("mbid").agg(F.min("names").alias("_by_id"))
    by_name = tags.groupBy("artist_key", "title_key").agg(F.min("names").alias("_by_name"))
    joined = tracks.join(by_id, "mbid", "left").join(by_name, ["artist_key", "title_key"], "left")
    return joined.withColumn("tag_list", T.top_tags(F.when(F.size(F.coalesce("_by_id", F.array().cast("array<string>"))) > 0, F.col("_by_id")).otherwise(F.col("_by_name")))).drop("_by_id", "_by_name")


def market_row(market: DataFrame) -> DataFrame:
    """(artist_key, album_key, market_year, market_genre): the first listing."""
    one = first_per_key(market, ["artist_key", "album_key"], ["pos", "id"])
    return one.select("artist_key", "album_key", F.col("year").cast("string").alias("market_year"), F.try_element_at("genres", F.lit(1)).alias("market_genre"))


def precedence(force: bool = False) -> dict[str, Column]:
    """The fields of an enriched track from existing, fp_mbid, text_mbid, release, tag, market and measured columns."""
    had, c = T.present, F.col
    mbid = F.coalesce("text_mbid", "fp_mbid", had("mbid")) if force else F.coalesce(had("mbid"), c("fp_mbid"), c("text_mbid"))
    tagged = F.coalesce(T.normalize_genre(F.try_element_at("tag_list", F.lit(1))), had("genre"))
    release_date = F.when(had("album_mbid").isNull() & (F.length("release_date") >= 4), T.normalize_date("release_date"))
    market_date = F.when(tagged.isNull() & (c("market_year") != "0"), T.normalize_date("market_year"))
    return {
        "mbid": mbid,
        "album_mbid": F.coalesce(had("album_mbid"), c("release_id")),
        "date": F.coalesce(had("date"), release_date, market_date),
        "genre": F.coalesce(tagged, T.normalize_genre("market_genre")),
        "bpm": F.coalesce("measured_bpm", "bpm"),
    }


def enrich(tracks: DataFrame, *, releases: DataFrame, fallback: DataFrame, recordings: DataFrame, fingerprints: DataFrame, tags: DataFrame, market: DataFrame, force: bool = False) -> DataFrame:
    """Tracks after the whole chain of look-ups; a table without a match leaves a field as it was."""
    t = keyed(tracks)
    if "measured_bpm" not in t.columns:
        t = t.withColumn("measured_bpm", F.lit(None).cast("double"))
    prints = fingerprints.groupBy("fingerprint").agg(F.min(first_accepted("results")).alias("fp_mbid"))  # one row a fingerprint is meant; of several the least id
    t = t.join(prints, "fingerprint", "left").join(match_recording(recordings), ["artist_key", "title_key"], "left")
    t = t.join(match_release(t, releases, fallback), ["artist_key", "album_key"], "left")
    t = t.withColumn("_own", F.col("mbid")).withColumn("mbid", precedence(force)["mbid"])
    t = tag_names(t, tags).withColumn("mbid", F.col("_own")).drop("_own")
    t = t.join(market_row(market), ["artist_key", "album_key"], "left")
    return t.withColumns(precedence(force)).drop("fp_mbid", "text_mbid", "release_id", "release_date", "tag_list", "market_year", "market_genre", "measured_bpm", "artist_key", "title_key", "album_key")


#: What a caller of ``tag`` may set.
OPTIONS = {"bpm", "replaygain", "lyrics", "art", "force", "workers"}
#: Results that a search gives at most: artwork, and an artist's releases.
ARTWORK_LIMIT, RELEASE_LIMIT = 5, 100


def check_options(names) -> None:
    """Unknown option names are an error, not ignored."""
    if unknown := sorted(set(names) - OPTIONS):
        raise CadenzaError(f"unknown options: {', '.join(unknown)}")


def artist_requests(tracks: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """(artist_key, artist, key) of the discographies to ask for: one an artist, without those in the cache."""
    named = tracks.select("artist", T.normalize_text("artist").alias("artist_key")).where("artist_key <> ''")
    asked = named.groupBy("artist_key").agg(F.min("artist").alias("artist")).withColumn("key", F.concat(F.lit("discography:"), "artist_key"))
    return asked if cached is None else asked.join(cached.select("key"), "key", "left_anti").select("artist_key", "artist", "key")


def artwork_requests(tracks: DataFrame, country: str = "US") -> DataFrame:
    """One search a (artist_key, album_key): term, entity, country, limit, key."""
    term = T.query_string("artist", "album")
    rows = tracks.select("artist_key", "album_key", term.alias("term")).groupBy("artist_key", "album_key").agg(F.min("term").alias("term"))
    return rows.select("*", F.lit("album").alias("entity"), F.lit(country).alias("country"), F.lit(ARTWORK_LIMIT).alias("limit"), F.concat_ws(":", F.lit("artwork"), "artist_key", "album_key", F.lit("album")).alias("key"))


def artwork(tracks: DataFrame, artwork_rows: DataFrame, size: int = 1400) -> DataFrame:
    """Keyed tracks with the URL of their album's cover, for FLAC files only."""
    tracks = tracks.withColumn("_flac", F.lower("path").endswith(".flac"))
    one = artwork_rows.select("artist_key", "album_key", T.artwork_url(F.slice("results", 1, ARTWORK_LIMIT), size).alias("url")).groupBy("artist_key", "album_key").agg(F.min("url").alias("cover_url"))
    return tracks.join(one, ["artist_key", "album_key"], "left").withColumn("cover_url", F.when(F.col("_flac"), F.col("cover_url"))).drop("_flac")


def without_covers(tracks: DataFrame, covers: DataFrame, force: bool = False) -> DataFrame:
    """Tracks with cover, their folder's picture file, and cover_url only where the folder has none or force asks for a new one."""
    held = album_covers(tracks, covers)
    return held if force else held.withColumn("cover_url", F.when(F.col("cover").isNull(), F.col("cover_url")))


def cover_downloads(tracks: DataFrame) -> DataFrame:
    """(dst, url): one picture to fetch a folder, that of its first track which has an address."""
    asked = tracks.where("cover_url IS NOT NULL").withColumn("_path", T.path_parts("path"))
    return first_per_key(asked, ["parent"], ["_path"]).select(F.concat("parent", F.lit("/cover.jpg")).alias("dst"), F.col("cover_url").alias("url"))


def stories(tracks: DataFrame, story_rows: DataFrame) -> DataFrame:
    one = story_rows.select("artist_key", "title_key", T.story("plain").alias("told")).groupBy("artist_key", "title_key").agg(F.min("told").alias("story"))
    return tracks.join(one, ["artist_key", "title_key"], "left")


def lyrics_lookup(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """Keyed tracks with cleaned lyrics; word-timed ones also give the plain form.  An extension ranks several hits: word-timed, line-timed, plain."""
    rank = F.when(T.has_word_times("text"), 0).when(F.col("text").rlike(r"(?m)^\[\d{1,2}:\d{2}"), 1).otherwise(2)
    best = first_per_key(found.withColumn("_quality", rank), ["artist_key", "title_key"], ["_quality", "text"])
    best = best.select("artist_key", "title_key", T.clean_lyrics("text").alias("_text"))
    return tracks.join(best, ["artist_key", "title_key"], "left").select("*", *T.lyrics_files("_text")).drop("_text")


def tag_album(tracks: DataFrame, tables: dict[str, DataFrame], **options) -> DataFrame:
    """Tracks after the look-up chain and the optional steps, each of which an option of ``OPTIONS`` turns off.

    tables: releases, fallback, recordings, fingerprints, tags, market, and artwork, lyrics, stories where those steps
    run.  bpm takes measured_bpm, replaygain adds each folder's gain_mode, art adds cover_url
    (with the table covers, of folders' own pictures, just for folders without one, and cover), lyrics adds enhanced and
    plain sidecar texts; stories are added where the table is given.
    """
    check_options(options)
    on = lambda name: options.get(name, True)
    if not on("bpm"):
        tracks = tracks.withColumn("measured_bpm", F.lit(None).cast("double"))
    names = ("releases", "fallback", "recordings", "fingerprints", "tags", "market")
    tables = {**tables, "releases": first_rows(tables["releases"], ["artist_key"], RELEASE_LIMIT)}
    out = keyed(enrich(tracks, **{n: tables[n] for n in names}, force=options.get("force", False)))
    if on("replaygain"):
        modes = gain_modes(out.withColumn("ext", F.lower(T.extension("path"))), "parent").select("parent", F.col("mode").alias("gain_mode"))
        out = out.join(modes, "parent", "left")
    if on("art"):
        out = artwork(out, tables["artwork"])
        if "covers" in tables:
            out = without_covers(out, tables["covers"], options.get("force", False))
    if on("lyrics"):
        out = lyrics_lookup(out, tables["lyrics"])
    if "stories" in tables:
        out = stories(out, tables["stories"])
    return out.drop("artist_key", "title_key", "album_key")


def lyrics_writes(tagged: DataFrame) -> DataFrame:
    """(path, text): the plain sidecar of each track with lyrics, and the word-timed one beside it."""
    both = [tagged.where(F.length(c) > 0).select(T.with_suffix("path", suffix).alias("path"), F.col(c).alias("text")) for c, suffix in (("plain", ".lrc"), ("enhanced", ".enhanced.lrc"))]
    return both[0].union(both[1])


def desired_tags(tracks: DataFrame, *keep: str) -> DataFrame:
    """(path, tags) and the columns to keep: what to write into each file, only non-empty fields, in the format's own spelling."""
    flac = F.col("path").rlike(r"(?i)\.flac$")
    bpm = F.when(flac, F.format_string("%.1f", "bpm")).otherwise(F.bround("bpm").cast("int").cast("string"))
    fields = {
        "artist": F.col("artist"), "title": F.col("title"), "album": F.col("album"), "albumartist": F.col("album_artist"), "date": F.col("date"), "genre": F.col("genre"),
        "tracknumber": F.col("track_number").cast("string"), "isrc": F.when(flac, F.col("isrc")), "bpm": F.when(F.col("bpm").isNotNull(), bpm),
        "musicbrainz_trackid": F.col("mbid"), "musicbrainz_albumid": F.col("album_mbid"),
        "replaygain_track_gain": F.when(F.col("track_gain").isNotNull(), F.format_string("%+.2f dB", "track_gain")), "replaygain_track_peak": F.when(F.col("track_peak").isNotNull(), F.format_string("%.6f", "track_peak")),
    }
    pairs = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), T.present(v))])
    return tracks.select("path", *keep, F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("tags"))
