"""The library audit: rules per track, a sidecar anti join, and global counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import GENRE_BLACKLIST


def _blacklisted(genre: Column) -> Column:
    return F.coalesce(F.length(genre) > 0, F.lit(False)) & T.normalize_text(genre).rlike("|".join(sorted(" ".join(t.lower().split()) for t in GENRE_BLACKLIST)))


def with_issues(tracks: DataFrame, sidecars: DataFrame, spectral: bool = False, threshold: float = 0.001) -> DataFrame:
    """Add ``issues`` (messages in rule order) to tracks that have path, parent, stem, ext, artist, title, genre, checksum_ok, hf_rms and read_error.

    Missing check results (null) raise no issue; a column checksum_error, if there is one, tells why a check failed; of a track that could not be read only the file checks apply.
    """
    flac = F.col("ext") == ".flac"
    read = F.col("read_error").isNull()
    none = F.array().cast("array<string>")
    say = lambda cond, msg: F.when(cond, F.array(msg)).otherwise(none)
    has = sidecars.select(F.col("parent").alias("_p"), F.col("stem").alias("_s")).distinct().withColumn("_has", F.lit(True))
    joined = tracks.join(has, (F.col("parent") == F.col("_p")) & (F.col("stem") == F.col("_s")), "left").drop("_p", "_s")
    rules = [
        say(flac & ~F.col("checksum_ok"), F.lit("FLAC audio stream MD5 checksum verification failed (corrupted FLAC).")),
        *([say(flac & F.col("checksum_error").isNotNull(), F.concat(F.lit("Checksum check failed: "), F.col("checksum_error")))] if "checksum_error" in tracks.columns else []),
        *([say(flac & (F.col("hf_rms") < threshold), F.lit("Possible fake lossless (spectral cutoff below 16kHz)."))] if spectral else []),
        F.when(read, T.bracket_issues("artist")).otherwise(none),
        F.when(read, T.bracket_issues("title")).otherwise(none),
        say(read & _blacklisted(F.col("genre")), F.concat(F.lit("Blacklisted genre tag: '"), F.col("genre"), F.lit("'"))),
        say(read & (F.coalesce(T.present("artist"), F.lit("Unknown Artist")) == "Unknown Artist"), F.lit("Missing ARTIST tag.")),
        say(read & (F.coalesce(T.present("title"), F.lit("Unknown Title")) == "Unknown Title"), F.lit("Missing TITLE tag.")),
        say(~read, F.concat(F.lit("Metadata read error: "), F.coalesce("read_error", F.lit("")))),
        say(F.col("_has").isNull(), F.lit("Missing synchronized lyrics (.lrc) file.")),
    ]
    return joined.withColumn("issues", F.concat(*rules)).drop("_has")


def _says(issues: Column, *words: str) -> Column:
    """Some message holds all the words, after normalisation."""
    low = lambda x: T.normalize_ascii(x)

    def both(x):
        cond = F.lit(True)
        for w in words:
            cond = cond & low(x).contains(w)
        return cond

    return F.exists(issues, both)


def counters(audited: DataFrame) -> DataFrame:
    """One row: total_files, corrupt_files, missing_metadata, missing_lrc, files_with_issues."""
    i = F.col("issues")
    return audited.agg(
        F.count("*").alias("total_files"),
        F.count_if(_says(i, "corrupt") | _says(i, "checksum")).alias("corrupt_files"),
        F.count_if(_says(i, "missing", "tag")).alias("missing_metadata"),
        F.count_if(_says(i, "missing", "lrc")).alias("missing_lrc"),
        F.count_if(F.size(i) > 0).alias("files_with_issues"),
    )


def issue_rows(audited: DataFrame) -> DataFrame:
    """(path, position, issue), one row an issue."""
    return audited.select("path", F.posexplode("issues").alias("position", "issue"))
