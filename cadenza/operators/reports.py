"""Reports as one-row tables of JSON, or as one line a file for large libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.library import projection
from .audit import counters

GENERATOR = "cadenza"


def tag_statistics(tracks: DataFrame) -> DataFrame:
    """total, and count and percentage of tracks with bpm, gain, mbid and genre."""
    out = tracks.agg(F.count("*").alias("total"), F.count("bpm").alias("with_bpm"), F.count("track_gain").alias("with_gain"), F.count(T.present("mbid")).alias("with_mbid"), F.count(T.present("genre")).alias("with_genre"))
    return out.select("*", *(T.percent(F.col(f"with_{c}"), F.col("total")).alias(f"{c}_percent") for c in ("bpm", "gain", "mbid", "genre")))


def audit_report(audited: DataFrame, target: str) -> DataFrame:
    """(value): the audit report as one row; its issues map holds files that have any, by path.  For libraries beyond one row's size there is ``audit_lines``."""
    per = audited.where(F.size("issues") > 0).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "issues")))).alias("issues"))
    c = counters(audited).crossJoin(per)  # one row each
    said = F.format_string(
        f"{GENERATOR} audited %d files in '%s'. Audit status: %d corrupted files, %d missing metadata, %d missing LRCs. Total files with issues: %d.",
        "total_files", F.lit(target), "corrupt_files", "missing_metadata", "missing_lrc", "files_with_issues",
    )
    summary = F.struct("total_files", "corrupt_files", "missing_metadata", "missing_lrc", "files_with_issues")
    return c.select(F.to_json(F.struct(F.lit("audit_report_v1").alias("schema"), F.lit(GENERATOR).alias("generator"), said.alias("llm_summary"), F.lit(target).alias("target_path"), summary.alias("summary"), "issues"), {"ignoreNullFields": "false"}).alias("value"))


def audit_lines(audited: DataFrame) -> DataFrame:
    """(value): one JSON object a file that has issues; any number of files, no shuffle."""
    return audited.where(F.size("issues") > 0).select(F.to_json(F.struct("path", "issues")).alias("value"))


def tag_lines(tracks: DataFrame) -> DataFrame:
    """(value): one JSON object a track."""
    rows = projection(tracks)
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def tag_report(tracks: DataFrame, now: str) -> DataFrame:
    """(value): the tag report with statistics and all tracks."""
    rows = projection(tracks).agg(F.sort_array(F.collect_list(F.struct(*projection(tracks).columns))).alias("tracks"))
    s = tag_statistics(tracks).crossJoin(rows)
    stats = F.struct("total", "with_bpm", "with_gain", "with_mbid", "with_genre", *(F.bround(f"{c}_percent", 1).alias(f"{c}_percent") for c in ("bpm", "gain", "mbid", "genre")))
    return s.select(F.to_json(F.struct(F.lit("tag_report_v1").alias("schema"), F.lit(GENERATOR).alias("generator"), F.lit(now).alias("generated_at"), stats.alias("summary"), "tracks"), {"ignoreNullFields": "false"}).alias("value"))
