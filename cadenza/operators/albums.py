"""Folders: singles or albums, uniform stream properties, and where singles go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import cut, small
from .rename import sidecar_moves


def folder_classes(tracks: DataFrame) -> DataFrame:
    """(parent, n_files, n_albums, is_single): at most two files, or tracks of several albums; unreadable files (null album) count as files only."""
    named = tracks.withColumn("_album", F.when(F.col("album").isNotNull(), T.normalize_text("album")))
    return named.groupBy("parent").agg(F.count("*").alias("n_files"), F.count_distinct("_album").alias("n_albums")).withColumn("is_single", (F.col("n_files") <= 2) | (F.col("n_albums") > 1))


def first_wins(actions: DataFrame) -> DataFrame:
    """Of actions with equal destination the one with the least source; an aggregate, as one destination may be wanted by very many."""
    rest = [c for c in actions.columns if c not in ("src", "dst")]
    first = actions.groupBy("dst").agg(F.min(F.struct("src", *rest)).alias("_first"))
    return first.select(*(c if c == "dst" else F.col(f"_first.{c}") for c in actions.columns))


def plan_singles(tracks: DataFrame, existing: DataFrame, target: str) -> DataFrame:
    """(src, dst, kind) moves of single tracks to target/Artist/Artist - Title.ext; taken destinations and later twins are left out.

    Tracks that could not be read (read_error) count as files of their folder but stay where they are.
    """
    single = folder_classes(tracks).where("is_single").select("parent")
    if "read_error" in tracks.columns:
        tracks = tracks.where("read_error IS NULL")
    artist, title = T.sanitize_name("artist"), T.sanitize_name("title")
    dst = F.concat(F.lit(target.rstrip("/") + "/"), artist, F.lit("/"), artist, F.lit(" - "), title, F.col("ext"))
    moves = tracks.join(single, "parent", "left_semi").select(F.col("path").alias("src"), dst.alias("dst"), F.lit("move").alias("kind")).where("src <> dst")
    first = cut(first_wins(moves))  # whether a place is taken is the same for all who want it
    taken = cut(existing.select(F.col("path").alias("dst")).join(small(first.select("dst")), "dst", "left_semi").distinct())
    return cut(first.join(small(taken), "dst", "left_anti").select("src", "dst", "kind"))


def with_sidecars(moves: DataFrame, existing: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Moves plus those of the .lrc files beside them; one that tracks share goes with the first of them, and of equal free places the first source gets it."""
    owners = moves.select(F.col("src").alias("path")) if tracks is None else tracks
    lrc = sidecar_moves(moves, existing, owners).where("status = 'planned'").drop("status")
    return moves.select("src", "dst", "kind").unionByName(lrc)


def emptied_folders(moves: DataFrame, files: DataFrame) -> DataFrame:
    """Parents all of whose files move away."""
    gone = cut(moves.select(F.col("src").alias("path"), F.lit(1).alias("_moved")).distinct())
    moved = files.join(small(gone), "path", "left")
    return moved.groupBy("parent").agg(F.count("*").alias("n"), F.count("_moved").alias("n_moved")).where("n = n_moved").select("parent")


def gain_modes(tracks: DataFrame, *keys: str) -> DataFrame:
    """Per group (the whole library without keys) of FLAC tracks: 'skip' where an album gain exists, 'album' if all streams are alike, else 'track'."""
    kind = F.struct("sample_rate", "channels", "bits")
    mode = F.when(F.col("has_gain"), "skip").when(F.col("kinds") <= 1, "album").otherwise("track")
    return tracks.where("ext = '.flac'").groupBy(*keys).agg(F.count("*").alias("n_files"), F.count_distinct(kind).alias("kinds"), F.bool_or("has_album_gain").alias("has_gain")).withColumn("mode", mode)


def album_covers(tracks: DataFrame, covers: DataFrame) -> DataFrame:
    """Tracks with their folder's cover, null where there is none; one cover a folder, the least of several."""
    rest = [c for c in covers.columns if c != "parent"]
    one = covers.groupBy("parent").agg(F.min(F.struct(*rest)).alias("_one")).select("parent", *(F.col(f"_one.{c}") for c in rest))
    return tracks.join(one, "parent", "left")
