"""A library tree as a table.

``binaryFile`` skips names that begin with '_' or '.' and reads brackets in paths as
patterns, so the walk is a Python data source.  Folders are opened from the root down
until there are ``TASKS`` of them, each then a task of its own; a task holds one file's
row at a time.  ``decoded`` is the seam for whatever reads the files' contents.
"""

from __future__ import annotations

import os
import stat
import sys
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import text as T
from ..functions.tables import AUDIO_EXTENSIONS
from .sink import HOME
from .tags import read_tags


TASKS = 64


SCHEMA = "path string, parent string, stem string, ext string, length bigint, modified timestamp, changed bigint"


class LibraryWalk(DataSource):
    """Options: path, the root folder; settle, seconds that a file must rest before a stream reads it.

    Equality and membership of ext, and equality and prefix of parent, are decided by the walk: files of other
    endings are not looked at, and folders that cannot hold wanted ones are not opened.  As a stream, the offset is
    a moment; each batch has the files that were written, moved or renamed since the last one.
    """

    @classmethod
    def name(cls) -> str:
        return "library_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _ChangeReader(self.options["path"], float(self.options.get("settle", "2")))


class _Walk:
    """The files below a root that pass the pushed filters."""

    def __init__(self, root: str):
        self.root, self.exts, self.parents, self.prefixes = root, None, None, []

    def may_hold(self, folder: str) -> bool:
        """Whether the folder or one below it can be wanted."""
        below = folder.rstrip("/") + "/"
        return (self.parents is None or any(p == folder or p.startswith(below) for p in self.parents)) and all(folder.startswith(p) or p.startswith(below) or p == folder for p in self.prefixes)

    def wanted(self, folder: str) -> bool:
        return (self.parents is None or folder in self.parents) and all(folder.startswith(p) for p in self.prefixes)

    def trees(self) -> list[tuple[str, bool]]:
        """(folder, whether with all below it)."""
        flat, trees = [], [self.root]
        while trees and len(flat) + len(trees) < TASKS:
            flat += trees
            trees = [e.path for t in trees for e in sorted(os.scandir(t), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and e.name != HOME and self.may_hold(e.path)]
        return [(f, False) for f in flat] + [(t, True) for t in trees]

    def rows(self, top: str, below: bool, after: int = -1, until: int | None = None) -> Iterator[tuple]:
        for folder, folders, names in os.walk(top):
            folders[:] = [f for f in folders if below and f != HOME and self.may_hold(os.path.join(folder, f))]
            if not self.wanted(folder):
                continue
            for n in names:
                ext = n[n.rindex(".") :].lower() if "." in n[1:] and not n.endswith(".") else ""
                if self.exts is not None and ext not in self.exts:
                    continue
                path = os.path.join(folder, n)
                try:
                    st = os.stat(path)
                except OSError:  # gone since its folder was read
                    continue
                changed = max(st.st_mtime_ns, st.st_ctime_ns)
                if stat.S_ISREG(st.st_mode) and changed > after and (until is None or changed <= until):
                    yield path, folder, n[: len(n) - len(ext)], ext, st.st_size, datetime.fromtimestamp(st.st_mtime, timezone.utc), changed


class _Reader(DataSourceReader, _Walk):
    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            column, kind = getattr(f, "attribute", ()), type(f).__name__
            if kind in ("EqualTo", "In") and column == ("ext",):
                values = set(f.value if kind == "In" else [f.value])
                self.exts = values if self.exts is None else self.exts & values
            elif kind in ("EqualTo", "In") and column == ("parent",):
                values = set(f.value if kind == "In" else [f.value])
                self.parents = values if self.parents is None else self.parents & values
            elif kind == "StringStartsWith" and column == ("parent",):
                self.prefixes.append(f.value)
            elif not (kind == "IsNotNull" and column in (("ext",), ("parent",))):
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(t) for t in self.trees()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.rows(*partition.value)


class _ChangeReader(DataSourceStreamReader, _Walk):
    """Moments are nanoseconds of the later of modification and status change, so that a file moved in with an old date counts too."""

    def __init__(self, root: str, settle: float):
        _Walk.__init__(self, root)
        self.settle = settle

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((*t, start["until"], end["until"])) for t in self.trees()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.rows(*partition.value)

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are done."""


def _register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
    spark.dataSource.register(LibraryWalk)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All regular files below root: path, parent, stem, ext (lower case), length and modified; filters of ext and parent reach the walk."""
    _register(spark)
    return spark.read.format("library_walk").option("path", root).load().drop("changed")


def scan_changes(spark: SparkSession, root: str, settle: float = 2) -> DataFrame:
    """The same rows as a stream: first all files, then in each batch those changed since the last; a file is read once it has rested for some seconds."""
    _register(spark)
    return spark.readStream.format("library_walk").option("path", root).option("settle", str(settle)).load().drop("changed")


def decoded(files: DataFrame, decode: Callable[[str], dict], schema: str) -> DataFrame:
    """Files with the fields of decode(path), as the schema names them, and read_error; a file that fails has nulls and its message.

    decode runs on the executors, a batch of paths at a time: tag readers, fingerprints, checksums and tempo tools fit here.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = files.sparkSession
    out = spark.createDataFrame([], f"path string, {schema}, read_error string").schema
    fields = to_arrow_schema(out)

    def one(path: str) -> dict:
        try:
            return {**decode(path), "path": path, "read_error": None}
        except Exception as e:  # a row's failure is a value, not the job's
            return {"path": path, "read_error": f"{type(e).__name__}: {e}"}

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([one(p) for p in b.column(0).to_pylist()], fields)

    return files.join(files.select("path").mapInArrow(run, out), "path", "left")


def audio(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isin(*AUDIO_EXTENSIONS))


def sidecars(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext") == ".lrc").select("parent", "stem")


def lyrics(spark: SparkSession, root: str) -> DataFrame:
    """(parent, stem, text) of .lrc files; undecodable bytes are dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[lL][rR][cC]").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    text = F.regexp_replace(F.regexp_replace(F.expr("make_valid_utf8(string(content))"), "\ufffd", ""), "\r\n?", "\n")
    return raw.select(T.parent(path).alias("parent"), T.stem(path).alias("stem"), text.alias("text"))


def tag(tags, name: str):
    """First value of a tag in a map<string,array<string>>: lower-case key, then upper; '' is missing."""
    low, up = (F.try_element_at(F.try_element_at(tags, F.lit(n)), F.lit(1)) for n in (name.lower(), name.upper()))
    return F.coalesce(T.present(low), T.present(up))


def tracks_from_tags(raw: DataFrame, *keep: str) -> DataFrame:
    """Track fields from (path, tags, sample_rate, bitrate, channels), with the sentinels of missing names, and the columns to keep."""
    t = F.col("tags")
    g = lambda n: tag(t, n)
    return raw.select(
        "path", T.parent("path").alias("parent"), F.coalesce(g("artist"), F.lit("Unknown Artist")).alias("artist"), F.coalesce(g("title"), F.lit("Unknown Title")).alias("title"),
        F.coalesce(g("album"), F.lit("Unknown Album")).alias("album"), g("albumartist").alias("album_artist"), T.track_number(g("tracknumber")).alias("track_number"), F.lit(1).alias("disc_number"),
        F.coalesce(g("date"), g("year")).alias("date"), T.normalize_genre(g("genre")).alias("genre"), g("isrc").alias("isrc"), T.decimal_number(g("bpm")).alias("bpm"),
        T.present(F.try_element_at(F.try_element_at(t, F.lit("musicbrainz_trackid")), F.lit(1))).alias("mbid"), T.present(F.try_element_at(F.try_element_at(t, F.lit("musicbrainz_albumid")), F.lit(1))).alias("album_mbid"),
        "sample_rate", "bitrate", "channels", F.lit(True).alias("is_lossless"), *keep,
    )


def read_tracks(files: DataFrame) -> DataFrame:
    """Track fields and read_error of files (path), from their own tags."""
    return tracks_from_tags(read_tags(files), "bits", "read_error")


def covers(files: DataFrame) -> DataFrame:
    """(parent, cover): each folder's cover picture."""
    return files.where(F.lower(T.base_name("path")) == "cover.jpg").groupBy("parent").agg(F.min("path").alias("cover"))


def projection(tracks: DataFrame) -> DataFrame:
    """The report's view of a track: file name added, album artist falls back to the artist."""
    return tracks.select(
        F.col("path").alias("file_path"), T.base_name("path").alias("file_name"), "artist", "title", "album", F.coalesce(T.present("album_artist"), "artist").alias("album_artist"),
        "track_number", "disc_number", "date", "genre", "isrc", "bpm", "track_gain", "track_peak", "mbid", "sample_rate", "bitrate", "is_lossless",
    )
