"""Command line: ``tag``, ``audit``, ``rename`` and ``organize`` over a library folder.

Tags are read from the files themselves, or, with ``--tracks``, from a Parquet table of tracks (see
``schemas.TRACKS``) by path.  ``tag`` takes snapshot tables of look-ups from ``--snapshots``, and writes tags
and lyrics.  Exit codes: 0 done, 1 error, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import log, schemas
from .errors import AudioError, CadenzaError
from .functions import text as T
from .operators import actions, albums, audit, enrich, rename, reports
from .sources import library

VERSION = "0.1.0"
LOG = log.console("cadenza")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cadenza")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--dry-run", action="store_true")
    sub = p.add_subparsers(dest="verb")
    verbs = {v: sub.add_parser(v) for v in ("tag", "audit", "rename", "organize")}
    for v in verbs.values():
        v.add_argument("path")
        v.add_argument("--tracks")
    for f in ("--no-bpm", "--no-replaygain", "--no-lyrics", "--no-art", "--force"):
        verbs["tag"].add_argument(f, action="store_true")
    verbs["tag"].add_argument("--snapshots")
    verbs["tag"].add_argument("--plan", help="Parquet folder for the tags to write into each file")
    verbs["tag"].add_argument("--out", help="Parquet folder for the enriched tracks")
    for k in ("--lastfm-key", "--acoustid-key", "--discogs-token"):
        verbs["tag"].add_argument(k, default=os.environ.get(k[2:].replace("-", "_").upper()))
    verbs["tag"].add_argument("-w", "--workers", type=int, default=4)
    verbs["audit"].add_argument("--spectral", action="store_true")
    for v in ("tag", "audit"):
        verbs[v].add_argument("--json")
        verbs[v].add_argument("--json-lines", help="folder of one JSON object a file, for libraries beyond one report's size")
    verbs["organize"].add_argument("--target-singles", required=True)
    return p


def load_tracks(spark: SparkSession, files: DataFrame, tracks: str | None) -> DataFrame:
    """Audio files with their track rows, of the given table or else by their own tags; files without one carry an error."""
    audio = library.audio(files).select("path", "parent", "stem", "ext")
    names = [c.split() for c in schemas.TRACKS.split(", ")]
    known = spark.read.schema(schemas.TRACKS).parquet(tracks) if tracks else library.read_tracks(audio)
    fields = [F.col(n) if n in known.columns else F.lit(None).cast(kind).alias(n) for n, kind in names if n not in ("path", "parent")]
    known = known.select("path", *fields, F.lit(True).alias("_known"))
    return audio.join(known, "path", "left").withColumn("read_error", F.coalesce("read_error", F.when(F.col("_known").isNull(), F.lit("no metadata")))).drop("_known")


def _write_json(value: DataFrame, path: str) -> None:
    Path(path).write_text(json.dumps(json.loads(value.first().value), indent=2, ensure_ascii=False), encoding="utf-8")


def _snapshot(spark: SparkSession, folder: str | None, name: str, schema: str) -> DataFrame:
    at = f"{folder}/{name}"
    return spark.read.schema(schema).parquet(at) if folder and os.path.exists(at) else spark.createDataFrame([], schema)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if not os.path.isdir(args.path):
        raise AudioError(f"folder not found: {args.path}")
    if not args.dry_run and args.verb != "audit":
        for cut_off in actions.unfinished(args.path):
            LOG.info({"resumed": actions.resume(spark, cut_off)})
    files = library.scan(spark, args.path).cache()
    tracks = load_tracks(spark, files, args.tracks)
    if args.verb == "audit":
        audited = audit.with_issues(tracks, library.sidecars(files), args.spectral).cache()
        LOG.info(audit.counters(audited).first().asDict())
        if args.json:
            _write_json(reports.audit_report(audited, os.path.abspath(args.path)), args.json)
        if args.json_lines:
            reports.audit_lines(audited).write.mode("overwrite").text(args.json_lines)
    elif args.verb == "rename":
        named = rename.wanted_names(tracks.where("read_error IS NULL")).withColumn("is_track", F.lit(True))
        others = files.join(named.select("path"), "path", "left_anti").select("path", "parent", F.col("stem").alias("wanted"), "ext", F.lit(False).alias("is_track"))
        plan = rename.rename_actions(rename.allocate(named.select("path", "parent", "wanted", "ext", "is_track").unionByName(others)), files, named).cache()
        heads = rename.header_writes(named, plan, library.lyrics(spark, args.path)).cache()
        LOG.info({"headers": heads.count()})
        _finish(args, plan, texts=heads)
    elif args.verb == "organize":
        plan = albums.with_sidecars(albums.plan_singles(tracks, files, args.target_singles), files, tracks).cache()
        _finish(args, plan, folders=albums.emptied_folders(plan, files))
    elif args.verb == "tag":
        s = args.snapshots
        keyless = {"fingerprints": args.acoustid_key, "tags": args.lastfm_key, "market": args.discogs_token}
        tables = {
            name: _snapshot(spark, s if keyless.get(name, True) else None, file, schema)
            for name, file, schema in (
                ("releases", "releases", schemas.RELEASES), ("fallback", "release_search", schemas.RELEASE_SEARCH), ("recordings", "recordings", schemas.RECORDINGS), ("fingerprints", "fingerprints", schemas.FINGERPRINTS),
                ("tags", "tags", schemas.TAGS), ("market", "market", schemas.MARKET), ("artwork", "artwork", schemas.ARTWORK), ("lyrics", "lyrics", schemas.FOUND_LYRICS), ("stories", "stories", schemas.STORIES),
            )
        }
        options = {"bpm": not args.no_bpm, "replaygain": not args.no_replaygain, "art": not args.no_art, "lyrics": not args.no_lyrics, "force": args.force}
        tables["covers"] = library.covers(files)
        readable = tracks.where("read_error IS NULL").repartition(max(args.workers, 1), "parent")
        new = enrich.tag_album(readable, tables, **options).cache()
        LOG.info(reports.tag_statistics(new).first().asDict())
        wanted = enrich.desired_tags(new)
        if args.plan:
            wanted.write.mode("overwrite").parquet(args.plan)
        if not args.no_lyrics:
            texts = enrich.lyrics_writes(new).cache()
            LOG.info({"lyrics": texts.count()})
        if not args.no_art:
            LOG.info({"covers": enrich.cover_downloads(new).count()})
        if not args.dry_run:
            flac = F.lower(F.col("path")).endswith(".flac")
            cover = new.select("path", F.when(flac, F.col("cover")).alias("cover")) if "cover" in new.columns else new.select("path", F.lit(None).cast("string").alias("cover"))
            LOG.info({"applied": actions.apply(args.path, texts=None if args.no_lyrics else texts, tags=wanted.join(cover, "path"), create=True)})
        if args.json:
            _write_json(reports.tag_report(new, datetime.now(timezone.utc).isoformat()), args.json)
        if args.json_lines:
            reports.tag_lines(new).write.mode("overwrite").text(args.json_lines)
        if args.out and not args.dry_run:
            new.write.mode("overwrite").parquet(args.out)
    return 0


def _finish(args: argparse.Namespace, plan: DataFrame, **more: DataFrame) -> None:
    LOG.info({r.kind: r.n for r in actions.summary(plan).collect()})
    if not args.dry_run:
        LOG.info({"applied": actions.apply(args.path, plan, **more)})


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not args.verb:
        p.print_help()
        return 0
    try:
        spark = SparkSession.getActiveSession() or SparkSession.builder.appName("cadenza").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        return run(spark, args)
    except KeyboardInterrupt:
        return 130
    except CadenzaError as e:
        LOG.error(e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
