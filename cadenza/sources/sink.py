"""Carrying plans out: a data source whose tasks move files, write texts and tags, and remove folders.

A run has a folder of its own (``<library>/.cadenza/<run>``) that holds the plan, the files on their way and
a journal; a file system that the driver and all executors share is assumed, as by the walk.

Moves take two jobs, so that names which the plan frees may be taken by it, in whatever order tasks run:
``stage`` renames every source to a place named by its hash, ``place`` links it to its destination and drops
the first name.  A link never overwrites.  Every step is safe to repeat: a task that is run again, or a rerun
after a crash, finds by the places of the files what has been done.  A file whose destination is taken or cannot
be made goes back to where it was, or, where that place is taken by then, to a numbered name beside it.

Each task appends what it did to a journal file and reports counts; the driver's commit writes one summary, whose
presence ends the phase.
"""

from __future__ import annotations

import errno
import json
import os
import shutil
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import tags as codec
from .tags import rewrite

HOME = ".cadenza"


class LibraryActions(DataSource):
    """Options: run, the run's folder; phase; create, whether texts may be new files.  Append only."""

    @classmethod
    def name(cls) -> str:
        return "library_actions"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["run"], self.options["phase"], self.options.get("create") == "true")


@dataclass
class _Did(WriterCommitMessage):
    counts: dict
    journal: str


class _Writer(DataSourceWriter):
    def __init__(self, run: str, phase: str, create: bool):
        self.run, self.phase, self.create = run, phase, create

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        step = {"stage": self._stage, "place": self._place, "text": self._text, "tidy": self._tidy, "tags": self._tags}[self.phase]
        counts: Counter = Counter()
        folder = os.path.join(self.run, "journal")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"{self.phase}-{uuid.uuid4().hex}.jsonl")
        with open(path, "a", encoding="utf-8") as journal:
            for row in iterator:
                status, at = step(row)
                counts[status] += 1
                journal.write(json.dumps({"phase": self.phase, "status": status, "at": at, **{k: v for k, v in row.asDict().items() if k not in ("text", "tags")}}, ensure_ascii=False) + "\n")
                journal.flush()
        return _Did(dict(counts), path)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        total = sum((Counter(m.counts) for m in done), Counter())
        _put(summary_path(self.run, self.phase), json.dumps({"counts": total, "journals": sorted(m.journal for m in done)}))

    def abort(self, messages) -> None:
        """What tasks did stays done and is in their journals; the next run of the phase goes on from there."""

    def _held(self, row) -> str:
        return os.path.join(self.run, "staged", row["id"][:2], row["id"])

    def _stage(self, row) -> tuple[str, str]:
        held, src = self._held(row), row["src"]
        if os.path.lexists(held):
            return "staged", held
        if not os.path.isfile(src):
            return "missing", src
        os.makedirs(os.path.dirname(held), exist_ok=True)
        try:
            os.rename(src, held)
        except OSError as e:
            if e.errno != errno.EXDEV:
                return f"failed: {e.strerror}", src
            return "left", src  # on another device: copied from where it is
        return "staged", held

    def _place(self, row) -> tuple[str, str]:
        held, src, dst = self._held(row), row["src"], row["dst"]
        mark = held + ".done"
        if os.path.lexists(mark):
            if os.path.lexists(held):  # a crash came between the two names
                _drop(held)
            return "done", dst
        here = held if os.path.lexists(held) else src
        if not os.path.isfile(here) or here == src and not self._other_device(src):
            return "missing", src
        try:
            os.makedirs(os.path.dirname(dst), exist_ok=True)
            taken = not _link(here, dst, row["id"])
        except OSError as e:
            return (f"failed: {e.strerror}", self._back(held, src) if here == held else src)
        if taken:
            return "taken", self._back(held, src) if here == held else src
        open(mark, "w").close()
        _drop(here)
        return "done", dst

    def _other_device(self, src: str) -> bool:
        os.makedirs(os.path.join(self.run, "staged"), exist_ok=True)
        return os.stat(src).st_dev != os.stat(os.path.join(self.run, "staged")).st_dev

    def _back(self, held: str, src: str) -> str:
        stem, ext = os.path.splitext(src)
        n, at = 1, src
        while not _link(held, at, "back"):
            n += 1
            at = f"{stem} ({n}){ext}"
        _drop(held)
        return at

    def _text(self, row) -> tuple[str, str]:
        path = row["path"]
        if not self.create and not os.path.isfile(path):
            return "missing", path
        try:
            _put(path, row["text"])
        except OSError as e:
            return f"failed: {e.strerror}", path
        return "done", path

    def _tags(self, row) -> tuple[str, str]:
        path, cover = row["path"], row["cover"]
        try:
            picture = None
            if cover:
                with open(cover, "rb") as f:
                    picture = ("image/png" if cover.lower().endswith(".png") else "image/jpeg", f.read())
            rewrite(path, {k: v for k, v in row["tags"].items() if v}, picture)
        except Exception as e:  # a file that is broken or of a kind without a writer stays as it is
            return f"failed: {type(e).__name__}: {e}", path
        return "done", path

    def _tidy(self, row) -> tuple[str, str]:
        try:
            os.rmdir(row["parent"])
        except OSError:  # not there, or not empty
            return "kept", row["parent"]
        return "done", row["parent"]


def _drop(path: str) -> None:
    try:
        os.unlink(path)
    except FileNotFoundError:  # another attempt of the task was first
        return


def _link(here: str, dst: str, tag: str) -> bool:
    """Give the file a second name unless that is taken by another file."""
    try:
        os.link(here, dst)
    except FileExistsError:
        return os.path.samefile(here, dst)
    except OSError as e:
        if e.errno not in (errno.EXDEV, errno.EPERM, errno.ENOTSUP):
            raise
        part = f"{dst}.{tag}.part"
        shutil.copy2(here, part)
        try:
            os.link(part, dst)
        except FileExistsError:
            return False
        except OSError:  # a file system without links
            if os.path.lexists(dst):
                return False
            os.rename(part, dst)
        finally:
            if os.path.lexists(part):
                os.unlink(part)
    return True


def _put(path: str, text: str) -> None:
    """The whole text or none of it."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def summary_path(run: str, phase: str) -> str:
    return os.path.join(run, f"_{phase}.json")


def register(spark: SparkSession) -> None:
    for module in (sys.modules[__name__], codec):
        cloudpickle.register_pickle_by_value(module)  # executors need no copy of this package
    spark.dataSource.register(LibraryActions)
