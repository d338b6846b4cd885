"""The walk: pushed filters, and changed files as a stream."""

import os
import re
import time

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.sources import library

NAMES = ["a.mp3", "B.FLAC", ".hidden.wav", "_x.ogg", ".mp3", "no", "dot.", "two.tar.mp3", "sub/c.mp3", "sub/deep [1]/d.flac", "sub/deep [1]/e.lrc", "other/f.mp3", "other/g.txt"]


def make(root, names=NAMES):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text("x")


def rel(rows, root):
    return sorted(os.path.relpath(r.path, root) for r in rows)


def left_to_spark(df):
    """Whether the plan filters rows that the walk gives."""
    return bool(re.search(r"(?<!Runtime)Filter", df._jdf.queryExecution().executedPlan().toString()))


def test_columns_are_those_of_the_text_functions(spark, tmp_path):
    make(tmp_path)
    files = library.scan(spark, str(tmp_path))
    assert rel(files.collect(), tmp_path) == sorted(NAMES)
    p = F.col("path")
    assert files.where((F.col("parent") != T.parent(p)) | (F.col("stem") != T.stem(p)) | (F.col("ext") != T.extension(p))).collect() == []


def test_filters_reach_the_walk(spark, tmp_path):
    make(tmp_path)
    files = library.scan(spark, str(tmp_path))
    only = library.audio(files)
    assert not left_to_spark(only)
    assert rel(only.collect(), tmp_path) == sorted(n for n in NAMES if n.lower().endswith((".mp3", ".flac", ".ogg", ".wav")) and n != ".mp3")
    below = files.where(F.col("parent").startswith(f"{tmp_path}/sub") & (F.col("ext") == ".flac"))
    assert not left_to_spark(below) and rel(below.collect(), tmp_path) == ["sub/deep [1]/d.flac"]
    assert rel(files.where(F.col("parent") == f"{tmp_path}/other").where("length > 5 OR ext = '.txt'").collect(), tmp_path) == ["other/g.txt"]
    assert files.where("ext = '.mp3' AND ext = '.lrc'").collect() == []


def test_folders_that_cannot_hold_wanted_files_are_not_opened(tmp_path):
    make(tmp_path)
    walk = library._Reader(str(tmp_path))

    class StringStartsWith:
        attribute, value = ("parent",), f"{tmp_path}/sub/de"

    assert list(walk.pushFilters([StringStartsWith()])) == []
    assert [os.path.relpath(t, tmp_path) for t, _ in walk.trees()] == [".", "sub", "sub/deep [1]"]
    assert [os.path.relpath(r[0], tmp_path) for t in walk.trees() for r in walk.rows(*t)] == ["sub/deep [1]/d.flac", "sub/deep [1]/e.lrc"]


def test_a_batch_has_only_changed_files(spark, tmp_path):
    root = tmp_path / "lib"
    make(root)
    stream = library.scan_changes(spark, str(root), settle=0)

    def once():
        got = []
        q = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        q.awaitTermination(90)
        return rel(got, root)

    assert once() == sorted(NAMES)
    (root / "a.mp3").write_text("changed")
    old = tmp_path / "old.mp3"
    old.write_text("y")
    os.utime(old, (1, 1))
    os.rename(old, root / "moved in.mp3")
    time.sleep(0.05)
    assert once() == ["a.mp3", "moved in.mp3"]
    assert once() == []
