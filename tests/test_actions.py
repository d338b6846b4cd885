"""Carrying plans out: no file is lost, none is there twice, and a run cut off is taken up."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cadenza import cli, schemas
from cadenza.operators import actions
from cadenza.sources import sink


def plan(spark, root, moves):
    return spark.createDataFrame([(f"{root}/{a}", f"{root}/{b}", "rename", "planned") for a, b in moves], "src string, dst string, kind string, status string")


def contents(root):
    """Names below root by content; every test file's content is its first name."""
    out = {}
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f not in (sink.HOME,)]
        for n in names:
            with open(f"{folder}/{n}") as f:
                out.setdefault(f.read(), []).append(os.path.relpath(f"{folder}/{n}", root))
    return out


@pytest.fixture
def lib(tmp_path):
    root = tmp_path / "lib"
    root.mkdir()
    for n in "abcdef":
        (root / n).write_text(n)
    return root


def test_chains_and_swaps_move_whatever_the_order(spark, lib):
    moves = plan(spark, lib, [("a", "b"), ("b", "c"), ("c", "x/y/c"), ("d", "e"), ("e", "d")]).repartition(5)
    assert actions.apply(str(lib), moves) == {"place": 5}
    assert contents(lib) == {"a": ["b"], "b": ["c"], "c": ["x/y/c"], "d": ["e"], "e": ["d"], "f": ["f"]}
    assert actions.unfinished(str(lib)) == []


def test_taken_and_impossible_places_give_the_file_back(spark, lib):
    moves = plan(spark, lib, [("a", "f"), ("b", "f/under"), ("c", "new"), ("gone", "z"), ("d", "a")])
    assert actions.apply(str(lib), moves) == {"place": 2}
    got = contents(lib)
    assert got["c"] == ["new"] and got["d"] == ["a"] and got["f"] == ["f"] and got["b"] == ["b"] and got["a"] in (["a (2)"], ["a (2)"])
    run = next((lib / sink.HOME).iterdir())
    rows = [json.loads(x) for p in json.loads((run / "_place.json").read_text())["journals"] for x in open(p)]
    assert sorted(r["status"].split(":")[0] for r in rows) == ["done", "done", "failed", "missing", "taken"]


def _begin(spark, lib, moves):
    """A run whose plan is written down and nothing done."""
    run = lib / sink.HOME / "run"
    os.makedirs(run)
    rows = plan(spark, lib, moves).select("src", "dst", F.sha2("src", 256).alias("id"))
    rows.repartition(4).write.parquet(f"file://{run}/moves")
    (run / "_plan.json").write_text(json.dumps({"tables": ["moves"], "create": False}))
    sink.register(spark)
    return str(run), rows


@pytest.mark.parametrize("phase", ["stage", "place"])
def test_a_failing_task_leaves_nothing_lost_and_a_rerun_ends_the_run(spark, lib, phase):
    run, rows = _begin(spark, lib, [("a", "b"), ("b", "c"), ("c", "g"), ("d", "h"), ("e", "i/j")])
    if phase == "place":
        rows.write.format("library_actions").option("run", run).option("phase", "stage").mode("append").save()
    explode = F.udf(lambda s: 1 // 0 if s.endswith("/d") else s)
    broken = rows.coalesce(1).orderBy("src").withColumn("src", explode("src"))
    with pytest.raises(Exception, match="ZeroDivision"):
        broken.write.format("library_actions").option("run", run).option("phase", phase).mode("append").save()
    assert not os.path.exists(sink.summary_path(run, phase))
    everything = [n for folder, _, names in os.walk(lib) for n in names if n in "abcdefghij" or len(n) == 64]
    assert len(everything) == 6  # each file has one name, here or on its way
    assert actions.unfinished(str(lib)) == [run]
    assert actions.resume(spark, run) == {"place": 5}
    assert contents(lib) == {"a": ["b"], "b": ["c"], "c": ["g"], "d": ["h"], "e": ["i/j"], "f": ["f"]}


def test_steps_may_be_repeated_at_any_point(spark, lib):
    run, rows = _begin(spark, lib, [("a", "b"), ("b", "z")])
    for phase in ("stage", "stage", "place", "place"):
        rows.write.format("library_actions").option("run", run).option("phase", phase).mode("append").save()
    assert contents(lib) == {"a": ["b"], "b": ["z"], "c": ["c"], "d": ["d"], "e": ["e"], "f": ["f"]}
    held = os.path.join(run, "staged", "00")
    os.makedirs(held, exist_ok=True)
    w = sink._Writer(run, "place", False)
    row = {"id": "00crash", "src": f"{lib}/c", "dst": f"{lib}/c2"}
    w._stage(row)
    os.link(f"{held}/00crash", f"{lib}/c2")  # a crash between the two names
    assert w._place(row)[0] == "done" and contents(lib)["c"] == ["c2"]


def test_texts_and_folders(spark, lib):
    (lib / "empty").mkdir()
    (lib / "full").mkdir()
    (lib / "full" / "x").write_text("x")
    texts = spark.createDataFrame([(f"{lib}/a", "new\r\n"), (f"{lib}/none", "n")], "path string, text string")
    folders = spark.createDataFrame([(f"{lib}/empty",), (f"{lib}/full",), (f"{lib}/nowhere",)], "parent string")
    assert actions.apply(str(lib), texts=texts, folders=folders) == {"text": 1, "tidy": 1}
    assert (lib / "a").read_bytes() == b"new\r\n" and not (lib / "none").exists() and not (lib / "empty").exists()
    assert actions.apply(str(lib), texts=texts, create=True) == {"text": 2}
    assert (lib / "none").read_text() == "n"


def _library(spark, tmp_path, files, tracks):
    lib = tmp_path / "lib"
    lib.mkdir()
    for name, text in files.items():
        (lib / name).write_text(text)
    names = [c.split()[0] for c in schemas.TRACKS.split(", ")]
    rows = [{"path": f"{lib}/{p}", "parent": str(lib), **t} for p, t in tracks.items()]
    at = str(tmp_path / "tracks")
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.TRACKS).write.parquet(at)
    return lib, at


def test_two_tracks_that_want_one_sidecar_keep_both_lyrics(spark, tmp_path, capsys):
    t = {"artist": "A", "title": "T", "track_number": 1}
    lib, at = _library(spark, tmp_path, {"p.flac": "", "q.mp3": "", "p.lrc": "p's words", "q.lrc": "q's words"}, {"p.flac": t, "q.mp3": t})
    assert cli.main(["rename", str(lib), "--tracks", at]) == 0
    out = capsys.readouterr().out
    assert "'rename': 2" in out and "'sidecar': 1" in out and "'place': 3" in out and "'text': 1" in out  # planned as applied
    assert sorted(p.name for p in lib.iterdir() if p.name != sink.HOME) == ["01 - A - T.flac", "01 - A - T.lrc", "01 - A - T.mp3", "q.lrc"]
    assert (lib / "01 - A - T.lrc").read_text() == "[ar:A]\n[ti:T]\np's words" and (lib / "q.lrc").read_text() == "q's words"


def test_a_shared_sidecar_goes_with_the_first_track(spark, tmp_path):
    lib, at = _library(spark, tmp_path, {"s.flac": "", "s.mp3": "", "s.lrc": "words"}, {"s.flac": {"artist": "A", "title": "One", "track_number": 1}, "s.mp3": {"artist": "B", "title": "Two", "track_number": 2}})
    assert cli.main(["rename", str(lib), "--tracks", at]) == 0
    assert (lib / "01 - A - One.lrc").read_text() == "[ar:A]\n[ti:One]\nwords" and not (lib / "02 - B - Two.lrc").exists() and (lib / "02 - B - Two.mp3").exists()


def test_singles_with_one_place_for_their_sidecars(spark, tmp_path, capsys):
    t = {"artist": "A", "title": "T", "album": "X"}
    lib, at = _library(spark, tmp_path, {"p.flac": "", "q.mp3": "", "p.lrc": "p", "q.lrc": "q"}, {"p.flac": t, "q.mp3": {**t, "album": "Y"}})
    assert cli.main(["organize", str(lib), "--tracks", at, "--target-singles", str(tmp_path / "s")]) == 0
    assert (tmp_path / "s/A/A - T.lrc").read_text() == "p" and (lib / "q.lrc").read_text() == "q"
    assert "'place': 3" in capsys.readouterr().out


def test_an_unfinished_run_is_ended_by_the_next_verb(spark, lib):
    run, _ = _begin(spark, lib, [("a", "b2"), ("b", "c2")])
    assert cli.main(["rename", str(lib)]) == 0
    assert contents(lib)["a"] == ["b2"] and actions.unfinished(str(lib)) == []
