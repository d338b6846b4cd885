import json

import pytest
from pyspark.sql import functions as F

from cadenza import cli
from cadenza.errors import CadenzaError
from cadenza.operators import albums, cache, enrich, rename
from cadenza.sources import library


@pytest.fixture
def tree(tmp_path):
    for p in ("A [FLAC]/01.flac", "A [FLAC]/01.lrc", "A [FLAC]/02.FLAC", "_b/x.mp3", ".c/y.ogg", "z.wav", "A [FLAC]/note.txt"):
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"[00:01.00] a")
    return tmp_path


def test_walk_sees_hidden_and_bracketed(spark, tree):
    files = library.scan(spark, str(tree))
    assert files.count() == 7
    assert sorted(r.stem for r in library.audio(files).collect()) == ["01", "02", "x", "y", "z"]
    assert [r.text for r in library.lyrics(spark, str(tree)).collect()] == ["[00:01.00] a"]


def test_walk_of_deep_and_wide_trees(spark, tmp_path, monkeypatch):
    want = set()
    for i in range(9):
        for j in range(3):
            f = tmp_path / f"a{i}" / "b" / f"c{j}" / "t.mp3"
            f.parent.mkdir(parents=True)
            f.write_bytes(b"")
            want.add(str(f))
    (tmp_path / "a0" / "top.mp3").write_bytes(b"")
    for tasks in (1, 5, 64):
        monkeypatch.setattr(library, "TASKS", tasks)
        got = [r.path for r in library.scan(spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(want | {str(tmp_path / "a0" / "top.mp3")})


def test_decoders_fill_columns_and_failures_are_rows(spark, tree):
    def decode(path):
        if path.endswith(".wav"):
            raise ValueError("no header")
        return {"artist": path[-5], "bpm": 90.5}

    got = {r.stem: (r.artist, r.bpm, r.read_error) for r in library.decoded(library.audio(library.scan(spark, str(tree))), decode, "artist string, bpm double").collect()}
    assert got["x"] == ("x", 90.5, None) and got["z"] == (None, None, "ValueError: no header") and len(got) == 5


def test_folder_classes(spark):
    rows = [("a", "X"), ("a", "X"), ("a", "x "), ("b", "X"), ("c", "X"), ("c", "Y"), ("c", None), ("d", None), ("d", None), ("d", "Q")]
    got = {r.parent: r.is_single for r in albums.folder_classes(spark.createDataFrame(rows, "parent string, album string")).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": False}


def test_singles_move_with_sidecar(spark):
    t = spark.createDataFrame([("/l/s/1.mp3", "/l/s", ".mp3", "Art", "Ti/t", "Al")], "path string, parent string, ext string, artist string, title string, album string")
    files = spark.createDataFrame([("/l/s/1.mp3", "/l/s"), ("/l/s/1.lrc", "/l/s")], "path string, parent string")
    plan = albums.with_sidecars(albums.plan_singles(t, files, "/out/"), files)
    assert sorted((r.src, r.dst) for r in plan.collect()) == [("/l/s/1.lrc", "/out/Art/Art - Ti_t.lrc"), ("/l/s/1.mp3", "/out/Art/Art - Ti_t.mp3")]
    assert [r.parent for r in albums.emptied_folders(plan, files).collect()] == ["/l/s"]


def _alloc(spark, names, wanted, **kw):
    rows = [("p", f"p/{n}", w, ".wav") for n, w in zip(names, wanted, strict=True)]
    got = rename.allocate(spark.createDataFrame(rows, "parent string, path string, wanted string, ext string"), **kw)
    return [r.new_name for r in got.orderBy("path").collect()]


def test_allocation(spark):
    assert _alloc(spark, ["a.wav", "b.wav"], ["X", "X"]) == ["X.wav", "X (2).wav"]
    again = ["X (2).wav", "X.wav"]
    assert _alloc(spark, again, ["X", "X"]) == again  # a rerun changes nothing
    assert _alloc(spark, again, ["X", "X"], compat=True) == ["X (3).wav", "X.wav"]
    assert _alloc(spark, ["a.wav", "b.wav", "c.wav"], ["b", "Z", "b"]) == ["b (2).wav", "Z.wav", "b.wav"]


def test_release_match_takes_first_that_contains(spark):
    tracks = spark.createDataFrame([("a", "blue"), ("a", ""), ("b", "none")], "artist_key string, album_key string")
    rel = spark.createDataFrame([("a", 0, "r0", "Blue Deluxe", "1999"), ("a", 1, "r1", "Blue", "2000")], "artist_key string, pos int, id string, title string, date string")
    other = spark.createDataFrame([("b", "none", 0, "f0", "x", "2001")], "artist_key string, album_key string, pos int, id string, title string, date string")
    got = {(r.artist_key, r.album_key): r.release_id for r in enrich.match_release(tracks, rel, other).collect()}
    assert got == {("a", "blue"): "r0", ("b", "none"): "f0"}


def test_first_accepted_is_not_best(spark):
    df = spark.sql("SELECT array(named_struct('score', 0.5D, 'recording_id', 'a'), named_struct('score', 0.85D, 'recording_id', 'b'), named_struct('score', 0.95D, 'recording_id', 'c')) AS r")
    assert df.select(enrich.first_accepted("r").alias("y")).first().y == "b"


def test_cache_expiry_and_latest(spark):
    now = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    old = cache.entry(spark.createDataFrame([("k", "1"), ("m", None)], "key string, value_json string"), F.to_timestamp(F.lit("2024-01-02 00:00:00")))
    new = cache.entry(spark.createDataFrame([("k2", "2")], "key string, value_json string"), F.to_timestamp(F.lit("2024-01-09 00:00:00")))
    table = cache.upsert(old, new)
    asked = spark.createDataFrame([("k",), ("k2",), ("m",)], "key string")
    assert {r.key: r.value_json for r in cache.lookup(asked, table, now).collect()} == {"k": None, "k2": "2", "m": None}
    assert table.count() == 2


def test_enrich_precedence(spark):
    from cadenza import schemas

    cols = {"path": "p", "artist": "mgl", "title": "T", "album": "Blue", "mbid": "", "genre": "", "date": "", "fingerprint": "f"}
    names = [c.split()[0] for c in schemas.TRACKS.split(", ")]
    tracks = spark.createDataFrame([tuple(cols.get(n) for n in names)], schemas.TRACKS)
    empty = lambda s: spark.createDataFrame([], s)
    args = dict(
        releases=spark.createDataFrame([("m g l", 0, "rel", "Blue", "2001-05-06")], schemas.RELEASES), fallback=empty("artist_key string, album_key string, pos int, id string, title string, date string"),
        recordings=spark.createDataFrame([("m g l", "t", 0, "txt")], schemas.RECORDINGS), fingerprints=spark.createDataFrame([("f", [(0.95, "fp", "t", "a")])], schemas.FINGERPRINTS),
        tags=empty(schemas.TAGS), market=spark.createDataFrame([("m g l", "blue", 0, 1, "Blue", 2024, ["Rock"])], schemas.MARKET),
    )
    r = enrich.enrich(tracks, **args).first()
    assert (r.artist, r.mbid, r.album_mbid, r.date, r.genre) == ("M.G.L.", "fp", "rel", "2001-05-06", "Rock")
    assert enrich.enrich(tracks, force=True, **args).first().mbid == "txt"
    args["releases"] = empty(schemas.RELEASES)
    assert enrich.enrich(tracks, **args).first().date == "2024"


def test_command_line(spark, tree, tmp_path, capsys):
    report = tmp_path / "r.json"
    assert cli.main(["audit", str(tree), "--json", str(report)]) == 0
    data = json.loads(report.read_text())
    assert data["schema"] == "audit_report_v1" and data["summary"]["total_files"] == 5 and data["summary"]["missing_lrc"] == 4
    assert cli.main(["audit", str(tree / "nowhere")]) == 1
    assert cli.main(["--dry-run", "organize", str(tree), "--target-singles", str(tmp_path / "s")]) == 0
    assert cli.main(["rename", str(tree)]) == 0
    assert (tree / "z.wav").exists()


def test_streaming_audit(spark, tmp_path):
    from cadenza.streaming import audit_stream

    src = spark.sql("SELECT 'a/1.mp3' path, 'a' parent, '1' stem, '.mp3' ext, 'x' artist, 'y' title, 'Pop' genre, true checksum_ok, 0.5D hf_rms, cast(null AS string) read_error, timestamp'2024-01-01 10:10:00' modified")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = audit_stream(stream, src.select("parent", "stem").limit(0)).writeStream.outputMode("complete").format("memory").queryName("audits").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.files, r.files_with_issues) for r in spark.table("audits").collect()] == [(1, 1)]


def test_unread_files_stay(spark, tmp_path):
    for n in ("a.mp3", "b.mp3"):
        (tmp_path / "lib" / "x").mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / "x" / n).write_bytes(b"")
    assert cli.main(["organize", str(tmp_path / "lib"), "--target-singles", str(tmp_path / "out")]) == 0
    assert (tmp_path / "lib/x/a.mp3").exists() and not (tmp_path / "out").exists()
    t = spark.createDataFrame([("/l/1.mp3", "/l", ".mp3", "Art", "T", "Al", None), ("/l/2.mp3", "/l", ".mp3", None, None, None, "bad")], "path string, parent string, ext string, artist string, title string, album string, read_error string")
    assert [r.src for r in albums.plan_singles(t, t.select("path", "parent"), "/out").collect()] == ["/l/1.mp3"]


def _tracks(spark, rows):
    from cadenza import schemas

    names = [c.split()[0] for c in schemas.TRACKS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.TRACKS)


def _tables(spark):
    from cadenza import schemas as s

    made = {
        "releases": ([], s.RELEASES), "fallback": ([], s.RELEASE_SEARCH), "recordings": ([], s.RECORDINGS), "fingerprints": ([], s.FINGERPRINTS), "tags": ([], s.TAGS), "market": ([], s.MARKET),
        "artwork": ([("art", "al", [("http://x/100x100bb.jpg",)])], s.ARTWORK), "lyrics": ([("art", "t", "[00:01.00] <00:01.00>la")], s.FOUND_LYRICS), "stories": ([("art", "t", "A story.")], s.STORIES),
    }
    return {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in made.items()}


def test_each_tag_option_changes_the_plan(spark):
    t = _tracks(spark, [{"path": "/l/1.flac", "parent": "/l", "artist": "Art", "title": "T", "album": "Al", "bpm": 90.0}]).withColumn("measured_bpm", F.lit(120.0))
    tables = _tables(spark)
    full = enrich.tag_album(t, tables).first()
    assert (full.bpm, full.gain_mode, full.plain, full.enhanced, full.story) == (120.0, "album", "[00:01.00] la", "[00:01.00] <00:01.00>la", "A story.") and "1400x1400" in full.cover_url
    assert enrich.tag_album(t, tables, bpm=False).first().bpm == 90.0
    for option, column in (("replaygain", "gain_mode"), ("art", "cover_url"), ("lyrics", "plain")):
        assert column not in enrich.tag_album(t, tables, **{option: False}).columns
    assert {r.path for r in enrich.lyrics_writes(enrich.tag_album(t, tables)).collect()} == {"/l/1.lrc", "/l/1.enhanced.lrc"}
    with pytest.raises(CadenzaError):
        enrich.tag_album(t, tables, sound=True)


def test_tag_and_rename_from_the_command_line(spark, tmp_path, capsys):
    lib = tmp_path / "lib"
    lib.mkdir()
    (lib / "x.mp3").write_bytes(b"")
    (lib / "x.lrc").write_text("[ar:old]\n[00:01.00] la\n")
    at = str(tmp_path / "tracks")
    _tracks(spark, [{"path": f"{lib}/x.mp3", "parent": str(lib), "artist": "Art", "title": "T", "album": "Al", "track_number": 3}]).write.parquet(at)
    assert cli.main(["tag", str(lib), "--tracks", at, "--no-lyrics", "-w", "2", "--plan", str(tmp_path / "plan"), "--json-lines", str(tmp_path / "lines")]) == 0
    assert spark.read.parquet(str(tmp_path / "plan")).first().tags["tracknumber"] == "3"
    assert json.loads(spark.read.text(str(tmp_path / "lines")).first().value)["artist"] == "Art"
    assert cli.main(["--dry-run", "rename", str(lib), "--tracks", at]) == 0 and (lib / "x.mp3").exists()
    assert cli.main(["rename", str(lib), "--tracks", at]) == 0
    assert (lib / "03 - Art - T.lrc").read_text() == "[ti:T]\n[ar:Art]\n[00:01.00] la\n" and (lib / "03 - Art - T.mp3").exists()
    assert "[INFO]" in capsys.readouterr().out


def test_names_are_given_in_order_of_path_components(spark):
    rows = [("p", "p/a-b/1.mp3", "X", ".mp3"), ("p", "p/a/1.mp3", "X", ".mp3")]
    df = spark.createDataFrame(rows, "parent string, path string, wanted string, ext string")
    assert {r.path: r.new_name for r in rename.stateless(df).collect()} == {"p/a/1.mp3": "X.mp3", "p/a-b/1.mp3": "X (2).mp3"}
    assert {r.path: r.new_name for r in rename.allocate(df).collect()} == {"p/a/1.mp3": "X.mp3", "p/a-b/1.mp3": "X (2).mp3"}


def test_requests_are_one_a_key(spark):
    t = enrich.keyed(spark.createDataFrame([("Art", "T", "Al"), ("ART", "U", "Al"), ("", "V", "")], "artist string, title string, album string"))
    assert [(r.artist_key, r.artist) for r in enrich.artist_requests(t).collect()] == [("art", "ART")]
    assert sorted((r.term, r.limit) for r in enrich.artwork_requests(t).collect()) == [("", 5), ("ART Al", 5)]


def test_checksum_errors_are_told(spark):
    from cadenza.operators import audit

    t = spark.sql("SELECT 'a/1.flac' path, 'a' parent, '1' stem, '.flac' ext, 'x' artist, 'y' title, 'Pop' genre, cast(null AS boolean) checksum_ok, 'no such tool' checksum_error, 0.5D hf_rms, cast(null AS string) read_error")
    assert audit.with_issues(t, t.select("parent", "stem")).first().issues == ["Checksum check failed: no such tool"]
