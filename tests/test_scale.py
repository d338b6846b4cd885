"""Forms that spread one group over tasks, each against the plain one."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from cadenza import streaming
from cadenza.operators import albums, cache, enrich, rename, scan


def test_positions_follow_one_window_whatever_the_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(40), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    want, seen = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        seen[k] = want[i] = seen.get(k, 0) + 1
    for blocks in (1, 3, 16):
        got = scan.positions(df, ["k"], ["t", "i"], "n", blocks)
        assert {r.i: r.n for r in got.collect()} == want
        if blocks == 16:
            assert got.where("k = 'hot'").select("_block").distinct().count() > 4


def test_slots_of_one_provider_spread_over_blocks(spark):
    rng = random.Random(4)
    rows = [("p" if i % 5 else None, i, rng.choice([rng.uniform(0, 900), rng.uniform(0, 9000), None])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, at double")
    want = {}
    for key in ("p", None):
        top = None
        for n, (_, i, at) in enumerate(r for r in rows if r[0] == key):
            if at is not None:
                top = max(at - n * 2.5, at - n * 2.5 if top is None else top)
            want[i] = None if top is None else n * 2.5 + top
    for blocks in (1, 13):
        assert {r.i: r.slot for r in rename.slots(df, 2.5, ["k"], "at", ["i"], blocks).collect()} == want
    assert rename.slots(df.limit(0), 2.5, ["k"], "at", ["i"]).collect() == []


def plain_allocation(rows, compat):
    """A folder's files one after the other, every name tried from the first."""
    taken, out = {p.rsplit("/", 1)[-1] for p, *_ in rows}, {}
    for path, want, ext, is_track in sorted(rows, key=lambda r: r[0].split("/")):
        own = path.rsplit("/", 1)[-1]
        new = f"{want}{ext}" if is_track else own
        if new != own:
            k = 1
            if not compat:
                taken.discard(own)
            while new in taken:
                k += 1
                new = f"{want} ({k}){ext}"
            taken.discard(own)
            taken.add(new)
        out[path] = new
    return out


@pytest.mark.parametrize("large", [rename.LARGE, 2])
@pytest.mark.parametrize("compat", [False, True])
def test_names_equal_the_run_file_by_file(spark, monkeypatch, large, compat):
    monkeypatch.setattr(rename, "LARGE", large)
    rng = random.Random(5)
    names = ["x", "x (2)", "x (3)", "x (2) (2)", "x (02)", "x (1)", "x ()", "y", "y (4)", "z.w", "z.w (2)", "a", "b (7", "c"]
    folders, rows = {}, []
    for f in range(60):
        still = f % 2  # no file in these folders leaves a name that another may want
        held = rng.sample([n + e for n in names for e in (".mp3", ".flac")], rng.randrange(1, 14))
        files = [(f"l/{f}/{n}", rng.choice(names[:10]), "." + n.rsplit(".", 1)[1], not still and rng.random() < 0.7) for n in held]
        files += [(f"l/{f}/t{i}.mp3", "x" if still else rng.choice(names[:10]), ".mp3", True) for i in range(rng.randrange(9))]
        folders[f] = files
        rows += [(f"l/{f}", *r) for r in files]
    df = spark.createDataFrame(rows, "parent string, path string, wanted string, ext string, is_track boolean")
    want = {p: n for files in folders.values() for p, n in plain_allocation(files, compat).items()}
    got = rename.allocate(df, compat).collect()
    assert len(got) == len(rows) and {r.path: r.new_name for r in got} == want


def test_large_sets_are_numbered_without_python(spark, monkeypatch):
    monkeypatch.setattr(rename, "LARGE", 50)
    rows = [("l", f"l/t{i:04}.mp3", "x", ".mp3", True) for i in range(300)] + [("l", f"l/x ({k}).mp3", "n", ".mp3", False) for k in range(3, 200, 7)]
    uses = []
    plain = rename._by_ranges
    monkeypatch.setattr(rename, "_by_ranges", lambda u: uses.append(plain(u)) or uses[-1])
    got = rename.allocate(spark.createDataFrame(rows, "parent string, path string, wanted string, ext string, is_track boolean"))
    assert {r.path: r.new_name for r in got.collect()} == plain_allocation([r[1:] for r in rows], False)
    new, rest = uses[0]
    assert new.count() == 300 and rest.where("claims").count() == 0


def test_ranks_follow_one_window_whatever_the_blocks(spark):
    rng = random.Random(6)
    rows = [(rng.choice([7, 7, 7, 2]), rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, t int, i int")
    want, seen = {}, {}
    for k, _, i in sorted(rows):
        seen[k] = want[i] = seen.get(k, 0) + 1
    for blocks in (1, 3, 16):
        assert {r.i: r.n for r in scan.ranked(df, ["k"], ["t", "i"], "n", blocks).collect()} == want
    assert scan.ranked(df.limit(0), ["k"], ["t"], "n").collect() == []


@pytest.mark.parametrize("large", [rename.LARGE, 50])
def test_only_sets_whose_names_are_left_reach_python(spark, monkeypatch, large):
    """Names of sets that stay as they are come from windows or ranges, however many sets a folder has."""
    monkeypatch.setattr(rename, "LARGE", large)
    python = []
    plain = GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, schema: python.append(self._df) or plain(self, f, schema))
    rows = [("l", f"l/t{i:04}.mp3", f"p{i % 40}" if i % 3 else "x", ".mp3", True) for i in range(300)]  # sets of one name, one of them large
    rows += [("l", f"l/{n}.mp3", "n", ".mp3", False) for n in ("p1", "p2 (2)", "p2 (4)", "x (3)", "q (2)")]  # some of their names are taken
    rows += [("l", "l/a.mp3", "b", ".mp3", True), ("l", "l/b.mp3", "a", ".mp3", True), ("l", "l/c.mp3", "a", ".mp3", True)]  # these are left
    got = rename.allocate(spark.createDataFrame(rows, "parent string, path string, wanted string, ext string, is_track boolean"))
    assert {r.path: r.new_name for r in got.collect()} == plain_allocation([r[1:] for r in rows], False)
    assert {r.path for r in python[0].collect()} == {"l/a.mp3", "l/b.mp3", "l/c.mp3"}


def test_releases_of_one_artist_are_found_by_their_rarest_piece(spark):
    n = 100_000
    titles = spark.range(n).select(F.lit("a").alias("artist_key"), F.col("id").cast("int").alias("pos"), F.col("id").cast("string").alias("id"), F.concat(F.lit("greatest hits "), F.lpad(F.conv(F.xxhash64("id") % 60_000_000, 10, 36), 6, "0"), F.lit(" live")).alias("title"), F.lit("2001").alias("date"))
    some = [r.title for r in titles.where("pos % 997 = 0").collect()]
    albums = [("a", t[14:20].lower()) for t in some] + [("a", "no such one"), ("a", "hits"), ("a", "zz"), ("b", "hits"), ("a", "")]
    wanted = spark.createDataFrame(albums, "artist_key string, album_key string")
    got = {(r.artist_key, r.album_key): r.release_id for r in enrich.match_release(wanted, titles, indexed=True).collect()}
    held = [(int(r.id), r.title.lower()) for r in titles.collect()]
    for artist, album in albums:
        first = min((i for i, t in held if album in t), default=None) if artist == "a" and album else None
        assert got.get((artist, album)) == (None if first is None else str(first)), album
    titled = titles.select("artist_key", "pos", F.lower("title").alias("_title"))
    pairs = enrich.release_candidates(wanted.where("length(album_key) > 4"), titled).count()
    assert pairs < n * len(albums) / 200  # all pairs: n for each album


def test_store_writes_touched_shards_only(spark, tmp_path):
    at = lambda s: F.lit(s).cast("timestamp")
    path = str(tmp_path / "cache")
    assert cache.load(spark, path).count() == 0
    old = cache.entry(spark.range(200).select(F.col("id").cast("string").alias("key"), F.lit("old").alias("value_json")), at("2024-01-01 00:00:00"))
    assert cache.store(old, path, at("2024-01-01 00:00:00")) == list(range(8))
    files = lambda: {s: sorted(os.listdir(f"{path}/{s}")) for s in os.listdir(path) if s.startswith("shard=")}
    before = files()
    new = cache.entry(spark.createDataFrame([("7", "new")], "key string, value_json string"), at("2024-01-05 00:00:00"))
    (touched,) = cache.store(new, path, at("2024-01-05 00:00:00"))
    after = files()
    assert [s for s in before if before[s] != after[s]] == [f"shard={touched}"]
    assert {r.key: r.value_json for r in cache.load(spark, path).collect()} == {str(i): "new" if i == 7 else "old" for i in range(200)}
    cache.store(new, path, at("2024-01-09 00:00:00"))  # what was stored on the first has expired: this shard drops it
    held = cache.load(spark, path).where(F.col("shard") == touched)
    assert [r.key for r in held.collect()] == ["7"]
    assert cache.store(new.limit(0), path, at("2024-01-09 00:00:00")) == []


def test_stream_of_cache_rows_expires_entries(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [("a", "1", 0, 100), ("a", "2", 50, 150), ("a", "3", 400, 500), ("b", "1", 10, 110), ("b", "0", 10, 110), ("c", "1", 300, 400), ("end", "1", 4000, 9000)]
        schema = "key string, value_json string, s bigint, e bigint"
        for i, part in enumerate((rows[:2], rows[2:], [("end", "2", 8000, 9900)])):
            spark.createDataFrame(part, schema).select("key", "value_json", F.timestamp_seconds(F.col("s") + 86_400).alias("stored_at"), F.timestamp_seconds(F.col("e") + 86_400).alias("expires_at")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        static = spark.read.parquet(*(f"{tmp_path}/in/{i}" for i in range(3)))
        stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = streaming.cache_changes(stream, "1 minute").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(120)
        assert q.exception() is None
        shown = lambda df: sorted((r.key, r.at, r.change, r.value_json or '') for r in df.where("key <> 'end'").collect())
        assert shown(spark.read.parquet(f"{tmp_path}/out")) == shown(cache.changes(static))
    finally:
        spark.conf.set(provider, was)


def test_equal_titles_are_held_against_an_album_once(spark, monkeypatch):
    """Many releases of few names: candidates do not grow with them, and short albums need no join of all titles."""
    titles = spark.range(20_000).select(F.lit("a").alias("artist_key"), (F.col("id") % 9000).cast("int").alias("pos"), F.col("id").cast("string").alias("id"), F.concat(F.lit("name "), (F.col("id") % 5).cast("string")).alias("title"), F.lit("2001").alias("date"))
    wanted = spark.createDataFrame([("a", k) for k in ("name 3", "e", "4", "me", "zz", "n 4")] + [("b", "e")], "artist_key string, album_key string")
    pairs = []
    plain = enrich.release_candidates
    monkeypatch.setattr(enrich, "release_candidates", lambda w, t: pairs.append(plain(w, t)) or pairs[-1])
    got = {(r.artist_key, r.album_key): r.release_id for r in enrich.match_release(wanted, titles, indexed=True).collect()}
    least = lambda k: min((i % 9000, str(i)) for i in range(20_000) if k in f"name {i % 5}")[1]
    assert got == {("a", k): least(k) for k in ("name 3", "e", "4", "me")}
    assert pairs[0].count() <= 20


def test_one_wanted_place_is_no_task_of_its_own(spark):
    """First sources are aggregated before rows are dealt; a window would sort all that want one place in one task."""
    moves = spark.range(2000).select(F.format_string("s%04d", (F.col("id") * 7) % 2000).alias("src"), F.when(F.col("id") % 10 > 0, "hot").otherwise(F.format_string("d%d", "id")).alias("dst"), F.lit("move").alias("kind"))
    first = albums.first_wins(moves)
    assert "Window" not in first._jdf.queryExecution().executedPlan().toString()
    want = {}
    for r in moves.collect():
        want[r.dst] = min(want.get(r.dst, r.src), r.src)
    assert {(r.src, r.dst, r.kind) for r in first.collect()} == {(s, d, "move") for d, s in want.items()}


def test_files_are_not_dealt_for_few_sidecars(spark):
    """Of all files those that few moves ask for are picked out by a broadcast, not by joins that deal every file."""
    moves = spark.createDataFrame([("a/x.mp3", "b/x.mp3"), ("a/y.mp3", "b/y.mp3")], "src string, dst string")
    files = spark.range(100_000).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("path")).union(spark.createDataFrame([("a/x.lrc",), ("a/y.lrc",), ("b/y.lrc",)], "path string"))
    plan = rename.sidecar_moves(moves, files, moves.select(F.col("src").alias("path")))
    assert {tuple(r) for r in plan.collect()} == {("a/x.lrc", "b/x.lrc", "sidecar", "planned"), ("a/y.lrc", "b/y.lrc", "sidecar", "conflict")}
    assert "Range (0, 100000" not in plan._jdf.queryExecution().executedPlan().toString()
