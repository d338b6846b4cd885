"""Loudness, high frequencies, tempo and fingerprints against plain versions and planted signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import audio
from cadenza.plans import catalogue


def frames(spark, tracks, size, rate):
    rows = [(p, i, [float(v) for v in x[i * size : (i + 1) * size]], rate) for p, x in tracks.items() for i in range(len(x) // size)]
    return spark.createDataFrame(rows, "path string, at long, samples array<double>, rate int")


def plain_k(x, rate):
    """The two filters, sample by sample, from the published design at this rate."""
    out = x
    for kind, f0, q, gain in (("shelf", 1681.974450955533, 0.7071752369554196, 3.999843853973347), ("high", 38.13547087602444, 0.5003270373238773, 0)):
        k = np.tan(np.pi * f0 / rate)
        a0 = 1 + k / q + k * k
        a = (2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)
        vh = 10 ** (gain / 20)
        vb = vh**0.4996667741545416
        b = ((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0) if kind == "shelf" else (1.0, -2.0, 1.0)
        y = np.zeros(len(out))
        for i in range(len(out)):
            y[i] = b[0] * out[i] + (b[1] * out[i - 1] - a[0] * y[i - 1] if i else 0) + (b[2] * out[i - 2] - a[1] * y[i - 2] if i > 1 else 0)
        out = y
    return out


def plain_loudness(x, rate, size):
    """Blocks of four frames, both gates, no histogram."""
    e = np.array([np.mean(x[i * size : (i + 4) * size] ** 2) for i in range(len(x) // size - 3)])
    level = lambda v: -0.691 + 10 * np.log10(v)
    e = e[e > 0]
    e = e[level(e) >= -70]
    return level(e[level(e) > level(e.mean()) - 10].mean())


def test_loudness_equals_filter_and_gates(spark):
    rate, size, rnd = 8000, 800, np.random.default_rng(5)
    t = np.arange(rate * 4) / rate
    tracks = {
        "sine": 0.5 * np.sin(2 * np.pi * 1000 * t), "loud and soft": np.where(t < 2, 0.4, 0.01) * rnd.standard_normal(len(t)), "gap": np.where((t > 1) & (t < 3), 0, 0.2) * np.sin(2 * np.pi * 440 * t),
    }
    df = frames(spark, tracks, size, rate)
    got = {r.path: r.loudness for r in audio.loudness(audio.loudness_state(df), "path").collect()}
    for p, x in tracks.items():
        assert abs(got[p] - plain_loudness(plain_k(x, rate), rate, size)) < 0.15, p
    flat = {r.path: r.loudness for r in audio.loudness(audio.loudness_state(df, "flat"), "path").collect()}
    for p, x in tracks.items():
        assert abs(flat[p] - plain_loudness(x, rate, size)) < 0.02, p
    assert abs(flat["sine"] - (-0.691 + 10 * np.log10(0.125))) < 1e-6


def test_albums_merge_states_without_samples(spark):
    rnd = np.random.default_rng(6)
    tracks = {f"t{i}": rnd.standard_normal(4000) * 10.0**-i for i in range(3)}
    df = frames(spark, tracks, 100, 1000)
    states = audio.loudness_state(df, "flat").cache()
    whole = audio.loudness(states.withColumn("album", F.lit(1)), "album").first().loudness
    blocks = np.concatenate([[np.mean(x[i * 100 : i * 100 + 400] ** 2) for i in range(37)] for x in tracks.values()])
    level = lambda v: -0.691 + 10 * np.log10(v)
    assert abs(whole - level(blocks[level(blocks) > level(blocks.mean()) - 10].mean())) < 0.02
    assert abs(audio.loudness(states).first().loudness - whole) < 1e-9
    gains = {r.path: r for r in audio.replay_gain(df, df.select("path").distinct().withColumn("parent", F.lit("a")), weighting="flat").collect()}
    assert {round(r.album_gain, 6) for r in gains.values()} == {round(-18 - whole, 6)} and gains["t0"].track_gain < gains["t2"].track_gain


def test_silence_and_odd_frames(spark):
    odd = spark.createDataFrame([("s", i, [0.0] * 8, 100) for i in range(9)] + [("n", 0, None, 100), ("e", 0, [], 100), (None, 0, [1.0], 100), ("x", 0, [None, 0.5], 100)], "path string, at long, samples array<double>, rate int")
    assert audio.loudness(audio.loudness_state(odd), "path").count() == 0
    assert {r.path: r.hf_rms for r in audio.high_frequency_rms(odd, 10).collect()}["s"] == 0
    assert audio.tempo(audio.onsets(odd), 10).where("bpm IS NOT NULL").count() == 0
    assert audio.landmarks(audio.peaks(odd)).count() == 0
    none = odd.limit(0)
    assert audio.high_frequency_rms(none).count() == audio.loudness(audio.loudness_state(none), "path").count() == audio.tempo(audio.onsets(none), 10).count() == 0


def test_energy_above_the_cutoff_is_that_of_the_sines_there(spark):
    n, rate = 441, 44_100  # bins of 100 Hz
    t = np.arange(n * 20) / rate
    tracks = {"both": 0.5 * np.sin(2 * np.pi * 1000 * t) + 0.01 * np.sin(2 * np.pi * 17_000 * t), "low": 0.9 * np.sin(2 * np.pi * 15_900 * t), "edge": 0.2 * np.sin(2 * np.pi * 16_000 * t)}
    got = {r.path: r.hf_rms for r in audio.high_frequency_rms(frames(spark, tracks, n, rate)).collect()}
    assert got["both"] == pytest.approx(0.01 / np.sqrt(2), rel=1e-6) and got["low"] < 1e-9 and got["edge"] == pytest.approx(0.2 / np.sqrt(2), rel=1e-6)


@pytest.mark.parametrize("bpm", [62.3, 90.0, 119.9, 128.0, 174.6])
def test_planted_tempos_are_found(spark, bpm):
    per, rnd = 100, np.random.default_rng(int(bpm))
    x = np.abs(rnd.standard_normal(60 * per)) * 0.05
    for beat in np.arange(0.3, 59.5, 60 / bpm):
        i = beat * per
        x[int(i)] += 1 - i % 1
        x[int(i) + 1] += i % 1
    df = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(x)], "path string, at long, onset double")
    assert abs(audio.tempo(df, per).first().bpm - bpm) <= 0.1001


def test_onsets_rise_with_the_level(spark):
    x = np.concatenate([np.full(100, 0.0), np.full(100, 0.5), np.full(100, 0.1), np.full(100, 0.5)])
    got = {r.at: r.onset for r in audio.onsets(frames(spark, {"t": x}, 100, 1000)).collect()}
    assert got[1] > got[3] > got[2] == 0


def test_shifted_and_noisy_copies_are_found(spark):
    rnd, size, rate = np.random.default_rng(9), 256, 8000
    tone = lambda: np.concatenate([sum(a * np.sin(2 * np.pi * f * np.arange(size) / rate) for f, a in zip(rnd.integers(2, 120, 4) * rate / size, (1, 0.8, 0.6, 0.5))) for _ in range(80)])  # noqa: E731, B905
    known = {f"k{i}": tone() for i in range(40)}
    asked = {f"q{i}": known[f"k{i}"][size * (i % 9) :] + 0.3 * rnd.standard_normal(size * (80 - i % 9)) for i in range(30)} | {f"new{i}": tone() for i in range(10)}
    prints = lambda t: audio.landmarks(audio.peaks(frames(spark, t, size, rate)))
    got = {r.path: (r.found, r.offset) for r in audio.accepted(audio.match_prints(prints(asked), prints(known))).collect()}
    right = sum(got.get(f"q{i}") == (f"k{i}", i % 9) for i in range(30))
    assert right >= 29 and not [p for p in got if p.startswith("new")]
    few = {r.path: (r.found, r.offset) for r in audio.accepted(audio.match_prints(prints(asked), prints(known), most=0)).collect()}
    assert few == got  # 40 tracks are too few for a key to be common


def test_tempo_of_events_is_that_of_plain_steps(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect()
    series = {}
    for r in rows:
        series.setdefault(r.user_id, []).append(r.value or 0.0)
    grid = np.arange(40, 240.025, 0.05)
    got = {r.user_id: r.bpm for r in catalogue.QUERIES["event_tempo"](spark, sf).collect()}
    assert got.keys() == series.keys()
    for user, x in series.items():
        x = np.array(x) - np.mean(x)
        n = len(x)
        if n < 4 or not x.any():
            assert got[user] is None
            continue
        auto = np.array([(x[: n - k] * x[k:]).sum() / (n - k) for k in range(n)]) / (x @ x / n)
        best = -1, None
        for bpm in grid:
            at = [m * 600 / bpm for m in range(1, 9) if m * 600 / bpm < 0.75 * n]
            score = np.mean(np.interp(at, range(n), auto) - 0.5 * np.interp([v - 300 / bpm for v in at], range(n), auto)) * np.exp(-0.5 * np.log2(bpm / 120) ** 2) if at else -np.exp(-0.5 * np.log2(bpm / 120) ** 2)
            best = max(best, (score + 1e-12, bpm), key=lambda v: round(v[0], 9))
        assert got[user] is None if best[0] <= 0 else abs(got[user] - best[1]) < 0.051


@pytest.mark.parametrize("width", [16, 37, 1 << 15])
def test_long_tracks_match_as_all_landmarks_do(spark, width):
    """Against the count of all meeting landmarks, with repeated frames, gaps and a track of no landmarks."""
    rnd = np.random.default_rng(width)
    peaks = lambda n: [(at, int(f)) for at in range(n) if at % 19 for f in rnd.choice(12, 3, replace=False)]
    known = {f"k{i}": peaks(150) for i in range(4)}
    known["k1"] += known["k1"][:30]
    asked = {f"q{i}": [(at - 40, f if rnd.random() < 0.8 else int(rnd.integers(12))) for at, f in known[f"k{i}"] if at >= 40] for i in range(3)} | {"new": peaks(60), "none": [(3, 1)]}
    rows = lambda t: spark.createDataFrame([(p, at, f) for p, x in t.items() for at, f in x], "path string, at long, f int")
    a, k = rows(asked), rows(known)
    want = audio.accepted(audio.match_prints(audio.landmarks(a), audio.landmarks(k)))
    got = {tuple(r) for r in audio.match_long(a, k, width=width).collect()}
    assert got == {tuple(r) for r in want.collect()} and len(got) >= 3
