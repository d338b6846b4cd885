"""Sound as a table of frames: loudness, high-frequency energy, tempo and fingerprints.

A frame is a row (path, at, samples, rate): the at-th run of equally many samples of a track, mono, full scale 1.  Decoders
stay outside; what they give is enough for all that follows.  Work on samples is vectorised in Arrow batches and yields
a few numbers a frame; the rest is joins and sums of those, so a long track or a large album is no task's burden.

Null samples are silence, null paths and frames without samples count for nothing.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import cut, small

#: Loudness: blocks of so many frames, absolute and relative gate, the reference level, histogram bins a unit.
BLOCK, GATE, RELATIVE, REFERENCE, BINS = 4, -70.0, -10.0, -18.0, 10
_OFFSET = -0.691
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


def _matrix(samples: pd.Series) -> np.ndarray:
    """Rows of equal length; shorter frames end in silence."""
    n = max((len(x) for x in samples if x is not None), default=0)
    out = np.zeros((len(samples), n))
    for i, x in enumerate(samples):
        if x is not None and len(x):
            out[i, : len(x)] = np.nan_to_num(np.asarray(x, dtype=float))
    return out


def k_response(rate: int, freq: np.ndarray) -> np.ndarray:
    """Squared gain of the two filters of loudness measurement (a shelf for the head, a high pass) at the given frequencies."""
    z = np.exp(-2j * np.pi * freq / rate)
    # fixed values: centre, quality and gain of the shelf; corner and quality of the high pass
    f0, q, gain = 1681.974450955533, 0.7071752369554196, 3.999843853973347
    k, vh = np.tan(np.pi * min(f0, 0.49 * rate) / rate), 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = ((vh + vb * k / q + k * k) + 2 * (k * k - vh) * z + (vh - vb * k / q + k * k) * z * z) / a0
    shelf /= 1 + 2 * (k * k - 1) / a0 * z + (1 - k / q + k * k) / a0 * z * z
    f0, q = 38.13547087602444, 0.5003270373238773
    k = np.tan(np.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    high = (1 - 2 * z + z * z) / (1 + 2 * (k * k - 1) / a0 * z + (1 - k / q + k * k) / a0 * z * z)
    return np.abs(shelf * high) ** 2


def _spectra():
    def power(x: np.ndarray) -> np.ndarray:
        """The mean square of each row by frequency (Parseval): one-sided."""
        n = x.shape[1]
        p = np.abs(np.fft.rfft(x, axis=1)) ** 2 / max(n, 1) ** 2
        p[:, 1 : (n + 1) // 2] *= 2
        return p

    def above(samples: pd.Series, rate: pd.Series, cutoff: pd.Series) -> pd.Series:
        x = _matrix(samples)
        if not x.size:
            return pd.Series(np.zeros(len(samples)))
        freq = np.arange(x.shape[1] // 2 + 1)[None, :] * rate.to_numpy()[:, None] / x.shape[1]
        return pd.Series(np.where(freq >= cutoff.to_numpy()[:, None], power(x), 0).sum(axis=1))

    def weighted(samples: pd.Series, rate: pd.Series) -> pd.Series:
        x, out = _matrix(samples), np.zeros(len(samples))
        for r in rate.unique() if x.size else ():
            on = (rate == r).to_numpy()
            out[on] = power(x[on]) @ k_response(int(r), np.arange(x.shape[1] // 2 + 1) * r / x.shape[1])
        return pd.Series(out)

    return F.pandas_udf(above, "double"), F.pandas_udf(weighted, "double")


def _sizes(frames: DataFrame) -> DataFrame:
    return frames.where("path IS NOT NULL AND size(samples) > 0").withColumn("_n", F.size("samples"))


def high_frequency_rms(frames: DataFrame, cutoff: float = 16_000) -> DataFrame:
    """(path, hf_rms): root mean square of what lies at or above the cutoff, over the whole track; frames of unequal length weigh by it."""
    above, _ = _spectra()
    part = _sizes(frames).select("path", "_n", above("samples", "rate", F.lit(float(cutoff))).alias("_e"))
    return part.groupBy("path").agg(F.sqrt(F.sum(F.col("_e") * F.col("_n")) / F.sum("_n")).alias("hf_rms"))


def loudness_state(frames: DataFrame, weighting: str = "k", block: int = BLOCK) -> DataFrame:
    """(path, bin, n, energy): a track's blocks above the absolute gate by tenth of a unit of loudness, the mergeable state of ``loudness``.

    A block is ``block`` frames in a row, one beginning with every frame; a frame of 100 ms gives the usual blocks of
    400 ms.  weighting: 'k', the hearing curve, applied to each frame's spectrum; or 'flat'.
    """
    _, weighted = _spectra()
    rows = _sizes(frames)
    energy = weighted("samples", "rate") if weighting == "k" else F.aggregate("samples", F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0)).cast("double")) / F.col("_n")
    each = rows.select("path", "at", energy.alias("e"))
    # a frame counts for the blocks that begin with it and with the frames before it: sums need no order and no window over a track
    spread = each.select("path", F.explode(F.sequence(F.col("at") - (block - 1), F.col("at"))).alias("at"), "e")
    blocks = spread.groupBy("path", "at").agg(F.sum("e").alias("e"), F.count("*").alias("k")).where(F.col("k") == block).select("path", (F.col("e") / block).alias("e"))
    loud = F.when(F.col("e") > 0, _OFFSET + 10 * F.log10("e"))
    kept = blocks.withColumn("l", loud).where(F.col("l") >= GATE)
    return kept.groupBy("path", F.floor(F.col("l") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.sum("e").alias("energy"))


def loudness(states: DataFrame, *keys: str) -> DataFrame:
    """The keys, loudness and gain of merged states: the mean energy of all blocks sets the second gate, that of the blocks above it the result.

    A block counts by its bin, so blocks within a tenth of a unit of the second gate may fall on its other side; energies are exact.
    """
    level = lambda e, n: _OFFSET + 10 * F.log10(e / n)
    merged = states.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum("energy").alias("energy"))
    first = merged.groupBy(*keys).agg(level(F.sum("energy"), F.sum("n")).alias("_gate"))
    gated = merged.join(first, list(keys)) if keys else merged.crossJoin(first)  # one row
    out = gated.where((F.col("bin") + 1) / BINS > F.col("_gate") + RELATIVE).groupBy(*keys).agg(level(F.sum("energy"), F.sum("n")).alias("loudness"))
    return out.withColumn("gain", REFERENCE - F.col("loudness"))


def replay_gain(frames: DataFrame, tracks: DataFrame, key: str = "parent", weighting: str = "k") -> DataFrame:
    """(path, track_gain, album_gain) of tracks (path and the key): albums merge their tracks' states, no sample is read again."""
    states = loudness_state(frames, weighting)
    album = loudness(states.join(tracks.select("path", key), "path"), key).select(key, F.col("gain").alias("album_gain"))
    track = loudness(states, "path").select("path", F.col("gain").alias("track_gain"))
    return tracks.select("path", key).join(track, "path", "left").join(album, key, "left").select("path", "track_gain", "album_gain")


def onsets(frames: DataFrame) -> DataFrame:
    """(path, at, onset): how much the level rises from one frame to the next, on a logarithmic scale."""
    level = F.log1p(F.lit(1000.0) * F.sqrt(F.aggregate("samples", F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0)).cast("double")) / F.col("_n")))
    rows = _sizes(frames).select("path", "at", level.alias("level"))
    before = rows.select("path", (F.col("at") + 1).alias("at"), F.col("level").alias("before"))
    return rows.join(before, ["path", "at"]).select("path", "at", F.greatest(F.col("level") - F.col("before"), F.lit(0.0)).alias("onset"))


def tempo(onset_rows: DataFrame, per_second: float, low: float = 40, high: float = 240, prefer: float = 120, beats: int = 8) -> DataFrame:
    """(path, bpm) from (path, at, onset): the tempo at the lags of whose beats the onsets' autocorrelation is high, and low between them.

    Lags between frames are interpolated, so that tempos are found to 0.1.  What lies between the beats tells a tempo from its half;
    beyond that the one nearer to ``prefer`` gains, by a curve one octave wide.  Null where nothing rises.  A track's onsets, a number a frame, come together; the usual
    caller gives the 60 seconds from the 30th on.
    """

    def best(series: pd.Series) -> pd.Series:
        grid = np.arange(low, high + 0.025, 0.05)
        lags = 60 * per_second / grid
        prior = np.exp(-0.5 * np.log2(grid / prefer) ** 2)

        def one(x) -> float | None:
            x = np.asarray(x, dtype=float)
            x = x - x.mean() if len(x) else x
            if len(x) < 4 or not x.any():
                return None
            size = 1 << (2 * len(x) - 1).bit_length()
            auto = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2)[: len(x)]
            auto /= auto[0] * np.arange(len(x), 0, -1) / len(x)
            score, used = np.zeros(len(grid)), np.zeros(len(grid))
            for m in range(1, beats + 1):
                ok = lags * m < 0.75 * len(x)
                on, off = (np.interp(lags * at, np.arange(len(x)), auto) for at in (m, m - 0.5))
                score += np.where(ok, on - 0.5 * off, 0)
                used += ok
            score = np.where(used > 0, score / np.maximum(used, 1), -1) * prior
            return round(float(grid[score.argmax()]), 1) if score.max() > 0 else None

        return series.map(one)

    line = F.transform(F.array_sort(F.collect_list(F.struct("at", "onset"))), lambda r: r["onset"])
    return onset_rows.groupBy("path").agg(line.alias("x")).select("path", F.pandas_udf(best, "double")("x").alias("bpm"))


def peaks(frames: DataFrame, per_frame: int = 3) -> DataFrame:
    """(path, at, f): the strongest frequencies of each frame (bins above both neighbours), loudest first, the lower of equals."""
    def strongest(samples: pd.Series) -> pd.Series:
        x = _matrix(samples)
        if x.shape[1] < 4:
            return pd.Series([[] for _ in range(len(samples))])
        p = np.abs(np.fft.rfft(x, axis=1))
        top = np.zeros(p.shape, bool)
        top[:, 1:-1] = (p[:, 1:-1] > p[:, :-2]) & (p[:, 1:-1] > p[:, 2:])
        height = np.where(top, p, -1)
        order = np.argsort(-height, axis=1, kind="stable")[:, :per_frame]
        return pd.Series([[int(f) for f in row if height[i, f] > 0] for i, row in enumerate(order)])

    return _sizes(frames).select("path", "at", F.explode(F.pandas_udf(strongest, "array<int>")("samples")).alias("f"))


def landmarks(peak_rows: DataFrame, reach: int = 5) -> DataFrame:
    """(path, at, key): every peak with each peak of the next frames; the key holds both frequencies and the distance."""
    later = peak_rows.select("path", F.col("at").alias("to"), F.col("f").alias("f2"))
    steps = peak_rows.select("path", "at", "f", F.explode(F.sequence(F.col("at") + 1, F.col("at") + reach)).alias("to"))
    key = (F.col("f").cast("long") * (1 << 20) + F.col("f2")) * 64 + (F.col("to") - F.col("at"))
    return steps.join(later, ["path", "to"]).select("path", "at", key.alias("key"))


def match_prints(asked: DataFrame, known: DataFrame, most: float = 0.01) -> DataFrame:
    """(path, found, offset, votes, score): for each asked track the known one most of whose landmarks agree on one shift in time.

    known is an inverted index of landmarks by key.  Keys that more than the share ``most`` of the known tracks have (and more than
    100) say little and give no candidates; they vote once a candidate is known, so that scores are exact for every candidate.
    score is votes over the asked track's landmarks; ties go to the least name, then the least shift.
    """
    n = known.select("path").distinct().agg(F.count("*").alias("n_tracks"))
    common = known.groupBy("key").agg(F.count_distinct("path").alias("n")).crossJoin(F.broadcast(n)).where(F.col("n") > F.greatest(F.lit(100.0), F.col("n_tracks") * most)).select("key")  # n is one row
    index = known.select("key", F.col("path").alias("found"), F.col("at").alias("there"))
    votes = lambda rows: rows.groupBy("path", "found", (F.col("there") - F.col("at")).alias("offset")).agg(F.count("*").alias("votes"))
    rare = votes(asked.join(common, "key", "left_anti").join(index, "key"))
    frequent = asked.join(common, "key", "left_semi").join(index, "key").join(rare.select("path", "found").distinct(), ["path", "found"], "left_semi")
    every = rare.unionByName(votes(frequent)).groupBy("path", "found", "offset").agg(F.sum("votes").alias("votes"))
    w = Window.partitionBy("path").orderBy(F.desc("votes"), "found", "offset")
    total = asked.groupBy("path").agg(F.count("*").alias("_all"))
    best = every.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return best.join(total, "path").select("path", "found", "offset", "votes", (F.col("votes") / F.col("_all")).alias("score"))


def _shifts(threshold: float, reach: int, width: int):
    """Of a block of asked peaks and a stretch of known ones of twice the width, the shifts at which the block may reach the threshold."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        (t0, f0), (t1, f1) = (np.array([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in row[c]], np.int64).T for c in ("own", "there"))
        start, base = t0.min(), int(row["b"]) * width
        total = np.zeros(width + 1, complex)
        for f in np.intersect1d(f0, f1):
            x, y = (np.fft.rfft(np.bincount(t[g == f] - at, minlength=2 * width)) for t, g, at in ((t0, f0, start), (t1, f1, base)))
            total += x.conj() * y
        common = np.rint(np.fft.irfft(total)[:width])
        d = np.flatnonzero(common * reach * row["most"] >= threshold * row["marks"] * (1 - 1e-9))
        return pd.DataFrame({"path": row["path"], "found": row["found"], "offset": d + base - start})

    return find


def match_long(asked: DataFrame, known: DataFrame, threshold: float = 0.2, reach: int = 5, width: int = 1 << 15) -> DataFrame:
    """match_prints and accepted for peaks (path, at, f) of long tracks with few frequencies, where landmarks meet at every shift.

    A landmark that agrees has a first peak that agrees, and no peak has more than ``reach`` frames times the peaks of one after it.  So a track
    that reaches the threshold has a block of frames in which common peaks reach that share of its landmarks.  Peaks in
    common are counted for all shifts of a block at once, by Fourier transforms; at the shifts that are left
    landmarks are counted one by one, so that votes and scores are exact.
    """
    asked, known = cut(asked), cut(known)
    marks = landmarks(asked, reach)
    ends = asked.groupBy("path").agg(F.min("at").alias("_lo"), (F.max("at") - F.min("at") + 1).alias("_n"))
    block = lambda rows: rows.join(F.broadcast(ends), "path").withColumn("a", F.expr(f"(at - _lo) * ceil(_n / {width}) div _n"))
    peak = F.collect_list(F.struct("at", "f"))
    own = block(asked).groupBy("path", "a").agg(peak.alias("own")).join(block(marks).groupBy("path", "a").agg(F.count("*").alias("marks")), ["path", "a"])
    b = F.floor(F.col("at") / width)
    there = known.select(F.col("path").alias("found"), "at", "f", F.explode(F.array(b, b - 1)).alias("b")).groupBy("found", "b").agg(peak.alias("there"))
    frame = asked.groupBy("path", "at").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    twice = known.groupBy("path", "at", "f").agg(F.count("*").alias("m")).agg(F.max("m").alias("m"))
    most = frame.crossJoin(twice).select((F.col("n") * F.col("m")).alias("most"))  # one row
    pairs = own.crossJoin(there).crossJoin(F.broadcast(most))
    kinds = {**dict(asked.dtypes), **dict(known.select(F.col("path").alias("found")).dtypes)}
    maybe = pairs.groupBy("path", "a", "found", "b").applyInPandas(_shifts(threshold, reach, width), f"path {kinds['path']}, found {kinds['found']}, offset bigint")
    maybe = cut(maybe.distinct())
    at = (F.col("at") + F.col("offset")).alias("there")
    index = landmarks(known, reach).select(F.col("path").alias("found"), F.col("at").alias("there"), "key")
    every = marks.join(small(maybe), "path").select("path", "found", "offset", at, "key").join(index, ["found", "there", "key"]).groupBy("path", "found", "offset").agg(F.count("*").alias("votes"))
    total = marks.groupBy("path").agg(F.count("*").alias("_all"))
    good = accepted(every.join(total, "path").withColumn("score", F.col("votes") / F.col("_all")), threshold)
    w = Window.partitionBy("path").orderBy(F.desc("votes"), "found", "offset")
    return good.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select("path", "found", "offset", "votes", "score")


def accepted(matches: DataFrame, threshold: float | Column = 0.2) -> DataFrame:
    """Matches whose score reaches the threshold."""
    return matches.where(F.col("score") >= threshold)
