"""Ordered state machines over the rows of a key.

Each is a function over sorted tuples, run as a grouped map; the relational steps around them stay in Catalyst.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from functools import cmp_to_key

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nest import fold

BINS, HEIGHT, PROMINENCE, MIN_PERIOD_S, MAX_PERIOD_S, LEAST = 4096, 4.0, 3.0, 0.02, 8.0, 20
REPEAT_US = 10.0


def lead_groups(rows: list[tuple], band: float = 0.5) -> Iterable[tuple]:
    """From (ts, seq, dur) sorted: seq, group. The first free anchor takes all that start less than band * its duration behind
    it; one without a duration takes none, not even itself. Sorted rows make that one pass."""
    group, limit = -1, None
    for ts, seq, dur in rows:
        if limit is None or ts >= limit:
            if band * dur <= 0:
                continue
            group, limit = group + 1, ts + band * dur
        yield seq, group


def virtual_cycles(rows: list[tuple]) -> Iterable[tuple]:
    """From (ts, seq, kind, end_ts, mode), kind run or result: kind, start, end, run_seq, result_seq. A run of another
    mode closes the active one, one of the same mode replaces it; a result closes it, unless it follows the result before by
    less than REPEAT_US; what is active at the end becomes a prefill."""
    active, last = None, None
    for ts, seq, kind, end, mode in rows:
        if kind == "run":
            if active and active[2] != mode and ts > active[0]:
                yield "batch", active[0], ts, active[1], None
            active = (ts, seq, mode)
            continue
        if last is not None and ts - last < REPEAT_US:
            continue
        last = ts
        if active:
            if end >= active[0]:
                yield "batch", active[0], end, active[1], seq
            active = None
    if active:
        yield "prefill", active[0], max(active[0], rows[-1][3]), active[1], None


def tracks(rows: list[tuple]) -> Iterable[tuple]:
    """From (start, seq, end): seq, track, start; the first track that is free, one microsecond later where it just ends."""
    ends: list = []
    for start, seq, end in rows:
        k = next((k for k, e in enumerate(ends) if start >= e), len(ends))
        if k == len(ends):
            ends.append(end)
        else:
            start += start == ends[k]
            ends[k] = end
        yield seq, k, start


def busiest(rows: list[tuple], share: float = 0.8) -> Iterable[tuple]:
    """H3: from (ts, value): the shortest window that holds `share` of the work (trapezoids; the last sample lasts 1 us)."""
    ts, v = (np.array(x, float) for x in zip(*rows, strict=True)) if rows else (np.zeros(0), np.zeros(0))
    step, mean = np.append(np.diff(ts), 1.0), (v + np.append(v[1:], v[-1:])) / 200
    ok = step > 0
    ts, step, work = ts[ok], step[ok], (step * mean)[ok]
    if work.sum() <= 0:
        return
    sums = np.concatenate([[0.0], np.cumsum(work)])
    stop = np.searchsorted(sums, sums[:-1] + share * work.sum() * (1 - 1e-12))  # the first end that holds enough, for each start
    ok = stop < len(sums)
    ends = np.where(ok, (ts + step)[np.minimum(stop, len(ts)) - 1] - ts, np.inf)
    k = int(ends.argmin())
    if np.isfinite(ends[k]):
        yield float(ts[k]), float(ts[k] + ends[k])


def local_peaks(x: np.ndarray, height: float, prominence: float) -> list[int]:
    """Strict local maxima (the middle of a flat top) of that height and prominence."""
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            k = (i + j) // 2
            left, right = np.flatnonzero(x[:i] > x[k]), np.flatnonzero(x[j + 1 :] > x[k])
            base = max(x[left[-1] if len(left) else 0 : k + 1].min(), x[k : (j + 1 + right[0] if len(right) else len(x)) + 1].min())
            if x[k] >= height and x[k] - base >= prominence:
                out.append(k)
        i = j + 1
    return out


def spectrum_period(counts: np.ndarray, span: float, n: int) -> tuple[float, float] | None:
    """H5: period in microseconds and score of n events, from the spectrum of their counts in bins of equal width over `span`."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(counts)) / (len(counts) - 1))
    power = np.abs(np.fft.rfft(counts * window))[1:]
    freq = np.fft.rfftfreq(len(counts), span / 1e6 / len(counts))[1:]
    floor = max(float(np.median(power)), 1e-9)
    peaks = [k for k in local_peaks(power, HEIGHT * floor, PROMINENCE * floor) if 1 / MAX_PERIOD_S <= freq[k] <= 1 / MIN_PERIOD_S]
    if not peaks:
        return None
    snr = {k: power[k] / floor for k in peaks}

    def score(k: int) -> float:
        ratio = [(freq[o] / freq[k], snr[o]) for o in peaks if o != k and snr[o] >= 3]
        bonus = max((s for r, s in ratio if 1.95 < r < 2.05 or 2.95 < r < 3.05), default=0.0)
        return (snr[k] + 0.8 * bonus) / math.log10(n + 1)

    loud, best = max(peaks, key=snr.get), max(peaks, key=score)
    ratio = freq[best] / freq[loud]
    pick = best if best == loud or 0.48 < ratio < 0.52 or 0.32 < ratio < 0.34 else loud
    return 1e6 / freq[pick], score(pick)


def cadence(stamps: np.ndarray) -> tuple[float, float] | None:
    """H5 of sorted time stamps."""
    if len(stamps) < LEAST or stamps[-1] <= stamps[0]:
        return None
    counts, _ = np.histogram(stamps, bins=BINS, range=(stamps[0], stamps[-1]))
    return spectrum_period(counts, float(stamps[-1] - stamps[0]), len(stamps))


def consensus(found: list[tuple], band: float = 0.1) -> tuple[float, float, list[str]]:
    """H6: from (period, score, name): periods within the band of the least free one form a cluster; of the cluster with the largest
    sum of scores the weighted mean period, that sum and the names."""
    left, groups = sorted(found), []
    while left:
        first = left[0][0]
        groups.append([x for x in left if abs(x[0] - first) / first < band])
        left = [x for x in left if abs(x[0] - first) / first >= band]
    best = max(groups, key=lambda g: sum(x[1] for x in g))
    total = sum(x[1] for x in best)
    return (sum(x[0] * x[1] for x in best) / total if total > 0 else best[0][0]), total, [n for x in best for n in x[2:]]


def start_index(stamps: list[float], period: float, width: int = 5) -> int:
    """H9: the position to start from: where the smoothed number of events in the next tenth of a period rises most, and of the half
    period around it the densest one; 0 for fewer than ten events."""
    ts = np.asarray(stamps, float)
    if len(ts) < 2 * width:
        return 0
    dense = np.searchsorted(ts, ts + 0.1 * period, "right") - np.arange(len(ts))
    rise = np.diff(np.convolve(dense, np.ones(width) / width, "valid"))
    at = int(rise.argmax()) + 1 + width // 2
    low, high = np.searchsorted(ts, ts[at] - period / 2, "left"), np.searchsorted(ts, ts[at] + period / 2, "right")
    return int(low + dense[low:high].argmax())


def beats(stamps: list[float], start: int, period: float, band: float = 0.25) -> list[int]:
    """Positions found by going both ways from `start` in steps of a period; a beat takes the nearest stamp within band
    periods, a missing one is stepped over."""
    found, reach = {start}, band * period
    for way in (1, -1):
        at = stamps[start]
        while stamps[0] - reach <= at + way * period <= stamps[-1] + reach:
            want = at + way * period
            near = range(bisect_left(stamps, want - reach), bisect_right(stamps, want + reach))
            if near:
                k = min(near, key=lambda i: abs(stamps[i] - want))
                found.add(k)
                at = stamps[k]
            else:
                at = want
    return sorted(found)


def seeds(stamps: list[float], period: float, band: float = 0.25, jumps: int = 5) -> list[int]:
    """Positions of a chain. It starts from the two events whose distance is nearest to a period, and goes on in both directions,
    as long as one of the next `jumps` beats has an event within band periods. Empty for fewer than five events, or no pair."""
    ts = np.asarray(stamps, float)
    if len(ts) < 5:
        return []
    reach, pair, least = band * period, None, math.inf
    want = ts + period
    for i, j in enumerate(np.searchsorted(ts, want, "left")):
        before = int(np.searchsorted(ts, ts[j - 1], "left")) if j else 0  # of equal stamps the first
        for k in sorted({max(before, i + 1), max(int(j), i + 1)}):
            if k < len(ts) and abs(ts[k] - want[i]) <= reach and abs(ts[k] - want[i]) < least:
                least, pair = abs(ts[k] - want[i]), (i, k)
    if pair is None:
        return []
    found = set(pair)
    for way, at in ((-1, pair[0]), (1, pair[1])):
        while True:
            for jump in range(1, jumps + 1):
                goal = ts[at] + way * jump * period
                near = [i for i in range(bisect_left(stamps, goal - reach), bisect_right(stamps, goal + reach)) if (i - at) * way > 0]
                if near:
                    at = min(near, key=lambda i: abs(ts[i] - goal))
                    found.add(at)
                    break
            else:
                break
    return sorted(found)


def beat_grid(stamps: list[float], period: float, band: float = 0.25) -> list[int]:
    """Positions nearest to a regular grid whose phase follows each match."""
    out, at, k = [], stamps[0], 0
    while at <= stamps[-1] + band * period:
        near = range(bisect_left(stamps, at - band * period), bisect_right(stamps, at + band * period))
        if near:
            k = min(near, key=lambda i: abs(stamps[i] - at))
            out.append(k)
            at = stamps[k]
        at += period
    return sorted(set(out))


def ranked(candidates: list[dict], alike: float = 0.9) -> list[dict]:
    """By total duration, but by mean duration where totals are alike. That is no total order, so the few candidates are
    compared in their given order on the driver."""
    def compare(a: dict, b: dict) -> int:
        low, high = sorted((a["total"], b["total"]))
        key = "mean" if high and low / high >= alike else "total"
        return (a[key] < b[key]) - (a[key] > b[key])

    return sorted(candidates, key=cmp_to_key(compare))


def cadences(events: DataFrame, keys: list[str]) -> DataFrame:
    """H5 for each key and name: keys, name, period_us, score. Events are counted in their bins first, so a stream of any length
    reaches Python as BINS numbers."""
    by = [*keys, "name"]
    ends = events.groupBy(*by).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.count("*").alias("_n")).where((F.col("_n") >= LEAST) & (F.col("_b") > F.col("_a")))
    place = F.least(F.floor((F.col("ts") - F.col("_a")) * BINS / (F.col("_b") - F.col("_a"))), F.lit(BINS - 1)).cast("int")
    bins = events.select(*by, "ts").join(ends, by).groupBy(*by, "_a", "_b", "_n", place.alias("_bin")).agg(F.count("*").alias("_k"))
    rows = bins.groupBy(*by, "_a", "_b", "_n").agg(F.collect_list(F.struct("_bin", "_k")).alias("x"))

    def period(at: pd.Series, count: pd.Series, span: pd.Series, n: pd.Series) -> pd.DataFrame:
        def one(a, c, s, k):
            counts = np.zeros(BINS)
            counts[np.asarray(a)] = np.asarray(c)
            return spectrum_period(counts, float(s), int(k)) or (None, None)

        return pd.DataFrame([one(*x) for x in zip(at, count, span, n, strict=True)], columns=["period_us", "score"], dtype=float)

    got = F.pandas_udf(period, "period_us double, score double")(F.col("x._bin"), F.col("x._k"), (F.col("_b") - F.col("_a")).cast("double"), F.col("_n"))
    return rows.withColumn("got", got).where("got.period_us is not null").select(*by, "got.period_us", "got.score")


def consensus_periods(found: DataFrame, keys: list[str]) -> DataFrame:
    """H6 for each key: period_us, score, names."""
    return fold(found, keys, ["period_us", "score", "name"], lambda rows: [consensus(rows)], "period_us double, score double, names array<string>")
