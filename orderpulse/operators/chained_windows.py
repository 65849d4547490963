"""Windows that open at the first time after the last one has ended, for keys of any length.

A window of a key starts at some time ``w`` and holds the times up to ``w + width``; the next one starts at the key's
first time after that.  Each start depends on the one before, yet a stretch of time is a small function: at
its entry at most ``width`` of the last window is left, so only the times of its first ``width`` units, and the next one,
can be its first start.  For each of these candidates a row holds the last start that it leads to in the stretch.

Time is cut by a fixed grid into blocks of ``BLOCK_WINDOWS`` widths, and ``FANOUT`` neighbouring stretches make a longer one,
``LEVELS`` times: candidates' rows are joined on the way up, the few longest stretches of a key are chained, and the start that
each stretch is entered with goes down again.  Times are distinct integers, so however many rows a key has, a
block holds ``BLOCK_WINDOWS * width`` times at most and a group of stretches ``FANOUT * (width + 1)`` candidates; no function is ever
kept in one value.  The number of steps is the same for every input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

BLOCK_WINDOWS = 16
FANOUT = 64
LEVELS = 2

#: The start that a key's first stretch is entered with.
NO_WINDOW = -(1 << 63)


def _floor_div(value: Column, size: int) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(size)), F.lit(size))


def _first_starts(times: np.ndarray, begin: int, width: int) -> np.ndarray:
    """Which of a stretch's sorted times can be its first start, whatever window is open at ``begin``."""
    return np.concatenate(([True], times[:-1] < begin + width))


def _walk(cand: np.ndarray, last: np.ndarray, current: np.ndarray, width: int) -> np.ndarray:
    """The last starts after a stretch that is entered with the starts ``current``."""
    j = np.searchsorted(cand, current + width, side="right")
    return np.where(j < len(cand), last[np.minimum(j, len(cand) - 1)], current)


def _stretches(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(number, candidates, last starts) of each stretch in a group, in order."""
    pdf = pdf.sort_values(["_at", "_cand"])
    at, cand, last = (pdf[c].to_numpy(dtype=np.int64) for c in ("_at", "_cand", "_last"))
    cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
    return [(int(a[0]), c, x) for a, c, x in zip(np.split(at, cuts), np.split(cand, cuts), np.split(last, cuts))]


def _entries(stretches: list, entry: int, width: int) -> list[tuple[int, int]]:
    """(number, start it is entered with) of each stretch."""
    out, current = [], np.array([entry], dtype=np.int64)
    for at, cand, last in stretches:
        out.append((at, int(current[0])))
        current = _walk(cand, last, current, width)
    return out


def scan_starts(times: np.ndarray, entry: int, width: int) -> np.ndarray:
    """The window start of each of the sorted ``times`` when the window of ``entry`` is open before them."""
    out = np.empty(len(times), dtype=np.int64)
    start, i = entry, 0
    while True:
        k = int(np.searchsorted(times, start + width, side="right"))
        out[i:k] = start
        if k == len(times):
            return out
        start, i = int(times[k]), k


def chained_windows(times: DataFrame, key: str, time: str, count: str, width: int) -> DataFrame:
    """(key, time, count, window_start) of ``times``, whose rows (key, time) are distinct and not null; ``count`` is carried along."""
    ship_package(times.sparkSession)
    kind = times.schema[key].dataType.simpleString()
    block = BLOCK_WINDOWS * width

    def columns(k, rows: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({key: [k] * len(rows), "_at": [r[0] for r in rows], "_entry": [r[1] for r in rows]})

    def leaf(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf[time].to_numpy(dtype=np.int64))
        cand = t[_first_starts(t, int(k[1]) * block, width)]
        last = cand
        while True:   # at most BLOCK_WINDOWS steps, all candidates at once
            then = _walk(t, t, last, width)
            if np.array_equal(then, last):
                break
            last = then
        return pd.DataFrame({key: [k[0]] * len(cand), "_at": k[1], "_cand": cand, "_last": last})

    def joined(size: int):
        def up(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            s = _stretches(pdf)
            cand, last = (np.concatenate([s[0][i]] + [x[i][:1] for x in s[1:2]]) for i in (1, 2))
            for _, c, x in s[1:]:
                last = _walk(c, x, last, width)
            first = _first_starts(cand, int(k[1]) * size, width)
            return pd.DataFrame({key: [k[0]] * int(first.sum()), "_at": k[1], "_cand": cand[first], "_last": last[first]})
        return up

    def top(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return columns(k[0], _entries(_stretches(pdf), NO_WINDOW, width))

    def down(k: tuple, below: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        return columns(k[0], _entries(_stretches(below), int(above["_entry"].iloc[0]), width))

    def windows(k: tuple, inside: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inside = inside.sort_values(time)
        t = inside[time].to_numpy(dtype=np.int64)
        return pd.DataFrame({key: [k[0]] * len(t), time: t, count: inside[count].to_numpy(), "window_start": scan_starts(t, int(above["_entry"].iloc[0]), width)})

    cut = times.select(key, time, count, _floor_div(F.col(time), block).alias("_at"))
    stretch, entered = f"`{key}` {kind}, _at bigint, _cand bigint, _last bigint", f"`{key}` {kind}, _at bigint, _entry bigint"
    levels = [cut.groupBy(key, "_at").applyInPandas(leaf, stretch)]
    for i in range(LEVELS):
        grouped = levels[i].withColumn("_up", _floor_div(F.col("_at"), FANOUT))
        levels[i] = grouped
        levels.append(grouped.groupBy(key, "_up").applyInPandas(joined(block * FANOUT ** (i + 1)), stretch))
    entries = levels[-1].groupBy(key).applyInPandas(top, entered)
    for lower in reversed(levels[:-1]):
        entries = lower.groupBy(key, "_up").cogroup(entries.groupBy(key, "_at")).applyInPandas(down, entered)
    return (cut.groupBy(key, "_at").cogroup(entries.groupBy(key, "_at"))
            .applyInPandas(windows, f"`{key}` {kind}, `{time}` bigint, `{count}` bigint, window_start bigint"))
