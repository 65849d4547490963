"""Viterbi over many sequences of different lengths at once, in numpy.

Sequences are walked in step: step *t* handles word *t* of every sequence that has one, so the
Python loop runs once per position of the longest sequence, not once per word.  Only back pointers
are stored (a byte per word and label); the scores of a step are asked for when it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Words of the sequences walked together; one longer sequence is walked alone.
WORDS_AT_ONCE = 1 << 20


def groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indexes of the sequences in groups of about ``WORDS_AT_ONCE`` words, longest first, so that
    sequences of a group have similar lengths."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    cut = np.cumsum(lengths[order]) // WORDS_AT_ONCE
    for part in np.split(order, np.flatnonzero(np.diff(cut)) + 1):
        if len(part):
            yield part


def _steps(starts: np.ndarray, lengths: np.ndarray):
    """For sequences sorted longest first: how many still run at each position."""
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
    return starts, active


def walk(starts: np.ndarray, lengths: np.ndarray, scores: Callable[[np.ndarray], np.ndarray],
         transitions: np.ndarray, out: np.ndarray) -> None:
    """Best label of every word, written to ``out``.

    starts, lengths: first word and number of words of each sequence, longest first.  scores(rows):
    (len(rows), K) label scores of those words.  transitions[i, j]: score of label j after i.
    Ties go to the smaller label."""
    starts, active = _steps(starts, lengths)
    k = transitions.shape[0]
    base = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    back = np.zeros((int(lengths.sum()), k), np.uint8)
    best = scores(starts).astype(np.float64)
    final = np.zeros(len(starts), np.intp)
    for t in range(1, len(active)):
        n, before = active[t], len(best)
        if n < before:
            final[n:before] = best[n:].argmax(1)
            best = best[:n]
        via = best[:, :, None] + transitions
        frm = via.argmax(1)
        back[base[:n] + t] = frm
        best = np.take_along_axis(via, frm[:, None, :], 1)[:, 0] + scores(starts[:n] + t)
    final[:len(best)] = best.argmax(1)
    _trace(starts, active, final, lambda rows, lab: back[rows, lab], base, out)


def walk_switching(starts: np.ndarray, lengths: np.ndarray, scores: Callable[[np.ndarray], np.ndarray],
                   penalty: float, out: np.ndarray) -> None:
    """As ``walk`` for transitions that are 0 for staying and ``-penalty`` for any switch, in K steps
    instead of K * K a word."""
    starts, active = _steps(starts, lengths)
    base = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    best = scores(starts).astype(np.float64)
    stay = np.ones((int(lengths.sum()), best.shape[1]), bool)
    origin = np.zeros(len(stay), np.int16)
    final = np.zeros(len(starts), np.intp)
    for t in range(1, len(active)):
        n, before = active[t], len(best)
        if n < before:
            final[n:before] = best[n:].argmax(1)
            best = best[:n]
        top = best.argmax(1)
        limit = (np.take_along_axis(best, top[:, None], 1) - penalty)
        rows = base[:n] + t
        stay[rows] = best >= limit
        origin[rows] = top
        best = np.maximum(best, limit) + scores(starts[:n] + t)
    final[:len(best)] = best.argmax(1)
    _trace(starts, active, final, lambda rows, lab: np.where(stay[rows, lab], lab, origin[rows]), base, out)


def _trace(starts, active, final, before, base, out) -> None:
    label = final.copy()
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        out[starts[:n] + t] = label[:n]
        if t:
            label[:n] = before(base[:n] + t, label[:n])
