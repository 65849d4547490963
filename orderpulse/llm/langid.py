"""Language identification of whole, possibly mixed texts.

Every word gets a score per language from hashed character n-grams (naive Bayes).  The script of
the word narrows the candidates first: a language that hardly uses a script cannot win a word of it.
A Viterbi walk over the words with a penalty for switching then labels spans, so a single odd word
does not break a span but a run in another language does.  A text's language is the one whose spans
hold the most letters, and its score is their share.

Training is a Spark job: words are counted per label inside the tasks, n-gram counts are summed by
a shuffle, and only the table (label, n-gram bucket) of at most ``MAX_LABELS`` x ``BUCKETS`` counts
reaches the driver.  The classifier is fitted on about ``docs_per_label`` documents of each label,
chosen by a hash of the row (a documented bound of the classifier; prediction reads every text).

Defined results: a text that is null, empty or without a letter is ``und`` with score 0, and so is
every text when nothing was learned.  Ties go to the smaller label by code point.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import viterbi
from .common import map_rows

UNDETERMINED = "und"
BUCKETS = 1 << 15
#: A model of more labels is refused: it is collected and broadcast.
MAX_LABELS = 512
DOCS_PER_LABEL = 4000
GRAMS = (1, 2, 3, 4)
SWITCH_PENALTY = 12.0
#: Share of a label's letters below which it does not count as using a script.
SCRIPT_SHARE = 0.02
_NEVER = -1e4
_CACHE_WORDS = 400_000
#: Texts walked together: a step of the walk costs the same for few or many of them.
ROWS_TOGETHER = 4000
_WORD = re.compile(r"[^\W\d_]+")

# The first and last code point of the main blocks of each script.
SCRIPTS = {
    "Latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x530, 0x58F),),
    "Hebrew": ((0x590, 0x5FF),),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFEFC)),
    "Devanagari": ((0x900, 0x97F),),
    "Bengali": ((0x980, 0x9FF),),
    "Tamil": ((0xB80, 0xBFF),),
    "Telugu": ((0xC00, 0xC7F),),
    "Thai": ((0xE00, 0xE7F),),
    "Georgian": ((0x10A0, 0x10FF),),
    "Hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "Ethiopic": ((0x1200, 0x137F),),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "Han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)),
}
N_SCRIPTS = len(SCRIPTS) + 1  # 0: any other script
_RANGES = sorted((a, b, i) for i, spans in enumerate(SCRIPTS.values(), 1) for a, b in spans)
_STARTS = np.array([a for a, _, _ in _RANGES])
_ENDS = np.array([b for _, b, _ in _RANGES])
_IDS = np.array([i for _, _, i in _RANGES])


def script_of(points: np.ndarray) -> np.ndarray:
    at = np.maximum(np.searchsorted(_STARTS, points, side="right") - 1, 0)
    return np.where((points >= _STARTS[at]) & (points <= _ENDS[at]), _IDS[at], 0)


def letters_of(word: str) -> str:
    """``word`` without what the word pattern takes but no alphabet has, such as superscript digits."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def grams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: (word index, bucket) of every n-gram, the word's borders counting as
    one character each."""
    u = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    border = u == 10
    word = np.cumsum(border) - 1
    out = []
    for n in GRAMS:
        size = len(u) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        ok = ~border[:size] if n == 1 else np.ones(size, bool)
        for j in range(n):
            h = (h ^ u[j:j + size]) * np.uint64(0x100000001B3)
            if 0 < j < n - 1:
                ok &= ~border[j:j + size]
        if n == 2:
            ok &= ~(border[:size] & border[1:size + 1])
        at = np.flatnonzero(ok)
        bucket = (h[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
        out.append((np.where(border[at], word[np.minimum(at + 1, len(u) - 1)], word[at]), bucket.astype(np.int64)))
    return out


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray   # (BUCKETS, K) log probability of an n-gram bucket
    allowed: np.ndarray   # (N_SCRIPTS, K) candidates of each script

    def score(self, words: list[str]) -> np.ndarray:
        """(len(words), K) scores; words hold letters only."""
        total = np.zeros((len(words), len(self.labels)))
        if not words or not self.labels:
            return total
        for word, bucket in grams(words):
            for k in range(len(self.labels)):
                total[:, k] += np.bincount(word, self.weights[bucket, k], minlength=len(words))
        first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
        total = total / len(GRAMS) - (total / len(GRAMS)).max(1, keepdims=True)
        return np.where(self.allowed[script_of(first)], total, _NEVER)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
          docs_per_label: int = DOCS_PER_LABEL) -> Model:
    """Fit on rows with a text and a label."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                           F.col(label_col).cast("string").alias("label")).where("text is not null and label is not null")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((N_SCRIPTS, 0), bool))
    scale = 1 << 30
    rate: Column = F.lit(0)
    for label, n in sizes.items():
        rate = F.when(F.col("label") == label, int(scale * min(1.0, docs_per_label / n))).otherwise(rate)
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < rate).select("label", "text")

    def make():
        def f(b: pa.RecordBatch) -> dict:
            words: dict[str, Counter] = defaultdict(Counter)
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words[label].update(_WORD.findall(text.lower()))
            out: dict[str, list] = {"label": [], "feature": [], "n": []}
            for label, found in words.items():
                kept = Counter()
                for w, n in found.items():
                    kept[letters_of(w)] += n
                kept.pop("", None)
                if not kept:
                    continue
                forms, times = list(kept), np.array(list(kept.values()), np.float64)
                counts = sum(np.bincount(b, times[w], BUCKETS) for w, b in grams(forms))
                points = np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32)
                per = np.repeat(times, [len(w) for w in forms])
                script = np.bincount(script_of(points), per, N_SCRIPTS)
                full = np.concatenate((counts, script))
                at = np.flatnonzero(full)
                out["label"] += [label] * len(at)
                out["feature"] += at.tolist()
                out["n"] += full[at].astype(np.int64).tolist()
            return out
        return f

    counted = (map_rows(rows, make, "label string, feature int, n long")
               .groupBy("label", "feature").agg(F.sum("n").alias("n")).toPandas())
    labels = sorted(sizes, key=lambda x: x.encode())
    full = np.zeros((BUCKETS + N_SCRIPTS, len(labels)))
    full[counted["feature"].to_numpy(int), counted["label"].map({x: i for i, x in enumerate(labels)}).to_numpy(int)] = counted["n"]
    n, script = full[:BUCKETS], full[BUCKETS:]
    weights = np.log((n + 0.5) / (n.sum(0) + 0.5 * BUCKETS))
    allowed = script >= SCRIPT_SHARE * np.maximum(script.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(labels, weights.astype(np.float32), allowed)


class Labeller:
    """Labels the words of texts; keeps the scores of words already seen, up to a bound."""

    def __init__(self, model: Model, penalty: float = SWITCH_PENALTY):
        self.model, self.penalty = model, penalty
        self._start()

    def _start(self) -> None:
        self.ids: dict[str, int] = {"": 0}
        self.scores = np.zeros((1, len(self.model.labels)))
        self.letters = np.zeros(1, np.int64)

    def _learn(self, words: set[str]) -> None:
        new = sorted(words)
        forms = [letters_of(w) for w in new]
        solid = [i for i, w in enumerate(forms) if w]
        got = np.zeros((len(new), len(self.model.labels)))
        got[solid] = self.model.score([forms[i] for i in solid])
        self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
        self.scores = np.concatenate((self.scores, got))
        self.letters = np.concatenate((self.letters, [len(w) for w in forms]))

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(label of each word, letters of each word, words of each text)."""
        if len(self.ids) > _CACHE_WORDS:
            self._start()
        found = [_WORD.findall(t.lower()) if t else [] for t in texts]
        if new := set().union(*found) - self.ids.keys():
            self._learn(new)
        lengths = np.array([len(w) for w in found], np.int64)
        ids = np.fromiter((i for w in found for i in map(self.ids.__getitem__, w)), np.int64, int(lengths.sum()))
        out = np.zeros(len(ids), np.int64)
        if self.model.labels:
            starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            for part in viterbi.groups(lengths):
                viterbi.walk_switching(starts[part], lengths[part], lambda rows: self.scores[ids[rows]], self.penalty, out)
        return out, self.letters[ids], lengths


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score, n_spans): n_spans counts runs of one language in the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = Labeller(shared.value)
        labels, k = shared.value.labels, len(shared.value.labels)

        def f(b: pa.RecordBatch) -> dict:
            label, letters, lengths = labeller.label(b.column(1).to_pylist())
            doc = np.repeat(np.arange(len(lengths)), lengths)
            out: dict = {"id": b.column(0)}
            if not k:
                return out | {"lang_pred": [UNDETERMINED] * len(lengths), "score": [0.0] * len(lengths), "n_spans": [0] * len(lengths)}
            held = np.bincount(doc * k + label, letters, len(lengths) * k).reshape(-1, k)
            total = held.sum(1)
            kept = letters > 0
            d, x = doc[kept], label[kept]
            opens = np.ones(len(x), bool)
            opens[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
            out["lang_pred"] = [labels[i] if t else UNDETERMINED for i, t in zip(held.argmax(1), total)]
            out["score"] = np.divide(held.max(1), total, out=np.zeros(len(total)), where=total > 0)
            out["n_spans"] = np.bincount(d[opens], minlength=len(lengths))
            return out
        return f

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_rows(docs.select(id_col, F.col(text_col).cast("string").alias("text")), make,
                   f"id {kind}, lang_pred string, score double, n_spans long", ROWS_TOGETHER)
    return out.withColumnRenamed("id", id_col)


def spans(text: str, model: Model, penalty: float = SWITCH_PENALTY) -> list[tuple[int, int, str]]:
    """(start, end, language) of each run of one language in ``text``, in code points."""
    label, letters, _ = Labeller(model, penalty).label([text])
    out: list[tuple[int, int, str]] = []
    lowered = text.lower()
    if len(lowered) != len(text):   # lowering changed the offsets: lower each character alone
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        label, letters, _ = Labeller(model, penalty).label([lowered])
    for m, x, n in zip(_WORD.finditer(lowered), label, letters):
        if not n or not model.labels:
            continue
        name = model.labels[x]
        if out and out[-1][2] == name:
            out[-1] = (out[-1][0], m.end(), name)
        else:
            out.append((m.start(), m.end(), name))
    return out
