"""Personal data: fixed patterns plus a linear-chain conditional random field (CRF).

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers in their plain forms.
The CRF labels every white-space token of the whole text from word-shape features of the token and its
neighbours and adds forms the patterns do not have (a phone number without a plus, a spelled-out
address).  It is trained here, by gradient ascent on the likelihood of a small labelled
table (``labelled_rows``), and decoded by Viterbi in numpy batches.  A run of one label is cut at the
spans of the patterns, which always stay as they are, and at each complete form of its kind, so
neighbouring items of one kind are added one by one.

All pattern searches take time in proportion to the text: each run of characters that may start
a match is looked at once.

Defined results: a null or empty text has no spans; repeated rows each get their own; offsets are code
points, ends exclusive; spans are ordered by start, then by kind in the order of ``KINDS``.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import viterbi
from .common import map_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
#: Sentences that training takes at most; they are collected to the driver.
MAX_TRAINING_ROWS = 5000
_CACHE_WORDS = 600_000

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+\.[0-9]+\.[0-9]+)?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_MARKS = ",.;:!?\"'"


def emails(text: str) -> Iterator[Span]:
    """Each @ with its run of local characters before it; runs of different @ do not overlap."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield "email", start, m.end()
            done = end = m.end()
        at = text.find("@", end)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if m.group(1) and all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            yield "ip", *m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                yield "phone", *m.span()


def base_spans(text: str | None) -> list[Span]:
    """Spans of the patterns, ordered."""
    if not text:
        return []
    found = list(emails(text))
    if _DIGIT.search(text):
        found += itertools.chain(ips(text), cards(text), phones(text))
    return ordered(found)


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- features ---------------------------------------------------------------------------------------

def shape(token: str) -> str:
    """Runs of capitals as X, of other letters as x, digits as a 9 each (up to 20), the rest as it is."""
    out: list[str] = []
    for c in token[:64]:
        k = "9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if k == "9" or not out or out[-1] != k:
            out.append(k)
    return "".join(out)[:20]


def features(token: str) -> tuple[str, ...]:
    """Word-shape features of a token on its own."""
    bare = token.strip(_MARKS)
    if bare.isalpha():
        return ("s=X" if bare[0].isupper() else "s=x", "w=" + bare.lower())
    digits = sum("0" <= c <= "9" for c in bare)
    letters = sum(c.isalpha() for c in bare)
    s = shape(bare)
    kind = ("d" * (digits > 0)) + ("l" * (letters > 0)) + "".join(c for c in "@.-+()[]:/%" if c in bare)
    return ("s=" + s, "c=" + re.sub("9+", "9", s)[:8], "k=" + kind, f"n={min(digits, 20)}" + ("l" if letters else ""), "w=" + bare.lower())


# --- training ---------------------------------------------------------------------------------------

def labelled_rows() -> list[tuple[str, str]]:
    """The small labelled table: (sentence, labels by token), made from the rules below."""
    names = ("ann", "j.doe", "maria-k", "info", "lee_9", "t.weber")
    hosts = ("example", "mail7", "post", "web-de")
    prose = ("the report was sent to the office on monday", "wir haben das haus am see gesehen", "le petit chat est sur la table", "el libro de la casa es rojo",
             "version 2.10.3 was built in 2021 with 48 tests", "it costs 1,299.00 or 35 % less", "see chapter 12.4 on page 318", "at 10:45 on 2024-03-17 we met",
             "license 4.0 holds for 1200 items", "the score was 3-2 after 90 minutes", "order 20240117 has 16 lines", "a = b + 42", "room 101 and room 202",
             "und die Zahl 12345 war richtig", "build 9f86d081884c7d65 passed", "in 1999 and 2003 there were 5000 people", "https://example.com/a?b=12 is a page",
             "que 12 de 40 son de 2019", "### ~~~ *** $$$ || >>", "Thantion. onreea, Ingthe thonst% ere&", "isbn 978 3 16 148410", "ratio 0.125 of 3.75 10.5", "v1.2.3.4-beta is out")
    out = [(p, " ".join("O" for _ in p.split())) for p in prose]

    def add(before: str, what: str, kind: str, after: str) -> None:
        words = [(w, "O") for w in before.split()] + [(w, kind) for w in what.split()] + [(w, "O") for w in after.split()]
        out.append((" ".join(w for w, _ in words), " ".join(x for _, x in words)))

    frames = (("please write to", "for the rest"), ("contact", "or wait"), ("und dann", "ist da"), ("call", "."), ("the number is", ", he said"), ("la casa de", "en la calle"), ("", "and more"), ("from", "to here"))
    for i, (n, (a, z)) in enumerate(itertools.product(names, frames)):
        h = hosts[i % len(hosts)]
        add(a, f"{n}@{h}.com", "email", z)
        add(a, f"{n} [at] {h} [dot] com", "email", z)
        add(a, f"{n}[at]{h}[dot]org", "email", z)
        add(a, f"{n}(at){h}.net", "email", z)
        d = f"{(i * 7919 + 123) % 10 ** 10:010d}"
        add(a, f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", "phone", z)
        add(a, f"({d[:3]}) {d[3:6]}-{d[6:]}", "phone", z)
        add(a, f"{d[:3]}-{d[3:6]}-{d[6:]}", "phone", z)
        add(a, f"+49 {d[:3]} {d[3:]}", "phone", z)
        add(a, f"{17 + i * 5 % 200}.{i * 11 % 256}.{d[:2]}.{i % 250}", "ip", z)
        add(a, f"fe80::{d[:4]}:{d[4:8]}", "ip", z)
        groups = [(i * 40503 + j * 25717 + 97) % 65536 for j in range(8)]
        for width in (0, 4):
            full = [":".join(f"{g:0{width}x}" for g in x) for x in (groups, groups[::-1])]
            add(a, full[0], "ip", z)
            add(a, " ".join(full), "ip", z)
        c = f"4{(i * 104729 + 5) % 10 ** 15:015d}"
        add(a, c, "card", z)
        add(a, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", "card", z)
        add(a, f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}", "card", z)
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "text string, labels string")


class Crf:
    """Label scores are sums of weights of a token's own features and its two neighbours'."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.index, self.weights, self.transitions = index, weights, transitions  # weights: (3, features, K)

    @staticmethod
    def train(rows: list[tuple[str, str]], steps: int = 80, rate: float = 0.5, l2: float = 2e-3) -> Crf:
        """Gradient ascent (AdaGrad) on the penalised log likelihood, all sentences at once."""
        tokens = [t.split() for t, _ in rows]
        gold = [[LABELS.index(x) for x in y.split()] for _, y in rows]
        seen = sorted({f for s in tokens for w in s for f in features(w)})
        index = {f: i + 1 for i, f in enumerate(seen)}  # 0: nothing, also beyond the ends
        k, n, m = len(LABELS), len(rows), max(map(len, tokens))
        width = max(len(features(w)) for s in tokens for w in s)
        x = np.zeros((n, m + 2, width), int)
        y, mask = np.zeros((n, m), int), np.zeros((n, m))
        for i, s in enumerate(tokens):
            for j, w in enumerate(s):
                f = [index[v] for v in features(w)]
                x[i, j + 1, :len(f)] = f
            y[i, :len(s)], mask[i, :len(s)] = gold[i], 1
        w, tr = np.zeros((3, len(index) + 1, k)), np.zeros((k, k))
        gw, gt = np.full(w.shape, 1e-6), np.full(tr.shape, 1e-6)
        places = (x[:, 1:-1], x[:, :-2], x[:, 2:])
        onehot = np.eye(k)[y] * mask[..., None]
        pairs = (mask[:, 1:, None, None] * np.eye(k)[y[:, :-1]][..., :, None] * np.eye(k)[y[:, 1:]][..., None, :]).sum((0, 1))
        for _ in range(steps):
            e = sum(w[p][places[p]].sum(2) for p in range(3))
            a, b = np.zeros((n, m, k)), np.zeros((n, m, k))
            a[:, 0] = e[:, 0]
            for t in range(1, m):
                step = np.logaddexp.reduce(a[:, t - 1, :, None] + tr, axis=1) + e[:, t]
                a[:, t] = np.where(mask[:, t, None] > 0, step, a[:, t - 1])
            for t in range(m - 2, -1, -1):
                step = np.logaddexp.reduce(tr + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
                b[:, t] = np.where(mask[:, t + 1, None] > 0, step, 0)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + b - z[:, None, None]) * mask[..., None]
            joint = np.exp(a[:, :-1, :, None] + tr + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            diff = onehot - p
            for q in range(3):
                at, by = places[q].reshape(-1), np.repeat(diff.reshape(-1, k), width, 0)
                g = np.stack([np.bincount(at, by[:, c], len(w[q])) for c in range(k)], 1)
                g -= l2 * n * 0.01 * w[q]
                g[0] = 0
                gw[q] += g * g
                w[q] += rate * g / np.sqrt(gw[q])
            g = pairs - joint.sum((0, 1)) - l2 * n * 0.01 * tr
            gt += g * g
            tr += rate * g / np.sqrt(gt)
        return Crf(index, w, tr)

    def vectors(self, token: str) -> np.ndarray:
        """(3, K): what a token adds to its own label's scores, the next token's and the one's before."""
        at = [i for f in features(token) if (i := self.index.get(f))]
        return self.weights[:, at].sum(1)


class Tagger:
    """Finds the spans of texts; keeps the vectors of tokens already seen, up to a bound."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self._start()

    def _start(self) -> None:
        self.ids: dict[str, int] = {"": 0}
        self.rows = [np.zeros((3, len(LABELS)))]
        self.same: dict[bytes, int] = {self.rows[0].tobytes(): 0}
        # a word of letters that training did not see has one of two vectors
        self.words = {f[2:] for f in self.crf.index if f.startswith("w=")}
        self.plain = [self._row(self.crf.vectors(w)) for w in ("\u0101", "\u0100")]

    def _row(self, v: np.ndarray) -> int:
        i = self.same.setdefault(v.tobytes(), len(self.rows))
        if i == len(self.rows):
            self.rows.append(v)
        return i

    def _id(self, token: str) -> int:
        bare = token.strip(_MARKS)
        if bare.isalpha() and bare.lower() not in self.words:
            i = self.plain[bare[0].isupper()]
        else:
            i = self._row(self.crf.vectors(token))
        self.ids[token] = i
        return i

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(label of each token, tokens of each text).

        A token whose score for O leads by more than any two transitions can make up is O on the best
        path.  Such tokens cut the texts, and the walk goes over the rest only; the result is that
        of the walk over whole texts."""
        if len(self.ids) > _CACHE_WORDS:
            self._start()
        get, make = self.ids.get, self._id
        split = [t.split() if t else [] for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        # between two texts stands one empty token, so neighbours never cross
        ids = np.zeros(int(lengths.sum()) + len(split) + 1, np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1] + 1
        for s, at in zip(split, starts.tolist()):
            ids[at:at + len(s)] = [make(w) if (i := get(w)) is None else i for w in s]
        inner = np.zeros(len(ids), bool)
        keep = np.repeat(starts, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        inner[keep] = True
        own, before, after = np.array(self.rows).transpose(1, 0, 2)
        tr = self.crf.transitions
        scores = own[ids]
        scores[1:] += before[ids[:-1]]
        scores[:-1] += after[ids[1:]]
        open_ = inner & (scores[:, 0] - scores[:, 1:].max(1) <= 2 * (tr.max() - tr.min()))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], open_, [False])).astype(np.int8)))
        first, last = edge[::2], edge[1::2] - 1
        scores[first] += np.where(inner[first - 1], 1, 0)[:, None] * tr[0]
        scores[last] += np.where(inner[last + 1], 1, 0)[:, None] * tr[:, 0]
        out = np.zeros(len(ids), np.int8)
        for part in viterbi.groups(last - first + 1):
            viterbi.walk(first[part], (last - first + 1)[part], lambda r: scores[r], tr, out)
        return out[keep], lengths

    def spans(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """(spans of the patterns, all spans) of each text."""
        label, lengths = self.label(texts)
        ends = np.cumsum(lengths)
        out = []
        for t, a, b in zip(texts, ends - lengths, ends):
            base = base_spans(t)
            added = _accepted(t, label[a:b], base) if t and label[a:b].any() else []
            out.append((base, ordered(base + added)))
        return out


def _accepted(text: str, label: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of the runs of one label that touch no span of ``base``.

    A run is cut at the spans of ``base``.  A part that has the form of its kind as a whole, without
    punctuation around it, is one span; any other part gives a span for each complete form in it, so
    neighbouring items of one kind are found one by one."""
    tokens = list(_TOKEN.finditer(text))
    out = []
    cuts = np.flatnonzero(np.diff(label)) + 1
    taken = _merged(base)
    starts = [a for a, _ in taken]
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(label)]):
        if not label[s]:
            continue
        kind = LABELS[label[s]]
        at, last = tokens[s].start(), tokens[e - 1].end()
        i = max(0, bisect.bisect_right(starts, at) - 1)
        while i < len(taken) and taken[i][0] < last:
            a, b = taken[i]
            out += _items(kind, text, at, min(a, last))
            at, i = max(at, b), i + 1
        out += _items(kind, text, at, last)
    return out


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The places that ``spans`` cover, in order and apart from each other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _items(kind: str, text: str, start: int, end: int) -> list[Span]:
    """The part ``start:end`` of a run as one span, or the complete forms in it."""
    whole = _bare(text, start, end)
    if whole is None:
        return []
    if _has_form(kind, text[slice(*whole)]):
        found = [whole]
    elif kind == "email":
        found = [m.span() for m in _ONE_SPELLED.finditer(text, *whole)]
    elif kind == "ip":
        found = [x for m in _SIX_RUN.finditer(text, *whole) if (x := _bare(text, *m.span())) and _has_form(kind, text[slice(*x)])]
    else:
        found = _numbers(kind, text, *whole)
    return [(kind, a, b) for a, b in found if not _inside_word(text, a) and not _inside_word(text, b)]


def _bare(text: str, start: int, end: int) -> tuple[int, int] | None:
    """A place without the white space and punctuation around it; None if nothing is left."""
    while start < end and (text[start] in _MARKS or text[start].isspace()):
        start += 1
    while start < end and (text[end - 1] in _MARKS or text[end - 1].isspace()):
        end -= 1
    return (start, end) if start < end else None


def _inside_word(text: str, at: int) -> bool:
    """Whether ``at`` stands between two letters or digits."""
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def _numbers(kind: str, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The complete numbers that cover most digits of ``start:end`` (then: the fewest, the first).

    A number is a row of atoms without letters; it ends before its digits are too many and before more than
    ``_MAX_GAP`` atoms without a digit, so each atom starts a bounded number of candidates."""
    atoms = [m.span() for m in _ATOM.finditer(text, start, end)]
    digits = [sum("0" <= c <= "9" for c in text[a:b]) for a, b in atoms]
    words = [any(c.isalpha() for c in text[a:b]) for a, b in atoms]
    most = 19 if kind == "card" else 15
    best: list[tuple[int, int]] = [(0, 0)] * (len(atoms) + 1)   # digits covered from an atom on, less spans
    take: list[tuple[int, tuple[int, int]] | None] = [None] * len(atoms)
    for i in range(len(atoms) - 1, -1, -1):
        best[i] = best[i + 1]
        total = gap = 0
        for j in range(i, len(atoms)):
            total += digits[j]
            gap = 0 if digits[j] else gap + 1
            if words[j] or total > most or gap > _MAX_GAP:
                break
            if not digits[j] or (place := _bare(text, atoms[i][0], atoms[j][1])) is None or not _has_form(kind, text[slice(*place)]):
                continue
            value = best[j + 1][0] + total, best[j + 1][1] - 1
            if value > best[i] or value == best[i] and take[i] is None and digits[i]:
                best[i], take[i] = value, (j + 1, place)
    out, i = [], 0
    while i < len(atoms):
        if take[i] is None:
            i += 1
        else:
            i, place = take[i]
            out.append(place)
    return out


_AT, _DOT = r"(?:@|[\[(]\s*at\s*[\])])", r"[\[(]\s*dot\s*[\])]"
_SPELLED = re.compile(rf"[\w.+-]+\s*{_AT}\s*[\w-]+(?:\s*(?:\.|{_DOT})\s*[\w-]+)+", re.ASCII)
# One address among others, searched in linear time: a full stop and white space before the next address end it.
_ONE_SPELLED = re.compile(rf"(?<![\w.+-])[\w.+-]++\s*+{_AT}\s*+[\w-]++(?:\s*+(?:\.(?!\s++[\w.+-]++\s*+{_AT})|{_DOT})\s*+[\w-]++)++", re.ASCII)
_SIX = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
_SIX_FULL = re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}")
_SIX_RUN = re.compile(r"[0-9A-Fa-f:]+")
_ATOM = re.compile(r"[^\s,;/|]+")
_MAX_GAP = 3


def _has_form(kind: str, body: str) -> bool:
    """The least that a span of a kind must have."""
    digits = "".join(c for c in body if "0" <= c <= "9")
    plain = not any(c.isalpha() for c in body)
    if kind == "email":
        return bool(_SPELLED.fullmatch(body))
    if kind == "ip":
        return bool(_SIX_FULL.fullmatch(body)) or bool(_SIX.fullmatch(body)) and "::" in body
    if kind == "card":
        return plain and 12 <= len(digits) <= 19 and luhn(digits) and set(body) <= set("0123456789 .-")
    return plain and 9 <= len(digits) <= 15 and body.count("(") == body.count(")") and (body[0] in "(+" or body.count("-") >= 2)


def train(labelled: DataFrame) -> Crf:
    """Train on (text, labels) rows; at most ``MAX_TRAINING_ROWS``."""
    rows = [(r.text, r.labels) for r in labelled.orderBy("text", "labels").limit(MAX_TRAINING_ROWS + 1).collect()]
    if len(rows) > MAX_TRAINING_ROWS:
        raise ValueError(f"more than {MAX_TRAINING_ROWS} training rows")
    return Crf.train(rows)


def find(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, base, spans) of every whole text, each an array of (kind, start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def make():
        tagger = Tagger(shared.value)

        def f(b: pa.RecordBatch) -> dict:
            both = tagger.spans(b.column(1).to_pylist())
            rows = lambda i: [[{"kind": k, "start": s, "end": e} for k, s, e in x[i]] for x in both]
            return {"id": b.column(0), "base": rows(0), "spans": rows(1)}
        return f

    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind:string,start:int,end:int>>"
    out = map_rows(docs.select(id_col, F.col(text_col).cast("string").alias("text")), make, f"id {kind}, base {span}, spans {span}")
    return out.withColumnRenamed("id", id_col)


def digest(found: DataFrame, kinds: tuple[str, ...] = KINDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_<kind> of each kind's base spans, base_sha256, spans as text, and the columns ``keep``."""
    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), *keep)
