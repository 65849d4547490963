"""Secrets: fixed patterns plus a guess-cost estimate for values in credential contexts.

The patterns find assignments to credential names, access key ids and long hexadecimal strings.  The
method looks at further values that stand in a credential context ("passphrase is ...", "Bearer ...",
"pwd: ...", with any run of blanks and tabs around the sign) and estimates how many guesses an attacker
needs.  A name may be a part of a longer one joined by ``_``, ``-`` or a change of case; further contexts are
``Authorization: Basic``, the password of a URL (``://user:...@host``), and after "passphrase:" four to 24 words
of three or more small letters.  The estimate is the cheapest way to cut the value into dictionary words, dates, repeats, keyboard walks,
sequences and brute-force spans, found by dynamic programming over its positions.  A value of six or
more characters, of whatever letters, whose cheapest cut needs at least ``MIN_GUESSES_LOG10`` is a
secret; a placeholder such as "changeme1234" is not.  The cost alone decides, so after "is" a long
rare or foreign word that the dictionary lacks is one too.  Added spans have the kind ``guess``; those
that touch a pattern's span are left out, so the patterns' spans stay as they are.

The dictionary is the words of a tokenizer's rank file: a word's rank bounds its guesses.  It is read
on the driver and broadcast (its size is checked).

Cost in time: patterns are searched in proportion to the text, and the dynamic program looks at most
``MAX_WORD`` characters back for words and keeps the cheapest start of each run and repeat as it goes, so
a value of any length is handled whole.

Defined results: a null or empty text has no spans; repeated rows each get their own; offsets are code
points, ends exclusive; spans are ordered by start, then by kind in the order of ``KINDS``.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

KINDS = ("assign", "access", "hex", "guess")
BASE_KINDS = KINDS[:3]
MIN_GUESSES_LOG10 = 10.0
DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
MAX_DICTIONARY = 1_000_000
MAX_WORD = 32

Span = tuple[str, int, int]

# The patterns of the base kinds; letters of the names in either case.
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT_WORDS = ("pwd", "pass", "credential", "bearer", "client", "private", "secret", "token", "api", "access", "login", "auth", "://")
# A credential name stands alone or at a joint of a longer one (db_pass, userPwd, PGPASS); up to three more parts may follow it.
_NAME = (r"(?:(?ai:(?<![A-Za-z0-9])(?:pwd|pass(?:word|wd|phrase|code)?|credentials?|(?:client|private|access|api|auth|secret)[_\x20-]?(?:key|token|secret)|secret|token|login))"
         r"|(?<=[a-z0-9])(?:Pwd|Pass(?:word|wd|phrase|code)?|Secret|Token|Credentials?)|(?<=[A-Z0-9])(?:PWD|PASS(?:WORD|WD|PHRASE|CODE)?)(?=[\"']?=))")
_SIGN, _GAP = r"(?:=>|[:=])", r"[\x20\t]*+"
_CONTEXT = re.compile("|".join((
    rf"(?ai:\bpass[\x20_-]?phrase)[\"']?{_GAP}{_SIGN}{_GAP}[\"']?([a-z]{{3,}}+(?:\x20[a-z]{{3,}}+){{3,23}}+)(?=[\"'.,;\r\n]|\Z)",
    rf"{_NAME}(?:(?:[_-][A-Za-z0-9]{{1,24}}+){{0,3}}+[\"']?{_GAP}{_SIGN}|[\"']?{_GAP}(?ai:is|was)[\x20\t]){_GAP}[\"']?([^\s\"'<>(){{}}\[\],;]{{6,}})",
    rf"(?ai:\bauthorization)[\"']?{_GAP}{_SIGN}{_GAP}[\"']?(?ai:basic|digest)[\x20\t]++([A-Za-z0-9+/_.=~-]{{6,}})",
    r"://[^\s:/?#@]++:([^\s/@]{6,})@",
    r"(?ai:\bbearer)[\x20\t]++([A-Za-z0-9+/_.=~-]{6,})")))


def base_spans(text: str | None) -> list[Span]:
    if not text:
        return []
    found: list[Span] = []
    lowered = text.lower()
    if any(n in lowered for n in _NAMES):
        found += (("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6)
    if "AKIA" in text:
        found += (("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20)
    found += (("hex", *m.span()) for m in _HEX.finditer(text))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- guess cost ---------------------------------------------------------------------------------------

# Rows of a keyboard, from left to right, and letters that digits stand for.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "~!@#$%^&*()_+", "QWERTYUIOP{}|", "ASDFGHJKL:\"", "ZXCVBNM<>?")
_LEET = str.maketrans("013457@$!", "oieastasi")
_FULL_DATE = re.compile(r"(?:19|20)[0-9]{2}([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}")
_YEAR = re.compile("(?:19|20)[0-9]{2}")
_LOG_DATE, _LOG_YEAR = math.log10(365 * 120), math.log10(120)
_LOG_WALK = math.log10(47 * 4)
_LOG_CUT = math.log10(2)   # a cut more makes a pattern harder to guess
_CLASSES = ((re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[0-9]"), 10), (re.compile("[^A-Za-z0-9]"), 33))


def _adjacent() -> set[str]:
    pairs: set[str] = set()
    for r, row in enumerate(_ROWS):
        for i, c in enumerate(row):
            near = [row[i + 1:i + 2]]
            if r % 4 < 3:
                below = _ROWS[r + 1]
                near += [below[max(0, i - 1 - (r % 4 == 0)):][:1], below[i - (r % 4 == 0):][:1] if i else ""]
            for x in near:
                if x:
                    pairs |= {c + x, x + c}
    return pairs


_NEAR = _adjacent()


def read_dictionary(path: str) -> dict[str, float]:
    """log10 of the rank of each word of three or more letters in a rank file."""
    out: dict[str, float] = {}
    with open(path, "rb") as f:
        for n, line in enumerate(f):
            if n >= MAX_DICTIONARY:
                raise ValueError(f"{path} has more than {MAX_DICTIONARY} entries")
            token, rank = line.split()
            word = base64.b64decode(token).decode("utf-8", "ignore").strip().lower()
            if len(word) >= 3 and word.isalpha():
                out.setdefault(word, math.log10(int(rank) + 2))
    # Common words of passwords, ahead of the rank file's.
    for rank, word in enumerate(("password", "admin", "letmein", "welcome", "secret", "changeme", "example", "qwerty", "dragon", "monkey", "master", "login", "default", "test", "user", "root", "guest", "hello")):
        out[word] = min(out.get(word, 9.0), math.log10(rank + 2))
    return out


class _Starts:
    """The cheapest start of a segment that costs the logarithm of its length, among all starts in a run.

    Of two starts, once the earlier one is as cheap as the later one it stays so, as the logarithm of the
    longer length grows slower.  So starts lie on a stack, the later on top, each with the end at which
    the one beneath takes over; those ends fall towards the top, and each start enters and leaves once."""

    def __init__(self):
        self.first, self.stack = -1, []

    def least(self, first: int, at: int, cost: float, shift: int, end: int) -> float:
        """Adds the start ``at`` of cost ``cost`` to the run that begins at ``first``; the lowest sum of
        a start's cost and log10 of (``end`` - start + ``shift``)."""
        stack = self.stack
        if first != self.first:
            self.first = first
            stack.clear()
        at -= shift
        while stack and stack[-1][2] <= end:
            stack.pop()
        over = math.inf
        while stack:
            i, c, until = stack[-1]
            d = cost - c
            over = at if d > 15 else at + (at - i) / (10 ** d - 1) if d > 1e-12 else math.inf
            if over < until:
                break
            stack.pop()
        if over > end:
            stack.append((at, cost, over))
        at, cost, _ = stack[-1]
        return cost + math.log10(end - at)


def guesses_log10(value: str, dictionary: dict[str, float]) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``."""
    n = len(value)
    each = math.log10(sum(size for c, size in _CLASSES if c.search(value)) or 1)
    lower = value.lower()
    plain = lower.translate(_LEET) if len(lower) == n else value
    lower = lower if len(lower) == n else value
    by_end: dict[int, list[tuple[int, float]]] = {}
    for at in range(n):
        if value[at].isdigit():
            for form, cost in ((_FULL_DATE, _LOG_DATE), (_YEAR, _LOG_YEAR)):
                if m := form.match(value, at):
                    by_end.setdefault(m.end(), []).append((at, cost))
    best = [0.0] * (n + 1)
    same = walk = step = 0     # characters of the run that ends here: equal, keyboard walk, sequence
    delta = 0
    period = [0] * 9           # characters that repeat what stands k before
    sames, walks, steps, periods = _Starts(), _Starts(), _Starts(), [_Starts() for _ in range(9)]
    for end in range(1, n + 1):
        i = end - 1
        if i:
            same = same + 1 if value[i] == value[i - 1] else 0
            walk = walk + 1 if value[i - 1:end] in _NEAR else 0
            d = ord(value[i]) - ord(value[i - 1])
            step, delta = (step + 1, d) if d == delta and abs(d) == 1 else (int(abs(d) == 1), d)
            for k in range(2, 9):
                period[k] = period[k] + 1 if i >= k and value[i] == value[i - k] else 0
        low = best[i] + each
        for k in range(3, min(MAX_WORD, end) + 1):
            at = end - k
            word = lower[at:end]
            cost = dictionary.get(word)
            extra = 0.0 if value[at:end] == word else _LOG_CUT
            if cost is None and (cost := dictionary.get(plain[at:end])) is not None:
                extra = 2 * _LOG_CUT
            if cost is not None:
                low = min(low, best[at] + cost + extra + _LOG_CUT)
        for at, cost in by_end.get(end, ()):
            low = min(low, best[at] + cost + _LOG_CUT)
        # runs, walks, sequences and repeats may begin anywhere in the longest one that ends here
        if same >= 2:
            low = min(low, sames.least(i - same, end - 3, best[end - 3], 0, end) + each + _LOG_CUT)
        if walk >= 3:   # 0.3 for each step; counted from the value's start, so that starts compare
            low = min(low, walks.least(i - walk, end - 4, best[end - 4] - 0.3 * (end - 4), 0, end) + _LOG_WALK + i * 0.3)
        if step >= 2:
            low = min(low, steps.least(i - step, end - 3, best[end - 3], 0, end) + each + _LOG_CUT)
        for k in range(2, 9):
            if period[k] >= k:   # the block once, then its number of repeats
                low = min(low, periods[k].least(end - period[k], end - k, best[end - k], k, end) - math.log10(k) + _LOG_CUT)
        best[end] = low
    return best[n]


def added_spans(text: str | None, base: list[Span], dictionary: dict[str, float], least: float = MIN_GUESSES_LOG10) -> Iterator[Span]:
    """Values in credential contexts that cost at least ``least`` (log10) guesses."""
    if not text:
        return
    lowered = text.lower()
    if not any(w in lowered for w in _CONTEXT_WORDS):
        return
    for m in _CONTEXT.finditer(text):
        at = m.lastindex
        value = m.group(at).rstrip(".!?:")
        start, end = m.start(at), m.start(at) + len(value)
        if len(value) < 6 or any(a < end and start < b for _, a, b in base):
            continue
        if guesses_log10(value, dictionary) >= least:
            yield "guess", start, end


def scan(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_GUESSES_LOG10) -> DataFrame:
    """(``id_col``, base, spans, max_guesses_log10): arrays of (kind, start, end), and the cost of the
    costliest assigned value (null without one)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_dictionary(ranks_path or public_tokenizers.path(DEFAULT_RANKS)))

    def make():
        words = shared.value

        def f(b: pa.RecordBatch) -> dict:
            out: dict = {"id": b.column(0), "base": [], "spans": [], "max_guesses_log10": []}
            for t in b.column(1).to_pylist():
                base = base_spans(t)
                spans = ordered([*base, *added_spans(t, base, words, least)])
                costs = [guesses_log10(_ASSIGN.match(t, s).group(2), words) for k, s, _ in base if k == "assign"]
                costs += [guesses_log10(t[s:e], words) for k, s, e in spans if k == "guess"]
                out["base"].append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                out["spans"].append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                out["max_guesses_log10"].append(max(costs, default=None))
            return out
        return f

    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind:string,start:int,end:int>>"
    out = map_rows(docs.select(id_col, F.col(text_col).cast("string").alias("text")), make, f"id {kind}, base {span}, spans {span}, max_guesses_log10 double")
    return out.withColumnRenamed("id", id_col)
