"""Ops 2, 4, 6 and 10: plain forms of the patterns, Viterbi against enumeration, edge rows."""
import itertools
import math
import re

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from orderpulse.llm import fixity, langid, pii, secret_scan, viterbi
from pyspark.sql import functions as F

EDGE = [(None, None), (1, ""), (2, "  \n"), (3, "123 456"), (4, "mail a@b.co, 10.0.0.1"), (4, "mail a@b.co, 10.0.0.1"), (5, "the house " * 5000)]
SCHEMA = "doc_id long, text string, lang string, spans int, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], SCHEMA)


def plain_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return pii.ordered(out)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from([*"a@.+-( )%_,é", "1", "25", "4111111111111111", "1.2.3.4", "+1 (555) 555-0100", "x@y.zz"]), max_size=25).map("".join))
def test_pii_patterns(text):
    assert pii.base_spans(text) == plain_pii(text)


def plain_secrets(t):
    rx = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out = [("assign", *m.span()) for m in re.finditer(rx, t) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return secret_scan.ordered(out)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from([*"ab0=:\"' ſK", "Token", "api_KEY", "password", "passwd", "AKIA", "ABCDEF0123456789", "deadbeef0123"]), max_size=25).map("".join))
def test_secret_patterns(text):
    assert secret_scan.base_spans(text) == plain_secrets(text)


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 10 ** 6))
def test_viterbi(seed):
    r = np.random.default_rng(seed)
    lengths = np.sort(r.integers(1, 6, 5))[::-1]
    starts, e, tr = np.concatenate(([0], np.cumsum(lengths)))[:-1], r.normal(size=(int(lengths.sum()), 3)), r.normal(size=(3, 3))
    for matrix, walk in ((tr, lambda o: viterbi.walk(starts, lengths, lambda x: e[x], tr, o)),
                         (-0.7 * (1 - np.eye(3)), lambda o: viterbi.walk_switching(starts, lengths, lambda x: e[x], 0.7, o))):
        out = np.zeros(len(e), int)
        walk(out)
        for s, n in zip(starts, lengths):
            value = lambda p: sum(e[s + i, x] for i, x in enumerate(p)) + sum(matrix[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
            assert abs(value(out[s:s + n].tolist()) - max(map(value, itertools.product(range(3), repeat=int(n))))) < 1e-9


def test_edges(spark):
    docs = frame(spark, EDGE)
    crf = pii.train(pii.labelled_table(spark))
    got = pii.digest(pii.find(docs, crf)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in EDGE)
    assert all(r.spans == pii.listed(plain_pii(dict(EDGE)[r.doc_id] or "")) for r in got)
    assert len(pii.digest(secret_scan.scan(docs), secret_scan.BASE_KINDS).collect()) == len(EDGE)
    model = langid.train(docs.where("doc_id is not null"))
    by = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert by == {None: ("und", 0.0), 1: ("und", 0.0), 2: ("und", 0.0), 3: ("und", 0.0), 4: ("en", 1.0), 5: ("en", 1.0)}
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert pii.find(docs.limit(0), crf).count() == 0


ITEMS = {"email": ("a [at] x [dot] com", "bob(at)post.net", "t.weber [at] mail7 [dot] co [dot] uk"), "phone": ("(555) 123-4567", "555-765-4321"),
         "ip": ("fe80::1234:5678", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:db8:1:2:3:4:5:6"),
         "card": ("4111 1111 1111 1111", "5500000000000004", "4111-1111-1111-1111")}


def test_neighbours_of_one_kind_are_found_one_by_one():
    for kind, items in ITEMS.items():
        for n in (1, 2, 3):
            for row in itertools.product(items, repeat=n):
                for sign in (" ", "\n", ", ", ". "):
                    text = sign.join(row)
                    label = np.full(len(text.split()), pii.LABELS.index(kind), np.int8)
                    assert [text[a:b] for _, a, b in pii._accepted(text, label, [])] == list(row)
    tagger = pii.Tagger(pii.Crf.train(pii.labelled_rows()))
    for kind, items in (("email", ["a [at] x [dot] com", "b [at] y [dot] com"]), ("phone", ["(555) 123-4567", "(555) 765-4321"]),
                        ("email", ["ann@example.com", "bob(at)post.net"]), ("email", ["bob(at)post.net", "ann@example.com", "lee(at)web.org"]),
                        ("ip", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"])):
        for sign in ("\n", ", "):
            text = "from " + sign.join(items) + " to here"
            assert [(k, text[a:b]) for k, a, b in tagger.spans([text])[0][1]] == [(kind, x) for x in items]


def test_mixed_text_gets_spans(spark):
    rows = [(i, "the cat and the dog went home", "en") for i in range(9)] + [(20 + i, "кошка и собака пошли домой", "ru") for i in range(9)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [x for *_, x in langid.spans("the cat went home. кошка пошли домой", model)] == ["en", "ru"]


def test_guess_cost():
    words = secret_scan.read_dictionary(public_tokenizers.path(secret_scan.DEFAULT_RANKS))
    cost = lambda v: secret_scan.guesses_log10(v, words)
    assert max(map(cost, ("password", "changeme1234", "aaaaaaaaaaaa", "qwertyuiop", "20240117"))) < 7 < 15 < cost("xK9$vQ2!mZ7p")
    text = "pwd: xK9$vQ2!mZ7p and passphrase is changeme1234"
    assert [text[a:b] for _, a, b in secret_scan.added_spans(text, [], words)] == ["xK9$vQ2!mZ7p"]


def plain_guesses(v, words):
    """The cheapest segmentation, every segment tried from every start."""
    each = math.log10(sum(n for c, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[^A-Za-z0-9]", 33)) if re.search(c, v)))
    cut, best = math.log10(2), [0.0]
    day = "(0[1-9]|[12][0-9]|3[01])"
    dates = [rf"(19|20)\d\d([-/._]?)(0[1-9]|1[0-2])\2{day}", rf"{day}([-/._]?)(0[1-9]|1[0-2])\2(19|20)\d\d"]
    for end in range(1, len(v) + 1):
        costs = [best[end - 1] + each]
        for at in range(end):
            x, n = v[at:end], end - at
            steps = {ord(b) - ord(a) for a, b in itertools.pairwise(x)}
            log = math.log10(n)
            if x in words:
                costs.append(best[at] + words[x] + cut)
            if any(re.fullmatch(d, x) for d in dates):
                costs.append(best[at] + math.log10(365 * 120) + cut)
            if re.fullmatch(r"(19|20)\d\d", x):
                costs.append(best[at] + math.log10(120) + cut)
            if n >= 3 and len(steps) == 1 and steps <= {0, 1, -1}:
                costs.append(best[at] + each + log + cut)
            if n >= 4 and all(a + b in secret_scan._NEAR for a, b in itertools.pairwise(x)):
                costs.append(best[at] + math.log10(47 * 4) + log + (n - 1) * 0.3)
            for k in range(2, 9):
                if n >= 2 * k and x[k:] == x[:-k]:
                    costs.append(best[at + k] + math.log10((n - k) / k + 1) + cut)
        best.append(min(costs))
    return best[-1]


@settings(deadline=None, max_examples=600)
@given(st.lists(st.sampled_from([*"aabc1209w", "aaaaa", "qwerty", "asdf", "abcd", "9876", "banana", "2012", "01011999", "12.01.2003", "abab", "abcabc"]), min_size=1, max_size=9).map("".join),
       st.dictionaries(st.sampled_from(["banana", "aaa", "bqwe", "aab", "ban", "qwer", "wer", "cab", "tyasd"]), st.sampled_from([0.3, 1.0, 3.0]), max_size=6))
def test_guess_cost_is_the_lowest(value, words):
    assert abs(secret_scan.guesses_log10(value, words) - plain_guesses(value, words)) < 1e-9


def test_every_context_value_is_decided_by_its_cost():
    words = secret_scan.read_dictionary(public_tokenizers.path(secret_scan.DEFAULT_RANKS))
    found = lambda t: [t[a:b] for _, a, b in secret_scan.added_spans(t, secret_scan.base_spans(t), words)]
    for value in ("qzxjvkwpmrtbhd", "correcthorsebatterystaple", "xK9$vQ2!mZ7p"):
        assert found(f"the passphrase is {value}. Bye") == [value]
        for gap in ("", " ", " " * 9, "\t", " \t" * 3000):
            assert found(f"pwd:{gap}{value}\npwd{gap}= {value}\nbearer \t{gap}{value.replace('$', '-').replace('!', '-')}")[:2] == [value] * 2
            assert len(found(f"client key{gap}={gap}'{value}'; Bearer{gap or ' '}abcdefzq7kwpmrtb")) == 2
    assert found("the password is incorrectly typed, the token was automatically made") == []


def test_fixity_locates_damage(spark):
    rows = [(i, f"u{i}", f"body {i}") for i in range(40)] + [(None, None, None), (7, "u7", "body 7")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    html = F.coalesce(F.col("html"), F.lit(""))
    same = fixity.audit_pages(pages, html).collect()
    assert len(same) == len(rows) and {r.state for r in same} == {"intact"}
    got = {r.record: r.state for r in fixity.audit_pages(pages, F.when(F.col("page_id") == 30, "bODY 30").otherwise(html)).collect()}
    assert [k for k, v in got.items() if v == "corrupt"] == [32] and set(got.values()) == {"intact", "corrupt"}
    cut = {r.record: r.state for r in fixity.audit_pages(pages, F.when(F.col("page_id") == 30, "").otherwise(html)).collect()}
    assert cut[32] == "corrupt" and all(cut[i] == "moved" for i in range(33, 42))
    assert fixity.audit_pages(pages.limit(0), html).count() == 0


def _plain_audit(a, b):
    """{(file, record): state} by comparing every record."""
    out = {}
    for place in a.keys() | b.keys():
        x, y = a.get(place), b.get(place)
        out[place] = "extra" if x is None else "missing" if y is None else "intact" if x == y else "moved" if x[1:] == y[1:] else "corrupt"
    return out


def test_fixity_of_many_files_against_every_record_compared(spark):
    """Damage, lost and added records, moved ones and a file that only one replica has."""
    a = {(f, r): (r * 10, 10, f"d{f}-{r}") for f in range(4) for r in range(fixity.FILE_RECORDS if f < 2 else 300)}
    b = {k: v for k, v in a.items() if k not in ((0, 4095), (1, 17)) and k[0] != 3}
    b |= {(0, 5): (50, 10, "other"), (1, 4000): (40001, 10, "d1-4000"), (2, 300): (3000, 10, "new"), (5, 0): (0, 10, "new file")}
    names = "page_id long, warc_file long, record long, offset long, length long, digest string"
    frame = lambda rows: spark.createDataFrame([(f * 10000 + r, f, r, *v) for (f, r), v in rows.items()], names)
    got = fixity.audit(frame(a), frame(b)).collect()
    assert len(got) == len(a.keys() | b.keys())
    assert {(r.warc_file, r.record): r.state for r in got} == _plain_audit(a, b)
    assert {r.state for r in got} == {"intact", "corrupt", "moved", "missing", "extra"}
    assert all((r.root is None) == (r.warc_file == 5) and r.page_id == r.warc_file * 10000 + r.record for r in got)


def test_fixity_ignores_extra_columns(spark):
    pages = spark.createDataFrame([(i, f"u{i % 3}", None if i == 4 else f"b{i}", 1, "x", "y", 0) for i in range(20)],
                                  "page_id long, url string, html string, record long, digest string, state string, place long")
    assert {r.state for r in fixity.audit_pages(pages, F.col("html")).collect()} == {"intact"}


def test_credential_names_inside_longer_ones_and_other_contexts():
    words = secret_scan.read_dictionary(public_tokenizers.path(secret_scan.DEFAULT_RANKS))
    found = lambda t: [t[a:b] for _, a, b in secret_scan.added_spans(t, secret_scan.base_spans(t), words)]
    value = "xK9vQ2mZ7pLw4"
    for text in ("aws_secret_access_key = {}", "DB_PASS={}", "MYSQL_PWD: {}", "user_pwd={}", "auth_token_x: {}", "PGPASS='{}'", "Authorization: Basic {}",
                 "userPwd => {}", "postgres://admin:{}@db.example.com/x", "db-pass-main: '{}'"):
        assert found(text.format(value)) == [value], text
    assert found("passphrase: correct horse battery staple\nnext") == ["correct horse battery staple"]
    assert found("the compass is straightforward, the bypass: was closed, see https://example.com:8080/a@b; token-based is a word; PASSENGER=none") == []
    for hard in ("token-" * 20000, "pass_" * 20000 + "=", "://a:" * 20000, "passphrase: " + "abc " * 20000, "://" + "a" * 100000):
        assert found(hard) == []


def test_secrets_of_an_empty_table(spark):
    got = secret_scan.scan(spark.createDataFrame([], "doc_id long, text string, spans string"))
    assert got.count() == 0 and got.columns == ["doc_id", "base", "spans", "max_guesses_log10"]
