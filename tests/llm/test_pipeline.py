"""The corpus pipeline against plain Python, stage by stage, on nulls, copies, near copies and clashing columns."""
import random
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from orderpulse.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, size long, part int"


def _docs():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [prose(r.randint(30, 90)) for _ in range(24)]
    texts += [texts[0], texts[0].upper(), texts[3]]                                   # exact copies
    texts += [t.rsplit(" ", 1)[0] + " changed" for t in texts[4:8]]                    # near copies
    texts += [None, "", "too short", "again and again " * 20, "line\r\n" + prose(40) + "\n\n" + prose(40)]
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t) if t else None, "x", 9, 1) for i, t in enumerate(texts)]
    return rows + [rows[9], (None, prose(50), None, "a", None, "x", None, None)]       # a repeated row, a null id


def _stages(spark, rows, folder):
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    docs, out = spark.read.parquet(path), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        out.append(docs)
    return out


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def _passes(text):
    words = (text or "").split()
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return len(words) >= 10 and 100 * len(inside) <= 20 * len(words)


def _shingles(text):
    words = _lower(text).split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    rows = _docs()
    return folder, rows, _stages(spark, rows, folder)


def test_columns_pass_through(run):
    for out in run[2][:-1]:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "sha", "size", "part"]


def test_quality_keeps_what_the_rules_pass(run):
    want = sorted((str(r[0]), r[1]) for r in run[1] if _passes(r[1]))
    assert sorted((str(r.doc_id), r.text) for r in run[2][0].collect()) == want and len(want) < len(run[1])


def test_exact_dedup_keeps_the_largest_id_of_each_text(run):
    best = {}
    for r in run[2][0].collect():
        key = -1 if r.doc_id is None else r.doc_id
        best[_lower(r.text)] = max(key, best.get(_lower(r.text), -1))
    got = run[2][1].collect()
    assert {_lower(r.text): -1 if r.doc_id is None else r.doc_id for r in got} == best and len(got) == len(best)


def test_near_dedup_keeps_one_of_each_group(run):
    rows = run[2][1].collect()
    sets = [_shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    kept = [r.text for r in run[2][2].collect()]
    groups = [find([r.text for r in rows].index(t)) for t in kept]
    assert sorted(groups) == sorted({find(i) for i in range(len(rows))}) and len(kept) < len(rows)


def test_mixing_comes_near_the_targets_with_whole_documents(run):
    before, after = run[2][2].collect(), run[2][3].collect()
    size = defaultdict(int)
    for r in before:
        size[r.source] += len(r.text.split())
    named = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(named)}
    target, rest, left = {}, float(sum(size.values())), list(named)
    while left:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        full = [s for s in left if share[s] > 3 * size[s]]
        target |= {s: 3 * size[s] for s in full} if full else share
        rest -= sum(3 * size[s] for s in full)
        left = [s for s in left if s not in full] if full else []
    taken, longest = defaultdict(int), max(len(r.text.split()) for r in before)
    for r in after:
        taken[r.source] += len(r.text.split())
    assert all(target[s] - 1 <= taken[s] < target[s] + longest + 1 for s in named)
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}


def test_encoding_counts_the_library_tokens(run):
    library = tiktoken.Encoding("lib", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.DEFAULT_RANKS)))
    want = sorted((str(r.doc_id), len(library.encode_ordinary(r.text))) for r in run[2][3].collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in run[2][4].collect()) == want


def test_run_gives_the_rows_of_the_stages_and_takes_an_empty_table(spark, run, tmp_path):
    folder, _, outs = run
    got = corpus_pipeline.run(spark, str(folder))
    assert sorted(map(str, got.collect())) == sorted(map(str, outs[-1].collect()))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    empty = corpus_pipeline.run(spark, str(tmp_path))
    assert empty.count() == 0 and empty.columns == got.columns
