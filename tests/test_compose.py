"""Transfer functions compose exactly: compose(f, g) applied == g applied after f."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from orderpulse.operators.delivery import DeliveryFold
from orderpulse.operators.ratelimit import RateFold
from orderpulse.operators.reserve import StockFold


def _slices(values, cuts):
    cuts = sorted(set(c % (len(values) + 1) for c in cuts))
    edges = [0] + cuts + [len(values)]
    return [values[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _tf(fold, seg):
    tf = fold.tf_identity()
    if len(next(iter(seg.values()))):
        tf = fold.tf_step(tf, seg)
    return fold.tf_finish(tf)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=0, max_size=120), st.lists(st.integers(0, 200), max_size=3),
       st.lists(st.tuples(st.one_of(st.none(), st.integers(-200, 3000)), st.integers(0, 50)), min_size=1, max_size=8))
def test_rate_compose(times, cuts, entries):
    fold = RateFold("t", 100)
    t = np.sort(np.array(times, dtype=np.int64))
    parts = [_tf(fold, {"t": x}) for x in _slices(t, cuts)]
    composed = parts[0]
    for p in parts[1:]:
        composed = fold.tf_compose(composed, p)
    first = int(t[0]) if len(t) else 0
    for w, c in entries:
        s = (None, 0) if w is None else (min(w, first), c)
        want = s
        for p in parts:
            want = fold.tf_apply(p, want)
        assert fold.tf_apply(composed, s) == want
        # and the fold itself agrees with the composed function
        _, exit_state = fold.step(None, {"t": t}, s) if len(t) else (None, s)
        assert exit_state == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=80), st.lists(st.integers(0, 100), max_size=3), st.integers(0, 30))
def test_stock_compose(q, cuts, entry):
    fold = StockFold(30)
    q = np.array(q, dtype=np.int64)
    parts = [_tf(fold, {"quantity": x}) for x in _slices(q, cuts)]
    composed = parts[0]
    for p in parts[1:]:
        composed = fold.tf_compose(composed, p)
    assert fold.tf_apply(composed, entry) == fold.step(None, {"quantity": q}, entry)[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([None, 200, 500]), max_size=12), st.lists(st.integers(0, 15), max_size=3),
       st.sampled_from([("PENDING", 0), ("FAILED", 2), ("FAILED", 4), ("DELIVERED", 1)]))
def test_delivery_compose(hs, cuts, phase):
    fold = DeliveryFold()
    n = len(hs)
    seg = {"http_status": np.array([np.nan if h is None else h for h in hs], dtype=float),
           "error": np.array(["timeout" if h is None else None for h in hs], dtype=object),
           "ts": (np.datetime64("2024-01-01") + np.arange(n).astype("timedelta64[s]")).astype("datetime64[ns]")}
    idx = np.arange(n)
    parts = [_tf(fold, {k: v[i] for k, v in seg.items()}) for i in _slices(idx, cuts)]
    composed = parts[0]
    for p in parts[1:]:
        composed = fold.tf_compose(composed, p)
    entry = (phase[0], phase[1], 404, "e", 7, None)
    assert fold.tf_apply(composed, entry) == fold.step(None, seg, entry)[1]
