"""The range-partitioned fold equals a single-process fold, hot keys included."""
import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orderpulse.operators.delivery import DeliveryFold
from orderpulse.operators.ordered_fold import brute_force_fold, ordered_fold
from orderpulse.operators.ratelimit import RateFold
from orderpulse.operators.reserve import StockFold, reserve_scan

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _check(spark, pdf, schema, key, order, fold, parts, cols):
    want = brute_force_fold(pdf, key, order, fold)[[*pdf.columns, *cols]]
    got = ordered_fold(spark.createDataFrame(pdf, schema), key, order, fold, parts).toPandas()
    a = got.sort_values(order + [key]).reset_index(drop=True)[want.columns]
    b = want.sort_values(order + [key]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 9)), min_size=1, max_size=400),
       st.integers(2, 20), st.integers(5, 60))
def test_stock_fold_matches_brute_force(spark, rows, parts, stock):
    # key 0 is hot: most rows, spread over several range partitions
    pdf = pd.DataFrame({"k": [f"p{0 if i % 5 else k}" for i, (k, _) in enumerate(rows)],
                        "seq": np.arange(len(rows)), "quantity": [q for _, q in rows]})
    _check(spark, pdf, "k string, seq long, quantity int", "k", ["seq"], StockFold(stock), parts,
           ["status", "remaining"])


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 40000)), min_size=1, max_size=400),
       st.integers(2, 20))
def test_rate_fold_matches_brute_force(spark, rows, parts):
    t = np.sort(np.array([x for _, x in rows]))
    pdf = pd.DataFrame({"k": [f"t{k}" for k, _ in rows], "seq": np.arange(len(rows)), "req_ms": t})
    _check(spark, pdf, "k string, seq long, req_ms long", "k", ["req_ms", "seq"],
           RateFold("req_ms", 1000), parts, ["window_start", "request_count"])


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([None, 200, 500, 404])), min_size=1,
                max_size=200), st.integers(2, 16))
def test_delivery_fold_matches_brute_force(spark, rows, parts):
    ts = pd.date_range("2024-01-01", periods=len(rows), freq="s")
    pdf = pd.DataFrame({"d": [k for k, _ in rows], "seq": np.arange(len(rows)), "ts": ts,
                        "http_status": pd.array([h for _, h in rows], dtype="Int64"),
                        "error": ["timeout" if h is None else None for _, h in rows]})
    _check(spark, pdf, "d long, seq long, ts timestamp, http_status int, error string", "d", ["seq"],
           DeliveryFold(), parts, ["status", "attempt_count", "last_http_status", "next_attempt_us"])


@given(st.lists(st.integers(1, 7), max_size=300), st.integers(0, 100))
def test_reserve_scan_invariants(q, stock):
    q = np.array(q, dtype=np.int64)
    taken, left = reserve_scan(q, stock)
    assert 0 <= left <= stock
    assert int(q[taken].sum()) == stock - left
    # plain loop agrees
    s = stock
    for i, v in enumerate(q):
        ok = s >= v
        assert ok == taken[i]
        s -= v if ok else 0
