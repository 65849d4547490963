"""Exact quantiles by selection equal the sorted list's (A10)."""
import math
import random
from collections import defaultdict

import pytest

from orderpulse.operators.quantiles import exact_quantile


def _plain(values, q):
    v = sorted(values)
    if not v:
        return None
    p = (len(v) - 1) * q
    lo, hi = v[math.floor(p)], v[math.ceil(p)]
    return lo + (p - math.floor(p)) * (hi - lo)


@pytest.mark.parametrize("rows_per_slice,q", [(1, 0.99), (9, 0.5), (200, 0.0), (10**6, 1.0)])
def test_quantiles(spark, rows_per_slice, q):
    r = random.Random(rows_per_slice)
    # a key with half of the rows, one value in a third of them, nulls, a null key and a key without values
    rows = [(None if i % 50 == 0 else 0 if i % 2 else r.randint(1, 6), 0.25 if i % 3 == 0 else None if i % 7 == 0 else r.uniform(-5, 1e6))
            for i in range(1500)] + [(99, None), (99, None), (98, 3.5)]
    want, total = defaultdict(list), defaultdict(int)
    for k, v in rows:
        total[k] += 1
        want[k] += [] if v is None else [v]
    got = exact_quantile(spark.createDataFrame(rows, "k int, v double"), "k", "v", q, rows_per_slice=rows_per_slice).collect()
    assert {x.k: x.total for x in got} == total and len(got) == len(total)
    for x in got:
        plain = _plain(want[x.k], q)
        assert x.quantile is None if plain is None else x.quantile == pytest.approx(plain, rel=1e-12, abs=1e-12)


def test_no_rows(spark):
    assert exact_quantile(spark.createDataFrame([], "k int, v double"), "k", "v", 0.9).count() == 0
